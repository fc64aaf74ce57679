"""Batch matcher: queries against a catalogue, pair decisions and one entity decision each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.operators.pairs import online_policy, reverse_ranks
from kinmatch.operators.rankers import exact_cosine


def match(queries: DataFrame, catalogue: DataFrame, assignments: DataFrame, probability, *, k: int, threshold: float, reciprocal: int, override: float, margin: float) -> tuple[DataFrame, DataFrame]:
    """Candidates with their decision, and one decision per query.

    ``queries, catalogue``: ``id, v, tokens`` (unit vectors, identity tokens);
    ``assignments``: ``id, entity_id, manual_review``; ``probability``: a
    function of the cosine column.  A query with no accepted candidate is new;
    one with several entities, near the threshold or with a flagged cluster
    goes to review.
    """
    top = exact_cosine(queries, catalogue, k)
    q = queries.select(F.col("id").alias("query_id"), F.col("tokens").alias("qt"))
    c = catalogue.select(F.col("id").alias("candidate_id"), F.col("v").alias("cv"), F.col("tokens").alias("ct"))
    met = top.join(q, "query_id").join(c, "candidate_id")
    back = reverse_ranks(met.select("query_id", "candidate_id", "cv", "score"), catalogue.select("id", "v"))
    conflict = ((F.size("qt") + F.size("ct")) > 0) & (F.col("qt") != F.col("ct"))
    decided = met.join(back, ["query_id", "candidate_id"]).select(
        "query_id", "candidate_id", "score", "rank", "reverse_rank", conflict.alias("variant_conflict"), probability(F.col("score")).alias("pair_probability")
    )
    policy = online_policy(F.col("pair_probability"), F.col("rank"), F.col("reverse_rank"), F.col("variant_conflict"), threshold=threshold, reciprocal=reciprocal, override=override)
    with_entity = decided.withColumn("p", policy).select("*", "p.accepted", "p.reason").drop("p").join(
        assignments.select(F.col("id").alias("candidate_id"), "entity_id", "manual_review"), "candidate_id", "left"
    )
    ok = F.col("accepted")
    per = with_entity.groupBy("query_id").agg(
        F.count_distinct(F.when(ok, F.col("entity_id"))).alias("entities"), F.min(F.when(ok, F.col("entity_id"))).alias("entity_id"),
        F.max(F.when(ok, F.col("pair_probability"))).alias("best"), F.coalesce(F.max(F.when(ok, F.col("manual_review"))), F.lit(False)).alias("flagged"),
    )
    decision = F.when(F.col("best").isNull(), "new_entity").when((F.col("entities") > 1) | (F.col("best") < threshold + margin) | F.col("flagged"), "manual_review").otherwise("matched")
    return with_entity, per.select("query_id", decision.alias("decision"), F.when(F.col("entities") == 1, F.col("entity_id")).alias("entity_id"), "entities", F.col("best").alias("best_probability"))
