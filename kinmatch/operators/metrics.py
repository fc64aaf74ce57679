"""Retrieval and pair metrics.  ``truth``: ``id, label``; every query needs another row of its label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.errors import ContractError
from kinmatch.functions.numbers import f1, safe_divide


def judged(ranking: DataFrame, truth: DataFrame) -> DataFrame:
    """The ranking with ``label, positives, hit``; positives are the other rows of the query's label."""
    sizes = truth.groupBy("label").agg(F.count("*").alias("size"))
    q = truth.join(sizes, "label").select(F.col("id").alias("query_id"), F.col("label"), (F.col("size") - 1).alias("positives"))
    c = truth.select(F.col("id").alias("candidate_id"), F.col("label").alias("_cl"))
    return ranking.join(q, "query_id").join(c, "candidate_id", "left").select(
        *ranking.columns, "label", "positives", F.coalesce((F.col("label") == F.col("_cl")).cast("int"), F.lit(0)).alias("hit")
    )


def per_query(judgements: DataFrame, ks: list[int], ap_at: int, corpus_size: int) -> DataFrame:
    """One row per query: hit rate, recall, precision and F1 at each ``k``, and average precision.

    Precision divides by ``min(k, corpus - 1)``, average precision by
    ``min(positives, ap_at)``.
    """
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    run = judgements.withColumn("hits", F.sum("hit").over(w))
    found = [F.coalesce(F.sum(F.when(F.col("rank") <= k, F.col("hit"))), F.lit(0)).alias(f"found_{k}") for k in ks]
    ap = F.sum(F.when((F.col("rank") <= ap_at) & (F.col("hit") == 1), F.col("hits") / F.col("rank")).otherwise(0.0))
    grouped = run.groupBy("query_id", "label", "positives").agg(*found, ap.alias("_ap"))
    if_none = F.raise_error(F.concat(F.lit("query without a positive: "), F.col("query_id").cast("string")))
    checked = F.when(F.col("positives") > 0, F.col("positives")).otherwise(if_none.cast("long"))
    out: list[Column] = ["query_id", "label", checked.alias("positives"), (F.col("_ap") / F.least(checked, F.lit(ap_at))).alias(f"ap_{ap_at}")]
    for k in ks:
        recall, precision = F.col(f"found_{k}") / checked, F.col(f"found_{k}") / min(k, corpus_size - 1)
        out += [
            (F.col(f"found_{k}") > 0).cast("double").alias(f"hit_rate_{k}"), recall.alias(f"recall_{k}"),
            precision.alias(f"precision_{k}"), f1(precision, recall).alias(f"f1_{k}"),
        ]
    return grouped.select(*out)


def retrieval_metrics(queries: DataFrame, ks: list[int], ap_at: int, by: list[str] | None = None) -> DataFrame:
    """Macro averages over the rows of ``per_query``, overall or by strata."""
    names = [f"{m}_{k}" for k in ks for m in ("hit_rate", "recall", "precision", "f1")]
    aggs = [F.count("*").alias("queries"), F.avg(f"ap_{ap_at}").alias(f"map_{ap_at}"), *[F.avg(n).alias(n) for n in names]]
    return queries.groupBy(*by).agg(*aggs) if by else queries.agg(*aggs)


def retrieval_curve(judgements: DataFrame, ks: list[int], corpus_size: int) -> DataFrame:
    """``k, recall, hit_rate, precision, f1, map`` for each ``k``, in one pass per query."""
    out = None
    for k in ks:
        row = retrieval_metrics(per_query(judgements, [k], k, corpus_size), [k], k).select(
            F.lit(k).alias("k"), F.col(f"recall_{k}").alias("recall"), F.col(f"hit_rate_{k}").alias("hit_rate"),
            F.col(f"precision_{k}").alias("precision"), F.col(f"f1_{k}").alias("f1"), F.col(f"map_{k}").alias("map"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def select_k(curve: DataFrame, target: float) -> DataFrame:
    """Smallest ``k`` that reaches the target recall, else the largest."""
    return curve.agg(F.coalesce(F.min(F.when(F.col("recall") >= target, F.col("k"))), F.max("k")).alias("selected_k"))


def total_positives(truth: DataFrame) -> DataFrame:
    """One row ``total``: directed pairs of one label."""
    sizes = truth.groupBy("label").agg(F.count("*").alias("n"))
    return sizes.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1)), F.lit(0)).alias("total"))


def asked_positives(judgements: DataFrame) -> DataFrame:
    """One row ``total``: directed pairs of one label whose first row was a query."""
    asked = judgements.select("query_id", "positives").distinct()
    return asked.agg(F.coalesce(F.sum("positives"), F.lit(0)).alias("total"))


def _rates(tp: Column, fp: Column, total: Column) -> list[Column]:
    precision = F.when(tp > 0, tp / (tp + fp)).otherwise(0.0)
    recall = safe_divide(tp, total)
    return [precision.alias("precision"), recall.alias("recall"), f1(precision, recall).alias("f1")]


def pair_metrics_at(judgements: DataFrame, totals: DataFrame, threshold: float) -> DataFrame:
    """Directed pairs at a threshold; positives that were not retrieved count as missed."""
    at = F.col("score") >= threshold
    sums = judgements.agg(
        F.coalesce(F.sum((at & (F.col("hit") == 1)).cast("long")), F.lit(0)).alias("true_positive"),
        F.coalesce(F.sum((at & (F.col("hit") == 0)).cast("long")), F.lit(0)).alias("false_positive"),
    )
    tp, fp, total = F.col("true_positive"), F.col("false_positive"), F.col("total")
    return sums.crossJoin(totals).select(F.lit(threshold).alias("threshold"), *_rates(tp, fp, total), tp, fp, (total - tp).alias("false_negative"))


def threshold_points(judgements: DataFrame, totals: DataFrame) -> DataFrame:
    """Metrics at every distinct score; tied scores are taken together.

    Scores are aggregated first and summed in a sorted, partitioned order:
    each range of scores sums for itself and adds what the higher ranges hold.
    """
    by_score = judgements.groupBy("score").agg(F.sum("hit").alias("tp"), F.sum(1 - F.col("hit")).alias("fp"))
    # ranges of scores by their leading decimals keep the running sum out of one task
    bucketed = by_score.withColumn("bucket", F.floor(F.col("score") * 1000))
    over = bucketed.groupBy("bucket").agg(F.sum("tp").alias("btp"), F.sum("fp").alias("bfp"))
    higher = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    above = over.select("bucket", F.coalesce(F.sum("btp").over(higher), F.lit(0)).alias("atp"), F.coalesce(F.sum("bfp").over(higher), F.lit(0)).alias("afp"))
    inside = Window.partitionBy("bucket").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    run = bucketed.select("bucket", "score", F.sum("tp").over(inside).alias("itp"), F.sum("fp").over(inside).alias("ifp"))
    sums = run.join(above, "bucket").select("score", (F.col("itp") + F.col("atp")).alias("true_positive"), (F.col("ifp") + F.col("afp")).alias("false_positive"))
    tp, fp, total = F.col("true_positive"), F.col("false_positive"), F.col("total")
    return sums.crossJoin(totals).select(F.col("score").alias("threshold"), *_rates(tp, fp, total), tp, fp, (total - tp).alias("false_negative"))


def select_threshold(points: DataFrame) -> DataFrame:
    """The point of best F1, then precision, then threshold."""
    row = F.struct(*points.columns)
    return points.agg(F.max_by(row, F.struct("f1", "precision", "threshold")).alias("r")).select("r.*")


def precision_at_recall(points: DataFrame, floor: float) -> DataFrame:
    """The point of best precision, then threshold, among those that reach the recall; an error if none does."""
    row = F.struct(*points.columns)
    best = F.max_by(F.when(F.col("recall") >= floor, row), F.when(F.col("recall") >= floor, F.struct("precision", "threshold")))
    met = points.agg(best.alias("r"))
    return met.select(F.coalesce("r", F.raise_error(F.lit("no threshold reaches the recall")).cast(points.select(row.alias("r")).schema["r"].dataType)).alias("r")).select("r.*")


def threshold_curve(judgements: DataFrame, totals: DataFrame, steps: int = 40) -> DataFrame:
    """Metrics at ``i / steps``; each pair is counted once, into the last point it reaches."""
    reach = F.least(F.floor(F.col("score") * steps), F.lit(steps)).cast("int")
    # a product may round past the point that the score itself does not reach
    reach = F.when(F.col("score") < reach / steps, reach - 1).when((reach < steps) & (F.col("score") >= (reach + 1) / steps), reach + 1).otherwise(reach)
    counted = judgements.groupBy(reach.alias("at")).agg(F.sum("hit").alias("tp"), F.sum(1 - F.col("hit")).alias("fp"))
    points = judgements.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("i"))
    sums = points.join(F.broadcast(counted), F.col("at") >= F.col("i"), "left").groupBy("i").agg(
        F.coalesce(F.sum("tp"), F.lit(0)).alias("true_positive"), F.coalesce(F.sum("fp"), F.lit(0)).alias("false_positive")
    )
    tp, fp, total = F.col("true_positive"), F.col("false_positive"), F.col("total")
    return sums.crossJoin(totals).select((F.col("i") / steps).alias("threshold"), *_rates(tp, fp, total), tp, fp, (total - tp).alias("false_negative"))


def failure_kinds(queries: DataFrame, k: int) -> DataFrame:
    """``failure, queries`` by recall: none, partial or complete."""
    r = F.col(f"recall_{k}")
    return queries.groupBy(F.when(r >= 1, "none").when(r > 0, "partial").otherwise("complete").alias("failure")).agg(F.count("*").alias("queries"))


def group_strata(queries: DataFrame, strata: dict[str, str], k: int) -> DataFrame:
    """``dimension, value, queries, recall, zero_recall`` by each dimension on its own, in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(c).cast("string").alias("value")) for d, c in strata.items()]))
    r = F.col(f"recall_{k}")
    rows = queries.select(r.alias("r"), each.alias("s")).select("r", "s.*")
    return rows.groupBy("dimension", "value").agg(F.count("*").alias("queries"), F.avg("r").alias("recall"), F.sum((F.col("r") == 0).cast("long")).alias("zero_recall"))


def best_positive(judgements: DataFrame) -> DataFrame:
    """``query_id, best_rank, best_score`` of the first right candidate (null if none), and the first score."""
    return judgements.groupBy("query_id").agg(
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("best_rank"), F.max(F.when(F.col("hit") == 1, F.col("score"))).alias("best_score"),
        F.max("score").alias("top_score"),
    )


def review_examples(judgements: DataFrame, most: int = 40) -> DataFrame:
    """First queries of each outcome, in order of their id: ``bucket, query_id, best_rank, place``."""
    best = judgements.groupBy("query_id").agg(F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("best_rank"))
    bucket = F.when(F.col("best_rank") == 1, "top1_success").when(F.col("best_rank").isNull(), "retrieval_miss").otherwise("top1_false_match")
    w = Window.partitionBy("bucket").orderBy("query_id")
    return best.withColumn("bucket", bucket).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def select_weight(scores: DataFrame) -> DataFrame:
    """``weight, score`` of the best fusion weight: score, then nearness to one half, then the smaller weight."""
    key = F.struct("score", (-F.abs(F.col("weight") - 0.5)).alias("a"), (-F.col("weight")).alias("b"))
    return scores.agg(F.max_by(F.struct("weight", "score"), key).alias("r")).select("r.*")


def modality_review(tops: DataFrame) -> DataFrame:
    """``bucket, queries`` of eight overlapping outcomes.

    ``tops``: ``query_id``, right-at-first flags ``image, text, simple, pair``,
    first candidates ``image_top, text_top``, ``pair_any`` (a right one at any
    rank) and ``conflict``.
    """
    c = F.col
    flags = {
        "pair_top1_false_match": ~c("pair"), "pair_retrieval_miss": ~c("pair_any"),
        "pair_head_regression": c("simple") & ~c("pair"), "pair_head_rescue": ~c("simple") & c("pair"),
        "image_rescue": c("image") & ~c("text"), "text_rescue": c("text") & ~c("image"),
        "modality_disagreement": c("image_top") != c("text_top"), "variant_token_conflict": c("conflict"),
    }
    one = tops.agg(*[F.coalesce(F.sum(v.cast("long")), F.lit(0)).alias(k) for k, v in flags.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("bucket"), F.col(k).alias("queries")) for k in flags])).alias("x")).select("x.*")


def first_and_all_misses(judgements: DataFrame) -> DataFrame:
    """One row ``queries, top1_false_matches, zero_recall_queries`` of a judged ranking."""
    one = judgements.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("hit"))).alias("first"), F.max("hit").alias("any_"))
    return one.agg(
        F.count("*").alias("queries"), F.sum((F.coalesce("first", F.lit(0)) == 0).cast("long")).alias("top1_false_matches"),
        F.sum((F.col("any_") == 0).cast("long")).alias("zero_recall_queries"),
    )


def validation_bundle(judgements: DataFrame, ks: list[int], ap_at: int, rows: int) -> DataFrame:
    """Retrieval metrics of a ranking beside its best threshold, one row."""
    point = select_threshold(threshold_points(judgements, asked_positives(judgements)))
    chosen = point.select("threshold", "precision", "recall", F.col("f1").alias("pair_f1"))
    return retrieval_metrics(per_query(judgements, ks, ap_at, rows), ks, ap_at).crossJoin(F.broadcast(chosen))


def reproduced(values: dict[str, float], expected: dict[str, float], tolerance: float = 1e-4) -> None:
    """An error unless each expected value came out again within the tolerance."""
    wrong = sorted(k for k, v in expected.items() if abs(values[k] - v) > tolerance)
    if wrong:
        raise ContractError(f"not reproduced: {wrong}")
