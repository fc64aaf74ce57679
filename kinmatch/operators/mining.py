"""Hard negatives: cross-label candidates with counted exclusions, quotas and caps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.functions.hashes import stable_order
from kinmatch.functions.numbers import balanced_round


def excluded(candidates: DataFrame, *, low: float, high: float) -> DataFrame:
    """Candidates with the first rule that excludes them as ``outcome``.

    ``candidates``: both sides' ``_label, _phash, _title`` (normalized), named
    ``query_`` and ``candidate_``, and ``pair_probability``.  A null hash or
    title equals none.
    """
    c = F.col
    outcome = (
        F.when(c("query_label") == c("candidate_label"), "excluded_same_label")
        .when(~c("pair_probability").between(low, high), "excluded_probability")
        .when(c("query_phash") == c("candidate_phash"), "excluded_same_phash")
        .when(c("query_title") == c("candidate_title"), "excluded_exact_title")
        .otherwise("eligible")
    )
    return candidates.withColumn("outcome", outcome)


def per_query_quota(eligible: DataFrame, n: int, variant_share: float) -> DataFrame:
    """At most ``n`` per query: variant conflicts first up to their share (halves to even), ordinary ones after.

    Places that variants leave go to ordinary pairs, never the other way.
    """
    limit = balanced_round(F.lit(n * variant_share))
    strongest = [F.desc("pair_probability"), F.desc("cosine_similarity"), F.asc("candidate_id")]
    w = Window.partitionBy("query_id", "variant_conflict").orderBy(*strongest)
    placed = eligible.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
    variants = placed.groupBy("query_id").agg(F.sum((F.col("variant_conflict") & (F.col("place") <= limit)).cast("int")).alias("kept"))
    return placed.join(variants, "query_id").where(
        F.when(F.col("variant_conflict"), F.col("place") <= limit).otherwise(F.col("place") <= n - F.col("kept"))
    ).drop("place", "kept")


def undirected_strongest(selected: DataFrame) -> DataFrame:
    """One row per unordered pair, that of the highest probability, then cosine."""
    a, b = F.col("query_id"), F.col("candidate_id")
    turned = a > b
    side = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x))
    rows = selected.select(
        F.least(a, b).alias("left_posting_id"), F.greatest(a, b).alias("right_posting_id"),
        side("query_label", "candidate_label").alias("left_label_group"), side("candidate_label", "query_label").alias("right_label_group"),
        "cosine_similarity", "pair_probability", "variant_conflict",
    )
    key = F.struct("pair_probability", "cosine_similarity")
    rest = [c for c in rows.columns if c not in ("left_posting_id", "right_posting_id")]
    return rows.groupBy("left_posting_id", "right_posting_id").agg(F.max_by(F.struct(*rest), key).alias("r")).select("left_posting_id", "right_posting_id", "r.*")


def cap_variants(pairs: DataFrame, share: float) -> DataFrame:
    """Keep the hardest variants so that they are at most ``share`` of all: ``floor(share * ordinary / (1 - share))``.

    The cut-off is found over counts per probability, then ties are ordered
    among the rows of that one probability only.
    """
    if share >= 1:
        return pairs
    variants, ordinary = pairs.where("variant_conflict"), pairs.where("not variant_conflict")
    limit = ordinary.agg(F.floor(share * F.count("*") / (1 - share)).alias("most"))
    by = variants.groupBy("pair_probability").agg(F.count("*").alias("n"))
    over = by.withColumn("bucket", F.floor(F.col("pair_probability") * 10_000))
    sums = over.groupBy("bucket").agg(F.sum("n").alias("bn"))
    above = sums.select("bucket", F.coalesce(F.sum("bn").over(Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("an"))
    inside = Window.partitionBy("bucket").orderBy(F.desc("pair_probability")).rowsBetween(Window.unboundedPreceding, -1)
    before = over.join(above, "bucket").select("pair_probability", (F.coalesce(F.sum("n").over(inside), F.lit(0)) + F.col("an")).alias("before"))
    w = Window.partitionBy("pair_probability").orderBy(F.desc("cosine_similarity"), "left_posting_id", "right_posting_id")
    ranked = variants.withColumn("_p", F.row_number().over(w)).join(before, "pair_probability")
    kept = ranked.crossJoin(F.broadcast(limit)).where(F.col("before") + F.col("_p") <= F.col("most"))
    return kept.select(*pairs.columns).unionByName(ordinary)


def mining_counts(candidates: DataFrame, chosen: DataFrame, deduplicated: DataFrame, capped: DataFrame) -> DataFrame:
    """``counter, n`` of all steps."""
    c = candidates.agg(
        F.count("*").alias("candidates_seen"),
        *[F.coalesce(F.sum((F.col("outcome") == o).cast("long")), F.lit(0)).alias(o) for o in ("excluded_same_label", "excluded_probability", "excluded_same_phash", "excluded_exact_title", "eligible")],
    )
    d, e, f = (x.agg(F.count("*").alias(n)) for x, n in ((chosen, "s"), (deduplicated, "d"), (capped, "c")))
    one = c.crossJoin(d).crossJoin(e).crossJoin(f).select(
        *c.columns, F.col("s").alias("selected_before_symmetric_dedup"), (F.col("s") - F.col("d")).alias("symmetric_duplicates_removed"), (F.col("d") - F.col("c")).alias("variant_quota_removed"),
    )
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("counter"), F.col(n).alias("n")) for n in one.columns])).alias("x")).select("x.*")


def negative_batch(pairs: DataFrame, seed: int, epoch: int, batch: int, n: int) -> DataFrame:
    """A deterministic batch of ``n`` pairs, without repeats if there are enough, else repeated in turns."""
    order = stable_order(f"{seed}:{epoch}:{batch}", F.concat_ws("|", "left_posting_id", "right_posting_id"))
    first = pairs.withColumn("_o", order).orderBy("_o", "left_posting_id", "right_posting_id").limit(n)
    ranked = first.withColumn("_r", F.row_number().over(Window.orderBy("_o", "left_posting_id", "right_posting_id")) - 1)  # at most n rows
    size = ranked.agg(F.count("*").alias("_m"))
    slots = pairs.sparkSession.range(n).select(F.col("id").alias("slot"))
    met = slots.crossJoin(F.broadcast(size)).where("_m > 0").withColumn("_r", F.pmod(F.col("slot"), F.col("_m")))
    return met.join(F.broadcast(ranked), "_r").select("slot", *pairs.columns)
