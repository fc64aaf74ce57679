"""Undirected candidate pairs: folding, gates, reverse ranks, edge and probability metrics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.functions.numbers import f1, safe_divide
from kinmatch.operators.rankers import HELD_SCORES, grid_cells
from kinmatch.runtime import Scratch

PAIR = (
    "left_posting_id", "right_posting_id", "cosine_similarity", "pair_probability", "left_rank", "right_rank", "variant_conflict",
)


def fold_directed(ranking: DataFrame, k: int) -> DataFrame:
    """Directed candidates as pairs: both ranks (``k + 1`` where a side lacks the other) and the larger score."""
    a, b = F.col("query_id"), F.col("candidate_id")
    rank = lambda side: F.coalesce(F.min(F.when(side, F.col("rank"))), F.lit(k + 1))
    return ranking.groupBy(F.least(a, b).alias("left_id"), F.greatest(a, b).alias("right_id")).agg(
        F.max("score").alias("cosine"), rank(a < b).alias("left_rank"), rank(a > b).alias("right_rank")
    )


def usable_pairs(scored: DataFrame) -> DataFrame:
    """Pairs of a scored table as undirected ones, the strongest row of each.

    Rows with a null id or probability and pairs of a posting with itself are
    left out; sides are put in order with their ranks; of repeated pairs the
    row of the highest probability, then cosine, then the smallest ranks stays.
    A null conflict is none.
    """
    turned = F.col("left_posting_id") > F.col("right_posting_id")
    a, b = F.col("left_posting_id"), F.col("right_posting_id")
    rows = scored.where("left_posting_id is not null and right_posting_id is not null and pair_probability is not null and left_posting_id <> right_posting_id").select(
        F.least(a, b).alias("left_posting_id"), F.greatest(a, b).alias("right_posting_id"), "cosine_similarity", "pair_probability",
        F.when(turned, F.col("right_rank")).otherwise(F.col("left_rank")).alias("left_rank"),
        F.when(turned, F.col("left_rank")).otherwise(F.col("right_rank")).alias("right_rank"),
        F.coalesce("variant_conflict", F.lit(False)).alias("variant_conflict"),
    )
    key = F.struct("pair_probability", "cosine_similarity", (-F.col("left_rank")).alias("a"), (-F.col("right_rank")).alias("b"), F.col("variant_conflict").cast("int").alias("v"))
    rest = [c for c in PAIR if c not in ("left_posting_id", "right_posting_id")]
    best = rows.groupBy("left_posting_id", "right_posting_id").agg(F.max_by(F.struct(*rest), key).alias("r"))
    return best.select("left_posting_id", "right_posting_id", "r.*")


def gate(probability: Column, ranks: Column, conflict: Column, *, threshold: float, reciprocal: int, override: float) -> Column:
    """The first gate a pair fails, or ``eligible``."""
    return (
        F.when(probability < threshold, "below_probability").when(ranks > reciprocal, "non_reciprocal")
        .when(conflict & (probability < override), "variant_conflict_rejected").otherwise("eligible")
    )


def gated_pairs(pairs: DataFrame, *, threshold: float, reciprocal: int, override: float) -> DataFrame:
    """The pairs with their ``gate``."""
    worst = F.greatest("left_rank", "right_rank")
    return pairs.withColumn("gate", gate(F.col("pair_probability"), worst, F.col("variant_conflict"), threshold=threshold, reciprocal=reciprocal, override=override))


def strongest_first() -> list[Column]:
    return [F.desc("pair_probability"), F.desc("cosine_similarity"), F.asc("left_posting_id"), F.asc("right_posting_id")]


def _closer(block: pa.Table, chunk: pa.Table) -> pa.Table:
    """Rows of a chunk that are closer to each candidate of a block than its query is."""
    v = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
    q, c, ids = block.column("query_id").combine_chunks(), block.column("candidate_id").combine_chunks(), chunk.column("id").combine_chunks()
    n = np.zeros(len(q), dtype=np.int64)
    if len(q) and len(ids):
        left, right, score = v(block, "cv"), v(chunk, "v").T, block.column("score").to_numpy()
        own = [pc.index_in(x, ids).fill_null(-1).to_numpy() for x in (q, c)]
        width = max(1, HELD_SCORES // len(ids))
        for at in range(0, len(q), width):
            s = left[at : at + width] @ right
            for x in own:
                there = np.flatnonzero(x[at : at + width] >= 0)
                s[there, x[at : at + width][there]] = -np.inf
            n[at : at + width] = (s > score[at : at + width, None]).sum(axis=1)
    return pa.table({"query_id": q, "candidate_id": c, "n": n})


def reverse_ranks(candidates: DataFrame, corpus: DataFrame, **grid: int) -> DataFrame:
    """One plus the corpus rows strictly closer to the candidate than the query is.

    ``candidates``: ``query_id, candidate_id, cv, score``; ``corpus``: ``id, v``,
    all vectors at unit length.  The query's own score is the measure and never
    counts.  The candidates are the stated set of a grid over the corpus.
    """
    kind = corpus.schema["id"].dataType.simpleString()
    asked = candidates.select("query_id", "candidate_id", "cv", "score", F.xxhash64("query_id", "candidate_id").alias("id"))
    found = grid_cells(asked, corpus.select("id", "v"), _closer, f"query_id {kind}, candidate_id {kind}, n long", **grid)
    return found.groupBy("query_id", "candidate_id").agg((F.sum("n") + 1).alias("reverse_rank"))


def online_policy(probability: Column, forward: Column, reverse: Column, conflict: Column, *, threshold: float, reciprocal: int, override: float) -> Column:
    """Struct ``accepted, reason`` of the online decision on one pair."""
    reason = (
        F.when(probability < threshold, "below_probability_threshold").when((forward > reciprocal) | (reverse > reciprocal), "not_reciprocal_top_k")
        .when(conflict & (probability < override), "variant_conflict").otherwise("accepted")
    )
    return F.struct((reason == "accepted").alias("accepted"), reason.alias("reason"))


def labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """The pairs whose both ends have a label, with ``positive``. ``truth``: ``id, label``."""
    left = truth.select(F.col("id").alias("left_posting_id"), F.col("label").alias("_l"))
    right = truth.select(F.col("id").alias("right_posting_id"), F.col("label").alias("_r"))
    return pairs.join(left, "left_posting_id").join(right, "right_posting_id").withColumn("positive", (F.col("_l") == F.col("_r")).cast("int")).drop("_l", "_r")


def edge_metrics(accepted: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: accepted pairs against all true undirected pairs, counted from label sizes."""
    sizes = truth.groupBy("label").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("long")), F.lit(0)).alias("total"))
    sums = accepted.agg(F.coalesce(F.sum("positive"), F.lit(0)).alias("true_positive"), F.count("*").alias("accepted"))
    tp = F.col("true_positive")
    precision, recall = safe_divide(tp, F.col("accepted")), safe_divide(tp, F.col("total"))
    return sums.crossJoin(F.broadcast(sizes)).select(
        precision.alias("precision"), recall.alias("recall"), f1(precision, recall).alias("f1"), tp,
        (F.col("accepted") - tp).alias("false_positive"), (F.col("total") - tp).alias("false_negative"),
    )


def classification_metrics(pairs: DataFrame, *, threshold: float, bins: int, recall_floor: float, precision_floor: float) -> DataFrame:
    """Quality of pair probabilities within the candidates, one row.

    Confusion at the threshold, average precision, Brier score, expected
    calibration error over equal-width bins (the last closed), best precision
    at a recall floor and best recall at a precision floor.  ``pairs`` has
    ``pair_probability, positive`` and the ids that break ties row by row.
    """
    p, y = F.col("pair_probability"), F.col("positive")
    # ranges of a sort that ties are part of, so that a probability of many pairs is cut too; sums per range, then across the ranges
    order = [F.desc("pair_probability"), F.asc("left_posting_id"), F.asc("right_posting_id")]
    ranged = Scratch(pairs.sparkSession, "ranges").write(
        pairs.repartitionByRange(*order).sortWithinPartitions(*order).select("pair_probability", "positive", F.monotonically_increasing_id().alias("mid"))
    ).withColumn("bucket", F.shiftright("mid", 33))
    over = ranged.groupBy("bucket").agg(F.sum(y).alias("bp"), F.count("*").alias("bn"))
    above_w = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    above = over.select("bucket", F.coalesce(F.sum("bp").over(above_w), F.lit(0)).alias("ap"), F.coalesce(F.sum("bn").over(above_w), F.lit(0)).alias("an"))
    inside = Window.partitionBy("bucket").orderBy("mid")
    run = ranged.select("*", F.sum(y).over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("ip"), F.row_number().over(inside).alias("inr"))
    run = run.join(above, "bucket").select("pair_probability", "positive", (F.col("ip") + F.col("ap")).alias("cum"), (F.col("inr") + F.col("an")).alias("place"))
    totals = pairs.agg(F.sum(y).alias("pos"), F.count("*").alias("n"))
    prefix = run.crossJoin(F.broadcast(totals)).select("*", (F.col("cum") / F.col("place")).alias("pp"), (F.col("cum") / F.col("pos")).alias("pr"))
    at = p >= threshold
    sums = prefix.agg(
        F.sum((at & (y == 1)).cast("long")).alias("true_positive"), F.sum((at & (y == 0)).cast("long")).alias("false_positive"),
        F.first("pos").alias("candidate_positive_pairs"), F.first("n").alias("n"), F.sum(F.when(y == 1, F.col("pp")).otherwise(0.0)).alias("aps"),
        F.avg((p - y) * (p - y)).alias("brier_score"),
        F.coalesce(F.max(F.when(F.col("pr") >= recall_floor, F.col("pp"))), F.lit(0.0)).alias("precision_at_required_recall"),
        F.coalesce(F.max(F.when(F.col("pp") >= precision_floor, F.col("pr"))), F.lit(0.0)).alias("recall_at_required_precision"),
    )
    cell = F.least(F.floor(p * bins), F.lit(bins - 1))
    cell = F.when(p < cell / bins, cell - 1).when((cell < bins - 1) & (p >= (cell + 1) / bins), cell + 1).otherwise(cell)
    cells = pairs.groupBy(cell.alias("cell")).agg(F.count("*").alias("m"), F.avg(p).alias("mp"), F.avg(y).alias("my"))
    ece = cells.agg(F.sum(F.col("m") * F.abs(F.col("mp") - F.col("my"))).alias("gap"))
    tp, fp, pos = F.col("true_positive"), F.col("false_positive"), F.col("candidate_positive_pairs")
    precision, recall = safe_divide(tp, tp + fp), safe_divide(tp, pos)
    return sums.crossJoin(F.broadcast(ece)).select(
        F.lit(threshold).alias("threshold"), precision.alias("precision"), recall.alias("recall_within_candidates"),
        f1(precision, recall).alias("f1_within_candidates"), (F.col("aps") / pos).alias("average_precision"), "brier_score",
        (F.col("gap") / F.col("n")).alias("expected_calibration_error"), "precision_at_required_recall", "recall_at_required_precision",
        tp, fp, (F.col("n") - pos - fp).alias("true_negative"), (pos - tp).alias("false_negative_within_candidates"),
        "candidate_positive_pairs", (F.col("n") - pos).alias("candidate_negative_pairs"),
    )
