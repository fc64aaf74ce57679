"""Catalogue audit: duplicates, cross-label buckets, sizes, quantiles, scripts, near hashes."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmatch.functions.hashes import hamming, phash_bits
from kinmatch.functions.numbers import balanced_round, group_size_band
from kinmatch.functions.titles import title_scripts
from kinmatch.operators.rankers import HELD_SCORES, grid_cells
from kinmatch.runtime import Scratch

QUANTILES = (("minimum", 0.0), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p95", 0.95), ("p99", 0.99), ("maximum", 1.0))
FINDING = T.StructType([
    T.StructField("severity", T.StringType()), T.StructField("code", T.StringType()),
    T.StructField("message", T.StringType()), T.StructField("n", T.LongType()),
])


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    """One row ``duplicates``: rows beyond the first of each key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def cross_label_buckets(df: DataFrame, keys: dict[str, Column], label: str = "label_group") -> DataFrame:
    """``bucket, buckets, repeated``: values shared by several labels, and by several rows, for each key.

    Null values and labels are left out.  All keys go through one shuffle.
    """
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("bucket"), c.cast("string").alias("value")) for k, c in keys.items()]))
    rows = df.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), each.alias("k")).select("label", "k.*").where("value is not null")
    by_value = rows.groupBy("bucket", "value").agg(F.countDistinct("label").alias("labels"), F.count("*").alias("n"))
    return by_value.groupBy("bucket").agg(
        F.sum((F.col("labels") > 1).cast("long")).alias("buckets"), F.sum((F.col("n") > 1).cast("long")).alias("repeated")
    )


def size_distribution(df: DataFrame, label: str = "label_group") -> DataFrame:
    """``size, groups, band`` of the label groups."""
    sizes = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("groups")).withColumn("band", group_size_band(F.col("size")))


def nearest_rank_quantiles(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``measure, quantile, value``: nearest rank, halves rounded to the even rank.

    Values are counted first, so the ranks run over distinct values only.
    """
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), c.cast("double").alias("value")) for k, c in values.items()]))
    counted = df.select(each.alias("v")).select("v.*").where("value is not null").groupBy("measure", "value").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    run = counted.select("*", F.sum("n").over(Window.partitionBy("measure").orderBy("value")).alias("upto"))
    totals = counted.groupBy("measure").agg(F.sum("n").alias("total"))
    asked = totals.select("measure", "total", F.explode(F.array(*[F.struct(F.lit(q).alias("quantile"), F.lit(p).alias("p")) for q, p in QUANTILES])).alias("q"))
    asked = asked.select("measure", "q.quantile", (balanced_round((F.col("total") - 1) * F.col("q.p")) + 1).alias("rank"))
    met = asked.join(run, "measure").where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
    return met.select("measure", "quantile", "value")


def linear_quantiles(df: DataFrame, value: str, by: str, points: dict[str, float]) -> DataFrame:
    """Mean, population deviation and interpolated percentiles of a value by class."""
    cuts = [F.percentile(value, p).alias(n) for n, p in points.items()]
    return df.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), *cuts)


def script_presence(df: DataFrame, title: str = "title") -> DataFrame:
    """``script, titles``: titles with a character of each script."""
    some = df.where(F.col(title).isNotNull()).select(F.explode(title_scripts(F.col(title))).alias("script"))
    return some.groupBy("script").agg(F.count("*").alias("titles"))


def title_counts(df: DataFrame, title: str, image: str, phash: str) -> DataFrame:
    """One row of counts over titles, images and hashes."""
    t = F.col(title)
    return df.agg(
        F.count("*").alias("n_rows"), F.count(t).alias("titles"),
        F.coalesce(F.sum(F.length(t)), F.lit(0)).alias("characters"),
        F.coalesce(F.sum(F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(t.rlike("[0-9]").cast("long")), F.lit(0)).alias("titles_with_digits"),
        F.coalesce(F.sum(t.rlike("[^\\x00-\\x7F]").cast("long")), F.lit(0)).alias("titles_not_ascii"),
        F.countDistinct(image).alias("unique_images"), F.countDistinct(phash).alias("unique_phashes"),
    )


def image_dimensions(images: DataFrame) -> DataFrame:
    """One row: images read, unreadable ones, small sides, extreme aspects, distinct contents."""
    readable = F.col("sha256").isNotNull() & (F.col("width") > 0) & (F.col("height") > 0)
    aspect = F.when(readable, F.col("width") / F.col("height"))
    flag = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return images.distinct().agg(
        F.count("*").alias("images"), flag(~readable).alias("unreadable"),
        flag(readable & (F.least("width", "height") < 64)).alias("small_side"),
        flag((aspect < 0.25) | (aspect > 4)).alias("extreme_aspect"), F.countDistinct("sha256").alias("contents"),
    )


def labelled_histogram(df: DataFrame, value: Column, edges: list[int]) -> DataFrame:
    """``bin, n`` over half-open bins; the last is open above."""
    bounds = list(zip(edges, [*edges[1:], None], strict=True))
    names = [f"{a}_to_{b - 1}" if b is not None else f"{a}_plus" for a, b in bounds]
    c = None
    for (a, b), name in zip(bounds, names, strict=True):
        cond = (value >= a) & (value < b) if b is not None else value >= a
        c = F.when(cond, name) if c is None else c.when(cond, name)
    return df.select(c.alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))


#: Bands of a hash in the search for near ones.
NEAR_BANDS = 3
#: Hashes of a block and of a chunk in that search; a worker holds three tables of a block.
NEAR_BLOCK, NEAR_CHUNK = 1_048_576, 262_144


def _near_cell(most: int):
    """``a, b``: hashes of a block and a chunk at most ``most`` bits apart, the smaller one from the chunk."""
    cuts = [64 * i // NEAR_BANDS for i in range(NEAR_BANDS + 1)]
    flips = [[sum(1 << j for j in some) for r in range(most // NEAR_BANDS + 1) for some in itertools.combinations(range(b - a), r)] for a, b in itertools.pairwise(cuts)]

    def run(block: pa.Table, chunk: pa.Table) -> pa.Table:
        held, asked = (t.column("id").to_numpy().view(np.uint64) for t in (block, chunk))
        found = [np.empty((0, 2), dtype=np.uint64)]
        for (low, high), masks in zip(itertools.pairwise(cuts), flips, strict=True):
            part = lambda x: (x >> np.uint64(low) & np.uint64((1 << high - low) - 1)).astype(np.int64)  # noqa: B023, E731
            order = np.argsort(part(held), kind="stable")
            first = np.concatenate([[0], np.cumsum(np.bincount(part(held), minlength=1 << high - low))])
            mine = part(asked)
            for m in masks:
                at = mine ^ m
                n = first[at + 1] - first[at]
                some = np.flatnonzero(n)
                size = n[some]
                for rows in np.split(np.arange(len(some)), np.flatnonzero(np.diff(np.cumsum(size) // HELD_SCORES)) + 1):
                    k = size[rows]
                    place = np.repeat(first[at[some[rows]]] - np.concatenate([[0], np.cumsum(k)[:-1]]), k) if len(k) else np.empty(0, dtype=np.int64)
                    a, b = np.repeat(asked[some[rows]], k), held[order[place + np.arange(len(place))]]
                    near = (a < b) & (np.bitwise_count(a ^ b) <= most)
                    found.append(np.stack([a[near], b[near]], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0).view(np.int64)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def near_phashes(df: DataFrame, most: int, phash: str = "image_phash", label: str = "label_group", **grid: int) -> DataFrame:
    """``left_phash, right_phash, distance`` of different hashes at most ``most`` bits apart under different labels.

    The 64 bits are cut into three bands; of two hashes that close one band
    differs in a third of ``most`` bits at most, so looking up one side's bands
    under every such flip of bits among the other's finds every pair.  That is
    done in the cells of a grid, where hashes travel as numbers, and no flip
    becomes a row.  A pair counts if its hashes' labels together are more than one.
    """
    rows = df.select(F.lower(F.trim(phash)).alias("h"), F.col(label).alias("label")).where("label is not null")
    rows = rows.select("h", phash_bits("h").alias("bits"), "label").where("bits is not null").distinct()
    # labels stay an aggregate: smallest and largest tell whether a union has more than one
    hashes = Scratch(df.sparkSession, "near").write(rows.groupBy("h", "bits").agg(F.min("label").alias("low"), F.max("label").alias("high")))
    ids = hashes.select(F.col("bits").alias("id"))
    met = grid_cells(ids, ids, _near_cell(most), "a long, b long", **{"block_queries": NEAR_BLOCK, "chunk_rows": NEAR_CHUNK} | grid)
    end = lambda n, bits: hashes.select(F.col("bits").alias(bits), *[F.col(c).alias(f"{c}{n}") for c in ("h", "low", "high")])
    crossing = met.join(end(1, "a"), "a").join(end(2, "b"), "b").where(F.least("low1", "low2") != F.greatest("high1", "high2"))
    return crossing.select(F.col("h1").alias("left_phash"), F.col("h2").alias("right_phash"), hamming("a", "b").alias("distance"))


def audit_findings(counts: DataFrame, rules: dict[str, tuple[str, str]]) -> DataFrame:
    """Findings ``severity, code, message, n`` for the counts above zero; ``counts`` has ``code, n``."""
    table = F.create_map(*[x for code, (sev, msg) in rules.items() for x in (F.lit(code), F.struct(F.lit(sev).alias("severity"), F.lit(msg).alias("message")))])
    return counts.where("n > 0").select("code", "n", F.try_element_at(table, F.col("code")).alias("r")).where("r is not null").select(
        "r.severity", "code", "r.message", "n"
    )


def audit_status(findings: DataFrame) -> DataFrame:
    """One row ``status``: blocked, passed_with_warnings or passed."""
    worst = F.max(F.when(F.col("severity") == "critical", 2).when(F.col("severity") == "warning", 1).otherwise(0))
    return findings.agg(F.coalesce(worst, F.lit(0)).alias("w")).select(
        F.when(F.col("w") == 2, "blocked").when(F.col("w") == 1, "passed_with_warnings").otherwise("passed").alias("status")
    )
