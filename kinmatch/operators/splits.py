"""Label components and splits that no shared image, content or hash crosses."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.functions.hashes import stable_order
from kinmatch.functions.numbers import group_size_band
from kinmatch.runtime import Scratch

#: Edges of a whole graph that one task may take.
FINISH_EDGES = 300_000
SPLITS = (("train", 0.8), ("validation", 0.1), ("test", 0.1))


def _joined(t: pa.Table) -> pa.Table:
    """Smallest name of each node's component, by union-find with halved paths."""
    a, b = t.column("a").to_pylist(), t.column("b").to_pylist()
    names = sorted({*a, *b})
    number = {v: i for i, v in enumerate(names)}
    up = list(range(len(names)))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for x, y in zip(a, b, strict=True):
        i, j = top(number[x]), top(number[y])
        if i != j:
            up[max(i, j)] = min(i, j)
    return pa.table({"node": pa.array(names, pa.string()), "root": pa.array([names[top(i)] for i in range(len(names))], pa.string())})


def star_components(edges: DataFrame, *, finish_edges: int | None = None) -> DataFrame:
    """``node, root`` for edges ``src, dst``, by alternating large and small stars.

    Each round hangs larger neighbours, then smaller ones, on the smallest
    neighbour until every node points at its component's smallest node.  Once
    no more than ``FINISH_EDGES`` edges are there, one task finishes them.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "stars")
    e = scratch.write(
        edges.where("src is not null and dst is not null and src <> dst")
        .select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct()
    )

    def digest(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())  # edges are distinct; a sum would overflow

    before, now = None, digest(e)
    while before != now:
        if now[0] <= (FINISH_EDGES if finish_edges is None else finish_edges):
            return scratch.write(e.withColumn("whole", F.lit(0)).groupBy("whole").applyInArrow(_joined, "node string, root string"))
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select("a", "b", "m")
        hung = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        after = scratch.write(hung)
        scratch.drop(e)
        e, before, now = after, now, digest(after)
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _label_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the labels of each root, one to a line; a root may go on in the next batch."""
    root, digest = None, None
    for d in batches:
        done = []
        for r, label in zip(d["root"], d["label"], strict=True):
            if r != root:
                if digest:
                    done.append((root, digest.hexdigest()))
                root, digest = r, hashlib.sha256(label.encode())
            else:
                digest.update(b"\n" + label.encode())
        yield pd.DataFrame(done, columns=["root", "digest"], dtype=object)
    if digest:
        yield pd.DataFrame([(root, digest.hexdigest())], columns=["root", "digest"])


def label_components(rows: DataFrame, links: dict[str, Column], label: str = "label_group") -> DataFrame:
    """``label_group, component_id, component_rows, size_band``: label groups joined by shared values.

    ``links``: the values that join label groups (image, content, hash); nulls
    join nothing.  Every label group gets a component, linked or not.
    """
    base = rows.where(F.col(label).isNotNull())
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), c.cast("string").alias("v")) for k, c in links.items()]))
    nodes = base.select(F.concat(F.lit("0"), F.col(label)).alias("src"), each.alias("x")).where("x.v is not null").select(
        "src", F.concat(F.lit("1"), "x.k", F.lit(":"), "x.v").alias("dst")
    )
    found = star_components(nodes.distinct()).where("node like '0%'").select(F.expr("substring(node, 2)").alias(label), F.expr("substring(root, 2)").alias("root"))
    sizes = base.groupBy(label).agg(F.count("*").alias("n"))
    joined = sizes.join(found, label, "left").withColumn("root", F.coalesce("root", label))
    counted = joined.groupBy("root").agg(
        F.count("*").alias("labels"), F.sum("n").alias("component_rows"), group_size_band(F.max("n")).alias("size_band")
    )
    # rows of a root stand together in order and stream through a digest, so that no list grows with a component
    ordered = joined.select("root", F.col(label).alias("label")).repartition("root").sortWithinPartitions("root", "label")
    digests = ordered.mapInPandas(_label_digests, "root string, digest string")
    heads = counted.join(digests, "root").select("root", "component_rows", "size_band", F.concat(F.lit("component_"), F.substring("digest", 1, 16)).alias("component_id"))
    return joined.join(heads, "root").select(label, "component_id", "component_rows", "size_band")


def _least_loaded(total: float, in_band: dict[str, float], splits: tuple):
    """Streams through components in order and holds the loads of the splits only."""
    share = [f for _, f in splits]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [0.0] * len(splits)
        bands = {b: [0.0] * len(splits) for b in in_band}
        for d in batches:
            picks = []
            for w, band in zip(d["w"], d["size_band"], strict=True):
                held, most = bands[band], in_band[band]
                cost = [0.7 * rows[i] / (total * f) + 0.3 * held[i] / max(most * f, 1e-12) for i, f in enumerate(share)]
                i = cost.index(min(cost))
                rows[i] += w
                held[i] += 1.0
                picks.append(splits[i][0])
            yield pd.DataFrame({"component_id": d["component_id"], "split": picks})

    return run


def assign_splits(components: DataFrame, *, seed: int = 2026, splits=SPLITS) -> DataFrame:
    """``component_id, split``: heaviest first, each to the split with the least load.

    Load is 0.7 of the row share plus 0.3 of the share of its size band, ties go
    to the earlier split.  The rule is sequential by definition: an external
    sort puts the components in order, then one task streams through them and
    holds nothing but the loads, so the rule is the same at every size.
    """
    one = components.select("component_id", F.col("component_rows").cast("double").alias("w"), "size_band").distinct()
    totals = {r["size_band"]: (r["n"], r["w"]) for r in one.groupBy("size_band").agg(F.count("*").cast("double").alias("n"), F.sum("w").alias("w")).collect()}  # four bands
    ordered = one.withColumn("h", stable_order(seed, "component_id")).repartition(1).sortWithinPartitions(F.desc("w"), "h", "component_id").select("component_id", "w", "size_band")
    loads = _least_loaded(sum(w for _, w in totals.values()), {b: n for b, (n, _) in totals.items()}, splits)
    return ordered.mapInPandas(loads, "component_id string, split string")


def split_integrity(rows: DataFrame, keys: dict[str, Column], split: str = "split") -> DataFrame:
    """``key_name, crossing``: values of each key that stand in more than one split."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), c.cast("string").alias("v")) for k, c in keys.items()]))
    by = rows.select(F.col(split).alias("split"), each.alias("x")).where("x.v is not null").select("split", "x.*")
    spread = by.groupBy("k", "v").agg(F.countDistinct("split").alias("n"))
    return spread.groupBy(F.col("k").alias("key_name")).agg(F.sum((F.col("n") > 1).cast("long")).alias("crossing"))


def first_of_each(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by ``order``, through an aggregate instead of a sort of the group."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
