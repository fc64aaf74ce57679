"""Splits that keep related records together, by largest differencing.

Units (components of label groups) are spread over blocks of bounded size.
Within a block the largest-differencing method packs them into equal bins:
the two partial packings with the widest spread are combined, heaviest bin
onto lightest, until one is left.  The packings of several blocks are then
combined by the same rule, level by level, and whole bins go to the splits.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmatch.llm.grid_components import grid_components
from kinmatch.runtime import Scratch

BINS = 200
BLOCK_UNITS = 20_000
FAN_IN = 64
TARGETS = (("train", 0.8), ("validation", 0.1), ("test", 0.1))


def difference(packings: list[np.ndarray], ids: list) -> tuple[list[np.ndarray], np.ndarray]:
    """Combine packings by largest differencing.

    ``packings``: bin loads, all of one width.  Returns for each packing the
    place of each of its bins in the result, and the loads of the result.
    Ties go to the smaller id.
    """
    order = sorted(range(len(packings)), key=lambda i: ids[i])
    heap, loads, trees = [], {}, {}
    for place, i in enumerate(order):
        s = np.sort(packings[i])[::-1]
        heap.append((-int(s[0] - s[-1]), place))
        loads[place] = s
    heapq.heapify(heap)
    fresh = len(order)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = loads.pop(a) + loads.pop(b)[::-1]
        down = np.argsort(-total, kind="stable")
        trees[fresh] = (a, b, down)
        loads[fresh] = total[down]
        heapq.heappush(heap, (-int(total[down[0]] - total[down[-1]]), fresh))
        fresh += 1
    top = heap[0][1]
    width = len(loads[top])
    where: dict[int, np.ndarray] = {top: np.arange(width)}
    for node in range(top, len(order) - 1, -1):
        a, b, down = trees[node]
        rank = np.empty(width, dtype=np.int64)
        rank[down] = np.arange(width)
        where[a] = where[node][rank]
        where[b] = where.pop(node)[rank[::-1]]
    places: list[np.ndarray] = [np.empty(0)] * len(order)
    for place, i in enumerate(order):
        back = np.empty(width, dtype=np.int64)
        back[np.argsort(-packings[i], kind="stable")] = where[place]
        places[i] = back
    return places, loads[top]


def _pack_units(bins: int):
    def run(t: pa.Table) -> pa.Table:
        ids, weights = t.column("unit").to_pylist(), t.column("weight").to_numpy()
        single = [np.concatenate([[w], np.zeros(bins - 1, dtype=np.int64)]) for w in weights]
        places, loads = difference(single, ids)
        n = len(ids)
        block = t.column("block")[0].as_py()
        return pa.table(
            {
                "unit": pa.array([*ids, *[None] * bins], pa.string()),
                "block": pa.array([block] * (n + bins), pa.int64()),
                "bin": pa.array([*[int(p[0]) for p in places], *range(bins)], pa.int32()),
                "load": pa.array([*[None] * n, *loads.tolist()], pa.int64()),
            }
        )

    return run


def _pack_blocks(bins: int):
    def run(t: pa.Table) -> pa.Table:
        d = t.select(["block", "bin", "load"]).to_pandas()
        up = int(t.column("up")[0].as_py())
        ids = sorted(d["block"].unique())
        rows = {b: g.sort_values("bin")["load"].to_numpy() for b, g in d.groupby("block")}
        places, loads = difference([rows[b] for b in ids], ids)
        return pa.table(
            {
                "block": pa.array([*np.repeat(ids, bins), *[None] * bins], pa.int64()),
                "bin": pa.array([*np.tile(np.arange(bins), len(ids)), *[None] * bins], pa.int32()),
                "up": pa.array([up] * (bins * (len(ids) + 1)), pa.int64()),
                "up_bin": pa.array([*np.concatenate(places), *range(bins)], pa.int32()),
                "load": pa.array([*[None] * (bins * len(ids)), *loads.tolist()], pa.int64()),
            }
        )

    return run


def share_out(loads: list[int], targets=TARGETS) -> list[str]:
    """The split of each bin: heaviest first, to the split that lacks most of its share."""
    total = sum(loads)
    lack = {name: share * total for name, share in targets}
    split = [""] * len(loads)
    for i in sorted(range(len(loads)), key=lambda i: (-loads[i], i)):
        name = max(lack, key=lambda s: lack[s])
        split[i] = name
        lack[name] -= loads[i]
    return split


def balance_units(units: DataFrame, *, bins: int = BINS, block_units: int = BLOCK_UNITS, targets=TARGETS) -> DataFrame:
    """``unit, bin, split`` for ``unit string, weight long``, whole units only.

    An empty input gives no rows; null units are left out and null weights are 0.
    Each unit should come once.  The result depends on the units and their
    weights only, not on their order or partitioning.
    """
    spark = units.sparkSession
    scratch = Scratch(spark, "splits")
    weight = F.coalesce(F.col("weight").cast("long"), F.lit(0))
    units = scratch.write(units.select("unit", weight.alias("weight")).where("unit is not null"))
    n = units.count()
    if n == 0:
        return spark.createDataFrame([], "unit string, bin int, split string")
    blocks = math.ceil(n / block_units)
    schema = "unit string, block long, bin int, load long"
    packed = scratch.write(
        units.withColumn("block", F.pmod(F.xxhash64("unit"), F.lit(blocks)))
        .groupBy("block").applyInArrow(_pack_units(bins), schema)
    )
    level = packed.where("unit is null").select("block", "bin", "load")
    placed = packed.where("unit is not null").select("unit", "block", "bin")
    while blocks > 1:
        blocks = math.ceil(blocks / FAN_IN)
        joint = scratch.write(
            level.withColumn("up", F.pmod(F.col("block"), F.lit(blocks)))
            .groupBy("up").applyInArrow(_pack_blocks(bins), "block long, bin int, up long, up_bin int, load long")
        )
        steps = joint.where("block is not null").select("block", "bin", "up", "up_bin")
        placed = placed.join(steps, ["block", "bin"]).select("unit", F.col("up").alias("block"), F.col("up_bin").alias("bin"))
        level = joint.where("block is null").select(F.col("up").alias("block"), F.col("up_bin").alias("bin"), "load")
    loads = {r["bin"]: r["load"] for r in level.collect()}  # as many rows as bins, whatever the data
    split = share_out([loads[i] for i in range(bins)], targets)
    names = F.element_at(F.array(*[F.lit(s) for s in split]), F.col("bin") + 1)
    return placed.select("unit", "bin", names.alias("split"))


def held_together(components: DataFrame, component: str = "component_id", labels: str = "label_groups") -> DataFrame:
    """``label_group, first_label_group`` of every label group that a component lists.

    Two label groups belong together if one id lists both over all its rows,
    and so on through others.  Components and label groups are the two sides
    of one graph, so an id with a third of all label groups is a vertex and
    never a group in one task.  Nulls link nothing; a label group whose
    component lists no other one is its own first.
    """
    links = components.select(F.col(component).alias("c"), F.explode(labels).alias("g")).where(
        "c is not null and g is not null"
    )
    # label groups sort before components, so each root is a label group
    found = grid_components(links.select(F.concat(F.lit("0"), "g").alias("src"), F.concat(F.lit("1"), "c").alias("dst")))
    return found.where("node like '0%'").select(
        F.expr("substring(node, 2)").alias("label_group"), F.expr("substring(root, 2)").alias("first_label_group")
    )


def split_units(rows: DataFrame, components: DataFrame, scratch: Scratch, *, id_col: str, label: str = "label_group", targets=TARGETS) -> DataFrame:
    """``own, unit, bin, split`` of everything that is kept whole, a written table.

    ``own`` is ``g:`` and a label group of either table, or stands for a row
    without one (``p:`` and its posting, ``r:`` and its row number); ``unit`` is
    the first ``own`` that it is held together with.  A label group without rows
    weighs nothing but has its place too.
    """
    weights = rows.groupBy(owner(id_col, label).alias("own")).agg(F.count("*").alias("weight"))
    heads = held_together(components).select(F.concat(F.lit("g:"), "label_group").alias("own"), F.concat(F.lit("g:"), "first_label_group").alias("head"))
    owned = scratch.write(
        weights.join(heads, "own", "full_outer").select("own", F.coalesce("head", "own").alias("unit"), F.coalesce("weight", F.lit(0)).alias("weight"))
    )
    parts = balance_units(owned.groupBy("unit").agg(F.sum("weight").alias("weight")), targets=targets)
    return scratch.write(owned.select("own", "unit").join(parts, "unit").select("own", "unit", "bin", "split"))


def owner(id_col: str, label: str) -> Column:
    return F.coalesce(F.concat(F.lit("g:"), F.col(label)), F.concat(F.lit("p:"), F.col(id_col)), F.concat(F.lit("r:"), F.col("row_number")))


def split_labels(rows: DataFrame, components: DataFrame, *, id_col: str, label: str = "label_group", targets=TARGETS) -> DataFrame:
    """``label_group, first_label_group, bin, split`` of every label group of either table."""
    placed = split_units(rows, components, Scratch(rows.sparkSession, "units"), id_col=id_col, label=label, targets=targets)
    return placed.where("own like 'g:%'").select(
        F.expr("substring(own, 3)").alias("label_group"), F.expr("substring(unit, 3)").alias("first_label_group"), "bin", "split"
    )


def split_rows(rows: DataFrame, components: DataFrame, *, id_col: str, label: str = "label_group", targets=TARGETS) -> DataFrame:
    """Each row's ``row_number, posting_id, label_group, unit, bin, split``.

    A label group under no component is a unit of its own, and so is a posting
    without a label; rows with neither label nor posting id go by their row number.
    """
    placed = split_units(rows, components, Scratch(rows.sparkSession, "units"), id_col=id_col, label=label, targets=targets)
    base = rows.select(F.col("row_number"), F.col(id_col).alias("posting_id"), F.col(label).alias("label_group"), owner(id_col, label).alias("own"))
    return base.join(placed, "own").select("row_number", "posting_id", "label_group", "unit", "bin", "split")


def split_invariants(split: DataFrame, components: DataFrame, targets=TARGETS) -> DataFrame:
    """One row over ``split_rows``: ``rows_split, labels_crossing, held_crossing, shares_hold``.

    ``shares_hold``: no split is further from its share than the heaviest unit weighs.
    """
    crossing = lambda df, key: df.where(F.col(key).isNotNull()).groupBy(key).agg((F.min("split") != F.max("split")).cast("long").alias("x")).agg(F.coalesce(F.sum("x"), F.lit(0)))
    held = held_together(components).join(split.select("label_group", "split").distinct(), "label_group")
    total, heaviest = split.count(), split.groupBy("unit").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    wanted = split.sparkSession.createDataFrame([(n, float(s)) for n, s in targets], "split string, share double")
    sizes = wanted.join(split.groupBy("split").agg(F.count("*").alias("n")), "split", "left")
    holds = sizes.agg(F.min(F.abs(F.coalesce("n", F.lit(0)) - F.col("share") * F.lit(total)) <= F.lit(heaviest or 0)).alias("shares_hold"))
    return (
        split.agg(F.count("*").alias("rows_split")).crossJoin(crossing(split, "label_group").toDF("labels_crossing"))
        .crossJoin(crossing(held, "first_label_group").toDF("held_crossing")).crossJoin(holds)
    )
