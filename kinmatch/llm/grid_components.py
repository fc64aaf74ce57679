"""Groups of records linked directly or through others, over a 2-D grid.

Vertices are hashed into blocks and every edge falls into the cell of its two
blocks.  A cell runs union-find over its own edges only, then each vertex meets
the representatives found along its row and column: one becomes its parent and
the others are linked to that parent in a contracted graph.  Rounds go on until
no link is left.  Parents are chosen by a hash that changes with the round, so
the number of rounds is logarithmic in whatever order the ids come.  A vertex
that holds a third of all edges fills a row of cells; cells above twice the
usual size are split by a salt, as union-find over a part is just as valid.
The smallest id of a group is one aggregate at the end.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.runtime import Scratch

#: Links that one cell holds on average; a cell is the unit of work of a task.
CELL_EDGES = 150_000


def union_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index connected with each of ``n`` vertices, by hooking and pointer jumping."""
    parent = np.arange(n)
    while len(a):
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            jumped = parent[parent]
            if np.array_equal(jumped, parent):
                break
            parent = jumped
    return parent


def _cell_roots(cell: pa.Table) -> pa.Table:
    m = cell.num_rows
    ends = pa.chunked_array(cell.column("src").chunks + cell.column("dst").chunks, pa.string()).combine_chunks()
    coded = ends.dictionary_encode()
    codes = coded.indices.to_numpy()
    turned = np.empty(len(coded.dictionary), dtype=np.int64)
    turned[codes] = np.concatenate([cell.column("hu").to_numpy(), cell.column("hv").to_numpy()])
    order = np.argsort(turned, kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    root = union_roots(rank[codes[:m]], rank[codes[m:]], len(order))
    ordered = coded.dictionary.take(pa.array(order))
    return pa.table({"node": ordered, "rep": ordered.take(pa.array(root))})


def cells_of(links: DataFrame, side: int, turn: int, cell_edges: int) -> DataFrame:
    """The links with their cell ``row_, col_, salt`` and both ends' hashes of this round.

    A cell of more than ``2 * cell_edges`` links is split into parts of about ``cell_edges``.
    """
    block = lambda c: F.pmod(F.col(c), F.lit(side)).cast("int")
    placed = links.withColumns({"hu": F.xxhash64("src", F.lit(turn)), "hv": F.xxhash64("dst", F.lit(turn))}).select(
        "*", F.least(block("hu"), block("hv")).alias("row_"), F.greatest(block("hu"), block("hv")).alias("col_")
    )
    if side == 1:
        return placed.withColumn("salt", F.lit(0))
    heavy = placed.groupBy("row_", "col_").agg(F.count("*").alias("n")).where(F.col("n") > 2 * cell_edges)
    parts = heavy.select("row_", "col_", F.ceil(F.col("n") / cell_edges).alias("parts"))  # few or no cells
    salt = F.pmod(F.xxhash64("src", "dst", F.lit(-1 - turn)), F.coalesce("parts", F.lit(1))).cast("int")
    return placed.join(parts, ["row_", "col_"], "left").withColumn("salt", salt).drop("parts")


def contracted(links: DataFrame, scratch: Scratch, cell_edges: int = CELL_EDGES) -> list[DataFrame]:
    """One map ``node, parent`` for each round; ``links`` is a written table ``src, dst`` without loops."""
    maps: list[DataFrame] = []
    turn = 0
    while (n := links.count()) > 0:
        side = max(1, math.ceil(math.sqrt(2 * n / cell_edges)))
        cells = cells_of(links, side, turn, cell_edges).select("row_", "col_", "salt", "src", "dst", "hu", "hv")
        found = cells.groupBy("row_", "col_", "salt").applyInArrow(_cell_roots, "node string, rep string")
        if side == 1:
            maps.append(scratch.write(found.select("node", F.col("rep").alias("parent"))))
            scratch.drop(links)
            break
        first = F.min(F.struct(F.xxhash64("rep", F.lit(turn)).alias("h"), F.col("rep").alias("rep")))
        met = scratch.write(found.groupBy("node").agg(first["rep"].alias("parent"), F.collect_set("rep").alias("reps")))
        maps.append(met.select("node", "parent"))
        following = scratch.write(
            met.where(F.size("reps") > 1)
            .select("parent", F.explode("reps").alias("rep")).where("rep <> parent")
            .select(F.least("parent", "rep").alias("src"), F.greatest("parent", "rep").alias("dst"))
            .distinct()
        )
        scratch.drop(links)
        links = following
        turn += 1
    return maps


def grid_components(edges: DataFrame, left: str = "src", right: str = "dst", *, cell_edges: int = CELL_EDGES) -> DataFrame:
    """Every linked vertex with the smallest id (as a string) of its group.

    Returns ``node, root``.  Rows with a null end are no links; a vertex whose
    only links lead to itself is not returned, as it is linked with nothing.
    Repeated and reversed links count once; an empty input gives no rows; any
    further columns are ignored.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "grid")
    a, b = F.col(left).cast("string"), F.col(right).cast("string")
    links = (  # least and greatest skip nulls, so half a link becomes a loop and goes with the loops
        edges.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"))
        .where("src is not null and dst is not null and src <> dst")
        .distinct()
    )
    maps = contracted(scratch.write(links), scratch, cell_edges)
    if not maps:
        return spark.createDataFrame([], "node string, root string")
    found = maps[-1].select("node", F.col("parent").alias("top"))
    for earlier in reversed(maps[:-1]):
        above = found.select(F.col("node").alias("parent"), "top")
        found = earlier.join(above, "parent", "left").select("node", F.coalesce("top", "parent").alias("top"))
    found = scratch.write(found)
    smallest = found.groupBy("top").agg(F.min("node").alias("root"))
    return found.join(smallest, "top").select("node", "root")


def assign_groups(found: DataFrame, postings: DataFrame, key: str = "posting_id") -> DataFrame:
    """One row for each posting with its group identifier and size.

    Postings without a link form groups of their own; null keys are left out
    and repeated ones count once.
    """
    every = postings.select(F.col(key).cast("string").alias("node")).where("node is not null").distinct()
    rooted = (
        every.join(found, "node", "full_outer")
        .select("node", F.coalesce("root", "node").alias("root"))
    )
    sizes = rooted.groupBy("root").agg(F.count("*").alias("cluster_size"))
    return (
        rooted.join(sizes, "root")
        .select(
            F.col("node").alias(key),
            F.concat(F.lit("entity_"), F.substring(F.sha2("root", 256), 1, 16)).alias("entity_id"),
            F.col("root").alias("first_posting_id"),
            "cluster_size",
        )
    )
