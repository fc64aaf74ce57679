"""Texts packed into containers of fixed capacity by sum of squares.

A text goes where the sum of squared counts of partly filled containers, by
fill level, comes out smallest; the counts stand in an array of levels.  Each
block of texts is packed for itself, then the containers that stayed open in
any block are packed as items of their fill, until one block is left.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.runtime import Scratch

CAPACITY = 1024
BLOCK_ITEMS = 40_000
#: Equal rows that are numbered at once.
COPIES = 10_000
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the public byte-level tokenizer parts a text before it joins bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """A tiktoken encoding from a vocabulary file of ranks."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, id_col: str, text: str, path: str = TOKENIZER) -> DataFrame:
    """``id, tokens`` of every row with a text; the vocabulary file is sent to the executors."""
    df.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(SparkFiles.get(name)).encode_ordinary
        for d in batches:
            yield pd.DataFrame({"id": d["id"], "tokens": [len(encode(t)) for t in d["text"]]})

    some = df.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    return some.mapInPandas(run, f"id {some.schema['id'].dataType.simpleString()}, tokens int")


def sum_of_squares(sizes: list[int], capacity: int) -> tuple[np.ndarray, list[int]]:
    """Container of each item, in order of arrival, and the fill of each container.

    ``N[h]`` counts open containers of fill ``h``.  An item of size ``s`` into
    fill ``h`` changes the sum of squares by ``2 (N[h+s] - N[h]) + 2``, into a
    new container by ``2 N[s] + 1``; full ones leave the count.  Ties go to the
    fullest container.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    where = np.empty(len(sizes), dtype=np.int64)
    fills: list[int] = []
    for i, s in enumerate(sizes):
        change = 2 * (count[s + 1 :] - count[1 : capacity + 1 - s]) + 2
        if len(change):
            change[-1] = -2 * count[capacity - s] + 1
            change[count[1 : capacity + 1 - s] == 0] = 2 * len(sizes) + 9
            best = len(change) - 1 - int(np.argmin(change[::-1]))
        fresh = 0 if s == capacity else 2 * count[s] + 1
        if len(change) and change[best] <= min(fresh, 2 * len(sizes)):
            h = best + 1
            c = open_[h].pop()
            count[h] -= 1
        else:
            h, c = 0, len(fills)
            fills.append(0)
        fills[c] += s
        where[i] = c
        if h + s < capacity:
            count[h + s] += 1
            open_[h + s].append(c)
    return where, fills


def _pack(capacity: int):
    def run(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("turn").to_numpy(), kind="stable")
        sizes = t.column("size").to_numpy()[order]
        block = t.column("block")[0].as_py()
        where, fills = sum_of_squares(sizes.tolist(), capacity)
        box = [f"{block}.{c}" for c in where]
        return pa.table({"item": t.column("item").take(pa.array(order)), "box": pa.array(box, pa.string()), "fill": pa.array(np.array(fills)[where], pa.int64())})

    return run


def pack_texts(counts: DataFrame, *, capacity: int = CAPACITY, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``id, piece, first_token, tokens, container_id`` for ``id, tokens``.

    A text longer than a container fills as many as it can and its rest is an
    item like any other; no other text is divided.  A text without tokens
    takes one place, so that every text is in a container.  Ids should be
    unique; equal rows are packed as often as they come.  Block and turn of an
    item follow from its id, piece, size and number among equal rows, so the
    result does not depend on the partitioning.
    """
    spark = counts.sparkSession
    scratch = Scratch(spark, "packing")
    sized = scratch.write(counts.select("id", F.greatest("tokens", F.lit(1)).alias("tokens")))
    full = F.floor(F.col("tokens") / capacity).cast("int")
    rest = F.col("tokens") - full * capacity
    whole = sized.where(full > 0).select(
        "id", F.explode(F.sequence(F.lit(0), full - 1)).alias("piece"), F.lit(capacity).alias("tokens")
    ).withColumn("container_id", F.concat_ws("-", F.lit("w"), "id", "piece"))
    # equal rows are told apart by a running number, so that no number depends on where a row stands
    rests = sized.where(rest > 0).groupBy("id", full.alias("piece"), rest.cast("long").alias("size")).agg(F.count("*").alias("n"))
    runs = rests.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES))).alias("run"))
    copies = runs.select("id", "piece", "size", F.explode(F.sequence(F.col("run") * COPIES, F.least(F.col("n"), (F.col("run") + 1) * COPIES) - 1)).alias("copy"))
    items = scratch.write(copies.select("id", "piece", "size", F.concat_ws("-", "id", "piece", "size", "copy").alias("item")))
    n = items.count()
    blocks = max(1, math.ceil(n / block_items))
    schema = "item string, box string, fill long"
    level = 0

    def packed(df: DataFrame, blocks: int) -> DataFrame:
        turn = F.xxhash64("item", F.lit(level))
        return scratch.write(
            df.select("item", "size", turn.alias("turn"), F.pmod(F.xxhash64("item", F.lit(level + 1000)), F.lit(blocks)).alias("block"))
            .groupBy("block").applyInArrow(_pack(capacity), schema)
        )

    first = packed(items, blocks)
    placed = items.join(first.select("item", "box"), "item").select("id", "piece", F.col("size").cast("int").alias("tokens"), F.concat(F.lit("0:"), "box").alias("box"))
    boxes = first.select(F.concat(F.lit("0:"), "box").alias("box"), "fill").distinct()
    while blocks > 1:
        level += 1
        left = scratch.write(boxes.where(F.col("fill") < capacity).select(F.col("box").alias("item"), F.col("fill").alias("size")))
        before, blocks = blocks, max(1, math.ceil(left.count() / block_items))
        if blocks >= before:
            break  # what is left open fills whole blocks: nothing is gained by another turn
        again = packed(left, blocks).select(F.col("item").alias("box"), F.concat(F.lit(f"{level}:"), "box").alias("into"), "fill")
        placed = placed.join(again.select("box", "into"), "box", "left").select("id", "piece", "tokens", F.coalesce("into", "box").alias("box"))
        boxes = again.select(F.col("into").alias("box"), "fill").distinct()
    every = placed.withColumnRenamed("box", "container_id").unionByName(whole)
    return every.select("id", "piece", (F.col("piece") * capacity).alias("first_token"), "tokens", "container_id")


def packing_summary(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: ``containers, tokens, capacity, fill_rate, open_containers``."""
    boxes = packed.groupBy("container_id").agg(F.sum("tokens").alias("fill"))
    return boxes.agg(
        F.count("*").alias("containers"), F.sum("fill").alias("tokens"), F.lit(capacity).alias("capacity"),
        F.round(F.sum("fill") / (F.count("*") * capacity), 6).alias("fill_rate"),
        F.sum((F.col("fill") < capacity).cast("long")).alias("open_containers"),
    )


def packing_invariants(packed: DataFrame, texts: DataFrame, id_col: str, capacity: int = CAPACITY, least_fill: float = 0.98) -> DataFrame:
    """One row: ``texts, lost, overfull, divided, tight``.

    ``texts``: rows with a text; ``lost``: those of them in no container; ``overfull``: containers
    above the capacity; ``divided``: texts in several pieces that would have gone into one;
    ``tight``: at least ``least_fill`` of the room is used, or one container is not full.
    """
    some = texts.select(F.col(id_col).alias("id")).where("id is not null")
    lost = some.join(packed.select("id").distinct(), "id", "left_anti").agg(F.count("*").alias("lost"))
    boxes = packed.groupBy("container_id").agg(F.sum("tokens").alias("fill")).agg(
        F.coalesce(F.sum((F.col("fill") > capacity).cast("long")), F.lit(0)).alias("overfull"),
        (F.sum("fill") >= least_fill * capacity * (F.count("*") - 1)).alias("tight"),
    )
    pieces = packed.groupBy("id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("whole")).where("pieces > 1")
    divided = pieces.agg(F.coalesce(F.sum((F.col("whole") <= capacity).cast("long")), F.lit(0)).alias("divided"))
    return some.agg(F.count("*").alias("texts")).crossJoin(lost).crossJoin(boxes).crossJoin(divided)
