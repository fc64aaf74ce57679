"""Stored vector indexes: tables in a shared folder that grow by appending."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.errors import ContractError
from kinmatch.functions.numbers import dot
from kinmatch.operators.ann import CellIndex
from kinmatch.operators.rankers import exact_cosine, top_k


def _described(spark: SparkSession, path: str, facts: dict | None = None) -> dict:
    """Write or read the facts of an index, through the file system that holds the tables."""
    if facts is not None:
        spark.createDataFrame([(json.dumps(facts, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/facts")
        return facts
    return json.loads(spark.read.text(f"{path}/facts").first()["value"])


class StoredExact:
    """All vectors of an exact index; they are read as stored and never normalized again."""

    def __init__(self, vectors: DataFrame, facts: dict):
        self.vectors, self.facts = vectors, facts

    @classmethod
    def save(cls, vectors: DataFrame, path: str) -> StoredExact:
        """``id, v`` at unit length, as made by ``rankers.vectors``; ids have to be unique."""
        spark = vectors.sparkSession
        r = vectors.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high")).first()
        if r["n"] != r["ids"] or r["low"] != r["high"]:
            raise ContractError("an index needs unique ids and vectors of one width")
        vectors.select("id", "v").write.parquet(f"{path}/vectors")
        _described(spark, path, {"kind": "exact", "version": 1, "width": r["low"], "rows": r["n"]})
        return cls.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> StoredExact:
        facts = _described(spark, path)
        if facts.get("kind") != "exact" or facts.get("version") != 1:
            raise ContractError(f"{path} is no exact index of this version")
        return cls(spark.read.parquet(f"{path}/vectors"), facts)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return exact_cosine(queries, self.vectors, k)


class StoredCells:
    """Inverted lists, one folder for each cell, so that a search reads the lists of its probed cells only."""

    def __init__(self, spark: SparkSession, path: str):
        facts = _described(spark, path)
        if facts.get("kind") != "cells" or facts.get("version") != 1:
            raise ContractError(f"{path} is no cell index of this version")
        self.spark, self.path, self.index = spark, path, CellIndex(np.array(facts["centres"]))

    @classmethod
    def save(cls, index: CellIndex, corpus: DataFrame, path: str) -> StoredCells:
        spark = corpus.sparkSession
        _described(spark, path, {"kind": "cells", "version": 1, "centres": index.centres.tolist()})
        stored = cls(spark, path)
        stored.append(corpus)
        return stored

    def append(self, more: DataFrame) -> None:
        """Put further rows ``id, v`` into the lists; a cell of many rows is written by several tasks."""
        salt = F.pmod(F.xxhash64("id"), F.lit(8))
        self.index.cells(more, 1).repartition("cell", salt).write.mode("append").partitionBy("cell").parquet(f"{self.path}/lists")

    def lists(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/lists")

    def search(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """Best ``k`` among the rows of the probed cells, scored exactly."""
        q = self.index.cells(queries, probes).select(F.col("id").alias("query_id"), F.col("v").alias("qv"), "cell")
        asked = sorted(r["cell"] for r in q.select("cell").distinct().collect())  # at most as many as there are cells
        c = self.lists().where(F.col("cell").isin(asked)).select(F.col("id").alias("candidate_id"), F.col("v").alias("cv"), "cell")
        met = c.join(q, "cell").where("query_id <> candidate_id")
        return top_k(met.select("query_id", "candidate_id", dot("qv", "cv").alias("score")), k)


def same_rankings(one: DataFrame, other: DataFrame) -> None:
    """An error unless both rankings have the same candidates, scores and ranks: an index has to come back as it was saved."""
    cols = ["query_id", "candidate_id", "score", "rank"]
    a, b = one.select(*cols), other.select(*cols)
    if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
        raise ContractError("the stored index ranks otherwise than the one that was saved")
