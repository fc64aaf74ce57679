"""Approximate search: an inverted-file index over unit vectors, with exact rerank and gates."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.functions.numbers import dot
from kinmatch.operators.rankers import top_k

#: Rows that the coarse centres are fitted on.
FIT_ROWS = 20_000
CENTRES, ROUNDS = 32, 8


class CellIndex:
    """Coarse cells around centres fitted on a bounded sample; every row is indexed."""

    def __init__(self, centres: np.ndarray):
        self.centres = centres

    @classmethod
    def fit(cls, corpus: DataFrame, *, centres: int = CENTRES, fit_rows: int = FIT_ROWS, rounds: int = ROUNDS) -> CellIndex:
        """Spherical k-means on the ``fit_rows`` rows with the smallest digests of their ids."""
        sample = corpus.orderBy(F.xxhash64("id"), "id").limit(fit_rows).toPandas()
        v = np.stack(sample["v"].to_numpy())
        c = v[np.linspace(0, len(v) - 1, min(centres, len(v))).astype(int)].copy()
        for _ in range(rounds):
            own = np.argmax(v @ c.T, axis=1)
            for j in range(len(c)):
                members = v[own == j]
                if len(members):
                    mean = members.sum(axis=0)
                    c[j] = mean / max(np.linalg.norm(mean), 1e-12)
        return cls(c)

    def cells(self, df: DataFrame, probes: int) -> DataFrame:
        """``id, v, cell`` for the ``probes`` nearest cells of each row."""
        centres = self.centres
        probes = min(probes, len(centres))

        def run(batches):
            for d in batches:
                if d.empty:
                    continue
                near = np.argsort(-(np.stack(d["v"].to_numpy()) @ centres.T), axis=1, kind="stable")[:, :probes]
                yield pd.DataFrame({"id": np.repeat(d["id"].to_numpy(), probes), "v": np.repeat(d["v"].to_numpy(), probes), "cell": near.ravel()})

        kind = df.schema["id"].dataType.simpleString()
        return df.mapInPandas(run, f"id {kind}, v array<double>, cell int")

    def search(self, queries: DataFrame, corpus: DataFrame, k: int, probes: int) -> DataFrame:
        """Best ``k`` among the rows of the probed cells, scored exactly."""
        q = self.cells(queries, probes).select(F.col("id").alias("query_id"), F.col("v").alias("qv"), "cell")
        c = self.cells(corpus, 1).select(F.col("id").alias("candidate_id"), F.col("v").alias("cv"), "cell")
        met = c.join(q, "cell").where("query_id <> candidate_id")
        return top_k(met.select("query_id", "candidate_id", dot("qv", "cv").alias("score")), k)

    def save(self, path: str) -> None:
        with open(path, "x", encoding="utf-8") as f:
            json.dump({"version": 1, "centres": self.centres.tolist()}, f)

    @classmethod
    def load(cls, path: str) -> CellIndex:
        """Read the centres as stored: they are not normalized again, which could reorder ties."""
        with open(path, encoding="utf-8") as f:
            stored = json.load(f)
        if stored.get("version") != 1:
            raise ValueError("unknown index version")
        return cls(np.array(stored["centres"]))


def agreement(exact: DataFrame, other: DataFrame, k: int) -> DataFrame:
    """``query_id, agreement``: share of the exact first ``k`` that the other ranking has too."""
    a = exact.where(F.col("rank") <= k).select("query_id", "candidate_id")
    b = other.where(F.col("rank") <= k).select("query_id", "candidate_id", F.lit(1).alias("hit"))
    return a.join(b, ["query_id", "candidate_id"], "left").groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("agreement"))


def disagreements(exact: DataFrame, other: DataFrame, k: int, most: int = 30) -> DataFrame:
    """The queries that agree least, with the candidates only one ranking has."""
    a = exact.where(F.col("rank") <= k).select("query_id", "candidate_id", F.lit("exact").alias("side"))
    b = other.where(F.col("rank") <= k).select("query_id", "candidate_id", F.lit("other").alias("side"))
    sides = a.unionByName(b).groupBy("query_id", "candidate_id").agg(F.count("*").alias("n"), F.max("side").alias("side"))
    lists = sides.groupBy("query_id").agg(
        F.sum((F.col("n") == 2).cast("long")).alias("both"),
        F.array_sort(F.collect_list(F.when((F.col("n") == 1) & (F.col("side") == "exact"), F.col("candidate_id")))).alias("only_exact"),
        F.array_sort(F.collect_list(F.when((F.col("n") == 1) & (F.col("side") == "other"), F.col("candidate_id")))).alias("only_other"),
    )
    return lists.select("query_id", (F.col("both") / k).alias("agreement"), "only_exact", "only_other").where("agreement < 1").orderBy("agreement", "query_id").limit(most)


def accepted_setting(trials: DataFrame, exact_recall: float, *, drop: float = 0.001, agreed: float = 0.99) -> DataFrame:
    """First setting that loses at most ``drop`` recall and agrees in ``agreed``, else the last.

    ``trials``: ``setting, recall, agreement``.
    """
    good = (F.col("recall") >= exact_recall - drop) & (F.col("agreement") >= agreed)
    return trials.agg(
        F.coalesce(F.min(F.when(good, F.col("setting"))), F.max("setting")).alias("setting"),
        F.coalesce(F.max(good.cast("int")), F.lit(0)).cast("boolean").alias("accepted"),
    )
