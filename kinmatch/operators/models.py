"""Encoders, pair head, fusion, losses and gates, without a deep-learning library.

Weights are plain arrays: drawn from a seed or loaded from a file, and shipped
to the workers with the function that uses them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmatch.functions.numbers import dot, sigmoid

PAD, UNKNOWN = 0, 1


def character_vocabulary(titles: DataFrame, least: int, most: int) -> DataFrame:
    """``token, token_id`` of the most frequent characters of ``norm``; ids start after padding and unknown."""
    chars = titles.select(F.explode(F.filter(F.split("norm", ""), lambda c: c != "")).alias("token"))
    counted = chars.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    kept = counted.orderBy(F.desc("n"), "token").limit(most)
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("a"), F.col("token").alias("b"))))  # at most ``most``
    return kept.agg(order.alias("o")).select(F.posexplode("o")).select(F.col("col.b").alias("token"), (F.col("pos") + 2).alias("token_id"))


def unknown_rate(titles: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """One row ``unknown_rate``: share of characters outside the vocabulary."""
    chars = titles.select(F.explode(F.filter(F.split("norm", ""), lambda c: c != "")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    met = chars.join(F.broadcast(vocabulary), "token", "left")
    return met.agg((F.sum(F.when(F.col("token_id").isNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("unknown_rate"))


#: Titles that a worker encodes at once, which bounds its arrays.
ENCODED_ROWS = 500


@dataclass
class TextEncoder:
    """Character embedding, convolutions of several widths, masked maximum, layer norm, two dense layers, unit length."""

    weights: dict[str, np.ndarray]
    widths: tuple[int, ...] = (3, 5, 7)

    @classmethod
    def seeded(cls, characters: int, *, embedding: int = 24, filters: int = 32, out: int = 64, seed: int = 7, widths=(3, 5, 7)) -> TextEncoder:
        r = np.random.default_rng(seed)
        draw = lambda *s: (r.standard_normal(s) / np.sqrt(s[0] if len(s) < 3 else s[0] * s[1])).astype(np.float32)
        w = {"embedding": draw(characters, embedding) * np.sqrt(characters)}
        w["embedding"][PAD] = 0
        for k in widths:
            w[f"conv{k}"], w[f"bias{k}"] = draw(k, embedding, filters), np.zeros(filters, np.float32)
        wide = filters * len(widths)
        w |= {"scale": np.ones(wide, np.float32), "shift": np.zeros(wide, np.float32), "dense1": draw(wide, wide), "dense2": draw(wide, out)}
        return cls(w, tuple(widths))

    def encode(self, ids: np.ndarray) -> np.ndarray:
        """Unit vectors of padded id rows."""
        w = self.weights
        x = w["embedding"][ids]
        real = ids != PAD
        pooled = []
        for k in self.widths:
            p = np.pad(x, ((0, 0), (k // 2, k // 2), (0, 0)))
            y = sum(p[:, j : j + x.shape[1]] @ w[f"conv{k}"][j] for j in range(k)) + w[f"bias{k}"]
            y = 0.5 * y * (1 + np.tanh(0.7978845608 * (y + 0.044715 * y**3)))
            pooled.append(np.where(real[:, :, None], y, -np.inf).max(axis=1))
        h = np.concatenate(pooled, axis=1)
        h = (h - h.mean(1, keepdims=True)) / np.sqrt(h.var(1, keepdims=True) + 1e-5) * w["scale"] + w["shift"]
        h = np.maximum(h @ w["dense1"], 0) @ w["dense2"]
        return h / np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-12)

    def embed(self, df: DataFrame) -> DataFrame:
        """``id, v`` for ``id, ids`` (padded character ids), in Arrow batches."""
        kind = df.schema["id"].dataType.simpleString()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for d in batches:
                for i in range(0, len(d), ENCODED_ROWS):
                    part = d.iloc[i : i + ENCODED_ROWS]
                    v = self.encode(np.stack(part["ids"].to_numpy()).astype(int))
                    yield pd.DataFrame({"id": part["id"], "v": list(v.astype(float))})

        spread = df.select("id", "ids").repartition(df.sparkSession.sparkContext.defaultParallelism)  # the work per row is large
        return spread.mapInPandas(run, f"id {kind}, v array<double>")


def pair_features(left: Column | str, right: Column | str) -> Column:
    """``[l * r, |l - r|]``: the same for both orders of a pair."""
    l_, r_ = (F.col(x) if isinstance(x, str) else x for x in (left, right))
    return F.concat(F.zip_with(l_, r_, lambda x, y: x * y), F.zip_with(l_, r_, lambda x, y: F.abs(x - y)))


def fusion_features(image: Column, text: Column) -> Column:
    """``[i, t, i * t, |i - t|]`` of the modalities of one listing."""
    return F.concat(image, text, F.zip_with(image, text, lambda x, y: x * y), F.zip_with(image, text, lambda x, y: F.abs(x - y)))


def score_preserving(image: Column, text: Column, weight: float) -> Column:
    """Joint vector whose dot product is ``w * image + (1 - w) * text`` cosine."""
    return F.concat(F.transform(image, lambda x: x * F.lit(weight**0.5)), F.transform(text, lambda x: x * F.lit((1 - weight) ** 0.5)))


def fit_pair_head(pairs: DataFrame, *, most: int = 20_000, seed: int = 7) -> LogisticRegressionModel:
    """A logistic pair head on labelled pairs ``left_id, right_id, lv, rv, positive``.

    It is fitted on at most ``most`` pairs, those with the smallest digests; all
    pairs can be scored.
    """
    order = F.sha2(F.concat_ws(":", F.lit(seed), F.col("left_id").cast("string"), F.col("right_id").cast("string")), 256)
    some = pairs.orderBy(order).limit(most)
    data = some.select(array_to_vector(pair_features("lv", "rv")).alias("features"), F.col("positive").cast("double").alias("label"))
    return LogisticRegression(maxIter=30, regParam=0.01).fit(data)


def pair_probabilities(model: LogisticRegressionModel, pairs: DataFrame) -> DataFrame:
    """The pairs with ``pair_probability``, as plain arithmetic on the coefficients."""
    w = F.array(*[F.lit(float(x)) for x in model.coefficients])
    logit = dot(pair_features("lv", "rv"), w) + F.lit(float(model.intercept))
    return pairs.withColumn("pair_probability", sigmoid(logit))


def probability_of(model, features: DataFrame) -> DataFrame:
    """Probabilities through the library's own transformer, for comparison."""
    return model.transform(features).withColumn("p", vector_to_array("probability")[1])


def contrastive_losses(rows: DataFrame, temperature: float) -> DataFrame:
    """``batch, loss``: supervised contrastive loss of each batch of ``batch, id, label, v`` (unit vectors; a few hundred rows a batch)."""
    b = rows.select("batch", F.col("id").alias("jd"), F.col("label").alias("jl"), F.col("v").alias("jv"))
    pairs = rows.join(b, "batch").where("id <> jd").select("batch", "id", "label", "jl", (dot("v", "jv") / temperature).alias("z"))
    top = pairs.groupBy("batch", "id").agg(F.max("z").alias("m"))
    shifted = pairs.join(top, ["batch", "id"]).select("batch", "id", (F.col("label") == F.col("jl")).alias("same"), (F.col("z") - F.col("m")).alias("z"))
    per = shifted.groupBy("batch", "id").agg(
        F.log(F.sum(F.exp("z"))).alias("lse"), F.sum(F.when(F.col("same"), F.col("z")).otherwise(0.0)).alias("s"), F.sum(F.col("same").cast("long")).alias("n")
    )
    checked = F.when(F.col("n") > 0, F.col("n")).otherwise(F.raise_error(F.lit("an anchor has no other sample of its label")).cast("long"))
    return per.groupBy("batch").agg(F.avg(-(F.col("s") / checked - F.col("lse"))).alias("loss"))


def contrastive_loss(batch: DataFrame, temperature: float) -> DataFrame:
    """One row ``loss`` of one batch ``id, label, v``."""
    return contrastive_losses(batch.withColumn("batch", F.lit(0)), temperature).agg(F.avg("loss").alias("loss"))


def accept_candidate(runs: DataFrame) -> DataFrame:
    """One row ``accepted``: the candidate loses no mAP, at most 0.002 recall, gains precision, adds no variant errors.

    ``runs``: one row with ``base_`` and ``new_`` of ``map, recall, precision, variant_errors``.
    """
    c = F.col
    return runs.select((
        (c("new_map") >= c("base_map")) & (c("new_recall") >= c("base_recall") - 0.002)
        & (c("new_precision") > c("base_precision")) & (c("new_variant_errors") <= c("base_variant_errors"))
    ).alias("accepted"))


def best_epoch(history: DataFrame, initial: float | None = None) -> DataFrame:
    """One row ``best_epoch``: the first epoch of the strictly best score; -1 if the initial state is not beaten."""
    best = history.agg(F.max("score").alias("m"))
    first = history.crossJoin(F.broadcast(best)).where("score = m").agg(F.min("epoch").alias("e"), F.max("m").alias("m"))
    return first.select((F.when(F.col("m") > F.lit(initial), F.col("e")).otherwise(-1) if initial is not None else F.col("e")).cast("int").alias("best_epoch"))


def parse_ppm(data: bytes) -> np.ndarray:
    """A plain or raw PPM image as bytes ``[height, width, 3]``."""
    if data[:2] == b"P3":
        words = b" ".join(line.partition(b"#")[0] for line in data.splitlines()).split()
        w, h, top = int(words[1]), int(words[2]), int(words[3])
        return (np.array(words[4 : 4 + 3 * w * h], dtype=float).reshape(h, w, 3) * 255 / top).round().astype(np.uint8)
    head = data.split(None, 4)
    w, h = int(head[1]), int(head[2])
    return np.frombuffer(data[-3 * w * h :], dtype=np.uint8).reshape(h, w, 3)


def resize_and_pad(image: np.ndarray, side: int) -> np.ndarray:
    """The image scaled to fit a square, its proportions kept, centred on black, in ``[-1, 1]`` as ``[3, side, side]``."""
    h, w = image.shape[:2]
    scale = side / max(h, w)
    nh, nw = max(1, round(h * scale)), max(1, round(w * scale))
    rows = np.minimum((np.arange(nh) / scale).astype(int), h - 1)
    cols = np.minimum((np.arange(nw) / scale).astype(int), w - 1)
    out = np.zeros((side, side, 3), dtype=np.float32)
    top, left = (side - nh) // 2, (side - nw) // 2
    out[top : top + nh, left : left + nw] = image[rows][:, cols]
    return (out / 127.5 - 1).transpose(2, 0, 1)
