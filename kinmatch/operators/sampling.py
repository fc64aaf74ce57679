"""Deterministic samples ordered by digests instead of random states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.functions.hashes import stable_order


def product_batches(rows: DataFrame, *, products: int, samples: int, batches: int, seed: int) -> DataFrame:
    """``batch, slot, id, label``: each batch has ``products`` labels with ``samples`` rows each.

    Labels of at least two rows take part.  A label with fewer rows than
    ``samples`` repeats them in turns.  Per batch only the first labels in
    digest order and their first rows are kept, by aggregates of bounded size.
    """
    sized = rows.where("id is not null and label is not null").groupBy("label").agg(F.count("*").alias("n")).where("n >= 2")
    spark = rows.sparkSession
    turns = spark.range(batches).select(F.col("id").cast("int").alias("batch"))
    keyed = sized.crossJoin(F.broadcast(turns)).withColumn("o", F.sha2(F.concat_ws(":", F.lit(seed), "batch", "label"), 256))
    chosen = keyed.withColumn("p", F.row_number().over(Window.partitionBy("batch").orderBy("o", "label"))).where(F.col("p") <= products)
    members = rows.join(F.broadcast(chosen.select("batch", "label", "n")), "label")
    inner = Window.partitionBy("batch", "label").orderBy("m", "id")
    placed = members.withColumn("m", F.sha2(F.concat_ws(":", F.lit(seed), "batch", F.col("id").cast("string")), 256)).withColumn("r", F.row_number().over(inner)).where(F.col("r") <= samples)
    have = F.least("n", F.lit(samples))
    slots = F.sequence(F.col("r") - 1, F.lit(samples - 1), have.cast("int"))
    return placed.select("batch", "label", "id", F.explode(slots).alias("slot"))


def row_batches(rows: DataFrame, *, size: int, seed: int) -> DataFrame:
    """All rows ``id, label`` with their ``batch``, about ``size`` rows each.

    Two rows of a label, three where one would be left, go to a batch together,
    so a row has another of its label in its batch if there is one at all.
    """
    own = rows.where("id is not null and label is not null")
    n = max(1, -(-own.count() // size))
    by = Window.partitionBy("label")
    place = F.row_number().over(by.orderBy(stable_order(seed, "id"), "id")) - 1
    pair = F.greatest(F.lit(0), F.least(F.floor(place / 2), F.floor(F.count("*").over(by) / 2) - 1))
    digest = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.col("label").cast("string"), pair.cast("bigint").cast("string")), 256), 1, 8), 16, 10)
    return own.withColumn("batch", F.pmod(digest.cast("long"), F.lit(n)).cast("int"))


def balanced_batches(rows: DataFrame, *, ratio: int, seed: int) -> DataFrame:
    """``batch, left_id, right_id, positive`` of every batch ``batch, id, label``: all positives and at most ``ratio`` negatives each.

    A batch is what a model sees at once, a few hundred rows.
    """
    a = rows.select("batch", F.col("id").alias("left_id"), F.col("label").alias("ll"))
    b = rows.select("batch", F.col("id").alias("right_id"), F.col("label").alias("rl"))
    pairs = a.join(b, "batch").where("left_id < right_id").withColumn("positive", F.col("ll") == F.col("rl"))
    order = F.sha2(F.concat_ws(":", F.lit(seed), F.col("left_id").cast("string"), F.col("right_id").cast("string")), 256)
    placed = pairs.withColumn("r", F.row_number().over(Window.partitionBy("batch", "positive").orderBy(order, "left_id", "right_id")))
    total = pairs.groupBy("batch").agg(F.sum(F.col("positive").cast("long")).alias("np"))
    return placed.join(total, "batch").where(F.col("positive") | (F.col("r") <= ratio * F.col("np"))).select("batch", "left_id", "right_id", "positive")


def balanced_pairs(rows: DataFrame, *, ratio: int, seed: int) -> DataFrame:
    """``left_id, right_id, positive`` of one batch ``id, label``."""
    return balanced_batches(rows.withColumn("batch", F.lit(0)), ratio=ratio, seed=seed).drop("batch")


def inspection_pairs(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` label groups in digest order with two of their rows, of different images if the group has them."""
    own = rows.where("label is not null and id is not null")
    order = stable_order(seed, "id")
    firsts = own.groupBy("label").agg(F.min_by(F.struct("id", "image"), order).alias("a"), F.countDistinct("image").alias("images"), F.count_distinct("id").alias("n")).where("n >= 2")
    picked = firsts.withColumn("o", stable_order(seed, "label")).orderBy("o", "label").limit(n)
    rest = own.join(F.broadcast(picked.select("label", "a")), "label").where(F.col("id") != F.col("a.id"))
    other = F.struct((F.coalesce(F.col("image") == F.col("a.image"), F.lit(True))).cast("int").alias("same"), order.alias("o"))
    return rest.groupBy("label", F.col("a.id").alias("left_id")).agg(F.min_by("id", other).alias("right_id"))


def collision_samples(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` values of a key that several labels share, in digest order, with their smallest and largest label."""
    by = rows.where(f"{key} is not null and label is not null").groupBy(F.col(key).cast("string").alias("value")).agg(
        F.countDistinct("label").alias("labels"), F.min("label").alias("low_label"), F.max("label").alias("high_label")
    )
    return by.where("labels > 1").withColumn("o", stable_order(seed, "value")).orderBy("o").limit(n).drop("o")


def bounded_diagnostic_pairs(pairs: DataFrame, most: int, seed: int) -> DataFrame:
    """At most ``most`` pairs of each class in digest order; a sampling operator by purpose."""
    order = F.sha2(F.concat_ws(":", F.lit(seed), F.col("left_id").cast("string"), F.col("right_id").cast("string")), 256)
    return pairs.withColumn("_r", F.row_number().over(Window.partitionBy("positive").orderBy(order))).where(F.col("_r") <= most).drop("_r")
