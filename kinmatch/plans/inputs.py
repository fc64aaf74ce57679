"""Test tables in the shape that the operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.functions.hashes import phash_bits
from kinmatch.functions.titles import feature_title
from kinmatch.operators.rankers import vectors
from kinmatch.runtime import spread, table

#: Searches take every row whose id this number divides as a query, against all rows.
QUERY_EVERY = 20


def is_query(c: str) -> Column:
    return F.col(c) % QUERY_EVERY == 0


def embedded(spark: SparkSession, d: str) -> DataFrame:
    """``id, v`` of the embeddings."""
    return vectors(table(spark, d, "embeddings"), "vec_id", "embedding")


def embedded_truth(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")


def embedded_halves(spark: SparkSession, d: str) -> DataFrame:
    """``id, image, text``: both halves of each vector at unit length, as two modalities."""
    e = table(spark, d, "embeddings")
    half = lambda a: F.slice("embedding", a, 32)
    one = vectors(e.select("vec_id", half(1).alias("embedding")), "vec_id", "embedding").withColumnRenamed("v", "image")
    two = vectors(e.select("vec_id", half(33).alias("embedding")), "vec_id", "embedding").withColumnRenamed("v", "text")
    return one.join(two, "id")


def titled(spark: SparkSession, d: str) -> DataFrame:
    """``id, norm`` of the listings with a title."""
    rows = table(spark, d, "listing").where("title is not null").select(F.col("row_number").alias("id"), "title")
    return spread(rows, "id").select("id", feature_title("title").alias("norm"))


def hashed(spark: SparkSession, d: str) -> DataFrame:
    """``id, bits`` of the listings with a plain 64-bit hash."""
    return spread(table(spark, d, "listing").select("row_number", "image_phash"), "row_number").select(F.col("row_number").alias("id"), phash_bits("image_phash").alias("bits")).where("bits is not null")


def listing_labels(spark: SparkSession, d: str) -> DataFrame:
    """``id, label`` of each labelled posting; of redelivered rows the label is one."""
    return table(spark, d, "listing").where("label_group is not null").groupBy(F.col("posting_id").alias("id")).agg(F.min("label_group").alias("label"))


def train_with_images(spark: SparkSession, d: str) -> DataFrame:
    """Training rows with the content of their picture; repeated rows once."""
    images = table(spark, d, "image_record").groupBy("image").agg(F.min("sha256").alias("sha256"))
    rows = table(spark, d, "train").select("posting_id", "image", "image_phash", "title", "label_group").distinct()
    return rows.join(images, "image", "left")
