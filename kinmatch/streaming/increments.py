"""Streams over the catalogue.  An extension: the batch operators state the semantics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.functions.titles import plain_title


def redelivery_free(stream: DataFrame, delay: str = "30 days") -> DataFrame:
    """Listings without redelivered copies: the first arrival of a posting within the watermark."""
    return stream.withWatermark("ingested_at", delay).dropDuplicatesWithinWatermark(["posting_id"])


def arrivals(stream: DataFrame, window: str = "1 day", delay: str = "2 days") -> DataFrame:
    """``window_start, listings, titles`` per window of arrival time; later rows than the watermark are passed over."""
    marked = stream.withWatermark("ingested_at", delay)
    return marked.groupBy(F.window("ingested_at", window)).agg(
        F.count("*").alias("listings"), F.approx_count_distinct("title").alias("titles")
    ).select(F.col("window.start").alias("window_start"), "listings", "titles")


def known_titles(stream: DataFrame, catalogue: DataFrame) -> DataFrame:
    """New listings beside the label groups of catalogue rows with the same normalized title (stream to table join)."""
    groups = catalogue.where("title is not null and label_group is not null").groupBy(plain_title("title").alias("norm")).agg(F.min("label_group").alias("known_label_group"))
    return stream.withColumn("norm", plain_title("title")).join(groups, "norm", "left").drop("norm")
