"""Named queries of the training-data operators over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.llm import balanced_splits, grid_components, leakage, listing_groups, lookalikes, packing, refined_duplicates, truncation
from kinmatch.runtime import Scratch, ship, table

#: A scored pair is a link from this probability on.
LINK_PROBABILITY = 0.5


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.lookalike_pairs(table(spark, d, "listing"), "posting_id", "title").select(
        F.col("left_id").alias("left_posting_id"), F.col("right_id").alias("right_posting_id")
    )


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.lookalike_classes(table(spark, d, "listing"), "posting_id", "title").withColumnRenamed("id", "posting_id")


def p1_consistent_titles(spark: SparkSession, d: str) -> DataFrame:
    titles = table(spark, d, "listing").select("row_number", "posting_id", "title")
    return lookalikes.consistent_text(titles, "title", "consistent_title")


def _links(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("pair_probability")
    return table(spark, d, "scored_pair").where((p >= LINK_PROBABILITY) & ~F.isnan(p)).select(
        F.col("left_posting_id").alias("src"), F.col("right_posting_id").alias("dst")
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = grid_components.grid_components(_links(spark, d))
    return found.where("node <> root").select(F.col("root").alias("first_posting_id"), F.col("node").alias("posting_id"))


def p2_entities(spark: SparkSession, d: str) -> DataFrame:
    found = grid_components.grid_components(_links(spark, d))
    pairs = table(spark, d, "scored_pair")
    postings = (
        table(spark, d, "listing").select("posting_id")
        .unionByName(pairs.select(F.col("left_posting_id").alias("posting_id")))
        .unionByName(pairs.select(F.col("right_posting_id").alias("posting_id")))
    )
    return grid_components.assign_groups(found, postings)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "train")
    groups = listing_groups.product_groups(rows)
    unlabelled = rows.where("label_group is null").select("posting_id").distinct()
    return listing_groups.group_pairs(groups.join(unlabelled, "posting_id", "left_semi"))


def p3_products(spark: SparkSession, d: str) -> DataFrame:
    return listing_groups.product_groups(table(spark, d, "train"))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    return listing_groups.product_classes(listing_groups.product_groups(table(spark, d, "train")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    placed = balanced_splits.split_labels(table(spark, d, "listing"), table(spark, d, "split_component"), id_col="posting_id")
    return placed.where("label_group <> first_label_group and split is not null").select("first_label_group", "label_group")


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    return balanced_splits.split_rows(table(spark, d, "listing"), table(spark, d, "split_component"), id_col="posting_id")


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    rows = p4_splits(spark, d).groupBy("split").agg(F.count("*").alias("n_rows"), F.countDistinct("unit").alias("n_units"))
    total = rows.agg(F.sum("n_rows").alias("total"))
    return rows.crossJoin(F.broadcast(total)).select("split", "n_rows", "n_units", F.round(F.col("n_rows") / F.col("total"), 6).alias("share"))


def p4_invariants(spark: SparkSession, d: str) -> DataFrame:
    split = Scratch(spark, "invariants").write(p4_splits(spark, d))
    return balanced_splits.split_invariants(split, table(spark, d, "split_component"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = refined_duplicates.refine_duplicates(table(spark, d, "listing"), "row_number", "title", "image_phash")
    return rows.where("row_id <> first_id").select(F.col("first_id").alias("first_row_number"), F.col("row_id").alias("row_number"))


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    listing = table(spark, d, "listing")
    records = refined_duplicates.distinct_records(listing, "row_number", "title", "image_phash")
    return listing.join(records, listing["row_number"] == records["first_id"]).select("row_number", "posting_id", "title", "image_phash", "copies")


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    counts = packing.token_counts(table(spark, d, "documents"), "doc_id", "text")
    return packing.pack_texts(counts).withColumnRenamed("id", "doc_id")


def p6_summary(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_summary(p6_packed(spark, d))


def p6_invariants(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    packed = Scratch(spark, "invariants").write(packing.pack_texts(packing.token_counts(docs, "doc_id", "text")))
    return packing.packing_invariants(packed, docs, "doc_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.verbatim_leaks(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p7_rewritten(spark: SparkSession, d: str) -> DataFrame:
    return leakage.rewritten_leaks(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    hits = p7_found(spark, d).groupBy("item_id").agg(F.count("*").alias("n_documents"))
    return table(spark, d, "eval_item").select("item_id", "task").join(hits, "item_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated_texts(table(spark, d, "documents")).select(F.col("id").alias("doc_id")).distinct()


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return truncation.source_rates(docs, truncation.truncated_texts(docs))


def p8_spikes(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "documents").where("text is not null").select(F.coalesce("source", F.lit("\x1f")).alias("source"), "text")
    return truncation.length_spikes(truncation.text_lengths(texts)).withColumn("source", F.nullif("source", F.lit("\x1f")))


_ALL = (
    p1_found, p1_classes, p1_consistent_titles, p2_found, p2_entities, p3_found, p3_products, p3_classes, p4_found, p4_splits, p4_shares, p4_invariants,
    p5_found, p5_records, p6_packed, p6_summary, p6_invariants, p7_found, p7_rewritten, p7_items, p8_found, p8_rates, p8_spikes,
)


def _shipped(f: Callable) -> Callable:
    def run(spark: SparkSession, d: str) -> DataFrame:
        ship(spark)
        return f(spark, d)

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: _shipped(f) for f in _ALL}
