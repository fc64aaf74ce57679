"""Strict scans: metadata, manifests, images, embeddings, assignments, evidence."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.errors import ContractError, DataValidationError, FixtureError
from kinmatch.functions.hashes import PHASH

METADATA = ("posting_id", "image", "image_phash", "title", "label_group")
MANIFEST = "posting_id string, image string, label_group string, super_component_id string, split string"
ASSIGNMENTS = "posting_id string, entity_id string, cluster_size int, cluster_confidence double, manual_review boolean"
NEGATIVES = (
    "left_posting_id string, right_posting_id string, left_label_group string, right_label_group string, cosine_similarity double, "
    "pair_probability double, variant_conflict boolean, left_identity_tokens array<string>, right_identity_tokens array<string>"
)


def unsafe_name(c: Column) -> Column:
    """Whether a file name is absolute or has several parts, under POSIX or Windows rules."""
    return c.rlike(r"[/\\]") | c.rlike(r"^[A-Za-z]:") | c.isin(".", "..")


def reject_reason(df: DataFrame) -> Column:
    """The first rule a metadata row breaks: a value is missing, then an unsafe path, then a bad hash; null if none."""
    missing = F.lit(False)
    for c in METADATA:
        missing = missing | F.col(c).isNull() | (F.trim(c) == "")
    return (
        F.when(missing, "missing_value").when(unsafe_name(F.trim("image")), "unsafe_image_path")
        .when(~F.trim("image_phash").rlike(PHASH), "invalid_phash")
    )


def screened(df: DataFrame) -> DataFrame:
    """The rows trimmed, hashes in lower case, with ``reject_reason``."""
    trimmed = df.withColumn("reject_reason", reject_reason(df))
    for c in METADATA:
        trimmed = trimmed.withColumn(c, F.trim(c))
    return trimmed.withColumn("image_phash", F.lower("image_phash"))


def scan_metadata(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Good rows of a metadata CSV and the rejected ones with their reason.

    The header has to name the five columns; further columns are passed over.
    """
    header = spark.read.option("header", True).csv(path)
    if absent := [c for c in METADATA if c not in header.columns]:
        raise ContractError(f"columns are missing: {absent}")
    rows = screened(header.select(*METADATA))
    return rows.where("reject_reason is null").drop("reject_reason"), rows.where("reject_reason is not null")


def joined_splits(metadata: DataFrame, manifest: DataFrame) -> DataFrame:
    """Metadata with its split; both must hold the same ids and no label may cross splits."""
    both = metadata.join(manifest.select("posting_id", "split", F.lit(1).alias("_m")), "posting_id", "full_outer")
    odd = both.where(F.col("_m").isNull() | F.col("title").isNull()).limit(1).count()
    if odd:
        raise DataValidationError("metadata and manifest hold different postings")
    crossing = both.groupBy("label_group").agg(F.countDistinct("split").alias("n")).where("n > 1").limit(1).count()
    if crossing:
        raise DataValidationError("a label group stands in several splits")
    return both.drop("_m")


def one_split(metadata: DataFrame, manifest: DataFrame, name: str) -> DataFrame:
    """Rows of one split by semi join; no other label is read beyond the join."""
    return metadata.join(manifest.where(F.col("split") == name).select("posting_id"), "posting_id", "left_semi")


def label_blind(metadata: DataFrame) -> DataFrame:
    """Rows without their labels."""
    return metadata.select("posting_id", "image", "image_phash", "title")


def scan_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("mode", "FAILFAST").json(path)


def scan_negatives(spark: SparkSession, path: str) -> DataFrame:
    """A hard-negative manifest: sides in order, labels that differ, each pair once."""
    rows = spark.read.schema(NEGATIVES).option("mode", "FAILFAST").json(path)
    wrong = rows.where("left_posting_id >= right_posting_id or left_label_group = right_label_group or pair_probability not between 0 and 1")
    twice = rows.groupBy("left_posting_id", "right_posting_id").count().where("count > 1")
    if wrong.limit(1).count() or twice.limit(1).count():
        raise ContractError("the negatives are not in canonical form")
    return rows


def _dimensions(data: bytes) -> tuple[int, int] | None:
    """Width and height from the header of a PNG, JPEG, GIF or plain or raw PPM file."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return int.from_bytes(data[16:20]), int.from_bytes(data[20:24])
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
    if data[:2] in (b"P3", b"P6"):
        words = b" ".join(line.partition(b"#")[0] for line in data[:4096].splitlines()).split()
        return (int(words[1]), int(words[2])) if len(words) > 3 and words[1].isdigit() and words[2].isdigit() else None
    if data[:2] == b"\xff\xd8":
        i = 2
        while i + 9 < len(data) and data[i] == 0xFF:
            kind, size = data[i + 1], int.from_bytes(data[i + 2 : i + 4])
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                return int.from_bytes(data[i + 7 : i + 9]), int.from_bytes(data[i + 5 : i + 7])
            i += 2 + size
    return None


def scan_images(spark: SparkSession, folder: str) -> DataFrame:
    """``image, path, sha256, width, height, file_bytes`` of the files of a folder; undecodable ones have null sides."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    hashed = files.select(F.element_at(F.split("path", "/"), -1).alias("image"), "path", F.sha2("content", 256).alias("sha256"), F.col("length").cast("int").alias("file_bytes"), "content")

    def sides(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            found = [_dimensions(bytes(c)) or (None, None) for c in d["content"]]
            d = d.drop(columns="content")
            d["width"] = pd.array([w for w, _ in found], dtype="Int32")
            d["height"] = pd.array([h for _, h in found], dtype="Int32")
            yield d

    return hashed.mapInPandas(sides, "image string, path string, sha256 string, file_bytes int, width int, height int")


def image_findings(listings: DataFrame, images: DataFrame) -> DataFrame:
    """``code, n``: images that are missing, that nothing names and that cannot be read."""
    named, there = listings.select("image").where("image is not null").distinct(), images.select("image").distinct()
    count = lambda df, code: df.agg(F.lit(code).alias("code"), F.count("*").alias("n"))
    broken = images.where("width is null or height is null").select("image").distinct()
    return count(named.join(there, "image", "left_anti"), "missing_image").unionByName(count(there.join(named, "image", "left_anti"), "unreferenced_image")).unionByName(
        count(broken, "undecodable_image")
    )


def checked_embeddings(df: DataFrame, id_col: str, vector: str, *, width: int, tolerance: float = 1e-4) -> DataFrame:
    """The vectors, or an error: unique ids, one width, finite values, unit length."""
    v = F.col(vector)
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x))
    bad = df.select(
        F.sum((v.isNull() | (F.size(v) != width) | ~F.coalesce(finite, F.lit(False)) | (F.abs(length - 1) > tolerance)).cast("long")).alias("bad"),
        (F.count("*") - F.countDistinct(id_col)).alias("twice"),
    ).first()
    if bad["bad"] or bad["twice"]:
        raise ContractError(f"{bad['bad']} vectors break the contract, {bad['twice']} ids are repeated")
    return df


def aligned_modalities(image: DataFrame, text: DataFrame, id_col: str) -> DataFrame:
    """Two embedding tables on one id, or an error if one lacks a row of the other."""
    both = image.withColumnRenamed("embedding", "image").join(text.withColumnRenamed("embedding", "text"), id_col, "full_outer")
    if both.where("image is null or text is null").limit(1).count():
        raise ContractError("the modalities hold different rows")
    return both


def scan_assignments(spark: SparkSession, path: str) -> DataFrame:
    """A typed assignment CSV with unique postings."""
    rows = spark.read.schema(ASSIGNMENTS).option("header", True).option("mode", "FAILFAST").csv(path)
    if rows.groupBy("posting_id").count().where("count > 1").limit(1).count():
        raise ContractError("a posting is assigned twice")
    return rows


def scan_evidence(spark: SparkSession, paths: list[str], keys: tuple[str, ...]) -> DataFrame:
    """One row per run summary; all have the keys and share one manifest hash."""
    runs = []
    for p in paths:
        with open(p, encoding="utf-8") as f:
            run = json.load(f)
        if absent := [k for k in keys if k not in run]:
            raise ContractError(f"{p} lacks {absent}")
        runs.append({k: run[k] for k in keys})
    if len({r.get("manifest_sha256") for r in runs}) > 1:
        raise ContractError("the runs used different manifests")
    return spark.createDataFrame(pd.DataFrame(runs))


def query_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Queries that arrive as JSON files in a folder (an extension: the batch matcher works on any DataFrame)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).json(folder)


def check_fixture(rows: DataFrame, records: int, sizes: dict[int, int]) -> None:
    """A metadata fixture has to hold so many records and label groups of the stated sizes, or it is an error."""
    groups = rows.groupBy("label_group").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))
    found = {r["size"]: r["n"] for r in groups.limit(len(sizes) + 1).collect()}
    if rows.count() != records or found != sizes:
        raise FixtureError(f"expected {records} records in groups {sizes}, found groups {found}")
