"""Sinks that never overwrite: an equal output is left alone, another one is an error."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.errors import OutputConflictError


def write_once(path: str, content: bytes | str) -> bool:
    """Write a small file through a temporary one; False if it is there already with the same content."""
    data = content.encode() if isinstance(content, str) else content
    target = Path(path)
    if target.exists():
        if hashlib.sha256(target.read_bytes()).digest() != hashlib.sha256(data).digest():
            raise OutputConflictError(f"{path} exists with other contents")
        return False
    target.parent.mkdir(parents=True, exist_ok=True)
    fd, temporary = tempfile.mkstemp(dir=target.parent)
    with os.fdopen(fd, "wb") as f:
        f.write(data)
    os.replace(temporary, target)
    return True


def table_digest(df: DataFrame) -> tuple[int, int]:
    """Rows and an order-free digest of a table."""
    r = df.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in sorted(df.columns)]), F.lit(1 << 40))).alias("h")).first()
    return r["n"], r["h"] or 0


def write_table_once(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None, **options) -> bool:
    """Write a table, or find the same rows there already; other rows are an error."""
    spark = df.sparkSession
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
        there = spark.read.schema(df.schema).format(fmt).options(**options).load(path)
        if table_digest(there) != table_digest(df):
            raise OutputConflictError(f"{path} exists with other rows")
        return False
    writer = df.write.mode("errorifexists").format(fmt).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
    return True


def write_manifest(rows: DataFrame, path: str) -> bool:
    """A split manifest as JSON lines, in order of the posting."""
    cols = ["posting_id", "image", "label_group", "super_component_id", "split"]
    return write_table_once(rows.select(*cols).repartitionByRange("posting_id").sortWithinPartitions("posting_id"), path, "json")


def write_assignments(rows: DataFrame, path: str) -> bool:
    cols = ["posting_id", "entity_id", "cluster_size", "cluster_confidence", "manual_review"]
    return write_table_once(rows.select(*cols), path, "csv", header=True)


def write_embeddings(df: DataFrame, path: str, contract: dict) -> bool:
    """Vectors as Parquet with their contract beside them."""
    fresh = write_table_once(df, path)
    write_once(f"{path}.contract.json", json.dumps(contract, sort_keys=True, indent=1))
    return fresh


def pair_json(pairs: DataFrame) -> DataFrame:
    """One JSON text per pair."""
    return pairs.select(F.to_json(F.struct(*pairs.columns)).alias("json"))


def markdown_report(title: str, tables: dict[str, DataFrame], most: int = 50) -> str:
    """Small tables as Markdown; a table of more rows than ``most`` is refused."""
    out = [f"# {title}"]
    for name, df in tables.items():
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{name} is too long for a report")
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows]
    return "\n".join(out) + "\n"


def bar_svg(title: str, bars: list[tuple[str, float]]) -> str:
    """Horizontal bars with their values."""
    top = max((v for _, v in bars), default=0) or 1
    parts = [f'<svg xmlns="http://www.w3.org/2000/svg" width="640" height="{40 + 24 * len(bars)}" font-family="sans-serif" font-size="12">', f'<text x="8" y="20" font-size="14">{title}</text>']
    for i, (name, v) in enumerate(bars):
        y = 36 + 24 * i
        parts.append(f'<text x="8" y="{y + 12}">{name}</text><rect x="160" y="{y}" width="{400 * v / top:.1f}" height="16" fill="#4477aa"/><text x="{166 + 400 * v / top:.1f}" y="{y + 12}">{v:g}</text>')
    return "".join([*parts, "</svg>"])


def curve_svg(title: str, lines: dict[str, list[tuple[float, float]]]) -> str:
    """Lines over the unit square, for threshold curves."""
    colours = ("#4477aa", "#ee6677", "#228833", "#ccbb44")
    parts = [f'<svg xmlns="http://www.w3.org/2000/svg" width="480" height="340" font-family="sans-serif" font-size="12"><text x="8" y="20" font-size="14">{title}</text>', '<rect x="40" y="30" width="400" height="270" fill="none" stroke="#999"/>']
    for (name, points), colour in zip(lines.items(), colours, strict=False):
        path = " ".join(f"{40 + 400 * x:.1f},{300 - 270 * y:.1f}" for x, y in points)
        parts.append(f'<polyline fill="none" stroke="{colour}" points="{path}"><title>{name}</title></polyline>')
    return "".join([*parts, "</svg>"])
