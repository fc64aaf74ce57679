"""Records that are the same but for their formatting, by progressive refinement.

Three levels, each only inside the classes of the one before that have several
members: stripped length and bare code, then the letter histogram, then the
exact key.  Counts and first rows are aggregated before any join, so a record
that makes up a third of all rows is one row after the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmatch.runtime import Scratch

NEITHER = r"[^\p{L}\p{Nd}]+"


def one_case(c: Column) -> Column:
    """Text without letter case."""
    return F.lower(c)


def stripped(c: Column) -> Column:
    return F.regexp_replace(one_case(c), NEITHER, "")


def cheap_invariant(title: Column, code: Column) -> Column:
    """Hash of the title's stripped length and the bare code; equal records always agree on it."""
    return F.xxhash64(F.length(stripped(title)), stripped(code))


def letter_histogram(title: Column) -> Column:
    """Hash of the letters and digits in order, each as often as it comes."""
    return F.xxhash64(F.array_join(F.sort_array(F.split(stripped(title), "")), ""))


def exact_key(title: Column, code: Column) -> Column:
    """The record itself: its words in one order and its bare code."""
    words = F.filter(F.split(one_case(title), NEITHER), lambda w: w != "")
    bare = F.regexp_replace(one_case(code), NEITHER, "")
    return F.concat_ws("\n", F.array_join(F.sort_array(words), " "), bare)


def refine_duplicates(df: DataFrame, id_col: str, title: str, code: str) -> DataFrame:
    """``row_id, first_id, copies`` for each row with both fields.

    ``first_id`` is the smallest id of the record's rows.  A row in which a
    field is null is no record and is left out; texts of signs only are the
    empty record; every row counts, redelivered ones too.  Other columns are
    not read, so their names do not matter.  The first invariant is made on both
    passes over the rows, as writing all texts would cost more; everything after
    it is made once, for rows that may still have a partner.
    """
    scratch = Scratch(df.sparkSession, "records")
    rows = df.select(F.col(id_col).alias("row_id"), F.col(title).alias("t"), F.col(code).alias("h")).where(
        "row_id is not null and t is not null and h is not null"
    )

    def classes(level: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The rows that stand alone in their class ``c``, and the classes of several."""
        found = scratch.write(level.groupBy("c").agg(F.count("*").alias("n"), F.min("row_id").alias("only")))
        single = found.where("n = 1").select(F.col("only").alias("row_id"), F.col("only").alias("first_id"), F.lit(1).cast("long").alias("copies"))
        return single, found.where("n > 1").select("c")

    first = rows.select("*", cheap_invariant(F.col("t"), F.col("h")).alias("c"))
    alone, several = classes(first.select("row_id", "c"))
    second = scratch.write(first.join(several, "c", "left_semi").select("row_id", "t", "h", F.xxhash64("c", letter_histogram(F.col("t"))).alias("c")))
    alone_too, several = classes(second.select("row_id", "c"))
    joint = scratch.write(second.join(several, "c", "left_semi").select("row_id", exact_key(F.col("t"), F.col("h")).alias("key")))
    scratch.drop(second)
    records = joint.groupBy("key").agg(F.min("row_id").alias("first_id"), F.count("*").alias("copies"))
    return alone.unionByName(alone_too).unionByName(joint.join(records, "key").select("row_id", "first_id", "copies"))


def distinct_records(df: DataFrame, id_col: str, title: str, code: str) -> DataFrame:
    """One row for each distinct record with its number of copies: ``first_id, copies``."""
    return refine_duplicates(df, id_col, title, code).where("row_id = first_id").select("first_id", "copies")
