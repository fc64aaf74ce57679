"""One form for text that looks the same but is written with other characters."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmatch.runtime import Scratch

#: Members of a class that one part pairs with all others.
PART_ROWS = 5_000
# Look-alike letters and the Latin letters they pass for.
LOOKALIKES = (
    ("аеорсухіѕјһԁԛԝӏү", "aeopcyxisjhdqwly"),  # Cyrillic, small
    ("АВЕЅІЈКМНОРСТУХԚԜӀҮԌ", "ABESIJKMHOPCTYXQWIYG"),  # Cyrillic, capital
    ("ονιαγρυχ", "oviaypux"),  # Greek, small
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX"),  # Greek, capital
    ("օոսհցզ", "onuhgq"),  # Armenian, small
    ("ՕՏՍ", "OSU"),  # Armenian, capital
    ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎽᏀᏃᏔᏙᏚᏞᏟᏢᏦᏴ", "DRTAJEWMHYGZWVSLCPKB"),  # Cherokee
    ("ꭰꭱꭺꭻꭼꮃꮇꮋꮐꮓꮩꮪꮮꮯꮲꮶᏸ", "DRAJEWMHGZVSLCPKB"),  # Cherokee, small
    ("ɡɑıƖ", "gail"),  # Latin variants
    ("ÐƉ", "ĐĐ"),
    ("‐‑", "--"),
)
# First and last code points of the ranges that are ignorable by default.
IGNORABLE = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5),
    (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164),
    (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3),
    (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)
#: Compatibility forms that a reader can tell from the plain character: m² is not m2.
TOLD_APART = ("<super>", "<sub>", "<circle>", "<square>", "<fraction>")
#: Joins the values of a batch so that one pass handles all of them.
JOINT = "\uf8ff"

_LETTERS = {a: b for many, plain in LOOKALIKES for a, b in zip(many, plain, strict=True)}


def _opened(c: str, every: bool) -> str:
    """Compatibility decomposition of one character, without the visible kinds unless ``every``."""
    kind = unicodedata.decomposition(c).partition(" ")[0]
    if kind in TOLD_APART and not every:
        return c
    return unicodedata.normalize("NFKD" if kind.startswith("<") else "NFD", c)


def _replacement(c: str, every: bool) -> str:
    code = ord(c)
    if any(a <= code <= b for a, b in IGNORABLE):
        return ""
    if c in "\u2028\u2029\x85":
        return "\n"
    if c == "\u2800" or unicodedata.category(c) == "Zs":
        return " "
    return "".join(_LETTERS.get(x, x) for x in _opened(c, every))


def _pass(text: str, every: bool) -> str:
    table = {ord(c): _replacement(c, every) for c in set(text)}
    return unicodedata.normalize("NFC", text.translate(table))


def looks(values: list[str], *, fold: bool, every: bool = True) -> list[str]:
    """The form of each value; all are handled in one pass over their joined text.

    ``every`` opens all compatibility characters, else superscripts, fractions
    and the like stay.  ``fold`` applies full case folding after look-alike
    letters were replaced, since several of them change under folding.
    """
    if any(JOINT in v for v in values):
        done = [_pass(v, every) for v in values]
    else:
        done = _pass(JOINT.join(values), every).split(JOINT) if values else []
    return [unicodedata.normalize("NFC", v.casefold()) for v in done] if fold else done


def _text_forms(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """``folded``: the consistent form for comparison. ``look``: what a reader sees, case kept."""
    for values in batches:
        codes, uniques = pd.factorize(values)  # a null gets the code -1
        plain = list(uniques)
        folded = pd.Series([*looks(plain, fold=True), None], dtype=object)
        look = pd.Series([*looks(plain, fold=False, every=False), None], dtype=object)
        yield pd.DataFrame({"folded": folded.iloc[codes].to_numpy(), "look": look.iloc[codes].to_numpy()})


def text_forms(column: Column | str) -> Column:
    """Both forms of a text column as a struct ``folded, look``."""
    return F.pandas_udf(_text_forms, "folded string, look string")(column)


def consistent_text(df: DataFrame, column: str, out: str) -> DataFrame:
    """Add ``out``, the one form of ``column``.

    Each distinct value is handled once.  Nulls stay null, the empty text stays
    empty, whole texts are used whatever their length; existing columns are
    kept, but for one already named ``out``, which is replaced.
    """
    return df.withColumn(out, text_forms(F.col(column))["folded"])


def lookalike_members(df: DataFrame, id_col: str, column: str, scratch: Scratch) -> DataFrame:
    """``id, text, class_id`` of the rows whose text is also written with other characters, a written table.

    Texts meet by their consistent form; then what a reader can see (case,
    kind and number of plain blanks) has to agree as well.  Rows with a null id
    or text are left out, repeated rows count once.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(column).alias("text")).where("id is not null and text is not null").distinct()
    formed = scratch.write(
        rows.select("text").distinct().select("text", text_forms("text").alias("f"))
        .select("text", F.md5(F.concat_ws("\x1e", "f.folded", "f.look").cast("binary")).alias("class_id"))
    )
    several = formed.groupBy("class_id").agg(F.count("*").alias("n")).where("n > 1").select("class_id")
    return scratch.write(rows.join(formed.join(several, "class_id", "left_semi"), "text").select("id", "text", "class_id"))


def lookalike_classes(df: DataFrame, id_col: str, column: str) -> DataFrame:
    """``id, class_id, members, links``: one row for each id and class of texts that look the same.

    ``members`` counts the ids of the class with each of their texts, ``links``
    those whose text differs in its characters.  Nothing is paired, so a text
    with a third of all rows stays a count.  Ids whose text is written in one
    way only have no row.
    """
    members = lookalike_members(df, id_col, column, Scratch(df.sparkSession, "looks"))
    texts = members.groupBy("class_id", "text").agg(F.count("*").alias("own"))
    sizes = texts.groupBy("class_id").agg(F.sum("own").alias("members"))
    return (
        members.join(texts, ["class_id", "text"]).join(sizes, "class_id")
        .groupBy("id", "class_id", "members").agg(F.max(F.col("members") - F.col("own")).alias("links"))
    )


def lookalike_pairs(df: DataFrame, id_col: str, column: str) -> DataFrame:
    """Pairs of ids whose texts look the same but differ in their characters.

    Returns ``left_id, right_id``, the smaller first and each pair once.  Null
    ids and texts, repeated rows and equal texts give no pair.  The members of
    a large class are paired in parts of ``PART_ROWS`` with all of the class.
    """
    members = lookalike_members(df, id_col, column, Scratch(df.sparkSession, "looks"))
    parts = members.groupBy("class_id").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
    sized = members.join(parts, "class_id")
    left = sized.select("class_id", F.col("id").alias("a_id"), F.col("text").alias("a"), F.pmod(F.xxhash64("id", "text"), F.col("parts")).cast("int").alias("part"))
    right = sized.select("class_id", F.col("id").alias("b_id"), F.col("text").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return (
        left.join(right, ["class_id", "part"]).where("a_id < b_id and a <> b")
        .select(F.col("a_id").alias("left_id"), F.col("b_id").alias("right_id")).distinct()
    )
