"""Title functions.  Three normal forms exist on purpose and are never merged."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Quantity and unit markers, found anywhere in a normalized title, also inside words.
IDENTITY = r"\d+(?:[.,]\d+)?|(?:ml|cl|dl|l|mg|g|kg|mm|cm|m|gb|tb|pcs?|pack|set|x)"
# Digits and whole-word units of the failure reviews.
DIGITS = r"\d+(?:[.,]\d+)?"
WHOLE_UNITS = r"\b(?:kg|g|mg|l|ml|cm|mm|m|gb|tb|mah|w|v|pcs|pc|pack|size|sz)\b"
# Code point ranges of the scripts that the audit counts.
SCRIPTS = (
    ("cjk", 0x4E00, 0x9FFF), ("japanese", 0x3040, 0x30FF), ("hangul", 0xAC00, 0xD7AF), ("thai", 0x0E00, 0x0E7F),
    ("cyrillic", 0x0400, 0x04FF), ("arabic", 0x0600, 0x06FF),
)

_NOT_WORD = re.compile(r"[^\w]+")
_ESCAPED = re.compile(r"(?:\\x[0-9a-fA-F]{2})+")


def _feature(t: str) -> str:
    return _NOT_WORD.sub(" ", unicodedata.normalize("NFKC", t).casefold()).strip()


def _audit(t: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", t).casefold().split())


def _shown(t: str) -> str:
    def run(m: re.Match) -> str:
        try:
            return bytes.fromhex(m[0].replace("\\x", "")).decode("utf-8")
        except UnicodeDecodeError:
            return m[0]

    return _ESCAPED.sub(run, t)


def _scripts(t: str) -> list[str]:
    found = set()
    for c in set(t):
        named = next((name for name, a, b in SCRIPTS if a <= ord(c) <= b), None)
        if c.isdigit():
            found.add("digits")
        elif named:
            found.add(named)
        elif "LATIN" in unicodedata.name(c, ""):
            found.add("latin")
    return sorted(found or {"other"})


def _arrow(f: Callable, kind: str) -> Callable[[Column | str], Column]:
    """A function of one text as an Arrow UDF that works on distinct values; null stays null."""

    def run(values: pd.Series) -> pd.Series:
        codes, uniques = pd.factorize(values)
        done = pd.Series([*map(f, uniques), None], dtype=object)
        return pd.Series(done.iloc[codes].to_numpy())

    return lambda c: F.pandas_udf(run, kind)(c)


feature_title = _arrow(_feature, "string")
audit_title = _arrow(_audit, "string")
folded_title = _arrow(str.casefold, "string")
shown_title = _arrow(_shown, "string")
title_scripts = _arrow(_scripts, "array<string>")


def plain_title(c: Column | str) -> Column:
    """Feature form without compatibility characters, inside the JVM: lower case, words parted by blanks."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}_]+", " "))


def plain_audit_title(c: Column | str) -> Column:
    """Audit form inside the JVM: lower case, signs kept, blanks collapsed."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), r"\s+", " "))


def word_ngrams(normalized: Column | str, low: int, high: int) -> Column:
    """All character n-grams within words padded by a blank, repeats kept; a word shorter than n gives none."""
    c = F.col(normalized) if isinstance(normalized, str) else normalized

    def of_word(w: Column) -> Column:
        padded = F.concat(F.lit(" "), w, F.lit(" "))

        def of_size(n: int) -> Column:
            places = F.sequence(F.lit(1), F.length(padded) - (n - 1))
            grams = F.transform(places, lambda i: F.substr(padded, i, F.lit(n)))
            return F.when(F.length(padded) >= n, grams).otherwise(F.array().cast("array<string>"))

        sizes = [of_size(n) for n in range(low, high + 1)]
        return F.concat(*sizes)

    return F.flatten(F.transform(F.filter(F.split(c, " "), lambda w: w != ""), of_word))


def identity_tokens(normalized: Column | str) -> Column:
    """Sorted distinct quantity tokens of a normalized title; letters count inside words too."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(normalized, F.lit(IDENTITY), F.lit(0))))


def bounded_identity_tokens(normalized: Column | str) -> Column:
    """The same with unit markers as whole words or right after a number only."""
    bounded = r"\d+|(?<![\p{L}\p{N}])(?:ml|cl|dl|l|mg|g|kg|mm|cm|m|gb|tb|pcs?|pack|set|x)(?![\p{L}])|(?<=\d)(?:ml|cl|dl|l|mg|g|kg|mm|cm|m|gb|tb|pcs?)(?![\p{L}])"
    return F.array_sort(F.array_distinct(F.regexp_extract_all(normalized, F.lit(bounded), F.lit(0))))


def variant_conflict(left: Column, right: Column) -> Column:
    """Whether two token sets differ, at least one of them not empty."""
    return ((F.size(left) + F.size(right)) > 0) & (left != right)


def digit_unit_tokens(text: Column | str) -> Column:
    """Digits and whole-word units in their order, as one struct."""
    return F.struct(
        F.regexp_extract_all(text, F.lit(DIGITS), F.lit(0)).alias("digits"),
        F.regexp_extract_all(text, F.lit(WHOLE_UNITS), F.lit(0)).alias("units"),
    )


def encoded_title(normalized: Column | str, vocabulary: Column, length: int) -> Column:
    """Character ids of a title, cut and padded to ``length``: 0 pads, 1 is unknown; never empty."""
    c = F.col(normalized) if isinstance(normalized, str) else normalized
    ids = F.transform(F.slice(F.filter(F.split(c, ""), lambda x: x != ""), 1, length), lambda x: F.coalesce(F.try_element_at(vocabulary, x), F.lit(1)))
    ids = F.when(F.size(ids) == 0, F.array(F.lit(1))).otherwise(ids)
    return F.slice(F.concat(ids, F.array_repeat(F.lit(0), length)), 1, length)
