"""Evaluation passages inside a corpus, by canonical templates and their slots.

Every word is either part of a turn of phrase or fills a slot: numbers, units
and names become typed placeholders.  Windows of this template are joined by
hash; then the slots decide.  Equal slots are a verbatim passage; they are part
of the join key there, so that no frequent template becomes a hot key.  Slots
that map one to one onto the item's are the item with other parameters; for
those an amount (number and unit, however they are written) and a run of names
are one slot each.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.llm.bit_filter import bit_filter, passes
from kinmatch.llm.title_fields import UNITS
from kinmatch.runtime import Scratch

#: Consecutive words that make a passage; template words and slots of a re-parameterised one, and template words among them.
PASSAGE, REWRITTEN, PHRASED = 12, 24, 8
#: A word in so many items (and this share of them) belongs to a turn of phrase.
PHRASE_LEAST, PHRASE_SHARE = 3, 0.005
#: Characters of the texts that a task takes apart at once.
PORTION = 4_000_000

_WORD = re.compile(r"[^\W_]+")
_STEP = 0x9E3779B97F4A7C15


def words_of(text: str) -> list[str]:
    """Unbroken runs of letters or digits, without letter case."""
    return _WORD.findall(text.casefold())


def slot_kind(word: str, phrase: frozenset[str]) -> str:
    """Placeholder of a slot word; empty for a word of a turn of phrase."""
    if any(c.isdigit() for c in word):
        return "<number>"
    if word in UNITS:
        return "<unit>"
    return "" if word in phrase else "<name>"


def _rolled(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of ``width`` values; the values before a window do not matter."""
    n = len(h) - width + 1
    total = np.zeros(max(0, n), dtype=np.uint64)
    power = np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(width):
            total += h[k : k + n] * power
            power *= np.uint64(_STEP | 1)
    return total


def _hashed(words: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False)


def _portions(d: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """A batch in parts of bounded length, but for single texts that are longer."""
    upto = d["text"].str.len().cumsum() // PORTION
    yield from (part for _, part in d.groupby(upto, sort=False))


def _mixed(template: np.ndarray, filled: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (template ^ (filled >> np.uint64(31))) * np.uint64(_STEP) + filled


def window_reader(phrase: list[str], keep: np.ndarray | None) -> Callable:
    """A function over batches ``id, text`` that yields the windows of ``PASSAGE`` words: ``id, template, filled``.

    ``keep``: bits of the windows to look for, all others are passed over.
    """
    known = frozenset(phrase)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in (part for batch in batches for part in _portions(batch)):
            lists = [words_of(t) for t in d["text"]]
            sizes = np.array([len(x) for x in lists])
            flat = [w for x in lists for w in x]
            if len(flat) < PASSAGE:
                continue
            codes, uniques = pd.factorize(np.array(flat, dtype=object))
            exact = _hashed(list(uniques))
            typed = _hashed([slot_kind(w, known) or w for w in uniques])
            owner = np.repeat(np.arange(len(lists)), sizes)
            template, filled = _rolled(typed[codes], PASSAGE), _rolled(exact[codes], PASSAGE)
            whole = owner[: len(template)] == owner[PASSAGE - 1 :]
            if keep is not None:
                whole &= passes(keep, _mixed(template, filled))
            places = np.flatnonzero(whole)
            yield pd.DataFrame({
                "id": d["id"].to_numpy()[owner[places]], "template": template[places].view(np.int64), "filled": filled[places].view(np.int64),
                "mixed": _mixed(template[places], filled[places]).view(np.int64),
            })

    return run


def slot_reader(phrase: list[str], keep: np.ndarray | None) -> Callable:
    """A function over batches ``id, text`` that yields windows of ``REWRITTEN`` template words and slots: ``id, template, filled, slots``.

    Windows with fewer than ``PHRASED`` template words say nothing and are left out.
    """
    known = frozenset(phrase)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in (part for batch in batches for part in _portions(batch)):
            lists = [words_of(t) for t in d["text"]]
            flat = [w for x in lists for w in x]
            if len(flat) < REWRITTEN:
                continue
            codes, uniques = pd.factorize(np.array(flat, dtype=object))
            kinds = [slot_kind(w, known) for w in uniques]
            # 0: template word, 1: amount, 2: name
            sort_ = np.array([0 if not k else 2 if k == "<name>" else 1 for k in kinds])[codes]
            owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            follows = np.zeros(len(codes), dtype=bool)
            follows[1:] = (sort_[1:] > 0) & (sort_[1:] == sort_[:-1]) & (owner[1:] == owner[:-1])
            start = np.flatnonzero(~follows)
            typed = _hashed([("<amount>" if k != "<name>" else k) if k else w for k, w in zip(kinds, uniques, strict=True)])[codes][start]
            stop = np.append(start[1:], len(codes))
            words = [flat[a] if b == a + 1 else " ".join(flat[a:b]) for a, b in zip(start, stop, strict=True)]
            exact, free, owner = _hashed(words), sort_[start] > 0, owner[start]
            if len(start) < REWRITTEN:
                continue
            template = _rolled(typed, REWRITTEN)
            phrased = np.concatenate([[0], np.cumsum(~free)])
            whole = (owner[: len(template)] == owner[REWRITTEN - 1 :]) & (phrased[REWRITTEN:] - phrased[: len(template)] >= PHRASED)
            if keep is not None:
                whole &= passes(keep, template)
            places = np.flatnonzero(whole)
            yield pd.DataFrame({
                "id": d["id"].to_numpy()[owner[places]], "template": template[places].view(np.int64), "filled": _rolled(exact, REWRITTEN)[places].view(np.int64),
                "slots": pd.Series([[words[j] for j in range(p, p + REWRITTEN) if free[j]] for p in places], dtype=object),
            })

    return run


def phrase_words(items: DataFrame, text: str) -> list[str]:
    """Words without digits that several items share; as many as the evaluation set has, never the corpus."""

    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            yield pd.DataFrame({"w": [w for t in d["text"] for w in set(words_of(t)) if not any(c.isdigit() for c in w)]}, dtype=object)

    some = items.select(F.col(text).alias("text")).where("text is not null")
    least = max(PHRASE_LEAST, math.ceil(PHRASE_SHARE * some.count()))
    rows = some.mapInPandas(distinct, "w string").groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return sorted(r["w"] for r in rows.select("w").collect())


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")


def verbatim_leaks(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``doc_id, item_id``: the document holds 12 or more consecutive words of the item.

    Letter case, signs and blanks do not matter.  Null ids and texts match
    nothing, texts under 12 words neither; repeated rows and passages give one
    row; whole texts are read whatever their length.
    """
    scratch = Scratch(docs.sparkSession, "leaks")
    phrase, schema = phrase_words(items, text), "id long, template long, filled long, mixed long"
    wanted = scratch.write(_texts(items, item_id, text).mapInPandas(window_reader(phrase, None), schema).distinct())
    keep = bit_filter(wanted, "mixed")
    left = _texts(docs, doc_id, text).mapInPandas(window_reader(phrase, keep), schema).select(F.col("id").alias("doc_id"), "template", "filled")
    right = wanted.select(F.col("id").alias("item_id"), "template", "filled")
    return left.join(right, ["template", "filled"]).select("doc_id", "item_id").distinct()


def rewritten_leaks(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``doc_id, item_id, slots, changed``: the document holds the item with other parameters.

    24 or more consecutive template words and slots are the item's, and what
    fills the slots maps one to one onto the item's, some of it onto others.
    An amount is one slot whether it is written "1,5 kg" or "1500g", and so is
    a name of several words; at least 8 of the 24 are template words.  Of
    several such places the one with the fewest changes counts.  Null ids and
    texts, shorter texts and items match nothing.
    """
    scratch = Scratch(docs.sparkSession, "leaks")
    phrase, schema = phrase_words(items, text), "id long, template long, filled long, slots array<string>"
    wanted = scratch.write(_texts(items, item_id, text).mapInPandas(slot_reader(phrase, None), schema).distinct())
    found = _texts(docs, doc_id, text).mapInPandas(slot_reader(phrase, bit_filter(wanted, "template")), schema)
    met = found.withColumnsRenamed({"id": "doc_id", "filled": "doc_filled", "slots": "doc_slots"}).join(
        wanted.withColumnsRenamed({"id": "item_id", "filled": "item_filled", "slots": "item_slots"}), "template"
    )
    pairs = F.arrays_zip("doc_slots", "item_slots")
    distinct = F.size(F.array_distinct(pairs))
    consistent = met.where("doc_filled <> item_filled").where(
        (distinct == F.size(F.array_distinct("doc_slots"))) & (distinct == F.size(F.array_distinct("item_slots")))
    )
    changed = F.size(F.filter(pairs, lambda p: p["doc_slots"] != p["item_slots"]))
    one = F.struct(changed.alias("changed"), F.size("doc_slots").alias("slots"))
    return (
        consistent.groupBy("doc_id", "item_id").agg(F.min(one).alias("m"))
        .select("doc_id", "item_id", "m.slots", "m.changed")
    )
