"""Texts that lost their end, found by length spikes and by how sentences go on.

A limit shows as a spike at the top of a source's length histogram, in
characters or in bytes; a text at a spike without a final sign was cut.  A
transfer that broke off leaves no spike.  There the last words tell: it is
counted over the whole corpus how often the runs of words that stand at an open
end elsewhere end a sentence or a text, and how often more follows.  Only runs
that some open end asks for are counted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmatch.llm.bit_filter import bit_filter, passes
from kinmatch.runtime import Scratch

#: A spike holds at least so many texts and so many times the mean of the lengths around it.
SPIKE_LEAST, SPIKE_TIMES, SPIKE_AROUND = 5, 6.0, 20
#: Byte limits may leave out the last character, which has up to four bytes.
CHARACTER_BYTES = 4
#: Share of ends below which more is missing, and occurrences that make a run of words worth asking.
END_SHARE, SUPPORT = 0.5, 3
#: The same for a number and its point, which may also be a closed sentence.
CLOSED_SHARE = 0.1
#: Longest run of words that is asked for.
ORDER = 5
#: Characters of the texts that a task takes apart at once.
PORTION = 4_000_000

_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+(?:['’][^\W\d_]+)*|&[a-z]*;?|</?[a-z]*>?|[#:]|[.!?…]+|\n")
_BLANK = " \t\n\r\f "
# Java patterns over the tail of a text
_ELLIPSIS = r"(?:…|\.{2,}|\[(?:…|\.{2,})\])\s*$"
_FINAL = r"[.!?\])\"'”’»}>\p{So}\p{Sk}\p{Mn}\p{Cf}]$"
#: A number may have been cut at its decimal sign.
_DECIMAL = r"(?<![-\d])\d+[.]$"
#: An entity, a tag or a character that was cut in its middle.
_BROKEN = r"(?:&[a-z]{0,7}|</?[a-z][^<>]{0,200}|<|\x{FFFD})$"
#: Longest end that those patterns look at.
_TAIL = 256

_STEP = np.uint64(0x9E3779B97F4A7C15)


def trimmed(text: Column) -> Column:
    """The text without blanks at its end."""
    return F.rtrim(text, F.lit(_BLANK))


def bare_end(text: Column) -> Column:
    """The text without blanks and without an ellipsis at its end."""
    t = trimmed(text)
    return F.when(F.right(t, F.lit(8)).rlike(_ELLIPSIS), trimmed(F.regexp_replace(t, _ELLIPSIS, ""))).otherwise(t)


def ends_open(text: Column) -> Column:
    """Whether no final sign, bracket or picture closes the text; an ellipsis closes nothing, nor does a number's point."""
    end = F.right(trimmed(text), F.lit(_TAIL))
    return (end != "") & (end.rlike(_ELLIPSIS) | end.rlike(_DECIMAL) | end.endswith("�") | ~end.rlike(_FINAL))


def _portions(d: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """A batch in parts of bounded length, but for single texts that are longer."""
    upto = d["text"].str.len().cumsum() // PORTION
    yield from (part for _, part in d.groupby(upto, sort=False))


def _shape(token: str) -> str:
    if token[0].isdigit():
        return "0" * min(len(token), 3) if token.isdigit() else "0.0"
    return token.lower()


def word_runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Places of the last word of each text (-1: none), which words end a sentence, and the runs that end at each word.

    A run is a pair of arrays over all places: its hash, and whether it is
    there.  The longest come first, each as it is and then loosened, with
    every capitalised word inside a sentence as a name and every number but a
    last one as any number; else numbers are shapes of their length.  A run may
    take in the start of its sentence, not more.
    """
    lists = [_TOKEN.findall(t) for t in texts]
    flat = ["\n"]
    last = np.empty(len(lists), dtype=np.int64)
    for i, x in enumerate(lists):
        flat += x
        last[i] = len(flat) - 1
        flat.append("\n")
    codes, uniques = pd.factorize(np.array(flat, dtype=object))
    stop = np.array([u[0] in "\n.!?…" for u in uniques])[codes]
    shape = pd.util.hash_array(np.array(["^" if u[0] in "\n.!?…" else _shape(u) for u in uniques], dtype=object), categorize=False)[codes]
    capital = np.array([u[0].isupper() for u in uniques])[codes]
    inside = np.zeros(len(codes), dtype=bool)
    inside[1:] = ~stop[:-1]
    number = np.array([u[0].isdigit() for u in uniques])[codes]
    any_name, any_number = pd.util.hash_array(np.array(["<Name>", "<Number>"], dtype=object), categorize=False)
    loose = np.where(capital & inside, any_name, shape)
    before = np.where(number, any_number, loose)
    at = np.arange(len(codes))
    since = at - np.maximum.accumulate(np.where(stop, at, 0))
    ends = np.zeros(len(codes), dtype=bool)
    ends[:-1] = stop[1:]
    runs: list[tuple[np.ndarray, np.ndarray]] = []
    with np.errstate(over="ignore"):
        exact_run, loose_run, power = shape.copy(), loose.copy(), np.uint64(1)
        for n in range(2, ORDER + 1):
            power *= _STEP
            exact_run[n - 1 :] += shape[: len(shape) - n + 1] * power
            loose_run[n - 1 :] += before[: len(before) - n + 1] * power
            there = since >= n - 1
            mix = lambda h, kind: (h + np.uint64(2 * n + kind)) * _STEP ^ (h >> np.uint64(29))  # noqa: B023, E731
            runs.append((mix(loose_run, 1), there if n > 2 else since == 1))
            runs.append((mix(exact_run, 0), there))
    # a text that ends with stops has its last word before them
    for i in np.flatnonzero(stop[last]):
        j = last[i]
        while j > 0 and stop[j] and flat[j] != "\n":
            j -= 1
        last[i] = -1 if stop[j] else j
    return last, ends & ~stop, runs[::-1]


def _asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``row, keys``: the runs at the end of each text, the longest first."""
    for d in (part for batch in batches for part in _portions(batch)):
        last, _, runs = word_runs(list(d["text"]))
        hashes = np.stack([h[last] for h, _ in runs], axis=1).view(np.int64)
        there = np.stack([t[last] & (last >= 0) for _, t in runs], axis=1)
        yield pd.DataFrame({"row": d["row"].to_numpy(), "keys": [h[t].tolist() for h, t in zip(hashes, there, strict=True)]})


def _counted(held: np.ndarray):
    """``key, total, ends`` of the runs that may have been asked for; the end of a text that a limit cut ends nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in (part for batch in batches for part in _portions(batch)):
            last, ends, runs = word_runs(list(d["text"]))
            whole = np.ones(len(ends), dtype=bool)
            whole[last[d["cut"].to_numpy(dtype=bool)]] = False
            keys, closing = [], []
            for h, there in runs:
                places = np.flatnonzero(there & whole)
                places = places[passes(held, h[places])]
                keys.append(h[places])
                closing.append(ends[places])
            one, back = np.unique(np.concatenate(keys), return_inverse=True)
            yield pd.DataFrame({"key": one.view(np.int64), "total": np.bincount(back, minlength=len(one)), "ends": np.bincount(back, weights=np.concatenate(closing), minlength=len(one)).astype(np.int64)})

    return run


def length_spikes(lengths: DataFrame) -> DataFrame:
    """``source, unit, length, n, texts`` of the lengths at which a source cuts its texts.

    ``lengths``: ``source, unit, length``.  A length is a spike if it holds far
    more texts than the lengths around it; only the upper half of a source's
    range counts, since a limit is where lengths end.
    """
    hist = lengths.groupBy("source", "unit", "length").agg(F.count("*").alias("n"))
    top = hist.groupBy("source", "unit").agg(F.max("length").alias("top"), F.sum("n").alias("texts"))
    # a histogram has one row for each length, not for each text
    near = hist.select("source", "unit", F.col("n").alias("m"), F.explode(F.sequence(F.col("length") - SPIKE_AROUND, F.col("length") + SPIKE_AROUND)).alias("length"))
    around = near.groupBy("source", "unit", "length").agg(F.sum("m").alias("around"))
    return (
        hist.join(around, ["source", "unit", "length"]).join(top, ["source", "unit"])
        .where(F.col("n") >= SPIKE_LEAST)
        .where(F.col("n") >= SPIKE_TIMES * (F.col("around") - F.col("n")) / (2 * SPIKE_AROUND))
        .where(F.col("length") * 2 >= F.col("top"))
        .select("source", "unit", "length", "n", "texts")
    )


def text_lengths(texts: DataFrame, *, once: bool = False) -> DataFrame:
    """``source, unit, length`` of ``source, text``, in characters and in bytes; ``once``: of each different text of a source."""
    units = F.array(
        F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")),
        F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length")),
    )
    sized = texts.select("source", F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), *([F.xxhash64("text").alias("h")] if once else []))
    return (sized.distinct() if once else sized).select("source", F.explode(units).alias("u")).select("source", "u.unit", "u.length")


def truncated_texts(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``id, source, spike, end_share`` of the texts that stop inside a word or sentence.

    ``spike``: the text has a length at which its source cuts, and no final
    sign.  ``end_share``: how often the last words end a sentence elsewhere
    (null: not asked or never seen).  Null and blank texts have lost nothing;
    rows with a null id are left out; texts of a null source form a source of
    their own; repeated rows are judged alike and come as often as they are
    there, but a text counts once where lengths and ends of words are counted,
    as its copies say nothing new; whole texts are read whatever their length.
    """
    scratch = Scratch(df.sparkSession, "ends")
    texts = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.coalesce(F.col(source), F.lit("\x1f")).alias("source")).where(
        "text is not null and id is not null"
    )
    spikes = scratch.write(length_spikes(text_lengths(texts, once=True)))
    # a byte limit may fall inside a character, which is then left out
    room = F.when(F.col("unit") == "bytes", F.sequence(F.col("length") - (CHARACTER_BYTES - 1), F.col("length"))).otherwise(F.array("length"))
    limits = spikes.select("source", "unit", F.explode(room).alias("length")).distinct()
    limit = lambda unit, name: limits.where(F.col("unit") == unit).select("source", F.col("length").alias(name), F.lit(True).alias(f"at_{name}"))
    tail = F.right("text", F.lit(_TAIL))
    sized = (
        texts.select("*", F.length("text").alias("chars"), F.octet_length("text").alias("bytes"))
        .join(limit("chars", "chars"), ["source", "chars"], "left").join(limit("bytes", "bytes"), ["source", "bytes"], "left")
        .select("id", "source", "text", ends_open(F.col("text")).alias("open"), (F.coalesce("at_chars", F.lit(False)) | F.coalesce("at_bytes", F.lit(False))).alias("spike"))
    )
    open_ = (
        sized.where("open").select("id", "source", F.xxhash64("id", "source", "text").alias("row"), "spike", bare_end(F.col("text")).alias("text"))
        .select("id", "source", "row", "spike", tail.rlike(_BROKEN).alias("broken"), tail.rlike(_DECIMAL).alias("decimal"), tail.rlike(_FINAL).alias("closed"), "text")
    )
    open_ = scratch.write(open_)
    asked = scratch.write(
        open_.where("not spike and not broken and (decimal or not closed)").select("row", "text").mapInPandas(_asked, "row long, keys array<long>").dropDuplicates(["row"])
    )
    held = bit_filter(asked.select(F.explode("keys").alias("key")), "key")
    once = sized.groupBy("text").agg(F.max(F.col("open") & F.col("spike")).alias("cut"))
    counts = once.mapInPandas(_counted(held), "key long, total long, ends long").groupBy("key").agg(F.sum("total").alias("total"), F.sum("ends").alias("ends"))
    met = asked.select("row", F.posexplode("keys").alias("turn", "key")).join(counts, "key").where(F.col("total") > SUPPORT)  # its own occurrence is one of them
    best = met.groupBy("row").agg(F.min_by(F.struct("total", "ends"), "turn").alias("c")).select("row", ((F.col("c.ends") - 1) / (F.col("c.total") - 1)).alias("end_share"))
    judged = open_.drop("text").join(asked.select("row", F.size("keys").alias("n_keys")), "row", "left").join(best, "row", "left")
    cut = (
        F.col("spike") & (~F.col("closed") | F.col("decimal")) | F.col("broken")
        | (~F.col("closed") & (F.col("n_keys") > 0) & (F.coalesce("end_share", F.lit(0.0)) < END_SHARE))
        | (F.col("closed") & F.col("decimal") & (F.col("end_share") < CLOSED_SHARE))
    )
    return judged.where(cut).select("id", F.when(F.col("source") != "\x1f", F.col("source")).alias("source"), "spike", "end_share")


def source_rates(df: DataFrame, found: DataFrame, id_col: str = "doc_id", source: str = "source") -> DataFrame:
    """``source, texts, truncated, rate`` of every source, also of those that cut nothing."""
    all_ = df.where(F.col("text").isNotNull()).groupBy(F.col(source).alias("source")).agg(F.count("*").alias("texts"))
    cut = found.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("truncated"))
    return all_.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").select(
        "source", "texts", F.coalesce("truncated", F.lit(0)).alias("truncated"),
        F.round(F.coalesce("truncated", F.lit(0)) / F.col("texts"), 6).alias("rate"),
    )
