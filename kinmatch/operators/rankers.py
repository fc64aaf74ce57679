"""Rankings: ``query_id, candidate_id, score, rank``, by hashes, n-grams and vectors.

A search takes a stated set of queries against all rows, in a grid: queries are
hashed into blocks and the corpus into chunks of bounded rows, each cell of
block and chunk is scored in one vectorised step, and only the best ``k`` per
query of a cell are shuffled.  Nothing passes through the driver.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.functions.numbers import unit_vector

#: Queries of a block and rows of a chunk.
BLOCK_QUERIES, CHUNK_ROWS = 8_192, 8_192
#: Titles of a chunk, which are weighed ``CHUNK_ROWS`` at once.
TITLE_ROWS = 262_144
#: Units of a score of nine places.
SCORE_UNITS = 1_000_000_000
#: Scores that a worker holds at once.
HELD_SCORES = 1_000_000
#: Rows below which a chunk is not worth a task.
LEAST_ROWS = 256
#: Share of a chunk's titles from which a gram is scored as a dense column.
DENSE_SHARE = 0.02


def best_first(by: list[str] | None = None) -> Window:
    return Window.partitionBy(*(by or ["query_id"])).orderBy(F.desc("score"), F.asc("candidate_id"))


def top_k(scored: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """Best ``k`` candidates per query, ties to the smaller id, with unique ranks from 1."""
    return scored.withColumn("rank", F.row_number().over(best_first(by))).where(F.col("rank") <= k)


def vectors(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """``id, v`` at unit length; rows with null, empty, zero or non-finite vectors are left out."""
    return df.select(F.col(id_col).alias("id"), unit_vector(vector).alias("v")).where("id is not null and v is not null")


def best_of(scores: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and score of the best ``k`` of each line, ties to the smaller of ``rows``; -inf is no candidate."""
    n, m = scores.shape
    least = np.partition(scores, m - k, axis=1)[:, m - k] if m > k else np.full(n, -np.inf)
    q, c = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
    s = scores[q, c]
    order = np.lexsort((rows[c], -s, q))
    q, c, s = q[order], c[order], s[order]
    start = np.searchsorted(q, np.arange(n))
    kept = np.arange(len(q)) - start[q] < k
    return q[kept], c[kept], s[kept]


def _cell(prepare: Callable, k: int):
    """Best ``k`` of each query of a block in a chunk; ``prepare`` gives a function from a slice of queries to its scores."""

    def run(block: pa.Table, chunk: pa.Table) -> pa.Table:
        q, c = block.column("id").combine_chunks(), chunk.column("id").combine_chunks()
        found = []
        if len(q) and len(c):
            rank = np.empty(len(c), dtype=np.int64)
            rank[pc.sort_indices(c).to_numpy()] = np.arange(len(c))
            score = prepare(block, chunk)
            own = pc.index_in(q, c)  # a query is no candidate of its own
            width = max(1, HELD_SCORES // len(c))
            for at in range(0, len(q), width):
                s = score(at, min(len(q), at + width))
                mine = own[at : at + width]
                there = np.flatnonzero(mine.is_valid().to_numpy(zero_copy_only=False))
                s[there, mine.drop_null().to_numpy()] = -np.inf
                i, j, v = best_of(s, rank, k)
                found.append((i + at, j, v))
        i, j, v = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, dtype=np.int64),) * 2 + (np.empty(0),)
        return pa.table({"query_id": q.take(pa.array(i)), "candidate_id": c.take(pa.array(j)), "score": v})

    return run


def grid_cells(left: DataFrame, right: DataFrame, run: Callable, schema: str, *, block_queries: int | None = None, chunk_rows: int | None = None) -> DataFrame:
    """``run(block, chunk)`` over every cell of a grid of blocks of ``left`` and chunks of ``right``, both with an ``id`` that is unique.

    Cells are spread over all cores, since the work per row is large.
    """
    spark = right.sparkSession
    n, m = left.count(), right.count()
    cores = spark.sparkContext.defaultParallelism
    blocks = max(1, -(-n // (block_queries or BLOCK_QUERIES)))
    chunks = max(1, -(-m // (chunk_rows or CHUNK_ROWS)), min(-(-2 * cores // blocks), m // LEAST_ROWS))
    number = lambda of: F.pmod(F.xxhash64("id"), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    spread = lambda df: df.repartition(min(blocks * chunks, 20_000), "block", "chunk").groupBy("block", "chunk")
    left = left.select(*[F.col(c).alias(c) for c in left.columns])  # other columns than those of the table it may be a part of
    one = spread(left.select("*", number(blocks).alias("block"), every(chunks).alias("chunk")))
    two = spread(right.select("*", number(chunks).alias("chunk"), every(blocks).alias("block")))
    return one.cogroup(two).applyInArrow(run, schema)


def in_grid(queries: DataFrame, corpus: DataFrame, k: int, prepare: Callable, **grid: int) -> DataFrame:
    """Exact search of a stated query set against all rows of a corpus."""
    kind = corpus.schema["id"].dataType.simpleString()
    return top_k(grid_cells(queries, corpus, _cell(prepare, k), f"query_id {kind}, candidate_id {kind}, score double", **grid), k)


def _matrix(t: pa.Table) -> np.ndarray:
    return t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)


def _cosines(block: pa.Table, chunk: pa.Table) -> Callable:
    q, c = _matrix(block), _matrix(chunk).T
    return lambda a, b: q[a:b] @ c


def _hash_shares(block: pa.Table, chunk: pa.Table) -> Callable:
    q, c = (t.column("bits").to_numpy().view(np.uint64) for t in (block, chunk))
    return lambda a, b: 1 - np.bitwise_count(q[a:b, None] ^ c[None, :]) / 64


def _sparse_dots(block: pa.Table, chunk: pa.Table) -> Callable:
    """Dot products over shared features, -inf without one: frequent features as dense columns, the others by postings."""

    def taken(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        f = t.column("f").combine_chunks()
        return np.diff(f.offsets.to_numpy()), f.flatten().to_numpy().astype(np.int64), t.column("w").combine_chunks().flatten().to_numpy()

    (qn, qf, qw), (cn, cf, cw) = taken(block), taken(chunk)
    m = len(cn)
    crow = np.repeat(np.arange(m), cn)
    names, inverse, counts = np.unique(cf, return_inverse=True, return_counts=True)
    many = np.flatnonzero(counts >= max(8, DENSE_SHARE * m))
    column = np.full(len(names), -1)
    column[many] = np.arange(len(many))
    dense = column[inverse] >= 0
    c_dense = np.zeros((len(many), m))
    c_dense[column[inverse[dense]], crow[dense]] = cw[dense]
    order = np.argsort(inverse[~dense], kind="stable")
    feature, row, weight = inverse[~dense][order], crow[~dense][order], cw[~dense][order]
    first = np.searchsorted(feature, np.arange(len(names) + 1))
    place = np.minimum(np.searchsorted(names, qf), max(0, len(names) - 1))
    known = names[place] == qf if len(names) else np.zeros(len(qf), dtype=bool)
    offset = np.concatenate([[0], np.cumsum(qn)])

    def score(a: int, b: int) -> np.ndarray:
        part = slice(offset[a], offset[b])
        line, f, w, ok = np.repeat(np.arange(b - a), qn[a:b]), place[part], qw[part], known[part]
        q_dense = np.zeros((b - a, len(many)))
        d = ok & (column[f] >= 0)
        q_dense[line[d], column[f[d]]] = w[d]
        out = q_dense @ c_dense  # all weights are positive, so a shared feature shows
        rest = np.flatnonzero(ok & (column[f] < 0))
        size = first[f[rest] + 1] - first[f[rest]]
        for some in np.array_split(rest, max(1, int(size.sum()) // HELD_SCORES)):
            n = first[f[some] + 1] - first[f[some]]
            at = np.repeat(first[f[some]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            flat = np.repeat(line[some], n) * m + row[at]
            out += np.bincount(flat, weights=weight[at] * np.repeat(w[some], n), minlength=(b - a) * m).reshape(b - a, m)
        return np.where(out > 0, np.round(out, 9), -np.inf)

    return score


def exact_cosine(queries: DataFrame, corpus: DataFrame, k: int, **grid: int) -> DataFrame:
    """Exact best ``k`` of ``corpus`` for each row of ``queries`` (both ``id, v`` at unit length), never the row itself."""
    return in_grid(queries.select("id", "v"), corpus.select("id", "v"), k, _cosines, **grid)


def phash_ranking(queries: DataFrame, corpus: DataFrame, k: int, **grid: int) -> DataFrame:
    """Best ``k`` by ``1 - distance / 64`` for ``id, bits``."""
    return in_grid(queries.select("id", "bits"), corpus.select("id", "bits"), k, _hash_shares, **grid)


def gram_reader(low: int, high: int) -> Callable[[str], Counter]:
    """Counts of the character n-grams within the words of a text; as ``word_ngrams``, but each word is cut once."""

    @lru_cache(maxsize=100_000)
    def of_word(w: str) -> tuple[str, ...]:
        p = f" {w} "
        return tuple(p[i : i + n] for n in range(low, high + 1) for i in range(len(p) - n + 1))

    def read(text: str) -> Counter:
        found: Counter[str] = Counter()
        for w in text.split(" "):
            if w:
                found.update(of_word(w))
        return found

    return read


def fit_vocabulary(titles: DataFrame, low: int, high: int, most: int) -> DataFrame:
    """``gram, df, feature_id, idf`` of the most frequent n-grams (ties in order of the gram).

    ``titles``: ``id, norm``.  ``most`` bounds the vocabulary; the weights are
    counted over all titles: ``idf = ln((1 + N) / (1 + df)) + 1``.
    """

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = gram_reader(low, high)
        for d in batches:
            total: Counter[str] = Counter()
            for t in d["norm"]:
                total.update(read(t).keys())
            yield pd.DataFrame({"gram": list(total), "df": list(total.values())}).astype({"gram": "object", "df": "int64"})

    n = titles.agg(F.count("*").alias("n_titles"))
    grams = titles.select("norm").mapInPandas(counts, "gram string, df long")
    kept = grams.groupBy("gram").agg(F.sum("df").alias("df")).orderBy(F.desc("df"), "gram").limit(most)
    numbered = kept.withColumn("feature_id", F.row_number().over(Window.orderBy("gram")) - 1)  # at most ``most`` rows
    return numbered.crossJoin(F.broadcast(n)).select("gram", "df", "feature_id", (F.log((1 + F.col("n_titles")) / (1 + F.col("df"))) + 1).alias("idf"))


def _held(vocabulary: DataFrame) -> dict[str, tuple[int, float]]:
    return {r["gram"]: (r["feature_id"], r["idf"]) for r in vocabulary.select("gram", "feature_id", "idf").collect()}


def _weighted(grams: Counter, held: dict[str, tuple[int, float]]) -> tuple[np.ndarray, np.ndarray] | None:
    """Features in order and their weights at unit length; none without a known gram."""
    got = sorted((held[g][0], (1 + math.log(n)) * held[g][1]) for g, n in grams.items() if g in held)
    if not got:
        return None
    f, w = zip(*got, strict=True)
    w = np.array(w)
    return np.array(f, dtype=np.int32), w / math.sqrt(float(w @ w))


def sparse_titles(titles: DataFrame, vocabulary: DataFrame, low: int, high: int) -> DataFrame:
    """``id, f, w``: features in order and weights ``(1 + ln tf) * idf`` at unit length, for titles with any feature.

    The vocabulary has as many rows as its parameter ``most`` allows, so
    workers hold it and no gram is shuffled.
    """
    held = _held(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = gram_reader(low, high)
        for d in batches:
            rows = [(i, *v) for i, t in zip(d["id"], d["norm"], strict=True) if (v := _weighted(read(t), held))]
            yield pd.DataFrame(rows, columns=["id", "f", "w"])

    return titles.select("id", "norm").mapInPandas(run, f"id {titles.schema['id'].dataType.simpleString()}, f array<int>, w array<double>")


def tfidf_vectors(titles: DataFrame, vocabulary: DataFrame, low: int, high: int) -> DataFrame:
    """``id, feature_id, weight`` of ``sparse_titles``, one row for each feature."""
    z = F.explode(F.arrays_zip("f", "w"))
    return sparse_titles(titles, vocabulary, low, high).select("id", z.alias("z")).select("id", F.col("z.f").alias("feature_id"), F.col("z.w").alias("weight"))


def tfidf_ranking(queries: DataFrame, rows: DataFrame, k: int, **grid: int) -> DataFrame:
    """Best ``k`` by sparse dot product of ``id, f, w``; only pairs that share a gram are candidates.

    Scores are rounded to nine places, so that the order of summing cannot
    decide between equal ones.
    """
    return in_grid(queries.select("id", "f", "w"), rows.select("id", "f", "w"), k, _sparse_dots, **grid)


def _title_cell(held: dict[str, tuple[int, float]], low: int, high: int, k: int, rows: int):
    """Best ``k`` of each query of a block in a chunk of titles, one row for each query; ``rows`` of the chunk are weighed at once.

    Scores of nine places travel as whole numbers.
    """

    def run(block: pa.Table, chunk: pa.Table) -> pa.Table:
        read = gram_reader(low, high)

        def weighed(t: pa.Table) -> tuple[np.ndarray, pa.Table]:
            every = [_weighted(read(x), held) for x in t.column("norm").to_pylist()]
            some = np.array([i for i, v in enumerate(every) if v], dtype=np.int64)
            arrays = [pa.array([every[i][c] for i in some], pa.list_(kind)) for c, kind in ((0, pa.int32()), (1, pa.float64()))]
            return some, pa.table(arrays, ["f", "w"])

        q, c = block.column("id").combine_chunks(), chunk.column("id").combine_chunks()
        asked, queries = weighed(block)
        rank = np.empty(len(c), dtype=np.int64)
        order = pc.sort_indices(c).to_numpy()
        rank[order] = np.arange(len(c))
        own = pc.fill_null(pc.index_in(q, c), -1).to_numpy() if len(c) else np.full(len(q), -1)  # a query is no candidate of its own
        line, place, best = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
        for start in range(0, len(c) if len(asked) else 0, rows):
            there, part = weighed(chunk.slice(start, rows))
            if not len(there):
                continue
            ranks, score = rank[there + start], _sparse_dots(queries, part)
            least = np.full(len(asked), -np.inf)  # what a query holds already
            full = np.bincount(line, minlength=len(asked)) >= k
            held_least = np.full(len(asked), np.inf)
            np.minimum.at(held_least, line, best)
            least[full] = held_least[full]
            at_own = np.full(len(c) + 1, -1)
            at_own[there + start] = np.arange(len(there))
            found = [(line, place, best)]
            width = max(1, HELD_SCORES // len(there))
            for a in range(0, len(asked), width):
                s = score(a, min(len(asked), a + width))
                mine = at_own[own[asked[a : a + width]]]
                s[np.flatnonzero(mine >= 0), mine[mine >= 0]] = -np.inf
                s[s < least[a : a + width, None]] = -np.inf
                i, j, v = best_of(s, ranks, k)
                found.append((i + a, ranks[j], v))
            line, place, best = (np.concatenate(x) for x in zip(*found, strict=True))
            by = np.lexsort((place, -best, line))
            line, place, best = line[by], place[by], best[by]
            kept = np.arange(len(line)) - np.searchsorted(line, line) < k
            line, place, best = line[kept], place[kept], best[kept]
        lines = np.unique(line)
        offsets = pa.array(np.append(np.searchsorted(line, lines), len(line)).astype(np.int32), pa.int32())
        marks = pa.array(np.rint(best * SCORE_UNITS).astype(np.int32))
        return pa.table({"query_id": q.take(pa.array(asked[lines])), "candidates": pa.ListArray.from_arrays(offsets, c.take(pa.array(order[place]))), "marks": pa.ListArray.from_arrays(offsets, marks)})

    return run


def title_ranking(queries: DataFrame, rows: DataFrame, vocabulary: DataFrame, low: int, high: int, k: int, *, held_rows: int = CHUNK_ROWS, **grid: int) -> DataFrame:
    """As ``tfidf_ranking`` of ``sparse_titles``, from the titles ``id, norm`` themselves.

    A title is a small part of its vector, so titles travel to the cells and are
    weighed there.  A chunk is large, since each one keeps ``k`` candidates per
    query: what is shuffled is a row for each query and chunk.
    """
    kind = rows.schema["id"].dataType.simpleString()
    cell = _title_cell(_held(vocabulary), low, high, k, held_rows)
    shape = f"query_id {kind}, candidates array<{kind}>, marks array<int>"
    found = grid_cells(queries.select("id", "norm"), rows.select("id", "norm"), cell, shape, **{"chunk_rows": TITLE_ROWS} | grid)
    # candidates meet before they become rows
    z = F.explode(F.arrays_zip("candidates", "marks"))
    each = found.repartition("query_id").select("query_id", z.alias("z")).select("query_id", F.col("z.candidates").alias("candidate_id"), (F.col("z.marks") / F.lit(float(SCORE_UNITS))).alias("score"))
    return top_k(each, k)


def padded(ranking: DataFrame, queries: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """Fill short lists with zero scores in order of the id, up to ``k``.

    ``ids`` needs only its ``2 k + 1`` smallest members: no list can use more.
    """
    pool = ids.select(F.col("id").alias("candidate_id")).orderBy("candidate_id").limit(2 * k + 1)
    counts = queries.select(F.col("id").alias("query_id")).join(ranking.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left")
    short = counts.where(F.coalesce("n", F.lit(0)) < k).select("query_id")
    fill = short.crossJoin(F.broadcast(pool)).where("query_id <> candidate_id")
    fill = fill.join(ranking.select("query_id", "candidate_id"), ["query_id", "candidate_id"], "left_anti").withColumn("score", F.lit(0.0))
    return top_k(ranking.select("query_id", "candidate_id", "score").unionByName(fill), k)


def candidate_union(rankings: list[DataFrame], k: int) -> DataFrame:
    """``query_id, candidate_id, score`` (0) of all candidates in the first ``k`` of any ranking."""
    out = None
    for r in rankings:
        part = r.where(F.col("rank") <= k).select("query_id", "candidate_id")
        out = part if out is None else out.unionByName(part)
    return out.distinct().withColumn("score", F.lit(0.0))


def fuse_rankings(visual: DataFrame, text: DataFrame, weight: float, k: int) -> DataFrame:
    """Late fusion: ``w * visual + (1 - w) * text`` over the lists of both, 0 where a list lacks the pair."""
    v = visual.select("query_id", "candidate_id", F.col("score").alias("vs"))
    t = text.select("query_id", "candidate_id", F.col("score").alias("ts"))
    both = v.join(t, ["query_id", "candidate_id"], "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return top_k(both.select("query_id", "candidate_id", (weight * zero("vs") + (1 - weight) * zero("ts")).alias("score")), k)


def modality_fusion(queries: DataFrame, corpus: DataFrame, weight: float, k: int) -> DataFrame:
    """Whole-corpus fusion of two cosines for ``id, image, text`` vectors at unit length.

    ``w * a.b + (1 - w) * c.d`` is the dot product of the joined vectors scaled
    by the roots of the weights, so one exact search does it.
    """
    scale = lambda df: df.select("id", F.concat(
        F.transform("image", lambda x: x * F.lit(weight**0.5)), F.transform("text", lambda x: x * F.lit((1 - weight) ** 0.5))
    ).alias("v"))
    return exact_cosine(scale(queries), scale(corpus), k)


def reranked(ranking: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """Order fixed candidates anew by ``scores`` (``query_id, candidate_id, score``)."""
    return top_k(ranking.select("query_id", "candidate_id").join(scores, ["query_id", "candidate_id"]), k)


def invalid_rows(ranking: DataFrame) -> DataFrame:
    """Rows of a ranking that break its order, name the query itself or repeat a candidate."""
    w = Window.partitionBy("query_id").orderBy("rank")
    prior = ranking.select(
        "*", F.lag("score").over(w).alias("_s"), F.lag("candidate_id").over(w).alias("_c"),
        F.count("*").over(Window.partitionBy("query_id", "candidate_id")).alias("_n"),
    )
    wrong = (F.col("score") > F.col("_s")) | ((F.col("score") == F.col("_s")) & (F.col("candidate_id") <= F.col("_c")))
    return prior.where(F.coalesce(wrong, F.lit(False)) | (F.col("query_id") == F.col("candidate_id")) | (F.col("_n") > 1)).drop("_s", "_c", "_n")


def ranking_json(ranking: DataFrame) -> DataFrame:
    """One JSON list of candidates per query, in order; a list has at most ``k`` entries."""
    one = F.struct("rank", F.col("candidate_id").alias("posting_id"), "score")
    lists = ranking.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("c"))
    return lists.select("query_id", F.to_json(F.transform("c", lambda x: F.struct(x["posting_id"].alias("posting_id"), x["score"].alias("score")))).alias("candidates"))


def score_of(column: str) -> Column:
    return F.col(column).cast("double").alias("score")
