"""Listings of one product, by multi-pass sorted neighbourhood and correlation clustering.

Titles are read into fields once per distinct title; listings with the same
fields are one signature, so a product listed a million times is one row from
there on.  Several orders of the name's words give several sorted sequences;
in each a window slides over neighbours, which are compared by soft alignment
of their words.  The links found are clustered around pivots.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.llm.title_fields import fields
from kinmatch.runtime import Scratch

WINDOW = 12
BUCKET_ROWS = 4_000
#: Shortest names that may differ by one and by two edits.
ONE_TYPO, TWO_TYPOS = 6, 8
#: Links that one task clusters, by the same rounds; with more the rounds are joins.
FINISH_LINKS = 1_000_000
#: Postings of a group that one part pairs with all others.
PART_ROWS = 5_000
ATTRIBUTES = ("kind", "amount", "variant", "pieces")


def typing_distance(a: str, b: str, most: int) -> int:
    """Edits between two words (a swap of neighbours is one edit), or ``most + 1`` if more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
    return row[-1]


def _alike(a: str, b: str) -> bool:
    shorter = min(len(a), len(b))
    most = (shorter >= ONE_TYPO) + (shorter >= TWO_TYPOS)
    return a == b or most > 0 and typing_distance(a, b, most) <= most


@lru_cache(maxsize=500_000)
def same_name(a: str, b: str) -> bool:
    """Soft alignment of two names: words may be split, misspelt or, on one side, missing.

    The names agree when their letters do, when all of one is a run of words
    of the other, which then also states the brand, or when two words or more
    are all found in the other in any order.
    """
    x, y = a.split(), b.split()
    if not x or not y:
        return False
    whole_x, whole_y = "".join(x), "".join(y)
    if _alike(whole_x, whole_y):
        # the same brand before two different short lines would pass as two typos
        return _alike(x[-1], y[-1]) or len(x) != len(y) or typing_distance(whole_x, whole_y, 1) <= 1
    for whole, words in ((whole_x, y), (whole_y, x)):
        for i in range(len(words)):
            for j in range(i + 1, len(words) + 1):
                if (i, j) != (0, len(words)) and _alike(whole, "".join(words[i:j])):
                    return True
    few, many = sorted((x, y), key=len)
    if len(few) < 2:
        return False
    left = list(many)
    for w in few:
        met = next((v for v in left if _alike(w, v)), None)
        if met is None:
            return False
        left.remove(met)
    return True


FIELDS = "kind string, amount string, variant string, pieces int, code string, name string"


def _title_fields(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for titles in batches:
        yield pd.DataFrame([fields(t) for t in titles], columns=["kind", "amount", "variant", "pieces", "code", "name"])


def letter_bits(name: str) -> int:
    """The letters of a name as bits; several letters may share one."""
    bits = 0
    for c in set(name) - {" "}:
        bits |= 1 << (ord(c) & 31)
    return bits


def _compare(window: int):
    def run(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("place")
        group, code = pd.factorize(d["grp"])[0], pd.factorize(d["code"].replace("", None))[0]
        names, uniques = pd.factorize(d["name"])
        bits = np.array([letter_bits(n) for n in uniques], dtype=np.uint32)[names]
        name, sid = d["name"].to_numpy(), d["sid"].to_numpy()
        left, right = [], []
        for k in range(1, window):
            near = (group[:-k] == group[k:]) & (sid[:-k] != sid[k:])
            near &= (code[:-k] == code[k:]) | (code[:-k] < 0) | (code[k:] < 0)
            # an edit brings in one letter at most, and one name is a run of the other but for the edits
            strange = np.minimum(np.bitwise_count(bits[:-k] & ~bits[k:]), np.bitwise_count(bits[k:] & ~bits[:-k]))
            for i in np.flatnonzero(near & (strange <= 2)):
                if same_name(*sorted((name[i], name[i + k]))):
                    left.append(min(sid[i], sid[i + k]))
                    right.append(max(sid[i], sid[i + k]))
        return pd.DataFrame({"a": left, "b": right}, dtype="object").astype({"a": "int64", "b": "int64"}).drop_duplicates()

    return run


def neighbour_links(nodes: DataFrame, scratch: Scratch, *, window: int = WINDOW, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links ``a, b`` of signatures that meet in a window of one of the sorted sequences.

    The sequences of all passes form one range-partitioned sort.  It is cut
    into buckets of equal length that share ``window - 1`` rows with the next,
    so no neighbour is missed at a cut and no bucket grows with a hot key.
    """
    words = F.split("name", " ")
    joined = F.array_join(words, "")
    keys = F.array(
        F.concat_ws("\x1f", F.lit("1"), "grp", F.array_join(F.array_sort(words), "")),  # in order of the words
        F.concat_ws("\x1f", F.lit("2"), "grp", F.element_at(words, -1), joined),  # line before brand
        F.concat_ws("\x1f", F.lit("3"), "grp", F.reverse(joined)),  # from the end
        F.concat_ws("\x1f", F.lit("4"), "grp", "code", joined),  # by model code
        F.concat_ws("\x1f", F.lit("5"), "grp", F.substring(F.reverse(joined), 2, 4), joined),  # past a misspelt end
    )
    rows = nodes.select("sid", "grp", "code", "name", F.explode(keys).alias("key"))
    ordered = scratch.write(
        rows.repartitionByRange("key", "sid").sortWithinPartitions("key", "sid")
        .select("sid", "grp", "code", "name", F.monotonically_increasing_id().alias("mid"))
    )
    # one row per partition of the sort
    part = F.shiftright("mid", 33)
    sizes = sorted((r["p"], r["n"]) for r in ordered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    if not sizes:
        return nodes.sparkSession.createDataFrame([], "a long, b long")
    starts, total = {}, 0
    for p, n in sizes:
        starts[p] = total
        total += n
    start = F.element_at(F.create_map(*[F.lit(x) for p in starts for x in (p, starts[p])]), part.cast("int"))
    ranked = ordered.withColumn("place", start + F.col("mid").bitwiseAND(F.lit((1 << 33) - 1)))
    home = F.floor(F.col("place") / bucket_rows)
    shared = F.when((F.col("place") % bucket_rows < window - 1) & (home > 0), F.array(home, home - 1)).otherwise(F.array(home))
    return (
        ranked.select("sid", "grp", "code", "name", "place", F.explode(shared).alias("bucket"))
        .groupBy("bucket").applyInPandas(_compare(window), "a long, b long").distinct()
    )


def _rounds(t: pa.Table) -> pa.Table:
    """The rounds of ``pivot_clusters`` over links that stand in both directions."""
    a, b, support = (t.column(c).to_numpy() for c in ("a", "b", "sa"))
    ids, first, codes = np.unique(a, return_index=True, return_inverse=True)
    # more listings first, then the smaller id
    rank = np.empty(len(ids), dtype=np.int64)
    rank[np.lexsort((-ids, support[first]))] = np.arange(len(ids))
    by_rank = np.argsort(rank)
    x, y = codes, np.searchsorted(ids, b)
    pivot = np.full(len(ids), -1)
    while len(x):
        top = np.full(len(ids), -1)
        np.maximum.at(top, x, rank[y])
        from_pivot = rank[x] > top[x]
        best = np.full(len(ids), -1)
        np.maximum.at(best, y[from_pivot], rank[x[from_pivot]])
        took = best >= 0
        pivot[took] = by_rank[best[took]]
        closed = took.copy()
        closed[x[from_pivot]] = True
        keep = ~closed[x] & ~closed[y]
        x, y = x[keep], y[keep]
    got = np.flatnonzero(pivot >= 0)
    return pa.table({"sid": ids[got], "pivot": ids[pivot[got]]})


def pivot_clusters(nodes: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Correlation clustering by pivots: ``sid, pivot``.

    A node that outranks all its open neighbours (more listings, then smaller
    id) is a pivot and takes them; pairs without a link count as unlike.  All
    pivots of a round are found at once, so hot nodes stay aggregates.
    """
    rank = F.struct(F.col("support"), -F.col("sid"))
    ranks = nodes.select("sid", rank.alias("r"))
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    open_ = scratch.write(
        both.join(ranks.select(F.col("sid").alias("a"), F.col("r").alias("ra")), "a")
        .join(ranks.select(F.col("sid").alias("b"), F.col("r").alias("rb")), "b")
    )
    taken: list[DataFrame] = []
    while (n := open_.count()) > 0:
        if n <= 2 * FINISH_LINKS:
            flat = open_.select("a", "b", F.col("ra.support").alias("sa"), F.lit(0).alias("whole"))
            taken.append(scratch.write(flat.groupBy("whole").applyInArrow(_rounds, "sid long, pivot long")))
            break
        best = open_.groupBy("a", "ra").agg(F.max("rb").alias("top"))
        pivots = best.where("ra > top").select("a")
        took = scratch.write(
            open_.join(pivots, "a").groupBy(F.col("b").alias("sid")).agg(F.max_by("a", "ra").alias("pivot"))
        )
        taken.append(took)
        closed = took.select("sid").unionByName(took.select(F.col("pivot").alias("sid"))).distinct()
        rest = scratch.write(
            open_.join(closed.withColumnRenamed("sid", "a"), "a", "left_anti").join(closed.withColumnRenamed("sid", "b"), "b", "left_anti")
        )
        scratch.drop(open_)
        open_ = rest
    if not taken:
        return nodes.select("sid", F.col("sid").alias("pivot"))
    all_taken = taken[0]
    for t in taken[1:]:
        all_taken = all_taken.unionByName(t)
    return nodes.select("sid").join(all_taken, "sid", "left").select("sid", F.coalesce("pivot", "sid").alias("pivot"))


def product_groups(df: DataFrame, id_col: str = "posting_id", title: str = "title", *, window: int = WINDOW) -> DataFrame:
    """``posting_id, group_id, kind, amount, variant, pieces, code, name`` of every listing with a title.

    Listings of one group agree in kind, amount, variant and pieces and have
    names that align.  Rows with a null id or title are left out, repeated
    rows count once, a posting with several titles has a row for each; a title
    of which nothing can be read forms a group with equal ones only.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "products")
    rows = df.select(F.col(id_col).alias("posting_id"), F.col(title).alias("t")).where(
        "posting_id is not null and t is not null"
    ).distinct()
    read = scratch.write(
        rows.groupBy("t").agg(F.count("*").alias("n"))
        .select("t", "n", F.pandas_udf(_title_fields, FIELDS)("t").alias("f")).select("t", "n", "f.*")
        .withColumn("grp", F.concat_ws("|", *ATTRIBUTES))
        .withColumn("name", F.when(F.col("name") == "", F.concat(F.lit("\x1e"), "t")).otherwise(F.col("name")))
        .withColumn("sid", F.xxhash64("grp", "code", "name"))
    )
    nodes = scratch.write(
        read.groupBy("sid", "grp", "code", "name").agg(F.sum("n").alias("support"))
    )
    found = nodes.select("sid", F.col("sid").alias("group_id"))
    while True:  # each turn leaves fewer nodes; the last one finds no pivots that are alike
        links = scratch.write(neighbour_links(nodes, scratch, window=window))
        if links.isEmpty():
            break
        pivots = scratch.write(pivot_clusters(nodes, links, scratch))
        found = scratch.write(
            found.join(pivots.select(F.col("sid").alias("group_id"), "pivot"), "group_id").select("sid", F.col("pivot").alias("group_id"))
        )
        heads = pivots.groupBy(F.col("pivot").alias("sid")).agg(F.count("*").alias("_n"))
        sums = nodes.join(pivots, "sid").groupBy(F.col("pivot").alias("sid")).agg(F.sum("support").alias("support"), F.max("code").alias("code"))
        nodes = scratch.write(nodes.drop("support", "code").join(heads.drop("_n"), "sid", "left_semi").join(sums, "sid"))
    return rows.join(read, "t").join(found, "sid").select(
        "posting_id", "group_id", *ATTRIBUTES, "code", "name", F.col("t").alias("title")
    )


def product_classes(groups: DataFrame) -> DataFrame:
    """``posting_id, group_id, members, links``: each posting of a group and the number of the others in it."""
    one = groups.select("posting_id", "group_id").distinct()
    sizes = one.groupBy("group_id").agg(F.count("*").alias("members"))
    return one.join(sizes, "group_id").select("posting_id", "group_id", "members", (F.col("members") - 1).alias("links"))


def group_pairs(groups: DataFrame) -> DataFrame:
    """Every pair of postings of one group, ``left_posting_id, right_posting_id``, the smaller first.

    The postings of a large group are paired in parts of ``PART_ROWS`` with all of the group.
    """
    one = groups.select("group_id", "posting_id").distinct()
    parts = one.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1").select("group_id", F.ceil(F.col("n") / PART_ROWS).cast("int").alias("parts"))
    sized = one.join(parts, "group_id")
    left = sized.select("group_id", F.col("posting_id").alias("left_posting_id"), F.pmod(F.xxhash64("posting_id"), F.col("parts")).cast("int").alias("part"))
    right = sized.select("group_id", F.col("posting_id").alias("right_posting_id"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return left.join(right, ["group_id", "part"]).where("left_posting_id < right_posting_id").select("left_posting_id", "right_posting_id").distinct()
