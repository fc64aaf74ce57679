"""Many clustering policies over the same pairs: exact greedy merging on numbered postings, a task for every two gates."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.operators import clusters
from kinmatch.operators.pairs import gate
from kinmatch.runtime import Scratch

#: Pairs of a gate that one task may take; policies of larger gates are merged in rounds on tables, see ``clusters``.
GATE_PAIRS = 6_000_000
#: Pairs of a block that travels to the gates' tasks.
BLOCK_PAIRS = 65_536
#: Undecided pairs that are merged one after the other, as rounds over so few cost more.
FEW_PAIRS = 4_000
#: Pairs whose coverage is counted at once.
TURN_PAIRS = 500_000
_NEVER = np.iinfo(np.int32).max


def merge_unbounded(a: np.ndarray, b: np.ndarray, nodes: int, *, most: int, stops: list[int]):
    """Greedy merging with a size limit alone, strongest first; yields ``home, merged, too_large, 0`` after each of ``stops`` pairs.

    No weaker pair matters, so one pass serves every threshold.
    """
    home, members = list(range(nodes)), {}
    merged, large, at = [], 0, 0
    for stop in stops:
        for i, (u, v) in enumerate(zip(a[at:stop].tolist(), b[at:stop].tolist(), strict=True), at):
            x, y = home[u], home[v]
            if x == y:
                continue
            one, two = members.get(x) or [x], members.get(y) or [y]
            if len(one) + len(two) > most:
                large += 1
                continue
            if len(one) < len(two):
                x, one, two = y, two, one
            one.extend(two)
            members[x] = one
            members.pop(home[two[0]], None)
            for w in two:
                home[w] = x
            merged.append(i)
        at = stop
        yield np.array(home, dtype=np.int32), np.array(merged, dtype=np.int64), large, 0


def _first(nodes: int, x: np.ndarray, y: np.ndarray, rank: np.ndarray, of_x, of_y) -> np.ndarray:
    """The smallest of ascending ranks at each cluster: of repeated places the last assignment stays."""
    first = np.full(nodes, _NEVER, dtype=np.int32)
    first[x[of_x][::-1]] = rank[of_x][::-1]
    other = np.full(nodes, _NEVER, dtype=np.int32)
    other[y[of_y][::-1]] = rank[of_y][::-1]
    return np.minimum(first, other)


def _mergeable(u: np.ndarray, v: np.ndarray, x: np.ndarray, y: np.ndarray, size: np.ndarray, nodes: int, coverage: float) -> np.ndarray:
    """Whether enough members of either cluster have an edge to the other; all edges of two clusters are given."""
    ok = 1 / np.maximum(size[x], size[y]) >= coverage
    some = np.flatnonzero(~ok)
    if len(some):
        key = np.where(x < y, x.astype(np.int64) * nodes + y, y.astype(np.int64) * nodes + x)[some]
        order = np.argsort(key)
        some, key = some[order], key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.cumsum(new) - 1
        several = np.bincount(group)[group] > 1
        some, group = some[several], group[several]
        if len(some):
            low = x[some] < y[some]
            share = []
            for low_side in (True, False):
                end = np.where(low == low_side, u[some], v[some])
                pair = np.unique(group * nodes + end)
                share.append(np.bincount(pair // nodes, minlength=group[-1] + 1)[group] / size[np.where(low == low_side, x[some], y[some])])
            ok[some] = np.minimum(*share) >= coverage
    return ok


def merge_in_rounds(a: np.ndarray, b: np.ndarray, nodes: int, *, most: int, coverage: float):
    """Greedy merging as ``clusters.merge_strongest`` does it, of pairs ``a, b`` that stand strongest first: ``home, merged, too_large, thin``.

    A round decides every pair that no earlier undecided pair can influence.
    An earlier pair that can merge as things stand changes both its clusters at
    its rank at the earliest; from there a change spreads over later pairs of a
    changed cluster.  ``until`` is the rank up to which a cluster surely stays as
    it is: pairs before both their clusters' ranks are refused for good, and the
    pair at both ranks merges.  Clusters only grow, so two that are too large
    together stay apart.
    """
    home, size = np.arange(nodes, dtype=np.int32), np.ones(nodes, dtype=np.int32)
    u, v, rank, due, ok = a, b, np.arange(len(a), dtype=np.int32), np.ones(len(a), dtype=bool), np.ones(len(a), dtype=bool)
    changed = np.zeros(nodes, dtype=bool)
    merged, large, thin = [], 0, 0
    while True:
        x, y = home[u], home[v]
        keep = x != y
        over = keep & (size[x] + size[y] > most)
        large += np.count_nonzero(over & due)
        keep &= ~over
        alive = np.zeros(nodes, dtype=bool)
        for side in (x, y):
            alive[side[keep & due]] = True
        keep &= alive[x] & alive[y]
        u, v, rank = u[keep], v[keep], rank[keep]
        due, ok = due[keep], ok[keep]
        x, y = x[keep], y[keep]
        del over, keep
        if np.count_nonzero(due) <= FEW_PAIRS:
            break
        anew = np.flatnonzero(changed[x] | changed[y])
        turns = len(anew) // TURN_PAIRS + 1  # all pairs of two clusters come in one turn
        for turn in range(turns):
            now = anew[(x[anew] + y[anew]) % turns == turn]
            ok[now] = _mergeable(u[now], v[now], x[now], y[now], size, nodes, coverage)
        can, cannot = np.flatnonzero(ok & due), np.flatnonzero(~ok & due)
        until = _first(nodes, x, y, rank, can, can)
        at, tx, ty, tr = cannot, x[cannot], y[cannot], rank[cannot]
        while len(at):
            hx, hy = until[tx], until[ty]
            lower = _first(nodes, tx, ty, tr, (hy < tr) & (tr < hx), (hx < tr) & (tr < hy))
            if (lower == _NEVER).all():
                break
            until = np.minimum(until, lower)
            open_ = (tr < until[tx]) | (tr < until[ty])
            at, tx, ty, tr = at[open_], tx[open_], ty[open_], tr[open_]
        refused = at[(tr < until[tx]) & (tr < until[ty])] if len(at) else at
        thin += len(refused)
        due[refused] = False
        now = can[(rank[can] == until[x[can]]) & (rank[can] == until[y[can]])]
        due[now] = False
        up = np.arange(nodes, dtype=np.int32)
        up[y[now]] = x[now]
        size[x[now]] += size[y[now]]
        home = up[home]
        changed[:] = False
        changed[x[now]] = True
        merged.append(rank[now])
    rest, over, few = _one_by_one(u, v, x, y, rank, due, home, size, most, coverage)
    return home, np.concatenate([*merged, np.array(rest, dtype=np.int32)]).astype(np.int64), large + over, thin + few


def _one_by_one(u, v, x, y, rank, due, home: np.ndarray, size: np.ndarray, most: int, coverage: float) -> tuple[list[int], int, int]:
    """The last undecided pairs in their order, from the clusters of ``home`` on, which it changes."""
    place: dict[int, int] = {}
    members: dict[int, set[int]] = {}
    near: dict[int, set[int]] = {}
    for p, q, i, j in zip(u.tolist(), v.tolist(), x.tolist(), y.tolist(), strict=True):
        for node, cluster, other in ((p, i, q), (q, j, p)):
            place[node] = cluster
            members.setdefault(cluster, set()).add(node)
            near.setdefault(node, set()).add(other)
    count = {k: int(size[k]) for k in members}
    into: dict[int, int] = {}
    merged, large, thin = [], 0, 0
    for p, q, r in zip(u[due].tolist(), v[due].tolist(), rank[due].tolist(), strict=True):
        i, j = place[p], place[q]
        if i == j:
            continue
        one, two = members[i], members[j]
        if count[i] + count[j] > most:
            large += 1
        elif min(sum(not near[w].isdisjoint(two) for w in one) / count[i], sum(not near[w].isdisjoint(one) for w in two) / count[j]) < coverage:
            thin += 1
        else:
            if len(one) < len(two):
                i, j = j, i
            for w in members[j]:
                place[w] = i
            members[i] |= members.pop(j)
            count[i] += count.pop(j)
            into[j] = i
            merged.append(r)
    if into:
        up = np.arange(len(home), dtype=np.int32)
        for j in into:
            i = j
            while i in into:
                i = into[i]
            up[j] = i
        home[:] = up[home]
    return merged, large, thin


def _numbered(rows: DataFrame, name: str, scratch: Scratch) -> tuple[DataFrame, int]:
    """The rows with ``number``, from 0 on in the order of the distinct ``name``; and how many they are."""
    held = scratch.write(rows.repartitionByRange(name).sortWithinPartitions(name).withColumn("mid", F.monotonically_increasing_id()))
    part = F.shiftright("mid", 33)
    sizes = sorted(tuple(r) for r in held.groupBy(part).count().collect())  # one for each partition
    starts = dict(zip([p for p, _ in sizes], itertools.accumulate([0, *[n for _, n in sizes]]), strict=False))
    start = F.element_at(F.create_map(*[F.lit(x) for p, n in starts.items() for x in (p, n)]), part) if starts else F.lit(0)
    return held.withColumn("number", (start + F.col("mid").bitwiseAND(F.lit((1 << 33) - 1))).cast("int")).drop("mid"), sum(n for _, n in sizes)


def _parts(settings: list[tuple[int, dict]]) -> list[dict]:
    """What a task each takes: the settings of two gates with neighbouring thresholds, or those without a coverage that differ in their threshold only; large ones first."""
    found: dict[tuple, dict] = {}
    ladder = sorted({float(s["threshold"]) for _, s in settings})
    for i, s in settings:
        t, rule = float(s["threshold"]), (s["reciprocal"], float(s["override"]))
        key = ("prefixes", *rule, s["most"]) if float(s["coverage"]) <= 0 else (ladder.index(t) // 2, *rule)
        part = found.setdefault(key, {"threshold": t, "reciprocal": rule[0], "override": rule[1], "free": float(s["coverage"]) <= 0, "settings": []})
        part["threshold"] = min(part["threshold"], t)
        part["settings"].append((i, t, float(s["coverage"]), s["most"], float(s["margin"])))
    return sorted(found.values(), key=lambda p: (p["threshold"], -p["reciprocal"]))


def _cuts(part: dict) -> list[float]:
    return sorted({x for _, t, _, _, margin in part["settings"] for x in (t, t + margin, t + 2 * margin)})


_BLOCK = "part int, labels boolean, place long, n int, above array<long>, data binary"


def _pair_blocks(parts: list[dict]):
    """Blocks of the sorted pairs for each part: both ends and the conflicts, and how many probabilities reach each cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = 0, []

        def blocks() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            a, b, p, worst, conflict = (t.column(c).to_numpy() for c in ("a", "b", "pair_probability", "worst", "variant_conflict"))
            where = (int(t.column("range")[0].as_py()) << 32) + place
            for k, part in enumerate(parts):
                some = ~((p < part["threshold"]) | (worst > part["reciprocal"]) | (conflict & (p < part["override"])))  # as ``gate``: no rank passes, and a NaN is large
                if some.any():
                    data = a[some].tobytes() + b[some].tobytes() + conflict[some].tobytes()
                    above = [int(np.count_nonzero(~(p[some] < c))) for c in _cuts(part)]
                    yield _block(k, False, where, int(some.sum()), above, data)

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= BLOCK_PAIRS:
                yield from blocks()
                place, held = place + 1, []
        if any(x.num_rows for x in held):
            yield from blocks()

    return run


def _label_blocks(parts: int):
    """Blocks of the labelled postings' numbers and their labels' for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column("number").to_numpy().tobytes() + batch.column("code").to_numpy().tobytes()
            for k in range(parts if batch.num_rows else 0):
                yield _block(k, True, 0, batch.num_rows, [], data)

    return run


def _block(part: int, labels: bool, place: int, n: int, above: list[int], data: bytes) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip((part, labels, place, n, above, data), kinds, strict=True)], names=[c.split()[0] for c in _BLOCK.split(", ")])


_COUNTS = ("pairs", "merges", "size_rejections", "consistency_rejections", "nodes", "manual_review_clusters")
_SUMS = ("tp", "b3p", "b3r", "postings", "pp", "clusters", "singleton_clusters", "impure", "impure_ns", "maximum_cluster_size", "ap", "groups", "split_groups")
_RESULT = ", ".join(["setting int", *[f"{c} long" for c in _COUNTS], *[f"{c} {'double' if c in ('b3p', 'b3r') else 'long'}" for c in _SUMS]])


def _judged(home: np.ndarray, posting: np.ndarray, label: np.ndarray) -> dict:
    """What the cluster metrics need, over labelled postings; see ``clusters.cluster_metrics``."""
    nodes = len(home)
    cell, n = np.unique(home[posting].astype(np.int64) * nodes + label, return_counts=True)
    entity, of = cell // nodes, cell % nodes
    es, ts = np.bincount(home[posting], minlength=nodes), np.bincount(label, minlength=nodes)
    labels, entities = np.bincount(entity, minlength=nodes), np.bincount(of, minlength=nodes)
    c2 = lambda x: int((x * (x - 1) // 2).sum())
    return {
        "tp": c2(n), "b3p": float((n * n / es[entity]).sum() / n.sum()), "b3r": float((n * n / ts[of]).sum() / n.sum()), "postings": int(n.sum()), "pp": c2(es),
        "clusters": np.count_nonzero(es), "singleton_clusters": np.count_nonzero(es == 1), "impure": np.count_nonzero(labels > 1), "impure_ns": np.count_nonzero((labels > 1) & (es > 1)),
        "maximum_cluster_size": int(es.max()), "ap": c2(ts), "groups": np.count_nonzero(ts), "split_groups": np.count_nonzero(entities > 1),
    }


def _reviewed(home: np.ndarray, a: np.ndarray, conflict: np.ndarray, merged: np.ndarray, sure: int, surer: int) -> int:
    """Clusters whose weakest merge is not among the first ``sure`` pairs, or that merged at a conflict that is not among the first ``surer``."""
    shaky = (merged >= sure) | (conflict[merged] & (merged >= surer))
    return len(np.unique(home[a[merged[shaky]]]))


def _results(parts: list[dict], nodes: int):
    """Merges each part of a partition under its settings; a row for each setting."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list[tuple]] = {}
        for batch in batches:
            for k, labels, place, n, above, data in zip(*batch.to_pydict().values(), strict=True):
                blocks.setdefault(k, []).append((labels, place, n, above, data))
        batch = data = None  # what came lies in the blocks now
        for k in sorted(blocks):
            mine = sorted(blocks.pop(k), key=lambda x: x[:2])
            part, rows = parts[k], []
            column = lambda labels, at, kind: np.concatenate([np.empty(0, kind), *[np.frombuffer(data, kind, n, at * n) for known, _, n, _, data in mine if known == labels]])  # noqa: B023, E731
            a, b, conflict = column(False, 0, np.int32), column(False, 4, np.int32), column(False, 8, np.bool_)
            posting, label = column(True, 0, np.int32), column(True, 4, np.int32)
            above = np.sum([[0] * len(_cuts(part)), *[x[3] for x in mine if not x[0]]], axis=0, dtype=np.int64)
            reach = dict(zip(_cuts(part), above.tolist(), strict=True))
            del mine
            for (i, t, _, _, margin), (home, merged, large, thin) in _merges(part, a, b, nodes, reach):
                stop = reach[t]
                touched = np.zeros(nodes, dtype=bool)
                touched[a[:stop]] = touched[b[:stop]] = True
                ends = len(np.unique(home[np.flatnonzero(touched)]))
                row = {"setting": i, "pairs": stop, "merges": len(merged), "size_rejections": large, "consistency_rejections": thin, "nodes": ends}
                row["manual_review_clusters"] = _reviewed(home, a, conflict, merged, reach[t + margin], reach[t + 2 * margin])
                rows.append(row | (_judged(home, posting, label) if len(posting) else {}))
            kinds = [(c.split()[0], {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[c.split()[1]]) for c in _RESULT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([None if (x := r.get(c)) is None else kind.to_pandas_dtype()(x) for r in rows], kind) for c, kind in kinds], names=[c for c, _ in kinds])

    return run


def _merges(part: dict, a: np.ndarray, b: np.ndarray, nodes: int, reach: dict[float, int]):
    """Each setting of a part with its merge."""
    if part["free"]:
        ordered = sorted(part["settings"], key=lambda s: -s[1])
        yield from zip(ordered, merge_unbounded(a, b, nodes, most=ordered[0][3], stops=[reach[s[1]] for s in ordered]), strict=True)
        return
    done: dict[tuple, tuple] = {}
    for s in part["settings"]:
        if s[1:4] not in done:  # the pairs of the higher threshold stand first
            done[s[1:4]] = merge_in_rounds(a[: reach[s[1]]], b[: reach[s[1]]], nodes, most=s[3], coverage=s[2])
        yield s, done[s[1:4]]


def _in_tables(pairs: DataFrame, truth: DataFrame | None, settings: list[tuple[int, dict]], scratch: Scratch) -> DataFrame:
    """The same rows from clusters that are merged in rounds on tables, however many pairs a gate has."""
    spark = pairs.sparkSession
    found = scratch.write(clusters.conservative_clusters(pairs, [s for _, s in settings]))
    by = found.groupBy("setting").agg(
        *[F.sum(c).alias(c) for c in _COUNTS[1:4]], F.count_distinct("first_posting_id").alias("nodes"),
        F.count_distinct(F.when(F.col("manual_review"), F.col("first_posting_id"))).alias("manual_review_clusters"),
    ).withColumn("pairs", F.lit(1).cast("long"))  # more than none
    numbers = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(settings)], "setting int, number int")
    both = by if truth is None else by.join(clusters.swept_sums(found, truth, len(settings)), "setting", "full")
    known = [F.col(c) if c in both.columns else F.lit(None).alias(c) for c in (*_COUNTS, *_SUMS)]
    return both.join(F.broadcast(numbers), "setting").select(F.col("number").alias("setting"), *known)


def policy_results(pairs: DataFrame, truth: DataFrame | None, settings: list[dict]) -> DataFrame:
    """Counts of each setting's merge and, with ``truth``, the sums of its cluster metrics: one row for each setting.

    Sorted pairs travel as blocks of numbers to a task for every two gates, which
    holds some 100 bytes a pair; neither pairs nor postings are copied to rows
    of the settings.  Settings of gates beyond ``GATE_PAIRS`` go another way.
    """
    spark = pairs.sparkSession
    scratch = Scratch(spark, "sweep")
    worst = F.greatest("left_rank", "right_rank")
    passes = lambda s: gate(F.col("pair_probability"), F.col("worst"), F.col("variant_conflict"), threshold=float(s["threshold"]), reciprocal=s["reciprocal"], override=float(s["override"])) == "eligible"
    rules = list({(float(s["threshold"]), s["reciprocal"], float(s["override"])): s for s in settings}.values())
    lowest, furthest, least = min(float(s["threshold"]) for s in rules), max(s["reciprocal"] for s in rules), min(float(s["override"]) for s in rules)
    loosest = {"threshold": lowest, "reciprocal": furthest, "override": least}
    some = scratch.write(pairs.withColumn("worst", worst).where(passes(loosest)).select("left_posting_id", "right_posting_id", "pair_probability", "cosine_similarity", "worst", "variant_conflict"))
    counts = some.agg(*[F.sum(passes(s).cast("long")) for s in rules]).first()
    large = {(float(s["threshold"]), s["reciprocal"], float(s["override"])) for s, n in zip(rules, counts, strict=True) if (n or 0) > GATE_PAIRS}
    numbered = [(i, s, (float(s["threshold"]), s["reciprocal"], float(s["override"])) in large) for i, s in enumerate(settings)]
    parts, others = _parts([(i, s) for i, s, over in numbered if not over]), [(i, s) for i, s, over in numbered if over]

    results = []
    if parts:
        ids = some.select(F.col("left_posting_id").alias("posting_id")).unionByName(some.select(F.col("right_posting_id").alias("posting_id"))).withColumn("label", F.lit(None).cast("string"))
        if truth is not None:
            ids = ids.unionByName(truth.select(F.col("id").alias("posting_id"), "label"))
        nodes, n = _numbered(ids.where("posting_id is not null").groupBy("posting_id").agg(F.max("label").alias("label")), "posting_id", scratch)
        end = lambda side, to: nodes.select(F.col("posting_id").alias(side), F.col("number").alias(to))
        ended = some.join(end("left_posting_id", "a"), "left_posting_id").join(end("right_posting_id", "b"), "right_posting_id")
        order = [F.desc("pair_probability"), F.desc("cosine_similarity"), F.asc("a"), F.asc("b")]
        columns = ["a", "b", "pair_probability", "cosine_similarity", "worst", "variant_conflict"]
        placed = ended.select(columns).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id())
        blocks = placed.mapInArrow(_pair_blocks(parts), _BLOCK)
        if truth is not None:
            known = nodes.where("label is not null").select("number", "label")
            coded = known.join(known.groupBy("label").agg(F.min("number").alias("code")), "label").select("number", "code")
            blocks = blocks.unionByName(coded.mapInArrow(_label_blocks(len(parts)), _BLOCK))
        results.append(scratch.write(blocks.repartitionById(len(parts), F.col("part")).mapInArrow(_results(parts, n), _RESULT)))
    if others:
        results.append(_in_tables(pairs, truth, others, scratch))
    every = results[0] if len(results) == 1 else results[0].unionByName(results[1])
    return every.join(F.broadcast(spark.createDataFrame([(i, s["name"] if "name" in s else f"s{i}") for i, s in enumerate(settings)], "setting int, name string")), "setting")


def diagnostics(results: DataFrame) -> DataFrame:
    """``setting, name`` and the counts of the settings with an eligible pair."""
    return results.where("pairs > 0").select("setting", "name", "merges", "size_rejections", "consistency_rejections", F.col("nodes").alias("clusters"), "manual_review_clusters")


def quality(results: DataFrame) -> DataFrame:
    """``setting`` and its cluster metrics over the labelled postings; those without an accepted pair stand alone."""
    return clusters.measures(results.where("postings is not null"), ["setting"])
