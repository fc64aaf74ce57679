import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinmatch.errors import ConfigurationError, ContractError
from kinmatch.functions.hashes import phash_bits
from kinmatch.operators import ann, audit, clusters, matcher, metrics, mining, models, pairs, rankers, sampling, splits, stored, sweep
from kinmatch.plans import catalogue, inputs
from kinmatch.sources import guards
from tests.conftest import rows


def ranking(spark, data):
    return spark.createDataFrame(data, "query_id string, candidate_id string, score double, rank int")


def test_phash_ranking_breaks_ties_by_id(spark):
    h = spark.createDataFrame([("q", "0" * 16), ("b", "0" * 15 + "1"), ("a", "0" * 15 + "2")], "id string, h string").select("id", phash_bits("h").alias("bits"))
    got = rankers.phash_ranking(h.where("id = 'q'"), h, 2).collect()
    assert [(r["candidate_id"], r["score"], r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [("a", 1 - 1 / 64, 1), ("b", 1 - 1 / 64, 2)]


def test_exact_cosine_equals_brute_force_over_blocks(spark):
    r = np.random.default_rng(3)
    m = r.standard_normal((60, 8))
    m[7] = m[3]  # a tie
    df = rankers.vectors(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(99, [0.0] * 8), (98, None)], "i int, v array<double>"), "i", "v")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for grid in ({}, {"block_queries": 5, "chunk_rows": 13}):
        got = {}
        for x in rankers.exact_cosine(df.where("id % 5 = 0"), df, 4, **grid).collect():
            got.setdefault(x["query_id"], {})[x["rank"]] = x["candidate_id"]
        for q in range(0, 60, 5):
            s = u @ u[q]
            want = sorted((i for i in range(60) if i != q), key=lambda i: (-round(s[i], 12), i))[:4]
            assert [got[q][k] for k in range(1, 5)] == want
    assert rankers.exact_cosine(df.where("id < 0"), df, 4).count() == 0


def test_cell_index_round_trip_and_gate(spark, tmp_path):
    r = np.random.default_rng(1)
    df = rankers.vectors(spark.createDataFrame([(i, [float(x) for x in r.standard_normal(8)]) for i in range(200)], "i int, v array<double>"), "i", "v")
    index = ann.CellIndex.fit(df, centres=8)
    exact = rankers.exact_cosine(df.where("id % 20 = 0"), df, 5)
    full = index.search(df.where("id % 20 = 0"), df, 5, 8)
    assert ann.agreement(exact, full, 5).agg(F.min("agreement")).first()[0] == 1.0
    index.save(str(tmp_path / "i.json"))
    assert np.array_equal(ann.CellIndex.load(str(tmp_path / "i.json")).centres, index.centres)
    trials = spark.createDataFrame([(1, 0.5, 0.6), (2, 0.99, 0.995), (3, 1.0, 1.0)], "setting int, recall double, agreement double")
    assert rows(ann.accepted_setting(trials, 0.99)) == [(2, True)]
    assert rows(ann.accepted_setting(trials, 5.0)) == [(3, False)]


def test_stored_indexes_come_back_and_grow(spark, tmp_path):
    r = np.random.default_rng(2)
    df = rankers.vectors(spark.createDataFrame([(i, [float(x) for x in r.standard_normal(8)]) for i in range(200)], "i int, v array<double>"), "i", "v")
    q = df.where("id % 20 = 0")
    exact = rankers.exact_cosine(q, df, 5)
    stored.same_rankings(exact, stored.StoredExact.save(df, f"{tmp_path}/exact").search(q, 5))
    with pytest.raises(ContractError):
        stored.same_rankings(exact, rankers.exact_cosine(q, df.where("id % 20 <> 7"), 5))
    with pytest.raises(ContractError):
        stored.StoredExact.save(df.unionByName(df), f"{tmp_path}/twice")
    cells = stored.StoredCells.save(ann.CellIndex.fit(df, centres=8), df.where("id < 150"), f"{tmp_path}/cells")
    cells.append(df.where("id >= 150"))
    again = stored.StoredCells(spark, f"{tmp_path}/cells")
    assert again.lists().count() == 200
    found = again.search(q, 5, 8)
    assert ann.agreement(exact, found, 5).agg(F.min("agreement")).first()[0] == 1.0


def test_guards(spark, tmp_path):
    findings = "severity string, code string, message string, n long"
    rows_ = spark.range(3)
    with pytest.raises(ContractError):
        guards.publish(rows_, spark.createDataFrame([("critical", "a", "b", 1)], findings), f"{tmp_path}/out")
    assert guards.publish(rows_, spark.createDataFrame([("warning", "a", "b", 1)], findings), f"{tmp_path}/out") == "passed_with_warnings"
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3
    assert guards.frozen_policy({"threshold": 0.16}, {"threshold": 0.16, "rank": 5})
    with pytest.raises(ConfigurationError):
        guards.frozen_policy({"threshold": 0.16}, {"threshold": 0.2})
    guards.claim_test_access(f"{tmp_path}/m/once.json", {"run": 1})
    with pytest.raises(ContractError):
        guards.claim_test_access(f"{tmp_path}/m/once.json", {"run": 2})
    assert set(guards.latency_profile(lambda: None, 5)) == {"p50", "p95", "mean"}
    metrics.reproduced({"map": 0.5}, {"map": 0.50005})
    with pytest.raises(ContractError):
        metrics.reproduced({"map": 0.5}, {"map": 0.51})


def test_tfidf_pads_short_lists(spark):
    t = spark.createDataFrame([(1, "coffee 500g"), (2, "coffee mug"), (3, "xyz"), (4, "")], "id int, norm string")
    v = rankers.sparse_titles(t, rankers.fit_vocabulary(t.where("id < 3"), 3, 3, 100), 3, 3)
    assert v.where("id in (3, 4)").count() == 0
    full = rankers.padded(rankers.tfidf_ranking(v, v, 3), t, t, 3)
    assert full.groupBy("query_id").count().where("count <> 3").count() == 0
    assert [r["candidate_id"] for r in full.where("query_id = 3").orderBy("rank").collect()] == [1, 2, 4]
    length = v.select("id", F.explode("w").alias("weight")).groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-9 for r in length)


def test_union_and_fusion(spark):
    a = ranking(spark, [("q", "a", 0.9, 1), ("q", "b", 0.5, 2)])
    b = ranking(spark, [("q", "b", 1.0, 1), ("q", "c", 0.1, 2)])
    assert rows(rankers.candidate_union([a, b], 1)) == [("q", "a", 0.0), ("q", "b", 0.0)]
    assert [(r["candidate_id"], r["score"]) for r in rankers.fuse_rankings(a, b, 0.5, 2).orderBy("rank").collect()] == [("b", 0.75), ("a", 0.45)]
    assert rankers.invalid_rows(a).count() == 0
    assert rankers.invalid_rows(ranking(spark, [("q", "b", 0.5, 1), ("q", "a", 0.9, 2)])).count() == 1


def test_near_hashes_equal_brute_force(spark):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(12)]
    data = []
    for i in range(120):
        x = base[i % 12]
        for _ in range(r.randrange(7)):
            x ^= 1 << r.randrange(64)
        data.append((f"{x:016x}", f"g{r.randrange(4)}"))
    data += [("nonsense", "g1"), (None, "g1"), (f"{base[0]:016x}", None)]
    got = {(a, b): d for a, b, d in rows(audit.near_phashes(spark.createDataFrame(data, "image_phash string, label_group string"), 5))}
    labels = {}
    for h, g in data:
        if h and h != "nonsense" and g:
            labels.setdefault(h, set()).add(g)
    want = {(a, b): (int(a, 16) ^ int(b, 16)).bit_count() for a in labels for b in labels if a < b and (int(a, 16) ^ int(b, 16)).bit_count() <= 5 and len(labels[a] | labels[b]) > 1}
    assert got == want and want


def test_near_hashes_of_all_cells_equal_brute_force(spark):
    r = random.Random(8)
    base = [r.getrandbits(64) for _ in range(20)]
    found = sorted({b ^ sum(1 << j for j in r.sample(range(64), r.randrange(7))) for b in base for _ in range(15)})
    data = [(f"{x:016x}", f"g{i}") for i, x in enumerate(found)]
    want = {(f"{a:016x}", f"{b:016x}"): (a ^ b).bit_count() for a in found for b in found if a < b and (a ^ b).bit_count() <= 8}
    df = spark.createDataFrame(data, "image_phash string, label_group string")
    for grid in ({}, {"block_queries": 90, "chunk_rows": 60}):
        near = audit.near_phashes(df, 8, **grid)
        assert "explode(flatten" not in near._jdf.queryExecution().toString()  # no row for each flip of bits
        got = [((a, b), d) for a, b, d in rows(near)]
        assert len(got) == len(want) and dict(got) == want


def test_near_hashes_across_splits_make_no_row_for_a_flip(spark, small):
    plan = catalogue.near_phash_cross_split(spark, small)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "flatten(" not in plan


def test_nearest_rank_quantiles(spark):
    df = spark.createDataFrame([(x,) for x in (5, 1, 4, 2, 3, None)], "x int")
    got = {(q): v for _, q, v in rows(audit.nearest_rank_quantiles(df, {"m": F.col("x")}))}
    data = [1, 2, 3, 4, 5]
    assert got == {n: float(data[round(4 * p)]) for n, p in audit.QUANTILES}


def test_star_components_equal_union_find(spark):
    r = random.Random(2)
    edges = [(f"n{r.randrange(80):03d}", f"n{r.randrange(80):03d}") for _ in range(60)] + [(None, "n001"), ("n002", "n002")]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "src string, dst string")
    for most in (0, 1_000):  # in rounds, and finished at once
        assert dict(rows(splits.star_components(df, finish_edges=most))) == {v: find(v) for v in parent}
    assert splits.star_components(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_the_digest_of_many_edges_does_not_overflow(spark, monkeypatch):
    monkeypatch.setattr(splits.Scratch, "write", lambda self, df: df)  # only the digest runs
    edges = spark.range(1, 17_500_000).select(F.col("id").alias("src"), F.lit(0).alias("dst"))
    assert splits.star_components(edges, finish_edges=20_000_000).columns == ["node", "root"]


def test_components_join_labels_by_shared_values_and_splits_hold(spark):
    data = [(f"p{i}", f"g{i // 3:02d}", f"h{i // 3}", f"img{i}") for i in range(90)] + [("x", "g00", "shared", None), ("y", "g01", "shared", None)]
    df = spark.createDataFrame(data, "posting_id string, label_group string, image_phash string, image string")
    c = splits.label_components(df, {"phash": F.col("image_phash"), "image": F.col("image")})
    ids = {r["label_group"]: r["component_id"] for r in c.collect()}
    assert ids["g00"] == ids["g01"] and len(set(ids.values())) == 29
    s = splits.assign_splits(c)
    assert {r["split"] for r in s.collect()} == {"train", "validation", "test"} and s.count() == 29
    crossing = splits.split_integrity(df.join(c, "label_group").join(s, "component_id"), {"label": F.col("label_group"), "phash": F.col("image_phash")})
    assert all(r["crossing"] == 0 for r in crossing.collect())
    assert rows(splits.assign_splits(c.repartition(3))) == rows(s)


def test_splits_follow_the_sequential_rule(spark):
    import hashlib

    r = np.random.default_rng(5)
    data = [(f"c{i}", int(r.integers(1, 9)), ["2", "3_to_5", "6_to_9"][int(r.integers(0, 3))]) for i in range(200)]
    got = dict(rows(splits.assign_splits(spark.createDataFrame(data, "component_id string, component_rows long, size_band string"), seed=3)))
    total, share = sum(w for _, w, _ in data), {"train": 0.8, "validation": 0.1, "test": 0.1}
    most = Counter(b for _, _, b in data)
    loads, bands = Counter(), Counter()
    for c, w, b in sorted(data, key=lambda x: (-x[1], hashlib.sha256(f"3:{x[0]}".encode()).hexdigest(), x[0])):
        pick = min(share, key=lambda s: 0.7 * loads[s] / (total * share[s]) + 0.3 * bands[b, s] / (most[b] * share[s]))
        assert got[c] == pick
        loads[pick] += w
        bands[b, pick] += 1


def test_component_digest_streams_over_batches():
    import hashlib

    import pandas as pd

    parts = [pd.DataFrame({"root": ["a", "a"], "label": ["a", "b"]}), pd.DataFrame({"root": ["a", "c"], "label": ["d", "c"]})]
    got = dict(pd.concat(splits._label_digests(iter(parts))).itertuples(index=False))
    assert got == {"a": hashlib.sha256(b"a\nb\nd").hexdigest(), "c": hashlib.sha256(b"c").hexdigest()} and not list(splits._label_digests(iter([])))


PAIR = "left_posting_id string, right_posting_id string, cosine_similarity double, pair_probability double, left_rank int, right_rank int, variant_conflict boolean"
SETTING = {"threshold": 0.5, "reciprocal": 5, "override": 0.95, "coverage": 1.0, "most": 64, "margin": 0.05}


def edge(a, b, p, rank=1, conflict=False):
    return (a, b, p, p, 1, rank, conflict)


def test_conservative_clusters_refuse_weak_bridges(spark):
    df = spark.createDataFrame([edge("1", "2", 0.99), edge("3", "4", 0.98), edge("2", "3", 0.97)], PAIR)
    got = clusters.conservative_clusters(df, [SETTING])
    assert {(r["posting_id"], r["first_posting_id"]) for r in got.collect()} == {("1", "1"), ("2", "1"), ("3", "3"), ("4", "3")}
    assert got.agg(F.sum("consistency_rejections"), F.sum("merges")).first() == (1, 2)


def test_gates_reject_in_order(spark):
    df = spark.createDataFrame([edge("1", "2", 0.9, rank=6), edge("2", "3", 0.94, conflict=True), edge("1", "3", 0.1)], PAIR)
    gates = {r["left_posting_id"] + r["right_posting_id"]: r["gate"] for r in pairs.gated_pairs(df, threshold=0.5, reciprocal=5, override=0.95).collect()}
    assert gates == {"12": "non_reciprocal", "23": "variant_conflict_rejected", "13": "below_probability"}
    assert clusters.conservative_clusters(df, [SETTING]).count() == 0


def test_clusters_equal_a_direct_merge_on_random_graphs(spark):
    r = random.Random(4)
    data = {}
    for _ in range(120):
        a, b = sorted(r.sample(range(40), 2))
        data[(a, b)] = edge(f"{a:02d}", f"{b:02d}", round(r.uniform(0.5, 1), 4))
    d = pd.DataFrame(data.values(), columns=[c.split()[0] for c in PAIR.split(", ")])
    for coverage, most in ((0.5, 64), (0.3, 6)):
        members, _, _, _ = clusters.merge_strongest(list(d[["left_posting_id", "right_posting_id", "pair_probability", "cosine_similarity", "variant_conflict"]].itertuples(index=False, name=None)), most=most, coverage=coverage)
        want = {v: vs[0] for vs in members.values() for v in vs}
        got = clusters.conservative_clusters(spark.createDataFrame(d, PAIR), [SETTING | {"coverage": coverage, "most": most}])
        assert {x["posting_id"]: x["first_posting_id"] for x in got.collect()} == want


def test_clusters_of_large_components_equal_a_direct_merge(spark):
    r = random.Random(5)
    one, level = {}, {(a, b): 0.9 for a in range(14) for b in range(a + 1, 14)}
    for _ in range(150):
        a, b = sorted(r.sample(range(45), 2))
        one[(a, b)] = round(r.uniform(0.5, 1), 2)
    limit = clusters.COMPONENT_EDGES
    try:
        clusters.COMPONENT_EDGES = 40
        for data, coverage, most in ((one, 0.5, 64), (one, 0.3, 6), (level, 0.5, 5)):
            edges = [edge(f"{a:02d}", f"{b:02d}", p, conflict=p >= 0.95 and a % 2 == 0) for (a, b), p in data.items()]
            members, taken, large, thin = clusters.merge_strongest([(a, b, p, c, k) for a, b, c, p, _, _, k in edges], most=most, coverage=coverage)
            low = {k: min((p for a, _, p, *_ in taken if a in vs), default=0.0) for k, vs in members.items()}
            want = {v: (vs[0], len(vs), low[k], len(vs) > 1 and low[k] < 0.55) for k, vs in members.items() for v in vs}
            got = clusters.conservative_clusters(spark.createDataFrame(edges, PAIR), [SETTING | {"coverage": coverage, "most": most}]).collect()
            assert {x["posting_id"]: (x["first_posting_id"], x["cluster_size"], x["cluster_confidence"], x["manual_review"]) for x in got} == want and len(got) == len(want)
            assert [sum(x[c] for x in got) for c in ("merges", "size_rejections", "consistency_rejections")] == [len(taken), large, thin]
    finally:
        clusters.COMPONENT_EDGES = limit


def test_rounds_of_numbered_pairs_equal_a_direct_merge():
    few, turn = sweep.FEW_PAIRS, sweep.TURN_PAIRS
    try:
        for seed in range(60):
            sweep.TURN_PAIRS = (turn, 10)[seed % 2]
            r = random.Random(seed)
            nodes = r.choice((12, 30, 80))
            some = {tuple(sorted(r.sample(range(nodes), 2))): round(r.uniform(0.5, 1), r.choice((1, 3))) for _ in range(r.choice((20, 150, 400)))}
            some |= {(0, v): round(r.uniform(0.5, 1), 2) for v in range(1, nodes)} if seed % 3 == 0 else {}  # a posting that meets every other
            edges = sorted(((f"{a:02d}", f"{b:02d}", p, p, False) for (a, b), p in some.items()), key=lambda e: (-e[2], e[0], e[1]))
            a, b = (np.array([int(e[i]) for e in edges], dtype=np.int32) for i in (0, 1))
            for coverage, most, sweep.FEW_PAIRS in ((1.0, 64, 0), (0.5, 64, 0), (0.5, 64, 50), (0.4, 7, 0), (0.3, 5, 10), (0.0, 6, 0)):
                members, taken, large, thin = clusters.merge_strongest(edges, most=most, coverage=coverage)
                ways = [sweep.merge_in_rounds(a, b, nodes, most=most, coverage=coverage)]
                if not coverage:
                    ways += list(sweep.merge_unbounded(a, b, nodes, most=most, stops=[len(a) // 2, len(a)]))[1:]
                for home, merged, *counts in ways:
                    assert counts == [large, thin] and sorted(merged) == sorted(edges.index(e) for e in taken)
                    assert {tuple(vs) for vs in members.values()} == {tuple(f"{v:02d}" for v in np.flatnonzero(home == k)) for k in set(home[np.concatenate([a, b])].tolist())}
    finally:
        sweep.FEW_PAIRS, sweep.TURN_PAIRS = few, turn


def test_policies_in_tasks_equal_those_in_tables(spark, small):
    some = [dict(s, name=f"n{i}") for i, s in enumerate(catalogue.SWEEP) if i % 13 == 0] + [SETTING | {"name": "x", "coverage": 0.5, "most": 5}, SETTING | {"name": "y", "coverage": 0.0, "most": 3}]
    p, truth = catalogue._pairs(spark, small), inputs.listing_labels(spark, small)
    limit, got = sweep.GATE_PAIRS, []
    try:
        for sweep.GATE_PAIRS in (limit, 0, 60):  # none, all and some in tables
            found = sweep.policy_results(p, truth, some)
            got.append((rows(sweep.diagnostics(found)), rows(catalogue.rounded(sweep.quality(found)))))
    finally:
        sweep.GATE_PAIRS = limit
    assert got[0] == got[1] == got[2] and len(got[0][0]) == len(got[0][1]) == len(some)
    none = p.where("false")
    assert len(rows(sweep.quality(sweep.policy_results(none, truth, some)))) == len(some) and not rows(sweep.diagnostics(sweep.policy_results(none, None, some)))


def test_a_sweep_writes_no_row_for_each_policy(spark, small, monkeypatch):
    write, written = sweep.Scratch.write, []
    monkeypatch.setattr(sweep.Scratch, "write", lambda self, df: written.append(write(self, df)) or written[-1])
    assert catalogue.cluster_sweep(spark, small).count() == len(catalogue.SWEEP)
    assert max(df.count() for df in written) <= catalogue._pairs(spark, small).count() + inputs.listing_labels(spark, small).count()


def test_diagnostics_of_the_policies_write_no_row_for_each(spark, small, monkeypatch):
    write, written = sweep.Scratch.write, []
    monkeypatch.setattr(sweep.Scratch, "write", lambda self, df: written.append(write(self, df)) or written[-1])
    got = {r["setting"]: r for r in catalogue.cluster_diagnostics(spark, small).collect()}
    p = catalogue._pairs(spark, small)
    assert max(df.count() for df in written) <= 2 * p.count()  # pairs, or their ends
    s = catalogue.SWEEP[-1]
    edges = [tuple(r) for r in pairs.gated_pairs(p, **{k: s[k] for k in ("threshold", "reciprocal", "override")}).where("gate = 'eligible'").select("left_posting_id", "right_posting_id", "pair_probability", "cosine_similarity", "variant_conflict").collect()]
    members, taken, large, thin = clusters.merge_strongest(edges, most=s["most"], coverage=s["coverage"])
    last = got[len(catalogue.SWEEP) - 1]
    assert (last["merges"], last["size_rejections"], last["consistency_rejections"], last["clusters"]) == (len(taken), large, thin, len(members))


def test_diagnostics_gate_pairs_without_a_rank_or_number_alike_in_tasks_and_tables(spark):
    found = [("a", "b", 0.9, 0.9, 1, 1), ("b", "c", 0.9, 0.7, None, None), ("c", "d", 0.9, 0.7, None, 3), ("d", "e", 0.9, float("nan"), 1, 1), ("e", "f", 0.9, 0.7, None, 9)]
    p = spark.createDataFrame([(*x, False) for x in found], PAIR)
    eligible = pairs.gated_pairs(p, **{k: SETTING[k] for k in ("threshold", "reciprocal", "override")}).where("gate = 'eligible'").count()
    limit = sweep.GATE_PAIRS
    try:
        for sweep.GATE_PAIRS in (limit, 0):  # in tasks, in tables
            got = sweep.diagnostics(sweep.policy_results(p, None, [SETTING | {"coverage": c} for c in (0.0, 0.2)])).orderBy("setting").collect()
            assert [(r["merges"], r["clusters"]) for r in got] == [(eligible, 1)] * 2 and eligible == 4
    finally:
        sweep.GATE_PAIRS = limit


def test_the_selected_policy_comes_from_a_sweep_without_a_row_for_each_policy(spark, small, monkeypatch):
    write, written = sweep.Scratch.write, []
    monkeypatch.setattr(sweep.Scratch, "write", lambda self, df: written.append(write(self, df)) or written[-1])
    got = catalogue.selected_policy(spark, small).collect()
    assert max(df.count() for df in written) <= catalogue._pairs(spark, small).count() + inputs.listing_labels(spark, small).count()
    key = lambda r: (r["pairwise_precision"] >= catalogue.MINIMUM_PRECISION, r["b_cubed_f1"], r["pairwise_f1"], r["pairwise_precision"], -r["false_split_group_rate"], r["threshold"], -r["reciprocal"], r["coverage"])
    assert got == [max(catalogue.cluster_sweep(spark, small).collect(), key=key)]


def test_cluster_metrics_of_perfect_partition(spark):
    t = spark.createDataFrame([("e1", "g1", 3), ("e2", "g2", 1)], "entity string, label string, n long")
    m = clusters.cluster_metrics(t).first()
    assert (m["pairwise_f1"], m["b_cubed_f1"], m["false_merge_pair_rate"], m["false_split_group_rate"]) == (1, 1, 0, 0)
    assert {r["band"]: r["groups"] for r in clusters.group_recovery(t).collect()} == {"2": 0, "3_to_5": 2, "6_to_9": 0, "10_plus": 0}


def test_edge_and_classification_metrics(spark):
    truth = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "a"), ("4", "b")], "id string, label string")
    accepted = pairs.labelled(spark.createDataFrame([edge("1", "2", 0.9), edge("1", "4", 0.9)], PAIR), truth)
    e = pairs.edge_metrics(accepted, truth).first()
    assert (e["precision"], round(e["recall"], 6), e["false_negative"]) == (0.5, 0.333333, 2)
    p = spark.createDataFrame([("a", "b", 0.9, 1), ("a", "c", 0.8, 0), ("a", "d", 0.6, 1), ("a", "e", 0.1, 0)], "left_posting_id string, right_posting_id string, pair_probability double, positive int")
    m = pairs.classification_metrics(p, threshold=0.5, bins=5, recall_floor=0.5, precision_floor=0.8).first()
    assert (round(m["precision"], 6), m["recall_within_candidates"], round(m["f1_within_candidates"], 6), round(m["average_precision"], 6), round(m["brier_score"], 6)) == (0.666667, 1, 0.8, 0.833333, 0.205)
    assert (m["true_positive"], m["false_positive"], m["true_negative"]) == (2, 1, 1)


def test_online_policy(spark):
    df = spark.createDataFrame([(0.8, 1, 2), (0.15, 1, 2), (0.8, 1, 6)], "p double, f int, r int")
    got = df.select(pairs.online_policy(F.col("p"), F.col("f"), F.col("r"), F.lit(False), threshold=0.16, reciprocal=5, override=0.15)["reason"]).collect()
    assert [r[0] for r in got] == ["accepted", "below_probability_threshold", "not_reciprocal_top_k"]


def test_usable_pairs_turn_and_fold(spark):
    df = spark.createDataFrame([("b", "a", 0.1, 0.4, 7, 1, None), ("a", "b", 0.1, 0.6, 1, 7, True), ("a", None, 0.1, 0.9, 1, 1, None), ("a", "a", 1.0, 1.0, 1, 1, None), ("a", "c", 0.1, None, 1, 1, None)], PAIR)
    assert rows(pairs.usable_pairs(df)) == [("a", "b", 0.1, 0.6, 1, 7, True)]


def test_quota_prefers_variants_then_ordinary(spark):
    data = [("q", f"c{i}", 0.9 - i / 100, 0.5, i % 2 == 0) for i in range(8)]
    df = spark.createDataFrame(data, "query_id string, candidate_id string, pair_probability double, cosine_similarity double, variant_conflict boolean")
    got = {r["candidate_id"] for r in mining.per_query_quota(df, 5, 0.5).collect()}
    assert got == {"c0", "c2", "c1", "c3", "c5"}  # round(2.5) is 2 variants
    only_variants = mining.per_query_quota(df.where("variant_conflict"), 5, 0.5)
    assert only_variants.count() == 2


def test_variant_cap_keeps_the_hardest(spark):
    data = [(f"l{i}", f"r{i}", "a", "b", 0.5, 0.5 + i / 100, i < 6) for i in range(10)]
    df = spark.createDataFrame(data, "left_posting_id string, right_posting_id string, left_label_group string, right_label_group string, cosine_similarity double, pair_probability double, variant_conflict boolean")
    got = mining.cap_variants(df, 0.5)
    assert {r["left_posting_id"] for r in got.where("variant_conflict").collect()} == {"l2", "l3", "l4", "l5"} and got.count() == 8
    assert mining.negative_batch(df, 1, 0, 0, 25).count() == 25 and mining.negative_batch(df.limit(0), 1, 0, 0, 5).count() == 0


def test_product_batches_and_pairs(spark):
    labels = "aabbbccdd"
    df = spark.createDataFrame([(f"p{i}", c) for i, c in enumerate(labels)], "id string, label string")
    got = sampling.product_batches(df, products=3, samples=2, batches=4, seed=7)
    assert got.groupBy("batch").count().where("count <> 6").count() == 0
    assert got.groupBy("batch", "label").count().where("count <> 2").count() == 0
    assert rows(got) == rows(sampling.product_batches(df, products=3, samples=2, batches=4, seed=7))
    b = sampling.balanced_pairs(spark.createDataFrame([(f"p{i}", c) for i, c in enumerate("001122")], "id string, label string"), ratio=2, seed=1)
    assert sorted(r["positive"] for r in b.collect()).count(True) == 3 and b.count() == 9


def test_contrastive_loss_equals_numpy(spark):
    r = np.random.default_rng(0)
    v = r.standard_normal((8, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    y = np.array([0, 0, 1, 1, 2, 2, 2, 0])
    z = v @ v.T / 0.1
    np.fill_diagonal(z, -np.inf)
    lp = z - np.log(np.exp(z).sum(1, keepdims=True))
    want = -np.mean([lp[i][[j for j in range(8) if j != i and y[j] == y[i]]].mean() for i in range(8)])
    df = spark.createDataFrame([(i, int(y[i]), [float(x) for x in v[i]]) for i in range(8)], "id int, label int, v array<double>")
    assert abs(models.contrastive_loss(df, 0.1).first()["loss"] - want) < 1e-9
    with pytest.raises(Exception, match="anchor"):
        models.contrastive_loss(df.where("id in (0, 1, 2)"), 0.1).collect()


def test_score_preserving_fusion_and_encoder(spark):
    i, t = np.array([0.6, 0.8]), np.array([1.0, 0.0])
    df = spark.createDataFrame([(i.tolist(), t.tolist(), t.tolist(), i.tolist())], "i1 array<double>, t1 array<double>, i2 array<double>, t2 array<double>")
    from kinmatch.functions.numbers import dot

    joint = dot(models.score_preserving(F.col("i1"), F.col("t1"), 0.4), models.score_preserving(F.col("i2"), F.col("t2"), 0.4))
    assert abs(df.select(joint.alias("x")).first()["x"] - (0.4 * 0.6 + 0.6 * 0.6)) < 1e-9
    e = models.TextEncoder.seeded(10)
    out = e.encode(np.array([[2, 3, 0, 0], [2, 3, 4, 1]]))
    assert out.shape == (2, 64) and np.allclose(np.linalg.norm(out, axis=1), 1, atol=1e-5)
    short, long = e.encode(np.array([[2, 3, 0, 0]])), e.encode(np.array([[2, 3, 0, 0, 0, 0, 0, 0]]))
    assert np.allclose(short, long, atol=1e-5)  # padding does not matter


def test_pair_head_learns_a_separable_rule(spark):
    r = np.random.default_rng(0)
    data = []
    for k in range(200):
        a = r.standard_normal(6)
        b = a + 0.05 * r.standard_normal(6) if k % 2 else r.standard_normal(6)
        data.append((k, k + 1000, [float(x) for x in a / np.linalg.norm(a)], [float(x) for x in b / np.linalg.norm(b)], k % 2))
    df = spark.createDataFrame(data, "left_id int, right_id int, lv array<double>, rv array<double>, positive int")
    model = models.fit_pair_head(df.where("left_id < 150"))
    held = models.pair_probabilities(model, df.where("left_id >= 150"))
    assert held.select(F.avg(((F.col("pair_probability") > 0.5).cast("int") == F.col("positive")).cast("double"))).first()[0] > 0.9


def test_matcher_decides(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0], ["a"]), (2, [0.99, 0.141], ["a"]), (3, [0.0, 1.0], ["b"])], "id int, v array<double>, tokens array<string>")
    known = spark.createDataFrame([(1, "e1", False), (2, "e1", False), (3, "e3", False)], "id int, entity_id string, manual_review boolean")
    _, d = matcher.match(e, e, known, lambda c: c, k=2, threshold=0.5, reciprocal=2, override=0.9, margin=0.05)
    got = {r["query_id"]: (r["decision"], r["entity_id"]) for r in d.collect()}
    assert got[1] == ("matched", "e1") and got[3] == ("new_entity", None)


def test_images(spark):
    ppm = b"P3\n# c\n2 1\n255\n255 0 0 0 0 255\n"
    assert models.parse_ppm(ppm).tolist() == [[[255, 0, 0], [0, 0, 255]]]
    square = models.resize_and_pad(models.parse_ppm(ppm), 4)
    assert square.shape == (3, 4, 4) and square[0, 1, 0] == 1.0 and square[0, 0, 0] == -1.0


def test_best_epoch_and_acceptance(spark):
    h = spark.createDataFrame([(0, 0.5), (1, 0.7), (2, 0.7)], "epoch int, score double")
    assert models.best_epoch(h).first()[0] == 1 and models.best_epoch(h, 0.7).first()[0] == -1
    run = spark.createDataFrame([(0.8, 0.9, 0.5, 10, 0.8, 0.899, 0.6, 10)], "base_map double, base_recall double, base_precision double, base_variant_errors int, new_map double, new_recall double, new_precision double, new_variant_errors int")
    assert models.accept_candidate(run).first()[0]


def test_title_ranking_equals_brute_force_of_the_whole_model(spark, small):
    titles = {r["id"]: r["norm"] for r in inputs.titled(spark, small).collect()}
    grams = {}
    for i, t in titles.items():
        words = [f" {w} " for w in t.split(" ") if w]
        grams[i] = Counter(w[j : j + n] for w in words for n in range(2, 6) for j in range(len(w) - n + 1))
    df = Counter(g for c in grams.values() for g in c)
    assert len(df) <= 100_000
    x = {}
    for i, c in grams.items():
        w = {g: (1 + math.log(n)) * (math.log((1 + len(titles)) / (1 + df[g])) + 1) for g, n in c.items()}
        length = math.sqrt(sum(v * v for v in w.values()))
        x[i] = {g: v / length for g, v in w.items()}
    want = {}
    for q in (i for i in titles if i % 20 == 0):
        scores = {c: round(sum(v * x[c].get(g, 0.0) for g, v in x[q].items()), 9) for c in titles if c != q}
        for rank, c in enumerate(sorted(scores, key=lambda c: (-scores[c], c))[:100], 1):
            want[(q, rank)] = (c, scores[c])
    got = {(r["query_id"], r["rank"]): (r["candidate_id"], r["score"]) for r in catalogue.tfidf_topk(spark, small).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-6 for k in want)


def test_titles_weighed_in_cells_rank_as_their_vectors(spark, small):
    t = inputs.titled(spark, small).limit(400).cache()
    t = t.unionByName(spark.createDataFrame([(-20, ""), (-40, "zzz qqq")], "id long, norm string"))
    vocabulary = rankers.fit_vocabulary(t.where("id > 0"), 2, 5, 3_000).cache()
    v, asked = rankers.sparse_titles(t, vocabulary, 2, 5), "id % 4 = 0"
    want = rows(rankers.tfidf_ranking(v.where(asked), v, 7).select("query_id", "rank", "candidate_id", "score"))
    for grid in ({}, {"held_rows": 50, "block_queries": 40, "chunk_rows": 130}):
        found = rankers.title_ranking(t.where(asked), t, vocabulary, 2, 5, 7, **grid)
        assert rows(found.select("query_id", "rank", "candidate_id", "score")) == want and want


def test_batches_hold_every_row_with_another_of_its_label(spark):
    data = [(i, i % 9 if i < 100 else 9) for i in range(203)]
    got = sampling.row_batches(spark.createDataFrame(data, "id int, label int"), size=20, seed=3).collect()
    assert sorted((r["id"], r["label"]) for r in got) == data and len({r["batch"] for r in got}) > 5
    assert min(Counter((r["batch"], r["label"]) for r in got).values()) >= 2


def test_contrastive_loss_takes_every_vector(spark, small):
    have = sampling.row_batches(inputs.embedded(spark, small).join(inputs.embedded_truth(spark, small), "id"), size=catalogue.BATCH, seed=7).collect()
    assert len(have) == 500
    losses = []
    for batch in {r["batch"] for r in have}:
        one = [r for r in have if r["batch"] == batch]
        z = np.array([r["v"] for r in one]) @ np.array([r["v"] for r in one]).T / 0.1
        y = np.array([r["label"] for r in one])
        np.fill_diagonal(z, -np.inf)
        same = (y[:, None] == y[None, :]) & ~np.eye(len(y), dtype=bool)
        lp = np.where(same, z - np.log(np.exp(z).sum(1, keepdims=True)), 0)
        losses.append(-np.mean(lp.sum(1) / same.sum(1)))
    assert abs(catalogue.contrastive_loss(spark, small).first()["loss"] - np.mean(losses)) < 2e-6


def test_pairs_of_every_batch_are_balanced(spark, small):
    have = sampling.row_batches(catalogue._product_rows(spark, small), size=catalogue.BATCH, seed=7).collect()
    got = catalogue.balanced_pairs(spark, small).collect()
    label, batch = {r["id"]: r["label"] for r in have}, {r["id"]: r["batch"] for r in have}
    want = {(a, b) for a in label for b in label if a < b and label[a] == label[b] and batch[a] == batch[b]}
    assert {(r["left_id"], r["right_id"]) for r in got if r["positive"]} == want
    n = Counter((r["batch"], r["positive"]) for r in got)
    assert want and all(n[(b, False)] == 2 * n[(b, True)] for b in set(batch.values()))


def test_missed_pairs_are_those_of_the_asked_queries(spark, small):
    label = {r["id"]: r["label"] for r in inputs.embedded_truth(spark, small).collect()}
    sizes = Counter(label.values())
    total = sum(sizes[label[i]] - 1 for i in label if i % 20 == 0)
    hits = {}
    for r in catalogue._judged(spark, small).collect():
        tp, fp = hits.get(r["score"], (0, 0))
        hits[r["score"]] = (tp + r["hit"], fp + 1 - r["hit"])
    points, tp, fp = [], 0, 0
    for score in sorted(hits, reverse=True):
        tp, fp = tp + hits[score][0], fp + hits[score][1]
        precision, recall = tp / (tp + fp), tp / total
        points.append((2 * precision * recall / (precision + recall) if tp else 0, precision, score, recall))
    got = catalogue.select_threshold(spark, small).first()
    best = max(points)
    assert (got["f1"], got["precision"], got["threshold"], got["recall"]) == pytest.approx(best, abs=1e-6)
    assert got["true_positive"] + got["false_negative"] == total
    for r in (catalogue.pair_metrics(spark, small).first(), catalogue.threshold_curve(spark, small).first()):
        assert r["true_positive"] + r["false_negative"] == total
    floor = metrics.precision_at_recall(catalogue._points(spark, small), 0.001).first()
    assert (floor["precision"], floor["threshold"]) == pytest.approx(max((p, s) for _, p, s, recall in points if recall >= 0.001), abs=1e-6)


def test_title_vectors_read_128_characters_and_510_kinds(spark, tmp_path):
    kinds = "".join(chr(0x4E00 + i) for i in range(300))
    long = "abcd " * 20
    titles = [long + "x", long + "y", kinds[:100], kinds[100:200], kinds[200:], *kinds.replace("", " ").split(), "x y"]
    spark.createDataFrame(list(enumerate(titles)), "row_number long, title string").coalesce(1).write.parquet(str(tmp_path / "listing.parquet"))
    v = {r["id"]: np.array(r["v"]) for r in catalogue._title_vectors(spark, str(tmp_path)).collect()}
    apart = [(0, 1), (5 + 250, 5 + 251), (5 + 280, 5 + 281)]
    assert len(v) == len(titles) and all(np.abs(v[a] - v[b]).max() > 1e-6 for a, b in apart)
