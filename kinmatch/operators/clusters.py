"""Conservative clustering of eligible pairs, cluster metrics and reviews."""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.functions.numbers import f1, safe_divide, strict_size_band
from kinmatch.operators.pairs import gate
from kinmatch.operators.splits import star_components
from kinmatch.runtime import Scratch

#: Edges of one component that a task merges at once; larger components are merged in rounds, see ``_in_rounds``.
COMPONENT_EDGES = 200_000


def merge_strongest(edges: list[tuple], *, most: int, coverage: float) -> tuple[dict[str, list[str]], list[tuple], int, int]:
    """Greedy merging of one component's edges ``(left, right, probability, cosine, conflict)``, strongest first.

    Two clusters become one unless that passes the size limit or too small a
    share of either side's members has an edge to the other side.  Returns
    members by cluster, the accepted edges and both counts of refusals.
    """
    home: dict[str, str] = {}
    members: dict[str, set[str]] = {}
    near: dict[str, set[str]] = {}
    for a, b, *_ in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for v in near:
        home[v], members[v] = v, {v}
    taken, too_large, thin = [], 0, 0
    for e in sorted(edges, key=lambda e: (-e[2], -e[3], e[0], e[1])):
        x, y = home[e[0]], home[e[1]]
        if x == y:
            continue
        one, two = members[x], members[y]
        if len(one) + len(two) > most:
            too_large += 1
        elif min(sum(not near[v].isdisjoint(two) for v in one) / len(one), sum(not near[v].isdisjoint(one) for v in two) / len(two)) < coverage:
            thin += 1
        else:
            if len(one) < len(two):
                x, y = y, x
            members[x] |= members.pop(y)
            for v in members[x]:
                home[v] = x
            taken.append(e)
    return {k: sorted(v) for k, v in members.items()}, taken, too_large, thin


_OUT = "setting int, posting_id string, first_posting_id string, cluster_size int, cluster_confidence double, manual_review boolean, merges int, size_rejections int, consistency_rejections int"
_IN = ["root", "setting", "left_posting_id", "right_posting_id", "pair_probability", "cosine_similarity", "variant_conflict", "threshold", "coverage", "most", "margin"]


def _components(d: pd.DataFrame) -> pd.DataFrame:
    """All components of a bucket; the bucket only makes tasks large enough."""
    by: dict[str, list[tuple]] = {}
    for row in zip(*[d[c] for c in _IN], strict=True):
        by.setdefault(row[0], []).append(row)
    rows = []
    for found in by.values():
        _, setting, *_, threshold, coverage, most, margin = found[0]
        members, taken, large, thin = merge_strongest([r[2:7] for r in found], most=int(most), coverage=float(coverage))
        home = {v: k for k, vs in members.items() for v in vs}
        inner: dict[str, list] = {}
        for a, _, p, _, conflict in taken:
            inner.setdefault(home[a], []).append((p, conflict))
        counts = (len(taken), large, thin)
        for k, vs in members.items():
            es = inner.get(k, [])
            confidence = min((p for p, _ in es), default=0.0)
            shaky = any(c and p < threshold + 2 * margin for p, c in es)
            review = len(vs) > 1 and (confidence < threshold + margin or shaky)
            for v in vs:
                rows.append((int(setting), v, vs[0], len(vs), confidence, bool(review), *counts))
                counts = (0, 0, 0)
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _OUT.split(", ")])


_BAND = "was string, now string, size int, lowest double, shaky boolean, setting int, merges int, size_rejections int, consistency_rejections int"
_LIVE = ["part", "setting", "place", "due", "left_posting_id", "right_posting_id", "pair_probability", "variant_conflict", "x", "y", "nx", "ny", "threshold", "coverage", "most", "margin"]


def _bands(d: pd.DataFrame) -> pd.DataFrame:
    """Merges the due pairs of each part of a bucket in their order, from clusters ``x, y`` of sizes ``nx, ny`` on.

    Pairs that are not due only say which postings are near.  A row for each cluster of a part says what it became.
    """
    by: dict[str, list[tuple]] = {}
    for row in zip(*[d[c] for c in _LIVE], strict=True):
        by.setdefault(row[0], []).append(row)
    rows = []
    for found in by.values():
        setting, (threshold, coverage, most, margin) = found[0][1], found[0][-4:]
        home, size, members, near = {}, {}, {}, {}
        for _, _, _, _, a, b, _, _, x, y, nx, ny, *_ in found:
            for v, k, n, w in ((a, x, nx, b), (b, y, ny, a)):
                home[v], size[k] = k, int(n)
                members.setdefault(k, set()).add(v)
                near.setdefault(v, set()).add(w)
        into: dict[str, list[str]] = {k: [k] for k in members}
        lowest: dict[str, float] = {}
        shaky: set[str] = set()
        merges = large = thin = 0
        for _, _, _, _, a, b, p, conflict, *_ in sorted((r for r in found if r[3]), key=lambda r: r[2]):
            x, y = home[a], home[b]
            if x == y:
                continue
            one, two = members[x], members[y]
            if size[x] + size[y] > most:
                large += 1
            elif min(sum(not near[v].isdisjoint(two) for v in one) / size[x], sum(not near[v].isdisjoint(one) for v in two) / size[y]) < coverage:
                thin += 1
            else:
                if len(one) < len(two):
                    x, y = y, x
                for v in members[y]:
                    home[v] = x
                members[x] |= members.pop(y)
                into[x] += into.pop(y)
                size[x] += size.pop(y)
                lowest[x] = min(p, lowest.get(x, p), lowest.get(y, p))
                if y in shaky or (conflict and p < threshold + 2 * margin):
                    shaky.add(x)
                merges += 1
        counts = (merges, large, thin)
        for k, olds in into.items():
            for old in olds:
                rows.append((old, k, size[k], lowest.get(k), k in shaky, int(setting), *counts))
                counts = (0, 0, 0)
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in _BAND.split(", ")])
    return out.astype({"lowest": "float64"})


def _in_rounds(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """Exact merge of components (``root``) that are too large for one task, in rounds on written tables.

    A round decides the ``COMPONENT_EDGES`` strongest undecided pairs of each
    component.  Whether two clusters merge depends on them alone, so the parts
    that these pairs connect go to tasks of their own, with the other pairs
    inside a part for the coverage.  Clusters only grow: two that together are
    too large never merge, and their pairs are refused and left out at once.
    """
    spark = pairs.sparkSession
    key = lambda c: F.concat_ws("|", F.format_string("%05d", "setting"), c)
    live = scratch.write(
        pairs.withColumns({"x": key("left_posting_id"), "y": key("right_posting_id"), "nx": F.lit(1), "ny": F.lit(1), "decided": F.lit(False), "refused": F.lit(False)})
    )
    end = lambda side, k: live.select("setting", "threshold", "margin", F.col(side).alias("posting_id"), F.col(k).alias("cluster"))
    homes = scratch.write(end("left_posting_id", "x").unionByName(end("right_posting_id", "y")).distinct().withColumns({"lowest": F.lit(None).cast("double"), "shaky": F.lit(False)}))
    strongest = Window.partitionBy("root", "decided").orderBy(F.desc("pair_probability"), F.desc("cosine_similarity"), "left_posting_id", "right_posting_id")
    counts: dict[int, list[int]] = {}  # three numbers a setting

    def count(df: DataFrame, *columns: Column) -> None:
        for r in df.groupBy("setting").agg(*[F.sum(c) for c in columns]).collect():
            counts[r[0]] = [n + m for n, m in zip(counts.get(r[0], [0, 0, 0]), r[1:], strict=True)]

    undecided = live.count()
    while undecided:
        placed = live.withColumn("place", F.row_number().over(strongest)).withColumn("due", ~F.col("decided") & (F.col("place") <= COMPONENT_EDGES))
        tagged = scratch.write(placed)
        parts = star_components(tagged.where("due").select(F.col("x").alias("src"), F.col("y").alias("dst")))
        inside = tagged.join(parts.select(F.col("node").alias("x"), F.col("root").alias("part")), "x").join(parts.select(F.col("node").alias("y"), F.col("root").alias("other")), "y").where("part = other")
        buckets = max(spark.sparkContext.defaultParallelism, undecided // COMPONENT_EDGES)
        bucketed = inside.select(F.pmod(F.xxhash64("part"), F.lit(buckets)).alias("bucket"), *_LIVE)
        found = scratch.write(bucketed.groupBy("bucket").applyInPandas(_bands, _BAND))
        count(found, F.col("merges"), F.col("size_rejections"), F.col("consistency_rejections"))
        change = found.select(F.col("was").alias("cluster"), "now", F.col("lowest").alias("l"), F.col("shaky").alias("s"))
        after = homes.join(change, "cluster", "left").select(
            "setting", "threshold", "margin", "posting_id", F.coalesce("now", "cluster").alias("cluster"), F.least("lowest", "l").alias("lowest"), (F.col("shaky") | F.coalesce("s", F.lit(False))).alias("shaky")
        )
        end_now = lambda k: found.select(F.col("was").alias(k), F.col("now").alias(f"{k}_now"), F.col("size").alias(f"{k}_size"))
        moved = tagged.join(end_now("x"), "x", "left").join(end_now("y"), "y", "left").withColumns(
            {"x": F.coalesce("x_now", "x"), "y": F.coalesce("y_now", "y"), "nx": F.coalesce("x_size", "nx"), "ny": F.coalesce("y_size", "ny"), "decided": F.col("decided") | F.col("due")}
        ).where("x <> y").withColumn("refused", F.col("nx") + F.col("ny") > F.col("most"))
        moved = scratch.write(moved.select(live.columns))
        count(moved.where("refused and not decided"), F.lit(0), F.lit(1), F.lit(0))
        homes_now, kept = scratch.write(after), scratch.write(moved.where("not refused"))
        for old in (live, homes, tagged, parts, found, moved):
            scratch.drop(old)
        live, homes = kept, homes_now
        undecided = live.where("not decided").count()

    ends = homes.groupBy("setting", "cluster", "threshold", "margin").agg(
        F.min("posting_id").alias("first_posting_id"), F.count("*").cast("int").alias("cluster_size"), F.coalesce(F.min("lowest"), F.lit(0.0)).alias("cluster_confidence"), F.max("shaky").alias("shaky")
    )
    review = (F.col("cluster_size") > 1) & ((F.col("cluster_confidence") < F.col("threshold") + F.col("margin")) | F.col("shaky"))
    ends = ends.select("cluster", "first_posting_id", "cluster_size", "cluster_confidence", review.alias("manual_review"))
    totals = spark.createDataFrame([(k, *[int(n) for n in v]) for k, v in counts.items()], "setting int, merges int, size_rejections int, consistency_rejections int")
    once = homes.groupBy("setting").agg(F.min("posting_id").alias("posting_id")).join(F.broadcast(totals), "setting")  # a setting's counts stand in one row
    number = [F.coalesce(c, F.lit(0)).alias(c) for c in ("merges", "size_rejections", "consistency_rejections")]
    return homes.select("setting", "posting_id", "cluster").join(ends, "cluster").join(F.broadcast(once), ["setting", "posting_id"], "left").select(
        "setting", "posting_id", "first_posting_id", "cluster_size", "cluster_confidence", "manual_review", *number
    )


def conservative_clusters(pairs: DataFrame, settings: list[dict]) -> DataFrame:
    """Clusters of every posting that has a pair, for each setting.

    A setting has ``threshold, reciprocal, override, coverage, most, margin``;
    its place in the list is ``setting``.  No decision crosses a connected
    component of the eligible pairs, so components are merged in parallel and
    exactly; those of more than ``COMPONENT_EDGES`` pairs in rounds.
    """
    spark = pairs.sparkSession
    scratch = Scratch(spark, "clusters")
    gates = list(dict.fromkeys((float(s["threshold"]), s["reciprocal"], float(s["override"])) for s in settings))
    which = F.explode(F.array(*[F.struct(F.lit(g).alias("g"), F.lit(t).alias("threshold"), F.lit(r).alias("reciprocal"), F.lit(o).alias("override")) for g, (t, r, o) in enumerate(gates)]))
    rule = F.col("rule")
    passed = gate(F.col("pair_probability"), F.greatest("left_rank", "right_rank"), F.col("variant_conflict"), threshold=rule["threshold"], reciprocal=rule["reciprocal"], override=rule["override"])
    # pairs are gated and components found once for all settings that differ in what comes after
    eligible = scratch.write(
        pairs.withColumn("rule", which).where(passed == "eligible")
        .select("rule.g", "left_posting_id", "right_posting_id", "pair_probability", "cosine_similarity", "variant_conflict")
    )
    prefix = lambda c: F.concat_ws("|", F.format_string("%05d", "g"), c)
    roots = star_components(eligible.select(prefix("left_posting_id").alias("src"), prefix("right_posting_id").alias("dst")))
    tagged = eligible.withColumn("node", prefix("left_posting_id")).join(roots, "node").drop("node")
    one = lambda i, s: F.struct(F.lit(i).alias("setting"), F.lit(float(s["threshold"])).alias("threshold"), F.lit(float(s["coverage"])).alias("coverage"), F.lit(s["most"]).alias("most"), F.lit(float(s["margin"])).alias("margin"))
    of = lambda g: F.array(*[one(i, s) for i, s in enumerate(settings) if (float(s["threshold"]), s["reciprocal"], float(s["override"])) == gates[g]])
    every = F.element_at(F.array(*[of(g) for g in range(len(gates))]), F.col("g") + 1)
    tagged = tagged.withColumn("s", F.explode(every)).select(*[c for c in tagged.columns if c not in ("g", "root")], F.concat_ws("/", F.format_string("%05d", "s.setting"), "root").alias("root"), "s.*")
    sizes = tagged.groupBy("root").agg(F.count("*").alias("component_edges"))
    tagged = scratch.write(tagged.join(sizes, "root"))
    fits, over = tagged.where(F.col("component_edges") <= COMPONENT_EDGES), tagged.where(F.col("component_edges") > COMPONENT_EDGES).drop("component_edges")
    buckets = max(spark.sparkContext.defaultParallelism, tagged.count() // COMPONENT_EDGES)
    found = fits.withColumn("bucket", F.pmod(F.xxhash64("root"), F.lit(buckets))).select("bucket", *_IN).groupBy("bucket").applyInPandas(_components, _OUT)
    if not over.isEmpty():
        found = found.unionByName(_in_rounds(over, scratch))
    return found.join(F.broadcast(spark.createDataFrame([(i, s["name"] if "name" in s else f"s{i}") for i, s in enumerate(settings)], "setting int, name string")), "setting")


def with_singletons(clusters: DataFrame, ids: DataFrame) -> DataFrame:
    """Assignments of all ``ids`` (``posting_id``): those without an accepted pair stand alone with confidence 0."""
    every = ids.select("posting_id").where("posting_id is not null").distinct()
    c = clusters.select("posting_id", "first_posting_id", "cluster_size", "cluster_confidence", "manual_review")
    return every.join(c, "posting_id", "left").select(
        "posting_id", F.coalesce("first_posting_id", "posting_id").alias("first_posting_id"), F.coalesce("cluster_size", F.lit(1)).alias("cluster_size"),
        F.coalesce("cluster_confidence", F.lit(0.0)).alias("cluster_confidence"), F.coalesce("manual_review", F.lit(False)).alias("manual_review"),
    )


def numbered_entities(assignments: DataFrame) -> DataFrame:
    """``entity_id`` counts clusters in order of their smallest posting: ``entity_000001`` and so on.

    Ranks come from a range-partitioned sort and one count per partition.
    """
    spark = assignments.sparkSession
    scratch = Scratch(spark, "entities")
    heads = scratch.write(
        assignments.select("first_posting_id").distinct().repartitionByRange("first_posting_id").sortWithinPartitions("first_posting_id")
        .select("first_posting_id", F.monotonically_increasing_id().alias("mid"))
    )
    part = F.shiftright("mid", 33)
    sizes = sorted((r["p"], r["n"]) for r in heads.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    starts = dict(zip([p for p, _ in sizes], itertools.accumulate([0, *[n for _, n in sizes]]), strict=False))
    start = F.element_at(F.create_map(*[F.lit(x) for p, n in starts.items() for x in (p, n)]), part.cast("int")) if starts else F.lit(0)
    place = start + F.col("mid").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ids = heads.select("first_posting_id", F.concat(F.lit("entity_"), F.when(place < 1_000_000, F.lpad(place.cast("string"), 6, "0")).otherwise(place.cast("string"))).alias("entity_id"))
    return assignments.join(ids, "first_posting_id")


def contingency(assignments: DataFrame, truth: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``entity, label, n`` (for each value of ``by``): the only thing cluster metrics need, however large the groups are."""
    t = truth.select(F.col("id").alias("posting_id"), "label")
    return assignments.join(t, "posting_id").groupBy(*by, F.col("entity_id").alias("entity"), "label").agg(F.count("*").alias("n"))


def cluster_metrics(table: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairwise and B-cubed quality, merge and split rates and sizes from a contingency table, one row (for each value of ``by``)."""
    return measures(cluster_sums(table, by), list(by))


def cluster_sums(table: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """What ``measures`` takes, from a contingency table."""
    c2 = lambda x: (x * (x - 1) / 2).cast("long")
    by = list(by)
    e = table.groupBy(*by, "entity").agg(F.sum("n").alias("size"), F.count("*").alias("labels"))
    t = table.groupBy(*by, "label").agg(F.sum("n").alias("size"), F.count("*").alias("entities"))
    cells = table.join(e.select(*by, "entity", F.col("size").alias("es")), [*by, "entity"]).join(t.select(*by, "label", F.col("size").alias("ts")), [*by, "label"])
    n = F.col("n")
    a = cells.groupBy(*by).agg(
        F.sum(c2(n)).alias("tp"), (F.sum(n * n / F.col("es")) / F.sum(n)).alias("b3p"), (F.sum(n * n / F.col("ts")) / F.sum(n)).alias("b3r"), F.sum(n).alias("postings"),
    )
    b = e.groupBy(*by).agg(
        F.sum(c2(F.col("size"))).alias("pp"), F.count("*").alias("clusters"), F.sum((F.col("size") == 1).cast("long")).alias("singleton_clusters"),
        F.sum((F.col("labels") > 1).cast("long")).alias("impure"), F.sum(((F.col("labels") > 1) & (F.col("size") > 1)).cast("long")).alias("impure_ns"), F.max("size").alias("maximum_cluster_size"),
    )
    c = t.groupBy(*by).agg(F.sum(c2(F.col("size"))).alias("ap"), F.count("*").alias("groups"), F.sum((F.col("entities") > 1).cast("long")).alias("split_groups"))
    return a.join(b, by).join(c, by) if by else a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c))


def measures(sums: DataFrame, by: list[str]) -> DataFrame:
    """The metrics of ``cluster_sums``."""
    col = F.col
    precision, recall = safe_divide(col("tp"), col("pp")), safe_divide(col("tp"), col("ap"))
    plural = col("clusters") - col("singleton_clusters")
    return sums.select(
        *by, precision.alias("pairwise_precision"), recall.alias("pairwise_recall"), f1(precision, recall).alias("pairwise_f1"),
        col("b3p").alias("b_cubed_precision"), col("b3r").alias("b_cubed_recall"), f1(col("b3p"), col("b3r")).alias("b_cubed_f1"),
        F.when(col("pp") > 0, 1 - precision).otherwise(0.0).alias("false_merge_pair_rate"),
        safe_divide(col("impure"), col("clusters")).alias("impure_cluster_rate"), safe_divide(col("impure_ns"), plural).alias("impure_non_singleton_cluster_rate"),
        safe_divide(col("split_groups"), col("groups")).alias("false_split_group_rate"), "clusters", "singleton_clusters", plural.alias("non_singleton_clusters"),
        "maximum_cluster_size", safe_divide(col("postings"), col("clusters")).alias("mean_cluster_size"),
    )


def swept_sums(clusters: DataFrame, truth: DataFrame, settings: int) -> DataFrame:
    """``setting`` and the sums of its cluster metrics over the labelled postings; those without an accepted pair stand alone."""
    numbers = clusters.sparkSession.range(settings).select(F.col("id").cast("int").alias("setting"))  # the stated grid
    every = truth.select(F.col("id").alias("posting_id")).crossJoin(F.broadcast(numbers))
    a = every.join(clusters.select("setting", "posting_id", "first_posting_id"), ["setting", "posting_id"], "left").select(
        "setting", "posting_id", F.coalesce("first_posting_id", "posting_id").alias("entity_id")
    )
    return cluster_sums(contingency(a, truth, ("setting",)), ("setting",))


def group_recovery(table: DataFrame) -> DataFrame:
    """``band, groups, unsplit_rate, mean_fragments`` by group size; all four bands, also empty ones."""
    t = table.groupBy("label").agg(F.sum("n").alias("size"), F.count("*").alias("fragments"))
    some = t.groupBy(strict_size_band(F.col("size")).alias("band")).agg(
        F.count("*").alias("groups"), F.avg((F.col("fragments") == 1).cast("double")).alias("unsplit_rate"), F.avg("fragments").alias("mean_fragments")
    )
    bands = table.sparkSession.createDataFrame([("2",), ("3_to_5",), ("6_to_9",), ("10_plus",)], "band string")
    return bands.join(some, "band", "left").select(
        "band", F.coalesce("groups", F.lit(0)).alias("groups"), F.coalesce("unsplit_rate", F.lit(0.0)).alias("unsplit_rate"), F.coalesce("mean_fragments", F.lit(0.0)).alias("mean_fragments")
    )


def failure_review(table: DataFrame, assignments: DataFrame, most: int = 20) -> DataFrame:
    """``kind, name, parts, size``: the first impure clusters, split groups and clusters to review."""
    def first(df: DataFrame, kind: str, name: str, order: list[Column]) -> DataFrame:
        return df.orderBy(*order, name).limit(most).select(F.lit(kind).alias("kind"), F.col(name).alias("name"), "parts", "size")

    e = table.groupBy("entity").agg(F.count("*").alias("parts"), F.sum("n").alias("size")).where("parts > 1")
    g = table.groupBy("label").agg(F.count("*").alias("parts"), F.sum("n").alias("size")).where("parts > 1")
    r = assignments.where("manual_review").groupBy("entity_id").agg(F.lit(1).cast("long").alias("parts"), F.count("*").alias("size"))
    worst = [F.desc("parts"), F.desc("size")]
    return first(e, "false_merge", "entity", worst).unionByName(first(g, "false_split", "label", worst)).unionByName(first(r, "manual_review", "entity_id", worst))


def select_policy(results: DataFrame, minimum_precision: float) -> DataFrame:
    """Best setting of a sweep: one that is precise enough before any other, then by B-cubed F1 and pairwise F1 and precision.

    Ties go to fewer split groups, then to the stricter policy: the higher
    threshold, the smaller reciprocal rank, the higher coverage.
    """
    c = F.col
    key = F.struct(
        (c("pairwise_precision") >= minimum_precision).cast("int").alias("ok"), "b_cubed_f1", "pairwise_f1", "pairwise_precision",
        (-c("false_split_group_rate")).alias("whole"), "threshold", (-c("reciprocal")).alias("strict"), "coverage",
    )
    return results.agg(F.max_by(F.struct(*results.columns), key).alias("r")).select("r.*")


def ranked_within(df: DataFrame, by: str, order: list[Column]) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
