"""Named queries of the core operators over the whole test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.functions import titles as T
from kinmatch.functions.hashes import phash_bits, stable_order
from kinmatch.functions.numbers import dot, group_size_band, normalized_length_band, sigmoid, strict_size_band, title_length_band
from kinmatch.operators import ann, audit, clusters, matcher, metrics, mining, models, pairs, rankers, sampling, splits, stored, sweep
from kinmatch.plans import inputs, oracles
from kinmatch.runtime import Scratch, ship, table
from kinmatch.sources import files

K = 20
GRAMS, FEATURES, CANDIDATES = (2, 5), 100_000, 100  # the reference's title model
GATES = {"threshold": 0.5, "reciprocal": 10, "override": 0.8}
SETTING = GATES | {"coverage": 0.5, "most": 64, "margin": 0.05, "name": "frozen"}
# The reference's grid of policies
SWEEP = [
    {"threshold": t, "reciprocal": r, "override": 0.15, "coverage": c, "most": 64, "margin": 0.02, "name": f"t{t}_r{r}_c{c}"}
    for t in (0.1, 0.12, 0.14, 0.16, 0.18, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5, 0.6) for r in (5, 10, 20, 50) for c in (0.0, 0.5, 1.0)
]
MINIMUM_PRECISION = 0.9
BATCH = 256
SIX = 6


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, or all doubles, to six places."""
    names = names or tuple(c for c, t in df.dtypes if t == "double")
    return df.withColumns({c: F.round(c, SIX) for c in names})


# ---- rankings


def _cosine(spark, d, k=K):
    e = inputs.embedded(spark, d)
    return rankers.exact_cosine(e.where(inputs.is_query("id")), e, k)


def exact_topk_cosine(spark, d):
    return rounded(_cosine(spark, d))


def _phash(spark, d, k=K):
    h = inputs.hashed(spark, d)
    return rankers.phash_ranking(h.where(inputs.is_query("id")), h, k)


def phash_topk(spark, d):
    return rounded(_phash(spark, d))


def near_phash_pairs(spark, d):
    return audit.near_phashes(table(spark, d, "train"), 8)


def char_ngrams(spark, d):
    g = T.word_ngrams("norm", 2, 5)
    return inputs.titled(spark, d).select(F.col("id").alias("row_number"), F.size(g).alias("n_grams"), F.size(F.array_distinct(g)).alias("n_distinct"))


def tfidf_vocabulary(spark, d):
    return rounded(rankers.fit_vocabulary(inputs.titled(spark, d), *GRAMS, FEATURES))


def _tfidf(spark, d, k=CANDIDATES):
    s = Scratch(spark, "tfidf")
    t = inputs.titled(spark, d)
    found = rankers.title_ranking(t.where(inputs.is_query("id")), t, rankers.fit_vocabulary(t, *GRAMS, FEATURES), *GRAMS, k)
    return rankers.padded(s.write(found), t.where(inputs.is_query("id")), t, k)


def tfidf_weights(spark, d):
    t = inputs.titled(spark, d)
    v = rankers.tfidf_vectors(t, rankers.fit_vocabulary(t, *GRAMS, FEATURES), *GRAMS)
    return rounded(v.groupBy("id").agg(F.count("*").alias("features"), F.sum("weight").alias("total"), F.max("weight").alias("largest")))


def tfidf_topk(spark, d):
    return rounded(_tfidf(spark, d))


def _fused_halves(spark, d, weight, k=K):
    h = inputs.embedded_halves(spark, d)
    return rankers.modality_fusion(h.where(inputs.is_query("id")), h, weight, k)


def modality_score_fusion(spark, d):
    return rounded(_fused_halves(spark, d, 0.4))


def _half(spark, d, name, k=K):
    h = inputs.embedded_halves(spark, d).select("id", F.col(name).alias("v"))
    return rankers.exact_cosine(h.where(inputs.is_query("id")), h, k)


def candidate_union(spark, d):
    return rankers.candidate_union([_half(spark, d, "image"), _half(spark, d, "text")], 10)


def fuse_rankings(spark, d):
    return rounded(rankers.fuse_rankings(_half(spark, d, "image"), _half(spark, d, "text"), 0.75, K))


def invalid_ranking_rows(spark, d):
    """The first ranks turned round: every query shows its break."""
    r = _cosine(spark, d)
    return rounded(rankers.invalid_rows(r.withColumn("rank", F.when(F.col("rank") == 1, 2).when(F.col("rank") == 2, 1).otherwise(F.col("rank")))))


def ranking_lists(spark, d):
    return rankers.ranking_json(rounded(_cosine(spark, d, 5)))


# ---- approximate search


def ann_topk(spark, d):
    e = inputs.embedded(spark, d)
    return rounded(ann.CellIndex.fit(e).search(e.where(inputs.is_query("id")), e, K, 24))


def ranking_agreement(spark, d):
    e = inputs.embedded(spark, d)
    found = ann.CellIndex.fit(e).search(e.where(inputs.is_query("id")), e, K, 24)
    return rounded(ann.agreement(_cosine(spark, d), found, K))


def ann_disagreements(spark, d):
    e = inputs.embedded(spark, d)
    found = ann.CellIndex.fit(e).search(e.where(inputs.is_query("id")), e, K, 2)
    return rounded(ann.disagreements(_cosine(spark, d), found, K))


def ann_gate(spark, d):
    """Recall against the labels may fall by 0.001 at most and 0.99 of the exact candidates must be found."""
    s = Scratch(spark, "ann")
    e, truth, n = inputs.embedded(spark, d), inputs.embedded_truth(spark, d), _size(spark, d)
    recall = lambda r: metrics.per_query(metrics.judged(r, truth), [K], K, n).agg(F.avg(f"recall_{K}").alias("recall"))
    q, index, exact = e.where(inputs.is_query("id")), ann.CellIndex.fit(e), s.write(_cosine(spark, d))
    trials = None
    for probes in (8, 24, 32):
        found = s.write(index.search(q, e, K, probes))
        a = ann.agreement(exact, found, K).agg(F.lit(probes).alias("setting"), F.avg("agreement").alias("agreement")).crossJoin(recall(found))
        trials = a if trials is None else trials.unionByName(a)
    return ann.accepted_setting(trials, recall(exact).first()[0])


# ---- retrieval metrics


def _judged(spark, d):
    return metrics.judged(_cosine(spark, d), inputs.embedded_truth(spark, d))


def _size(spark, d):
    return table(spark, d, "embeddings").count()


def retrieval_metrics(spark, d):
    q = metrics.per_query(_judged(spark, d), [1, 5, 10, 20], 20, _size(spark, d))
    return rounded(metrics.retrieval_metrics(q, [1, 5, 10, 20], 20))


def retrieval_curve(spark, d):
    j = Scratch(spark, "curve").write(_judged(spark, d))
    return rounded(metrics.retrieval_curve(j, [1, 5, 10, 20], _size(spark, d)))


def select_candidate_k(spark, d):
    j = Scratch(spark, "curve").write(_judged(spark, d))
    return metrics.select_k(metrics.retrieval_curve(j, [1, 5, 10, 20], _size(spark, d)), 0.95)


def _title_judged(spark, d):
    """Title ranking of the listings whose label group has another row, with strata of each query."""
    s = Scratch(spark, "titles")
    rows = table(spark, d, "listing")
    truth = rows.where("label_group is not null and title is not null").select(F.col("row_number").alias("id"), F.col("label_group").alias("label"))
    j = metrics.judged(s.write(_tfidf(spark, d)), truth).where("positives > 0")
    return s.write(metrics.per_query(j, [K], K, rows.count()))


def stratified_metrics(spark, d):
    """Title retrieval by size of the label group and length of the title."""
    rows = table(spark, d, "listing")
    sizes = rows.where("label_group is not null and title is not null").groupBy(F.col("label_group").alias("label")).agg(F.count("*").alias("n"))
    q = _title_judged(spark, d).join(sizes, "label").join(rows.select(F.col("row_number").alias("query_id"), F.length(T.feature_title("title")).alias("len")), "query_id")
    q = q.select("*", group_size_band(F.col("n")).alias("size_band"), normalized_length_band(F.col("len")).alias("length_band"))
    return rounded(metrics.retrieval_metrics(q, [K], K, ["size_band", "length_band"]))


def failure_strata(spark, d):
    rows = table(spark, d, "listing")
    sizes = rows.where("label_group is not null and title is not null").groupBy(F.col("label_group").alias("label")).agg(F.count("*").alias("n"))
    twin = rows.where("label_group is not null and image_phash is not null").groupBy("label_group", "image_phash").agg((F.count("*") > 1).alias("twin"))
    own = rows.join(twin, ["label_group", "image_phash"], "left").select(F.col("row_number").alias("query_id"), F.length("title").alias("len"), F.coalesce("twin", F.lit(False)).alias("twin"))
    q = _title_judged(spark, d).join(sizes, "label").join(own, "query_id")
    q = q.select("*", group_size_band(F.col("n")).alias("size_band"), title_length_band(F.col("len")).alias("length_band"))
    return rounded(metrics.group_strata(q, {"group_size": "size_band", "title_length": "length_band", "same_phash_positive": "twin"}, K))


def failure_kinds(spark, d):
    return metrics.failure_kinds(_title_judged(spark, d), K)


def first_and_all_misses(spark, d):
    return metrics.first_and_all_misses(_judged(spark, d))


def validation_bundle(spark, d):
    j = Scratch(spark, "bundle").write(_judged(spark, d))
    return rounded(metrics.validation_bundle(j, [1, 5, 10, 20], 20, _size(spark, d)))


def base_ablations(spark, d):
    """mAP of each modality alone and of their equal fusion."""
    truth, n = inputs.embedded_truth(spark, d), _size(spark, d)
    out = None
    for name, r in (("image", _half(spark, d, "image")), ("text", _half(spark, d, "text")), ("simple", _fused_halves(spark, d, 0.5))):
        one = metrics.per_query(metrics.judged(r, truth), [K], K, n).agg(F.lit(name).alias("ranking"), F.avg(f"ap_{K}").alias("map"), F.avg(f"recall_{K}").alias("recall"))
        out = one if out is None else out.unionByName(one)
    return rounded(out)


def stored_topk(spark, d):
    """The exact ranking from an index that was stored and read again."""
    s, e = Scratch(spark, "stored"), inputs.embedded(spark, d)
    index = stored.StoredExact.save(e, f"{s.root}/exact")
    return rounded(index.search(e.where(inputs.is_query("id")), K))


def best_positive(spark, d):
    """Rank and score 0 where no right candidate was found."""
    return rounded(metrics.best_positive(_judged(spark, d)).fillna(0))


def review_examples(spark, d):
    """Rank 0 where no right candidate was found."""
    return metrics.review_examples(_judged(spark, d), 10).fillna(0)


def _judged_total(spark, d):
    """The judged ranking and the positives of its queries; a query has candidates whenever there is another row."""
    j = Scratch(spark, "judged").write(_judged(spark, d))
    return j, metrics.asked_positives(j)


def pair_metrics(spark, d):
    return rounded(metrics.pair_metrics_at(*_judged_total(spark, d), 0.3))


def _points(spark, d):
    return metrics.threshold_points(*_judged_total(spark, d))


def select_threshold(spark, d):
    return rounded(metrics.select_threshold(_points(spark, d)))


def precision_at_recall(spark, d):
    """Over the scored pairs, within the candidates; the reference asks for a recall of 0.8."""
    p = pairs.labelled(_pairs(spark, d), inputs.listing_labels(spark, d))
    j = Scratch(spark, "judged").write(p.select(F.col("pair_probability").alias("score"), F.col("positive").alias("hit")))
    return rounded(metrics.precision_at_recall(metrics.threshold_points(j, j.agg(F.sum("hit").alias("total"))), 0.8))


def threshold_curve(spark, d):
    return rounded(metrics.threshold_curve(*_judged_total(spark, d)))


def _weights(spark, d):
    truth, n = inputs.embedded_truth(spark, d), _size(spark, d)
    out = None
    for w in (0.0, 0.25, 0.5, 0.75, 1.0):
        q = metrics.per_query(metrics.judged(_fused_halves(spark, d, w), truth), [K], K, n)
        one = q.agg(F.lit(w).alias("weight"), F.avg(f"ap_{K}").alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


def fusion_weight_selection(spark, d):
    return rounded(metrics.select_weight(_weights(spark, d)))


def _row_tokens(spark, d):
    """``id, tokens``: the quantity tokens of the listing whose row has the number of a vector."""
    return inputs.titled(spark, d).select("id", T.identity_tokens("norm").alias("tokens"))


def modality_review(spark, d):
    truth = inputs.embedded_truth(spark, d)
    out = None
    for name, r in (("image", _half(spark, d, "image")), ("text", _half(spark, d, "text")), ("simple", _fused_halves(spark, d, 0.5)), ("pair", _cosine(spark, d))):
        one = metrics.judged(r, truth).groupBy("query_id").agg(
            (F.max(F.when(F.col("rank") == 1, F.col("hit"))) == 1).alias(name), F.max(F.when(F.col("rank") == 1, F.col("candidate_id"))).alias(f"{name}_top"), (F.max("hit") == 1).alias(f"{name}_any")
        )
        out = one if out is None else out.join(one, "query_id")
    tokens = _row_tokens(spark, d)
    both = out.join(tokens.select(F.col("id").alias("query_id"), F.col("tokens").alias("qt")), "query_id", "left").join(
        tokens.select(F.col("id").alias("pair_top"), F.col("tokens").alias("ct")), "pair_top", "left"
    )
    none = F.array().cast("array<string>")
    return metrics.modality_review(both.withColumn("conflict", T.variant_conflict(F.coalesce("qt", none), F.coalesce("ct", none))))


# ---- audit


def duplicate_audit(spark, d):
    rows = table(spark, d, "listing")
    ids = audit.repeated(rows, "posting_id").select(F.lit("posting_id").alias("kind"), "duplicates")
    full = audit.repeated(rows, "posting_id", "image", "image_phash", "title", "label_group").select(F.lit("row").alias("kind"), "duplicates")
    return ids.unionByName(full)


def cross_label_buckets(spark, d):
    rows = inputs.train_with_images(spark, d)
    return audit.cross_label_buckets(rows, {"image": F.col("image"), "sha256": F.col("sha256"), "image_phash": F.lower("image_phash"), "title": T.audit_title("title")})


def group_sizes(spark, d):
    return audit.size_distribution(table(spark, d, "listing"))


def quantiles(spark, d):
    return audit.nearest_rank_quantiles(table(spark, d, "listing"), {"characters": F.length("title"), "tokens": F.size(F.split(T.feature_title("title"), " "))})


def image_quantiles(spark, d):
    images = table(spark, d, "image_record").distinct()
    return audit.nearest_rank_quantiles(images, {"width": F.col("width"), "height": F.col("height"), "file_bytes": F.col("file_bytes")})


def length_histogram(spark, d):
    return audit.labelled_histogram(table(spark, d, "listing"), F.length("title"), [0, 20, 40, 60, 80, 120])


def script_presence(spark, d):
    return audit.script_presence(table(spark, d, "listing"))


def title_counts(spark, d):
    return audit.title_counts(table(spark, d, "listing"), "title", "image", "image_phash")


def image_audit(spark, d):
    return audit.image_dimensions(table(spark, d, "image_record"))


RULES = {
    "duplicate_posting": ("critical", "postings occur more than once"), "image_shared_by_labels": ("warning", "an image stands under several labels"),
    "missing_image": ("critical", "a named image is not there"), "unreadable_image": ("warning", "an image cannot be read"),
}


def audit_findings(spark, d):
    rows, images = table(spark, d, "train"), table(spark, d, "image_record")
    count = lambda df, code: df.select(F.lit(code).alias("code"), F.col(df.columns[0]).cast("long").alias("n"))
    counts = count(audit.repeated(rows, "posting_id"), "duplicate_posting")
    shared = audit.cross_label_buckets(rows.distinct(), {"image": F.col("image")}).select("buckets")
    missing = rows.where("image is not null").select("image").distinct().join(images, "image", "left_anti").agg(F.count("*"))
    broken = images.where("sha256 is null").select("image").distinct().agg(F.count("*"))
    for df, code in ((shared, "image_shared_by_labels"), (missing, "missing_image"), (broken, "unreadable_image")):
        counts = counts.unionByName(count(df, code))
    return audit.audit_findings(counts, RULES)


def audit_status(spark, d):
    return audit.audit_status(audit_findings(spark, d))


def similarity_diagnostics(spark, d):
    j = _judged(spark, d).withColumn("kind", F.when(F.col("hit") == 1, "positive").otherwise("negative"))
    return rounded(audit.linear_quantiles(j, "score", "kind", {"p05": 0.05, "p50": 0.5, "p95": 0.95}))


# ---- titles


def normalized_titles(spark, d):
    rows = table(spark, d, "listing").where("title is not null")
    return rows.select("row_number", T.feature_title("title").alias("feature_title"), T.audit_title("title").alias("audit_title"), T.folded_title("title").alias("folded_title"), T.shown_title("title").alias("shown_title"))


def plain_titles(spark, d):
    return inputs.titled(spark, d).select(F.col("id").alias("row_number"), "norm")


def identity_tokens(spark, d):
    t = inputs.titled(spark, d)
    tokens = T.identity_tokens("norm")
    return t.select(F.col("id").alias("row_number"), F.array_join(tokens, "|").alias("tokens"), F.size(tokens).alias("n_tokens"))


def variant_conflicts(spark, d):
    titles = table(spark, d, "listing").where("title is not null").groupBy("posting_id").agg(F.min("title").alias("title"))
    t = titles.select("posting_id", T.identity_tokens(T.feature_title("title")).alias("tokens"))
    p = pairs.usable_pairs(table(spark, d, "scored_pair")).select("left_posting_id", "right_posting_id")
    met = p.join(t.select(F.col("posting_id").alias("left_posting_id"), F.col("tokens").alias("l")), "left_posting_id").join(
        t.select(F.col("posting_id").alias("right_posting_id"), F.col("tokens").alias("r")), "right_posting_id"
    )
    return met.groupBy(T.variant_conflict(F.col("l"), F.col("r")).alias("conflict")).agg(F.count("*").alias("n_pairs"))


def digit_unit_tokens(spark, d):
    one = inputs.titled(spark, d).select("id", T.digit_unit_tokens("norm").alias("t"))
    return one.select(F.col("id").alias("row_number"), F.array_join("t.digits", "|").alias("digits"), F.array_join("t.units", "|").alias("units"))


def character_vocabulary(spark, d):
    return models.character_vocabulary(inputs.titled(spark, d), 5, 200)


def unknown_rate(spark, d):
    t = inputs.titled(spark, d)
    return rounded(models.unknown_rate(t, models.character_vocabulary(t, 50, 60)))


# ---- components and splits


def _components(spark, d):
    rows = inputs.train_with_images(spark, d)
    return splits.label_components(rows, {"image": F.col("image"), "sha": F.col("sha256"), "phash": phash_bits("image_phash").cast("string")})


def label_components(spark, d):
    return _components(spark, d)


def split_assignment(spark, d):
    return splits.assign_splits(Scratch(spark, "components").write(_components(spark, d)))


def split_integrity(spark, d):
    s = Scratch(spark, "components")
    c = s.write(_components(spark, d))
    rows = inputs.train_with_images(spark, d).join(c, "label_group").join(s.write(splits.assign_splits(c)), "component_id")
    return splits.split_integrity(rows, {"label_group": F.col("label_group"), "image": F.col("image"), "image_phash": phash_bits("image_phash"), "sha256": F.col("sha256")})


# ---- pairs


def candidate_pairs(spark, d):
    return rounded(pairs.fold_directed(_cosine(spark, d), K))


def _pairs(spark, d):
    return pairs.usable_pairs(table(spark, d, "scored_pair"))


def usable_pairs(spark, d):
    return rounded(_pairs(spark, d))


def edge_gates(spark, d):
    return pairs.gated_pairs(_pairs(spark, d), **GATES).groupBy("gate").agg(F.count("*").alias("n_pairs"))


def reverse_rank(spark, d):
    e = inputs.embedded(spark, d)
    top = _cosine(spark, d, 5).join(e.select(F.col("id").alias("candidate_id"), F.col("v").alias("cv")), "candidate_id")
    return pairs.reverse_ranks(top, e)


def pair_policy(spark, d):
    p = table(spark, d, "scored_pair")
    s = pairs.online_policy(F.coalesce("pair_probability", F.lit(0.0)), F.col("left_rank"), F.col("right_rank"), F.coalesce("variant_conflict", F.lit(False)), **GATES)
    return p.select(s.alias("p")).groupBy("p.accepted", "p.reason").agg(F.count("*").alias("n_pairs"))


def edge_metrics(spark, d):
    truth = inputs.listing_labels(spark, d)
    kept = pairs.gated_pairs(_pairs(spark, d), **GATES).where("gate = 'eligible'")
    return rounded(pairs.edge_metrics(pairs.labelled(kept, truth), truth))


def candidate_classification(spark, d):
    p = Scratch(spark, "pairs").write(pairs.labelled(_pairs(spark, d), inputs.listing_labels(spark, d)))
    return rounded(pairs.classification_metrics(p, threshold=0.5, bins=10, recall_floor=0.5, precision_floor=0.8))


# ---- clusters


def _clusters(spark, d, settings):
    return clusters.conservative_clusters(_pairs(spark, d), settings)


def _assigned(spark, d):
    s = Scratch(spark, "assigned")
    ids = table(spark, d, "listing").select("posting_id")
    return clusters.numbered_entities(s.write(clusters.with_singletons(_clusters(spark, d, [SETTING]), ids)))


def conservative_clusters(spark, d):
    return rounded(_assigned(spark, d))


def conservative_invariants(spark, d):
    """Every posting is in one entity, none is larger than allowed, and what an entity says of itself holds for all its postings."""
    a = Scratch(spark, "invariants").write(_assigned(spark, d))
    by = a.groupBy("entity_id").agg(
        F.count("*").alias("n"), F.min("cluster_size").alias("low"), F.max("cluster_size").alias("high"), F.min("cluster_confidence").alias("c"), F.max("cluster_confidence").alias("d")
    )
    wrong = by.agg(
        F.sum((F.col("n") > SETTING["most"]).cast("long")).alias("oversized"),
        F.sum(((F.col("n") != F.col("low")) | (F.col("n") != F.col("high")) | (F.col("c") != F.col("d"))).cast("long")).alias("torn"),
    )
    return a.agg(F.count_distinct("posting_id").alias("postings"), (F.count("*") - F.count_distinct("posting_id")).alias("repeated")).crossJoin(F.broadcast(wrong))


def cluster_diagnostics(spark, d):
    return sweep.diagnostics(sweep.policy_results(_pairs(spark, d), None, SWEEP))


def cluster_sweep(spark, d):
    found = sweep.quality(sweep.policy_results(_pairs(spark, d), inputs.listing_labels(spark, d), SWEEP))
    rows = [(i, x["name"], float(x["threshold"]), x["reciprocal"], float(x["coverage"])) for i, x in enumerate(SWEEP)]
    named = spark.createDataFrame(rows, "setting int, name string, threshold double, reciprocal int, coverage double")
    return rounded(found.join(F.broadcast(named), "setting").select(*named.columns, "pairwise_precision", "pairwise_recall", "pairwise_f1", "b_cubed_f1", "false_split_group_rate", "clusters"))


def selected_policy(spark, d):
    return clusters.select_policy(cluster_sweep(spark, d), MINIMUM_PRECISION)


def _earlier(spark, d):
    """The earlier run's assignments, one row per posting with an entity."""
    a = table(spark, d, "cluster_assignment").where("entity_id is not null")
    return a.groupBy("posting_id").agg(F.min("entity_id").alias("entity_id"), F.max("manual_review").alias("manual_review"))


def _table(spark, d):
    return clusters.contingency(_earlier(spark, d), inputs.listing_labels(spark, d))


def cluster_metrics(spark, d):
    return rounded(clusters.cluster_metrics(_table(spark, d)))


def group_recovery(spark, d):
    return rounded(clusters.group_recovery(_table(spark, d)))


def cluster_failures(spark, d):
    return clusters.failure_review(_table(spark, d), _earlier(spark, d))


# ---- mining and sampling


def _candidates(spark, d):
    rows = table(spark, d, "listing").where("label_group is not null").groupBy("posting_id").agg(
        F.min("label_group").alias("label"), F.min(F.lower("image_phash")).alias("phash"), F.min("title").alias("title")
    )
    t = rows.select("posting_id", "label", "phash", T.feature_title("title").alias("title"))
    p = table(spark, d, "scored_pair").where("right_posting_id is not null and pair_probability is not null and left_posting_id <> right_posting_id")
    one = p.groupBy(F.col("left_posting_id").alias("query_id"), F.col("right_posting_id").alias("candidate_id")).agg(F.max(F.struct("pair_probability", "cosine_similarity")).alias("s"))
    one = one.select("query_id", "candidate_id", "s.pair_probability", "s.cosine_similarity")
    side = lambda n: t.select(F.col("posting_id").alias(f"{n}_id"), *[F.col(c).alias(f"{n}_{c}") for c in ("label", "phash", "title")])
    met = one.join(side("query"), "query_id").join(side("candidate"), "candidate_id")
    conflict = T.variant_conflict(T.identity_tokens(F.coalesce("query_title", F.lit(""))), T.identity_tokens(F.coalesce("candidate_title", F.lit(""))))
    return mining.excluded(met.withColumn("variant_conflict", conflict), low=0.05, high=0.95)


def _mined(spark, d):
    s = Scratch(spark, "mining")
    c = s.write(_candidates(spark, d))
    chosen = s.write(mining.per_query_quota(c.where("outcome = 'eligible'"), 5, 0.5))
    one = s.write(mining.undirected_strongest(chosen))
    return c, chosen, one, mining.cap_variants(one, 0.3)


def hard_negatives(spark, d):
    return rounded(_mined(spark, d)[1].select("query_id", "candidate_id", "pair_probability", "cosine_similarity", "variant_conflict"))


def dedup_pairs(spark, d):
    return rounded(_mined(spark, d)[2])


def cap_variants(spark, d):
    return rounded(_mined(spark, d)[3])


def mining_counts(spark, d):
    return mining.mining_counts(*_mined(spark, d))


def negative_batch(spark, d):
    return rounded(mining.negative_batch(_mined(spark, d)[3], 7, 0, 0, 64))


def _product_rows(spark, d):
    return table(spark, d, "train").where("label_group is not null").groupBy(F.col("posting_id").alias("id")).agg(F.min("label_group").alias("label"))


def product_batches(spark, d):
    return sampling.product_batches(_product_rows(spark, d), products=8, samples=3, batches=4, seed=7)


def balanced_pairs(spark, d):
    """Pairs of every batch of a batching of all rows."""
    s = Scratch(spark, "batch")
    return sampling.balanced_batches(s.write(sampling.row_batches(s.write(_product_rows(spark, d)), size=BATCH, seed=7)), ratio=2, seed=7)


def inspection_pairs(spark, d):
    rows = table(spark, d, "train").where("label_group is not null").groupBy(F.col("posting_id").alias("id")).agg(F.min("label_group").alias("label"), F.min("image").alias("image"))
    return sampling.inspection_pairs(rows, 20, 7)


def collision_samples(spark, d):
    return sampling.collision_samples(table(spark, d, "train").withColumn("label", F.col("label_group")), "image", 20, 7)


def mined_probabilities(spark, d):
    p = _mined(spark, d)[2]
    return rounded(p.agg(
        F.min("pair_probability").alias("minimum"), F.percentile("pair_probability", 0.5).alias("median"),
        F.percentile("pair_probability", 0.95).alias("p95"), F.max("pair_probability").alias("maximum"),
    ))


# ---- further joins, sets and orders


def rejected_metadata(spark, d):
    """Training rows by the first metadata rule they break."""
    bad = files.screened(table(spark, d, "train").select(*files.METADATA)).where("reject_reason is not null")
    return bad.groupBy("reject_reason").agg(F.count("*").alias("n_rows"))


def image_joins(spark, d):
    rows, images = table(spark, d, "train"), table(spark, d, "image_record").select("image", F.col("width").isNotNull().alias("readable")).distinct()
    named = rows.where("image is not null").select("image").distinct()
    matched = rows.join(images, "image").agg(F.lit("matched_rows").alias("kind"), F.count("*").alias("n"))
    missing = named.join(images, "image", "left_anti").agg(F.lit("missing_images").alias("kind"), F.count("*").alias("n"))
    unused = images.join(named, "image", "left_anti").agg(F.lit("unreferenced_images").alias("kind"), F.count("*").alias("n"))
    return matched.unionByName(missing).unionByName(unused)


def candidate_sets(spark, d):
    """Candidates that both modality rankings hold, and those of one only."""
    a, b = (_half(spark, d, n).select("query_id", "candidate_id") for n in ("image", "text"))
    count = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return count(a.intersect(b), "both").unionByName(count(a.exceptAll(b), "image_only")).unionByName(count(b.exceptAll(a), "text_only"))


def strongest_edges(spark, d):
    kept = pairs.gated_pairs(_pairs(spark, d), **GATES).where("gate = 'eligible'")
    return rounded(kept.orderBy(*pairs.strongest_first()).limit(50).select("left_posting_id", "right_posting_id", "pair_probability", "cosine_similarity"))


def digest_order(spark, d):
    """The first twenty postings in an order made from digests."""
    ids = table(spark, d, "listing").select("posting_id").distinct()
    return ids.withColumn("digest", stable_order(7, "posting_id")).orderBy("digest").limit(20)


def title_length_summary(spark, d):
    t = inputs.titled(spark, d).select(F.length("norm").alias("n"))
    q = audit.nearest_rank_quantiles(t, {"normalized_length": F.col("n")})
    cut = t.agg(F.lit("over_64").alias("measure"), F.lit("share").alias("quantile"), F.avg((F.col("n") > 64).cast("double")).alias("value"))
    return rounded(q.unionByName(cut))


def run_summary(spark, d):
    """Mean and population deviation over the runs of the weight grid."""
    return rounded(_weights(spark, d).agg(F.count("*").alias("runs"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std")))


def group_size_recall(spark, d):
    rows = table(spark, d, "listing")
    sizes = rows.where("label_group is not null and title is not null").groupBy(F.col("label_group").alias("label")).agg(F.count("*").alias("n"))
    q = _title_judged(spark, d).join(sizes, "label").groupBy(strict_size_band(F.col("n")).alias("band"))
    return rounded(q.agg(F.count("*").alias("queries"), F.avg(f"recall_{K}").alias("recall")))


def label_blind_test_rows(spark, d):
    """Rows of the test split without their labels, by semi join with the manifest."""
    s = Scratch(spark, "blind")
    c = s.write(_components(spark, d))
    rows = inputs.train_with_images(spark, d)
    manifest = rows.join(c, "label_group").join(splits.assign_splits(c), "component_id").select("posting_id", "split").distinct()
    return files.label_blind(files.one_split(rows, s.write(manifest), "test"))


def near_phash_cross_split(spark, d):
    """Near hashes whose label groups stand in different splits."""
    s = Scratch(spark, "near")
    c = s.write(_components(spark, d))
    rows = inputs.train_with_images(spark, d).join(c, "label_group").join(splits.assign_splits(c), "component_id")
    where = s.write(rows.select(F.lower(F.trim("image_phash")).alias("h"), "split").distinct())
    near = near_phash_pairs(spark, d)
    both = near.join(where.select(F.col("h").alias("left_phash"), F.col("split").alias("ls")), "left_phash").join(where.select(F.col("h").alias("right_phash"), F.col("split").alias("rs")), "right_phash")
    return both.where("ls <> rs").select("left_phash", "right_phash", "distance").distinct()


# ---- models and matching


def _title_vectors(spark, d):
    """``id, v`` of every title, with the reference's length and vocabulary: 510 characters besides padding and unknown."""
    s = Scratch(spark, "encoder")
    t = inputs.titled(spark, d)
    vocabulary = s.write(models.character_vocabulary(t, 2, 510))
    chars = vocabulary.agg(F.map_from_entries(F.collect_list(F.struct("token", "token_id"))).alias("vocab"))  # at most 510 entries
    ids = t.crossJoin(F.broadcast(chars)).select("id", T.encoded_title("norm", F.col("vocab"), 128).alias("ids"))
    return models.TextEncoder.seeded(512).embed(ids)


def text_embeddings(spark, d):
    return _title_vectors(spark, d).select(F.col("id").alias("row_number"), F.size("v").alias("width"), F.round(dot("v", "v"), 4).alias("length"))


def contrastive_loss(spark, d):
    """Mean over the batches of a batching of all vectors."""
    s = Scratch(spark, "loss")
    rows = s.write(inputs.embedded(spark, d).join(inputs.embedded_truth(spark, d), "id"))
    return rounded(models.contrastive_losses(s.write(sampling.row_batches(rows, size=BATCH, seed=7)), 0.1).agg(F.avg("loss").alias("loss")))


def pair_head(spark, d):
    s = Scratch(spark, "head")
    e, truth = inputs.embedded(spark, d), inputs.embedded_truth(spark, d)
    j = metrics.judged(s.write(_cosine(spark, d)), truth)
    v = lambda n, c: e.select(F.col("id").alias(n), F.col("v").alias(c))
    p = s.write(j.select(F.col("query_id").alias("left_id"), F.col("candidate_id").alias("right_id"), F.col("hit").alias("positive")).join(v("left_id", "lv"), "left_id").join(v("right_id", "rv"), "right_id"))
    scored = models.pair_probabilities(models.fit_pair_head(p), p)
    ranking = scored.select(F.col("left_id").alias("query_id"), F.col("right_id").alias("candidate_id"), F.col("pair_probability").alias("score"))
    return rounded(rankers.top_k(ranking, K))


def matcher_decisions(spark, d):
    e = inputs.embedded(spark, d)
    with_tokens = Scratch(spark, "tokens").write(e.join(_row_tokens(spark, d), "id", "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>"))))
    known = inputs.embedded_truth(spark, d).select("id", F.concat(F.lit("entity_"), "label").alias("entity_id"), (F.col("id") % 11 == 0).alias("manual_review"))
    _, decisions = matcher.match(with_tokens.where(inputs.is_query("id")), with_tokens, known, lambda c: sigmoid(10 * (c - 0.3)), k=5, threshold=0.4, reciprocal=10, override=0.6, margin=0.05)
    return rounded(decisions)


def streamed_arrivals(spark, d):
    """Arrivals per day through a stream that is read to its end."""
    from kinmatch.streaming.increments import arrivals

    s = Scratch(spark, "stream")
    path = f"{d}/listing.parquet"
    schema = spark.read.parquet(path).schema
    one_file = spark.read.parquet(path).inputFiles()[0].endswith("/listing.parquet")
    stream = spark.readStream.schema(schema).parquet(f"{d}/listing*.parquet" if one_file else path)
    stream = stream.withColumn("ingested_at", F.col("ingested_at").cast("timestamp"))
    out = f"{s.root}/out"
    q = (
        arrivals(stream, "1 day", "3650 days").writeStream.outputMode("complete").option("checkpointLocation", f"{s.root}/state").trigger(availableNow=True)
        .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(out)).start()
    )
    q.awaitTermination()
    return spark.read.parquet(out).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "listings")


_ALL = (
    exact_topk_cosine, stored_topk, first_and_all_misses, validation_bundle, base_ablations, phash_topk, near_phash_pairs, char_ngrams, tfidf_vocabulary, tfidf_weights, tfidf_topk, modality_score_fusion,
    candidate_union, fuse_rankings, invalid_ranking_rows, ranking_lists, ann_topk, ranking_agreement, ann_disagreements, ann_gate,
    retrieval_metrics, retrieval_curve, select_candidate_k, stratified_metrics, failure_strata, failure_kinds, best_positive, review_examples,
    pair_metrics, select_threshold, precision_at_recall, threshold_curve, fusion_weight_selection, modality_review,
    duplicate_audit, cross_label_buckets, group_sizes, quantiles, image_quantiles, length_histogram, script_presence, title_counts, image_audit,
    audit_findings, audit_status, similarity_diagnostics, normalized_titles, plain_titles, identity_tokens, variant_conflicts, digit_unit_tokens,
    character_vocabulary, unknown_rate, label_components, split_assignment, split_integrity, candidate_pairs, usable_pairs, edge_gates,
    reverse_rank, pair_policy, edge_metrics, candidate_classification, conservative_clusters, conservative_invariants, cluster_diagnostics, cluster_sweep,
    selected_policy, cluster_metrics, group_recovery, cluster_failures, hard_negatives, dedup_pairs, cap_variants, mining_counts,
    mined_probabilities, rejected_metadata, image_joins, candidate_sets, strongest_edges, digest_order, title_length_summary, run_summary,
    group_size_recall, label_blind_test_rows, near_phash_cross_split, negative_batch, product_batches, balanced_pairs, inspection_pairs, collision_samples, text_embeddings, contrastive_loss, pair_head,
    matcher_decisions, streamed_arrivals,
)


def _shipped(f: Callable) -> Callable:
    def run(spark: SparkSession, d: str) -> DataFrame:
        ship(spark)
        return f(spark, d)

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: _shipped(f) for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()


