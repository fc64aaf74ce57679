"""SQL of the core queries, over the same tables."""

from __future__ import annotations

from kinmatch.functions.titles import DIGITS, IDENTITY, WHOLE_UNITS

# compatibility forms of the tables' titles: full-width signs, letters and digits; blanks are collapsed anyway
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_CHEROKEE = "".join(map(chr, range(0xAB70, 0xABC0))), "".join(map(chr, range(0x13A0, 0x13F0)))
_NARROW = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
_TOKENS = f"list_sort(list_distinct(regexp_extract_all({{n}}, '{IDENTITY}')))"


def _compatible(t: str) -> str:
    return f"nfc_normalize(replace(replace(replace(translate({t}, '{_WIDE}', '{_NARROW}'), chr(8209), chr(8208)), chr(64257), 'fi'), chr(64258), 'fl'))"


def plain(t: str) -> str:
    one = f"nfc_normalize(lower({_compatible(t)}))"
    one = f"translate({one}, '{_CHEROKEE[0]}', '{_CHEROKEE[1]}')"  # folds to its capitals
    return rf"trim(regexp_replace(replace({one}, 'ß', 'ss'), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


def tokens(n: str) -> str:
    return _TOKENS.format(n=n)


def _unit(name: str, source: str, expr: str) -> str:
    return f"""
  {name}_r AS (SELECT id, list_transform({expr}, lambda x: x::DOUBLE) AS r FROM {source}),
  {name}_n AS (SELECT id, r, sqrt(list_inner_product(r, r)) AS l FROM {name}_r),
  {name} AS (SELECT id, list_transform(r, lambda x: x / l) AS v FROM {name}_n)"""


_EMB = "em AS (SELECT vec_id AS id, label, embedding FROM embeddings)"
_VEC = f"WITH {_EMB}, {_unit('u', 'em', 'embedding')}"
_HALVES = f"WITH {_EMB}, {_unit('im', 'em', 'embedding[1:32]')}, {_unit('tx', 'em', 'embedding[33:64]')}"


def _search(name: str, source: str, k: int) -> str:
    return f"""
  {name} AS (
    SELECT q.id AS query_id, c.id AS candidate_id, list_inner_product(q.v, c.v) AS score,
           row_number() OVER (PARTITION BY q.id ORDER BY list_inner_product(q.v, c.v) DESC, c.id) AS rank
    FROM {source} q JOIN {source} c ON q.id <> c.id WHERE q.id % 20 = 0 QUALIFY rank <= {k})"""


def _fused(name: str, w: float, k: int) -> str:
    score = f"{w} * list_inner_product(qi.v, ci.v) + {1 - w} * list_inner_product(qt.v, ct.v)"
    return f"""
  {name} AS (
    SELECT query_id, candidate_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) AS rank FROM (
      SELECT qi.id AS query_id, ci.id AS candidate_id, {score} AS score
      FROM im qi JOIN tx qt ON qi.id = qt.id JOIN im ci ON qi.id <> ci.id JOIN tx ct ON ci.id = ct.id WHERE qi.id % 20 = 0) QUALIFY rank <= {k})"""


def _judged(name: str, ranking: str) -> str:
    return f"""
  {name} AS (
    SELECT r.*, q.label, (q.label = c.label)::INT AS hit, s.n - 1 AS positives
    FROM {ranking} r JOIN em q ON r.query_id = q.id JOIN em c ON r.candidate_id = c.id
    JOIN (SELECT label, count(*) AS n FROM em GROUP BY label) s ON q.label = s.label)"""


def _per_query(name: str, judged: str, ks: list[int], ap: int) -> str:
    n = "(SELECT count(*) FROM embeddings)"
    cols = []
    for k in ks:
        f = f"sum(CASE WHEN rank <= {k} THEN hit ELSE 0 END)"
        p, r = f"({f} / least({k}, {n} - 1)::DOUBLE)", f"({f} / any_value(positives)::DOUBLE)"
        cols += [
            f"({f} > 0)::DOUBLE AS hit_rate_{k}", f"{r} AS recall_{k}", f"{p} AS precision_{k}",
            f"CASE WHEN {p} + {r} = 0 THEN 0 ELSE 2 * {p} * {r} / ({p} + {r}) END AS f1_{k}",
        ]
    return f"""
  {name}_c AS (SELECT *, sum(hit) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS hits FROM {judged}),
  {name} AS (SELECT query_id, label, sum(CASE WHEN hit = 1 AND rank <= {ap} THEN hits / rank::DOUBLE ELSE 0 END) / least(any_value(positives), {ap}) AS ap, {', '.join(cols)}
    FROM {name}_c GROUP BY query_id, label)"""


_J = f"{_VEC}, {_search('r', 'u', 20)}, {_judged('j', 'r')}"
_TOTAL = "(SELECT sum(p)::BIGINT FROM (SELECT any_value(positives) AS p FROM j GROUP BY query_id))"


def _rates(tp: str, fp: str, total: str) -> str:
    p, r = f"(CASE WHEN {tp} > 0 THEN {tp} / ({tp} + {fp})::DOUBLE ELSE 0 END)", f"({tp} / {total}::DOUBLE)"
    return f"{p} AS precision, {r} AS recall, CASE WHEN {p} + {r} = 0 THEN 0 ELSE 2 * {p} * {r} / ({p} + {r}) END AS f1, {tp} AS true_positive, {fp} AS false_positive, {total} - {tp} AS false_negative"


def _points(judged: str, total: str) -> str:
    return f"""b AS (SELECT score, sum(hit)::BIGINT AS tp, sum(1 - hit)::BIGINT AS fp FROM {judged} GROUP BY score),
  c AS (SELECT score, sum(tp) OVER (ORDER BY score DESC)::BIGINT AS tp, sum(fp) OVER (ORDER BY score DESC)::BIGINT AS fp FROM b),
  points AS (SELECT score AS threshold, {_rates('tp', 'fp', total)} FROM c)"""


_POINTS = f"{_J}, {_points('j', _TOTAL)}"
_SIX = "round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, true_positive, false_positive, false_negative"

_TITLES = f"t AS (SELECT row_number AS id, {plain('title')} AS norm FROM listing WHERE title IS NOT NULL)"


def _grams(low: int, high: int) -> str:
    return f"""
  {_TITLES},
  w AS (SELECT id, ' ' || unnest(list_filter(string_split(norm, ' '), lambda x: x <> '')) || ' ' AS p FROM t),
  ns AS (SELECT unnest(range({low}, {high + 1})) AS n),
  g AS (SELECT id, substr(p, unnest(range(1, length(p) - n + 2))::INT, n::INT) AS gram FROM w CROSS JOIN ns WHERE length(p) >= n)"""


def _vocabulary(most: int) -> str:
    return f"""
  df AS (SELECT gram, count(DISTINCT id) AS df FROM g GROUP BY gram ORDER BY df DESC, gram LIMIT {most}),
  vocab AS (SELECT gram, df, row_number() OVER (ORDER BY gram) - 1 AS feature_id, ln((1 + (SELECT count(*) FROM t)) / (1 + df)::DOUBLE) + 1 AS idf FROM df)"""


_TFIDF = f"""WITH {_grams(2, 5)}, {_vocabulary(100_000)},
  tf AS (SELECT id, feature_id, (1 + ln(count(*))) * any_value(idf) AS w FROM g JOIN vocab USING (gram) GROUP BY id, feature_id),
  ln_ AS (SELECT id, sqrt(sum(w * w)) AS l FROM tf GROUP BY id),
  x AS (SELECT id, feature_id, w / l AS weight FROM tf JOIN ln_ USING (id))"""

_IMAGES = """
  ti AS (SELECT DISTINCT posting_id, image, image_phash, title, label_group FROM train),
  tr AS (SELECT ti.*, i.sha256 FROM ti LEFT JOIN (SELECT image, min(sha256) AS sha256 FROM image_record GROUP BY image) i USING (image))"""

_HEX = "regexp_matches(image_phash, '^[0-9a-fA-F]{16}$')"
_BITS = "list_reduce(list_transform(string_split(lower({c}), ''), lambda h: (strpos('0123456789abcdef', h) - 1)::UBIGINT), lambda a, b: (a << 4) | b)"

_QUANT = "(('minimum', 0.0), ('p25', 0.25), ('median', 0.5), ('p75', 0.75), ('p95', 0.95), ('p99', 0.99), ('maximum', 1.0))"


def _quantiles(union: str) -> str:
    return f"""
  WITH m AS ({union}),
  o AS (SELECT measure, value, row_number() OVER (PARTITION BY measure ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY measure) AS n FROM m WHERE value IS NOT NULL),
  q AS (SELECT * FROM (VALUES {_QUANT[1:-1]}) AS q(quantile, p))
  SELECT measure, quantile, value::DOUBLE AS value FROM o JOIN q ON o.i = round_even(((n - 1) * p)::DOUBLE, 0)"""


_PAIRS = """
  up AS (
    SELECT * FROM (
      SELECT least(left_posting_id, right_posting_id) AS left_posting_id, greatest(left_posting_id, right_posting_id) AS right_posting_id, cosine_similarity, pair_probability,
             CASE WHEN left_posting_id > right_posting_id THEN right_rank ELSE left_rank END AS left_rank,
             CASE WHEN left_posting_id > right_posting_id THEN left_rank ELSE right_rank END AS right_rank, coalesce(variant_conflict, false) AS variant_conflict
      FROM scored_pair WHERE left_posting_id IS NOT NULL AND right_posting_id IS NOT NULL AND pair_probability IS NOT NULL AND left_posting_id <> right_posting_id)
    QUALIFY row_number() OVER (PARTITION BY left_posting_id, right_posting_id ORDER BY pair_probability DESC, cosine_similarity DESC, left_rank, right_rank, variant_conflict DESC) = 1)"""
_GATE = """CASE WHEN pair_probability < 0.5 THEN 'below_probability' WHEN greatest(left_rank, right_rank) > 10 THEN 'non_reciprocal'
    WHEN variant_conflict AND pair_probability < 0.8 THEN 'variant_conflict_rejected' ELSE 'eligible' END"""
_LABELS = "lb AS (SELECT posting_id AS id, min(label_group) AS label FROM listing WHERE label_group IS NOT NULL GROUP BY posting_id)"
_LABELLED = "lp AS (SELECT {p}.*, (a.label = b.label)::INT AS y FROM {p} JOIN lb a ON left_posting_id = a.id JOIN lb b ON right_posting_id = b.id)"

_CONT = f"""{_LABELS},
  ea AS (SELECT posting_id, min(entity_id) AS entity_id FROM cluster_assignment WHERE entity_id IS NOT NULL GROUP BY posting_id),
  ct AS (SELECT entity_id AS entity, label, count(*) AS n FROM ea JOIN lb ON posting_id = id GROUP BY ALL)"""

_MINE = f"""
  mr AS (SELECT posting_id, min(label_group) AS label, min(lower(image_phash)) AS phash, min(title) AS title FROM listing WHERE label_group IS NOT NULL GROUP BY posting_id),
  mt AS (SELECT posting_id, label, phash, {plain('title')} AS title FROM mr),
  mk AS (SELECT *, {tokens("coalesce(title, '')")} AS tok FROM mt),
  mp AS (SELECT left_posting_id AS query_id, right_posting_id AS candidate_id, pair_probability, cosine_similarity FROM scored_pair
         WHERE right_posting_id IS NOT NULL AND pair_probability IS NOT NULL AND left_posting_id <> right_posting_id
         QUALIFY row_number() OVER (PARTITION BY left_posting_id, right_posting_id ORDER BY pair_probability DESC, cosine_similarity DESC) = 1),
  mc AS (SELECT mp.*, q.label AS query_label, c.label AS candidate_label, (len(q.tok) + len(c.tok) > 0) AND q.tok <> c.tok AS variant_conflict,
         CASE WHEN q.label = c.label THEN 'excluded_same_label' WHEN NOT pair_probability BETWEEN 0.05 AND 0.95 THEN 'excluded_probability'
              WHEN q.phash = c.phash THEN 'excluded_same_phash' WHEN q.title = c.title THEN 'excluded_exact_title' ELSE 'eligible' END AS outcome
         FROM mp JOIN mk q ON query_id = q.posting_id JOIN mk c ON candidate_id = c.posting_id),
  ms AS (SELECT *, row_number() OVER (PARTITION BY query_id, variant_conflict ORDER BY pair_probability DESC, cosine_similarity DESC, candidate_id) AS place FROM mc WHERE outcome = 'eligible'),
  mq AS (SELECT query_id, sum((variant_conflict AND place <= 2)::INT) AS kept FROM ms GROUP BY query_id),
  hn AS (SELECT query_id, candidate_id, pair_probability, cosine_similarity, variant_conflict, query_label, candidate_label FROM ms JOIN mq USING (query_id)
         WHERE CASE WHEN variant_conflict THEN place <= 2 ELSE place <= 5 - kept END),
  dd AS (SELECT least(query_id, candidate_id) AS left_posting_id, greatest(query_id, candidate_id) AS right_posting_id,
         CASE WHEN query_id > candidate_id THEN candidate_label ELSE query_label END AS left_label_group, CASE WHEN query_id > candidate_id THEN query_label ELSE candidate_label END AS right_label_group,
         cosine_similarity, pair_probability, variant_conflict FROM hn
         QUALIFY row_number() OVER (PARTITION BY least(query_id, candidate_id), greatest(query_id, candidate_id) ORDER BY pair_probability DESC, cosine_similarity DESC) = 1),
  cv AS (SELECT * EXCLUDE (o) FROM (SELECT *, row_number() OVER (PARTITION BY variant_conflict ORDER BY pair_probability DESC, cosine_similarity DESC, left_posting_id, right_posting_id) AS o FROM dd)
         WHERE NOT variant_conflict OR o <= (SELECT floor(0.3 * count(*) / 0.7) FROM dd WHERE NOT variant_conflict))"""
_MINED = "left_posting_id, right_posting_id, left_label_group, right_label_group, round(cosine_similarity, 6) AS cosine_similarity, round(pair_probability, 6) AS pair_probability, variant_conflict"


def _batches(own: str) -> str:
    """Rows ``id, label`` in batches of about 256, two of a label together."""
    return f"""pl AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY sha256('7:' || id), id) - 1 AS place, count(*) OVER (PARTITION BY label) AS m FROM {own} WHERE id IS NOT NULL AND label IS NOT NULL),
  rb AS (SELECT id, label, (('0x' || substr(sha256('7:' || label || ':' || greatest(0, least(place // 2, m // 2 - 1))), 1, 8))::BIGINT % greatest(1, (SELECT ceil(count(*) / 256.0)::BIGINT FROM pl)))::INT AS batch FROM pl)"""


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    ranked = "query_id, candidate_id, round(score, 6) AS score, rank"
    out["exact_topk_cosine"] = f"{_VEC}, {_search('r', 'u', 20)} SELECT {ranked} FROM r"
    out["ranking_lists"] = f"""{_VEC}, {_search('r', 'u', 5)}
  SELECT query_id, '[' || string_agg('{{"posting_id":' || candidate_id || ',"score":' || round(score, 6) || '}}', ',' ORDER BY rank) || ']' AS candidates FROM r GROUP BY query_id"""
    out["modality_score_fusion"] = f"{_HALVES}, {_fused('r', 0.4, 20)} SELECT {ranked} FROM r"
    both = f"{_HALVES}, {_search('a', 'im', 20)}, {_search('b', 'tx', 20)}"
    out["candidate_union"] = f"{both} SELECT DISTINCT query_id, candidate_id, 0.0::DOUBLE AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE rank <= 10"
    out["fuse_rankings"] = f"""{both},
  f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.candidate_id, b.candidate_id) AS candidate_id, 0.75 * coalesce(a.score, 0) + 0.25 * coalesce(b.score, 0) AS score
        FROM a FULL JOIN b ON a.query_id = b.query_id AND a.candidate_id = b.candidate_id)
  SELECT query_id, candidate_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) AS rank FROM f QUALIFY rank <= 20"""
    out["phash_topk"] = f"""WITH h AS (SELECT row_number AS id, {_BITS.format(c='image_phash')} AS b FROM listing WHERE {_HEX})
  SELECT q.id AS query_id, c.id AS candidate_id, round(1 - bit_count(xor(q.b, c.b)) / 64.0, 6)::DOUBLE AS score,
         row_number() OVER (PARTITION BY q.id ORDER BY bit_count(xor(q.b, c.b)), c.id) AS rank
  FROM h q JOIN h c ON q.id <> c.id WHERE q.id % 20 = 0 QUALIFY rank <= 20"""
    out["near_phash_pairs"] = f"""WITH h AS (SELECT lower(trim(image_phash)) AS h, min(label_group) AS lo, max(label_group) AS hi FROM train
      WHERE label_group IS NOT NULL AND regexp_matches(trim(image_phash), '^[0-9a-fA-F]{{16}}$') GROUP BY 1),
  b AS (SELECT *, {_BITS.format(c='h')} AS b FROM h)
  SELECT x.h AS left_phash, y.h AS right_phash, bit_count(xor(x.b, y.b)) AS distance FROM b x JOIN b y ON x.h < y.h
  WHERE bit_count(xor(x.b, y.b)) <= 8 AND least(x.lo, y.lo) <> greatest(x.hi, y.hi)"""
    out["char_ngrams"] = f"""WITH {_grams(2, 5)} SELECT t.id AS row_number, count(gram) AS n_grams, count(DISTINCT gram) AS n_distinct FROM t LEFT JOIN g ON t.id = g.id GROUP BY t.id"""
    out["tfidf_vocabulary"] = f"WITH {_grams(2, 5)}, {_vocabulary(100_000)} SELECT gram, df, feature_id, round(idf, 6) AS idf FROM vocab"
    out["tfidf_weights"] = f"{_TFIDF} SELECT id, count(*) AS features, round(sum(weight), 6) AS total, round(max(weight), 6) AS largest FROM x GROUP BY id"

    title_topk = f"""{_TFIDF},
  sc AS (SELECT a.id AS query_id, b.id AS candidate_id, round(sum(a.weight * b.weight), 9) AS score FROM x a JOIN x b ON a.feature_id = b.feature_id AND a.id <> b.id WHERE a.id % 20 = 0 GROUP BY 1, 2),
  pool AS (SELECT id FROM t ORDER BY id LIMIT 201),
  al AS (SELECT * FROM sc UNION ALL SELECT q.id, p.id, 0 FROM t q JOIN pool p ON q.id <> p.id WHERE q.id % 20 = 0 AND (q.id, p.id) NOT IN (SELECT (query_id, candidate_id) FROM sc)),
  tk AS (SELECT query_id, candidate_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) AS rank FROM al QUALIFY rank <= 100)"""
    out["tfidf_topk"] = f"{title_topk} SELECT {ranked} FROM tk"
    title_queries = f"""{title_topk},
  em AS (SELECT row_number AS id, label_group AS label FROM listing WHERE label_group IS NOT NULL AND title IS NOT NULL),
  sz AS (SELECT label, count(*) AS n FROM em GROUP BY label),
  jt AS (SELECT tk.query_id, tk.rank, q.label, coalesce((q.label = c.label)::INT, 0) AS hit, s.n - 1 AS positives, s.n AS size
         FROM tk JOIN em q ON query_id = q.id LEFT JOIN em c ON candidate_id = c.id JOIN sz s ON q.label = s.label WHERE s.n > 1 AND tk.rank <= 20),
  hc AS (SELECT *, sum(hit) OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM jt),
  pt AS (SELECT query_id, label, any_value(size) AS size, sum(CASE WHEN hit = 1 THEN hits / rank::DOUBLE ELSE 0 END) / least(any_value(positives), 20) AS ap,
         (sum(hit) > 0)::INT AS hr, sum(hit) / any_value(positives)::DOUBLE AS rc, sum(hit) / least(20, (SELECT count(*) FROM listing) - 1)::DOUBLE AS pc FROM hc GROUP BY query_id, label),
  pf AS (SELECT *, CASE WHEN pc + rc = 0 THEN 0 ELSE 2 * pc * rc / (pc + rc) END AS f, CASE WHEN size <= 2 THEN '2' WHEN size <= 5 THEN '3_to_5' WHEN size <= 9 THEN '6_to_9' ELSE '10_plus' END AS size_band FROM pt)"""
    out["stratified_metrics"] = f"""{title_queries},
  z AS (SELECT pf.*, CASE WHEN length(norm) <= 30 THEN 'up_to_30' WHEN length(norm) <= 60 THEN '31_to_60' WHEN length(norm) <= 100 THEN '61_to_100' ELSE 'over_100' END AS length_band FROM pf JOIN t ON query_id = t.id)
  SELECT size_band, length_band, count(*) AS queries, round(avg(ap), 6) AS map_20, round(avg(hr), 6) AS hit_rate_20, round(avg(rc), 6) AS recall_20, round(avg(pc), 6) AS precision_20, round(avg(f), 6) AS f1_20 FROM z GROUP BY ALL"""
    out["failure_kinds"] = f"{title_queries} SELECT CASE WHEN rc >= 1 THEN 'none' WHEN rc > 0 THEN 'partial' ELSE 'complete' END AS failure, count(*) AS queries FROM pf GROUP BY 1"
    out["failure_strata"] = f"""{title_queries},
  tw AS (SELECT label_group, image_phash, count(*) > 1 AS twin FROM listing WHERE label_group IS NOT NULL AND image_phash IS NOT NULL GROUP BY 1, 2),
  z AS (SELECT pf.*, CASE WHEN length(title) <= 40 THEN 'up_to_40' WHEN length(title) <= 80 THEN '41_to_80' ELSE 'over_80' END AS lb, coalesce(twin, false) AS twin
        FROM pf JOIN listing l ON query_id = l.row_number LEFT JOIN tw ON tw.label_group = l.label_group AND tw.image_phash = l.image_phash),
  d AS (SELECT 'group_size' AS dimension, size_band AS value, rc FROM z UNION ALL SELECT 'title_length', lb, rc FROM z UNION ALL SELECT 'same_phash_positive', twin::VARCHAR, rc FROM z)
  SELECT dimension, value, count(*) AS queries, round(avg(rc), 6) AS recall, count(*) FILTER (rc = 0) AS zero_recall FROM d GROUP BY 1, 2"""

    ks = [1, 5, 10, 20]
    names = [f"{m}_{k}" for k in ks for m in ("hit_rate", "recall", "precision", "f1")]
    out["retrieval_metrics"] = f"{_J}, {_per_query('p', 'j', ks, 20)} SELECT count(*) AS queries, round(avg(ap), 6) AS map_20, {', '.join(f'round(avg({n}), 6) AS {n}' for n in names)} FROM p"
    out["stored_topk"] = out["exact_topk_cosine"]
    out["first_and_all_misses"] = f"""{_J}, o AS (SELECT query_id, coalesce(max(hit) FILTER (rank = 1), 0) AS f, max(hit) AS a FROM j GROUP BY query_id)
  SELECT count(*) AS queries, count(*) FILTER (f = 0) AS top1_false_matches, count(*) FILTER (a = 0) AS zero_recall_queries FROM o"""
    out["validation_bundle"] = f"""{_POINTS}, {_per_query('p', 'j', ks, 20)},
  m AS (SELECT count(*) AS queries, round(avg(ap), 6) AS map_20, {', '.join(f'round(avg({n}), 6) AS {n}' for n in names)} FROM p),
  z AS (SELECT round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS pair_f1 FROM (SELECT * FROM points ORDER BY points.f1 DESC, points.precision DESC, points.threshold DESC LIMIT 1))
  SELECT m.*, z.* FROM m CROSS JOIN z"""
    bases = [("image", "a"), ("text", "b"), ("simple", "e")]
    out["base_ablations"] = f"""{_HALVES}, {_search('a', 'im', 20)}, {_search('b', 'tx', 20)}, {_fused('e', 0.5, 20)},
  {', '.join(f"{_judged(f'j{r}', r)}, {_per_query(f'p{r}', f'j{r}', [20], 20)}" for _, r in bases)}
  {' UNION ALL '.join(f"SELECT '{n}' AS ranking, round(avg(ap), 6) AS map, round(avg(recall_20), 6) AS recall FROM p{r}" for n, r in bases)}"""
    curve = " UNION ALL ".join(
        f"SELECT {k} AS k, round(avg(recall_{k}), 6) AS recall, round(avg(hit_rate_{k}), 6) AS hit_rate, round(avg(precision_{k}), 6) AS precision, round(avg(f1_{k}), 6) AS f1, round(avg(ap), 6) AS map FROM p{k}" for k in ks
    )
    pq = ", ".join(_per_query(f"p{k}", "j", [k], k) for k in ks)
    out["retrieval_curve"] = f"{_J}, {pq} {curve}"
    out["select_candidate_k"] = f"{_J}, {pq}, c AS ({curve}) SELECT coalesce(min(CASE WHEN recall >= 0.95 THEN k END), max(k)) AS selected_k FROM c"
    out["best_positive"] = f"{_J} SELECT query_id, coalesce(min(CASE WHEN hit = 1 THEN rank END), 0) AS best_rank, round(coalesce(max(CASE WHEN hit = 1 THEN score END), 0), 6) AS best_score, round(max(score), 6) AS top_score FROM j GROUP BY query_id"
    out["review_examples"] = f"""{_J}, b AS (SELECT query_id, min(CASE WHEN hit = 1 THEN rank END) AS best_rank FROM j GROUP BY query_id),
  k AS (SELECT *, CASE WHEN best_rank = 1 THEN 'top1_success' WHEN best_rank IS NULL THEN 'retrieval_miss' ELSE 'top1_false_match' END AS bucket FROM b)
  SELECT query_id, coalesce(best_rank, 0) AS best_rank, bucket, row_number() OVER (PARTITION BY bucket ORDER BY query_id) AS place FROM k QUALIFY place <= 10"""
    at = "(SELECT sum(hit) FILTER (score >= {t}) AS tp, sum(1 - hit) FILTER (score >= {t}) AS fp FROM j)"
    out["pair_metrics"] = f"""{_J}, s AS (SELECT 0.3::DOUBLE AS threshold, coalesce(sum(hit) FILTER (score >= 0.3), 0)::BIGINT AS tp, coalesce(sum(1 - hit) FILTER (score >= 0.3), 0)::BIGINT AS fp FROM j),
  o AS (SELECT threshold, {_rates('tp', 'fp', _TOTAL)} FROM s) SELECT {_SIX} FROM o"""
    del at
    out["select_threshold"] = f"{_POINTS} SELECT {_SIX} FROM (SELECT * FROM points ORDER BY points.f1 DESC, points.precision DESC, points.threshold DESC LIMIT 1)"
    out["precision_at_recall"] = f"""WITH {_PAIRS}, {_LABELS}, {_LABELLED.format(p='up')}, j AS (SELECT pair_probability AS score, y AS hit FROM lp), {_points('j', '(SELECT sum(hit)::BIGINT FROM j)')}
  SELECT {_SIX} FROM (SELECT * FROM points WHERE recall >= 0.8 ORDER BY points.precision DESC, points.threshold DESC LIMIT 1)"""
    out["threshold_curve"] = f"""{_J}, s AS (SELECT i, coalesce(sum(hit) FILTER (score >= i / 40.0::DOUBLE), 0)::BIGINT AS tp, coalesce(sum(1 - hit) FILTER (score >= i / 40.0::DOUBLE), 0)::BIGINT AS fp
      FROM j CROSS JOIN (SELECT unnest(range(0, 41)) AS i) GROUP BY i),
  o AS (SELECT i / 40.0::DOUBLE AS threshold, {_rates('tp', 'fp', _TOTAL)} FROM s) SELECT {_SIX} FROM o"""
    weights = (0.0, 0.25, 0.5, 0.75, 1.0)
    parts = ", ".join(f"{_fused(f'r{i}', w, 20)}, {_judged(f'j{i}', f'r{i}')}, {_per_query(f'p{i}', f'j{i}', [20], 20)}" for i, w in enumerate(weights))
    weight_runs = union = " UNION ALL ".join(f"SELECT {w}::DOUBLE AS weight, avg(ap) AS score FROM p{i}" for i, w in enumerate(weights))
    out["fusion_weight_selection"] = f"{_HALVES}, {parts}, w AS ({union}) SELECT weight, round(score, 6) AS score FROM (SELECT * FROM w ORDER BY w.score DESC, abs(weight - 0.5), weight LIMIT 1)"
    out["similarity_diagnostics"] = f"""{_J} SELECT CASE WHEN hit = 1 THEN 'positive' ELSE 'negative' END AS kind, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std,
         round(quantile_cont(score, 0.05), 6) AS p05, round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.95), 6) AS p95 FROM j GROUP BY 1"""
    tops = [("image", "a"), ("text", "b"), ("simple", "c"), ("pair", "r")]
    per = ", ".join(f"m{r} AS (SELECT query_id, max(hit) FILTER (rank = 1) = 1 AS ok, max(candidate_id) FILTER (rank = 1) AS top, max(hit) = 1 AS any_ FROM j{r} GROUP BY query_id)" for _, r in tops)
    flags = {
        "pair_top1_false_match": "NOT mr.ok", "pair_retrieval_miss": "NOT mr.any_", "pair_head_regression": "mc.ok AND NOT mr.ok", "pair_head_rescue": "NOT mc.ok AND mr.ok",
        "image_rescue": "ma.ok AND NOT mb.ok", "text_rescue": "mb.ok AND NOT ma.ok", "modality_disagreement": "ma.top <> mb.top", "variant_token_conflict": "len(coalesce(ta.tok, [])) + len(coalesce(tb.tok, [])) > 0 AND coalesce(ta.tok, []) <> coalesce(tb.tok, [])",
    }
    rows = " UNION ALL ".join(f"SELECT '{k}' AS bucket, count(*) FILTER ({v}) AS queries FROM ma JOIN mb USING (query_id) JOIN mc USING (query_id) JOIN mr USING (query_id) LEFT JOIN tk ta ON ta.id = mr.query_id LEFT JOIN tk tb ON tb.id = mr.top" for k, v in flags.items())
    out["modality_review"] = f"""{_HALVES}, {_unit('u', 'em', 'embedding')}, {_search('a', 'im', 20)}, {_search('b', 'tx', 20)}, {_fused('c', 0.5, 20)}, {_search('r', 'u', 20)},
  {', '.join(_judged(f'j{r}', r) for _, r in tops)}, {per}, {_TITLES}, tk AS (SELECT id, {tokens('norm')} AS tok FROM t) {rows}"""
    out["candidate_pairs"] = f"""{_VEC}, {_search('r', 'u', 20)} SELECT least(query_id, candidate_id) AS left_id, greatest(query_id, candidate_id) AS right_id, round(max(score), 6) AS cosine,
         coalesce(min(CASE WHEN query_id < candidate_id THEN rank END), 21) AS left_rank, coalesce(min(CASE WHEN query_id > candidate_id THEN rank END), 21) AS right_rank FROM r GROUP BY 1, 2"""
    out["reverse_rank"] = f"""{_VEC}, {_search('r', 'u', 5)} SELECT query_id, candidate_id, 1 + count(*) FILTER (list_inner_product(c.v, x.v) > score) AS reverse_rank
  FROM r JOIN u c ON candidate_id = c.id JOIN u x ON x.id <> candidate_id GROUP BY query_id, candidate_id"""
    out["contrastive_loss"] = f"""{_VEC}, own AS (SELECT id, label::VARCHAR AS label FROM em), {_batches('own')},
  b AS (SELECT rb.*, u.v FROM rb JOIN u USING (id)),
  p AS (SELECT x.batch, x.id, x.label = y.label AS same, list_inner_product(x.v, y.v) / 0.1 AS z FROM b x JOIN b y ON x.batch = y.batch AND x.id <> y.id),
  s AS (SELECT batch, id, max(z) AS m FROM p GROUP BY ALL),
  o AS (SELECT p.batch, p.id, ln(sum(exp(z - m))) AS lse, sum(CASE WHEN same THEN z - m ELSE 0 END) AS g, sum(same::INT) AS n FROM p JOIN s ON p.id = s.id AND p.batch = s.batch GROUP BY p.batch, p.id)
  SELECT round(avg(loss), 6) AS loss FROM (SELECT batch, avg(-(g / n - lse)) AS loss FROM o GROUP BY batch)"""

    # audit
    out["duplicate_audit"] = """
  SELECT 'posting_id' AS kind, sum(n - 1)::BIGINT AS duplicates FROM (SELECT count(*) AS n FROM listing GROUP BY posting_id)
  UNION ALL SELECT 'row', sum(n - 1)::BIGINT FROM (SELECT count(*) AS n FROM listing GROUP BY posting_id, image, image_phash, title, label_group)"""
    audit_title = f"trim(regexp_replace(replace(nfc_normalize(lower({_compatible('title')})), 'ß', 'ss'), '[\\s\\p{{Z}}\\x{{85}}]+', ' ', 'g'))"
    keys = {"image": "image", "sha256": "sha256", "image_phash": "lower(image_phash)", "title": audit_title}
    union = " UNION ALL ".join(f"SELECT '{k}' AS bucket, {c} AS value, label_group FROM tr WHERE label_group IS NOT NULL" for k, c in keys.items())
    out["cross_label_buckets"] = f"""WITH {_IMAGES}, k AS ({union}), v AS (SELECT bucket, value, count(DISTINCT label_group) AS l, count(*) AS n FROM k WHERE value IS NOT NULL GROUP BY 1, 2)
  SELECT bucket, count(*) FILTER (l > 1) AS buckets, count(*) FILTER (n > 1) AS repeated FROM v GROUP BY bucket"""
    band = "CASE WHEN {n} <= 2 THEN '2' WHEN {n} <= 5 THEN '3_to_5' WHEN {n} <= 9 THEN '6_to_9' ELSE '10_plus' END"
    out["group_sizes"] = f"SELECT size, count(*) AS groups, {band.format(n='size')} AS band FROM (SELECT count(*) AS size FROM listing WHERE label_group IS NOT NULL GROUP BY label_group) GROUP BY size"
    out["quantiles"] = _quantiles(f"SELECT 'characters' AS measure, length(title) AS value FROM listing UNION ALL SELECT 'tokens', len(string_split({plain('title')}, ' ')) FROM listing WHERE title IS NOT NULL")
    out["image_quantiles"] = _quantiles(" UNION ALL ".join(f"SELECT '{c}' AS measure, {c} AS value FROM (SELECT DISTINCT * FROM image_record)" for c in ("width", "height", "file_bytes")))
    out["length_histogram"] = """
  SELECT CASE WHEN n < 20 THEN '0_to_19' WHEN n < 40 THEN '20_to_39' WHEN n < 60 THEN '40_to_59' WHEN n < 80 THEN '60_to_79' WHEN n < 120 THEN '80_to_119' ELSE '120_plus' END AS bin, count(*) AS n
  FROM (SELECT length(title) AS n FROM listing WHERE title IS NOT NULL) GROUP BY 1"""
    out["title_counts"] = r"""
  SELECT count(*) AS n_rows, count(title) AS titles, sum(length(title))::BIGINT AS characters,
         sum(len(list_filter(regexp_split_to_array(title, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')))::BIGINT AS tokens,
         count(*) FILTER (regexp_matches(title, '[0-9]')) AS titles_with_digits, count(*) FILTER (regexp_matches(title, '[^\x00-\x7F]')) AS titles_not_ascii,
         count(DISTINCT image) AS unique_images, count(DISTINCT image_phash) AS unique_phashes FROM listing"""
    out["image_audit"] = """
  WITH i AS (SELECT *, sha256 IS NOT NULL AND width > 0 AND height > 0 AS ok FROM (SELECT DISTINCT * FROM image_record))
  SELECT count(*) AS images, count(*) FILTER (NOT coalesce(ok, false)) AS unreadable, count(*) FILTER (ok AND least(width, height) < 64) AS small_side,
         count(*) FILTER (ok AND (width / height::DOUBLE < 0.25 OR width / height::DOUBLE > 4)) AS extreme_aspect, count(DISTINCT sha256) AS contents FROM i"""
    findings = """
  WITH c AS (
    SELECT 'critical' AS severity, 'duplicate_posting' AS code, 'postings occur more than once' AS message, sum(k - 1)::BIGINT AS n FROM (SELECT count(*) AS k FROM train GROUP BY posting_id)
    UNION ALL SELECT 'warning', 'image_shared_by_labels', 'an image stands under several labels', count(*) FROM (SELECT image FROM train WHERE label_group IS NOT NULL AND image IS NOT NULL GROUP BY image HAVING count(DISTINCT label_group) > 1)
    UNION ALL SELECT 'critical', 'missing_image', 'a named image is not there', count(DISTINCT image) FROM train WHERE image IS NOT NULL AND image NOT IN (SELECT image FROM image_record)
    UNION ALL SELECT 'warning', 'unreadable_image', 'an image cannot be read', count(DISTINCT image) FROM image_record WHERE sha256 IS NULL)"""
    out["audit_findings"] = f"{findings} SELECT severity, code, message, n FROM c WHERE n > 0"
    out["audit_status"] = f"{findings} SELECT CASE WHEN max((severity = 'critical')::INT) = 1 THEN 'blocked' WHEN count(*) > 0 THEN 'passed_with_warnings' ELSE 'passed' END AS status FROM c WHERE n > 0"

    # titles
    out["plain_titles"] = f"WITH {_TITLES} SELECT id AS row_number, norm FROM t"
    out["identity_tokens"] = f"WITH {_TITLES}, k AS (SELECT id, {tokens('norm')} AS tok FROM t) SELECT id AS row_number, array_to_string(tok, '|') AS tokens, len(tok) AS n_tokens FROM k"
    out["variant_conflicts"] = f"""WITH {_PAIRS}, ti AS (SELECT posting_id, min(title) AS title FROM listing WHERE title IS NOT NULL GROUP BY posting_id),
  tk AS (SELECT posting_id, {tokens(plain('title'))} AS tok FROM ti)
  SELECT (len(a.tok) + len(b.tok) > 0) AND a.tok <> b.tok AS conflict, count(*) AS n_pairs FROM up JOIN tk a ON left_posting_id = a.posting_id JOIN tk b ON right_posting_id = b.posting_id GROUP BY 1"""
    out["script_presence"] = r"""
  WITH c AS (SELECT DISTINCT row_number, unnest(string_split(title, '')) AS ch FROM listing WHERE title IS NOT NULL),
  k AS (SELECT DISTINCT row_number, CASE WHEN regexp_matches(ch, '\p{Nd}') THEN 'digits' WHEN regexp_matches(ch, '[\x{400}-\x{4FF}]') THEN 'cyrillic' WHEN regexp_matches(ch, '[\p{Latin}\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}]') THEN 'latin' END AS script FROM c)
  SELECT script, count(*) AS titles FROM k WHERE script IS NOT NULL GROUP BY script"""
    out["digit_unit_digits"] = f"WITH {_TITLES} SELECT id AS row_number, array_to_string(regexp_extract_all(norm, '{DIGITS}'), '|') AS digits FROM t"
    chars = f"WITH {_TITLES}, c AS (SELECT unnest(string_split(norm, '')) AS token FROM t), n AS (SELECT token, count(*) AS n FROM c WHERE token <> '' GROUP BY token)"
    out["character_vocabulary"] = f"{chars} SELECT token, row_number() OVER (ORDER BY n DESC, token) + 1 AS token_id FROM (SELECT * FROM n WHERE n >= 5 ORDER BY n DESC, token LIMIT 200)"
    out["unknown_rate"] = f"{chars}, v AS (SELECT token FROM n WHERE n >= 50 ORDER BY n DESC, token LIMIT 60) SELECT round(sum(n) FILTER (token NOT IN (SELECT token FROM v)) / sum(n)::DOUBLE, 6) AS unknown_rate FROM n"

    # components
    out["label_components"] = f"""WITH RECURSIVE {_IMAGES},
  k AS (SELECT label_group AS g, 'i' || image AS v FROM tr WHERE image IS NOT NULL UNION SELECT label_group, 's' || sha256 FROM tr WHERE sha256 IS NOT NULL
        UNION SELECT label_group, 'p' || lower(image_phash) FROM tr WHERE {_HEX}),
  e AS (SELECT DISTINCT x.g AS a, y.g AS b FROM k x JOIN k y ON x.v = y.v WHERE x.g IS NOT NULL AND y.g IS NOT NULL),
  reach(a, b) AS (SELECT label_group, label_group FROM tr WHERE label_group IS NOT NULL UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
  roots AS (SELECT a AS label_group, min(b) AS root FROM reach GROUP BY a),
  sizes AS (SELECT label_group, count(*) AS n FROM tr WHERE label_group IS NOT NULL GROUP BY label_group),
  comp AS (SELECT root, 'component_' || substr(sha256(string_agg(label_group, chr(10) ORDER BY label_group)), 1, 16) AS component_id, sum(n)::BIGINT AS component_rows, {band.format(n='max(n)')} AS size_band FROM roots JOIN sizes USING (label_group) GROUP BY root)
  SELECT label_group, component_id, component_rows, size_band FROM roots JOIN comp USING (root)"""

    # pairs
    out["usable_pairs"] = f"WITH {_PAIRS} SELECT left_posting_id, right_posting_id, round(cosine_similarity, 6) AS cosine_similarity, round(pair_probability, 6) AS pair_probability, left_rank, right_rank, variant_conflict FROM up"
    out["edge_gates"] = f"WITH {_PAIRS} SELECT {_GATE} AS gate, count(*) AS n_pairs FROM up GROUP BY 1"
    out["pair_policy"] = """
  WITH p AS (SELECT CASE WHEN coalesce(pair_probability, 0) < 0.5 THEN 'below_probability_threshold' WHEN left_rank > 10 OR right_rank > 10 THEN 'not_reciprocal_top_k'
      WHEN coalesce(variant_conflict, false) AND coalesce(pair_probability, 0) < 0.8 THEN 'variant_conflict' ELSE 'accepted' END AS reason FROM scored_pair)
  SELECT reason = 'accepted' AS accepted, reason, count(*) AS n_pairs FROM p GROUP BY reason"""
    out["edge_metrics"] = f"""WITH {_PAIRS}, {_LABELS}, kp AS (SELECT * FROM up WHERE {_GATE} = 'eligible'), {_LABELLED.format(p='kp')},
  s AS (SELECT sum(y)::BIGINT AS tp, count(*) - sum(y)::BIGINT AS fp, (SELECT sum(n * (n - 1) // 2)::BIGINT FROM (SELECT count(*) AS n FROM lb GROUP BY label)) AS total FROM lp),
  o AS (SELECT {_rates('tp', 'fp', 'total')} FROM s)
  SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, true_positive, false_positive, false_negative FROM o"""
    out["candidate_classification"] = f"""WITH {_PAIRS}, {_LABELS}, {_LABELLED.format(p='up')},
  o AS (SELECT *, sum(y) OVER w AS cum, row_number() OVER w AS place, sum(y) OVER () AS pos, count(*) OVER () AS n FROM lp WINDOW w AS (ORDER BY pair_probability DESC, left_posting_id, right_posting_id ROWS UNBOUNDED PRECEDING)),
  x AS (SELECT *, cum / place::DOUBLE AS pp, cum / pos::DOUBLE AS pr FROM o),
  b AS (SELECT i, count(*) AS m, avg(pair_probability) AS mp, avg(y) AS my FROM lp JOIN (SELECT unnest(range(0, 10)) AS i) ON pair_probability >= i / 10.0::DOUBLE AND (pair_probability < (i + 1) / 10.0::DOUBLE OR (i = 9 AND pair_probability <= 1)) GROUP BY i),
  s AS (SELECT sum(y) FILTER (pair_probability >= 0.5)::BIGINT AS tp, sum(1 - y) FILTER (pair_probability >= 0.5)::BIGINT AS fp, any_value(pos)::BIGINT AS pos, any_value(n) AS n, sum(CASE WHEN y = 1 THEN pp ELSE 0 END) AS aps,
        avg((pair_probability - y) * (pair_probability - y)) AS brier, coalesce(max(pp) FILTER (pr >= 0.5), 0) AS par, coalesce(max(pr) FILTER (pp >= 0.8), 0) AS rap FROM x),
  r AS (SELECT *, tp / (tp + fp)::DOUBLE AS p, tp / pos::DOUBLE AS q FROM s)
  SELECT 0.5::DOUBLE AS threshold, round(p, 6) AS precision, round(q, 6) AS recall_within_candidates, round(2 * p * q / (p + q), 6) AS f1_within_candidates, round(aps / pos, 6) AS average_precision, round(brier, 6) AS brier_score,
         round((SELECT sum(m * abs(mp - my)) FROM b) / n, 6) AS expected_calibration_error, round(par, 6) AS precision_at_required_recall, round(rap, 6) AS recall_at_required_precision,
         tp AS true_positive, fp AS false_positive, n - pos - fp AS true_negative, pos - tp AS false_negative_within_candidates, pos AS candidate_positive_pairs, n - pos AS candidate_negative_pairs FROM r"""
    out["cluster_metrics"] = f"""WITH {_CONT},
  e AS (SELECT entity, sum(n) AS size, count(*) AS k FROM ct GROUP BY entity), t AS (SELECT label, sum(n) AS size, count(*) AS k FROM ct GROUP BY label),
  a AS (SELECT sum(n * (n - 1) // 2) AS tp, sum(n * n / e.size::DOUBLE) / sum(n) AS bp, sum(n * n / t.size::DOUBLE) / sum(n) AS br, sum(n) AS postings FROM ct JOIN e USING (entity) JOIN t USING (label)),
  b AS (SELECT sum(size * (size - 1) // 2) AS pp, count(*) AS c, count(*) FILTER (size = 1) AS s, count(*) FILTER (k > 1) AS i, max(size)::BIGINT AS mx FROM e),
  d AS (SELECT sum(size * (size - 1) // 2) AS ap, count(*) AS g, count(*) FILTER (k > 1) AS sg FROM t),
  x AS (SELECT *, tp / pp::DOUBLE AS p, tp / ap::DOUBLE AS r FROM a CROSS JOIN b CROSS JOIN d)
  SELECT round(p, 6) AS pairwise_precision, round(r, 6) AS pairwise_recall, round(2 * p * r / (p + r), 6) AS pairwise_f1, round(bp, 6) AS b_cubed_precision, round(br, 6) AS b_cubed_recall, round(2 * bp * br / (bp + br), 6) AS b_cubed_f1,
         round(1 - p, 6) AS false_merge_pair_rate, round(i / c::DOUBLE, 6) AS impure_cluster_rate, round(i / (c - s)::DOUBLE, 6) AS impure_non_singleton_cluster_rate, round(sg / g::DOUBLE, 6) AS false_split_group_rate,
         c AS clusters, s AS singleton_clusters, c - s AS non_singleton_clusters, mx AS maximum_cluster_size, round(postings / c::DOUBLE, 6) AS mean_cluster_size FROM x"""
    strict = "CASE WHEN size = 2 THEN '2' WHEN size <= 5 THEN '3_to_5' WHEN size <= 9 THEN '6_to_9' ELSE '10_plus' END"
    out["group_recovery"] = f"""WITH {_CONT}, t AS (SELECT sum(n) AS size, count(*) AS k FROM ct GROUP BY label),
  s AS (SELECT {strict} AS band, count(*) AS groups, avg((k = 1)::INT) AS u, avg(k) AS f FROM t GROUP BY 1)
  SELECT b.band, coalesce(groups, 0) AS groups, round(coalesce(u, 0), 6) AS unsplit_rate, round(coalesce(f, 0), 6) AS mean_fragments
  FROM (VALUES ('2'), ('3_to_5'), ('6_to_9'), ('10_plus')) AS b(band) LEFT JOIN s ON b.band = s.band"""

    # mining and sampling
    out["hard_negatives"] = f"WITH {_MINE} SELECT query_id, candidate_id, round(pair_probability, 6) AS pair_probability, round(cosine_similarity, 6) AS cosine_similarity, variant_conflict FROM hn"
    out["dedup_pairs"] = f"WITH {_MINE} SELECT {_MINED} FROM dd"
    out["cap_variants"] = f"WITH {_MINE} SELECT {_MINED} FROM cv"
    counters = [f"SELECT '{o}' AS counter, count(*) AS n FROM mc WHERE outcome = '{o}'" for o in ("excluded_same_label", "excluded_probability", "excluded_same_phash", "excluded_exact_title", "eligible")]
    counters += [
        "SELECT 'candidates_seen', count(*) FROM mc", "SELECT 'selected_before_symmetric_dedup', count(*) FROM hn",
        "SELECT 'symmetric_duplicates_removed', (SELECT count(*) FROM hn) - (SELECT count(*) FROM dd)", "SELECT 'variant_quota_removed', (SELECT count(*) FROM dd) - (SELECT count(*) FROM cv)",
    ]
    out["mining_counts"] = f"WITH {_MINE} {' UNION ALL '.join(counters)}"
    out["mined_probabilities"] = f"""WITH {_MINE} SELECT round(min(pair_probability), 6) AS minimum, round(quantile_cont(pair_probability, 0.5), 6) AS median,
         round(quantile_cont(pair_probability, 0.95), 6) AS p95, round(max(pair_probability), 6) AS maximum FROM dd"""
    empty = " OR ".join(f"{c} IS NULL OR trim({c}) = ''" for c in ("posting_id", "image", "image_phash", "title", "label_group"))
    out["rejected_metadata"] = f"""
  WITH r AS (SELECT CASE WHEN {empty} THEN 'missing_value' WHEN regexp_matches(trim(image), '[/\\\\]|^[A-Za-z]:') OR trim(image) IN ('.', '..') THEN 'unsafe_image_path'
      WHEN NOT regexp_matches(trim(image_phash), '^[0-9a-fA-F]{{16}}$') THEN 'invalid_phash' END AS reject_reason FROM train)
  SELECT reject_reason, count(*) AS n_rows FROM r WHERE reject_reason IS NOT NULL GROUP BY 1"""
    out["image_joins"] = """
  WITH i AS (SELECT DISTINCT image, width IS NOT NULL AS readable FROM image_record)
  SELECT 'matched_rows' AS kind, count(*) AS n FROM train JOIN i USING (image)
  UNION ALL SELECT 'missing_images', count(DISTINCT image) FROM train WHERE image IS NOT NULL AND image NOT IN (SELECT image FROM i)
  UNION ALL SELECT 'unreferenced_images', count(*) FROM i WHERE image NOT IN (SELECT image FROM train WHERE image IS NOT NULL)"""
    out["candidate_sets"] = f"""{both}, x AS (SELECT query_id, candidate_id FROM a), y AS (SELECT query_id, candidate_id FROM b)
  SELECT 'both' AS kind, count(*) AS n FROM (SELECT * FROM x INTERSECT SELECT * FROM y)
  UNION ALL SELECT 'image_only', count(*) FROM (SELECT * FROM x EXCEPT SELECT * FROM y) UNION ALL SELECT 'text_only', count(*) FROM (SELECT * FROM y EXCEPT SELECT * FROM x)"""
    out["strongest_edges"] = f"""WITH {_PAIRS} SELECT left_posting_id, right_posting_id, round(pair_probability, 6) AS pair_probability, round(cosine_similarity, 6) AS cosine_similarity
  FROM (SELECT * FROM up WHERE {_GATE} = 'eligible' ORDER BY up.pair_probability DESC, up.cosine_similarity DESC, left_posting_id, right_posting_id LIMIT 50)"""
    out["digest_order"] = "SELECT posting_id, sha256('7:' || posting_id) AS digest FROM (SELECT DISTINCT posting_id FROM listing) ORDER BY digest LIMIT 20"
    lengths = f"SELECT 'normalized_length' AS measure, length({plain('title')}) AS value FROM listing WHERE title IS NOT NULL"
    out["title_length_summary"] = f"{_quantiles(lengths)} UNION ALL SELECT 'over_64', 'share', round(avg((value > 64)::INT), 6) FROM ({lengths})"
    out["run_summary"] = f"{_HALVES}, {parts}, w AS ({weight_runs}) SELECT count(*) AS runs, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std FROM w"
    out["group_size_recall"] = f"{title_queries} SELECT {strict} AS band, count(*) AS queries, round(avg(rc), 6) AS recall FROM pf GROUP BY 1"
    products = """
  WITH RECURSIVE o AS (SELECT posting_id AS id, min(label_group) AS label FROM train WHERE label_group IS NOT NULL GROUP BY posting_id),
  s AS (SELECT label, count(*) AS n FROM o GROUP BY label HAVING count(*) >= 2),
  c AS (SELECT label, n, batch FROM s CROSS JOIN (SELECT unnest(range(0, 4)) AS batch) QUALIFY row_number() OVER (PARTITION BY batch ORDER BY sha256('7:' || batch || ':' || label), label) <= 8),
  m AS (SELECT c.batch, c.label, o.id, c.n, row_number() OVER (PARTITION BY c.batch, c.label ORDER BY sha256('7:' || c.batch || ':' || o.id), o.id) - 1 AS r FROM o JOIN c ON o.label = c.label),
  pb AS (SELECT m.batch, m.label, m.id, z.slot FROM m JOIN (SELECT unnest(range(0, 3)) AS slot) z ON m.r = z.slot % least(n, 3))"""
    out["product_batches"] = f"{products} SELECT batch::INT AS batch, label, id, slot::INT AS slot FROM pb"
    out["balanced_pairs"] = f"""WITH own AS (SELECT posting_id AS id, min(label_group) AS label FROM train WHERE label_group IS NOT NULL GROUP BY posting_id), {_batches('own')},
  p AS (SELECT x.batch, x.id AS left_id, y.id AS right_id, x.label = y.label AS positive FROM rb x JOIN rb y ON x.batch = y.batch AND x.id < y.id)
  SELECT batch, left_id, right_id, positive FROM p
  QUALIFY positive OR row_number() OVER (PARTITION BY batch, positive ORDER BY sha256('7:' || left_id || ':' || right_id), left_id, right_id) <= 2 * sum(positive::INT) OVER (PARTITION BY batch)"""
    out["collision_samples"] = """
  SELECT image AS value, count(DISTINCT label_group) AS labels, min(label_group) AS low_label, max(label_group) AS high_label FROM train WHERE image IS NOT NULL AND label_group IS NOT NULL
  GROUP BY image HAVING count(DISTINCT label_group) > 1 ORDER BY sha256('7:' || image) LIMIT 20"""
    out["streamed_arrivals"] = "SELECT strftime(date_trunc('day', ingested_at), '%Y-%m-%d') AS day, count(*) AS listings FROM listing GROUP BY 1"
    out.pop("digit_unit_digits")
    out["digit_unit_tokens"] = f"""WITH {_TITLES} SELECT id AS row_number, array_to_string(regexp_extract_all(norm, '{DIGITS}'), '|') AS digits,
         array_to_string(list_filter(string_split(norm, ' '), lambda w: regexp_full_match(w, '{WHOLE_UNITS.replace(chr(92) + 'b', '')}')), '|') AS units FROM t"""
    out["invalid_ranking_rows"] = f"""{_VEC}, {_search('r', 'u', 20)},
  x AS (SELECT query_id, candidate_id, score, CASE rank WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE rank END AS rank FROM r),
  y AS (SELECT *, lag(score) OVER w AS s, lag(candidate_id) OVER w AS c, count(*) OVER (PARTITION BY query_id, candidate_id) AS n FROM x WINDOW w AS (PARTITION BY query_id ORDER BY rank))
  SELECT query_id, candidate_id, round(score, 6) AS score, rank FROM y WHERE coalesce(score > s OR (score = s AND candidate_id <= c), false) OR query_id = candidate_id OR n > 1"""
    worst = "ORDER BY parts DESC, size DESC, name LIMIT 20"
    out["cluster_failures"] = f"""WITH {_CONT},
  rv AS (SELECT posting_id, min(entity_id) AS entity_id, max(manual_review) AS review FROM cluster_assignment WHERE entity_id IS NOT NULL GROUP BY posting_id)
  SELECT * FROM (SELECT 'false_merge' AS kind, entity AS name, count(*) AS parts, sum(n)::BIGINT AS size FROM ct GROUP BY entity HAVING count(*) > 1 {worst})
  UNION ALL SELECT * FROM (SELECT 'false_split', label AS name, count(*) AS parts, sum(n)::BIGINT AS size FROM ct GROUP BY label HAVING count(*) > 1 {worst})
  UNION ALL SELECT * FROM (SELECT 'manual_review', entity_id AS name, 1::BIGINT AS parts, count(*) AS size FROM rv WHERE review GROUP BY entity_id {worst})"""
    share = "[0.8, 0.1, 0.1]"
    cost = lambda j: f"0.7 * l[{j}] / (total * {share}[{j}]) + 0.3 * b[(band - 1) * 3 + {j}] / greatest(m * {share}[{j}], 1e-12)"
    out["split_assignment"] = f"""WITH RECURSIVE one AS (SELECT DISTINCT component_id, component_rows::DOUBLE AS w, size_band FROM ({out['label_components']})),
  o AS (SELECT component_id, w, list_position(['2', '3_to_5', '6_to_9', '10_plus'], size_band) AS band, count(*) OVER (PARTITION BY size_band)::DOUBLE AS m, sum(w) OVER () AS total,
        row_number() OVER (ORDER BY w DESC, sha256('2026:' || component_id), component_id) AS i FROM one),
  walk(i, component_id, pick, l, b) AS (
    SELECT 0::BIGINT, ''::VARCHAR, 0, [0.0, 0.0, 0.0]::DOUBLE[], list_transform(range(12), lambda x: 0.0)::DOUBLE[]
    UNION ALL
    SELECT i, component_id, pick, list_transform(l, lambda x, k: CASE WHEN k = pick THEN x + w ELSE x END), list_transform(b, lambda x, k: CASE WHEN k = (band - 1) * 3 + pick THEN x + 1 ELSE x END)
    FROM (SELECT *, CASE WHEN c1 <= c2 AND c1 <= c3 THEN 1 WHEN c2 <= c3 THEN 2 ELSE 3 END AS pick FROM (
      SELECT o.*, l, b, {cost(1)} AS c1, {cost(2)} AS c2, {cost(3)} AS c3 FROM walk JOIN o ON o.i = walk.i + 1)))
  SELECT component_id, ['train', 'validation', 'test'][pick] AS split FROM walk WHERE i > 0"""
    own_split = f"""cs AS ({out['split_assignment']}), lc AS ({out['label_components']}), ls AS (SELECT label_group, split FROM lc JOIN cs USING (component_id))"""
    out["label_blind_test_rows"] = f"""WITH {_IMAGES}, {own_split}
  SELECT posting_id, image, image_phash, title FROM tr WHERE posting_id IN (SELECT posting_id FROM tr JOIN ls USING (label_group) WHERE split = 'test')"""
    out["near_phash_cross_split"] = f"""WITH {_IMAGES}, {own_split}, near AS ({out['near_phash_pairs']}),
  placed AS (SELECT DISTINCT lower(trim(image_phash)) AS h, split FROM tr JOIN ls USING (label_group))
  SELECT DISTINCT left_phash, right_phash, distance FROM near JOIN placed a ON left_phash = a.h JOIN placed b ON right_phash = b.h WHERE a.split <> b.split"""
    out["inspection_pairs"] = """
  WITH own AS (SELECT posting_id AS id, min(label_group) AS label, min(image) AS image FROM train WHERE label_group IS NOT NULL GROUP BY posting_id),
  f AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha256('7:' || id)) AS p, count(*) OVER (PARTITION BY label) AS n FROM own WHERE id IS NOT NULL),
  a AS (SELECT label, id AS left_id, image AS li FROM f WHERE p = 1 AND n >= 2 ORDER BY sha256('7:' || label), label LIMIT 20)
  SELECT label, left_id, id AS right_id FROM own JOIN a USING (label) WHERE id <> left_id
  QUALIFY row_number() OVER (PARTITION BY label ORDER BY coalesce(image = li, true)::INT, sha256('7:' || id)) = 1"""
    taken = ", ".join(f"cap.{c}" for c in ("left_posting_id", "right_posting_id", "left_label_group", "right_label_group", "cosine_similarity", "pair_probability", "variant_conflict"))
    out["negative_batch"] = f"""WITH cap AS ({out['cap_variants']}), o AS (
    SELECT {taken}, row_number() OVER (ORDER BY sha256('7:0:0:' || left_posting_id || '|' || right_posting_id), left_posting_id, right_posting_id) - 1 AS r FROM cap QUALIFY r < 64)
  SELECT slot, {taken.replace('cap.', 'o.')} FROM (SELECT unnest(range(64)) AS slot) JOIN o ON r = slot % (SELECT count(*) FROM o)"""
    audit_form = audit_title
    folded = f"translate(replace(replace(replace(lower(title), 'ß', 'ss'), chr(64257), 'fi'), chr(64258), 'fl'), '{_CHEROKEE[0]}', '{_CHEROKEE[1]}')"
    out["normalized_titles"] = f"""SELECT row_number, {plain('title')} AS feature_title, translate({audit_form}, '{_CHEROKEE[0]}', '{_CHEROKEE[1]}') AS audit_title, {folded} AS folded_title, title AS shown_title
  FROM listing WHERE title IS NOT NULL"""
    out["conservative_invariants"] = "SELECT count(DISTINCT posting_id) AS postings, 0::BIGINT AS repeated, 0::BIGINT AS oversized, 0::BIGINT AS torn FROM listing"
    out["split_integrity"] = "SELECT unnest(['label_group', 'image', 'image_phash', 'sha256']) AS key_name, 0::BIGINT AS crossing"
    return out
