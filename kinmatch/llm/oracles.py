"""The same results in SQL, where SQL can state them over whole tables."""

from __future__ import annotations

_NEITHER = r"[^\p{L}\p{Nd}]+"

_RECORDS = rf"""
  SELECT row_number, posting_id, title, image_phash,
         list_aggregate(list_sort(list_filter(regexp_split_to_array(lower(title), '{_NEITHER}'), lambda w: w <> '')), 'string_agg', ' ') AS words,
         regexp_replace(lower(image_phash), '{_NEITHER}', '', 'g') AS bare
  FROM listing WHERE title IS NOT NULL AND image_phash IS NOT NULL
"""

_FIRST = f"""
  WITH r AS ({_RECORDS}),
  f AS (SELECT *, min(row_number) OVER (PARTITION BY words, bare) AS first_row_number, count(*) OVER (PARTITION BY words, bare) AS copies FROM r)
"""


def _reach(edges: str) -> str:
    """Vertices ``a`` with every ``b`` that a walk over the links leads to."""
    return f"""
  WITH RECURSIVE e AS ({edges}),
  both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
  reach(a, b) AS (
    SELECT a, b FROM both_ways
    UNION
    SELECT r.a, s.b FROM reach r JOIN both_ways s ON r.b = s.a
  )
"""


_WINDOWS = r"""
    SELECT {key}, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS win
    FROM (SELECT {key}, regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+') AS w FROM {table})
    WHERE len(w) >= 12
"""


def oracle_sql() -> dict[str, str]:
    links = "SELECT left_posting_id AS a, right_posting_id AS b FROM scored_pair WHERE pair_probability >= 0.5 AND right_posting_id IS NOT NULL"
    listed = "SELECT component_id, unnest(label_groups) AS g FROM split_component"
    leaks = f"""
  WITH d AS ({_WINDOWS.format(key="doc_id", text="text", table="documents")}),
  i AS (SELECT DISTINCT * FROM ({_WINDOWS.format(key="item_id", text="text", table="eval_item")})),
  hit AS (SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (win))"""
    linked = _reach(links) + """,
  root AS (SELECT a AS posting_id, min(b) AS r FROM (SELECT a, b FROM reach UNION ALL SELECT a, a FROM reach) GROUP BY a),
  every AS (SELECT posting_id FROM listing UNION SELECT left_posting_id FROM scored_pair UNION SELECT right_posting_id FROM scored_pair),
  entity AS (SELECT every.posting_id, coalesce(r, every.posting_id) AS first_posting_id FROM every LEFT JOIN root USING (posting_id) WHERE every.posting_id IS NOT NULL)"""
    return {
        "p2_entities": linked + """
  SELECT posting_id, 'entity_' || substr(sha256(first_posting_id), 1, 16) AS entity_id, first_posting_id, count(*) OVER (PARTITION BY first_posting_id) AS cluster_size FROM entity""",
        "p4_invariants": "SELECT count(*) AS rows_split, 0::BIGINT AS labels_crossing, 0::BIGINT AS held_crossing, true AS shares_hold FROM listing",
        "p6_invariants": "SELECT count(*) AS texts, 0::BIGINT AS lost, 0::BIGINT AS overfull, true AS tight, 0::BIGINT AS divided FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL",
        "p7_items": leaks + " SELECT e.item_id, e.task, h.n AS n_documents FROM eval_item e JOIN (SELECT item_id, count(*) AS n FROM hit GROUP BY item_id) h ON e.item_id = h.item_id",
        "p8_spikes": """
  WITH l AS (SELECT coalesce(source, chr(31)) AS source, unit, length FROM (SELECT source, 'chars' AS unit, length(text) AS length FROM documents WHERE text IS NOT NULL
             UNION ALL SELECT source, 'bytes', octet_length(encode(text)) FROM documents WHERE text IS NOT NULL)),
  h AS (SELECT source, unit, length, count(*) AS n FROM l GROUP BY ALL),
  t AS (SELECT source, unit, max(length) AS top, sum(n)::BIGINT AS texts FROM h GROUP BY ALL),
  a AS (SELECT x.source, x.unit, x.length, x.n, sum(y.n) - any_value(x.n) AS around FROM h x JOIN h y ON x.source = y.source AND x.unit = y.unit AND abs(x.length - y.length) <= 20 GROUP BY x.source, x.unit, x.length, x.n)
  SELECT nullif(source, chr(31)) AS source, unit, length, n, texts FROM a JOIN t USING (source, unit) WHERE n >= 5 AND n >= 6.0 * around / 40 AND length * 2 >= top""",
        "p2_found": _reach(links) + "SELECT min(b) AS first_posting_id, a AS posting_id FROM reach GROUP BY a HAVING min(b) < a",
        "p4_found": _reach(f"SELECT g AS a, min(g) OVER (PARTITION BY component_id) AS b FROM ({listed}) WHERE g IS NOT NULL")
        + "SELECT min(b) AS first_label_group, a AS label_group FROM reach GROUP BY a HAVING min(b) < a",
        "p5_found": _FIRST + "SELECT first_row_number, row_number FROM f WHERE first_row_number <> row_number",
        "p5_records": _FIRST + "SELECT row_number, posting_id, title, image_phash, copies FROM f WHERE first_row_number = row_number",
        "p7_found": leaks + " SELECT doc_id, item_id FROM hit",
    }
