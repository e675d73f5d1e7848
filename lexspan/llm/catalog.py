"""The queries of this subpackage and, where DuckDB can express them, their SQL."""

from __future__ import annotations

from lexspan.llm.centroids import op12_centroid_clustering
from lexspan.llm.decontaminate import op10_benchmark_decontamination
from lexspan.llm.hard_negatives import op13_hard_negatives
from lexspan.llm.html_text import op7_html_extraction
from lexspan.llm.jaccard_join import op1_jaccard_join
from lexspan.llm.language_id import op4_language_id
from lexspan.llm.packing import op2_best_fit_packing
from lexspan.llm.quality_classifier import op5_quality_classifier
from lexspan.llm.quality_rules import op6_quality_rules
from lexspan.llm.secrets import op3_secret_scans
from lexspan.llm.suffix_dedup import op11_suffix_dedup
from lexspan.llm.token_counts import op8_token_counts
from lexspan.llm.warc import op9_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_jaccard_join,
        op2_best_fit_packing,
        op3_secret_scans,
        op4_language_id,
        op5_quality_classifier,
        op6_quality_rules,
        op7_html_extraction,
        op8_token_counts,
        op9_warc,
        op10_benchmark_decontamination,
        op11_suffix_dedup,
        op12_centroid_clustering,
        op13_hard_negatives,
    )
}


def _centroid_sql(rounds: int) -> str:
    """Clusters after so many rounds, a pair of common tables each."""
    kept = "len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64"
    ctes = [
        f"v AS (SELECT vec_id, row_number() OVER () AS i, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE {kept})",
        "c0 AS (SELECT row_number() OVER (ORDER BY h NULLS LAST, x) - 1 AS k, x AS c FROM (SELECT x, sha256('1:' || CAST(vec_id AS VARCHAR)) AS h FROM v) ORDER BY h NULLS LAST, x LIMIT 16)",
    ]
    for r in range(rounds + 1):
        ctes.append(f"a{r} AS (SELECT vec_id, x, k, s FROM (SELECT vec_id, x, k, s, row_number() OVER (PARTITION BY i ORDER BY s, k) AS nth FROM (SELECT vec_id, i, x, k, list_sum(list_transform(range(1, 65), lambda j: (x[j] - c[j]) * (x[j] - c[j]))) AS s FROM v, c{r})) WHERE nth = 1)")
        if r < rounds:
            ctes.append(f"m{r} AS (SELECT k, list(CAST(floor_div AS BIGINT) ORDER BY j) AS c FROM (SELECT k, j, (sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) / count(*) AS floor_div FROM (SELECT k, unnest(x) AS y, unnest(range(1, 65)) AS j FROM a{r}) GROUP BY k, j) GROUP BY k)")
            ctes.append(f"c{r + 1} AS (SELECT c{r}.k, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (k))")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(s AS BIGINT) AS distance, CAST(sum(s) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(s) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (k)"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
SQL: dict[str, str] = {
    "op1_jaccard_join": rf"""WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_SPACED}) AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM docs),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * o >= 85 * (a.n + b.n - o)),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT l.y, r.root FROM reach r JOIN links l ON l.x = r.node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT node AS doc_id, min(root) AS component_id FROM reach GROUP BY node) USING (doc_id)""",
    "op6_quality_rules": rf"""WITH docs AS (SELECT doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, array_to_string(w[p : p + 2], ' ') AS g FROM docs WHERE len(w) >= 3),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM again) GROUP BY doc_id),
normal AS (SELECT doc_id, host, regexp_extract_all(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_SPACED}) AS v FROM (SELECT doc_id, host, unnest(lines) AS l FROM docs)),
frequent AS (SELECT host, array_to_string(v, ' ') AS line FROM normal GROUP BY ALL HAVING count(DISTINCT doc_id) > 10),
lost AS (SELECT doc_id, CAST(sum(len(v)) AS BIGINT) AS n FROM normal n JOIN frequent f ON f.host = n.host AND f.line = array_to_string(v, ' ') GROUP BY doc_id),
base AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(l.n, 0) AS frequent_words
FROM docs LEFT JOIN repeats r USING (doc_id) LEFT JOIN lost l USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - frequent_words >= 0.5 * n_words AS kept FROM base""",
    "op9_warc": r"""WITH bodies AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY sha1(coalesce(html, ''))) AS first FROM pages)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 4), lambda i: translate(to_base(CAST('0x' || substr(h, 10 * i + 1, 10) AS BIGINT), 32, 8), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')), '') AS payload_digest,
CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to FROM bodies""",
    "op10_benchmark_decontamination": rf"""WITH docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wanted AS (SELECT DISTINCT item_id, n, g FROM (SELECT item_id, least(10, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i : i + least(10, len(w)) - 1], ' '))) AS g FROM items WHERE len(w) > 0)),
places AS (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM docs, (SELECT DISTINCT n FROM wanted))),
found AS (SELECT DISTINCT doc_id, item_id, p, n FROM places JOIN wanted USING (n, g)),
hits AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM found) GROUP BY doc_id),
held AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN held USING (doc_id)""",
    "op11_suffix_dedup": """WITH docs AS (SELECT row_number() OVER () AS i, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT i, p, md5_number(substr(h, 2 * p + 1, 400)) AS g FROM (SELECT i, h, unnest(range(0, length(h) // 2 - 199)) AS p FROM docs)),
again AS (SELECT i, p FROM (SELECT i, p, count(*) OVER (PARTITION BY g) AS n FROM windows) WHERE n > 1),
islands AS (SELECT i, min(p) AS b, max(p) + 200 AS e FROM (SELECT i, p, sum(fresh) OVER (PARTITION BY i ORDER BY p) AS island FROM (SELECT i, p, CASE WHEN p > lag(p) OVER (PARTITION BY i ORDER BY p) + 200 THEN 1 ELSE 0 END AS fresh FROM again)) GROUP BY i, island),
gaps AS (SELECT i, b, e, lead(b) OVER (PARTITION BY i ORDER BY b) AS next_b, row_number() OVER (PARTITION BY i ORDER BY b) AS nth FROM islands),
cut AS (SELECT i, CAST(sum(e - b) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(CASE WHEN nth = 1 THEN substr(h, 1, 2 * b) ELSE '' END || substr(h, 2 * e + 1, coalesce(2 * (next_b - e), length(h))), '' ORDER BY b) AS kept FROM gaps JOIN docs USING (i) GROUP BY i)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM docs LEFT JOIN cut USING (i)""",
    "op12_centroid_clustering": _centroid_sql(3),
    "op13_hard_negatives": """WITH v AS (SELECT vec_id, row_number() OVER () AS i, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = len(embedding)),
scores AS (SELECT a.i AS ai, a.vec_id AS anchor_id, b.i AS bi, b.vec_id AS id, a.label = b.label AS same, list_sum(list_transform(range(1, len(a.x) + 1), lambda j: a.x[j] * b.x[j])) AS s FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.i <> b.i AND len(a.x) = len(b.x)),
positives AS (SELECT ai, anchor_id, id AS positive_id, s AS positive_score, row_number() OVER (PARTITION BY ai ORDER BY s DESC, id) AS p FROM scores WHERE same QUALIFY p <= 5),
negatives AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY ai, p ORDER BY s DESC, id) AS rank, id AS negative_id, positive_score, s AS negative_score FROM positives JOIN scores USING (ai, anchor_id) WHERE NOT same AND 100 * s BETWEEN 30 * positive_score AND 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, CAST(positive_score AS BIGINT) AS positive_score, CAST(negative_score AS BIGINT) AS negative_score FROM negatives WHERE rank <= 10""",
}
