"""DuckDB SQL with the rows of the queries that SQL can express."""

from __future__ import annotations

_FOLD = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(column: str, separators: str) -> str:
    return f"list_filter(regexp_split_to_array({_FOLD.format(column)}, '{separators}'), lambda t: t <> '')"


_ASCII = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

OP1 = f"""WITH items AS (SELECT item_id, {_words("text", _ASCII)} AS w FROM benchmark WHERE item_id IS NOT NULL),
grams AS (SELECT DISTINCT item_id, list_slice(w, s, s + least(len(w), 8) - 1) AS gram FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 8) + 2)) AS s FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {_words("text", _ASCII)} AS w FROM documents),
sizes AS (SELECT DISTINCT len(gram) AS n FROM grams),
spots AS (SELECT doc_id, n, s, list_slice(w, s, s + n - 1) AS gram FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM docs, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, s, n, item_id FROM spots JOIN grams USING (gram)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM docs d LEFT JOIN hit_words h ON h.doc_id = d.doc_id LEFT JOIN hit_items i ON i.doc_id = d.doc_id"""

OP2 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""

OP3 = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', substr(hex, i, 1))]), '') AS bits,
  min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT)
    + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM b"""

OP5 = f"""WITH RECURSIVE docs AS (SELECT doc_id, {_words("text", "[\\x20\\x09-\\x0D]+")} AS w FROM documents),
each AS (SELECT DISTINCT doc_id, list_slice(w, s, s + least(len(w), 4) - 1) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 4) + 2)) AS s FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM each GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM each a JOIN each b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM docs UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(other) FROM reach r WHERE r.doc_id = d.doc_id) AS component_id FROM docs d LEFT JOIN sizes s ON s.doc_id = d.doc_id"""


#: kind, pattern, group of the value, least code points of the value, is it base.
_SECRETS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    ("access", "AKIA[A-Z0-9]+", 0, 18, True),
    ("hex", "[0-9a-f]+", 0, 16, True),
    ("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1, False),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, False),
    ("opaque", r"\b[A-Za-z0-9_]{32,}", 0, 32, False),
]


def _op9() -> str:
    parts = []
    for rank, (kind, pattern, group, least, base) in enumerate(_SECRETS):
        sql = pattern.replace("'", "''")
        parts.append(f"SELECT doc_id, source, {rank} AS rank, '{kind}' AS kind, {least} AS least, {str(base).lower()} AS base, regexp_split_to_array(text, '{sql}') AS gaps, regexp_extract_all(text, '{sql}') AS found, regexp_extract_all(text, '{sql}', {group}) AS values_ FROM docs")
    union = " UNION ALL ".join(parts)
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, source FROM documents), kinds AS ({union}),
each AS (SELECT doc_id, source, rank, kind, least, base, unnest(range(1, len(found) + 1)) AS k, gaps, found, values_ FROM kinds WHERE len(found) > 0),
placed AS (SELECT doc_id, source, rank, kind, base, values_[k] AS v, length(found[k]) AS size, sum(length(gaps[k]) + length(found[k])) OVER (PARTITION BY doc_id, rank ORDER BY k) AS stop, least FROM each),
valid AS (SELECT doc_id, source, rank, kind, base, v, CAST(stop - size AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM placed
  WHERE length(v) >= least AND (kind <> 'opaque' OR (regexp_matches(v, '[0-9].*[0-9]') AND regexp_matches(v, '[A-Za-z].*[A-Za-z]')))),
free AS (SELECT * FROM valid a WHERE base OR NOT EXISTS (SELECT 1 FROM valid b WHERE b.base AND b.doc_id = a.doc_id AND b.start < a.stop AND a.start < b.stop)),
holders AS (SELECT v, count(DISTINCT coalesce(source, chr(0))) <= 2 AND count(DISTINCT doc_id) <= 8 AS live FROM free GROUP BY v),
spans AS (SELECT f.*, live, kind || ':' || start || ':' || stop AS told FROM free f JOIN holders USING (v) WHERE base OR live)
SELECT d.doc_id, count(told) FILTER (WHERE kind = 'assign') AS n_assign, count(told) FILTER (WHERE kind = 'access') AS n_access, count(told) FILTER (WHERE kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(told, ',' ORDER BY start, rank) FILTER (WHERE base), '')) AS base_sha256, coalesce(string_agg(told, ',' ORDER BY start, rank), '') AS spans, count(told) FILTER (WHERE live) AS n_live
FROM docs d LEFT JOIN spans s ON s.doc_id = d.doc_id GROUP BY d.doc_id"""


ORACLES = {"op1_decontamination": OP1, "op2_exact_topk": OP2, "op3_warc": OP3, "op5_ngram_jaccard_join": OP5, "op9_secrets": _op9()}
