"""DuckDB SQL of those operators that SQL can express over whole tables."""

from __future__ import annotations

from scrivener.llm.urls import CAPITALS, SMALL

_SPACE = r"[^\x20\x09-\x0D]+"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP1 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '{_SPACE}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

OP3 = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, {_BLANKS}), '{CAPITALS}', '{SMALL}') AS key FROM l),
common AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, top IS NOT NULL AND doc_id <> top AS dropped FROM k LEFT JOIN common USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


# Stated here by themselves, not taken from the operator: (kind, pattern, group of the value, least length)
_KINDS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("token", r"(?:gh[pousr]_[A-Za-z0-9]{20,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+)", 0, 0),
    ("key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*(?:-[^-]+){0,64}-----END [A-Z ]*PRIVATE KEY-----)?", 0, 0),
]
_AROUND = r"-----(?:BEGIN|END) [A-Z ]*PRIVATE KEY-----|\s|\\[nr]"


def _matches(rank: int) -> str:
    kind, pattern, group, least = _KINDS[rank]
    pattern = pattern.replace("'", "''")
    value = f"unnest(regexp_extract_all(t, '{pattern}', {group}))"
    if kind == "key":
        value = f"coalesce(nullif(regexp_replace({value}, '{_AROUND}', '', 'g'), ''), {value})"
    return f"""SELECT doc_id, source, lang, '{kind}' AS kind, {rank} AS rank, {least} AS least, unnest(regexp_extract_all(t, '{pattern}')) AS whole, {value} AS value,
      unnest(list_slice(regexp_split_to_array(t, '{pattern}'), 1, len(regexp_extract_all(t, '{pattern}')))) AS gap, unnest(range(len(regexp_extract_all(t, '{pattern}')))) AS i
    FROM d"""


OP5 = f"""
WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents),
m AS ({' UNION ALL '.join(_matches(k) for k in range(len(_KINDS)))}),
p AS (SELECT *, CAST(sum(length(gap) + length(whole)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS stop FROM m),
f AS (SELECT *, stop - length(whole) AS start FROM p WHERE length(value) >= least),
o AS (SELECT value, count(DISTINCT coalesce(source, chr(0))) AS owners, count(DISTINCT coalesce(source, chr(0)) || chr(1) || coalesce(lang, chr(0))) AS repos FROM f GROUP BY value),
j AS (SELECT f.*, owners >= 3 OR owners > 1 AND repos >= 6 AS copied, concat(kind, ':', start, ':', stop) AS span FROM f JOIN o USING (value)),
g AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
    string_agg(span, ',' ORDER BY start, rank) FILTER (WHERE rank < 3) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans,
    count(*) FILTER (WHERE NOT copied) AS n_live, count(*) FILTER (WHERE copied) AS n_copied FROM j GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""

SQL = {"op1_minhash": OP1, "op3_line_dedup": OP3, "op5_secret_scans": OP5}
