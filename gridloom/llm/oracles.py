"""DuckDB SQL for the operators' registered queries that SQL can express on small tables."""

from __future__ import annotations

from gridloom.llm.licenses import TEMPLATES, WIDTH
from gridloom.llm.line_dedup import ORACLE as LINE_DEDUP
from gridloom.llm.mixing import ORACLE as MIX
from gridloom.llm.repair import ORACLE as REPAIR
from gridloom.llm.resampling import ORACLE as RESAMPLING

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM_WORDS = f"list_filter(string_split_regex({LOWER.format('text')}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
SPACE_WORDS = f"list_filter(string_split_regex({LOWER.format('text')}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, coalesce({ALNUM_WORDS}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {ALNUM_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS k FROM b WHERE len(w) > 0)),
g AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS g FROM
  (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
m AS (SELECT doc_id, item, k, g.n AS n FROM g JOIN win ON win.n = g.n AND win.g = g.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS i FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(i), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(i, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce({SPACE_WORDS}, []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 0) + 2)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r AS (SELECT doc_id, doc_id AS x FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.x = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id)
JOIN (SELECT doc_id, min(x) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""

_VALUES = ", ".join("('" + name + "', '" + text.replace("'", "''") + "')" for name, text in TEMPLATES)
_GRAMS = f"list_distinct(list_transform(range(1, greatest(len(w) - {WIDTH - 2}, 1)), lambda k: array_to_string(w[k : k + {WIDTH - 1}], ' ')))"

LICENSES = f"""
WITH t AS (SELECT name, {_GRAMS} AS g FROM (SELECT name, {ALNUM_WORDS} AS w FROM (VALUES {_VALUES}) v(name, text))),
d AS (SELECT doc_id, {_GRAMS} AS g FROM (SELECT doc_id, coalesce({ALNUM_WORDS}, []) AS w FROM documents)),
m AS (SELECT doc_id, list_sort(list(name)) AS names FROM d JOIN t ON 100 * len(list_intersect(d.g, t.g)) >= 80 * len(t.g) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(names), 0) AS BIGINT) AS n_licenses, coalesce(array_to_string(names, ','), '') AS licenses FROM d LEFT JOIN m USING (doc_id)
"""

ORACLES = {
    "op2_line_dedup": LINE_DEDUP,
    "op7_license_scan": LICENSES,
    "op8_ngram_jaccard_join": JACCARD,
    "op9_benchmark_decontamination": DECONTAMINATION,
    "op11_source_mix": MIX,
    "op12_conversation_repair": REPAIR,
    "op13_importance_resampling": RESAMPLING,
}
