"""DuckDB SQL for the queries that SQL can express."""

_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_WORD = r"'[^\x20\x09-\x0D]+'"


def _windows(words: str, n: str) -> str:
    return f"list_transform(range(1, len({words}) - {n} + 2), lambda i: array_to_string({words}[i:i + {n} - 1], ' '))"


DECONTAMINATION = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_AZ}, {_ALNUM}) AS w FROM documents),
b AS (SELECT item_id, w, least(8, len(w)) AS n FROM (SELECT item_id, regexp_extract_all({_AZ}, {_ALNUM}) AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, unnest({_windows('w', 'n')}) AS k FROM b), ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS s, unnest({_windows('w', 'n')}) AS k FROM d, ns WHERE len(w) >= n),
h AS (SELECT doc_id, s, n, item_id FROM dw JOIN bw USING (n, k)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n, string_agg(t, ',' ORDER BY t) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n, 0) >= 2 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN i ON d.doc_id = i.doc_id"""

SUBSTRINGS = f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS s, unnest({_windows('w', '13')}) AS k FROM d WHERE len(w) >= 13),
f AS (SELECT k, min(doc_id) AS m FROM win GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(s, s + 13)) AS p FROM win JOIN f USING (k) WHERE m < doc_id)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.p) AS kept, count(*) AS n FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p WHERE gone.p IS NULL GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id"""

LINES = f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, i, regexp_extract_all(lower(line), {_WORD}) AS w FROM l),
s AS (SELECT doc_id, i, list_distinct({_windows('w', 'least(5, len(w))')}) AS s FROM w WHERE len(w) > 0), t AS (SELECT doc_id, i, len(s) AS n, unnest(s) AS k FROM s),
m AS (SELECT y.doc_id, y.i FROM t x JOIN t y ON x.k = y.k AND (x.doc_id < y.doc_id OR x.doc_id = y.doc_id AND x.i < y.i) GROUP BY x.doc_id, x.i, x.n, y.doc_id, y.i, y.n HAVING 10 * count(*) >= 8 * (x.n + y.n - count(*))),
kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) AS text, count(*) AS n FROM l LEFT JOIN (SELECT DISTINCT doc_id, i FROM m) m ON l.doc_id = m.doc_id AND l.i = m.i WHERE m.i IS NULL GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n, CASE WHEN d.text IS NULL THEN -1 ELSE 1 END) AS BIGINT) AS n_lines, sha256(CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END) AS text_sha256 FROM documents d LEFT JOIN kept ON d.doc_id = kept.doc_id"""

JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_AZ}, {_WORD}) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct({_windows('w', 'least(4, len(w))')}) END AS s FROM w), t AS (SELECT doc_id, len(s) AS n, unnest(s) AS k FROM s),
e AS (SELECT x.doc_id AS a, y.doc_id AS b FROM t x JOIN t y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY x.doc_id, x.n, y.doc_id, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
r AS (SELECT a AS id, a AS reach FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.reach = e.a), c AS (SELECT id, min(reach) AS c FROM r GROUP BY 1)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(c, doc_id) AS component_id FROM s LEFT JOIN c ON doc_id = id"""
