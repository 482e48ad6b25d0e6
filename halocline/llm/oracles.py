"""DuckDB SQL for those queries that SQL can express."""

from __future__ import annotations

from halocline.llm import quality, secret_scan

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _grams(n: int) -> str:
    return f"""
g{n} AS (SELECT doc_id, unnest(range(1, n - {n} + 2)) AS p, unnest(list_transform(range(1, n - {n} + 2), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS g FROM d WHERE n >= {n}),
c{n} AS (SELECT doc_id, count(*) AS k, sum(length(w[q])) AS ch FROM (
  SELECT DISTINCT doc_id, unnest(range(p, p + {n})) AS q FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g{n}) WHERE c > 1) JOIN d USING (doc_id) GROUP BY doc_id)"""


def quality_sql() -> str:
    sizes = sorted({*quality.NGRAM_LIMITS, quality.BASE_NGRAM})
    return f"""
WITH d AS (SELECT doc_id, text, w, len(w) AS n, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS wc FROM (SELECT doc_id, text, {WORDS} AS w FROM documents)),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
lc AS (SELECT doc_id, line, count(*) AS c, length(line) AS ch FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id, line),
ld AS (SELECT doc_id, sum(c - 1) AS dup, sum(c) AS total, sum((c - 1) * ch) AS dup_ch, sum(c * ch) AS total_ch FROM lc GROUP BY doc_id),
{", ".join(_grams(n).strip() for n in sizes)},
m AS (SELECT d.doc_id, d.n AS n_words, CAST(d.wc AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(coalesce(d.text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(ld.dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c{quality.BASE_NGRAM}.k, 0) AS BIGINT) AS n_repeat_words,
  coalesce(100 * ld.dup > {quality.LINE_LIMIT} * ld.total, false) OR coalesce(100 * ld.dup_ch > {quality.LINE_CHAR_LIMIT} * ld.total_ch, false)
  OR 100 * length(regexp_replace(coalesce(d.text, ''), '[^#*$%&|<>]', '', 'g')) > {quality.SYMBOL_LIMIT} * d.n
  {" ".join(f"OR coalesce(100 * c{n}.ch > {limit} * d.wc, false)" for n, limit in quality.NGRAM_LIMITS.items())} AS failed
  FROM d LEFT JOIN ld ON ld.doc_id = d.doc_id {" ".join(f"LEFT JOIN c{n} ON c{n}.doc_id = d.doc_id" for n in sizes)})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {quality.BASE_WORDS} OR 100 * n_repeat_words > {quality.BASE_LIMIT} * n_words) AS base_failed,
  NOT (n_words < {quality.BASE_WORDS} OR 100 * n_repeat_words > {quality.BASE_LIMIT} * n_words) AND NOT failed AS kept
FROM m"""


WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM s WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT s.page_id, s.payload_bytes, s.payload_digest,
  CASE WHEN s.page_id > f.first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN s.page_id > f.first THEN f.first END AS refers_to
FROM s LEFT JOIN f ON f.payload_digest = s.payload_digest"""


def secret_sql() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    parts = [
        f"""SELECT doc_id, {i} AS rank, '{r.kind}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'s': list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0), 'n': length(m[i]), 'v': length(v[i])}})) AS x, {r.least} AS least
  FROM (SELECT doc_id, string_split_regex(t, {quoted(r.pattern)}) AS g, regexp_extract_all(t, {quoted(r.pattern)}, 0) AS m, regexp_extract_all(t, {quoted(r.pattern)}, {r.group}) AS v FROM d WHERE regexp_matches(t, {quoted(r.pattern)}))"""
        for i, r in enumerate(secret_scan.RULES)
    ]
    base = ", ".join(f"'{r.kind}'" for r in secret_scan.BASE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, rank, kind, CAST(x.s AS BIGINT) AS s, CAST(x.s + x.n AS BIGINT) AS e FROM ({" UNION ALL ".join(parts)}) WHERE x.v >= least),
a AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secret_scan.BASE)},
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (kind IN ({base})), '') AS b,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secret_scan.BASE)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a ON a.doc_id = d.doc_id"""


LEAKS = r"""
WITH i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
i5 AS (SELECT item_id, w, least(5, len(w)) AS k, len(w) - least(5, len(w)) + 1 AS n FROM i WHERE len(w) > 0),
ig AS (SELECT item_id, k, n, unnest(list_transform(range(1, n + 1), lambda j: array_to_string(w[j:j + k - 1], ' '))) AS g FROM i5),
ic AS (SELECT item_id, g, count(*) AS m FROM ig GROUP BY item_id, g),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
ks AS (SELECT DISTINCT k FROM i5),
dg AS (SELECT doc_id, k, len(w) - k + 1 AS last, unnest(range(1, len(w) - k + 2)) AS p, unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j + k - 1], ' '))) AS g FROM d, ks WHERE len(w) >= k),
hit AS (SELECT DISTINCT dg.doc_id, dg.k, dg.last, ig.item_id, ig.n, dg.p FROM dg JOIN ig ON ig.g = dg.g AND ig.k = dg.k),
win AS (SELECT DISTINCT doc_id, k, item_id, n, least(n, last) AS m, least(p, last - least(n, last) + 1) AS s FROM hit),
c AS (SELECT win.doc_id, win.k, win.item_id, win.n, win.m, win.s, dg.g, count(*) AS c FROM win JOIN dg ON dg.doc_id = win.doc_id AND dg.k = win.k AND dg.p BETWEEN win.s AND win.s + win.m - 1 GROUP BY ALL),
x AS (SELECT c.doc_id, c.item_id, c.k, c.n, c.m, c.s, sum(least(c.c, ic.m)) AS b FROM c JOIN ic ON ic.item_id = c.item_id AND ic.g = c.g GROUP BY ALL),
y AS (SELECT doc_id, item_id, k, n, m, s, CAST(b AS DOUBLE) / CAST(n + m - b AS DOUBLE) AS sim FROM x)
SELECT doc_id, item_id, sim AS similarity, CAST(s AS INTEGER) AS start_word, CAST(m + k - 1 AS INTEGER) AS n_words
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY sim DESC, s) AS r FROM y WHERE sim >= 0.8) WHERE r = 1"""


PASSAGES = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS p, unnest(list_transform(range(1, len(w) - 33), lambda i: md5(array_to_string(w[i:i + 34], ' ')))) AS h FROM d WHERE len(w) >= 35),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY h) AS c FROM g) WHERE c > 1),
q AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS i FROM r),
x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS v FROM d),
k AS (SELECT x.doc_id, count(q.i) AS gone, coalesce(string_agg(x.v, ' ' ORDER BY x.i) FILTER (q.i IS NULL), '') AS t FROM x LEFT JOIN q ON q.doc_id = x.doc_id AND q.i = x.i GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(k.gone, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""


BYTES = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, unnest(range(0, length(h) // 2 - 199)) AS p, unnest(list_transform(range(0, length(h) // 2 - 199), lambda i: md5(substr(h, 2 * i + 1, 400)))) AS m FROM d WHERE length(h) >= 400),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY m) AS c FROM g) WHERE c > 1),
i AS (SELECT doc_id, p, sum(CASE WHEN p - before <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM r)),
s AS (SELECT doc_id, min(p) AS a, max(p) + 200 AS b FROM i GROUP BY doc_id, k),
t AS (SELECT s.doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY s.doc_id ORDER BY a), 0) AS z, h FROM s JOIN d ON d.doc_id = s.doc_id),
k AS (SELECT doc_id, count(*) AS n, sum(b - a) AS gone, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS h FROM t GROUP BY doc_id)
SELECT d.doc_id, length(d.h) // 2 AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""


ORACLES = {"op1_quality_rules": quality_sql(), "op3_suffix_dedup": BYTES, "op4_decontamination": LEAKS, "op6_substring_dedup": PASSAGES, "op7_warc": WARC, "op9_secret_scan": secret_sql()}
