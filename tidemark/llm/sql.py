"""DuckDB SQL for the queries that SQL can express, over the same whole tables."""

from . import quality_rules as q

SQL: dict[str, str] = {}

_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
SQL["op1_secret_scan"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
k(kind, rank, re) AS (VALUES ('assign', 0, '{_ASSIGN}'), ('access', 1, 'AKIA[A-Z0-9]+'), ('hex', 2, '[0-9a-f]+')),
m AS (
  SELECT r, 'assign' AS kind, 0 AS rank, regexp_split_to_array(t, '{_ASSIGN}') AS p, regexp_extract_all(t, '{_ASSIGN}', 0) AS m,
         regexp_extract_all(t, '{_ASSIGN}', 2) AS g, 6 AS least FROM d
  UNION ALL SELECT r, 'access', 1, regexp_split_to_array(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0), regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0), 20 FROM d
  UNION ALL SELECT r, 'hex', 2, regexp_split_to_array(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+', 0), regexp_extract_all(t, '[0-9a-f]+', 0), 24 FROM d),
e AS (SELECT r, kind, rank, least, unnest(p[1:len(m)]) AS gap, unnest(m) AS hit, unnest(g) AS val, unnest(range(len(m))) AS i FROM m),
s AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY r, rank ORDER BY i) AS stop FROM e),
f AS (SELECT r, kind, rank, stop - length(hit) AS start, stop FROM s WHERE length(val) >= least),
a AS (SELECT r, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
      string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM f GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (r)
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+')"
SQL["op6_decontaminate"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id::varchar AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
k AS (SELECT item, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM k)),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS x
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT r, item, n, i FROM dw JOIN bw USING (n, x)),
p AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM h) GROUP BY r),
t AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN t USING (r)
"""


def _quality() -> str:
    """Statistics, then rule by rule the exact binomial tails of each stratum's next cutoffs, corrected, and the verdicts; the numbers are the operator's own."""
    top, each = q.LEVELS, q.DELTA / ((len(q.STRATA) + 1) * q.WALKS)
    ratio = {"symbol_ratio": "n_symbols / n_words", "bang_ratio": "n_bangs / n_words", "upper_ratio": "n_upper / word_chars", "repeat_ratio": "n_repeat_words / n_words"}
    strikes = ", ".join(" + ".join(f"(CASE WHEN n_words > 0 AND {ratio[k]} > {c} THEN 1 ELSE 0 END)" for c in cuts) + f" AS x{i}" for i, (k, cuts) in enumerate(q.CUTOFFS.items()))
    strata = ", ".join(f"'{s}'" for s in q.STRATA)
    steps, chosen = [], "SELECT DISTINCT s FROM g"
    for r in range(q.RULES):
        before = " OR ".join([f"x{j} > {top} - c{j}" for j in range(r)] or ["false"])
        steps.append(rf"""
a{r} AS ({chosen}),
k{r} AS (SELECT s, lv, count(*) AS n, count(*) FILTER (x{r} >= {top} - lv OR {before}) AS k FROM g JOIN a{r} USING (s), (SELECT unnest(range({top})) AS lv) GROUP BY s, lv),
b{r} AS (SELECT s, lv, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({q.ALPHA}) + (n - i) * ln(1 - {q.ALPHA}))) AS tail
      FROM (SELECT s, lv, n::double AS n, unnest(range(k::bigint + 1))::double AS i FROM k{r} WHERE k < n) GROUP BY s, lv),
f{r} AS (SELECT k{r}.s, min(k{r}.lv) AS lv FROM k{r} LEFT JOIN b{r} ON b{r}.s = k{r}.s AND b{r}.lv = k{r}.lv WHERE coalesce(tail, 1) > {each!r} GROUP BY k{r}.s)""")
        chosen = f"SELECT a{r}.*, coalesce(lv, {top}) AS c{r} FROM a{r} LEFT JOIN f{r} USING (s)"
    kept = " AND ".join(["NOT base_failed", *(f"x{r} <= {top} - coalesce(c{r}, 0)" for r in range(q.RULES))])
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, CASE WHEN lang IN ({strata}) THEN lang ELSE 'other' END AS s, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
u AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
h AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS c FROM u) WHERE c > 1),
p AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM h) GROUP BY r),
l AS (SELECT r, count(*) - count(DISTINCT x) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
f AS (SELECT d.doc_id, d.s, len(w.w)::bigint AS n_words, length(array_to_string(w.w, ''))::bigint AS word_chars, length(regexp_replace(d.t, '[^#*$%&|<>]+', '', 'g'))::bigint AS n_symbols,
      coalesce(l.n, 0) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words, length(regexp_replace(d.t, '[^!]+', '', 'g')) AS n_bangs, length(regexp_replace(d.t, '\P{{Lu}}+', '', 'g')) AS n_upper
      FROM d JOIN w USING (r) LEFT JOIN l USING (r) LEFT JOIN p USING (r)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {strikes} FROM f),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
g AS (SELECT s, {", ".join(f"x{r}" for r in range(q.RULES))} FROM v SEMI JOIN good USING (doc_id) WHERE NOT base_failed),{",".join(steps)},
a AS ({chosen})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, {kept} AS kept
FROM v LEFT JOIN a USING (s)
"""


SQL["op2_quality_rules"] = _quality()

_FINITE = "embedding IS NOT NULL AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])"


def _vector_codes(rounds: int = 4) -> str:
    """Each round's assignment packs distance and index into one number, so the least breaks ties by index."""
    near = "SELECT r, p, min(d * 256 + entry) AS best FROM (SELECT l.r, l.p, c.entry, sum((l.v - c.v) * (l.v - c.v))::bigint AS d FROM long l JOIN cb{n} c ON c.p = l.p AND c.j = l.j GROUP BY l.r, l.p, c.entry) GROUP BY r, p"
    steps = []
    for n in range(rounds):
        steps.append(f"a{n} AS MATERIALIZED ({near.format(n=n)})")
        steps.append(f"""cb{n + 1} AS MATERIALIZED (SELECT c.p, c.entry, c.j, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, c.v) AS v FROM cb{n} c LEFT JOIN (
  SELECT l.p, a.best % 256 AS entry, l.j, sum(l.v)::bigint AS s, count(*) AS n FROM long l JOIN a{n} a ON a.r = l.r AND a.p = l.p GROUP BY l.p, a.best % 256, l.j) m ON m.p = c.p AND m.entry = c.entry AND m.j = c.j)""")
    return f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, [floor(1024 * x::double)::bigint FOR x IN embedding] AS v FROM embeddings WHERE {_FINITE}),
long AS MATERIALIZED (SELECT r, vec_id, (i - 1) // (len(v) // 4) AS p, (i - 1) % (len(v) // 4) AS j, v[i] AS v FROM (SELECT r, vec_id, v, unnest(range(1, len(v) + 1)) AS i FROM e)),
cb0 AS MATERIALIZED (SELECT p, f.entry, j, v FROM long JOIN (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM e ORDER BY vec_id LIMIT 256) f USING (r)),
{", ".join(steps)},
z AS MATERIALIZED ({near.format(n=rounds)}),
c AS (SELECT r, string_agg(printf('%02x', best % 256), '' ORDER BY p) AS code, sum(best // 256)::bigint AS error FROM z GROUP BY r),
h AS (SELECT sha256(string_agg(v::varchar, ',' ORDER BY p, entry, j)) AS codebooks_sha256 FROM cb{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::bigint AS label_error, codebooks_sha256 FROM e JOIN c USING (r) CROSS JOIN h
"""


SQL["op11_vector_codes"] = _vector_codes()

SQL["op13_hard_negatives"] = f"""
WITH e AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::double)::bigint FOR x IN embedding] AS v FROM embeddings WHERE label IS NOT NULL AND {_FINITE}),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_sum([a.v[i] * b.v[i] FOR i IN range(1, len(a.v) + 1)])::bigint AS score FROM e a JOIN e b ON b.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS rn FROM s WHERE same) WHERE rn <= 5)
SELECT anchor_id, positive_id, rn::integer AS rank, id AS negative_id, positive_score, score AS negative_score FROM (
  SELECT p.*, s.id, s.score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS rn
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score) WHERE rn <= 10
"""
