"""DuckDB SQL for registered queries: plain forms over all rows, without the operators' stores and samples."""

from __future__ import annotations

from .urls import Listed

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER.format('t')}, '[^\x20\x09-\x0D]+')"
_BITS = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_transform(range(8), lambda j: CAST(ascii(c) AS BIGINT) >> CAST(j AS INT) & 1)))"
_CRC = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {_BITS}), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"


def _discount(k: int, n: str) -> str:
    return f"CASE WHEN least({n}1, {n}2, {n}3, {n}4) = 0 THEN {k / 2} ELSE least(greatest({k} - {k + 1} * ({n}1 / ({n}1 + 2 * {n}2)) * {n}{k + 1} / {n}{k}, 0), {k}) END"


def _tally(of: str, n: str) -> str:
    return ", ".join(f"CAST(count(*) FILTER ({of} = {k}) AS DOUBLE) AS {n}{k}" for k in (1, 2, 3, 4))


#: Words never hold a blank, so names with one stand for the start and the end.
KNESER_NEY = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, {_CRC} % 7 = 2 AS held_out, list_append({_WORDS}, ' end') AS ws FROM d),
tok AS (SELECT doc_id, held_out, unnest(ws) AS w, unnest(list_prepend(' start', ws[:-2])) AS v FROM s),
train AS (SELECT * FROM tok WHERE NOT held_out),
word AS (SELECT w, count(*) AS c FROM train GROUP BY w),
size AS (SELECT count(*) AS v, coalesce(sum(c), 0) AS n FROM word),
context AS (SELECT v, count(*) AS total FROM train GROUP BY v),
pair AS (SELECT v, w, count(*) AS c FROM train GROUP BY v, w),
seen AS (SELECT {_tally('c', 'n')}, count(*) AS pairs FROM pair),
high AS (SELECT {', '.join(f'{_discount(k, "n")} AS d{k}' for k in (1, 2, 3))}, pairs FROM seen),
left_of AS (SELECT w, count(*) AS c FROM pair GROUP BY w),
few AS (SELECT {_tally('c', 'm')} FROM left_of),
low AS (SELECT {', '.join(f'{_discount(k, "m")} AS e{k}' for k in (1, 2, 3))}, m1, m2 FROM few),
free AS (SELECT (e1 * m1 + e2 * m2 + e3 * (size.v - m1 - m2)) / greatest(pairs, 1) AS mass FROM low, size, high),
mass AS (SELECT v, count(*) FILTER (c = 1) AS f1, count(*) FILTER (c = 2) AS f2, count(*) FILTER (c > 2) AS f3 FROM pair GROUP BY v),
q AS (SELECT tok.doc_id, tok.held_out, tok.w, tok.v, greatest(coalesce(l.c, 0) - CASE least(coalesce(l.c, 0), 3) WHEN 0 THEN 0 WHEN 1 THEN e1 WHEN 2 THEN e2 ELSE e3 END, 0) / greatest(pairs, 1) + free.mass / (size.v + 1) AS q
  FROM tok CROSS JOIN low CROSS JOIN free CROSS JOIN size CROSS JOIN high LEFT JOIN left_of AS l ON l.w = tok.w),
p AS (SELECT q.doc_id, q.held_out, coalesce(word.c, 0) AS c, CASE WHEN context.total IS NULL THEN q.q ELSE
  greatest(coalesce(pair.c, 0) - CASE least(coalesce(pair.c, 0), 3) WHEN 0 THEN 0 WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END, 0) / context.total + (f1 * d1 + f2 * d2 + f3 * d3) / context.total * q.q END AS p
  FROM q CROSS JOIN high LEFT JOIN word ON word.w = q.w LEFT JOIN context ON context.v = q.v LEFT JOIN mass ON mass.v = q.v LEFT JOIN pair ON pair.v = q.v AND pair.w = q.w)
SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, CAST(any_value(size.n) AS BIGINT) AS train_tokens,
  round(sum(log10((c + 1) / (size.n + size.v + 1))), 6) AS base_score, round(sum(log10(p)), 6) AS score, round(pow(10, least(-sum(log10(p)) / count(*), 300)), 3) AS perplexity
FROM p CROSS JOIN size GROUP BY doc_id"""

NEAR = f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(coalesce(text, ''))[1:32] AS h FROM documents),
n AS (SELECT count(*) AS n FROM d),
texts AS MATERIALIZED (SELECT h, any_value(t) AS t, min(doc_id) AS first, count(*) AS copies FROM d WHERE doc_id IS NOT NULL GROUP BY h),
words AS (SELECT h, copies, {_WORDS} AS ws FROM texts),
sh AS MATERIALIZED (SELECT h, copies, g, count(*) AS times FROM (SELECT h, copies, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM words) GROUP BY h, copies, g),
df AS (SELECT g, sum(copies) AS df FROM sh GROUP BY g),
w AS MATERIALIZED (SELECT h, g, times, n.n / (n.n + df.df) AS idf, df.df AS df FROM sh JOIN df USING (g) CROSS JOIN n),
total AS (SELECT h, sum(times * idf) AS total FROM w GROUP BY h),
edge AS MATERIALIZED (SELECT a, b FROM (SELECT x.h AS a, y.h AS b, sum(x.idf * least(x.times, y.times)) AS both_ FROM w AS x JOIN w AS y ON x.g = y.g AND x.h <> y.h WHERE x.df > 1 GROUP BY x.h, y.h) JOIN total AS p ON p.h = a JOIN total AS q ON q.h = b WHERE both_ >= 0.8 * (p.total + q.total - both_) - 1e-9),
reach AS (SELECT h, h AS o FROM texts UNION SELECT reach.h, edge.b FROM reach JOIN edge ON edge.a = reach.o),
class AS (SELECT r.h, min({{'first': x.first, 'h': x.h}}) AS least, sum(x.copies) AS class_size FROM reach AS r JOIN texts AS x ON x.h = r.o GROUP BY r.h)
SELECT d.doc_id, CASE WHEN d.doc_id IS NOT NULL THEN least.first END AS class_id, CAST(CASE WHEN d.doc_id IS NULL THEN 1 ELSE class_size END AS BIGINT) AS class_size, d.h AS text_hash, CASE WHEN d.doc_id IS NULL THEN d.h ELSE least.h END AS class_text FROM d LEFT JOIN class USING (h)"""


def url_rules(listed: list[Listed]) -> str:
    """All subsets of the tokens of every labelled URL are counted, which a small table allows."""
    quoted = lambda x: x.replace("'", "''")
    rules = ", ".join(f"({i}, '{quoted(r.host)}', '{quoted(r.path)}', '{r.verdict}')" for i, r in enumerate(listed))
    return rf"""WITH u AS (SELECT page_id, url, CASE WHEN url IS NULL THEN '' ELSE {_LOWER.format("regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1)")} END AS host, coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
t AS MATERIALIZED (SELECT *, CASE WHEN contains(url, '://') THEN list_sort(list_distinct(list_concat(['s=' || lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))],
  list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h=' || x),
  list_transform(list_filter(regexp_split_to_array(lower(path), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '' AND NOT regexp_full_match(x, '[0-9]+')), lambda x: 'p=' || x),
  list_transform(regexp_extract_all(regexp_extract(url, '\?([^#]*)', 1), '(?:^|&)([^=&]+)', 1), lambda x: 'q=' || x),
  CASE WHEN contains(url, '#') THEN ['#'] ELSE [] END))) ELSE [] END AS tokens FROM u),
labelled AS (SELECT tokens, (quality = 0 OR toxic = 1) AS bad FROM t JOIN labels ON labels.doc_id = t.page_id WHERE (quality = 0 OR toxic = 1) IS NOT NULL AND len(tokens) > 0),
n AS (SELECT count(*) AS n, ceil(least(1.0, greatest(0.002, 5.0 / greatest(count(*), 1))) * count(*)) AS need FROM labelled),
subset AS (SELECT bad, list_filter(tokens, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS items FROM (SELECT bad, tokens, unnest(range(1, CAST(1 AS BIGINT) << len(tokens))) AS mask FROM labelled)),
counted AS (SELECT items, count(*) AS freq, count(*) FILTER (bad) AS both_ FROM subset GROUP BY items),
rule AS MATERIALIZED (SELECT items, CAST(both_ AS DOUBLE) / freq AS confidence, CAST(both_ AS DOUBLE) / n.n AS support FROM counted, n WHERE both_ >= need AND CAST(both_ AS DOUBLE) / freq >= 0.5),
kept AS (SELECT *, sha256(array_to_string(items, chr(10))) AS rule_id FROM rule AS r WHERE NOT EXISTS (SELECT 1 FROM rule AS s WHERE len(s.items) < len(r.items) AND list_has_all(r.items, s.items) AND s.confidence >= r.confidence)),
fit AS (SELECT url, min({{'o': -confidence, 'rule_id': rule_id, 'support': support}}) AS b FROM (SELECT DISTINCT url, tokens FROM t) AS x JOIN kept ON list_has_all(x.tokens, kept.items) GROUP BY url),
listed(i, h, p, verdict) AS (VALUES {rules}),
own AS (SELECT page_id, url, arg_max(h || p, length(h || p) * 1000 - i) AS rule, arg_max(verdict, length(h || p) * 1000 - i) AS verdict FROM t JOIN listed ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id, url)
SELECT t.page_id, t.host, t.path, own.rule, coalesce(own.verdict, CASE WHEN fit.url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, fit.b.rule_id AS mined_rule, -fit.b.o AS confidence, fit.b.support AS support FROM t LEFT JOIN own ON own.page_id IS NOT DISTINCT FROM t.page_id AND own.url = t.url LEFT JOIN fit ON fit.url = t.url"""
