"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

from .quality_rules import quantile
from .secret_scan import RULES

_WORD = r"[^\x20\x09-\x0D]+"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def secret_scan() -> str:
    """Matches and what lies between them give the offsets of each rule."""
    parts = []
    for nth, r in enumerate(RULES):
        p = _quoted(r.pattern)
        parts.append(
            f"""SELECT doc_id, {nth} AS nth, '{r.kind}' AS kind, {str(r.base).lower()} AS base, {r.least} AS least,
            regexp_extract_all(t, {p}, 0) AS m, regexp_extract_all(t, {p}, {r.group}) AS g, regexp_split_to_array(t, {p}) AS gap FROM d WHERE regexp_matches(t, {p})"""
        )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
raw AS ({' UNION ALL '.join(parts)}),
one AS (SELECT *, generate_subscripts(m, 1) AS i FROM raw),
off AS (SELECT doc_id, nth, kind, base, least, length(g[i]) AS held,
  (list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::BIGINT AS s, length(m[i]) AS len FROM one),
span AS (SELECT doc_id, nth, kind, base, s, kind || ':' || s || ':' || (s + len) AS label FROM off WHERE held >= least),
agg AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(label, ',' ORDER BY s, nth) FILTER (base) AS b, string_agg(label, ',' ORDER BY s, nth) AS spans FROM span GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN agg USING (doc_id)"""


EXACT_DEDUP = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)"""

MIX_SOURCES = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size,
    substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
l AS (SELECT *, row_number() OVER f AS n,
    sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER () - coalesce(sum(weight) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS share
  FROM w WINDOW f AS (ORDER BY source_size / weight, source NULLS LAST)),
o AS (SELECT min(n) FILTER (rest * weight < 3 * source_size * share) AS first FROM l),
t AS (SELECT source, source_size, CASE WHEN first IS NULL OR n < first THEN (3 * source_size)::DOUBLE
    ELSE (SELECT rest::DOUBLE FROM l WHERE n = first) * weight / (SELECT share FROM l WHERE n = first) END AS target FROM l, o),
g AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS whole FROM t),
b AS (SELECT source, h, sum(size) AS size FROM d WHERE size > 0 GROUP BY source, h),
c AS (SELECT b.*, sum(b.size) OVER (PARTITION BY b.source ORDER BY h) AS upto, target - whole * source_size AS goal
  FROM b JOIN g ON b.source IS NOT DISTINCT FROM g.source),
x AS (SELECT *, upto <= goal OR (upto - size < goal AND upto - goal < goal - (upto - size)) AS part FROM c WHERE goal > 0)
SELECT d.doc_id, d.size, g.source_size, g.target, d.size * (g.whole + coalesce(x.part, false)::INT)::BIGINT AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
LEFT JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.h = x.h AND d.size > 0"""

QUALITY_RULES = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_WORD}') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM d),
tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS times FROM
  (SELECT doc_id, i, words[i] AS a, words[i+1] AS b, words[i+2] AS c FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 2)) AS i FROM w WHERE len(words) > 2))),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM tri, (VALUES (0), (1), (2)) AS o(k) WHERE times > 1 GROUP BY doc_id),
m AS (SELECT doc_id, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 50 AS f_short, 100 * n_repeat_words > 50 * n_words AS f_repeats, n_symbols > n_words AS f_symbols, n_dup_lines > 0.5 * n_lines AS f_dup_lines FROM m),
l AS (SELECT doc_id, source, unnest(['short', 'repeats', 'symbols', 'dup_lines']) AS rule, unnest([f_short, f_repeats, f_symbols, f_dup_lines]) AS failed FROM b),
h AS (SELECT source, rule, count(*) AS n, count(*) FILTER (failed) AS k FROM l GROUP BY ALL),
t AS (SELECT rule, sum(n) AS total, sum(n * n) AS nn, count(*) AS hosts, sum(k) / sum(n) AS mean FROM h GROUP BY rule),
v AS (SELECT rule, any_value(total) AS total, any_value(mean) AS mean, any_value(mean * (1 - mean)) AS noise,
    (sum(n * (k / n - mean) * (k / n - mean)) - (any_value(hosts) - 1) * any_value(mean * (1 - mean))) / nullif(any_value(total - nn / total), 0) AS between FROM h JOIN t USING (rule) GROUP BY rule),
q AS (SELECT *, CASE WHEN between > 0 AND noise > 0 THEN least(greatest(noise / between - 1, 1), total) ELSE greatest(total, 1) END AS weight FROM v),
p AS (SELECT source, rule, mean, k + mean * weight AS a, n - k + (1 - mean) * weight AS b FROM h JOIN q USING (rule) WHERE mean > 0 AND mean < 1),
r AS (SELECT source, rule, CASE WHEN rule IN ('short', 'repeats') THEN round(ln(a / b) / sqrt(1 / a + 1 / b), 9) >= {quantile(0.95)}
    ELSE round((ln(a / b) - ln(mean / (1 - mean))) / sqrt(1 / a + 1 / b), 9) >= {quantile(0.9)} END AS sure FROM p),
s AS (SELECT h.source, coalesce(bool_or(sure) FILTER (rule IN ('short', 'repeats')), false) AS host_failed, coalesce(bool_or(sure) FILTER (rule = 'symbols'), false) AS w_symbols,
    coalesce(bool_or(sure) FILTER (rule = 'dup_lines'), false) AS w_dup_lines FROM (SELECT DISTINCT source FROM h) AS h LEFT JOIN r ON h.source IS NOT DISTINCT FROM r.source GROUP BY h.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f_short OR f_repeats AS base_failed,
    NOT (f_short OR f_repeats OR host_failed OR (w_symbols AND f_symbols) OR (w_dup_lines AND f_dup_lines)) AS kept
FROM b JOIN s ON b.source IS NOT DISTINCT FROM s.source"""

#: The pages of the test tables hold neither canonical links nor redirects; the components are in the recursive part.
URL_FILTER = r"""
WITH RECURSIVE u AS (SELECT page_id, html, coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '') AS raw,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path, coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*[^?#]*(\?[^#]*)', 1), '') AS q FROM pages),
p AS (SELECT page_id, html, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path, q FROM u),
n AS (SELECT *, host || path || q AS node FROM p),
tags AS (SELECT node, unnest(regexp_extract_all(html, '(?i)<link\b[^>]*canonical[^>]*>')) AS tag FROM n WHERE host <> ''),
raw_edges AS (SELECT node AS a, regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?(?:https?:)?//([^"''\s>#]*)', 1) AS b FROM tags),
e AS (SELECT a, b FROM raw_edges WHERE b <> '' UNION SELECT b, a FROM raw_edges WHERE b <> ''),
reach AS (SELECT DISTINCT a, a AS b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
rules(verdict, rule, h, pre) AS (VALUES ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'),
    ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')),
named AS (SELECT node, host, path FROM n UNION SELECT b, regexp_extract(b, '^[^/?#]*', 0), regexp_extract(b, '^[^/?#]*([^?#]*)', 1) FROM e),
best AS (SELECT node, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS own
    FROM named JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY node),
near AS (SELECT reach.a, bool_or(own = 'block') AND NOT bool_or(own = 'allow') AS blocked FROM reach JOIN best ON reach.b = best.node GROUP BY reach.a)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN blocked THEN 'block' END, 'allow') AS verdict
FROM n LEFT JOIN best USING (node) LEFT JOIN near ON n.node = near.a"""

FILTER_AUDIT = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_WORD}') AS ws FROM d),
b AS (SELECT doc_id, part, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b,
    100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n,
    count(*) FILTER (coalesce(good, false)) AS good, count(*) FILTER (coalesce(toxic, false)) AS toxic FROM b LEFT JOIN l USING (doc_id) GROUP BY ALL),
f(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT p.f || q.f || r.f || s.f || t.f AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits FROM f p, f q, f r, f s, f t
    WHERE len(list_distinct([p.f, q.f, r.f, s.f, t.f])) = 5),
s AS (SELECT filter_order, k AS step, bits[k] AS own, coalesce(list_sum(bits[1:k - 1]), 0)::INT AS earlier FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
r AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (mask & (own | earlier) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & own > 0 AND mask & earlier = 0), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (mask & own > 0 AND mask & earlier > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (mask & own > 0 AND mask & earlier = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (mask & own > 0 AND mask & earlier = 0), 0)::BIGINT AS toxic_lost FROM m, s GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r"""

COLLOCATIONS = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
i AS (SELECT lang, ws, unnest(generate_series(1, len(ws))) AS i FROM w WHERE len(ws) > 0),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM i, (VALUES (1), (2), (3), (4), (5)) AS s(k) WHERE i + k - 1 <= len(ws)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
x AS (SELECT c.lang, c.phrase, c.k, c.a, c.ws, j, array_to_string(c.ws[1:j], ' ') AS head, array_to_string(c.ws[j + 1:], ' ') AS rest FROM c, (VALUES (1), (2), (3), (4)) AS s(j) WHERE j < c.k),
y AS (SELECT x.lang, x.phrase, x.a, j, l.a AS l, r.a AS r, n, (1000::HUGEINT * x.a * n) // (l.a::HUGEINT * r.a) AS score FROM x
    JOIN f AS l ON l.lang = x.lang AND l.phrase = head JOIN f AS r ON r.lang = x.lang AND r.phrase = rest JOIN n ON n.lang = x.lang),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
o AS (SELECT DISTINCT o.lang, array_to_string(o.ws[i:i + s.k - 1], ' ') AS phrase, o.a AS around FROM c AS o, (VALUES (2), (3), (4)) AS s(k), (VALUES (1), (2), (3), (4)) AS t(i)
    WHERE s.k < o.k AND i + s.k - 1 <= o.k),
m AS (SELECT lang, phrase, max(around) AS around FROM o GROUP BY ALL),
k AS (SELECT z.* FROM z LEFT JOIN m USING (lang, phrase) WHERE around IS NULL OR around < a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM k
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000"""

ORACLES: dict[str, str] = {
    "op1_secret_scan": secret_scan(),
    "op2_exact_dedup": EXACT_DEDUP,
    "op5_mix_sources": MIX_SOURCES,
    "op9_quality_rules": QUALITY_RULES,
    "op10_url_filter": URL_FILTER,
    "op12_filter_audit": FILTER_AUDIT,
    "op13_collocations": COLLOCATIONS,
}
