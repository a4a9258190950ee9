"""DuckDB SQL for the results of the registered queries, where SQL can state them."""

from __future__ import annotations

from .urlfilter import TWO_LABELS

_RENDER = "'<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)"


def _spans(turns: str) -> str:
    before = f"coalesce(list_sum(list_transform({turns}[1:i-1], lambda x: length({_RENDER}))), 0)"
    start = f"({before} + length({turns}[i].role) + 5)::bigint"
    return f"""array_to_string(list_transform(list_filter(range(1, len({turns}) + 1), lambda i: {turns}[i].role = 'assistant'),
        lambda i: {start} || '-' || ({start} + length({turns}[i].text) + 7)), ',')"""


def _framed(*values: str) -> str:
    return " || ".join(f"coalesce(strlen(({v})::varchar) || ':' || ({v})::varchar, '-')" for v in values)


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Eight steps a byte; the byte comes in with the first of them.
_CRC32 = """xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(range(1, len(doc_id::varchar) + 1), lambda i: [ascii(substr(doc_id::varchar, i, 1))::bigint, 0, 0, 0, 0, 0, 0, 0]))),
  lambda c, b: CASE WHEN xor(c, b) & 1 = 1 THEN xor(xor(c, b) >> 1, 3988292384) ELSE xor(c, b) >> 1 END), 4294967295)"""

#: Trees by level: one of each language, then that of the subroots.
_MERKLE = f"""
WITH RECURSIVE leaf AS (
  SELECT doc_id, lang, sha256({_framed("doc_id", "source", "lang", "n_chars", "text")}) AS leaf,
    sha256({_framed("doc_id", "source", "lang", "n_chars", f"CASE WHEN {_CRC32} % 3 = 0 THEN {_LOWER} ELSE text END")}) AS now
  FROM documents),
placed AS (
  SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaf),
node AS (
  SELECT lang, 0 AS level, pos, n, leaf AS d FROM placed
  UNION ALL
  SELECT lang, level + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(d, '' ORDER BY pos)) FROM node WHERE n > 1 GROUP BY lang, level, pos // 8),
language AS (SELECT lang, d, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM node WHERE n = 1),
upper_node AS (
  SELECT 0 AS level, pos, n, d FROM language
  UNION ALL
  SELECT level + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(d, '' ORDER BY pos)) FROM upper_node WHERE n > 1 GROUP BY level, pos // 8),
fold AS (
  SELECT id, lang, 0 AS level, pos, n, now AS d, '' AS others FROM placed
  UNION ALL
  SELECT f.id, any_value(f.lang), any_value(f.level) + 1, any_value(f.pos) // 8, (any_value(f.n) + 7) // 8,
    sha256(string_agg(CASE WHEN s.pos = f.pos THEN f.d ELSE s.d END, '' ORDER BY s.pos)),
    any_value(f.others) || coalesce(string_agg(s.d, '' ORDER BY s.pos) FILTER (s.pos <> f.pos), '')
  FROM fold f JOIN node s ON s.lang IS NOT DISTINCT FROM f.lang AND s.level = f.level AND s.pos // 8 = f.pos // 8 WHERE f.n > 1 GROUP BY f.id),
upper_fold AS (
  SELECT f.id, 0 AS level, l.pos, l.n, f.d, f.others, l.d AS subroot FROM fold f JOIN language l ON l.lang IS NOT DISTINCT FROM f.lang WHERE f.n = 1
  UNION ALL
  SELECT f.id, any_value(f.level) + 1, any_value(f.pos) // 8, (any_value(f.n) + 7) // 8,
    sha256(string_agg(CASE WHEN s.pos = f.pos THEN f.d ELSE s.d END, '' ORDER BY s.pos)),
    any_value(f.others) || coalesce(string_agg(s.d, '' ORDER BY s.pos) FILTER (s.pos <> f.pos), ''), any_value(f.subroot)
  FROM upper_fold f JOIN upper_node s ON s.level = f.level AND s.pos // 8 = f.pos // 8 WHERE f.n > 1 GROUP BY f.id)
SELECT p.doc_id, p.leaf, f.subroot, r.d AS root, sha256(f.others) AS proof_sha256, f.d AS folded_root, f.d = r.d AS verified
FROM upper_fold f JOIN placed p USING (id), (SELECT d FROM upper_node WHERE n = 1) r WHERE f.n = 1"""

ORACLES = {
    "op11_merkle_manifest": _MERKLE,
    "op4_preference_pairs": f"""
WITH talk AS (
  SELECT conv_id, list({{'role': coalesce(role, 'unknown'), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
following AS (SELECT conv_id, coalesce(lead(conv_id) OVER (ORDER BY conv_id), min(conv_id) OVER ()) AS n FROM talk),
pair AS (
  SELECT c.conv_id, c.t AS a, list_append(c.t[1:len(c.t)-1], {{'role': c.t[len(c.t)].role, 'text': o.t[len(o.t)].text}}) AS b
  FROM talk c JOIN following f USING (conv_id) JOIN talk o ON o.conv_id = f.n),
cut AS (SELECT *, (coalesce(list_min(list_filter(range(1, greatest(len(a), len(b)) + 1), lambda i: a[i] IS DISTINCT FROM b[i])), len(a) + 1) - 1)::int AS k FROM pair),
part AS (SELECT conv_id, k, a[1:k] AS p, a[k+1:len(a)] AS a, b[k+1:len(b)] AS b FROM cut)
SELECT conv_id AS pair_id, k AS prefix_turns,
  coalesce(array_to_string(list_transform(p, lambda x: {_RENDER}), ''), '') AS prompt,
  coalesce(array_to_string(list_transform(a, lambda x: {_RENDER}), ''), '') AS chosen,
  coalesce(array_to_string(list_transform(b, lambda x: {_RENDER}), ''), '') AS rejected,
  {_spans("a")} AS chosen_spans, {_spans("b")} AS rejected_spans
FROM part""",
    "op6_benchmark_decontamination": """
WITH words AS (
  SELECT 0 AS kind, doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') FROM benchmark),
shingles AS (
  SELECT DISTINCT kind, id, array_to_string(w[i:i+4], ' ') AS s
  FROM (SELECT kind, id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)),
sizes AS (SELECT id AS item_id, count(*) AS n FROM shingles WHERE kind = 1 GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, count(*)::int AS shared, any_value(n)::int AS item_shingles, count(*) / any_value(n)::double AS containment
FROM shingles d JOIN shingles i ON d.kind = 0 AND i.kind = 1 AND d.s = i.s JOIN sizes ON sizes.item_id = i.id
GROUP BY d.id, i.id HAVING count(*) >= 0.8 * any_value(n)""",
    "op8_url_filter": """
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
known AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
hosts AS (
  SELECT host, CASE WHEN bare IS_ADDRESS THEN bare WHEN TWO IN (WIDE) THEN regexp_extract(bare, '([^.]*\\.)?([^.]*\\.)?[^.]*$') ELSE TWO END AS domain,
    CASE WHEN bare IS_ADDRESS THEN '[address]' WHEN TWO IN (WIDE) THEN TWO ELSE regexp_extract(bare, '[^.]*$') END AS suffix, count(bad) AS n, coalesce(sum(bad), 0) AS bad
  FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\\.+$', '') AS bare FROM parsed LEFT JOIN known USING (page_id)) GROUP BY host, bare),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix),
overall AS (SELECT (sum(bad) + 0.5::double) / (sum(n) + 1.0::double) AS mean FROM suffixes),
k1 AS (SELECT SPREAD AS rho FROM suffixes, overall WHERE n > 0),
s AS (SELECT suffix, (bad + k * mean) / (n + k) AS post FROM suffixes, overall, (SELECT STRENGTH AS k FROM k1)),
k2 AS (SELECT SPREAD AS rho FROM (SELECT d.*, post AS mean FROM domains d JOIN s USING (suffix)) WHERE n > 0),
d AS (SELECT domain, (bad + k * s.post) / (n + k) AS post FROM domains JOIN s USING (suffix), (SELECT STRENGTH AS k FROM k2)),
k3 AS (SELECT SPREAD AS rho FROM (SELECT h.*, post AS mean FROM hosts h JOIN d USING (domain)) WHERE n > 0),
h AS (SELECT host, n, k, (bad + k * d.post) / (n + k) AS post FROM hosts JOIN d USING (domain), (SELECT STRENGTH AS k FROM k3)),
judged AS (SELECT p.*, post AS bad_mean, post - 0.5::double * sqrt(post * (1 - post) / (n + k + 1)) AS bad_bound FROM parsed p JOIN h USING (host)),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM judged)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN bad_bound >= (SELECT mean FROM overall) THEN 'block' ELSE 'allow' END AS verdict,
  round(bad_mean, 9) AS bad_mean, round(bad_bound, 9) AS bad_bound
FROM ruled""".replace("WIDE", ", ".join(f"'{x}'" for x in TWO_LABELS)).replace("TWO", "regexp_extract(bare, '([^.]*\\.)?[^.]*$')").replace("bare IS_ADDRESS", "regexp_matches(bare, '^([0-9]{1,3}(\\.[0-9]{1,3}){3}|\\[.*\\])$')").replace("SPREAD", "(sum(CASE WHEN mean * (1 - mean) > 0 THEN pow(bad - n * mean, 2) / n / (mean * (1 - mean)) END) - count(*) FILTER (mean * (1 - mean) > 0)) / nullif(sum(CASE WHEN mean * (1 - mean) > 0 THEN n - 1 END), 0)::double").replace(
        "STRENGTH", "coalesce(least(100.0::double, greatest(1.0::double, (1 - greatest(rho, 1e-9::double)) / greatest(rho, 1e-9::double))), 100.0::double)"
    ),
}
