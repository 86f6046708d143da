"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_SPACED = r"[^\x20\x09-\x0D]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _rules(docs: str) -> str:
    """CTEs up to ``judged`` over the relation ``docs``, with a row number as key."""
    return rf"""
numbered AS (SELECT *, row_number() OVER () AS rn, coalesce(text, '') AS t FROM {docs}),
tokens AS (SELECT rn, doc_id, t, regexp_extract_all(t, '{_SPACED}') AS w, string_split(t, chr(10)) AS ls FROM numbered),
grams AS (SELECT rn, unnest(range(1, len(w) - 1)) AS i, w FROM tokens WHERE len(w) >= 3),
keyed AS (SELECT rn, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM grams),
twice AS (SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, a, b, c) AS n FROM keyed) WHERE n > 1),
covered AS (SELECT rn, count(DISTINCT p) AS n_repeat_words FROM (SELECT rn, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rn),
lines AS (SELECT rn, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
          FROM (SELECT rn, unnest(ls) AS l FROM tokens) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rn),
measured AS (
  SELECT t.rn, t.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM tokens t LEFT JOIN covered USING (rn) LEFT JOIN lines USING (rn)),
masked AS (
  SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (100 * n_symbols > 30 * n_words)::INT
                 + 8 * (100 * n_dup_lines > 50 * n_lines)::INT + 16 * (word_chars > 40 * n_words)::INT AS INT) AS fail_mask FROM measured),
judged AS (SELECT *, (fail_mask & 3) <> 0 AS base_failed, fail_mask = 0 AS kept FROM masked)"""


def _hits(docs: str) -> str:
    """CTEs up to ``spans`` (document positions hit, by row number and item)."""
    return rf"""
dw AS (SELECT rn, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM {docs}),
iw AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, len(win) AS n, array_to_string(win, ' ') AS win
         FROM (SELECT item_id, unnest([w[s:s + least(10, len(w)) - 1] FOR s IN range(1, len(w) - least(10, len(w)) + 2)]) AS win FROM iw WHERE len(w) > 0)),
runs AS (SELECT rn, s, n, array_to_string(w[s:s + n - 1], ' ') AS win
         FROM (SELECT rn, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)),
spans AS (SELECT rn, s, runs.n AS n, item_id FROM runs JOIN wins USING (n, win)),
hits AS (SELECT rn, count(DISTINCT p) AS n_hit FROM (SELECT rn, unnest(range(s, s + n)) AS p FROM spans) GROUP BY rn),
items AS (SELECT rn, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
          FROM (SELECT DISTINCT rn, CAST(item_id AS VARCHAR) AS item FROM spans) GROUP BY rn)"""


OP8 = f"""WITH {_rules("documents")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, fail_mask FROM judged"""

OP2 = f"""WITH d AS (SELECT *, row_number() OVER () AS rn FROM documents), {_hits("d")}
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d JOIN dw USING (rn) LEFT JOIN hits USING (rn) LEFT JOIN items USING (rn)"""

OP3 = rf"""WITH RECURSIVE
d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_SPACED}') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                             ELSE [array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)] END) AS g FROM d)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * m >= 85 * (p.n + q.n - m)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT x, y FROM both_ways UNION SELECT r.x, e.y FROM reach r JOIN both_ways e ON r.y = e.x)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, CAST(least(d.doc_id, coalesce(m, d.doc_id)) AS BIGINT) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT x, min(y) AS m FROM reach GROUP BY x) ON x = d.doc_id"""


def _rest(url: str) -> str:
    return f"(CASE WHEN strpos({url}, '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) ELSE '' END)"


def _host(rest: str) -> str:
    return _LOWER.format(f"regexp_extract({rest}, '^[^/?#]*')")


def _path(rest: str) -> str:
    return f"regexp_extract(substr({rest}, length(regexp_extract({rest}, '^[^/?#]*')) + 1), '^[^?#]*')"


def _key(url: str) -> str:
    bare = f"regexp_replace({_rest(url)}, '(?s)#.*$', '')"
    return f"({_host(bare)} || substr({bare}, length(regexp_extract({bare}, '^[^/?#]*')) + 1))"


def _rule(host: str, path: str) -> str:
    fits = lambda h, p: f"({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}')"
    order = (("www.example.com", "/en/"), ("example.com", "/en/"), ("net", "/es/"), ("net", "/fr/"), ("com", "/"))
    return "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p in order) + " END"


_VERDICT = "CASE {0} WHEN 'www.example.com/en/' THEN 'allow' WHEN 'com/' THEN 'allow' WHEN NULL THEN NULL ELSE CASE WHEN {0} IS NOT NULL THEN 'block' END END"

OP5 = rf"""WITH RECURSIVE
pg AS (SELECT row_number() OVER () AS rn, page_id, coalesce(url, '') AS u, coalesce(html, '') AS h, url IS NOT NULL AS has FROM pages),
r AS (SELECT *, {_rest("u")} AS rest FROM pg),
tags AS (SELECT u, rest, unnest(regexp_extract_all(h, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM r WHERE has),
found AS (SELECT u, rest, CASE WHEN regexp_matches(tag, '(?is)^<link') AND regexp_matches(tag, '(?is)\brel\s*=\s*["'']?canonical\b') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
  WHEN regexp_matches(tag, '(?is)^<meta') AND regexp_matches(tag, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?is)\bcontent\s*=\s*["''][^"''>]*?\burl\s*=\s*([^"''\s>]+)', 1) END AS t FROM tags),
full_ AS (SELECT u, CASE WHEN contains(t, '://') THEN t WHEN starts_with(t, '//') THEN 'http:' || t WHEN starts_with(t, '/') THEN 'http://' || {_host("rest")} || t
  WHEN contains(regexp_extract(rest, '^[^?#]*'), '/') THEN 'http://' || regexp_replace(regexp_extract(rest, '^[^?#]*'), '[^/]*$', '') || t ELSE 'http://' || regexp_extract(rest, '^[^?#]*') || '/' || t END AS v
  FROM found WHERE coalesce(t, '') <> ''),
links AS (SELECT DISTINCT {_key("u")} AS x, {_key("v")} AS y FROM full_),
e AS (SELECT x, y FROM links WHERE x <> y AND x <> '' AND y <> '' UNION SELECT y, x FROM links WHERE x <> y AND x <> '' AND y <> ''),
reach(x, y) AS (SELECT x, y FROM e UNION SELECT a.x, b.y FROM reach a JOIN e b ON a.y = b.x),
judged AS (SELECT x, least(x, y) AS c, {_rule(_host("y"), _path("y"))} AS w FROM reach),
parts AS (SELECT x, min(c) AS component, bool_or(coalesce({_VERDICT.format("w")} = 'block', false)) AS blocked, bool_or(coalesce({_VERDICT.format("w")} = 'allow', false)) AS allowed FROM judged GROUP BY x),
own AS (SELECT page_id, {_host("rest")} AS host, {_path("rest")} AS path, {_key("u")} AS k FROM r),
ruled AS (SELECT *, {_rule("host", "path")} AS rule FROM own)
SELECT page_id, host, path, rule, coalesce({_VERDICT.format("rule")}, CASE WHEN coalesce(blocked AND NOT allowed, false) THEN 'block' ELSE 'allow' END) AS verdict, component
FROM ruled LEFT JOIN parts ON x = k"""

ORACLES = {"op2_decontaminate": OP2, "op3_near_duplicates": OP3, "op5_url_filter": OP5, "op8_quality_rules": OP8}
