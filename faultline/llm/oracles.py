"""DuckDB SQL of the queries that SQL can express, over the driver's tables."""

from __future__ import annotations

from .chat import CONTROL, ChatParams
from .url_filter import Rule, Vocabulary, vocabulary_sql


def url_sql(rules: tuple[Rule, ...], v: Vocabulary) -> str:
    fit = "NULL"
    for r in sorted(rules, key=lambda r: len(r.text)):
        fit = f"CASE WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.text}' ELSE {fit} END"
    verdict = " ".join(f"WHEN '{r.text}' THEN '{r.verdict}'" for r in rules)
    strict, weight = vocabulary_sql(v, "url")
    there = lambda t: f"regexp_matches(lower(url), '(^|[^\\p{{L}}\\p{{N}}]){t}($|[^\\p{{L}}\\p{{N}}])')"
    listed = lambda terms: f"list_sort(list_filter([{', '.join(f"CASE WHEN {there(t)} THEN '{t}' END" for t in terms)}], lambda x: x IS NOT NULL))"
    return f"""
WITH parts AS (
  SELECT page_id, coalesce(url, '') AS url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
judged AS (
  SELECT *, {fit} AS rule, {strict} AS bad, {weight} AS weight FROM split)
SELECT page_id, host, path, rule, CASE rule {verdict} ELSE CASE WHEN bad OR weight >= {v.soft_limit} THEN 'block' ELSE 'allow' END END AS verdict,
  {listed(v.strict)} AS strict_hits, {listed(v.soft)} AS soft_hits, CAST(weight AS INTEGER) AS soft_weight FROM judged"""


_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda k: array_to_string(w[k : k + least(10, len(w)) - 1], ' '))) AS words
  FROM b WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT rid, n, unnest(range(1, len(w) - n + 2)) AS p, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k : k + n - 1], ' '))) AS words
  FROM d, lens WHERE len(w) >= n),
hit AS (SELECT rid, p, dw.n, item_id FROM dw JOIN win ON dw.n = win.n AND dw.words = win.words),
marked AS (SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(p, p + n)) AS place FROM hit) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (rid) LEFT JOIN named USING (rid)"""

_BASE32 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
_DIGEST = " || ".join(f"substr({_BASE32}, CAST((CAST('0x' || substr(h, {5 * g + 1}, 5) AS BIGINT) >> {15 - 5 * k}) & 31 AS BIGINT) + 1, 1)" for g in range(8) for k in range(4))

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT page_id, strlen(html) AS payload_bytes, {_DIGEST} AS payload_digest, min(page_id) OVER (PARTITION BY html) AS least FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM least THEN least END AS refers_to FROM m"""


def _escaped(c: str) -> str:
    out = f"replace({c}, '\\', '\\\\')"
    for x in CONTROL:
        out = f"replace({out}, '{x}', '{x[0]}\\{x[1:]}')"
    return out


def chat_sql(p: ChatParams) -> str:
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (
  SELECT *, row_number() OVER w AS pos, CAST(ceil(strlen(text) / {p.bytes_per_token}.0) AS BIGINT) + {p.turn_tokens} AS tokens,
    length({_escaped('role')}) + 10 + length({_escaped('text')}) + 8 AS chars
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
b AS (
  SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY pos) - tokens AS before,
    first_value(CASE WHEN role = 'system' THEN chars END) OVER (PARTITION BY conv_id ORDER BY pos) AS system_chars,
    first_value(CASE WHEN role = 'system' THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos) AS system_tokens
  FROM o),
s AS (SELECT *, greatest({max(1, p.budget // 4)}, {p.budget - p.history} - system_tokens) AS size FROM b),
h AS (SELECT *, CAST(floor(before / size) AS BIGINT) AS share FROM s),
e AS (SELECT *, before + tokens - (share + 1) * size AS over, min(before) OVER (PARTITION BY conv_id, share) - share * size AS taken FROM h),
w AS (SELECT *, 2 * share + CASE WHEN over > 0 AND over > taken THEN 1 ELSE 0 END AS win FROM e),
g AS (SELECT *, coalesce(lag(win) OVER (PARTITION BY conv_id ORDER BY pos) <> win, false) AS begins FROM w),
l AS (SELECT *, count(*) FILTER (WHERE begins) OVER (PARTITION BY conv_id ORDER BY before RANGE BETWEEN 1 FOLLOWING AND {p.history} FOLLOWING) AS later FROM g),
n AS (
  SELECT *, chars * (1 + CASE WHEN pos = 1 AND role = 'system' THEN 0 ELSE later END) + CASE WHEN begins THEN coalesce(system_chars, 0) ELSE 0 END AS written FROM l)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(written) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id"""


EMBEDDING = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS rid, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.rid AS u, b.rid AS v FROM v a JOIN v b ON a.rid <> b.rid AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT rid AS u, rid AS v FROM v UNION SELECT reach.u, links.v FROM reach JOIN links ON links.u = reach.v),
named AS (SELECT reach.u AS rid, min(v.vec_id) AS component_id FROM reach JOIN v ON v.rid = reach.v GROUP BY reach.u),
counted AS (SELECT u AS rid, count(*) AS n_links FROM links GROUP BY u)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN named USING (rid) LEFT JOIN counted USING (rid)
UNION ALL SELECT vec_id, 0, vec_id, true FROM embeddings
WHERE embedding IS NULL OR len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 OR len(list_filter(embedding, lambda x: x <> 0)) = 0"""
