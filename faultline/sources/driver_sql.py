"""The same relations for DuckDB, stated on their own as common table expressions."""

from __future__ import annotations

from .driver import FOLDERS, TITLES

_quoted = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
_hash = lambda c: f"sha256(CAST({c} AS VARCHAR))"

RELATIONS = f"""
bugs AS (
  SELECT o_orderkey AS bug_id, o_orderkey AS position, 'fn_' || (o_custkey % 97) AS function, o_custkey AS custkey, o_orderdate AS opened,
    o_orderpriority AS priority, o_orderstatus AS status, o_totalprice AS weight,
    replace(replace({_quoted(TITLES)}[CAST(o_orderkey % {len(TITLES)} AS BIGINT) + 1], '{{f}}', 'fn_' || (o_custkey % 97)), '{{g}}', 'fn_' || (o_orderkey % 89))
      || CASE WHEN o_orderkey % 7 = 0 THEN ' (2)' ELSE '' END AS title
  FROM orders),
tags AS (
  SELECT DISTINCT c_custkey AS custkey, tag FROM (
    SELECT c_custkey, lower(c_mktsegment) AS tag FROM customer
    UNION ALL SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT c_custkey, lower(n_name) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 5 = 0)),
subsystems AS (SELECT bug_id, tag FROM bugs JOIN tags USING (custkey)),
fix_refs AS (
  SELECT l_orderkey AS bug_id, CASE WHEN l_linenumber % 2 = 0 THEN 'listing' ELSE 'detail' END AS kind,
    CASE WHEN l_returnflag <> 'R' THEN {_hash('l_suppkey')} END AS hash, p_name AS title, p_brand AS repo,
    {{'l_linenumber': l_linenumber, 'l_partkey': l_partkey, 'l_suppkey': l_suppkey}} AS position
  FROM lineitem JOIN part ON l_partkey = p_partkey),
patches AS (SELECT {_hash('s_suppkey')} AS hash, s_suppkey AS suppkey, s_suppkey % 5 <> 0 AS is_valid, s_suppkey % 7 <> 0 AS is_complete FROM supplier),
ranges AS (
  SELECT {_hash('(p_partkey % (SELECT count(*) FROM supplier))')} AS hash, CASE WHEN p_partkey % 13 <> 0 THEN folder || name END AS old_path,
    CASE WHEN p_partkey % 17 <> 0 THEN folder || CASE WHEN p_partkey % 19 = 0 THEN '/moved' ELSE '' END || name END AS new_path,
    p_partkey % 500 + 1 AS old_start, CAST(p_size % 9 AS BIGINT) AS old_count, p_partkey % 11 AS new_count, 'fn_' || (p_partkey % 97) AS function,
    CASE WHEN p_partkey % 350 = 0 THEN 'binary' WHEN p_partkey % 351 = 0 THEN 'unparsed' ELSE 'text' END AS kind
  FROM (SELECT *, {_quoted(FOLDERS)}[p_size % {len(FOLDERS)} + 1] AS folder, '/f' || (p_partkey % 40) || '.c' AS name FROM part)),
sites AS (
  SELECT bug_id, CASE WHEN bug_id % 11 <> 0 THEN {_quoted(FOLDERS)}[CAST(custkey % {len(FOLDERS)} AS BIGINT) + 1] || '/f' || (bug_id % 40) || '.c' END AS path,
    CASE WHEN bug_id % 11 <> 0 THEN bug_id % 500 + 1 END AS line, function FROM bugs),
reports AS (
  SELECT bug_id, title, CASE WHEN bug_id % 10 = 0 THEN '<html>' || text || '</html>' ELSE text END AS report FROM (
    SELECT bug_id, title, concat_ws(chr(10), title, CASE WHEN bug_id % 2 = 0 THEN 'Read' ELSE 'Write' END || ' of size 8 at addr ffff88 by task exe/' || (bug_id % 50), '', 'CPU: 0 PID: 7 Comm: exe',
      'Call Trace:', ' <TASK>', ' dump_stack_lvl+0x1/0x2 lib/dump_stack.c:106', ' ' || b.function || '.constprop.0+0x10/0x20 ' || coalesce(path, 'fs/none.c') || ':' || coalesce(line, 1),
      ' fn_' || (bug_id % 89) || '+0x3/0x4 fs/open.c:' || (bug_id % 90 + 1), ' do_syscall_64+0x5/0x6', 'Allocated by task 7:', ' kmem_alloc+0x1/0x9 mm/slab.c:33',
      'Freed by task ' || (bug_id % 3 + 6) || ':', ' kfree+0x1/0x9 mm/slab.c:44',
      CASE WHEN bug_id % 4 = 0 THEN 'The buggy address belongs to the object' END, CASE WHEN bug_id % 4 = 0 THEN ' timer_fn+0x1/0x9 kernel/time/timer.c:5' END) AS text
    FROM bugs b JOIN sites USING (bug_id)) WHERE bug_id % 9 <> 0),
payloads AS (
  SELECT doc_id, 'id-' || doc_id AS key, text AS content, source, quality = 1 AS is_valid
  FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id))"""


def with_relations(body: str, more: str = "") -> str:
    """A query over the relations; more: further common table expressions."""
    return f"WITH {RELATIONS}{', ' + more if more else ''} {body}"
