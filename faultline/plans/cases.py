"""Queries over versions, failures, counters, and how rows are shown."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus, ingest, present, research
from ..sources import mirror
from ..sources.driver import DriverTables
from ..sources.driver_sql import with_relations
from .core import CLASSIFIED, METRICS, _VALID_REPORT, load
from .detail import documents

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


@query("SELECT page_id, page_id % 7 IN (0, 1, 2, 4) AS markup FROM pages")
def audit_markup(spark, d):
    """Pages behind declarations and comments, and texts that only look like them."""
    k = F.col("page_id")
    kinds = ("<p>x", "﻿ \n<?xml version='1'?>\n<!-- a --> <!-- b --><html>", "<!DOCTYPE  html>", "<!doctype htmlx>", "<h3 class='a'>", "text <p>", "<!-- open <p>")
    text = F.coalesce(*(F.when(k % 7 == i, F.lit(x)) for i, x in enumerate(kinds)))
    return DriverTables(spark, d).raw("pages").select("page_id", corpus.is_audit_markup(text).alias("markup"))


@query("SELECT '| ' || p_partkey || ' | ' || CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN 'a \\| b' ELSE repeat('x', 19) || '…' END || ' |' AS line FROM part")
def markdown_table(spark, d):
    k = F.col("p_partkey")
    rows = DriverTables(spark, d).raw("part").select(k.alias("k"), F.when(k % 3 == 1, "a  |\n b").when(k % 3 == 2, "x" * 30).alias("t"))
    return present.markdown_rows(rows, 20)


@query("""SELECT '{"a":{"x":' || CASE WHEN p_size % 2 = 0 THEN 'null' ELSE CAST(p_size AS VARCHAR) END || ',"y":"' || p_brand || '"},"b":[{"m":1,"n":' || p_partkey || '}],"k":' || p_partkey || '}' AS json FROM part""")
def canonical_json(spark, d):
    own = F.struct(F.col("p_brand").alias("y"), F.when(F.col("p_size") % 2 != 0, F.col("p_size")).alias("x"))
    return present.canonical_json(DriverTables(spark, d).raw("part").select(F.col("p_partkey").alias("k"), F.array(F.struct(F.col("p_partkey").alias("n"), F.lit(1).alias("m"))).alias("b"), own.alias("a")))


@query(with_relations(f"""SELECT count(*) AS catalog_bugs, count(*) FILTER (WHERE bug_id % 23 <> 0) AS bug_json, (SELECT count(*) FROM reports WHERE NOT {_VALID_REPORT}) AS crash_reports, count(*) - (SELECT count(*) FROM reports WHERE NOT {_VALID_REPORT}) AS missing_reports,
  count(*) FILTER (WHERE bug_id IN (SELECT bug_id FROM fix_refs WHERE hash IS NOT NULL)) AS bugs_with_fix_hash, count(*) FILTER (WHERE bug_id NOT IN (SELECT bug_id FROM fix_refs WHERE hash IS NOT NULL)) AS bugs_without_fix_hash,
  (SELECT count(DISTINCT hash) FROM fix_refs) AS unique_fix_hashes, (SELECT count(DISTINCT f.hash) FROM fix_refs f JOIN patches p ON p.hash = f.hash AND is_valid) AS patches_on_disk,
  (SELECT count(DISTINCT hash) FROM fix_refs) - (SELECT count(DISTINCT f.hash) FROM fix_refs f JOIN patches p ON p.hash = f.hash AND is_valid) AS missing_patches FROM bugs"""))
def mirror_status(spark, d):
    c = load(spark, d)
    reports = c.reports.select("bug_id", corpus.valid_report(F.col("report")).alias("is_valid"))
    return mirror.status(c.bugs.select("bug_id", (F.col("bug_id") % 23 != 0).alias("has_detail")), reports, c.refs, c.patches)


_VERSIONS = "SELECT doc_id % 40 AS key, sha256(coalesce(text, '')) AS sha256, doc_id % 3 = 0 AS is_valid, doc_id % 9 AS first_run, doc_id % 9 AS last_run FROM documents"


@query(f"SELECT key, sha256, bool_or(is_valid) AS is_valid, min(first_run) AS first_run, max(last_run) AS last_run FROM ({_VERSIONS}) GROUP BY 1, 2")
def version_upsert(spark, d):
    k = F.col("doc_id")
    rows = DriverTables(spark, d).raw("documents").select((k % 40).alias("key"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), (k % 3 == 0).alias("is_valid"), (k % 9).alias("first_run"), (k % 9).alias("last_run"))
    return ingest.upsert_versions(rows.where("first_run < 5"), rows.where("first_run >= 5"), "key")


@query("SELECT l_orderkey AS version, l_linenumber AS ordinal, CASE WHEN l_orderkey % 2 = 0 THEN 'old' ELSE 'new' END AS side FROM lineitem")
def children_once(spark, d):
    """The even versions are known; their children come again and are not taken twice."""
    rows = DriverTables(spark, d).raw("lineitem").select(F.col("l_orderkey").alias("version"), F.col("l_linenumber").alias("ordinal"))
    return ingest.children_once(rows.where("version % 2 = 0").withColumn("side", F.lit("old")), rows.withColumn("side", F.lit("new")), "version")


@query(with_relations("SELECT bug_id, 2 AS parser_version, CASE WHEN bug_id % 3 = 0 THEN 'kept' ELSE 'parsed' END AS how FROM reports"))
def reparse_by_version(spark, d):
    """Every third report was read by the present parser, others by an older one, and some that are gone."""
    reports = DriverTables(spark, d).reports().select("bug_id")
    k = F.col("bug_id")
    derived = reports.unionByName(spark.range(5).select((-F.col("id") - 1).alias("bug_id"))).select("bug_id", F.lit("kept").alias("how"), F.when(k % 3 == 0, 2).otherwise(1).alias("parser_version"))
    return ingest.reparse(derived, reports, "bug_id", 2, lambda rows: rows.select("bug_id", F.lit("parsed").alias("how"))).select("bug_id", "parser_version", "how")


@query(with_relations("""SELECT 'report' AS kind, CAST(bug_id AS VARCHAR) AS key, 'snapshot report belongs to a different bug or crash version' AS error FROM reports WHERE bug_id % 31 = 0 OR bug_id % 37 = 0
  UNION ALL SELECT 'patch', hash, 'snapshot patch belongs to a different commit' FROM patches WHERE suppkey % 6 = 1"""))
def ownership_on_write(spark, d):
    t, k, s = DriverTables(spark, d), F.col("bug_id"), F.col("suppkey")
    one = F.lit(1).alias("snapshot_id")
    reports = t.reports().select(one, "bug_id", k.alias("report_version"), F.when(k % 37 == 0, -1).otherwise(k).alias("crash_id"))
    versions = t.bugs().select(k.alias("report_version"), F.when(k % 31 == 0, -1).otherwise(k).alias("bug_id"))
    members, crashes = t.bugs().select(one, "bug_id", k.alias("version_id")), t.bugs().select(k.alias("crash_id"), k.alias("version_id"))
    patches = t.patches().select("hash", s.alias("patch_version"))
    return ingest.disowned(reports, versions, members, crashes, patches, t.patches().select(s.alias("patch_version"), F.when(s % 6 == 1, "other").otherwise(F.col("hash")).alias("hash")))


@query("SELECT count(*) AS n, list(doc_id ORDER BY key) FILTER (WHERE place <= 100) AS first FROM (SELECT doc_id, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS key, row_number() OVER (ORDER BY doc_id) AS place FROM documents WHERE doc_id % 4 = 0)")
def first_failures(spark, d):
    rows = DriverTables(spark, d).raw("documents").where("doc_id % 4 = 0").select(F.lit("page").alias("kind"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("key"), F.lit("e").alias("error"))
    return present.failures(rows).select("n", F.transform("first", lambda x: x["key"].cast("long")).alias("first"))


@query(with_relations("SELECT kind, value FROM (SELECT 'report' AS kind, 'id-' || bug_id AS value FROM bugs WHERE bug_id % 50 = 0 UNION ALL SELECT DISTINCT 'patch', hash FROM fix_refs WHERE hash IS NOT NULL)"))
def pending_work(spark, d):
    """What a retry queue holds that the listing still refers to; the queue also holds bugs and commits that are gone."""
    t = DriverTables(spark, d)
    key = F.concat(F.lit("id-"), "bug_id")
    queue = t.bugs().where("bug_id % 50 = 0").select(F.lit("report").alias("kind"), key.alias("value")).unionByName(t.patches().select(F.lit("patch").alias("kind"), F.col("hash").alias("value")))
    queue = queue.unionByName(spark.range(9).select(F.when(F.col("id") % 2 == 0, "report").otherwise("patch").alias("kind"), F.concat(F.lit("gone"), "id").alias("value")))
    return mirror.pending(queue, t.bugs().select(key.alias("key")), t.fix_refs().where("hash is not null").select("hash").distinct()).select("kind", "value")


@query(with_relations("SELECT bug_id, title, bug_type, family, access_mode, coalesce(n, 0) AS n_tags, repro_status, fix_file_count, patch_line_count FROM classified JOIN metrics USING (bug_id) LEFT JOIN (SELECT bug_id, count(DISTINCT tag) AS n FROM subsystems GROUP BY 1) USING (bug_id)", f"{CLASSIFIED}, {METRICS}"))
def case_projection(spark, d):
    out = research.cases(documents(load(spark, d)))
    return out.select("bug_id", "title", "bug_type", "family", "access_mode", F.size("tags").cast("long").alias("n_tags"), "repro_status", "fix_file_count", "patch_line_count")


@query(with_relations("SELECT bug_id, list(hash || ':' || repo || ':' || position.l_linenumber ORDER BY hash, repo, position) AS children FROM fix_refs WHERE hash IS NOT NULL GROUP BY 1"))
def ordered_children(spark, d):
    """A bug's references by hash, repo and position."""
    r = DriverTables(spark, d).fix_refs().where("hash is not null")
    out = r.groupBy("bug_id").agg(F.sort_array(F.collect_list(F.struct("hash", "repo", "position"))).alias("c"))
    return out.select("bug_id", F.transform("c", lambda x: F.concat_ws(":", x["hash"], x["repo"], x["position"]["l_linenumber"])).alias("children"))
