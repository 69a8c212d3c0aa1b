"""Queries over the core operators: facets, filters, fixes, metrics, related cases, statistics, integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.classify import FAMILIES, MARKERS, SANITIZERS
from ..operators import corpus, filters, fixes, research
from ..operators.filters import Criteria
from ..sources.driver import DriverTables
from ..sources import mirror
from ..sources.driver_sql import with_relations


def load(spark: SparkSession, sf_dir: str, numbered: bool = False) -> corpus.Corpus:
    """The corpus of the driver's tables. numbered: a patch's number stands for its hash, for queries that shuffle many; DriverTables.hash_of() gives the hash."""
    t = DriverTables(spark, sf_dir)
    bugs = t.bugs().withColumn("repro_status", F.when(F.col("status") == "F", "available").when(F.col("status") == "O", "not_provided").otherwise("unknown"))
    patches = t.patches().withColumn("hash", F.col("suppkey")) if numbered else t.patches()
    ranges = t.numbered_ranges().withColumnRenamed("patch", "hash") if numbered else t.ranges()
    return corpus.Corpus(bugs, t.subsystems(), t.sites(), t.fix_refs(numbered), patches, ranges, t.reports().select("bug_id", "report"))


# --- SQL of the classifiers, on the title t


def _case(rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in rules) + f" ELSE {default} END"


def _marker_sql(t: str) -> str:
    return _case([(f"regexp_matches({t}, '^{s}\\s*:')", f"'{s}'") for s in SANITIZERS] + [(f"regexp_matches({t}, '^{m}(\\s|:|$)')", f"'{k}'") for m, k in MARKERS], "'other'")


_MANAGER = "^[a-z0-9][a-z0-9._+/-]* (build|boot|test) error\\s*(:\\s*(.*))?$"
CLASSIFIED = f"""
low AS (SELECT *, trim(regexp_replace(lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))), '(\\s*\\(\\d+\\))+$', '')) AS t FROM bugs),
stage AS (SELECT *, regexp_extract(t, '{_MANAGER}', 1) AS stage, regexp_extract(t, '{_MANAGER}', 3) AS inner_title FROM low),
typed AS (
  SELECT *, CASE WHEN stage = 'build' THEN 'build-error' WHEN stage <> '' AND {_marker_sql('inner_title')} = 'other' THEN stage || '-error'
    WHEN stage <> '' THEN {_marker_sql('inner_title')} ELSE {_marker_sql('t')} END AS bug_type,
    lower(regexp_replace(title, '(?i)\\s+(in|at)\\s+.*$', '')) AS head FROM stage),
fams AS (SELECT *, list_filter([{', '.join(f"CASE WHEN regexp_matches(head, '{p}') THEN '{k}' END" for k, p in FAMILIES)}], lambda x: x IS NOT NULL) AS all_families FROM typed),
fam AS (SELECT *, list_filter(all_families, lambda x: NOT (x = 'out-of-bounds' AND list_contains(all_families, 'shift-out-of-bounds'))) AS fl FROM fams),
classified AS (
  SELECT * EXCLUDE (access), CASE WHEN family IN ('unknown', 'deadlock', 'hang', 'memory-leak') THEN 'unknown' ELSE access END AS access_mode FROM (
    SELECT *, CASE WHEN len(fl) = 1 THEN fl[1] ELSE 'unknown' END AS family,
      CASE WHEN regexp_matches(head, '\\bread-write\\b') OR (regexp_matches(head, '\\bread\\b') AND regexp_matches(head, '\\bwrite\\b')) THEN 'read-write'
        WHEN regexp_matches(head, '\\bread\\b') THEN 'read' WHEN regexp_matches(head, '\\bwrite\\b') THEN 'write' ELSE 'unknown' END AS access,
      CASE status WHEN 'F' THEN 'available' WHEN 'O' THEN 'not_provided' ELSE 'unknown' END AS repro_status FROM fam))"""

METRICS = """
pairs AS (SELECT DISTINCT bug_id, hash FROM fix_refs WHERE hash IS NOT NULL),
ok AS (SELECT * FROM patches WHERE is_valid),
met AS (SELECT bug_id, pairs.hash, ok.hash IS NOT NULL AS there, coalesce(is_complete, false) AS complete FROM pairs LEFT JOIN ok USING (hash)),
size AS (
  SELECT bug_id, count(DISTINCT coalesce(new_path, old_path)) AS files, sum(old_count + new_count) AS lines, bool_or(kind IN ('binary', 'unparsed') OR coalesce(new_path, old_path) IS NULL) AS odd
  FROM met JOIN ranges USING (hash) WHERE there GROUP BY bug_id),
per AS (SELECT bug_id, count(*) AS hashes, count(*) FILTER (WHERE there) AS available, bool_and(there AND complete) AS whole FROM met GROUP BY bug_id),
subject AS (SELECT bug_id, title, repo, count(DISTINCT hash) AS n FROM fix_refs GROUP BY bug_id, title, repo),
unresolved AS (SELECT DISTINCT bug_id, title, repo FROM fix_refs JOIN subject USING (bug_id, title, repo) WHERE hash IS NULL AND n <> 1),
metrics AS (
  SELECT bug_id, coalesce(hashes, 0) AS hashes, coalesce(available, 0) AS available, coalesce(available, 0) > 0 AS has_patch,
    CASE WHEN known THEN coalesce(files, 0) END AS fix_file_count, CASE WHEN known THEN CAST(coalesce(lines, 0) AS BIGINT) END AS patch_line_count
  FROM (SELECT *, coalesce(hashes > 0 AND whole AND NOT coalesce(odd, false), false) AND bug_id NOT IN (SELECT bug_id FROM unresolved) AS known
    FROM bugs LEFT JOIN per USING (bug_id) LEFT JOIN size USING (bug_id)))"""

_VALID_REPORT = "regexp_matches(lower(substr(report, 1, 4096)), '^\\s*<(!doctype|html|head|body|\\?xml|!--)')"
_SHOWN = "bug_id, bug_type, family, access_mode"


def _core_sql(body: str, metrics: bool = False) -> str:
    return with_relations(body, CLASSIFIED + ("," + METRICS if metrics else ""))


QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- facets


@query(_core_sql("SELECT bug_type AS value, count(*) AS bugs FROM classified GROUP BY 1"))
def facet_bug_types(spark, d) -> DataFrame:
    return filters.facet(corpus.classified(DriverTables(spark, d).bugs()), "bug_type")


@query(_core_sql("SELECT family AS value, count(*) AS bugs FROM classified GROUP BY 1"))
def facet_families(spark, d):
    return filters.facet(corpus.classified(DriverTables(spark, d).bugs()), "family")


@query(_core_sql("SELECT access_mode AS value, count(*) AS bugs FROM classified GROUP BY 1"))
def facet_access_modes(spark, d):
    return filters.facet(corpus.classified(DriverTables(spark, d).bugs()), "access_mode")


@query(with_relations("SELECT lower(tag) AS value, count(DISTINCT bug_id) AS bugs FROM subsystems GROUP BY 1"))
def facet_subsystems_ci(spark, d):
    return filters.facet_tags(DriverTables(spark, d).subsystems())


# --- filters


def _filtered(criteria: Criteria):
    return lambda spark, d: filters.select(load(spark, d), criteria).select("bug_id", "bug_type", "family", "access_mode")


def _filter(name: str, criteria: Criteria, where: str, metrics: bool = False) -> None:
    QUERIES[name] = _filtered(criteria)
    ORACLES[name] = _core_sql(f"SELECT {_SHOWN} FROM classified WHERE {where}", metrics)


_IN_FIX = "bug_id IN (SELECT bug_id FROM fix_refs JOIN patches USING (hash) JOIN ranges USING (hash) WHERE is_valid AND {})"
_filter("filter_types_or", Criteria(types=(" KASAN", "warning")), "bug_type IN ('kasan', 'warning')")
_filter("filter_types_and_tags", Criteria(types=("kasan", "info", "bug"), tags=("BUILDING", "France")), "bug_type IN ('kasan', 'info', 'bug') AND bug_id IN (SELECT bug_id FROM subsystems WHERE lower(tag) IN ('building', 'france'))")
_filter("filter_family_and_access", Criteria(families=("use-after-free", "out-of-bounds"), access_modes=("read",)), "family IN ('use-after-free', 'out-of-bounds') AND access_mode = 'read'")
_filter("filter_query_literal", Criteria(query="in FN_1"), "contains(lower(title), 'in fn_1') OR contains('id-' || bug_id, 'in fn_1')")
_filter("filter_crash_file_glob", Criteria(crash_files=("net/*f1?.c", "mm/[!f]*")), "bug_id IN (SELECT bug_id FROM sites WHERE regexp_matches(path, '^net/.*f1.\\.c$') OR regexp_matches(path, '^mm/[^f].*$'))")
_filter("filter_crash_function_glob", Criteria(crash_functions=("fn_1*", "fn_22")), "bug_id IN (SELECT bug_id FROM sites WHERE starts_with(function, 'fn_1') OR function = 'fn_22')")
_filter("filter_fix_file_glob", Criteria(fix_files=("fs/*/f*",)), _IN_FIX.format("(regexp_matches(old_path, '^fs/.*/f.*$') OR regexp_matches(new_path, '^fs/.*/f.*$'))"))
_filter("filter_fix_function_glob", Criteria(fix_functions=("fn_9?",)), _IN_FIX.format("regexp_matches(function, '^fn_9.$')"))
_filter("filter_availability_tristate", Criteria(has_c_repro=False, has_report=True, has_patch=True), f"repro_status = 'not_provided' AND bug_id IN (SELECT bug_id FROM reports WHERE NOT {_VALID_REPORT}) AND bug_id IN (SELECT bug_id FROM metrics WHERE has_patch)", True)
_filter("filter_no_report", Criteria(has_report=False), f"bug_id NOT IN (SELECT bug_id FROM reports WHERE NOT {_VALID_REPORT})")
_filter("filter_max_patch_lines", Criteria(max_patch_lines=80, max_fix_files=8), "bug_id IN (SELECT bug_id FROM metrics WHERE patch_line_count <= 80 AND fix_file_count <= 8)", True)
_filter("filter_six_categories", Criteria(types=("kasan", "kmsan", "ubsan", "bug"), tags=("machinery", "automobile", "building"), crash_files=("net/*", "fs/*", "drivers/*"), has_patch=True, has_report=True, query="fn_"), f"bug_type IN ('kasan', 'kmsan', 'ubsan', 'bug') AND bug_id IN (SELECT bug_id FROM subsystems WHERE lower(tag) IN ('machinery', 'automobile', 'building')) AND bug_id IN (SELECT bug_id FROM sites WHERE regexp_matches(path, '^(net|fs|drivers)/')) AND bug_id IN (SELECT bug_id FROM metrics WHERE has_patch) AND bug_id IN (SELECT bug_id FROM reports WHERE NOT {_VALID_REPORT}) AND contains(title, 'fn_')", True)


@query(_core_sql("SELECT bug_id, position, title FROM classified WHERE bug_type = 'warning' ORDER BY position LIMIT 20 OFFSET 40"))
def filter_page_offset(spark, d):
    return filters.page(filters.select(load(spark, d), Criteria(types=("warning",))), 20, 40).select("bug_id", "position", "title")


@query(_core_sql("SELECT count(*) AS total FROM classified WHERE family = 'use-after-free'"))
def filter_total_before_page(spark, d):
    return filters.select(load(spark, d), Criteria(families=("use-after-free",))).agg(F.count("*").alias("total"))


@query(_core_sql(f"""
  SELECT bug_id, title, bug_type, (SELECT list_sort(list_distinct(list(tag))) FROM subsystems s WHERE s.bug_id = p.bug_id) AS tags,
    (SELECT count(DISTINCT hash) FROM fix_refs r WHERE r.bug_id = p.bug_id) AS n_hashes, bug_id IN (SELECT bug_id FROM reports WHERE NOT {_VALID_REPORT}) AS has_report
  FROM (SELECT * FROM classified WHERE bug_type = 'kasan' ORDER BY position LIMIT 20) p"""))
def filter_page_enriched(spark, d):
    c = load(spark, d)
    rows = filters.enriched(filters.page(filters.select(c, Criteria(types=("kasan",)))), c)
    return rows.select("bug_id", "title", "bug_type", "tags", F.coalesce(F.size("hashes"), F.lit(0)).cast("long").alias("n_hashes"), "has_report")


@query(with_relations("SELECT bug_id, position, title, priority FROM bugs WHERE status = 'O'"))
def current_bug_rows(spark, d):
    """Each order status is a snapshot, of which one is current."""
    t = DriverTables(spark, d)
    snapshots = t.raw("orders").select(F.col("o_orderstatus").alias("snapshot_id")).distinct().withColumn("is_current", F.col("snapshot_id") == "O")
    members = t.bugs().select("bug_id", F.col("status").alias("snapshot_id"))
    return filters.current(t.bugs(), members, snapshots).select("bug_id", "position", "title", "priority")


# --- fixes


@query(with_relations("SELECT bug_id, repo, hash, old_path, new_path, old_start, old_count, new_count, function, kind FROM one JOIN ranges USING (hash)", "one AS MATERIALIZED (SELECT bug_id, f.hash, repo, count(*) AS n FROM fix_refs f JOIN patches p ON p.hash = f.hash WHERE is_valid GROUP BY ALL)"))
def current_fix_locations(spark, d):
    t = DriverTables(spark, d)
    return fixes.fix_ranges(t.fix_refs(), t.patches(), t.ranges()).select("bug_id", "repo", "hash", "old_path", "new_path", "old_start", "old_count", "new_count", "function", "kind")


@query(with_relations("SELECT bug_id, fix_refs.hash, title, repo, p.hash IS NOT NULL AS patch_available FROM fix_refs LEFT JOIN patches p ON p.hash = fix_refs.hash AND p.is_valid"))
def effective_fixes_left(spark, d):
    t = DriverTables(spark, d)
    valid = t.patches().where("is_valid").select(F.col("hash").alias("_h"))
    return t.fix_refs().join(valid, F.col("hash") == F.col("_h"), "left").select("bug_id", "hash", "title", "repo", F.col("_h").isNotNull().alias("patch_available"))


_FIRST = "coalesce(arg_min({0}, position) FILTER (WHERE {0} <> ''), '')"
_SEEN = "list({'p': position, 'k': kind} ORDER BY position)"


@query(with_relations("""
  SELECT bug_id, position.l_linenumber AS line_number, hash, title, repo, array_to_string(list_transform(list_filter(list_zip(kinds, generate_series(1, len(kinds))), lambda x: list_position(kinds, x[1]) = x[2]), lambda x: x[1]), ',') AS sources, n AS "references" FROM (
    SELECT h.bug_id, least(h.position, b.position) AS position, h.hash, h.title, h.repo, list_concat(list_transform(h.seen, lambda x: x.k), coalesce(list_transform(b.seen, lambda x: x.k), [])) AS kinds, h.n + coalesce(b.n, 0) AS n
    FROM hashed h LEFT JOIN (SELECT bug_id, only_one.hash, min(position) AS position, flatten(list(seen ORDER BY position)) AS seen, CAST(sum(n) AS BIGINT) AS n FROM bare JOIN only_one USING (bug_id, title, repo) GROUP BY ALL) b USING (bug_id, hash)
    UNION ALL SELECT bug_id, position, NULL, title, repo, list_transform(seen, lambda x: x.k), n FROM bare WHERE (bug_id, title, repo) NOT IN (SELECT (bug_id, title, repo) FROM only_one))""", f"""
hashed AS (SELECT bug_id, hash, {_FIRST.format('title')} AS title, {_FIRST.format('repo')} AS repo, min(position) AS position, {_SEEN} AS seen, count(*) AS n FROM fix_refs WHERE hash IS NOT NULL GROUP BY bug_id, hash),
bare AS (SELECT bug_id, title, repo, min(position) AS position, {_SEEN} AS seen, count(*) AS n FROM fix_refs WHERE hash IS NULL GROUP BY bug_id, title, repo),
only_one AS (SELECT bug_id, title, repo, min(hash) AS hash FROM hashed GROUP BY bug_id, title, repo HAVING count(*) = 1)"""))
def merge_fixes(spark, d):
    out = fixes.merge(DriverTables(spark, d).fix_refs())
    return out.select("bug_id", F.col("position.l_linenumber").alias("line_number"), "hash", "title", "repo", F.array_join("sources", ",").alias("sources"), "references")


_SIDE = "CASE kind WHEN 'listing' THEN 0 ELSE 1 END"


@query(with_relations(f"SELECT bug_id, hash, title, repo, arg_min(kind, ({_SIDE}, position)) AS kind, min(position).l_linenumber AS line_number FROM (SELECT *, min({_SIDE}) OVER (PARTITION BY bug_id, hash, title, repo) AS side FROM fix_refs) WHERE {_SIDE} = side GROUP BY 1, 2, 3, 4"))
def ordered_union(spark, d):
    return fixes.ordered_union(DriverTables(spark, d).fix_refs()).select("bug_id", "hash", "title", "repo", "kind", F.col("position.l_linenumber").alias("line_number"))


_RESOLVED = "resolved AS (SELECT bug_id, title, repo, max('h' || (bug_id % 7)) AS resolved FROM fix_refs WHERE hash IS NULL AND bug_id % 2 = 0 GROUP BY ALL)"


def _resolutions(refs: DataFrame) -> DataFrame:
    """A resolution for each title-only reference of the even bugs."""
    return refs.where("hash is null and bug_id % 2 = 0").select("bug_id", "title", "repo", F.concat(F.lit("h"), F.col("bug_id") % 7).alias("hash"), (F.col("bug_id") % 5).alias("run")).distinct()


@query(with_relations(f"""SELECT bug_id, h AS hash, arg_min(title, ({_SIDE} = 0, position)) AS title, arg_min(repo, ({_SIDE} = 0, position)) AS repo FROM (
  SELECT *, coalesce(hash, resolved) AS h FROM fix_refs LEFT JOIN resolved USING (bug_id, title, repo)) WHERE h IS NOT NULL GROUP BY 1, 2""", _RESOLVED))
def research_fixes(spark, d):
    refs = DriverTables(spark, d).fix_refs()
    return fixes.research_fixes(refs, _resolutions(refs)).select("bug_id", "hash", "title", "repo")


@query(with_relations("SELECT hash, arg_min(repo, (bug_id, position)) AS repo, count(DISTINCT bug_id) AS bugs FROM fix_refs WHERE hash IS NOT NULL GROUP BY hash"))
def patch_jobs(spark, d):
    return fixes.patch_jobs(DriverTables(spark, d).fix_refs())


@query(with_relations("SELECT bug_id, title, repo, resolved AS hash, CAST(bug_id % 5 AS BIGINT) AS run FROM resolved WHERE bug_id % 5 < 3", _RESOLVED))
def accepted_resolutions(spark, d):
    """Runs 0 to 2 are completed."""
    refs = DriverTables(spark, d).fix_refs()
    runs = spark.range(5).select(F.col("id").alias("run"), F.when(F.col("id") < 3, "completed").otherwise("failed").alias("status"))
    return fixes.applicable_resolutions(_resolutions(refs), runs, refs).select("bug_id", "title", "repo", "hash", "run")


@query(with_relations("SELECT bug_id, hashes, available, has_patch, fix_file_count, patch_line_count FROM metrics", METRICS))
def patch_metrics(spark, d):
    t = DriverTables(spark, d)
    return fixes.patch_metrics(t.bugs(), t.fix_refs(), t.patches(), t.ranges())


@query(with_relations("SELECT bug_id, title, repo FROM unresolved", METRICS))
def unresolved_refs(spark, d):
    return fixes.unresolved(DriverTables(spark, d).fix_refs())


@query("SELECT user_id AS identity, max(ts) AS run, arg_max(event_id, (ts, event_id)) AS id, arg_max(event_type, (ts, event_id)) AS hash FROM events WHERE event_type <> 'view' GROUP BY user_id")
def latest_resolution(spark, d):
    e = DriverTables(spark, d).raw("events")
    return fixes.latest_resolution(e.select(F.col("user_id").alias("identity"), F.col("ts").alias("run"), F.col("event_id").alias("id"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("hash")))


# --- statistics, related cases, comparison


@query(with_relations("SELECT (SELECT count(*) FROM bugs) AS bugs, count(*) AS links, count(DISTINCT hash) AS commits, (SELECT count(*) FROM bugs WHERE bug_id NOT IN (SELECT bug_id FROM pairs)) AS without_hash FROM pairs JOIN bugs USING (bug_id)", METRICS))
def stats_totals(spark, d):
    return research.totals(load(spark, d))


_FIXES = "fixed AS (SELECT bug_id, old_path, new_path, ranges.function AS fix_function FROM (SELECT DISTINCT bug_id, hash, repo FROM fix_refs) JOIN patches USING (hash) JOIN ranges USING (hash) WHERE is_valid)"
_RELATION = """
ranked AS (
  SELECT bug_id, CASE WHEN path IS NULL OR (old_path IS NULL AND new_path IS NULL) THEN 0 WHEN NOT (coalesce(old_path = path, false) OR coalesce(new_path = path, false)) THEN 1 WHEN coalesce(function = fix_function, false) THEN 3 ELSE 2 END AS r
  FROM sites JOIN fixed USING (bug_id)),
closest AS (SELECT bug_id, max(r) AS best, min(r) AS worst FROM ranked GROUP BY bug_id),
relationships AS (
  SELECT bug_id, CASE WHEN best = 3 THEN 'same-function' WHEN best = 2 THEN 'same-file' WHEN best = 1 AND worst = 1 AND patch_line_count IS NOT NULL THEN 'different-file' ELSE 'unknown' END AS relationship
  FROM metrics LEFT JOIN closest USING (bug_id))"""


_DISTRIBUTIONS = """
  SELECT dimension, value, count(*) AS bugs FROM (
    SELECT bug_id, 'bug_type' AS dimension, bug_type AS value FROM classified UNION SELECT bug_id, 'family', family FROM classified UNION SELECT bug_id, 'access_mode', access_mode FROM classified
    UNION SELECT bug_id, 'subsystem', lower(tag) FROM subsystems UNION SELECT bug_id, 'crash_function', function FROM sites WHERE function IS NOT NULL
    UNION SELECT bug_id, 'fix_function', fix_function FROM fixed WHERE fix_function IS NOT NULL UNION SELECT bug_id, 'fix_file', coalesce(new_path, old_path) FROM fixed WHERE coalesce(new_path, old_path) IS NOT NULL
    UNION SELECT bug_id, 'relationship', relationship FROM relationships) GROUP BY 1, 2"""
_DISTRIBUTED = f"{CLASSIFIED}, {METRICS}, {_FIXES}, {_RELATION}"


@query(with_relations(_DISTRIBUTIONS, _DISTRIBUTED))
def stats_distributions(spark, d):
    return research.distributions(load(spark, d))


@query(with_relations(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY bugs DESC, value) AS place FROM ({_DISTRIBUTIONS})) WHERE place <= 5", _DISTRIBUTED))
def stats_top_values(spark, d):
    return research.ranked(research.distributions(load(spark, d)), 5)


@query(with_relations("SELECT relationship, count(*) AS bugs FROM relationships GROUP BY 1", f"{METRICS}, {_FIXES}, {_RELATION}"))
def stats_relationship(spark, d):
    return research.relationships(load(spark, d)).groupBy("relationship").agg(F.count("*").alias("bugs"))


@query(with_relations("SELECT count(patch_line_count) AS known, count(*) - count(patch_line_count) AS unknown, min(patch_line_count) AS smallest, max(patch_line_count) AS largest, median(patch_line_count) AS median FROM metrics", METRICS))
def stats_fix_size(spark, d):
    t = DriverTables(spark, d)
    return research.numeric_summary(fixes.patch_metrics(t.bugs(), t.fix_refs(), t.patches(), t.ranges()), "patch_line_count")


@query(_core_sql(f"""SELECT count(*) FILTER (WHERE bug_id IN (SELECT bug_id FROM reports WHERE NOT {_VALID_REPORT})) AS with_report, count(*) FILTER (WHERE bug_id NOT IN (SELECT bug_id FROM reports WHERE NOT {_VALID_REPORT})) AS without_report,
  count(*) FILTER (WHERE bug_id IN (SELECT bug_id FROM metrics WHERE has_patch)) AS with_patch, count(*) FILTER (WHERE bug_id IN (SELECT bug_id FROM metrics WHERE NOT has_patch)) AS without_patch,
  count(*) FILTER (WHERE bug_id NOT IN (SELECT bug_id FROM subsystems)) AS untagged,
  count(*) FILTER (WHERE repro_status = 'available') AS repro_available, count(*) FILTER (WHERE repro_status = 'not_provided') AS repro_not_provided, count(*) FILTER (WHERE repro_status = 'unknown') AS repro_unknown FROM classified""", True))
def stats_availability(spark, d):
    return research.availability(load(spark, d))


_EVIDENCE = f"""{_FIXES},
evidence AS (
  SELECT bug_id, 'same-fix-commit' AS kind, hash AS value FROM fix_refs WHERE hash IS NOT NULL UNION SELECT bug_id, 'same-crash-function', function FROM sites WHERE function IS NOT NULL
  UNION SELECT bug_id, 'same-fix-file', old_path FROM fixed WHERE old_path IS NOT NULL UNION SELECT bug_id, 'same-fix-file', new_path FROM fixed WHERE new_path IS NOT NULL
  UNION SELECT bug_id, 'same-crash-file', path FROM sites WHERE path IS NOT NULL)"""


@query(with_relations("""
  SELECT bug_id, list_filter(['same-fix-commit', 'same-crash-function', 'same-fix-file', 'same-crash-file'], lambda k: list_contains(ks, k)) AS kinds, list_sort(vs) AS shared FROM (
    SELECT e.bug_id, list_distinct(list(e.kind)) AS ks, list(e.kind || '=' || e.value) AS vs FROM evidence e JOIN (SELECT kind, value FROM evidence WHERE bug_id = 1) o USING (kind, value) WHERE e.bug_id <> 1 GROUP BY e.bug_id)
  ORDER BY list_contains(ks, 'same-fix-commit') DESC, list_contains(ks, 'same-crash-function') DESC, list_contains(ks, 'same-fix-file') DESC, list_contains(ks, 'same-crash-file') DESC, bug_id LIMIT 10""", _EVIDENCE))
def related_topk(spark, d):
    return research.related(load(spark, d), 1)


@query(with_relations("""
  SELECT field, "left", "right", "left" = "right" AS same FROM (
    SELECT field, max(value) FILTER (WHERE bug_id = 1) AS "left", max(value) FILTER (WHERE bug_id = 2) AS "right" FROM (
      SELECT bug_id, unnest(['bug_type', 'family', 'access_mode', 'subsystems', 'repro_status']) AS field, unnest([bug_type, family, access_mode, coalesce(s, ''), repro_status]) AS value
      FROM classified LEFT JOIN (SELECT bug_id, string_agg(DISTINCT tag, ',' ORDER BY tag) AS s FROM subsystems GROUP BY bug_id) USING (bug_id) WHERE bug_id IN (1, 2)) GROUP BY field)""", CLASSIFIED))
def compare_pair(spark, d):
    return research.compare(load(spark, d), 1, 2)


@query(with_relations("SELECT kind, value FROM evidence WHERE bug_id IN (1, 31) GROUP BY ALL HAVING count(*) = 2", _EVIDENCE))
def compare_shared_evidence(spark, d):
    return research.shared_evidence(load(spark, d), 1, 31)


# --- reports and text


@query(with_relations("SELECT bug_id, count(*) AS lines, sum(length(line)) AS chars FROM (SELECT bug_id, unnest(string_split(report, chr(10))) AS line FROM reports) GROUP BY bug_id"))
def report_lines(spark, d):
    return corpus.report_lines(DriverTables(spark, d).reports()).groupBy("bug_id").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


@query(with_relations("""
  SELECT section, count(*) AS lines FROM (
    SELECT coalesce(last_value(heading IGNORE NULLS) OVER (PARTITION BY bug_id ORDER BY n), 'manifestation') AS section FROM (
      SELECT bug_id, n, CASE WHEN contains(line, 'Allocated by task') THEN 'allocation' WHEN contains(line, 'Freed by task') THEN 'free' END AS heading
      FROM (SELECT bug_id, unnest(string_split(report, chr(10))) AS line, generate_subscripts(string_split(report, chr(10)), 1) AS n FROM reports))) GROUP BY section"""))
def section_carry_forward(spark, d):
    lines = corpus.report_lines(DriverTables(spark, d).reports())
    heading = F.when(F.col("line").rlike("(?i)Allocated by task|Page( last)? allocated via order"), "allocation").when(F.col("line").rlike("(?i)Freed by task|Page last free stack trace"), "free")
    order = Window.partitionBy("bug_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.select(F.coalesce(F.last(heading, True).over(order), F.lit("manifestation")).alias("section")).groupBy("section").agg(F.count("*").alias("lines"))


@query(_core_sql(f"""
  SELECT access, count(*) AS bugs FROM (SELECT CASE WHEN NOT starts_with(report, '<html>') OR true THEN CASE WHEN report IS NULL THEN access_mode WHEN bug_id % 2 = 0 THEN 'read' ELSE 'write' END END AS access
    FROM classified LEFT JOIN (SELECT bug_id, report FROM reports) USING (bug_id)) GROUP BY access"""))
def facet_access_with_reports(spark, d):
    t = DriverTables(spark, d)
    return corpus.classified_with_reports(t.bugs(), t.reports()).groupBy(F.col("access_mode").alias("access")).agg(F.count("*").alias("bugs"))


@query("SELECT kind, error, count(*) AS n FROM (SELECT 'page' AS kind, CASE WHEN html IS NULL THEN 'missing' WHEN trim(html) = '' THEN 'empty' WHEN regexp_matches(lower(substr(html, 1, 4096)), '^\\s*<(!doctype|html|head|body|\\?xml|!--)') THEN 'markup' END AS error FROM pages UNION ALL SELECT 'document', CASE WHEN text IS NULL THEN 'missing' WHEN trim(text) = '' THEN 'empty' WHEN regexp_matches(lower(substr(text, 1, 4096)), '^\\s*<(!doctype|html|head|body|\\?xml|!--)') THEN 'markup' END FROM documents) GROUP BY 1, 2")
def artifact_validity(spark, d):
    t = DriverTables(spark, d)
    both = t.raw("pages").select(F.lit("page").alias("kind"), corpus.report_error(F.col("html")).alias("error")).unionByName(t.raw("documents").select(F.lit("document").alias("kind"), corpus.report_error(F.col("text")).alias("error")))
    return both.groupBy("kind", "error").agg(F.count("*").alias("n"))


@query("SELECT href, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY href")
def html_hrefs(spark, d):
    p = DriverTables(spark, d).raw("pages")
    return p.select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href")).groupBy("href").agg(F.count("*").alias("n"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'extid-x' || page_id WHEN page_id % 3 = 1 THEN NULL WHEN page_id % 2 = 0 THEN 'id-k' || page_id END AS key, lower(regexp_extract(url, '^(https?://[^/?#@\\s]+)', 1)) AS origin FROM pages")
def link_keys(spark, d):
    p, k = DriverTables(spark, d).raw("pages"), F.col("page_id")
    other = F.when(k % 2 == 0, F.concat(F.lit("https://h.example/bug?id=k"), k)).otherwise(F.lit("/bug"))
    link = F.when(k % 3 == 0, F.concat(F.lit("/bug?a=b&extid=x"), k, F.lit("#t"))).when(k % 3 == 1, F.concat(F.lit("/bug?id=1&id="), k)).otherwise(other)
    return p.select("page_id", text.link_key(link).alias("key"), text.origin(F.col("url")).alias("origin"))


@query("SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://b.example/x/' || page_id WHEN 1 THEN 'https://b.example/bug?id=' || page_id WHEN 2 THEN 'HTTPS://b.example/own' END AS url FROM pages")
def absolute_urls(spark, d):
    k = F.col("page_id")
    link = F.when(k % 5 == 0, F.concat(F.lit("/x/"), k)).when(k % 5 == 1, F.concat(F.lit("bug?id="), k)).when(k % 5 == 2, "HTTPS://b.example/own").when(k % 5 == 3, "https://other.example/x").otherwise("javascript:alert(1)")
    return DriverTables(spark, d).raw("pages").select("page_id", text.absolute_url(link, "https://b.example").alias("url"))


@query("SELECT 'extid-p' || page_id AS key, 'net' AS tag FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT 'extid-p' || page_id, 's' || (page_id % 6) FROM pages WHERE page_id % 2 = 0")
def html_labels(spark, d):
    """A listing of a row a page; rows of odd pages name two bugs, so their labels count for none."""
    k = F.col("page_id")
    more = F.when(k % 2 == 1, F.concat(F.lit("<a href='/bug?id=q"), k, F.lit("'>b</a>"))).otherwise("<a href='http://[x'>torn</a>")
    row = F.concat(F.lit("<table><tr><td><a href='/bug?extid=p"), k, F.lit("'>t</a>"), more, F.lit("<a href='?label=subsystems%3Anet'>n</a><a href='?label=subsystems: '>n</a><a href='?label=subsystems:s"), k % 6, F.lit("'>s</a></td></tr></table>"))
    return mirror.subsystem_tags(DriverTables(spark, d).raw("pages").select(row.alias("text")))


_EVIDENCE_OF = ("syz-repro", "config", "c-repro", "other")


@query("""SELECT doc_id, kind, text IS NOT NULL AND regexp_matches(text, '\\S') AND NOT regexp_matches(lower(substr(text, 1, 4096)), '^\\s*<(!doctype|html|head|body|\\?xml|!--)')
  AND CASE kind WHEN 'syz-repro' THEN regexp_matches(text, '(?m)^\\s*(?:r\\d+\\s*=\\s*)?[A-Za-z_]\\w*(?:\\$\\w+)?\\s*\\(') WHEN 'config' THEN regexp_matches(text, '(?m)^(?:CONFIG_[A-Za-z0-9_]+=|# CONFIG_[A-Za-z0-9_]+ is not set\\r?$)') WHEN 'c-repro' THEN regexp_matches(text, '\\b(?:int|void)\\s+main\\s*\\(') ELSE true END AS valid
  FROM (SELECT doc_id, ['syz-repro', 'config', 'c-repro', 'other'][doc_id % 4 + 1] AS kind, CASE WHEN doc_id % 3 = 0 THEN 'r0 = open(a)' || chr(10) || 'CONFIG_X=y' || chr(10) || 'int main (void)' ELSE substr(text, 1, 200) END AS text FROM documents)""")
def evidence_validity(spark, d):
    k = F.col("doc_id")
    rows = DriverTables(spark, d).raw("documents").select("doc_id", F.get(F.array(*map(F.lit, _EVIDENCE_OF)), (k % 4).cast("int")).alias("kind"), F.when(k % 3 == 0, "r0 = open(a)\nCONFIG_X=y\nint main (void)").otherwise(F.substring("text", 1, 200)).alias("text"))
    return rows.select("doc_id", "kind", mirror.valid_evidence(F.col("kind"), F.col("text")).alias("valid"))


@query("SELECT CASE WHEN k IS NULL THEN 'unknown' WHEN k > 50 THEN 'available' ELSE 'not_provided' END AS status, count(*) AS n FROM (SELECT TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1")
def json_props_tristate(spark, d):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    e = DriverTables(spark, d).raw("events").select(F.when(k.isNull(), "unknown").when(k > 50, "available").otherwise("not_provided").alias("status"))
    return e.groupBy("status").agg(F.count("*").alias("n"))


@query(with_relations("SELECT old_path, old_start, old_count, CASE WHEN old_count = 0 THEN 'after line ' || old_start WHEN old_count = 1 THEN 'line ' || old_start ELSE 'lines ' || old_start || '-' || (old_start + old_count - 1) END AS shown, coalesce(old_path, 'unknown file') || ':' || old_start AS at FROM ranges"))
def range_rendering(spark, d):
    r = DriverTables(spark, d).ranges()
    return r.select("old_path", "old_start", "old_count", text.line_range(F.col("old_start"), F.col("old_count")).alias("shown"), text.coordinate(F.col("old_path"), F.col("old_start"), F.lit(None).cast("long")).alias("at"))


@query(_core_sql("SELECT bug_id, bug_type, family FROM classified WHERE bug_type IN ('boot-error', 'build-error', 'test-error', 'other')"))
def classify_manager_errors(spark, d):
    rows = corpus.classified(DriverTables(spark, d).bugs())
    return rows.where(F.col("bug_type").isin("boot-error", "build-error", "test-error", "other")).select("bug_id", "bug_type", "family")
