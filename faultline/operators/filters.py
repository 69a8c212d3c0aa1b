"""The filter query: alternatives within a category, all categories together, and facets."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify
from ..functions.text import ascii_fold, matches_any
from . import corpus, fixes

_VOCABULARY = {"types": classify.TYPES, "families": ("unknown", *(k for k, _ in classify.FAMILIES)), "access_modes": classify.ACCESS_MODES}


@dataclass(frozen=True)
class Criteria:
    """Empty means no condition. Globs are case-sensitive and * crosses slashes; unknown facts meet no claim."""

    types: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    families: tuple[str, ...] = ()
    access_modes: tuple[str, ...] = ()
    crash_files: tuple[str, ...] = ()
    fix_files: tuple[str, ...] = ()
    crash_functions: tuple[str, ...] = ()
    fix_functions: tuple[str, ...] = ()
    has_c_repro: bool | None = None
    has_report: bool | None = None
    has_patch: bool | None = None
    max_fix_files: int | None = None
    max_patch_lines: int | None = None
    query: str = ""

    def __post_init__(self):
        for f in fields(self):
            value = getattr(self, f.name)
            if f.name.startswith("max_"):
                if value is not None and (isinstance(value, bool) or not isinstance(value, int) or value < 0):
                    raise ValueError(f"{f.name} must be a whole number, zero or more")
            elif f.name.startswith("has_"):
                if value not in (None, True, False) or isinstance(value, int) and not isinstance(value, bool):
                    raise ValueError(f"{f.name} must be true, false or left out")
            elif f.name != "query":
                if isinstance(value, str) or any(not isinstance(x, str) or not x.strip() or any(ord(c) < 32 for c in x) for x in value):
                    raise ValueError(f"{f.name} must list texts that are not empty and hold no control characters")
        for name, known in _VOCABULARY.items():
            clean = tuple(dict.fromkeys(x.strip().lower() for x in getattr(self, name)))
            if unknown := set(clean) - set(known):
                raise ValueError(f"unknown {name}: {', '.join(sorted(unknown))}")
            object.__setattr__(self, name, clean)


def select(c: corpus.Corpus, criteria: Criteria) -> DataFrame:
    """The classified bugs that meet the criteria; joins are only there for the criteria that need them."""
    rows, k = corpus.classified(c.bugs), criteria
    for column, values in (("bug_type", k.types), ("family", k.families), ("access_mode", k.access_modes)):
        if values:
            rows = rows.where(F.col(column).isin(*values))
    if k.query:
        needle = k.query.translate({a: a + 32 for a in range(65, 91)})
        rows = rows.where(F.contains(ascii_fold("title"), F.lit(needle)) | F.contains(F.concat(F.lit("id-"), "bug_id"), F.lit(needle)))
    if k.has_c_repro is not None:
        rows = rows.where(F.col("repro_status") == ("available" if k.has_c_repro else "not_provided"))
    if k.tags:
        wanted = [t.strip().translate({a: a + 32 for a in range(65, 91)}) for t in k.tags]
        rows = rows.join(c.tags.where(ascii_fold("tag").isin(*wanted)), "bug_id", "left_semi")
    if k.crash_files or k.crash_functions:
        for column, globs in (("path", k.crash_files), ("function", k.crash_functions)):
            if globs:
                rows = rows.join(c.sites.where(matches_any(F.col(column), globs)), "bug_id", "left_semi")
    if k.fix_files or k.fix_functions:
        for columns, globs in ((("old_path", "new_path"), k.fix_files), (("function",), k.fix_functions)):
            if globs:
                hit = F.lit(False)
                for column in columns:
                    hit = hit | matches_any(F.col(column), globs)
                hashes = c.ranges.where(hit).select("hash").distinct().join(c.patches.where("is_valid"), "hash", "left_semi")
                rows = rows.join(c.refs.where("hash is not null").join(hashes, "hash", "left_semi"), "bug_id", "left_semi")
    if k.has_report is not None:
        rows = rows.join(c.reports.where(corpus.valid_report(F.col("report"))).select("bug_id"), "bug_id", "left_semi" if k.has_report else "left_anti")
    if k.has_patch is not None or k.max_fix_files is not None or k.max_patch_lines is not None:
        m = fixes.patch_metrics(c.bugs, c.refs, c.patches, c.ranges)
        for column, value, test in (("has_patch", k.has_patch, "__eq__"), ("fix_file_count", k.max_fix_files, "__le__"), ("patch_line_count", k.max_patch_lines, "__le__")):
            if value is not None:
                m = m.where(getattr(F.col(column), test)(F.lit(value)))
        rows = rows.join(m.select("bug_id"), "bug_id", "left_semi")
    return rows


def current(bugs: DataFrame, members: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The bugs that are members (bug_id, snapshot_id) of the snapshot (snapshot_id, is_current) that is current."""
    now = F.broadcast(snapshots.where("is_current").select("snapshot_id").limit(1))  # at most one row
    return bugs.join(members.join(now, "snapshot_id", "left_semi").select("bug_id"), "bug_id", "left_semi")


def page(rows: DataFrame, limit: int | None = 20, offset: int = 0) -> DataFrame:
    """Rows in listing order from offset on; no limit returns all."""
    rows = rows.orderBy("position").offset(offset) if offset else rows.orderBy("position")
    return rows if limit is None else rows.limit(limit)


#: Rows of a page up to which it is looked at once and its ids are given to the scans as literals.
PAGE_ROWS = 1_000


def enriched(chosen: DataFrame, c: corpus.Corpus) -> DataFrame:
    """A page plus tags, sites, fix hashes and report flag.

    A page of up to PAGE_ROWS rows is worked out once and held as a local relation; its ids are pushed into the scans of the
    child relations. A larger one is joined.
    """
    got = chosen.limit(PAGE_ROWS + 1).toArrow()
    if got.num_rows <= PAGE_ROWS:
        chosen = chosen.sparkSession.createDataFrame(got.to_pylist(), chosen.schema)
        ids = got.column("bug_id").to_pylist()
        of = lambda df: df.where(F.col("bug_id").isin(*ids))
    else:
        of = lambda df: df.join(chosen.select("bug_id"), "bug_id", "left_semi")
    tags = of(c.tags).groupBy("bug_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    hashes = of(c.refs).where("hash is not null").groupBy("bug_id").agg(F.array_sort(F.collect_set("hash")).alias("hashes"))
    sites = of(c.sites).groupBy("bug_id").agg(F.array_sort(F.collect_set(F.struct("path", "line", "function"))).alias("sites"))
    valid = of(c.reports).where(corpus.valid_report(F.col("report"))).select("bug_id", F.lit(True).alias("has_report"))
    out = chosen
    for side in (tags, hashes, sites, valid):
        out = out.join(side, "bug_id", "left")
    return out.withColumn("has_report", F.coalesce("has_report", F.lit(False)))


def facet(rows: DataFrame, column: str) -> DataFrame:
    """value, bugs: how many rows have each value."""
    return rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("bugs"))


def facet_tags(tags: DataFrame) -> DataFrame:
    """value, bugs: tags that differ in ASCII case only are one, and a bug counts once for it."""
    return tags.groupBy(ascii_fold("tag").alias("value")).agg(F.count_distinct("bug_id").alias("bugs"))
