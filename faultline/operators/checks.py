"""Integrity checks and the mirror audit: each check is a DataFrame of what breaks it; no rows mean it holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify


def damaged_blobs(blobs: DataFrame) -> DataFrame:
    """sha256 of blobs whose content has another digest or size."""
    c = F.col("content").cast("binary")
    return blobs.where((F.sha2(c, 256) != F.col("sha256")) | (F.octet_length(c) != F.col("size_bytes"))).select("sha256")


def dangling(child: DataFrame, parent: DataFrame, key: str, edge: str) -> DataFrame:
    """edge, key: child keys without a parent, each once."""
    return child.where(F.col(key).isNotNull()).select(key).distinct().join(parent.select(key), key, "left_anti").select(F.lit(edge).alias("edge"), F.col(key).cast("string").alias("key"))


def wrong_types(stored: DataFrame) -> DataFrame:
    """bug_id, stored, expected where the stored type is not the classifier's."""
    return stored.select("bug_id", F.col("bug_type").alias("stored"), classify.bug_type(F.col("title")).alias("expected")).where("stored <> expected")


def membership(snapshots: DataFrame, members: DataFrame) -> DataFrame:
    """snapshot_id, expected, found of snapshots whose record count is not the number of their members."""
    n = members.groupBy("snapshot_id").agg(F.count("*").alias("found"))
    out = snapshots.join(n, "snapshot_id", "left").select("snapshot_id", F.col("record_count").alias("expected"), F.coalesce("found", F.lit(0)).alias("found"))
    return out.where("expected <> found")


def active_count(snapshots: DataFrame) -> DataFrame:
    """One row if more than one snapshot is current."""
    return snapshots.agg(F.count_if("is_current").alias("current")).where("current > 1")


def duplicates(rows: DataFrame, key: str, source: str) -> DataFrame:
    """source, key, n of keys that occur more than once."""
    return rows.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(source).alias("source"), "key", "n")


def bijection(**sides: DataFrame) -> DataFrame:
    """key, present (sorted names of the sides that have it) of keys (column key) that some side lacks.

    One union and one aggregation replace a chain of outer joins.
    """
    tagged = [df.select(F.col("key").cast("string").alias("key")).withColumn("side", F.lit(name)) for name, df in sides.items()]
    per = reduce(DataFrame.unionByName, tagged).groupBy("key").agg(F.array_sort(F.collect_set("side")).alias("present"))
    return per.where(F.size("present") < len(sides))


def identity_coverage(refs: DataFrame, patches: DataFrame) -> DataFrame:
    """bug_id, title, repo, sources, hashes, any_patch, all_patched of each reference's identity."""
    valid = patches.where("is_valid").select("hash", F.lit(True).alias("ok"))
    r = refs.join(valid, "hash", "left")
    return r.groupBy("bug_id", "title", "repo").agg(
        F.array_sort(F.collect_set("kind")).alias("sources"), F.count_distinct("hash").alias("hashes"), F.coalesce(F.bool_or("ok"), F.lit(False)).alias("any_patch"),
        F.bool_and(F.coalesce("ok", F.lit(False))).alias("all_patched"),
    )


def _counted(bad: DataFrame, name: str) -> DataFrame:
    return bad.agg(F.count("*").alias("n")).where("n > 0").select(F.lit(name).alias("check"), "n")


def associations(snapshots: DataFrame, members: DataFrame, reports: DataFrame, report_versions: DataFrame, patches: DataFrame, patch_versions: DataFrame, located: DataFrame) -> DataFrame:
    """check, n of the seven associations of a snapshot that are broken.

    snapshots (snapshot_id, is_current), members (snapshot_id, bug_id, version_id), reports (snapshot_id, bug_id, report_version, crash_version),
    report_versions (report_version, bug_id, is_valid), patches (snapshot_id, hash, patch_version), patch_versions (patch_version, hash,
    is_valid), located (kind 'report' or 'patch', version: what locations were read from).
    """
    r = reports.join(report_versions.select("report_version", F.col("bug_id").alias("_owner"), F.col("is_valid").alias("_valid")), "report_version")
    member = members.select("snapshot_id", "bug_id", "version_id")
    p = patches.join(patch_versions.select("patch_version", F.col("hash").alias("_hash"), F.col("is_valid").alias("_valid")), "patch_version")
    current = snapshots.where("is_current").select("snapshot_id")
    read = lambda kind, name: located.where(F.col("kind") == kind).select(F.col("version").alias(name)).distinct()
    active = members.join(current, "snapshot_id", "left_semi").join(report_versions.where("is_valid").select("bug_id").distinct(), "bug_id", "left_semi")
    found = (
        (r.join(member, ["snapshot_id", "bug_id"]).where("_owner <> bug_id or crash_version <> version_id"), "snapshot report ownership mismatch"),
        (p.where("_hash <> hash"), "snapshot patch ownership mismatch"),
        (r.where("not _valid"), "snapshot uses invalid report version"), (p.where("not _valid"), "snapshot uses invalid patch version"),
        (active.join(reports.select("snapshot_id", "bug_id"), ["snapshot_id", "bug_id"], "left_anti"), "active report has no snapshot association"),
        (reports.join(current, "snapshot_id", "left_semi").join(read("report", "report_version"), "report_version", "left_anti"), "active report has no current location extraction"),
        (patches.join(current, "snapshot_id", "left_semi").join(read("patch", "patch_version"), "patch_version", "left_anti"), "active patch has no current location extraction"),
    )
    return reduce(DataFrame.unionByName, (_counted(*f) for f in found))


def missing(members: DataFrame, classified: DataFrame, version: int, patches: DataFrame, covered: DataFrame) -> DataFrame:
    """check, n: members whose classification is missing or of another version, valid patches whose coverage is missing."""
    fresh = classified.where(F.col("classifier_version") == version).select("bug_id")
    return _counted(members.join(fresh, "bug_id", "left_anti"), "missing or stale bug characteristics").unionByName(_counted(patches.where("is_valid").join(covered.select("hash"), "hash", "left_anti"), "missing patch coverage"))


def orphans(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """kind, key, issue: files (kind, key) that nothing refers to, and wanted ones that are not there."""
    f, w = files.select("kind", "key").distinct(), wanted.select("kind", "key").distinct()
    return f.join(w, ["kind", "key"], "left_anti").withColumn("issue", F.lit("orphan")).unionByName(w.join(f, ["kind", "key"], "left_anti").withColumn("issue", F.lit("missing")))
