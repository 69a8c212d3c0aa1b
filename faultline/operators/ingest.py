"""Snapshots: merges of versioned relations, and a store that activates a snapshot only when all of it is there.

Parquet has no transactions. Each merge computes the whole new relation from the old and the incoming one; the store writes
relations of a run to directories of their own and then swaps one small manifest, so readers see all of a snapshot or
none of it, and a failed run leaves the active one as it was.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def new_blobs(known: DataFrame, payloads: DataFrame) -> DataFrame:
    """sha256, content, size_bytes of payloads (content) that known (sha256) lacks, each once."""
    own = payloads.where("content is not null").select(F.sha2(F.col("content").cast("binary"), 256).alias("sha256"), F.col("content").cast("binary").alias("content"))
    return own.dropDuplicates(["sha256"]).join(known.select("sha256"), "sha256", "left_anti").withColumn("size_bytes", F.octet_length("content").cast("long"))


def upsert_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """Documents by (kind, key, sha256): a URL is kept unless a better one comes, validity only grows, a valid one has no error."""
    key = ["kind", "key", "sha256"]
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    named = lambda c: F.max(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct("_new", F.col(c).alias("v"))))["v"]
    valid = F.max(F.coalesce("is_valid", F.lit(False)))
    return both.groupBy(*key).agg(F.coalesce(named("url"), F.lit("")).alias("url"), valid.alias("is_valid"), F.when(valid, "").otherwise(F.coalesce(named("error"), F.lit(""))).alias("error"), F.min("first_run").alias("first_run"), F.max("last_run").alias("last_run"))


def upsert_seen(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, first_run, last_run."""
    return old.unionByName(new).groupBy(key).agg(F.min("first_run").alias("first_run"), F.max("last_run").alias("last_run"))


def upsert_resolutions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Resolutions by identity: the last run's row, but an accepted hash is not given up for none."""
    order = F.struct("run", F.coalesce("hash", F.lit("")).alias("h"))
    both = old.unionByName(new)
    return both.groupBy("identity").agg(F.max("run").alias("run"), F.max(F.when(F.col("hash").isNotNull(), F.struct("run", "hash")))["hash"].alias("hash"), F.max_by("status", order).alias("status"))


def apply_resolutions(refs: DataFrame, resolutions: DataFrame) -> DataFrame:
    """refs with resolved_hash: that of the same (bug_id, title, repo), only where the reference has no hash."""
    r = resolutions.where("hash is not null").groupBy("bug_id", "title", "repo").agg(F.max(F.struct("run", "hash"))["hash"].alias("resolved"))
    return refs.join(r, ["bug_id", "title", "repo"], "left").withColumn("resolved_hash", F.when(F.col("hash").isNull(), F.col("resolved"))).drop("resolved")


def upsert_versions(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, sha256, is_valid, first_run, last_run: versions of an artifact's content; a version once valid stays so."""
    valid = F.max(F.coalesce("is_valid", F.lit(False))).alias("is_valid")
    return old.unionByName(new).groupBy(key, "sha256").agg(valid, F.min("first_run").alias("first_run"), F.max("last_run").alias("last_run"))


def children_once(known: DataFrame, children: DataFrame, version: str) -> DataFrame:
    """known, plus the children of versions that have none yet: a version never changes, so its children are written once."""
    return known.unionByName(children.join(known.select(version).distinct(), version, "left_anti"))


def reparse(derived: DataFrame, sources: DataFrame, version: str, parser_version: int, parse) -> DataFrame:
    """derived (version, parser_version, ..) with the rows of older parsers replaced: parse makes rows, without parser_version, of sources
    that have none of this parser. Rows of sources that are gone are left out."""
    fresh = derived.where(F.col("parser_version") == parser_version).join(sources.select(version), version, "left_semi")
    stale = sources.join(fresh.select(version).distinct(), version, "left_anti")
    return fresh.unionByName(parse(stale).withColumn("parser_version", F.lit(parser_version)))


def disowned(reports: DataFrame, report_versions: DataFrame, members: DataFrame, crashes: DataFrame, patches: DataFrame, patch_versions: DataFrame) -> DataFrame:
    """kind, key, error of rows that a snapshot must not take in: reports of another bug or of a crash of another version, patches of another commit.

    reports (snapshot_id, bug_id, report_version, crash_id), report_versions (report_version, bug_id), members (snapshot_id, bug_id,
    version_id), crashes (crash_id, version_id), patches (hash, patch_version), patch_versions (patch_version, hash).
    """
    own = report_versions.select("report_version", "bug_id").join(members, "bug_id").join(crashes, "version_id").select("snapshot_id", "bug_id", "report_version", "crash_id")
    bad = reports.join(own, ["snapshot_id", "bug_id", "report_version", "crash_id"], "left_anti")
    torn = patches.join(patch_versions, ["patch_version", "hash"], "left_anti")
    told = lambda df, kind, key, error: df.select(F.lit(kind).alias("kind"), key.cast("string").alias("key"), F.lit(error).alias("error"))
    return told(bad, "report", F.col("bug_id"), "snapshot report belongs to a different bug or crash version").unionByName(told(torn, "patch", F.col("hash"), "snapshot patch belongs to a different commit"))


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """key, change ('new', 'removed', 'changed') of two (key, content) listings; unchanged keys are left out."""
    b, a = before.select("key", F.col("content").alias("b"), F.lit(1).alias("in_b")), after.select("key", F.col("content").alias("a"), F.lit(1).alias("in_a"))
    change = F.when(F.col("in_b").isNull(), "new").when(F.col("in_a").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return b.join(a, "key", "full").select("key", change.alias("change")).where("change is not null")


def listing_errors(rows: DataFrame) -> DataFrame:
    """position, key, error of listing rows (position, key, title) that cannot be taken in: unsafe or repeated keys."""
    nth = F.row_number().over(Window.partitionBy("key").orderBy("position"))
    error = F.when(F.col("key").isNull() | ~F.col("key").rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$") | (F.length("key") > 128), "unsafe key").when(nth > 1, "duplicate key")
    return rows.select("position", "key", error.alias("error")).where("error is not null")


def fingerprint(files: DataFrame) -> DataFrame:
    """One row: a digest over (path, content) of all files, the same for the same files in any order or partitioning.

    Files are digested one by one; the second level joins sorted digests by two-character groups, so no row holds all.
    """
    leaf = files.select(F.sha2(F.concat_ws("\0", "path", F.sha2(F.col("content").cast("binary"), 256)), 256).alias("h"))
    group = leaf.groupBy(F.substring("h", 1, 2).alias("g")).agg(F.sha2(F.concat_ws("", F.sort_array(F.collect_list("h"))), 256).alias("h"))
    return group.agg(F.sha2(F.concat_ws("", F.sort_array(F.collect_list(F.concat("g", "h")))), 256).alias("fingerprint"))


class Store:
    """Snapshots below one folder; any file system that Spark reads will do."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = lambda path: (lambda p: (p.getFileSystem(spark._jsc.hadoopConfiguration()), p))(spark._jvm.org.apache.hadoop.fs.Path(path))

    def manifest(self) -> dict:
        """The newest manifest that was written whole: active run, last run checked, relations' folders."""
        fs, folder = self._fs(f"{self.root}/manifests")
        if not fs.exists(folder):
            return {"run": 0, "active": None, "last_checked": 0, "fingerprint": None, "relations": {}}
        newest = max((s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json")), default=None)
        if newest is None:
            return {"run": 0, "active": None, "last_checked": 0, "fingerprint": None, "relations": {}}
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.root}/manifests/{newest}", wholetext=True).collect()))

    def _publish(self, manifest: dict, number: int) -> None:
        fs, temporary = self._fs(f"{self.root}/manifests/.{uuid.uuid4().hex}")
        out = fs.create(temporary, False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        _, final = self._fs(f"{self.root}/manifests/{number:012d}.json")
        if fs.exists(final) or not fs.rename(temporary, final):
            fs.delete(temporary, False)
            raise RuntimeError(f"another writer has published manifest {number}")

    def ingest(self, relations: dict[str, DataFrame], errors: DataFrame | None = None, checked: int = 0, fingerprint_of: DataFrame | None = None, pending: DataFrame | None = None) -> str:
        """'unchanged', 'failed', 'partial' or 'completed'. Only a completed run becomes active; a partial one is stored.

        A run is partial if it has errors, or if work that the listing still refers to is pending.
        """
        now = self.manifest()
        mark = None if fingerprint_of is None else fingerprint(fingerprint_of).first()[0]
        number = now["run"] + 1
        seen = max(now["last_checked"], checked)
        if mark is not None and mark == now["fingerprint"] and now["active"] is not None:
            self._publish({**now, "run": number, "last_checked": seen, "status": "unchanged"}, number)
            return "unchanged"
        if "bugs" not in relations or relations["bugs"].isEmpty():
            self._publish({**now, "run": number, "last_checked": seen, "status": "failed"}, number)
            return "failed"
        folders = {name: f"{self.root}/run={number:08d}-{uuid.uuid4().hex[:8]}/{name}" for name in relations}
        for name, df in relations.items():
            df.write.parquet(folders[name])
        failed = errors is not None and not errors.isEmpty()
        if failed:
            errors.write.parquet(f"{self.root}/errors/run={number:08d}-{uuid.uuid4().hex[:8]}")
        if failed or pending is not None and not pending.isEmpty():
            self._publish({**now, "run": number, "last_checked": seen, "status": "partial"}, number)
            return "partial"
        self._publish({"run": number, "active": number, "last_checked": seen, "fingerprint": mark, "relations": folders, "status": "completed"}, number)
        return "completed"

    def read(self, name: str) -> DataFrame:
        """A relation of the active snapshot."""
        return self.spark.read.parquet(self.manifest()["relations"][name])
