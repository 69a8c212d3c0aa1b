"""The file mirror: listing, details, reports and patches, read by Spark and flattened into the engine's relations.

Layout below one root: raw/upstream_fixed.json and .html, raw/bugs/KEY.json, artifacts/reports/KEY.txt,
artifacts/patches/HASH.diff, processed/resolved_fix_hashes.json, processed/sync_state.json. Payloads are parsed with explicit schemas;
what does not parse becomes a row of errors, never an exception in a task.
"""

from __future__ import annotations

import json
from html.parser import HTMLParser
from urllib.parse import parse_qs, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import FULL_HASH, HASH, fix_title, is_key, link_key, origin
from ..operators.corpus import valid_patch, valid_report

_FIX = "struct<title:string,link:string,hash:string,repo:string,branch:string>"
_LISTING = f"array<struct<title:string,link:string,`fix-commits`:array<{_FIX}>>>"
_CRASH = "struct<title:string,`c-reproducer`:string,`kernel-config`:string,`kernel-source-git`:string,`kernel-source-commit`:string,`crash-report-link`:string>"
DETAIL = f"id string, title string, status string, `first-crash` string, `last-crash` string, `fix-time` string, `close-time` string, `fix-commits` array<{_FIX}>, crashes array<{_CRASH}>, discussions array<string>, _corrupt string"


def artifacts(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """key, content, text, size of the files of one kind; the key is the file's stem."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)
    stem = F.regexp_extract("path", r"([^/]+)\Q" + suffix + r"\E$", 1)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return f.select(stem.alias("key"), "content", F.regexp_replace(text, "^﻿", "").alias("text"), F.col("length").alias("size"))


def listing(payload: DataFrame) -> DataFrame:
    """position, key, title, link, fixes, first_hash, error of the one listing in payload (value: its JSON).

    The array may be called Bugs or bugs. A row without a single key in its link, with a repeated key or with a malformed fix
    entry says so in error.
    """
    array = F.coalesce(F.get_json_object("value", "$.Bugs"), F.get_json_object("value", "$.bugs"))
    parsed = F.from_json(array, _LISTING)
    # a payload without such an array is one row that says so, not an empty listing
    torn = F.array(F.lit(None).cast(_LISTING.removeprefix("array<")[:-1]))
    rows = payload.select(F.posexplode(F.when(parsed.isNull(), torn).otherwise(parsed)).alias("position", "b"), parsed.isNull().alias("torn"))
    rows = rows.select("position", "torn", F.col("b").isNull().alias("no_object"), "b.title", "b.link", F.coalesce("b.fix-commits", F.array().cast(f"array<{_FIX}>")).alias("fixes"))
    rows = rows.withColumn("key", link_key(F.col("link")))
    repeated = rows.where("key is not null").groupBy("key").agg(F.count("*").alias("_n"))
    rows = rows.join(repeated, "key", "left")
    bad = F.exists("fixes", lambda f: f.isNull() | (F.coalesce(f.hash, F.lit("")) != "") & ~F.coalesce(f.hash, F.lit("")).rlike(FULL_HASH))
    error = F.when(F.col("torn"), "no array of bugs").when(F.col("no_object"), "not an object").when(F.col("key").isNull(), "no single bug key in the link").when(F.col("_n") > 1, "repeated key").when(bad, "malformed fix entry").when(F.coalesce("title", F.lit("")) == "", "no title")
    first = F.get(F.filter(F.transform("fixes", lambda f: F.lower(f.hash)), lambda h: F.coalesce(h, F.lit("")) != ""), F.lit(0))
    return rows.select("position", "key", "title", "link", "fixes", F.coalesce(first, F.lit("")).alias("first_hash"), error.alias("error"))


def details(files: DataFrame) -> DataFrame:
    """key, detail (struct), error of detail files (key, text)."""
    parsed = F.from_json("text", DETAIL, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    got = files.select("key", parsed.alias("detail"))
    error = F.when(F.col("detail").isNull() | F.col("detail._corrupt").isNotNull(), "not a JSON object").when(~is_key(F.col("key")), "unsafe key").when(F.exists(F.coalesce("detail.crashes", F.array().cast(f"array<{_CRASH}>")), lambda c: c.isNull()), "malformed crash")
    return got.withColumn("error", error)


def first_report(crashes):
    """The link of the first crash that has a report."""
    return F.get(F.filter(F.transform(crashes, lambda c: c["crash-report-link"]), lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(0))


def reproducers(crashes):
    """struct(status, urls): available with distinct links in order, not provided, or unknown without crashes to look at."""
    urls = F.array_distinct(F.filter(F.transform(crashes, lambda c: c["c-reproducer"]), lambda x: F.coalesce(x, F.lit("")) != ""))
    return F.struct(F.when(crashes.isNull(), "unknown").when(F.size(urls) > 0, "available").otherwise("not_provided").alias("status"), F.coalesce(urls, F.array().cast("array<string>")).alias("urls"))


def patch_urls(fixes):
    """Of each fix its link if it is http or https; distinct, in order."""
    return F.array_distinct(F.filter(F.transform(fixes, lambda f: F.when(origin(f.link).isNotNull(), f.link)), lambda x: x.isNotNull()))


def merged_payload(listing_row, detail):
    """struct title, link, source: a bug's title is that of its details, else of the listing, else nothing."""
    said = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    return F.struct(F.coalesce(said(detail["title"]), said(listing_row["title"])).alias("title"), listing_row["link"].alias("link"), F.when(detail.isNotNull(), "detail").otherwise("listing").alias("source"))


def shown_title(listing_title, detail_title, key):
    """The listing's title, else the details', else the key."""
    return F.coalesce(F.nullif(listing_title, F.lit("")), F.nullif(detail_title, F.lit("")), key)


def report_title(crash_title, version_title):
    return F.coalesce(F.nullif(crash_title, F.lit("")), version_title)


def chosen_crash(crashes, ordinal=None, report_url=None):
    """The crash to fetch evidence of, with its ordinal: the one asked for, else the one whose report is shown, else the first with a report, else
    the first; null if there is none or the one asked for is not there."""
    placed = F.transform(crashes, lambda c, i: F.struct(i.alias("ordinal"), c.alias("crash")))
    link = lambda p: F.coalesce(p["crash"]["crash-report-link"], F.lit(""))
    first = lambda test: F.get(F.filter(placed, test), F.lit(0))
    chosen = F.coalesce(*([first(lambda p: link(p) == report_url)] if report_url is not None else []), first(lambda p: link(p) != ""), F.get(placed, F.lit(0)))
    return chosen if ordinal is None else F.when(ordinal.isNotNull(), first(lambda p: p["ordinal"] == ordinal)).otherwise(chosen)


#: What evidence of each kind has to hold to be taken.
EVIDENCE_CONTENT = {
    "c-repro": r"\b(?:int|void)\s+main\s*\(",
    "syz-repro": r"(?m)^\s*(?:r\d+\s*=\s*)?[A-Za-z_]\w*(?:\$\w+)?\s*\(",
    "config": r"(?m)^(?:CONFIG_[A-Za-z0-9_]+=|# CONFIG_[A-Za-z0-9_]+ is not set\r?$)",
}


def valid_evidence(kind, text):
    """Is a payload neither blank nor markup and, where its kind has a rule, what it says?"""
    wrong = F.lit(False)
    for name, pattern in EVIDENCE_CONTENT.items():
        wrong = wrong | ((kind == name) & ~text.rlike(pattern))
    return F.coalesce(valid_report(text) & ~wrong, F.lit(False))


def catalog(rows: DataFrame, generated_at: str, before: str | None = None) -> str:
    """The catalog's JSON text for listing() rows: position, key, title, link, fixes. The time of an earlier catalog stays if nothing else differs.

    The catalog is one file by its format; its rows are collected in listing order.
    """
    good = rows.where("error is null").select("position", F.struct("key", "title", "link", "fixes", "first_hash").alias("bug")).orderBy("position")
    bugs = [json.loads(r[0]) for r in good.select(F.to_json("bug")).collect()]
    if before is not None:
        old = json.loads(before)
        if old.get("bugs") == bugs and old.get("generated_at"):
            generated_at = old["generated_at"]
    return json.dumps({"generated_at": generated_at, "bugs": bugs}, indent=2, sort_keys=True) + "\n"


def fix_refs(rows: DataFrame, kind: str) -> DataFrame:
    """key, kind, ordinal, hash, title, repo of rows (key, fixes)."""
    out = rows.select("key", F.posexplode("fixes").alias("ordinal", "f"))
    valid = F.lower(F.when(F.col("f.hash").rlike(HASH), F.col("f.hash")))
    return out.select("key", F.lit(kind).alias("kind"), "ordinal", valid.alias("hash"), fix_title(F.coalesce("f.title", F.lit(""))).alias("title"), F.coalesce("f.repo", F.lit("")).alias("repo"))


def _link(href: str) -> tuple[set[str], set[str]]:
    """(bug keys, subsystem labels) that a link names; nothing for one that is no URL."""
    try:
        url = urlsplit(href)
        query = parse_qs(url.query)
    except ValueError:
        return set(), set()
    keys = {f"{name}-{values[0]}" for name, values in query.items() if name in ("extid", "id") and len(values) == 1 and url.path.endswith("/bug")}
    labels = {label.partition(":")[2].strip() for label in query.get("label", ()) if label.startswith("subsystems:")}
    return keys, labels - {""}


class _Rows(HTMLParser):
    """What the links of each innermost table row name; links outside of rows are collected apart."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[set[str], set[str]]] = []
        self.rows: list[tuple[set[str], set[str]]] = []
        self.keys: set[str] = set()

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.open.append((set(), set()))
        elif tag == "a" and (href := dict(attrs).get("href")):
            keys, labels = _link(href)
            self.keys |= keys
            if self.open:
                self.open[-1][0].update(keys)
                self.open[-1][1].update(labels)

    def handle_endtag(self, tag):
        if tag == "tr" and self.open:
            self.rows.append(self.open.pop())


def _parsed(html: str) -> _Rows:
    parser = _Rows()
    parser.feed(html or "")
    parser.close()
    return parser


def tags_of(html: str) -> list[tuple[str, str]]:
    """(key, label) of the table rows that name exactly one bug."""
    return list(dict.fromkeys((next(iter(keys)), label) for keys, labels in _parsed(html).rows if len(keys) == 1 for label in sorted(labels)))


def keys_of(html: str) -> list[str]:
    """The bug keys that any link names."""
    return sorted(_parsed(html).keys)


def subsystem_tags(pages: DataFrame, text: str = "text") -> DataFrame:
    """key, tag of listing pages. HTML needs a real parser; it runs over Arrow batches."""

    def run(batches):
        for b in batches:
            rows = [r for t in b.column(0).to_pylist() for r in tags_of(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(2)], names=["key", "tag"])

    return pages.select(text).mapInArrow(run, "key string, tag string").distinct()


def html_keys(pages: DataFrame, text: str = "text") -> DataFrame:
    """key: the bugs that listing pages link to."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([k for t in b.column(0).to_pylist() for k in keys_of(t)], pa.string())], names=["key"])

    return pages.select(text).mapInArrow(run, "key string").distinct()


def listing_membership(json_rows: DataFrame, html_keys: DataFrame) -> DataFrame:
    """key, side of keys that only one of the two listings has."""
    j, h = json_rows.select("key").distinct(), html_keys.select("key").distinct()
    return j.join(h, "key", "left_anti").withColumn("side", F.lit("json")).unionByName(h.join(j, "key", "left_anti").withColumn("side", F.lit("html")))


def resolutions(payload: DataFrame) -> DataFrame:
    """bug_key, title, repo, status, hash of a resolution file; only 40-digit hashes count."""
    item = "struct<bug_key:string,title:string,repo:string,status:string,hash:string>"
    rows = payload.select(F.explode(F.from_json(F.get_json_object("value", "$.resolutions"), f"array<{item}>")).alias("r")).select("r.*")
    return rows.withColumn("hash", F.lower(F.when(F.col("hash").rlike(FULL_HASH), F.col("hash")))).withColumn("title", fix_title(F.coalesce("title", F.lit(""))))


def load_state(text: str) -> dict[str, list[str]]:
    """Pending work of a retry file, version 1 or 2; anything else is refused."""
    state = json.loads(text)
    kinds = {1: ("pending_details", "pending_reports"), 2: ("pending_details", "pending_reports", "pending_patches")}
    if not isinstance(state, dict) or state.get("version") not in kinds:
        raise ValueError("unknown retry state")
    out = {}
    for name in kinds[state["version"]]:
        values = state.get(name, [])
        if not isinstance(values, list) or any(not isinstance(v, str) or not v for v in values):
            raise ValueError(f"{name} must list texts")
        out[name] = sorted(set(values))
    return {**dict.fromkeys(kinds[2], []), **out}


def save_state(pending_work: dict[str, list[str]]) -> str:
    """The text of a retry file, version 2; load_state() reads it back."""
    unknown = set(pending_work) - {"pending_details", "pending_reports", "pending_patches"}
    if unknown:
        raise ValueError(f"unknown work: {', '.join(sorted(unknown))}")
    return json.dumps({"version": 2, **{k: sorted(set(pending_work.get(k, ()))) for k in ("pending_details", "pending_reports", "pending_patches")}}, indent=2, sort_keys=True) + "\n"


def pending(state: DataFrame, live_keys: DataFrame, live_hashes: DataFrame) -> DataFrame:
    """Rows of state (kind, value) that the current listing still refers to."""
    keys = state.where("kind <> 'patch'").join(live_keys.select(F.col("key").alias("value")), "value", "left_semi")
    return keys.unionByName(state.where("kind = 'patch'").join(live_hashes.select(F.col("hash").alias("value")), "value", "left_semi"))


def status(bugs: DataFrame, reports: DataFrame, refs: DataFrame, patches: DataFrame) -> DataFrame:
    """One row of counters of what is there and what is missing. bugs (bug_id, has_detail), reports (bug_id, is_valid), refs (bug_id, hash), patches (hash, is_valid)."""
    hashed = refs.where("hash is not null").select("bug_id", "hash")
    rows = bugs.join(reports.where("is_valid").select("bug_id", F.lit(1).alias("_r")), "bug_id", "left").join(hashed.select("bug_id", F.lit(1).alias("_h")).distinct(), "bug_id", "left")
    per = rows.agg(F.count("*").alias("catalog_bugs"), F.count_if("has_detail").alias("bug_json"), F.count("_r").alias("crash_reports"), F.count_if(F.col("_r").isNull()).alias("missing_reports"), F.count("_h").alias("bugs_with_fix_hash"), F.count_if(F.col("_h").isNull()).alias("bugs_without_fix_hash"))
    jobs = hashed.select("hash").distinct().join(patches.where("is_valid").select("hash", F.lit(1).alias("_p")), "hash", "left")
    of_jobs = jobs.agg(F.count("*").alias("unique_fix_hashes"), F.count("_p").alias("patches_on_disk"), F.count_if(F.col("_p").isNull()).alias("missing_patches"))
    return per.crossJoin(of_jobs)  # one row each


def load(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Relations of a mirror: listing, details, refs, tags, reports, patches; errors holds what was refused."""
    rows = listing(spark.read.text(f"{root}/raw/upstream_fixed.json", wholetext=True))
    detail = details(artifacts(spark, f"{root}/raw/bugs", ".json"))
    good = detail.where("error is null").select("key", F.coalesce("detail.fix-commits", F.array().cast(f"array<{_FIX}>")).alias("fixes"))
    reports = artifacts(spark, f"{root}/artifacts/reports", ".txt").select("key", F.col("text").alias("report"), valid_report(F.col("text")).alias("is_valid"))
    patches = artifacts(spark, f"{root}/artifacts/patches", ".diff").select(F.lower("key").alias("hash"), F.col("text").alias("patch"), valid_patch(F.col("text")).alias("is_valid"))
    errors = rows.where("error is not null").select(F.lit("listing").alias("kind"), "key", "error").unionByName(detail.where("error is not null").select(F.lit("detail").alias("kind"), "key", "error"))
    errors = errors.unionByName(reports.where("not is_valid").select(F.lit("report").alias("kind"), "key", F.lit("no report").alias("error"))).unionByName(patches.where("not is_valid").select(F.lit("patch").alias("kind"), F.col("hash").alias("key"), F.lit("no patch").alias("error")))
    return {
        "listing": rows, "details": detail, "refs": fix_refs(rows.where("error is null"), "listing").unionByName(fix_refs(good, "detail")),
        "tags": subsystem_tags(spark.read.text(f"{root}/raw/upstream_fixed.html", wholetext=True), "value"), "reports": reports, "patches": patches, "errors": errors,
    }
