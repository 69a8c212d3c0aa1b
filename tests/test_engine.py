"""Fixes, filters, snapshots, the mirror and streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from faultline.operators import checks, fixes, ingest
from faultline.operators.filters import Criteria
from faultline.plans import core
from faultline.sources import mirror
from faultline.streaming import arrivals


def _merged(rows):
    """The merge as its rules read, one bug and one reference after the other: those with a hash first, each by position."""
    out = []
    for bug in {r[0] for r in rows}:
        known: list[dict] = []
        for _, position, kind, h, title, repo in sorted((r for r in rows if r[0] == bug), key=lambda r: (r[3] is None, r[1])):
            same = [f for f in known if h and f["hash"] == h]
            alike = [f for f in known if not h and title and (f["title"], f["repo"]) == (title, repo)]
            bare = [f for f in alike if not f["hash"]]
            match = same[:1] or bare[:1] or (alike if len(alike) == 1 else [])
            if not match:
                known.append({"hash": h, "title": title, "repo": repo, "sources": [kind], "n": 1, "position": position})
                continue
            f = match[0]
            f["title"], f["repo"], f["n"], f["position"] = f["title"] or title, f["repo"] or repo, f["n"] + 1, min(f["position"], position)
            if kind not in f["sources"]:
                f["sources"].append(kind)
        out += [(bug, f["position"], f["hash"], f["title"], f["repo"], tuple(f["sources"]), f["n"]) for f in known]
    return sorted(out, key=str)


def _refs(seed, n=160):
    rng = random.Random(seed)
    return [(rng.randrange(12), k, rng.choice(["listing", "detail"]), rng.choice([None, None, "h1", "h2", "h3"]), rng.choice(["", "t1", "t2"]), rng.choice(["", "r"])) for k in rng.sample(range(1000), n)]


REFS = "bug_id long, position long, kind string, hash string, title string, repo string"


@pytest.mark.parametrize("seed", [4, 5, 6])
def test_merge_of_fixes(spark, seed):
    rows = _refs(seed)
    got = sorted(((r.bug_id, r.position, r.hash, r.title, r.repo, tuple(r.sources), r.references) for r in fixes.merge(spark.createDataFrame(rows, REFS)).collect()), key=str)
    assert got == _merged(rows)


def test_unions_of_fixes_keep_the_first(spark):
    rows = _refs(7)
    df = spark.createDataFrame([(b, p, k, h and h.upper(), t, r) for b, p, k, h, t, r in rows], REFS)
    want: dict = {}
    for b, p, k, h, t, r in sorted(rows, key=lambda x: (x[2] != "listing", x[1])):
        want.setdefault((b, h, t, r), (p, k))
    assert {(r.bug_id, r.hash, r.title, r.repo): (r.position, r.kind) for r in fixes.ordered_union(df).collect()} == want
    found: dict = {}
    for b, p, k, h, t, r in sorted(rows, key=lambda x: (x[2] != "detail", x[1])):
        h = h or ("h1" if (b, t, r) == (3, "t1", "r") else None)
        if h:
            old = found.setdefault((b, h), ["", ""])
            old[:] = [old[0] or t, old[1] or r]
    resolved = spark.createDataFrame([(3, "t1", "r", "H1"), (4, "t1", "r", None)], "bug_id long, title string, repo string, hash string")
    assert {(r.bug_id, r.hash): [r.title, r.repo] for r in fixes.research_fixes(df, resolved).collect()} == found
    jobs = {r.hash: (r.repo, r.bugs) for r in fixes.patch_jobs(spark.createDataFrame([(2, 1, "listing", "h", "t", "late"), (1, 5, "listing", "h", "t", "first"), (1, 2, "detail", "h", "t", "")], REFS)).collect()}
    assert jobs == {"h": ("first", 2)}


def test_sizes_are_unknown_unless_all_is_known(spark):
    bugs = spark.createDataFrame([(k,) for k in range(1, 8)], "bug_id long")
    refs = spark.createDataFrame([(1, "d", "a", "t", "r"), (1, "l", "a", "t", "q"), (2, "d", "a", "t", "r"), (2, "d", "b", "t", "r"), (3, "d", "c", "t", "r"), (4, "d", "a", "t", "r"), (4, "d", None, "u", "r"), (5, "d", "a", "t", "r"), (5, "l", None, "t", "r"), (6, "d", None, "t", "r")], "bug_id long, kind string, hash string, title string, repo string")
    patches = spark.createDataFrame([("a", True, True), ("b", False, True), ("c", True, False)], "hash string, is_valid boolean, is_complete boolean")
    ranges = spark.createDataFrame([("a", "x", "x", 1, 2, "text"), ("a", "x", "y", 0, 1, "text"), ("c", "x", "x", 5, 5, "text")], "hash string, old_path string, new_path string, old_count long, new_count long, kind string")
    got = {r.bug_id: (r.hashes, r.has_patch, r.fix_file_count, r.patch_line_count) for r in fixes.patch_metrics(bugs, refs, patches, ranges).collect()}
    assert got == {1: (1, True, 2, 4), 2: (2, True, None, None), 3: (1, True, None, None), 4: (1, True, None, None), 5: (1, True, 2, 4), 6: (0, False, None, None), 7: (0, False, None, None)}


@pytest.mark.parametrize("bad", [{"types": ("nope",)}, {"tags": "abc"}, {"tags": ("",)}, {"crash_files": ("a\n",)}, {"max_patch_lines": -1}, {"max_fix_files": True}, {"has_report": 1}, {"families": ("x",)}])
def test_criteria_are_checked(bad):
    with pytest.raises(ValueError):
        Criteria(**bad)


def test_facets_add_up(spark):
    d = "/root/testdata/sf0.001"
    total = spark.read.parquet(f"{d}/orders.parquet").count()
    for name in ("facet_bug_types", "facet_families", "facet_access_modes"):
        assert core.QUERIES[name](spark, d).agg(F.sum("bugs")).first()[0] == total


def test_snapshots(spark, tmp_path):
    store = ingest.Store(spark, f"file://{tmp_path}/store")
    bugs = spark.createDataFrame([(1, "a"), (2, "b")], "bug_id long, title string")
    files = spark.createDataFrame([("p", b"1"), ("q", b"2")], "path string, content binary")
    assert store.ingest({"bugs": bugs.limit(0)}) == "failed" and store.manifest()["active"] is None
    assert store.ingest({"bugs": bugs}, checked=5, fingerprint_of=files) == "completed"
    assert store.ingest({"bugs": bugs}, checked=3, fingerprint_of=files.repartition(3)) == "unchanged"
    errors = spark.createDataFrame([("x",)], "error string")
    assert store.ingest({"bugs": bugs.limit(1)}, errors=errors) == "partial"
    assert store.manifest()["last_checked"] == 5 and store.read("bugs").count() == 2
    assert store.ingest({"bugs": bugs.limit(1)}) == "completed" and store.read("bugs").count() == 1


def test_checks_find_what_breaks(spark):
    blobs = spark.createDataFrame([("x", b"a", 1)], "sha256 string, content binary, size_bytes long")
    assert checks.damaged_blobs(blobs).count() == 1
    a, b = (spark.createDataFrame([(k,) for k in keys], "key long") for keys in ((1, 2), (2, 3)))
    assert {(r.key, tuple(r.present)) for r in checks.bijection(a=a, b=b).collect()} == {("1", ("a",)), ("3", ("b",))}
    assert checks.active_count(spark.createDataFrame([(True,), (True,)], "is_current boolean")).count() == 1


HTML = "<html><body><a href='/bug?extid=zz&label=subsystems:no'>out</a><table><tr><td><a href='/bug?extid=k1'>t</a><a href='?label=subsystems%3Anet'>net</a><a href='?label=subsystems%3Afs'>fs</a></td></tr><tr><td><a href='/bug?extid=k2'>a</a><a href='/bug?id=k3'>b</a><a href='?label=subsystems%3Amm'>mm</a></td></tr></table></body></html>"


def test_mirror(spark, tmp_path):
    for folder in ("raw/bugs", "artifacts/reports", "artifacts/patches"):
        (tmp_path / folder).mkdir(parents=True)
    h = "ab" * 20
    listed = [{"title": "KASAN: x", "link": "/bug?extid=k1", "fix-commits": [{"title": "net: fix", "hash": h.upper(), "repo": "r"}]}, {"title": "t2", "link": "/bug?extid=k2", "fix-commits": [{"title": "only <b>title</b>"}]}, {"title": "dup", "link": "/bug?extid=k2"}, {"title": "none", "link": "/bug"}]
    (tmp_path / "raw/upstream_fixed.json").write_text(json.dumps({"version": 1, "bugs": listed}))
    (tmp_path / "raw/upstream_fixed.html").write_text(HTML)
    (tmp_path / "raw/bugs/extid-k1.json").write_text(json.dumps({"id": "1", "title": "KASAN: x", "crashes": [{"title": "c"}, {"title": "c", "c-reproducer": "/u", "crash-report-link": "/r"}], "fix-commits": [{"title": "net: fix", "hash": h, "repo": "r"}]}))
    (tmp_path / "raw/bugs/extid-k2.json").write_text("[")
    (tmp_path / "artifacts/reports/extid-k1.txt").write_text("BUG: x\n")
    (tmp_path / "artifacts/reports/extid-k2.txt").write_text("<html>no</html>")
    (tmp_path / f"artifacts/patches/{h}.diff").write_text("diff --git a/x b/x\n" + "-" * 60)
    got = mirror.load(spark, f"file://{tmp_path}")
    assert {(r.key, r.tag) for r in got["tags"].collect()} == {("extid-k1", "fs"), ("extid-k1", "net")}
    assert sorted((r.kind, r.key or "", r.error) for r in got["errors"].collect()) == [("detail", "extid-k2", "not a JSON object"), ("listing", "", "no single bug key in the link"), ("listing", "extid-k2", "repeated key"), ("listing", "extid-k2", "repeated key"), ("report", "extid-k2", "no report")]
    assert sorted((r.key, r.kind, r.hash, r.title) for r in got["refs"].collect()) == [("extid-k1", "detail", h, "net: fix"), ("extid-k1", "listing", h, "net: fix")]
    c = got["details"].where("error is null").select(mirror.reproducers(F.col("detail.crashes")).alias("r"), mirror.first_report(F.col("detail.crashes")).alias("l")).first()
    assert (c.r.status, c.r.urls, c.l) == ("available", ["/u"], "/r")
    assert got["patches"].where("is_valid").count() == 1
    member = mirror.listing_membership(got["listing"].where("key is not null"), mirror.html_keys(spark.createDataFrame([(HTML,)], "text string"))).collect()
    assert {(r.key, r.side) for r in member} == {("extid-zz", "html"), ("id-k3", "html")}
    for text, why in (('{"Bugs": 3}', "no array of bugs"), ("[", "no array of bugs"), ('{"bugs": [null]}', "not an object")):
        assert [r.error for r in mirror.listing(spark.createDataFrame([(text,)], "value string")).collect()] == [why], text
    catalog = mirror.catalog(got["listing"], "now")
    assert json.loads(catalog)["generated_at"] == "now" and [b["key"] for b in json.loads(catalog)["bugs"]] == ["extid-k1"]
    assert mirror.catalog(got["listing"], "later", catalog) == catalog and "later" in mirror.catalog(got["listing"].limit(0), "later", catalog)
    saved = mirror.save_state({"pending_reports": ["b", "a", "a"]})
    assert mirror.load_state(saved) == {"pending_details": [], "pending_reports": ["a", "b"], "pending_patches": []}
    assert mirror.tags_of("<tr><a href='http://[x'>a</a><a href='/bug?id=k'>b</a><a href='?label=subsystems: '>c</a><a href='?label=subsystems: fs '>d</a></tr>") == [("id-k", "fs")]
    with pytest.raises(ValueError):
        mirror.load_state('{"version": 3}')
    assert mirror.load_state('{"version": 1, "pending_details": ["b", "a"]}') == {"pending_details": ["a", "b"], "pending_reports": [], "pending_patches": []}


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "k1.txt").write_text("KASAN: use-after-free in f\nmore")
    q = arrivals.reports(spark, f"file://{folder}").writeStream.format("memory").queryName("arrived").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination()
    r = spark.table("arrived").first()
    assert (r.key, r.bug_type, r.family) == ("k1", "kasan", "use-after-free")
    merge = arrivals.merge_into(f"file://{tmp_path}/store")
    batch = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "key string, content string")
    merge(batch, 0)
    merge(batch.union(spark.createDataFrame([("d", "z")], batch.schema)), 1)
    assert spark.read.parquet(f"file://{tmp_path}/store/blobs").count() == 3
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props").write.parquet(f"file://{tmp_path}/events")
    events = spark.readStream.schema(arrivals.EVENT).parquet(f"file://{tmp_path}/events")
    q = arrivals.attempts(events).writeStream.format("memory").queryName("tries").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination()
    assert spark.table("tries").count() > 0
