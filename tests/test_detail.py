"""Explanations and detail documents where many bugs share patches: what they answer, and what they must not shuffle."""

import random

from faultline.operators.corpus import Corpus
from faultline.plans import core, detail

SF = "/root/testdata/sf0.001"
PATHS, NAMES = ["a/x.c", "a/y.c", None], ["f", "g", "h", None]


def _corpus(spark, seed: int = 5) -> Corpus:
    rng = random.Random(seed)
    bugs = [(k, k, f"KASAN: use-after-free Read in f{k}", "available") for k in range(40)]
    sites = [(k, rng.choice(PATHS), k, rng.choice(NAMES)) for k in range(40) if k % 9] + [(3, "a/y.c", 1, "g")]
    refs = [(rng.randrange(42), rng.choice(["listing", "detail"]), at, rng.choice(["p0", "p1", "p2", "p3", "gone", None]), rng.choice(["t1", "t2", "", None]), rng.choice(["r", "q", None])) for at in range(200)]
    refs = [r for r in refs if not 30 <= r[0] < 36] + [(k, "detail", 300 + k, "p4", "t1", "r") for k in range(30, 36)] + [(31, "listing", 400, None, "t1", "r"), (32, "listing", 401, None, "t2", "r")]
    patches = [(f"p{k}", k != 2, k != 3) for k in range(5)]
    ranges = [(rng.choice(["p0", "p1", "p2", "p3", "no"]), rng.choice(PATHS), rng.choice(PATHS), rng.randrange(2), rng.randrange(4), rng.randrange(4), rng.choice(NAMES), rng.choice(["text"] * 9 + ["binary"])) for _ in range(60)] + [("p4", "a/x.c", "a/x.c", 0, 1, 2, "f", "text"), ("p4", None, "a/n.c", 1, 1, 2, "g", "text")]
    line = lambda: rng.choice([f" {rng.choice('fgk')}+0x1/0x2 {rng.choice(['a/x.c', './a/y.c', 'b/z.c'])}:{rng.randrange(1, 9)}", f" {rng.choice('fg')}.constprop.0+0x1/0x2", "Freed by task 7:", "text"])
    reports = [(k, "\n".join(line() for _ in range(rng.randrange(9)))) for k in range(42) if k % 7]
    made = lambda rows, schema: spark.createDataFrame(rows, schema)
    return Corpus(
        made(bugs, "bug_id long, position long, title string, repro_status string"), made([(k, t) for k in range(40) for t in ("net", "fs")[: k % 3]], "bug_id long, tag string"), made(sites, "bug_id long, path string, line long, function string"),
        made(refs, "bug_id long, kind string, position long, hash string, title string, repo string"), made(patches, "hash string, is_valid boolean, is_complete boolean"),
        made(ranges, "hash string, old_path string, new_path string, old_start int, old_count int, new_count int, function string, kind string"), made(reports, "bug_id long, report string"),
    )


def _stacks(c):
    """bug: (function, path) of each frame before the first heading, read plainly."""
    out = {}
    for bug, report in c.reports.collect():
        for line in (report or "").split("\n"):
            if line.startswith("Freed"):
                break
            if "+0x" in line:
                name, _, at = line.strip().partition(" ")
                out.setdefault(bug, []).append((name.split("+")[0].split(".")[0], at.removeprefix("./").split(":")[0] or None))
    return out


def test_explanations_of_odd_rows(spark):
    c = _corpus(spark)
    valid, frames, want = {r.hash for r in c.patches.collect() if r.is_valid}, _stacks(c), []
    ranges, links = {(r.hash, r.old_path, r.new_path, r.old_start, r.function, r.kind) for r in c.ranges.collect()}, {(r.bug_id, r.hash) for r in c.refs.collect() if r.hash in valid}
    for s in c.sites.collect():
        for bug, h in links:
            for own, old, new, start, f, kind in ranges:
                if bug != s.bug_id or own != h:
                    continue
                known, same = s.path is not None and (old or new), s.path in (old, new)
                grade = "unknown" if not known else "different-file" if not same else "same-function" if f is not None and f == s.function else "same-file"
                met = [at for name, at in frames.get(bug, ()) if name == f]
                in_file = sum(at is not None and at in (old, new) for at in met)
                by_name = sum(not (at is not None and at in (old, new)) and (at is None or not (old or new)) for at in met)
                want.append((bug, h, old, new, start, f, kind, grade, "unknown" if grade == "unknown" else "inferred", in_file, by_name))
    got = [tuple(r) for r in detail.explanations(c).drop("method").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(w[-2] for w in want) and sum(w[-1] for w in want)


def test_explanations_meet_their_ranges_last(spark):
    """Nothing is shuffled that is made of each range of each bug, and no hash goes through a shuffle."""
    plan = detail.explanations(core.load(spark, SF, numbered=True))._jdf.queryExecution().executedPlan().toString().splitlines()
    join = next(k for k, line in enumerate(plan) if "Join" in line)
    assert "SortMergeJoin [hash" in plan[join] and not any("Exchange" in line for line in plan[:join])
    assert not any("sha2" in line for line in plan)


def test_documents_of_odd_rows(spark):
    c = _corpus(spark)
    refs, ranges, patches = c.refs.collect(), c.ranges.collect(), {r.hash: r.is_complete for r in c.patches.collect() if r.is_valid}
    frames, sites = c.reports.collect(), c.sites.collect()
    got, counted = ({r.bug_id: r for r in detail.documents(c, named).collect()} for named in (True, False))
    assert set(got) == set(counted) == set(range(40)) and any(r.fix_file_count for r in got.values())
    for bug, r in got.items():
        own = [x for x in refs if x.bug_id == bug]
        hashes = {x.hash for x in own if x.hash}
        mine = [x for x in ranges if x.hash in hashes and x.hash in patches]
        files = {x.new_path or x.old_path for x in mine} - {None}
        assert (r.hashes, r.available, r.n_ranges, r.fix_files) == (len(hashes), len(hashes & set(patches)), len(mine), sorted(files))
        open_ref = any(not x.hash and (x.title is None or x.repo is None or len({y.hash for y in own if y.hash and (y.title, y.repo) == (x.title, x.repo)}) != 1) for x in own)
        known = hashes and not open_ref and all(patches.get(h) for h in hashes) and not any(x.kind == "binary" or not (x.new_path or x.old_path) for x in mine)
        assert (r.fix_file_count, r.patch_line_count) == ((len(files), sum(x.old_count + x.new_count for x in mine)) if known else (None, None))
        ranks = {0 if s.path is None or not (x.old_path or x.new_path) else 1 if s.path not in (x.old_path, x.new_path) else 3 if x.function and x.function == s.function else 2 for s in sites if s.bug_id == bug for x in mine}
        name = ["unknown", "different-file", "same-file", "same-function"][max(ranks, default=0)]
        assert r.relationship == ("unknown" if name == "different-file" and (min(ranks) != 1 or not known) else name)
        assert sum(f.references for f in r.fixes) == len(own) and all(f.patch_available == (f.hash in patches) for f in r.fixes)
        other = counted[bug]
        assert len(other.fix_files) == len(files) and other[:3] == r[:3] and (other.fixes, other.stack, other.fix_file_count) == (r.fixes, r.stack, r.fix_file_count)
        assert r.n_frames == sum(line.count("+0x1") for b, report in frames if b == bug for line in report.split("\n"))


def test_documents_shuffle_numbers_for_paths(spark):
    """Files go to the bugs as numbers, and no hash is made of what is shuffled."""
    made = detail.documents(core.load(spark, SF, numbered=True), named=False)
    assert dict(made.dtypes)["fix_files"] == "array<int>"
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert not any("sha2" in line and "report_sha256" not in line for line in plan.splitlines())
