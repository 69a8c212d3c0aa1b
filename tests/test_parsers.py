"""Parsers and classifiers on our own small inputs."""

import pytest
from pyspark.sql import functions as F

from faultline.functions import classify, stats, text
from faultline.operators import corpus, diffs, stacks, study
from faultline.sources import driver

TITLES = {
    "KASAN: use-after-free Read in foo": ("kasan", "use-after-free", "read"), "kmsan : uninit-value in x": ("kmsan", "uninitialized-value", "unknown"), "KCSAN: data-race in a / b": ("kcsan", "data-race", "unknown"),
    "KFENCE: invalid free in k": ("kfence", "invalid-free", "unknown"), "UBSAN: shift-out-of-bounds in s": ("ubsan", "shift-out-of-bounds", "unknown"), "KASAN missing colon": ("other", "unknown", "unknown"),
    "WARNING: deadlock use-after-free": ("warning", "unknown", "unknown"), "  Kernel   BUG at x (2) (3)": ("bug", "unknown", "unknown"), "ci-x build error: WARNING in y": ("build-error", "unknown", "unknown"),
    "ci-x boot error: KASAN: out-of-bounds Write in y": ("kasan", "out-of-bounds", "write"), "ci-x test error": ("test-error", "unknown", "unknown"), "ci-x boot error: odd": ("boot-error", "unknown", "unknown"),
    "infos": ("other", "unknown", "unknown"), "memory leak in read": ("memory-leak", "memory-leak", "unknown"), "": ("other", "unknown", "unknown"),
}


def test_titles(spark):
    got = corpus.classified(spark.createDataFrame([(t,) for t in TITLES], "title string")).collect()
    assert {r.title: (r.bug_type, r.family, r.access_mode) for r in got} == TITLES


def test_every_type_has_a_title(spark):
    b = spark.createDataFrame([(t.format(f="f", g="g"),) for t in driver.TITLES], "title string")
    assert {r.bug_type for r in corpus.classified(b).collect()} == set(classify.TYPES)


REPORT = """BUG: KASAN: use-after-free in foo+0x1/0x2 net/a.c:10
Read of size 8 at addr ffff by task exe/7
Call Trace:
 <TASK>
 [<ffffffff81000001>] dump_stack_lvl+0x1/0x2 lib/d.c:1
 inner net/a.c:5:3 [inline]
 foo.constprop.0+0x1/0x2 ./net/a.c:10
 bar+0x1/0x2
 [<ffffffff81000002>]
Allocated by task 7:
 kmalloc+0x1/0x2 mm/s.c:3
Uninit was stored to memory at:
 baz+0x1/0x2 mm/t.c:4
unwind stack type:0
 qux+0x1/0x2 mm/u.c:5
"""


def test_stack_frames(spark):
    got = stacks.frames(spark.createDataFrame([(1, REPORT), (2, None), (3, "")], "bug_id long, report string")).orderBy("report_line", "ordinal").collect()
    assert [(r.section, r.function, r.path, r.line, r.column, r.inline) for r in got] == [
        ("manifestation", "dump_stack_lvl", "lib/d.c", 1, None, False), ("manifestation", "inner", "net/a.c", 5, 3, True), ("manifestation", "foo", "net/a.c", 10, None, False),
        ("manifestation", "bar", None, None, None, False), ("manifestation", None, None, None, None, False), ("allocation", "kmalloc", "mm/s.c", 3, None, False), ("origin", "baz", "mm/t.c", 4, None, False), ("unwind", "qux", "mm/u.c", 5, None, False),
    ]


SITES = [
    ("UBSAN: shift in f", "UBSAN: shift in fs/x.c:7:2\n f+0x1/0x2 fs/x.c:7", ("f", "fs/x.c", 7, "sanitizer explicit source location", "high")),
    ("KASAN: uaf in f", "BUG: KASAN: uaf in g fs/y.c:3\n f+0x1/0x2 fs/x.c:7", ("g", "fs/y.c", 3, "sanitizer explicit access location", "high")),
    ("WARNING in f", "WARNING: CPU: 1 at fs/w.c:9 h\n f+0x1/0x2 fs/x.c:7", ("", "fs/w.c", 9, "explicit BUG/WARNING source location", "high")),
    ("KMSAN: uninit in f", "x\n f+0x1/0x2 fs/x.c:7", ("f", "fs/x.c", 7, "sanitizer title function matched to symbolized stack", "high")),
    ("INFO: hung in f", "x\n g+0x1/0x2 fs/g.c:1\n f+0x1/0x2 fs/x.c:7", ("f", "fs/x.c", 7, "ordinary title function matched to symbolized stack", "medium")),
    ("odd", "fs/r.c:5 suspicious rcu_dereference_check() usage!", ("", "fs/r.c", 5, "explicit RCU diagnostic source location", "high")),
    ("odd", "BUG: sleeping function called at fs/b.c:6", ("", "fs/b.c", 6, "explicit BUG/WARNING source location", "high")),
    ("odd", "RIP: 0010:f+0x1/0x2 fs/x.c:7\n kasan_report+0x1/0x2 mm/k.c:1", ("f", "fs/x.c", 7, "RIP symbol matched to symbolized stack", "high")),
    ("hang in f", " g+0x1/0x2 fs/g.c:1\n f+0x1/0x2", ("f", "", None, "function only; no manifestation source line", "low")),
    ("odd", " kasan_report+0x1/0x2 mm/k.c:1\n g+0x1/0x2 fs/g.c:1", ("g", "fs/g.c", 1, "first non-runtime manifestation frame", "low")),
    ("hang in f", "nothing", ("f", "", None, "function only; no manifestation source line", "low")),
    ("odd", "nothing\nFreed by task 3:\n g+0x1/0x2 fs/g.c:1", ("", "", None, "unresolved", "low")),
]


def test_precedence_of_crash_sites(spark):
    rows = spark.createDataFrame([(k, t, r) for k, (t, r, _) in enumerate(SITES)], "bug_id long, title string, report string")
    got = {r.bug_id: (r.function or "", r.path or "", r.line, r.strategy, r.confidence) for r in stacks.crash_sites(rows).collect()}
    assert got == {k: want for k, (_, _, want) in enumerate(SITES)}


def test_columns_and_evidence_of_crash_sites(spark):
    rows = [(1, "UBSAN: x in f", "UBSAN: x in ./fs/x.c:7:2\n" + "y" * 600), (2, "odd", " g+0x1/0x2 fs/g.c:12:3 " + "z" * 600), (3, "WARNING in f", "a\n" * 121 + "WARNING: fs/late.c:3\n f+0x1/0x2 fs/x.c:9")]
    got = {r.bug_id: (r.path, r.line, r.column, len(r.evidence)) for r in stacks.crash_sites(spark.createDataFrame(rows, "bug_id long, title string, report string")).collect()}
    assert got == {1: ("fs/x.c", 7, 2, len("UBSAN: x in ./fs/x.c:7:2")), 2: ("fs/g.c", 12, 3, 500), 3: ("fs/x.c", 9, None, len("f+0x1/0x2 fs/x.c:9"))}


def test_sections_of_reports(spark):
    report = "BUG: x\nPID: 7\n a+0x1/0x2\nFreed by task 7:\n kfree+0x1/0x2\n __do_sys_b+0x1/0x2\n\nAllocated by task 3:\n kmalloc+0x1\nThe buggy address belongs to\n timer+0x1\nFreed by task 9:\n late+0x1\n"
    one = lambda c, t=report: spark.createDataFrame([(t,)], "r string").select(c).first()[0]
    parts = one(corpus.split_report(F.col("r")))
    assert (parts.main, parts.free, parts.allocation) == ("BUG: x\nPID: 7\n a+0x1/0x2", " kfree+0x1/0x2\n __do_sys_b+0x1/0x2\n", " kmalloc+0x1")
    assert tuple(one(corpus.split_report(F.col("r")), "plain")) == ("plain", "", "")
    bucket = lambda kind, t=report: one(study.temporal_bucket(F.lit(kind), F.col("r")), t)
    assert (bucket("Use-after-free (read)").bucket, bucket("Use-after-free (read)").confidence) == ("across syscalls within one session", "medium")
    assert bucket("Use-after-free", report.replace("PID: 7", "PID: 8")).bucket == "unbounded" and bucket("Use-after-free", report.replace(" a+0x1", " __do_sys_b+0x1")).bucket == "within the same syscall"
    assert bucket("Use-after-free", report.replace(" kfree", " rcu_core")).confidence == "high" and bucket("Invalid/double free", "BUG: x").bucket == "not determined"
    assert [bucket(k).bucket for k in ("NULL dereference", "Data race", "Deadlock/lock ordering", "Kernel warning")] == ["within the same syscall", "unbounded", "not applicable", "not determined"]


def test_evidence_lines_are_found_in_order(spark):
    rows = spark.createDataFrame([("b\n\n a \nnone\nb", "a\n b\na\nx\nb "), (None, "a"), ("a", None), ("", "")], "e string, r string")
    got = [None if r[0] is None else [(x.report_line, x.text) for x in r[0]] for r in rows.select(corpus.evidence_lines(F.col("e"), F.col("r"))).collect()]
    assert got[0] == [(2, " b"), (3, "a"), (5, "b ")] and all(not x for x in got[1:])


def test_repeated_frames_are_left_out(spark):
    report = " a+0x1/0x2 fs/a.c:1\n a+0x9/0x9 fs/a.c:1\n a+0x1/0x2 fs/a.c:2\n b+0x1/0x2\n b+0x2/0x3\n a+0x1/0x2 fs/a.c:2\nKASAN: x in c fs/c.c:1\n a+0x1/0x2\nd+0x1/0x2\nFreed by task 1:\n e+0x1/0x2"
    got = stacks.parsed_frames(spark.createDataFrame([(1, report), (2, None)], "bug_id long, report string")).orderBy("ordinal").collect()
    assert [(r.function, r.path, r.line) for r in got] == [("a", "fs/a.c", 1), ("a", "fs/a.c", 2), ("b", None, None), ("a", "fs/a.c", 2)]


def test_data_races_have_two_sites(spark):
    report = "BUG: KCSAN: data-race in a / b\n\nwrite to 0x1 of 8 bytes by task 1 on cpu 0:\n a+0x1/0x2 fs/a.c:1\n c+0x1/0x2 fs/c.c:2\n\nread to 0x1 of 8 bytes by task 2 on cpu 1:\n b+0x1/0x2 fs/b.c:3\n"
    rows = spark.createDataFrame([(1, "KCSAN: data-race in a / b", report), (2, "KCSAN: data-race in a / a", " a+0x1/0x2 fs/a.c:1"), (3, None, None)], "bug_id long, title string, report string")
    got = {(r.bug_id, r.role): (r.function, r.path, r.line) for r in stacks.crash_sites(rows).collect()}
    assert got == {(1, "primary"): ("a", "fs/a.c", 1), (1, "conflicting-access"): ("b", "fs/b.c", 3), (2, "primary"): ("a", None, None), (2, "conflicting-access"): ("a", None, None), (3, "primary"): (None, None, None)}


TEXT = "diff --git a/fs/x.c b/fs/x.c\n--- a/fs/x.c\n+++ b/fs/x.c\n@@ -10,4 +10,5 @@ static int foo(int a)\n one\n-two\n+deux\n three\n+quatre\n five\n"
PATCHES = {
    "text": (TEXT, [("fs/x.c", "fs/x.c", 11, 1, 11, 1, "foo", "text"), ("fs/x.c", "fs/x.c", 12, 0, 13, 1, "foo", "text")], True),
    "short": (TEXT.replace(" five\n", ""), [("fs/x.c", "fs/x.c", None, 0, None, 0, None, "unparsed")], False),
    "extra": (TEXT + "+more\n", [("fs/x.c", "fs/x.c", 11, 1, 11, 1, "foo", "text"), ("fs/x.c", "fs/x.c", 12, 0, 13, 1, "foo", "text")], False),
    "rename": ("diff --git a/a.c b/b.c\nsimilarity index 100%\nrename from a.c\nrename to b.c\n", [("a.c", "b.c", None, 0, None, 0, None, "rename")], True),
    "new": ("diff --git a/n.c b/n.c\nnew file mode 100644\n--- /dev/null\n+++ b/n.c\n@@ -0,0 +1,2 @@\n+a\n+b\n", [(None, "n.c", 0, 0, 1, 2, None, "text")], True),
    "mode": ("diff --git a/m.sh b/m.sh\nold mode 100644\nnew mode 100755\n", [("m.sh", "m.sh", None, 0, None, 0, None, "file-only")], True),
    "binary": ("diff --git a/p.bin b/p.bin\nBinary files a/p.bin and b/p.bin differ\n", [("p.bin", "p.bin", None, 0, None, 0, None, "binary")], False),
    "context": ("diff --git a/c.c b/c.c\n--- a/c.c\n+++ b/c.c\n@@ -1,3 +1,3 @@\n static int bar(void) {\n-x\n+y\n }\n", [("c.c", "c.c", 2, 1, 2, 1, "bar", "text")], True),
    "quoted": ('diff --git "a/d\\303\\251.c" "b/d\\303\\251.c"\n--- "a/d.c"\n+++ "b/d.c"\n@@ -1 +1 @@\n-x\n+y\n\\ No newline at end of file\n', [("d.c", "d.c", 1, 1, 1, 1, None, "text")], True),
    "plain": ("--- a/x.c\t2020\n+++ b/x.c\n@@ -1 +1 @@ int f(void)\n-x\n+y\n--- a/z.c\n+++ b/z.c\n@@ -2,0 +3 @@\n+y\n", [("x.c", "x.c", 1, 1, 1, 1, "f", "text"), ("z.c", "z.c", 2, 0, 3, 1, None, "text")], True),
    "removed header": ("diff --git a/x.c b/x.c\n--- a/x.c\n+++ b/x.c\n@@ -1,2 +1 @@\n--- a/no.c\n y\n", [("x.c", "x.c", 1, 1, 0, 0, None, "text")], True),
    "over": ("diff --git a/x.c b/x.c\n--- a/x.c\n+++ b/x.c\n@@ -1 +1,2 @@\n-x\n-z\n+y\n+y\n", [("x.c", "x.c", None, 0, None, 0, None, "unparsed")], False),
    "two": (TEXT + "@@ -30,2 +31,2 @@ while (x)\n int bar(int y) {\n-x\n+z\n", [("fs/x.c", "fs/x.c", 11, 1, 11, 1, "foo", "text"), ("fs/x.c", "fs/x.c", 12, 0, 13, 1, "foo", "text"), ("fs/x.c", "fs/x.c", 31, 1, 32, 1, None, "text")], True),
    "header only": ("diff --git a/x.c b/x.c\n--- a/x.c\n+++ b/x.c\n", [("x.c", "x.c", None, 0, None, 0, None, "file-only")], False),
    "torn": (TEXT + "@@ garbage\n", [("fs/x.c", "fs/x.c", 11, 1, 11, 1, "foo", "text"), ("fs/x.c", "fs/x.c", 12, 0, 13, 1, "foo", "text")], False),
    "signed": (TEXT + "-- \n2.1\n", [("fs/x.c", "fs/x.c", 11, 1, 11, 1, "foo", "text"), ("fs/x.c", "fs/x.c", 12, 0, 13, 1, "foo", "text")], True),
    "nothing": ("no diff", [(None, None, None, 0, None, 0, None, "unparsed")], False),
    "empty": (None, [(None, None, None, 0, None, 0, None, "unparsed")], False),
}


def test_patches(spark):
    df = spark.createDataFrame([(k, p) for k, (p, _, _) in PATCHES.items()], "hash string, patch string")
    got: dict = {}
    for r in diffs.changed_ranges(df).collect():
        got.setdefault(r.hash, []).append((r.old_path, r.new_path, r.old_start, r.old_count, r.new_start, r.new_count, r.function, r.kind))
    assert got == {k: rows for k, (_, rows, _) in PATCHES.items()}
    assert {r.hash: r.is_complete for r in diffs.completeness(df).collect()} == {k: c for k, (_, _, c) in PATCHES.items()}
    stat = {r.hash: (r.files, r.insertions, r.deletions) for r in diffs.diffstat(diffs.patch_files(df)).collect()}
    assert stat["text"] == (1, 2, 1) and stat["binary"] == (1, None, None) and stat["rename"] == (1, 0, 0)
    assert stat["plain"] == (2, 2, 1) and stat["over"] == (1, None, None) and stat["removed header"] == (1, 0, 1)
    hunk = diffs.hunks(df.where("hash = 'text'")).first()
    assert (hunk.functions, hunk.touched, hunk.anchors, hunk.additions, hunk.deletions, hunk.is_source) == (["foo"], [11, 12, 13], [12, 13], 2, 1, True)
    told = diffs.patch_files(df.where("hash = 'two'")).first()
    assert told.text == PATCHES["two"][0] and "".join(h.text for h in told.documents) == told.text[told.text.index("@@") :]
    assert [(h.hunk_no, h.changes, h.removed, h.added) for h in told.documents] == [(1, 2, 1, 2), (2, 1, 1, 1)]
    assert [r.documents[0].removed for r in diffs.patch_files(df.where("hash = 'short'")).collect()] == [None]


def test_globs_ranges_links_and_moments(spark):
    rows = [("net/ipv4/f.c", "net/*", True), ("net/a", "net/?", True), ("Net/a", "net/*", False), ("a]b", "a[]]b", True), ("abc", "a[!b]c", False), (None, "*", False), ("a\nb", "a*b", True), ("a.c", "a.c", True), ("axc", "a.c", False)]
    for value, glob, want in rows:
        assert spark.createDataFrame([(value,)], "v string").select(text.matches_any(F.col("v"), [glob])).first()[0] is want, (value, glob)
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(text.line_range(F.lit(a), F.lit(b))) for a, b in ((None, 0), (0, 0), (4, 0), (4, 1), (4, 3))] == ["lines unknown", "before line 1", "after line 4", "line 4", "lines 4-6"]
    assert [one(text.link_key(F.lit(x))) for x in ("/bug?extid=ab1", "/bug?id=a&id=b", "/bug", "https://h/bug?id=%2e%2e")] == ["extid-ab1", None, None, "id-.."]
    assert one(text.fix_title(F.lit(" a <b>x</b> &amp;  c\t"))) == "a x & c" and one(text.fix_title(F.lit("&lt;i&gt;&nbsp;&eacute;&#x41;"))) == "<i> éA"
    links = ("/a?b", "a?id=1", "//h/x", "http://h.example/x", "HTTPS://H.example/x", "https://h.example:1/x", "mailto:x", "https://h.example/a b")
    assert [one(text.absolute_url(F.lit(x), "https://h.example")) for x in links] == ["https://h.example/a?b", "https://h.example/a?id=1", None, None, "HTTPS://H.example/x", None, None, None]
    assert [str(one(text.moment(F.lit(x)))) for x in ("2020/02/03 04:05", "2020-02-03T04:05:00Z", "soon")] == ["2020-02-03 04:05:00", "2020-02-03 04:05:00", "None"]
    assert one(text.plain_function(F.lit("foo.isra.0.cold"))) == "foo.isra.0" and one(text.plain_path(F.lit("././a/b.c"))) == "a/b.c"


def test_components(spark):
    want = {
        "net/ipv4/tcp.c": ("net", "net/ipv4"), "drivers/net/ethernet/intel/e1000/x.c": ("net", "drivers/net/ethernet/intel"), "drivers/net/tun.c": ("net", "drivers/net/tun.c"), "fs/open.c": ("fs", "fs/vfs"), "fs/ext4/x.c": ("fs", "fs/ext4"),
        "arch/x86/kvm/mmu/x.c": ("kvm", "arch/x86/kvm/mmu"), "include/linux/skbuff.h": ("net", "net/headers"), "include/foo.h": ("include/other", "include"), "kernel/bpf/core.c": ("bpf", "bpf/bpf"), "drivers/block/loop/x.c": ("block", "block/loop"),
        "": ("unknown", "unknown"), "mm/slab.c": ("mm", "mm"), "sound/core/x.c": ("sound", "sound/core"), "drivers/usb/core/x.c": ("drivers/usb", "drivers/usb/core"), "lib/x.c": ("lib", "lib"),
    }
    got = {r.path: (r.subsystem, r.component) for r in study.placed(spark.createDataFrame([(p,) for p in want], "p string")).collect()}
    assert got == want


def test_patch_classes(spark):
    rows = [("fix race", "", "", "Synchronization/ordering", "medium"), ("tidy", "", "", "Logic/control-flow correction", "low"), ("x", "if (a)\n  return;", "", "Validation/guard", "medium"), ("kref leak", "kref_get(&a);", "", "Refcount/accounting correction", "high"), ("api", "down_write(&x);", "", "API/protocol contract", "medium"), ("tidy", "down_write(&x);", "", "Synchronization/ordering", "medium"), ("tidy", "", "race", "Synchronization/ordering", "low")]
    for title, added, removed, name, confidence in rows:
        got = spark.range(1).select(classify.patch_class(F.lit(title), F.lit(added), F.lit(removed)).alias("c")).first().c
        assert (got["class"], got["confidence"]) == (name, confidence), title
        assert got.action == classify.PATCH_ACTIONS[name]
    got = spark.range(1).select(classify.patch_class(F.lit("Check it"), F.lit("if (check)"), F.lit("")).alias("c")).first().c
    assert got.evidence == "title:check, added:check, added conditional"
    lines = F.array(F.lit("x"), F.lit(" BUG: y "), F.lit("INFO: z"))
    assert spark.range(1).select(classify.class_evidence(F.lit("t"), lines)).first()[0] == "t | BUG: y"


def test_intervals(spark):
    r = spark.createDataFrame([(0, 0), (5, 10), (10, 10)], "n long, t long")
    low, high = stats.wilson(F.col("n"), F.col("t"))
    got = [(round(a, 4), round(b, 4)) for a, b in r.select(low, high).collect()]
    assert got == [(0.0, 0.0), (0.2366, 0.7634), (0.7225, 1.0)]
    assert stats.spearman(spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 9.0), (3.0, None)], "a double, b double"), "a", "b").first().rho == pytest.approx(1.0)
    assert stats.spearman(spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "a double, b double"), "a", "b").first().rho != stats.spearman(spark.createDataFrame([(1.0, 2.0)], "a double, b double"), "a", "b").first().rho  # both NaN
