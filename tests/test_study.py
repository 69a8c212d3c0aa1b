"""The study's operators where many bugs share patches: what they answer, and what they must not shuffle or broadcast."""

import random

from pyspark.sql import functions as F

from faultline.operators import study
from faultline.plans import study as plans

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_distance_to_the_nearest_fixed_frame(spark):
    rng = random.Random(3)
    names = ["a", "b", "c", "d", None, ""]
    frames = [(bug, k, rng.choice(names[:5]), rng.choice(["x", "y", None]), rng.randrange(4)) for bug in range(30) if bug % 7 for k in range(rng.randrange(1, 5))]
    sites = [(bug, rng.choice(["x", None]), rng.randrange(4), rng.choice(names)) for bug in range(30)]
    links = [(bug, patch) for bug in range(30) for patch in rng.sample(range(6), rng.randrange(3))]
    functions = sorted({(patch, rng.choice(["b", "c", "z", None, ""])) for patch in range(6) for _ in range(2)}, key=str)
    want = {}
    for bug, path, line, crashed in sites:
        fixed = {f for p, f in functions if f and (bug, p) in links}
        own = [f for f in frames if f[0] == bug]
        here = [f[1] for f in own if (f[2] is not None and f[2] == crashed) or (f[3] is not None and f[3] == path and abs(f[4] - line) <= 1)]
        anchor = min(here or [f[1] for f in own], default=None)
        near = [abs(f[1] - anchor) for f in own if f[2] in fixed]
        want[bug] = None if not fixed else "0" if crashed in fixed else None if anchor is None else str(min(near)) if near else "inf"
    made = study.stack_distance(
        spark.createDataFrame(frames, "bug_id long, idx int, function string, path string, line long"), spark.createDataFrame(sites, "bug_id long, path string, line long, function string"),
        spark.createDataFrame(links, "bug_id long, patch long"), spark.createDataFrame(functions, "patch long, function string"), "patch",
    )
    assert {r.bug_id: r.distance for r in made.collect()} == want
    assert {None, "0", "inf"} < set(want.values())


def test_reports_are_classified_where_they_stand(spark):
    plan = _plan(plans._studied(spark, SF))
    assert "Join" not in plan and "hashpartitioning" not in plan


def test_pairs_meet_their_ranges_last(spark):
    """No exchange but the aggregation's lies above the join of bugs with the ranges of their patches, and no side of a bug's size is broadcast."""
    plan = _plan(study.per_bug(plans.pairs(spark, SF)).select("bug_id", F.col("hunks"), "lowest")).splitlines()
    joins = [k for k, line in enumerate(plan) if "SortMergeJoin" in line]
    assert "patch" in plan[joins[0]].split("SortMergeJoin")[1][:20]
    assert sum("Exchange hashpartitioning" in line for line in plan[: joins[0]]) == 1
