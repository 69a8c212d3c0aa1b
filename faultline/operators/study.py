"""The crash-to-fix distance study: cohort, grades, tables and examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify, stats
from ..functions.text import let
from . import corpus, stacks


def cohort(bugs: DataFrame) -> DataFrame:
    """bugs (has_catalog, has_report, n_hashes, n_patches) plus included and exclusion_reason, reasons joined by '; '."""
    reasons = F.array(
        F.when(~F.col("has_catalog"), "not in catalog"), F.when(~F.col("has_report"), "no report"),
        F.when(F.col("n_hashes") == 0, "no fix commit with hash"), F.when((F.col("n_hashes") > 0) & (F.col("n_patches") == 0), "no patch available"),
    )
    reason = F.concat_ws("; ", reasons)
    return bugs.select("*", (reason == "").alias("included"), reason.alias("exclusion_reason"))


def source_first(hunks: DataFrame) -> DataFrame:
    """Source hunks of a bug if it has any, else all of its hunks."""
    any_source = F.max("is_source").over(Window.partitionBy("bug_id"))
    return hunks.withColumn("_any", any_source).where("is_source or not _any").drop("_any")


def placed(paths: DataFrame) -> DataFrame:
    """path, subsystem, component of the distinct paths of a one-column DataFrame.

    Paths repeat far more often than they differ, so the rules run once a path; each step is a projection of its own.
    """
    own = paths.toDF("path").where("path is not null").distinct().withColumn("subsystem", classify.subsystem(F.col("path")))
    return own.withColumn("component", classify.component(F.col("path"), F.col("subsystem")))


def graded(sites: DataFrame, links: DataFrame, hunks: DataFrame, key: str = "hash") -> DataFrame:
    """The hunks of each bug's patches next to its crash site, with subsystems and grade.

    sites: bug_id, crash_path, crash_line, crash_function. links: bug_id, key, each once. hunks: key, fix_path, touched, functions and more. Sites and
    hunks are placed by their own paths. Links meet the sites first and the hunks last, so that what is made of each hunk of each bug goes through no
    shuffle but that of an aggregation; the hints keep Spark from broadcasting a side whose size it has only guessed.
    """
    places = lambda df, c, name: df.join(placed(df.select(c)).select(F.col("path").alias(c), F.struct("path", "subsystem", "component").alias(name)), c, "left")
    met = links.join(places(sites, "crash_path", "_crash").hint("merge"), "bug_id").join(places(hunks, "fix_path", "_fix").hint("merge"), key)
    grade = classify.grade(F.col("_crash"), F.col("_fix"), F.col("crash_line"), F.col("crash_function"), F.col("touched"), F.col("functions"))
    return met.select("*", grade.alias("grade"), F.col("_crash.subsystem").alias("crash_subsystem"), F.col("_fix.subsystem").alias("fix_subsystem"), F.col("_fix.component").alias("fix_component")).drop("_crash", "_fix")


def per_bug(hunks: DataFrame) -> DataFrame:
    """bug_id, hunks, lowest, highest: grades over a bug's hunks, nulls left out."""
    return hunks.groupBy("bug_id").agg(F.count("*").alias("hunks"), F.min("grade").alias("lowest"), F.max("grade").alias("highest"))


def count_maps(rows: DataFrame, single: tuple[str, ...], crossed: tuple[tuple[str, str], ...]) -> DataFrame:
    """dimension, value, other, n: all count maps and cross tables of rows by one GROUPING SETS pass."""
    names = list(dict.fromkeys([*single, *(c for pair in crossed for c in pair)]))
    sets = [[n] for n in single] + [list(pair) for pair in crossed]
    out = rows.groupingSets([[F.col(n) for n in s] for s in sets], *names).agg(F.count("*").alias("n"), F.grouping_id(*names).alias("g"))
    bit = {n: 1 << (len(names) - 1 - k) for k, n in enumerate(names)}
    code = {sum(bit[n] for n in names if n not in s): s for s in sets}
    text = lambda n: F.col(n).cast("string")
    pick = lambda f: F.coalesce(*(F.when(F.col("g") == k, f(s)) for k, s in code.items()))
    return out.select(pick(lambda s: F.lit(" x ".join(s))).alias("dimension"), pick(lambda s: text(s[0])).alias("value"), pick(lambda s: text(s[1]) if len(s) > 1 else F.lit(None)).alias("other"), "n")


def shares(rows: DataFrame, by: str, test) -> DataFrame:
    """by, n, hits, share, low, high: how many rows of each group meet test, with the 95 % Wilson interval."""
    out = rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if(test).alias("hits"))
    low, high = stats.wilson(F.col("hits"), F.col("n"))
    return out.select(by, "n", "hits", stats.ratio(F.col("hits"), F.col("n")).alias("share"), low.alias("low"), high.alias("high"))


def odds(rows: DataFrame, exposed, event) -> DataFrame:
    """One row: the 2 x 2 table of two conditions, its odds ratio and 95 % interval."""
    one = rows.agg(*(F.count_if(t).alias(n) for n, t in (("a", exposed & event), ("b", exposed & ~event), ("c", ~exposed & event), ("d", ~exposed & ~event))))
    ratio, low, high = stats.odds_ratio(*(F.col(x) for x in "abcd"))
    return one.select("*", ratio.alias("odds_ratio"), low.alias("low"), high.alias("high"))


def quartiles(rows: DataFrame, by: str, column: str) -> DataFrame:
    """by, n, q1, median, q3, mean of the known values; quartiles interpolate between values."""
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = rows.where(F.col(column).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), q.alias("q"), F.avg(column).alias("mean"))
    return out.select(by, "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "mean")


def first_of_each(rows: DataFrame, by: str, order: list, k: int = 1) -> DataFrame:
    """The first k rows of each group; the group limit runs before the shuffle."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def diverse(rows: DataFrame, by: str, order: list, k: int = 20) -> DataFrame:
    """k rows: first the first of each group, then second ones and so on, each round in order."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("_n", rank).where(F.col("_n") <= k).orderBy(F.col("_n") > 1, *order).limit(k).drop("_n")


def before_and_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """metric, before, after, difference of two (metric, value) tables; what one side lacks counts as zero in the difference."""
    b, a = before.select("metric", F.col("value").alias("before")), after.select("metric", F.col("value").alias("after"))
    return b.join(a, "metric", "full").withColumn("difference", F.coalesce("after", F.lit(0)) - F.coalesce("before", F.lit(0)))


#: Fixed value: so many names are broadcast at most.
NAMES = 65_536


def named(rows: DataFrame, names: DataFrame) -> DataFrame:
    """rows (function and more) plus fixable: is the function one of names (function, distinct)? Names are counted before they are broadcast."""
    names = names.withColumn("fixable", F.lit(True))
    few = names.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("function")), F.lit(0)).alias("size")).first()
    names = F.broadcast(names) if few["n"] <= NAMES and few["size"] <= 64 * NAMES else names.hint("merge")
    return rows.join(names, "function", "left").withColumn("fixable", F.coalesce("fixable", F.lit(False)))


def stack_distance(frames: DataFrame, sites: DataFrame, links: DataFrame, functions: DataFrame, key: str = "hash") -> DataFrame:
    """bug_id, distance: frames between the crash and the nearest fixed function on the failing stack.

    0 if the crashing function is fixed; null if a side is unknown; infinity ('inf') if no fixed function is on the stack.
    frames: bug_id, idx, function, path, line. sites: bug_id, path, line, function. links: bug_id, key, each once. functions: key, function, each once.
    A bug takes its few frames that any patch could change, nearest first, along to the functions of its patches; the functions of a bug are never listed.
    """
    functions = functions.where("coalesce(function, '') <> ''")
    f = frames.join(sites.select("bug_id", F.col("path").alias("cp"), F.col("line").alias("cl"), F.col("function").alias("cf")).hint("merge"), "bug_id")
    here = (F.col("function") == F.col("cf")) | ((F.col("path") == F.col("cp")) & (F.abs(F.col("line") - F.col("cl")) <= 1))
    f = named(f.withColumn("here", F.coalesce(here, F.lit(False))).select("bug_id", "idx", "function", "here"), functions.select("function").distinct())
    anchor = f.groupBy("bug_id").agg(F.coalesce(F.min(F.when(F.col("here"), F.col("idx"))), F.min("idx")).alias("anchor"), F.collect_list(F.when(F.col("fixable"), F.struct("idx", "function"))).alias("named"))
    near = F.sort_array(F.transform("named", lambda x: F.struct(F.abs(x["idx"] - F.col("anchor")).alias("d"), x["function"].alias("function"))))
    near = anchor.select("bug_id", F.col("anchor").isNotNull().alias("stacked"), near.alias("near"))
    told = links.join(sites.select("bug_id", F.col("function").alias("crashed")).hint("merge"), "bug_id").join(near.hint("merge"), "bug_id", "left").select("bug_id", key, "crashed", "stacked", F.col("near.function").alias("named"), F.col("near.d").alias("far"))
    place = F.array_position("named", F.col("function")).cast("int")
    d = F.when(F.col("function") == F.col("crashed"), -1).when(place > 0, F.get("far", place - 1))
    best = told.join(functions.hint("merge"), key).groupBy("bug_id").agg(F.lit(True).alias("known"), F.min(d).alias("d"), F.max("stacked").alias("stacked"))
    out = sites.select("bug_id").distinct().join(best.hint("merge"), "bug_id", "left")
    value = F.when(F.col("known").isNull(), None).when(F.col("d") == -1, "0").when(F.col("stacked").isNull(), None).when(F.col("d").isNull(), "inf").otherwise(F.col("d").cast("string"))
    return out.select("bug_id", value.alias("distance"))


#: What says that a report's accesses happen in asynchronous work, and what begins a system call's function.
ASYNCHRONOUS = ("workqueue", "process_one_work", "rcu_core", "call_rcu", "timer", "tasklet", "softirq", "irq/")
SYSCALL = r"(?:__do_sys_|__se_sys_|\bdo_sys_|\bsys_)"


def temporal_bucket(study_class, report):
    """struct bucket, confidence, reason: when memory was broken, relative to where it shows; one of five buckets.

    Only the failing part of the report and the section on who freed the memory count.
    """
    low = F.lower(study_class)
    calls = lambda text: F.filter(F.transform(stacks.stack(corpus.lines_of(text)), lambda f: f["function"]), lambda f: f.rlike(SYSCALL))
    told = lambda bucket, confidence, reason: F.struct(F.lit(bucket).alias("bucket"), F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason"))

    def of_free(parts, now, then):
        main, freed, known, work = parts["main"], parts["free"], (now != "") & (then != ""), F.lower(F.concat(parts["main"], parts["free"]))
        return (
            F.when((known & (now != then)) | work.rlike("|".join(ASYNCHRONOUS)), told("unbounded", "high", "Free/access occur in different tasks or asynchronous contexts"))
            .when(freed == "", told("not determined", "low", "UAF report has no usable free-stack anchor"))
            .when(F.arrays_overlap(calls(main), calls(freed)), told("within the same syscall", "medium", "Free and manifestation stacks share a syscall frame"))
            .when(known, told("across syscalls within one session", "medium", "Free/access share a task but not a syscall frame"))
            .otherwise(told("unbounded", "medium", "A distinct free stack precedes the later invalid access"))
        )

    freed = let(corpus.split_report(report), lambda parts: of_free(parts, F.regexp_extract(parts["main"], r"\bPID:\s*(\d+)", 1), F.regexp_extract(report, r"Freed by task\s+(\d+)", 1)))
    has = lambda *needles: low.rlike("|".join(needles))
    return (
        F.when(has("use-after-free", "double free"), freed)
        .when(has("out-of-bounds", "null dereference", "arithmetic/type ub", "uninitialized"), told("within the same syscall", "medium", "Detector fires at the invalid operation/consumption site"))
        .when(has("data race"), told("unbounded", "medium", "Conflicting accesses may occur in independently scheduled contexts"))
        .when(has("deadlock", "hang", "lockup"), told("not applicable", "medium", "No corruption-to-manifestation interval is defined for this liveness/locking failure"))
        .otherwise(told("not determined", "low", "Report lacks an allocation/free/origin anchor suitable for Δt"))
    )


def quality(site_path, site_confidence, grade, hunks, fixes, detector, functions):
    """struct flags, review: what a study row should be looked at for, flags joined by '; '."""
    flags = F.array_compact(F.array(
        F.when((site_confidence == "low") | (F.coalesce(site_path, F.lit("")) == ""), "CS needs manual review"), F.when(grade.isNull(), "distance unresolved"),
        F.when(grade.isin(4, 5), "D4/D5 uses path-based MAINTAINERS proxy"), F.when(hunks > 1, "multi-hunk maximum applied"), F.when(fixes > 1, "multiple fix commits"),
        F.when(F.contains(detector, F.lit("KCSAN")), "dual conflicting access sites"), F.when(F.coalesce(F.size(functions), F.lit(0)) == 0, "FS function unresolved"),
    ))
    looked = F.exists(flags, lambda x: x.rlike("CS needs|distance unresolved|FS function unresolved"))
    return F.struct(F.array_join(flags, "; ").alias("flags"), F.when(looked, "Manual review recommended").otherwise("Automated classification").alias("review"))


def annotation(grade, stack, bucket):
    """D?/S=?/Δt=? of a study row."""
    return F.concat(F.coalesce(F.concat(F.lit("D"), grade), F.lit("Unresolved")), F.lit("/S="), F.coalesce(stack, F.lit("unknown")), F.lit("/Δt="), bucket)


def far_shares(rows: DataFrame, by: str) -> DataFrame:
    """by, bugs, resolved, far, local, far_share, low, high, off_stack, known_stack, off_share, unbounded, days: one table for any grouping.

    rows: by, highest (grade), stack (S; null: unknown, 'inf': off the stack), bucket and days. Shares are of what is known.
    """
    known = F.col("stack").isNotNull()
    out = rows.groupBy(by).agg(
        F.count("*").alias("bugs"), F.count("highest").alias("resolved"), F.count_if(F.col("highest") >= 3).alias("far"), F.count_if(F.col("highest") <= 1).alias("local"),
        F.count_if(F.col("stack") == "0").alias("on_site"), F.count_if(known & ~F.col("stack").isin("0", "inf")).alias("on_stack"), F.count_if(F.col("stack") == "inf").alias("off_stack"), F.count_if(known).alias("known_stack"),
        F.count_if(F.col("bucket") == "unbounded").alias("unbounded"), F.median("days").alias("days"),
    )
    low, high = stats.wilson(F.col("far"), F.col("resolved"))
    return out.select("*", stats.ratio(F.col("far"), F.col("resolved")).alias("far_share"), low.alias("low"), high.alias("high"), stats.ratio(F.col("off_stack"), F.col("known_stack")).alias("off_share"))


def farthest(hunks: DataFrame, order: str) -> DataFrame:
    """bug_id, lowest, highest, and the hunk (its order) that is the first with the highest grade."""
    per = hunks.where("grade is not null").groupBy("bug_id").agg(F.min("grade").alias("lowest"), F.max(F.struct(F.col("grade"), (-F.col(order)).alias("o"))).alias("top"))
    return per.select("bug_id", "lowest", F.col("top.grade").alias("highest"), (-F.col("top.o")).alias("farthest"))


def study_rows(rows: DataFrame) -> DataFrame:
    """The study's rows as they are published: rows (facts of a bug, its crash site as cs_*, its fixes as fix_*, its patch's class as a struct patch,
    temporal as a struct, stack, highest, lowest, hunks) plus places and labels, quality flags and the annotation."""
    named = F.when(F.col("cs_path").isNotNull(), F.concat_ws(":", "cs_path", "cs_line"))
    label = F.when(F.col("highest").isNull(), "Unresolved").otherwise(F.concat(F.lit("D"), F.col("highest"), F.lit(" "), F.get(F.array(*map(F.lit, classify.GRADES)), F.col("highest"))))
    q = quality(F.col("cs_path"), F.col("cs_confidence"), F.col("highest"), F.col("hunks"), F.size("fix_hashes"), F.col("detector"), F.col("fix_functions"))
    rows = rows.withColumns({"_q": q, "cs_subsystem": classify.subsystem(F.col("cs_path"))})
    rows = rows.withColumns({"cs_component": classify.component(F.col("cs_path"), F.col("cs_subsystem")), "cs_location": named, "distance_label": label, "fix_commit_count": F.size("fix_hashes").cast("long")})
    rows = rows.withColumns({f"{c}": F.array_join(F.col(c), "; ") for c in ("fix_hashes", "fix_paths", "fix_functions")})
    more = {"patch_type": "patch.class", "patch_action": "patch.action", "patch_class_confidence": "patch.confidence", "patch_class_evidence": "patch.evidence", "temporal_distance": "temporal.bucket", "temporal_confidence": "temporal.confidence", "temporal_reason": "temporal.reason", "review_status": "_q.review", "qc_flags": "_q.flags"}
    rows = rows.withColumns({k: F.col(v) for k, v in more.items()})
    note = annotation(F.col("highest"), F.col("stack"), F.col("temporal_distance"))
    rows = rows.withColumns({"full_annotation": note, "distance_rule": F.lit("maximum across all source hunks/available fix commits"), "data_flow_hops_T": F.lit("not analyzed (taint analysis required)")})
    return rows.drop("patch", "temporal", "_q").withColumnsRenamed({"highest": "distance", "lowest": "distance_min", "stack": "stack_distance", "family": "bug_family", "class": "bug_type", "access": "access_mode", "hunks": "fix_hunk_count"})
