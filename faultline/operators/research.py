"""Related cases, comparison and statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import corpus, fixes

#: Kinds of evidence in the order that ranks, strongest first.
EVIDENCE = ("same-fix-commit", "same-crash-function", "same-fix-file", "same-crash-file")
RELATIONS = ("unknown", "different-file", "same-file", "same-function")


def _evidence(c: corpus.Corpus, bug_id: int | None = None) -> DataFrame:
    """evidence() before it is made distinct; of one bug, if that is given: its rows are picked before any join."""
    own = lambda df: df if bug_id is None else df.where(F.col("bug_id") == bug_id)
    commits = own(c.refs).where("hash is not null").select("bug_id", F.lit(EVIDENCE[0]).alias("kind"), F.col("hash").alias("value"))
    sites = own(c.sites).select("bug_id", F.explode_outer(F.array_compact(F.array(*(F.when(F.col(v).isNotNull(), F.struct(F.lit(k).alias("kind"), F.col(v).alias("value"))) for k, v in ((EVIDENCE[1], "function"), (EVIDENCE[3], "path")))))).alias("e"))
    sites = sites.where("e is not null").select("bug_id", "e.*")
    # files are made distinct by patch before they meet the bugs that refer to it
    by_hash = c.ranges.select("hash", F.explode_outer(F.array_compact(F.array("old_path", "new_path"))).alias("value")).where("value is not null").distinct()
    refs = own(c.refs).where("hash is not null").select("bug_id", "hash").distinct()
    files = refs.join(by_hash.join(c.patches.where("is_valid").select("hash"), "hash", "left_semi"), "hash").select("bug_id", F.lit(EVIDENCE[2]).alias("kind"), "value")
    return reduce(DataFrame.unionByName, (commits, sites, files))


def evidence(c: corpus.Corpus) -> DataFrame:
    """bug_id, kind, value: what can tie a bug to another, each once."""
    return _evidence(c).distinct()


def related(c: corpus.Corpus, bug_id: int, limit: int = 10) -> DataFrame:
    """The bugs that share evidence with one bug, best first: bug_id, kinds, shared values.

    The target's values are few (those of one bug) and are broadcast to the evidence of all, which is made distinct only where it
    meets them; nothing is compared pair by pair.
    """
    every = _evidence(c)
    own = F.broadcast(_evidence(c, bug_id).select("kind", "value").distinct())
    met = every.where(F.col("bug_id") != bug_id).join(own, ["kind", "value"]).distinct()
    per = met.groupBy("bug_id").agg(F.collect_set("kind").alias("k"), F.array_sort(F.collect_set(F.concat_ws("=", "kind", "value"))).alias("shared"))
    flags = [F.array_contains("k", kind).cast("int").desc() for kind in EVIDENCE]
    kinds = F.filter(F.array(*map(F.lit, EVIDENCE)), lambda x: F.array_contains("k", x))
    return per.orderBy(*flags, "bug_id").limit(limit).select("bug_id", kinds.alias("kinds"), "shared")


#: What a case shows.
CASE = ("bug_id", "title", "bug_type", "family", "access_mode", "tags", "repro_status", "fix_file_count", "patch_line_count", "sites", "fixes", "has_report")


def cases(documents: DataFrame) -> DataFrame:
    """The columns of detail documents that related and compared cases show."""
    return documents.select(*CASE)


def compare(c: corpus.Corpus, a: int, b: int) -> DataFrame:
    """field, left, right, same: the five fields in which two bugs can differ."""
    tags = c.tags.where(F.col("bug_id").isin(a, b)).groupBy("bug_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("subsystems"))
    rows = corpus.classified(c.bugs.where(F.col("bug_id").isin(a, b))).join(tags, "bug_id", "left")
    named = ("bug_type", "family", "access_mode", "subsystems", "repro_status")
    long = rows.select("bug_id", F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.coalesce(n, F.lit("")).alias("value")) for n in named))).alias("f")).select("bug_id", "f.*")
    side = lambda k, name: F.max(F.when(F.col("bug_id") == k, F.col("value"))).alias(name)
    out = long.groupBy("field").agg(side(a, "left"), side(b, "right"))
    return out.withColumn("same", F.col("left") == F.col("right"))


def shared_evidence(c: corpus.Corpus, a: int, b: int) -> DataFrame:
    """kind, value that two bugs have in common."""
    own = evidence(c).where(F.col("bug_id").isin(a, b))
    return own.groupBy("kind", "value").agg(F.count_distinct("bug_id").alias("n")).where("n = 2").drop("n")


def totals(c: corpus.Corpus) -> DataFrame:
    """One row: bugs, distinct commits, bug-commit links, bugs without a hash."""
    links = c.refs.where("hash is not null").select("bug_id", "hash").distinct()
    per = c.bugs.select("bug_id").join(links.groupBy("bug_id").agg(F.count("*").alias("n")), "bug_id", "left")
    one = per.agg(F.count("*").alias("bugs"), F.coalesce(F.sum("n"), F.lit(0)).alias("links"), F.count_if(F.col("n").isNull()).alias("without_hash"))
    return one.crossJoin(links.agg(F.count_distinct("hash").alias("commits")))  # one row each


def distributions(c: corpus.Corpus) -> DataFrame:
    """dimension, value, bugs: a bug counts once for each value; all dimensions in one aggregation.

    A fix file goes by its new path, or its old one if it is deleted. What ranges say is made distinct by patch before it meets the bugs.
    """
    rows = corpus.classified(c.bugs)
    pair = lambda name, c: F.when(c.isNotNull(), F.struct(F.lit(name).alias("dimension"), c.alias("value")))
    several = lambda df, key, *pairs: df.select(key, F.explode_outer(F.array_compact(F.array(*pairs))).alias("d")).where("d is not null").select(key, "d.*")
    flat = several(rows, "bug_id", *(pair(n, F.col(n)) for n in ("bug_type", "family", "access_mode")))
    sites = several(c.sites, "bug_id", pair("crash_function", F.col("function")))
    by_hash = several(c.ranges, "hash", pair("fix_function", F.col("function")), pair("fix_file", F.coalesce("new_path", "old_path"))).distinct()
    refs = c.refs.where("hash is not null").select("bug_id", "hash").distinct()
    fixed = refs.join(by_hash.join(c.patches.where("is_valid").select("hash"), "hash", "left_semi"), "hash").select("bug_id", "dimension", "value").distinct()
    tags = c.tags.select("bug_id", F.lit("subsystem").alias("dimension"), F.lower("tag").alias("value")).distinct()
    closest = relationships(c).select("bug_id", F.lit("relationship").alias("dimension"), F.col("relationship").alias("value"))
    return reduce(DataFrame.unionByName, (flat, sites, tags, fixed, closest)).groupBy("dimension", "value").agg(F.count("*").alias("bugs"))


def ranked(rows: DataFrame, top: int | None = None) -> DataFrame:
    """distributions() in the order they are shown: per dimension the most bugs first, then by value; the first ``top`` of each if given."""
    place = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("bugs"), "value"))
    out = rows.withColumn("place", place)
    return out if top is None else out.where(F.col("place") <= top)


def numeric_summary(rows: DataFrame, column: str) -> DataFrame:
    """One row: known, unknown, smallest, largest, exact median."""
    c = F.col(column)
    return rows.agg(F.count(c).alias("known"), F.count_if(c.isNull()).alias("unknown"), F.min(c).alias("smallest"), F.max(c).alias("largest"), F.median(c).alias("median"))


def pair_relation(crash_path, crash_function, old_path, new_path, fix_function):
    """Relation of one crash site and one changed range, as a rank in RELATIONS."""
    file = F.coalesce((old_path == crash_path) | (new_path == crash_path), (old_path == crash_path), (new_path == crash_path), F.lit(False))
    return (
        F.when(crash_path.isNull() | (old_path.isNull() & new_path.isNull()), 0)
        .when(file & F.coalesce(crash_function == fix_function, F.lit(False)), 3)
        .when(file, 2)
        .otherwise(1)
    )


def closest(c: corpus.Corpus) -> DataFrame:
    """bug_id, best, worst: ranks in RELATIONS over all pairs of a bug's sites and ranges; bugs meet their sites first and the ranges of their patches last."""
    by_hash = c.ranges.select("hash", "old_path", "new_path", F.col("function").alias("fix_function")).distinct().join(c.patches.where("is_valid").select("hash"), "hash", "left_semi")
    pairs = fixes.links(c.refs).join(c.sites.select("bug_id", "path", "function").hint("merge"), "bug_id").join(by_hash.hint("merge"), "hash")
    rank = pair_relation(F.col("path"), F.col("function"), F.col("old_path"), F.col("new_path"), F.col("fix_function"))
    return pairs.select("bug_id", rank.alias("r")).groupBy("bug_id").agg(F.max("r").alias("best"), F.min("r").alias("worst"))


def relation_name(known):
    """The relationship that best and worst of closest() stand for. known: is the patches' size known?"""
    return F.when(F.col("best") >= 2, F.get(F.array(*map(F.lit, RELATIONS)), F.col("best"))).when((F.col("best") == 1) & (F.col("worst") == 1) & known, RELATIONS[1]).otherwise(RELATIONS[0])


def relationships(c: corpus.Corpus) -> DataFrame:
    """bug_id, relationship: the closest over all pairs of a bug's sites and ranges.

    A different file is only said if the patches' size is known and every pair differs; otherwise what is not close is unknown.
    """
    size = fixes.patch_metrics(c.bugs, c.refs, c.patches, c.ranges).select("bug_id", F.col("patch_line_count").isNotNull().alias("known"))
    return size.join(closest(c), "bug_id", "left").select("bug_id", relation_name(F.col("known")).alias("relationship"))


def availability(c: corpus.Corpus) -> DataFrame:
    """One row: bugs with a valid report or without, with an available patch or without, without a tag, and of each reproducer status."""
    m = fixes.patch_metrics(c.bugs, c.refs, c.patches, c.ranges).select("bug_id", "has_patch")
    valid = c.reports.where(corpus.valid_report(F.col("report"))).select("bug_id", F.lit(1).alias("r"))
    tagged = c.tags.select("bug_id", F.lit(1).alias("t")).distinct()
    rows = c.bugs.select("bug_id", "repro_status").join(m, "bug_id").join(valid, "bug_id", "left").join(tagged, "bug_id", "left")
    repro = (F.count_if(F.col("repro_status") == s).alias(f"repro_{s}") for s in ("available", "not_provided", "unknown"))
    return rows.agg(F.count("r").alias("with_report"), F.count_if(F.col("r").isNull()).alias("without_report"), F.count_if("has_patch").alias("with_patch"), F.count_if(~F.col("has_patch")).alias("without_patch"), F.count_if(F.col("t").isNull()).alias("untagged"), *repro)
