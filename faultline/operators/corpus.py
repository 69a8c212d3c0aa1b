"""The relations that queries read, and their derived columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify
from ..functions.text import let


@dataclass(frozen=True)
class Corpus:
    """One active snapshot. bugs: bug_id, position, title, repro_status; the others are keyed by bug_id or hash.

    tags (bug_id, tag), sites (bug_id, path, line, function), refs (bug_id, kind, hash, title, repo), patches (hash,
    is_valid, is_complete), ranges (hash, old_path, new_path, old_start, old_count, new_count, function, kind), reports
    (bug_id, report).
    """

    bugs: DataFrame
    tags: DataFrame
    sites: DataFrame
    refs: DataFrame
    patches: DataFrame
    ranges: DataFrame
    reports: DataFrame


def classified(bugs: DataFrame) -> DataFrame:
    """bugs plus bug_type, family and access_mode of the title.

    Each step is a projection of its own, so no expression is worked out twice.
    """
    rows = bugs.select("*", classify.bug_type(F.col("title")).alias("bug_type"), classify.family_words(F.col("title")).alias("_words"))
    rows = rows.select("*", classify.one_family(F.col("_words")).alias("family")).drop("_words")
    return rows.withColumn("access_mode", classify.access_mode(F.col("title"), F.col("family")))


def lines_of(text):
    """A text's lines, without the empty one after a last line end."""
    odd = r"\r\u000B\u000C\u001C\u001D\u001E\u0085\u2028\u2029"
    split = F.when(text.rlike(f"[{odd}]"), F.split(text, rf"\r\n|[\n{odd}]")).otherwise(F.split(text, "\n"))  # most texts have line feeds only
    return let(split, lambda lines: F.when(F.try_element_at(lines, F.lit(-1)) == "", F.slice(lines, 1, F.greatest(F.lit(0), F.size(lines) - 1))).otherwise(lines))


def report_lines(reports: DataFrame) -> DataFrame:
    """bug_id, line_no (from 1), line: a report's lines."""
    return reports.select("bug_id", F.posexplode(lines_of(F.col("report"))).alias("at", "line")).select("bug_id", (F.col("at") + 1).alias("line_no"), "line")


def heads_with(line, guards, pattern: str, low=None):
    """Does pattern occur in line? guards: lower-case texts one of which is in every line that it occurs in; they are far cheaper to look for.

    low: the line in lower case, for callers that ask several questions of a line; lambdas work out again what they do not bind.
    """
    if low is None:
        return let(F.lower(line), lambda own: heads_with(line, guards, pattern, own))
    there = F.contains(low, F.lit(guards[0]))
    for g in guards[1:]:
        there = there | F.contains(low, F.lit(g))
    return there & line.rlike(pattern)


#: Headings after which a report tells of other moments or tasks than the failing access.
HISTORY = (
    ("allocation", ("allocated",), r"(?i)Allocated by task|Page(?: last)? allocated via order"),
    ("free", ("free",), r"(?i)Freed by task|Page last free stack trace"),
    ("origin", ("uninit was", "origin:", "local variable"), r"(?i)Uninit was (?:created|stored)\b|Origin:|Local variable"),
    ("memory", ("the buggy address", "memory state", "page_owner"), r"(?i)The buggy address (?:belongs|is located)|Memory state around|page_owner tracks the page"),
    ("other", ("backtrace of", "unwind stack"), r"(?i)(?:stack backtrace|backtrace) of (?:CPU|task)|unwind stack type:"),
)


def split_report(report):
    """struct main, free, allocation: what stands before the first heading, and below the first heading of each kind up to the next of any."""
    kind = lambda x: let(F.lower(x), lambda low: F.coalesce(*(F.when(heads_with(x, guards, p, low), F.lit(name)) for name, guards, p in HISTORY)))
    found = lambda lines: F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), kind(x).alias("kind"))), lambda h: h["kind"].isNotNull())

    def parts(lines, heads):
        def below(name: str):
            placed = F.transform(heads, lambda h, i: F.struct(h["at"].alias("at"), h["kind"].alias("kind"), F.coalesce(F.get(heads, i + 1)["at"], F.size(lines)).alias("end")))
            own = F.get(F.filter(placed, lambda h: h["kind"] == name), F.lit(0))
            return F.coalesce(F.array_join(F.slice(lines, own["at"] + 2, own["end"] - own["at"] - 1), "\n"), F.lit(""))

        first = F.coalesce(F.get(heads, F.lit(0))["at"], F.size(lines))
        return F.struct(F.array_join(F.slice(lines, 1, first), "\n").alias("main"), below("free").alias("free"), below("allocation").alias("allocation"))

    return let(lines_of(report), lambda lines: let(found(lines), lambda heads: parts(lines, heads)))


def evidence_lines(evidence, report):
    """Where the lines of evidence stand in a report, each after the one before: an array of struct report_line (from 1), text. Blank lines
    and lines that are not there are left out; white space at the ends does not count."""
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    rows = F.transform(lines_of(report), lambda x, i: F.struct((i + 1).alias("report_line"), x.alias("text")))
    wanted = F.filter(F.transform(lines_of(evidence), bare), lambda x: x != "")
    none = F.expr("cast(array() as array<struct<report_line:int,text:string>>)")

    def step(found, line):
        after = F.coalesce(F.try_element_at(found, F.lit(-1))["report_line"], F.lit(0))
        next_one = F.slice(F.filter(rows, lambda r: (r["report_line"] > after) & (bare(r["text"]) == line)), 1, 1)
        return F.concat(found, next_one)

    return F.aggregate(wanted, none, step)


def classified_with_reports(bugs: DataFrame, reports: DataFrame) -> DataFrame:
    """bugs plus family and access_mode from the report's failing part first, then the title."""
    lines = lines_of(split_report(F.coalesce("report", F.lit("")))["main"])
    heads = F.transform(F.filter(lines, lambda x: x.rlike(classify.DIAGNOSTIC)), F.trim)
    out = bugs.join(reports.select("bug_id", "report"), "bug_id", "left").withColumn("_lines", lines)
    out = out.withColumn("family", classify.family(F.col("title"), heads))
    return out.withColumn("access_mode", classify.access_mode(F.col("title"), F.col("family"), F.col("_lines"))).drop("_lines", "report")


def is_markup(text):
    """Does the text start as HTML, behind a byte order mark or white space?"""
    return F.coalesce(F.lower(F.substring(text, 1, 4096)).rlike(r"^[﻿\s]*<(!doctype|html|head|body|\?xml|!--)"), F.lit(False))


#: The elements that an error page may begin with.
LEADING = r"(?:<!doctype\s+html\b|<(?:html|head|body|title|meta|link|script|style|div|span|main|section|article|header|footer|nav|form|table|pre|p|a|ul|ol|li|iframe|h[1-6])\b)"


def is_audit_markup(text):
    """Is the text a page, by its first element? A byte order mark, one XML declaration and comments before it are passed over; 16 KiB count."""
    start = F.regexp_replace(F.coalesce(text, F.lit("")), "^[\\s\ufeff]+", "")
    return F.lower(F.substring(start, 1, 16_384)).rlike(r"^(?s:<\?xml\b.*?\?>\s*)?(?s:<!--.*?-->\s*)*" + LEADING)


def valid_report(text):
    return F.coalesce((F.trim(text) != "") & ~is_markup(text), F.lit(False))


def valid_patch(text):
    return F.coalesce((F.octet_length(text) > 40) & ~is_markup(text) & F.contains(text, F.lit("diff --git")), F.lit(False))


def valid_listing(text):
    low = F.lower(text)
    return F.coalesce(is_markup(text) & F.contains(low, F.lit("<html")) & F.contains(low, F.lit("</html>")), F.lit(False))


def report_error(text):
    """Why a payload is no report; null if it is one."""
    return F.when(text.isNull(), "missing").when(F.trim(text) == "", "empty").when(is_markup(text), "markup")
