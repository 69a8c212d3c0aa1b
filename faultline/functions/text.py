"""Column expressions over titles, paths, links and coordinates; all run inside the JVM."""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def let(value, body) -> Column:
    """body(value), with value worked out once: Catalyst would copy it to each place that body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_fold(c) -> Column:
    """A-Z to a-z and nothing else, as SQLite's NOCASE compares."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def squeezed(c) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


@F.arrow_udf(T.StringType())
def _unescaped(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else html.unescape(t) for t in texts.to_pylist()], pa.string())


def fix_title(c) -> Column:
    """A commit subject without tags, with HTML entities decoded and white space squeezed. Entities need their table, so this is Arrow."""
    return squeezed(_unescaped(F.regexp_replace(c, "<[^>]*>", "")))


def plain_function(c) -> Column:
    """A symbol without the suffixes that compilers add to clones."""
    out = F.trim(c)
    for suffix in (r"\.(constprop|isra|part)\.\d+$", r"\.(cold|llvm)\.\d+$", r"\.(cold|hot)$"):
        out = F.regexp_replace(out, suffix, "")
    return out


def plain_path(c) -> Column:
    return F.regexp_replace(F.trim(c), r"^(\./)+", "")


def title_functions(title) -> Column:
    """Functions that a title names: both sides of a data race, else each symbol after in or at."""
    t = F.regexp_replace(F.trim(title), r"\s+\(\d+\)$", "")
    race = r"data-race in ([A-Za-z_][\w.]*)\s*/\s*([A-Za-z_][\w.]*)"
    both = F.array(F.regexp_extract(t, race, 1), F.regexp_extract(t, race, 2))
    named = F.regexp_extract_all(t, F.lit(r"\b(?:in|at)\s+([A-Za-z_][A-Za-z0-9_.]*)(?![\w./])"), F.lit(1))
    return F.transform(F.when(t.rlike(race), both).otherwise(named), plain_function)


#: First letters and whole names of functions that only report or instrument.
RUNTIME_PREFIXES = (
    "kasan_", "__kasan", "kmsan_", "__kmsan", "ubsan_", "__ubsan", "__asan", "asan_", "kfence_", "__kfence", "kcsan_", "__kcsan",
    "dump_stack", "panic", "report_bug", "handle_bug", "exc_", "asm_exc_", "warn_slowpath", "__warn", "lockdep_", "check_", "print_",
    "show_", "die", "oops_", "instrument_", "__sanitizer", "arch_static_branch", "trace_",
)
RUNTIME_NAMES = (
    "__dump_stack", "dump_stack_lvl", "do_error_trap", "do_trap", "__die_body", "make_task_dead", "__might_resched", "lock_acquire",
    "lock_release", "__lock_acquire", "kmem_cache_alloc", "kfree", "__kmalloc", "__slab_free", "slab_free_freelist_hook",
)


def is_runtime(function) -> Column:
    starts = "^(" + "|".join(map(re.escape, RUNTIME_PREFIXES)) + ")"
    return (F.coalesce(function, F.lit("")) == "") | function.rlike(starts) | function.isin(*RUNTIME_NAMES)


def glob_regex(pattern: str) -> str:
    """An anchored Java regex for a case-sensitive glob in which * also crosses slashes."""
    out, i = "", 0
    while i < len(pattern):
        c, i = pattern[i], i + 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := pattern.find("]", i + 1 + pattern[i : i + 1].count("!"))) > 0:
            body, i = pattern[i:end], end + 1
            negated = body.startswith("!")
            body = re.sub(r"([\\\[\]&^~])", r"\\\1", body[negated:])
            out += f"[{'^' * negated}{body}]"
        else:
            out += re.escape(c)
    return f"(?s)^{out}$"


def matches_any(c, patterns) -> Column:
    """Does any glob match? Null matches none."""
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(glob_regex(p))
    return F.coalesce(out & c.isNotNull(), F.lit(False))


#: What a key may look like, and how long a commit hash is.
KEY = r"^[A-Za-z0-9][A-Za-z0-9._-]*$"
HASH = r"^[0-9a-fA-F]{7,128}$"
FULL_HASH = r"^[0-9a-fA-F]{40}$"


def is_key(c) -> Column:
    return F.coalesce(c.rlike(KEY) & (F.length(c) <= 128), F.lit(False))


def link_key(link) -> Column:
    """``extid-X`` or ``id-X`` of a link with exactly one such parameter; null for any other link."""
    query = F.regexp_extract(link, r"\?([^#]*)", 1)
    own = F.filter(F.split(query, "&"), lambda p: p.rlike(r"^(extid|id)=."))
    value = F.try_url_decode(F.regexp_extract(F.get(own, F.lit(0)), r"=(.*)$", 1))
    key = F.concat(F.regexp_extract(F.get(own, F.lit(0)), r"^(\w+)=", 1), F.lit("-"), value)
    return F.when((F.size(own) == 1) & is_key(key), key)


def absolute_url(link, base: str) -> Column:
    """link on the site of base (scheme://host): a path becomes a whole URL; null for other sites, other schemes and white space."""
    own = origin(link)
    whole = F.when(link.rlike(r"^/(?!/)[^\s]*$"), F.concat(F.lit(base.rstrip("/")), link)).when(link.rlike(r"^[^/?#:\s][^?#:\s]*(?:[?#]\S*)?$"), F.concat(F.lit(base.rstrip("/") + "/"), link))
    return F.coalesce(whole, F.when((own == origin(F.lit(base))) & ~link.rlike(r"\s"), link))


def origin(url) -> Column:
    """scheme://host[:port], lower-cased; null for anything but http and https, and with user names in it."""
    got = r"^([hH][tT][tT][pP][sS]?)://([^/?#@\s]+)"
    after = F.regexp_extract(url, got + r"(?:[/?#]|$)", 2)
    return F.when(after != "", ascii_fold(F.concat(F.regexp_extract(url, got, 1), F.lit("://"), after)))


def coordinate(path, line, column) -> Column:
    """path:line:column as far as known."""
    return F.concat(F.coalesce(path, F.lit("unknown file")), F.coalesce(F.concat(F.lit(":"), line), F.lit("")), F.coalesce(F.when(line.isNotNull(), F.concat(F.lit(":"), column)), F.lit("")))


def line_range(start, count) -> Column:
    """How a changed range reads: an inclusive range, the line it follows, or that it is unknown."""
    return (
        F.when(start.isNull(), F.lit("lines unknown"))
        .when((count == 0) & (start == 0), F.lit("before line 1"))
        .when(count == 0, F.concat(F.lit("after line "), start))
        .when(count == 1, F.concat(F.lit("line "), start))
        .otherwise(F.concat(F.lit("lines "), start, F.lit("-"), start + count - 1))
    )


def moment(text) -> Column:
    """A timestamp of ``YYYY/MM/DD HH:MM`` or ISO-8601 text; null for anything else."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy/MM/dd HH:mm")), F.try_to_timestamp(text))
