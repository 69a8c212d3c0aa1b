"""Benchmark decontamination, with DataFrame functions only.

Method. Texts are words: A-Z lower-cased, maximal runs of ASCII digits and letters and all non-ASCII characters. Every
run of ``n`` consecutive words of a benchmark item is a window; an item of fewer words, but not none, is one window.
The distinct windows, hashed, are the broadcast set. One pass over the documents hashes all their windows, looks each up, and
verifies a hit word by word, so a collision of hashes finds nothing. What is hit is then gathered per document.

A broadcast holds at most ``most`` windows and about ``MOST_BYTES``. A larger benchmark is first cut down to the windows whose hash
occurs in the documents (hashes alone are shuffled for this, each once a task), and what is left is looked up in as many passes as
it takes, a share of the windows in each. A document's words never go through a shuffle.

Each document row also emits one sentinel entry, so documents without hits come out of the same pass, and
repeated rows are counted and come out as often as they went in. A row is known by its id and 128 bits of hashes of its text.

Defined results: a null text has no words. Documents and items without words hit nothing. An item without an id
still marks words, but is neither counted nor listed. Items of one id count once. Ids may be of any type.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, extent, free, sized, staged

#: Windows, and bytes of them, that one broadcast holds.
MOST, MOST_BYTES = 200_000, 64 << 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _hash(w, at, k: int):
    """Hash of the k words from the zero-based place at; taken element by element, as slice() copies slowly."""
    return F.xxhash64(*(F.get(w, at + i) for i in range(k)))


def _hash_from(k: int):
    return lambda x: _hash(F.col("w"), x, k)


def windows_of(items: DataFrame, n: int) -> DataFrame:
    """(item_id, hash, length, words): the windows of each item."""
    w = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    w = w.select("item_id", "w", F.least(F.lit(n), F.size("w")).alias("length"))
    w = w.select("item_id", "length", F.explode(F.transform(F.sequence(F.lit(1), F.expr("size(w) - length + 1")), lambda k: F.slice(F.col("w"), k, F.col("length")))).alias("words"))
    hashed = F.lit(None).cast("long")
    for k in range(1, n + 1):
        hashed = F.when(F.col("length") == k, _hash(F.col("words"), F.lit(0), k)).otherwise(hashed)
    return w.select("item_id", hashed.alias("hash"), "length", "words").distinct()


#: What knows a row of documents.
KEY = ("doc_id", "h1", "h2")


def _keyed(text="text"):
    return F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), F.col(text)).alias("h2")


def _hashed(docs: DataFrame, lengths: list[int]):
    """(rows of KEY, w and h; start and length of the window at place p of h). Place 0 of h is the sentinel."""
    hashes, at, length = [F.array(F.lit(0).cast("long"))], F.col("p"), F.lit(0)
    count = lambda k: F.greatest(F.lit(0), F.size("w") - (k - 1))
    for i, k in enumerate(lengths):
        places = F.when(F.size("w") >= k, F.sequence(F.lit(0), F.size("w") - k)).otherwise(F.array().cast("array<int>"))
        hashes.append(F.transform(places, _hash_from(k)))
        before = sum((count(j) for j in lengths[:i]), F.lit(0))
        length = F.when((F.col("p") > before) & (F.col("p") <= before + count(k)), F.lit(k)).otherwise(length)
        at = F.when(F.col("p") > before, F.col("p") - before).otherwise(at)
    split = docs.select("doc_id", *_keyed(), words(F.col("text")).alias("w"))
    return split.select(*KEY, "w", (F.concat(*hashes) if lengths else hashes[0]).alias("h")), at, length


def _shares(rows: DataFrame, windows: DataFrame, most: int) -> list[DataFrame]:
    """The windows in parts that can be broadcast; only those that can be in rows if they are many."""
    n, size = extent(windows)
    if n > 2 * most or size > 2 * MOST_BYTES:
        there = rows.select(F.explode_outer("h").alias("hash")).distinct()
        windows = staged(windows.join(there, "hash", "left_semi"), "windows-met")
        n, size = extent(windows)
    parts = max(1, -(-n // most), -(-size // MOST_BYTES))
    return [windows.where(F.pmod("hash", F.lit(parts)) == k) if parts > 1 else windows for k in range(parts)]


def marks(docs: DataFrame, benchmark: DataFrame, n: int = 10, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(marked, owners). marked has a row for each distinct row of docs: KEY, n_words, copies, hits (sorted structs s, e, window:
    words from s to before e are hit); owners: window and item_id."""
    placed = staged(windows_of(benchmark, n), "placed")
    windows = staged(placed.select("hash", "length", "words").distinct().withColumn("window", F.monotonically_increasing_id()), "windows")
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # n values at most
    rows, at, length = _hashed(docs, lengths)
    entries = rows.select(*KEY, "w", F.posexplode_outer("h").alias("p", "hash"))  # outer: no filter on h, which would be worked out twice
    sentinel = windows.sparkSession.range(1).selectExpr("0L as hash", "0 as length", "cast(array() as array<string>) as words", "-1L as window")

    def looked_up(part: DataFrame, first: bool) -> DataFrame:
        table = F.broadcast((part.unionByName(sentinel) if first else part).select("hash", "words", "window", F.col("length").alias("is_window")))
        met = entries if first else entries.where("p > 0")
        met = met.join(table, "hash").where(F.when(F.col("p") == 0, F.col("is_window") == 0).otherwise((F.col("is_window") > 0) & (F.slice(F.col("w"), at, length) == F.col("words"))))
        return met.select(*KEY, F.size("w").cast("long").alias("n_words"), "p", at.alias("s"), (at + length).alias("e"), "window")

    found = reduce(DataFrame.unionByName, [looked_up(part, k == 0) for k, part in enumerate(_shares(rows, windows, most))])
    real = F.col("p") > 0
    marked = found.groupBy(*KEY, "n_words").agg(
        F.sum(F.when(real, 0).otherwise(1)).cast("int").alias("copies"),
        F.sort_array(F.collect_set(F.when(real, F.struct("s", "e", "window")))).alias("hits"),
    )
    same = lambda a, b: (a["hash"] == b["hash"]) & (a["length"] == b["length"]) & (a["words"] == b["words"])
    small = sized(windows)
    return marked, placed.where("item_id is not null").join(small, same(placed, small)).select("window", "item_id")


def report(docs: DataFrame, benchmark: DataFrame, n: int = 10, most: int = MOST) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    m, owners = marks(docs, benchmark, n, most)
    m = staged(m, "marked")
    met = m.where(F.size("hits") > 0).select(*KEY, F.explode(F.array_distinct(F.col("hits.window"))).alias("window"))
    owners = owners.join(sized(staged(met.select("window").distinct(), "met")), "window", "left_semi")
    named = met.join(sized(staged(owners, "owners")), "window").groupBy(*KEY).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    named = sized(staged(named, "named")).select(*(F.col(c).alias(f"_{c}") for c in KEY), "items")
    m = m.join(named, m["doc_id"].eqNullSafe(F.col("_doc_id")) & (m["h1"] == F.col("_h1")) & (m["h2"] == F.col("_h2")), "left")
    hit = F.expr("aggregate(hits, struct(0 as e, 0L as t), (a, x) -> struct(greatest(a.e, x.e) as e, a.t + greatest(0, x.e - greatest(a.e, x.s)) as t), a -> a.t)")
    items = F.coalesce("items", F.array().cast("array<string>"))
    m = m.select("doc_id", "n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return m.withColumn("contaminated", F.col("n_hit") > 0).drop("copy")


def _joined(docs: DataFrame, marked: DataFrame, how: str) -> DataFrame:
    """docs joined by row with marked (KEY and more), whose columns of KEY get free names."""
    own = {c: free(f"_{c}", docs.columns) for c in KEY}
    side = sized(staged(marked, "contaminated")).withColumnsRenamed(own)
    h1, h2 = F.xxhash64(docs["text"]), F.xxhash64(F.lit(1), docs["text"])
    out = docs.join(side, docs["doc_id"].eqNullSafe(side[own["doc_id"]]) & (h1 == side[own["h1"]]) & (h2 == side[own["h2"]]), how)
    return out if how == "left_anti" else out.drop(*own.values())


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 10, most: int = MOST) -> DataFrame:
    """docs without the rows that hold a window of the benchmark; all columns stay."""
    return _joined(docs, marks(docs, benchmark, n, most)[0].where(F.size("hits") > 0).select(*KEY), "left_anti")


def cut(docs: DataFrame, benchmark: DataFrame, n: int = 10, most: int = MOST) -> DataFrame:
    """doc_id and text of every row of docs, hit words removed and the words around a cut joined by one space.

    Texts without hits come back as they are; those with hits as their normalised words.
    """
    both = _joined(docs.select("doc_id", "text"), marks(docs, benchmark, n, most)[0].where(F.size("hits") > 0).select(*KEY, "hits"), "left")
    left = F.expr("filter(w, (x, i) -> not exists(hits, h -> i + 1 >= h.s and i + 1 < h.e))")
    both = both.withColumn("w", F.when(F.col("hits").isNotNull(), words(F.col("text"))))
    return both.select("doc_id", F.when(F.col("hits").isNull(), F.col("text")).otherwise(F.concat_ws(" ", left)).alias("text"))
