"""SimHash near-duplicates: fingerprints, pigeonring candidates, components.

Method. A fingerprint is 64 bits; two of them link at ``MOST`` = 4 or fewer differing bits. The bits form a ring of
five segments. If the differences b_0..b_4 of the segments sum to 4 or less, then some start i has, for every length l,
b_i + .. + b_(i+l-1) <= 4l/5, so the chain's budgets are 0, 1, 2, 3, 4. Chains of three are indexed: segment i is
equal, and with the next two cut in halves, either both halves of segment i+1 are equal or one half of each is.
That makes five masks a start, 25 in all, of 26 bits or so each; two fingerprints that link agree under one of them at
least. Within a bucket the budgets of two, three and four segments prune pairs, in that order, before the full Hamming check.

Equal fingerprints are collapsed before anything else, so copies cost nothing. A bucket sends out a spanning forest of
its links, never its pairs. Buckets of more than ``BUCKET`` fingerprints are cut into blocks, and each pair of blocks
becomes a group of its own, so no task has to hold or compare a whole hot bucket.

Similarity. ``keep_similar_first`` asks for texts whose five-word shingles are alike by ``LEAST`` = 0.8 instead. Such a pair differs in
about 0.15 of its SimHash bits at most (10 of 64, more than 16 at times), so 64 bits leave no chain of equal ones to look up. Its fingerprint is
therefore longer: ``RING`` = 160 segments of 16 SimHash bits of the set of shingles. A chain of five segments makes a candidate if the first is equal
and the five differ in ``CHAIN_MOST`` = 16 bits at most; chains begin at every segment. A pair at 0.8 has one with probability
1 - (1 - 0.848**16 * 0.987)**160 = 0.99999. The budget of the whole ring, ``RING_MOST`` = 640 bits or four a segment, prunes candidates before the sets
of shingles themselves are compared, which decides. Below four shingles only equal sets are alike by 0.8. Sets of four and five, whose ties
make up to 0.19 of the bits differ, have ``SHORT_RINGS`` = 3 rings. Chains are looked up in two rounds. The first ``EARLY`` starts also give families: texts that met and whose rings
differ in ``FAMILY_MOST`` = 700 bits at most (alike by about 0.49) are of one. All members of a family are compared with each other once, in large blocks. In the second round,
over all starts, members of a family are not entries for each other any more: a large group of texts that are too far from each other to connect
would meet at nearly every start, and each time again in every two blocks.
Entries of a start travel as packed arrays, each with the four segments after it, so a chance meeting of 16 bits goes no further than the task that sees it.

Defined results: a null text, an empty one and one of white space have no words, fingerprint zero, and link like
any other; by similarity, texts without words are copies of each other. Rows without an id have a fingerprint and a component, but
never name a component unless no row of it has an id. Repeated rows are kept, each with its component; the operators that
keep one row of a component keep one of them. Sets of shingles are known by 64-bit hashes.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import connected_components, free, give_back, give_back_driver, roots_of, sized, slices, staged, with_sums

MOST = 4
LEAST, SHINGLE = 0.8, 5
RING, CHAIN_MOST, RING_MOST, FAMILY_MOST = 160, 16, 640, 700
SHORT, SHORT_RINGS = 5, 3
EARLY = 16
BUCKET = 8_192
#: Rows of a batch that holds texts or sets of shingles.
TEXTS = 500
_SEGMENTS = 5
_CHUNK = 1 << 16
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _span(lo: int, hi: int) -> int:
    return ((1 << (hi - lo)) - 1) << lo


def _ring() -> tuple[list[int], list[tuple[int, int, int]]]:
    """(masks, for each mask those of its start's chains of two, three and four segments)."""
    edge = [round(64 * k / _SEGMENTS) for k in range(_SEGMENTS + 1)]
    whole = [_span(edge[k], edge[k + 1]) for k in range(_SEGMENTS)]
    half = [(_span(edge[k], (edge[k] + edge[k + 1]) // 2), _span((edge[k] + edge[k + 1]) // 2, edge[k + 1])) for k in range(_SEGMENTS)]
    masks, chains = [], []
    for i in range(_SEGMENTS):
        after = [whole[(i + k) % _SEGMENTS] for k in range(4)]
        (a, b), (c, d) = half[(i + 1) % _SEGMENTS], half[(i + 2) % _SEGMENTS]
        masks += [whole[i] | x for x in (a | b, a | c, a | d, b | c, b | d)]
        chains += [tuple(sum(after[:k]) for k in (2, 3, 4))] * 5
    return masks, chains


MASKS, CHAINS = _ring()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """SimHash of the word shingles of the whole text, unsigned."""
    low = (text or b"").lower()
    starts, ends = [], []
    for m in _WORD.finditer(low):
        starts.append(m.start())
        ends.append(m.end())
    if not starts:
        return 0
    joined = b" ".join(low.split())
    at = np.cumsum([0, *(e - s + 1 for s, e in zip(starts, ends, strict=True))])
    first = at[: max(1, len(starts) - shingle + 1)].tolist()
    last = (at[min(shingle, len(starts)) :] - 1).tolist()
    ones, n, digest = np.zeros(64, np.int64), len(first), xxhash.xxh64_intdigest
    for k in range(0, n, _CHUNK):
        h = np.array([digest(joined[s:e], 42) for s, e in zip(first[k : k + _CHUNK], last[k : k + _CHUNK], strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, keep, shingle: int = 4) -> DataFrame:
    """The columns ``keep`` of docs, then the fingerprint as a signed long, in a column fp (or _fp, .. if that is taken)."""
    head = docs.select(*keep)
    names = head.columns
    own = free("fp", names)

    def run(batches):
        for batch in batches:
            for b in slices(batch, len(names)):
                fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(len(names))], np.uint64)
                yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(fps.view(np.int64))], names=[*names, own])
        give_back()

    out = T.StructType([*head.schema.fields, T.StructField(own, T.LongType())])
    return docs.select(*keep, F.col("text").cast("binary").alias(free("_text", names))).mapInArrow(run, out)


def within(x: np.ndarray, chains: np.ndarray) -> np.ndarray:
    """Are the differences x within the budgets of the chains of two, three and four segments, and of the whole ring?"""
    near = np.bitwise_count(x & chains[..., 0]) < 2
    for k, most in ((1, 2), (2, 3)):
        near[near] = np.bitwise_count(x[near] & (chains[near, k] if chains.ndim > 1 else chains[k])) <= most
    near[near] = np.bitwise_count(x[near]) <= MOST
    return near


def _forest(group: np.ndarray, fp: np.ndarray, chains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (fp, fp) that span the components inside each run of equal groups; runs are contiguous.

    chains: for each row the masks of its start's chains.
    """
    n = len(fp)
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    end_of = np.repeat(np.r_[start[1:], n], np.diff(np.r_[start, n]))
    live, root, shift = np.arange(n), np.arange(n), 0
    while True:
        shift += 1
        live = live[live + shift < end_of[live]]
        if not len(live):
            break
        a, b = live, live + shift
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
        near = within(fp[a] ^ fp[b], chains[a])
        if near.any():
            root = _merged(root, a[near], b[near])
    own = np.flatnonzero(root != np.arange(n))
    return fp[own], fp[root[own]]


def _merged(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """root after the links a-b; only the roots concerned are looked at."""
    ra, rb = root[a], root[b]
    names, at = np.unique(np.concatenate([ra, rb]), return_inverse=True)
    new = roots_of(len(names), at[: len(ra)], at[len(ra) :])
    to = root.copy()
    hit = np.isin(root, names)
    to[hit] = names[new[np.searchsorted(names, root[hit])]]
    return to


def _links_of_buckets(batches):
    """Rows (mask, bucket, block_a, block_b, fp) sorted by all but fp; links of each bucket's forest."""
    chains = np.array(CHAINS, np.uint64)
    held: list[pa.RecordBatch] = []

    def out(rows: pa.Table):
        cols = [rows.column(k).to_numpy() for k in range(5)]
        change = np.zeros(len(cols[0]), bool)
        for c in cols[:4]:
            change[1:] |= c[1:] != c[:-1]
        u, v = _forest(np.cumsum(change), cols[4].view(np.uint64), chains[cols[0]])
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < 100_000:
            continue
        rows = pa.Table.from_batches(held)
        last = [rows.column(k)[size - 1].as_py() for k in range(4)]
        same = np.logical_and.reduce([rows.column(k).to_numpy() == last[k] for k in range(4)])
        cut = int(size - same.sum())  # sorted: the last group's rows are at the end
        if cut:
            yield out(rows.slice(0, cut))
        held, size = rows.slice(cut).to_batches(), size - cut
    if size:
        yield out(pa.Table.from_batches(held))
    give_back()


def fingerprint_links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(u, v): links between distinct fingerprints that connect all that are within MOST bits of each other.

    fps: one column of distinct fingerprints.
    """
    entries = F.explode(F.array(*(F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bucket")) for k, m in enumerate(MASKS))))
    rows = fps.select("fp", entries.alias("e")).select("e.mask", "e.bucket", "fp")
    full = rows.groupBy("mask", "bucket").count().where(F.col("count") > bucket)
    full = full.select("mask", "bucket", F.ceil(F.col("count") / bucket).cast("int").alias("blocks"))
    rows = rows.join(sized(staged(full, "hot-buckets")), ["mask", "bucket"], "left")
    own = F.expr("cast(pmod(xxhash64(fp), blocks) as int)")
    place = F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(own, k).alias("a"), F.greatest(own, k).alias("b")))
    )
    dealt = rows.select("mask", "bucket", F.explode(place).alias("p"), "fp").select("mask", "bucket", "p.a", "p.b", "fp")
    key = ["mask", "bucket", "a", "b"]
    return dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(_links_of_buckets, "u long, v long")


def components(marked: DataFrame, doc_id: str = "doc_id", links: DataFrame | None = None) -> DataFrame:
    """marked plus component (a fingerprint of it) and component_id (the smallest id reachable by links).

    marked: rows with doc_id and fp. links: forests of links between fps, by default those within MOST bits. Two components can share a component_id only if rows of both have that id.
    """
    of_fp = staged(marked.groupBy("fp").agg(F.min(doc_id).alias("_least"), F.count("*").alias("n")), "fingerprints")
    total, fps = (x or 0 for x in of_fp.agg(F.sum("n"), F.count("*")).first())
    comps = connected_components(fingerprint_links(of_fp.select("fp")) if links is None else links, contracted=True)
    placed = of_fp.join(comps.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "_least", "n", F.coalesce("component", "fp").alias("component"))
    placed = staged(placed, "placed")
    names = placed.groupBy("component").agg(F.min("_least").alias("component_id"), F.count("*").alias("n"))
    changed = with_sums(placed.drop("_least").withColumnRenamed("n", "_n"), names, ["component"], fps)
    return with_sums(marked, staged(changed.select("fp", "component", "component_id", F.col("_n").alias("n")), "named"), ["fp"], total)


def near_duplicates(docs: DataFrame, keep=("doc_id",), shingle: int = 4) -> DataFrame:
    """The columns ``keep`` (with doc_id) of docs, then fingerprint (16 hex digits) and component_id.

    Kept columns named like those two are left out.
    """
    made = fingerprints(docs, keep, shingle)
    head = made.columns[:-1]
    mine = [f"c{k}" for k in range(len(head))]
    at = next(k for k, c in enumerate(head) if c.lower() == "doc_id")
    out = components(staged(made.toDF(*mine, "fp"), "marked", TEXTS), mine[at])
    kept = [F.col(m).alias(c) for m, c in zip(mine, head, strict=True) if c.lower() not in ("fingerprint", "component_id")]
    return out.select(*kept, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """docs with one row of each component: the smallest id, and of rows that repeat it the first by text hash.

    Whole columns do not go through the search. The rows to drop, by id and text hash, are taken out by one join;
    rows that repeat both are collapsed apart from the others.
    """
    found = components(staged(fingerprints(docs.select("doc_id", "text"), ["doc_id", F.xxhash64("text").alias("_hash")], shingle), "marked", TEXTS))
    return _firsts(docs, found)


def _firsts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with the first row of each component; found: doc_id, _hash (the text's) and component of every row."""
    rows = staged(found.select("doc_id", "_hash", "component"), "placed-rows")
    sizes = staged(rows.groupBy("component", "doc_id", "_hash").count(), "sizes")
    # the smallest id with the smallest hash, rows without an id last; numbers only, so they are summed up in place
    by_id = sizes.groupBy("component").agg(F.min("doc_id").alias("_first"), F.count("*").alias("n"))
    total = sizes.count()
    judged = with_sums(sizes, by_id, ["component"], total).where(F.col("doc_id").eqNullSafe(F.col("_first"))).select("component", "doc_id", "_hash")
    chosen = judged.groupBy("component", "doc_id").agg(F.min("_hash").alias("_hash")).select("component", F.col("doc_id").alias("_first"), F.col("_hash").alias("_first_hash"))
    chosen = chosen.join(sizes.groupBy("component").agg(F.count("*").alias("n")), "component")
    judged = staged(with_sums(sizes, chosen, ["component"], total).select("doc_id", "_hash", (F.col("doc_id").eqNullSafe(F.col("_first")) & (F.col("_hash") == F.col("_first_hash"))).alias("stays"), "count"), "judged")
    a, b = free("_id", docs.columns), free("_hash", docs.columns)
    same = lambda side: docs["doc_id"].eqNullSafe(side[a]) & (F.xxhash64(docs["text"]) == side[b])
    named = lambda cond: sized(judged.where(cond).select(F.col("doc_id").alias(a), F.col("_hash").alias(b)))
    gone = named("not stays or count > 1")
    kept = docs.join(gone, same(gone), "left_anti")
    if not judged.where("stays and count > 1").limit(1).count():
        return kept
    # rows that repeat id and text: the first by a hash of all that can be hashed, so that a second run keeps the same one
    again = named("stays and count > 1")
    whole = F.struct(*(docs[c] for c in docs.columns))
    keyed = docs.join(again, same(again), "left_semi").select(whole.alias("row"), F.xxhash64(*(docs[f.name] for f in docs.schema.fields if not isinstance(f.dataType, T.MapType | T.VariantType))).alias("by"))
    one = keyed.groupBy(F.col("row.doc_id").alias("id"), F.xxhash64("row.text").alias("hash")).agg(F.min_by("row", "by").alias("row"))
    return kept.unionByName(one.select("row.*"))


# --- similarity of shingle sets

_WORDS = RING // 4
_rng = np.random.default_rng(7)
_XOR, _ODD = (_rng.integers(0, 1 << 63, SHORT_RINGS * _WORDS, np.uint64, endpoint=True) * np.uint64(2) + np.uint64(1) for _ in range(2))
_MIX, _HALF = np.uint64(0x9E3779B97F4A7C15), np.uint64(32)
_SETS = 256
#: Members of a family's block, and the bytes of their sets, about.
_FAMILY, _FAMILY_BYTES = 2_048, 16 << 20
#: Entries of a start that are looked up at once, rows of which a packed array is made, and the run from which on entries are compared one by one.
_RANGE, _PACK, _RUN = 400_000, 500, 1_024


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles; of a shorter text all its words are one."""
    words = _WORD.findall((text or b"").lower())
    if not words:
        return np.zeros(0, np.uint64)
    joined, at = b" ".join(words), np.cumsum([0, *map(len, words)])
    at += np.arange(len(at))
    first, last = at[: max(1, len(words) - SHINGLE + 1)].tolist(), (at[min(SHINGLE, len(words)) :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e], 42) for s, e in zip(first, last, strict=True)), np.uint64, len(first)))


def ring_of(own: np.ndarray, rings: int = 1) -> np.ndarray:
    """The SimHash bits of a set, 64 a word and ``RING`` segments a ring: each is 1 if it is set in over half the members' hashes."""
    ones, width = np.zeros(64 * rings * _WORDS, np.int64), rings * _WORDS
    for k in range(0, len(own), 255):
        h = (own[k : k + 255, None] ^ _XOR[:width]) * _ODD[:width]
        h ^= h >> _HALF
        h *= _MIX
        h ^= h >> _HALF
        ones += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(own), bitorder="little").view(np.uint64)


def _ringed(batches):
    """Rows (doc_id, text hash, text) become (doc_id, text hash, fp of the set, ring, size of the set); sets that are like none but their equals have no ring."""
    for batch in batches:
        for b in slices(batch, 2):
            fps, rings, sizes = np.zeros(b.num_rows, np.uint64), [], []
            for k, text in enumerate(b.column(2)):
                own = shingles(text.as_py())
                if len(own):
                    fps[k] = xxhash.xxh64_intdigest(own.tobytes())
                sizes.append(len(own))
                rings.append(ring_of(own, SHORT_RINGS if len(own) <= SHORT else 1).tobytes() if len(own) >= LEAST / (1 - LEAST) - 1e-9 else b"")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64)), pa.array(rings, pa.binary()), pa.array(sizes, pa.int32())], names=["doc_id", "_hash", "fp", "ring", "size"])
    give_back()


def _packed(rows: pa.Table, starts: int, parts: int):
    """Rows (fp, c, ring) as (start, part, key, after, fp, apart): arrays of the entries of a start whose 16 bits are in one of ``parts`` ranges."""
    fp, c = (rows.column(k).to_numpy() for k in (0, 1))
    raw, size = rows.column(2).to_pylist(), 8 * _WORDS
    lengths = np.array([len(x) for x in raw])
    ends = -(-np.arange(1, parts) * (1 << 16) // parts)
    for r in range(int(lengths.max()) // size):
        has = np.flatnonzero(lengths > r * size)
        ring = np.frombuffer(b"".join(raw[k][r * size : (r + 1) * size] for k in has), np.uint16).reshape(len(has), RING)
        around, own, apart = np.concatenate([ring, ring[:, :4]], axis=1), fp[has], fp[has] ^ c[has]
        for first in range(0, starts, 16):
            out = []
            for i in range(first, min(first + 16, starts)):
                order = np.argsort(around[:, i], kind="stable")
                key, after = around[order, i], np.ascontiguousarray(around[order, i + 1 : i + 5])
                for part, (lo, hi) in enumerate(itertools.pairwise([0, *np.searchsorted(key, ends).tolist(), len(key)])):
                    if hi > lo:
                        out.append((r * RING + i, part, key[lo:hi].tobytes(), after[lo:hi].tobytes(), own[order[lo:hi]].tobytes(), apart[order[lo:hi]].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int32(), pa.int32(), *[pa.binary()] * 4))], names=["start", "part", "key", "after", "fp", "apart"])


def _entries(starts: int, parts: int):
    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= _PACK * min(parts, 64):
                yield from _packed(pa.Table.from_batches(held), starts, parts)
                held, n = [], 0
        if n:
            yield from _packed(pa.Table.from_batches(held), starts, parts)
        give_back()

    return run


def _met_in_run(after: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which entries of one bucket have a partner that is not connected to them and within the chain's budget.

    Each entry outside of the largest component has its turn; one that has met a partner by then only looks for the largest component's entries
    that have not.
    """
    own = np.unique(c, return_inverse=True)[1]
    major = np.bincount(own).argmax()
    met, every, left = np.zeros(len(c), bool), np.arange(len(c)), np.flatnonzero(own == major)
    for u in np.flatnonzero(own != major):
        among = left if met[u] else every
        hit = among[(np.bitwise_count(after[among] ^ after[u]) <= CHAIN_MOST) & (own[among] != own[u])]
        if len(hit):
            met[hit] = met[u] = True
            left = left[~met[left]]
    return met


def _met_in_runs(key: np.ndarray, after: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The same for every run of equal keys."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[start, len(key)])
    met, end_of = np.zeros(len(key), bool), np.repeat(start + sizes, sizes)
    for lo, n in zip(start[sizes > _RUN].tolist(), sizes[sizes > _RUN].tolist(), strict=True):
        met[lo : lo + n] = _met_in_run(after[lo : lo + n], c[lo : lo + n])
    live, shift = np.flatnonzero(np.repeat(sizes <= _RUN, sizes)), 0
    while len(live):
        shift += 1
        live = live[live + shift < end_of[live]]
        near = live[np.bitwise_count(after[live] ^ after[live + shift]) <= CHAIN_MOST]
        near = near[c[near] != c[near + shift]]
        met[near] = met[near + shift] = True
    return met


def _chained(batches):
    """Rows of _packed sorted by start and part become (key, fp, f): entries with a partner within the chain's budget, key by start and its 16 bits."""
    now, held = None, []

    def out():
        key, after, fp, apart = (np.concatenate([np.frombuffer(x[k], kind) for x in held]) for k, kind in enumerate((np.uint16, np.uint64, np.int64, np.int64)))
        order = np.argsort(key, kind="stable")
        key, after, fp = key[order], after[order], fp[order]
        c = fp ^ apart[order]
        met = np.flatnonzero(_met_in_runs(key, after, c))
        return pa.RecordBatch.from_arrays([pa.array((now[0] << 16) + key[met].astype(np.int64)), pa.array(fp[met]), pa.array(c[met])], names=["key", "fp", "f"])

    for batch in batches:
        for start, part, *arrays in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            if (start, part) != now:
                if held:
                    yield out()
                now, held = (start, part), []
            held.append(arrays)
    if held:
        yield out()
    give_back()


def _sets(batches):
    """Rows (fp, c, f, ring, text) become (fp, c, f, ring, own: the shingles)."""
    for batch in batches:
        for b in slices(batch, 4):
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([shingles(t.as_py()).tobytes() for t in b.column(4)], pa.binary())], names=["fp", "c", "f", "ring", "own"])
    give_back()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the similarity of two sorted sets is LEAST or more."""
    if min(len(a), len(b)) < LEAST * max(len(a), len(b)):
        return False
    x = np.concatenate([a, b])
    x.sort(kind="stable")
    both = int((x[1:] == x[:-1]).sum())
    return both >= LEAST * (len(a) + len(b) - both)


def _similar_to(sets: list[np.ndarray]):
    """A function of row a and some rows after it: which of these sets are similar to a's, as similar() says."""
    ends = np.cumsum([len(x) for x in sets])
    names = []

    def of(a: int, rows: np.ndarray) -> np.ndarray:
        if len(rows) < 16 or 8 * len(rows) < len(sets) - a:
            return np.array([similar(sets[a], sets[b]) for b in rows], bool)
        if not names:  # the shingles by number
            names.append(np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32))
            names.append(np.zeros(names[0].max(initial=0) + 1, bool))
        own, lo = names[0][ends[a] - len(sets[a]) : ends[a]], int(rows[0])
        names[1][own] = True
        sums = np.r_[0, np.cumsum(names[1][names[0][ends[lo] - len(sets[lo]) : ends[rows[-1]]]])]
        names[1][own] = False
        to, sizes = ends[rows] - (ends[lo] - len(sets[lo])), np.array([len(sets[b]) for b in rows])
        both = sums[to] - sums[to - sizes]
        return both >= LEAST * (len(sets[a]) + sizes - both)

    return of


def _apart_within(labels: list[np.ndarray], ring: np.ndarray, a: int, most: int = RING_MOST) -> np.ndarray:
    """The rows after row a that share none of the labels with it and are within ``most`` bits of the ring."""
    rest = a + 1 + np.flatnonzero(np.logical_and.reduce([x[a + 1 :] != x[a] for x in labels]))
    return rest[np.bitwise_count(ring[rest] ^ ring[a]).sum(axis=1, dtype=np.int64) <= most]


def _groups(batches, columns: int):
    """The rows of each run of equal (key, a, b), column by column."""
    now, held = None, []
    for batch in batches:
        cols = [batch.column(k).to_pylist() for k in range(columns)]
        for row in zip(*cols, strict=True):
            if row[:3] != now:
                if len(held) > 1:
                    yield now, list(zip(*held, strict=True))
                now, held = row[:3], []
            held.append(row[3:])
    if len(held) > 1:
        yield now, list(zip(*held, strict=True))


def _rings(raw) -> np.ndarray:
    """The first ring of each."""
    return np.frombuffer(b"".join(x[: 8 * _WORDS] for x in raw), np.uint64).reshape(len(raw), _WORDS)


def _pruned(most: int):
    """Rows (key, a, b, fp, f, ring), sorted by the first three; those that have a partner within ``most`` bits, and in ``near`` the fp that names all in the group that partners connect."""

    def run(batches):
        for group, (fps, f, ring) in _groups(batches, 6):
            f, ring, pairs = np.unique(np.array(f), return_inverse=True)[1], _rings(ring), []
            if f.any():
                for a in range(len(fps) - 1):
                    if len(near := _apart_within([f], ring, a, most)):
                        pairs.append((np.full(len(near), a), near))
            if not pairs:
                continue
            u, v = (np.concatenate(x) for x in zip(*pairs, strict=True))
            root, own = roots_of(len(fps), u, v), np.unique(np.concatenate([u, v]))
            names = (pa.array([x] * len(own), kind) for x, kind in zip(group, (pa.int64(), pa.int32(), pa.int32()), strict=True))
            yield pa.RecordBatch.from_arrays([*names, *(pa.array([fps[k] for k in rows], pa.int64()) for rows in (own, root[own]))], names=["key", "a", "b", "fp", "near"])
        give_back()

    return run


def _similar_links(batches):
    """Rows (key, a, b, fp, c, f, ring, own), sorted by the first three; links that span what the sets connect. Rows with the same f are not compared, those with the same c are connected already."""
    for _, (fps, c, f, ring, own) in _groups(batches, 8):
        root, done = (np.unique(np.array(x), return_inverse=True)[1] for x in (c, f))
        ring, sets, out = _rings(ring), [np.frombuffer(x, np.uint64) for x in own], []
        alike = _similar_to(sets)
        for a in range(len(fps) - 1):
            near = _apart_within([done, root], ring, a)
            if not len(near):
                continue
            for b in near[alike(a, near)]:
                if root[b] != root[a]:
                    out.append((fps[a], fps[b]))
                    root[root == root[b]] = root[a]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["u", "v"])
    give_back()


_KEY = ["key", "a", "b"]


def _pairs(own, blocks):
    """The groups of a member of block ``own``: its block with every block."""
    return F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(own, k).alias("a"), F.greatest(own, k).alias("b")))


def _compared(docs: DataFrame, base: DataFrame, dealt: DataFrame, done: str, most: int) -> tuple[DataFrame, DataFrame]:
    """(u, v): links that span what the sets connect in the groups of dealt; (fp, near): what rings within ``most`` bits connect there. Both staged.

    dealt: key, a, b, fp, f, ring; two with the same f are not compared. done: the column of base that f is.
    """
    met = staged(dealt.repartition(*_KEY).sortWithinPartitions(*_KEY).mapInArrow(_pruned(most), "key long, a int, b int, fp long, near long"), "met")
    give_back_driver(docs.sparkSession)
    wanted = base.join(met.select("fp").distinct(), "fp", "left_semi").select("rid", "fp", "ring", "c", F.col(done).alias("f"))
    text = docs.select(F.xxhash64("doc_id", F.xxhash64("text")).alias("rid"), F.col("text").cast("binary").alias("text"))
    sets = text.join(sized(staged(wanted, "wanted")), "rid").select("fp", "c", "f", "ring", "text").dropDuplicates(["fp"]).mapInArrow(_sets, "fp long, c long, f long, ring binary, own binary")
    sets = staged(sets, "sets", TEXTS)
    links = met.drop("near").join(sets, "fp").select(*_KEY, "fp", "c", "f", "ring", "own").repartition(*_KEY).sortWithinPartitions(*_KEY).mapInArrow(_similar_links, "u long, v long")
    return staged(links, "links", TEXTS), met.select("fp", "near")


def _of_chains(docs: DataFrame, base: DataFrame, starts: int, whole: bool, bucket: int) -> tuple[DataFrame, DataFrame]:
    """What _compared gives, of texts that have a chain at one of the first ``starts`` starts. base: fp, rid, ring, c: what fp is connected to, and f: its family.

    Buckets of more than ``bucket`` are dealt in blocks. Not whole: a block meets itself and a few members of all the bucket,
    enough to connect a group of near copies. Whole: if few are left outside of the bucket's largest family, they meet every block; else
    every two blocks meet. So no pair that is not of one family is left out.
    """
    parts, kinds = max(1, -(-base.count() // _RANGE)), ("start int, part int, key binary, after binary, fp binary, apart binary", "key long, fp long, f long")
    packed = base.select("fp", "f", "ring").mapInArrow(_entries(starts, parts), kinds[0]).repartition("start", "part").sortWithinPartitions("start", "part")
    entries = staged(packed.mapInArrow(_chained, kinds[1]), "entries", TEXTS)
    give_back_driver(docs.sparkSession)
    count = entries.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("fp")).alias("x"), F.min("fp").alias("least"), F.min("f").alias("c"), F.max("f").alias("d")).where("n > 1 and c <> d")
    once = staged(count.groupBy("n", "x", "least").agg(F.min("key").alias("key")).select("key", "n"), "buckets")  # buckets of the same members are one
    sizes = once.select("key", "n", F.ceil(F.col("n") / bucket).cast("int").alias("blocks"))
    members = with_sums(entries, sizes.withColumn("size", F.col("n")), ["key"], once.agg(F.sum("n")).first()[0] or 0)
    members = staged(members, "members")
    own = F.expr("cast(pmod(xxhash64(fp), blocks) as int)")
    alone = F.array(F.struct(own.alias("a"), own.alias("b")))
    all_blocks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(k.alias("a"), k.alias("b")))
    if whole:
        largest = members.where("blocks > 1").groupBy("key", "f").agg(F.count("*").alias("k")).groupBy("key").agg(F.max_by("f", "k").alias("major"), (F.sum("k") - F.max("k")).alias("others"))
        members = members.join(sized(staged(largest, "largest")), "key", "left")
        place = F.when(F.col("blocks") == 1, alone).when(F.col("others") > bucket, _pairs(own, F.col("blocks"))).when(F.col("f") == F.col("major"), alone).otherwise(all_blocks)
    else:
        place = F.when((F.col("blocks") > 1) & (F.pmod(F.xxhash64("fp", "key"), F.col("size")) < 8), all_blocks).otherwise(alone)
    dealt = members.select("key", "fp", "f", F.explode(place).alias("p")).select("key", "p.a", "p.b", "fp", "f")
    return _compared(docs, base, dealt.join(base.select("fp", "ring"), "fp").select(*_KEY, "fp", "f", "ring"), "f", RING_MOST if whole else FAMILY_MOST)


def _of_families(docs: DataFrame, base: DataFrame, block: int) -> DataFrame:
    """(u, v), staged: links that span what the sets connect in each family. base: as for _of_chains, with the sizes of the sets."""
    blocks = F.ceil(F.greatest(F.col("n") / block, F.col("bytes") / _FAMILY_BYTES)).cast("int")
    sizes = base.groupBy("f").agg(F.count("*").alias("n"), F.sum(8 * F.col("size").cast("long")).alias("bytes"), F.min("c").alias("c"), F.max("c").alias("d")).where("n > 1 and c <> d")
    sizes = staged(sizes.select("f", "n", blocks.alias("blocks")), "families")
    members = with_sums(base.select("f", "fp", "c", "ring"), sizes, ["f"], sizes.agg(F.sum("n")).first()[0] or 0)
    own = F.expr("cast(pmod(xxhash64(fp), blocks) as int)")
    dealt = members.select(F.col("f").alias("key"), F.explode(_pairs(own, F.col("blocks"))).alias("p"), "fp", "c", "ring").select("key", "p.a", "p.b", "fp", F.col("c").alias("f"), "ring")
    return _compared(docs, base, dealt, "c", RING_MOST)[0]


def _placed(base: DataFrame, name: str, links: DataFrame) -> DataFrame:
    """base with the component that links put each fp in, in a column of that name."""
    comps = staged(connected_components(links, contracted=True), "early").toDF("fp", "component")
    return base.join(comps, "fp", "left").withColumn(name, F.coalesce("component", "fp")).drop("component")


def similar_links(docs: DataFrame, ringed: DataFrame, bucket: int = _SETS, family: int = _FAMILY) -> DataFrame:
    """(u, v): links between the fps of sets that connect all similar ones that have a chain within its budget or are of one family."""
    rid = F.xxhash64("doc_id", "_hash").alias("rid")
    base = staged(ringed.where("octet_length(ring) > 0").select("fp", "ring", "size", rid).groupBy("fp", "ring", "size").agg(F.min("rid").alias("rid")), "rings")
    early, near = _of_chains(docs, base.withColumns({"c": F.col("fp"), "f": F.col("fp")}), EARLY, False, bucket)
    later = staged(_placed(_placed(base, "c", early), "f", near), "rings")
    give_back_driver(docs.sparkSession)
    links = early.unionByName(_of_families(docs, later, family))
    later = staged(_placed(later.drop("c"), "c", links), "rings")
    give_back_driver(docs.sparkSession)
    return links.unionByName(_of_chains(docs, later, RING, True, bucket)[0])


def keep_similar_first(docs: DataFrame, bucket: int = _SETS, family: int = _FAMILY) -> DataFrame:
    """docs with one row of each component of texts alike by LEAST, chosen as keep_first does."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_hash"), F.col("text").cast("binary").alias("text"))
    ringed = staged(rows.mapInArrow(_ringed, "doc_id long, _hash long, fp long, ring binary, size int"), "ringed", TEXTS)
    found = components(ringed.select("doc_id", "_hash", "fp"), links=similar_links(docs, ringed, bucket, family))
    give_back_driver(docs.sparkSession)
    return _firsts(docs, found)
