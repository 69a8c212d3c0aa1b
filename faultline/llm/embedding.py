"""Embedding near-duplicates by collision-counting projections.

Method. Unit vectors are projected on ``projections`` random directions. Two vectors of cosine c or more are at most
d = sqrt(2 - 2c) apart, so in a random direction they differ by about d / sqrt(dims) and, with the window's half width
``width`` of those, collide with a known probability. Each projection is cut into steps of a twelfth of a half window. Rows are sorted by
the first projection and written to the workspace in blocks, a file each. A task takes a block of queries and reads, one after
the other, the blocks that its window on the first projection reaches; blocks are read by name and never shuffled. Of a block it
sorts every projection into windows, a bitmap of the rows inside for each step that a query can stand on. A query's
collisions are the bitmaps of its windows, added up for all rows at once by carry-save counters; pairs whose count reaches the
calibrated one are verified by their cosine in double precision.

Calibration: a pair at exactly the limit collides in each projection with probability p = erf(width / sqrt 2) or more, and the
least count asked for is the largest that a binomial(projections, p) reaches but for half of 1 - ``recall``;
the first projection's window is as wide as it takes to miss no more than the other half. Nearer pairs are found surer still.
With ``recall`` 1 nothing rests on chance: the window is the one outside of which no such pair can be, and every pair in it is verified.

Cost. One-dimensional projections of isotropic vectors separate little (two unrelated ones meet in a third of the windows),
so work grows with the square of the number of distinct vectors. Rows shuffled and memory do not: a vector is shuffled twice, and
each vector is read once for every block of queries.

Equal vectors are collapsed before and counted after, so copies make no pairs. A task sends out, for each
vector, its number of links and the smallest vector of its local component, never its pairs. Nothing of the vectors or blocks reaches
the driver but their number.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are
components of their own. Only vectors of equal length link. Rows that repeat an id are collapsed with equal ones and each
row comes out. A null id never names a component unless all of its component are null; it is kept only then.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pa_dataset
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import connected_components, give_back, new_folder, roots_of, staged, store, with_sums


@dataclass(frozen=True)
class ProjectionParams:
    cosine: float = 0.95
    projections: int = 48
    width: float = 2.0
    recall: float = 0.9999
    block: int = 4_096
    task_blocks: int = 64
    seed: int = 5


def least_count(p: ProjectionParams) -> int:
    """Collisions that a pair at the limit reaches, but for half of what recall allows to miss."""
    hit = math.erf(p.width / math.sqrt(2))
    below = 0.0
    for k in range(p.projections + 1):
        below += math.comb(p.projections, k) * hit**k * (1 - hit) ** (p.projections - k)
        if below > (1 - p.recall) / 2:
            return k
    return p.projections


def reach(p: ProjectionParams, dims: int) -> float:
    """How far apart a pair at the limit can be on the first projection."""
    apart = math.sqrt(2 - 2 * p.cosine)
    if p.recall >= 1:
        return apart * math.sqrt(dims) * (1 + 1e-9)
    return apart * min(math.sqrt(dims), NormalDist().inv_cdf(1 - (1 - p.recall) / 4))


def directions(dims: int, p: ProjectionParams) -> np.ndarray:
    """Random orthogonal frames, so that few directions see as much as many independent ones would."""
    rng = np.random.default_rng(p.seed)
    frames = [np.linalg.qr(rng.normal(size=(dims, dims)))[0] for _ in range(-(-p.projections // dims))]
    return np.concatenate(frames, axis=1)[:, : p.projections] * math.sqrt(dims)


#: A half window takes this many steps; projections further out than _FAR steps are moved there, which only adds collisions.
_HALF = 12
_FAR = 100


def steps(unit: np.ndarray, p: ProjectionParams) -> np.ndarray:
    """For each projection, the step on which each unit vector stands."""
    proj = unit @ directions(unit.shape[1], p)
    half = p.width * math.sqrt(2 - 2 * p.cosine)  # in units of the projections, which have unit variance
    return (np.clip(np.floor(proj * (_HALF / half)), -_FAR, _FAR) + _FAR).astype(np.uint8).T.copy()


def window_bitmaps(of: np.ndarray) -> np.ndarray:
    """For each projection and each step: the rows less than a half window and a step away, as bits of 64-bit words."""
    rows = -(-of.shape[1] // 64) * 64
    centre = np.arange(2 * _FAR + 1, dtype=np.int16)[:, None]
    out = np.zeros((len(of), len(centre), rows // 64), np.uint64)
    for k, own in enumerate(of):
        inside = np.zeros((len(centre), rows), bool)
        inside[:, : len(own)] = np.abs(own.astype(np.int16)[None, :] - centre) <= _HALF + 1
        out[k] = np.packbits(inside, axis=1, bitorder="little").view(np.uint64)
    return out


def collided(queries: np.ndarray, bitmaps: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the pairs that collide in ``least`` projections or more; queries: steps, a column each."""
    waiting: list[list[np.ndarray]] = [[]]  # by weight 1, 2, 4, ..: bit planes not yet added
    for own, table in zip(queries, bitmaps, strict=True):
        waiting[0].append(table[own])
        at = 0
        while len(waiting[at]) == 3:
            a, b, c = waiting[at]
            both = a ^ b
            waiting[at] = [both ^ c]
            if at + 1 == len(waiting):
                waiting.append([])
            waiting[at + 1].append((a & b) | (both & c))
            at += 1
    at = 0
    while at < len(waiting):
        if len(waiting[at]) == 2:
            a, b = waiting[at]
            waiting[at] = [a ^ b]
            if at + 1 == len(waiting):
                waiting.append([])
            waiting[at + 1].append(a & b)
            if len(waiting[at + 1]) == 3:
                a, b, c = waiting[at + 1]
                both = a ^ b
                waiting[at + 1] = [both ^ c]
                if at + 2 == len(waiting):
                    waiting.append([])
                waiting[at + 2].append((a & b) | (both & c))
        at += 1
    planes = [w[0] if w else np.zeros_like(waiting[0][0]) for w in waiting]
    if least >> len(planes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    more, same = np.zeros_like(planes[0]), np.full_like(planes[0], ~np.uint64(0))
    for k in range(len(planes) - 1, -1, -1):
        if least >> k & 1:
            same &= planes[k]
        else:
            more |= same & planes[k]
            same &= ~planes[k]
    more |= same
    query, word = np.nonzero(more)
    hit, bit = np.nonzero(np.unpackbits(more[query, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return query[hit], word[hit] * 64 + bit


def _unit(vec: np.ndarray) -> np.ndarray:
    x = vec.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _projected(p: ProjectionParams, kind: str):
    """Rows (k1, k2, embedding, copies, least) become (dims, first, k1, k2, copies, least, vec)."""

    def run(batches):
        frames: dict[int, np.ndarray] = {}
        for b in batches:
            vecs = [np.asarray(v, kind) for v in b.column(2).to_pylist()]
            first = []
            for v in vecs:
                if len(v) not in frames:
                    frames[len(v)] = directions(len(v), p)[:, 0]
                first.append(float(_unit(v[None, :])[0] @ frames[len(v)]))
            yield pa.RecordBatch.from_arrays([pa.array([len(v) for v in vecs], pa.int32()), pa.array(first, pa.float64()), b.column(0), b.column(1), b.column(3), b.column(4), pa.array([v.tobytes() for v in vecs], pa.binary())], names=["dims", "first", "k1", "k2", "copies", "least", "vec"])

    return run


_BLOCKS = "name string, dims int, lo double, hi double, base long, k1 array<long>, k2 array<long>, copies array<long>, least array<long>"


def _blocks(p: ProjectionParams, folder: str, kind: str):
    """Sorted rows are written as files of at most p.block vectors each; a row a file comes out, vectors numbered from base."""

    def run(batches):
        files, top = store(folder)
        held: list[pa.RecordBatch] = []
        seq = 0

        def out(rows: pa.Table):
            nonlocal seq
            name, dims = uuid.uuid4().hex, rows.column(0)[0].as_py()
            vec = np.frombuffer(b"".join(rows.column(6).to_pylist()), kind)
            with files.open_output_stream(f"{top}/{name}", compression=None) as f:
                f.write(rows.column(4).to_numpy().astype("<i8").tobytes() + vec.tobytes())
            base = ((TaskContext.get().partitionId() << 20) + seq) * p.block
            seq += 1
            first = rows.column(1).to_numpy()
            cols = [[name], [dims], [float(first.min())], [float(first.max())], [base], *([rows.column(k).to_pylist()] for k in (2, 3, 4, 5))]
            kinds = (pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), *[pa.list_(pa.int64())] * 4)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _BLOCKS.split(", ")])

        def cut(last: bool):
            nonlocal held
            rows = pa.Table.from_batches(held)
            dims, at = rows.column(0).to_numpy(), 0
            while at < rows.num_rows:
                end = at + int(np.searchsorted(dims[at:], dims[at], side="right"))
                if not last and end == rows.num_rows and end - at < p.block:
                    break
                yield out(rows.slice(at, min(end, at + p.block) - at))
                at = min(end, at + p.block)
            held = rows.slice(at).to_batches()

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= p.block:
                yield from cut(False)
        if held:
            yield from cut(True)
        give_back()

    return run


def _compare(p: ProjectionParams, folder: str, index_at: str, kind: str, parts: int):
    """Rows (name, part) become (node, links, root) of a block's queries and the blocks that they meet.

    Blocks of one length stand in a circle and each meets the half that follows, so every pair of blocks is met once; the part says which of those.
    """
    least = 0 if p.recall >= 1 else least_count(p)

    def run(batches):
        files, top = store(folder)
        index_files, index_top = store(index_at)
        table = pa_dataset.dataset(index_top, format="parquet", filesystem=index_files).to_table(columns=["name", "dims", "lo", "hi", "base"])
        index = sorted(zip(*(table.column(k).to_pylist() for k in (1, 2, 3, 4, 0)), strict=True))
        place = {x[4]: k for k, x in enumerate(index)}

        def load(k: int):
            dims, _, _, base, name = index[k]
            with files.open_input_stream(f"{top}/{name}", compression=None) as f:
                raw = f.read()
            n = len(raw) // (8 + dims * np.dtype(kind).itemsize)
            unit = _unit(np.frombuffer(raw, kind, offset=8 * n).reshape(n, dims))
            return base + np.arange(n), np.frombuffer(raw, "<i8", n), unit, steps(unit, p) if least else None

        def links(a, b, same: bool):
            maps = window_bitmaps(b[3]) if least else None
            for k in range(0, len(a[0]), 256):  # query-centred windows, 256 queries at a time
                x = a[2][k : k + 256]
                if least:
                    q, r = collided(a[3][:, k : k + 256], maps, least)
                else:
                    q, r = (c.ravel() for c in np.indices((len(x), len(b[0]))))
                if same:
                    q, r = q[q + k < r], r[q + k < r]
                if len(q) > len(x) * len(b[0]) // 200:
                    near = (x @ b[2].T)[q, r] >= p.cosine
                else:
                    near = np.concatenate([np.einsum("ij,ij->i", x[q[j : j + 65_536]], b[2][r[j : j + 65_536]]) >= p.cosine for j in range(0, len(q), 65_536)] or [np.zeros(0, bool)])
                yield q[near] + k, r[near]

        for batch in batches:
            for name, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = place[name]
                dims, lo, hi = index[at][:3]
                own = [k for k, x in enumerate(index) if x[0] == dims]
                n, me = len(own), own.index(at)
                far = reach(p, dims)
                others = [own[(me + s) % n] for s in range(n // 2 + 1) if s < n - s or (s == n - s and me < n // 2)]
                a = None
                for to in others[part::parts]:
                    if index[to][1] > hi + far or index[to][2] < lo - far:
                        continue
                    a = load(at) if a is None else a
                    same = to == at
                    b = a if same else load(to)
                    met = list(links(a, b, same))
                    ai, bi = (np.concatenate([m[k] for m in met]) for k in (0, 1))
                    if not len(ai):
                        continue
                    na, shift = len(a[0]), 0 if same else len(a[0])
                    names, copies = (a[0], a[1]) if same else (np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]))
                    bi = bi + shift
                    n_links = np.bincount(ai, copies[bi], len(names)) + np.bincount(bi, copies[ai], len(names))
                    linked, root = np.flatnonzero(n_links), roots_of(len(names), ai, bi)
                    yield pa.RecordBatch.from_arrays([pa.array(names[linked]), pa.array(n_links[linked].astype(np.int64)), pa.array(names[root[linked]])], names=["node", "links", "root"])
        give_back()

    return run


def near_duplicates(rows: DataFrame, p: ProjectionParams = ProjectionParams()) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of rows (vec_id, embedding)."""
    spark = rows.sparkSession
    element = rows.schema["embedding"].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    if not isinstance(element, T.FloatType | T.DoubleType):
        rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    sound = F.coalesce(F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    keys = [F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(p.seed), F.col("embedding")).alias("k2")]  # 128 bits name a vector
    total = rows.count()
    distinct = rows.where(sound).select("vec_id", "embedding", *keys).groupBy("k1", "k2", "embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    projected = distinct.select("k1", "k2", "embedding", "copies", "least").mapInArrow(_projected(p, kind), "dims int, first double, k1 long, k2 long, copies long, least long, vec binary")
    ranged = projected.repartitionByRange(max(1, math.ceil(total / (4 * p.block))), "dims", "first", "k1").sortWithinPartitions("dims", "first", "k1")
    folder = new_folder(spark, "blocks")
    files, top = store(folder)
    files.create_dir(top, recursive=True)
    blocks = staged(ranged.mapInArrow(_blocks(p, folder, kind), _BLOCKS), "block-index")
    n = blocks.count()
    parts = max(1, math.ceil(n / 2 / p.task_blocks))
    tasks = blocks.select("name", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")).repartition(max(1, min(100_000, n * parts)))
    found = staged(tasks.mapInArrow(_compare(p, folder, blocks._staged_at, kind, parts), "node long, links long, root long"), "found")
    nodes = blocks.select("base", F.posexplode(F.arrays_zip("k1", "k2", "copies", "least")).alias("pos", "v")).select((F.col("base") + F.col("pos")).alias("node"), "v.*")
    comps = connected_components(found.where("node <> root").select("node", "root"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.join(counts, "node", "left").join(comps, "node", "left")
    named = staged(named.select("k1", "k2", "least", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component")), "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named = staged(with_sums(named, least, ["component"], total).select("k1", "k2", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id", F.col("copies").alias("n")), "named")
    linked = with_sums(rows.where(sound).select("vec_id", *keys), named, ["k1", "k2"], total).select("vec_id", "n_links", F.coalesce("component_id", "vec_id").alias("component_id"))
    alone = rows.where(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
