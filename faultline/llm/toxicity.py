"""Toxicity: a factorization machine over hashed terms.

Method: a text is the set of its terms (runs of letters, A-Z and all other letters lower-cased), each hashed to
``2**bits`` slots. With x_i = 1 for the slots that a text has and the model knows,
    f(x) = w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j,    score = 1 / (1 + exp(-f))
The pairwise part lets two terms say more together than their weights add up to. It is trained by mini-batch AdaGrad
on the log loss over a sample of labelled rows bounded by ``sample_rows`` (expected number of ids, picked by a hash of the id,
so it is the same for every run). A slot enters the model if the rate of the label among its texts is clear of chance (``min_z``, which fewer than ``min_texts`` texts cannot show),
or if that rate among the texts that it shares with another slot is clear of what the two say one by one (``pair_z``); so a
pair is learned even where neither of its terms tells anything alone. Weights for all other slots would add up noise in long texts. Scoring reads
whole texts, in one pass, without a shuffle; the model is a few hundred kB of arrays whatever the input.

Defined results: a null or empty text scores the model's value for no terms. A null id is never learned from and counts
as held out. Repeated rows score alike; of rows that repeat an id one is learned from, and equal sets of terms count once, by the majority of
their labels. A document's label is the greatest of its non-null labels. With no labels,
or with only one class, the score is that class's rate (0 if there are none) for every text. Kept columns named score or predicted are left out.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free, give_back, sized, slices, without

_TERM = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class FMParams:
    bits: int = 20
    factors: int = 8
    sample_rows: int = 20_000
    epochs: int = 80
    rate: float = 0.3
    ridge: float = 1e-3
    min_z: float = 5.0
    min_texts: int = 5
    pair_z: float = 7.0
    pair_share: float = 0.02
    batch: int = 256
    seed: int = 7


@dataclass(frozen=True)
class FMModel:
    bits: int
    slots: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        """rows: for each text, positions in slots, each once."""
        n = len(rows)
        at = np.repeat(np.arange(n), [len(r) for r in rows])
        x = np.concatenate(rows).astype(np.int64) if n else np.zeros(0, np.int64)
        f = np.full(n, self.w0)
        np.add.at(f, at, self.w[x])
        if len(x):
            s, q = np.zeros((n, self.v.shape[1])), np.zeros((n, self.v.shape[1]))
            np.add.at(s, at, self.v[x])
            np.add.at(q, at, self.v[x] ** 2)
            f += 0.5 * (s * s - q).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(f, -40, 40)))


def terms(text: str | None) -> set[str]:
    return set(_TERM.findall((text or "").lower()))


def slot(term: str, bits: int) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) & ((1 << bits) - 1)


def _surprise(seen, expected, variance):
    """Standard deviations between what was seen and expected, with a correction that few cases cannot overcome."""
    away = np.abs(seen - expected) - 0.5
    return np.sign(seen - expected) * np.maximum(away, 0) / np.sqrt(variance + 1)


def telling_pairs(rows: list[np.ndarray], y: np.ndarray, both: np.ndarray, hit: np.ndarray, p: FMParams) -> np.ndarray:
    """Slots of pairs that say something other than the sum of what their two slots say.

    Looks at every two slots that each have ``pair_share`` of the texts: rarer ones meet too seldom for a pair to be told from chance.
    """
    n = len(y)
    prior = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    often = np.flatnonzero(both >= max(p.pair_share * n, 1))
    place = np.full(len(both), -1, np.int32)
    place[often] = np.arange(len(often))
    own = np.log((hit[often] + 0.5) / (both[often] - hit[often] + 0.5)) - prior
    telling, bits = np.zeros(len(often), bool), []
    # a bitmap of texts for each slot: of all texts, and of those with the label
    for own_texts in (np.arange(n), np.flatnonzero(y > 0)):
        words = np.zeros((len(often), -(-max(1, len(own_texts)) // 64)), np.uint64)
        for k, text in enumerate(own_texts):
            mine = place[rows[text]]
            mine = mine[mine >= 0]
            words[mine, k >> 6] |= np.uint64(1) << np.uint64(k & 63)
        bits.append(words)
    whole, toxic = bits
    for i in range(len(often) - 1):
        met = np.bitwise_count(whole[i + 1 :] & whole[i]).sum(axis=1, dtype=np.int64)
        toxic_met = np.bitwise_count(toxic[i + 1 :] & toxic[i]).sum(axis=1, dtype=np.int64)
        sure = 1 / (1 + np.exp(-(prior + own[i] + own[i + 1 :])))
        told = np.abs(_surprise(toxic_met, met * sure, met * sure * (1 - sure))) >= p.pair_z
        telling[i + 1 :] |= told
        telling[i] |= told.any()
    return often[telling]


def fit(rows: list[np.ndarray], y: np.ndarray, p: FMParams) -> FMModel:
    """rows: the slots of each training text, each once; y: 0 or 1."""
    n, pos = len(y), float(y.sum()) if len(y) else 0.0
    if not n or pos in (0, n):
        rate = pos / n if n else 0.0
        w0 = float(np.log(rate / (1 - rate))) if 0 < rate < 1 else (40.0 if rate else -40.0)
        return FMModel(p.bits, np.zeros(0, np.int64), w0, np.zeros(0), np.zeros((0, p.factors)))
    size = 1 << p.bits
    both, hit = np.zeros(size, np.int32), np.zeros(size, np.int32)
    for r, label in zip(rows, y, strict=True):  # text by text: all slots of all texts at once would be the most that is held
        both[r] += 1
        if label:
            hit[r] += 1
    rate = pos / n
    share = both / n
    z = (hit - pos * share) / np.sqrt(np.maximum(pos * share * (1 - share) * (1 - rate), 1e-9))
    single = (np.abs(z) >= p.min_z) & (both >= p.min_texts)
    slots = np.union1d(np.flatnonzero(single), telling_pairs(rows, y, both, hit, p))
    index = np.full(size, -1, np.int32)
    index[slots] = np.arange(len(slots))
    known = [own[own >= 0] for own in (index[r] for r in rows)]
    at, x = np.repeat(np.arange(n), [len(r) for r in known]), np.concatenate(known)
    starts = np.searchsorted(at, np.arange(n + 1))

    rng = np.random.default_rng(p.seed)
    w0, w, v = float(np.log(pos / (n - pos))), np.zeros(len(slots)), rng.normal(0, 0.05, (len(slots), p.factors))
    g0, gw, gv = 1e-8, np.full(len(slots), 1e-8), np.full(v.shape, 1e-8)
    for _ in range(p.epochs):
        order = rng.permutation(n)
        for k in range(0, n, p.batch):
            own = order[k : k + p.batch]
            sizes = starts[own + 1] - starts[own]
            row = np.repeat(np.arange(len(own)), sizes)
            xs = x[np.concatenate([np.arange(starts[i], starts[i + 1]) for i in own])] if sizes.sum() else np.zeros(0, np.int64)
            s = np.zeros((len(own), p.factors))
            np.add.at(s, row, v[xs])
            f = np.full(len(own), w0)
            np.add.at(f, row, w[xs])
            q = np.zeros(len(own))
            np.add.at(q, row, (v[xs] ** 2).sum(axis=1))
            f += 0.5 * ((s * s).sum(axis=1) - q)
            d = (1 / (1 + np.exp(-np.clip(f, -40, 40))) - y[own]) / len(own)
            e0 = d.sum()
            g0 += e0 * e0
            w0 -= p.rate * e0 / np.sqrt(g0)
            if not len(xs):
                continue
            touched, place = np.unique(xs, return_inverse=True)
            ew = np.bincount(place, weights=d[row], minlength=len(touched)) + p.ridge * w[touched] / n
            ev = np.zeros((len(touched), p.factors))
            np.add.at(ev, place, d[row, None] * (s[row] - v[xs]))
            ev += p.ridge * v[touched]
            gw[touched] += ew * ew
            gv[touched] += ev * ev
            w[touched] -= p.rate * ew / np.sqrt(gw[touched])
            v[touched] -= p.rate * ev / np.sqrt(gv[touched])
    return FMModel(p.bits, slots, w0, w, v)


def held_out(doc_id, parts: int, part: int):
    """Is crc32 of the id as text, modulo parts, the held-out part; true for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(True))


def _slot_sets(bits: int):
    """Rows (doc_id, y, text) become (doc_id, y, slots)."""

    def run(batches):
        for batch in batches:
            for b in slices(batch, 2):
                rows = [np.unique(np.fromiter((slot(t, bits) for t in terms(s)), np.int32)) if s else np.zeros(0, np.int32) for s in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "y", "slots"])

    return run


def train(docs: DataFrame, labels: DataFrame, label: str, usable, p: FMParams = FMParams()) -> FMModel:
    """Learns from the labelled rows of docs for which the condition ``usable`` on doc_id holds.

    At most about ``sample_rows`` sets of term slots reach the driver, whatever repeats.
    """
    marked = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & usable).groupBy("doc_id").agg(F.max(label).cast("double").alias("_y"))
    n = marked.count()
    if n > p.sample_rows:
        marked = marked.where(F.xxhash64("doc_id").bitwiseAND((1 << 30) - 1) < int(p.sample_rows / n * (1 << 30)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.make_valid_utf8("text").alias("text")).join(sized(marked), "doc_id").select("doc_id", "_y", "text")
    sets = rows.mapInArrow(_slot_sets(p.bits), "doc_id long, y double, slots binary").groupBy("doc_id", "y").agg(F.min("slots").alias("slots"))
    got = sets.groupBy("slots").agg(F.avg("y").alias("y")).orderBy("slots").toArrow()
    model = fit([np.frombuffer(s.as_buffer(), np.int32) for s in got.column(0)], (got.column(1).to_numpy() >= 0.5).astype(float), p)
    del got
    give_back()
    return model


def toxic(text, model: FMModel):
    """The score as a column; only the text goes through Python."""
    size = 1 << model.bits
    index = {int(s): i for i, s in enumerate(model.slots)}

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        seen: dict[str, int] = {}
        out = [np.zeros(0)]
        for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]), 0, 256):
            rows = []
            for s in part.column(0).to_pylist():
                own = set()
                for t in terms(s):
                    if (i := seen.get(t)) is None:
                        if len(seen) > 200_000:
                            seen.clear()
                        i = seen[t] = index.get(zlib.crc32(t.encode()) & (size - 1), -1)
                    if i >= 0:
                        own.add(i)
                rows.append(np.fromiter(own, np.int64, len(own)))
            out.append(model.scores(rows))
        give_back()
        return pa.array(np.concatenate(out))

    return run(F.make_valid_utf8(text))


def score(docs: DataFrame, model: FMModel, keep, threshold: float = 0.7) -> DataFrame:
    """The columns ``keep`` (names or columns) of docs, then score and predicted; one pass, no shuffle."""
    head = docs.select(*keep)
    own = free("_score", head.columns)
    out = docs.select(*keep, toxic(F.col("text"), model).alias(own))
    return out.select(*without(head, ("score", "predicted")), F.col(own).alias("score"), (F.col(own) >= threshold).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, model: FMModel, threshold: float = 0.7) -> DataFrame:
    """docs without the rows predicted toxic; all columns stay as they are."""
    own = free("_toxic", docs.columns)
    return docs.withColumn(own, toxic(F.col("text"), model)).where(F.col(own) < threshold).drop(own)
