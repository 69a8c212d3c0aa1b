"""Language ID: nearest centroid over TF-IDF n-gram vectors, several clustered centroids per language.

Method: a text's letters are lower-cased, every run of other characters becomes one space, and all 1-, 2- and 3-grams
of characters are counted into ``dims`` hashed slots. A vector is (1 + log count) x IDF, scaled to length 1. Each
language's training vectors are clustered by spherical k-means into ``centroids`` centroids; a text goes to the
language of the centroid with the greatest cosine. A text whose cosine distance to that centroid is beyond
the language's rejection distance for its length is rejected. That distance is learned as a curve: ``slack`` times the ``quantile``
of the distances of the training texts and of their beginnings (8, 16, 32, .. 512 letters), by powers of two of the number of letters, with
straight lines between, and never less than ``near``. The fewer letters, the farther a text may be.

Training reads a sample bounded by ``sample_rows`` ids per language (expected size, picked by a hash of the id; of rows that repeat an id one) and the
``max_langs`` languages with most rows; scoring reads
whole texts in one pass without a shuffle. The model is a matrix of dims x (languages x centroids).

Defined results: null texts and texts without a letter are ``und`` with score 0 and rejected. Texts in no language
(no training rows) are ``und`` too. Equal cosines go to the alphabetically first language. A null id is never
learned from and counts as held out. Kept columns named like the three results are left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free, give_back, slices, without

_GAP = re.compile(r"[\W\d_]+")
_CHUNK = 1 << 20
_POWERS = 24


@dataclass(frozen=True)
class LangParams:
    dims: int = 1 << 13
    sample_rows: int = 600
    centroids: int = 3
    iterations: int = 10
    quantile: float = 0.99
    slack: float = 1.25
    near: float = 0.3
    max_langs: int = 256
    seed: int = 11


@dataclass(frozen=True)
class LangModel:
    langs: list[str]
    owner: np.ndarray
    matrix: np.ndarray
    idf: np.ndarray
    limits: np.ndarray
    p: LangParams


def letters(text: str | None) -> str:
    """The text's letters, lower-cased, with one space for every run of other characters between them."""
    own = _GAP.sub(" ", (text or "").lower()).strip()
    return own if any(map(str.isalpha, own)) else ""  # digits of other scripts and the like are left too


def gram_counts(own: str, dims: int) -> np.ndarray | None:
    """Counts of the hashed 1-, 2- and 3-grams of all of letters(text); None if there are none."""
    if not own:
        return None
    text, total, shift = f" {own} ", np.zeros(dims, np.int64), np.uint32(32 - dims.bit_length() + 1)
    for k in range(0, len(text), _CHUNK):
        past = min(k, 2)  # characters of the part before, for the n-grams that begin there
        c = np.frombuffer(text[k - past : k + _CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
        h = c * np.uint32(0x9E3779B1)
        two = (h[:-1] ^ (c[1:] * np.uint32(0x85EBCA6B))) * np.uint32(0xC2B2AE35)
        three = (two[:-1] ^ (c[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
        for x in (h[past:], two[past // 2 :], three):
            total += np.bincount(x >> shift, minlength=dims)
    return total


def _unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(counts)
    x = np.zeros(len(counts), np.float32)
    x[at] = (1 + np.log(counts[at])) * idf[at]
    return x / max(float(np.sqrt((x * x).sum())), 1e-12)


def sparse(counts: np.ndarray) -> np.ndarray:
    """Slots and counts, in two rows."""
    at = np.flatnonzero(counts)
    return np.stack([at, counts[at]]).astype(np.int32)


def _dense(pairs: np.ndarray, dims: int) -> np.ndarray:
    out = np.zeros(dims, np.int32)
    out[pairs[0]] = pairs[1]
    return out


def _length(counts) -> float:
    """About the number of letters, from the counts of all grams."""
    return max(1.0, float(counts.sum()) / 3)


def _curve(lengths: np.ndarray, distances: np.ndarray, p: LangParams) -> np.ndarray:
    """Rejection distance at each power of two of the length; what no text shows is taken from the nearest that do."""
    at, seen, far = np.rint(np.log2(lengths)).astype(int), [], []
    for k in range(_POWERS):
        if (at == k).any():
            seen.append(k)
            far.append(float(np.quantile(distances[at == k], p.quantile)))
    return np.clip(p.slack * np.interp(np.arange(_POWERS), seen, far), p.near, 1.0)


def fit(counts: dict[str, list[np.ndarray]], p: LangParams, beginnings: dict[str, list[np.ndarray]] | None = None) -> LangModel:
    """counts: by language, sparse() gram counts of its training texts, and of beginnings of them. Languages without texts are left out."""
    langs = sorted(k for k, v in counts.items() if v)
    n = sum(len(counts[k]) for k in langs)
    seen = np.zeros(p.dims)
    for k in langs:
        for c in counts[k]:
            seen[c[0]] += 1
    idf = (np.log((1 + n) / (1 + seen)) + 1).astype(np.float32)
    owner, rows, far = [], [], []
    for i, k in enumerate(langs):
        x = np.stack([_unit(_dense(c, p.dims), idf) for c in counts[k]])
        rng = np.random.default_rng(p.seed)
        own = x[rng.choice(len(x), min(p.centroids, len(x)), replace=False)]
        for _ in range(p.iterations):
            near = (x @ own.T).argmax(axis=1)
            sums = np.stack([x[near == j].sum(axis=0) if (near == j).any() else own[j] for j in range(len(own))])
            own = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        rows.append(own)
        owner += [i] * len(own)
        every = [*counts[k], *(beginnings or {}).get(k, ())]
        distances = np.array([1 - float((own @ _unit(_dense(c, p.dims), idf)).max()) for c in every])
        far.append(_curve(np.array([_length(c[1]) for c in every]), distances, p))
    matrix = np.concatenate(rows).astype(np.float32) if rows else np.zeros((0, p.dims), np.float32)
    return LangModel(langs, np.array(owner, int), matrix, idf, np.array(far), p)


def _sparse(dims: int):
    """Rows (lang, text) become (lang, whole, grams): of each text, and of its beginnings."""

    def run(batches):
        for batch in batches:
            for b in slices(batch, 1):
                langs, whole, out = [], [], []
                for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    own = letters(text)
                    for k in (len(own), *(1 << e for e in range(3, 10) if 1 << e < len(own))) if own else ():
                        if (c := gram_counts(own[:k].strip(), dims)) is not None:
                            langs.append(lang)
                            whole.append(k == len(own))
                            out.append(sparse(c).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(whole, pa.bool_()), pa.array(out, pa.binary())], names=["lang", "whole", "grams"])

    return run


def train(docs: DataFrame, usable, p: LangParams = LangParams()) -> LangModel:
    """Learns from the rows with a language for which the condition ``usable`` holds."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & usable)
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(p.max_langs).collect()}
    share = F.lit(-1)
    for lang, n in sorted(sizes.items()):
        share = F.when(F.col("lang") == lang, int(min(1.0, p.sample_rows / n) * (1 << 30))).otherwise(share)
    picked = rows.where(F.xxhash64("doc_id").bitwiseAND((1 << 30) - 1) <= share).select("doc_id", "lang", F.make_valid_utf8("text").alias("text"))
    picked = picked.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text")
    counts, beginnings = {}, {}
    got = picked.mapInArrow(_sparse(p.dims), "lang string, whole boolean, grams binary").toArrow()
    for lang, whole, raw in sorted(zip(*(got.column(k).to_pylist() for k in range(3)), strict=True)):
        (counts if whole else beginnings).setdefault(lang, []).append(np.frombuffer(raw, np.int32).reshape(2, -1))
    model = fit(counts, p, beginnings)
    del got, counts, beginnings
    give_back()
    return model


def predict(texts: list[str | None], m: LangModel) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, is it rejected) of each text."""
    lang, score, bad = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    if not m.langs:
        return lang, score, bad
    at, rows, lengths = [], [], []
    for i, t in enumerate(texts):
        if (c := gram_counts(letters(t), m.p.dims)) is not None:
            at.append(i)
            rows.append(_unit(c, m.idf))
            lengths.append(_length(c))
    if at:
        cosine = np.stack(rows) @ m.matrix.T
        best = cosine.argmax(axis=1)
        for i, j, n, c in zip(at, best, lengths, cosine[np.arange(len(at)), best], strict=True):
            lang[i], score[i] = m.langs[m.owner[j]], min(1.0, max(0.0, float(c)))
            bad[i] = 1 - c > np.interp(np.log2(n), np.arange(_POWERS), m.limits[m.owner[j]])
    return lang, score, bad


def language(text, model: LangModel):
    """A struct column lang_pred, score, rejected; only the text goes through Python."""

    @F.arrow_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    def run(texts: pa.Array) -> pa.Array:
        lang, score, bad = [], [np.zeros(0)], [np.zeros(0, bool)]
        for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]), 0, 256):
            a, b, c = predict(part.column(0).to_pylist(), model)
            lang += a
            score.append(b)
            bad.append(c)
        give_back()
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(np.concatenate(score)), pa.array(np.concatenate(bad))], names=["lang_pred", "score", "rejected"])

    return run(F.make_valid_utf8(text))


def identify(docs: DataFrame, model: LangModel, keep) -> DataFrame:
    """The columns ``keep`` of docs, then lang_pred, score and rejected; one pass, no shuffle."""
    head = docs.select(*keep)
    own, made = free("_language", head.columns), ("lang_pred", "score", "rejected")
    out = docs.select(*keep, language(F.col("text"), model).alias(own))
    return out.select(*without(head, made), *(F.col(f"{own}.{c}").alias(c) for c in made))


def keep_known(docs: DataFrame, model: LangModel) -> DataFrame:
    """docs without the rows that are rejected; all columns stay as they are."""
    own = free("_language", docs.columns)
    return docs.withColumn(own, language(F.col("text"), model)).where(~F.col(f"{own}.rejected")).drop(own)
