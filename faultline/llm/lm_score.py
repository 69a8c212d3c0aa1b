"""Language-model scoring by cross-entropy difference.

Method. A target model (documents picked by a label) and a background model (all documents) are n-gram models of order two
over one vocabulary, smoothed alike. A document's score is the mean over its tokens of target loss - background
loss, in bits; below zero it is more like the target than like the corpus.

Every word and every pair of all documents counts and is used. With c the counts,
    P(v | u) = weight * c(u, v) / c(u) + (1 - weight) * P(v),     P(v) = (c(v) + 1/2) / (N + |V| / 2)
which sums to one over the vocabulary; for a u that was never seen, P(v | u) = P(v). Both models know the scored documents
themselves: a document of the target is among what its target model was counted from.

Documents are numbered once, in chunks of about ``_WHOLE`` tokens that are one file of the workspace each and never shuffled; tasks get them by name. A
chunk sends its distinct words, and then its distinct pairs, with their counts through a shuffle, in ranges of their hashes: a row is what a chunk has in a range, packed and in order, so
a pair is about nine bytes. Where the rows of a range meet they are summed, and each chunk gets back the sums of what other chunks hold
too. The number of ranges grows with the tokens, so a range is about ``_RANGE`` of them whatever the input; a very common word is one number
a chunk, and nothing is broadcast but the targets' ids. Words and pairs go by 64-bit hashes; two of one hash would be counted as one.

Defined results: null and empty texts, and texts without a token, have 0 tokens, null losses and score, and are not
selected. A document is a target if any of its label rows says so; rows without an id never are. Without any target
the target model is uniform. Repeated rows count as often as they stand there. Kept columns named like a result are left out.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import give_back, new_folder, sized, slices, staged, store

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_WHOLE = 1 << 21
_RANGE = 1 << 20
#: Rows of a batch of texts, and of packed numbers.
_TEXTS, _PACKS = 500, 8
_SLICE = 1 << 16
_SEQ = 12


@dataclass(frozen=True)
class LMParams:
    weight: float = 0.7
    threshold: float = 0.0


_CHUNKS = "chunk long, name string, tokens long"
_PARTS = ("lengths", "targets", "ids", "hashes", "head")


def _packed(kept: pa.Schema, folder: str):
    """Rows (target, text, kept columns) become chunks, a file each: token numbers, the words' hashes and the kept columns. A row a file comes out."""

    def run(batches):
        files, top = store(folder)
        words, heads, lengths, targets, ids, n, seq = None, [], [], [], [], 0, 0

        def out():
            if seq >= 1 << _SEQ:
                raise ValueError("a partition has too many tokens; read the documents in smaller parts")
            rows = pa.Table.from_batches(heads, kept).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as w:
                w.write_table(rows)
            hashes = np.fromiter((xxhash.xxh64_intdigest(w.encode()) for w in words), np.uint64, len(words))
            body = (np.array(lengths, np.int32), np.array(targets, np.bool_), np.concatenate([np.zeros(0, np.int32), *ids]), hashes)
            packed = pa.RecordBatch.from_arrays([*(pa.array([x.tobytes()], pa.binary()) for x in body), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=list(_PARTS))
            name = uuid.uuid4().hex
            with files.open_output_stream(f"{top}/{name}", compression=None) as f, pa.ipc.new_stream(f, packed.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(packed)
            chunk = (TaskContext.get().partitionId() << _SEQ) + seq
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([name]), pa.array([len(body[2])], pa.int64())], names=["chunk", "name", "tokens"])

        for batch in batches:
            for b in slices(batch, 1):
                start = 0
                for k, (is_target, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                    if words is None:
                        words = defaultdict()
                        words.default_factory = words.__len__
                        words[""]  # the start of a text is number 0
                    tokens = _TOKEN.findall((text or "").lower())
                    ids.append(np.fromiter(map(words.__getitem__, tokens), np.int32, len(tokens)))
                    lengths.append(len(tokens))
                    targets.append(is_target)
                    n += len(tokens)
                    if n >= _WHOLE:
                        heads.append(pa.RecordBatch.from_arrays(b.columns[2:], schema=kept).slice(start, k + 1 - start))
                        yield out()
                        words, heads, lengths, targets, ids, n, seq, start = None, [], [], [], [], 0, seq + 1, k + 1
                if start < b.num_rows:
                    heads.append(pa.RecordBatch.from_arrays(b.columns[2:], schema=kept).slice(start))
        if lengths:
            yield out()
        give_back()

    return run


def _unpacked(source, name: str):
    """(lengths, targets, ids, hashes) and the kept columns of a chunk."""
    files, top = source
    with files.open_input_stream(f"{top}/{name}", compression=None) as f:
        row = pa.ipc.open_stream(f).read_all().combine_chunks()
    part = lambda k, kind: np.frombuffer(row.column(k).chunk(0)[0].as_buffer(), kind)
    return [part(0, np.int32), part(1, np.bool_), part(2, np.int32), part(3, np.uint64)], row.column(4).chunk(0)[0].as_buffer()


def _narrow(x: np.ndarray) -> bytes:
    """Numbers that are not negative, each in as many bytes as the largest takes, which the first byte tells; all lowest bytes first, so
    that the others, mostly zeros, compress."""
    x = np.ascontiguousarray(x, np.uint64).reshape(-1)
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if x.size else 1
    return bytes([width]) + x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _wide(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : raw[0]] = planes.T
    return out.view(np.uint64).reshape(-1)


def _steps(x: np.ndarray) -> bytes:
    """Numbers in rising order, at least one, as the first of them and the steps between."""
    x = x.astype(np.uint64)
    return int(x[0]).to_bytes(8, "little") + _narrow(x[1:] - x[:-1])


def _from_steps(raw: bytes) -> np.ndarray:
    return np.cumsum(np.r_[np.frombuffer(raw, np.uint64, 1), _wide(raw[8:])], dtype=np.uint64)


def _keys(lengths: np.ndarray, ids: np.ndarray, size: int) -> np.ndarray:
    """For each token of a chunk the number of its pair."""
    prior = np.zeros(len(ids), np.int64)
    prior[1:] = ids[:-1]
    ends = np.cumsum(lengths)
    prior[(ends - lengths)[lengths > 0]] = 0
    return prior * size + ids


def _sums(which: np.ndarray, size: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each number below size occurs, in all tokens and in the target's."""
    return np.bincount(which, minlength=size), np.bincount(which[own], minlength=size)


def _chunk_words(lengths, targets, ids, hashes):
    """For a chunk's words the counts c of both models, and b, how often another token follows."""
    own = np.repeat(targets, lengths)
    prior = _keys(lengths, ids, 1) - ids
    return [*_sums(ids, len(hashes), own), *_sums(prior, len(hashes), own)]


def pair_hashes(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A hash of two words' hashes, in their order."""
    x = u * np.uint64(0x9E3779B97F4A7C15) + (v ^ (v >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _of_words(lengths, targets, ids, hashes):
    """(hashes, counts) of a chunk's words."""
    return hashes, _chunk_words(lengths, targets, ids, hashes)


def _of_pairs(lengths, targets, ids, hashes):
    """(hashes, counts) of a chunk's pairs, in the order of their numbers."""
    keys, of = np.unique(_keys(lengths, ids, len(hashes)), return_inverse=True)
    return pair_hashes(hashes[keys // len(hashes)], hashes[keys % len(hashes)]), [*_sums(of, len(keys), np.repeat(targets, lengths))]


_SENT = "range long, chunk long, start long, keys binary, counts binary"


def _sent(counted, bits: int, folder: str):
    """Chunks become rows of what they hold in each range of hashes: hashes in order, and their counts."""

    def run(batches):
        source = store(folder)
        for b in batches:
            for chunk, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                keys, counts = counted(*_unpacked(source, name)[0])
                order = np.argsort(keys, kind="stable")
                keys, counts = keys[order], np.stack(counts)[:, order]
                edges = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
                starts = np.unique([0, *edges])
                for lo, hi in zip(starts, [*starts[1:], len(keys)], strict=True):
                    if hi > lo:
                        cols = [[int(keys[lo]) >> (64 - bits)], [chunk], [lo], [_steps(keys[lo:hi])], [_narrow(counts[:, lo:hi])]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["range", "chunk", "start", "keys", "counts"])
        give_back()

    return run


_BACK = "chunk long, kind int, place binary, sums binary, distinct long, total long, total_target long"


def _summed(kind: int, width: int):
    """Rows of _sent, by range; for each of them the places and sums of what other chunks hold too. The first row of a range tells
    how many different ones it has and what their first two counts sum to."""

    def out(held):
        parts = [_from_steps(x[2]) for x in held]
        keys = np.concatenate(parts)
        counts = np.concatenate([_wide(x[3]).astype(np.int64).reshape(width, -1) for x in held], axis=1)
        order = np.argsort(keys, kind="stable")
        new = np.r_[True, keys[order][1:] != keys[order][:-1]]
        of = np.empty(len(keys), np.int64)
        of[order] = np.cumsum(new) - 1
        sums = np.stack([np.bincount(of, c).astype(np.int64) for c in counts])
        at, told = 0, (int((sums[0] > 0).sum()), int(sums[0].sum()), int(sums[1].sum()))
        for (chunk, start, *_), part in zip(held, parts, strict=True):
            n = len(part)
            own, whole = counts[:, at : at + n], sums[:, of[at : at + n]]
            more = np.flatnonzero((own != whole).any(axis=0))
            at += n
            if len(more) or any(told):
                cols = [[chunk], [kind], [_steps(start + more) if len(more) else b""], [_narrow(whole[:, more])], *([x] for x in told)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=[x.split()[0] for x in _BACK.split(", ")])
            told = (0, 0, 0)

    def run(batches):
        now, held = None, []
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if row[0] != now:
                    if held:
                        yield from out(held)
                    now, held = row[0], []
                held.append(row[1:])
        if held:
            yield from out(held)
        give_back()

    return run


def _scored(kept: pa.Schema, names, totals, size: int, p: LMParams, folder: str):
    """Rows (chunk, kind, place, sums, name), of each chunk the sums first (1 words, 2 pairs), then the chunk's file (3)."""

    def scored(source, name, sums):
        (lengths, targets, ids, hashes), head = _unpacked(source, name)
        key, of = np.unique(_keys(lengths, ids, len(hashes)), return_inverse=True)
        word = _chunk_words(lengths, targets, ids, hashes)
        pair = [*_sums(of, len(key), np.repeat(targets, lengths))]
        for kind, values, names_of in ((1, word, hashes), (2, pair, pair_hashes(hashes[key // len(hashes)], hashes[key % len(hashes)]))):
            order = np.argsort(names_of, kind="stable")
            for place, whole in sums[kind]:
                if not place:  # a row that only tells of its range
                    continue
                at = order[_from_steps(place).astype(np.int64)]
                for x, y in zip(values, _wide(whole).reshape(len(values), -1), strict=True):
                    x[at] = y
        u, v = key // len(hashes), key % len(hashes)
        doc, out = np.repeat(np.arange(len(lengths)), lengths), []
        for j in (1, 0):
            p1 = (word[j][v] + 0.5) / (totals[j] + size / 2)
            followed = word[2 + j][u]
            prob = np.where(followed > 0, p.weight * pair[j] / np.maximum(followed, 1) + (1 - p.weight) * p1, p1)
            out.append(np.bincount(doc, -np.log2(prob)[of], len(lengths)))
        n = lengths.astype(np.int64)
        none = n == 0
        a, c = (x / np.maximum(n, 1) for x in out)
        s = (out[0] - out[1]) / np.maximum(n, 1)
        head = pa.ipc.open_stream(head).read_all().combine_chunks()
        cols = [*(head.column(i).combine_chunks() for i in range(len(kept))), pa.array(s, mask=none), pa.array(n), *(pa.array(x, mask=none) for x in (a, c)), pa.array(~none & (s < p.threshold))]
        return pa.Table.from_arrays(cols, names=names)

    def run(batches):
        source = store(folder)
        chunk, sums = None, {1: [], 2: []}
        for b in batches:
            for own, kind, place, whole, name in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if own != chunk:
                    chunk, sums = own, {1: [], 2: []}
                if kind < 3:
                    sums[kind].append((place, whole))
                    continue
                yield from scored(source, name, sums).to_batches(max_chunksize=_SLICE)
                sums = {1: [], 2: []}
        give_back()

    return run


MADE = ("score", "n_tokens", "target_loss", "background_loss", "selected")


def score(docs: DataFrame, labels: DataFrame, label: str, keep, p: LMParams = LMParams()) -> DataFrame:
    """The columns ``keep`` of docs, then score, n_tokens, target_loss, background_loss (bits a token) and selected."""
    spark = docs.sparkSession
    ids = labels.where(F.col(label) == 1).select(F.col("doc_id").alias("_of")).where("_of is not null").distinct().withColumn("_target", F.lit(True))
    kept = [c for c in docs.select(*keep).columns if c.lower() not in MADE]
    names = [f"c{k}" for k in range(len(kept))]
    rows = docs.select(F.col("doc_id").alias("_own"), F.make_valid_utf8("text").alias("_text"), F.struct(*keep).alias("_kept"))
    rows = rows.join(sized(ids), F.col("_own") == F.col("_of"), "left").select(F.coalesce("_target", F.lit(False)).alias("target"), "_text", *(F.col("_kept")[c].alias(n) for c, n in zip(kept, names, strict=True)))
    plain = rows.select(*names)
    schema = pa.schema([pa.field(n, x.type) for n, x in zip(names, plain.limit(0).toArrow().schema, strict=True)])
    folder = new_folder(spark, "chunks")
    files, top = store(folder)
    files.create_dir(top, recursive=True)
    chunks = staged(rows.mapInArrow(_packed(schema, folder), _CHUNKS), "chunk-index", _TEXTS)
    n_chunks, tokens = chunks.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    bits = max(3, (tokens // _RANGE).bit_length())
    body = chunks.select("chunk", "name").repartition(max(1, min(n_chunks, 20_000)))

    def back(counted, kind: int, width: int) -> DataFrame:
        sent = body.mapInArrow(_sent(counted, bits, folder), _SENT)
        return sent.repartition(min(1 << bits, 20_000), "range").sortWithinPartitions("range").mapInArrow(_summed(kind, width), _BACK)

    of_words = staged(back(_of_words, 1, 4), "words", _PACKS)
    size, n, n_target = of_words.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("distinct", "total", "total_target"))).first()
    both = of_words.unionByName(back(_of_pairs, 2, 2)).select("chunk", "kind", "place", "sums").unionByName(chunks.select("chunk", F.lit(3).alias("kind"), "name"), allowMissingColumns=True)
    kinds = (T.DoubleType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.BooleanType())
    out = T.StructType([*(T.StructField(f.name, f.dataType) for f in plain.schema.fields), *(T.StructField(f"_{c}", t) for c, t in zip(MADE, kinds, strict=True))])
    run = _scored(schema, out.names, (n, n_target), size + 2, p, folder)
    placed = both.select("chunk", "kind", "place", "sums", "name").repartition(max(1, min(n_chunks, 20_000)), "chunk")
    made = placed.sortWithinPartitions("chunk", "kind").mapInArrow(run, out)
    return staged(made, "scores", _PACKS).toDF(*kept, *MADE)
