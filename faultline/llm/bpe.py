"""Byte-level BPE encoding and decoding over a prefix-sharing trie.

Method. The words of a batch that have no encoding yet are made distinct and laid out as a trie: in byte order,
neighbours share their common prefix. A depth-first walk carries one state a node, the last token of the encoding of
the bytes down to it. That state suffices: the encoding of a prefix is the encoding of the prefix before its
last token, plus that token. Which token is last is decided by the merges: among the tokens that end there, the one
is right that the tokens before it would not have merged into, i.e. whose boundary with the state before it survives
(``Merges.apart``). So each prefix shared by many words is worked out once, and a word's encoding is read off
by walking the states back. Encodings are kept for later batches in two generations of ``KEPT`` words: when the young one is
full it becomes the old one, whose words come back when they are met again.

Texts are split as the tokenizer file says: special tokens first, then its pattern. Encoding and decoding run in one
pass over whole texts without a shuffle; ids are decoded to bytes, and bytes that are no UTF-8 become U+FFFD.

Defined results: a null text is encoded as an empty one: no tokens. A text that is no valid UTF-8 is made valid first,
each bad sequence becoming U+FFFD. Repeated rows give repeated results. Kept columns named like a result are left out.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import free, give_back, slices

#: Fixed value: the split pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEPT = 125_000


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a visible character: itself if visible, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Merges:
    """A vocabulary with its merges, and which pairs of tokens can stand next to each other."""

    def __init__(self, spec: dict):
        byte = _byte_of_char()
        raw = lambda s: bytes(byte[c] for c in s)
        vocab = {k: i for k, i in spec["model"]["vocab"].items() if all(c in byte for c in k)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {raw(k): i for k, i in vocab.items() if k not in self.special}
        self.bytes_of = [b""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for b, i in self.ids.items():
            self.bytes_of[i] = b
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.made: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, c = self.ids[raw(left)], self.ids[raw(right)], self.ids[raw(left) + raw(right)]
            self.made[a, b] = rank
            if c not in self.rank:
                self.rank[c], self.parts[c] = rank, (a, b)
        self._apart: dict[int, bool] = {}
        self._index()

    def _index(self) -> None:
        """An automaton over the tokens: for each state, the tokens that end there, longest first."""
        step: dict[int, int] = {}
        token, depth = [-1], [0]
        for word, i in self.ids.items():
            at = 0
            for byte in word:
                to = step.get(at << 8 | byte)
                if to is None:
                    to = step[at << 8 | byte] = len(token)
                    token.append(-1)
                    depth.append(depth[at] + 1)
                at = to
            token[at] = i
        back, ends = [0] * len(token), [()] * len(token)
        for key in sorted(step, key=lambda key: depth[step[key]]):
            at, byte, to = key >> 8, key & 255, step[key]
            up = back[at]
            while at and up and (up << 8 | byte) not in step:
                up = back[up]
            back[to] = step.get(up << 8 | byte, 0) if at else 0
            ends[to] = ((token[to], depth[to]), *ends[back[to]]) if token[to] >= 0 else ends[back[to]]
        self.step, self.back, self.ends, self.size = step, back, ends, len(step)

    def apart(self, a: int, b: int) -> bool:
        """Does BPE leave token a followed by token b as they are?

        Merging happens in order of rank, so time is rank: at any time the boundary is touched by a right part of a
        and a left part of b. Going back in time undoes the later of the two parts' merges; the boundary is broken
        if at some time the parts then standing there have a merge that comes before the next one to use either of
        them. Ties in rank are merged left to right, so on the left a merge of the same rank comes first.
        """
        rank, x, y = self.rank.get, a, b
        until_left = until_right = len(self.made)  # when x, y are used up by their own side
        out = True
        while True:
            m = self.made.get((x, y))
            if m is not None and m < until_left and m <= until_right:
                out = False
                break
            rx, ry = rank(x, -1), rank(y, -1)
            if rx < 0 and ry < 0:
                break
            if rx >= ry:
                until_left, x = rx, self.parts[x][1]
            else:
                until_right, y = ry, self.parts[y][0]
        return out

    def encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids, as little-endian unsigned 32-bit integers, of distinct non-empty words."""
        out: dict[bytes, bytes] = {}
        step, back, ends, apart = self.step, self.back, self.ends, self._apart
        if len(step) > self.size + 400_000:
            self._index()
            step, back, ends = self.step, self.back, self.ends
        if len(apart) > 200_000:
            apart.clear()
        before, last, state, size = b"", [-1], [0], [0]  # by depth: the last token, its length, the automaton's state
        for w in sorted(words):
            n, d, top = len(w), 0, min(len(w), len(before))
            while d < top and w[d] == before[d]:
                d += 1
            del last[d + 1 :], state[d + 1 :], size[d + 1 :]
            at = state[d]
            for end in range(d + 1, n + 1):
                key = at << 8 | w[end - 1]
                to = step.get(key)
                if to is None:
                    up = back[at]
                    while (to := step.get(up << 8 | w[end - 1])) is None and up:
                        up = back[up]
                    to = step[key] = to or 0
                at = to
                for t, k in ends[at]:
                    if k == end:
                        break
                    pair = last[end - k] << 32 | t
                    ok = apart.get(pair)
                    if ok is None:
                        ok = apart[pair] = self.apart(last[end - k], t)
                    if ok:
                        break
                else:
                    raise ValueError(f"the vocabulary has no token for byte {w[end - 1]}")
                last.append(t)
                size.append(k)
                state.append(at)
            got, end = [], n
            while end:
                got.append(last[end])
                end -= size[end]
            out[w] = array("I", got[::-1]).tobytes()
            before = w
        return out


class Codec:
    """Whole texts to ids and back."""

    def __init__(self, spec: dict):
        self.kept = KEPT
        self.merges = Merges(spec)
        self.pattern = regex.compile(PATTERN)
        special = sorted(self.merges.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        """The words of text in order; special tokens stand as pieces of their own."""
        if self.special is None or not self.special.search(text):
            return self.pattern.findall(text)
        out = []
        for k, part in enumerate(self.special.split(text)):
            out += [part] if k % 2 else self.pattern.findall(part)
        return out

    def encode_batch(self, texts: list[str | None]):
        """Yields the ids of each text, as little-endian unsigned 32-bit integers."""
        group, chars = [], 0
        for t in texts:
            group.append(t or "")
            chars += len(group[-1])
            if chars > 1_000_000:
                yield from self._encode(group)
                group, chars = [], 0
        yield from self._encode(group)

    def _encode(self, texts: list[str]):
        split = [self.pieces(t) for t in texts]
        if len(self.known) > self.kept:
            self.known, self.older = {}, self.known
        known = self.known
        new = set().union(*split)
        new.difference_update(known)
        back = new.intersection(self.older)
        known.update((w, self.older[w]) for w in back)
        new -= back
        special = self.merges.special
        plain = {w: w.encode() for w in new if w not in special}
        got = self.merges.encode_words(list(plain.values()))
        known.update((w, got[b]) for w, b in plain.items())
        known.update((w, np.array([special[w]], "<u4").tobytes()) for w in new if w in special)
        for words in split:
            yield b"".join(map(known.__getitem__, words))

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the decoded text."""
        of = self.merges.bytes_of
        raw = b"".join(map(of.__getitem__, array("I", ids)))
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()


@lru_cache(2)
def _codec(raw: bytes) -> Codec:
    return Codec(json.loads(raw))


def load_spec(path: str) -> bytes:
    """What the operators need of a tokenizer file, read on the driver."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or spec["model"].get("ignore_merges") or spec["model"]["type"] != "BPE":
        raise ValueError("only byte-level BPE without a normalizer or prefix space is supported")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        raise ValueError("added tokens that take neighbouring text with them are not supported")
    return json.dumps({"model": {k: spec["model"][k] for k in ("vocab", "merges")}, "added_tokens": spec["added_tokens"]}).encode()


def encode(docs: DataFrame, path: str, keep, with_ids: bool = False, text: str = "text", kept_words: int = KEPT) -> DataFrame:
    """The columns ``keep`` of docs, then n_tokens, ids_sha256 and decoded_sha256; with_ids adds ids, array<int>.

    kept_words: encodings that a worker keeps for later batches, twice at most; fewer take less memory and more time.
    ids_sha256 is over the ids as little-endian unsigned 32-bit integers, decoded_sha256 over the decoded text in UTF-8.
    """
    spec = docs.sparkSession.sparkContext.broadcast(load_spec(path))
    head = docs.select(*keep)
    kept = [c for c in head.columns if c.lower() not in ("n_tokens", "ids_sha256", "decoded_sha256", "ids")]
    plain = free("_text", head.columns)
    docs = docs.select(*keep, F.make_valid_utf8(text).alias(plain)).select(*kept, plain)
    head, names = docs.drop(plain), kept

    def run(batches):
        codec = _codec(spec.value)
        codec.kept = kept_words
        for b in batches:
            for own in slices(b, len(names), 500, 1 << 20):
                n, a, d, every = [], [], [], []
                for ids in codec.encode_batch(own.column(len(names)).to_pylist()):
                    n.append(len(ids) // 4)
                    a.append(hashlib.sha256(ids).hexdigest())
                    d.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                    if with_ids:
                        every.append(np.frombuffer(ids, "<i4"))
                cols = [*own.columns[: len(names)], pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(every, pa.list_(pa.int32()))] * with_ids, names=out.names)
        give_back()

    own = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    out = T.StructType([*head.schema.fields, *own] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids)
    return docs.mapInArrow(run, out)


def decode(rows: DataFrame, path: str, keep, ids: str = "ids") -> DataFrame:
    """The columns ``keep`` of rows, then text: the decoded ids (an array of ints; null: empty)."""
    spec = rows.sparkSession.sparkContext.broadcast(load_spec(path))
    head = rows.select(*keep)
    names = head.columns

    def run(batches):
        codec = _codec(spec.value)
        for b in batches:
            texts = [codec.decode(np.array(x or [], "<u4").tobytes()).decode() for x in b.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(texts, pa.string())], names=[*names, "text"])

    return rows.select(*keep, F.col(ids).alias(free("_ids", names))).mapInArrow(run, T.StructType([*head.schema.fields, T.StructField("text", T.StringType())]))
