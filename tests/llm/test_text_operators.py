"""URL filter, toxicity, language ID, LM scoring and BPE, on small tables and against plain versions."""

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from faultline.llm import bpe, language_id, lm_score, queries, toxicity, url_filter
from pyspark.sql import functions as F

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, langs=None):
    rows = [(i, t, (langs or {}).get(i), "s", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


# --- URL filter


def test_urls(spark):
    urls = [
        (1, "https://WWW.Example.com/en/7?x#y"), (2, "http://a.example.com/en/8"), (3, "http://b.net/de/1"), (4, "http://example.net/de/8x"),
        (5, None), (6, ""), (7, "no scheme/en/"), (8, "http://notexamplecom/en/"), (9, "http://x.fr/porn/1"), (10, "http://x.fr/important-pornx"),
        (11, "http://x.fr/free"), (12, "http://x.fr/free-casino"), (13, "http://x.fr/free-free-free-free"), (14, "http://x.org/es/"), (14, "http://x.org/es/"), (None, "://y?z"),
    ]
    rows = spark.createDataFrame(urls, "page_id long, url string").withColumn("verdict", F.lit(3))
    got = url_filter.judge_urls(rows, queries.RULES).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(urls)
    assert (by[1].host, by[1].path, by[1].rule, by[1].verdict) == ("www.example.com", "/en/7", "example.com/en/7", "allow")
    assert (by[2].rule, by[2].verdict) == ("com/en/", "block")
    assert by[3].rule == "net/de/" and by[4].rule == "example.net/de/8"
    assert all((by[k].host, by[k].path, by[k].rule, by[k].verdict) == ("", "", None, "allow") for k in (5, 6, 7))
    assert by[8].rule is None and (by[None].host, by[None].path) == ("y", "")
    assert [by[k].verdict for k in (9, 10, 11, 12, 13, 14)] == ["block", "allow", "allow", "block", "allow", "block"]


def test_vocabulary_must_need_several_soft_terms():
    with pytest.raises(ValueError):
        url_filter.Vocabulary(soft={"a": 3}, soft_limit=3)


# --- toxicity


def _texts_of_pairs(label, n):
    """Texts of 20 words, in half of them "insult" and in half "group"; label says what follows from the two."""
    rng = random.Random(3)
    stock = [f"w{chr(97 + k // 676)}{chr(97 + k // 26 % 26)}{chr(97 + k % 26)}" for k in range(3000)]
    out = []
    for _ in range(n):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        out.append((" ".join([rng.choice(stock) for _ in range(20)] + ["insult"] * a + ["group"] * b), float(label(a, b))))
    return out


@pytest.mark.parametrize("label", [lambda a, b: a and b, lambda a, b: a == b])
def test_pairs_of_terms_are_learned(label):
    """With production parameters, also where the label depends on the pair alone and neither term tells anything."""
    p, texts = toxicity.FMParams(), _texts_of_pairs(label, 8000)
    rows = [np.unique([toxicity.slot(t, p.bits) for t in toxicity.terms(s)]) for s, _ in texts]
    y = np.array([v for _, v in texts])
    m = toxicity.fit(rows[:6000], y[:6000], p)
    at = {int(s): i for i, s in enumerate(m.slots)}
    known = [np.array([at[s] for s in r if s in at], int) for r in rows[6000:]]
    assert ((m.scores(known) >= 0.5) == y[6000:]).mean() > 0.98


def test_scores_are_the_sum_over_pairs(spark):
    """f(x) by its double sum over pairs of slots, for every text, against the operator's column."""
    texts = [t for t, _ in _texts_of_pairs(lambda a, b: a and b, 400)] + ["", None, "insult group " * 50_000]
    p = toxicity.FMParams()
    rows = [np.unique([toxicity.slot(t, p.bits) for t in toxicity.terms(s)]) for s in texts[:400]]
    m = toxicity.fit(rows, np.array([float("insult" in t and "group" in t) for t in texts[:400]]), p)
    at = {int(s): i for i, s in enumerate(m.slots)}
    got = {r.doc_id: r.score for r in toxicity.score(docs(spark, texts), m, ["doc_id"]).collect()}
    for k, t in enumerate(texts):
        own = sorted({at[s] for w in toxicity.terms(t) if (s := toxicity.slot(w, p.bits)) in at})
        f = m.w0 + sum(m.w[i] for i in own) + sum(float(m.v[i] @ m.v[j]) for i in own for j in own if i < j)
        assert got[k] == pytest.approx(1 / (1 + math.exp(-f)), abs=1e-9)


def test_toxicity_on_odd_rows(spark):
    d = docs(spark, [None, "", "moron " * 3, "fine words", "fine words"]).union(spark.createDataFrame([(None, "moron", None, None, None)], DOC))
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(5)] + [(None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    out = toxicity.held_out(F.col("doc_id"), 3, 1)
    m = toxicity.train(d, labels, "toxic", F.lit(True))
    got = toxicity.score(d, m, ["doc_id", out.alias("held_out")]).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    empty = toxicity.train(d.limit(0), labels.limit(0), "toxic", F.lit(True))
    assert {r.predicted for r in toxicity.score(d, empty, ["doc_id"]).collect()} == {0}


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op2_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("predicted", "toxic").toPandas()
    hit = got[got.predicted == 1]
    assert (hit.toxic == 1).mean() > 0.95 and (got[got.toxic == 1].predicted == 1).mean() > 0.7


# --- language ID


def test_languages_on_odd_rows(spark):
    texts = ["the cat and the dog are here with us " * 5] * 4 + ["der hund und die katze sind hier bei uns " * 5] * 4 + [None, "", "123 !?", "the dog", "q" * 3_000_000]
    d = docs(spark, texts, {**dict.fromkeys(range(4), "en"), **dict.fromkeys(range(4, 8), "de")})
    m = language_id.train(d, F.lit(True))
    got = {r.doc_id: r for r in language_id.identify(d, m, ["doc_id"]).collect()}
    assert [got[i].lang_pred for i in (0, 4, 11)] == ["en", "de", "en"]
    assert all(got[i].lang_pred == "und" and got[i].rejected and got[i].score == 0 for i in (8, 9, 10))
    assert got[12].rejected and not got[0].rejected and not got[11].rejected
    none = language_id.train(d.limit(0), F.lit(True))
    assert {r.lang_pred for r in language_id.identify(d, none, ["doc_id"]).collect()} == {"und"}


def test_languages_by_plain_tf_idf():
    """Counts, TF-IDF, cosine and rejection worked out plainly, for texts longer than a part of them that is counted at a time."""
    rng = random.Random(9)
    stock = {"en": "the cat and dog is with house water of this".split(), "de": "der hund und die katze ist mit haus wasser dies".split()}
    train = {k: [" ".join(rng.choice(v) for _ in range(40)) for _ in range(12)] for k, v in stock.items()}
    p = language_id.LangParams(dims=1 << 10)
    count = lambda t: language_id.gram_counts(language_id.letters(t), p.dims)
    m = language_id.fit({k: [language_id.sparse(count(t)) for t in v] for k, v in train.items()}, p)
    texts = ["The cat, the dog!", "katze mit hund", "zzz qqq xxx", "the house " * 30, "ÄÖ haus", "x", train["en"][0]]

    def plain_counts(t):
        own = " " + language_id.letters(t) + " "
        out = [0] * p.dims
        mul = lambda x, y: x * y & 0xFFFFFFFF
        for k in range(len(own)):
            h = mul(ord(own[k]), 0x9E3779B1)
            out[h >> 22] += 1
            if k + 1 < len(own):
                h = mul(h ^ mul(ord(own[k + 1]), 0x85EBCA6B), 0xC2B2AE35)
                out[h >> 22] += 1
            if k + 2 < len(own):
                out[mul(h ^ mul(ord(own[k + 2]), 0x27D4EB2F), 0x165667B1) >> 22] += 1
        return out

    n, seen = 24, [0] * p.dims
    for v in train.values():
        for t in v:
            seen = [a + (b > 0) for a, b in zip(seen, plain_counts(t))]
    lang, score, bad = language_id.predict(texts, m)
    for k, t in enumerate(texts):
        c = plain_counts(t)
        x = [(1 + math.log(v)) * (math.log((1 + n) / (1 + s)) + 1) if v else 0.0 for v, s in zip(c, seen)]
        norm = math.sqrt(sum(v * v for v in x))
        cosine = [sum(a * float(b) for a, b in zip(x, row)) / norm for row in m.matrix]
        best = max(range(len(cosine)), key=lambda j: cosine[j])
        assert lang[k] == m.langs[m.owner[best]] and score[k] == pytest.approx(max(0, cosine[best]), abs=1e-5)
        limit = np.interp(math.log2(max(1, sum(c) / 3)), range(language_id._POWERS), m.limits[m.owner[best]])
        assert bad[k] == (1 - cosine[best] > limit)
    assert bad[2] and not bad[6]


@pytest.mark.parametrize("part", [3, 4, 7, 64])
def test_grams_across_the_parts_of_a_long_text(monkeypatch, part):
    whole = language_id.gram_counts(language_id.letters("Hier, ist ein Text!  mit Wörtern"), 1 << 13)
    monkeypatch.setattr(language_id, "_CHUNK", part)
    assert (language_id.gram_counts(language_id.letters("Hier, ist ein Text!  mit Wörtern"), 1 << 13) == whole).all()


def test_equal_cosines_go_to_the_first_language():
    c = language_id.sparse(language_id.gram_counts("same text", 1 << 13))
    m = language_id.fit({"b": [c], "a": [c]}, language_id.LangParams())
    assert language_id.predict(["same text"], m)[0] == ["a"]


def test_languages_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op3_language_id(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").where("lang is not null"), "doc_id").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.99 and got.rejected.mean() < 0.02


# --- LM scoring


def _plain_scores(texts, targets, p):
    tok = [lm_score._TOKEN.findall((t or "").lower()) for t in texts]
    seq = [["<s>", *t] for t in tok]
    size, out = len({w for t in tok for w in t}) + 2, []
    models = []
    for own in ([s for s, k in zip(seq, targets) if k], seq):
        c, b, u = {}, {}, {}
        for s in own:
            for x, y in zip(s, s[1:]):
                c[y] = c.get(y, 0) + 1
                u[x] = u.get(x, 0) + 1
                b[x, y] = b.get((x, y), 0) + 1
        models.append((c, b, u, sum(c.values())))
    for s in seq:
        losses = []
        for c, b, u, whole in models:
            total_loss = 0.0
            for x, y in zip(s, s[1:]):
                p1 = (c.get(y, 0) + 0.5) / (whole + size / 2)
                total_loss -= math.log2(p.weight * b.get((x, y), 0) / u[x] + (1 - p.weight) * p1 if x in u else p1)
            losses.append(total_loss)
        n = len(s) - 1
        out.append((n, losses[0] / n, losses[1] / n) if n else (0, None, None))
    return out


@pytest.mark.parametrize("chunk", [1, 90, 1 << 22])
def test_lm_scores_equal_a_plain_version(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(lm_score, "_WHOLE", chunk)
    rng = random.Random(6)
    texts = ["the a " * 70_000] + [" ".join(rng.choice(["the", "cat", "x!", "Rare%d" % rng.randint(0, 40)]) for _ in range(rng.randint(0, 30))) for _ in range(40)] + [None, "", "once"]
    texts += texts[1:3]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i % 3 == 0)) for i in range(0, 46, 2)] + [(0, 0), (None, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in queries.op8_lm_score(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, (n, a, b) in enumerate(_plain_scores(texts, [i % 6 == 0 for i in range(46)], lm_score.LMParams())):
        assert got[i].n_tokens == n and (got[i].score is None) == (a is None)
        if n:
            assert got[i].target_loss == pytest.approx(a) and got[i].background_loss == pytest.approx(b) and got[i].score == pytest.approx(a - b)
        assert got[i].selected == (n > 0 and got[i].score < 0)


def test_lm_without_rows_or_targets(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    d = docs(spark, ["a b", None])
    assert sorted(r.n_tokens for r in lm_score.score(d, none, "quality", ["doc_id"]).collect()) == [0, 2]
    assert lm_score.score(d.limit(0), none, "quality", ["doc_id"]).count() == 0


# --- BPE


def test_bpe_equals_the_library(spark):
    rng = random.Random(1)
    parts = ["a", "b", "th", "e", " ", "  ", "\n", "ing", "é", "日", "🎉", "1", "23", "!", "..", "'s", "\r\n", "_", "Ã", "Â", "\x00", "<|endoftext|>", "<|endof", "　"]
    texts = [None, "", "a" * 5000, "ÃÂ" * 800, "<|endoftext|>", " \n\n x  "] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 120))) for _ in range(400)]
    d = docs(spark, texts).withColumn("n_tokens_", F.lit(1))
    lib = Tokenizer.from_file(PATH)
    got = {r.doc_id: r for r in bpe.encode(d, PATH, ["doc_id"], with_ids=True).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert list(got[i].ids) == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.decode(bpe.encode(d, PATH, ["doc_id"], with_ids=True), PATH, ["doc_id"]).collect()
    assert {r.doc_id: r.text for r in back} == {i: t or "" for i, t in enumerate(texts)}


def test_every_token_is_reached():
    """The walk takes a whole word that is a token as that token; so the merges have to make every token."""
    codec = bpe._codec(bpe.load_spec(PATH))
    lib = Tokenizer.from_file(PATH)
    words = [(b.decode(), i) for b, i in codec.merges.ids.items() if len(b) > 1 and _is_text(b)]
    whole = [(w, i) for w, i in words if codec.pieces(w) == [w]]
    assert len(whole) > 40_000
    assert [e.ids for e in lib.encode_batch([w for w, _ in whole], add_special_tokens=False)] == [[i] for _, i in whole]


def _is_text(b):
    try:
        b.decode()
        return True
    except UnicodeDecodeError:
        return False


def test_bpe_ids_of_bad_utf8_decode_as_the_library_does():
    codec, lib = bpe._codec(bpe.load_spec(PATH)), Tokenizer.from_file(PATH)
    rng = random.Random(2)
    for _ in range(200):
        ids = [rng.randrange(50_257) for _ in range(6)]
        assert codec.decode(np.array(ids, "<u4").tobytes()).decode() == lib.decode(ids, skip_special_tokens=False)
