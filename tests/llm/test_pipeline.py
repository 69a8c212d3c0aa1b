"""The pipeline's stages on a small corpus, against what each stage should do to it."""

import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from faultline.llm import shared, simhash


def _words(rng, stock, n):
    return " ".join(rng.choice(stock) for _ in range(n))


def test_pipeline(spark, tmp_path):
    rng = random.Random(12)
    english = "the cat dog house river walks under over green stone letter morning window people again other because table water light".split()
    german = "der hund katze haus fluss geht unter grün stein brief morgen fenster leute wieder andere weil tisch wasser licht ist".split()
    rows, labels = [], []
    for i in range(120):
        lang = "en" if i % 2 else "de"
        text = _words(rng, english if i % 2 else german, 80) + f" n{i}"
        if i < 30:
            text += " moronic scumbag"
        rows.append((i, text, lang, "s", len(text)))
        labels.append((i, 1, int(i < 30)))
    passage = _words(rng, english, 30)
    rows += [(200, rows[40][1], "de", "s", 0), (201, rows[41][1].upper().lower(), "en", "s", 0), (202, "?! 123", None, "s", 0), (203, None, None, None, None), (204, _words(rng, english, 40) + " " + passage, "en", "s", 0), (205, _words(rng, english, 60) + " scumbag moronic", "en", "s", 0)]
    rows += [(50, rows[50][1], "de", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit(1)).withColumn("fp", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = [r[0] for r in rows]
    gone = ({202, 203}, {*range(30), 205}, {200, 201, 50}, {204})
    for (name, stage), out in zip(corpus_pipeline.STAGES[:-1], gone):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "fp"]
        once = {50} if 50 in out else set()
        left = sorted([x for x in left if x not in out] + list(once))
        assert sorted(r.doc_id for r in docs.select("doc_id").collect()) == left, name
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    lib, text_of = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {r[0]: r[1] for r in rows}
    assert got == {i: len(lib.encode(text_of[i], add_special_tokens=False).ids) for i in left}


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_by_jaccard(spark, tmp_path):
    rng = random.Random(3)
    stock = [f"w{k}" for k in range(900)]
    rows = [(1000 + i, t) for i, t in enumerate(["", None, "one two", "one two", " "])]
    for i in range(60):
        words = [rng.choice(stock) for _ in range(150)]
        for j in range(4):
            rows.append((4 * i + j, " ".join(words)))
            for _ in range(rng.choice([1, 1, 2])):
                words[rng.randrange(150)] = "changed"
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for i, t in rows}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                lo, hi = sorted((root[a], root[b]))
                root = {k: lo if r == hi else r for k, r in root.items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, docs, str(tmp_path)).collect())
    assert got == sorted(set(root.values())) and len(got) < 100


def test_ring_is_of_simhash_bits():
    rng = np.random.default_rng(5)
    x, y, z = (simhash.ring_of(rng.integers(0, 1 << 63, 1, np.uint64)) for _ in range(3))
    rng = np.random.default_rng(5)
    three = np.concatenate([rng.integers(0, 1 << 63, 1, np.uint64) for _ in range(3)])
    assert (simhash.ring_of(three) == (x & y | y & z | x & z)).all() and (simhash.ring_of(three[:2]) == (x & y)).all()
    assert 1_150 < np.bitwise_count(x ^ y).sum() < 1_410 and len(x) == 40


def test_chains_meet_as_their_budget_says():
    rng = np.random.default_rng(6)
    for run in (5, 1_024):
        for kinds in (3, 1_000):
            key, c = np.sort(rng.integers(0, 3, 90)).astype(np.uint16), rng.integers(0, kinds, 90)
            after = np.array([3, 7, 0xFFFF, 0x1FFFF, 0xFFFFFFFFFF, 1 << 63], np.uint64)[rng.integers(0, 6, 90)]
            near = (np.bitwise_count(after[:, None] ^ after) <= simhash.CHAIN_MOST) & (c[:, None] != c) & (key[:, None] == key)
            simhash._RUN, before = run, simhash._RUN
            try:
                assert (simhash._met_in_runs(key, after, c) == near.any(axis=1)).all()
            finally:
                simhash._RUN = before


def test_a_large_family_is_compared_once(spark, monkeypatch):
    rng = random.Random(8)
    base, rows = [f"b{k}" for k in range(120)], []
    for i in range(240):  # most pairs are alike by 0.5 to 0.8 and do not connect; every sixth is near to the one before
        words = rows[-1][1].split() if i % 6 == 5 else base[:]
        for k in rng.sample(range(120), 1 if i % 6 == 5 else 4 + i % 3):
            words[k] = f"w{i}x{k}"
        rows.append((i, " ".join(words)))
    rows += [(1_000 + i, " ".join(f"r{rng.randrange(5_000)}" for _ in range(100))) for i in range(60)]
    sets = [set(simhash.shingles(t.encode()).tolist()) for _, t in rows]
    root = np.arange(len(rows))
    for a in range(len(rows)):
        for b in range(a):
            if root[a] != root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[root == max(root[a], root[b])] = min(root[a], root[b])
    met, staged = [], simhash.staged
    monkeypatch.setattr(simhash, "staged", lambda df, name, *more: (out := staged(df, name, *more), name in ("entries", "members", "met") and met.append(out.count()))[0])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in simhash.keep_similar_first(docs).collect())
    assert got == sorted({rows[k][0] for k in root}) and 60 < len(got) < 290
    assert sum(met) < 40 * len(rows)  # each start listed nearly all of the family before
    monkeypatch.setattr(simhash, "staged", staged)
    assert got == sorted(r.doc_id for r in simhash.keep_similar_first(docs, bucket=16, family=50).collect())


def test_similar_sets_one_against_many():
    rng = np.random.default_rng(9)
    sets = [np.unique(np.r_[rng.choice(60, 40, replace=False), rng.integers(100, 130, k % 5)]).astype(np.uint64) for k in range(50)] + [np.arange(4, dtype=np.uint64), np.arange(5, dtype=np.uint64)]
    sets += sets[:20]
    alike = simhash._similar_to(sets)
    for a in range(len(sets) - 1):
        for rows in (np.arange(a + 1, len(sets)), np.arange(a + 1, len(sets), 3)):
            assert alike(a, rows).tolist() == [simhash.similar(sets[a], sets[b]) for b in rows]


def test_short_texts_alike_by_exactly_the_least(spark):
    rows = []
    for i in range(40):
        words = [f"w{i}x{k}" for k in range(9)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:8]))]  # five shingles and four of them
        rows += [(1_000 + 2 * i, f"s{i} a b c d e f"), (1_001 + 2 * i, f"s{i} a b c d e")]  # three and two
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_similar_first(docs).collect()) == [*range(0, 80, 2), *range(1_000, 1_080)]


def test_the_driver_gives_back_what_its_jvm_allocated(spark):
    shared.give_back_driver(spark)
    assert shared._trim  # the JVM's own command was reached, not only the collection
