"""SimHash, decontamination, WARC, chat windows and embeddings, on small tables and against brute force."""

import base64
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from faultline.llm import chat, decontaminate, embedding, shared, simhash, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOC).withColumn("_text", F.lit("clash")).withColumn("fp", F.lit(1))


# --- shared


def test_components_of_random_graphs_and_a_long_path(spark):
    rng = random.Random(4)
    path = list(range(100, 164))
    rng.shuffle(path)
    links = [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + list(zip(path, path[1:])) + [(7, 7)]
    got = {r.node: r.component for r in shared.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {}
    for a, b in links:
        for x in (a, b):
            want.setdefault(x, {x})
        if want[a] is not want[b]:
            want[a] |= want[b]
            for x in want[b]:
                want[x] = want[a]
    assert got == {x: min(s) for x, s in want.items() if len(s) > 1}
    assert shared.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- SimHash


def _fp(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    rng = random.Random(2)
    for text in [None, "", " \t", "A", "a b c", "É É É É É", "x\x1cy z\x0bw q", " ".join(rng.choice("abcdef") for _ in range(300)), "word " * 70_000]:
        assert simhash.fingerprint(None if text is None else text.encode()) == _fp(text)


def test_chains_miss_no_link_and_hold_their_budgets():
    rng = random.Random(9)
    chains = np.array(simhash.CHAINS, np.uint64)
    for _ in range(20_000):
        x = sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6)))
        own = [i for i, m in enumerate(simhash.MASKS) if not x & m]
        passed = [bool(simhash.within(np.array([x], np.uint64), chains[[i]])[0]) for i in own]
        assert any(passed) == (x.bit_count() <= 4)
        for i, ok in zip(own, passed):
            assert ok == (x.bit_count() <= 4 and all((x & c).bit_count() <= k for k, c in zip((1, 2, 3), simhash.CHAINS[i])))


def _components(fps, most=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("bucket", [8_192, 4])
def test_links_connect_what_brute_force_connects(spark, bucket):
    rng = random.Random(bucket)
    base = [rng.getrandbits(64) for _ in range(12)] + [0]
    fps = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(25)})
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    comps = {r.node: r.component for r in shared.connected_components(simhash.fingerprint_links(df, bucket)).collect()}
    got = [comps.get(simhash._signed(x), simhash._signed(x)) for x in fps]
    want = _components(fps)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_near_duplicates_on_odd_rows(spark):
    rng = random.Random(8)
    long = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randint(0, 50)) for _ in range(400)) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(long)] + [(10, long[0]), (11, long[0] + " end"), (12, None), (13, ""), (14, " \n"), (None, long[1]), (3, long[4]), (3, long[4]), (None, "no id at all here"), (20, "x" * 500_000)]
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    fps = [_fp(t) for _, t in rows]
    want = _components(fps)
    least = {}
    for (i, _), c in zip(rows, want):
        least[c] = min([x for x in (least.get(c), i) if x is not None], default=None)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got if r.doc_id is not None) == sorted((i, f"{f:016x}", least[c]) for (i, _), f, c in zip(rows, fps, want) if i is not None)
    kept = simhash.keep_first(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns and kept.count() == len(set(want))
    assert simhash.near_duplicates(docs(spark, []).limit(0)).count() == 0 == simhash.keep_first(docs(spark, []).limit(0)).count()


# --- decontamination


def _brute(docs_, items, n=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    win = [(i, tuple(w[k : k + min(n, len(w))])) for i, t in items for w in [split(t)] if w for k in range(len(w) - min(n, len(w)) + 1)]
    out = []
    for i, t in docs_:
        w, hit, own = split(t), set(), set()
        for item, x in win:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    if item is not None:
                        own.add(item)
        out.append((i, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(map(str, own))).encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(6)
    word = lambda: rng.choice("ab") + rng.choice(["", "É", "1"])
    items = [(k, " ".join(word() for _ in range(rng.choice([0, 1, 3, 10, 11, 14])))) for k in range(12)] + [(None, "q r s"), (3, "zz"), (50, None), (10, "one two three four five six seven eight nine ten eleven twelve")]
    rows = [(k, " ".join(word() for _ in range(rng.randint(0, 40)))) for k in range(30)]
    rows += [(100, None), (101, ""), (102, "!!"), (103, "Q-R_s, x"), (104, "ZZ zz"), (104, "ZZ zz"), (None, "q r s"), (105, "zero one two three four five six seven eight nine ten eleven x one"), (105, "other"), (106, "k " * 200_000)]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("w", F.lit(1))
    got = decontaminate.report(docs(spark, rows).withColumn("w", F.lit(1)), bench).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    order = lambda x: (x[0] is None, *map(str, x))
    assert sorted(map(tuple, got), key=order) == sorted(_brute(rows, items), key=order)
    clean = decontaminate.clean(docs(spark, rows), bench)
    assert sorted(str(r.doc_id) for r in clean.select("doc_id").collect()) == sorted(str(b[0]) for b in _brute(rows, items) if not b[5])
    for most in (40, 3):  # more than a broadcast may hold: hashes are met first, then looked up in shares
        got = decontaminate.report(docs(spark, rows).withColumn("w", F.lit(1)), bench, most=most).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
        assert sorted(map(tuple, got), key=order) == sorted(_brute(rows, items), key=order)
    plan = decontaminate.marks(docs(spark, rows), bench, most=3)[0]._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\([^)]*\bw#", plan)
    texts = decontaminate.report(docs(spark, rows), bench.select(F.concat(F.lit("i"), "item_id").alias("item_id"), "text"))
    assert texts.where("contaminated").count() == sum(b[5] for b in _brute(rows, items))
    cut = {r.doc_id: r.text for r in decontaminate.cut(docs(spark, rows), bench).collect()}
    assert cut[103] == "x" and cut[104] == "" and cut[105] in ("zero x one", "other")
    none = bench.limit(0)
    assert decontaminate.report(docs(spark, rows), none).where("contaminated").count() == 0
    assert decontaminate.report(docs(spark, []).limit(0), bench).count() == 0


# --- WARC


def test_archives(spark, tmp_path):
    rows = [(5, "http://a/1", "<p>é</p>"), (2, "http://a/2\r\nX: y", "<p>é</p>"), (7, None, None), (8, "http://b", ""), (9, "http://c", "z" * 200_000), (9, "http://c", "z" * 200_000), (None, "http://d", "<p>é</p>"), (None, "u", "only here\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(0))
    got = warc.round_trip(pages).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = []
    for i, _, t in rows:
        ids = [j for j, _, u in rows if (u or "") == (t or "") and j is not None]
        least = min(ids, default=None)
        again = least is not None and i != least
        want.append((i, len((t or "").encode()), digest(t), "revisit" if again else "response", least if again else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert {r.record_type for r in warc.round_trip(pages, dedup_bytes=10**6).collect()} == {"response"}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_picked_records_are_read_by_their_ranges(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"{i} " * 50) for i in range(300)], "page_id long, url string, html string")
    index = warc.write(pages, str(tmp_path / "w"), roll_bytes=4_000)
    assert index.select("archive").distinct().count() > 3
    got = warc.read(index.where("page_id % 7 = 0"), str(tmp_path / "w"), gap=0).collect()
    assert {r.page_id: r.payload.decode() for r in got} == {i: f"{i} " * 50 for i in range(0, 300, 7)}
    assert all(r.target_uri == f"http://a/{r.page_id}" for r in got)
    mixed = index.orderBy(F.rand(3)).repartition(5)
    assert sorted(r.page_id for r in warc.read(mixed, str(tmp_path / "w"), read_bytes=3_000).collect()) == list(range(300))


def test_large_pages_and_what_revisits_refer_to(spark, tmp_path):
    rng = random.Random(1)
    pages = spark.range(1_024).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a/"), "id").alias("url"), F.concat(F.col("id").cast("string"), F.repeat(F.lit("some page "), 100_000)).alias("html"))
    pages = pages.unionByName(pages.where("page_id = 7").withColumn("page_id", F.lit(5_000).cast("long")).withColumn("url", F.lit("http://again")))
    index = warc.write(pages, str(tmp_path / "w"), date="2001-02-03T04:05:06Z")
    got = warc.read(index, str(tmp_path / "w")).select("page_id", "record_type", F.octet_length("payload").alias("n")).collect()
    assert len(got) == 1_025 and all(r.n == (len(str(r.page_id)) + 10**6 if r.record_type == "response" else 0) for r in got)
    row = index.where("page_id = 5000").first()
    raw = (tmp_path / "w" / "archives" / row.archive).read_bytes()
    import zlib

    headers, _ = warc.parse_record(zlib.decompress(raw[row.offset : row.offset + row.length], 31))
    assert (headers["warc-type"], headers["warc-refers-to-target-uri"], headers["warc-refers-to-date"]) == ("revisit", "http://a/7", "2001-02-03T04:05:06Z")
    start = zlib.decompressobj(31)
    assert warc.parse_record(start.decompress(raw))[0]["warc-type"] == "warcinfo" and len(raw) - len(start.unused_data) <= index.where(F.col("archive") == row.archive).agg(F.min("offset")).first()[0]


# --- chat


@pytest.mark.parametrize("params", [chat.ChatParams(), chat.ChatParams(budget=60, history=25)])
def test_chat_round_trip(spark, params):
    rng = random.Random(7)
    bits = ["</s>", "[INST]", "\\", "<|end|>\n", "<|turn:user|>\n", "x", " ", "\n", "é🎉", "<", "|>", "<|", "<<SYS>>", "\\<|", ""]
    rows = []
    for c in range(12):
        n = rng.randint(1, 14)
        for k in range(n):
            role = "system" if k == 0 and c % 3 == 0 else rng.choice(["user", "assistant", "assistant", "to|>ol", None])
            rows.append((c, k, role, rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))])))
    rows += [(None, 0, "assistant", "no id"), (20, None, "user", "a"), (20, None, "user", "a"), (20, 1, "assistant", "w" * 100_000), (20, 1, "assistant", "v")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1))
    made = chat.windows(df, params)
    got = {r.conv_id: r for r in chat.digest(made).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=key)
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert (got[c].n_turns, got[c].loss_chars) == (len(own), len(loss))
        assert got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    for r in made.collect():
        turns = r.formatted.split("<|end|>\n")[:-1]
        assert 0 < len(turns) - r.n_repeated and all(t.startswith("<|turn:") for t in turns)
        assert r.over_budget == (r.n_tokens > params.budget)
        if params.budget == 60 and r.window and r.conv_id in (0, 3, 6, 9):
            assert turns[0].startswith("<|turn:system|>")
    assert chat.digest(chat.windows(df.limit(0))).count() == 0


@pytest.mark.parametrize("history", [0, 256, 700])
def test_windows_hold_the_budget(spark, history):
    """Every window is within the budget or a single turn too long by itself; history is as long as allowed."""
    rng = random.Random(history)
    rows = []
    for c in range(30):
        rows += [(c, k, "system" if k == 0 and c % 2 else ("user", "assistant")[k % 2], f"{c}.{k} " + "y" * rng.choice([5, 40, 400, 1_500, 2_600, 9_000 if c < 3 else 10])) for k in range(rng.randint(1, 40))]
    p = chat.ChatParams(budget=2_048, history=history)
    made = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), p).collect()
    tokens = {(c, k): -(-len(t.encode()) // 4) + 4 for c, k, _, t in rows}
    owned = []
    for r in made:
        turns = [tuple(map(int, t.split("\n", 1)[1].split(" ")[0].split("."))) for t in r.formatted.split("<|end|>\n")[:-1]]
        own, repeats = turns[r.n_repeated :], turns[: r.n_repeated]
        owned += own
        assert r.n_tokens == sum(tokens[t] for t in turns)
        if r.n_tokens > p.budget:
            system = tokens[own[0][0], 0] if own[0][0] % 2 else 0
            assert r.over_budget and (system > p.budget * 3 // 4 - history or len(own) == 1 and tokens[own[0]] > p.budget - history - system)
        past = [t for t in repeats if t[1] or not own[0][0] % 2]
        assert past == [(own[0][0], k) for k in range(own[0][1] - len(past), own[0][1])] and sum(tokens[t] for t in past) <= history
        before = (own[0][0], own[0][1] - len(past) - 1)
        if before[1] >= own[0][0] % 2:
            assert sum(tokens[t] for t in past) + tokens[before] > history
    assert sorted(owned) == sorted(tokens)


# --- embeddings


def test_least_count_keeps_its_recall():
    p = embedding.ProjectionParams()
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    z = p.cosine * x + np.sqrt(1 - p.cosine**2) * y
    a, b = embedding.steps(x, p), embedding.steps(z, p)
    count = (np.abs(a.astype(int) - b.astype(int)) <= embedding._HALF + 1).sum(axis=0)
    assert (count >= embedding.least_count(p)).mean() > 0.999
    maps = embedding.window_bitmaps(b[:, :300])
    whole = (np.abs(a[:, :200, None].astype(int) - b[:, None, :300].astype(int)) <= embedding._HALF + 1).sum(axis=0)
    for least in (1, 16, 31, 38, 47, 48):
        met = np.zeros_like(whole, bool)
        met[embedding.collided(a[:, :200], maps, least)] = True
        assert (met == (whole >= least)).all()


@pytest.mark.parametrize("dims", [8, 64, 384])
def test_recall_against_brute_force(spark, dims):
    rng = np.random.default_rng(dims)
    base = rng.normal(size=(300, dims))
    v = np.concatenate([base, base + rng.normal(size=base.shape) * 0.32, base + rng.normal(size=base.shape) * 0.25])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    links = (u @ u.T >= 0.95).sum(axis=1) - 1
    df = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    for p in (embedding.ProjectionParams(block=256), embedding.ProjectionParams(block=200, recall=1, task_blocks=1)):
        got = {r.vec_id: r.n_links for r in embedding.near_duplicates(df, p).collect()}
        found = sum(got.values()) / links.sum()
        assert all(got[k] <= n for k, n in enumerate(links)) and found >= (0.99 if p.recall < 1 else 1)


@pytest.mark.parametrize("task_blocks", [64, 1])
def test_embeddings_equal_brute_force(spark, task_blocks):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    vecs = [list(map(float, b + rng.normal(size=16) * s)) for b in base for s in (0, 0, 0.08, 0.1, 0.3)]
    rows = [(i, v, 0) for i, v in enumerate(vecs)] + [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] + [1.0] * 15, 0), (903, [None] * 16, 0), (904, [], 0), (905, vecs[0][:8], 0), (906, [1e30] * 16, 0), (907, [1e-30] * 16, 0), (908, [float("inf")] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(0))
    got = {r.vec_id: r for r in embedding.near_duplicates(df, embedding.ProjectionParams(block=32, task_blocks=task_blocks)).collect()}
    ids = [i for i in range(len(vecs))] + [906, 907]
    m = np.array([np.asarray(v, np.float32).astype(float) for i, v, _ in rows if i in ids])
    m /= np.abs(m).max(axis=1, keepdims=True)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    link = m @ m.T >= 0.95
    np.fill_diagonal(link, False)
    label = np.array(ids)
    for _ in range(len(ids)):
        label = np.array([min(label[k], *label[link[k]]) if link[k].any() else label[k] for k in range(len(ids))])
    assert len(got) == len(rows)
    for k, i in enumerate(ids):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (link[k].sum(), label[k], label[k] == i)
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in (900, 901, 902, 903, 904, 905, 908))
    assert embedding.near_duplicates(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, [1e-60, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (None, [2.0, 0.0]), (None, [0.0, 1.0]), (None, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted(map(str, (tuple(r) for r in embedding.near_duplicates(odd).collect())))
    assert got == sorted(map(str, [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (None, 3, 1, False), (None, 1, None, True), (None, 1, None, True)]))
