"""All ten operators on the same odd tables: empty, null, repeated and very long rows, columns whose names clash whatever their case."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from faultline.llm import bpe, chat, decontaminate, embedding, language_id, lm_score, queries, simhash, toxicity, url_filter, warc

PATH = public_tokenizers.path("byte_bpe_50k.json")
CLASH = ("Score", "PREDICTED", "fp", "_text", "_hash", "_id", "N_Tokens", "ids", "Fingerprint", "COMPONENT_ID", "lang_PRED", "Rejected", "_language", "_toxic", "w", "h1", "H2", "_judged", "Host", "_hits", "_rule", "Verdict", "selected", "window", "_first", "_size", "kept")
LONG = "the house and the dog " * 60_000


def _docs(spark):
    rows = [(1, "the cat sat on the mat with a dog", "en", "s"), (1, "the cat sat on the mat with a dog", "en", "s"), (2, None, None, None), (3, "", "en", None), (4, LONG, "en", "s"), (None, "no id", "en", "s"), (None, None, None, None), (5, " \t", None, "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def _clashing(df):
    return df.withColumns({c: F.lit("mine") for c in CLASH})


def _labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (4, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def _bench(spark):
    return spark.createDataFrame([(7, "sat on the mat"), (8, None), (None, "")], "item_id long, text string")


def _some(df, empty):
    return df.limit(0) if empty else df


def _but_text(df):
    return [c for c in df.columns if c != "text"]


def op1(spark, empty):
    pages = _clashing(spark.createDataFrame([(1, "https://Example.com/en/7"), (1, "https://Example.com/en/7"), (2, None), (3, ""), (None, "http://x/" + "free-" * 50_000)], "page_id long, url string"))
    return url_filter.judge_urls(_some(pages, empty), queries.RULES), 5


def op2(spark, empty):
    docs = _some(_clashing(_docs(spark)), empty)
    return toxicity.score(docs, toxicity.train(docs, _labels(spark), "toxic", F.lit(True)), docs.columns), 8


def op3(spark, empty):
    docs = _some(_clashing(_docs(spark)), empty)
    return language_id.identify(docs, language_id.train(docs, F.lit(True)), _but_text(docs)), 8


def op4(spark, empty):
    docs = _some(_clashing(_docs(spark)), empty)
    return simhash.near_duplicates(docs, _but_text(docs)), 8


def op4_first(spark, empty):
    return simhash.keep_first(_some(_clashing(_docs(spark)), empty)), 4


def op4_similar(spark, empty):
    return simhash.keep_similar_first(_some(_clashing(_docs(spark)), empty)), 4


def op5(spark, empty):
    return decontaminate.report(_some(_clashing(_docs(spark)), empty), _clashing(_bench(spark))), 8


def op5_clean(spark, empty):
    return decontaminate.clean(_some(_clashing(_docs(spark)), empty), _clashing(_bench(spark))), 6


def op6(spark, empty):
    pages = _clashing(spark.createDataFrame([(1, "http://a", "x"), (1, "http://a", "x"), (2, None, None), (3, "", ""), (4, "http://b", LONG), (None, "u", LONG)], "page_id long, url string, html string"))
    return warc.round_trip(_some(pages, empty)), 6


def op7(spark, empty):
    turns = _clashing(spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", LONG), (1, 1, "user", LONG), (1, 2, "assistant", ""), (2, None, None, None), (None, 0, "assistant", "a")], "conv_id long, turn long, role string, text string"))
    return chat.digest(chat.windows(_some(turns, empty))), 3


def op8(spark, empty):
    docs = _some(_clashing(_docs(spark)), empty)
    return lm_score.score(docs, _labels(spark), "quality", _but_text(docs)), 8


def op9(spark, empty):
    rows = _clashing(spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, []), (None, [1.0, 0.001]), (4, [0.0, 0.0]), (5, [1.0, None])], "vec_id long, embedding array<float>"))
    return embedding.near_duplicates(_some(rows, empty)), 7


def op10(spark, empty):
    docs = _some(_clashing(_docs(spark)), empty)
    return bpe.encode(docs, PATH, _but_text(docs), with_ids=True), 8


OPERATORS = (op1, op2, op3, op4, op4_first, op4_similar, op5, op5_clean, op6, op7, op8, op9, op10)


@pytest.mark.parametrize("operator", OPERATORS, ids=lambda f: f.__name__)
def test_odd_rows_and_clashing_columns(spark, operator):
    out, n = operator(spark, False)
    names = [c.lower() for c in out.columns]
    assert len(names) == len(set(names)) and len(out.collect()) == n
    out, _ = operator(spark, True)
    assert out.collect() == []


def test_the_session_is_left_as_it_was(spark):
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(k) for k in keys]
    simhash.keep_similar_first(_docs(spark)).count()
    lm_score.score(_docs(spark), _labels(spark), "quality", ["doc_id"]).count()
    assert [spark.conf.get(k) for k in keys] == before
