"""Byte-level BPE gives the library's ids, by folds in the plan, by the heap and with words folded beforehand, and decodes to the same bytes."""

import hashlib
import os

import numpy as np
import pyspark.sql.functions as F
import pytest

from stratalake.llm import byte_pairs
from stratalake.llm.vocabulary import tokenizer_path

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATH, PATTERN = tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
DATA = "/root/testdata/sf0.001/documents.parquet"
ODD = ["", None, " ", "a" * 1500, " " * 900 + "x", "　  x  y\n\n z", "don't we'll I'VE 's's", "日本語のテキスト、これは。" * 30, "x\u0000y\x85z q", "😀👍🏽 é é",
       "=" * 700, "1234567890" * 40, "﻿abc Ā ĀĀ", "The same words, the same WORDS.", "The same words, the same WORDS."]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_pairs.load_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def ranks():
    return byte_pairs.RankMap(byte_pairs.load_ranks(PATH))


def odd(spark):
    return spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").selectExpr("*", "'x' as ids", "1 as words", "2 as long", "3 as word")


@pytest.mark.parametrize("frequent", [1, 40, 1 << 16])
def test_ids_are_the_librarys(spark, library, ranks, frequent):
    got = {r.doc_id: r.ids for r in byte_pairs.encode(odd(spark), ranks, PATTERN, frequent).collect()}
    assert got == {k: library.encode_ordinary(t or "") for k, t in enumerate(ODD)}


def test_folds_in_the_plan_give_the_same(spark, library, ranks):
    encoded = byte_pairs.decode(byte_pairs.encode_in_plan(odd(spark), ranks, PATTERN, 40), ranks)
    for r in encoded.collect():
        assert r.ids == library.encode_ordinary(ODD[r.doc_id] or "") and bytes(r.decoded) == (ODD[r.doc_id] or "").encode()


def test_heap_equals_the_library(library, ranks):
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 10, 200, 3000):
        for alphabet in (b"a", b"ab", bytes(range(256)), "éüß".encode()):
            word = bytes(rng.choice(list(alphabet), n).tolist())
            assert byte_pairs.merge(word, ranks.ranks) == library._encode_single_piece(word)


def test_a_megabyte_without_a_break(spark, library, ranks):
    text = "ab" * 500_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = byte_pairs.encode(df, ranks, PATTERN).first()
    assert b"".join(ranks.pieces[k] for k in row.ids) == text.encode() and len(row.ids) == len(text) // 2  # "ab" is a piece, longer runs are none


def test_round_trip_on_documents(spark, library):
    if not os.path.exists(DATA):
        pytest.skip("no test data")
    docs = spark.read.parquet(DATA)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = byte_pairs.round_trip(docs, PATH, PATTERN).collect()
    assert len(got) == docs.count()
    for r in got:
        ids = np.array(library.encode_ordinary(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_empty_table_and_unknown_ids(spark, ranks):
    assert byte_pairs.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH, PATTERN).collect() == []
    row = byte_pairs.decode(spark.createDataFrame([([72, None, 10**6],)], "ids array<int>"), ranks).first()
    assert bytes(row.decoded) == ranks.pieces[72]


def test_ranks_must_count_from_nought():
    with pytest.raises(ValueError):
        byte_pairs.RankMap({b"a": 1})


def test_rare_words_are_folded_in_the_plan(spark, ranks):
    plan = byte_pairs.encode(odd(spark), ranks, PATTERN, 1)._jdf.queryExecution().analyzed().toString()
    assert "array_min" in plan and "collect_list" in plan


def test_long_words_by_windows(spark, ranks):
    words = ["a" * 1500, "=" * 700, "ab" * 300, "é" * 65, "-=" * 333]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    for r in df.select("word", byte_pairs.bound(ranks.literal(), lambda t: ranks.fold(t, F.col("word"))).alias("ids")).collect():
        assert r.ids == byte_pairs.merge(r.word.encode(), ranks.ranks)


def shuffled(spark) -> int:
    """Bytes that the session's stages have written to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(s.shuffleWriteBytes() for s in sc._jvm.scala.jdk.javaapi.CollectionConverters.asJava(stages))


def test_what_is_shuffled_is_packed(spark, ranks):
    texts = [" ".join(f"{w:07d}w" for w in range(k * 400, k * 400 + 1600)) for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8).cache()
    docs.count()
    held = shuffled(spark)
    assert byte_pairs.encode(docs, ranks, PATTERN, 1).selectExpr("sum(size(ids))").first()[0] > 0
    assert shuffled(spark) - held < 3 * sum(map(len, texts))  # 4.8 as rows of words and ids
    docs.unpersist()


def test_frequent_words_have_low_numbers(spark, ranks):
    docs = spark.createDataFrame([(1, "a b b b c c c c d d")], "doc_id long, text string")
    found = byte_pairs.folded_words(docs, ranks, PATTERN, 3).collect()
    assert sorted((r["count"], r["word"]) for r in found) == [(2, " d"), (3, " b"), (4, " c")]


def test_only_empty_texts(spark, ranks):
    df = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, byte_pairs.encode(df, ranks, PATTERN).collect())) == [(1, []), (2, [])]


def test_long_rare_words_end_a_block(spark, library, ranks, monkeypatch):
    monkeypatch.setattr(byte_pairs, "BLOCK_CHARS", 3000)
    texts = {k: chr(97 + k) * 2000 + " " + "xyz"[k % 3] * 9000 for k in range(8)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    assert byte_pairs._blocks(df, PATTERN, []).count() == 8
    got = {r.doc_id: r.ids for r in byte_pairs.encode(df, ranks, PATTERN, 1).collect()}
    assert got == {k: library.encode_ordinary(t) for k, t in texts.items()}
