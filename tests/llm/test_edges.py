"""What every operator gives for nulls, empty and very long texts, ties, repeats, empty tables and clashing columns."""

import hashlib

import pytest

from stratalake.llm import chat, fingerprints, licenses, media, ngram_join, packing, pieces, pii, quality, secrets
from stratalake.llm.vocabulary import tokenizer_path

LONG = "Ünï tok" * 30_000 + " mit license " + "word " * 40_000
ROWS = [(1, "Hello mit license. Mail a@b.co", 9, "x", 1), (1, "Hello mit license. Mail a@b.co", 9, "x", 1), (None, "no id", 9, "x", 1), (2, None, None, None, None),
        (3, "", 9, "x", 1), (4, " \n\t", 9, "x", 1), (5, LONG, 9, "x", 1), (6, "日本語 😀 \u0000 end", 9, "x", 1)]
SCHEMA = "doc_id long, text string, n long, score string, _guest int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def weights():
    import numpy as np

    return np.zeros(quality.DIMENSIONS + 1)


OPERATORS = {
    "pieces": lambda d: pieces.round_trip(d, tokenizer_path("piece_bpe_32k.model")),
    "join": lambda d: ngram_join.jaccard_components(d, 3, 9, 10),
    "quality": lambda d: quality.quality_scores(d, weights()),
    "licenses": licenses.scan_licenses,
    "pii": lambda d: pii.digest(pii.find_personal_data(d), pii.BASE),
    "media": lambda d: media.read_back(media.text_media(d)),
    "secrets": lambda d: pii.digest(secrets.find_secrets(d), secrets.BASE),
    "fingerprints": fingerprints.fingerprint_edits,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(docs, empty, name):
    got = OPERATORS[name](docs).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"]) if r["doc_id"] is not None else (False, 0) for r in got) == [(False, 0), *((True, k) for k in (1, 1, 2, 3, 4, 5, 6))]
    twins = [r for r in got if r["doc_id"] == 1]
    if name != "fingerprints":  # the last of two equal rows has another neighbour
        assert twins[0] == twins[1]
    by = {r["doc_id"]: r for r in got}
    for c in got[0].asDict():
        if c not in ("doc_id", "held_out", "component_id", "edited_sha256", "edited_fingerprint", "near_edited", "near_next"):
            assert by[2][c] == by[3][c], c  # null text counts as empty
    assert OPERATORS[name](empty).count() == 0


def test_packing_edges(docs, empty):
    got = packing.pack(docs, tokenizer_path("word_bpe_49k.json")).collect()
    assert packing.pack(empty, tokenizer_path("word_bpe_49k.json")).count() == 0
    assert [(r["length"], r["doc_tokens"]) for r in got if r["doc_id"] == 2] == [(1, 1)]
    assert sum(r["length"] for r in got if r["doc_id"] == 1) == 2 * next(r["doc_tokens"] for r in got if r["doc_id"] == 1)
    assert sum(r["length"] for r in got if r["doc_id"] == 5) == next(r["doc_tokens"] for r in got if r["doc_id"] == 5) > 40_000


def test_keeping_and_redacting_keep_the_columns(spark, docs, empty):
    import numpy as np

    high = np.append(np.zeros(quality.DIMENSIONS), 9.0)
    assert quality.keep_good(docs, high).count() == 8 and quality.keep_good(docs, -high).count() == 0
    df = spark.createDataFrame([(1, 'token = "abcdef123456"', 22), (2, None, 0), (3, "plain", 5)], "doc_id long, text string, n_chars long")
    got = sorted(map(tuple, secrets.redact_secrets(df).collect()))
    assert got == [(1, '[assign]"', 9), (2, None, 0), (3, "plain", 5)]
    for f in (lambda d: quality.keep_good(d, high), secrets.redact_secrets, ngram_join.one_of_each):
        assert f(empty).columns == empty.columns and f(empty).count() == 0


def test_chat_edges(spark):
    rows = [(1, 1, "assistant", "b<x>[INST]"), (1, 0, "user", None), (1, 1, "assistant", "b<x>[INST]"), (None, 5, None, "q"), (2, None, "user\nx", "a&lt;"), (3, 0, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 20 and got[1]["turns_sha256"] == sha("user\n\nassistant\nb<x>[INST]\nassistant\nb<x>[INST]\n")
    assert got[1]["loss_sha256"] == sha("b<x>[INST]" * 2) and got[None]["turns_sha256"] == sha("\nq\n") and got[2]["turns_sha256"] == sha("user\nx\na&lt;\n")
    assert got[3]["loss_chars"] == 0 and got[3]["loss_sha256"] == sha("")
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0
    texts = "".join(r["formatted"] for r in chat.format_conversations(df).where("conv_id = 1").orderBy("place").collect())
    assert texts.count("<|turn|>") == 3 and "[INST]" not in texts and "<x>" not in texts


def test_trees_choose_the_best_branch(spark):
    rows = [("a", None, 1.0), ("b", "a", 0.0), ("c", "a", 5.0), ("d", "c", 3.0), ("e", "c", 3.0), ("f", "gone", 2.0), ("x", "y", 1.0), ("y", "x", 1.0), ("z", "x", 1.0)]
    df = spark.createDataFrame(rows, "id string, parent string, score double")
    got = sorted((r["tree"], r["depth"], r["id"]) for r in chat.best_paths(df).collect())
    assert got == [("a", 0, "a"), ("a", 1, "c"), ("a", 2, "e"), ("f", 0, "f")]  # ties by id; cycles reach no root
    two = sorted((r["path"], r["depth"], r["id"]) for r in chat.best_paths(df, 2).where("tree = 'a'").collect())
    assert two == [("d", 0, "a"), ("d", 1, "c"), ("d", 2, "d"), ("e", 0, "a"), ("e", 1, "c"), ("e", 2, "e")]
    long = spark.range(700).selectExpr("id", "nullif(id, 0) - 1 as parent", "1.0 as score")
    assert chat.best_paths(long).count() == 700


def test_relational_encoding_equals_the_arrays(docs, empty):
    path = tokenizer_path("piece_bpe_32k.model")
    rows = lambda df: sorted(((r["doc_id"], list(r["ids"])) for r in df.collect()), key=repr)
    odd = docs.union(docs.sparkSession.createDataFrame([(7, "x" * 300 + " a▁b ▁▁ c", 1, "x", 1), (8, "  \n\n\t tail  ", 1, "x", 1)], SCHEMA))
    assert rows(pieces.relational(odd, path)) == rows(pieces.encode(odd, path))
    assert rows(pieces.relational(empty, path)) == []


def test_shape_of_a_long_word_is_that_of_the_whole_word():
    start = b"ab1-" * 16
    table = quality.WordFeatures()
    shape = lambda w: table[w] & 0xFFFFFFFF
    assert shape(start + b"x" * 100) != shape(start + b"X9" * 50) != shape(start)
    assert shape(start + b"x" * 100) == shape(start + b"y" * 7) and shape(b"aaB12") == shape(b"cD9")
