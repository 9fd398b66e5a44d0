"""Phrases and clauses read token by token, directions and the verified search, against plain readings and by hand."""

import random

import numpy as np
import pyspark.sql.functions as F
import pytest

from stratalake.operators import directions, search, text


def of(spark, f, questions):
    df = spark.createDataFrame(list(enumerate(questions)), "k int, q string").select("k", f(F.col("q")).alias("x"))
    return [r["x"] for r in sorted(df.collect())]


def plain_phrases(question):
    """A reader with a finger on one word after another."""
    words, out, k = question.lower().split(" "), [], 0
    while k < len(words):
        if words[k] not in text.ARTICLES:
            k += 1
            continue
        taken = [words[k]]
        k += 1
        while k < len(words) and len(taken) < 4:
            taken.append(words[k])
            k += 1
            if taken[-1] in text.ENDS:
                break
        while len(taken) > 1 and taken[-1] in text.ENDS:
            taken.pop()
        if len(taken) > 1 and taken[1] not in text.SCENE and " ".join(taken) not in out:
            out.append(" ".join(taken))
    return out


def test_phrases_are_those_of_a_reader(spark):
    rng = random.Random(4)
    words = ["the", "a", "an", "red", "pot", "lid", "table", "on", "of", "and", "it", "open", "Arm", "drawer"]
    questions = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    assert of(spark, text.phrases, questions) == [plain_phrases(q) for q in questions]


def test_phrases_end_at_anything_but_white_space(spark):
    asked = ["Take the pot, then the\tred  lid.", "the pot-holder", "the", "the.pot", "", None, "put the green cup of tea on the large round tray"]
    assert of(spark, text.phrases, asked) == [["the pot", "the red lid"], ["the pot"], [], [], [], None, ["the green cup", "the large round tray"]]


def test_clauses_part_at_whole_words(spark):
    asked = ["open the lid and then stir it,then close the lid", "a sandy island", "go AND see it", "x y AND x y", "  spaced   out , here we go ", None]
    assert of(spark, text.clauses, asked) == [["open the lid and then stir it,then close the lid", "open the lid", "stir it", "close the lid"], ["a sandy island"], ["go AND see it", "see it"],
                                              ["x y AND x y", "x y", "x y"], ["spaced out , here we go", "spaced out", "here we go"], None]


PAIRS = [("close", "open", -0.9, 4), ("in", "out", -0.5, 9), ("fold", "unfold", -0.7, 3)]


def test_questions_are_turned_round(spark):
    asked = [(1, "Open the lid and fold in"), (2, "go out and in"), (3, "nothing here"), (4, None), (5, ""), (6, "open, open open"), (7, "unfold")]
    pairs = spark.createDataFrame(PAIRS, "a string, b string, far double, shared long")
    got = {r[0]: r[1] for r in directions.swapped(spark.createDataFrame(asked, "k int, q string"), "k", "q", pairs).collect()}
    assert got == {1: "open the lid and unfold in", 2: "go out and out", 6: "open, close open", 7: "fold"}
    assert directions.swapped(spark.createDataFrame(asked, "k int, q string"), "k", "q", pairs.where("false")).count() == 0


def test_a_lexicon_needs_distance_and_contexts(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    rng = np.random.default_rng(0)
    axis, other = np.eye(4)[0], np.eye(4)[1]
    base = rng.normal(size=4)
    terms = [("open", base + axis), ("close", base - axis), ("hot", base + other), ("cold", base - other), ("void", None)]
    docs = [(f"please {w} the {x} will {w} they {w}", ) for w in ("open", "close") for x in ("lid", "pot")] + [("hot soup",), ("cold soup",), (None,), ("",)]
    df = spark.createDataFrame([(t, None if v is None else v.tolist()) for t, v in terms], "term string, vec array<double>")
    body = spark.createDataFrame(docs, "text string")
    assert [tuple(r) for r in directions.lexicon(df, body, "text").select("a", "b", "shared").collect()] == [("close", "open", 3)]
    assert {(r.a, r.b) for r in directions.lexicon(df, body.union(spark.createDataFrame([("so hot so cold",)], "text string")), "text", contexts=1).collect()} == {("close", "open"), ("cold", "hot")}
    assert directions.lexicon(df.where("term = 'open'"), body, "text").count() == 0


def test_recordings_are_gated_by_content(spark):
    recordings = spark.createDataFrame([(1, 0, 9, [1.0, 0.0]), (1, 10, 19, [0.6, 0.8]), (2, 0, 9, [1.0, 0.0]), (2, 10, 19, [-1.0, 0.0])], "who int, r0 long, r1 long, vec array<double>")
    places = spark.createDataFrame([(1, 3, 5), (1, 12, 14), (2, 11, 12), (2, 8, 15), (2, 30, 31)], "who int, t0 long, t1 long")
    asked = spark.createDataFrame([([2.0, 1.0], [1.0, 1.0])], "vec array<double>, swap array<double>")
    got = [tuple(r) for r in directions.changing(places, recordings, "who", asked, 5).collect()]
    assert got == [(1, 0, 9, 1.0), (1, 10, 19, 0.6), (2, 10, 19, -1.0)]  # the place from 8 to 15 lies in no recording
    assert directions.changing(places, recordings, "who", asked.selectExpr("vec", "vec as swap"), 5).count() == 0


@pytest.mark.parametrize(("rows", "clauses", "each"), [(0, 1, 120), (10_000, 2, 60), (240_000, 2, 80), (10**9, 1, 256), (10**9, 40, 12), (100, 8, 15), (100, 60, 12)])
def test_budgets_follow_the_rows_down_to_a_floor(rows, clauses, each):
    assert search.clause_budget(rows, clauses) == each


def test_a_place_must_suit_every_clause(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    rows = [("r", k, 1.0 if k == 10 else 0.1, 0.0 if k == 10 else 0.1, None) for k in range(40)] + [("s", k, 0.6 if k == 5 else 0.0, 0.6 if k == 5 else 0.0, 1.0 if k == 20 else 0.0) for k in range(40)]
    df = spark.createDataFrame(rows, "who string, pos long, a double, b double, dir double").withColumn("tie", F.concat("who", F.lpad(F.col("pos").cast("string"), 3, "0")))
    best = lambda *more: search.verified(df, "who", "pos", ["a", "b"], {}, "tie", 0, 3, *more).first()
    assert best()["who"] == "s" and best()["t0"] <= 5 <= best()["t1"]
    none = search.verified(df.where("false"), "who", "pos", ["a", "b"], {}, "tie", 0, 3)
    assert none.count() == 0


def test_term_means_meet_in_blocks_and_parts(spark, monkeypatch):
    monkeypatch.setattr(directions, "PART", 9)
    monkeypatch.setattr(directions, "HELD", 5)
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice([f"w{k}" for k in range(60)], 12)) for _ in range(50)] + ["", None, "w1 W1!"]
    x = rng.normal(size=(53, 3))
    df = spark.createDataFrame([(t, v.tolist()) for t, v in zip(texts, x)] + [("w2 w3", None)], "text string, v array<double>")
    terms = spark.createDataFrame([(f"w{k}",) for k in range(55)] + [("absent",)], "term string")
    means = directions.term_means(df, terms, "text", "v")
    got = {r["term"]: r["vec"] for r in means.collect()}
    has = {f"w{k}": [i for i, t in enumerate(texts) if f"w{k}" in (t or "").lower().replace("!", "").split()] for k in range(55)}
    assert got.keys() == {t for t, at in has.items() if at} and all(np.allclose(v, x[has[t]].mean(0)) for t, v in got.items())
    assert "posexplode" not in means._jdf.queryExecution().analyzed().toString()  # sums stay arrays when they are shuffled
