"""Two-tier search: against the exact way, with what it computes counted; and null vectors in vector search."""

import numpy as np
import pyspark.sql.functions as F
import pytest

from stratalake.operators import analytics, sharp
from stratalake.operators.vectors import nearest
from stratalake.sources.store import Store


@pytest.fixture
def made(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    rng = np.random.default_rng(5)
    full = rng.normal(size=(600, 12))
    rough = full + 0.25 * rng.normal(size=full.shape)
    df = spark.createDataFrame([(k, r.tolist(), f.tolist()) for k, (r, f) in enumerate(zip(rough, full))], "id long, r array<double>, f array<double>")
    return Store.create(spark, f"{tmp_path}/s"), df, full


def test_a_second_search_computes_nothing(spark, made):
    store, df, full = made
    asked, counted = df.where("id % 50 = 0"), []

    def teach(wanted):
        counted.append(wanted.count())
        return df.join(wanted.select("id"), "id", "left_semi").select("id", F.col("f").alias("vec"))

    ask = lambda q, **how: sharp.search(store, "kept", df.select("id", "r"), q, "id", "r", "f", teach, **how)
    first, fresh = ask(asked)
    assert fresh == counted[0] == sharp.shortlisted(df, asked, "id", "r", 48).select("match").distinct().count()
    second, again = ask(asked)
    assert again == 0 and len(counted) == 1
    rows = lambda x: sorted(map(tuple, x.collect()))
    assert rows(first) == rows(second)
    unit = full / np.linalg.norm(full, axis=1, keepdims=True)
    exact = {k: set(np.argsort(-(unit @ unit[k]))[:10].tolist()) for k in range(0, 600, 50)}
    hits = {k: {r.match for r in second.collect() if r.key == k} for k in exact}
    assert np.mean([len(hits[k] & exact[k]) / 10 for k in exact]) >= 0.9
    other, more = ask(df.where("id % 50 in (0, 1)"))
    assert 0 < more < 600 and counted[1] == more and store.table("kept").read().count() == fresh + more
    whole, rest = ask(asked, shortlist=600)
    assert rest == 600 - fresh - more and {r.key: set() for r in whole.collect()}.keys() == exact.keys()
    assert {(r.key, r.match) for r in whole.collect()} == {(k, m) for k, ms in exact.items() for m in ms}


def test_odd_questions(spark, made):
    store, df, _ = made
    nothing = lambda wanted: wanted.select("id", F.lit(None).cast("array<double>").alias("vec"))
    found, fresh = sharp.search(store, "none", df.select("id", "r"), df.where("id < 3"), "id", "r", "f", nothing)
    assert (found.count(), fresh) == (0, 0)
    found, fresh = sharp.search(store, "none", df.select("id", "r"), df.where("false"), "id", "r", "f", nothing)
    assert (found.count(), fresh) == (0, 0)


def test_null_and_uneven_vectors_match_nothing(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, None), (4, [1.0, 0.0, 0.0]), (5, [0.0, 1.0]), (6, [1.0, 0.0, 0.1])]
    df = spark.createDataFrame(rows, "k long, v array<double>")
    got = sorted((r.key, r.match, r["rank"]) for r in nearest(df, df, "k", "v", 2).collect())
    assert got == [(1, 1, 1), (1, 2, 2), (2, 1, 2), (2, 2, 1), (4, 4, 1), (4, 6, 2), (5, 2, 2), (5, 5, 1), (6, 4, 2), (6, 6, 1)]
    both = spark.createDataFrame([(1, [1.0], [1.0]), (2, [-1.0], [-1.0]), (3, None, [1.0]), (4, [1.0, 2.0], [1.0])], "k long, a array<double>, b array<double>")
    assert analytics.first_hit_rate(both, "k", "a", "b").first()["rate"] == 1.0
