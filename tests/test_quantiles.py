"""Exact quantiles, cuts and the operators that stand on them, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalake.functions import quantiles as module
from stratalake.functions.quantiles import quantiles
from stratalake.operators import analytics, cuts, text


def naive_fit(values, mode, q=99.0):
    s = np.sort(np.array(values, float))
    if mode == "quantile":
        cut = np.percentile(s, q)
    elif mode == "knee":
        part = s[int(0.05 * len(s)) : int(0.95 * len(s))]
        at = int(np.argmax(np.diff(part)))
        cut = (part[at] + part[at + 1]) / 2
    else:
        bins = min(256, max(16, len(s) // 8))
        width = (s[-1] - s[0]) / bins
        place = np.minimum(np.floor((s - s[0]) / (s[-1] - s[0]) * bins), bins - 1)
        best = None
        for b in range(bins - 1):
            low, high = place[place <= b], place[place > b]
            between = len(low) * len(high) * (high.mean() - low.mean()) ** 2
            if best is None or between > best[0] * (1 + 1e-12):
                best = (between, s[0] + (b + 1) * width)
        cut = best[1]
    below, above = s[s <= cut], s[s > cut]
    gap = (above.mean() - below.mean()) / (s.std() + 1e-12) if len(below) and len(above) else 0.0
    return len(s), cut, gap, len(below) / len(s)


@pytest.mark.parametrize("accuracy", [20_000, 100])
def test_quantiles_equal_sorted_values(spark, monkeypatch, accuracy):
    """With 100 steps of the sketch the keys of 3000 rows and more take the way of bounds on both sides."""
    monkeypatch.setattr(module, "ACCURACY", accuracy)
    rng = np.random.default_rng(3)
    kinds = {"even": rng.normal(size=3000), "ties": rng.integers(0, 5, 3000).astype(float), "one": np.ones(3000), "few": rng.normal(size=3), "skew": rng.pareto(0.5, 5000)}
    rows = [(k, float(x)) for k, v in kinds.items() for x in v] + [("null", None), ("few", None), ("few", float("nan")), (None, 4.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    shares = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.913, "e": 1.0}
    got = {r["k"]: r for r in quantiles(df, "v", shares, ["k"]).collect()}
    assert set(got) == {*kinds, None}
    for k, v in kinds.items():
        assert got[k]["n"] == len(v)
        assert [got[k][name] for name in shares] == pytest.approx([np.quantile(v, s) for s in shares.values()], rel=1e-12)
    assert got[None]["c"] == 4.0
    whole = quantiles(df, "v", shares).first()
    every = np.concatenate([*kinds.values(), [4.0]])
    assert [whole[name] for name in shares] == pytest.approx([np.quantile(every, s) for s in shares.values()], rel=1e-12)


def test_quantiles_of_nothing(spark):
    r = quantiles(spark.createDataFrame([], "v double"), "v", {"m": 0.5}).first()
    assert (r["n"], r["m"]) == (0, None)


@pytest.mark.parametrize("mode", ["knee", "quantile", "otsu"])
def test_fit_cut(spark, mode):
    rng = np.random.default_rng(5)
    for v in ([*rng.normal(0, 1, 300), *rng.normal(9, 1, 200)], rng.uniform(size=41), [1.0, 1, 1, 1, 1, 1, 1, 1, 1, 2]):
        v = [float(x) for x in v]
        got = cuts.fit_cut(spark.createDataFrame([(x,) for x in [*v, None, float("nan")]], "v double"), "v", mode).first()
        assert list(got) == pytest.approx(list(naive_fit(v, mode)), abs=6e-4)


def test_fit_cut_without_structure(spark):
    few = spark.createDataFrame([(float(x),) for x in range(7)], "v double")
    same = spark.createDataFrame([(2.0,)] * 20, "v double")
    for mode in ("knee", "quantile", "otsu"):
        assert list(cuts.fit_cut(few, "v", mode).first()) == [7, None, None, None]
    assert list(cuts.fit_cut(same, "v").first()) == [20, 2.0, 0.0, 1.0]
    assert list(cuts.fit_cut(same, "v", "otsu").first()) == [20, None, None, None]
    assert list(cuts.fit_cut(spark.createDataFrame([], "v double"), "v").first()) == [0, None, None, None]
    with pytest.raises(ValueError):
        cuts.fit_cut(few, "v", "other")


def test_lag_changes(spark):
    rng = np.random.default_rng(1)
    keys = {1: rng.normal(size=(20, 4)), 2: rng.normal(size=(6, 4)), 3: rng.normal(size=(2, 4))}
    unit = {k: x / np.linalg.norm(x, axis=1, keepdims=True) for k, x in keys.items()}
    far = {lag: {(k, i): 1 - x[i] @ x[i - lag] for k, x in unit.items() for i in range(lag, len(x))} for lag in (1, 2, 4, 8)}
    want = {(k, i): 0.0 for k, x in keys.items() for i in range(len(x))}
    for lag, found in far.items():
        middle = np.median(list(found.values()))
        for (k, i), d in found.items():
            if len(keys[k]) > 2:
                want[k, i - (lag - 1) // 2] += d / middle
    df = spark.createDataFrame([(k, i, x.tolist()) for k, v in keys.items() for i, x in enumerate(v)], "k int, i int, v array<double>")
    got = {(r["k"], r["i"]): r["pyramid"] for r in analytics.lag_changes(df, ["k"], "i", "v").collect()}
    assert got == pytest.approx(want)


def test_frozen(spark):
    still, other = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, i, v) for i, v in enumerate([still, still, still, other, still, other, other])] + [(2, 0, still), (2, 1, still)]
    df = spark.createDataFrame(rows, "k int, i int, v array<double>")
    for at in (0.9, None):
        assert sorted(map(tuple, analytics.frozen(df, ["k"], "i", "v", at).collect())) == [(1, 0, 2), (1, 5, 6)]


def test_changed(spark):
    a = [[1.0, 0.0]] * 6
    b = [[1.0, 0.0]] * 3 + [[0.0, 1.0]] + [[1.0, 0.0]] * 3
    rows = [(1, s, i, v) for s, side in enumerate((a, b)) for i, v in enumerate(side)]
    path = analytics.aligned_path(spark.createDataFrame(rows, "k int, side int, i int, v array<double>"), ["k"], "side", "i", "v")
    assert {r["j"] for r in analytics.changed(path).collect()} == {3}
    assert {r["j"] for r in analytics.changed(path, 0.5).collect()} == {3}
    assert analytics.changed(path.where("distance < 0.5")).count() == 0


def test_first_hit_rate(spark, monkeypatch):
    monkeypatch.setattr(analytics, "BLOCK", 16)
    rng = np.random.default_rng(2)
    a = rng.normal(size=(50, 3))
    b = a + rng.normal(size=(50, 3))
    df = spark.createDataFrame([(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(a, b))], "i long, a array<double>, b array<double>")
    assert analytics.first_hit_rate(df, "i", "a", "b").first()[0] == pytest.approx(((a @ b.T).argmax(1) == np.arange(50)).mean())
    assert analytics.first_hit_rate(df.where("i = 0"), "i", "a", "b").first()[0] is None


def test_clauses_and_phrases(spark):
    def of(f, q):
        return spark.createDataFrame([(q,)], "q string").select(f(F.col("q")).alias("x")).first()[0]
    q = "put a  green object in the drawer and then close it, slowly"
    assert of(text.clauses, q) == ["put a green object in the drawer and then close it, slowly", "put a green object in the drawer", "close it"]
    assert of(text.clauses, "open it") == ["open it"]
    assert of(text.clauses, "") == [""]
    assert of(text.clauses, "the sand then the band") == ["the sand then the band", "the sand", "the band"]
    assert of(text.phrases, "Put the eggplant into the red pot on a table, then the eggplant") == ["the eggplant", "the red pot"]
    assert of(text.phrases, "pick it up") == []
