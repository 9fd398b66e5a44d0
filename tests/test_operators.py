import random

import numpy as np
import pyspark.sql.functions as F
import pytest

from stratalake.functions import scalar
from stratalake.operators import cuts, intervals, islands, ranking, sequence
from stratalake.operators import vectors as vec


def naive_split(v, anchor=None):
    v = np.array(v, float)
    if len(v) < 2 or np.ptp(v) <= 1e-5:
        return None
    b = np.minimum(np.floor((v - v.min()) / np.ptp(v) * 64), 63)
    best, at = -1, None
    for k in range(63):
        mid = v.min() + (np.arange(64) + 0.5) * np.ptp(v) / 64
        c = np.array([(b == i).sum() for i in range(64)])
        w0, w1 = c[: k + 1].sum(), c[k + 1 :].sum()
        if w0 and w1:
            m0, m1 = (c * mid)[: k + 1].sum() / w0, (c * mid)[k + 1 :].sum() / w1
            if round(w0 * w1 * (m0 - m1) ** 2, 6) > best:
                best, at = round(w0 * w1 * (m0 - m1) ** 2, 6), mid[k]
    lo, hi = v[v <= at], v[v > at]
    gap = hi.mean() - lo.mean()
    if gap <= lo.std() + hi.std() or anchor is not None and min(abs(lo.mean() - anchor), abs(hi.mean() - anchor)) >= gap:
        return None
    return (lo.mean() + hi.mean()) / 2


@pytest.mark.parametrize("seed", range(4))
def test_split_equals_a_naive_one(spark, seed):
    rng = random.Random(seed)
    v = [rng.gauss(0, 1) for _ in range(80)] + [rng.gauss(6, 1 + seed) for _ in range(30)]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    for anchor in (None, 0.0, 40.0):
        got, want = cuts.split(df, "v", anchor).first()[0], naive_split(v, anchor)
        assert got == want or got == pytest.approx(want)


def test_split_has_none_for_one_group(spark):
    for v in ([], [1.0], [2.0] * 9, [None, None]):
        assert cuts.split(spark.createDataFrame([(x,) for x in v], "v double"), "v").first()[0] is None


def test_asof_resample_and_ties(spark):
    s = spark.createDataFrame([("a", 0, 1.0), ("a", 10, 2.0)], "k string, t long, v double")
    assert sorted(map(tuple, intervals.resample(s, ["k"], "t", "v", 5).collect())) == [("a", 0, 1.0), ("a", 5, 1.0), ("a", 10, 2.0)]
    assert sorted(map(tuple, intervals.resample(s, ["k"], "t", "v", 5, "linear").collect())) == [("a", 0, 1.0), ("a", 5, 1.5), ("a", 10, 2.0)]


def test_range_join_equals_all_pairs(spark):
    rng = random.Random(1)
    make = lambda n: [(i, rng.randrange(3), a := rng.randrange(-50, 300), a + rng.choice([0, 1, 9, 80])) for i in range(n)]
    x, y = make(60), make(50)
    a, b = spark.createDataFrame(x, "i long, k long, a0 long, a1 long"), spark.createDataFrame(y, "j long, k long, b0 long, b1 long")
    want = {(p[0], q[0]) for p in x for q in y if p[1] == q[1] and p[3] >= q[2] and p[2] <= q[3]}
    got = intervals.range_join(a, b, ["k"], ("a0", "a1"), ("b0", "b1"), 16).select("i", "j").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    left = intervals.range_join(a, b, ["k"], ("a0", "a1"), ("b0", "b1"), 16, "left_anti").collect()
    assert sorted(r[0] for r in left) == sorted({p[0] for p in x} - {i for i, _ in want})


def test_touching_spans_merge_unless_strict(spark):
    df = spark.createDataFrame([("r", 0, 5), ("r", 5, 8), ("r", 20, 21), ("r", 1, 2)], "k string, a long, b long")
    count = lambda strict: islands.merge_spans(df, ["k"], "a", "b", strict=strict).select("island").distinct().count()
    assert (count(False), count(True)) == (2, 3)


def test_abstaining_scores_get_the_middle_rank(spark):
    df = spark.createDataFrame([(1, 0.9), (2, None), (3, 0.1)], "id long, s double")
    assert [r["r"] for r in ranking.ranks(df, "s", "id", "r").orderBy("id").collect()] == [0.0, 0.5, 1.0]
    none = spark.createDataFrame([(1, None)], "id long, s double")
    assert ranking.ranks(none, "s", "id", "r").first()["r"] == 0.0


def test_suppression_counts_touching_as_overlap(spark):
    df = spark.createDataFrame([("r", 0, 5, 1.0), ("r", 5, 8, 0.9), ("r", 9, 10, 0.8), ("s", 0, 5, 0.7)], "k string, a long, b long, s double")
    assert [r["s"] for r in ranking.suppress(df, ["k"], "a", "b", "s", 9).collect()] == [1.0, 0.8, 0.7]


def test_ago_buckets(spark):
    df = spark.createDataFrame([(89,), (5399,), (172799,), (172800,)], "s long").select(scalar.ago(F.col("s")).alias("x"))
    assert [r[0] for r in df.collect()] == ["89 seconds ago", "90 minutes ago", "48 hours ago", "2 days ago"]


def naive_curve(d):
    """The whole table of the recurrence, with a free row above the anchor's first: columns and matched lengths count
    from 1, the start is the number of columns before the match."""
    n, m = d.shape
    cost = {(0, j): 0.0 for j in range(m + 1)} | {(i, 0): np.inf for i in range(1, n + 1)}
    began = {(0, j): j for j in range(m + 1)} | {(i, 0): 0 for i in range(1, n + 1)}
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            a, b, c = (i - 1, j - 1), (i - 1, j), (i, j - 1)
            best = a if cost[a] <= cost[b] and cost[a] <= cost[c] else b if cost[b] <= cost[c] else c
            cost[i, j], began[i, j] = d[i - 1, j - 1] + cost[best], began[best]
    return [cost[n, j] / (n + max(j - began[n, j], 1)) for j in range(1, m + 1)], [began[n, j] for j in range(1, m + 1)]


def test_alignment_curve_equals_a_naive_one():
    rng = np.random.default_rng(0)
    for _ in range(60):
        many, n, m = rng.integers(1, 5), rng.integers(1, 6), rng.integers(1, 30)
        d = rng.integers(-2, 4, (many, n, m)).astype(float) / 4
        got, start = sequence.curves(d)
        for k in range(many):
            want, began = naive_curve(d[k])
            assert np.allclose(got[k], want) and start[k].tolist() == began


def test_alignment_curve_of_literal_costs():
    c, s = sequence.curve(np.array([[1.0, 0.0, 1.0, 1.0], [1.0, 1.0, 0.0, 1.0]]))
    assert c.tolist() == [2 / 3, 1 / 3, 0.0, 1 / 5] and s.tolist() == [0, 1, 1, 1]  # both rows meet columns 1 and 2: two matched
    c, s = sequence.curve(np.array([[-1.0, -1.0, 2.0]]))
    assert c.tolist() == [-1 / 2, -2 / 3, 0.0] and s.tolist() == [0, 0, 0]  # a cost below 0 carries the first row to the left


def test_search_by_several_anchors_shots_and_recordings(spark):
    """Recordings 1 and 2 repeat an event of recording 0; 3 holds half of it."""
    rng = np.random.default_rng(8)
    rows = {(r, i): (4 * rng.permutation(40) / 40).tolist() for r in range(4) for i in range(24)}
    for i in range(4):
        rows[1, 9 + i] = rows[2, 15 + i] = rows[0, 5 + i]
    rows[3, 3], rows[3, 4] = rows[0, 5], rows[0, 6]
    df = spark.createDataFrame([(100 * r + i, r, v) for (r, i), v in rows.items()], "vec_id long, label long, v array<double>")
    steps = sequence.steps_from_vectors(df, 8).cache()
    anchor, own = steps.where("rec = 0 and pos between 5 and 8"), spark.createDataFrame([(0, 5, 8)], "rec long, x0 long, x1 long")
    span = lambda r: (r["rec"], r["begin"], r["end"])
    only = sequence.find(steps, anchor, 5, 8, own, recs=spark.createDataFrame([(2,)], "rec long")).collect()
    assert span(only[0]) == (2, 15, 18) and {r["rec"] for r in only} == {2}
    both = sequence.find(steps, [anchor, steps.where("rec = 1 and pos between 9 and 12")], 3, 8, own).collect()
    assert {span(r) for r in both[:2]} == {(1, 9, 12), (2, 15, 18)} and both[0]["score"] == pytest.approx(both[1]["score"])
    shots = sequence.find(steps, anchor, 4, 8, own, shots=2).collect()
    assert {span(r) for r in shots[:2]} == {(1, 9, 12), (2, 15, 18)} and not any(span(r)[0] == 0 and r["begin"] <= 8 and r["end"] >= 5 for r in shots)


def test_alignment_path_goes_from_corner_to_corner():
    path = sequence.align_path(np.array([[0.0, 5, 5], [5, 0, 0]]))
    assert path == [(0, 0), (1, 1), (1, 2)]


def test_sparse_scores_equal_dense_ones_and_search_finds_the_copy(spark):
    rng = np.random.default_rng(3)
    rows = [(100 * r + i, r, (4 * rng.permutation(40) / 40).tolist()) for r in range(3) for i in range(20)]
    for i in range(3):  # recording 2 repeats steps 4 to 6 of recording 0 at 10
        rows[40 + 10 + i] = (200 + 10 + i, 2, rows[4 + i][2])
    df = spark.createDataFrame(rows, "vec_id long, label long, v array<double>")
    steps = sequence.steps_from_vectors(df, 8)
    anchor = steps.where("rec = 0 and pos between 4 and 6")
    voc = sequence.vocabulary(steps, 3)
    got = {(r["a"], r["rec"], r["pos"]): r["s"] for r in sequence.similarity(steps, anchor, voc).collect()}
    words = sorted(r[0] for r in voc.collect())
    dense = {(r["rec"], r["pos"]): np.array([dict(zip(r["ids"], r["lps"])).get(w, r["floor"]) for w in words]) for r in steps.collect()}
    mean = np.mean(list(dense.values()), axis=0)
    for (a, rec, pos), s in got.items():
        q = np.exp(dense[0, a]) / np.exp(dense[0, a]).sum()
        assert s == pytest.approx(float((q * (dense[rec, pos] - mean)).sum()), abs=1e-9)
    own = spark.createDataFrame([(0, 4, 6)], "rec long, x0 long, x1 long")
    cost = lambda rec: np.array([[1 - got[a, rec, j] for j in range(20)] for a in (4, 5, 6)])
    best, want = sequence.find(steps, anchor, 1, 3, own).first(), {}
    for rec in (1, 2):
        c, start = naive_curve(cost(rec))
        j = int(np.argmin(c))
        want[rec] = (-c[j], rec, start[j], j)
    assert (best["rec"], best["begin"], best["end"]) == max(want.values())[1:]
    assert want[2] == max(want.values()) and want[2][2:] == (10, 12)


def test_long_recordings_are_cut_into_overlapping_chunks(spark):
    df = spark.range(300).select(F.lit(0).alias("rec"), F.col("id").alias("pos"))
    chunks = {c: (a, b) for c, a, b in sequence.chunked(df).groupBy("chunk").agg(F.min("pos"), F.max("pos")).collect()}
    assert chunks == {0: (0, 119), 1: (80, 199), 2: (160, 279), 3: (240, 299)}


def test_nearest_in_blocks_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vec, "BLOCK", 7)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(30, 6))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = {(r["key"], r["rank"]): r["cosine"] for r in vec.nearest(df, df, "id", "v", 3).collect()}
    s = -np.sort(-(u @ u.T), axis=1)
    assert len(got) == 90 and all(abs(s[k, r - 1] - c) < 1e-9 for (k, r), c in got.items())


def test_sliding_windows_hold_their_members(spark):
    df = spark.createDataFrame([("a", t) for t in (3, 4, 9, 15, 16, 23)], "k string, t long")
    got = sorted(map(tuple, intervals.window_members(df, ["k"], "t", 8, 4).select("t0", "t").collect()))
    starts = [3, 7, 11, 15, 19]
    assert got == sorted((s, t) for s in starts for t in (3, 4, 9, 15, 16, 23) if s <= t < s + 8)


def test_products_of_blocks_are_held_in_part(spark, monkeypatch):
    monkeypatch.setattr(vec, "HELD", 100)
    a, b = np.arange(60.0).reshape(30, 2), np.arange(80.0).reshape(40, 2)
    parts = list(vec.tiles(a, b))
    assert max(s.size for _, s in parts) <= 100 and np.array_equal(np.concatenate([s for _, s in parts]), a @ b.T)
    assert [s.shape for _, s in vec.tiles(a, np.ones((400, 2)))] == [(1, 400)] * 30


def test_tasks_of_tfidf_follow_the_rows(spark, monkeypatch):
    from stratalake.operators import text

    df = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} the") for i in range(200)], "id long, body string").checkpoint()
    plan = lambda: text.tfidf_search(df, "id", text.words(F.col("body")), ["w1", "the"])
    want = {r["id"]: round(r["score"], 9) for r in plan().collect()}
    monkeypatch.setattr(text, "TASK_ROWS", 10)
    shown = plan()._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count("term#") and sum(", 20" in x for x in shown.splitlines() if "RepartitionByExpression" in x) == 3
    assert {r["id"]: round(r["score"], 9) for r in plan().collect()} == want and len(want) == 200
