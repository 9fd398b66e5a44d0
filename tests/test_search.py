"""Composed searches, clusters, graph index, latent space and SQL functions against plain versions."""

import numpy as np
import pyspark.sql.functions as F
import pytest

from stratalake.functions.sql import register
from stratalake.functions import scalar
from stratalake.operators import clusters, graph_index, lsa, search, text, vectors


def rows_of(spark, x):
    return spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "id long, v array<double>")


@pytest.fixture(autouse=True)
def checkpoints(spark, tmp_path):
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(str(tmp_path))


def blobs(seed, n, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = np.eye(8)[:4]
    return np.concatenate([c + rng.normal(0, spread, (n, 8)) for c in centres])


def test_density_labels_find_blobs_and_noise():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.1, (40, 2)) for c in ((0, 0), (5, 0), (0, 5))] + [[[50.0, 50.0], [-40.0, 30.0]]])
    label = clusters.density_labels(x, 8)
    groups = [set(label[40 * k : 40 * k + 40]) - {-1} for k in range(3)]
    assert [len(g) for g in groups] == [1, 1, 1] and len(set.union(*groups)) == 3
    assert list(label[-2:]) == [-1, -1]
    assert (clusters.density_labels(x[:5], 8) == -1).all()


def test_density_clusters_assign_every_row(spark):
    df = rows_of(spark, blobs(2, 50)).union(spark.createDataFrame([(900, None)], "id long, v array<double>"))
    got = {r["id"]: r["cluster"] for r in clusters.density_clusters(df, "id", "v", sample=100).collect()}
    assert len(got) == 201 and got[900] == -1
    for k in range(4):
        inside = [got[i] for i in range(50 * k, 50 * k + 50)]
        top = max(set(inside), key=inside.count)
        assert top >= 0 and inside.count(top) >= 40
    empty = spark.createDataFrame([], "id long, v array<double>")
    assert clusters.density_clusters(empty, "id", "v").count() == 0


@pytest.mark.parametrize("kind", ["spread", "dense"])
def test_graph_index_recall(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(5000, 24)) if kind == "spread" else blobs(4, 1250, 0.2)
    df = rows_of(spark, x)
    queries = df.where("id % 100 = 0")
    index = graph_index.build(df, "id", "v").checkpoint()
    assert index.count() == 5000 and index.select("block").distinct().count() > 1
    found: dict = {}
    for r in graph_index.search(index, queries, "id", "v", 10).collect():
        found.setdefault(r["query"], set()).add(r["match"])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = {q: set(np.argsort(-(u @ u[q]))[:10]) for q in range(0, 5000, 100)}
    assert np.mean([len(found[q] & true[q]) / 10 for q in true]) >= 0.9


def test_latent_space_spans_what_svd_spans(spark):
    rng = np.random.default_rng(5)
    topics = [[f"t{k}w{i}" for i in range(12)] for k in range(4)]
    docs = [(i, " ".join(rng.choice(topics[i % 4], 30))) for i in range(80)]
    df = spark.createDataFrame(docs, "id long, text string")
    w, _ = lsa.weights(df, "id", text.words(F.col("text")))
    w = w.checkpoint()
    got = {r["id"]: np.array(r["vec"]) for r in lsa.embed(w, "id", lsa.basis(w, "id", 4), 4).collect()}
    terms = sorted({r["term"] for r in w.collect()})
    a = np.zeros((80, len(terms)))
    for r in w.collect():
        a[r["id"], terms.index(r["term"])] = r["w"]
    left, s, _ = np.linalg.svd(a, full_matrices=False)
    want = left[:, :4] * s[:4]
    made = np.stack([got[i] for i in range(80)])
    assert np.allclose(made @ made.T, want @ want.T, atol=1e-4)


def test_hybrid_keeps_rows_and_no_terms_of_rows(spark, monkeypatch):
    rng = np.random.default_rng(8)
    docs = [(i, " ".join(rng.choice([f"w{k}" for k in range(300)], 60))) for i in range(70)] + [(70, ""), (71, "w1 w1 alone"), (71, "w1 w2"), (None, "w3 w4")]
    df = spark.createDataFrame(docs, "id long, text string")
    said = {"w1": 1, "w5": 2, "alone": 1, "absent": 1}
    w, idf = lsa.weights(df, "id", text.words(F.col("text")))
    w = w.checkpoint()
    q = spark.createDataFrame([(k, n) for k, n in said.items()], "term string, n int").join(idf, "term").select(F.lit(0).alias("one"), "term", ((1 + F.log("n")) * F.col("idf")).alias("w")).checkpoint()
    wording = {r["id"]: r["x"] for r in w.join(q.select("term", F.col("w").alias("qw")), "term").groupBy("id").agg(F.sum(F.col("w") * F.col("qw")).alias("x")).collect()}
    terms = lsa.basis(w, "id", 4).checkpoint()
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    point = unit(lsa.embed(q, "one", terms, 4).first()["vec"])
    want = {r["id"]: (unit(r["vec"]) @ point, wording.get(r["id"], 0.0)) for r in lsa.embed(w, "id", terms, 4).collect()}

    kept, kind = [], type(df)
    plain = kind.checkpoint
    monkeypatch.setattr(kind, "checkpoint", lambda self, *a: (out := plain(self, *a), kept.append(out.count()))[0])
    monkeypatch.setattr(lsa, "HELD", 50)
    hashes = {r[0]: r[1] for r in spark.createDataFrame([(t,) for t in said], "term string").select("term", F.xxhash64("term")).collect()}
    got = {r["id"]: (r["meaning"], r["wording"]) for r in lsa.likeness(df, "id", text.words(F.col("text")), {hashes[t]: n for t, n in said.items()}, 4).collect()}
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], [want[k] for k in want], atol=1e-9)
    assert all(r["meaning"] is None and r["wording"] == 0 for r in lsa.likeness(df, "id", text.words(F.col("text")), {7: 1}, 4).collect())
    search.hybrid(df.where("id is not null"), "id", "text", "w1 w5", df.select("id", F.lit(0.5).alias("appearance")).where("id < 70"), 4).collect()
    assert max(kept) <= len(docs) + 4 + lsa.EXTRA + 1  # rows, and a small matrix


def test_spend_stops_where_rows_repeat_what_is_held(spark):
    held = blobs(6, 20, 0.02)[:60]
    new = np.concatenate([held[:10] + 0.01, [np.eye(8)[6], np.eye(8)[7]]])
    got = search.spend(rows_of(spark, new), rows_of(spark, held), "id", "v", 6).collect()
    assert {r["key"] for r in got} == {10, 11}
    assert len(search.spend(rows_of(spark, new), rows_of(spark, held).where("id < 0"), "id", "v", 3).collect()) == 3


def test_chain_takes_what_lies_inside(spark):
    scores = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.1), (1, 3, 0.5), (1, 4, 0.8), (2, 5, 0.7), (2, 6, 0.2)], "clause int, node long, score double")
    follows = spark.createDataFrame([(1, 3), (2, 4)], "before long, node long")
    inside = spark.createDataFrame([(3, 5), (3, 6), (4, 6)], "outer long, inner long")
    mean = {r["node"]: (r["path"], round(r["score"], 6)) for r in search.chain_paths(scores, follows, inside, ["start", "then", "during"], "mean").collect()}
    assert mean == {3: ([1, 3, 5], 0.7), 4: ([2, 4, 6], round(1.1 / 3, 6))}
    low = {r["node"]: round(r["score"], 6) for r in search.chain_paths(scores, follows, inside, ["start", "then", "during"], "min").collect()}
    assert low == {3: 0.5, 4: 0.1}


def test_whole_path_score():
    costs = np.array([[[0.0, 1.0], [1.0, 0.0]], [[0.0, 1.0], [2.0, 5.0]]])
    from stratalake.operators import sequence

    assert sequence.corner_costs(costs).tolist() == [0.0, 5.0] and sequence.corner_costs(np.array([[[0.5, 0.25]]])).tolist() == [0.75]


def test_registered_functions(spark):
    register(spark)
    r = spark.sql("SELECT vec_cosine(array(1D, 0D), array(1D, 1D)) AS c, span_iou(0D, 2D, 1D, 3D) AS i, spans_overlap(0, 1, 1, 2) AS o").first()
    assert (round(r["c"], 6), round(r["i"], 6), r["o"]) == (0.707107, 0.333333, True)
    assert spark.sql("SELECT vec_mean(v) AS m FROM VALUES (array(1D, 3D)), (array(3D, 5D)) AS t(v)").first()["m"] == [2.0, 4.0]
    path = spark.sql("SELECT * FROM dtw_path(array(array(1D, 0D), array(0D, 1D)), array(array(1D, 0D), array(1D, 0D), array(0D, 1D)))").collect()
    assert [(p["i"], p["j"]) for p in path] == [(0, 0), (0, 1), (1, 2)]


def test_global_places_over_many_buckets(spark, monkeypatch):
    from stratalake.operators import ranking

    monkeypatch.setattr(ranking, "BUCKET_ROWS", 50)
    rng = np.random.default_rng(8)
    rows = [(i, None if i % 7 == 0 else float(rng.integers(0, 300))) for i in range(2000)] + [(5000 + i, 150.0) for i in range(700)]
    got = {r["id"]: r["r"] for r in ranking.ranks(spark.createDataFrame(rows, "id long, s double"), "s", "id", "r").collect()}
    known = sorted((r for r in rows if r[1] is not None), key=lambda r: (-r[1], r[0]))
    assert len(got) == 2700 and all(got[r[0]] == k for k, r in enumerate(known))
    assert {got[i] for i, s in rows if s is None} == {(len(known) - 1) / 2}
    none = spark.createDataFrame([(1, None)], "id long, s double")
    assert ranking.ranks(none, "s", "id", "r").first()["r"] == 0
    assert ranking.ranks(none.where("id > 1"), "s", "id", "r").count() == 0


def test_within_budget_over_all_rows(spark, monkeypatch):
    """The running sum is over every row, in many buckets, with ties, nulls and negative costs, as DuckDB's window has it."""
    import duckdb
    import pandas as pd

    from stratalake.operators import ranking

    monkeypatch.setattr(ranking, "BUCKET_ROWS", 50)
    rng = np.random.default_rng(4)
    for least, budget in ((0, 900), (-30, 200), (-45, -2000)):
        at = [None if i % 97 == 5 else int(k) for i, k in enumerate(rng.integers(0, 700, 1500))]
        rows = [(i, k, None if i % 11 == 0 or (k or 0) > 690 else int(c)) for i, (k, c) in enumerate(zip(at, rng.integers(least, 40, 1500)))]
        events = pd.DataFrame(rows, columns=["id", "k", "cost"]).astype("Int64")  # noqa: F841
        want = duckdb.sql(f"select id, sum(cost) over (order by k desc nulls last)::bigint as used from events qualify used <= {budget}").fetchall()
        got = ranking.within_budget(spark.createDataFrame(rows, "id long, k long, cost long"), "k", "cost", budget, "used").select("id", "used").collect()
        assert want and sorted(map(tuple, got)) == sorted(want)
    empty = spark.createDataFrame([], "id long, k long, cost long")
    assert ranking.within_budget(empty, "k", "cost", 10, "used").count() == 0


def test_token_budget_all_takes_the_newest_event(spark):
    from stratalake import catalog

    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet").select("event_id", "user_id").collect()
    total, want = 0, []
    for i, n in sorted(map(tuple, events), reverse=True):
        total += n
        if total <= 4096:
            want.append((i, total))
    got = catalog.queries()["token_budget_all"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(tuple, got), reverse=True) == want and want[0][0] == max(r[0] for r in events)


def test_opposites_over_all_rows_in_blocks(spark, monkeypatch):
    """Every row, met in several blocks, with equal vectors, rows in the mean, and null vectors."""
    from stratalake.operators import analytics

    monkeypatch.setattr(analytics, "BLOCK", 40)
    v = np.random.default_rng(6).integers(-2, 3, (150, 3)).astype(float)
    v = np.concatenate([v, -v, np.zeros((2, 3))])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(999, None)], "id long, v array<double>")
    got = {r["id"]: r["opposite"] for r in analytics.opposites(df, "id", "v").collect()}
    want = {}
    for i, a in enumerate(v):
        n = [np.linalg.norm(a) * np.linalg.norm(b) for b in v]
        want[i] = min((round(float(a @ b) / n[j], 9) + 0.0 if n[j] else 2.0, j) for j, b in enumerate(v) if j != i)[1]
    assert got == want
    assert analytics.opposites(df.where("id = 1"), "id", "v").count() == 0


def test_density_clusters_of_all_rows(spark, monkeypatch):
    """Small clusters of a larger table are found, as by the tree of all rows in one place, over many blocks and merges."""
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 1, (30, 16))
    x = np.concatenate([c / np.linalg.norm(c) + rng.normal(0, 0.02, (12, 16)) for c in centres] + [rng.normal(0, 1, (2600, 16))])
    df = rows_of(spark, x)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = clusters.density_labels(unit, 8)
    for block, part, edges in ((4000, 1024, 16), (300, 100, 2)):
        monkeypatch.setattr(clusters, "BLOCK", block)
        monkeypatch.setattr(clusters, "PART", part)
        monkeypatch.setattr(clusters, "EDGES", edges)
        got = {r["id"]: r["cluster"] for r in clusters.density_clusters(df, "id", "v").collect()}
        label = np.array([got[i] for i in range(len(x))])
        assert len(got) == len(x) and len(set(zip(label, want))) == len(set(want)) == len(set(label))
        assert all(len(set(label[12 * k : 12 * k + 12])) == 1 and label[12 * k] >= 0 for k in range(30))


def test_cells_with_stored_codes(spark, tmp_path, monkeypatch):
    """Recall of 0.9 or more at 10 where rows lie in groups, with a quarter of the cells probed, and a cell of most rows
    dealt in blocks."""
    from stratalake.operators import quantised

    monkeypatch.setattr(quantised, "BLOCK", 500)
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(40, 32))
    x = middles[np.minimum(rng.integers(0, 60, 3000), 39)] + 0.4 * rng.normal(size=(3000, 32))  # a third in one group
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9999, None)], "i long, v array<double>")
    quantised.build(df, "i", "v").save(f"{tmp_path}/index")
    index = quantised.CellIndex.load(spark, f"{tmp_path}/index")
    assert index.rows.count() == 3000  # every row is coded
    got = quantised.cell_search(index, df.where("i % 100 = 0"), "i", "v", 10, len(index.centres) // 4).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = {}
    for r in got:
        assert r["score"] == pytest.approx(u[r["key"]] @ u[r["match"]])
        found.setdefault(r["key"], set()).add(r["match"])
    recall = np.mean([len(found[i] & set(np.argsort(-(u @ u[i]))[:10].tolist())) / 10 for i in range(0, 3000, 100)])
    assert recall >= 0.9
    assert quantised.build(df.where("v is null"), "i", "v") is None


def test_units_take_a_norm_once_and_covers_keep_their_distances(spark):
    x = blobs(5, 12, 0.3)
    df = rows_of(spark, x)
    plan = df.select(scalar.unit(F.col("v")).alias("u"))._jdf.queryExecution().analyzed().toString()
    assert plan.lower().count("sqrt") == 1  # not in the lambda, where each element would take it anew
    u, picked = x / np.linalg.norm(x, axis=1, keepdims=True), [0]
    while len(picked) < 5:
        picked.append(int(np.round((1 - u @ u[picked].T).min(1), 9).argmax()))
    assert [r["key"] for r in vectors.farthest_points(df, "id", "v", 5).collect()] == picked
    some = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [])], "id long, v array<double>")
    assert [r[0] for r in some.orderBy("id").select(scalar.unit(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0], None, []]


def test_cluster_rows_take_their_length_once(spark):
    x = blobs(3, 20, 0.05)
    made = clusters.density_clusters(rows_of(spark, x), "id", "v")
    assert "/ greatest(sqrt(" not in made._jdf.queryExecution().analyzed().toString().lower()  # not in the lambda
    want = clusters.density_labels(x / np.linalg.norm(x, axis=1, keepdims=True), 8)
    both = {(r["cluster"], int(want[r["id"]])) for r in made.collect()}
    assert len(both) == len({a for a, _ in both}) == len({b for _, b in both})  # the same clusters, whatever their names


def test_terms_are_dealt_to_the_blocks_of_their_hashes(spark):
    docs = [(1, ["a", "b", "a", "c"]), (2, ["b"]), (3, []), (4, None), (None, ["c", "c"])]
    df = spark.createDataFrame(docs, "id long, words array<string>")
    h = {t: spark.createDataFrame([(t,)], "t string").select(F.xxhash64("t")).first()[0] for t in "abc"}
    got, rows = {}, lsa.dealt(df, "id", F.col("words"), 4).collect()
    for r in rows:
        hashes, counts, own, tf = (lsa._unpacked(r[c]) for c in ("hashes", "counts", "rows", "tf"))
        assert len(own) == len(tf) == counts.sum()
        for x, i, n in zip(np.repeat(np.cumsum(hashes, dtype=np.uint64), counts).tolist(), own, tf):
            assert x * 4 >> 64 == r["block"]
            got[r["keys"][i], x - 2**64 * (x >= 2**63)] = n
    assert got == {(1, h["a"]): 2, (1, h["b"]): 1, (1, h["c"]): 1, (2, h["b"]): 1, (None, h["c"]): 2}
    assert {k for r in rows for k in r["keys"]} == {1, 2, None}  # rows without terms are left out


def test_cells_are_searched_without_being_stored(spark):
    """Rows whose vectors are made for their codes alone: nothing else reads them."""
    from stratalake.operators import quantised

    x = blobs(6, 60, 0.3)
    df = rows_of(spark, x).union(spark.createDataFrame([(900, [0.0] * 8), (901, None)], "id long, v array<double>"))
    index = quantised.build(df, "id", "v")
    assert sum(r["count"] for r in index.rows.groupBy("cell").count().collect()) == 241
    probes = len(index.centres)
    got = quantised.cell_search(index, df.where("id in (0, 100)"), "id", "v", 10, probes, 100).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in (0, 100):
        found = {r["rank"]: r["match"] for r in got if r["key"] == q}
        assert [found[i + 1] for i in range(10)] == np.argsort(-(u @ u[q]), kind="stable")[:10].tolist()


def test_code_books_hold_few_differences_at_once():
    import tracemalloc

    from stratalake.operators import quantised

    x = np.random.default_rng(9).normal(size=(2000, 64))
    tracemalloc.start()
    centres = quantised.codebooks(x, 1, 100, 2)[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6 and centres.shape == (100, 64)  # all differences are 102 MB
    whole = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    assert (quantised._nearest(x, centres) == whole).all()
