import itertools
import random

import pytest

from stratalake.llm.ngram_join import jaccard_components, one_of_each


def brute(rows, n, num, den):
    sets = []
    for _, text in rows:
        raw = (text or "").encode()
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in raw).split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    label = [r[0] for r in rows]
    links = [0] * len(rows)
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and den * len(a & b) >= num * len(a | b):
            links[i] += 1
            links[j] += 1
            lo, hi = sorted((label[i], label[j]))
            label = [lo if x == hi else x for x in label]
    return sorted((r[0], len(s), x, k) for r, s, x, k in zip(rows, sets, label, links))


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(30):
        base = [rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 4, 7, 12, 20, 40, 90, 200, 500]))]
        for _ in range(rng.choice([1, 1, 2, 6, 15])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                if w:
                    k = rng.randrange(len(w))
                    w[k : k + rng.choice([0, 1])] = [rng.choice(words)] * rng.choice([0, 1])
            out.append(rng.choice([" ", "\n"]).join(w))
    out += [None, "", "  \t\n", "A b\x0bC", "a B c", "é É é É", "x\xa0y z"]
    return list(enumerate(out))


@pytest.mark.parametrize(("n", "num", "den"), [(3, 90, 100), (5, 8, 10), (2, 6, 10)])
def test_every_link_is_found(spark, n, num, den):
    rows = corpus(n)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, jaccard_components(df, n, num, den).collect())) == brute(rows, n, num, den)


def test_blocks_give_the_same_links(spark, monkeypatch):
    from stratalake.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 4)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    rows = corpus(9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_components(df, 3, 80, 100).collect())) == brute(rows, 3, 80, 100)


def test_empty_tables_null_ids_repeats_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_components(empty).count() == 0
    df = spark.createDataFrame(
        [(1, "a b c", 5, 7), (1, "a b c", 5, 7), (2, "a b c", 5, 7), (None, "q r", 5, 7), (3, None, 5, 7)],
        "doc_id long, text string, n long, component long")
    got = sorted(map(tuple, jaccard_components(df, 3, 9, 10).select("doc_id", "n_shingles", "component_id", "n_links").collect()), key=str)
    assert got == sorted([(1, 1, 1, 2), (1, 1, 1, 2), (2, 1, 1, 2), (None, 1, None, 0), (3, 0, 3, 0)], key=str)
    assert one_of_each(df, 3, 9, 10).columns == df.columns


def test_one_of_each_keeps_the_smallest(spark):
    df = spark.createDataFrame([(5, "a b c d"), (3, "a b c d"), (9, "x")], "doc_id long, text string")
    assert sorted(r[0] for r in one_of_each(df).collect()) == [3, 9]


def rows_kept(rows, n, num, den):
    """One row a component, by brute force over rows: ids that repeat are rows of their own."""
    label = [r[2] for r in sorted(brute([(k, t) for k, (_, t) in enumerate(rows)], n, num, den))]
    out = []
    for c in sorted(set(label)):
        group = [rows[k] for k in range(len(rows)) if label[k] == c]
        if not (group[0][1] or "").strip():
            out += group
            continue
        least = min((i is None, i or 0) for i, _ in group)
        texts = {t for i, t in group if (i is None, i or 0) == least}
        out.append((None if least[0] else least[1], texts))
    return out


def test_one_of_each_goes_by_row(spark):
    """Repeated ids with equal and with other texts, rows without ids, blanks, and columns with helper names."""
    words = [f"w{k}" for k in range(30)]
    a, near, b, c = " ".join(words), " ".join(words[:-1]), "q r s t u v", "k l m n o p"
    rows = [(5, a), (5, "another text that stands alone here"), (3, a), (7, b), (7, b), (None, c), (None, c), (None, near), (8, c.upper()), (2, ""), (2, None), (9, " \n"), (None, "z1 z2"), (None, "z1  z2")]
    df = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in rows], "doc_id int, text string, _gone int, row_id int, h int, node int").repartition(4)
    got = one_of_each(df, 3, 9, 10)
    assert got.schema == df.schema
    kept = [(r["doc_id"], r["text"]) for r in got.collect()]
    want = rows_kept(rows, 3, 90, 100)
    assert len(kept) == len(want)
    for w in want:
        assert w in kept if not isinstance(w[1], set) else any(i == w[0] and t in w[1] for i, t in kept)
    again = {(r["doc_id"], r["text"]) for r in one_of_each(df.repartition(3), 3, 9, 10).where("doc_id is not null").collect()}
    assert again == {k for k in kept if k[0] is not None}
    assert {(r["component_id"], r["n_links"]) for r in jaccard_components(df, 3, 9, 10).where("doc_id = 5").collect()} == {(3, 2), (5, 0)}


@pytest.mark.parametrize("num", [8, 9])
def test_unrelated_short_sets_share_no_signature(num):
    import numpy as np

    from stratalake.llm import ngram_join as nj

    rng, levels = np.random.default_rng(1), nj.Levels(num, 10)
    for n in (4, 8, 12, 24, 60, 90, 110, 200):
        sigs = np.concatenate([np.unique(nj.postings(np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)), levels)) for _ in range(12_000)] or [[]])
        assert not len(sigs) or np.unique(sigs, return_counts=True)[1].max() <= 3


def test_unrelated_short_texts_make_no_family(spark):
    """100,000 unrelated short texts at 0.8: no family above a handful."""
    from stratalake.llm import ngram_join as nj
    from stratalake.llm.common import components

    df = spark.range(100_000).selectExpr("array_join(transform(sequence(1, cast(5 + id % 40 as int)), i -> hex(xxhash64(id, i) & 16777215)), ' ') as text")
    posted = df.mapInArrow(nj._postings(5, 8, 10), "sig long, u long, v long").repartition("sig")
    families = components(posted.mapInArrow(nj._tied, "u long, v long"))
    assert (families.groupBy("component").count().agg({"count": "max"}).first()[0] or 0) <= 4


@pytest.mark.parametrize(("num", "den"), [(8, 10), (9, 10), (6, 10)])
def test_any_two_sets_within_the_threshold_share_a_signature(num, den):
    """Sets with few full fragments, grown and shrunk to the edge of the threshold."""
    import numpy as np

    from stratalake.llm import ngram_join as nj

    rng, levels, few = np.random.default_rng(3), nj.Levels(num, den), 0
    for k in range(6000):
        n = int(rng.integers(2, 60))
        top = 2**64 if k % 2 else 2**int(rng.integers(58, 64))  # crowded into some fragments, or not
        a = np.unique(rng.integers(0, top, n, dtype=np.uint64))
        gone = int(rng.integers(0, max(1, len(a) * (den - num) // den) + 1))
        b = np.delete(a, rng.permutation(len(a))[:gone])
        b = np.unique(np.concatenate((b, rng.integers(0, top, int(rng.integers(0, 4)), dtype=np.uint64))))
        both = len(np.intersect1d(a, b))
        if len(b) and both < len(np.union1d(a, b)) and den * both >= num * (len(a) + len(b) - both):
            assert len(np.intersect1d(nj.postings(a, levels), nj.postings(b, levels)))
            few += 1
    assert few > 500


def test_components_with_hubs(spark):
    from stratalake.llm.common import components

    rng = random.Random(4)
    edges = [(0, k) for k in range(1, 900)] + [(2000 + k, 2001 + k) for k in range(40)] + [(5000, 4000 + k) for k in range(500)] + [(rng.randrange(6000, 6400), rng.randrange(6000, 6400)) for _ in range(150)] + [(1, 1)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    want = {x: root(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    assert {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()} == want
