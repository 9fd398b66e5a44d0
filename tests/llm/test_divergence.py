"""The divergence audit equals sums over dictionaries, whatever the number of blocks."""

import collections
import re

import numpy as np
import pytest

from stratalake.llm import divergence

WORD = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "lang string, source string, text string"


def plain(docs, least=3, top=200):
    counts, documents = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for lang, source, text in docs:
        words = WORD.findall((text or "").translate(LOWER))
        counts[lang or "", source or ""].update(words)
        documents[lang or ""].update(set(words))
    out = []
    for lang in documents:
        kept = [t for t, n in documents[lang].items() if n >= least]
        groups = {s: {t: n[t] for t in kept} for (k, s), n in counts.items() if k == lang}
        shares = lambda n: {t: 1 + 10**9 * (n[t] + 1) // (sum(n.values()) + len(kept)) for t in kept}
        f = lambda p, q: (p - q) * (p - q) // q
        p, q = {s: shares(n) for s, n in groups.items()}, shares({t: sum(n[t] for n in groups.values()) for t in kept})
        for s in groups:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in groups if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode()) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -less, k + 1) for k, (less, item) in enumerate(found)]
    return sorted(out)


def audited(df, **how):
    return sorted(tuple(r) for r in divergence.audit(df, **how).select("lang", "source", "part", "item", "value", "rank").collect())


ODD = [(None, None, "a a b Ä c"), ("x", None, None), ("x", "s", ""), ("y", "s", "a b c"), ("y", "s", "a b c"), ("y", "t", "a b"), ("y", "u", None),
       ("y", "v", "A a a zz"), (None, "q", "a Ä b"), (None, "q", "b a-A"), (None, "r", "É a b Ä"), ("z", "only", "a a a"), ("y", "w", "b " * 300_000)]


def test_odd_rows_and_clashing_columns(spark):
    df = spark.createDataFrame(ODD, SCHEMA).selectExpr("*", "1 as term", "2 as n", "3 as place", "4 as shard", "5 as rank")
    assert audited(df) == plain(ODD)
    assert audited(spark.createDataFrame([], SCHEMA)) == []


@pytest.mark.parametrize("block", [1, 2, 3, 50])
def test_every_two_blocks_meet_once(spark, block):
    rng = np.random.default_rng(block)
    words = [f"w{chr(97 + k)}" for k in range(26)]
    docs = [(str(rng.integers(2)), f"s{rng.integers(9)}", " ".join(rng.choice(words, rng.integers(1, 9)))) for _ in range(150)]
    assert audited(spark.createDataFrame(docs, SCHEMA), block=block, top=3) == plain(docs, top=3)


def test_shares_are_exact():
    rng = np.random.default_rng(0)
    for total in (1, 7, 10**9 + 7, 8 * 10**15):
        n = np.append(rng.integers(0, total, 200), [0, total - 1])
        assert divergence.share(n, total).tolist() == [1 + 10**9 * (int(k) + 1) // total for k in n]


def test_sparse_and_dense_meetings_agree():
    rng = np.random.default_rng(1)
    for size in (1, 40, 3000):
        vectors = [divergence.packed(at := np.sort(rng.choice(size, max(1, size // 30), False)), rng.integers(1, 50, len(at))) for _ in range(2)]
        sparse = [(*divergence.unpacked(v), 5000, None) for v in vectors]
        dense = []
        for places, counts, total, _ in sparse:
            n = np.zeros(size, np.int64)
            n[places] = counts
            dense.append((places, counts, total, divergence.share(n, total)))
        assert divergence.meeting(*sparse, size) == divergence.meeting(*dense, size)
