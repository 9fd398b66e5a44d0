"""The classifier's features, learner and scores against plain versions with dictionaries and loops."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from stratalake.llm import quality, registry

DATA = "/root/testdata/sf0.001"
M = 2**64


def mix(x):
    x ^= x >> 31
    x = x * 0x9E3779B97F4A7C15 % M
    x ^= x >> 29
    x = x * 0xD6E8FEB86659FD93 % M
    return x ^ x >> 32


def plain_features(text):
    """Dimension -> share of the text's n-grams, one occurrence at a time."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return {0: quality.SCALE}

    def shape(w):
        kinds = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in w)
        return xxhash.xxh32_intdigest(re.sub(rb"(.)\1+", rb"\1", kinds, flags=re.DOTALL))

    a, s = [xxhash.xxh3_64_intdigest(w) % 2**31 for w in words], [shape(w) for w in words]
    grams = [x * 8 + 1 for x in a] + [x * 8 + 2 for x in s]
    grams += [int(x == y) * 8 + 3 for x, y in zip(a, a[1:])]
    grams += [mix((x * 0x1000003 + y) % M) * 8 % M + 4 for x, y in zip(a, a[1:])]
    pairs = [mix((x * 0x1000003 + y) % M) for x, y in zip(s, s[1:])]
    grams += [p * 8 % M + 5 for p in pairs] + [mix((p * 0x1000003 + y) % M) * 8 % M + 6 for p, y in zip(pairs, s[2:])]
    count = Counter(mix(g % M) % (quality.DIMENSIONS - 1) + 1 for g in grams)
    return {k: quality.SCALE * n / len(grams) for k, n in count.items()}


def plain_training(examples):
    """Follow-the-regularised-leader, a coordinate at a time."""
    z, n = Counter(), Counter()

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return (math.copysign(quality.L1, z[i]) - z[i]) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for label, x in examples:
            x = {**x, -1: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w[i] * v for i, v in x.items())))))
            for i, v in x.items():
                g = (p - label) * v
                step = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA
                z[i] += g - step * w[i]
                n[i] += g * g
    return {i: weight(i) for i in list(z)}


@pytest.mark.parametrize("text", ["", None, " \n", "one", "one one", "The 3rd Word-x, again: The 3rd", "日本 ÀB aa11BB " + "x" * 300 + " <b>", "a b c d e " * 9])
def test_features_equal_plain_ones(text):
    at, x = quality.vector(text, quality.WordFeatures())
    want = plain_features(text)
    assert at.tolist() == sorted(want) and x == pytest.approx([want[k] for k in sorted(want)])


def test_the_query_scores_as_a_plain_learner_does(spark):
    """Labels of kept folds alone, in the order of their ids' hashes, and every score of the table."""
    texts = dict(duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet'").fetchall())
    labels = dict(duckdb.sql(f"select doc_id, quality from '{DATA}/labels.parquet'").fetchall())
    x = {k: plain_features(t) for k, t in texts.items()}
    import zlib

    used = [k for k in labels if k in texts and labels[k] in (0, 1) and zlib.crc32(str(k).encode()) % 4 != 2]
    used.sort(key=lambda k: (xxhash.xxh64_intdigest(str(k)), k))
    w = plain_training([(labels[k], x[k]) for k in used])
    got = registry.queries()["op3_quality"](spark, DATA).collect()
    assert len(got) == len(texts)
    for r in got:
        total = sum(w.get(i, 0.0) * v for i, v in x[r["doc_id"]].items()) + w[-1]
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-max(-35.0, min(35.0, total)))), abs=2e-4)  # vectors travel as 32-bit numbers
    assert np.mean([r["held_out"] for r in got]) > 0.1
