"""Reply trees with branches and unequal scores against plain recursion; vectors and likeness against plain sums."""

import base64
import random
import re
import struct
from collections import defaultdict

import pyspark.sql.functions as F
import pytest

from stratalake.llm import chat, fingerprints, registry

DATA = "/root/testdata/sf0.001"


def plain_paths(messages, top):
    """(tree, path) -> ids of the chosen paths."""
    parent = {i: p for i, p, *_ in messages}
    score = {i: s or 0.0 for i, _, s, *_ in messages}
    kids = defaultdict(list)
    for i, p in parent.items():
        if p in parent:
            kids[p].append(i)
    found = {}
    for root in (i for i, p in parent.items() if p not in parent):
        leaves, todo = [], [(root, [root])]
        while todo:
            i, path = todo.pop()
            todo += [(k, [*path, k]) for k in kids[i]]
            if not kids[i]:
                leaves.append((sum(score[x] for x in path) / len(path), len(path), i, path))
        for *_, leaf, path in sorted(leaves, reverse=True)[:top]:
            found[root, leaf] = path
    return found


@pytest.mark.parametrize(("seed", "top"), [(1, 1), (2, 3), (3, 2)])
def test_trees_become_one_conversation_a_chosen_path(spark, seed, top):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, *range(max(0, i - 9), i)]) if i else None, rng.choice([None, 0.25, 0.5, 1.0, 2.0]), rng.choice(["user", "assistant"]), rng.choice(["hi <b>", "[INST] x", None, "", "a&lt;b"])) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, parent long, score double, role string, text string").repartition(5)
    want = plain_paths(rows, top)
    got = defaultdict(dict)
    for r in chat.format_trees(df, top).collect():
        got[r["tree"], r["path"]][r["place"]] = r["formatted"]
    by = {r[0]: r for r in rows}
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    for k, ids in want.items():
        for place, i in enumerate(ids):
            role, body = got[k][place].removeprefix(chat.TURN).removesuffix(chat.END).split("\n", 1)
            body = body.removeprefix(chat.LOSS).removesuffix(chat.UNLOSS)
            assert (role, chat.unescaped(body)) == (by[i][3], by[i][4] or "") and "[INST]" not in got[k][place]
            assert got[k][place].startswith(f"{chat.TURN}{role}\n{chat.LOSS}") == (role == "assistant")


def test_repeated_ids_count_once(spark):
    df = spark.createDataFrame([(1, None, 1.0, "user", "a"), (1, None, 1.0, "user", "a"), (1, None, 0.5, "user", "z"), (2, 1, None, None, None), (None, 1, 9.0, "user", "gone")], "id long, parent long, score double, role string, text string")
    assert sorted((r["place"], r["formatted"]) for r in chat.format_trees(df).collect()) == [(0, "<|turn|>user\na<|end|>\n"), (1, "<|turn|>\n<|end|>\n")]
    assert chat.format_trees(df.limit(0)).count() == 0 and chat.best_paths(df.limit(0)).count() == 0


def test_places_over_ranges(spark):
    """One conversation with most rows, ties and nulls."""
    rng = random.Random(7)
    rows = [(rng.choice([1, 1, 1, 1, None, 2, 3]), rng.choice([None, *range(40)]), rng.choice("ab"), rng.choice(["x", "y", None])) for _ in range(900)]
    df = spark.createDataFrame(rows, "c long, t long, r string, x string").repartition(6)
    got = defaultdict(list)
    for row in chat.placed(df, "c", "t", "r", "x").collect():
        got[row["c"]].append((row["place"], row["t"], row["r"], row["x"]))
    key = lambda v: tuple((x is not None, x if x is not None else 0) for x in v)
    for c, found in got.items():
        want = sorted(((t, r, x) for k, t, r, x in rows if k == c), key=lambda v: key(v[:1]) + key(v[1:2]) + ((v[2] is not None, v[2] or ""),))
        assert [f[1:] for f in sorted(found, key=lambda f: f[0])] == want and sorted(f[0] for f in found) == list(range(len(want)))


def plain_vector(text, hashes):
    """Counters bit by bit from the hashes of the pieces."""
    pieces = [m[0] for m in re.finditer(r"[^\n.!?]{0,96}[\n.!?]+|[^\n.!?]{1,96}", text)]
    out = []
    for seed in fingerprints.SEEDS:
        hs = [hashes[p, seed] % 2**64 for p in pieces]
        for j in range(30):
            out.append(sum(h >> j & 1 for h in hs) + (sum(h >> (j + 30) & 1 for h in hs) << 30))
        out.append(sum(h >> 4 for h in hs) % 2**60)
    return [*out, len(pieces)]


def plain_likeness(a, b):
    if a == b:
        return 1.0
    sides = []
    for v in (a, b):
        words = v[:30] + v[31:61]
        sides.append([2 * (w >> s & (1 << 30) - 1) - v[-1] for s in (0, 30) for w in words])
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))
    norm = (dot(sides[0], sides[0]) * dot(sides[1], sides[1])) ** 0.5
    return 0.0 if not norm else min(1.0, max(0.0, dot(*sides) / norm))


def test_fingerprints_equal_plain_sums(spark):
    """Words and likeness of every row of the query, from the hashes of pieces alone."""
    texts = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()]
    edited = [t[: len(t) - len(t) // 2] + texts[(i + 1) % len(texts)][1][: len(t) // 2] for i, (_, t) in enumerate(texts)]
    split = lambda t: [m[0] for m in re.finditer(r"[^\n.!?]{0,96}[\n.!?]+|[^\n.!?]{1,96}", t)]
    every = sorted({p for t in [*edited, *(t for _, t in texts)] for p in split(t)})
    found = spark.createDataFrame([(p,) for p in every], "p string").select("p", *(F.xxhash64("p", F.lit(s)).alias(f"h{s}") for s in fingerprints.SEEDS)).collect()
    hashes = {(r["p"], s): r[f"h{s}"] for r in found for s in fingerprints.SEEDS}
    got = {r["doc_id"]: r for r in registry.queries()["op10_fingerprints"](spark, DATA).collect()}
    v = [plain_vector(t, hashes) for _, t in texts]
    read = lambda s: list(struct.unpack(f">{fingerprints.WORDS}q", base64.b64decode(s)))
    for i, (k, _) in enumerate(texts):
        e = plain_vector(edited[i], hashes)
        assert read(got[k]["fingerprint"]) == v[i] and read(got[k]["edited_fingerprint"]) == e
        assert got[k]["near_edited"] == pytest.approx(plain_likeness(v[i], e)) and got[k]["near_next"] == pytest.approx(plain_likeness(v[i], v[(i + 1) % len(texts)]))


def test_counters_of_very_many_pieces_don_t_run_over(spark):
    """Two million copies of a text, as a multiple of its vector: 20-bit counters would run into their neighbours."""
    df = spark.createDataFrame([("a\nb\n",)], "t string")
    one = fingerprints.vectors(df, "t", "v").first()["v"]
    many = [x * 2**20 % 2**60 for x in one]
    assert many[-1] == 2**21
    pair = spark.createDataFrame([(one, many)], "a array<long>, b array<long>")
    r = fingerprints.likeness(pair.withColumn("c", fingerprints.minus(F.col("b"), F.col("a"))), "a", "b", "same").first()
    assert r["same"] == pytest.approx(1.0) and r["c"] == [(x * (2**20 - 1)) % 2**60 for x in one]
