"""The permutation test of neighbouring stretches against a plain version."""

import hashlib

import numpy as np

from stratalake.operators import analytics


def _plain(rows, trials, seed):
    out = {}
    for by in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == by and r[3] is not None]
        for pair in sorted({r[1] for r in mine}):
            both = [r for r in mine if r[1] in (pair, pair + 1)]
            x = np.array([np.array(r[3]) / np.linalg.norm(r[3]) for r in both])
            real = np.array([r[1] == pair for r in both])
            if real.all() or not real.any():
                continue
            gap = lambda a: np.linalg.norm(x[a].mean(0) - x[~a].mean(0))
            more = 0
            for t in range(1, trials + 1):
                order = np.argsort([hashlib.md5(f"{seed}:{t}:{r[2]}".encode()).hexdigest() for r in both])
                drawn = np.zeros(len(both), bool)
                drawn[order[: real.sum()]] = True
                more += gap(drawn) >= gap(real) - 1e-12
            out[by, pair] = (gap(real), (more + 1) / (trials + 1))
    return out


def test_trials_equal_plain_relabelling_and_find_a_planted_shift(spark):
    rng, rows = np.random.default_rng(1), []
    for by, sizes in (("a", [9, 4, 30]), ("b", [500, 700]), ("c", [5]), (None, [3, 3])):
        for s, n in enumerate(sizes, 1):
            for _ in range(n):
                v = rng.normal(size=6) + (4 if by == "b" and s == 2 else 0)
                rows.append((by, s, len(rows), v.tolist(), 9))
    rows.append(("a", 1, len(rows), None, 9))
    df = spark.createDataFrame(rows, "g string, s int, id long, v array<double>, trial int").repartition(5)
    got = {(r["g"], r["pair"]): (r["distance"], r["p"]) for r in analytics.shifts(df.where("g is not null"), ["g"], "s", "id", "v", 40, 7).collect()}
    want = _plain([r for r in rows if r[0]], 40, 7)
    assert got.keys() == want.keys() == {("a", 1), ("a", 2), ("b", 1)}
    assert all(np.allclose(got[k], want[k]) for k in want) and got["b", 1][1] == 1 / 41
    assert analytics.shifts(df.where("false"), ["g"], "s", "id", "v", 40).count() == 0
