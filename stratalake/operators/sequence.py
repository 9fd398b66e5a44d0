"""Search by example in sequences of sparse word lists: scores, subsequence alignment, event chains."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from stratalake.operators.ranking import suppress

#: Rows of one chunk and of the overlap of neighbouring ones; only longer recordings are cut.
CHUNK, OVERLAP = 120, 40


def steps_from_vectors(vectors: DataFrame, top: int = 24) -> DataFrame:
    """rec, pos, floor, ids, lps: each vector as the `top` best of its log-softmax; floor is the last one listed."""
    w = Window.partitionBy("label").orderBy("vec_id")
    s = vectors.select("label", (F.row_number().over(w) - 1).cast("long").alias("pos"), "v")
    s = s.withColumn("z", F.log(F.aggregate("v", F.lit(0.0), lambda a, x: a + F.exp(x))))
    pairs = F.slice(F.array_sort(F.transform("v", lambda x, i: F.struct((F.col("z") - x).alias("loss"), i.alias("id")))), 1, top)
    s = s.withColumn("p", pairs)
    return s.select(F.col("label").alias("rec"), "pos", (-F.element_at("p", -1)["loss"]).alias("floor"), F.transform("p", lambda e: e["id"]).alias("ids"), F.transform("p", lambda e: -e["loss"]).alias("lps"))


def vocabulary(steps: DataFrame, union_k: int) -> DataFrame:
    """The distinct words among the first union_k of any step."""
    return steps.select(F.explode(F.slice("ids", 1, union_k)).alias("word")).distinct()


def excess(steps: DataFrame, vocab: DataFrame) -> DataFrame:
    """rec, pos, floor, word, delta: listed words of the vocabulary and what they exceed the step's floor by."""
    long = steps.select("rec", "pos", "floor", F.explode(F.arrays_zip("ids", "lps")).alias("e")).select("rec", "pos", "floor", F.col("e.ids").alias("word"), (F.col("e.lps") - F.col("floor")).alias("delta"))
    return long.join(vocab, "word", "left_semi")


def similarity(steps: DataFrame, anchor: DataFrame, vocab: DataFrame) -> DataFrame:
    """a, rec, pos, s: score of each step for each anchor row, S = sum over words of softmax(anchor) * (step - mean step).

    Sparse: a step is its floor plus the excess of its listed words, so the sum is the floor, a join on listed words, and
    one constant for each anchor row. The anchor is a query, some rows; its word weights are broadcast.
    """
    n = steps.agg(F.count(F.lit(1)).alias("n"), F.avg("floor").alias("f")).join(vocab.agg(F.count(F.lit(1)).alias("m")), F.lit(True))
    long = excess(steps, vocab)
    mean = long.groupBy("word").agg(F.sum("delta").alias("d"))
    q = excess(anchor, vocab).select(F.col("pos").alias("a"), "word", F.exp(F.col("delta") + F.col("floor")).alias("e"), F.exp("floor").alias("low"))
    total = anchor.select(F.col("pos").alias("a"), F.exp("floor").alias("low")).join(q.groupBy("a").agg(F.sum("e").alias("listed"), F.count(F.lit(1)).alias("k")), "a", "left")
    total = total.join(F.broadcast(n), F.lit(True)).select("a", (F.coalesce("listed", F.lit(0.0)) + (F.col("m") - F.coalesce("k", F.lit(0))) * F.col("low")).alias("z"), (F.col("low")).alias("low"), "n", "f")
    # weight of a listed word is e / z, of any other low / z: write it as low / z for all and the rest for the listed
    w = q.join(total.drop("low"), "a").select("a", "word", ((F.col("e") - F.col("low")) / F.col("z")).alias("w"))
    base = total.select("a", (F.col("low") / F.col("z")).alias("u"), "n", "f")
    const = w.join(mean, "word").join(base, "a").groupBy("a").agg(F.sum(F.col("w") * F.col("d") / F.col("n")).alias("c"))
    every = mean.agg(F.sum("d").alias("all"))
    base = base.join(const, "a", "left").join(every, F.lit(True)).select("a", "u", (F.col("f") + F.coalesce("c", F.lit(0.0)) + F.col("u") * F.col("all") / F.col("n")).alias("c"))
    own = long.groupBy("rec", "pos").agg(F.sum("delta").alias("sum"))
    part = long.join(F.broadcast(w), "word").groupBy("a", "rec", "pos").agg(F.sum(F.col("w") * F.col("delta")).alias("x"))
    rows = steps.select("rec", "pos", "floor").join(own, ["rec", "pos"], "left").join(F.broadcast(base), F.lit(True))
    return rows.join(part, ["a", "rec", "pos"], "left").select("a", "rec", "pos", (F.col("floor") + F.coalesce("x", F.lit(0.0)) + F.col("u") * F.coalesce("sum", F.lit(0.0)) - F.col("c")).alias("s"))


def curves(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Subsequence alignment of n anchor rows with many recordings at once (cost: recordings x n x m): for each recording
    and column the cost of the best path that ends there, over the rows of the anchor and the columns it spans, and the
    column it starts at.

    A path may start at any column and takes every anchor row; costs may be below 0, so the first row too can go on to the
    left. Of equal predecessors the diagonal comes first, then the anchor's row before, then the column before. A path
    that comes from above its own column starts after it and spans none, which counts as one.
    """
    many, n, m = cost.shape
    best, start = np.zeros((many, m + 1)), np.tile(np.arange(m + 1), (many, 1))
    for i in range(n):
        new, began = np.full((many, m + 1), np.inf), np.zeros((many, m + 1), np.int64)
        # the better of diagonal and row before is known for all columns; the column before chains along the row
        up = best[:, 1:] < best[:, :-1]
        before, first = np.where(up, best[:, 1:], best[:, :-1]), np.where(up, start[:, 1:], start[:, :-1])
        for j in range(m):
            left = new[:, j] < before[:, j]
            new[:, j + 1] = np.where(left, new[:, j], before[:, j]) + cost[:, i, j]
            began[:, j + 1] = np.where(left, began[:, j], first[:, j])
        best, start = new, began
    return best[:, 1:] / (n + np.maximum(np.arange(1, m + 1) - start[:, 1:], 1)), start[:, 1:]


def curve(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for one recording (cost: n x m)."""
    c, s = curves(cost[None])
    return c[0], s[0]


def local_minima(c: np.ndarray) -> np.ndarray:
    """Whether each value is no more than the one before and less than the one after."""
    return np.append(True, c[1:] <= c[:-1]) & np.append(c[:-1] < c[1:], True)


def chunked(scores: DataFrame) -> DataFrame:
    """Adds the chunks a row is in: one, or two where they overlap."""
    size = F.max("pos").over(Window.partitionBy("rec")) + 1
    hop = CHUNK - OVERLAP
    first = F.greatest(F.lit(0), F.floor((F.col("pos") - CHUNK) / hop) + 1)
    last = F.least(F.floor(F.col("pos") / hop), F.floor((F.col("_n") - OVERLAP - 1) / hop))
    marked = scores.withColumn("_n", size).withColumn("chunk", F.explode(F.when(F.col("_n") <= CHUNK, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.least(first, last).cast("long"), last.cast("long")))))
    return marked.drop("_n")


def subsequences(scores: DataFrame) -> DataFrame:
    """rec, begin, end, score: local minima of the alignment curve of every recording. A recording's scores are gathered
    by chunks of CHUNK rows at most, and the chunks of a batch are aligned at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            grids = [np.array(list(cells), float).reshape(-1, size) for cells, size in zip(pdf["cells"], pdf["size"])]
            for shape in sorted({g.shape for g in grids}):
                at = [k for k, g in enumerate(grids) if g.shape == shape]
                cost, start = curves(1 - np.stack([grids[k] for k in at]))
                for k, c, s in zip(at, cost, start):
                    ends = np.nonzero(local_minima(c) & (s <= np.arange(len(c))))[0]
                    low = pdf["low"].iloc[k]
                    found += [(pdf["rec"].iloc[k], pdf["chunk"].iloc[k], low + s[j], low + j, -c[j]) for j in ends]
            yield pd.DataFrame(found, columns=["rec", "chunk", "begin", "end", "score"])

    kind = dict(scores.dtypes)["rec"]
    cells = F.array_sort(F.collect_list(F.struct("a", "pos", "s")))
    gathered = chunked(scores).groupBy("rec", "chunk").agg(F.transform(cells, lambda e: e["s"]).alias("cells"), F.min("pos").alias("low"), F.count_distinct("pos").cast("int").alias("size"))
    found = gathered.mapInPandas(run, f"rec {kind}, chunk long, begin long, end long, score double")
    return found.groupBy("rec", "begin", "end").agg(F.max_by("score", "chunk").alias("score"))  # the later chunk's, where two see one span


def whole(scores: DataFrame, spans: DataFrame) -> DataFrame:
    """rec, begin, end, s: how like each span (rec, begin, end) is to the whole anchor, end to end: less the cost of the
    best path from corner to corner over the rows of both."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            grids = [np.array(list(cells), float).reshape(-1, e - b + 1) for cells, b, e in zip(pdf["cells"], pdf["begin"], pdf["end"])]
            out = np.zeros(len(grids))
            for shape in sorted({g.shape for g in grids}):
                at = [k for k, g in enumerate(grids) if g.shape == shape]
                out[at] = corner_costs(1 - np.stack([grids[k] for k in at])) / -sum(shape)
            yield pd.DataFrame({"rec": pdf["rec"], "begin": pdf["begin"], "end": pdf["end"], "s": out})

    kind = dict(scores.dtypes)["rec"]
    places = spans.select("rec", "begin", "end").distinct().withColumn("pos", F.explode(F.sequence("begin", "end")))
    cells = places.join(scores, ["rec", "pos"]).groupBy("rec", "begin", "end").agg(F.transform(F.array_sort(F.collect_list(F.struct("a", "pos", "s"))), lambda e: e["s"]).alias("cells"))
    return cells.mapInPandas(run, f"rec {kind}, begin long, end long, s double")


def corner_costs(cost: np.ndarray) -> np.ndarray:
    """The cost of the best path from the first to the last corner of each table (tables x n x m)."""
    many, n, m = cost.shape
    best = np.full((many, m + 1), np.inf)
    best[:, 0] = 0
    for i in range(n):
        before, new = np.minimum(best[:, 1:], best[:, :-1]), np.full((many, m + 1), np.inf)
        for j in range(m):
            new[:, j + 1] = np.minimum(new[:, j], before[:, j]) + cost[:, i, j]
        best = new
    return best[:, -1]


def find(steps: DataFrame, anchor: DataFrame | list[DataFrame], top: int, union_k: int = 24, exclude: DataFrame | None = None, shots: int = 1, recs: DataFrame | None = None) -> DataFrame:
    """The best `top` spans like the anchor, none overlapping or touching another, none that overlaps an excluded span
    (rec, x0, x1), of all recordings or those in recs (rec).

    Of several anchors every one proposes spans, and a span's score is its mean likeness to all, end to end. With more
    shots than one the best span of each recording whose best is no worse than the mean of these bests becomes an anchor
    as well. Anchors are few: a list, and a span of each recording; each is searched for by a pass of its own.
    """
    vocab = vocabulary(steps, union_k)
    anchors = anchor if isinstance(anchor, list) else [anchor]

    def proposed(a: DataFrame) -> tuple[DataFrame, DataFrame]:
        scores = similarity(steps, a, vocab)
        if recs is not None:
            scores = scores.join(recs.select("rec").distinct(), "rec", "left_semi")
        found = subsequences(scores)
        if exclude is not None:
            x = exclude.select(F.col("rec").alias("_r"), "x0", "x1")
            found = found.join(F.broadcast(x), (F.col("rec") == F.col("_r")) & (F.col("begin") <= F.col("x1")) & (F.col("x0") <= F.col("end")), "left_anti")
        return scores, found

    made = [proposed(a) for a in anchors]
    pool = made[0][1]
    for _, more in made[1:]:
        pool = pool.unionByName(more)
    pool = pool.groupBy("rec", "begin", "end").agg(F.max("score").alias("score"))
    if shots > 1:
        best = pool.groupBy("rec").agg(F.max_by(F.struct("begin", "end", "score"), F.struct("score", -F.col("begin"), -F.col("end"))).alias("b")).select("rec", "b.*")
        bar = best.agg(F.avg("score").alias("bar"))
        for r in best.join(F.broadcast(bar), F.col("score") >= F.col("bar")).orderBy("rec").collect():  # a span of a recording each
            made.append(proposed(steps.where((F.col("rec") == r["rec"]) & F.col("pos").between(r["begin"], r["end"]))))
            pool = pool.select("rec", "begin", "end").unionByName(made[-1][1].select("rec", "begin", "end")).distinct()
    if len(made) > 1:
        likeness = [whole(scores, pool) for scores, _ in made]
        total = likeness[0]
        for more in likeness[1:]:
            total = total.unionByName(more)
        pool = total.groupBy("rec", "begin", "end").agg((F.sum("s") / len(made)).alias("score"))
    return suppress(pool, ["rec"], "begin", "end", "score", top)


def align_path(cost: np.ndarray) -> list[tuple[int, int]]:
    """Global alignment path from corner to corner."""
    n, m = cost.shape
    total = np.full((n + 1, m + 1), np.inf)
    total[0, 0] = 0
    for i in range(n):
        for j in range(m):
            total[i + 1, j + 1] = cost[i, j] + min(total[i, j], total[i, j + 1], total[i + 1, j])
    path, i, j = [], n, m
    while i and j:
        path.append((i - 1, j - 1))
        moves = ((total[i - 1, j - 1], i - 1, j - 1), (total[i - 1, j], i - 1, j), (total[i, j - 1], i, j - 1))
        _, i, j = min(moves, key=lambda x: x[0])
    return path[::-1]


def chain(scores: DataFrame, follows: DataFrame, clauses: int) -> DataFrame:
    """end, score: the best mean score of `clauses` clauses on spans that follow one another.

    scores: clause (from 0), node, score; follows: before, node. One join and a grouped maximum for each clause.
    """
    best = scores.where("clause = 0").select("node", F.col("score").alias("total"))
    for k in range(1, clauses):
        came = best.withColumnRenamed("node", "before").join(follows, "before").groupBy("node").agg(F.max("total").alias("total"))
        best = came.join(scores.where(F.col("clause") == k), "node").select("node", (F.col("total") + F.col("score")).alias("total"))
    return best.select(F.col("node").alias("end"), (F.col("total") / clauses).alias("score"))
