"""Vector search and vector statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from stratalake.functions.scalar import unit

#: Rows of the right side in one block of a blocked product.
BLOCK = 20_000
#: Products that a task holds at once: of two blocks, as many rows meet the other block as make these (8 MB).
HELD = 1 << 20


def tiles(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Places of rows of a, and their products with all rows of b, HELD at most at a time (one row at least)."""
    step = max(1, HELD // max(len(b), 1))
    for lo in range(0, len(a), step):
        at = slice(lo, lo + step)
        yield at, a[at] @ b.T


def stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(float, copy=False)


def mean_vector(df: DataFrame, by: list[str], vector: str, weight: str | None = None) -> DataFrame:
    """Element-wise (weighted) mean of each key, combined before the shuffle, and how many rows it has."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    long = df.select(*by, w.alias("_w"), F.posexplode(vector).alias("_i", "_x"))
    m = long.groupBy(*by, "_i").agg((F.sum(F.col("_x").cast("double") * F.col("_w")) / F.sum("_w")).alias("_m"), F.count(F.lit(1)).alias("n"))
    return m.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda e: e["_m"]).alias(vector), F.max("n").alias("n"))


def centred(df: DataFrame, by: list[str], vector: str) -> DataFrame:
    """Vectors less the mean of their key, scaled to length one. Means are joined on the key; a hot key is split by
    adaptive execution."""
    m = mean_vector(df, by, vector).select(*by, F.col(vector).alias("_mean"))
    return df.join(m, by).withColumn(vector, unit(F.zip_with(vector, "_mean", lambda x, y: x.cast("double") - y))).drop("_mean")


def nearest(queries: DataFrame, corpus: DataFrame, key: str, vector: str, k: int, earlier_only: bool = False) -> DataFrame:
    """key, match, cosine, rank: the k most alike corpus rows of each query (earlier_only: among smaller keys).

    Blocked matrix products: the corpus is dealt into blocks by size, each query meets every block once, and a query's
    k best of all blocks are ranked at the end. Nothing is collected, and memory is bounded by two blocks and HELD products. Null vectors
    neither ask nor match, and vectors of different lengths don't meet.
    """
    corpus, queries = (x.where(F.col(vector).isNotNull()).withColumn("_dim", F.size(vector)) for x in (corpus, queries))
    n = corpus.count()
    blocks = max(1, -(-n // BLOCK))
    c = corpus.select(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("b"), F.lit(0).alias("part"), "_dim", F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vec"))
    parts = max(1, -(-queries.count() // BLOCK))
    q = queries.select(F.pmod(F.xxhash64(key), F.lit(parts)).alias("part"), "_dim", F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vec"))
    q = q.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    c = c.drop("part").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    kind = dict(corpus.select(F.col(key).alias("key")).dtypes)["key"]

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"key": [], "match": [], "cosine": []}
        if len(left) and len(right):
            a, b = stacked(left["vec"]), stacked(right["vec"])
            for x in (a, b):
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            right_keys, left_keys = right["key"].to_numpy(), left["key"].to_numpy()
            for at, s in tiles(a, b):
                if earlier_only:
                    s[right_keys[None, :] >= left_keys[at, None]] = -np.inf
                if k == 1:
                    top = s.argmax(1)[:, None]
                elif s.shape[1] > k:
                    top = np.argpartition(np.negative(s, out=s), k - 1, axis=1)[:, :k]
                    np.negative(s, out=s)
                else:
                    top = np.tile(np.arange(s.shape[1]), (len(s), 1))
                got = np.take_along_axis(s, top, 1)
                ok = np.isfinite(got)
                out["key"].append(np.repeat(left_keys[at], top.shape[1]).reshape(top.shape)[ok])
                out["match"].append(right_keys[top][ok])
                out["cosine"].append(got[ok])
        return pd.DataFrame({c: np.concatenate(v) if v else [] for c, v in out.items()})

    met = q.groupBy("b", "part", "_dim").cogroup(c.groupBy("b", "part", "_dim")).applyInPandas(meet, f"key {kind}, match {kind}, cosine double")
    w = Window.partitionBy("key").orderBy(F.desc("cosine"), "match")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def farthest_points(df: DataFrame, key: str, vector: str, count: int) -> DataFrame:
    """Greedy cover: from the smallest key on, the row farthest (1 - cosine) from those picked, `count` times.

    Each round is one distributed pass over what the last one kept: every row's vector and its distance to the picks, held
    by Spark so that no round repeats those before it. Only the pick reaches the driver.
    """
    rows = df.select(F.col(key).alias("key"), unit(F.col(vector)).alias("vec"), F.lit(float("inf")).alias("far")).persist()
    picked, spark = [], df.sparkSession
    best = rows.agg(F.min_by(F.struct("key", "vec", "far"), "key").alias("b")).first()["b"]
    while best is not None and len(picked) < count:
        picked.append((best["key"], float(best["far"]) if np.isfinite(best["far"]) else None, len(picked)))
        if len(picked) == count:
            break
        v = F.array(*map(F.lit, best["vec"]))
        d = 1 - F.aggregate(F.zip_with("vec", v, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        before, rows = rows, rows.withColumn("far", F.least(F.col("far"), F.greatest(d, F.lit(0.0)))).where("far > 1e-12").persist()
        best = rows.agg(F.max_by(F.struct("key", "vec", "far"), F.struct(F.round("far", 9), -F.col("key"))).alias("b")).first()["b"]
        before.unpersist()
    rows.unpersist()
    return spark.createDataFrame(picked, "key long, distance double, pick int")
