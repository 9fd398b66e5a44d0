"""Shared helpers: input columns, shared-folder checkpoints, cached word hashes, components."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch; whole documents of up to some 100 KB stay within tens of MB.
BATCH_ROWS = 512
#: Distinct words a worker remembers before it starts afresh (about 50 MB).
WORDS_KEPT = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, and a checkpoint folder: the cluster's own. Where none is named, a session of one machine
    (master local) gets a temporary one; on a cluster that is an error, as its machines share no temporary folder."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "stratalake-checkpoints"))
    return spark


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until df has no such column (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def joined_spread(many: DataFrame, one: DataFrame, key: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """many joined on key (inner or left) with one, a row a key, whose `weight` is how many rows of many have the key and
    of which `total` is the sum. Keys with more than a quarter of an average task's rows are met by broadcast, so that no
    task gets all rows of a key: there are fewer than four times as many such keys as tasks, by that very sum."""
    tasks = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limit = max(64, total // (4 * tasks))
    hot, cold = one.where(F.col(weight) > limit).drop(weight), one.where(F.col(weight) <= limit).drop(weight)
    rest = many.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return many.join(F.broadcast(hot), key).unionByName(rest)


def cut(df: DataFrame) -> DataFrame:
    """Materialises in the shared checkpoint folder, so that a lost executor costs no recomputation."""
    ready(df.sparkSession)
    return df.checkpoint(eager=True)


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone: other columns, whatever their names, play no part."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names))


class WordHashes(dict):
    """word bytes -> 63-bit hash, computed once for each word kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word) >> 1
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words)).view(np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), element-wise on uint64."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def components(edges: DataFrame) -> DataFrame:
    """(u, v) pairs -> (node, component): the smallest node reachable, for every node that has an edge.

    Alternates two star contractions until nothing changes: first each node's larger neighbours, then its smaller
    ones, are tied to the smallest neighbour. Every step is a grouped minimum (combined before the shuffle) and an
    equi-join in which nodes with very many edges are met by broadcast. Loops and repeats are harmless.
    """

    def state(e: DataFrame) -> tuple:
        r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    now = cut(edges.where("u is not null and v is not null and u <> v")
              .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before, here = None, state(now)
    while here != before and here[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("k")).select("u", F.least("u", "m").alias("m"), "k")
        large = joined_spread(both, least, "u", "k", 2 * here[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = cut(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("k"))
        small = joined_spread(large, least, "u", "k", 2 * here[0]).select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        now = cut(small.select("e.u", "e.v").where("u <> v").distinct())
        before, here = here, state(now)
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component")))
