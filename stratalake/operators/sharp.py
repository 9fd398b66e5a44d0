"""Two-tier search: a cheap space ranks everything, a dear one ranks the shortlist, and what the dear one says is kept."""

from __future__ import annotations

import time
from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from stratalake.functions.scalar import cosine
from stratalake.operators.vectors import nearest
from stratalake.sources.store import Store


def shortlisted(rows: DataFrame, asked: DataFrame, key: str, rough: str, shortlist: int) -> DataFrame:
    """key (of the question), match: the `shortlist` rows most alike in the cheap space."""
    return nearest(asked, rows, key, rough, shortlist).select("key", "match")


def search(store: Store, kept: str, rows: DataFrame, asked: DataFrame, key: str, rough: str, full: str, teach: Callable[[DataFrame], DataFrame], k: int = 10, shortlist: int = 48) -> tuple[DataFrame, int]:
    """(key, match, score, rank) of the k best of each question's shortlist by the dear space, and how many rows had to be
    computed in it for this search.

    rows: key and `rough`, a vector of the cheap space, of all that is searched; asked: key, `rough` and `full`, the
    question in both spaces; teach: from the rows of `rows` that are wanted to key and vec, their vectors in the dear
    space. Those are kept in the store's table `kept` under their key: a search computes what no search has, and adds it
    in one commit, each key once, whoever else adds rows meanwhile. Keys may be of any kind that text tells apart. Rows
    that teach gives no vector for are no hits, and are asked for again next time; null vectors match nothing; equal
    scores go by the smaller match. No questions, no hits.
    """
    short = shortlisted(rows, asked, key, rough, shortlist).checkpoint()
    table, name = store.table(kept), F.col(key).cast("string")
    wanted = rows.join(short.select(F.col("match").alias(key)).distinct(), key, "left_semi")
    if table.schema() is not None:
        wanted = wanted.join(table.read().select(F.col("id").alias("_id")), name == F.col("_id"), "left_anti")
    wanted, fresh = wanted.checkpoint(), 0
    if not wanted.isEmpty():
        taught = teach(wanted).where(F.col("vec").isNotNull())
        new = taught.select(F.lit(time.time_ns()).alias("ts"), name.alias("id"), F.col("vec").cast("array<double>").alias("vec"))
        fresh = store.write_new(kept, new, "id")
    if table.schema() is None:
        return short.select("key", "match", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).where("false"), fresh
    known = table.read().select("id", "vec")
    met = short.join(known, F.col("match").cast("string") == F.col("id")).join(asked.select(F.col(key).alias("key"), F.col(full).alias("_q")), "key")
    scored = met.select("key", "match", F.round(cosine(F.col("_q"), F.col("vec")), 9).alias("score"))
    best = Window.partitionBy("key").orderBy(F.desc("score"), "match")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), fresh
