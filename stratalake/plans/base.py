"""Loading tables and registering queries with their SQL counterparts."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from stratalake.functions.scalar import epoch_us


class Registry:
    def __init__(self):
        self.queries, self.oracles = {}, {}

    def __call__(self, sql: str | None = None):
        def keep(f):
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return keep


def load(spark: SparkSession, sf_dir: str, *names: str):
    found = tuple(spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names)
    return found[0] if len(found) == 1 else found


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", epoch_us(F.col("ts")).alias("us"), "user_id", "event_type", "value")


SERIES = "series AS (SELECT event_id, epoch_us(ts) AS us, user_id, event_type, value FROM events)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))


VECTORS = "vectors AS (SELECT vec_id, label::BIGINT AS label, embedding::DOUBLE[] AS v FROM embeddings)"


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as intervals in days: from the order to its last shipment."""
    orders, lines = load(spark, sf_dir, "orders", "lineitem")
    day = lambda c: F.floor(epoch_us(F.col(c)) / 86_400_000_000).cast("long")
    last = lines.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("m"))
    joined = orders.join(last, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"), F.col("o_orderpriority").alias("stream"), day("o_orderdate").alias("t0"), day("m").alias("t1"), F.col("o_totalprice").alias("price")).where("t0 <= t1")


SPANS = """spans AS (SELECT * FROM (SELECT o_orderkey AS id, o_custkey AS cust, o_orderpriority AS stream, (epoch_us(o_orderdate) // 86400000000)::BIGINT AS t0,
  (epoch_us(m) // 86400000000)::BIGINT AS t1, o_totalprice AS price FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS m FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey) WHERE t0 <= t1)"""
