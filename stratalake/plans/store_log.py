"""Log folds, pruning and retention as relations, and streams run to their end."""

from __future__ import annotations

import uuid

import pyspark.sql.functions as F

from stratalake.functions.scalar import epoch_us
from stratalake.operators import ranking
from stratalake.plans.base import Registry, load
from stratalake.streaming import operators as streams

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
# a log made of events: each one adds or removes one of 500 files at a version
LOG = "log AS (SELECT event_id AS version, 'f' || (event_id * 7919 % 500) AS path, CASE WHEN event_type IN ('error', 'signup') THEN 'remove' ELSE 'add' END AS op, value AS lo, value + 10 AS hi FROM events)"
STATE = f"{LOG}, state AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY version DESC) AS k FROM log WHERE version <= 900) WHERE k = 1 AND op = 'add')"


def _log(spark, d):
    e = load(spark, d, "events")
    return e.select(F.col("event_id").alias("version"), F.concat(F.lit("f"), (F.col("event_id") * 7919 % 500).cast("string")).alias("path"),
                    F.when(F.col("event_type").isin("error", "signup"), "remove").otherwise("add").alias("op"), F.col("value").alias("lo"), (F.col("value") + 10).alias("hi"))


def _state(spark, d, version):
    last = _log(spark, d).where(F.col("version") <= version).groupBy("path").agg(F.max_by(F.struct("version", "op", "lo", "hi"), "version").alias("s"))
    return last.select("path", "s.*").where("op = 'add'")


@query(f"WITH {STATE} SELECT path, version FROM state")
def log_fold(spark, d):
    return _state(spark, d, 900).select("path", "version")


@query(f"WITH {STATE} SELECT path FROM state WHERE hi >= 50 AND lo <= 60")
def file_prune(spark, d):
    return _state(spark, d, 900).where("hi >= 50 and lo <= 60").select("path")


@query(f"WITH {STATE} SELECT DISTINCT path FROM log WHERE path NOT IN (SELECT path FROM state)")
def vacuum_set(spark, d):
    return _log(spark, d).select("path").distinct().join(_state(spark, d, 900).select("path"), "path", "left_anti")


@query(f"WITH {LOG} SELECT version // 100 AS era, op, count(*) AS n FROM log GROUP BY 1, 2")
def log_history(spark, d):
    return _log(spark, d).groupBy(F.floor(F.col("version") / 100).alias("era"), "op").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, epoch_us(time_bucket(INTERVAL '1 day', ts)) AS t0, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark, d):
    s = streams.file_stream(spark, d, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    found = streams.run_to_end(streams.tumbling(s, "ts", "1 day", "40 days", "event_type", n=F.count(F.lit(1))), f"t{uuid.uuid4().hex}", "complete")
    return found.select("event_type", epoch_us(F.col("window.start")).alias("t0"), "n")


@query("SELECT DISTINCT event_id % 1000 AS key FROM events")
def stream_dedupe(spark, d):
    s = streams.file_stream(spark, d, "events.parquet").select((F.col("event_id") % 1000).alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return streams.run_to_end(streams.once_each(s, "key", "ts", "40 days"), f"t{uuid.uuid4().hex}").select("key")


@query()
def stream_sampler(spark, d):
    s = streams.file_stream(spark, d, "events.parquet").select("event_type", (epoch_us(F.col("ts")) / 1e6).alias("t"), "value")
    return streams.run_to_end(streams.grid_sampler(s, "event_type", "t", "value", 3600.0, 4), f"t{uuid.uuid4().hex}")


@query("SELECT event_id, sum(user_id) OVER (ORDER BY event_id DESC)::BIGINT AS used FROM events QUALIFY used <= 4096")
def token_budget(spark, d):
    """The newest rows whose token counts sum to a budget."""
    return ranking.within_budget(load(spark, d, "events"), "event_id", "user_id", 4096, "used").select("event_id", "used")


@query("SELECT event_id, sum(user_id) OVER (ORDER BY event_id DESC)::BIGINT AS used FROM events QUALIFY used <= 4096")
def token_budget_all(spark, d):
    """The newest of all rows whose token counts sum to a budget."""
    return ranking.within_budget(load(spark, d, "events"), "event_id", "user_id", 4096, "used").select("event_id", "used")
