"""Structured Streaming forms: tumbling windows, deduplication, sampling on a grid, stability of files."""

from __future__ import annotations

import os
import tempfile

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState


def file_stream(spark: SparkSession, folder: str, name: str, files_each: int = 1) -> DataFrame:
    """A stream of the Parquet files of that name in a folder."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files_each).parquet(folder)


def tumbling(stream: DataFrame, on: str, width: str, late: str, *by: str, **aggregates) -> DataFrame:
    """Aggregates of epoch-aligned windows; rows later than `late` behind the newest are left out."""
    s = stream.withWatermark(on, late).groupBy(F.window(on, width), *by)
    return s.agg(*(a.alias(n) for n, a in aggregates.items()))


def once_each(stream: DataFrame, key: str, on: str, late: str) -> DataFrame:
    """Each key once among rows no later than `late` apart: a repeated row changes nothing."""
    return stream.withWatermark(on, late).dropDuplicatesWithinWatermark([key])


def grid_sampler(stream: DataFrame, by: str, time: str, value: str, period: float, size: int) -> DataFrame:
    """Takes a key's first row at or after each time of a grid of `period` seconds, and emits an atom (key, t0, mean) when
    `size` rows have been taken. t0 is the grid time that the atom's first row was due on, so atoms tile the stream
    whatever its jitter; the grid begins at the last multiple of `period` before the key's first row. A row without a
    value ends its key's recording: a partial atom is emitted as it is, and the next row begins a new grid. State holds at
    most `size` values a key; rows must come in time order within a key."""

    def step(key, frames, state: GroupState):
        due, t0, held = state.get if state.exists else (None, None, [])
        held, out = list(held), []
        for pdf in frames:
            for t, v in pdf.sort_values(time)[[time, value]].itertuples(index=False):
                if pd.isna(v):
                    if held:
                        out.append((key[0], t0, sum(held) / len(held)))
                    due, held = None, []
                    continue
                due = t // period * period if due is None else due
                if t >= due - 1e-9:
                    t0 = due if not held else t0
                    held.append(float(v))
                    due += period
                    if len(held) == size:
                        out.append((key[0], t0, sum(held) / size))
                        held = []
        state.update((due, t0, held))
        yield pd.DataFrame(out, columns=[by, "t0", "mean"])

    kind = dict(stream.dtypes)[by]
    return stream.groupBy(by).applyInPandasWithState(step, f"{by} {kind}, t0 double, mean double", "due double, t0 double, held array<double>", "append", "NoTimeout")


def stable_files(polls: DataFrame) -> DataFrame:
    """path of each file, once, when two polls in a row saw it with the same size and time.

    polls: stream of path, size, mtime."""

    def step(key, frames, state: GroupState):
        before, done = state.get if state.exists else ("", False)
        out = []
        for pdf in frames:
            for size, mtime in pdf[["size", "mtime"]].itertuples(index=False):
                seen = f"{size}:{mtime}"
                if seen == before and not done:
                    out.append(key[0])
                    done = True
                before = seen
        state.update((before, done))
        yield pd.DataFrame({"path": out})

    return polls.groupBy("path").applyInPandasWithState(step, "path string", "before string, done boolean", "append", "NoTimeout")


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What a stream gives once all its present input is processed, read from files in the shared checkpoint folder. In
    complete mode each batch is the whole result and replaces the one before."""
    spark = stream.sparkSession
    at = f"{shared_folder(spark)}/streams/{name}"
    out = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{at}/progress")
    if mode == "append":
        query = out.format("parquet").option("path", f"{at}/rows").start()
    else:
        query = out.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{at}/rows")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints; a temporary one on a single machine that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return named or os.path.join(tempfile.gettempdir(), "stratalake-checkpoints")
