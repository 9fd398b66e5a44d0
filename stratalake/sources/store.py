"""A versioned store of Parquet tables under a commit log.

A table is a folder of Parquet parts and a log of JSON commits, one file for each version, created exclusively: of two
writers with the same version one fails and tries again on top of the other. A version's files follow from folding the
log from the nearest checkpoint. Everything goes through Hadoop's file systems, so a store lives wherever Spark reads.
Only metadata is handled on the driver: rows are read, rewritten and summarised by Spark jobs.

Every table has a column ts (long, not null); a column t1, if there is one, makes its rows intervals [ts, t1].
"""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import asdict, dataclass, field

import pyarrow as pa
import pyspark.sql.functions as F
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

CHECKPOINT_EVERY, RETRIES = 10, 5
#: File systems where a link or a rename fails if the name is taken, so that of two writers one sees the other.
EXCLUSIVE = ("file", "hdfs", "viewfs", "webhdfs", "abfs", "abfss")
#: Files that no version ever had may be of a write under way: they are spared until they are so old (seconds).
UNDER_WAY = 24 * 3600


class CommitConflict(RuntimeError):
    """Files that a commit removes are no longer in the table."""


@dataclass
class FileEntry:
    path: str
    rows: int
    bytes: int
    min_ts: int | None
    max_ts: int | None
    max_end: int | None
    zone: dict = field(default_factory=dict)

    def overlaps(self, t0: int | None, t1: int | None) -> bool:
        end = self.max_end if self.max_end is not None else self.max_ts
        return not self.rows or ((t0 is None or end is None or end >= t0) and (t1 is None or self.min_ts is None or self.min_ts <= t1))

    def may_hold(self, column: str, low, high) -> bool:
        """Whether a row may lie in [low, high]. A bound that is NaN (which sorts after all numbers) compares as neither, so it
        rules nothing out."""
        zone = self.zone.get(column)
        return zone is None or zone[0] is None or (low is None or not zone[1] < low) and (high is None or not zone[0] > high)


class Files:
    """The few file operations a log needs, on any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str, single_writer: bool = False):
        self.jvm, self.single_writer = spark._jvm, single_writer
        path = self.jvm.org.apache.hadoop.fs.Path(root)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.path = self.jvm.org.apache.hadoop.fs.Path

    def exists(self, at: str) -> bool:
        return self.fs.exists(self.path(at))

    def names(self, at: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(at))) if self.exists(at) else []

    def sizes(self, at: str) -> dict[str, int]:
        return {s.getPath().getName(): s.getLen() for s in self.fs.listStatus(self.path(at))} if self.exists(at) else {}

    def ages(self, at: str) -> dict[str, float]:
        """Seconds since each file was changed."""
        now = time.time()
        return {s.getPath().getName(): now - s.getModificationTime() / 1000 for s in self.fs.listStatus(self.path(at))} if self.exists(at) else {}

    def read(self, at: str) -> str:
        stream = self.fs.open(self.path(at))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, at: str, text: str) -> bool:
        """Writes a whole new file; False if there is one of that name. It is written beside and then published in one
        step that fails where the name is taken: a hard link on local disks, a rename elsewhere (which HDFS refuses). Where
        neither fails (object stores) two writers could both win, so writing is refused unless there is a single writer."""
        if self.fs.getUri().getScheme() not in EXCLUSIVE and not self.single_writer:
            raise ValueError(f"{self.fs.getUri().getScheme()} can't create files exclusively: open the store with single_writer=True if nobody else writes")
        temporary = self.path(f"{at}.{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(temporary, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if self.fs.getUri().getScheme() == "file":
                local = lambda p: self.jvm.java.io.File(p.toUri().getPath()).toPath()
                self.jvm.java.nio.file.Files.createLink(local(self.path(at)), local(temporary))
                return True
            return not self.exists(at) and self.fs.rename(temporary, self.path(at))
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        finally:
            self.fs.delete(temporary, False)

    def delete(self, at: str) -> None:
        self.fs.delete(self.path(at), True)


class Table:
    def __init__(self, store: Store, name: str):
        self.store, self.spark, self.name, self.root = store, store.spark, name, f"{store.root}/{name}"
        self.files_ = store.files

    # log

    def versions(self) -> list[int]:
        return [int(n[:20]) for n in self.files_.names(f"{self.root}/_log") if n.endswith(".json") and n[:20].isdigit()]

    def _commit_at(self, version: int) -> dict:
        return json.loads(self.files_.read(f"{self.root}/_log/{version:020d}.json"))

    def state(self, version: int | None = None) -> dict:
        """version, kind, schema, meta and the files by path at a version (default: the last)."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        elif known and version not in known and version != 0:
            raise ValueError(f"{self.name} has no version {version}")
        state = {"version": version, "kind": None, "schema": None, "meta": {}, "files": {}}
        checkpoints = [int(n[:20]) for n in self.files_.names(f"{self.root}/_log") if n.endswith(".checkpoint") and int(n[:20]) <= version]
        if checkpoints:
            state = json.loads(self.files_.read(f"{self.root}/_log/{checkpoints[-1]:020d}.checkpoint"))
            state["files"] = {p: FileEntry(**f) for p, f in state["files"].items()}
        for v in known:
            if state["version"] < v <= version or (not checkpoints and v <= version):
                c = self._commit_at(v)
                for path in c["remove"]:
                    state["files"].pop(path, None)
                state["files"] |= {f["path"]: FileEntry(**f) for f in c["add"]}
                state["meta"] |= c["meta"]
                state["kind"], state["schema"] = c["kind"] or state["kind"], c["schema"] or state["schema"]
        state["version"] = version
        return state

    def commit(self, op: str, add: list[FileEntry], remove: list[str] = (), meta: dict | None = None, schema: T.StructType | None = None, kind: str | None = None, on: int | None = None, evolve: bool = False) -> int:
        """Adds a version and returns it. on: the version that the change was computed from, if it holds for no other.
        schema: that of the rows added; it joins the table's as of the version before, whoever wrote that."""
        for _ in range(RETRIES):
            now = self.state()
            if on is not None and now["version"] != on:
                raise CommitConflict(f"{self.name} is at version {now['version']}, no longer {on}")
            if missing := [p for p in remove if p not in now["files"]]:
                raise CommitConflict(f"{len(missing)} files are gone from {self.name}")
            version = now["version"] + 1
            whole = self._law(schema, now["schema"] and T.StructType.fromJson(json.loads(now["schema"])), evolve) if schema else None
            entry = {"version": version, "ts_utc": time.time(), "op": op, "kind": kind, "schema": whole.json() if whole else None, "add": [asdict(f) for f in add], "remove": list(remove), "meta": meta or {}}
            if self.files_.create(f"{self.root}/_log/{version:020d}.json", json.dumps(entry)):
                if version % CHECKPOINT_EVERY == 0:
                    state = self.state(version)
                    self.files_.create(f"{self.root}/_log/{version:020d}.checkpoint", json.dumps(state | {"files": {p: asdict(f) for p, f in state["files"].items()}}))
                return version
        raise CommitConflict(f"no free version of {self.name} in {RETRIES} tries")

    def history(self) -> DataFrame:
        rows = [(c["version"], c["ts_utc"], c["op"], len(c["add"]), len(c["remove"]), sum(f["rows"] for f in c["add"])) for c in map(self._commit_at, self.versions())]
        return self.spark.createDataFrame(rows, "version long, ts_utc double, op string, files_added long, files_removed long, rows_added long")

    def files(self, version: int | None = None) -> list[str]:
        return [f"{self.root}/{p}" for p in sorted(self.state(version)["files"])]

    def schema(self, version: int | None = None) -> T.StructType | None:
        raw = self.state(version)["schema"]
        return T.StructType.fromJson(json.loads(raw)) if raw else None

    # writing

    @staticmethod
    def _law(schema: T.StructType, old: T.StructType | None, evolve: bool) -> T.StructType:
        """The schema of a table with rows of `schema` added to those of `old`."""
        kinds = {f.name: f.dataType for f in schema}
        if kinds.get("ts") != T.LongType():
            raise ValueError("a table needs a long column ts")
        if old is None:
            return schema
        before = {f.name: f.dataType for f in old}
        for f in schema:
            if f.name in before and f.dataType != before[f.name]:
                raise ValueError(f"{f.name} is {before[f.name].simpleString()}, not {f.dataType.simpleString()}")
        new, gone = [f for f in schema if f.name not in before], set(before) - set(kinds)
        if (new or gone) and not evolve:
            raise ValueError(f"columns differ: new {[f.name for f in new]}, missing {sorted(gone)}")
        return T.StructType([*old, *(T.StructField(f.name, f.dataType, True) for f in new)])

    def _checked(self, df: DataFrame, evolve: bool) -> T.StructType:
        """df's schema, once it is known to suit the table as it is now; the commit tells whether it still does."""
        self._law(df.schema, self.schema(), evolve)
        return df.schema

    def _write(self, df: DataFrame, order: list[str] | None = None) -> list[FileEntry]:
        """Parts of a write with their statistics, gathered by one grouped pass over what was written."""
        layout = self.state()["meta"].get("layout")
        if order or layout:
            by = order or [layout, "ts"]
            df = df.repartitionByRange(*by[:1]).sortWithinPartitions(*by)
        at = f"data/{uuid.uuid4().hex}"
        df.withColumn("ts", F.when(F.col("ts").isNotNull(), F.col("ts")).otherwise(F.raise_error(F.lit("ts is null")).cast("long"))).write.option("compression", "zstd").parquet(f"{self.root}/{at}")
        sizes = self.files_.sizes(f"{self.root}/{at}")
        read = self.spark.read.parquet(f"{self.root}/{at}").withColumn("_file", F.col("_metadata.file_name"))
        zones = [c for c, k in df.dtypes if k in ("bigint", "int", "double", "string") and c not in ("ts", "t1")]
        end = F.max(F.coalesce("t1", "ts")) if "t1" in df.columns else F.lit(None).cast("long")
        stats = read.groupBy("_file").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"), end.alias("e"), *(f(c).alias(f"{k}_{c}") for c in zones for k, f in (("lo", F.min), ("hi", F.max))))
        return [FileEntry(f"{at}/{r['_file']}", r["n"], sizes[r["_file"]], r["a"], r["b"], r["e"], {c: [r[f"lo_{c}"], r[f"hi_{c}"]] for c in zones}) for r in stats.toLocalIterator()]

    def append(self, df: DataFrame, evolve: bool = False, kind: str = "timeseries") -> int:
        schema = self._checked(df, evolve)
        return self.commit("append", self._write(df), schema=schema, kind=kind, evolve=evolve)

    def append_grouped(self, df: DataFrame, group: str) -> int:
        """Clustered by a column, so that its values lie in few files."""
        schema = self._checked(df, False)
        return self.commit("append", self._write(df, [group, "ts"]), schema=schema)

    def set_layout(self, column: str) -> int:
        return self.commit("layout", [], meta={"layout": column})

    def replace(self, df: DataFrame, on: int | None = None) -> int:
        """All rows by others. on: the version that df was computed from; if the table has another by then, nothing is
        written and CommitConflict raised, so that rows appended meanwhile aren't lost. Default: the version at the call.
        """
        state = self.state(on)
        schema = self._checked(df, True)
        add = self._write(df)
        if not sum(f.rows for f in add):
            raise ValueError("a replacement without rows is refused")
        return self.commit("replace", add, list(state["files"]), schema=schema, on=state["version"], evolve=True)

    def compact(self) -> int:
        """Few files by ts (or the layout), with their statistics."""
        state = self.state()
        old = list(state["files"])  # rows appended meanwhile are in other files, which stay
        return self.commit("compact", self._write(self.read(state["version"]), None if self.state()["meta"].get("layout") else ["ts"]), old)

    def delete_range(self, t0: int, t1: int) -> int:
        """Drops rows with ts in [t0, t1]: covered files go, others that may hold such rows are written anew."""
        state = self.state()
        hit = {p: f for p, f in state["files"].items() if f.rows and f.min_ts <= t1 and f.max_ts >= t0}
        partly = [p for p, f in hit.items() if not (t0 <= f.min_ts and f.max_ts <= t1)]
        add = self._write(self._of(partly).where(~F.col("ts").between(t0, t1))) if partly else []
        return self.commit("delete", [f for f in add if f.rows], list(hit))

    # reading

    def _of(self, paths: list[str], version: int | None = None) -> DataFrame:
        schema = self.schema(version)
        if not paths:
            return self.spark.createDataFrame([], schema or T.StructType([T.StructField("ts", T.LongType())]))
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{p}" for p in paths))

    def read(self, version: int | None = None) -> DataFrame:
        return self._of(sorted(self.state(version)["files"]), version)

    def pruned(self, t0=None, t1=None, zones: dict | None = None, version: int | None = None) -> list[str]:
        """Paths of files whose statistics allow a match."""
        files = self.state(version)["files"]
        return sorted(p for p, f in files.items() if f.overlaps(t0, t1) and all(f.may_hold(c, lo, hi) for c, (lo, hi) in (zones or {}).items()))

    def scan(self, t0=None, t1=None, columns: list[str] | None = None, version: int | None = None) -> DataFrame:
        """Rows that meet [t0, t1], ordered by ts; ts always comes along."""
        df = self._of(self.pruned(t0, t1, version=version), version)
        end = F.coalesce("t1", "ts") if "t1" in df.columns else F.col("ts")
        if t0 is not None:
            df = df.where(end >= t0)
        if t1 is not None:
            df = df.where(F.col("ts") <= t1)
        return (df.select("ts", *(c for c in columns if c != "ts")) if columns else df).orderBy("ts")

    def scan_values(self, column: str, values: list, t0=None, t1=None, version: int | None = None) -> DataFrame:
        paths = {p for v in values for p in self.pruned(t0, t1, {column: (v, v)}, version)}
        df = self._of(sorted(paths), version).where(F.col(column).isin(values))
        return df.where(F.col("ts").between(t0 if t0 is not None else -(2**63), t1 if t1 is not None else 2**63 - 1))

    def where(self, column: str, low=None, high=None, version: int | None = None) -> DataFrame:
        df = self._of(self.pruned(zones={column: (low, high)}, version=version), version)
        df = df if low is None else df.where(F.col(column) >= low)
        return df if high is None else df.where(F.col(column) <= high)

    def elided(self, t0=None, t1=None, zones: dict | None = None) -> float:
        """Percentage of the table's bytes that pruning leaves unread."""
        files = self.state()["files"]
        total, touched = sum(f.bytes for f in files.values()), sum(files[p].bytes for p in self.pruned(t0, t1, zones))
        return 100 * (total - touched) / total if total else 0.0


class Store:
    def __init__(self, spark: SparkSession, root: str, single_writer: bool = False):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root, single_writer)

    @classmethod
    def create(cls, spark: SparkSession, root: str, single_writer: bool = False) -> Store:
        store = cls(spark, root, single_writer)
        if not store.files.create(f"{store.root}/_store.json", json.dumps({"format": 1})):
            raise FileExistsError(root)
        return store

    @classmethod
    def open(cls, spark: SparkSession, root: str, single_writer: bool = False) -> Store:
        store = cls(spark, root, single_writer)
        if not store.files.exists(f"{store.root}/_store.json"):
            raise FileNotFoundError(root)
        return store

    def tables(self) -> list[str]:
        return [n for n in self.files.names(self.root) if self.files.exists(f"{self.root}/{n}/_log")]

    def table(self, name: str) -> Table:
        return Table(self, name)

    def describe(self) -> DataFrame:
        rows = []
        for n in self.tables():
            s = self.table(n).state()
            f = [x for x in s["files"].values() if x.rows]
            rows.append((n, s["kind"], s["version"], sum(x.rows for x in f), sum(x.bytes for x in f), min((x.min_ts for x in f), default=None), max((x.max_ts for x in f), default=None)))
        return self.spark.createDataFrame(rows, "name string, kind string, version long, rows long, bytes long, min_ts long, max_ts long")

    def snapshot(self) -> dict[str, int]:
        return {n: self.table(n).state()["version"] for n in self.tables()}

    def sql(self, text: str, version: dict[str, int] | None = None) -> DataFrame:
        """Spark SQL over views of all tables, each at its pinned version if there is one."""
        for n in self.tables():
            self.table(n).read((version or {}).get(n)).createOrReplaceTempView(n)
        return self.spark.sql(text)

    def window(self, t0: int, t1: int, tables: list[str] | None = None, version: dict[str, int] | None = None) -> dict[str, DataFrame]:
        return {n: self.table(n).scan(t0, t1, version=(version or {}).get(n)) for n in tables or self.tables()}

    def aligned(self, tables: list[str], t0: int, t1: int, step: int, how: str = "nearest") -> DataFrame:
        """Numeric columns of several tables at the same regular times."""
        from stratalake.operators.intervals import resample

        out = self.spark.range(-(-t0 // step), t1 // step + 1).select((F.col("id") * step).alias("ts"))
        for n in tables:
            df = self.table(n).scan(t0, t1).withColumn("_one", F.lit(0))
            for c, k in df.dtypes:
                if k in ("double", "float", "int", "bigint") and c not in ("ts", "t1", "_one"):
                    out = out.join(resample(df.withColumn(c, F.col(c).cast("double")), ["_one"], "ts", c, step, how).select("ts", F.col(c).alias(f"{n}_{c}")), "ts", "left")
        return out

    def ingest(self, name: str, data, ts_column: str = "ts", evolve: bool = False, unit: str = "auto") -> int:
        """Appends rows in one commit; their time is a timestamp, ISO text or an epoch, whose unit (s, ms, us, ns) is told
        by the median magnitude unless it is named.

        data is a DataFrame, a pandas frame, an Arrow table, a dict of columns (whose values, nulls and large integers too,
        stay as they are), or the path of CSV (with a header) or Parquet files, which executors read in splits whatever
        their size; a folder is Parquet if files in it are.
        """
        from stratalake.functions.scalar import epoch_unit, epoch_us

        df = self._frame(data)
        if ts_column not in df.columns:
            raise ValueError(f"no column {ts_column!r} among {df.columns}")
        kind = dict(df.dtypes)[ts_column]
        if kind in ("timestamp", "timestamp_ntz", "date", "string"):
            ts = epoch_us(F.col(ts_column).cast("timestamp")) * 1000
        else:
            factors = {"s": 10**9, "ms": 10**6, "us": 10**3, "ns": 1}
            if unit != "auto" and unit not in factors:
                raise ValueError(f"no unit {unit!r}: auto, s, ms, us or ns")
            factor = factors.get(unit) or epoch_unit(df, ts_column).first()["to_ns"]
            ts = F.round(F.col(ts_column) * F.lit(factor).cast("long")).cast("long")
        return self.table(name).append(df.withColumn("_ts", ts.cast("long")).drop(*({ts_column, "ts"} & set(df.columns))).withColumnRenamed("_ts", "ts"), evolve)

    def _frame(self, data) -> DataFrame:
        if isinstance(data, DataFrame):
            return data
        if isinstance(data, (str, os.PathLike)):
            path = os.fspath(data)
            suffixes = (".parquet", ".pq")
            inside = [] if any(c in path for c in "*?{[") else Files(self.spark, path).names(path)
            return self.spark.read.parquet(path) if path.endswith(suffixes) or any(n.endswith(suffixes) for n in inside) else self.spark.read.csv(path, header=True, inferSchema=True)
        if isinstance(data, dict):
            lengths = {len(v) for v in data.values()}
            if len(lengths) > 1:
                raise ValueError("columns of different lengths")
            data = pa.table({k: pa.array(v) for k, v in data.items()})
        return self.spark.createDataFrame(data)

    def vacuum(self, retain: int = 3, dry_run: bool = True, under_way: float = UNDER_WAY) -> list[str]:
        """Data files that none of the last `retain` versions of their table refers to; deleted unless dry. Files that no
        version has had are left by a write that failed, or are of one under way: they go once they are `under_way` seconds
        old, which must be more than the longest write takes."""
        gone = []
        for n in self.tables():
            t = self.table(n)
            versions = t.versions()
            kept = {p for v in versions[-retain:] for p in t.state(v)["files"]}
            known = {f["path"] for v in versions for f in t._commit_at(v)["add"]}
            for d in self.files.names(f"{t.root}/data"):
                for f, age in self.files.ages(f"{t.root}/data/{d}").items():
                    path = f"data/{d}/{f}"
                    if f.startswith("part-") and path not in kept and (path in known or age > under_way):
                        gone.append(f"{t.root}/{path}")
        if not dry_run:
            for f in gone:
                self.files.delete(f)
        return gone

    def upsert(self, name: str, rows: DataFrame, keys: list[str], insert_only: list[str] = (), on: int | None = None) -> int:
        """Rows by key: new ones are added, known ones get the new values but for the insert-only columns and those that rows
        hasn't, which stay (null in new rows). Columns that the table hasn't are added, null in its other rows. Repeats of
        a key in rows must be equal; null keys are equal. Rewrites the table in one commit, bound to the version it read: if another came
        first, the rows are joined to that one anew. on: the only version the change holds for; another is a conflict."""
        for last in reversed(range(RETRIES)):
            try:
                return self._upsert(name, rows, keys, insert_only, on)
            except CommitConflict:
                if on is not None or not last:
                    raise
        raise AssertionError

    def _upsert(self, name: str, rows: DataFrame, keys: list[str], insert_only: list[str], on: int | None) -> int:
        t = self.table(name)
        version = t.state()["version"] if on is None else on
        if t.schema() is None:
            return t.commit("append", t._write(rows.dropDuplicates(keys)), schema=t._checked(rows, False), kind="timeseries", on=version)
        old, new = t.read(version).alias("o"), rows.dropDuplicates(keys).alias("n")
        same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
        own, held = set(old.columns), set(rows.columns)

        def value(c: str) -> Column:
            if c not in held or c not in own:
                return F.col(f"{'n' if c in held else 'o'}.{c}")
            if c in insert_only or c in keys:
                return F.coalesce(f"o.{c}", f"n.{c}")
            return F.when(F.col("n.ts").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

        pick = [value(c).alias(c) for c in (*old.columns, *(c for c in rows.columns if c not in own))]
        return t.replace(old.join(new, same, "full_outer").select(*pick), version)

    def write_new(self, name: str, rows: DataFrame, key: str) -> int:
        """Appends rows whose key the table doesn't hold yet, each once (null is a key too); how many there were."""
        t = self.table(name)
        for last in reversed(range(RETRIES)):
            version, new = t.state()["version"], rows.dropDuplicates([key])
            if t.schema() is not None:
                new = new.alias("n").join(t.read(version).select(F.col(key).alias("_key")), F.col(f"n.{key}").eqNullSafe(F.col("_key")), "left_anti")
            add = t._write(new)
            try:  # what is new depends on the version read
                t.commit("append", add, schema=t._checked(new, False), kind="timeseries", on=version)
                return sum(f.rows for f in add)
            except CommitConflict:
                if not last:
                    raise
        raise AssertionError
