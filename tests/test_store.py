import pytest

from stratalake.sources.store import CommitConflict, Store


@pytest.fixture
def store(spark, tmp_path):
    return Store.create(spark, f"{tmp_path}/s")


def rows(spark, *r):
    return spark.createDataFrame(list(r), "ts long, t1 long, v double, who string").coalesce(1)


def test_time_travel_pruning_and_intervals(spark, store):
    t = store.table("a")
    t.append(rows(spark, (100, 900, 1.0, "x"), (300, 310, 2.0, "y")))
    t.append(rows(spark, (2000, 2100, 3.0, "z")))
    assert [r["ts"] for r in t.scan(400, 500).collect()] == [100]  # the long row covers the window
    assert len(t.pruned(400, 500)) == 1 and t.elided(400, 500) > 0
    assert t.scan(columns=["v"]).columns == ["ts", "v"]
    assert t.read(1).count() == 2 and t.read().count() == 3
    assert [r["who"] for r in t.scan_values("who", ["z", "q"]).collect()] == ["z"]
    assert len(t.pruned(zones={"v": (2.5, None)})) == 1
    assert t.history().count() == 2 and store.snapshot() == {"a": 2}
    assert store.sql("select count(*) n from a", {"a": 1}).first()["n"] == 2


def test_rewrites_keep_statistics_and_conflicts_are_seen(spark, store):
    t = store.table("a")
    for k in range(12):  # past a checkpoint
        t.append(rows(spark, (10 * k, 10 * k + 3, float(k), "w")))
    assert t.state()["version"] == 12 and t.read(11).count() == 11 and t.read(5).count() == 5
    old = list(t.state()["files"])
    t.compact()
    assert t.read().count() == 12 and all(f.max_end is not None and f.zone for f in t.state()["files"].values())
    with pytest.raises(CommitConflict):
        t.commit("x", [], old)
    t.delete_range(20, 40)
    assert sorted(r["ts"] for r in t.read().collect()) == [0, 10, 50, 60, 70, 80, 90, 100, 110]
    gone = store.vacuum(1)
    assert gone and store.vacuum(100) == []
    store.vacuum(1, dry_run=False)
    assert t.read().count() == 9 and store.vacuum(1) == []


def test_schema_law_and_evolution(spark, store):
    t = store.table("a")
    t.append(rows(spark, (1, 2, 1.0, "x")))
    with pytest.raises(ValueError):
        t.append(spark.createDataFrame([(1, "no")], "ts long, v string"))
    with pytest.raises(ValueError):
        t.append(spark.createDataFrame([("1",)], "ts string"))
    with pytest.raises(ValueError):
        t.append(spark.createDataFrame([(1, 2, 1.0, "x", 5)], "ts long, t1 long, v double, who string, extra int"))
    t.append(spark.createDataFrame([(3, 4, 1.0, "x", 5)], "ts long, t1 long, v double, who string, extra int"), evolve=True)
    assert sorted((r["ts"], r["extra"]) for r in t.read().collect()) == [(1, None), (3, 5)]
    with pytest.raises(Exception, match="ts is null"):
        t.append(spark.createDataFrame([(None, 4, 1.0, "x", 5)], "ts long, t1 long, v double, who string, extra int"))
    with pytest.raises(ValueError):
        t.replace(t.read().limit(0))


def test_upserts_layout_ingest_and_alignment(spark, store):
    s = "ts long, id string, first long, score double"
    store.upsert("s", spark.createDataFrame([(1, "a", 1, 0.5), (1, "b", 1, 0.5)], s), ["id"], ["first"])
    store.upsert("s", spark.createDataFrame([(2, "b", 2, 0.9), (2, "c", 2, 0.1)], s), ["id"], ["first"])
    assert sorted((r["id"], r["first"], r["score"]) for r in store.table("s").read().collect()) == [("a", 1, 0.5), ("b", 1, 0.9), ("c", 2, 0.1)]
    new = spark.createDataFrame([(5, "c", 1, 0.0), (5, "d", 1, 0.0), (5, "d", 1, 0.0)], s)
    assert store.write_new("s", new, "id") == 1 and store.write_new("s", new, "id") == 0
    store.table("s").set_layout("id")
    store.table("s").compact()
    store.ingest("e", spark.createDataFrame([(1_700_000_000, 1.0), (1_700_000_010, 3.0)], "when long, v double"), "when")
    assert store.table("e").scan().first()["ts"] == 1_700_000_000 * 10**9
    got = store.aligned(["e"], 1_700_000_000 * 10**9, 1_700_000_010 * 10**9, 5 * 10**9, "linear")
    assert sorted(r["e_v"] for r in got.collect()) == [1.0, 2.0, 3.0]
    assert {r["name"] for r in store.describe().collect()} == {"s", "e"}
    with pytest.raises(FileNotFoundError):
        Store.open(spark, store.root + "-none")


def test_two_writers_lose_nothing(spark, tmp_path):
    """An append between the read and the commit of a replacement: the replacement is refused, an upsert done anew."""
    store = Store.create(spark, str(tmp_path / "two"))
    t = store.table("t")
    rows = lambda *xs: spark.createDataFrame(list(xs), "ts long, id string, v long")
    t.append(rows((1, "a", 1)))
    version = t.state()["version"]
    t.append(rows((2, "b", 2)))
    with pytest.raises(CommitConflict):
        t.replace(rows((9, "z", 9)), version)
    assert t.read().count() == 2
    held, writes = t._write, []

    def slow(df, order=None):
        made = held(df, order)
        if not writes:  # another writer comes first
            writes.append(1)
            store.table("t").append(rows((3, "c", 3)))
        return made

    store.table = lambda name, table=store.table: setattr(made := table(name), "_write", slow) or made if not writes else table(name)
    store.upsert("t", rows((4, "a", 7), (5, "d", 4)), ["id"])
    assert writes and sorted((r["id"], r["v"]) for r in t.read().collect()) == [("a", 7), ("b", 2), ("c", 3), ("d", 4)]


def test_a_name_is_created_once(spark, tmp_path):
    files = Store.create(spark, str(tmp_path / "once")).files
    at = str(tmp_path / "once" / "x.json")
    assert files.create(at, "1") and not files.create(at, "2") and files.read(at) == "1"
    assert not [n for n in files.names(str(tmp_path / "once")) if n.endswith(".tmp")]


def test_ingest_of_files_dicts_and_frames(spark, store, tmp_path):
    (tmp_path / "x.csv").write_text("when,v\n1700000000,1.5\n1700000010,2.5\n")
    (tmp_path / "iso.csv").write_text("when,v\n2024-01-01T00:00:01Z,7\n")
    spark.createDataFrame([(5, 1.0)], "ts long, v double").write.parquet(str(tmp_path / "x.parquet"))
    store.ingest("csv", str(tmp_path / "x.csv"), "when")
    assert sorted(map(tuple, store.table("csv").read().select("ts", "v").collect())) == [(1_700_000_000 * 10**9, 1.5), (1_700_000_010 * 10**9, 2.5)]
    assert store.table("csv").state()["version"] == 1  # one commit
    store.ingest("iso", tmp_path / "iso.csv", "when")
    assert store.table("iso").read().first()["ts"] == 1_704_067_201 * 10**9
    store.ingest("parquet", str(tmp_path / "x.parquet"), unit="ms")
    assert store.table("parquet").read().first()["ts"] == 5_000_000
    store.ingest("dict", {"ts": [1, 2], "v": [0.5, 1.5]}, unit="ns")
    assert [r["ts"] for r in store.table("dict").read().orderBy("ts").collect()] == [1, 2]
    for bad in (lambda: store.ingest("bad", {"v": [1]}), lambda: store.ingest("bad", {"ts": [1]}, unit="h"), lambda: store.ingest("bad", {"ts": [1], "v": [1, 2]})):
        with pytest.raises(ValueError):
            bad()


def test_upserts_keep_columns_they_do_not_name(spark, store):
    t = store.table("a")
    t.append(spark.createDataFrame([(1, "k1", 7), (2, "k2", 8), (3, None, 9)], "ts long, id string, extra long"))
    store.upsert("a", spark.createDataFrame([(10, "k1", 0.5), (20, "new", 0.25), (30, None, 0.75)], "ts long, id string, more double"), ["id"])
    assert sorted(map(tuple, t.read().collect()), key=repr) == sorted([(10, "k1", 7, 0.5), (2, "k2", 8, None), (20, "new", None, 0.25), (30, None, 9, 0.75)], key=repr)


def test_nan_bounds_rule_nothing_out(spark, store):
    t, nan = store.table("a"), float("nan")
    t.append(rows(spark, (1, 2, nan, "x"), (3, 4, 1.0, "y")))
    t.append(rows(spark, (5, 6, nan, "x")))
    t.append(rows(spark, (7, 8, None, "x")))
    assert [r["ts"] for r in t.where("v", 0.5, 2.0).collect()] == [3]
    whole = t.read()
    for low, high in ((0.5, None), (None, 0.5), (2.0, None), (1.0, 1.0)):
        want = whole if low is None else whole.where(f"v >= {low}")
        want = want if high is None else want.where(f"v <= {high}")
        assert sorted(r["ts"] for r in t.where("v", low, high).collect()) == sorted(r["ts"] for r in want.collect())


def test_two_evolving_appends_keep_both_columns(spark, store):
    t = store.table("a")
    t.append(rows(spark, (1, 2, 1.0, "x")))
    one = spark.createDataFrame([(3, 4, 1.0, "x", 5)], "ts long, t1 long, v double, who string, p int")
    other = spark.createDataFrame([(5, 6, 1.0, "x", "q")], "ts long, t1 long, v double, who string, q string")
    schema, add = t._checked(other, True), t._write(other)  # written before, committed after the first
    t.append(one, evolve=True)
    t.commit("append", add, schema=schema, evolve=True)
    assert sorted((r["ts"], r["p"], r["q"]) for r in t.read().collect()) == [(1, None, None), (3, 5, None), (5, None, "q")]
    with pytest.raises(ValueError):  # and a kind that differs from what came meanwhile is refused
        t.append(spark.createDataFrame([(5, 6, 1.0, "x", "no")], "ts long, t1 long, v double, who string, p string"), evolve=True)


def test_vacuum_spares_a_write_under_way(spark, store):
    t = store.table("a")
    t.append(rows(spark, (1, 2, 1.0, "x")))
    df = rows(spark, (3, 4, 1.0, "y"))
    schema, add = t._checked(df, False), t._write(df)
    assert store.vacuum(1, dry_run=False) == []
    t.commit("append", add, schema=schema)
    assert t.read().count() == 2
    t._write(df)  # never committed
    assert len(store.vacuum(1, under_way=-1)) == 1
    for k in range(3):
        t.replace(rows(spark, (k, k, 1.0, "z")))
    assert t.read(t.state()["version"] - 2).count() == 1 and len(store.vacuum(dry_run=False)) == 2
    assert t.read(t.state()["version"] - 2).count() == 1


def test_dicts_keep_their_numbers(spark, store, tmp_path):
    store.ingest("a", {"ts": [1, 2], "k": [9007199254740993, None]}, unit="ns")
    assert sorted((r["ts"], r["k"]) for r in store.table("a").read().collect()) == [(1, 9007199254740993), (2, None)]
    rows(spark, (1, 2, 1.0, "x")).write.parquet(f"{tmp_path}/folder")
    store.ingest("b", f"{tmp_path}/folder", unit="ns")
    assert store.table("b").read().count() == 1


def test_null_keys_are_written_once(spark, store):
    one = spark.createDataFrame([(1, None), (2, "a"), (2, "a")], "ts long, k string")
    assert [store.write_new("a", one, "k") for _ in range(3)] == [2, 0, 0]


def test_object_stores_need_a_single_writer(spark, tmp_path):
    from stratalake.sources.store import Files

    files = Files(spark, f"{tmp_path}/x")
    files.fs = spark._jvm.org.apache.hadoop.fs.RawLocalFileSystem()
    files.fs.initialize(spark._jvm.java.net.URI("file:///"), spark._jsc.hadoopConfiguration())
    assert files.create(f"{tmp_path}/x", "1") and not files.create(f"{tmp_path}/x", "2")

    class Elsewhere:
        def getUri(self):
            return spark._jvm.java.net.URI("bucket://b")

    files.fs = Elsewhere()
    with pytest.raises(ValueError, match="single_writer"):
        files.create(f"{tmp_path}/y", "1")
