from stratalake.streaming import operators as streams


def test_sampler_and_stability_over_micro_batches(spark, tmp_path):
    for k, part in enumerate(([("a", 0.2, 1.0), ("a", 0.4, 9.0), ("a", 1.1, 3.0)], [("a", 2.0, 5.0), ("a", 3.5, 7.0), ("b", 0.0, 1.0)], [("a", 4.2, 8.0), ("a", 4.3, None), ("b", 0.5, None), ("a", 9.7, 4.0), ("a", 10.1, 6.0)])):
        spark.createDataFrame(part, "k string, t double, v double").coalesce(1).write.parquet(f"{tmp_path}/in/{k}.parquet")
    s = spark.readStream.schema("k string, t double, v double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = streams.run_to_end(streams.grid_sampler(s, "k", "t", "v", 1.0, 2), f"sampled-{tmp_path.name}").collect()
    # atoms begin on the grid; what is left at the end of a recording is an atom too, and a new recording a new grid
    assert sorted(map(tuple, got)) == [("a", 0.0, 2.0), ("a", 2.0, 6.0), ("a", 4.0, 8.0), ("a", 9.0, 5.0), ("b", 0.0, 1.0)]
    for k, part in enumerate(([("x", 1, 5), ("y", 1, 5)], [("x", 2, 6), ("y", 1, 5)], [("x", 2, 6), ("y", 1, 5)])):
        spark.createDataFrame(part, "path string, size long, mtime long").coalesce(1).write.parquet(f"{tmp_path}/polls/{k}.parquet")
    p = spark.readStream.schema("path string, size long, mtime long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/polls")
    assert sorted(r[0] for r in streams.run_to_end(streams.stable_files(p), f"stable-{tmp_path.name}").collect()) == ["x", "y"]
