from curvelake.streaming.live import running_stats


def test_stream_equals_batch(spark, tmp_path):
    rows = [("a", float(i), 0.1 * i, f"2024-01-0{1 + i // 4} 0{i % 8}:00:00") for i in range(12)] + [("b", 0.0, None, "2024-01-01 00:00:00"), ("b", 1.0, 0.5, "2024-01-02 00:00:00")]
    df = spark.createDataFrame(rows, "curve_key string, time_h double, od double, arrived string").selectExpr("curve_key", "time_h", "od", "cast(arrived as timestamp) as arrived")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = running_stats(stream).writeStream.format("memory").queryName("live").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = sorted(map(tuple, running_stats(df).drop("window").collect()))
    assert sorted(map(tuple, spark.table("live").drop("window").collect())) == want and len(want) == 4
