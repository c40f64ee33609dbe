from marlstone.streaming.windows import event_stream, windowed


def test_a_stream_gives_the_batch_result(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/events.parquet").orderBy("ts").cache()
    n = table.count()
    for i in range(3):
        part = table.where(f"event_id >= {i * n // 3} and event_id < {(i + 1) * n // 3}")
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = windowed(event_stream(spark, str(tmp_path / "in"), 3), late="3650 days")
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, windowed(table).collect()))
