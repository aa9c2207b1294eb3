from geoloom.streaming import stateful


def run(spark, stream, tmp_path, name, mode):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).collect()


def source(spark, tmp_path, name, batches, schema, columns):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).selectExpr(*columns).coalesce(1).write.parquet(str(tmp_path / name / f"b{k}"))
    kind = spark.createDataFrame(batches[0], schema).selectExpr(*columns).schema
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name / "*"))


def test_log_tail_keeps_the_newest(spark, tmp_path):
    batches = [[(k, k % 2, k) for k in range(10)], [(k, k % 2, k) for k in range(10, 16)]]
    stream = source(spark, tmp_path, "logs", batches, "id long, key long, s int", ["id", "key", "timestamp_seconds(s) AS ts"])
    rows = run(spark, stateful.job_log_tail_stream(stream, 3), tmp_path, "tail", "update")
    assert {tuple(r.ids) for r in rows if max(r.ids) >= 14} == {(10, 12, 14), (11, 13, 15)}

