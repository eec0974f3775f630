from pyspark.sql import functions as F

from vecloom.database import Database
from vecloom.streaming.ingest import ingest, latest_per_id, sessions, sliding, tumbling

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _stream(spark, sf, tmp_path):
    src = tmp_path / "in"
    spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).repartition(3).write.parquet(str(src))
    return spark.readStream.schema(SCHEMA.replace("timestamp_ntz", "timestamp")).option("maxFilesPerTrigger", 1).parquet(str(src))


def _run(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_ingest_equals_batch(spark, tmp_path):
    rows = [(f"v{i % 15}", False, [float(i), 1.0], None, i) for i in range(40)]
    df = spark.createDataFrame(rows, "id string, id_is_num boolean, vector array<float>, metadata string, seq bigint")
    for part in range(4):
        df.where(F.col("seq").between(part * 10, part * 10 + 9)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    db, batch = Database(spark), Database(spark)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest(stream, lambda b, _: db.bulk_add(b), str(tmp_path / "c")).awaitTermination()
    batch.bulk_add(df)
    key = lambda d: sorted((r.id, r.vector) for r in d.records.collect())
    assert len(key(db)) == 15 and key(db) == key(batch)


def test_windows(spark, sf, tmp_path):
    s = _stream(spark, sf, tmp_path)
    total = spark.read.parquet(f"{sf}/events.parquet").count()
    t = _run(tumbling(s, late="10000 days"), tmp_path, "tumbling", "complete")
    assert t.agg(F.sum("n")).first()[0] == total
    assert _run(sliding(s, late="10000 days"), tmp_path, "sliding", "complete").agg(F.sum("n")).first()[0] == 4 * total
    assert _run(sessions(s, late="10000 days"), tmp_path, "sessions", "complete").agg(F.sum("n")).first()[0] == total


def test_repeated_deliveries(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "2025-01-01 00:00:00"), ("a", 1, "2025-01-01 00:00:01"), ("a", 2, "2025-01-01 00:00:02")], "id string, seq int, t string").select("id", "seq", F.to_timestamp("t").alias("ts"))
    df.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    assert _run(latest_per_id(s), tmp_path, "latest").count() == 2
