from __future__ import annotations

from stratafold.sources.snapshots import Table
from stratafold.streaming.tables import append_stream, windowed_counts

SCHEMA = "id bigint, ts timestamp, kind string"


def test_batches_are_added_once(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(i, f"2024-01-01 00:{i:02d}:00", "ab"[i % 2]) for i in range(30)]
    spark.createDataFrame(rows, "id bigint, ts string, kind string").selectExpr("id", "CAST(ts AS TIMESTAMP) AS ts", "kind").repartition(3).write.parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    table = Table(spark, str(tmp_path / "t")).create(spark.read.parquet(source).schema)
    append_stream(stream, table, "feed", str(tmp_path / "c")).awaitTermination(60)
    assert sorted(r.id for r in table.frame().collect()) == list(range(30))
    versions = len(table.versions())
    assert table.snapshot().streams == {"feed": 2} and versions == 4
    table.append_batch(table.frame(), "feed", 1)  # as after a failure
    assert len(table.versions()) == versions


def test_windows_close_behind_the_watermark(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i:02d}:00", "a") for i in range(0, 50)]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "id bigint, ts string, kind string").selectExpr("id", "CAST(ts AS TIMESTAMP) AS ts", "kind").write.parquet(source)
    counts = windowed_counts(spark.readStream.schema(SCHEMA).parquet(source), "ts", ["kind"], "10 minutes", "5 minutes")
    q = counts.writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.start.minute, r.n) for r in spark.table("counts").collect()) == [(0, 10), (10, 10), (20, 10), (30, 10)]
