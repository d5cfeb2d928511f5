"""Streams end with what the batch says, late rows aside."""

import pytest

from trailmark.streaming import windows

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@pytest.mark.parametrize("name,mode", [("tumbling", "complete"), ("sliding", "complete"), ("sessions", "complete")])
def test_stream_is_batch(spark, tmp_path, name, mode):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    made = getattr(windows, name)(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), late="60 days")
    q = made.writeStream.format("memory").queryName(f"out_{name}").outputMode(mode).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(spark.table(f"out_{name}")) == key(getattr(windows, name)(events))


def test_late_and_repeated(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:05:00"), (2, "2024-01-03 00:00:00")]
    first = spark.createDataFrame(rows, "event_id long, t string").selectExpr("event_id", "cast(t as timestamp_ntz) ts")
    first.coalesce(1).write.parquet(str(tmp_path / "in/a"))
    stream = spark.readStream.schema("event_id long, ts timestamp_ntz").parquet(str(tmp_path / "in/*"))
    run = lambda: windows.deduplicated(stream, ["event_id"]).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    run()
    spark.createDataFrame([(3, "2024-01-01 00:00:00"), (2, "2024-01-03 00:01:00"), (4, "2024-01-03 00:02:00")], "event_id long, t string").selectExpr(
        "event_id", "cast(t as timestamp_ntz) ts").coalesce(1).write.parquet(str(tmp_path / "in/b"))
    run()
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 4]
