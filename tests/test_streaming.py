"""Live variants give what the batch forms give."""

import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardstone.operators import decide, dialogue, evidence, table, ticks
from wardstone.plans.fixtures import RUNS, TICKS, TURNS
from wardstone.streaming import live

DIR = "/root/testdata/sf0.001"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, live.ROCKS)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield spark
    spark.conf.set(key, before)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def streamed(spark, df, order, tmp_path, make, parts=2, mode="append"):
    """``order`` is a column to split by, or a column that names the file of each row."""
    path, name = str(tmp_path / "in"), "t" + uuid.uuid4().hex
    rows = df.withColumn("__part", F.ntile(parts).over(Window.orderBy(order)) if isinstance(order, str) else order)
    for i in range(1, parts + 1):
        rows.where(F.col("__part") == i).drop("__part").coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = make(source).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return spark.table(name)


def test_ticks(rocks, tmp_path):
    t = TICKS.df(rocks, DIR).where("device_id < 12").drop("ts")
    got = streamed(rocks, t, "seq", tmp_path, live.live_ticks)
    batch = ticks.segments(ticks.streaks(t)).select("device_id", "seq", "skipped", F.col("failures").cast("int"), "degraded", F.col("segment").cast("int"))
    assert sorted(map(tuple, got.select("device_id", "seq", "skipped", "failures", "degraded", "segment").collect())) == sorted(map(tuple, batch.collect()))


def test_alerts(rocks, tmp_path):
    r = decide.decided(RUNS.df(rocks, DIR)).where("device_id < 20").select("device_id", "id", "ts", "decision")
    closes = r.where("id % 5 = 0").select("device_id", F.col("ts") + F.expr("interval 1 second"))
    closes = closes.toDF("device_id", "ts")
    rows = r.withColumn("closed", F.lit(False)).unionByName(closes.withColumn("closed", F.lit(True)), allowMissingColumns=True)
    got = streamed(rocks, rows, "ts", tmp_path, live.live_alerts)
    batch = ticks.alert_edges(r, closes).select("device_id", "id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_alert_needs_a_closed_intercept(spark):
    runs = spark.createDataFrame([(1, 1, 10, "hate"), (1, 2, 20, "hate"), (1, 3, 40, "not_hate"), (1, 4, 50, "hate"), (1, 5, 90, "hate"), (2, 6, 5, "hate")], "device_id long, id long, ts long, decision string")
    closes = spark.createDataFrame([(1, 30), (1, 60), (1, 70)], "device_id long, ts long")
    assert sorted(r["id"] for r in ticks.alert_edges(runs, closes).collect()) == [1, 4, 5, 6]


def test_dialogue(rocks, tmp_path):
    t = TURNS.df(rocks, DIR).where("session_id < 30")
    starts = t.groupBy("session_id").agg(F.lit(-1).cast("long").alias("turn")).select("session_id", "turn", F.lit("").alias("child_response"), F.lit(True).alias("start"))
    rows = t.select("session_id", "turn", "child_response", F.lit(False).alias("start")).union(starts.where("session_id <> 3"))
    got = streamed(rocks, rows, "turn", tmp_path, lambda s: live.live_dialogue(s, ("yes", "this"))).collect()
    batch = dialogue.phases(t.where("session_id <> 3"), ("yes", "this")).select("session_id", "turn", "phase", "completed")
    assert sorted((r[0], r[1], r[2], r[3]) for r in got if r["error"] is None) == sorted(map(tuple, batch.collect()))
    assert {r["session_id"] for r in got if r["error"]} == {3}


def in_time(spark):
    """Ticks a second apart by number, some repeated; (rows, late rows, rows that are too late, a last row far ahead)."""
    t = TICKS.df(spark, DIR).where("device_id < 8").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq")))
    far = spark.createDataFrame([(99, 10**7, None, True, False, "end", 1_710_000_000)], "device_id long, seq long, frame_hash string, has_audio boolean, failed boolean, title string, s long")
    return t, far.withColumn("ts", F.timestamp_seconds("s")).select(*t.columns)


def test_ticks_in_event_time(rocks, tmp_path):
    t, far = in_time(rocks)
    # rows of the first file, their repeats and some late rows with the second, one beyond the delay with the third
    part = F.when(F.col("seq") % 10 == 3, 2).otherwise(1)
    half = t.withColumn("file", F.when(F.col("seq") < 500, part).otherwise(part + 1))
    lost = t.where("seq < 60").orderBy(F.desc("seq")).limit(1)
    last = lost.first()["seq"]
    rows = half.where(F.col("seq") != last).unionByName(half.where("seq < 40").withColumn("file", F.col("file") + 1)).unionByName(far.withColumn("file", F.lit(4))).unionByName(lost.withColumn("file", F.lit(6)))
    for i in (5, 6):  # the watermark by which rows are late is a batch behind
        rows = rows.unionByName(far.withColumn("seq", F.lit(10**7 + i)).withColumn("ts", F.timestamp_seconds(F.lit(1_710_000_000 + 10**7 * i))).withColumn("file", F.lit(i)))
    got = streamed(rocks, rows, F.col("file"), tmp_path, lambda s: live.live_ticks_in_time(s.drop("file"), "1000 seconds"), parts=6)
    got = got.where("device_id < 90").select("device_id", "seq", "skipped", "failures", "degraded", "segment")
    batch = ticks.segments(ticks.streaks(t.where(F.col("seq") != last))).select("device_id", "seq", "skipped", F.col("failures").cast("int"), "degraded", F.col("segment").cast("int"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_silent_devices_are_forgotten(rocks, tmp_path):
    row = lambda s, f, at: (1, s, "h", False, False, "t", at, f)
    rows = rocks.createDataFrame([row(1, 1, 100), row(2, 1, 101), row(3, 2, 9000), row(4, 3, 9001), row(5, 4, 90_000), row(6, 5, 900_000)], "device_id long, seq long, frame_hash string, has_audio boolean, failed boolean, title string, s long, file int")
    rows = rows.withColumn("ts", F.timestamp_seconds("s")).drop("s")
    got = streamed(rocks, rows, F.col("file"), tmp_path, lambda s: live.live_ticks_in_time(s.drop("file"), "1 second", 100_000), parts=5)
    assert {r["seq"]: r["skipped"] for r in got.collect()} == {1: False, 2: True, 3: False, 4: True, 5: False}


def test_ring(rocks, tmp_path):
    t = TICKS.df(rocks, DIR).where("device_id < 12").select("device_id", "seq", F.col("title").alias("trace"))
    got = streamed(rocks, t, "seq", tmp_path, lambda s: live.live_ring(s, 5), mode="update")
    last = got.withColumn("m", F.max("upto").over(Window.partitionBy("device_id"))).where("upto = m")
    batch = ticks.newest(t, 5).select("device_id", "seq", "trace", "rank")
    assert sorted(map(tuple, last.select("device_id", "seq", "trace", "rank").distinct().collect())) == sorted(map(tuple, batch.collect()))


def test_records(rocks, tmp_path):
    e = rocks.read.parquet(f"{DIR}/events.parquet").where("user_id < 12").select(F.col("user_id").alias("device_id"), F.floor(F.col("event_id") / 40).alias("record"), "event_id", F.col("event_type").alias("state"))
    got = streamed(rocks, e, "event_id", tmp_path, live.live_records, mode="update", parts=3)
    last = evidence.frame_log(got, "record", "event_id").select("device_id", "record", "state", "rank")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, evidence.frame_log(e, "record", "event_id").select("device_id", "record", "state", "rank").collect()))


def test_cascade_is_persisted(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(40)
    docs = docs.select(F.col("doc_id").cast("string").alias("id"), F.to_timestamp(F.lit("2024-01-01")).alias("ts"), F.lit(1).cast("long").alias("device_id"), "text", F.lit(9).alias("child_age"), F.lit(0.0).alias("vision_score"), F.lit(False).alias("vision_calibrated"), F.lit("a.exe").alias("app_exe"))
    docs.write.parquet(str(tmp_path / "in"))
    pruned = []
    stream = live.cascade(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.foreachBatch(live.persist_batches(str(tmp_path / "runs"), 25, pruned.append)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert table.read(spark, str(tmp_path / "runs")).count() == 40 and pruned == [40]


def test_a_batch_is_written_once_however_often_it_is_tried(spark, tmp_path):
    path = str(tmp_path / "runs")
    rows = lambda n, day: spark.range(n).select(F.concat(F.lit(day), F.col("id").cast("string")).alias("id"), F.to_timestamp(F.lit(day)).alias("ts"), F.lit(1).cast("long").alias("device_id"), F.lit("hate").alias("decision"), F.lit("threat").alias("category"), F.lit(0.9).alias("risk"), F.lit(9).alias("child_age"), F.lit("a").alias("app_exe"))
    pruned = []
    write = live.persist_batches(path, 25, pruned.append)
    write(rows(10, "2024-01-01"), 0)
    write(rows(10, "2024-01-01"), 0)
    write(rows(10, "2024-01-02"), 1)
    assert table.read(spark, path).count() == 20 and pruned == []
    table.write_batch(rows(10, "2024-01-03"), path, "stream-2")  # a try that broke off before it was entered in the ledger
    again = live.persist_batches(path, 25, pruned.append)  # after a restart
    again(rows(10, "2024-01-02"), 1)
    again(rows(10, "2024-01-03"), 2)
    assert table.read(spark, path).count() == 30 and pruned == [30]
    assert table.committed(spark, path, "stream") == {0: 10, 1: 10, 2: 10} and table.committed(spark, path, "other") == {}
