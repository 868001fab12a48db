"""Scans by runs equal plain windows, and spread a key that holds most of the rows."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardstone.operators import dialogue, evidence, scan, ticks


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(2)
    out = [(1 if i % 3 else draw.choice([2, 3, None]), i * draw.choice([1, 1, 50]) + i * 1000, draw.choice([None, "a", "b"]), draw.random() < 0.3, draw.random() < 0.2, draw.choice(["t", "u", None]), i % 7) for i in range(600)]
    return spark.createDataFrame(out, "device_id int, seq long, frame_hash string, failed boolean, has_audio boolean, title string, v int").repartition(5).persist()


def same(a, b):
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0


@pytest.mark.parametrize("width", [2, 16, 1 << 30])
def test_before_equals_a_window(spark, rows, width):
    w = Window.partitionBy("device_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    values = {"l": ("last", F.when(F.col("v") > 3, F.struct("v", "title"))), "s": ("sum", F.when(F.col("v") % 2 == 0, F.col("v"))), "m": ("max", F.col("v"))}
    got = scan.before(rows, "device_id", ["seq"], scan.run_of(F.col("seq"), width * 500), values, width=width)
    want = rows.select("*", F.last(values["l"][1], True).over(w).alias("l"), F.sum(values["s"][1]).over(w).alias("s"), F.max("v").over(w).alias("m"))
    same(got, want)


@pytest.mark.parametrize("width", [12, 20, 1000])
def test_rolling_equals_a_window(rows, width):
    w = Window.partitionBy("device_id").orderBy("seq").rowsBetween(-11, 0)
    got = scan.rolling(rows, "device_id", ["seq"], scan.run_of(F.col("seq"), 5000), 12, {"s": F.sum("v"), "c": F.count("*")}, width=width)
    same(got, rows.select("*", F.sum("v").over(w).alias("s"), F.count("*").over(w).alias("c")))


def test_hot_device_is_spread(spark):
    plan = ticks.streaks(spark.range(100_000).select(F.lit(1).alias("device_id"), F.col("id").alias("seq"), F.lit("h").alias("frame_hash"), (F.col("id") % 5 == 0).alias("failed"), F.lit(True).alias("has_audio")))
    most = plan.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
    assert most < 60_000 and plan.count() == 100_000
    windows = [x for x in plan._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window" in x]
    assert windows and all("__run" in x or "__far" in x or "__range" in x for x in windows)


def test_streaks_by_hand(spark):
    seen = [("h", False, False), ("h", False, False), ("x", True, False), ("h", False, False), ("x", True, False), ("x", True, True), ("x", True, False), ("y", False, False), ("y", True, False)]
    df = spark.createDataFrame([(1, i * 9000, *r) for i, r in enumerate(seen)], "device_id int, seq long, frame_hash string, failed boolean, has_audio boolean")
    got = [(r["skipped"], r["failures"], r["wait"], r["degraded"]) for r in ticks.streaks(df).orderBy("seq").collect()]
    assert got == [(False, 0, 0, False), (True, 0, 0, False), (False, 1, 2, False), (True, 1, 2, False), (False, 2, 4, False), (False, 3, 6, True), (False, 4, 8, True), (False, 0, 0, False), (True, 0, 0, False)]


def test_dialogues_by_hand(spark):
    said = ["hm", "ok", "no", "yes", "and", "yes"]
    turns = spark.createDataFrame([(s, i + 1, i + 1, t) for s in (1, None) for i, t in enumerate(said)], "session_id int, turn int, child_turn int, child_response string")
    rows = dialogue.phases(turns, ["ok", "yes"]).where("session_id = 1").orderBy("turn").collect()
    assert [r["phase"] for r in rows] == ["Acknowledge", "Reason", "Contract", "Contract", "Completed", "Completed"]
    assert [r["completed"] for r in rows] == [False, False, False, True, True, True]
    assert [r["reply"] is not None for r in dialogue.closed(dialogue.phases(turns, ["ok", "yes"])).where("session_id is null").orderBy("turn").collect()] == [False] * 4 + [True] * 2


def test_sound_over_three_seconds(spark):
    chunks = spark.createDataFrame([(1, i, 4000, 4000.0 * (1.0 if i >= 5000 else 0.0)) for i in range(4990, 5020)], "device_id int, seq long, n int, sumsq double")
    got = {r["seq"]: r["rms"] for r in evidence.sound_gate(chunks).collect()}
    assert got[4999] == 0.0 and abs(got[5000] - (1 / 11) ** 0.5) < 1e-12 and got[5011] == 1.0


def test_due_takes_checks_of_one_time_by_number(spark):
    rows = [(1, 9 - i, "2024-01-01 00:00:40") for i in range(8)] + [(1, 1, "2024-01-01 00:00:10")]
    t = spark.createDataFrame(rows, "device_id int, seq long, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1)
    assert [r["gap"] for r in ticks.due(t).orderBy("seq").collect()] == [None, 30, *[0] * 7]
