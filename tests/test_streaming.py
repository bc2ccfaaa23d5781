import threading

import pytest
from pyspark.sql import functions as F

from chronoframe.streaming import control, runs

SCHEMA = "tid long, eid long, t double, blank boolean"


def feed(spark, folder, *batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{i}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(str(folder))


def test_runs_go_on_over_micro_batches(spark, tmp_path):
    first = [(1, 0, 0.0, False), (1, 1, 1.0, False), (2, 2, 0.5, True)]
    second = [(1, 3, 2.0, False), (1, 4, 3.0, True), (2, 5, 1.0, False), (1, 6, 4.0, False)]
    got = runs.drain(runs.valid_runs(feed(spark, tmp_path, first, second)), runs.RUNS)
    assert [(r["tid"], r["start"], r["end"], r["frames"]) for r in got.collect()] == [(1, 0.0, 3.0, 3)]


def test_a_late_frame_is_an_error_row(spark, tmp_path):
    got = runs.drain(runs.valid_runs(feed(spark, tmp_path, [(1, 0, 5.0, False)], [(1, 1, 2.0, True), (1, 2, 6.0, True)])), runs.RUNS).collect()
    assert sorted((r["error"] or "", r["start"], r["end"]) for r in got) == [("", 5.0, 6.0), ("frames out of order", 2.0, None)]


def test_frames_meet_their_marks(spark, tmp_path):
    a = spark.range(6).select(F.lit(1).alias("source"), F.col("id").alias("frame"), F.timestamp_seconds(F.col("id") + 100).alias("ts"))
    a.coalesce(1).write.parquet(f"{tmp_path}/a")
    a.where("frame <> 3").withColumn("score", F.col("frame") * 0.1).coalesce(1).write.parquet(f"{tmp_path}/b")
    read = lambda n: spark.readStream.schema(spark.read.parquet(f"{tmp_path}/{n}").schema).parquet(f"{tmp_path}/{n}")
    got = runs.drain(runs.joined_frames(read("a"), read("b")))
    assert sorted(r["frame"] for r in got.collect()) == [0, 1, 2, 4, 5]


def test_progress_counts_rows(spark, tmp_path):
    told = []
    listener = control.Progress(told.append)
    spark.streams.addListener(listener)
    try:
        runs.drain(feed(spark, tmp_path, [(1, 0, 0.0, False)] * 4), SCHEMA)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    finally:
        spark.streams.removeListener(listener)
    assert not told or told[-1] == 4


def test_jobs_are_admitted_cancelled_and_named(spark):
    jobs = control.Jobs(spark, at_once=1)
    with pytest.raises(ValueError):
        jobs.run("bad id").__enter__()
    jobs.cancel("early")
    with pytest.raises(InterruptedError):
        jobs.run("early").__enter__()
    order = []
    with jobs.run("a"):
        with pytest.raises(ValueError):
            jobs.run("a").__enter__()

        def second():
            with jobs.run("b"):
                order.append("b")

        thread = threading.Thread(target=second)
        thread.start()
        order.append("a")
        assert "job-a" in spark.sparkContext.getJobTags()
    thread.join(20)
    assert order == ["a", "b"] and not jobs.active


def test_a_cancelled_job_stops(spark):
    jobs, seen = control.Jobs(spark), []

    def slow():
        with jobs.run("slow"):
            try:
                spark.range(4, numPartitions=4).mapInArrow(lambda it: (__import__("time").sleep(30), it)[1], "id long").count()
            except Exception as e:
                seen.append(str(e))

    thread = threading.Thread(target=slow)
    thread.start()
    __import__("time").sleep(4)
    jobs.cancel("slow")
    thread.join(25)
    assert seen and not thread.is_alive()
