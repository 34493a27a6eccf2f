import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sitescore.operators import scaling, timeline
from sitescore.sources import records

EVENT = "event_seq long, lane string, name string, start_ms double, dur_ms double, candidate long, buffer int"


def test_fewer_than_three_points(spark):
    rows = spark.createDataFrame([("a", 50, 1.0), ("a", 60, math.nan), ("a", 70, 2.0), ("b", 60, 3.6), ("b", 70, 4.9), ("b", 80, 6.4), ("b", 10, 9.0)], "device string, k int, t double")
    got = {r["device"]: r["exponent"] for r in scaling.loglog_exponent(rows, "t").collect()}
    assert math.isnan(got["a"]) and got["b"] == pytest.approx(2)


def test_axis_without_points(spark):
    rows = spark.createDataFrame([], "device string, k int, t double")
    assert scaling.axis_limits(rows, "t").first()[:] == (0.0, 300.0, 0.0, 1.0)
    assert scaling.theory_curve(rows, "t", 2).count() == 0


def test_cap_per_rank_needs_candidates(spark):
    drawn = spark.createDataFrame([(0, 1)], "draw long, sensor_id int")
    with pytest.raises(ValueError):
        scaling.cap_per_rank(drawn, 3, 4)


def test_latch(spark):
    rows = spark.createDataFrame([(10, 1.0), (20, math.nan), (30, 3.0), (40, 4.0)], "k int, t double")
    got = [r["t"] for r in scaling.oom_latch(rows, "t").orderBy("k").collect()]
    assert got[0] == 1.0 and all(map(math.isnan, got[1:]))


def test_patch_keeps_pairs(spark):
    schema = "k int, m double, t double"
    old = spark.createDataFrame([(10, 1.0, 1.0), (20, 2.0, math.nan), (99, 9.0, 9.0)], schema)
    new = spark.createDataFrame([(10, 5.0, 5.0), (20, 6.0, 6.0), (30, math.nan, 7.0)], schema)
    sweep = spark.createDataFrame([(10,), (20,), (30,), (40,)], "k int")
    got = {r["k"]: r[1:] for r in scaling.patch_results(sweep, old, new, {"v": ("m", "t")}).collect()}
    assert got[10] == (1.0, 1.0) and got[20] == (6.0, 6.0) and math.isnan(got[30][0]) and got[30][1] == 7.0 and all(map(math.isnan, got[40]))


def test_formats(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"format": "something else"}\n')
    with pytest.raises(PySparkException):
        records.read_timeline(spark, str(tmp_path)).collect()
    with pytest.raises(PySparkException):
        records.read_breakdown(spark, str(tmp_path)).collect()


def test_objective_lines(spark):
    rows = spark.createDataFrame([("1.5",), ("2.5 9",), ("7 3.5 1",), ("7 4.5",), ("x",), ("",)], "line string")
    assert [r[0] for r in rows.select(records.checkpoint_objective(F.col("line"))).collect()] == [1.5, 2.5, 3.5, 7.0, None, None]


def test_io_bars_and_gaps(spark):
    rows = [(0, "io", "hdf5_read", 0.0, 5.0, 1, 0), (1, "io", "gpu_buffer_wait", 0.0, 2.0, 1, 0), (2, "gpu", "compute", 9.0, 1.0, 1, None), (3, "io", "hdf5_read", 1.0, 3.0, 2, 0), (4, "gpu", "compute", 9.0, 1.0, 2, None), (5, "main", "wait_for_io", 3.0, 7.0, 2, None), (6, "io", "gpu_buffer_wait", 8.0, 0.0, 3, 0)]
    events = spark.createDataFrame(rows, EVENT)
    bars = timeline.merge_io(events)
    assert {r["candidate"]: (r["start_ms"], r["dur_ms"]) for r in bars.collect()} == {1: (2.0, 3.0), 2: (1.0, 3.0)}
    gaps = timeline.dispatch_gaps(bars, events, events.where("lane = 'main'"), 1).collect()
    assert [(r["candidate"], r["start_ms"], r["dur_ms"]) for r in gaps] == [(1, 5.0, 4.0)]
    assert {r["lane"] for r in timeline.lane_assign(events.where("lane = 'gpu'")).collect()} == {"gpu0", "gpu1"}


def test_errors(spark):
    events = spark.createDataFrame([], EVENT)
    with pytest.raises(ValueError):
        timeline.capture_filter(events, 3, 3)
    with pytest.raises(PySparkException):
        timeline.profiler_window(spark.createDataFrame([(0, "a", "X", 1.0, 1.0)], "event_seq long, name string, ph string, ts double, dur double")).collect()
    assert timeline.plain_bounds(events).first()[:] == (0.0, 1.0)


def test_written_documents_stay_small(spark, tmp_path, monkeypatch):
    """More events make more documents, not longer ones."""
    from sitescore.jobs import measurements
    from sitescore.sources import fixtures

    many = spark.range(400_000).select(F.col("id").alias("event_seq"), F.lit("io").alias("lane"), F.lit("a").alias("name"), F.lit(0.0).alias("start_ms"), F.lit(1.0).alias("dur_ms"), F.floor(F.col("id") / 20).alias("candidate"), F.lit(0).alias("buffer"))
    monkeypatch.setattr(fixtures, "timeline", lambda *_: many)
    found = records.timeline_json(measurements._timeline_spans(spark, ""), F.lit(5.0), "document")
    sizes = [r[0] for r in found.select(F.size(F.from_json("value", records.TIMELINE)["events"])).collect()]
    assert max(sizes) <= 10_000 and len(sizes) > 16
