"""Running sums and numbers, and selections from text."""

import random

import pytest
from pyspark.sql import functions as F

from sitescore.operators import greedy, running


@pytest.mark.parametrize("n", [0, 1, 300])
def test_running(spark, n):
    rng = random.Random(n)
    rows = [(i, rng.choice([None, 1.0, -2.5]), rng.randrange(5)) for i in rng.sample(range(10 * n + 1), n)]
    got = running.running(spark.createDataFrame(rows, "a int, x double, b int").repartition(7), [F.desc("a")], "n", {"sx": "x", "sb": "b"})
    sx, want = None, []
    for k, (a, x, b) in enumerate(sorted(rows, reverse=True)):
        sx = x if sx is None else sx + (x or 0)
        want.append((a, x, b, sx, sum(r[2] for r in sorted(rows, reverse=True)[: k + 1]), k))
    assert [tuple(r) for r in got.orderBy(F.desc("a")).collect()] == want


def test_no_window_over_the_whole_table(spark):
    df = spark.range(100).select(F.col("id").cast("int").alias("step"), F.lit(1).alias("sensor_id"), F.lit(1.0).alias("gain"))
    plan = greedy.cumulative_logdet(df)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_selection_from_lines(spark, tmp_path):
    (tmp_path / "one.txt").write_text("17 2.500000000000000000e+00\n")
    assert [tuple(r) for r in greedy.read_selection(spark, str(tmp_path / "one.txt")).collect()] == [(0, 17, 2.5, 2.5)]
    (tmp_path / "more.txt").write_text("# sensors\n17 2.5e+00\n3  3.0 \n40 2.0\n")
    assert sorted(tuple(r) for r in greedy.read_selection(spark, str(tmp_path / "more.txt")).collect()) == [(0, 17, 2.5, 2.5), (1, 3, 0.5, 3.0), (2, 40, -1.0, 2.0)]
    for text in ("", "17\n", "a b\n"):
        (tmp_path / "bad.txt").write_text(text)
        assert greedy.read_selection(spark, str(tmp_path / "bad.txt")).count() == 0
