"""Summaries of scaling and ablation measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .running import running

METRICS = ("io_time", "compute_time", "wall_time", "imbalance_time", "comm_time")


def _hash_order(seed: int, id_: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), id_.cast("string")).cast("binary"))


def benchmark_draw(sensors: DataFrame, k: int, total: int, seed_s: int, seed_c: int, replace: bool = True) -> tuple[DataFrame, DataFrame]:
    """(selected, drawn): k of the sensors without replacement, and total draws (draw, sensor_id) from the
    others, with replacement or without. Both depend on the seeds alone."""
    selected = sensors.select("sensor_id").orderBy(_hash_order(seed_s, F.col("sensor_id")), "sensor_id").limit(k)
    pool = sensors.select("sensor_id").join(selected, "sensor_id", "left_anti")
    if not replace:
        drawn = running(pool, [_hash_order(seed_c, F.col("sensor_id")), "sensor_id"], "draw").where(F.col("draw") < total)
        return selected, drawn.select("draw", "sensor_id")
    placed = running(pool, ["sensor_id"], "place").select("place", "sensor_id")
    size = pool.agg(F.count("*").alias("size"))
    draws = sensors.sparkSession.range(total).withColumnRenamed("id", "draw").crossJoin(F.broadcast(size))  # size has one row
    number = F.conv(F.substring(_hash_order(seed_c, F.col("draw")), 1, 8), 16, 10).cast("long")
    return selected, draws.withColumn("place", number % F.col("size")).join(placed, "place").select("draw", "sensor_id")


def cap_per_rank(drawn: DataFrame, total: int, ranks: int, max_evals: int = 0) -> DataFrame:
    """drawn(draw, sensor_id) with its rank: total div ranks draws in a row for each rank, the remainder
    dropped, max_evals of them at most where that is positive; an error if none is left."""
    local = total // ranks
    most = min(local, max_evals) if max_evals > 0 else local
    if most == 0:
        raise ValueError("no candidates to evaluate")
    rank = F.floor(F.col("draw") / local).cast("int")
    return drawn.withColumn("rank", rank).where((F.col("rank") < ranks) & (F.col("draw") % local < most))


def run_summary(raw: DataFrame) -> DataFrame:
    """A row for each (ranks, run): the slowest rank's times, the mean compute time, and by how much the
    slowest compute exceeds it."""
    by = raw.groupBy("ranks", "run").agg(F.count("*").alias("actual_evals"), F.max("io").alias("io_time"), F.avg("compute").alias("compute_time"), F.max("wall").alias("wall_time"), (F.max("compute") - F.avg("compute")).alias("imbalance_time"), F.max("comm").alias("comm_time"))
    return by.select("ranks", "run", "actual_evals", *METRICS)


def best_over_runs(runs: DataFrame) -> DataFrame:
    """A row for each ranks: the least of each metric on its own, whichever run has it."""
    return runs.groupBy("ranks").agg(F.min("actual_evals").alias("actual_evals"), *(F.min(m).alias(m) for m in METRICS))


def best_run(rows: DataFrame, tie: str = "run") -> DataFrame:
    """A row for each ranks: the whole row with the least wall time, the first of equals."""
    others = [c for c in rows.columns if c != "ranks"]
    best = F.min_by(F.struct(*others), F.struct("wall_time", tie)).alias("b")
    return rows.groupBy("ranks").agg(best).select("ranks", "b.*")


def node_axis(rows: DataFrame, ranks_per_node: int, max_nodes: int = 256) -> DataFrame:
    """rows from one node to max_nodes of them, with nodes and gpus (four for each node)."""
    kept = rows.where(F.col("ranks").between(ranks_per_node, max_nodes * ranks_per_node))
    return kept.withColumn("nodes", F.col("ranks") / F.lit(float(ranks_per_node))).withColumn("gpus", F.col("nodes") * 4)


def scaling_efficiency(rows: DataFrame, weak: bool, x: str = "nodes") -> DataFrame:
    """rows with the ideal wall time from each system's smallest x, constant (weak) or falling as 1/x, and
    the efficiency in percent."""
    first = Window.partitionBy("system").orderBy(x).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w0, x0 = F.first("wall_time").over(first), F.first(x).over(first)
    ideal = w0 if weak else w0 * x0 / F.col(x)
    return rows.withColumn("ideal", ideal).withColumn("efficiency", F.try_divide(F.col("ideal") * 100, F.col("wall_time")))


def scaling_plan(start: Column, most: Column, strong_total: int, weak_per_rank: int, ranks_per_node: int) -> Column:
    """array<struct> of runs with ranks doubling from start to most: nodes, and the candidates of the
    strong (fixed) and the weak (for each rank) series."""
    steps = F.floor(F.log2(most / start) + 1e-9).cast("int")
    ranks = lambda i: (start * F.pow(F.lit(2.0), i)).cast("int")
    run = lambda i: F.struct(ranks(i).alias("ranks"), F.greatest(F.lit(1), F.floor(ranks(i) / ranks_per_node).cast("int")).alias("nodes"), F.lit(strong_total).alias("strong_total"), (ranks(i) * weak_per_rank).alias("weak_total"))
    return F.when(most >= start, F.transform(F.sequence(F.lit(0), F.greatest(steps, F.lit(0))), run)).otherwise(F.array().cast("array<struct<ranks:int,nodes:int,strong_total:int,weak_total:int>>"))


def patch_results(sweep: DataFrame, old: DataFrame, new: DataFrame, variants: dict[str, tuple[str, str]], keys: tuple[str, ...] = ("k",)) -> DataFrame:
    """For every row of sweep(keys): each variant (its memory and time columns) keeps the old pair if both
    are numbers, else takes the new value if that is one, else the old; old rows outside the sweep go."""
    a, b = old.select(*keys, F.struct(*[c for c in old.columns if c not in keys]).alias("o")), new.select(*keys, F.struct(*[c for c in new.columns if c not in keys]).alias("n"))
    own = sweep.select(*keys).join(a, list(keys), "left").join(b, list(keys), "left")
    real = lambda c: c.isNotNull() & ~F.isnan(c)
    out = []
    for m, t in variants.values():
        whole = real(F.col("o")[m]) & real(F.col("o")[t])
        for c in dict.fromkeys((m, t)):
            o, n = F.col("o")[c], F.col("n")[c]
            out.append(F.when(whole, o).when(real(n), n).otherwise(F.coalesce(o, F.lit(float("nan")))).alias(c))
    return own.select(*keys, *out)


def oom_latch(rows: DataFrame, column: str, keys: tuple[str, ...] = (), known: str | None = None) -> DataFrame:
    """rows in which column is NaN for every k after the first that failed (NaN), but where known is true."""
    before = Window.partitionBy(*(keys or (F.lit(0),))).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    failed = F.coalesce(F.max(F.isnan(column)).over(before), F.lit(False))
    keep = F.col(known) if known else F.lit(False)
    return rows.withColumn(column, F.when(failed & ~keep, F.lit(float("nan"))).otherwise(F.col(column)))


def finite_points(rows: DataFrame, column: str) -> DataFrame:
    """(k, t): the finite positive times of all devices together."""
    t = F.col(column)
    return rows.where(t.isNotNull() & ~F.isnan(t) & (t > 0) & (t < float("inf"))).select(F.col("k").cast("double").alias("k"), t.alias("t"))


def loglog_exponent(rows: DataFrame, column: str, k_min: float = 50, k_max: float | None = None, keys: tuple[str, ...] = ("device",)) -> DataFrame:
    """(keys, exponent): the least-squares slope of ln t on ln k; NaN for fewer than three points."""
    t, k = F.col(column), F.col("k").cast("double")
    fine = t.isNotNull() & ~F.isnan(t) & (t > 0) & (t < float("inf")) & (k >= k_min) & (F.lit(True) if k_max is None else k <= k_max)
    x, y = F.when(fine, F.log(k)), F.when(fine, F.log(F.when(fine, t)))
    slope = F.when(F.count(x) >= 3, F.regr_slope(y, x)).otherwise(F.lit(float("nan")))
    return rows.groupBy(*keys).agg(slope.alias("exponent"))


def axis_limits(rows: DataFrame, column: str, x_pad: float = 0.03, y_pad: float = 0.10, reserve: float = 0.28) -> DataFrame:
    """One row (x_min, x_max, y_min, y_max) around the finite points; 0 to 300 and 0 to 1 without any."""
    own = finite_points(rows, column).agg(F.max("k").alias("k"), F.max("t").alias("t"))
    return own.select(F.lit(0.0).alias("x_min"), F.coalesce(F.col("k") * (1 + x_pad), F.lit(300.0)).alias("x_max"), F.lit(0.0).alias("y_min"), F.coalesce(F.col("t") * (1 + y_pad) / max(1 - reserve, 0.5), F.lit(1.0)).alias("y_max"))


def theory_curve(rows: DataFrame, column: str, power: float, anchor_k: float = 100, points: int = 100) -> DataFrame:
    """(k, t): the curve c k^power at even places over the axis, through the median over devices of the
    time at the k nearest to anchor_k (the smaller of two); no row without a finite time."""
    t = F.col(column)
    fine = rows.where(t.isNotNull() & ~F.isnan(t) & (t > 0) & (t < float("inf")))
    near = fine.groupBy("device").agg(F.min_by(t, F.struct(F.abs(F.col("k") - anchor_k), "k")).alias("t"))
    scale = near.agg((F.median("t") / anchor_k**power).alias("c")).where("c is not null")
    ends = axis_limits(rows, column).select("x_min", "x_max")
    place = F.col("x_min") + (F.col("x_max") - F.col("x_min")) * F.col("i") / (points - 1)
    each = rows.sparkSession.range(points).withColumnRenamed("id", "i").crossJoin(F.broadcast(ends)).crossJoin(F.broadcast(scale))  # both have one row
    return each.select(place.alias("k"), (F.col("c") * F.pow(place, F.lit(float(power)))).alias("t"))
