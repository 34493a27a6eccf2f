"""Random and evenly spaced configurations, and how a selection compares with them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import Matrix, clean_nan, diagonal_blocks, regularize, side, symmetrize
from .objective import block_scores, config_logdet, config_upper, pivoted
from .running import running
from .state import cut

#: Random configurations of more values than this a side are built block by block.
DENSE_SIDE = 8_000
INFINITY = float("inf")


def exclude_sensors(candidates: DataFrame, listed: str) -> DataFrame:
    """candidates(sensor_id, ...) without the ids in a comma-separated list; blanks are ignored."""
    ids = candidates.sparkSession.range(1).select(F.explode(F.split(F.lit(listed), ",")).alias("x")).select(F.trim("x").alias("x")).where("x <> ''")
    return candidates.join(ids.select(F.col("x").cast("int").alias("sensor_id")), "sensor_id", "left_anti")


def remaining_candidates(candidates: DataFrame, selected: DataFrame) -> DataFrame:
    return candidates.join(selected.select("sensor_id"), "sensor_id", "left_anti")


def split_candidates(candidates: DataFrame, workers: int) -> DataFrame:
    """candidates with the worker of each: contiguous ranges of equal size, the last ones maybe short."""
    n = candidates.agg((F.max("sensor_id") + 1).alias("n"))
    size = F.ceil(F.col("n") / workers)
    return candidates.crossJoin(F.broadcast(n)).withColumn("worker", F.floor(F.col("sensor_id") / size).cast("int")).drop("n")  # n has one row


def split_samples(spark: SparkSession, total: Column | int, existing: DataFrame, workers: int) -> DataFrame:
    """(worker, n_samples): how many of the samples still needed each worker makes."""
    done = existing.agg(F.count("*").alias("done"))
    needed = F.greatest(F.lit(0), F.lit(total) - F.col("done"))
    w = F.col("id")
    share = F.floor(needed / workers) + (w < needed % workers).cast("int")
    return spark.range(workers).crossJoin(F.broadcast(done)).select(w.cast("int").alias("worker"), share.cast("long").alias("n_samples"))  # done has one row


def prescreen(blocks: Matrix) -> DataFrame:
    """(sensor_id, kept): whether I + K_cc, unscaled, is positive definite."""
    own = regularize(symmetrize(clean_nan(diagonal_blocks(blocks))), 1.0)
    return own.select(F.col("block_row").alias("sensor_id"), block_scores(F.col("block")).isNotNull().alias("kept"))


def drop_infinite(samples: DataFrame) -> DataFrame:
    """samples without infinite objectives; NaN stays."""
    return samples.where(F.abs("logdet") != INFINITY)


def order_key(seed: int, sample: Column, candidate: Column, attempt: Column | None = None) -> Column:
    """What a sample's candidates are sorted by: the md5 of seed, sample and candidate, and from the
    second attempt on of its number."""
    parts = [F.lit(f"{seed}-"), sample.cast("string"), F.lit("-"), candidate.cast("string")]
    if attempt is not None:
        parts.append(F.when(attempt > 0, F.concat(F.lit("-"), attempt.cast("string"))).otherwise(""))
    return F.md5(F.concat(*parts).cast("binary"))


def random_orders(candidates: DataFrame, samples: DataFrame, seed: int) -> DataFrame:
    """(sample_id, position, sensor_id): all candidates in a random order for each row of samples(sample_id[, attempt])."""
    attempt = F.col("attempt") if "attempt" in samples.columns else None
    pairs = samples.crossJoin(candidates.select("sensor_id"))  # an order holds every candidate
    by = Window.partitionBy("sample_id").orderBy(order_key(seed, F.col("sample_id"), F.col("sensor_id"), attempt), "sensor_id")
    return pairs.select("sample_id", (F.row_number().over(by) - 1).alias("position"), "sensor_id")


def random_configs(blocks: Matrix, candidates: DataFrame, n_samples: int, budget: int, r_sq: float, seed: int, slack: int = 8, first_sample: int = 0, dense_side: int = DENSE_SIDE) -> DataFrame:
    """(sample_id, logdet, retries, sensors): for each sample the first candidates in its order whose
    Schur complements are positive definite, budget of them.

    The first budget + slack candidates of an order are tried; a sample that they don't fill is tried
    again with all candidates, and one that these don't fill starts another order (a retry), until
    every sample is filled; a budget of more than the candidates is an error. Small ones are built in
    one task each, others block by block, all samples one candidate at a time.
    """
    spark = blocks.sparkSession
    todo = spark.range(first_sample, first_sample + n_samples).select(F.col("id").cast("int").alias("sample_id"), F.lit(0).alias("attempt"))
    n_all = candidates.count()
    if budget > n_all:
        raise ValueError("the budget exceeds the candidates")
    found = None
    attempt = 0
    while True:
        for tried in sorted({min(budget + slack, n_all), n_all}):
            got = cut(_attempt(blocks, random_orders(candidates, todo, seed), tried, budget, r_sq, dense_side).withColumn("retries", F.lit(attempt)))
            full = got.where(F.size("sensors") == budget)
            found = full if found is None else found.union(full)
            todo = cut(todo.join(full.select("sample_id"), "sample_id", "left_anti"))
            if not todo.count():
                return found.select("sample_id", "logdet", "retries", "sensors")
        attempt += 1
        found = cut(found)
        todo = todo.withColumn("attempt", F.lit(attempt))


def _attempt(blocks: Matrix, orders: DataFrame, tried: int, budget: int, r_sq: float, dense_side: int) -> DataFrame:
    orders = orders.where(F.col("position") < tried)
    configs = orders.select(F.col("sample_id").alias("config_id"), "position", "sensor_id")
    sub = config_upper(blocks, configs, r_sq)
    nt = side(blocks)
    if tried * nt > dense_side:
        rows = pivoted(sub, tried, nt, budget)
        at = rows.select("config_id", "logdet", F.posexplode_outer("positions").alias("k", "position")).join(configs, ["config_id", "position"], "left")
        by = at.groupBy("config_id", "logdet").agg(F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "sensor_id")))).alias("s"))
        return by.select(F.col("config_id").alias("sample_id"), "logdet", F.transform("s", lambda x: x["sensor_id"]).alias("sensors"))
    named = sub.join(configs.select("config_id", F.col("position").alias("i"), "sensor_id"), ["config_id", "i"])

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        a = {(i, j): np.reshape(b, (nt, nt)) for i, j, b in zip(pdf["i"], pdf["j"], pdf["block"], strict=True)}
        ids = dict(zip(pdf["i"], pdf["sensor_id"], strict=True))
        sensors, total, rows = [], 0.0, []
        for c in sorted(ids):
            y = []
            for n, (p, low) in enumerate(rows):
                y.append(np.linalg.solve(low, a[p, c] - sum((ys[p].T @ y[m] for m, ys in enumerate(parts[:n])), np.zeros((nt, nt)))))
            schur = a[c, c] - sum((x.T @ x for x in y), np.zeros((nt, nt)))
            try:
                low = np.linalg.cholesky(schur)
            except np.linalg.LinAlgError:
                continue
            if not rows:
                parts: list[dict[int, np.ndarray]] = []
            for m, x in enumerate(y):
                parts[m][c] = x
            parts.append({})
            rows.append((c, low))
            sensors.append(int(ids[c]))
            total += float(2 * np.log(np.diag(low)).sum())
            if len(sensors) == budget:
                break
        return pd.DataFrame({"sample_id": [pdf["config_id"].iloc[0]], "logdet": [total], "sensors": [sensors]})

    return named.groupBy("config_id").applyInPandas(build, "sample_id int, logdet double, sensors array<int>")


def baseline_run(blocks: Matrix, out: str, total_samples: int, budget: int, r_sq: float, seed: int, excluded: str = "") -> DataFrame:
    """Bring the samples in out up to total_samples and report (n_screened, n_samples, retries).

    Sensors whose blocks aren't positive definite, or that are excluded, are left out; samples that
    are there already are kept and not made again.
    """
    from ..sources.records import append_samples, read_samples

    spark = blocks.sparkSession
    screened = cut(prescreen(blocks))
    candidates = exclude_sensors(screened.where("kept").select("sensor_id"), excluded)
    existing = read_samples(spark, out).count()
    missing = max(0, total_samples - existing)
    if missing:
        append_samples(random_configs(blocks, candidates, missing, budget, r_sq, seed, first_sample=existing).select(F.col("sample_id").cast("long").alias("sample_id"), "logdet", "retries"), out)
    dropped = screened.agg(F.count_if(~F.col("kept")).alias("n_screened"))
    return read_samples(spark, out).agg(F.count("*").alias("n_samples"), F.sum("retries").alias("retries")).crossJoin(F.broadcast(dropped))


def uniform_subsample(n_total: Column, n_select: Column) -> Column:
    """array<int> of n_select evenly spaced indices below n_total: none, all, the middle one, an even
    stride where it fits, else rounded (half to even) places between both ends."""
    last = F.greatest(n_select - 1, F.lit(1))
    empty = F.array().cast("array<int>")
    upto = lambda n: F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)
    stride = F.floor(n_total / F.greatest(n_select, F.lit(1))).cast("int")
    step = (n_total - 1).cast("double") / last
    spaced = F.transform(upto(n_select), lambda i: F.rint(i * step).cast("int"))
    return (
        F.when((n_select <= 0) | (n_total <= 0), empty)
        .when(n_select >= n_total, upto(n_total))
        .when(n_select == 1, F.array(F.floor((n_total - 1) / 2).cast("int")))
        .when(n_total % F.greatest(n_select, F.lit(1)) == 0, F.transform(upto(n_select), lambda i: i * stride))
        .otherwise(spaced)
    )


def base_grid(budget: Column, n_lon: Column, n_lat: Column) -> tuple[Column, Column]:
    """(b_lon, b_lat): the sides of the largest even grid within budget, in the proportions of the whole one."""
    b_lon = F.greatest(F.lit(1), F.rint(F.sqrt(budget * n_lon / n_lat)).cast("int"))
    return b_lon, F.greatest(F.lit(1), F.least(n_lat, F.floor(budget / b_lon).cast("int")))


def grid_mesh(lons: Column, lats: Column, n_lat: Column) -> Column:
    """array<int> of the sensors at every pair of the indices, longitude outermost."""
    return F.flatten(F.transform(lons, lambda x: F.transform(lats, lambda y: x * n_lat + y)))


def center_rank(sensor: Column, n_lon: Column, n_lat: Column) -> tuple[Column, Column]:
    """(penalty, distance): 100 for each axis on whose edge the sensor lies, squared distance to the centre."""
    lon, lat = F.floor(sensor / n_lat), sensor % n_lat
    edge = lambda x, n: F.when((x == 0) | (x == n - 1), 100).otherwise(0)
    return edge(lon, n_lon) + edge(lat, n_lat), F.pow(lon - (n_lon - 1) / 2.0, F.lit(2.0)) + F.pow(lat - (n_lat - 1) / 2.0, F.lit(2.0))


def center_fill(unselected: DataFrame, add_count: int, n_lon: int, n_lat: int) -> DataFrame:
    """The add_count sensors that rank first by penalty, distance and id."""
    penalty, distance = center_rank(F.col("sensor_id"), F.lit(n_lon), F.lit(n_lat))
    return unselected.select("sensor_id").orderBy(penalty, distance, "sensor_id").limit(max(0, add_count))


def trim_to_budget(ids: DataFrame, budget: int, seed: int) -> DataFrame:
    """budget of the sensors, those with the smallest md5 of seed and id."""
    key = F.md5(F.concat(F.lit(f"{seed}-"), F.col("sensor_id").cast("string")).cast("binary"))
    return ids.select("sensor_id").orderBy(key, "sensor_id").limit(budget)


def uniform_config(spark: SparkSession, n_lon: int, n_lat: int, budget: int, seed: int) -> DataFrame:
    """(sensor_id): an evenly spaced grid of exactly budget sensors, filled up near the centre or trimmed."""
    if budget > n_lon * n_lat:
        raise ValueError("the budget exceeds the grid")
    b_lon, b_lat = base_grid(F.lit(budget), F.lit(n_lon), F.lit(n_lat))
    mesh = grid_mesh(uniform_subsample(F.lit(n_lon), b_lon), uniform_subsample(F.lit(n_lat), b_lat), F.lit(n_lat))
    base = spark.range(1).select(F.explode(mesh).alias("sensor_id"))
    n = base.count()
    if n > budget:
        return trim_to_budget(base, budget, seed)
    rest = spark.range(n_lon * n_lat).select(F.col("id").cast("int").alias("sensor_id")).join(base, "sensor_id", "left_anti")
    return base.union(center_fill(rest, budget - n, n_lon, n_lat))


def uniform_score(blocks: Matrix, n_lon: int, n_lat: int, budget: int, r_sq: float, seed: int) -> DataFrame:
    """One row (logdet) for the evenly spaced configuration."""
    own = uniform_config(blocks.sparkSession, n_lon, n_lat, budget, seed)
    placed = running(own, ["sensor_id"], "position").select(F.lit(0).alias("config_id"), F.col("position").cast("int").alias("position"), "sensor_id")
    return config_logdet(blocks, placed, r_sq).select("logdet")


def selected_coords(sensors: DataFrame, config: DataFrame) -> DataFrame:
    """Every sensor's coordinates and whether the configuration has it."""
    own = config.select("sensor_id", F.lit(True).alias("is_in"))
    return sensors.join(own, "sensor_id", "left").select("sensor_id", "lon", "lat", F.col("is_in").isNotNull().alias("selected"))


def density_histogram(samples: DataFrame, bins: int = 50) -> DataFrame:
    """(bin, left_edge, right_edge, n, density) of finite objectives: equal widths from least to largest,
    the last bin closed, empty bins kept; a width of 1 around a single value."""
    values = samples.where(F.col("logdet").isNotNull())
    ends = values.agg(F.min("logdet").alias("low"), F.max("logdet").alias("high"), F.count("*").alias("total"))
    same = F.col("low") == F.col("high")
    ends = ends.where("total > 0").select(F.when(same, F.col("low") - 0.5).otherwise(F.col("low")).alias("low"), F.when(same, F.col("high") + 0.5).otherwise(F.col("high")).alias("high"), "total")
    at = F.least(F.floor((F.col("logdet") - F.col("low")) / ((F.col("high") - F.col("low")) / bins)).cast("int"), F.lit(bins - 1))
    counts = values.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))  # ends has one row
    width = (F.col("high") - F.col("low")) / bins
    every = samples.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(ends))
    n = F.coalesce("n", F.lit(0)).cast("long")
    return every.join(counts, "bin", "left").select("bin", (F.col("low") + F.col("bin") * width).alias("left_edge"), (F.col("low") + (F.col("bin") + 1) * width).alias("right_edge"), n.alias("n"), (n / (F.col("total") * width)).alias("density"))


def sigma_distance(samples: DataFrame, optimum: float | Column) -> DataFrame:
    """One row (n, mean, max, stddev, to_mean, to_max): the optimum's distances in standard deviations;
    null for fewer than two samples or no spread, to_max also where the optimum is the largest sample."""
    optimum = F.lit(optimum) if isinstance(optimum, float) else optimum
    own = samples.agg(F.count("*").alias("n"), F.avg("logdet").alias("mean"), F.max("logdet").alias("max"), F.stddev_samp("logdet").alias("stddev"))
    fine = (F.col("n") >= 2) & (F.col("stddev") > 0)
    return own.withColumn("to_mean", F.when(fine, (optimum - F.col("mean")) / F.col("stddev"))).withColumn("to_max", F.when(fine & (F.col("max") != optimum), (optimum - F.col("max")) / F.col("stddev")))


def compare_designs(greedy: float, uniform: float, samples: DataFrame) -> DataFrame:
    """(design, logdet, to_mean, to_max): the greedy and the uniform value, and the random samples' mean."""
    own = sigma_distance(drop_infinite(samples), float(greedy))
    label = lambda design, *values: own.select(F.lit(design).alias("design"), *values)
    none = F.lit(None).cast("double")
    rows = label("greedy", F.lit(float(greedy)).alias("logdet"), "to_mean", "to_max")
    rows = rows.union(label("uniform", F.lit(float(uniform)), none, none))
    return rows.union(label("random", F.col("mean"), none, none)).union(label("random max", F.col("max"), none, none)).union(label("random stddev", F.col("stddev"), none, none))
