"""Queries on run measurements and timelines, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scaling, timeline
from ..operators.state import shared_path
from ..sources import fixtures as fx
from ..sources import records
from .matrix import r6

#: Events of one document, about; a timeline's candidate has 20.
DOCUMENT = 10_000
#: Start candidate of the timeline window.
X = 10
VARIANTS = {"N_IP": ("time_N_IP", "time_N_IP"), "S_IP": ("time_S_IP", "time_S_IP")}
SYSTEMS = ("A", 1.0), ("B", 1.25)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaling.best_over_runs(scaling.run_summary(fx.raw_runs(spark, sf_dir)))


def s11_scaling_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appended twice, the second time with wall times of 1.1 times."""
    path, own = shared_path(spark, "scaling"), _best(spark, sf_dir)
    for factor in (1.0, 1.1):
        records.append_scaling_csv(own.withColumn("wall_time", F.col("wall_time") * factor), path)
    return rounded(records.read_measurements(spark, path), *scaling.METRICS)


def _timeline_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fx.timeline(spark, sf_dir)
    start = F.col("start_ms") / 1000 + 5
    end = start + F.when(F.col("event_seq") % 11 == 0, -F.col("dur_ms")).otherwise(F.col("dur_ms")) / 1000
    # A trace is written as documents of a bounded number of candidates.
    trace, part = F.col("candidate") % 16, F.floor(F.col("candidate") / (16 * DOCUMENT // 20))
    return own.select(F.struct(trace.alias("trace"), part.alias("part")).alias("document"), "lane", "name", start.alias("start"), end.alias("end"), "candidate", "buffer")


def s12_read_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the documents on a line each, half indented."""
    path, spans = shared_path(spark, "timeline"), _timeline_spans(spark, sf_dir)
    for indent in (False, True):
        records.write_timeline(spans.where((F.col("document.part") % 2 == 1) == indent), F.lit(5.0), "document", path, indent, "append")
    return records.read_timeline(spark, path).select("lane", "name", F.round("start_ms", 3).alias("start_ms"), F.round("dur_ms", 3).alias("dur_ms"), "candidate", "buffer")


def s12_read_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "breakdown")
    by = fx.segments(spark, sf_dir).groupBy("candidate").agg(F.map_from_entries(F.collect_list(F.struct("name", "ms"))).alias("gpu_ms"))
    by.select(F.to_json(F.struct(F.lit("candidate_breakdown_v1").alias("format"), "candidate", F.create_map(F.lit("hdf5_read_si"), F.lit(1.5)).alias("io_ms"), "gpu_ms"), {"pretty": "true"}).alias("value")).write.text(path)
    return rounded(records.read_breakdown(spark, path), "ms")


def s12_read_profiler_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "trace")
    by = fx.trace(spark, sf_dir).groupBy(F.floor(F.col("event_seq") / DOCUMENT).alias("f")).agg(F.collect_list(F.struct("name", "ph", "ts", "dur")).alias("traceEvents"))
    for indent in (False, True):
        by.where((F.col("f") % 2 == 1) == indent).select(F.to_json(F.struct("traceEvents"), {"pretty": str(indent).lower()}).alias("value")).write.mode("append").text(path)
    return records.read_profiler_trace(spark, path).select("name", "ph", F.round("ts", 1).alias("ts"), F.round("dur", 1).alias("dur"))


def s13_write_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events each trace's written documents have, and their total length."""
    found = records.timeline_json(_timeline_spans(spark, sf_dir), F.lit(5.0), "document")
    own = found.select("document.trace", F.from_json("value", records.TIMELINE).alias("j"))
    total = F.aggregate("j.events", F.lit(0.0), lambda a, e: a + e["dur_ms"])
    by = own.select("trace", "j.format", F.size("j.events").alias("n"), total.alias("ms")).groupBy("trace", "format")
    return by.agg(F.sum("n").cast("int").alias("n_events"), F.round(F.sum("ms"), 3).alias("total_ms"))


def m1_benchmark_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fx.sensors(spark, sf_dir)
    drawn, found = scaling.benchmark_draw(own, 12, 500, 100, 200)
    other = scaling.benchmark_draw(own, 12, 20, 100, 200, replace=False)[1]
    out = drawn.select(F.lit("selected").alias("kind"), F.lit(-1).cast("long").alias("draw"), "sensor_id")
    return out.union(found.select(F.lit("with"), "draw", "sensor_id")).union(other.select(F.lit("without"), "draw", "sensor_id"))


def m2_cap_per_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scaling.benchmark_draw(fx.sensors(spark, sf_dir), 12, 500, 100, 200)[1]
    return scaling.cap_per_rank(found, 500, 7, 50).select("draw", "sensor_id", "rank")


def m3_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scaling.run_summary(fx.raw_runs(spark, sf_dir)), *scaling.METRICS)


def m4_best_over_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_best(spark, sf_dir), *scaling.METRICS)


def m5_best_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scaling.best_run(scaling.run_summary(fx.raw_runs(spark, sf_dir))), *scaling.METRICS)


def _axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaling.node_axis(_best(spark, sf_dir), 4, 64)


def m6_node_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _axis(spark, sf_dir).select("ranks", "nodes", "gpus", r6("wall_time"))


def m7_scaling_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    systems = F.explode(F.array(*[F.struct(F.lit(a).alias("system"), F.lit(b).alias("factor")) for a, b in SYSTEMS]))
    own = _axis(spark, sf_dir).withColumn("s", systems).withColumn("wall_time", F.col("wall_time") * F.col("s.factor")).select("s.system", "nodes", "wall_time")
    found = [scaling.scaling_efficiency(own, weak).withColumn("weak", F.lit(weak)) for weak in (True, False)]
    return rounded(found[0].union(found[1]), "wall_time", "ideal", "efficiency")


def m8_scaling_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fx.table(spark, sf_dir, "part").select("p_partkey", F.pow(F.lit(2.0), F.col("p_size") % 4).cast("int").alias("start"), (F.col("p_partkey") % 600).cast("int").alias("most"))
    return own.select("p_partkey", F.inline(scaling.scaling_plan(F.col("start"), F.col("most"), 8192, 256, 4)))


def _parity(df: DataFrame, parity: int) -> DataFrame:
    gone = F.col("k") / 10 % 2 == parity
    return df.select("device", "k", *(F.when(gone, F.lit(float("nan"))).otherwise(F.col(c)).alias(c) for c in ("time_N_IP", "time_S_IP")))


def m9_patch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fx.ablation(spark, sf_dir)
    old, new = _parity(own, 0), _parity(own, 1).withColumn("time_S_IP", F.col("time_S_IP") * 2)
    devices = own.select("device").distinct()
    sweep = devices.select("device", F.explode(F.sequence(F.lit(10), F.lit(450), F.lit(10))).alias("k"))
    return rounded(scaling.patch_results(sweep, old, new, VARIANTS, ("device", "k")), "time_N_IP", "time_S_IP")


def m10_oom_latch(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fx.ablation(spark, sf_dir).withColumn("time_N_IP", F.when(F.col("k") == 200, F.lit(float("nan"))).otherwise(F.col("time_N_IP"))).withColumn("known", F.col("k") % 100 == 0)
    found = scaling.oom_latch(own, "time_N_IP", ("device",), "known")
    return found.select("device", "k", F.when(F.isnan("time_N_IP"), None).otherwise(F.round("time_N_IP", 6)).alias("time_N_IP"))


def m11_finite_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scaling.finite_points(fx.ablation(spark, sf_dir), "time_N_IP"), "t")


def m12_loglog_exponent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scaling.loglog_exponent(fx.ablation(spark, sf_dir), "time_N_IP"), "exponent")


def m13_theory_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scaling.theory_curve(fx.ablation(spark, sf_dir), "time_N_IP", 3)
    return found.select(r6("k"), F.round(F.col("t") * 1e3, 6).alias("t"))


def m14_axis_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scaling.axis_limits(fx.ablation(spark, sf_dir), "time_N_IP"), "x_max", "y_max")


def m15_segment_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(timeline.segment_offsets(fx.segments(spark, sf_dir), 7.5), "ms", "start_ms")


def m16_breakdown_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fx.segments(spark, sf_dir).select("candidate", F.lit("gpu").alias("lane"), "name", "ms")
    return rounded(timeline.breakdown_pct(own), "ms", "pct")


def m17_io_bandwidth(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = fx.timeline(spark, sf_dir).where("name = 'hdf5_read'").select((F.col("dur_ms") / 1000).alias("seconds"))
    return timeline.io_bandwidth(reads, 175, 420, 4).select("n", "bytes", F.round("seconds", 4).alias("seconds"), r6("gib_per_s"))


def m18_timeline_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.timeline_window(fx.timeline(spark, sf_dir), X).select("event_seq", "lane", "name", F.round("start_ms", 3).alias("start_ms"), F.round("dur_ms", 3).alias("dur_ms"))


def m19_merge_io(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = timeline.merge_io(fx.timeline(spark, sf_dir))
    return found.select("candidate", "lane", "name", F.round("start_ms", 3).alias("start_ms"), F.round("dur_ms", 3).alias("dur_ms"))


def _tight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A timeline with compute after all I/O, in which some main events last long enough to cover the gaps."""
    own = fx.timeline(spark, sf_dir)
    own = own.withColumn("start_ms", F.when(F.col("lane") == "gpu", F.col("start_ms") + 1e9).otherwise(F.col("start_ms")))
    return own.withColumn("dur_ms", F.when((F.col("lane") == "main") & (F.col("event_seq") % 11 == 0), 1e12).otherwise(F.col("dur_ms")))


def m20_dispatch_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _tight(spark, sf_dir)
    shown = timeline.timeline_window(own, X)
    out = lambda found, kind: found.select(F.lit(kind).alias("kind"), "candidate", "name", F.round("start_ms", 3).alias("start_ms"), F.round("dur_ms", 3).alias("dur_ms"))
    every = timeline.dispatch_gaps(timeline.merge_io(own), own, own.where("lane = 'main'"))
    return out(every, "all").union(out(timeline.dispatch_gaps(timeline.merge_io(shown), own, shown.where("lane = 'main'"), X), "shown"))


def m21_lane_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.lane_assign(fx.timeline(spark, sf_dir).where("lane = 'gpu'")).select("event_seq", "lane")


def _plot_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = timeline.timeline_window(fx.timeline(spark, sf_dir), X)
    columns = ("lane", "name", "start_ms", "dur_ms", "candidate")
    return timeline.merge_io(seen).select(*columns).union(seen.where("lane = 'main'").select(*columns)).union(timeline.lane_assign(seen.where("lane = 'gpu'")).select(*columns))


def m22_window_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _plot_events(spark, sf_dir)
    found = timeline.window_bounds(own, X).select(F.lit("anchored").alias("kind"), "lo", "hi").union(timeline.plain_bounds(own).select(F.lit("plain"), "lo", "hi"))
    return found.select("kind", F.round("lo", 3).alias("lo"), F.round("hi", 3).alias("hi"))


def m23_clip_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fx.timeline(spark, sf_dir)
    found = timeline.clip_visible(own, timeline.window_bounds(own, X))
    return found.select("event_seq", F.round("bar_start", 3).alias("bar_start"), F.round("bar_end", 3).alias("bar_end"), "clipped_left", "clipped_right")


def m24_consolidate_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fx.segments(spark, sf_dir).withColumn("name", F.when(F.col("seq") == 0, "warmup").otherwise(F.col("name")))
    return rounded(timeline.consolidate_breakdown(own), "ms")


def _slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.breakdown_slices(fx.segments(spark, sf_dir).select("candidate", "name", "ms"), 5.0, ("trsm",))


def m25_breakdown_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_slices(spark, sf_dir), "pct")


def m26_display_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(timeline.display_widths(_slices(spark, sf_dir), 12.0), "pct", "width")


def m27_profiler_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = timeline.profiler_window(fx.trace(spark, sf_dir))
    return found.select("kind", "name", F.round("start_ms", 3).alias("start_ms"), F.round("dur_ms", 3).alias("dur_ms"))


def m28_capture_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fx.timeline(spark, sf_dir)
    n = own.agg(F.max("candidate") + 1).first()[0]
    return timeline.capture_filter(own, X, n).select("event_seq", "lane", "candidate")


METRICS_SQL = ", ".join(f"round({m}, 6) AS {m}" for m in scaling.METRICS)
RUNS = f"""WITH {fx.RAW}, runs AS (SELECT ranks, run, count(*) AS actual_evals, max(io) AS io_time, avg(compute) AS compute_time, max(wall) AS wall_time, max(compute) - avg(compute) AS imbalance_time, max(comm) AS comm_time FROM raw GROUP BY ranks, run)"""
BEST = f"{RUNS}, best AS (SELECT ranks, min(actual_evals) AS actual_evals, {', '.join(f'min({m}) AS {m}' for m in scaling.METRICS)} FROM runs GROUP BY ranks)"
AXIS = f"{BEST}, axis AS (SELECT *, ranks / 4.0::DOUBLE AS nodes, ranks::DOUBLE AS gpus FROM best WHERE ranks BETWEEN 4 AND 256)"
DRAW = f"""WITH {fx.SENSORS}, sel AS (SELECT sensor_id FROM sensors QUALIFY row_number() OVER (ORDER BY md5('100-' || sensor_id), sensor_id) <= 12),
pool AS (SELECT sensor_id, row_number() OVER (ORDER BY sensor_id) - 1 AS place FROM sensors WHERE sensor_id NOT IN (SELECT sensor_id FROM sel)),
draws AS (SELECT d AS draw, ('0x' || md5('200-' || d)[1:8])::BIGINT % (SELECT count(*) FROM pool) AS place FROM range(500) x(d)),
found AS (SELECT draw, sensor_id FROM draws JOIN pool USING (place))"""
FINITE = "f AS (SELECT device, k, time_N_IP AS t FROM ablation WHERE NOT isnan(time_N_IP) AND time_N_IP > 0)"
SPANS = f"WITH {fx.TIMELINE}, spans AS (SELECT candidate % 16 AS trace, lane, name, start_ms, dur_ms, candidate, buffer FROM timeline WHERE event_seq % 11 <> 0 OR dur_ms <= 0)"


def seen_sql(source: str) -> str:
    return f"""seen AS (SELECT * FROM {source} WHERE lane = 'io' AND candidate BETWEEN {X} AND {X + 5} AND name IN ('gpu_buffer_wait', 'hdf5_read')
  OR lane = 'main' AND candidate BETWEEN {X} AND {X + 4} AND name IN ('wait_for_io', 'await_dispatch', 'trsm_host') AND dur_ms >= 1 OR lane = 'gpu' AND candidate BETWEEN {X - 1} AND {X + 4} AND name = 'compute')"""


def bars_sql(source: str) -> str:
    return f"""bars AS (SELECT candidate, 'io' AS lane, 'hdf5_io' AS name, s AS start_ms, e - s AS dur_ms FROM (SELECT candidate, CASE WHEN rs IS NOT NULL AND ws IS NOT NULL THEN we ELSE coalesce(rs, ws) END AS s, coalesce(re, we) AS e FROM
  (SELECT candidate, min(start_ms) FILTER (name = 'hdf5_read') AS rs, max(start_ms + dur_ms) FILTER (name = 'hdf5_read') AS re, min(start_ms) FILTER (name = 'gpu_buffer_wait') AS ws, max(start_ms + dur_ms) FILTER (name = 'gpu_buffer_wait') AS we
   FROM {source} WHERE lane = 'io' GROUP BY candidate)) WHERE e - s > 0)"""


def bounds_sql(source: str) -> str:
    return f"""bounds AS (SELECT lo, e + 0.03::DOUBLE * greatest(e - lo, 1) AS hi FROM (SELECT coalesce(min(start_ms) FILTER (lane LIKE 'gpu%' AND candidate = {X} OR lane = 'io' AND candidate = {X + 1}), 0) AS lo,
  coalesce(max(start_ms + dur_ms) FILTER (candidate BETWEEN {X} AND {X + 3}), max(start_ms + dur_ms)) AS e FROM {source}))"""


TIMES = "round(start_ms, 3) AS start_ms, round(dur_ms, 3) AS dur_ms"
SLICES = f"""WITH {fx.SEGMENT_ROWS}, p AS (SELECT candidate, name, 100 * ms / sum(ms) OVER (PARTITION BY candidate) AS pct FROM segments QUALIFY sum(ms) OVER (PARTITION BY candidate) > 0),
s AS (SELECT candidate, CASE WHEN pct < 5 AND name <> 'trsm' THEN 'other' ELSE name END AS name, sum(pct) AS pct FROM p GROUP BY 1, 2),
slices AS (SELECT candidate, row_number() OVER (PARTITION BY candidate ORDER BY CASE name WHEN 'trsm' THEN 1 WHEN 'other' THEN 4 ELSE 3 END, name)::INT AS place, name, pct FROM s WHERE name <> 'other' OR pct > 0)"""

SQL: dict[str, str] = {
    "s11_scaling_csv": f"{BEST} SELECT ranks, actual_evals, {METRICS_SQL} FROM best UNION ALL SELECT ranks, actual_evals, {METRICS_SQL.replace('round(wall_time', 'round(wall_time * 1.1::DOUBLE')} FROM best",
    "s12_read_timeline": f"{SPANS} SELECT lane, name, {TIMES}, candidate, buffer FROM spans",
    "s12_read_breakdown": f"WITH {fx.SEGMENT_ROWS} SELECT candidate, 'gpu' AS lane, name, round(ms, 6) AS ms FROM segments UNION ALL SELECT DISTINCT candidate, 'io', 'hdf5_read_si', 1.5 FROM segments",
    "s12_read_profiler_trace": f"WITH {fx.TRACE} SELECT name, ph, round(ts, 1) AS ts, round(dur, 1) AS dur FROM trace",
    "s13_write_timeline": f"{SPANS} SELECT trace, 'pipelined_timeline_v1' AS format, count(*)::INT AS n_events, round(sum(dur_ms), 3) AS total_ms FROM spans GROUP BY trace",
    "m1_benchmark_draw": f"{DRAW} SELECT 'selected' AS kind, -1::BIGINT AS draw, sensor_id FROM sel UNION ALL SELECT 'with', draw, sensor_id FROM found UNION ALL SELECT 'without', row_number() OVER (ORDER BY md5('200-' || sensor_id), sensor_id) - 1 AS draw, sensor_id FROM pool QUALIFY draw < 20",
    "m2_cap_per_rank": f"{DRAW} SELECT draw, sensor_id, (draw // 71)::INT AS rank FROM found WHERE draw // 71 < 7 AND draw % 71 < 50",
    "m3_run_summary": f"{RUNS} SELECT ranks, run, actual_evals, {METRICS_SQL} FROM runs",
    "m4_best_over_runs": f"{BEST} SELECT ranks, actual_evals, {METRICS_SQL} FROM best",
    "m5_best_run": f"{RUNS} SELECT ranks, run, actual_evals, {METRICS_SQL} FROM runs QUALIFY row_number() OVER (PARTITION BY ranks ORDER BY runs.wall_time, run) = 1",
    "m6_node_axis": f"{AXIS} SELECT ranks, nodes, gpus, round(wall_time, 6) AS wall_time FROM axis",
    "m7_scaling_efficiency": f"""{AXIS}, s AS (SELECT system, nodes, wall_time * factor AS w FROM axis, (VALUES ('A', 1.0::DOUBLE), ('B', 1.25::DOUBLE)) t(system, factor)),
i AS (SELECT system, nodes, w, weak, CASE WHEN weak THEN first(w) OVER o ELSE first(w) OVER o * first(nodes) OVER o / nodes END AS ideal FROM s, (VALUES (true), (false)) t(weak) WINDOW o AS (PARTITION BY system, weak ORDER BY nodes))
SELECT system, nodes, round(w, 6) AS wall_time, round(ideal, 6) AS ideal, round(100 * ideal / w, 6) AS efficiency, weak FROM i""",
    "m8_scaling_plan": "SELECT p_partkey, r::INT AS ranks, greatest(1, r // 4)::INT AS nodes, 8192 AS strong_total, (r * 256)::INT AS weak_total FROM (SELECT p_partkey, unnest(list_filter(list_transform(range(12), lambda i: (2 ** (p_size % 4 + i))::BIGINT), lambda r: r <= p_partkey % 600)) AS r FROM part)",
    "m9_patch_results": f"""WITH {fx.ABLATION}, o AS (SELECT device, k, CASE WHEN k // 10 % 2 = 0 THEN 'nan' ELSE time_N_IP END AS a, CASE WHEN k // 10 % 2 = 0 THEN 'nan' ELSE time_S_IP END AS b FROM ablation),
n AS (SELECT device, k, CASE WHEN k // 10 % 2 = 1 THEN 'nan' ELSE time_N_IP END AS a, CASE WHEN k // 10 % 2 = 1 THEN 'nan' ELSE time_S_IP END * 2 AS b FROM ablation),
w AS (SELECT device, (x * 10)::INT AS k FROM (SELECT DISTINCT device FROM ablation), range(1, 46) t(x))
SELECT device, k, CASE WHEN NOT isnan(o.a) THEN round(o.a, 6) WHEN NOT isnan(n.a) THEN round(n.a, 6) ELSE 'nan'::DOUBLE END AS time_N_IP, CASE WHEN NOT isnan(o.b) THEN round(o.b, 6) WHEN NOT isnan(n.b) THEN round(n.b, 6) ELSE 'nan'::DOUBLE END AS time_S_IP FROM w LEFT JOIN o USING (device, k) LEFT JOIN n USING (device, k)""",
    "m10_oom_latch": f"WITH {fx.ABLATION}, a AS (SELECT device, k, CASE WHEN k = 200 THEN 'nan' ELSE time_N_IP END AS t FROM ablation) SELECT device, k, CASE WHEN isnan(t) OR (coalesce(bool_or(isnan(t)) OVER (PARTITION BY device ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AND k % 100 <> 0) THEN NULL ELSE round(t, 6) END AS time_N_IP FROM a",
    "m11_finite_points": f"WITH {fx.ABLATION}, {FINITE} SELECT k::DOUBLE AS k, round(t, 6) AS t FROM f",
    "m12_loglog_exponent": f"WITH {fx.ABLATION}, {FINITE} SELECT device, CASE WHEN count(*) FILTER (f.k >= 50) >= 3 THEN round(regr_slope(ln(t), ln(f.k)) FILTER (f.k >= 50), 6) ELSE 'nan'::DOUBLE END AS exponent FROM (SELECT DISTINCT device FROM ablation) LEFT JOIN f USING (device) GROUP BY device",
    "m13_theory_curve": f"""WITH {fx.ABLATION}, {FINITE}, c AS (SELECT median(t) / 100 ** 3 AS c FROM (SELECT device, t FROM f QUALIFY row_number() OVER (PARTITION BY device ORDER BY abs(k - 100), k) = 1)), e AS (SELECT max(k) * 1.03::DOUBLE AS x FROM f),
p AS (SELECT x * i / 99 AS k, c FROM range(100) t(i), e, c) SELECT round(k, 6) AS k, round(c * k ** 3 * 1e3, 6) AS t FROM p""",
    "m14_axis_limits": f"WITH {fx.ABLATION}, {FINITE} SELECT 0.0::DOUBLE AS x_min, round(max(k) * 1.03::DOUBLE, 6) AS x_max, 0.0::DOUBLE AS y_min, round(max(t) * 1.1::DOUBLE / 0.72::DOUBLE, 6) AS y_max FROM f",
    "m15_segment_offsets": f"WITH {fx.SEGMENT_ROWS} SELECT candidate, seq, name, round(ms, 6) AS ms, round(7.5::DOUBLE + coalesce(sum(ms) OVER (PARTITION BY candidate ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS start_ms FROM segments WHERE ms > 0",
    "m16_breakdown_pct": f"WITH {fx.SEGMENT_ROWS} SELECT candidate, 'gpu' AS lane, name, round(ms, 6) AS ms, CASE WHEN sum(ms) OVER (PARTITION BY candidate) > 0 THEN round(100 * ms / sum(ms) OVER (PARTITION BY candidate), 6) END AS pct FROM segments",
    "m17_io_bandwidth": f"WITH {fx.TIMELINE} SELECT count(*) AS n, (count(*) * ((175 * 420 * 420 + 420 * 420) * 4))::BIGINT AS bytes, round(sum(dur_ms / 1000), 4) AS seconds, round(count(*) * ((175 * 420 * 420 + 420 * 420) * 4) / 1073741824.0::DOUBLE / sum(dur_ms / 1000), 6) AS gib_per_s FROM timeline WHERE name = 'hdf5_read'",
    "m18_timeline_window": f"WITH {fx.TIMELINE}, {seen_sql('timeline')} SELECT event_seq, lane, name, {TIMES} FROM seen",
    "m19_merge_io": f"WITH {fx.TIMELINE}, {bars_sql('timeline')} SELECT candidate, lane, name, {TIMES} FROM bars",
    "m20_dispatch_gaps": f"""WITH {fx.TIMELINE}, tight AS (SELECT event_seq, lane, name, CASE WHEN lane = 'gpu' THEN start_ms + 1e9::DOUBLE ELSE start_ms END AS start_ms, CASE WHEN lane = 'main' AND event_seq % 11 = 0 THEN 1e12::DOUBLE ELSE dur_ms END AS dur_ms, candidate FROM timeline), {seen_sql('tight')},
{bars_sql('tight')}, {bars_sql('seen').replace('bars AS', 'shown AS', 1)}, gpu AS (SELECT candidate, arg_max(start_ms, event_seq) AS s FROM tight WHERE lane = 'gpu' GROUP BY candidate),
gaps AS (SELECT kind, candidate, start_ms + dur_ms AS a, s AS b FROM (SELECT 'all' AS kind, * FROM bars UNION ALL SELECT 'shown', * FROM shown WHERE candidate BETWEEN {X - 1} AND {X + 4}) JOIN gpu USING (candidate) WHERE s - (start_ms + dur_ms) >= 1)
SELECT kind, candidate, 'await_dispatch' AS name, round(a, 3) AS start_ms, round(b - a, 3) AS dur_ms FROM gaps WHERE NOT EXISTS (SELECT 1 FROM tight m WHERE m.lane = 'main' AND m.candidate = gaps.candidate AND m.start_ms <= a + 0.05 AND m.start_ms + m.dur_ms >= b - 0.05)""",
    "m21_lane_assign": f"WITH {fx.TIMELINE} SELECT event_seq, 'gpu' || coalesce(buffer, candidate % 2) AS lane FROM timeline WHERE lane = 'gpu'",
    "m22_window_bounds": f"""WITH {fx.TIMELINE}, {seen_sql('timeline')}, {bars_sql('seen')}, plot AS (SELECT lane, candidate, start_ms, dur_ms FROM bars UNION ALL SELECT lane, candidate, start_ms, dur_ms FROM seen WHERE lane <> 'io'), {bounds_sql('plot')}
SELECT 'anchored' AS kind, round(lo, 3) AS lo, round(hi, 3) AS hi FROM bounds UNION ALL SELECT 'plain', round(a - 0.03 * greatest(b - a, 1), 3), round(b + 0.03 * greatest(b - a, 1), 3) FROM (SELECT min(start_ms) AS a, max(start_ms + dur_ms) AS b FROM plot)""",
    "m23_clip_visible": f"WITH {fx.TIMELINE}, {bounds_sql('timeline')} SELECT event_seq, round(greatest(start_ms, lo), 3) AS bar_start, round(least(start_ms + dur_ms, hi), 3) AS bar_end, start_ms < lo - 0.5 AS clipped_left, start_ms + dur_ms > hi + 0.5 AS clipped_right FROM timeline, bounds WHERE start_ms + dur_ms >= lo AND start_ms <= hi AND least(start_ms + dur_ms, hi) > greatest(start_ms, lo)",
    "m24_consolidate_breakdown": f"""WITH {fx.SEGMENT_ROWS}, g AS (SELECT candidate, CASE WHEN seq = 5 THEN 'trsm' WHEN seq IN (7, 8) THEN 'gemm_chol' ELSE 'cast' END AS name, CASE WHEN seq = 0 THEN 1 ELSE 0 END AS other, sum(ms) AS ms FROM segments GROUP BY ALL HAVING other = 1 OR sum(ms) > 0)
SELECT candidate, name, round(sum(ms), 6) AS ms FROM g GROUP BY candidate, name""",
    "m25_breakdown_slices": f"{SLICES} SELECT candidate, place, name, round(pct, 6) AS pct FROM slices",
    "m26_display_widths": f"{SLICES}, r AS (SELECT *, CASE WHEN pct > 0 THEN greatest(pct, 12.0::DOUBLE) ELSE 0 END AS raised FROM slices) SELECT candidate, place, name, round(pct, 6) AS pct, round(100 * raised / sum(raised) OVER (PARTITION BY candidate), 6) AS width FROM r",
    "m27_profiler_window": f"""WITH {fx.TRACE}, w AS (SELECT ts - 0.02::DOUBLE * dur AS lo, ts + 1.05::DOUBLE * dur AS hi FROM trace WHERE name = 'Candidate_Eval_0'),
s AS (SELECT CASE WHEN contains(name, 'POSIX_Lustre_Read') OR name = 'IO_Wait_For_GPU' THEN 'io' WHEN contains(name, 'Math_Operations') THEN 'compute' END AS kind, name, (ts - lo) / 1000 AS start_ms, dur / 1000 AS dur_ms FROM trace, w WHERE ts + dur >= lo AND ts <= hi)
SELECT kind, name, {TIMES} FROM s WHERE kind IS NOT NULL""",
    "m28_capture_filter": f"WITH {fx.TIMELINE} SELECT event_seq, lane, candidate FROM timeline WHERE lane = 'main' OR candidate >= {X - 1}",
}

NAMES = (
    s11_scaling_csv, s12_read_timeline, s12_read_breakdown, s12_read_profiler_trace, s13_write_timeline, m1_benchmark_draw, m2_cap_per_rank, m3_run_summary, m4_best_over_runs, m5_best_run, m6_node_axis, m7_scaling_efficiency, m8_scaling_plan,
    m9_patch_results, m10_oom_latch, m11_finite_points, m12_loglog_exponent, m13_theory_curve, m14_axis_limits, m15_segment_offsets, m16_breakdown_pct, m17_io_bandwidth, m18_timeline_window, m19_merge_io, m20_dispatch_gaps, m21_lane_assign,
    m22_window_bounds, m23_clip_visible, m24_consolidate_breakdown, m25_breakdown_slices, m26_display_widths, m27_profiler_window, m28_capture_filter,
)
QUERIES = {f.__name__: f for f in NAMES}
