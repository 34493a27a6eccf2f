"""Analysis of timelines: events(lane, name, start_ms, dur_ms, candidate, buffer) of profiled runs.

Wherever keys are taken, a table with several traces is analysed by adding the trace's column to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names and limits of timeline events.
IO_NAMES = ("gpu_buffer_wait", "hdf5_read")
MAIN_NAMES = ("wait_for_io", "await_dispatch", "trsm_host")
GPU_NAME = "compute"
MAIN_MIN_MS = 1.0
COVER_MS = 0.05
CLIP_MS = 0.5
#: The parts that make up each group of a breakdown.
GROUPS = {"cast": ("h2d_si", "h2d_ii", "cast_si", "cast_ii", "scale_si", "scale_ii_diag", "scale_ii", "add_identity"), "trsm": ("trsm",), "gemm_chol": ("schur_gemm", "chol")}
ORDER = ("cast", "trsm", "gemm_chol")


def end_ms() -> Column:
    return F.col("start_ms") + F.col("dur_ms")


def segment_offsets(segments: DataFrame, wall_start_ms: float = 0.0, keys: tuple[str, ...] = ("candidate",)) -> DataFrame:
    """segments(keys, seq, name, ms) of positive length with their start: the wall start and all before."""
    before = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return segments.where("ms > 0").withColumn("start_ms", F.lit(wall_start_ms) + F.coalesce(F.sum("ms").over(before), F.lit(0.0)))


def breakdown_pct(breakdown: DataFrame, keys: tuple[str, ...] = ("candidate", "lane")) -> DataFrame:
    """breakdown(keys, name, ms) with the percentage of each part in its lane; null for an empty lane."""
    total = F.sum("ms").over(Window.partitionBy(*keys))
    return breakdown.withColumn("pct", F.when(total > 0, F.col("ms") * 100 / total))


def io_bandwidth(reads: DataFrame, k: int, nt: int, itemsize: int) -> DataFrame:
    """One row (n, bytes, seconds, gib_per_s) of reads(seconds), each of a candidate's k blocks and its own."""
    own = reads.agg(F.count("*").alias("n"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"))
    size = F.col("n") * ((k * nt * nt + nt * nt) * itemsize)
    return own.select("n", size.alias("bytes"), "seconds", F.when(F.col("seconds") > 0, size / float(1 << 30) / F.col("seconds")).otherwise(0.0).alias("gib_per_s"))


def timeline_window(events: DataFrame, x: int) -> DataFrame:
    """The events shown for start candidate x: I/O of x to x+5, main thread of x to x+4 that last 1 ms or
    more, compute of x-1 to x+4."""
    c, lane = F.col("candidate"), F.col("lane")
    io = (lane == "io") & c.between(x, x + 5) & F.col("name").isin(*IO_NAMES)
    main = (lane == "main") & c.between(x, x + 4) & F.col("name").isin(*MAIN_NAMES) & (F.col("dur_ms") >= MAIN_MIN_MS)
    gpu = (lane == "gpu") & c.between(max(x - 1, 0), x + 4) & (F.col("name") == GPU_NAME)
    return events.where(c.isNotNull() & (io | main | gpu))


def merge_io(events: DataFrame, keys: tuple[str, ...] = ("candidate",)) -> DataFrame:
    """One I/O bar for each candidate: from the last wait's end to the last read's end, or, with only one
    kind, from its first start to its last end; bars without length are dropped."""
    of = lambda name, value: F.when(F.col("name") == name, value)
    wait, read = IO_NAMES
    by = events.where((F.col("lane") == "io") & F.col("name").isin(*IO_NAMES)).groupBy(*keys).agg(
        F.min(of(read, F.col("start_ms"))).alias("rs"), F.max(of(read, end_ms())).alias("re"), F.min(of(wait, F.col("start_ms"))).alias("ws"), F.max(of(wait, end_ms())).alias("we")
    )
    start = F.when(F.col("rs").isNotNull() & F.col("ws").isNotNull(), F.col("we")).otherwise(F.coalesce("rs", "ws"))
    bars = by.select(*keys, F.lit("io").alias("lane"), F.lit("hdf5_io").alias("name"), start.alias("start_ms"), (F.coalesce("re", "we") - start).alias("dur_ms"))
    return bars.where("dur_ms > 0")


def dispatch_gaps(bars: DataFrame, events: DataFrame, main: DataFrame, x: int | None = None, keys: tuple[str, ...] = ("candidate",), order: str = "event_seq") -> DataFrame:
    """Bars of 1 ms or more between a candidate's I/O and the start of its compute (its last one in order)
    that no main event of that candidate covers; of the candidates shown for x, or of all."""
    shown = F.lit(True) if x is None else F.col("candidate").between(max(x - 1, 0), x + 4)
    gpu = events.where((F.col("lane") == "gpu") & (F.col("name") == GPU_NAME) & shown)
    gpu = gpu.groupBy(*keys).agg(F.max_by("start_ms", order).alias("gpu_start"))
    gaps = bars.select(*keys, end_ms().alias("io_end")).join(gpu, list(keys)).where(F.col("gpu_start") - F.col("io_end") >= MAIN_MIN_MS)
    cover = main.select(*(F.col(c).alias(f"m_{c}") for c in keys), F.col("start_ms").alias("m_start"), end_ms().alias("m_end"))
    same = F.lit(True)
    for c in keys:
        same = same & (F.col(c) == F.col(f"m_{c}"))
    inside = (F.col("m_start") <= F.col("io_end") + COVER_MS) & (F.col("m_end") >= F.col("gpu_start") - COVER_MS)
    left = gaps.join(cover, same & inside, "left_anti")
    return left.select(*keys, F.lit("main").alias("lane"), F.lit("await_dispatch").alias("name"), F.col("io_end").alias("start_ms"), (F.col("gpu_start") - F.col("io_end")).alias("dur_ms"))


def lane_assign(gpu: DataFrame) -> DataFrame:
    """gpu events with the lane gpu0 or gpu1 of their buffer, the candidate's parity where it is missing."""
    buffer = F.coalesce(F.col("buffer").cast("long"), F.coalesce(F.col("candidate"), F.lit(0)) % 2)
    return gpu.withColumn("lane", F.concat(F.lit("gpu"), buffer.cast("string")))


def window_bounds(events: DataFrame, x: int, pad: float = 0.03) -> DataFrame:
    """One row (lo, hi): from the first start of compute of x or I/O of x+1 (else 0) to the last end in x to
    x+3 (else of all) and a margin."""
    c, lane = F.col("candidate"), F.col("lane")
    anchor = (lane.startswith("gpu") & (c == x)) | ((lane == "io") & (c == x + 1))
    core = c.between(x, x + 3)
    own = events.agg(F.coalesce(F.min(F.when(anchor, F.col("start_ms"))), F.lit(0.0)).alias("lo"), F.coalesce(F.max(F.when(core, end_ms())), F.max(end_ms())).alias("end"))
    return own.select("lo", (F.col("end") + pad * F.greatest(F.col("end") - F.col("lo"), F.lit(1.0))).alias("hi"))


def plain_bounds(events: DataFrame, pad: float = 0.03) -> DataFrame:
    """One row (lo, hi) around all events with a margin on both sides; 0 and 1 without any."""
    own = events.agg(F.min("start_ms").alias("a"), F.max(end_ms()).alias("b"))
    span = F.greatest(F.col("b") - F.col("a"), F.lit(1.0)) * pad
    return own.select(F.coalesce(F.col("a") - span, F.lit(0.0)).alias("lo"), F.coalesce(F.col("b") + span, F.lit(1.0)).alias("hi"))


def clip_visible(events: DataFrame, bounds: DataFrame) -> DataFrame:
    """The events that overlap bounds(lo, hi), cut to it, with flags where more than 0.5 ms is cut off."""
    own = events.crossJoin(F.broadcast(bounds)).where((end_ms() >= F.col("lo")) & (F.col("start_ms") <= F.col("hi")))  # bounds has one row
    start, end = F.greatest("start_ms", "lo"), F.least(end_ms(), F.col("hi"))
    own = own.withColumn("bar_start", start).withColumn("bar_end", end)
    own = own.withColumn("clipped_left", F.col("start_ms") < F.col("lo") - CLIP_MS).withColumn("clipped_right", end_ms() > F.col("hi") + CLIP_MS)
    return own.where("bar_end > bar_start").drop("lo", "hi")


def consolidate_breakdown(parts: DataFrame, keys: tuple[str, ...] = ("candidate",), fold: bool = True) -> DataFrame:
    """(keys, name, ms) by group: named parts add up to their group if that is above 0, other names stay
    or, with fold, go to cast."""
    name = F.col("name")
    group = name
    for to, of in GROUPS.items():
        group = F.when(F.col("name").isin(*of), to).otherwise(group)
    mapped = F.col("name").isin(*[x for v in GROUPS.values() for x in v])
    by = parts.withColumn("g", group).withColumn("mapped", mapped).groupBy(*keys, F.col("g").alias("name"), "mapped").agg(F.sum("ms").alias("ms"))
    by = by.where(~F.col("mapped") | (F.col("ms") > 0))
    to = F.when(F.col("name").isin(*ORDER), F.col("name")).otherwise("cast") if fold else F.col("name")
    return by.groupBy(*keys, to.alias("name")).agg(F.sum("ms").alias("ms"))


def breakdown_slices(groups: DataFrame, min_pct: float, always: tuple[str, ...] = (), keys: tuple[str, ...] = ("candidate",)) -> DataFrame:
    """(keys, place, name, pct) of groups(keys, name, ms): fixed order, then by name; parts below min_pct
    that aren't always shown make up `other`, last. Nothing for a total of 0."""
    total = F.sum("ms").over(Window.partitionBy(*keys))
    pct = F.col("ms") * 100 / F.col("total")
    own = groups.withColumn("total", total).where("total > 0").withColumn("pct", pct)
    small = (F.lit(min_pct) > 0) & (F.col("pct") < min_pct) & (~F.col("name").isin(*always) if always else F.lit(True))
    own = own.withColumn("name", F.when(small, "other").otherwise(F.col("name"))).groupBy(*keys, "name").agg(F.sum("pct").alias("pct"))
    rank = F.lit(len(ORDER))
    for i, n in enumerate(ORDER):
        rank = F.when(F.col("name") == n, i).otherwise(rank)
    rank = F.when(F.col("name") == "other", len(ORDER) + 1).otherwise(rank)
    own = own.where((F.col("name") != "other") | (F.col("pct") > 0))
    return own.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy(rank, "name")).alias("place"), "name", "pct")


def display_widths(slices: DataFrame, least: float = 1.2, keys: tuple[str, ...] = ("candidate",)) -> DataFrame:
    """slices with their widths: positive parts are raised to least, and all scaled to 100."""
    raised = F.when(F.col("pct") > 0, F.greatest("pct", F.lit(least))).otherwise(0.0)
    own = slices.withColumn("raised", raised).withColumn("total", F.sum("raised").over(Window.partitionBy(*keys)))
    return own.withColumn("width", F.when(F.col("total") > 0, F.col("raised") * 100 / F.col("total")).otherwise(F.col("pct"))).drop("raised", "total")


def profiler_window(trace: DataFrame, order: str = "event_seq") -> DataFrame:
    """(kind, name, start_ms, dur_ms) of the complete events in the window of the first Candidate_Eval_0,
    by kind io or compute, others left out; an error if there is no such event."""
    own = trace.where((F.col("name") == "Candidate_Eval_0") & (F.col("ph") == "X")).agg(F.min_by(F.struct("ts", "dur"), order).alias("w"))
    w = F.when(F.col("w").isNull(), F.raise_error(F.lit("Candidate_Eval_0 isn't in the trace")).cast("double")).otherwise(F.col("w.ts"))
    bounds = own.select((w - F.col("w.dur") * 0.02).alias("lo"), (F.col("w.ts") + F.col("w.dur") * 1.05).alias("hi"))
    seen = trace.where("ph = 'X' and ts is not null and dur is not null").crossJoin(F.broadcast(bounds)).where("ts + dur >= lo and ts <= hi")  # bounds has one row
    name = F.col("name")
    kind = F.when(name.contains("POSIX_Lustre_Read") | (name == "IO_Wait_For_GPU"), "io").when(name.contains("Math_Operations") | name.contains("H2D_Transfer"), "compute")
    return seen.select(kind.alias("kind"), "name", ((F.col("ts") - F.col("lo")) / 1000.0).alias("start_ms"), (F.col("dur") / 1000.0).alias("dur_ms")).where("kind is not null")


def capture_filter(events: DataFrame, x: int, n_candidates: int) -> DataFrame:
    """Events recorded for start candidate x of n: I/O and GPU from max(0, x-1) on; an error if x is out of range."""
    if not 0 <= x < n_candidates:
        raise ValueError("the start candidate is out of range")
    return events.where(~F.col("lane").isin("io", "gpu") | (F.col("candidate") >= max(0, x - 1)))
