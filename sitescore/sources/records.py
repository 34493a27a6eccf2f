"""Files of samples, measurements and timelines."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import cut
from .pieces import JsonFiles, numbered_lines

# The files' columns and formats.
SAMPLES = "sample_id long, logdet double, retries int"
SCALING = "ranks int, actual_evals long, io_time double, compute_time double, wall_time double, imbalance_time double, comm_time double"
EVENT = "struct<lane: string, name: string, start_ms: double, dur_ms: double, candidate: long, buffer: int>"
TRACE_EVENT = "struct<name: string, ph: string, ts: double, dur: double>"
TIMELINE = f"format string, events array<{EVENT}>, start_candidate long, traceEvents array<{TRACE_EVENT}>"
BREAKDOWN = "format string, candidate long, io_ms map<string, double>, gpu_ms map<string, double>"
TIMELINE_FORMATS = ("pipelined_timeline_v1", "pipelined_timeline_v2")
#: Documents up to this many are sent to all tasks (three short columns each); more are joined by a shuffle.
BROADCAST_DOCUMENTS = 100_000


def append_samples(samples: DataFrame, path: str) -> None:
    samples.select("sample_id", "logdet", "retries").write.mode("append").parquet(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """The samples saved so far; none where the path isn't there yet."""
    try:
        return spark.read.schema(SAMPLES).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], SAMPLES)


def checkpoint_objective(line: Column) -> Column:
    """The objective of a line of numbers: of one or two the first, of more the second."""
    parts = F.split(F.trim(line), r"\s+")
    return F.when(F.size(parts) >= 3, F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0))).try_cast("double")


def append_scaling_csv(rows: DataFrame, path: str) -> None:
    rows.select("ranks", "actual_evals", "io_time", "compute_time", "wall_time", "imbalance_time", "comm_time").write.mode("append").option("header", True).csv(path)


def read_measurements(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCALING).option("header", True).csv(path)


def detect_format(format: Column, events: Column) -> Column:
    """manual or pytorch, by a document's format and whether it has trace events; anything else is an error."""
    return F.when(format.isin(*TIMELINE_FORMATS), "manual").when(events, "pytorch").otherwise(F.raise_error(F.lit("unrecognized trace format")))


def traced(spark: SparkSession, path: str, kind: str, key: str, schema: str) -> DataFrame:
    """(trace_file, event) of the objects below a key of the documents of one kind."""
    files = JsonFiles(spark, path, 3)
    documents = files.documents("format", "traceEvents")
    found = detect_format(F.trim(F.col("format"), F.lit('"')), F.col("traceEvents").isNotNull())
    documents = cut(documents.select("file", "document", found.alias("kind"))).where(F.col("kind") == kind)
    few = documents.count() <= BROADCAST_DOCUMENTS
    own = files.objects(key).join(F.broadcast(documents) if few else documents, ["file", "document"], "left_semi")
    return own.select(F.col("file").alias("trace_file"), F.from_json("value", schema, {"mode": "FAILFAST"}).alias("event"))


def read_timeline(spark: SparkSession, path: str) -> DataFrame:
    """(trace_file, lane, name, start_ms, dur_ms, candidate, buffer) of the manual timelines in path: JSON documents on
    one line or indented, one or many to a file, each read in as many splits as its length gives."""
    return traced(spark, path, "manual", "events", EVENT).select("trace_file", "event.*")


def read_profiler_trace(spark: SparkSession, path: str) -> DataFrame:
    """(name, ph, ts, dur) of the profiler traces in path, read as timelines are."""
    return traced(spark, path, "pytorch", "traceEvents", TRACE_EVENT).select("event.*")


def read_breakdown(spark: SparkSession, path: str) -> DataFrame:
    """(candidate, lane, name, ms) of documents on one line or indented; one that isn't a breakdown is an error."""
    rows = JsonFiles(spark, path, 1).objects().select(F.from_json("value", BREAKDOWN).alias("d")).select("d.*")
    fine = F.when(F.col("format") == "candidate_breakdown_v1", True).otherwise(F.raise_error(F.lit("expected candidate_breakdown_v1")).cast("boolean"))
    lanes = F.map_from_arrays(F.array(F.lit("io"), F.lit("gpu")), F.array("io_ms", "gpu_ms"))
    return rows.where(fine).select("candidate", F.explode(lanes).alias("lane", "ms")).select("candidate", "lane", F.explode("ms").alias("name", "ms"))


def timeline_json(spans: DataFrame, t0: Column, key: str, indent: bool = False) -> DataFrame:
    """(key, value): one JSON document for each key of spans(key, lane, name, start, end, candidate, buffer),
    in seconds; spans that end before they start are dropped, times become milliseconds from t0. On one line, or indented."""
    event = F.struct("lane", "name", ((F.col("start") - t0) * 1000).alias("start_ms"), ((F.col("end") - F.col("start")) * 1000).alias("dur_ms"), "candidate", "buffer")
    by = spans.where("end >= start").groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col("start"), event.alias("e")))).alias("events"))
    document = F.struct(F.lit(TIMELINE_FORMATS[0]).alias("format"), F.transform("events", lambda x: x["e"]).alias("events"))
    return by.select(key, F.to_json(document, {"pretty": str(indent).lower()}).alias("value"))


def write_timeline(spans: DataFrame, t0: Column, key: str, path: str, indent: bool = False, mode: str = "overwrite") -> None:
    timeline_json(spans, t0, key, indent).select("value").write.mode(mode).text(path)


def read_coords(spark: SparkSession, path: str) -> DataFrame:
    """(sensor_id, lon, lat) of a CSV file with a header, or of several in the order of their paths.

    With a column sensor_id the columns go by their names. A file of two columns has longitudes and latitudes, and
    a row's number in it is the sensor's id. Any other header is an error.
    """
    first = spark.read.text(path).first()
    names = [x.strip().strip('"').lower() for x in first[0].split(",")] if first else []
    if {"sensor_id", "lon", "lat"} <= {*names}:
        own = spark.read.option("header", True).csv(path)
        named = {c.strip().lower(): F.col(f"`{c}`") for c in own.columns}
        return own.select(*(F.trim(named[c]).cast(t).alias(c) for c, t in (("sensor_id", "int"), ("lon", "double"), ("lat", "double"))))
    if len(names) != 2:
        raise ValueError(f"expected lon,lat or sensor_id,lon,lat, found {first[0] if first else 'nothing'}")
    parts = F.split("value", ",")
    own = numbered_lines(spark, path, header=1)
    return own.select(F.col("number").cast("int").alias("sensor_id"), F.trim(parts[0]).cast("double").alias("lon"), F.trim(parts[1]).cast("double").alias("lat"))


def read_ablation(spark: SparkSession, path: str) -> DataFrame:
    """The measurements of a CSV file with a header, k as an int and all others as doubles, nan (in any case) or nothing
    for a variant that didn't run or ran out of memory."""
    own = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    value = lambda c: F.coalesce(F.when(F.lower(c) == "nan", F.lit(float("nan"))).otherwise(F.col(c).cast("double")), F.lit(float("nan")))
    return own.select(*(F.col(c).cast("double").cast("int").alias(c) if c == "k" else value(c).alias(c) for c in own.columns))


def append_ablation(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).csv(path)
