"""Tables in the shape of sensor-placement data, derived from general tables.

Each function reads parquet tables of a folder and gives one of the library's inputs: sensors with
a covariance matrix in blocks, configurations, objective samples, run measurements and timelines.
The SQL constants hold the same as DuckDB common table expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.linalg import listed
from ..operators.blocks import SCHEMA, Generated, tile_pairs
from ..operators.running import running

WINDOW = 48
#: Sensors a side of the tiles in which the matrix is made.
TILE = 64
R_SQ = 4.0
#: The timed parts of a candidate, in order.
SEGMENTS = ("h2d_si", "h2d_ii", "cast_si", "cast_ii", "scale_si", "trsm", "scale_ii_diag", "schur_gemm", "chol")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """(n_lon, n_lat): one place for each embedding, as nearly square as their number allows, n_lon <= n_lat."""
    n = table(spark, sf_dir, "embeddings").count()
    n_lon = max((d for d in range(1, int(n**0.5) + 1) if n % d == 0), default=1)
    return n_lon, n // n_lon


GRID = "g AS (SELECT max(d) AS n_lon, any_value(n) // max(d) AS n_lat FROM (SELECT count(*) AS n FROM embeddings), range(1, 100000) x(d) WHERE d * d <= n AND n % d = 0)"
SENSORS = f"""{GRID}, sensors AS (SELECT vec_id::INT AS sensor_id, (vec_id // n_lat)::INT AS lon_idx, (vec_id % n_lat)::INT AS lat_idx,
  -128 + 0.25::DOUBLE * (vec_id // n_lat) AS lon, 40 + 0.2::DOUBLE * (vec_id % n_lat) AS lat, embedding FROM embeddings, g)"""


def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sensor_id, lon_idx, lat_idx, lon, lat), a sensor for each embedding, latitude contiguous."""
    n_lat = grid(spark, sf_dir)[1]
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("sensor_id"))
    lon, lat = F.floor(F.col("sensor_id") / n_lat).cast("int"), F.col("sensor_id") % n_lat
    return own.select("sensor_id", lon.alias("lon_idx"), lat.alias("lat_idx"), (F.lit(-128.0) + 0.25 * lon).alias("lon"), (F.lit(40.0) + 0.2 * lat).alias("lat"))


def windows(embeddings: list, nt: int) -> np.ndarray:
    """(rows, nt, WINDOW): the lagged windows of each embedding."""
    e = np.array(embeddings, np.float64).reshape(len(embeddings), -1)
    return np.stack([e[:, t : t + WINDOW] for t in range(nt)], 1)


def varied(block: np.ndarray, i: np.ndarray, j: np.ndarray, nt: int, variant: str) -> pa.RecordBatch:
    """Blocks of the pairs (i, j) in one of the variants of k_blocks()."""
    same = i == j
    if variant == "nan":
        block[(same & (i % 10 == 3))[:, None, None] & ~np.eye(nt, dtype=bool)] = np.nan
    elif variant == "bad":
        block[same & (i % 13 == 5)] = -10 * np.eye(nt)
    elif variant in ("reject", "corner"):
        block[~same] *= {"reject": 3, "corner": 5}[variant]
    elif variant == "lopsided":
        block[i > j] *= 2
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), listed(block)], ["block_row", "block_col", "block"])


def embedded(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias(names[0]), F.col("embedding").cast("array<double>").alias(names[1]))


def k_matrix(spark: SparkSession, sf_dir: str, nt: int = 4, variant: str = "") -> Generated:
    """The matrix of k_blocks(), whose blocks are made for the pairs that are asked for."""

    def of(pairs: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    a, b = (windows(batch.column(x).to_pylist(), nt) for x in (2, 3))
                    yield varied(np.einsum("nti,nui->ntu", a, b), batch.column(0).to_numpy(), batch.column(1).to_numpy(), nt, variant)

        both = pairs.join(embedded(spark, sf_dir, "block_row", "a"), "block_row").join(embedded(spark, sf_dir, "block_col", "b"), "block_col")
        return both.select("block_row", "block_col", "a", "b").mapInArrow(run, SCHEMA)

    # What a variant changes isn't a product any more.
    windows_of = F.flatten(F.array(*(F.slice("e", t + 1, WINDOW) for t in range(nt))))
    features = None if variant else embedded(spark, sf_dir, "sensor_id", "e").select("sensor_id", windows_of.alias("f"))
    return Generated(sensors(spark, sf_dir).select("sensor_id"), of, nt, features, WINDOW)


def k_blocks(spark: SparkSession, sf_dir: str, nt: int = 4, variant: str = "") -> DataFrame:
    """(block_row, block_col, block): the Gram matrix of nt lagged windows of each sensor's embedding, all of it.

    variant: nan (not-a-number off the diagonal of some diagonal blocks), bad (some diagonal blocks
    are -10 I), reject and corner (off-diagonal blocks times 3 and 5), lopsided (lower triangle times 2).
    """
    rows = embedded(spark, sf_dir, "id", "e").select(F.struct("id", "e").alias("r"))
    tiles = rows.groupBy(F.floor(F.col("r.id") / TILE).alias("t")).agg(F.collect_list("r").alias("r")).select("t", F.col("r.id").alias("id"), F.col("r.e").alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ida, ea, idb, eb = (batch.column(i)[row].values for i in range(4))
                ida, idb = (x.to_numpy() for x in (ida, idb))
                a, b = (windows(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1), nt) for x in (ea, eb))
                block = np.einsum("ati,bui->abtu", a, b).reshape(-1, nt, nt)
                yield varied(block, np.repeat(ida, len(idb)), np.tile(idb, len(ida)), nt, variant)

    # The matrix has a block for every pair of sensors; they are made tile by tile.
    return tile_pairs(tiles, "id", "e", "id2", "e2").mapInArrow(run, SCHEMA)


def k_sql(nt: int, variant: str = "", name: str = "k") -> str:
    """Common table expressions with sensors and the cells name(block_row, block_col, t, t2, value)."""
    value = "list_dot_product(a.embedding[t + 1:t + 48]::DOUBLE[], b.embedding[t2 + 1:t2 + 48]::DOUBLE[])"
    same = "a.sensor_id = b.sensor_id"
    value = {
        "": value,
        "nan": f"CASE WHEN {same} AND a.sensor_id % 10 = 3 AND t <> t2 THEN 'nan'::DOUBLE ELSE {value} END",
        "bad": f"CASE WHEN {same} AND a.sensor_id % 13 = 5 THEN CASE WHEN t = t2 THEN -10.0 ELSE 0.0 END ELSE {value} END",
        "reject": f"CASE WHEN {same} THEN 1 ELSE 3 END * {value}",
        "corner": f"CASE WHEN {same} THEN 1 ELSE 5 END * {value}",
        "lopsided": f"CASE WHEN a.sensor_id > b.sensor_id THEN 2 ELSE 1 END * {value}",
    }[variant]
    return f"""{SENSORS}, {name} AS (SELECT a.sensor_id AS block_row, b.sensor_id AS block_col, t::INT AS t, t2::INT AS t2, ({value})::DOUBLE AS value
  FROM sensors a, sensors b, range({nt}) x(t), range({nt}) y(t2))"""


CONFIGS = "configs AS (SELECT c::INT AS config_id, p::INT AS position, ((c * 7 + p * 11) % (SELECT n_lon * n_lat FROM g))::INT AS sensor_id FROM range((SELECT n_lon * n_lat // 6 FROM g)) x(c), range(4) y(p) WHERE p < 1 + c % 4)"


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(config_id, position, sensor_id): configurations of 1 to 4 sensors, one for every six sensors."""
    n_lon, n_lat = grid(spark, sf_dir)
    n = n_lon * n_lat
    own = spark.range(n // 6).select(F.col("id").cast("int").alias("config_id"))
    own = own.select("config_id", F.explode(F.sequence(F.lit(0), F.col("config_id") % 4)).alias("position"))
    return own.select("config_id", "position", ((F.col("config_id") * 7 + F.col("position") * 11) % n).alias("sensor_id"))


SAMPLES = "samples AS (SELECT event_id AS sample_id, CASE WHEN event_id % 50 = 0 THEN 'inf'::DOUBLE ELSE value + 100 END AS logdet FROM events)"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("sample_id"), F.when(F.col("event_id") % 50 == 0, F.lit(float("inf"))).otherwise(F.col("value") + 100).alias("logdet"))


SELECTION = "selection AS (SELECT (row_number() OVER (ORDER BY vec_id) - 1)::INT AS step, vec_id::INT AS sensor_id, embedding[1]::DOUBLE AS gain, sum(embedding[1]::DOUBLE) OVER (ORDER BY vec_id) AS logdet FROM embeddings WHERE embedding[1] > 0)"


def selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(step, sensor_id, gain): a selection of the sensors whose embedding begins above zero, about half of them."""
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("sensor_id"), F.get("embedding", F.lit(0)).cast("double").alias("gain")).where("gain > 0")
    return running(own, ["sensor_id"], "step").select(F.col("step").cast("int").alias("step"), "sensor_id", "gain")


RAW = """raw AS (SELECT ranks, run, rank, sum(io) AS io, sum(compute) AS compute, sum(io + compute) AS wall, sum(comm) AS comm FROM (
  SELECT (4 * 2 ** (l_suppkey % 8))::INT AS ranks, (l_linenumber % 3)::INT AS run, (l_orderkey % (4 * 2 ** (l_suppkey % 8))::INT)::INT AS rank,
         l_quantity AS io, l_extendedprice / 1000 AS compute, l_tax AS comm FROM lineitem) GROUP BY ALL)"""


def raw_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ranks, run, rank, io, compute, wall, comm), one row for each rank of a run."""
    ranks = (F.lit(4) * F.pow(F.lit(2.0), F.col("l_suppkey") % 8)).cast("int")
    own = table(spark, sf_dir, "lineitem").select(ranks.alias("ranks"), (F.col("l_linenumber") % 3).cast("int").alias("run"), (F.col("l_orderkey") % ranks).cast("int").alias("rank"), F.col("l_quantity").alias("io"), (F.col("l_extendedprice") / 1000).alias("compute"), F.col("l_tax").alias("comm"))
    return own.groupBy("ranks", "run", "rank").agg(F.sum("io").alias("io"), F.sum("compute").alias("compute"), F.sum(F.col("io") + F.col("compute")).alias("wall"), F.sum("comm").alias("comm"))


ABLATION = """ablation AS (SELECT device, k, CASE WHEN k > 400 THEN 'nan'::DOUBLE ELSE a * pow(k, 3) / 1e12 END AS time_N_IP, a * pow(k, 2) / 1e9 AS time_S_IP
  FROM (SELECT p_brand AS device, (10 * p_size)::INT AS k, avg(p_retailprice) AS a FROM part GROUP BY ALL))"""


def ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(device, k, time_N_IP, time_S_IP); NaN stands for out of memory."""
    own = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("device"), (F.col("p_size") * 10).cast("int").alias("k")).agg(F.avg("p_retailprice").alias("a"))
    k = F.col("k").cast("double")
    return own.select("device", "k", F.when(F.col("k") > 400, F.lit(float("nan"))).otherwise(F.col("a") * F.pow(k, F.lit(3.0)) / 1e12).alias("time_N_IP"), (F.col("a") * F.pow(k, F.lit(2.0)) / 1e9).alias("time_S_IP"))


TIMELINE = """timeline AS (SELECT event_id AS event_seq, CASE WHEN event_type IN ('view', 'signup') THEN 'io' WHEN event_type IN ('click', 'error') THEN 'main' ELSE 'gpu' END AS lane,
  CASE event_type WHEN 'view' THEN 'hdf5_read' WHEN 'signup' THEN 'gpu_buffer_wait' WHEN 'click' THEN 'wait_for_io' WHEN 'error' THEN 'trsm_host' ELSE 'compute' END AS name,
  (epoch_us(ts) - min(epoch_us(ts)) OVER ()) / 1000.0::DOUBLE AS start_ms, value * 1000 AS dur_ms, (event_id // 20)::BIGINT AS candidate,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE ((event_id // 20) % 2)::INT END AS buffer FROM events)"""


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_seq, lane, name, start_ms, dur_ms, candidate, buffer)."""
    own = table(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    start = own.select(F.min(micros).alias("t0"))
    names = {"view": ("io", "hdf5_read"), "signup": ("io", "gpu_buffer_wait"), "click": ("main", "wait_for_io"), "error": ("main", "trsm_host")}
    lane, name = F.lit("gpu"), F.lit("compute")
    for kind, (a, b) in names.items():
        lane, name = F.when(F.col("event_type") == kind, a).otherwise(lane), F.when(F.col("event_type") == kind, b).otherwise(name)
    candidate = F.floor(F.col("event_id") / 20).cast("long")
    return own.crossJoin(F.broadcast(start)).select(  # start has one row
        F.col("event_id").alias("event_seq"), lane.alias("lane"), name.alias("name"), ((micros - F.col("t0")) / 1000.0).alias("start_ms"), (F.col("value") * 1000).alias("dur_ms"), candidate.alias("candidate"), F.when(F.col("event_id") % 7 != 0, (candidate % 2).cast("int")).alias("buffer")
    )


SEGMENT_ROWS = f"""segments AS (SELECT (event_id // 9)::BIGINT AS candidate, (event_id % 9)::INT AS seq,
  ({list(SEGMENTS)})[(event_id % 9 + 1)::INT] AS name, CASE WHEN event_id % 25 = 0 THEN 0 ELSE value END AS ms FROM events)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(candidate, seq, name, ms): nine timed parts for each candidate."""
    seq = (F.col("event_id") % 9).cast("int")
    names = F.array(*map(F.lit, SEGMENTS))
    return table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 9).cast("long").alias("candidate"), seq.alias("seq"), F.get(names, seq).alias("name"), F.when(F.col("event_id") % 25 == 0, F.lit(0.0)).otherwise(F.col("value")).alias("ms"))


TRACE = f"""{TIMELINE}, trace AS (SELECT event_seq, CASE name WHEN 'hdf5_read' THEN 'POSIX_Lustre_Read' WHEN 'gpu_buffer_wait' THEN 'IO_Wait_For_GPU' WHEN 'compute' THEN 'Math_Operations' ELSE 'GPU_Stream_Dispatch' END AS name,
  'X' AS ph, start_ms * 1000 AS ts, dur_ms * 1000 AS dur FROM timeline
  UNION ALL SELECT -1, 'Candidate_Eval_0', 'X', min(start_ms) * 1000, (max(start_ms + dur_ms) - min(start_ms)) * 1000 FROM timeline WHERE candidate BETWEEN 10 AND 20)"""


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_seq, name, ph, ts, dur) in microseconds, with one row that spans candidates 10 to 20."""
    own = timeline(spark, sf_dir)
    name = F.lit("GPU_Stream_Dispatch")
    for a, b in (("hdf5_read", "POSIX_Lustre_Read"), ("gpu_buffer_wait", "IO_Wait_For_GPU"), ("compute", "Math_Operations")):
        name = F.when(F.col("name") == a, b).otherwise(name)
    rows = own.select("event_seq", name.alias("name"), F.lit("X").alias("ph"), (F.col("start_ms") * 1000).alias("ts"), (F.col("dur_ms") * 1000).alias("dur"))
    low, high = F.min("start_ms"), F.max(F.col("start_ms") + F.col("dur_ms"))
    span = own.where(F.col("candidate").between(10, 20)).select(F.lit(-1).cast("long"), F.lit("Candidate_Eval_0"), F.lit("X"), low * 1000, (high - low) * 1000)
    return rows.union(span)
