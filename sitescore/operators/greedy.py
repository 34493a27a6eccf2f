"""Greedy selection of sensors by the largest gain in log-determinant.

Each candidate keeps its part of the factor, y (one block for each sensor picked so far), and its
Schur complement. The state has two parts. The front, rewritten at each pick, has the Schur
complement, the score and the blocks of the last few picks; older blocks lie in chunks of CHUNK
picks that are written once and never again. A pick reads one row of the matrix's blocks by a
pushed-down filter, or makes it from the sensors' features where these are known, broadcasts the winner's part (k blocks), reads the chunks in one pass, and
checkpoints the new front alone: the plan of a pick doesn't depend on the picks before, and what
it reads and computes is linear in their number. A front is deleted when the next one is written.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import nan_to_zero
from ..functions.linalg import log_dets
from ..sources.pieces import numbered_lines
from .blocks import Generated, Matrix, asked, diagonal_blocks, featured_row, normalised, oriented, regularize
from .objective import best_candidate
from .running import running
from .state import cut, release, remove

SELECTION = "step int, sensor_id int, gain double, logdet double"
CHECKPOINT_EVERY = 10
#: Picks whose blocks make up one chunk.
CHUNK = 10


@dataclass
class State:
    """front(sensor_id, recent, schur, score): recent holds the blocks y since the last chunk, one after
    the other; chunks[n](sensor_id, y) those of picks n * CHUNK on. Blocks are doubles as bytes, row by row."""

    front: DataFrame
    n_recent: int = 0
    chunks: list[DataFrame] = field(default_factory=list)

    def scores(self) -> DataFrame:
        """(sensor_id, score) of the candidates that aren't picked."""
        return self.front.select("sensor_id", "score")


def packed(block: Column) -> Column:
    """A block of doubles as bytes."""

    @F.pandas_udf("binary")
    def run(blocks: pd.Series) -> pd.Series:
        return blocks.map(lambda x: np.asarray(x, np.float64).tobytes())

    return run(block)


def unpacked(values: pd.Series, nt: int) -> np.ndarray:
    """(rows, blocks, nt, nt) of a column of equally many packed blocks each."""
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1, nt, nt)


def initial_state(blocks: Matrix, r_sq: float, candidates: DataFrame | None = None, triangle: str = "upper") -> State:
    """The state before the first pick, hash-partitioned by candidate."""
    own = regularize(normalised(diagonal_blocks(blocks), triangle), r_sq).select(F.col("block_row").alias("sensor_id"), "block")
    if candidates is not None:
        own = own.join(candidates.select("sensor_id"), "sensor_id", "left_semi")

    @F.pandas_udf("double")
    def score(blocks: pd.Series) -> pd.Series:
        nt = int(len(blocks.iloc[0]) ** 0.5) if len(blocks) else 0
        return pd.Series(log_dets(np.stack(blocks.to_numpy()).reshape(-1, nt, nt)) if nt else [], dtype="float64")

    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = own.repartition(parts, "sensor_id")
    null = F.nanvl(score("block"), F.lit(None).cast("double"))
    return State(cut(own.select("sensor_id", F.lit(b"").alias("recent"), packed(F.col("block")).alias("schur"), null.alias("score"))))


def matrix_row(blocks: Matrix, sensor: int, triangle: str = "upper") -> DataFrame:
    """(sensor_id, k): the blocks K[sensor, c] for every c, read with a filter on the sensor."""
    c = F.lit(sensor)
    if isinstance(blocks, Generated) and blocks.features is not None:
        found = featured_row(blocks, sensor)
        return found if triangle == "stored" else found.withColumn("k", nan_to_zero(F.col("k")))
    if isinstance(blocks, Generated):
        other = F.col("sensor_id")
        row, col = (c, other) if triangle == "stored" else (F.least(c, other), F.greatest(c, other))
        blocks = asked(blocks, blocks.ids.select(row.alias("block_row"), col.alias("block_col")))
    k = normalised(blocks, triangle)
    if triangle == "stored":
        return k.where(F.col("block_row") == sensor).select(F.col("block_col").alias("sensor_id"), F.col("block").alias("k"))
    own = k.where((F.col("block_row") == sensor) | (F.col("block_col") == sensor))
    other = F.when(F.col("block_row") == sensor, F.col("block_col")).otherwise(F.col("block_row"))
    return own.select(other.alias("sensor_id"), oriented(F.col("block"), c, other).alias("k"))


def advance(state: State, blocks: Matrix, winner: int, r_sq: float, triangle: str = "upper") -> State:
    """The state after winner is picked: without it, with the others' blocks y and Schur complements."""
    sc, own, has_past = state.front.sparkSession.sparkContext, F.col("sensor_id") == winner, bool(state.chunks)
    old = [x.withColumn("chunk", F.lit(n)) for n, x in enumerate(state.chunks)]
    past = None
    for x in old:
        past = x if past is None else past.union(x)
    row = state.front.where(own).first()
    nt = int((len(row["schur"]) // 8) ** 0.5)
    before = {r["chunk"]: np.frombuffer(r["y"], np.float64).reshape(-1, nt, nt) for r in past.where(own).collect()} if past is not None else {}
    mine = np.frombuffer(row["recent"], np.float64).reshape(-1, nt, nt), np.linalg.cholesky(np.frombuffer(row["schur"], np.float64).reshape(nt, nt))
    shared = sc.broadcast((before, *mine))
    product = lambda a, b: np.einsum("kab,nkac->nbc", a, b, optimize=True)

    @F.pandas_udf("binary")
    def partial(chunk: pd.Series, y: pd.Series) -> pd.Series:
        """The winner's blocks of a chunk, transposed, times a candidate's, added up."""
        out = [b""] * len(y)
        for n in chunk.unique():
            at = np.flatnonzero(chunk == n)
            for i, x in zip(at, product(shared.value[0][n], unpacked(y.iloc[at], nt)), strict=True):
                out[i] = x.tobytes()
        return pd.Series(out)

    @F.pandas_udf("new binary, schur binary, score double")
    def step(recent: pd.Series, schur: pd.Series, k: pd.Series, parts: pd.Series) -> pd.DataFrame:
        if not len(k):
            return pd.DataFrame({"new": [], "schur": [], "score": []})
        _, yw, low = shared.value
        rest = r_sq * np.stack(k.to_numpy()).reshape(-1, nt, nt)
        if len(yw):
            rest -= product(yw, unpacked(recent, nt))
        if has_past:
            rest -= np.stack([np.frombuffer(b"".join(p), np.float64).reshape(-1, nt, nt).sum(0) for p in parts])
        # One factorisation for all candidates: their right-hand sides lie side by side.
        new = np.linalg.solve(low, np.moveaxis(rest, 0, 1).reshape(nt, -1)).reshape(nt, -1, nt).swapaxes(0, 1)
        left = unpacked(schur, nt)[:, 0] - new.swapaxes(1, 2) @ new
        return pd.DataFrame({"new": [x.tobytes() for x in new], "schur": [x.tobytes() for x in left], "score": log_dets(left)})

    joined = state.front.where(~own).select("sensor_id", "recent", "schur").join(matrix_row(blocks, winner, triangle), "sensor_id")
    if past is not None:
        sums = past.where(~own).select("sensor_id", partial("chunk", "y").alias("part")).groupBy("sensor_id").agg(F.collect_list("part").alias("parts"))
        joined = joined.join(sums, "sensor_id")
    else:
        joined = joined.withColumn("parts", F.array().cast("array<binary>"))
    joined = joined.withColumn("s", step("recent", "schur", "k", "parts"))
    score = F.nanvl("s.score", F.lit(None).cast("double")).alias("score")
    front = cut(joined.select("sensor_id", F.concat("recent", "s.new").alias("recent"), "s.schur", score))
    shared.unpersist()
    if state.n_recent + 1 < CHUNK:
        return State(front, state.n_recent + 1, state.chunks)
    chunk = cut(front.select("sensor_id", F.col("recent").alias("y")))
    own = State(cut(front.withColumn("recent", F.lit(b""))), 0, [*state.chunks, chunk])
    release(front)
    return own


def write_selection(selection: DataFrame, path: str) -> None:
    """Save a selection. It is written aside and then takes the former one's place, which stays until then."""
    spark = selection.sparkSession
    aside, old = f"{path}.new", f"{path}.old"
    selection.coalesce(1).write.mode("overwrite").parquet(aside)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at, new, was = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, aside, old))
    fs = at.getFileSystem(conf)
    if fs.exists(at):
        remove(spark, old)
        fs.rename(at, was)
    fs.rename(new, at)
    remove(spark, old)


def read_selection(spark: SparkSession, path: str) -> DataFrame:
    """The selection saved in path, in any number of rows: as Parquet, or as lines of a sensor and the log-determinant
    so far, separated by white space. The one before where a save was cut off, and an empty one if there is none
    that can be read."""
    for own in (path, f"{path}.old"):
        for read in (lambda p: spark.read.schema(SELECTION).parquet(p), lambda p: read_selection_lines(spark, p)):
            try:
                found = read(own)
                found.count()
                return found
            except (PySparkException, Py4JError):
                continue
    return spark.createDataFrame([], SELECTION)


def read_selection_lines(spark: SparkSession, path: str) -> DataFrame:
    """A selection of lines in pick order, each a sensor and the log-determinant so far; text after # is left out.
    The gains are the differences. A line that isn't two numbers is an error."""
    lines = numbered_lines(spark, path, comment="#").select("number", F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("x"))
    fine = F.when(F.size("x") >= 2, F.col("x")).otherwise(F.raise_error(F.lit("expected a sensor and a log-determinant")).cast("array<string>"))
    rows = cut(lines.select(F.col("number").cast("int").alias("step"), fine.alias("x")).select("step", F.col("x")[0].cast("double").cast("int").alias("sensor_id"), F.col("x")[1].cast("double").alias("logdet")))
    before = rows.select((F.col("step") + 1).alias("step"), F.col("logdet").alias("before"))
    return rows.join(before, "step", "left").select("step", "sensor_id", (F.col("logdet") - F.coalesce("before", F.lit(0.0))).alias("gain"), "logdet")


def selection_lines(selection: DataFrame) -> DataFrame:
    """(value) of selection(step, sensor_id, gain, logdet) as such lines, in pick order over its partitions."""
    return selection.orderBy("step").select(F.format_string("%d %.18e", "sensor_id", "logdet").alias("value"))


def cumulative_logdet(selection: DataFrame) -> DataFrame:
    """selection(step, sensor_id, gain) with the running sum of its gains."""
    return running(selection, ["step"], sums={"logdet": "gain"})


def greedy_select(blocks: Matrix, budget: int, r_sq: float, candidates: DataFrame | None = None, restart: str | None = None, checkpoint: str | None = None, triangle: str = "upper", on_pick: Callable[[int, int], None] | None = None) -> DataFrame:
    """(step, sensor_id, gain, logdet): up to budget picks, fewer if no candidate has a finite gain.

    restart names a saved selection: its picks are replayed without a search and the selection goes
    on from there. checkpoint names a path to which the selection is saved every CHECKPOINT_EVERY
    picks and at the end; on_pick is called with the number and the sensor of each pick. Equal gains
    go to the smallest sensor_id. blocks are best read from files (read_matrix), as each pick filters
    them, or the features that they are products of, by the winner.
    """
    spark = blocks.sparkSession
    prefix = [(r["sensor_id"], r["gain"]) for r in read_selection(spark, restart).orderBy("step").collect()] if restart else []
    state = initial_state(blocks, r_sq, candidates, triangle)
    picks: list[tuple[int, int, float, float]] = []
    while len(picks) < budget:
        k = len(picks)
        if k < len(prefix):
            winner = state.scores().where(F.col("sensor_id") == prefix[k][0]).first()
        else:
            winner = best_candidate(state.scores()).first()
        if winner is None or winner["score"] is None:
            break
        picks.append((k, winner["sensor_id"], winner["score"], winner["score"] + (picks[-1][3] if picks else 0.0)))
        if on_pick:
            on_pick(k, winner["sensor_id"])
        if checkpoint and len(picks) % CHECKPOINT_EVERY == 0:
            write_selection(spark.createDataFrame(picks, SELECTION), checkpoint)
        if len(picks) < budget:
            before, state = state, advance(state, blocks, winner["sensor_id"], r_sq, triangle)
            release(before.front)  # the next one is safe
    for x in (state.front, *state.chunks):
        release(x)
    out = spark.createDataFrame(picks, SELECTION)
    if checkpoint:
        write_selection(out, checkpoint)
    return out


def resume_state(blocks: Matrix, prefix: DataFrame, r_sq: float, triangle: str = "upper") -> State:
    """The state after the picks of prefix(step, sensor_id), one pass for each, without a search."""
    state = initial_state(blocks, r_sq, None, triangle)
    for r in prefix.orderBy("step").collect():
        before, state = state, advance(state, blocks, r["sensor_id"], r_sq, triangle)
        release(before.front)
    return state
