"""D-optimal scores of sensor configurations: logdet(I + r_sq K_S)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import block_size, transpose
from ..functions.linalg import cholesky, log_dets, nullable, rank_tolerance, signed_log_det, split_factor, stacked
from .blocks import Generated, Matrix, asked, cross_blocks, diagonal_blocks, normalised, oriented, regularize, sensors_of, side
from .state import cut, release

#: Configurations of more values than this a side are scored block by block instead of in one task.
DENSE_SIDE = 8_000
#: Larger ones are eliminated so many sensors at a time, and so many values a side at most.
PANEL, PANEL_SIDE = 16, 4_096
#: Positions of a configuration whose features are multiplied in one place.
FEATURED = 4_096
#: Selections of more values than this a side aren't factored on the driver.
PLAIN_SIDE = 2_000


def config_upper(blocks: Matrix, configs: DataFrame, r_sq: float, triangle: str = "upper") -> DataFrame:
    """(config_id, i, j, block) for the pairs of positions i <= j of each configuration, regularised.

    The distinct pairs of sensors that configurations use are found first, so each of their blocks
    leaves the matrix once, whatever the number of configurations.
    """
    a = configs.select("config_id", F.col("position").alias("i"), F.col("sensor_id").alias("s"))
    b = configs.select("config_id", F.col("position").alias("j"), F.col("sensor_id").alias("c"))
    pairs = a.join(b, "config_id").where("i <= j")
    row, col = (F.col("s"), F.col("c")) if triangle == "stored" else (F.least("s", "c"), F.greatest("s", "c"))
    pairs = pairs.withColumn("block_row", row).withColumn("block_col", col)
    used = pairs.select("block_row", "block_col").distinct()
    k = regularize(normalised(asked(blocks, used), triangle), r_sq)
    block = F.col("block") if triangle == "stored" else oriented(F.col("block"), F.col("s"), F.col("c"))
    return pairs.join(k, ["block_row", "block_col"]).select("config_id", "i", "j", block.alias("block"))


def config_submatrix(blocks: Matrix, configs: DataFrame, r_sq: float, triangle: str = "upper") -> DataFrame:
    """(config_id, i, j, block) for all ordered pairs of positions; below the diagonal those above it, transposed."""
    own = config_upper(blocks, configs, r_sq, triangle)
    other = F.struct(F.col("j").alias("i"), F.col("i").alias("j"), transpose(F.col("block"), block_size(F.col("block"))).alias("block"))
    both = F.array(F.struct("i", "j", "block"), F.when(F.col("i") < F.col("j"), other))
    return own.select("config_id", F.inline(F.filter(both, lambda x: x.isNotNull())))


def config_logdet(blocks: Matrix, configs: DataFrame, r_sq: float, triangle: str = "upper", dense_side: int = DENSE_SIDE, panel: int | None = None) -> DataFrame:
    """(config_id, logdet); -inf where the determinant isn't positive.

    Each configuration goes by its own size: one of more values a side than the matrix has features, where
    these are known, by featured_logdet(), which makes none of its blocks; else one of up to dense_side values is
    assembled in a task, and larger ones are eliminated panel by panel, all of them together. The value doesn't
    depend on the way: all track the determinant's sign, elimination puts off what a panel can't divide by, and a
    matrix that is singular but for rounding has -inf in both. Of diagonal blocks the lower triangle counts.
    """
    nt = side(blocks)
    sizes = cut(configs.groupBy("config_id").agg(F.count("*").alias("n")))
    if isinstance(blocks, Generated) and blocks.features is not None:
        wide = F.col("n") * nt > blocks.width
        part = lambda fits: configs.join(sizes.where(fits).select("config_id"), "config_id", "left_semi")
        featured = featured_logdet(blocks.features, part(wide), nt, r_sq)
        if sizes.where(~wide).isEmpty():
            return featured
        return featured.union(config_logdet(replace(blocks, features=None), part(~wide), r_sq, triangle, dense_side, panel))
    most = sizes.agg(F.max("n")).first()[0] or 0

    def dense(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["j"].max()) + 1
        m = np.zeros((n, nt, n, nt))
        for i, j, block in zip(pdf["i"], pdf["j"], pdf["block"], strict=True):
            own = np.reshape(block, (nt, nt))
            m[j, :, i] = own.T
            m[i, :, j] = own
        m = m.reshape(n * nt, n * nt)
        value, sign = signed_log_det(m, rank_tolerance(n * nt, np.abs(m).max()))
        return pd.DataFrame({"config_id": [pdf["config_id"].iloc[0]], "logdet": [value if sign > 0 else -np.inf]})

    of = lambda fits: configs.join(sizes.where(fits).select("config_id"), "config_id", "left_semi")
    small = F.col("n") * nt <= dense_side
    dense_ones = config_upper(blocks, of(small), r_sq, triangle).groupBy("config_id").applyInPandas(dense, "config_id int, logdet double")
    if most * nt <= dense_side:
        return dense_ones
    found = pivoted(config_upper(blocks, of(~small), r_sq, triangle), most, nt, definite=False, panel=panel)
    return dense_ones.union(found.select("config_id", F.when(F.col("sign") > 0, F.col("logdet")).otherwise(F.lit(float("-inf")))))


def featured_logdet(features: DataFrame, configs: DataFrame, nt: int, r_sq: float) -> DataFrame:
    """(config_id, logdet) of configurations of a matrix known by features(sensor_id, f).

    With the features of a configuration's sensors below each other, x, det(I + r_sq x x') is det(I + r_sq x' x), and
    x' x has as many values a side as there are features, whatever the configuration's size. It is added up over FEATURED
    positions in one place, and over these sums. Rows with a NaN count as zero, as their products with any row do.
    """

    def squared(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["f"].to_numpy()).reshape(len(pdf) * nt, -1)
        x[np.isnan(x).any(1)] = 0
        return pd.DataFrame({"config_id": [key[0]], "n": [len(x)], "square": [(x.T @ x).tobytes()]})

    def total(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m = r_sq * sum(np.frombuffer(b) for b in pdf["square"])
        n = round(len(m) ** 0.5)
        m = m.reshape(n, n) + np.eye(n)
        value, sign = signed_log_det(m, rank_tolerance(int(pdf["n"].sum()), np.abs(m).max())) if np.isfinite(m).all() else (0.0, 0)
        return pd.DataFrame({"config_id": [key[0]], "logdet": [value if sign > 0 else -np.inf]})

    own = configs.join(features, "sensor_id").select("config_id", F.floor(F.col("position") / FEATURED).alias("part"), "f")
    squares = own.groupBy("config_id", "part").applyInPandas(squared, "config_id int, n long, square binary")
    return squares.groupBy("config_id").applyInPandas(total, "config_id int, logdet double")


def pivoted(upper: DataFrame, n_pivots: int, nt: int, budget: int | None = None, definite: bool = True, panel: int | None = None) -> DataFrame:
    """Elimination of many configurations at once, a panel of positions at a time.

    upper(config_id, i, j, block) has the blocks with i <= j. With definite, a position is accepted if what
    is left of its diagonal block is positive definite, and left out else; after `budget` accepted ones
    no more are. Without, all are accepted, and directions that a panel can't divide by are put off to the
    next panel (as rows of position -1), so a singular block on the diagonal does no harm; in the last one they
    decide the sign or make it 0. Returns (config_id, n, accepted, logdet, sign, positions).

    A panel is factored in one task a configuration. The blocks after it are updated in square tiles of
    as many positions, each with the panel's columns of its rows and its columns, so a block is rewritten once a
    panel; three checkpoints a panel hold the factor, its columns and what is left, the ones before are removed.
    """
    panel = panel or max(1, min(PANEL, PANEL_SIDE // nt))
    state = cut(upper)
    largest = F.array_max(F.transform("block", F.abs))
    heads = cut(state.groupBy("config_id").agg((F.max("j") + 1).alias("n"), F.max(largest).alias("scale")))
    rows = "config_id int, i int, j int, block array<double>"
    done: DataFrame | None = None

    def factor(pdf: pd.DataFrame) -> pd.DataFrame:
        n, scale, room = (pdf[c].iloc[0] for c in ("n", "scale", "room"))
        cells = {(i, j): np.asarray(b) for i, j, b in zip(pdf["i"], pdf["j"], pdf["block"], strict=True)}
        put_off = round(len(cells.get((-1, -1), ())) ** 0.5)
        own = sorted({i for i, _ in cells} - {-1})
        sizes = {-1: put_off} | dict.fromkeys(own, nt)
        members = [-1, *own] if put_off else own
        block = lambda i, j: cells[i, j].reshape(sizes[i], sizes[j]) if (i, j) in cells else cells[j, i].reshape(sizes[j], sizes[i]).T
        m = np.block([[block(i, j) for j in members] for i in members]) if members else np.zeros((0, 0))
        if definite:
            kept, low = [], np.zeros((0, 0))
            for k, i in enumerate(members):
                if len(kept) == room:
                    break
                at = np.concatenate([np.arange(x * nt, (x + 1) * nt) for x in [*kept, k]])
                low2, fine = cholesky(m[np.ix_(at, at)][None])
                if fine[0]:
                    kept, low = [*kept, k], low2[0]
            members = [members[k] for k in kept]
            f, signs, off, left = np.linalg.inv(low) if len(low) else low, np.ones(len(low)), np.zeros((0, len(low))), np.zeros(0)
            value, sign = 2 * float(np.log(np.diag(low)).sum()), 1
        else:
            f, signs, off, left, value, sign = split_factor(m, scale, rank_tolerance(n * nt, scale), last=max(own, default=-1) + 1 >= n)
        side = [(-1, put_off)] * (-1 in members) + [(i, nt) for i in members if i != -1]
        pack = lambda x: np.ascontiguousarray(x, np.float64).tobytes()
        return pd.DataFrame({"config_id": [pdf["config_id"].iloc[0]], "f": [pack(f)], "off": [pack(off)], "signs": [signs], "left": [left], "members": [[i for i, _ in side]], "put_off": [put_off], "logdet": [value], "sign": [sign], "positions": [[i for i in members if i >= 0]]})

    def columns(key: tuple, pdf: pd.DataFrame, by: pd.DataFrame) -> pd.DataFrame:
        if not len(by) or not len(pdf):
            return pd.DataFrame({c: [] for c in ("config_id", "j", "w", "signs", "off")}, dtype=object)
        r = by.iloc[0]
        sizes = {-1: r["put_off"]}
        own = {(i, j): np.reshape(b, (sizes.get(i, nt), nt)) for i, j, b in zip(pdf["i"], pdf["j"], pdf["block"], strict=True)}
        places = sorted({j for _, j in own})
        side = sum(sizes.get(i, nt) for i in r["members"])
        f, off = (np.frombuffer(r[c]).reshape(-1, side) for c in ("f", "off"))
        right = np.block([[own[i, j] for j in places] for i in r["members"]]) if len(r["members"]) else np.zeros((0, nt * len(places)))
        w, rest = f @ right, off @ right
        part = lambda x, k: np.ascontiguousarray(x[:, k * nt : (k + 1) * nt]).ravel()
        return pd.DataFrame({"config_id": [key[0]] * len(places), "j": places, "w": [part(w, k) for k in range(len(places))], "signs": [r["signs"]] * len(places), "off": [part(rest, k) for k in range(len(places))]})

    def update(key: tuple, pdf: pd.DataFrame, by: pd.DataFrame) -> pd.DataFrame:
        w = {j: np.reshape(x, (-1, nt)) for j, x in zip(by["j"], by["w"], strict=True)}
        signs = np.asarray(by["signs"].iloc[0])[:, None] if len(by) else np.zeros((0, 1))
        blocks = [np.asarray(b) - (w[i].T @ (signs * w[j])).ravel() if i in w and j in w else b for i, j, b in zip(pdf["i"], pdf["j"], pdf["block"], strict=True)]
        return pdf[["config_id", "i", "j"]].assign(block=pd.Series(blocks, pdf.index, dtype=object))

    tile = lambda c: F.floor(F.col(c) / panel).cast("int")
    for lo in range(0, n_pivots, panel):
        hi = lo + panel
        own = heads if done is None else heads.join(done.groupBy("config_id").agg(F.sum(F.size("positions")).alias("before")), "config_id", "left")
        room = F.lit(n_pivots) if budget is None else F.lit(budget) - (F.lit(0) if done is None else F.coalesce("before", F.lit(0)))
        own = own.withColumn("room", room.cast("int")).where("room > 0")
        found = cut(state.where(F.col("j") < hi).join(own, "config_id").groupBy("config_id").applyInPandas(factor, "config_id int, f binary, off binary, signs array<double>, left array<double>, members array<int>, put_off int, logdet double, sign int, positions array<int>"))
        result = found.select("config_id", "logdet", "sign", "positions")
        done = result if done is None else done.union(result)
        if hi >= n_pivots:
            break
        later = F.explode(F.sequence(F.lit(hi // panel), F.lit((n_pivots - 1) // panel))).alias("tj")
        by = found.select("config_id", later, "f", "off", "signs", "members", "put_off").groupBy("config_id", "tj")
        rest = state.where((F.col("i") < hi) & (F.col("j") >= hi)).withColumn("tj", tile("j"))
        w = cut(rest.groupBy("config_id", "tj").cogroup(by).applyInPandas(columns, "config_id int, j int, w array<double>, signs array<double>, off array<double>"))
        last = F.lit((n_pivots - 1) // panel)
        pairs = F.array_union(F.transform(F.sequence(F.lit(hi // panel), tile("j")), lambda t: F.struct(t.alias("ti"), tile("j").alias("tj"))), F.transform(F.sequence(tile("j"), last), lambda t: F.struct(tile("j").alias("ti"), t.alias("tj"))))
        spread = w.select("config_id", "j", "w", "signs", F.inline(pairs)).groupBy("config_id", "ti", "tj")
        kept = state.where(F.col("i") >= hi).withColumn("ti", tile("i")).withColumn("tj", tile("j"))
        new = kept.groupBy("config_id", "ti", "tj").cogroup(spread).applyInPandas(update, rows)
        if not definite:
            late = w.where(F.size("off") > 0).select("config_id", F.lit(-1).alias("i"), "j", F.col("off").alias("block"))
            size = F.size("left")
            diagonal = F.transform(F.sequence(F.lit(0), size * size - 1), lambda k: F.when(k % (size + 1) == 0, F.get("left", F.floor(k / (size + 1)).cast("int"))).otherwise(0.0))
            new = new.union(late).union(found.where(size > 0).select("config_id", F.lit(-1).alias("i"), F.lit(-1).alias("j"), diagonal.alias("block")))
        before, state = state, cut(new)
        for x in (before, w):
            release(x)
    signs = F.when(F.min(F.abs("sign")) == 0, 0).otherwise(1 - 2 * (F.count_if(F.col("sign") < 0) % 2)).cast("int")
    total = done.groupBy("config_id").agg(F.sum("logdet").alias("logdet"), signs.alias("sign"), F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))
    return heads.select("config_id", "n").join(total, "config_id").select("config_id", "n", F.size("positions").alias("accepted"), "logdet", "sign", "positions")


def block_scores(block: Column) -> Column:
    """logdet of each block, null where it isn't positive definite."""

    @F.pandas_udf("double")
    def run(blocks: pd.Series) -> pd.Series:
        if not len(blocks):
            return pd.Series([], dtype="float64")
        m = np.stack(blocks.to_numpy())
        nt = int(m.shape[1] ** 0.5)
        return pd.Series(log_dets(m.reshape(-1, nt, nt)))

    return F.nanvl(run(block), F.lit(None).cast("double"))


def singleton_scores(blocks: Matrix, r_sq: float, triangle: str = "upper") -> DataFrame:
    """(sensor_id, score): the gain of each sensor on its own; null if its block isn't positive definite."""
    own = regularize(normalised(diagonal_blocks(blocks), triangle), r_sq)
    return own.select(F.col("block_row").alias("sensor_id"), block_scores(F.col("block")).alias("score"))


def schur_gains(blocks: Matrix, selected: DataFrame, r_sq: float, triangle: str = "upper", plain_side: int = PLAIN_SIDE) -> DataFrame:
    """(sensor_id, score): for each sensor not in selected(position, sensor_id) the log-determinant of its
    Schur complement; null where that isn't positive definite.

    The plain form, which solves with the whole factor of the selected ones: it comes to the driver,
    PLAIN_SIDE values a side at most, and is broadcast. A larger selection is replayed pick by pick on
    the candidates' states instead.
    """
    spark = blocks.sparkSession
    order = selected.orderBy("position").collect()
    if not order:
        return singleton_scores(blocks, r_sq, triangle)
    k, nt = len(order), side(blocks)
    if k * nt > plain_side:
        from .greedy import resume_state  # which is built on this module

        return resume_state(blocks, selected.select(F.col("position").alias("step"), "sensor_id"), r_sq, triangle).scores()
    first = selected.select(F.lit(0).alias("config_id"), "position", "sensor_id")
    sub = config_submatrix(blocks, first, r_sq, triangle).collect()
    m = np.zeros((k, nt, k, nt))
    for r in sub:
        m[r["i"], :, r["j"]] = np.reshape(r["block"], (nt, nt))
    low = spark.sparkContext.broadcast(np.linalg.cholesky(m.reshape(k * nt, k * nt)))
    candidates = sensors_of(blocks).join(F.broadcast(selected.select("sensor_id")), "sensor_id", "left_anti")
    column = cross_blocks(blocks, first.select("position", "sensor_id"), candidates, triangle).groupBy("candidate").agg(F.array_sort(F.collect_list(F.struct("position", "block"))).alias("column"))
    own = regularize(normalised(diagonal_blocks(blocks), triangle), r_sq).select(F.col("block_row").alias("candidate"), F.col("block").alias("own"))
    joined = column.join(own, "candidate").select("candidate", F.flatten(F.transform("column", lambda x: x["block"])).alias("column"), "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                # One factorisation a batch: the candidates' right-hand sides lie side by side.
                sides = np.moveaxis(r_sq * stacked(batch.column(1), k * nt, nt), 0, 1).reshape(k * nt, -1)
                y = np.linalg.solve(low.value, sides).reshape(k * nt, -1, nt).swapaxes(0, 1)
                schur = stacked(batch.column(2), nt, nt) - np.swapaxes(y, 1, 2) @ y
                yield pa.RecordBatch.from_arrays([batch.column(0), nullable(log_dets(schur))], ["sensor_id", "score"])

    return joined.mapInArrow(run, "sensor_id int, score double")


def naive_gains(blocks: Matrix, selected: DataFrame, r_sq: float, triangle: str = "upper") -> DataFrame:
    """The same gains from the whole augmented matrices: logdet of S and c, minus logdet of S."""
    candidates = sensors_of(blocks).select(F.col("sensor_id").alias("c")).join(F.broadcast(selected.select(F.col("sensor_id").alias("c"))), "c", "left_anti")
    n = selected.count()
    own = selected.select("position", "sensor_id")
    each = candidates.crossJoin(F.broadcast(own)).select(F.col("c").alias("config_id"), "position", "sensor_id")
    with_c = each.union(candidates.select("c", F.lit(n), "c"))
    base = config_logdet(blocks, own.select(F.lit(-1).alias("config_id"), "position", "sensor_id"), r_sq, triangle).first()
    base = base["logdet"] if base else 0.0
    found = config_logdet(blocks, with_c, r_sq, triangle)
    return found.select(F.col("config_id").alias("sensor_id"), F.when(F.col("logdet") > float("-inf"), F.col("logdet") - base).alias("score"))


def failed_candidates(scores: DataFrame) -> DataFrame:
    """One row (n_failed): the candidates whose Schur complement isn't positive definite."""
    return scores.agg(F.count_if(F.col("score").isNull()).alias("n_failed"))


def best_candidate(scores: DataFrame) -> DataFrame:
    """The one row (sensor_id, score) with the largest finite score, the smallest id of equals; none if there is none."""
    finite = scores.where(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf")))
    return finite.orderBy(F.desc("score"), "sensor_id").limit(1)
