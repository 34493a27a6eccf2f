import math
import random

import numpy as np
import pytest

from sitescore.functions import linalg
from sitescore.jobs import matrix
from sitescore.operators import baseline, blocks, greedy, objective
from sitescore.operators.state import cut
from sitescore.sources import fixtures, records
from sitescore.streaming.merge import merge_rank_files_stream

R = 4.0
#: Picks and log-determinant on the smallest tables, by block size.
EXPECTED = {1: ([40, 49, 24, 41, 28], 7.447413182), 2: ([49, 40, 41, 28, 3], 14.733867973), 4: ([49, 40, 28, 36, 16], 28.539308961)}
N = 60


def matrix_of(spark, sf, nt, variant="", n=N):
    """The blocks of the first n sensors of the fixture."""
    return cut(fixtures.k_blocks(spark, sf, nt, variant).where(f"block_row < {n} and block_col < {n}"))


@pytest.fixture(scope="module")
def everyone(spark, sf):
    return fixtures.sensors(spark, sf).where(f"sensor_id < {N}")


@pytest.fixture(scope="module")
def k4(spark, sf):
    return matrix_of(spark, sf, 4)


@pytest.fixture(scope="module")
def dense(k4):
    return assemble(k4)


def assemble(df):
    rows = df.collect()
    n, nt = max(r["block_row"] for r in rows) + 1, int(len(rows[0]["block"]) ** 0.5)
    m = np.zeros((n, nt, n, nt))
    for r in rows:
        m[r["block_row"], :, r["block_col"]] = np.reshape(r["block"], (nt, nt))
    return m


def logdet(m, ids):
    nt = m.shape[1]
    own = m[ids][:, :, ids].reshape(len(ids) * nt, len(ids) * nt)
    sign, value = np.linalg.slogdet(np.eye(len(own)) + R * own)
    return value if sign > 0 else -np.inf


def configs(spark, lists):
    return spark.createDataFrame([(c, i, s) for c, ids in enumerate(lists) for i, s in enumerate(ids)], "config_id int, position int, sensor_id int")


@pytest.mark.parametrize("nt", EXPECTED)
def test_greedy_picks(spark, sf, nt):
    found = greedy.greedy_select(matrix_of(spark, sf, nt), 5, R).orderBy("step").collect()
    assert [r["sensor_id"] for r in found] == EXPECTED[nt][0]
    assert found[-1]["logdet"] == pytest.approx(EXPECTED[nt][1], abs=1e-8)


def test_gains_add_up_and_never_rise(spark, k4, dense):
    found = greedy.greedy_select(k4, 4, R).orderBy("step").collect()
    ids = [r["sensor_id"] for r in found]
    assert sum(r["gain"] for r in found) == pytest.approx(logdet(dense, ids))
    before = None
    for n in range(3):
        scores = {r["sensor_id"]: r["score"] for r in objective.schur_gains(k4, configs(spark, [ids[:n]]), R).collect()}
        for c in (0, 7, 33):
            assert scores[c] == pytest.approx(logdet(dense, [*ids[:n], c]) - (logdet(dense, ids[:n]) if n else 0))
        assert before is None or all(scores[c] <= before[c] + 1e-9 for c in scores)
        assert scores == pytest.approx({r["sensor_id"]: r["score"] for r in objective.schur_gains(k4, configs(spark, [ids[:n]]), R, plain_side=0).collect()})
        before = scores


@pytest.mark.parametrize("dense_side", [8_000, 0])
def test_config_scores(spark, k4, dense, dense_side):
    rng = random.Random(1)
    lists = [rng.sample(range(60), n) for n in (1, 2, 3, 5)]
    lists.append(lists[-1][::-1])
    got = {r["config_id"]: r["logdet"] for r in objective.config_logdet(k4, configs(spark, lists), R, dense_side=dense_side).collect()}
    for c, ids in enumerate(lists):
        assert got[c] == pytest.approx(logdet(dense, ids))


def test_non_definite_blocks(spark, sf):
    k = matrix_of(spark, sf, 2, "bad")
    bad = {s for s in range(60) if s % 13 == 5}
    assert {r["sensor_id"] for r in baseline.prescreen(k).where("not kept").collect()} == bad
    scores = objective.singleton_scores(k, R)
    assert {r["sensor_id"] for r in scores.where("score is null").collect()} == bad
    assert objective.failed_candidates(scores).first()[0] == len(bad)
    picked = [r["sensor_id"] for r in greedy.greedy_select(k, 4, R).collect()]
    assert len(picked) == 4 and not bad & {*picked}
    # Two values a sensor make the determinant positive, one value doesn't; by either way, mixed sizes too.
    for nt in (1, 2):
        own = matrix_of(spark, sf, nt, "bad")
        m, lists = assemble(own), [[5, 1], [1, 2], [5, 18, 1], [1, 2, 3, 5]]
        for side in (8_000, 2 * nt, 0):
            got = objective.config_logdet(own, configs(spark, lists), R, dense_side=side).orderBy("config_id").collect()
            assert [r["logdet"] for r in got] == pytest.approx([logdet(m, ids) for ids in lists])
        assert (got[0]["logdet"] == -math.inf) == (nt == 1)


def indefinite():
    """Symmetric matrices with singular and negative blocks on the diagonal, regular ones and singular ones."""
    rng = np.random.default_rng(3)
    swap = np.array([[0.0, 1, 0, 0], [1, 0, 0, 0], [0, 0, -1, 0], [0, 0, 0, 1]])
    a = rng.normal(size=(12, 12))
    hollow = a + a.T
    for i in range(0, 12, 2):
        hollow[i : i + 2, i : i + 2] = 0
    low = rng.normal(size=(12, 5))
    tiny = np.diag(np.full(12, 1e-9)) + np.fliplr(np.eye(12))
    return {"swap": swap, "hollow": hollow, "even": -hollow, "singular": low @ low.T, "tiny": tiny, "zero": np.zeros((4, 4)), "definite": a @ a.T + np.eye(12), "negative": np.diag([1.0, -1, -1, 1, 1, -1, 1, -1.0]) + 0.01}


@pytest.mark.parametrize("nt", [1, 2])
@pytest.mark.parametrize(("side", "panel"), [(8_000, None), (0, 4), (0, None)])
def test_one_result_by_either_way(spark, side, panel, nt):
    """All of these matrices side by side in one, a configuration each."""
    rows, lists, want, begin = [], [], [], 0
    for name, m in indefinite().items():
        n, k = len(m) // nt, m - np.eye(len(m))
        rows += [(begin + i, begin + j, k[i * nt : (i + 1) * nt, j * nt : (j + 1) * nt].ravel().tolist()) for i in range(n) for j in range(i, n)]
        lists.append([*range(begin, begin + n)])
        sign, value = np.linalg.slogdet(m)
        want.append(value if sign > 0 and name not in ("singular", "zero") else -math.inf)
        begin += n
    found = objective.config_logdet(spark.createDataFrame(rows, blocks.SCHEMA), configs(spark, lists), 1.0, dense_side=side, panel=panel)
    assert [r["logdet"] for r in found.orderBy("config_id").collect()] == pytest.approx(want, abs=1e-8)


def test_panels_make_few_checkpoints(spark, k4, dense, monkeypatch):
    made, real = [], objective.cut
    monkeypatch.setattr(objective, "cut", lambda df: made.append(real(df)) or made[-1])
    ids = random.Random(2).sample(range(60), 40)
    got = objective.config_logdet(k4, configs(spark, [ids, ids[:7]]), R, dense_side=0).orderBy("config_id").collect()
    assert [r["logdet"] for r in got] == pytest.approx([logdet(dense, ids), logdet(dense, ids[:7])])
    assert len(made) <= 10


def test_only_asked_blocks_are_made(spark, sf, k4, dense):
    k, asked = fixtures.k_matrix(spark, sf, 4), []
    counted = blocks.Generated(k.ids.where("sensor_id < 60"), lambda pairs: asked.append(pairs.count()) or k.of(pairs), 4)
    assert objective.singleton_scores(counted, R).count() == baseline.prescreen(counted).count() == 60
    assert asked == [60, 60]
    asked.clear()
    ids = [17, 3, 40]
    got = {r["sensor_id"]: r["score"] for r in objective.schur_gains(counted, configs(spark, [ids]), R).collect()}
    assert sum(asked) <= 4 * 60 + 6
    assert got == pytest.approx({r["sensor_id"]: r["score"] for r in objective.schur_gains(k4, configs(spark, [ids]), R).collect()})
    found = greedy.greedy_select(counted, 3, R).orderBy("step").collect()
    assert [r["sensor_id"] for r in found] == [r["sensor_id"] for r in greedy.greedy_select(k4, 3, R).orderBy("step").collect()]


def test_budgets_and_no_valid_candidate(spark, sf, k4):
    assert greedy.greedy_select(k4, 0, R).count() == 0
    few = fixtures.sensors(spark, sf).where("sensor_id < 3")
    assert sorted(r["sensor_id"] for r in greedy.greedy_select(k4, 10, R, few).collect()) == [0, 1, 2]
    none = spark.createDataFrame([(0, 0, [-10.0])], blocks.SCHEMA)
    assert greedy.greedy_select(none, 2, 1.0).count() == 0
    assert objective.best_candidate(spark.createDataFrame([(1, None), (2, math.nan), (3, math.inf)], "sensor_id int, score double")).count() == 0
    tie = spark.createDataFrame([(4, 2.0), (2, 2.0), (3, 1.0)], "sensor_id int, score double")
    assert objective.best_candidate(tie).first()["sensor_id"] == 2


def test_resume_is_the_straight_run(spark, k4, tmp_path):
    path = str(tmp_path / "s")
    straight = greedy.greedy_select(k4, 4, R).orderBy("step").collect()
    greedy.greedy_select(k4, 1, R, checkpoint=path)
    assert greedy.read_selection(spark, path).count() == 1
    resumed = greedy.greedy_select(k4, 4, R, restart=path).orderBy("step").collect()
    assert [r["sensor_id"] for r in resumed] == [r["sensor_id"] for r in straight]
    assert [r["logdet"] for r in resumed] == pytest.approx([r["logdet"] for r in straight])
    text = tmp_path / "s.txt"
    text.write_text("".join(f"{r['sensor_id']} {r['logdet']:.18e}\n" for r in straight[:2]))
    resumed = greedy.greedy_select(k4, 4, R, restart=str(text)).orderBy("step").collect()
    assert [(r["sensor_id"], pytest.approx(r["logdet"])) for r in resumed] == [(r["sensor_id"], r["logdet"]) for r in straight]
    state = greedy.resume_state(k4, greedy.read_selection(spark, path), R)
    assert state.scores().count() == 59
    assert greedy.read_selection(spark, str(tmp_path / "nothing")).count() == 0
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_text("no parquet")
    assert greedy.read_selection(spark, str(tmp_path / "broken")).count() == 0


def test_a_long_selection(spark, sf, tmp_path):
    """25 picks, over two chunks and two saves, against dense algebra; the plan of a pick doesn't grow."""
    k = matrix_of(spark, sf, 2)
    path = str(tmp_path / "blocks")
    blocks.write_blocks(k.where("block_row <= block_col"), path)
    own, m = blocks.read_blocks(spark, path), assemble(k)
    saved = str(tmp_path / "saved")
    found = greedy.greedy_select(own, 25, R, checkpoint=saved).orderBy("step").collect()
    ids: list[int] = []
    for r in found:
        gains = {c: logdet(m, [*ids, c]) for c in range(N) if c not in ids}
        assert gains[r["sensor_id"]] == pytest.approx(max(gains.values()), abs=1e-9)
        ids.append(r["sensor_id"])
        assert r["logdet"] == pytest.approx(gains[r["sensor_id"]])
    assert greedy.read_selection(spark, saved).orderBy("step").collect() == found
    state = greedy.resume_state(own, greedy.read_selection(spark, saved).where("step < 22"), R)
    assert len(state.chunks) == 2 and state.n_recent == 2
    assert {r["sensor_id"]: r["score"] for r in state.scores().collect()} == pytest.approx({c: logdet(m, [*ids[:22], c]) - logdet(m, ids[:22]) for c in range(N) if c not in ids[:22]})
    assert len(state.front._jdf.queryExecution().logical().toString().splitlines()) < 5


def test_a_row_is_read_by_its_sensor(spark, sf, tmp_path):
    path = str(tmp_path / "blocks")
    blocks.write_blocks(fixtures.k_blocks(spark, sf, 1), path)
    plan = greedy.matrix_row(blocks.read_blocks(spark, path), 7)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(block_row,7)" in plan.split("PushedFilters")[1]


def test_stored_and_upper_triangles(spark, sf, everyone):
    k = matrix_of(spark, sf, 2, "lopsided")
    m = assemble(k)
    own = configs(spark, [[9, 4]]).select("position", "sensor_id")
    for triangle in ("upper", "stored"):
        for r in blocks.cross_blocks(k, own, everyone, triangle).collect():
            s, c = r["sensor_id"], r["candidate"]
            want = m[s, :, c] if triangle == "stored" else (m[s, :, c] if s <= c else m[c, :, s].T)
            assert np.allclose(np.reshape(r["block"], (2, 2)), want)


def walk(m, order, budget):
    """A random configuration by the plain definition."""
    ids, total = [], 0.0
    for c in order:
        now = logdet(m, [*ids, c])
        a = np.eye((len(ids) + 1) * m.shape[1]) + R * m[[*ids, c]][:, :, [*ids, c]].reshape((len(ids) + 1) * m.shape[1], -1)
        if np.linalg.eigvalsh((a + a.T) / 2).min() > 0:
            ids, total = [*ids, c], now
        if len(ids) == budget:
            break
    return ids, total


@pytest.mark.parametrize("dense_side", [8_000, 0])
def test_random_configs(spark, sf, everyone, dense_side):
    k = matrix_of(spark, sf, 1, "reject")
    m = assemble(k)
    budget = 10 if dense_side else 3
    orders: dict = {}
    for r in baseline.random_orders(everyone, spark.range(5).selectExpr("cast(id as int) sample_id"), 42).orderBy("sample_id", "position").collect():
        orders.setdefault(r["sample_id"], []).append(r["sensor_id"])
    found = baseline.random_configs(k, everyone, 5, budget, R, 42, slack=2, dense_side=dense_side).collect()
    assert sorted(r["sample_id"] for r in found) == list(range(5))
    for r in found:
        ids, total = walk(m, orders[r["sample_id"]], budget)
        assert (r["sensors"], r["retries"]) == (ids, 0) and r["logdet"] == pytest.approx(total)


def test_cornered_samples_are_retried(spark, sf, everyone):
    k = matrix_of(spark, sf, 1, "corner")
    found = baseline.random_configs(k, everyone, 5, 10, 1.0, 42).collect()
    assert len(found) == 5 and any(r["retries"] for r in found)
    assert all(len(set(r["sensors"])) == 10 and r["logdet"] is not None for r in found)
    with pytest.raises(ValueError):
        baseline.random_configs(k, everyone, 1, 61, 1.0, 42)


def test_baseline_run_goes_on(spark, sf, tmp_path):
    k, path = matrix_of(spark, sf, 2, "bad"), str(tmp_path / "samples")
    first = baseline.baseline_run(k, path, 2, 4, R, 42, "3").first()
    assert (first["n_samples"], first["n_screened"]) == (2, 5)
    assert baseline.baseline_run(k, path, 5, 4, R, 42, "3").first()["n_samples"] == 5
    assert baseline.baseline_run(k, path, 4, 4, R, 42, "3").first()["n_samples"] == 5
    assert records.read_samples(spark, path).select("sample_id").distinct().count() == 5


@pytest.mark.parametrize("n_lon,n_lat,budget", [(12, 50, 175), (12, 5, 17), (3, 3, 9), (2, 40, 1), (40, 2, 3), (12, 5, 0 + 1)])
def test_uniform_config_has_its_budget(spark, n_lon, n_lat, budget):
    ids = [r[0] for r in baseline.uniform_config(spark, n_lon, n_lat, budget, 42).collect()]
    assert len(ids) == len({*ids}) == budget and all(0 <= i < n_lon * n_lat for i in ids)
    if (n_lon, n_lat, budget) == (12, 50, 175):
        b = baseline.base_grid(*map(baseline.F.lit, (175, 12, 50)))
        assert spark.range(1).select(*b).first()[:] == (6, 29)
    with pytest.raises(ValueError):
        baseline.uniform_config(spark, 2, 2, 5, 1)


def test_synthetic_blocks_ignore_partitioning(spark):
    five = spark.range(5).selectExpr("cast(id as int) sensor_id")
    a = blocks.synthetic_blocks(five, 3, "single", 7)
    b = blocks.synthetic_blocks(five.repartition(3), 3, "single", 7).repartition(3)
    one, two = ({(r[0], r[1]): tuple(r[2]) for r in x.collect()} for x in (a, b))
    assert one == two and len(one) == 25
    other = blocks.synthetic_blocks(five, 3, "single", 8).collect()
    assert not {x for r in other for x in r["block"]} & {x for v in one.values() for x in v}


def test_synthetic_values_are_standard_normal_and_independent():
    i, j = (x.ravel() for x in np.meshgrid(np.arange(300), np.arange(300), indexing="ij"))
    values = linalg.normal_blocks(i, j, 2, 3)
    flat = values.ravel()
    n = len(flat)
    assert len(np.unique(flat)) > 0.999 * n
    assert abs(flat.mean()) < 5 / n**0.5 and abs(flat.var() - 1) < 5 * (2 / n) ** 0.5
    assert abs((flat**4).mean() - 3) < 5 * (96 / n) ** 0.5 and (np.abs(flat) > 4).any()
    # Neighbours within a block, along a row and along a column of the matrix don't hang together.
    matrix = values.reshape(300, 300, 4)
    for x, y in ((matrix[..., :-1], matrix[..., 1:]), (matrix[:, :-1], matrix[:, 1:]), (matrix[:-1], matrix[1:]), (matrix, matrix.transpose(1, 0, 2))):
        apart = x is not matrix
        own = (x * y)[~np.eye(300, dtype=bool)] if not apart else x * y
        assert abs(own.mean()) < 5 / (own.size / (1 if apart else 2)) ** 0.5
    assert blocks.matrix_bytes(600, 420, "double") == 252_000**2 * 8


def test_merge_twice_is_merge_once(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "samples.rank0.txt").write_text("1.5\n2.5 9\n\n")
    assert sorted(r[0] for r in merge_rank_files_stream(spark, source, out, state).collect()) == [1.5, 2.5]
    (tmp_path / "in" / "samples.rank1.txt").write_text("3 4.5 6\n")
    for _ in range(2):
        assert sorted(r[0] for r in merge_rank_files_stream(spark, source, out, state).collect()) == [1.5, 2.5, 4.5]


def test_lines_appended_to_a_known_file_are_merged(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    rank = [tmp_path / "in" / f"samples.rank{i}.txt" for i in range(2)]
    want = []
    for part in range(3):
        for i, path in enumerate(rank):
            with path.open("a") as f:
                f.write("".join(f"{100 * part + 10 * i + n}\n" for n in range(5)))
            want += [100.0 * part + 10 * i + n for n in range(5)]
        for _ in range(2):
            assert sorted(r[0] for r in merge_rank_files_stream(spark, source, out, state).collect()) == sorted(want)
    with rank[0].open("a") as f:
        f.write("7")  # a line that isn't finished
    assert merge_rank_files_stream(spark, source, out, state).count() == len(want)
    with rank[0].open("a") as f:
        f.write("77\n")
    assert sorted(r[0] for r in merge_rank_files_stream(spark, source, out, state).collect()) == sorted([*want, 777.0])


def test_batched_cholesky_falls_back():
    good, bad = np.array([[2.0, 1], [1, 2]]), np.array([[1.0, 2], [2, 1]])
    got = linalg.log_dets(np.stack([good, bad, good, np.full((2, 2), np.nan)]))
    assert got[0] == got[2] == pytest.approx(math.log(3)) and np.isnan(got[[1, 3]]).all()


def test_uniform_score(spark, k4, dense):
    ids = sorted(r[0] for r in baseline.uniform_config(spark, 12, 5, 17, 42).collect())
    assert baseline.uniform_score(k4, 12, 5, 17, R, 42).first()[0] == pytest.approx(logdet(dense, ids))


def test_split_samples_cover_what_is_missing(spark, sf):
    assert sum(r["n_samples"] for r in matrix.p7_split_samples(spark, sf).collect()) == 123_457 - 1000


@pytest.mark.parametrize("nt", [1, 2])
def test_large_configurations_by_features(spark, sf, nt, monkeypatch):
    """A configuration of more values than features has the same value as by its blocks, and none of these is made."""
    monkeypatch.setattr(objective, "FEATURED", 16)
    k, m = fixtures.k_matrix(spark, sf, nt), assemble(matrix_of(spark, sf, nt))
    rng = random.Random(4)
    lists = [rng.sample(range(N), n) for n in (50, 57, 60)]

    def made(pairs):
        raise AssertionError("no block is needed")

    bare = blocks.Generated(k.ids, made, nt, k.features, k.width)
    got = objective.config_logdet(bare, configs(spark, lists), R).orderBy("config_id").collect()
    assert [r["logdet"] for r in got] == pytest.approx([logdet(m, ids) for ids in lists], abs=1e-9)
    # Beside small ones, each by its own way.
    mixed = [lists[0], [3, 9]]
    got = objective.config_logdet(k, configs(spark, mixed), R, dense_side=0).orderBy("config_id").collect()
    assert [r["logdet"] for r in got] == pytest.approx([logdet(m, ids) for ids in mixed], abs=1e-9)


def test_features_with_nan_are_read_as_their_blocks(spark):
    rng = np.random.default_rng(8)
    f = rng.normal(size=(9, 4))
    f[2, 1] = np.nan
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(f)], "sensor_id int, f array<double>")
    k = spark.createDataFrame([(i, j, [float(f[i] @ f[j])]) for i in range(9) for j in range(9)], blocks.SCHEMA)
    known = blocks.Generated(rows.select("sensor_id"), lambda pairs: blocks.asked(k, pairs), 1, rows, 4)
    both = [objective.config_logdet(x, configs(spark, [[*range(9)]]), R).first()["logdet"] for x in (k, known)]
    assert both[0] == pytest.approx(both[1])


def test_selection_by_features_makes_no_block_off_the_diagonal(spark, sf, k4, dense):
    """A known product is kept in files by its features, a row for each sensor, and gives the picks of its blocks."""
    k = fixtures.k_matrix(spark, sf, 4)
    asked = []
    few = blocks.Generated(k.ids.where(f"sensor_id < {N}"), lambda pairs: asked.append(pairs.where("block_row <> block_col").count()) or k.of(pairs), 4, k.features.where(f"sensor_id < {N}"), k.width)
    found = greedy.greedy_select(few, 5, R).orderBy("step").collect()
    assert [r["sensor_id"] for r in found] == EXPECTED[4][0] and found[-1]["logdet"] == pytest.approx(EXPECTED[4][1], abs=1e-8)
    assert asked == [0]
    for c in (0, 31):
        for triangle in ("upper", "stored"):
            got = {r["sensor_id"]: r["k"] for r in greedy.matrix_row(few, c, triangle).collect()}
            assert len(got) == N and all(np.allclose(np.reshape(x, (4, 4)), dense[c, :, i]) for i, x in got.items())


def test_matrix_files(spark, sf, k4, tmp_path):
    known, plain = fixtures.k_matrix(spark, sf, 2), fixtures.k_matrix(spark, sf, 2, "bad")
    n = known.ids.count()
    for name, k, rows in (("known", known, n), ("plain", blocks.Generated(plain.ids.where("sensor_id < 9"), plain.of, 2), 81), ("table", k4, N * N)):
        blocks.write_matrix(k, str(tmp_path / name))
        assert spark.read.parquet(str(tmp_path / name)).count() == rows
    got = blocks.read_matrix(spark, str(tmp_path / "known"))
    assert (got.nt, got.width, got.ids.count()) == (2, fixtures.WINDOW, n)
    pairs = spark.createDataFrame([(5, 3), (3, 5), (7, 7)], "block_row int, block_col int")
    by = lambda k: {(r[0], r[1]): r[2] for r in blocks.asked(k, pairs).collect()}
    own, want = by(got), by(known)
    assert own.keys() == want.keys() and all(own[x] == pytest.approx(want[x]) for x in want)
    assert blocks.read_matrix(spark, str(tmp_path / "plain")).count() == 81


@pytest.mark.parametrize("query", ["c9_greedy_select", "c10_extend_state", "c11_resume_state"])
def test_selections_write_no_blocks(spark, sf, query, monkeypatch):
    def written(*_):
        raise AssertionError("blocks grow with the square of the sensors")

    monkeypatch.setattr(blocks, "write_blocks", written)
    monkeypatch.setattr(matrix, "BUDGET", 3)
    monkeypatch.setattr(matrix, "RESUMED", 14)
    assert matrix.QUERIES[query](spark, sf).count() > 0


def test_matrix_info_is_that_of_all_blocks(spark, sf, tmp_path, monkeypatch):
    k = fixtures.k_matrix(spark, sf, 2)
    few = blocks.Generated(k.ids.where("sensor_id < 20"), k.of, 2, k.features.where("sensor_id < 20"), k.width)
    blocks.write_blocks(blocks.every(few), str(tmp_path / "blocks"))
    blocks.write_matrix(few, str(tmp_path / "matrix"))
    table = blocks.matrix_info(blocks.read_blocks(spark, str(tmp_path / "blocks")))
    kept = blocks.matrix_info(blocks.read_matrix(spark, str(tmp_path / "matrix")))
    assert table.first() == kept.first() == blocks.matrix_info(few).first() == (2, 20, 400)
    assert [(x.name, x.dataType) for x in table.schema] == [(x.name, x.dataType) for x in kept.schema]
    monkeypatch.setattr(blocks, "write_blocks", None)  # the query writes none
    assert matrix.s2_matrix_info(spark, sf).first() == (2, 500, 250_000)


@pytest.mark.parametrize("nt", [1, 3])
def test_synthetic_columns_are_those_of_all_blocks(spark, nt, monkeypatch):
    """Ids over several tiles, some repeated; the values stay in the tasks, and all pairs of ids are in them."""
    monkeypatch.setattr(blocks, "TILE", 8)
    monkeypatch.setattr(blocks, "VALUES", 40)
    ids = [*range(30), 3, 29, 29]
    own = spark.createDataFrame([(i,) for i in ids], "sensor_id int").repartition(3)
    want: dict = {}
    for r in blocks.synthetic_blocks(own, nt, "single", 5).collect():
        want.setdefault(r["block_col"], []).append((r["block_row"], r["block"]))
    found = blocks.synthetic_columns(own, nt, "single", 5)
    got = {r["sensor_id"]: r for r in found.collect()}
    assert got.keys() == want.keys() == {*ids}
    for c, rows in want.items():
        values = np.array([b for _, b in rows])
        assert (got[c]["n_blocks"], got[c]["n_values"], got[c]["single"]) == (30, values.size, True)
        assert values.size == len(ids) * ids.count(c) * nt * nt
        assert (got[c]["mean"], got[c]["variance"]) == pytest.approx((values.mean(), values.var()))
    assert not any(r["single"] for r in blocks.synthetic_columns(own, nt, "double", 5).collect())
    assert "n_blocks" in found.columns and matrix.s1_synthetic_blocks(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString().count("Generate ") == 0


@pytest.mark.parametrize("query", ["p2_symmetrize", "p3_regularize"])
def test_pairs_of_tiles_are_not_dealt_out(spark, sf, query):
    """No exchange stands above the join of all pairs of tiles."""
    plan = matrix.QUERIES[query](spark, sf)._jdf.queryExecution().executedPlan().toString()
    join = min(i for i in (plan.find("CartesianProduct"), plan.find("BroadcastNestedLoopJoin")) if i >= 0)
    assert "Exchange" not in plan[:join]


def test_tiles_of_any_size_make_the_same_matrix(spark, sf, dense, monkeypatch):
    monkeypatch.setattr(fixtures, "TILE", 7)
    assert np.allclose(assemble(fixtures.k_blocks(spark, sf, 4).where(f"block_row < {N} and block_col < {N}")), dense)


@pytest.mark.parametrize("nt", [1, 3])
@pytest.mark.parametrize("way", ["together", "mixed", "apart"])
def test_blocks_of_cells_wherever_they_are(spark, nt, way):
    """Whole blocks are put together in place, in any order inside, cut by batches or not; the rest meet by a shuffle."""
    n = 24
    rng = random.Random(nt)
    m = np.random.default_rng(1).normal(size=(n, n))
    cells = []
    for a in range(0, n, nt):
        for b in range(0, n, nt):
            own = [(i, j, float(m[i, j])) for i in range(a, a + nt) for j in range(b, b + nt)]
            rng.shuffle(own) if way == "mixed" else None
            cells += own
    if way == "apart":
        rng.shuffle(cells)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        df = blocks.entries_to_blocks(spark.createDataFrame(cells, "i int, j int, value double").repartition(3) if way == "apart" else spark.createDataFrame(cells, "i int, j int, value double").coalesce(1), nt)
        rows = df.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(rows) == (n // nt) ** 2
    for r in rows:
        assert np.array_equal(np.reshape(r["block"], (nt, nt)), m[r["block_row"] * nt :, r["block_col"] * nt :][:nt, :nt])


def test_entries_of_blocks_are_not_shuffled_by_block(spark, sf):
    """What the shuffle of cells wrote: nothing, if blocks lie together."""
    df = matrix.s3_entries_blocks(spark, sf)
    assert df.count() == 1_000_000
    cells = blocks.blocks_to_entries(fixtures.k_blocks(spark, sf, 2).where("block_row < 9")).selectExpr("block_row * 2 + t i", "block_col * 2 + t2 j", "value")
    rest = blocks.entries_to_blocks(cells, 2)
    assert rest.count() == 9 * 500
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "places" in plan and "Union" in plan
