import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sitescore.llm import decontam_prefix, mix_flow, pii_feistel, queries
from sitescore.llm.common import table


def brute_targets(sizes, weights=(5, 2, 1)):
    """Hand the whole out in small steps: whoever is below its cap gets its share by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    low, high = 0.0, 10.0 * sum(sizes.values()) + 1
    for _ in range(200):  # the water level at which all is handed out
        level = (low + high) / 2
        total = sum(min(3 * sizes[s], level * w[s]) for s in order)
        low, high = (level, high) if total < sum(sizes.values()) else (low, level)
    return {s: min(3 * sizes[s], high * w[s]) for s in order}


@pytest.mark.parametrize("seed", range(8))
def test_targets(seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 1, 10, 1000, 100_000]) for s in ["b", "a", None, "Z", "é", "c"][: rng.randint(1, 6)]}
    got, want = mix_flow.targets(list(sizes.items())), brute_targets(sizes)
    assert got.keys() == want.keys()
    for s in got:
        assert got[s] == pytest.approx(want[s], rel=1e-9, abs=1e-6)


def brute_flow(patterns, quota):
    """The least cost of the largest flow, token by token over all choices of copies (tiny cases only)."""
    best = (-1, 0)
    names = list(patterns)
    options = []
    for p in names:
        most = 3 * patterns[p]
        options.append([x for x in itertools.product(range(most + 1), repeat=len(p)) if sum(x) <= most])
    for choice in itertools.product(*options):
        into = defaultdict(int)
        cost = 0
        for p, x in zip(names, choice, strict=True):
            for s, n in zip(p, x, strict=True):
                into[s] += n
            n, size = sum(x), patterns[p]
            cost += sum(min(max(n - c * size, 0), size) * (c + 1) for c in range(3))
        if all(into[s] <= quota.get(s, 0) for s in into):
            total = sum(into.values())
            best = max(best, (total, -cost))
    return best


def test_route_is_a_min_cost_flow():
    rng = random.Random(2)
    for _ in range(25):
        patterns = {p: rng.randint(1, 2) for p in rng.sample([("a",), ("b",), ("a", "b"), ("b", "c")], rng.randint(1, 3))}
        quota = {s: rng.randint(0, 5) for s in "abc"}
        flow = mix_flow.route(patterns, quota)
        total = sum(x for f in flow.values() for x in f.values())
        cost = sum(min(max(sum(f.values()) - c * patterns[p], 0), patterns[p]) * (c + 1) for p, f in flow.items() for c in range(3))
        assert (round(total), -round(cost)) == brute_flow(patterns, quota)
        for s in "abc":
            assert sum(f.get(s, 0) for f in flow.values()) <= quota[s] + 1e-6


def test_mix_query(spark, sf):
    sf = sf.replace("0.001", "0.01")
    rows = queries.op7_mix_flow(spark, sf).collect()
    docs = {r["doc_id"]: (r["source"], len((r["text"] or "").split())) for r in table(spark, sf, "documents").collect()}
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        s, n = docs[r["doc_id"]]
        assert r["size"] == n and 0 <= r["taken"] <= 3 * n and (n == 0 or r["taken"] % n == 0)
        sizes[s] += n
        taken[s] += r["taken"]
        target[s] = r["target"]
    want = brute_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s], rel=1e-9)
        assert abs(taken[s] - target[s]) <= 0.02 * target[s] + 20
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.op7_mix_flow(spark, sf).collect()))


def test_overlapping_sources(spark):
    rng = random.Random(4)
    docs = [(i, "w " * rng.randint(5, 60), sorted(rng.sample(["a", "b", "c"], rng.randint(0, 3)))) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, tags array<string>")
    got = mix_flow.mix(df, sources=F.col("tags")).collect()
    whole = sum(r["size"] for r in got)
    assert len(got) == 400 and abs(sum(r["taken"] for r in got) - whole) <= 0.1 * whole


def test_every_pattern_goes_through_the_flow(spark, sf, monkeypatch):
    seen, route = [], mix_flow.route
    monkeypatch.setattr(mix_flow, "route", lambda patterns, *rest: seen.append({*patterns}) or route(patterns, *rest))
    queries.op7_mix_flow(spark, sf)
    assert seen == [{(r["source"],) for r in table(spark, sf, "documents").select("source").distinct().collect()}]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_more_patterns_than_the_driver_takes(spark, most):
    """Solved component by component in the tasks, with the same targets and as large and cheap a flow."""
    rng = random.Random(most)
    names = ["a", "b", "Z", "é", "c", "d", None, "e"]
    docs = [(i, "w " * rng.choice([1, 5, 60, 600]), rng.sample(names[:3] if i % 2 else names[3:], rng.randint(0, most))) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, tags array<string>")
    one, two = (mix_flow.mix(df, sources=F.col("tags"), max_patterns=n).collect() for n in (100, 0))
    by = lambda rows: {r["doc_id"]: (r["pattern"], r["size"], r["source_size"], pytest.approx(r["target"])) for r in rows}
    assert by(one) == by(two)
    assert sorted(map(str, one)) == sorted(map(str, two))


@pytest.mark.parametrize("weights", [(5.0, 2.0, 1.0), (0.1, 0.7, 0.3)])
def test_one_flow_whatever_the_order_and_the_neighbours(weights):
    """Patterns in any order, with names or numbers, together or a connected set at a time: the same numbers, not only the same cost."""
    rng = random.Random(9)
    for _ in range(40):
        patterns = {tuple(sorted(rng.sample(names, rng.randint(1, 3)))): rng.randint(0, 50) for names in ("abcd", "efgh") for _ in range(6)}
        sizes = defaultdict(int)
        for p, n in patterns.items():
            for s in p:
                sizes[s] += n
        quota = mix_flow.targets(list(sizes.items()), weights)
        flow = mix_flow.route(patterns, quota)
        turned = list(patterns.items())
        rng.shuffle(turned)
        assert mix_flow.route(dict(turned), quota) == flow
        apart = [mix_flow.route({p: n for p, n in turned if p[0] in part}, quota) for part in ("abcd", "efgh")]
        assert apart[0] | apart[1] == flow
        number = {s: 2 * i + 7 for i, s in enumerate(sorted(sizes))}
        numbers = mix_flow.route({tuple(number[s] for s in p): n for p, n in turned}, {number[s]: q for s, q in quota.items()})
        assert all(numbers[tuple(number[s] for s in p)] == {number[s]: x for s, x in flow[p].items()} for p in patterns)


def similar_groups(docs):
    """Smallest id of each component by the similarity of all pairs' five-word shingles."""
    sets = {}
    for i, text in docs:
        w = (text or "").lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x == y or 5 * len(x & y) >= 4 * len(x | y):
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    return root


SECRET = "a secret of the tests"


def test_pipeline_against_its_parts(spark, sf):
    """Each stage written and read again, and judged by the plain definition of what it decides."""
    spark.conf.set(corpus_pipeline.KEY, SECRET)
    docs = table(spark, sf, "documents").withColumn("extra", F.lit(1))
    columns = docs.columns
    for (name, stage), check in zip(corpus_pipeline.STAGES, (None, "one of each group", "no window", "no value", "drawn"), strict=True):
        before = docs.collect()
        path = f"{spark.sparkContext.getCheckpointDir()}/test-{name}"
        stage(spark, docs, sf).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        after = docs.collect()
        ids = {r["doc_id"] for r in after}
        assert len(ids) == len(after) and ids <= {r["doc_id"] for r in before}
        if name != "mixing":
            assert docs.columns == columns
        if check == "one of each group":
            assert ids == {*similar_groups([(r["doc_id"], r["text"]) for r in before]).values()}
        elif check == "no window":
            index = decontam_prefix.Index.of([(str(r["item_id"]), r["text"]) for r in table(spark, sf, "benchmark").collect()])
            index.choose({k: np.zeros(len(v), int) for k, v in index.shingles.items()})
            assert {r["doc_id"] for r in before if not index.hits(r["text"])[3]} == ids
        elif check == "no value":
            assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in after} == {r["doc_id"]: (t := pii_feistel.pseudonyms(r["text"], SECRET.encode())[0], len(t)) for r in before}
        elif check == "drawn":
            assert {*docs.columns} == {*columns} | {"size", "source_size", "target", "taken"} and all(r["taken"] > 0 for r in after)
    assert len(after)
    spark.conf.unset(corpus_pipeline.KEY)


def test_run(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.count() > 20 and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "mixing"]


def test_trial_key_is_refused(spark, edge):
    spark.conf.set(corpus_pipeline.KEY, pii_feistel.TRIAL_KEY.decode())
    with pytest.raises(ValueError):
        corpus_pipeline.pii(spark, edge, "")
    spark.conf.unset(corpus_pipeline.KEY)


def written(spark, tmp_path, docs, labels, benchmark):
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_run_on_edge_cases(spark, tmp_path, edge, labels, benchmark):
    """Nulls, empty and long texts, repeated rows and clashing columns."""
    got = corpus_pipeline.run(spark, written(spark, tmp_path, edge, labels.where("toxic = 0"), benchmark))
    assert {*got.columns} == {*edge.columns} | {"source_size"}
    rows = got.collect()
    ids = [r["doc_id"] for r in rows]
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None}) and {7, 11} <= {*ids}
    assert not {1, 2, 3, 8, 9} & {*ids}  # these have windows of the benchmark


def test_run_on_empty_tables(spark, tmp_path, empty, labels, benchmark):
    assert corpus_pipeline.run(spark, written(spark, tmp_path, empty, labels.limit(0), benchmark.limit(0))).count() == 0


def test_distinct_texts_of_one_id_stay(spark, sf):
    plain = " ".join(f"w{i}" for i in range(50))
    rows = [(1, plain, "b"), (1, plain, "a"), (1, "wholly different words", "c"), (2, plain + " end", "d"), (3, "Wholly  different words", "e"), (4, "four", "f"), (4, plain + " end", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for n in (1, 7):
        got = corpus_pipeline.near_duplicates(spark, docs.repartition(n), sf).collect()
        assert sorted(map(tuple, got)) == [(1, plain, "a"), (1, "wholly different words", "c"), (4, "four", "f")]
