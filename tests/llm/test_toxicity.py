import math
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitescore.llm import toxicity_segments as ts


def brute_segments(values):
    """Maximal scoring segments by their recursive definition: the best one, then those left and right of it."""
    best = (0.0, 0, 0)
    for i in range(len(values)):
        total = 0.0
        for j in range(i, len(values)):
            total += values[j]
            if total > best[0] + 1e-12:
                best = (total, i, j)
    if best[0] <= 0:
        return []
    s, i, j = best
    left, right = brute_segments(values[:i]), brute_segments(values[j + 1 :])
    return left + [(i, j, s)] + [(a + j + 1, b + j + 1, x) for a, b, x in right]


def test_segments_against_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(0, 60)
        values = [rng.choice([-0.1, -0.1, rng.uniform(-2, 0), rng.uniform(-0.5, 3)]) for _ in range(n)]
        want, got = brute_segments(values), ts.segments(values)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_segments_of_long_texts():
    """A million tokens with a falling sum, and ones with a rising and a level sum."""
    for values in (np.tile([-2.0, 1.0], 500_000), np.tile([-1.0, 2.0], 500_000), np.tile([-1.0, 1.0], 500_000)):
        began = time.perf_counter()
        found = ts.segments(values.tolist())
        assert time.perf_counter() - began < 5
        assert len(found) == (1 if values[1] == 2 else 500_000)


def brute_fit(rows):
    """Scores, drift, lambda and K by the definitions, in plain Python."""
    count, tox, clean = {}, 0, 0
    for text, toxic in rows:
        for w in {*ts.TOKEN.findall(text.lower())}:
            for f in ts.features(w):
                count.setdefault(f, [0, 0])[toxic] += 1
            tox, clean = tox + toxic, clean + 1 - toxic
    share, weight = (tox + 1) / (tox + clean + 2), ts.PRIOR / len(rows)

    def root(t, c):
        return math.sqrt(max(0.0, 2 * sum(n * math.log(n / ((t + c) * p)) for n, p in ((t, share), (c, 1 - share)) if n)))

    scores = {}
    for f, (c, t) in count.items():
        z = root(t, c + 1) if t > (t + c + 1) * share else -root(t + 1, c) if t + 1 < (t + c + 1) * share else 0.0
        if abs(z) > ts.MIN_Z:
            a, prior = weight * (t + c), weight * (tox + clean)
            delta = math.log((t + a) / (tox + prior + 1 - t - a)) - math.log((c + a) / (clean + prior + 1 - c - a))
            if z < 0 or delta >= ts.MIN_LOG_ODDS:
                scores[f] = delta if z > 0 else delta * (1 - (ts.MIN_Z / z) ** 2)
    def of(w):
        whole, *begins = ts.features(w)
        return scores.get(whole, max((scores[b] for b in begins if b in scores), default=0.0))
    values = [[of(w) for w in ts.TOKEN.findall(text.lower())] for text, toxic in rows if not toxic]
    flat = np.rint(np.array([x for v in values for x in v]) / ts.STEP) * ts.STEP
    drift = max(0.0, flat.mean() + ts.DRIFT)
    low, high = 1e-6, 50.0
    for _ in range(100):
        x = (low + high) / 2
        low, high = (x, high) if np.exp(x * (flat - drift)).mean() < 1 else (low, x)
    best = [max([0.0, *(s for *_, s in ts.segments([x - drift for x in v]))]) for v in values]
    k = len(values) / sum(len(v) * math.exp(-low * b) for v, b in zip(values, best, strict=True))
    return scores, drift, low, k


def test_fit_against_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for i in range(1600):
        toxic = int(i % 4 == 0)
        words = [rng.choice(["the", "of", "and", "tree", "treehouse"]) for _ in range(30)] + [rng.choice(["kind", "calm"] if rng.random() < 0.99 - 0.69 * toxic else ["zork", "zorkish", "bleh"]) for _ in range(4)]
        rng.shuffle(words)
        rows.append((i, " ".join(words), toxic))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    model = ts.fit(docs, labels)
    scores, drift, lam, k = brute_fit([(t, x) for i, t, x in rows if zlib.crc32(str(i).encode()) % ts.FOLDS])
    assert model.scores == pytest.approx(scores) and min(scores.values()) < 0 < max(scores.values())
    assert (model.drift, model.lam, model.k) == pytest.approx((drift, lam, k), rel=1e-6)


def synthetic(n, seed):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            for _ in range(rng.randint(1, 5)):
                text[rng.randrange(len(text))] = "zork" + rng.choice("abcdefghij")
        yield i, " ".join(text), toxic


def test_learns_words_and_beginnings(spark):
    rows = list(synthetic(600, 1))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in rows], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in ts.toxicity(docs, labels).collect()}
    held = [(found[i], t) for i, _, t in rows if found[i]["held_out"]]
    assert 80 < len(held) < 160
    assert sum(r["predicted"] == t for r, t in held) / len(held) > 0.97
    for i, text, t in rows[:50]:
        tokens = ts.TOKEN.findall(text.lower())
        for p in found[i]["passages"]:
            assert tokens[p["first"]].startswith("zork") and tokens[p["last"]].startswith("zork")


def test_held_out_labels_are_not_read(spark):
    rows = list(synthetic(300, 2))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in rows], "doc_id long, quality int, toxic int")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (sorted((r["doc_id"], r["score"]) for r in ts.toxicity(docs, x).collect()) for x in (labels, flipped))
    assert one == two


def test_no_labels_scores_near_zero(edge, labels):
    got = ts.toxicity(edge, labels.limit(0)).collect()
    assert all(0 <= r["score"] < 1e-6 and r["predicted"] == 0 for r in got)


@pytest.mark.parametrize("n", [600, 60_000])
def test_pure_toxic_word_at_any_number_of_rows(spark, n):
    """A word of 20 toxic and no clean training documents is learned; one of a toxic and a clean one isn't."""
    training = [i for i in range(2 * n) if zlib.crc32(str(i).encode()) % ts.FOLDS][:n]
    toxic = {i: int(at % 10 == 0) for at, i in enumerate(training)}
    words = {i: f"plain{i % 7} text{i % 11}" for i in training}
    for i in [i for i in training if toxic[i]][:20]:
        words[i] += " zork"
    words[training[10]] += " both"
    words[training[11]] += " both"
    docs = spark.createDataFrame([*words.items()], "doc_id long, text string")
    labels = spark.createDataFrame([*toxic.items()], "doc_id long, toxic int")
    scores = ts.fit(docs, labels).scores
    assert scores["=zork"] > 1 and "=both" not in scores
