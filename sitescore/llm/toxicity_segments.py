"""Toxicity by maximum-scoring segments.

Each token scores its own log-odds between toxic and clean labelled documents, smoothed by a
Dirichlet prior that follows the corpus, as far as they are significant: negative ones shrunk by
their significance, positive ones from MIN_LOG_ODDS on, since weaker ones are mostly words that a
few copied documents share. From each goes a drift, where clean texts wouldn't lose by themselves. A linear scan finds all maximal scoring
segments of a text. Under chance the best segment of m tokens reaches S with probability
1 - exp(-K m exp(-lambda S)); lambda and K are fitted on clean documents, and a text's significant
segments are added up on that scale and calibrated to a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

TOKEN = re.compile(r"[^\W\d_]+")
#: Lengths of the word beginnings that stand in for words never seen in training.
PREFIXES = range(3, 9)
FOLDS = 5
#: Bound on the labelled rows that the model is fitted on, and so on its words and features.
MAX_TRAIN_ROWS = 60_000
#: Weight of the prior, in documents.
PRIOR = 50.0
#: Significance at which a feature's log-odds begin to count; of negative ones a share of 1 - (MIN_Z / z)^2 does.
MIN_Z = 3.2
#: What positive log-odds must reach.
MIN_LOG_ODDS = 3.0
#: What a token of clean texts loses on average at least.
DRIFT = 0.1
#: Token scores are counted in steps of this size to fit lambda.
STEP = 0.01
#: Expected number of chance segments in a text, up to which a segment is significant.
E_VALUE = 0.5


def features(word: str) -> list[str]:
    return ["=" + word, *("^" + word[:n] for n in PREFIXES if n < len(word))]


@dataclass
class Model:
    """scores: significant log-odds by feature. drift: what each token loses. weights: of the calibration."""

    scores: dict[str, float] = field(default_factory=dict)
    drift: float = DRIFT
    lam: float = 1.0
    k: float = 1.0
    weights: tuple[float, float, float] = (-20.0, 0.0, 0.0)
    _memo: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_memo": {}}

    def token(self, word: str) -> float:
        """A token's score: that of the word if it is known, else the best of its beginnings, less the drift."""
        got = self._memo.get(word)
        if got is None:
            if len(self._memo) > 200_000:
                self._memo.clear()
            whole, *begins = features(word)
            own = self.scores.get
            got = own(whole)
            if got is None:
                got = max((x for x in map(own, begins) if x is not None), default=0.0)
            got -= self.drift
            self._memo[word] = got
        return got


def segments(values: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last token, score) of a text with these token scores.

    The stack holds candidates (left sum, right sum, first, last, place of the nearest earlier one with
    a lower left sum); a new positive token joins those that it lifts. Candidates that a search has
    passed are never met again, as the new one points past them; so the scan is linear in the tokens.
    """
    own = np.asarray(values, float)
    hits = np.flatnonzero(own > 0)
    sums = np.concatenate([[0.0], np.cumsum(own)])
    stack: list[tuple[float, float, int, int, int]] = []
    for at, left, right in zip(hits.tolist(), sums[hits].tolist(), sums[hits + 1].tolist(), strict=True):
        lower, begin = len(stack) - 1, at
        while lower >= 0 and stack[lower][0] >= left:
            lower = stack[lower][4]
        while lower >= 0 and stack[lower][1] < right:
            joined = lower
            left, _, begin, _, lower = stack[joined]
            del stack[joined:]
        stack.append((left, right, begin, at, lower))
    return [(a, b, right - left) for left, right, a, b, _ in stack]


def token_scores(text: str | None, model: Model) -> list[float]:
    """The score of each token of a text; a null text has none."""
    words = TOKEN.findall((text or "").lower())
    values = list(map(model._memo.get, words))
    return [model.token(w) if v is None else v for w, v in zip(words, values, strict=True)] if None in values else values


def evidence(n: int, found: list[tuple[int, int, float]], model: Model) -> tuple[float, float, list[tuple[int, int, float]]]:
    """(best, sum, significant segments with their normalised scores lambda S - ln(K n))."""
    base = math.log(max(model.k * max(n, 1), 1e-300))
    rated = [(a, b, model.lam * s - base) for a, b, s in found]
    significant = [x for x in rated if math.exp(-x[2]) <= E_VALUE]
    return max([0.0, *(x[2] for x in significant)]), sum(x[2] for x in significant), significant


def probability(best: float, total: float, model: Model) -> float:
    a, b, c = model.weights
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, a + b * math.log1p(best) + c * math.log1p(total)))))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(text, toxic) of the labelled documents outside the held-out fold; by an even hash no more
    than about max_rows of them. Repeated labels count once, toxic if any says so; copies of a text once."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.max("toxic").alias("toxic"))
    known = checkpoint(known.where(F.crc32(F.col("__id").cast("string").cast("binary")) % FOLDS != 0))
    share = min(1.0, max_rows / max(1, known.count()))
    known = known.where((F.xxhash64("__id", F.lit("train")).bitwiseAND((1 << 30) - 1)) < int(share * (1 << 30)))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("__id"))  # known has about max_rows rows
    return checkpoint(rows.where("text is not null").select("text", "toxic"))


def significance(all_tox: int, all_clean: int):
    """The signed root of the likelihood ratio of a feature's tox and clean counts against the classes'
    sizes, with one more document of the class that it speaks against: it grows with the count and
    with purity, whatever the number of rows."""
    share = (all_tox + 1.0) / (all_tox + all_clean + 2.0)
    part = lambda n, of, p: F.when(n > 0, n * F.log(n / (of * p))).otherwise(0.0)

    def root(tox, clean):
        g = 2 * (part(tox, tox + clean, share) + part(clean, tox + clean, 1 - share))
        return F.sqrt(F.greatest(g, F.lit(0.0)))

    tox, clean = F.col("tox"), F.col("clean")
    up = F.when(tox > (tox + clean + 1) * share, root(tox, clean + 1))
    return up.when(tox + 1 < (tox + clean + 1) * share, -root(tox + 1, clean)).otherwise(0.0)


def fit(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> Model:
    """Learn from docs(doc_id, text, ...) and labels(doc_id, toxic, ...) outside the held-out fold.

    Without a toxic or without a clean training document the model scores every text near 0.
    """
    rows = training_rows(docs, labels, max_train_rows)
    vocabulary = "word string, tox long, clean long"

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by: tuple[Counter, Counter] = (Counter(), Counter())
        out = lambda: pd.DataFrame([(w, by[1][w], by[0][w]) for w in {*by[0], *by[1]}], columns=["word", "tox", "clean"])
        for frame in frames:
            for text, toxic in zip(frame["text"], frame["toxic"], strict=True):
                own = by[int(toxic > 0)]
                own.update({*TOKEN.findall(text.lower())})
                own[""] += 1
                if len(by[0]) + len(by[1]) > 150_000:
                    yield out()
                    by[0].clear()
                    by[1].clear()
        yield out()

    words = checkpoint(rows.mapInPandas(count, vocabulary).groupBy("word").agg(F.sum("tox").alias("tox"), F.sum("clean").alias("clean")))
    sums = words.where("word = ''").first()
    if sums is None or not sums["tox"] or not sums["clean"]:
        return Model()
    whole = words.where("word <> ''").select(F.concat(F.lit("="), "word").alias("feature"), "tox", "clean")
    begins = words.select(F.explode(F.array(*[F.when(F.length("word") > n, F.concat(F.lit("^"), F.substring("word", 1, n))) for n in PREFIXES])).alias("feature"), "tox", "clean")
    begins = begins.where("feature is not null").groupBy("feature").agg(F.sum("tox").alias("tox"), F.sum("clean").alias("clean"))
    # A word counts once for each document that has it; the sums over words are the classes' sizes.
    all_tox, all_clean = words.where("word <> ''").agg(F.sum("tox"), F.sum("clean")).first()
    weight = PRIOR / (sums["tox"] + sums["clean"])
    alpha, prior = weight * (F.col("tox") + F.col("clean")), weight * ((all_tox or 0) + (all_clean or 0))
    of = lambda y, n: F.log((F.col(y) + alpha) / (F.lit(float((n or 0) + prior + 1)) - F.col(y) - alpha))
    rated = whole.union(begins).withColumn("delta", of("tox", all_tox) - of("clean", all_clean)).withColumn("z", significance(all_tox or 0, all_clean or 0))
    shrunk = F.when(F.col("z") < 0, F.col("delta") * (1 - F.pow(MIN_Z / F.col("z"), F.lit(2.0)))).when(F.col("delta") >= MIN_LOG_ODDS, F.col("delta"))
    counted = rated.where(F.abs("z") > MIN_Z).select("feature", shrunk.alias("score")).where("score is not null")
    # Bounded by the training rows: a feature needs several documents to be significant.
    model = Model(scores={r["feature"]: r["score"] for r in counted.collect()}, drift=0.0)
    return calibrated(model, rows)


def clean_scores(model: Model, rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(scores, how many tokens of clean texts have them), in steps of STEP."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: Counter = Counter()
        for frame in frames:
            for text in frame["text"]:
                own.update(np.rint(np.array(token_scores(text, shared.value)) / STEP).astype(int).tolist())
        yield pd.DataFrame({"step": list(own), "n": list(own.values())}, dtype="int64")

    got = rows.where("toxic <= 0").mapInPandas(run, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).orderBy("step").toPandas()
    shared.unpersist()
    return got["step"].to_numpy(float) * STEP, got["n"].to_numpy(float)


def decay(scores: np.ndarray, n: np.ndarray) -> float:
    """lambda: the positive root of sum p(s) exp(lambda s) = 1 over the token scores of clean texts."""
    if not (scores > 0).any():
        scores, n = np.append(scores, 1.0), np.append(n, 1.0)
    p, low, high = n / n.sum(), 1e-6, 50.0
    for _ in range(100):
        x = (low + high) / 2
        low, high = (x, high) if (p * np.exp(np.minimum(700, x * scores))).sum() < 1 else (low, x)
    return max(low, 1e-3)


def calibrated(model: Model, rows: DataFrame) -> Model:
    """Fit the drift, lambda, K and the calibration; what comes to the driver is a histogram, and a few numbers
    for each of the bounded training rows."""
    scores, n = clean_scores(model, rows)
    mean = float((scores * n).sum() / max(1.0, n.sum()))
    model.drift = max(0.0, mean + DRIFT)
    model.lam = decay(scores - model.drift, n)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for text, toxic in zip(frame["text"], frame["toxic"], strict=True):
                values = token_scores(text, shared.value)
                out.append((float(len(values)), int(toxic > 0), [s for _, _, s in segments(values)]))
            yield pd.DataFrame(out, columns=["n", "toxic", "found"])

    got = rows.mapInPandas(measure, "n double, toxic int, found array<double>").select("n", "toxic", "found", F.xxhash64("n", "toxic", "found").alias("h")).toPandas().sort_values(["n", "toxic", "h"], kind="stable")
    shared.unpersist()
    toxic = got["toxic"].to_numpy()
    n = np.maximum(1.0, got["n"].to_numpy())
    best = np.array([max([0.0, *x]) for x in got["found"]])
    clean = toxic == 0
    # K: under chance K n exp(-lambda S) has mean 1 over clean texts.
    model.k = float(clean.sum() / max(1e-300, (n[clean] * np.exp(-model.lam * best[clean])).sum()))
    rated = [evidence(int(m), [(0, 0, s) for s in x], model)[:2] for m, x in zip(n, got["found"], strict=True)]
    x = np.column_stack([np.ones(len(n)), *np.log1p(np.array(rated)).T])
    w, ridge = np.zeros(3), np.diag([1e-3, 1e-1, 1e-1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (toxic - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    model.weights = tuple(float(v) for v in w)
    return model


SCORED = "struct<score double, n_tokens long, passages array<struct<first long, last long, score double>>>"


def scored(model: Model, docs: DataFrame, text: str = "text"):
    """A column of SCORED for docs' text: the probability of a toxic label, and every significant
    passage as first and last token (counted from 0) and normalised score. A null or empty text has
    no passage and the score of such a text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, n_tokens long, passages array<struct<first:long,last:long,score:double>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        own, out = shared.value, []
        for t in texts:
            values = token_scores(t, own)
            best, total, significant = evidence(len(values), segments(values), own)
            out.append((probability(best, total, own), len(values), [{"first": a, "last": b, "score": s} for a, b, s in significant]))
        return pd.DataFrame(out, columns=["score", "n_tokens", "passages"])

    return run(F.col(text))


def toxicity(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """One row (doc_id, held_out, score, predicted, n_tokens, passages) for each row of docs.

    held_out is true for the fold that training leaves out, and for a null doc_id. Empty and null
    texts get the score of a text without passages; texts of any length are scanned whole. Repeated
    rows come back as often as they came; other columns are ignored.
    """
    out = docs.select("doc_id", scored(fit(docs, labels, max_train_rows), docs).alias("__t"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(True))
    return out.select("doc_id", held.alias("held_out"), "__t.score", (F.col("__t.score") >= 0.5).cast("int").alias("predicted"), "__t.n_tokens", "__t.passages")


def keep_clean(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that are not predicted toxic, with the columns of docs."""
    model = fit(docs, labels, **options)
    return docs.where(scored(model, docs)["score"] < 0.5)
