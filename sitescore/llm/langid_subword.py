"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is lower-cased, everything but letters becomes one space, and the byte n-grams of its words
(with a space at either end) are hashed into buckets. The mean of the buckets' embeddings goes
through a linear softmax. Embeddings and softmax are trained by stochastic gradient descent in
numpy on a bounded sample; a temperature and a rejection threshold are calibrated on rows of that
sample that the training doesn't see. As the model is linear, prediction adds up one row of
class scores for each n-gram.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOT_LETTERS = re.compile(r"[\W\d_]+")
SIZES = (2, 3, 4)
BUCKETS = 1 << 15
DIM = 16
FOLDS, HELD_OUT = 3, 1
#: Bound on the labelled rows that the model is fitted on, shared out evenly among the languages; a language
#: of fewer rows than its part leaves the rest to the others.
MAX_TRAIN_ROWS = 2_500
EPOCHS = 3
RATE = 1.0
#: Share of the accepted calibration rows that may be wrong.
ACCEPTED_ERROR = 0.01
BLOCK = 1 << 19
UNKNOWN = "und"


def letters(text: str | None) -> bytes:
    """The text's words of letters, lower-cased, a space before each and three after the last."""
    own = NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    return b" " + own.encode("utf-8", "surrogatepass") + b"   " if own else b""


def ngrams(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(starts, buckets) of the n-grams inside words, for each size, of bytes in which three spaces end each text."""
    a = data.astype(np.uint32)
    space = data == 32
    for n in SIZES:
        m = len(a) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint32)
        keep = ~(space[:m] & space[1 : m + 1])
        for i in range(n):
            h = h * np.uint32(16_777_619) ^ a[i : i + m]
            if 0 < i < n - 1:
                keep &= ~space[i : i + m]
        starts = np.nonzero(keep)[0]
        h = h[starts] * np.uint32(2_654_435_761)
        yield starts, h >> np.uint32(32 - (BUCKETS.bit_length() - 1))


def blocks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of the text, bucket) of all n-grams, in blocks of bounded size that may cut a text."""
    at, size, parts, of = 0, 0, [], []
    longest = max(SIZES) - 1

    def out():
        data = np.frombuffer(b"".join(parts), np.uint8)
        ends = np.cumsum([len(x) for x in parts])
        for starts, bucket in ngrams(data):
            yield np.array(of)[np.searchsorted(ends, starts, "right")], bucket

    for at, text in enumerate(texts):
        for lo in range(0, len(text), BLOCK):
            piece = text[lo : lo + BLOCK + longest] if lo + BLOCK < len(text) else text[lo:]
            if lo and len(piece) <= longest:
                break
            if lo or lo + BLOCK < len(text):  # a cut piece stands alone, so that no n-gram counts twice
                yield from _cut(at, piece)
                continue
            parts.append(piece)
            of.append(at)
            size += len(piece)
            if size >= BLOCK:
                yield from out()
                size, parts, of = 0, [], []
    if parts:
        yield from out()


def _cut(at: int, piece: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for starts, bucket in ngrams(np.frombuffer(piece, np.uint8)):
        own = starts < BLOCK
        yield np.full(int(own.sum()), at), bucket[own]


@dataclass
class Model:
    """scores: a row of class scores for each bucket."""

    langs: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        data = [letters(t) for t in texts]
        sums, counts = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        for of, bucket in blocks(data):
            if len(of):
                starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                sums[of[starts]] += np.add.reduceat(self.scores[bucket], starts, axis=0)
                counts += np.bincount(of, minlength=len(texts))
        p = softmax((sums / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature)
        known = np.array([bool(x) for x in data], bool)
        best = p.argmax(1) if len(self.langs) else np.zeros(len(texts), int)
        return [self.langs[i] if k else UNKNOWN for i, k in zip(best, known, strict=True)], np.where(known, p.max(1), 0.0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text and their shares."""
    count = np.zeros(BUCKETS, np.int64)
    for _, bucket in blocks([letters(text)]):
        count += np.bincount(bucket, minlength=BUCKETS)
    ids = np.flatnonzero(count)
    return ids.astype(np.int32), (count[ids] / max(1, count.sum())).astype(np.float32)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, langs: list[str], seed: int = 7) -> Model:
    """Stochastic gradient descent, one text a step, on four fifths of the rows; the rest calibrates."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1, 1, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    order = rng.permutation(len(bags))
    fit, rest = order[len(order) // 5 :], order[: len(order) // 5]
    steps, done = EPOCHS * max(1, len(fit)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(fit):
            ids, share = bags[i]
            rate, done = RATE * (1 - done / steps), done + 1
            x = share @ table[ids]
            g = softmax(x @ out + bias)
            g[labels[i]] -= 1
            table[ids] -= rate * len(ids) ** 0.5 * np.outer(share, out @ g)
            out -= rate * np.outer(x, g)
            bias -= rate * 0.1 * g
    scores = (table @ out).astype(np.float32)
    model = Model(langs, scores, bias)
    logits = np.array([bags[i][1] @ scores[bags[i][0]] + bias for i in rest]).reshape(len(rest), len(langs))
    if len(rest):
        y = labels[rest]
        loss = lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean()
        model.temperature = float(min(np.geomspace(0.5, 5, 40), key=loss))
        p = softmax(logits / model.temperature)
        best, right = p.max(1), p.argmax(1) == y
        by = np.argsort(-best, kind="stable")
        error = np.cumsum(~right[by]) / np.arange(1, len(by) + 1)
        fine = np.flatnonzero(error <= ACCEPTED_ERROR)
        model.threshold = float(best[by][fine[-1]]) if len(fine) else 1.0
    return model


def shares(counts: dict[str, int], most: int) -> dict[str, float]:
    """The part of each language's rows that is sampled, so that about most rows are in all."""
    out: dict[str, float] = {}
    rest, left = float(most), len(counts)
    for lang, n in sorted(counts.items(), key=lambda x: (x[1], x[0])):
        quota = min(float(n), rest / left)
        out[lang] = quota / n
        rest, left = rest - quota, left - 1
    return out


def fit(docs: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> Model | None:
    """Learn from text and lang of docs outside the held-out fold; None if there is no such row with a letter.

    One aggregate counts the labelled rows of each language; an even hash sample of each then makes up
    about max_train_rows rows, of which only the hashed bags come to the driver.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != HELD_OUT
    rows = docs.select("doc_id", "text", "lang").where("doc_id is not null and lang is not null and text is not null").where(fold)
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    part = docs.sparkSession.createDataFrame([(k, int(v * (1 << 30))) for k, v in shares(counts, max_train_rows).items()], "lang string, part long")
    rows = rows.join(F.broadcast(part), "lang")  # part has a row for each language
    rows = rows.where(F.xxhash64("doc_id", F.lit("train")).bitwiseAND((1 << 30) - 1) <= F.col("part"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            own = [bag(t) for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "lang": frame["lang"], "ids": [x[0] for x in own], "share": [x[1] for x in own]})

    got = rows.select("doc_id", "text", "lang").mapInPandas(run, "doc_id long, lang string, ids array<int>, share array<float>").toPandas()
    got = got[got["ids"].map(len) > 0].sort_values("doc_id", kind="stable")
    if got.empty:
        return None
    langs = sorted(got["lang"].unique())
    return train(list(zip(got["ids"], got["share"], strict=True)), np.array([langs.index(x) for x in got["lang"]]), langs)


def identify(docs: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """One row (doc_id, held_out, lang_pred, score, rejected) for each row of docs(doc_id, text, lang, ...).

    lang_pred is und, with score 0 and rejected, where the text is null or has no letter, or where
    nothing could be learned. rejected is true where the calibrated score is below the threshold that
    keeps the accepted rows' error within ACCEPTED_ERROR. held_out is true for the fold that training
    leaves out, and for a null doc_id. Of languages with equal scores the first by name is predicted.
    Texts of any length count whole. Repeated rows come back as often as they came.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, max_train_rows))

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        own = model.value
        if own is None:
            return pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": 0.0, "rejected": True})
        lang, score = own.predict(list(texts))
        return pd.DataFrame({"lang_pred": lang, "score": score, "rejected": (score < own.threshold) | (score == 0)})

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))
    out = docs.select("doc_id", held.alias("held_out"), run(F.col("text")).alias("__p"))
    return out.select("doc_id", "held_out", "__p.lang_pred", "__p.score", "__p.rejected")
