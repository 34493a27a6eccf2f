"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint has two (or, for very large corpora, three) blocks, each covered by a
perfect code: the Golay code of length 23 (covering radius 3), and the Hamming code of length
15 (radius 1). The anchors are the product of these codes. A fingerprint's home is the one
anchor within the covering radius of each block. Another fingerprint at t bits or fewer is,
block by block, at most radius + d bits from that home, the d of the blocks adding up to t or
less; so each fingerprint is replicated to every anchor within radius plus threshold, and the
fingerprints that share an anchor (one as its home) are compared. candidates() takes pairs beyond
the threshold from the anchors as well, for an exact comparison of the texts to follow.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, connected_components

SEED = 42
SHINGLE = 3
THRESHOLD = 2
#: Distinct fingerprints from which the third block is used (2^24 anchors without it, 2^35 with it).
THIRD_BLOCK_FROM = 1 << 24
#: Length, generator polynomial and covering radius of each block's code.
BLOCKS = ((23, 0b110001110101, 3), (23, 0b110001110101, 3), (15, 0b10011, 1))
CHUNK = 1 << 16
#: Fingerprints whose anchors are made at once, some 60 each.
STEP = 512
#: Fixed value: candidates() takes fingerprints at an anchor that differ in up to this many bits.
WIDE = 12


def majority(parts: Iterable[np.ndarray], n: int) -> int:
    """The bits set in over half of n unsigned hashes, given in parts, as a signed 64-bit number."""
    count = np.zeros(64, np.int64)
    for h in parts:
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """SimHash of a text's word shingles, repeats included, as a signed 64-bit number.

    Only A-Z is lower-cased. A text of fewer than k words has one shingle, its whole sequence;
    a null or empty text, or one of white space only, has fingerprint zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n, digest, join = max(1, len(words) - k + 1), xxhash.xxh64_intdigest, b" ".join

    def hashes():
        for lo in range(0, n, CHUNK):
            part = words[lo : lo + CHUNK + k - 1]
            shingles = zip(*(part[i:] for i in range(k)), strict=False) if len(part) >= k else [part]
            yield np.fromiter((digest(join(s), SEED) for s in shingles), np.uint64)

    return majority(hashes(), n)


@F.pandas_udf(T.LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return texts.map(fingerprint, na_action=None).astype("int64")


@cache
def coset_table(length: int, poly: int, radius: int, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each syndrome: the differences to the codewords within radius + threshold.

    Returns (syndrome of each word of the code's length by its high bits, ends, differences):
    the differences of syndrome s with at most x bits above the radius are
    differences[ends[s, 0] : ends[s, x + 1]].
    """
    r = poly.bit_length() - 1
    high = np.zeros(1 << (length - r), np.int64)
    for i in range(length - r):
        rest = 1 << (i + r)
        while rest.bit_length() > r:
            rest ^= poly << (rest.bit_length() - 1 - r)
        high[1 << i : 2 << i] = high[: 1 << i] ^ rest
    words, extra = [], []
    for w in range(radius + threshold + 1):
        own = [sum(1 << i for i in c) for c in combinations(range(length), w)]
        words += own
        extra += [max(0, w - radius)] * len(own)
    words, extra = np.array(words, np.int64), np.array(extra, np.int64)
    syndrome = high[words >> r] ^ (words & ((1 << r) - 1))
    order = np.lexsort((extra, syndrome))
    rank = (syndrome * (threshold + 2) + extra)[order]
    starts = np.arange(1 << r)[:, None] * (threshold + 2) + np.arange(threshold + 2)[None, :]
    return high, np.searchsorted(rank, starts), words[order]


def anchors(fps: np.ndarray, threshold: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(index into fps, anchor) for every anchor within covering radius plus threshold, as the
    module says; with threshold 0 the home alone."""
    at = np.arange(len(fps))
    anchor, left, shift = np.zeros(len(fps), np.int64), np.full(len(fps), threshold), 0
    for length, poly, radius in BLOCKS[:blocks]:
        high, ends, differences = coset_table(length, poly, radius, threshold)
        r = poly.bit_length() - 1
        bits = (fps[at].view(np.uint64) >> np.uint64(shift)).astype(np.int64) & ((1 << length) - 1)
        s = high[bits >> r] ^ (bits & ((1 << r) - 1))
        n = ends[s, left + 1] - ends[s, 0]
        row = np.repeat(np.arange(len(at)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        pick = ends[s[row], 0] + step
        used = np.zeros(len(row), np.int64)
        for x in range(threshold):
            used += pick >= ends[s[row], x + 1]
        word = bits[row] ^ differences[pick]
        at, anchor, left = at[row], (anchor[row] << (length - r)) | (word >> r), left[row] - used
        shift += length
    return at, anchor


def anchored(fps: DataFrame, threshold: int, blocks: int) -> DataFrame:
    """(anchor, fp, node) for each (fp, node) and each of its anchors."""

    def run(batches):
        for batch in batches:
            fp, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for lo in range(0, len(fp), STEP):
                at, anchor = anchors(np.ascontiguousarray(fp[lo : lo + STEP]), threshold, blocks)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[lo + at]), pa.array(node[lo + at])], ["anchor", "fp", "node"])

    return fps.select("fp", "node").mapInArrow(run, "anchor long, fp long, node long")


def links(fps: DataFrame, threshold: int = THRESHOLD, third_block_from: int = THIRD_BLOCK_FROM) -> DataFrame:
    """Pairs (a, b) of nodes whose distinct fingerprints differ in 1 to threshold bits, each once."""
    blocks = 2 if fps.count() < third_block_from else 3
    home = anchored(fps, 0, blocks)
    near = anchored(fps, threshold, blocks).select("anchor", F.col("fp").alias("fp2"), F.col("node").alias("node2"))
    close = (F.col("fp") < F.col("fp2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= threshold)
    return home.join(near, (home["anchor"] == near["anchor"]) & close).select(F.col("node").alias("a"), F.col("node2").alias("b"))


def candidates(fps: DataFrame, most: int = WIDE, threshold: int = THRESHOLD, third_block_from: int = THIRD_BLOCK_FROM) -> DataFrame:
    """Pairs (a, b) of nodes, a < b, each once, of fps(fp, node): nodes of one fingerprint, or of fingerprints
    that share an anchor and differ in up to most bits, which may be more than threshold.

    These are stars: a fingerprint's nodes with the smallest of them, which stands for them at the
    anchors, and all that reach an anchor with the smallest and the largest node that is at home there.
    So the pairs of a group of any size grow with the group, not with its square. Repeated
    fingerprints may come in any number; an empty table has no pairs.
    """
    heads = checkpoint(fps.groupBy("fp").agg(F.min("node").alias("node")))
    blocks = 2 if heads.count() < third_block_from else 3
    home = F.struct("node", "fp")
    ends = anchored(heads, 0, blocks).groupBy("anchor").agg(F.min(home).alias("low"), F.max(home).alias("high"))
    both = anchored(heads, threshold, blocks).join(ends, "anchor").select("node", "fp", F.explode(F.array("low", "high")).alias("end"))
    close = both.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("end.fp"))) <= most).select("node", F.col("end.node").alias("end"))
    equal = fps.join(heads.select("fp", F.col("node").alias("end")), "fp").select("node", "end")
    return close.union(equal).where("node <> end").select(F.least("node", "end").alias("a"), F.greatest("node", "end").alias("b")).distinct()


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, third_block_from: int = THIRD_BLOCK_FROM) -> DataFrame:
    """One row (doc_id, fp, component_id, copies) for each row of docs(doc_id, text, ...).

    Fingerprints link at threshold or fewer differing bits; component_id is the smallest doc_id
    reachable, itself included; copies is the number of rows with the same fingerprint. Rows of
    equal fingerprint meet in one aggregate before any comparison, so a group of copies of any
    size counts as one node. Null texts have fingerprint zero. Rows with a null doc_id get the
    component of their fingerprint if a row with an id has it, and null otherwise. Repeated rows
    come back as often as they came. Other columns of docs are ignored.
    """
    rows = checkpoint(docs.select("doc_id", fingerprints(F.col("text")).alias("fp")))
    nodes = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")))
    stars = connected_components(links(nodes.where("node is not null"), threshold, third_block_from))
    found = nodes.join(stars, nodes["node"] == stars["a"], "left").select("fp", F.coalesce("root", "node").alias("component_id"), "copies")
    return rows.join(checkpoint(found), "fp").select("doc_id", "fp", "component_id", "copies")


def keep_one(docs: DataFrame, near=near_duplicates, mark=fingerprints, mark_name: str = "fp", **options) -> DataFrame:
    """One row of each component of near(), near_duplicates() here: that of the smallest doc_id. Rows
    without a doc_id stay. The columns are those of docs.

    Rows may share a doc_id. Of those whose texts have an equal mark() the least in the order of text
    and the other columns is the one; texts of different marks each stay as long as their component's
    smallest doc_id is their own, so no distinct text is lost to a repeated id.
    """
    groups = near(docs, **options).where("doc_id is not null")
    first = F.col("doc_id") == F.col("component_id")
    kept, own_mark, other_mark, row_name = unused(docs, "kept", "own_mark", "other_mark", "row")
    ids = groups.groupBy(F.col("doc_id").alias(kept)).agg(F.count("*").alias("n"), F.bool_or(first).alias("first"))
    ids = checkpoint(ids.where("first").drop("first"))
    own = docs.join(ids.where("n = 1").select(kept), docs["doc_id"] == F.col(kept), "left_semi")
    again = ids.where("n > 1").select(kept)
    if again.limit(1).count():
        marks = groups.where(first).select(F.col("doc_id").alias(kept), F.col(mark_name).alias(other_mark)).join(again, kept, "left_semi").distinct()
        rows = docs.join(again, docs["doc_id"] == F.col(kept), "left_semi").withColumn(own_mark, mark(F.col("text")))
        rows = rows.join(marks, (F.col("doc_id") == F.col(kept)) & (F.col(own_mark) == F.col(other_mark)), "left_semi")
        row, order = F.struct(*docs.columns), F.struct("text", F.to_json(F.struct(*docs.columns)))
        least = rows.groupBy("doc_id", own_mark).agg(F.min_by(row, order).alias(row_name))
        own = own.unionByName(least.select(f"{row_name}.*"))
    return own.unionByName(docs.where("doc_id is null"))


def unused(docs: DataFrame, *names: str) -> list[str]:
    """Names that docs has no columns of: these, with as many underscores before them as it takes."""
    longest = max(map(len, docs.columns), default=0)
    return ["_" * longest + name for name in names]
