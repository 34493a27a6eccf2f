"""Token counts by a separator scan over flat token files.

A token file is a run of two-byte little-endian token ids, each document followed by the
end-of-document id; there is no index. Files are read in blocks of fixed size, spread over the
cluster; each block is searched for the id at once, and a running maximum over the blocks of a
file tells each block where the document that it starts in began.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import filesystem, shared_path

#: The id after the byte_bpe_50k vocabulary, which its file leaves free.
END = 50_256
WIDTH = 2
BLOCK_BYTES = 8 << 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@cache
def encoder(vocabulary: str):
    import public_tokenizers
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None) -> None:
    """Write one flat token file for each partition of docs(text, ...), in its order.

    Spark's text writer puts the line separator after each row as it is, so a row is a document's
    ids and the separator is END. A null text has no tokens.
    """
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                texts = batch.column(0).slice(lo, 512).to_pylist()
                ids = [np.array(encode(t or ""), "<u2").tobytes() for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], ["value"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    rows.write.option("lineSep", END.to_bytes(WIDTH, "little").decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


def blocks(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, size, start, length) of the blocks of the token files in path, whatever their number."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("size")).where("size > 0")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block_bytes).cast("long")))
    cut = files.select("file", "size", starts.alias("start"))
    return cut.select("file", "size", "start", F.least(F.lit(block_bytes).cast("long"), F.col("size") - F.col("start")).alias("length")).repartition("file", "start")


def separators(spark: SparkSession, path: str, end: int = END, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, start, ends): for each block the places, in tokens from the file's start, of the ids that end a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, name = filesystem(row["file"])
                with fs.open_input_file(name) as f:
                    f.seek(row["start"])
                    ids = np.frombuffer(f.read(row["length"]), "<u2")
                at = np.flatnonzero(ids == end) + row["start"] // WIDTH
                yield pa.RecordBatch.from_arrays([pa.array([row["file"]]), pa.array([row["start"]]), pa.array([at.tolist()], pa.list_(pa.int64()))], ["file", "start", "ends"])

    if block_bytes % WIDTH:
        raise ValueError("a block must hold whole tokens")
    return blocks(spark, path, block_bytes).mapInArrow(run, "file string, start long, ends array<long>")


def document_lengths(spark: SparkSession, path: str, end: int = END, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, ordinal, n_tokens) for each document in the token files: its number in the file, from 0,
    and its length without the separator. Tokens after the last separator belong to no document.

    The window runs over the blocks of one file (a row for each block, not each document).
    """
    found = separators(spark, path, end, block_bytes)
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    stitched = found.withColumn("last", F.coalesce(F.max(F.get("ends", F.size("ends") - 1)).over(before), F.lit(-1).cast("long")))
    stitched = stitched.withColumn("first", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).cast("long"))
    lengths = F.transform("ends", lambda x, i: F.struct((F.col("first") + i).alias("ordinal"), (x - F.when(i == 0, F.col("last")).otherwise(F.get("ends", i - 1)) - 1).alias("n_tokens")))
    return stitched.select("file", F.inline(lengths))


def token_counts(docs: DataFrame, vocabulary: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row (doc_id, n_tokens) for each row of docs(doc_id, text, ...), counted in token files.

    The files are written in the order of docs' partitions, and the n-th document of partition p is
    the n-th of the file part-p; so docs must come out in the same order twice, as a scan of files
    does. A number of documents other than that written raises an error. Null and empty texts have
    0 tokens. Repeated rows come back as often as they came; other columns are ignored.
    """
    spark = docs.sparkSession
    path = shared_path(spark, "tokens")
    write_tokens(docs, path, vocabulary)
    place = F.monotonically_increasing_id()
    ids = docs.select("doc_id", F.shiftright(place, 33).alias("part"), place.bitwiseAND((1 << 33) - 1).alias("ordinal"), F.lit(True).alias("known"))
    part = F.regexp_extract("file", r"part-(\d+)", 1).cast("long").alias("part")
    found = document_lengths(spark, path, END, block_bytes).select(part, "ordinal", "n_tokens")
    out = ids.join(found, ["part", "ordinal"], "full_outer")
    whole = F.col("n_tokens").isNotNull() & F.col("known").isNotNull()
    return out.select("doc_id", F.when(whole, F.col("n_tokens")).otherwise(F.raise_error(F.lit("documents and token files differ")).cast("long")).alias("n_tokens"))
