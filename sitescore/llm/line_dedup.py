"""Line deduplication over a corpus, in DataFrame functions only; returns bitmaps instead of texts.

The hashes of all lines are range-partitioned and sorted by hash, document and position, so that a
line's occurrences stream by with its first document in front, and every later document's are
dropped. What is dropped comes back to its document as a compressed bitmap of the lines to keep.

A line in very many documents would fill one range. The commonest lines of a sample are therefore
taken out: their first documents come from an aggregate, and they are dropped where they are read.
The sample decides on the way only, never on the result.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

#: Shorter keys stay; what is stripped from both ends of a line.
MIN_CHARS, STRIPPED = 10, " \t\n\x0b\f\r"
#: About so many documents are sampled; a line in so many of them is a common one; the commonest so many at most.
SAMPLE_ROWS, COMMON_FROM, MOST_COMMON = 20_000, 10, 1_000
#: Bitmaps are broadcast to the texts up to this many bytes; beyond it, texts and bitmaps are shuffled.
BROADCAST_BYTES = 32 << 20
LAST = (1 << 63) - 1


def lines(text: Column) -> Column:
    """The lines of a text; a null or empty one has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def key(line: Column) -> Column:
    """A line without white space at both ends, A-Z lower-cased."""
    line = F.btrim(line, F.lit(STRIPPED))
    return F.when(F.length(line) == F.octet_length(line), F.lower(line)).otherwise(F.translate(line, ascii_uppercase, ascii_lowercase))


def hashed(docs: DataFrame) -> DataFrame:
    """(doc, row, pos, h1, h2) for each line of docs(doc_id, text) whose key is long enough: 128 bits of hash of its key;
    doc and row know a row of docs again."""
    own = docs.select(doc(), row(), F.posexplode(F.transform(lines(F.col("text")), key)).alias("pos", "key"))
    return own.where(F.length("key") >= MIN_CHARS).select("doc", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def doc() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc")


def row() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("row")


def common_lines(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, most: int = MOST_COMMON) -> DataFrame:
    """(h1, h2) of the commonest lines of a sample of docs, most of them at most."""
    share = min(1.0, sample_rows / max(1, docs.count()))
    found = hashed(docs.sample(share, seed=7)).groupBy("h1", "h2").count().where(F.col("count") >= COMMON_FROM)
    return checkpoint(found.orderBy(F.desc("count"), "h1", "h2").limit(most).select("h1", "h2"))


def dropped_lines(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, most: int = MOST_COMMON) -> DataFrame:
    """(doc, row, pos) of each line that an earlier document has, too."""
    every, common = hashed(docs), F.broadcast(common_lines(docs, sample_rows, most))
    first = every.join(common, ["h1", "h2"]).groupBy("h1", "h2").agg(F.min("doc").alias("first"))
    own = every.join(F.broadcast(checkpoint(first)), ["h1", "h2"]).where("doc > first").select("doc", "row", "pos")
    rest = every.join(common, ["h1", "h2"], "left_anti").repartitionByRange("h1", "h2")
    seen = Window.partitionBy("h1", "h2").orderBy("doc", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return own.union(rest.withColumn("first", F.first("doc").over(seen)).where("doc > first").select("doc", "row", "pos"))


def keep_bitmaps(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, most: int = MOST_COMMON) -> DataFrame:
    """(doc, row, n_dropped, keep) of each row of docs(doc_id, text, ...) that loses lines.

    keep is a compressed bitmap of the lines that stay: an array of (at, bits), ascending, bit b of
    bits standing for line 64 * at + b. Words of 64 lines that all stay are left out. doc is the doc_id (the
    greatest long for null) and row the XXH64 of the text (null: empty), which rows of equal id and text share.
    """
    bit = F.expr("bit_or(shiftleft(1L, pos & 63))").alias("bits")
    words = dropped_lines(docs, sample_rows, most).groupBy("doc", "row", F.shiftright("pos", 6).alias("at")).agg(bit)
    word = F.struct("at", F.bitwise_not("bits").alias("bits"))
    return words.groupBy("doc", "row").agg(F.sum(F.bit_count("bits")).alias("n_dropped"), F.sort_array(F.collect_list(word)).alias("keep"))


def kept_text(text: Column, keep: Column) -> Column:
    """The lines of a text that its bitmap keeps, joined by \\n; all of them where keep is null."""
    gone = F.flatten(F.transform(keep, lambda w: F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.call_function("shiftright", w["bits"], b).bitwiseAND(1) == 0), lambda b: 64 * w["at"] + b)))
    own = lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), gone), lambda i: F.get(x, i))
    return F.when(keep.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.transform(F.array(lines(text)), own)[0], "\n"))


def deduplicated(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, most: int = MOST_COMMON, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row (doc_id, n_lines, n_dropped, keep, kept) for each row of docs(doc_id, text, ...): the lines before and those
    dropped (longs), the bitmap of keep_bitmaps() or null if all stay, and the lines that stay, joined by \\n.

    A line's key is the line stripped of white space and with A-Z lower-cased. Keys of MIN_CHARS code
    points or more that several doc_ids hold stay with the smallest of them only, there as often as it has
    them. Rows without a doc_id count as one document after all others. A null or empty text has one empty line,
    which stays; texts of any length are split whole. Repeated rows come back as often as they came. An
    empty table gives none; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    maps = checkpoint(keep_bitmaps(docs, sample_rows, most))
    size = maps.agg(F.coalesce(F.sum(64 + 16 * F.size("keep")), F.lit(0))).first()[0]
    own = docs.select("doc_id", "text", doc(), row()).join(F.broadcast(maps) if size <= broadcast_bytes else maps, ["doc", "row"], "left")
    n = F.size(lines(F.col("text"))).cast("long").alias("n_lines")
    return own.select("doc_id", n, F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), "keep", kept_text(F.col("text"), F.col("keep")).alias("kept"))


#: The same in DuckDB.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
l AS (SELECT rid, doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
m AS (SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS gone FROM k)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid
"""
