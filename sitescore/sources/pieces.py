"""Files read piece by piece in Spark's own splits, where rows have their places in the file.

Spark gives a split's rows in file order, and the split's start. So one pass that leaves a row for
each split, and a running total over these rows, tells every split what came before it; a second
pass uses that. The table of splits is as long as the list of them that Spark's scheduler holds, so
it may be sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..operators.state import cut



def earlier(*by: str) -> WindowSpec:
    """The splits before one: by its start, files in the order of their paths, or in the same file only."""
    return Window.partitionBy(*by).orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)


def records(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(file, split, value) of the text between separators; a file's records that begin in one split come in order."""
    own = spark.read.option("lineSep", separator).text(path)
    return own.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")


def numbered_lines(spark: SparkSession, path: str, header: int = 0, comment: str | None = None) -> DataFrame:
    """(number, value) of the lines of path that aren't blank, from 0 in the order of the file, or of several files in
    that of their paths; each file's first `header` lines are left out, and what follows a comment sign.

    Two passes: the first counts the lines of each split, the second numbers them from where the splits
    before end. The same for any splits.
    """
    lines = records(spark, path, "\n")
    if comment is not None:
        lines = lines.withColumn("value", F.substring_index("value", comment, 1))
    lines = lines.where(F.trim(F.regexp_replace("value", "\r$", "")) != "")
    lines = lines.withColumn("place", F.monotonically_increasing_id())
    splits = cut(lines.groupBy("file", "split").agg(F.count("*").alias("n"), F.min("place").alias("first")))
    before = F.coalesce(F.sum("n").over(earlier("file")), F.lit(0))
    splits = splits.withColumn("before", before).withColumn("own", F.greatest(F.lit(0), F.col("n") - F.greatest(F.lit(0), header - F.col("before"))))
    splits = splits.withColumn("start", F.coalesce(F.sum("own").over(earlier()), F.lit(0)))
    placed = lines.join(F.broadcast(splits), ["file", "split"])
    at = F.col("place") - F.col("first") + F.col("before")
    skipped = F.least(F.col("n"), F.greatest(F.lit(0), header - F.col("before")))
    return placed.where(at >= header).select((F.col("start") + F.col("place") - F.col("first") - skipped).alias("number"), F.regexp_replace("value", "\r$", "").alias("value"))


def structure(data: bytes, quoted: bool, depth: int) -> tuple[list[int], bytes, list[int], bool]:
    """(places, characters, depth after each, whether the end is quoted) of the brackets, colons and commas outside strings."""
    b = np.frombuffer(data, np.uint8)
    quote = b == 34
    if 92 in data:
        at = np.arange(len(b))
        other = np.maximum.accumulate(np.where(b != 92, at, -1))
        slashes = at - 1 - np.concatenate([[-1], other[:-1]])  # just before
        quote &= slashes % 2 == 0
    inside = (np.cumsum(quote) + quoted) & 1
    places = np.flatnonzero(((b == 123) | (b == 125) | (b == 91) | (b == 93) | (b == 58) | (b == 44)) & (inside == 0))
    chars = b[places]
    step = ((chars == 123) | (chars == 91)).astype(int) - ((chars == 125) | (chars == 93))
    return places.tolist(), chars.tobytes(), (depth + np.cumsum(step)).tolist(), bool(inside[-1]) if len(b) else quoted


class Scanner:
    """Reads a split of JSON from left to right, with the objects that open at one level and the keys at depth 1."""

    def __init__(self, level: int, quoted: bool, depth: int):
        self.level, self.quoted, self.depth = level, quoted, depth
        self.parts, self.is_open, self.from_before = bytearray(), depth >= level, depth >= level
        self.tail, self.opened, self.key, self.keyed, self.text, self.before = None, 0, None, False, False, b""
        self.found: list[tuple[int, str | None, bytes]] = []  # (documents opened in this split, key, object)
        self.marks: list[tuple[int, str | None, str]] = []  # (documents, key, the scalar that follows), and one without a key as a document opens

    def read(self, data: bytes) -> None:
        places, chars, depths, quoted = structure(data, self.quoted, self.depth)
        begin, last = 0, 0
        self.text = self.text or bool(data.strip(b"} \t\r\n"))
        for n, (at, char, now) in enumerate(zip(places, chars, depths, strict=True)):
            if now < 0:  # a separator put after the end of the file
                depths[n:] = [0] * (len(depths) - n)
                break
            if char in b"{[":
                if now == 1:
                    self.opened, self.key, self.keyed = self.opened + 1, None, True
                    self.marks.append((self.opened, None, ""))
                if now == self.level:
                    self.is_open, begin = True, at
            elif char in b"}]" and now == self.level - 1 and self.is_open:
                self.parts += data[begin : at + 1]
                if self.from_before:
                    self.tail = bytes(self.parts)
                elif self.parts[:1] == b"{":
                    self.found.append((self.opened, self.key, bytes(self.parts)))
                self.is_open = self.from_before = False
                self.parts.clear()
            elif char == 58 and now == 1:  # a colon
                name = data[last:at] if n else self.before + data[:at]
                self.key, self.keyed = name.strip().strip(b'"').decode("utf-8", "replace"), True
                scalar = data[at + 1 : places[n + 1] if n + 1 < len(places) else len(data)]
                self.marks.append((self.opened, self.key, scalar.strip().decode("utf-8", "replace")))
            last = at + 1
        if self.is_open:
            self.parts += data[begin:]
        self.before = data[last:] if depths and depths[-1] == 1 else b""
        self.quoted, self.depth = quoted, depths[-1] if depths else self.depth


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[bytes]]]:
    """Each (file, split) of a partition's records(), with its bytes piece by piece."""
    pieces = ((key, data) for batch in batches for key, data in joined(batch))
    for key, own in groupby(pieces, itemgetter(0)):
        yield key, (data for _, data in own)


def joined(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], bytes]]:
    keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
    values = batch.column(2).cast(pa.binary()).to_pylist()
    for key, own in groupby(zip(keys, values, strict=True), itemgetter(0)):
        yield key, b"".join(v + b"}" for _, v in own)


class JsonFiles:
    """Files of JSON documents, one or many to a file, on one line or indented, read in splits of any number.

    The text between closing braces is what Spark reads as lines, so one long array is split as well as one long
    file of small documents. Three passes over the splits: quotes and brackets, which tell every split's depth at
    its start; keys and the objects that splits cut; the objects. A file that ends inside a document is an error.
    """

    def __init__(self, spark: SparkSession, path: str, level: int):
        self.spark, self.level = spark, level
        self.rows = records(spark, path, "}")
        first = self.rows.mapInArrow(outline, "file string, split long, quotes long, outside long, inside long")
        splits = cut(first)
        odd = F.coalesce(F.sum("quotes").over(earlier("file")), F.lit(0)) % 2
        splits = splits.withColumn("quoted", odd == 1).withColumn("change", F.when(F.col("quoted"), F.col("inside")).otherwise(F.col("outside")))
        depth = F.coalesce(F.sum("change").over(earlier("file")), F.lit(0)).alias("depth")
        starts = {(r["file"], r["split"]): (r["quoted"], r["depth"]) for r in splits.select("file", "split", "quoted", depth).collect()}
        self.starts = spark.sparkContext.broadcast(starts)
        self.second = cut(self._second())
        ends = self.second.where("kind = 'split'").groupBy("file").agg(F.max_by("depth", "split").alias("depth"))
        for r in ends.where("depth <> 0").limit(1).collect():
            raise ValueError(f"{r['file']} ends inside a document")
        changed = F.when(F.col("keyed"), F.struct("key"))
        self.splits = self.second.where("kind = 'split'").select("file", "split", F.coalesce(F.sum("opened").over(earlier("file")), F.lit(0)).alias("documents"), F.last(changed, True).over(earlier("file"))["key"].alias("key_before"))
        carried = {(r["file"], r["split"]): (r["documents"], r["key_before"]) for r in self.splits.collect()}
        self.carried = spark.sparkContext.broadcast(carried)

    def _second(self) -> DataFrame:
        starts, level = self.starts, self.level

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for key, pieces in runs(batches):
                scanner, rows, before = Scanner(level, *starts.value[key]), [], starts.value[key][1]
                inside = scanner.is_open
                for data in pieces:
                    scanner.read(data)
                    scanner.found.clear()
                    rows += [{"kind": "mark", "opened": d, "key": k, "scalar": v} for d, k, v in scanner.marks]
                    scanner.marks.clear()
                    if len(rows) > 10_000:
                        yield packed(key, rows)
                        rows = []
                if before == 0 and not scanner.opened and scanner.text:
                    rows.append({"kind": "mark", "opened": 0})  # no document at all
                rest = bytes(scanner.parts) if scanner.is_open else None
                head = rest is not None and not scanner.from_before
                rows.append({"kind": "split", "opened": scanner.opened, "key": scanner.key, "keyed": scanner.keyed, "depth": scanner.depth, "tail": (rest if scanner.from_before else scanner.tail) if inside else None, "head": rest if head else None})
                yield packed(key, rows)

        return self.rows.mapInArrow(run, "file string, split long, kind string, opened long, key string, keyed boolean, depth long, scalar string, head binary, tail binary")

    def documents(self, *keys: str) -> DataFrame:
        """(file, document, <key>, ...): the scalar text after each of these keys at depth 1, or null without it, of each
        document; a file without any document counts as one that has none of them."""
        marks = self.second.where("kind = 'mark'").join(F.broadcast(self.splits), ["file", "split"])
        marks = marks.withColumn("document", F.col("documents") + F.col("opened"))
        own = [F.max(F.when(F.col("key") == k, F.coalesce("scalar", F.lit("")))).alias(k) for k in keys]
        return marks.groupBy("file", "document").agg(*own)

    def objects(self, key: str | None = None) -> DataFrame:
        """(file, document, value): the text of each object at this level, below one key at depth 1 if it is named."""
        starts, carried, level = self.starts, self.carried, self.level

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for at, pieces in runs(batches):
                scanner, (documents, before) = Scanner(level, *starts.value[at]), carried.value[at]
                for data in pieces:
                    scanner.read(data)
                    scanner.marks.clear()
                    own = [(documents + d, v) for d, k, v in scanner.found if key is None or (before if d == 0 and k is None else k) == key]
                    scanner.found.clear()
                    if own:
                        yield pa.RecordBatch.from_arrays([pa.array([at[0]] * len(own)), pa.array([d for d, _ in own], pa.int64()), pa.array([v.decode("utf-8", "replace") for _, v in own])], ["file", "document", "value"])

        return self.rows.mapInArrow(run, "file string, document long, value string").union(self._cut(key))

    def _cut(self, key: str | None) -> DataFrame:
        """The objects that splits cut: each begins with the head that a split leaves open, and goes on with the tails of the next."""
        own = self.second.where("kind = 'split'").join(F.broadcast(self.splits), ["file", "split"])
        opens = F.col("head").isNotNull().cast("int")
        upto = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, 0)
        own = own.withColumn("number", F.sum(opens).over(upto))
        known = F.coalesce("key", F.when(F.col("opened") == 0, F.col("key_before")))
        heads = own.where("head is not null").select("file", "number", "split", F.col("head").alias("piece"), (F.col("documents") + F.col("opened")).alias("document"), known.alias("key"))
        none = [F.lit(None).cast(t).alias(c) for c, t in (("document", "long"), ("key", "string"))]
        tails = own.where("tail is not null").select("file", (F.col("number") - opens).alias("number"), "split", F.col("tail").alias("piece"), *none)
        by = heads.union(tails).groupBy("file", "number").agg(F.max("document").alias("document"), F.max("key").alias("key"), F.sort_array(F.collect_list(F.struct("split", F.col("document").isNull().alias("is_tail"), F.col("piece").cast("string").alias("piece")))).alias("pieces"))
        value = F.array_join(F.transform("pieces", lambda x: x["piece"]), "")
        by = by.where("document is not null").select("file", "document", "key", value.alias("value")).where(F.col("value").startswith("{"))
        return (by if key is None else by.where(F.col("key") == key)).select("file", "document", "value")


def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split its number of quotes, and how it changes the depth if it begins outside and inside a string."""
    for (file, split), pieces in runs(batches):
        quotes, change = False, [0, 0]
        for data in pieces:
            for other in (False, True):
                *_, depths, after = structure(data, quotes ^ other, 0)
                change[other] += depths[-1] if depths else 0
                last = after ^ other
            quotes = last
        yield pa.RecordBatch.from_pylist([{"file": file, "split": split, "quotes": int(quotes), "outside": change[0], "inside": change[1]}])


SECOND = pa.schema([("file", pa.string()), ("split", pa.int64()), ("kind", pa.string()), ("opened", pa.int64()), ("key", pa.string()), ("keyed", pa.bool_()), ("depth", pa.int64()), ("scalar", pa.string()), ("head", pa.binary()), ("tail", pa.binary())])


def packed(key: tuple[str, int], rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"file": key[0], "split": key[1], **r} for r in rows], SECOND)
