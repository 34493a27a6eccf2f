"""Incremental merge of growing sample files."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..sources.records import checkpoint_objective

#: Bytes of a file that are read at once, and bytes that a task reads.
STEP, RANGE = 1 << 20, 64 << 20


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system that a URI names, and the path there; a bare path is local."""
    if uri.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pa.fs.FileSystem.from_uri(uri)


@dataclass
class Piece(InputPartition):
    """The lines of a file that begin in its bytes [start, end); the first byte begins one if begins says so."""

    name: str
    start: int
    end: int
    begins: bool = True


class LinesReader(DataSourceStreamReader):
    """The offset has, for each file, the bytes of the whole lines read so far."""

    def __init__(self, options: dict[str, str]):
        self.folder, self.range = options["path"], int(options.get("range", RANGE))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Where each file's last whole line ends now; a line without its end waits for it."""
        fs, folder = filesystem(self.folder)
        found = fs.get_file_info(pa.fs.FileSelector(folder, allow_not_found=True))
        return {x.base_name: self._end(fs, x.path, x.size) for x in found if x.is_file and x.base_name[0] not in "._"}

    @staticmethod
    def _end(fs: pa.fs.FileSystem, path: str, size: int) -> int:
        with fs.open_input_file(path) as f:
            while size:
                start = max(0, size - STEP)
                f.seek(start)
                at = f.read(size - start).rfind(b"\n")
                if at >= 0:
                    return start + at + 1
                size = start
        return 0

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        """What is new of each file, in ranges of a bounded length."""
        new = [(name, start.get(name, 0), to) for name, to in sorted(end.items()) if to > start.get(name, 0)]
        return [Piece(name, at, min(at + self.range, to), at == first) for name, first, to in new for at in range(first, to, self.range)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        """A line that a range's end cuts is read to its end here, and left out by the next range."""
        fs, folder = filesystem(self.folder)
        with fs.open_input_file(f"{folder}/{partition.name}") as f:
            at = partition.start
            if not partition.begins:
                at = self._next(f, at - 1)
            f.seek(at)
            rest = b""
            while at < partition.end:
                data = f.read(min(STEP, partition.end - at))
                at += len(data)
                *lines, rest = (rest + data).split(b"\n")
                yield self._batch(lines)
            if rest:
                end = self._next(f, at)
                f.seek(at)
                yield self._batch([(rest + f.read(end - at)).removesuffix(b"\n")])

    @staticmethod
    def _next(f: pa.NativeFile, at: int) -> int:
        """Where the line after the one that holds the byte at begins."""
        f.seek(at)
        while data := f.read(STEP):
            found = data.find(b"\n")
            if found >= 0:
                return at + found + 1
            at += len(data)
        return at

    @staticmethod
    def _batch(lines: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x.decode("utf-8", "replace") for x in lines], pa.string())], ["value"])


class LinesDataSource(DataSource):
    """spark.readStream.format("growing_lines").load(folder): (value) for each line, once, also of files that grow;
    the option range has the bytes that a task reads."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "value string"

    def streamReader(self, schema: StructType) -> LinesReader:
        return LinesReader(dict(self.options))


def merge_rank_files_stream(spark: SparkSession, in_dir: str, out: str, checkpoint: str, range_bytes: int = RANGE) -> DataFrame:
    """Bring each line of the files in in_dir that out doesn't have yet to out, once, and return out.

    The stream's checkpoint keeps the place reached in each file, so new files and new lines of known
    files are read, a repeated call adds nothing, and a call that was interrupted goes on where it
    stopped. A task reads range_bytes of a file, so a long one is read by many. Files may only grow; a last line without its end is read once it has one.
    """
    spark.dataSource.register(LinesDataSource)
    lines = spark.readStream.format("growing_lines").option("range", range_bytes).load(in_dir)
    rows = lines.where(F.trim("value") != "").select(checkpoint_objective(F.col("value")).alias("logdet"))
    query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("logdet double").parquet(out)
