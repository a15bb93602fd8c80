"""Where rows of raw files stand: capture order of any file scan, and JSON lines by file and line number.

Raw captures carry no row number. What tells their order is the file, the place of the split in it, and the place of
the row in the split; counts per split turn these into positions that do not depend on how files were split.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.distributed import running_totals

#: Split tables of up to so many rows, some 100 bytes each, are broadcast; larger ones are joined by shuffles.
BROADCAST_SPLITS = 500_000
BLOCK = 1 << 20


def _with_offsets(rows: DataFrame, splits: DataFrame, by_file: bool) -> DataFrame:
    """``rows`` with ``_n``, ``_first`` and ``_before`` (rows of earlier splits, of the same file or of all) of their split.

    ``splits`` has ``_file``, ``_split``, ``_n``, ``_first``, one row per split.
    """
    by = ["_file"] if by_file else []
    ordered = splits.withColumn("_place", F.struct("_file", "_split"))
    offsets = running_totals(ordered, "_place", ["_n"], by).select(
        F.col("_place._file").alias("_file"), "_split", "_n", "_first", F.col("_n_before").alias("_before"))
    few = offsets.count() <= BROADCAST_SPLITS
    return rows.join(F.broadcast(offsets) if few else offsets, ["_file", "_split"])


def capture_order(scan: DataFrame, out: str = "capture_order", file: str | None = None) -> DataFrame:
    """Add the position of every row in capture order: from 0, files by path, rows as they stand in them.

    ``scan`` is what a file source returns, before any filter; every other column stays. With ``file`` the
    path of the row's file is added as well. Rows are never sorted or shuffled: a row's place in its split is
    its number in the task less that of the split's first row, and one pass counts the rows of each split. Both passes
    must see the same splits; a row that does not fit the counts, because files changed in between, fails
    the job. The header of a CSV file is no row; a record over several lines is one row.
    """
    rows = scan.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_at"))
    splits = rows.groupBy("_file", "_split").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    told = _with_offsets(rows, splits, by_file=False)
    place = F.col("_at") - F.col("_first")
    fits = (place >= 0) & (place < F.col("_n"))
    position = F.when(fits, F.col("_before") + place).otherwise(F.raise_error(F.lit("files changed while they were read")))
    return told.select(*scan.columns, position.cast("long").alias(out), *([F.col("_file").alias(file)] if file else []))


# --- lines -------------------------------------------------------------------------------------------
class Range(InputPartition):
    """Bytes ``start`` to ``end`` of a file. A line belongs to the range that holds its first byte."""

    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


def _open(file: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(file)
    return system.open_input_file(path)


def _lines(part: Range) -> Iterator[bytes]:
    """The lines that begin in a range, without their line end, read a block at a time."""
    with _open(part.file) as stream:
        size = stream.size()
        at, held, skip = part.start, b"", False
        if at > 0:
            stream.seek(at - 1)
            skip = stream.read(1) != b"\n"  # the first line began before
        begin = at
        while at < size and (begin < part.end or skip):
            block = stream.read(BLOCK)
            if not block:
                break
            at += len(block)
            pieces = (held + block).split(b"\n")
            held = pieces.pop()
            if skip and not pieces:  # still inside the line that began before
                begin, held = begin + len(held), b""
            for piece in pieces:
                if skip:
                    skip = False
                elif begin < part.end:
                    yield piece.removesuffix(b"\r")
                begin += len(piece) + 1
            if begin >= part.end and not skip:
                return
        if held and not skip and begin < part.end:
            yield held.removesuffix(b"\r")


class NumberedLines(DataSource):
    """Lines of text files in splits of bytes: ``file``, ``split`` (its first byte), ``row`` (from 0, in the split), ``value``.

    Options: ``path`` (a file, or a folder whose files are taken by name; a URI, or a local path), ``split_bytes``, and
    ``limit``: the first so many lines of all files. For a limit the planner looks for the end of its last line, block by
    block, and no split reaches beyond, so what follows is never read. ``count`` as ``true`` returns, in place of
    the lines, one row per split with its number of lines in ``row`` and a null ``value``.
    """

    @classmethod
    def name(cls) -> str:
        return "numbered_lines"

    def schema(self) -> str:
        return "file string, split long, row long, value string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return LineReader(self.options)


class LineReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.size = options["path"], int(options.get("split_bytes", 128 << 20))
        self.limit = int(options["limit"]) if options.get("limit") else None
        self.count = options.get("count", "false") == "true"

    def _files(self) -> list[tuple[str, int]]:
        from pyarrow import fs

        path = self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}"
        system, place = fs.FileSystem.from_uri(path)
        root = path[:len(path) - len(place)] if path.endswith(place) else "file://"
        told = system.get_file_info([place])[0]
        found = [told] if told.is_file else system.get_file_info(fs.FileSelector(place, recursive=True))
        names = [f for f in found if f.is_file and f.size and not f.base_name.startswith(("_", "."))]
        return sorted((root + f.path, f.size) for f in names)

    def partitions(self) -> list[Range]:
        parts, left = [], self.limit
        for file, size in self._files():
            if left is not None:
                if left <= 0:
                    break
                size, found = self._end_of(file, left)
                left -= found
            parts += [Range(file, at, min(at + self.size, size)) for at in range(0, size, self.size)]
        return parts or [Range("", 0, 0)]

    @staticmethod
    def _end_of(file: str, limit: int) -> tuple[int, int]:
        """(first byte behind the first ``limit`` lines of a file, lines up to there)."""
        found, at = 0, 0
        with _open(file) as stream:
            size, last = stream.size(), b""
            while block := stream.read(BLOCK):
                here = block.count(b"\n")
                if found + here >= limit:
                    place = -1
                    for _ in range(limit - found):
                        place = block.index(b"\n", place + 1)
                    return at + place + 1, limit
                found, at, last = found + here, at + len(block), block[-1:]
        return size, found + (last != b"\n")

    def read(self, part: Range) -> Iterator[tuple]:
        if not part.file:
            return
        if self.count:
            yield part.file, part.start, sum(1 for _ in _lines(part)), None
            return
        for row, value in enumerate(_lines(part)):
            yield part.file, part.start, row, value.decode("utf-8", "replace")


def read_numbered_lines(spark: SparkSession, path: str, limit: int | None = None, split_bytes: int = 128 << 20) -> DataFrame:
    """``file``, ``line`` (from 1) and ``value`` of the lines of a file or folder, or of its first ``limit`` lines.

    One pass counts the lines of every split, so that a line knows its number whatever the splits are.
    """
    spark.dataSource.register(NumberedLines)
    reader = spark.read.format(NumberedLines.name()).option("path", path).option("split_bytes", split_bytes)
    reader = reader if limit is None else reader.option("limit", limit)
    rows = reader.load().select(F.col("file").alias("_file"), F.col("split").alias("_split"), "row", "value")
    counts = reader.option("count", "true").load().select(
        F.col("file").alias("_file"), F.col("split").alias("_split"), F.col("row").alias("_n"), F.lit(0).alias("_first"))
    told = _with_offsets(rows, counts, by_file=True)
    return told.select(F.col("_file").alias("file"), (F.col("_before") + F.col("row") + 1).alias("line"), "value")


def read_numbered_jsonl(
    spark: SparkSession, path: str, schema: T.StructType, limit: int | None = None, split_bytes: int = 128 << 20,
) -> tuple[DataFrame, DataFrame]:
    """(good rows with ``file`` and ``line``, rejects: ``file``, ``line``, ``value``) of JSON lines.

    Blank lines count as lines and are neither. A reject is a line that is no JSON object of the schema's types. ``limit``
    counts lines, and nothing behind them is read.
    """
    corrupt = "_corrupt_record"
    wide = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    lines = read_numbered_lines(spark, path, limit, split_bytes).where(F.length(F.trim("value")) > 0)
    parsed = lines.withColumn("_r", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}))
    bad = F.col(f"_r.{corrupt}").isNotNull() | F.col("_r").isNull()
    good = parsed.where(~bad).select(*[F.col("_r")[f.name].alias(f.name) for f in schema.fields], "file", "line")
    return good, parsed.where(bad).select("file", "line", "value")


def describe_reject(row) -> str:
    """``file:line`` and the beginning of a rejected line, for an error message."""
    return f"{row['file']}:{row['line']}: {json.dumps(row['value'][:80])}"
