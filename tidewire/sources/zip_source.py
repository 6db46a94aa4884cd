"""Zipped drops as a Spark data source, for batch reads and streams.

``spark.dataSource.register(ZipDrops)``, then ``spark.read.format("zipped_drops").load(folder)`` or
``spark.readStream.format("zipped_drops").load(folder)``.  Rows are lines with their drop and its
status, as ``gkg.read_drop_lines`` gives them.

* A partition holds drops of ``bytesPerPartition`` together, so many small drops don't become
  as many tasks, and fewer where that would leave cores idle: zipped bytes are a tenth of the lines'.
* A stream's offset is the stamp of the last drop that it has seen: a micro-batch takes the drops after it.
  Drops stay in their folder.  Drops without a stamp in their name, and drops that appear later than a
  newer one, are not for the stream; the batch form (``gkg.ingest_missing``) finds those.
* A zip is read as a stream twice: once to check the rules that hold for the whole file (field
  counts, UTF-8), once to hand on its lines, so a task holds one block of ``BLOCK`` bytes and one batch of lines.

Folders are listed with pyarrow's file systems (local, HDFS, S3, ...).
"""

from __future__ import annotations

import re
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .. import schema as S
from ..functions import text as X
from . import gkg

NAME = "zipped_drops"
BYTES_PER_PARTITION = 64 << 20
#: Bytes of a zip's end record; a shorter file is none (and can't be searched for one).
SHORTEST_ZIP = 22
#: Bytes of lines that are decoded and split together.
BLOCK = 1 << 20
STAMP = re.compile(r"(\d{14})")
ARROW = pa.schema([("file_path", pa.string()), ("status", pa.string()), ("line_no", pa.int64()), ("line", pa.string())])


class Drops(InputPartition):
    def __init__(self, uri: str, paths: list[str]):
        self.uri, self.paths = uri, paths


def _open_fs(uri: str):
    import pyarrow.fs as pafs
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def listed(uri: str) -> list[tuple[str, int]]:
    """(path, bytes) of the zip files below a folder, in order of their names."""
    import pyarrow.fs as pafs
    fs, inner = _open_fs(uri)
    infos = fs.get_file_info(pafs.FileSelector(inner, recursive=True, allow_not_found=True))
    hidden = lambda p: any(x.startswith(("_", ".")) for x in p[len(inner):].split("/"))
    return sorted((i.path, i.size) for i in infos if i.is_file and i.path.endswith(".zip") and not hidden(i.path))


def packed(uri: str, files: list[tuple[str, int]], limit: int) -> list[Drops]:
    out: list[Drops] = []
    held = limit
    for path, size in files:
        if held + size > limit or not out:
            out.append(Drops(uri, []))
            held = 0
        out[-1].paths.append(path)
        held += size
    return out


def stamp_of(path: str) -> str | None:
    m = STAMP.search(path.rsplit("/", 1)[-1])
    return m[1] if m else None


def spread(files: list[tuple[str, int]], limit: int, tasks: int) -> int:
    """The bytes of a partition: ``limit``, or less so that there is one for each of the tasks."""
    return max(1, min(limit, sum(n for _, n in files) // max(1, tasks)))


def _blocks(z: zipfile.ZipFile, name: str) -> Iterator[list[str]]:
    """Whole lines of about BLOCK bytes together; only \\n ends a line, with an optional \\r before it."""
    with z.open(name) as f:
        held: list[bytes] = []
        while block := f.read(BLOCK):
            cut = block.rfind(b"\n") + 1
            if cut:
                yield _split(b"".join((*held, block[: cut - 1])))
                held = []
            held.append(block[cut:])
        if rest := b"".join(held):
            yield _split(rest)


def _split(block: bytes) -> list[str]:
    text = block.decode("utf-8")
    lines = text.split("\n")
    return [x.removesuffix("\r") for x in lines] if "\r" in text else lines


def check(z: zipfile.ZipFile) -> tuple[str, int]:
    """(status, lines without the empty ones at the end) of a drop, by one pass over it."""
    names = z.namelist()
    if not names:
        return "empty_zip", 0
    counts: set[int] = set()
    total, empty = 0, 0
    try:
        for lines in _blocks(z, names[0]):
            total += len(lines)
            full = {x.count("\t") + 1 for x in lines if x}
            if not full:
                empty += len(lines)
                continue
            ending = 0
            while not lines[-1 - ending]:
                ending += 1
            # an empty line inside has one field
            counts |= full | ({1} if empty or "" in lines[: len(lines) - ending] else set())
            empty = ending
    except UnicodeDecodeError:
        return "invalid_utf8", 0
    if total == empty:
        return "empty", 0
    if len(counts) > 1:
        return "ragged", 0
    return ("ok", total - empty) if counts.pop() >= gkg.EXPECTED_FIELDS else ("too_few_columns", 0)


def read_drop(fs, path: str, shown: str) -> Iterator[pa.RecordBatch]:
    """The lines of one drop in batches; a rejected one gives a single row with its status."""
    try:
        with fs.open_input_file(path) as f:
            f.seek(0, 2)
            if f.tell() < SHORTEST_ZIP:
                raise zipfile.BadZipFile
            z = zipfile.ZipFile(f)
            status, n = check(z)
            if status == "ok":
                held: list[str] = []
                done = 0
                for lines in _blocks(z, z.namelist()[0]):
                    held += lines[: n - done - len(held)]
                    while len(held) >= gkg.LINES_PER_BATCH or held and done + len(held) == n:
                        part, held = held[: gkg.LINES_PER_BATCH], held[gkg.LINES_PER_BATCH :]
                        k = len(part)
                        yield pa.RecordBatch.from_arrays([pa.array([shown] * k), pa.array(["ok"] * k), pa.array(range(done, done + k), pa.int64()), pa.array(part, pa.string())], schema=ARROW)
                        done += k
                return
    except (zipfile.BadZipFile, zlib.error, EOFError):
        status = "bad_zip"
    yield pa.RecordBatch.from_arrays([pa.array([shown]), pa.array([status]), pa.array([None], pa.int64()), pa.array([None], pa.string())], schema=ARROW)


class _Reading:
    """Options and the reading of a partition, for batch and stream alike."""

    def __init__(self, options):
        self.uri = options["path"]
        self.limit = int(options.get("bytesPerPartition", BYTES_PER_PARTITION))
        self.tasks = int(options.get("minPartitions", 1))

    def packed(self, files: list[tuple[str, int]]) -> list[Drops]:
        return packed(self.uri, files, spread(files, self.limit, self.tasks))

    def read(self, partition: Drops) -> Iterator[pa.RecordBatch]:
        fs, _ = _open_fs(partition.uri)
        for path in partition.paths:
            yield from read_drop(fs, path, f"file:{path}" if fs.type_name == "local" else path)


class ZipReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Drops]:
        return self.packed(listed(self.uri)) or [Drops(self.uri, [])]


class ZipStreamReader(_Reading, DataSourceStreamReader):
    def __init__(self, options):
        super().__init__(options)
        self.at = ""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"stamp": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        stamps = [s for p, _ in listed(self.uri) if (s := stamp_of(p))]
        self.at = max(stamps + [self.at])
        return {"stamp": self.at}

    def partitions(self, start: dict, end: dict) -> list[Drops]:
        self.at = max(self.at, end["stamp"])
        files = [(p, n) for p, n in listed(self.uri) if (s := stamp_of(p)) and start["stamp"] < s <= end["stamp"]]
        return self.packed(files)

    def commit(self, end: dict) -> None:
        """The stream's checkpoint holds the offset; drops stay where they are."""


class ZipDrops(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "file_path string, status string, line_no long, line string"

    def reader(self, schema) -> ZipReader:
        return ZipReader(self.options)

    def streamReader(self, schema) -> ZipStreamReader:  # noqa: N802
        return ZipStreamReader(self.options)


def parsed(lines: DataFrame) -> DataFrame:
    """S1 + S2 + X2: records of the good drops among the source's lines."""
    raw = gkg.split_fields(lines.where(F.col("status") == "ok"))
    date = F.coalesce(gkg.stamp_from_path(F.col("file_path")), X.record_time(F.col(S.RID)))
    return raw.select(*[F.col(f"`{c}`") for c in S.PARSED_COLUMNS], date.alias(S.DATE))


def _options(spark: SparkSession, options: dict) -> dict:
    """A partition for each core unless the caller asks for another number."""
    return {"minPartitions": spark.sparkContext.defaultParallelism, **options}


def read_zipped(spark: SparkSession, folder: str, **options) -> DataFrame:
    spark.dataSource.register(ZipDrops)
    return parsed(spark.read.format(NAME).options(**_options(spark, options)).load(folder))


def stream_zipped(spark: SparkSession, folder: str, **options) -> DataFrame:
    spark.dataSource.register(ZipDrops)
    return parsed(spark.readStream.format(NAME).options(**_options(spark, options)).load(folder))
