"""A data source for logs of frames: JSON lines, one file for each log, one frame on each line.

``spark.read.format("frames")`` splits files into byte ranges, so a task holds a block of lines and never a whole log; a line
belongs to the range in which it begins. Filters on the log's name choose the files, filters on the other columns of
PUSHED drop rows in the task, before they go to the JVM; only the columns of the schema are decoded. As a stream
(``spark.readStream.format("frames")``) it follows logs that are appended to, up to their last whole line.

Besides the columns of the lines the schema may name ``log_name`` (the name of the file without its ending, or of its
folder ``log_name=...``) and ``position`` (the byte at which the line begins, which orders the frames of a file).
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.json as pj
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes in a range, and the bytes that a task reads at once.
RANGE, BLOCK = 32 << 20, 4 << 20
OWN = ("log_name", "position")
DEFAULT = "log_name string, position long, token string"
#: Columns whose filters the source applies by itself.
PUSHED = ("log_name", "token")


class Range(InputPartition):
    """Lines that begin from byte ``begin`` up to, without, byte ``end`` of a file."""

    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def log_of(path: str) -> str:
    """The log that a file belongs to."""
    *folders, name = path.split("/")
    named = [f.removeprefix("log_name=") for f in folders if f.startswith("log_name=")]
    return unquote(named[-1]) if named else name.split(".")[0]


def files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of all files below a folder, or of the one file, in the order of their names; hidden ones are left out."""
    system, root = opened(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
    hidden = lambda p: any(part.startswith(("_", ".")) for part in p[len(root) :].split("/"))
    return sorted((f.path, f.size) for f in found if f.is_file and f.size and (info.is_file or not hidden(f.path)))


def last_line_end(system: fs.FileSystem, path: str, size: int, least: int = 0) -> int:
    """The byte behind the last line feed before ``size``, or ``least`` if there is none behind it."""
    with system.open_input_file(path) as f:
        while size > least:
            begin = max(least, size - BLOCK)
            f.seek(begin)
            at = f.read(size - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            size = begin
    return least


def blocks(f, begin: int, end: int, block: int) -> Iterator[tuple[int, bytes]]:
    """(position, bytes) of whole lines that begin in the range, some ``block`` bytes at a time."""
    if begin:  # the line that holds the byte before belongs to an earlier range
        f.seek(begin - 1)
        at = begin - 1
        while True:
            got = f.read(block)
            if not got:
                return
            cut = got.find(b"\n")
            if cut >= 0:
                begin = at + cut + 1
                break
            at += len(got)
    f.seek(begin)
    rest = []
    at = held = begin
    while held < end:
        got = f.read(min(block, end - at) if at < end else block)
        at += len(got)
        cut = len(got) if not got else got.rfind(b"\n") + 1
        if at >= end and got:  # only the line that is open at the range's end goes on
            inside = max(0, end - (at - len(got)))
            cut = inside if inside and got[inside - 1 : inside] == b"\n" else got.find(b"\n", inside) + 1
        if cut or not got:
            whole = b"".join([*rest, got[:cut]])
            if whole:
                yield held, whole
            held += len(whole)
            rest = [got[cut:]]
        else:
            rest.append(got)
        if not got:
            return


def decoded(path: str, position: int, text: bytes, schema: pa.Schema, wanted: dict[str, set]) -> pa.RecordBatch | None:
    """The lines as a batch of the schema, without rows that the filters do not want. Lines of white space are no frames."""
    starts, at = [], 0
    for line in text.split(b"\n"):
        if line.strip():
            starts.append(position + at)
        at += len(line) + 1
    if not starts:
        return None
    fields = [f for f in schema if f.name not in OWN]
    options = pj.ParseOptions(explicit_schema=pa.schema(fields), unexpected_field_behavior="ignore")
    if fields:
        body = pj.read_json(io.BytesIO(text), read_options=pj.ReadOptions(use_threads=False, block_size=len(text) + 1), parse_options=options)
        if body.num_rows != len(starts):
            raise ValueError(f"{path}: {body.num_rows} frames on {len(starts)} lines from byte {position}")
    own = {"log_name": lambda: pa.array([log_of(path)] * len(starts)), "position": lambda: pa.array(starts, pa.int64())}
    out = pa.Table.from_arrays([(own[f.name]() if f.name in OWN else body[f.name]).cast(f.type) for f in schema], schema=schema)
    for name, values in wanted.items():
        if name not in OWN:
            out = out.filter(pc.is_in(out[name], pa.array(sorted(values), out.schema.field(name).type)))
    return out.combine_chunks().to_batches()[0] if out.num_rows else None


class Frames:
    """What the readers of tables and streams share: reading one range."""

    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.range, self.block = int(options.get("rangeBytes", RANGE)), int(options.get("blockBytes", BLOCK))
        self.wanted: dict[str, set] = {}

    def ranges(self, path: str, begin: int, end: int) -> list[Range]:
        return [Range(path, at, min(at + self.range, end)) for at in range(begin, end, self.range)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.schema)
        system, _ = opened(self.path)
        with system.open_input_file(partition.path) as f:
            for position, text in blocks(f, partition.begin, partition.end, self.block):
                batch = decoded(partition.path, position, text, schema, self.wanted)
                if batch is not None:
                    yield batch


class FramesReader(Frames, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take equalities and lists over PUSHED columns of text, and give the rest back."""
        kinds = {f.name: f.dataType.simpleString() for f in self.schema}
        for one in filters:
            name = one.attribute[0] if isinstance(one, (EqualTo, In)) and len(one.attribute) == 1 else None
            if name not in PUSHED or kinds.get(name) != "string":
                yield one
                continue
            values = {v for v in (one.value if isinstance(one, In) else [one.value]) if v is not None}
            self.wanted[name] = self.wanted[name] & values if name in self.wanted else values

    def partitions(self) -> list[Range]:
        logs = self.wanted.get("log_name")
        return [r for path, size in files(self.path) if logs is None or log_of(path) in logs for r in self.ranges(path, 0, size)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return super().read(partition) if partition.path else iter(())


class FramesStreamReader(Frames, DataSourceStreamReader):
    """Offsets hold, for each file, the byte behind its last whole line."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        known = getattr(self, "_known", {})
        system, _ = opened(self.path)
        self._known = {path: last_line_end(system, path, size, known.get(path, 0)) for path, size in files(self.path)}
        return self._known

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [r for path in sorted(end) for r in self.ranges(path, start.get(path, 0), end[path])]


class FramesSource(DataSource):
    """Options: path, rangeBytes, blockBytes. The schema is the reader's, or DEFAULT."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return DEFAULT

    def reader(self, schema: StructType) -> FramesReader:
        return FramesReader(schema, self.options)

    def streamReader(self, schema: StructType) -> FramesStreamReader:
        return FramesStreamReader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let it push filters into Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FramesSource)


def frames(spark: SparkSession, path: str, schema: str = DEFAULT, stream: bool = False, **options) -> DataFrame:
    """The frames of all logs below a folder, as a table or a stream."""
    register(spark)
    return (spark.readStream if stream else spark.read).format("frames").schema(schema).options(**options).load(path)
