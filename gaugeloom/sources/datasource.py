"""Ledgers as a data source of their own: ``spark.read.format("graded_ledger").load(path)``.

Files of newline-delimited JSON are read by byte ranges; a line belongs to the range in which it begins. Equalities and IN lists on
string columns are tested where lines are read, so rows that fail them never leave the reader. A line that is no JSON object of the
schema raises with its file and number, unless it is the last of its file that isn't blank: such a row was cut short, and is skipped.

Options: ``path`` (a file or a folder, plain text; names that begin with ``_`` or ``.`` are left out; a missing one is an empty ledger)
and ``splitBytes``. A narrower schema given to the reader reads fewer columns. For whole scans without a filter ``read_ledger`` stays in the JVM.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull
from pyspark.sql.pandas.types import to_arrow_schema

from ..schema import LEDGER

FORMAT = "graded_ledger"
SPLIT_BYTES = 64 << 20
#: Text that stands for a number in JSON.
NO_NUMBERS = ("NaN", "Infinity", "+Infinity", "-Infinity", "+INF", "-INF")
_BLOCK, _BATCH_ROWS, _BATCH_BYTES = 1 << 20, 10_000, 8 << 20


def register(spark: SparkSession) -> str:
    """Make the format known to a session, let the session push filters to Python sources, and return the format's name."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LedgerSource)
    return FORMAT


def _opened(path: str):
    return fs.FileSystem.from_uri(path if "://" in path else "file:///" + re.sub(r"^(file:)?/*", "", path))


def lines_from(handle, at: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of a file from byte ``at`` on, read block by block; the first line may be the end of one."""
    handle.seek(at)
    rest: list[bytes] = []
    while block := handle.read(_BLOCK):
        first, *more = block.split(b"\n")
        rest.append(first)
        if not more:
            continue
        for line in (b"".join(rest), *more[:-1]):
            yield at, line
            at += len(line) + 1
        rest = more[-1:]
    if any(rest):
        yield at, b"".join(rest)


def _text(value) -> str:
    return value if isinstance(value, str) else json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def typed(value, kind: T.DataType):
    """A JSON value as a column's; a value of another kind raises ValueError. In text columns other values stand as their JSON."""
    if value is None:
        return None
    whole = isinstance(value, int) and not isinstance(value, bool)
    if isinstance(kind, T.StringType):
        return _text(value)
    if isinstance(kind, T.LongType) and whole and -(1 << 63) <= value < 1 << 63:
        return value
    if isinstance(kind, T.DoubleType) and (whole or isinstance(value, float) or value in NO_NUMBERS):
        return float(value)
    if isinstance(kind, T.BooleanType) and isinstance(value, bool):
        return value
    if isinstance(kind, T.ArrayType) and isinstance(value, list):
        return [typed(x, kind.elementType) for x in value]
    raise ValueError(f"{kind.simpleString()} expected")


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int


class LedgerReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.kinds = {f.name: f.dataType for f in schema}
        self.arrow = to_arrow_schema(schema)
        self.path, self.split = options["path"], int(options.get("splitbytes", SPLIT_BYTES))
        self.wanted: dict[str, set] = {}
        self.present: set[str] = set()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equalities and IN lists on text columns, and that a column isn't null; others are left to Spark."""
        for f in filters:
            if isinstance(f, IsNotNull) and len(f.attribute) == 1:
                self.present.add(f.attribute[0])
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            name = f.attribute[0] if values is not None and len(f.attribute) == 1 else None
            if isinstance(self.kinds.get(name), T.StringType):
                values -= {None}
                self.wanted[name] = self.wanted[name] & values if name in self.wanted else values
            else:
                yield f

    def partitions(self) -> list[Range]:
        store, path = _opened(self.path)
        found = store.get_file_info(path)
        if found.type == fs.FileType.NotFound:
            return []
        infos = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        files = sorted((i.path, i.size) for i in infos if i.type == fs.FileType.File and not i.base_name.startswith(("_", ".")))
        return [Range(file, at, min(at + self.split, size)) for file, size in files for at in range(0, size, self.split)]

    def row(self, line: bytes) -> dict:
        value = json.loads(line)
        if not isinstance(value, dict):
            raise ValueError("no object")
        return {name: typed(value.get(name), kind) for name, kind in self.kinds.items()}

    def read(self, partition: Range | None):
        if partition is None:  # no files
            return
        store, _ = _opened(self.path)
        with store.open_input_file(partition.file) as handle:
            lines = lines_from(handle, max(0, partition.start - 1))
            if partition.start:
                next(lines, None)  # begins before the range
            rows, size = [], 0
            for at, line in lines:
                if at >= partition.end:
                    break
                if not line.strip():
                    continue
                try:
                    row = self.row(line)
                except ValueError as wrong:
                    if any(later.strip() for _, later in lines):
                        number = sum(1 for begin, _ in lines_from(handle, 0) if begin <= at)
                        raise ValueError(f"line {number} of {partition.file} is no JSON object") from wrong
                    break  # cut short
                if all(row[name] is not None for name in self.present) and all(row[name] in values for name, values in self.wanted.items()):
                    rows.append(row)
                    size += len(line)
                if len(rows) >= _BATCH_ROWS or size >= _BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=self.arrow)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=self.arrow)


class LedgerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        return LEDGER

    def reader(self, schema: T.StructType) -> LedgerReader:
        return LedgerReader(schema, {k.lower(): v for k, v in dict(self.options).items()})
