"""A connector for delimited files of providers: byte-range partitions, filters pushed to the scan, Arrow batches, a stream of new files."""

from __future__ import annotations

import datetime as dt
import json
import operator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv, fs
from pyspark.sql import datasource as ds
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType, StructType

#: How far apart the bytes lie at which a file is parted.
SPLIT = 64 << 20
_COMPARE = {ds.EqualTo: pc.equal, ds.GreaterThan: pc.greater, ds.GreaterThanOrEqual: pc.greater_equal, ds.LessThan: pc.less, ds.LessThanOrEqual: pc.less_equal}
_PYTHON = {ds.EqualTo: operator.eq, ds.GreaterThan: operator.gt, ds.GreaterThanOrEqual: operator.ge, ds.LessThan: operator.lt, ds.LessThanOrEqual: operator.le}


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and path behind a local path or an address that Arrow knows (file, hdfs, s3, gs); Hadoop's file:/x is file:///x."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Span(ds.InputPartition):
    """Lines of a file that begin at a byte from start on and before end; of a folder name=value, the values of its files."""

    path: str
    start: int
    end: int
    values: dict


class DelimitedFiles(ds.DataSource):
    """spark.read.format("provider_csv").load(folder) after install(spark): files with a header, in folders name=value or none.

    Columns are text, or of the schema given; what can't be read as its type fails the scan, an empty field is null. Options:
    `splitBytes` (a file of many such is read by as many tasks), `quotedLines` (true: fields may hold line ends, and a
    file is one task). Filters on plain columns (=, <, <=, >, >=, IN, IS NOT NULL, and those of folder names) are
    taken by the scan: files of other folders aren't opened, other rows don't leave Arrow. As a stream it takes in files in order of their time of change and name.
    """

    @classmethod
    def name(cls) -> str:
        return "provider_csv"

    def schema(self) -> StructType:
        files = _files(self.options["path"])
        if not files:
            raise ValueError(f"{self.options['path']}: no file to take columns from; give a schema")
        names = [*_header(files[0][0]), *_folders(files[0][0], self.options["path"])]
        out = StructType()
        for n in names:
            out = out.add(n, StringType())
        return out

    def reader(self, schema: StructType) -> ds.DataSourceReader:
        return _Scan(schema, dict(self.options))

    def streamReader(self, schema: StructType) -> ds.DataSourceStreamReader:  # noqa: N802
        return _NewFiles(schema, dict(self.options))


def install(spark) -> None:
    """Makes the format known to a session, with filters pushed down: without that setting Spark refuses sources that take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DelimitedFiles)


def _files(folder: str) -> list[tuple[str, int, int]]:
    """(path, bytes, nanoseconds of last change) of all data files, by path; names that begin with . or _ aren't data."""
    store, at = store_of(folder)
    info = store.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    head = folder[: len(folder) - len(at)] if folder.endswith(at) else ""
    data = [f for f in found if f.type == fs.FileType.File and not any(p.startswith((".", "_")) for p in f.path[len(at) :].split("/"))]
    return sorted((head + f.path, f.size, f.mtime_ns or 0) for f in data)


def _header(path: str) -> list[str]:
    store, at = store_of(path)
    with store.open_input_stream(at) as f:
        return csv.open_csv(f, csv.ReadOptions(block_size=1 << 20)).schema.names


def _folders(path: str, root: str) -> dict[str, str]:
    parts = path[len(root) :].split("/")[:-1] if path.startswith(root) else []
    return dict(p.split("=", 1) for p in parts if "=" in p)


class _Lines:
    """A file-like view of the whole lines of a span, the header left out."""

    def __init__(self, store: fs.FileSystem, span: Span, at: str):
        self.file, self.left, self.closed = store.open_input_file(at), None, False
        size = self.file.size()
        self.at = self._after(max(span.start - 1, 0)) if span.start else self._after(0)
        self.stop = size if span.end >= size else max(self._after(span.end - 1), self.at)

    def _after(self, byte: int) -> int:
        """The place behind the first line end from a byte on."""
        self.file.seek(byte)
        while chunk := self.file.read(1 << 16):
            if (k := chunk.find(b"\n")) >= 0:
                return byte + k + 1
            byte += len(chunk)
        return byte

    def read(self, n: int = -1) -> bytes:
        self.file.seek(self.at)
        out = self.file.read(min(n if n >= 0 else self.stop, self.stop - self.at))
        self.at += len(out)
        return out

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return False

    def writable(self) -> bool:
        return False

    def close(self) -> None:
        self.closed = True
        self.file.close()


class _Source:
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options, self.filters = schema, {k.lower(): v for k, v in options.items()}, []

    def spans(self, files: list[tuple[str, int, int]]) -> list[Span]:
        size = int(self.options.get("splitbytes", SPLIT))
        whole = str(self.options.get("quotedlines", "false")).lower() == "true"
        out = []
        for path, n, _ in files:
            values = _folders(path, self.options["path"])
            if all(_keeps(f, values) for f in self.filters if f.attribute[0] in values):
                out += [Span(path, s, n if whole else min(s + size, n), values) for s in range(0, n, n if whole else size)]
        return out

    def read(self, partition: Span):
        """Arrow batches of the rows that the filters keep."""
        store, at = store_of(partition.path)
        kinds = {f.name: to_arrow_type(f.dataType) for f in self.schema.fields}
        header = _header(partition.path)
        lines = _Lines(store, partition, at)
        if lines.at >= lines.stop:
            return
        own = {n: kinds[n] for n in header if n in kinds}
        quoted = str(self.options.get("quotedlines", "false")).lower() == "true"
        stream = csv.open_csv(pa.PythonFile(lines, mode="r"), csv.ReadOptions(column_names=header), csv.ParseOptions(newlines_in_values=quoted), csv.ConvertOptions(column_types=own, include_columns=list(own), strings_can_be_null=True, quoted_strings_can_be_null=False, null_values=[""], timestamp_parsers=[csv.ISO8601, "%Y-%m-%d %H:%M:%S"]))
        for batch in stream:
            for f in self.filters:
                if f.attribute[0] in own:
                    batch = batch.filter(_mask(f, batch.column(f.attribute[0])))
            if batch.num_rows:
                columns = [batch.column(n) if n in own else pa.array([partition.values.get(n)] * batch.num_rows, pa.string()).cast(kinds[n]) for n in kinds]
                yield pa.RecordBatch.from_arrays(columns, names=list(kinds))


def _supported(f) -> bool:
    return len(getattr(f, "attribute", ())) == 1 and (type(f) in _COMPARE or isinstance(f, ds.IsNotNull) or isinstance(f, ds.In) and None not in f.value)


def _mask(f, column: pa.Array) -> pa.Array:
    if isinstance(f, ds.IsNotNull):
        return pc.is_valid(column)
    if isinstance(f, ds.In):
        return pc.is_in(column, pa.array(list(f.value), column.type))
    return pc.fill_null(_COMPARE[type(f)](column, pa.scalar(f.value, column.type)), False)


def _keeps(f, values: dict) -> bool:
    """Whether a folder's value may pass; what isn't text is left to the rows."""
    v = values[f.attribute[0]]
    if isinstance(f, ds.IsNotNull):
        return True
    if isinstance(f, ds.In):
        return v in f.value if all(isinstance(x, str) for x in f.value) else True
    if isinstance(f.value, (int, float)) and not isinstance(f.value, bool):
        return _PYTHON[type(f)](float(v), f.value)
    if isinstance(f.value, dt.date):
        return _PYTHON[type(f)](type(f.value).fromisoformat(v), f.value)
    return _PYTHON[type(f)](v, f.value) if isinstance(f.value, str) else True


class _Scan(_Source, ds.DataSourceReader):
    def pushFilters(self, filters):  # noqa: N802
        """Takes what can be decided by file or in Arrow; those on a folder's name go back too unless they decide for whole files."""
        for f in filters:
            if _supported(f):
                self.filters.append(f)
            if not _supported(f) or f.attribute[0] in self._named():
                yield f

    def _named(self) -> set[str]:
        if not hasattr(self, "_names"):
            self._names = {n for p, _, _ in _files(self.options["path"]) for n in _folders(p, self.options["path"])}
        return self._names

    def partitions(self) -> list[Span]:
        return self.spans(_files(self.options["path"])) or [Span("", 0, 0, {})]

    def read(self, partition: Span):
        return super().read(partition) if partition.path else iter(())


class _NewFiles(_Source, ds.DataSourceStreamReader):
    """Offsets are the last file taken in, by time of change and path."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"mtime": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        last = max(((m, p) for p, _, m in _files(self.options["path"])), default=(-1, ""))
        return {"mtime": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        low, high = ((o["mtime"], o["path"]) for o in (start, end))
        return self.spans([f for f in _files(self.options["path"]) if low < (f[2], f[0]) <= high])

    def commit(self, end: dict) -> None:
        json.dumps(end)
