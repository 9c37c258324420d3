"""A FITS table as a Spark source and sink: ``spark.read.format("fits_table").load(path)``, ``df.write.format("fits_table").save(folder)``.

A file's header is read once; its rows are split into blocks of ``block_rows``, each of which is a task that reads its own bytes, so that a
catalogue of any size is read in parallel.  A wanted schema prunes columns: only those are decoded.  Paths go through Arrow's
file systems (local, HDFS, S3 and so on).

A folder that was written has files of at most ``block_rows`` rows each, and manifests.  A task's files have names of their own and count
only once a manifest lists them: the driver writes that when all tasks have committed.  So a task that fails, runs twice or is
aborted leaves nothing that a reader sees, and its files are deleted where it is still known which they are.  ``append`` adds a
manifest, ``overwrite`` one that replaces those before it.

Columns are numbers, booleans, strings of ASCII letters and arrays of as many numbers in each row.  A missing float is NaN and a missing string
empty; other missing values are an error, for the format has none.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from . import fits

BLOCK_ROWS = 200_000


def _open(path: str):
    system, inner = _system(path)
    return system.open_input_file(inner)


def table_layout(path: str) -> tuple[dict[str, str], np.dtype, int, int]:
    """(column formats, NumPy's row, number of rows, where they begin) of the first table of a file."""
    with _open(path) as f:

        def header(at: int) -> tuple[dict[str, str], int]:
            data = b""
            while True:  # a header ends in one of its blocks
                f.seek(at + len(data))
                data += (more := f.read(fits.BLOCK))
                try:
                    head, end = fits.read_header(data)
                    return head, at + end
                except (ValueError, UnicodeDecodeError):
                    if len(more) < fits.BLOCK:
                        raise

        head, at = header(0)
        size = abs(int(head["BITPIX"])) // 8 * int(np.prod([int(head[f"NAXIS{i}"]) for i in range(1, int(head["NAXIS"]) + 1)])) if int(head["NAXIS"]) else 0
        head, at = header(at + -(-size // fits.BLOCK) * fits.BLOCK)
    forms = {head[f"TTYPE{i}"]: head[f"TFORM{i}"] for i in range(1, int(head["TFIELDS"]) + 1)}
    return forms, np.dtype([(n, fits.column_type(x, arrays=True)[0]) for n, x in forms.items()]), int(head["NAXIS2"]), at


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def manifests(path: str) -> dict[str, dict]:
    """The manifests of a folder by name, but for those that another one replaces."""
    from pyarrow import fs

    system, inner = _system(path)
    found = {}
    for f in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
        if f.base_name.startswith("_manifest-") and f.base_name.endswith(".json"):
            with system.open_input_file(f.path) as g:
                found[f.base_name] = json.loads(g.read())
    gone = {name for m in found.values() for name in m["replaces"]}
    return {k: m for k, m in sorted(found.items()) if k not in gone}


def table_files(path: str) -> list[str]:
    """The files that make up a table: a file itself, or those that a folder's manifests list."""
    from pyarrow import fs

    system, inner = _system(path)
    if system.get_file_info(inner).type != fs.FileType.Directory:
        return [path]
    return [f"{path.rstrip('/')}/{name}" for m in manifests(path).values() for name, _ in m["files"]]


class _Rows(InputPartition):
    def __init__(self, path: str, first: int, n: int) -> None:
        self.path, self.first, self.n = path, first, n


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, block_rows: int) -> None:
        self.files, self.schema, self.block_rows = table_files(path), schema, block_rows

    def partitions(self) -> list[InputPartition]:
        counts = [(f, table_layout(f)[2]) for f in self.files]
        return [_Rows(f, i, min(self.block_rows, n - i)) for f, n in counts for i in range(0, n, self.block_rows)] or [_Rows("", 0, 0)]

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        if not partition.n:
            return
        forms, row, _, at = table_layout(partition.path)
        with _open(partition.path) as f:
            f.seek(at + partition.first * row.itemsize)
            data = f.read(partition.n * row.itemsize)
        rows = np.frombuffer(data, row, partition.n)
        yield pa.RecordBatch.from_arrays([fits.decoded(rows[x.name], forms[x.name]) for x in self.schema.fields], [x.name for x in self.schema.fields])


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, int]]


_FORMS = {pa.bool_(): "L", pa.int16(): "I", pa.int32(): "J", pa.int64(): "K", pa.float32(): "E", pa.float64(): "D"}


def _column(name: str, v: pa.ChunkedArray) -> tuple[str, np.ndarray]:
    """(format, values) of a column of a file."""
    v = v.combine_chunks()
    if pa.types.is_string(v.type) or pa.types.is_large_string(v.type):
        text = np.char.encode(pc.fill_null(v, "").to_numpy(zero_copy_only=False).astype(str), "ascii")
        return f"{max(1, text.dtype.itemsize)}A", text
    if pa.types.is_list(v.type):
        widths = pc.unique(pc.list_value_length(v)).to_pylist()
        inner = v.flatten()
        if len(widths) > 1 or widths == [None] or inner.null_count or inner.type not in _FORMS:
            raise ValueError(f"the arrays of {name} have missing values or several lengths")
        return f"{widths[0]}{_FORMS[inner.type]}", inner.to_numpy(zero_copy_only=False).reshape(len(v), widths[0])
    if v.type not in _FORMS:
        raise ValueError(f"{name} has a type that the format does not know: {v.type}")
    if v.null_count and not pa.types.is_floating(v.type):
        raise ValueError(f"{name} has missing values, for which the format has no sign")
    return _FORMS[v.type], (pc.fill_null(v, float("nan")) if v.null_count else v).to_numpy(zero_copy_only=False)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool, block_rows: int) -> None:
        self.path, self.schema, self.overwrite, self.block_rows, self.job = path, schema, overwrite, block_rows, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, inner = _system(self.path)
        system.create_dir(inner, recursive=True)
        files: list[tuple[str, int]] = []
        held: list[pa.RecordBatch] = []

        def flush() -> None:
            rows = pa.Table.from_batches(held)
            name = f"part-{self.job}-{uuid.uuid4().hex}.fits"
            with system.open_output_stream(f"{inner}/{name}") as f:
                f.write(fits.table_bytes({c: _column(c, rows[c]) for c in rows.column_names}))
            files.append((name, len(rows)))
            held.clear()

        try:
            for batch in iterator:
                for i in range(0, len(batch), self.block_rows):
                    held.append(batch.slice(i, self.block_rows))
                    if sum(map(len, held)) >= self.block_rows:
                        flush()
            if held:
                flush()
        except BaseException:
            self._delete(files)
            raise
        return _Written(files)

    def _delete(self, files: list[tuple[str, int]]) -> None:
        system, inner = _system(self.path)
        for name, _ in files:
            system.delete_file(f"{inner}/{name}")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, inner = _system(self.path)
        system.create_dir(inner, recursive=True)
        before = manifests(self.path) if self.overwrite else {}
        listed = {"files": [x for m in messages if m for x in m.files], "schema": self.schema.jsonValue(), "replaces": [*before]}
        with system.open_output_stream(f"{inner}/_manifest-{self.job}.json") as f:
            f.write(json.dumps(listed).encode())
        # what is replaced is no longer seen, and can go
        for name, m in before.items():
            self._delete(m["files"])
            system.delete_file(f"{inner}/{name}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._delete([x for m in messages if m for x in m.files])


class FitsTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fits_table"

    def schema(self) -> StructType:
        path = self.options["path"]
        files = table_files(path)
        if not files:
            found = [*manifests(path).values()]
            if not found:
                raise ValueError(f"{path} has no manifest")
            return StructType.fromJson(found[-1]["schema"])
        out = StructType()
        for n, form in table_layout(files[0])[0].items():
            out.add(n, fits.column_type(form, arrays=True)[1])
        return out

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema, int(self.options.get("block_rows", BLOCK_ROWS)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], schema, overwrite, int(self.options.get("block_rows", BLOCK_ROWS)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FitsTable)
