"""FITS tables and images: bytes to rows in tasks.

Here a file is one row of a binary scan, so its size is bounded by a row's (2 GB); ``fits_blocks`` reads tables of any size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructType

BLOCK, CARD = 2880, 80
#: Column formats: NumPy's big-endian type and Spark's type.
FORMATS: dict[str, tuple[str, DataType]] = {"E": (">f4", FloatType()), "D": (">f8", DoubleType()), "I": (">i2", ShortType()), "J": (">i4", IntegerType()), "K": (">i8", LongType()), "L": ("S1", BooleanType())}


def column_type(form: str, arrays: bool = False) -> tuple[str, DataType]:
    """Types of a column format such as ``D`` or ``20A``, with ``arrays`` also ``64E``, so many numbers in a row; an unknown one is an error."""
    m = re.fullmatch(r"(\d*)([A-Z])", form.strip())
    if m and m[2] == "A":
        return f"S{int(m[1] or 1)}", StringType()
    if m and m[2] in FORMATS and m[1] in ("", "1"):
        return FORMATS[m[2]]
    if arrays and m and m[2] in FORMATS and m[2] != "L" and int(m[1]) > 1:
        kind, spark_type = FORMATS[m[2]]
        return f"({int(m[1])},){kind}", ArrayType(spark_type, False)
    raise ValueError(f"column format {form!r}")


def _card(key: str, value: object) -> bytes:
    text = f"'{value:<8}'" if isinstance(value, str) else ("T" if value else "F").rjust(20) if isinstance(value, bool) else repr(value).rjust(20)
    return f"{key:<8}= {text}".ljust(CARD).encode("ascii")


def _header(cards: list[tuple[str, object]]) -> bytes:
    raw = b"".join(_card(k, v) for k, v in cards) + b"END".ljust(CARD)
    return raw + b" " * (-len(raw) % BLOCK)


def read_header(data: bytes, at: int = 0) -> tuple[dict[str, str], int]:
    """(values by keyword, where the data begin)."""
    out: dict[str, str] = {}
    while True:
        card = data[at : at + CARD].decode("ascii")
        if len(card) < CARD:
            raise ValueError("the header has no end")
        at += CARD
        if card.startswith("END") and not card[3:].strip():
            return out, -(-at // BLOCK) * BLOCK
        if card[8:10] == "= ":
            text = card[10:].strip()
            out[card[:8].strip()] = text[1 : text.index("'", 1)].rstrip() if text.startswith("'") else text.split("/")[0].strip()


def table_bytes(columns: dict[str, tuple[str, np.ndarray]]) -> bytes:
    """A file with one table; ``columns`` gives each column's format and values."""
    kind = np.dtype([(n, column_type(f, arrays=True)[0]) for n, (f, _) in columns.items()])
    rows = np.zeros(len(next(iter(columns.values()))[1]), kind)
    for n, (f, v) in columns.items():
        rows[n] = np.where(v, b"T", b"F") if f == "L" else v
    cards: list[tuple[str, object]] = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", kind.itemsize), ("NAXIS2", len(rows)), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", len(columns))]
    for i, (n, (f, _)) in enumerate(columns.items(), 1):
        cards += [(f"TTYPE{i}", n), (f"TFORM{i}", f)]
    body = rows.tobytes()
    return _header([("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0)]) + _header(cards) + body + b"\0" * (-len(body) % BLOCK)


def image_bytes(image: np.ndarray, **cards: object) -> bytes:
    """A file with one image in its primary part; ``cards`` go to the header."""
    head = [("SIMPLE", True), ("BITPIX", -32), ("NAXIS", image.ndim), *((f"NAXIS{i}", n) for i, n in enumerate(reversed(image.shape), 1)), *cards.items()]
    body = image.astype(">f4").tobytes()
    return _header(head) + body + b"\0" * (-len(body) % BLOCK)


def read_image(data: bytes) -> tuple[dict[str, str], np.ndarray]:
    """(header, image) of the primary part; axes of length 1 in front go."""
    head, at = read_header(data)
    shape = [int(head[f"NAXIS{i}"]) for i in range(int(head["NAXIS"]), 0, -1)]
    while len(shape) > 2 and shape[0] == 1:
        shape = shape[1:]
    kind = {"-32": ">f4", "-64": ">f8", "16": ">i2", "32": ">i4"}[head["BITPIX"]]
    return head, np.frombuffer(data, kind, int(np.prod(shape)), at).reshape(shape).astype(np.float32)


def _table(data: bytes) -> tuple[dict[str, str], np.ndarray]:
    head, at = read_header(data)
    size = abs(int(head["BITPIX"])) // 8 * int(np.prod([int(head[f"NAXIS{i}"]) for i in range(1, int(head["NAXIS"]) + 1)])) if int(head["NAXIS"]) else 0
    head, at = read_header(data, at + -(-size // BLOCK) * BLOCK)
    forms = {head[f"TTYPE{i}"]: head[f"TFORM{i}"] for i in range(1, int(head["TFIELDS"]) + 1)}
    rows = np.frombuffer(data, np.dtype([(n, column_type(f, arrays=True)[0]) for n, f in forms.items()]), int(head["NAXIS2"]), at)
    return forms, rows


def decoded(v: np.ndarray, form: str) -> pa.Array:
    """A column of a table's rows as Spark takes it."""
    if v.ndim == 2:
        return pa.FixedSizeListArray.from_arrays(pa.array(v.ravel().astype(v.dtype.newbyteorder("="))), v.shape[1]).cast(pa.list_(pa.from_numpy_dtype(v.dtype.newbyteorder("="))))
    return pa.array(np.char.rstrip(np.char.decode(v, "ascii")).tolist() if form.endswith("A") else v == b"T" if form == "L" else v.astype(v.dtype.newbyteorder("=")))


def read_tables(files: DataFrame, schema: StructType, content: str = "content") -> DataFrame:
    """Rows of the first table of each file; only the schema's columns are decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                forms, rows = _table(data.as_py())
                yield pa.RecordBatch.from_arrays([decoded(rows[x.name], forms[x.name]) for x in schema.fields], [f.name for f in schema.fields])

    return files.select(content).mapInArrow(run, schema)
