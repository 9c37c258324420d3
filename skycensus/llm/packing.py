"""Packing documents into sequences by minimum bin slack over the multiset of remaining lengths.

A document's ids are cut into full windows and one remainder.  Only the histogram of remainder lengths (one count for each
length below the window, whatever the number of documents) reaches the driver.  There a bitset subset-sum search finds, for the
longest remaining length, the multiset of remaining lengths that fills a window closest to its capacity, and repeats it as
often as the counts allow.  Lengths beside which no multiset fills a window exactly are laid end to end and cut at the windows'
borders, since cutting is free; the ids after the last border go to windows of powers of two, which need no padding.
Pieces get their place by their rank among the pieces of equal length, so no task ever holds a length's pieces together.

Contracts: a null text is empty and consists of the end id; rows with equal ids are packed each; an empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written
from .tokenize import coder, row_ranges, text_sizes, tokenizer_path, with_end

WINDOW = 2048


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, with the longest in it, whose sum comes closest to ``capacity`` from below.

    Bit s of ``reach[i]`` says that the first i steps' lengths can sum to s.  Steps take 1, 2, 4, ... copies of a length, so
    that a count of n takes about log2(n) of them; walking back over the steps gives the counts.
    """
    lengths = sorted((x for x, n in counts.items() if n > 0 and x <= capacity), reverse=True)
    first = lengths[0]
    room = capacity - first
    mask = (1 << (room + 1)) - 1
    reach, steps = [1], []
    for x in lengths:
        left = min(counts[x] - (x == first), room // x)
        copies = 1
        while left > 0:
            take = min(copies, left)
            reach.append((reach[-1] | reach[-1] << (take * x)) & mask)
            steps.append((x, take))
            left -= take
            copies *= 2
        if reach[-1] >> room & 1:
            break
    total = reach[-1].bit_length() - 1
    chosen = {first: 1}
    for i in range(len(steps) - 1, -1, -1):
        x, take = steps[i]
        if not reach[i] >> total & 1:
            chosen[x] = chosen.get(x, 0) + take
            total -= take * x
    return chosen


def plan(histogram: dict[int, int], capacity: int = WINDOW) -> tuple[list[tuple[int, int, int, int, int, int]], dict[int, tuple[int, int, int]], int, int]:
    """(patterns, tail, first tail sequence, tail ids) for a histogram of lengths.

    A pattern row (length, first rank, end rank, first sequence, copies a sequence, offset) places the ranks of a length; tail
    has (first rank, end rank, first position) of the lengths that are laid end to end.
    """
    counts = {x: n for x, n in histogram.items() if n > 0}
    used = dict.fromkeys(counts, 0)
    rows, sequence = [], 0
    rest: dict[int, int] = {}
    while counts:
        chosen = fill(counts, capacity)
        if sum(x * n for x, n in chosen.items()) < capacity:
            # nothing fills the window beside the longest length: it waits for the tail
            longest = max(counts)
            rest[longest] = counts.pop(longest)
            continue
        times = min(counts[x] // n for x, n in chosen.items())
        offset = 0
        for x, n in sorted(chosen.items(), reverse=True):
            rows.append((x, used[x], used[x] + n * times, sequence, n, offset))
            used[x] += n * times
            offset += n * x
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
        sequence += times
    tail, position = {}, 0
    for x in sorted(rest, reverse=True):
        tail[x] = (used[x], used[x] + rest[x], position)
        position += x * rest[x]
    return rows, tail, sequence, position


def tail_borders(first_sequence: int, n_ids: int, capacity: int, at: int) -> tuple[int, int, int]:
    """(sequence, offset in it, ids left in it) of position ``at`` of the tail."""
    whole = n_ids // capacity
    if at < whole * capacity:
        return first_sequence + at // capacity, at % capacity, capacity - at % capacity
    rest, at, sequence = n_ids - whole * capacity, at - whole * capacity, first_sequence + whole
    while True:
        size = 1 << (rest.bit_length() - 1)
        if at < size:
            return sequence, at, size - at
        rest, at, sequence = rest - size, at - size, sequence + 1


def tokenized_pieces(docs: DataFrame, tokenizer: str, end_id: int, window: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, start, length, ids_crc32, doc_tokens) of full windows and remainders."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(tokenizer_path(tokenizer), "words")
        for b in batches:
            for i, n in row_ranges(text_sizes(b.column(2))):
                s = b.slice(i, n)
                ids, offsets = with_end(*code.encode(s.column(2)), end_id)
                raw = memoryview(ids.astype("<u4").tobytes())
                counts = np.diff(offsets)
                pieces = -(-counts // window)
                row = np.repeat(np.arange(len(counts)), pieces)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
                length = np.minimum(window, counts[row] - start)
                at = offsets[row] + start
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(at.tolist(), (at + length).tolist(), strict=True)]
                of = pa.array(row)
                yield pa.RecordBatch.from_arrays([s.column(0).take(of), s.column(1).take(of), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(counts[row])], ["doc_id", "text_key", "start", "length", "ids_crc32", "doc_tokens"])

    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    return keyed.mapInArrow(run, f"doc_id {kind}, text_key long, start long, length long, ids_crc32 long, doc_tokens long")


def ranked(pieces: DataFrame, salts: int) -> DataFrame:
    """``rank``: 0, 1, ... among the pieces of a length, without bringing them together: counts by (length, salt) give offsets."""
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_key", "start"), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").count()
    before = sizes.select("length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "text_key", "start"))
    return salted.withColumn("in_salt", inside).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("in_salt") - 1).drop("salt", "in_salt", "before")


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece."""
    pieces = written(tokenized_pieces(docs, tokenizer, end_id, window, id_col, text_col), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``window`` rows
    rows, tail, first_tail, tail_ids = plan(histogram, window)
    table = np.array(sorted(rows), np.int64).reshape(-1, 6)
    key = table[:, 0] * (1 << 44) + table[:, 1]
    in_tail = np.zeros((window + 1, 3), np.int64)
    for x, place in tail.items():
        in_tail[x] = place
    kind = pieces.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "text_key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start, length, rank = (b.column(b.schema.names.index(c)).to_numpy() for c in ("start", "length", "rank"))
            ends = in_tail[length, 1] > 0
            ends &= rank >= in_tail[length, 0]
            at = np.maximum(np.searchsorted(key, length * (1 << 44) + rank, side="right") - 1, 0)
            p = table[at] if len(table) else np.zeros((len(b), 6), np.int64)
            k = rank - p[:, 1]
            n = np.maximum(p[:, 4], 1)
            sequence, offset = p[:, 3] + k // n, p[:, 5] + k % n * length
            plain = pa.array(np.flatnonzero(~ends))
            cols = {c: b.column(b.schema.names.index(c)) for c in names[:6]}
            yield pa.RecordBatch.from_arrays([*(c.take(plain) for c in cols.values()), pa.array(sequence[~ends]), pa.array(offset[~ends])], names)
            cut: list[tuple[int, int, int, int, int]] = []
            for i in np.flatnonzero(ends).tolist():
                x = int(length[i])
                position, done = int(in_tail[x, 2] + (rank[i] - in_tail[x, 0]) * x), 0
                while done < x:
                    to, there, room = tail_borders(first_tail, tail_ids, window, position + done)
                    take = min(room, x - done)
                    cut.append((i, int(start[i]) + done, take, to, there))
                    done += take
            if cut:
                of = pa.array([c[0] for c in cut])
                got = {c: cols[c].take(of) for c in names[:6]}
                whole = pa.array([c[2] == int(length[c[0]]) for c in cut])
                crc = pc.if_else(whole, got["ids_crc32"], pa.scalar(None, pa.int64()))
                yield pa.RecordBatch.from_arrays([got["doc_id"], got["text_key"], pa.array([c[1] for c in cut], pa.int64()), pa.array([c[2] for c in cut], pa.int64()), crc, got["doc_tokens"], pa.array([c[3] for c in cut], pa.int64()), pa.array([c[4] for c in cut], pa.int64())], names)

    n_pieces = sum(histogram.values())
    placed = ranked(pieces, max(64, n_pieces // 200_000)).mapInArrow(place, f"doc_id {kind}, text_key long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    if not tail_ids:
        return placed.drop("text_key")
    placed = written(placed, "placed")
    cut = placed.where("ids_crc32 IS NULL")
    # the checksums of cut pieces need their documents' ids again
    again = cut_checksums(docs, cut.select("doc_id", "text_key", "start", "length").dropDuplicates(), tokenizer, end_id, id_col, text_col)
    fixed = cut.drop("ids_crc32").join(again.select(*(F.col(c).alias("_" + c) for c in again.columns)), F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_key") == F.col("_text_key")) & (F.col("start") == F.col("_start")) & (F.col("length") == F.col("_length"))).withColumnRenamed("_ids_crc32", "ids_crc32")
    return placed.where("ids_crc32 IS NOT NULL").unionByName(fixed.select(*placed.columns)).drop("text_key")


def cut_checksums(docs: DataFrame, cut: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, start, length, ids_crc32) of given pieces, from their documents' texts."""
    kind = docs.schema[id_col].dataType.simpleString()
    spans = cut.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    keyed = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_key"), F.col(text_col).alias("text"))
    found = keyed.join(spans, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("text_key"))).dropDuplicates(["_id", "_key"]).select("doc_id", "text_key", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(tokenizer_path(tokenizer), "words")
        for b in batches:
            ids, offsets = with_end(*code.encode(b.column(2)), end_id)
            row, start, length, crc = [], [], [], []
            for i, spans in enumerate(b.column(3).to_pylist()):
                for s in spans:
                    at = offsets[i] + s["start"]
                    row.append(i)
                    start.append(s["start"])
                    length.append(s["length"])
                    crc.append(zlib.crc32(ids[at : at + s["length"]].astype("<u4").tobytes()))
            of = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "text_key", "start", "length", "ids_crc32"])

    return found.mapInArrow(run, f"doc_id {kind}, text_key long, start long, length long, ids_crc32 long")
