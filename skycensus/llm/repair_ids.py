"""Token-id output: Re-Pair grammars over shards of documents, with rules, expansion lengths and random access.

Documents are sorted by id over range partitions; each task packs its documents into shards of about ``SHARD_IDS`` ids and
compresses each one.  A shard is a row of a table: the documents' ids beside one binary value in this format (little endian):

    magic "RPG1", u32 documents, u32 rules, u32 symbols, u32 width (2 or 4 bytes a symbol), u32 first nonterminal
    u32 left[rules], u32 right[rules], u32 expansion length[rules]
    u32 symbol offset[documents + 1], u32 id count[documents]
    symbols

Re-Pair goes on until no pair repays its rule.  Each round counts all pairs, takes those that occur at least a ``SHARE``-th as often as
the most frequent one as new nonterminals, and replaces them without overlap: where two of them overlap, the more frequent one goes
first and the other waits for the next round.  Pairs never cross a document's end, so each document decodes alone.

Contracts: a null text is empty and holds the end id only; rows with equal ids each keep their own entry; a null id sorts
first; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written
from .tokenize import coder, row_ranges, text_sizes, tokenizer_path, with_end

MAGIC = b"RPG1"
#: Ids in one shard at about; the least count at which a pair repays its rule (12 bytes, two bytes saved each time); share of the
#: most frequent pair's count that others of a round must reach.
SHARD_IDS, LEAST_COUNT, SHARE = 1 << 20, 7, 64
_BITS = 18


def _bins(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return ((x * np.uint32(2654435761) + y * np.uint32(2246822519)) >> np.uint32(32 - _BITS)).astype(np.intp)


def _pair_bins(seq: np.ndarray, end: np.ndarray, at: np.ndarray | slice = slice(None)) -> np.ndarray:
    """The bins of the pairs that begin at ``at``; pairs across a document's end have one of their own."""
    bins = _bins(seq[:-1][at], seq[1:][at])
    bins[end[:-1][at]] = 1 << _BITS
    return bins


def _around(at: np.ndarray, after: int, n: int) -> np.ndarray:
    """The places of 0 to n - 1 from one before each of ``at`` to ``after`` beyond it, in order."""
    near = np.zeros(n + 3, bool)
    for step in range(after + 2):
        near[at + step] = True
    return np.flatnonzero(near[1 : n + 1])


def _frequent(seq: np.ndarray, bins: np.ndarray, counts: np.ndarray, least: int, share: int, room: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(positions of the round's pairs, rank of each position's pair by frequency, number of pairs); overlaps count.

    The pairs occur ``least`` times or more, and a ``share``-th as often as the fullest bin's.
    """
    counts[-1] = 0
    least = max(least, int(counts.max()) // share)
    at = np.flatnonzero((counts >= least)[bins])  # no pair is more frequent than its bin
    pairs = np.sort((seq[at].astype(np.uint64) << np.uint64(32)) | seq[at + 1])
    start = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
    n = np.diff(start, append=len(pairs))
    some = np.flatnonzero(n >= least)
    some = some[np.argsort(-n[some], kind="stable")][:room]
    x, y = (pairs[start[some]] >> np.uint64(32)).astype(np.uint32), pairs[start[some]].astype(np.uint32)
    rule = np.full((1 << _BITS) + 1, -1, np.int32)
    # of pairs that share a bin the most frequent one comes first, the others in later rounds
    rule[_bins(x, y)[::-1]] = np.arange(len(x))[::-1]
    r = rule[bins[at]]
    at, r = at[r >= 0], r[r >= 0]
    same = (seq[at] == x[r]) & (seq[at + 1] == y[r])
    return at[same], r[same], len(x)


def grammar(ids: np.ndarray, last: np.ndarray, first_nonterminal: int, least: int = LEAST_COUNT, share: int = SHARE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, last flags, left, right): ``last`` marks each document's last symbol."""
    seq, end = ids.astype(np.uint32), last.copy()
    left, right = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
    nonterminal = first_nonterminal
    # symbols of 16 bits stay so: a rule beyond them would double all others
    room = (1 << 16) - first_nonterminal if first_nonterminal < 1 << 16 else 1 << 31
    bins = _pair_bins(seq, end)
    counts = np.bincount(bins, minlength=(1 << _BITS) + 1)
    while len(seq) > 1 and room > 0:
        at, r, n_pairs = _frequent(seq, bins, counts, least, share, room)
        # a position beside a more frequent pair's waits
        beside = np.flatnonzero(np.diff(at) == 1)
        wait = np.zeros(len(at), bool)
        wait[beside[r[beside] > r[beside + 1]]] = True
        wait[beside[r[beside] < r[beside + 1]] + 1] = True
        at, r = at[~wait], r[~wait]
        # of a run of overlapping matches every other one is taken
        start = np.ones(len(at), bool)
        start[1:] = np.diff(at) > 1
        place = np.arange(len(at))
        keep = (place - np.maximum.accumulate(np.where(start, place, 0))) % 2 == 0
        at, r = at[keep], r[keep]
        used = np.bincount(r, minlength=n_pairs) >= least
        good = used[r]
        at, r = at[good], (np.cumsum(used) - 1)[r[good]]
        if not len(at):
            if share >= len(seq):
                break
            share = len(seq)  # nothing near the fullest bin: all pairs that repay their rule
            continue
        where = np.empty(int(used.sum()), np.int64)
        where[r] = at
        left.append(seq[where])
        right.append(seq[where + 1])
        seq[at] = nonterminal + r
        end[at] = end[at + 1]
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        few = 4 * len(at) < len(seq)
        if few:  # only the pairs beside the new symbols are counted again
            counts -= np.bincount(bins[_around(at, 1, len(bins))], minlength=len(counts))
            bins = bins[stay[:-1]]
        seq, end = seq[stay], end[stay]
        if few:
            bins = bins[: len(seq) - 1]
            near = _around(at - np.arange(len(at)), 0, len(bins))
            bins[near] = _pair_bins(seq, end, near)
            counts += np.bincount(bins[near], minlength=len(counts))
        else:
            bins = _pair_bins(seq, end)
            counts = np.bincount(bins, minlength=len(counts))
        nonterminal += len(where)
        room -= len(where)
    return seq, end, np.concatenate(left), np.concatenate(right)


def expansion_lengths(left: np.ndarray, right: np.ndarray, first_nonterminal: int) -> np.ndarray:
    """How many ids each rule stands for; rules refer to earlier ones only."""
    out = np.ones(len(left), np.int64)
    for _ in range(len(left)):
        size = lambda s: np.where(s < first_nonterminal, 1, out[np.maximum(s.astype(np.int64) - first_nonterminal, 0)])
        new = size(left) + size(right)
        if (new == out).all():
            break
        out = new
    return out


def pack_shard(ids: np.ndarray, offsets: np.ndarray, vocabulary: int, **how: int) -> bytes:
    """The documents ``ids[offsets[i]:offsets[i + 1]]`` in the format above."""
    counts = np.diff(offsets)
    last = np.zeros(len(ids), bool)
    last[offsets[1:] - 1] = True
    seq, end, left, right = grammar(ids, last, vocabulary, **how)
    ends = np.concatenate([[0], np.flatnonzero(end) + 1])
    width = 2 if vocabulary + len(left) <= 1 << 16 else 4
    lengths = expansion_lengths(left, right, vocabulary)
    head = MAGIC + struct.pack("<5I", len(counts), len(left), len(seq), width, vocabulary)
    return head + b"".join(x.astype("<u4").tobytes() for x in (left, right, lengths, ends, counts)) + seq.astype("<u2" if width == 2 else "<u4").tobytes()


class Shard:
    """Reads a packed shard; ``ids(i)`` decodes one document, ``all_ids()`` the whole shard."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a shard of token ids")
        self.n_docs, rules, symbols, width, self.base = struct.unpack_from("<5I", data, 4)
        at = 24
        parts = []
        for n in (rules, rules, rules, self.n_docs + 1, self.n_docs):
            parts.append(np.frombuffer(data, "<u4", n, at).astype(np.int64))
            at += 4 * n
        left, right, self.lengths, self.ends, self.counts = parts
        self.symbols = np.frombuffer(data, "<u2" if width == 2 else "<u4", symbols, at)
        # every rule's expansion, one after another: a rule's parts are shorter than itself
        self.starts = np.cumsum(self.lengths) - self.lengths
        flat = np.zeros(int(self.lengths.sum()), np.uint32)
        for size in np.unique(self.lengths).tolist():
            of = np.flatnonzero(self.lengths == size)
            split = np.where(left[of] < self.base, 1, self.lengths[np.maximum(left[of] - self.base, 0)])
            cell = np.arange(size)[None, :]
            from_left = cell < split[:, None]
            part = np.where(from_left, left[of][:, None], right[of][:, None])
            inside = np.where(from_left, cell, cell - split[:, None])
            deeper = part >= self.base
            source = self.starts[np.maximum(part - self.base, 0)] + inside if rules else inside
            flat[(self.starts[of][:, None] + cell).ravel()] = np.where(deeper, flat[np.where(deeper, source, 0)], part).ravel()
        self.flat = flat

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        symbols = symbols.astype(np.int64)
        rule = symbols - self.base
        deep = rule >= 0
        if not deep.any():
            return symbols.astype(np.uint32)
        size = np.where(deep, self.lengths[np.maximum(rule, 0)], 1)
        ends = np.cumsum(size)
        out = np.repeat(symbols.astype(np.uint32), size)
        inside = np.arange(int(ends[-1])) - np.repeat(ends - size, size)
        many = np.repeat(deep, size)
        out[many] = self.flat[np.repeat(self.starts[np.maximum(rule, 0)], size)[many] + inside[many]]
        return out

    def ids(self, i: int) -> np.ndarray:
        return self._expand(self.symbols[self.ends[i] : self.ends[i + 1]])

    def all_ids(self) -> tuple[np.ndarray, np.ndarray]:
        return self._expand(self.symbols), np.concatenate([[0], np.cumsum(self.counts)])


def write_shards(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, vocabulary: int = 50_257, shard_ids: int = SHARD_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, sort, compress and store; the table (part, seq, part_start, doc_ids, n_ids, shard) is read from storage.

    ``part`` ascends with the documents' ids; ``part_start`` counts the ids of the part before the shard.
    """
    kind = docs.schema[id_col].dataType
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text")).withColumn("part", F.spark_partition_id())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(tokenizer_path(tokenizer), "bytes")
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        n_held = seq = start = 0
        part = None

        def shard() -> pa.RecordBatch:
            nonlocal held, n_held, seq, start
            ids = np.concatenate([x[1] for x in held])
            offsets = np.concatenate([[0], np.cumsum(np.concatenate([x[2] for x in held]))])
            names = pa.concat_arrays([x[0] for x in held])
            row = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([start], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), pa.array([len(ids)], pa.int64()), pa.array([pack_shard(ids, offsets, vocabulary)], pa.binary())]
            held, n_held, seq, start = [], 0, seq + 1, start + len(ids)
            return pa.RecordBatch.from_arrays(row, ["part", "seq", "part_start", "doc_ids", "n_ids", "shard"])

        for b in batches:
            part = b.column(2)[0].as_py() if len(b) else part
            for i, n in row_ranges(text_sizes(b.column(1))):
                s = b.slice(i, n)
                ids, offsets = with_end(*code.encode(s.column(1)), end_id)
                held.append((s.column(0), ids, np.diff(offsets)))
                n_held += len(ids)
                if n_held >= shard_ids:
                    yield shard()
        if held:
            yield shard()

    packed = ranged.mapInArrow(pack, f"part int, seq int, part_start long, doc_ids array<{kind.simpleString()}>, n_ids long, shard binary")
    return written(packed, "token-ids")


def read_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the stored shards."""
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                shard = Shard(b.column(3)[i].as_py())
                ids, offsets = shard.all_ids()
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                part = pa.array(np.full(shard.n_docs, b.column(0)[i].as_py(), np.int32))
                yield pa.RecordBatch.from_arrays([b.column(2)[i].values, part, pa.array(b.column(1)[i].as_py() + offsets[:-1]), pa.array(shard.counts), pa.array(crc, pa.int64())], ["doc_id", "part", "in_part", "n_tokens", "ids_crc32"])

    rows = shards.select("part", "part_start", "doc_ids", "shard").mapInArrow(decode, f"doc_id {kind}, part int, in_part long, n_tokens long, ids_crc32 long")
    return rows.join(before, "part").select("doc_id", (F.col("before") + F.col("in_part")).alias("start"), "n_tokens", "ids_crc32")
