"""Repeated substrings of a corpus by merging shard Burrows-Wheeler transforms.

Every symbol covered by a string of ``length`` symbols that also starts anywhere else (in any text, the same one included) is marked.
A symbol is a byte, or with ``words`` a word.

1. *Texts once.*  Texts group by their MD5; a text with copies is repeated as a whole, and the rest of the work sees it once.
2. *Candidates.*  Each window of ``length`` symbols belongs to its leftmost smallest ``gram`` by hash (its anchor).  Equal
   windows have equal anchors at equal places, so only windows whose anchor's gram occurs twice can repeat: nothing is lost.
   A run of windows with one anchor is a region; of regions with equal content one is looked at.
3. *Shards and merge.*  Regions meet by anchor.  A task deals the regions of its groups to shards.  A shard's strings are read with a
   stride (one letter for each stride), its suffixes are sorted and its BWT is written down.  The
   shards' BWTs are then merged by refining their interleave: one stable pass over the merged BWT's letters turns the order by t - 1
   letters into the order by t letters, without sorting suffixes again.  A block border that first appears in pass t has a common
   prefix of t - 1 letters; after ``length / stride`` passes the blocks are the repeated intervals.
4. *Hot anchors.*  A group of more than ``MOST_REGIONS`` different regions is split before it meets.  Every window reaches over at least
   half of what it holds beside the anchor either to the left or to the right of it; the anchor and that half are a longer anchor, by
   which its windows meet instead.  Groups that are still too large are split again.  Equal windows always stay together, and an anchor
   as long as a window leaves one content, so every group comes to the merge in the end, with the same marks.

Contracts: a null text is empty; texts shorter than ``length`` have no marks of their own; matches never cross texts; rows with
equal ids are rows of their own, and their equal texts repeat each other; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .store import bucketed, written
from .tokenize import row_ranges, text_sizes

LENGTH, GRAM, STRIDE, SHARDS, MOST_REGIONS, PACK = 400, 64, 100, 4, 512, 400_000
#: The same for windows of words: a passage of over 50 words, anchored by eight of them.
PASSAGE_WORDS, WORD_GRAM, WORD_STRIDE = 51, 8, 17
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_SEGMENT = 1 << 20
_LOW = np.uint64((1 << 24) - 1)
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of a base, of its inverse, and a random value for each byte."""
    size = 1 << max(12, n.bit_length())
    if (which, size) not in _tables:
        base = _BASES[which] | 1
        up, down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64), dtype=np.uint64)]) for b in (base, pow(base, -1, 1 << 64)))
        _tables[which, size] = up, down, np.random.default_rng(1 + which).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return _tables[which, size]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def substring_hashes(x: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each substring of ``size`` symbols: bytes, or 64-bit hashes of words."""
    if len(x) < size:
        return np.zeros(0, np.uint64)
    up, down, value = _powers(which, len(x))
    letters = value[x] if x.dtype == np.uint8 else x * np.uint64(_BASES[which]) | np.uint64(1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters * up[: len(x)], dtype=np.uint64)])
    return _mixed((sums[size:] - sums[:-size]) * down[: len(x) - size + 1])


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, offsets of the texts in words, the words' first bytes, the bytes after them).

    ``offsets`` are those of the texts in ``data``; words end at ASCII white space.
    """
    inside = ~_SPACE[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begin[edges] = inside[edges]
    end[edges - 1] = inside[edges - 1]
    first, after = np.flatnonzero(begin), np.flatnonzero(end) + 1
    up, down, value = _powers(0, len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value[data] * up[: len(data)], dtype=np.uint64)])
    return _mixed((sums[after] - sums[first]) * down[first]), np.searchsorted(first, offsets), first, after


def _symbols(data: np.ndarray, offsets: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(data, offsets)[:2] if words else (data, offsets)


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    n = len(v)
    full = np.full(-(-n // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    full[:n] = v
    rows = full.reshape(-1, w)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


def regions(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, number of windows, anchor's place from the first window, gram hash) of the texts data[offsets[i]:offsets[i + 1]] of symbols."""
    sizes = np.diff(offsets)
    text_of = np.repeat(np.arange(len(sizes)), sizes)
    found: list[tuple[np.ndarray, ...]] = []
    for s in range(0, len(data), _SEGMENT):
        x = data[s : s + _SEGMENT + length - 1]
        if len(x) < length:
            break
        grams = substring_hashes(x, gram)
        place = np.arange(len(grams), dtype=np.uint64)
        least = _sliding_min((grams & ~_LOW) | place, length - gram + 1)
        anchor = (least & _LOW).astype(np.int64)
        text = text_of[s : s + len(anchor)]
        windows = np.flatnonzero(s + np.arange(len(anchor)) + length <= offsets[1:][text])
        if not len(windows):
            continue
        text, anchor = text[windows], anchor[windows]
        start = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
        count = np.diff(np.concatenate([start, [len(windows)]]))
        first = windows[start]
        found.append((text[start], s + first - offsets[text[start]], count, anchor[start] - first, grams[anchor[start]]))
    if not found:
        return *(np.zeros(0, np.int64) for _ in range(4)), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


# --- Burrows-Wheeler transforms of shards and their merge -------------------------------------------------------------


def shard_bwt(symbols: np.ndarray, following: np.ndarray, preceding: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, BWT symbol of each) of a shard.

    ``symbols[p] > 0`` is the symbol at p, 0 the end of a string; ``following`` and ``preceding`` lead to the next and previous
    position of the string (an end follows itself; a first position is preceded by -1).  Ranks double until ``depth`` symbols are sorted.
    """
    rank, jump, known = symbols, following, 1
    while 2 * known < depth:
        _, rank = np.unique(rank * (int(rank.max()) + 1) + rank[jump], return_inverse=True)
        jump, known = jump[jump], 2 * known
    order = np.argsort(rank * (int(rank.max()) + 1) + rank[jump], kind="stable") if known < depth else np.argsort(rank, kind="stable")
    before = preceding[order]
    return order, np.where(before < 0, 0, symbols[before])


def merge_bwts(bwts: list[np.ndarray], passes: int) -> tuple[np.ndarray, np.ndarray]:
    """(interleave, common prefix) of shard BWTs over one alphabet.

    ``interleave[i]`` says whose suffix comes i-th; ``prefix[i]`` is the number of symbols that it shares with the one before it, as
    far as ``passes`` tell (then it is ``passes``).
    """
    z = np.repeat(np.arange(len(bwts), dtype=np.int8), [len(b) for b in bwts])
    n = len(z)
    block = np.zeros(n, np.int64)
    prefix = np.full(n, passes, np.int64)
    symbols = np.empty(n, np.int64)
    place = np.arange(n)
    for t in range(1, passes + 1):
        for k, b in enumerate(bwts):  # the j-th entry of shard k reads the j-th symbol of its BWT
            symbols[z == k] = b
        order = np.sort((symbols << 32) | place) & 0xFFFFFFFF
        z, by, source = z[order], symbols[order], block[order]
        border = np.ones(n, bool)
        border[1:] = (by[1:] != by[:-1]) | (source[1:] != source[:-1])
        prefix[border & (prefix == passes)] = t - 1
        block = np.cumsum(border) - 1
    return z, prefix


def repeated_windows(contents: list[np.ndarray], length: int = LENGTH, stride: int = STRIDE, shards: int = SHARDS) -> list[np.ndarray]:
    """For each content (an array of symbols), which of its windows also start in another content (or elsewhere in it): a boolean for each window.

    A string of a shard is a chain of every ``stride``-th place of a content; only chains on which a window starts are read.
    """
    sizes = np.array([len(c) for c in contents], np.int64)
    windows = sizes - length + 1
    hashes = substring_hashes(np.concatenate(contents), stride)
    offsets = np.cumsum(sizes) - sizes
    n_chains = np.minimum(windows, stride)
    of = np.repeat(np.arange(len(sizes)), n_chains)
    residue = np.arange(int(n_chains.sum())) - np.repeat(np.cumsum(n_chains) - n_chains, n_chains)
    links = (sizes[of] - stride - residue) // stride + 1
    owner, chain_residue = np.repeat(of, links), np.repeat(residue, links)
    step = np.arange(int(links.sum())) - np.repeat(np.cumsum(links) - links, links)
    inside = chain_residue + stride * step
    head, tail = step == 0, step == np.repeat(links, links) - 1
    _, symbol = np.unique(hashes[offsets[owner] + inside], return_inverse=True)
    symbol = symbol + 1
    shards = min(shards, len(contents))
    ranked: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for k in range(shards):
        mine = np.flatnonzero(owner % shards == k)
        n = len(mine)
        ends = np.flatnonzero(tail[mine])  # each gets the end of its string
        following = np.concatenate([np.arange(n) + 1, n + np.arange(len(ends))])
        following[ends] = n + np.arange(len(ends))
        preceding = np.concatenate([np.where(head[mine], -1, np.arange(n) - 1), ends])
        order, bwt = shard_bwt(np.concatenate([symbol[mine], np.zeros(len(ends), np.int64)]), following, preceding, length // stride)
        ranked.append((order, bwt, mine))
    z, prefix = merge_bwts([r[1] for r in ranked], length // stride)
    alike = prefix >= length // stride
    alike[0] = False
    repeated = alike.copy()
    repeated[:-1] |= alike[1:]
    ends = np.cumsum(windows)
    marks = np.zeros(int(ends[-1]), bool)
    for k, (order, _, mine) in enumerate(ranked):
        flags = repeated[z == k]
        real = order < len(mine)
        at, flags = mine[order[real]], flags[real]
        starts = inside[at] < windows[owner[at]]
        marks[(ends - windows)[owner[at[starts]]] + inside[at[starts]]] = flags[starts]
    return np.split(marks, ends[:-1])


def _runs(flags: np.ndarray) -> list[dict[str, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"lo": a, "hi": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]


_RUNS = "array<struct<lo:long,hi:long>>"
_RUN_TYPE = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))


# --- Spark jobs -------------------------------------------------------------------------------------------------------


def distinct_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(k, copies, raw) of the different texts, bucketed by k (their MD5), so that joins on it move no text."""
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    one = docs.select(raw.alias("raw")).withColumn("k", _key("raw")).groupBy("k").agg(F.count("*").alias("copies"), F.first("raw").alias("raw"))
    return bucketed(one, "texts", "k")


def _key(raw: str) -> Column:
    return F.unhex(F.md5(raw))


def _text_slices(b: pa.RecordBatch, words: bool) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, symbols of their texts, offsets of the texts) of about a megabyte each; the texts are the column ``raw``."""
    at = b.schema.names.index("raw")
    for i, n in row_ranges(text_sizes(b.column(at)), _SEGMENT):
        s = b.slice(i, n).take(pa.array(np.arange(n)))
        raw = s.column(at).cast(pa.large_binary())
        offsets = np.frombuffer(raw.buffers()[1], np.int64, n + 1, raw.offset * 8)
        data = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] is not None else np.zeros(0, np.uint8)
        yield s, *_symbols(data[offsets[0] : offsets[-1]], offsets - offsets[0], words)


def _anchored(texts: DataFrame, length: int, gram: int, words: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, symbols, offsets in _text_slices(b, words):
                text, first, count, place, key = regions(symbols, offsets, length, gram)
                of = pa.array(text)
                yield pa.RecordBatch.from_arrays([s.column(0).take(of), s.column(1).take(of), *(pa.array(x.astype(np.int32)) for x in (first, count, place)), pa.array(key.view(np.int64))], ["k", "copies", "first", "windows", "place", "anchor"])

    return texts.select("k", "copies", "raw").mapInArrow(run, "k binary, copies long, first int, windows int, place int, anchor long")


def _listed(b: pa.RecordBatch, offsets: np.ndarray, names: list[str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Of a batch's lists ``regions``: (row of each entry, the named fields); field ``first`` counts from the batch's first symbol."""
    lists = b.column(b.schema.names.index("regions"))
    row = np.repeat(np.arange(len(b)), np.diff(lists.offsets.to_numpy()))
    entries = lists.flatten()
    fields = {x: entries.field(x).to_numpy(zero_copy_only=False) if entries.type.field(x).type != pa.binary() else entries.field(x) for x in names}
    fields["at"] = offsets[row] + fields["first"]
    return row, fields


def _digests(texts: DataFrame, suspects: DataFrame, length: int, words: bool) -> DataFrame:
    """(k, copies, first, windows, place, anchor, c) of each suspect region: c is the hash of its content and its anchor's place."""
    listed = suspects.groupBy("k").agg(F.collect_list(F.struct("first", "windows", "place", "anchor")).alias("regions"))
    names = ["first", "windows", "place", "anchor"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            for s, symbols, offsets in _text_slices(b, words):
                row, r = _listed(s, offsets, names)
                body, wide = memoryview(np.ascontiguousarray(symbols)).cast("B"), symbols.itemsize
                lo, hi = (r["at"] * wide).tolist(), ((r["at"] + r["windows"] + length - 1) * wide).tolist()
                digest = [xxhash.xxh3_128_digest(body[x:y], p) for x, y, p in zip(lo, hi, r["place"].tolist(), strict=True)]
                of = pa.array(row)
                yield pa.RecordBatch.from_arrays([s.column(0).take(of), s.column(1).take(of), *(pa.array(r[x]) for x in names), pa.array(digest, pa.binary())], ["k", "copies", *names, "c"])

    return texts.join(listed, "k").select("k", "copies", "raw", "regions").mapInArrow(run, "k binary, copies long, first int, windows int, place int, anchor long, c binary")


def _contents(texts: DataFrame, wanted: DataFrame, length: int, words: bool) -> DataFrame:
    """(anchor, many, c, copies, lo, content) of the wanted regions (k, first, windows, place and these), each content once; its anchor begins at lo."""
    names = ["first", "windows", "place", "anchor", "many", "copies", "c"]
    listed = wanted.groupBy("k").agg(F.collect_list(F.struct(*names)).alias("regions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, symbols, offsets in _text_slices(b, words):
                _, r = _listed(s, offsets, names)
                body, wide = memoryview(np.ascontiguousarray(symbols)).cast("B"), symbols.itemsize
                lo, hi = (r["at"] * wide).tolist(), ((r["at"] + r["windows"] + length - 1) * wide).tolist()
                for i in range(0, len(lo), 4000):
                    some = slice(i, i + 4000)
                    content = pa.array([bytes(body[x:y]) for x, y in zip(lo[some], hi[some], strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(r["anchor"][some]), pa.array(r["many"][some]), r["c"][some], pa.array(r["copies"][some]), pa.array(r["place"][some]), content], ["anchor", "many", "c", "copies", "lo", "content"])

    return texts.select("k", "raw").join(listed, "k").select("k", "raw", "regions").mapInArrow(run, "anchor long, many long, c binary, copies long, lo int, content binary")


def _merged(groups: DataFrame, length: int, stride: int, shards: int, kind: type) -> DataFrame:
    """(c, runs): repeated windows of the regions of whole anchor groups."""
    n = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack: list[tuple[bytes, np.ndarray, int]] = []
        size, anchor = 0, None

        def done() -> pa.RecordBatch:
            marks = repeated_windows([p[1] for p in pack], length, stride, shards)
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pack], pa.binary()), pa.array([_runs(np.ones(len(m), bool) if p[2] > 1 else m) for p, m in zip(pack, marks, strict=True)], _RUN_TYPE)], ["c", "runs"])

        for b in batches:
            for a, c, content, copies in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if a != anchor and size >= PACK:
                    yield done()
                    pack, size = [], 0
                anchor = a
                pack.append((c, np.frombuffer(content, kind), copies))
                size += len(pack[-1][1])
        if pack:
            yield done()

    return groups.repartition(n, "anchor").sortWithinPartitions("anchor", "c").select("anchor", "c", "content", "copies").mapInArrow(run, f"c binary, runs {_RUNS}")


def halved(content: bytes, lo: int, hi: int, length: int, wide: int) -> Iterator[tuple[int, bytes, int, int]]:
    """(first window, content, lo, hi) of the one or two parts of a region whose anchor is [lo, hi): windows that hold half of what is
    beside the anchor to the left of it, and the others, which hold as much to the right; the half belongs to the new anchor.

    Places count in symbols of ``wide`` bytes.
    """
    windows = len(content) // wide - length + 1
    half = -(-(length - (hi - lo)) // 2)
    cut = min(max(lo - half + 1, 0), windows)
    for x, y, begin, end in ((0, cut, lo - half, hi), (cut, windows, lo, hi + half)):
        if x < y:
            yield x, content[x * wide : (y - 1 + length) * wide], begin - x, end - x


def _halves(hot: DataFrame, anchor_size: int, length: int, wide: int) -> DataFrame:
    """(parent, base, anchor, c, copies, lo, content): the parts of regions whose anchors have ``anchor_size`` symbols; base is a part's first window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            out: list[tuple] = []
            for c, copies, lo, content in zip(*(x.to_pylist() for x in b.columns), strict=True):
                for base, part, begin, end in halved(content, lo, lo + anchor_size, length, wide):
                    left = int(begin + base < lo)
                    anchor = xxhash.xxh3_64_intdigest(part[begin * wide : end * wide], left)
                    out.append((c, base, anchor - (anchor >> 63 << 64), xxhash.xxh3_128_digest(part, anchor_size << 32 | 2 * begin + left), copies, begin, part))
            kinds = (pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["parent", "base", "anchor", "c", "copies", "lo", "content"])

    return hot.select("c", "copies", "lo", "content").mapInArrow(run, "parent binary, base int, anchor long, c binary, copies long, lo int, content binary")


def _whole(c: DataFrame, windows: Column) -> DataFrame:
    """(c, runs) of contents all whose windows repeat."""
    return c.select("c", F.array(F.struct(F.lit(0).cast("long").alias("lo"), windows.cast("long").alias("hi"))).alias("runs"))


def _marked(content: DataFrame, length: int, gram: int, stride: int, shards: int, kind: type, most_regions: int) -> DataFrame:
    """(c, runs): repeated windows of the contents of groups of two or more; a content that was split has a row for each of its parts."""
    wide, size = np.dtype(kind).itemsize, gram
    groups = content.where(F.col("many") <= most_regions).select("anchor", "c", "content", "copies")
    hot, origins, sure = content.where(F.col("many") > most_regions), None, None
    while not hot.isEmpty():
        parts = written(_halves(hot, size, length, wide), "halves")
        size += -(-(length - size) // 2)
        step = parts.select(F.col("parent").alias("above"), F.col("base").alias("more"), F.col("c").alias("below"))
        if origins is None:
            origins = step.select(F.col("above").alias("origin"), F.col("more").alias("base"), F.col("below").alias("c"))
        else:
            deeper = origins.join(step, F.col("c") == F.col("above")).select("origin", (F.col("base") + F.col("more")).alias("base"), F.col("below").alias("c"))
            origins = written(origins.unionByName(deeper), "origins")
        once = written(parts.groupBy("anchor", "c").agg(F.sum("copies").alias("copies"), F.first("lo").alias("lo"), F.first("content").alias("content")), "parts")
        found = once.join(once.groupBy("anchor").agg(F.count("*").alias("many")), "anchor")
        groups = groups.unionByName(found.where(f"many BETWEEN 2 AND {most_regions}").select(*groups.columns))
        alone = _whole(found.where("many = 1 AND copies > 1"), F.length("content") / wide - (length - 1))
        sure = alone if sure is None else sure.unionByName(alone)
        hot = found.where(F.col("many") > max(1, most_regions))
    marks = _merged(groups, length, stride, shards, kind)
    if origins is None:
        return marks
    marks = written(marks.unionByName(sure).where(F.size("runs") > 0), "part-marks")
    of_parts = origins.join(marks, "c").select(F.col("origin").alias("c"), F.transform("runs", lambda r: F.struct((r["lo"] + F.col("base")).alias("lo"), (r["hi"] + F.col("base")).alias("hi"))).alias("runs"))
    return marks.unionByName(of_parts)


def repeated_spans(texts: DataFrame, length: int = LENGTH, words: bool = False, stride: int | None = None, gram: int | None = None, most_regions: int = MOST_REGIONS, shards: int = SHARDS) -> DataFrame:
    """(k, spans) of ``distinct_texts``: for each text the window runs [lo, hi) that repeat, in bytes or in words."""
    stride, gram = stride or (WORD_STRIDE if words else STRIDE), gram or (WORD_GRAM if words else GRAM)
    if length % stride or gram > length:
        raise ValueError("the length is a multiple of the stride, and a gram is no longer than the length")
    kind = np.uint64 if words else np.uint8
    anchors = written(_anchored(texts, length, gram, words), "anchors")
    # each side of the joins below is a table, so that a hot key's rows can be split over tasks
    twice = written(anchors.groupBy("anchor").agg(F.sum("copies").alias("n")).where("n > 1").select("anchor"), "twice")
    held = written(_digests(texts, anchors.join(twice, "anchor"), length, words), "regions")
    once = written(held.groupBy("anchor", "c").agg(F.sum("copies").alias("copies"), F.min(F.struct("k", "first", "windows", "place")).alias("one")), "contents")
    groups = written(once.groupBy("anchor").agg(F.count("*").alias("many")).where("many > 1"), "groups")
    # the only content of its anchor is there twice itself
    sure = _whole(once.join(groups, "anchor", "left_anti"), F.col("one.windows"))
    found = _contents(texts, once.join(groups, "anchor").select("one.*", "anchor", "many", "copies", "c"), length, words)
    content = written(found, "bodies")
    marked = _marked(content, length, gram, stride, shards, kind, most_regions)
    marks = written(sure.unionByName(marked).where(F.size("runs") > 0), "marks")
    spans = held.select("k", "first", "c").join(marks, "c").select("k", F.transform("runs", lambda r: F.struct((r["lo"] + F.col("first")).alias("lo"), (r["hi"] + F.col("first")).alias("hi"))).alias("runs"))
    return spans.groupBy("k").agg(F.flatten(F.collect_list("runs")).alias("spans"))


def _cover(runs: list[dict[str, int]] | None, n: int, copies: int, length: int) -> list[tuple[int, int]]:
    """The maximal stretches of a text of ``n`` bytes that repeated windows cover."""
    if copies > 1 and n >= length:
        return [(0, n)]
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((r["lo"], r["hi"] + length - 1) for r in runs or []):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def _kept(raw: bytes, cover: list[tuple[int, int]]) -> bytes:
    ends = [0, *(hi for _, hi in cover)]
    starts = [*(lo for lo, _ in cover), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(ends, starts, strict=True))


def word_cover(raw: bytes, runs: list[dict[str, int]] | None, copies: int, words: int) -> tuple[list[tuple[int, int]], int, int]:
    """(stretches of bytes from a word's begin to a word's end that repeated windows of ``words`` words cover, their words, their number)."""
    if copies < 2 and not runs:
        return [], 0, 0
    data = np.frombuffer(raw, np.uint8)
    _, ends, first, after = word_hashes(data, np.array([0, len(data)]))
    if copies > 1:
        runs = [{"lo": 0, "hi": len(first) - words + 1}] if len(first) >= words else []
    cover = _union([(r["lo"], r["hi"] + words - 1) for r in runs or []])
    return [(int(first[lo]), int(after[hi - 1])) for lo, hi in cover], sum(hi - lo for lo, hi in cover), len(cover)


def _union(cover: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(cover):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def _with_spans(docs: DataFrame, length: int, words: int | None, text_col: str, how: dict[str, int]) -> DataFrame:
    """(k, copies, raw, spans, w_spans) of the different texts: repeated window runs in bytes and, with ``words``, in words."""
    texts = distinct_texts(docs, text_col)
    found = texts.join(repeated_spans(texts, length, **how), "k", "left")
    if words is None:
        return found.withColumn("w_spans", F.lit(None).cast(_RUNS))
    stride = WORD_STRIDE if words % WORD_STRIDE == 0 else next(words // n for n in (3, 4, 2, 5, 1) if words % n == 0)
    in_words = repeated_spans(texts, words, True, stride, min(WORD_GRAM, words))
    return found.join(in_words.withColumnRenamed("spans", "w_spans"), "k", "left")


def remove_repeats(docs: DataFrame, length: int = LENGTH, text_col: str = "text", words: int | None = PASSAGE_WORDS, **how: int) -> DataFrame:
    """(k, n_bytes, n_removed, n_spans, kept_sha256, passage_words, n_passages) of the different texts; k is the text's MD5.

    The bytes removed are those of repeated strings of ``length`` bytes.  ``passage_words`` counts the words inside strings of ``words``
    words that also start elsewhere (0 without ``words``), ``n_passages`` the maximal runs of them.
    """
    names = ["k", "n_bytes", "n_removed", "n_spans", "kept_sha256", "passage_words", "n_passages"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for k, copies, raw, runs, w_runs in zip(*(x.to_pylist() for x in b.columns), strict=True):
                cover = _cover(runs, len(raw), copies, length)
                kept = _kept(raw, cover)
                _, n_words, n_passages = word_cover(raw, w_runs, copies if words else 1, words or 0)
                rows.append((k, len(raw), len(raw) - len(kept), len(cover), hashlib.sha256(kept).hexdigest(), n_words, n_passages))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names)

    return _with_spans(docs, length, words, text_col, how).select("k", "copies", "raw", "spans", "w_spans").mapInArrow(run, "k binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, passage_words long, n_passages long")


def without_repeats(docs: DataFrame, length: int = LENGTH, text_col: str = "text", words: int | None = None, **how: int) -> DataFrame:
    """``docs`` with the repeated bytes cut out of the texts; a character that is cut in two goes as a whole.

    With ``words``, passages of that many words that occur twice are cut out as well, whatever their bytes and the white space between them.
    Every row stays, with a null text as null; the other columns are as they were.
    """
    rest = [c for c in docs.columns if c != text_col]
    keyed = docs.select(*(F.col(c).alias(f"o{i}") for i, c in enumerate(rest)), F.col(text_col).isNull().alias("was_null"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("own")).withColumn("k", _key("own")).drop("own")
    found = _with_spans(docs, length, words, text_col, how).join(keyed, "k").select("copies", "raw", "spans", "w_spans", "was_null", *(f"o{i}" for i in range(len(rest))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for copies, raw, runs, w_runs, null in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                cover = _cover(runs, len(raw), copies, length)
                if words:
                    cover = _union(cover + word_cover(raw, w_runs, copies, words)[0])
                out.append(None if null else raw.decode() if not cover else _kept(raw, cover).decode(errors="ignore"))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *b.columns[5:]], ["text", *b.schema.names[5:]])

    kinds = StructType().add("text", "string")
    for i, c in enumerate(rest):
        kinds.add(f"o{i}", docs.schema[c].dataType)
    done = found.mapInArrow(run, kinds)
    return done.select(*(F.col("text").alias(c) if c == text_col else F.col(f"o{rest.index(c)}").alias(c) for c in docs.columns))


def dedup_substrings(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", words: int | None = PASSAGE_WORDS, **how: int) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, passage_words, n_passages) of every row."""
    done = written(remove_repeats(docs, length, text_col, words, **how), "kept")
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("own")).withColumn("k", _key("own")).drop("own")
    return keyed.join(done, "k").drop("k")
