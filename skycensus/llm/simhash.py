"""SimHash near-duplicates: fingerprints of word shingles, linked by a self-join of binary tries.

Documents with one fingerprint meet in a partially aggregated group first, so the join sees each fingerprint once.  Two
fingerprints that differ in at most k bits agree on at least b - k of b bit blocks, so each fingerprint goes to one bucket for every
choice of b - k blocks; no bucket can miss a link.  In a task, all buckets' fingerprints form one sorted array that is read as
a binary trie: node pairs are traversed together from (root, root) downwards, each step adds the bits on which the two sides
differ, and a pair is dropped once the sum exceeds the budget.  A bucket's links leave it as at most one edge for each
fingerprint (to its local component), so their number stays linear.  Components over all buckets come from repeated
hooking to smaller neighbours in Spark; no links, components or fingerprints go to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected
from .store import bucketed, written
from .tokenize import row_ranges, text_sizes
from .toxicity import _words

BITS = 64


def fingerprint(text: bytes, size: int = 3) -> int:
    """The unsigned SimHash of the text's ``size``-word shingles: bit set if it is set in over half of the hashes."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)), np.uint64, len(words) - size + 1)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[i : i + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long): the fingerprint's bits as a signed long.  Null and blank texts have 0."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", size) for x in b.column(1)), np.uint64, len(b))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("raw")).mapInArrow(run, f"doc_id {kind}, fp long")


def _split(value: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """For each interval of a sorted array whose values agree above ``bit``, where the ones of that bit begin."""
    a, b = lo.copy(), hi.copy()
    one = np.uint64(1 << bit)
    while (open_ := a < b).any():
        mid = (a + b) >> 1
        set_ = (value[np.minimum(mid, len(value) - 1)] & one) != 0
        b = np.where(open_ & set_, mid, b)
        a = np.where(open_ & ~set_, mid + 1, a)
    return a


def trie_pairs(value: np.ndarray, lo: np.ndarray, hi: np.ndarray, budget: int, most: int = 1 << 16, label: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j within ``budget`` bits, inside each interval [lo, hi) of ``value`` (sorted in each interval).

    With ``label``, only pairs of different labels: two nodes that hold one label and no other are not traversed.

    A node of a trie is an interval and a level.  A node pair (p, q) has p = q or p before q; its children are paired in turn.
    Pairs wait in chunks of one level on a stack, so that a chunk never grows beyond about ``most`` node pairs.
    """
    stack = [(BITS - 1, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    if label is not None and len(label):
        ends = np.concatenate([np.flatnonzero(label[1:] != label[:-1]) + 1, [len(label)]])
        same_to = np.repeat(ends, np.diff(ends, prepend=0))
    while stack:
        bit, a, b, c, d, diff = stack.pop()
        if label is not None and len(a):
            mixed = (same_to[a] < b) | (same_to[c] < d) | (label[a] != label[c])
            a, b, c, d, diff = (x[mixed] for x in (a, b, c, d, diff))
        if len(a) > most:
            half = len(a) // 2
            stack += [(bit, *(x[:half] for x in (a, b, c, d, diff))), (bit, *(x[half:] for x in (a, b, c, d, diff)))]
            continue
        # a pair of leaves is settled at once
        leaf = (b - a == 1) & (d - c == 1)
        if leaf.any():
            i, j = a[leaf], c[leaf]
            near = np.bitwise_count(value[i] ^ value[j]) <= budget
            near &= i != j
            if near.any():
                yield i[near], j[near]
            a, b, c, d, diff = (x[~leaf] for x in (a, b, c, d, diff))
        if not len(a):
            continue
        # below the last bit all values of a node are equal, and its entries are halved
        m, n = (_split(value, a, b, bit), _split(value, c, d, bit)) if bit >= 0 else ((a + b) >> 1, (c + d) >> 1)
        own, cross = a == c, int(bit >= 0)
        parts = []
        for u, v, x, y, more, mirror in ((a, m, c, n, 0, False), (m, b, n, d, 0, False), (a, m, n, d, cross, False), (m, b, c, n, cross, True)):
            ok = (u < v) & (x < y) & (diff + more <= budget)
            if mirror:
                ok &= ~own  # the mirror image of the third kind
            parts.append((u[ok], v[ok], x[ok], y[ok], (diff + more)[ok].astype(np.int8)))
        kids = [np.concatenate(x) for x in zip(*parts, strict=True)]
        if len(kids[0]):
            stack.append((bit - 1, *kids))


def bucket_keys(blocks: int, budget: int) -> list[int]:
    """A mask for each choice of ``blocks - budget`` of the bit blocks."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    mask = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(mask[i] for i in some) for some in combinations(range(blocks), blocks - budget)]


def sampled_keys(tables: int, bits: int, seed: int = 5) -> list[int]:
    """A mask of ``bits`` random bits for each table."""
    rng = np.random.default_rng(seed)
    return [sum(1 << int(i) for i in rng.choice(BITS, bits, replace=False)) for _ in range(tables)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def local_links(buckets: np.ndarray, fps: np.ndarray, nodes: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component in the bucket) of all buckets of a task."""
    order = np.lexsort((fps, buckets))
    buckets, fps, nodes = buckets[order], fps[order], nodes[order]
    lo = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
    hi = np.concatenate([lo[1:], [len(fps)]])
    many = hi - lo > 1
    root = np.arange(len(fps))
    for i, j in trie_pairs(fps, lo[many], hi[many], budget):
        # hook the larger root under the smaller until each pair agrees
        while True:
            ri, rj = root[i], root[j]
            apart = ri != rj
            if not apart.any():
                break
            i, j, ri, rj = i[apart], j[apart], ri[apart], rj[apart]
            np.minimum.at(root, np.maximum(ri, rj), np.minimum(ri, rj))
            while (deeper := root[root] != root).any():
                root = np.where(deeper, root[root], root)
    smallest = nodes.copy()
    np.minimum.at(smallest, root, nodes)
    to = smallest[root]
    edge = nodes != to
    return nodes[edge], to[edge]


def links(nodes: DataFrame, budget: int, blocks: int) -> DataFrame:
    """Edges (src, dst) that connect exactly the (node, fp) rows within ``budget`` bits of each other."""
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    masks = bucket_keys(blocks, budget)
    keys = F.array(*(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks)))
    spread = nodes.select("node", "fp", F.explode(keys).alias("bucket")).repartition(n, "bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[b.column(i).to_numpy() for i in range(3)] for b in batches]
        if not got:
            return
        node, fp, bucket = (np.concatenate(x) for x in zip(*got, strict=True))
        src, dst = local_links(bucket, fp.view(np.uint64), node, budget)
        yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])

    return spread.mapInArrow(run, "src long, dst long")


def near_duplicates(docs: DataFrame, size: int = 3, budget: int = 2, blocks: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    Fingerprints link at ``budget`` or fewer differing bits; ``component_id`` is the smallest doc_id reachable.  Null and
    blank texts have fingerprint zero and link like any other; repeated rows give repeated rows; rows with a null id get
    their component's smallest id that is not null (null if there is none); other columns are ignored.
    """
    prints = written(fingerprints(docs, size, id_col, text_col), "simhash")
    groups = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-groups")
    # a fingerprint is its own node: it is unique, and it is there when all ids are null
    nodes = groups.select(F.col("fp").alias("node"), "fp")
    labels = connected(links(nodes, budget, blocks))
    linked = groups.join(labels, groups.fp == labels.node).select("fp", "least", "root")
    roots = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(roots, "root").select("fp", "component_id").unionByName(groups.join(labels, groups.fp == labels.node, "left_anti").select("fp", F.col("least").alias("component_id")))
    named = written(named, "simhash-components")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# --- near-duplicate documents by shingle similarity -----------------------------------------------------------------------


#: Least bits of a text's parity sketch; words of sketches compared at once; partners that a member of a bucket gets in the second round, and their growth from round to round.
SKETCH, SKETCH_WORDS, PARTNERS, GROWTH = 256, 1 << 20, 8, 8
#: Buckets up to this size are searched whole for members without any partner, which then leave; larger ones keep all members.
SMALL = 64
_MEMBER = "bucket long, node long, fp long, n int, sketch binary"


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """The sorted 32-bit hashes of the text's different ``size``-word shingles."""
    import xxhash

    words = (text or "").encode().lower().split()
    grams = {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()
    return np.unique(np.fromiter((xxhash.xxh32_intdigest(g) for g in grams), np.uint32, len(grams)))


def parity_sketch(h: np.ndarray) -> bytes:
    bits = max(SKETCH, 1 << max(0, len(h) - 1).bit_length())
    return np.packbits(np.bincount(h & np.uint32(bits - 1), minlength=bits).astype(np.uint8) & 1).tobytes()


class Sketches:
    """Parity sketches one after another; a longer one folds to a shorter one's length by the parity of its halves."""

    def __init__(self, words: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        self.words, self.start, self.size = words, start, size

    @classmethod
    def of(cls, bodies: list[bytes]) -> Sketches:
        size = np.fromiter(map(len, bodies), np.int64, len(bodies)) // 8
        return cls(np.frombuffer(b"".join(bodies), np.uint64), np.cumsum(size) - size, size)

    def __getitem__(self, rows: np.ndarray) -> Sketches:
        return Sketches(self.words, self.start[rows], self.size[rows])

    def bodies(self, rows: np.ndarray) -> list[bytes]:
        return [self.words[a : a + n].tobytes() for a, n in zip(self.start[rows].tolist(), self.size[rows].tolist(), strict=True)]

    def folded(self, rows: np.ndarray, wide: int) -> np.ndarray:
        """The sketches of ``rows`` in ``wide`` words."""
        at = np.arange(wide)
        out = self.words[self.start[rows][:, None] + at]
        for k in range(1, int(self.size[rows].max()) // wide):
            longer = self.size[rows] > k * wide
            out[longer] ^= self.words[self.start[rows[longer]][:, None] + k * wide + at]
        return out

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """In how many bits the sketches of each pair differ, at the length of the shorter one."""
        out = np.zeros(len(i), np.int64)
        wide = np.minimum(self.size[i], self.size[j])
        for w in np.unique(wide).tolist():
            at = np.flatnonzero(wide == w)
            step = max(1, SKETCH_WORDS // w)
            for s in range(0, len(at), step):
                x = at[s : s + step]
                out[x] = np.bitwise_count(self.folded(i[x], w) ^ self.folded(j[x], w)).sum(axis=1, dtype=np.int64)
        return out


def word_set_fingerprints(texts: DataFrame, size: int) -> DataFrame:
    """(node, fp, n, sketch) of (node, text): the SimHash of each text's different words, so that an edited word moves few bits; the
    number of its shingle hashes; and for each value of their low bits, whether an odd number of them has it (as many bits as hashes, in
    powers of two: in fewer, long texts would all look alike)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            for i, n in row_ranges(text_sizes(b.column(1)), 4 << 20):
                s = b.slice(i, n)
                rows, codes, names = _words(s.column(1))
                hashes = np.array([xxhash.xxh64_intdigest(w) for w in names], np.uint64)
                pairs = np.unique(rows * max(1, len(names)) + codes)
                row, code = pairs // max(1, len(names)), pairs % max(1, len(names))
                real = np.array([bool(w) for w in names], bool)[code] if names else np.zeros(0, bool)
                row, code = row[real], code[real]
                fps = np.zeros(n, np.uint64)
                cut = np.searchsorted(row, np.arange(n + 1))
                for r in np.flatnonzero(np.diff(cut)).tolist():
                    fps[r] = majority(hashes[code[cut[r] : cut[r + 1]]])
                counts, sketches = [], []
                for x in s.column(1):
                    h = shingle_hashes(x.as_py(), size)
                    counts.append(len(h))
                    sketches.append(parity_sketch(h))
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array(fps.view(np.int64)), pa.array(counts, pa.int32()), pa.array(sketches, pa.binary())], ["node", "fp", "n", "sketch"])

    return texts.mapInArrow(run, "node long, fp long, n int, sketch binary")


def may_link(n: np.ndarray, sketch: Sketches, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the pairs (i, j) can reach ``similarity``; false only for pairs that cannot.

    Two sets differ in at least as many elements as their parity sketches in bits, which bounds what they can have in common.
    """
    ok = np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j])
    some = np.flatnonzero(ok)
    i, j = i[some], j[some]
    both = (n[i] + n[j] - sketch.apart(i, j)) // 2
    ok[some] = both >= similarity * (n[i] + n[j] - both)
    return ok


def _gathered(batches: Iterator[pa.RecordBatch]) -> tuple[list, np.ndarray, np.ndarray] | None:
    """The task's rows by (bucket, fp): all columns, where the buckets of two rows or more begin, and where they end."""
    cols: list[list] = []
    for b in batches:
        cols.append([c.to_pylist() if pa.types.is_binary(c.type) else c.to_numpy() for c in b.columns])
    if not sum(len(c[0]) for c in cols):
        return None
    got = [Sketches.of([body for some in x for body in some]) if isinstance(x[0], list) else np.concatenate(x) for x in zip(*cols, strict=True)]
    got[2], got[3] = got[2].view(np.uint64), got[3].astype(np.int64)
    order = np.lexsort((got[1], got[2], got[0]))
    got = [x[order] for x in got]
    lo = np.flatnonzero(np.concatenate([[True], got[0][1:] != got[0][:-1]]))
    hi = np.concatenate([lo[1:], [len(order)]])
    return got, lo[hi - lo > 1], hi[hi - lo > 1]


def opening_links(fps: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): each member of the buckets [lo, hi) with the next one in order, and with the bucket's medoid.

    The medoid is the fingerprint nearest to the bits' majority: of a family of near copies, the one in the middle.
    """
    a, b = [], []
    for s in range(0, len(lo), 1 << 12):
        x, y = lo[s : s + (1 << 12)], hi[s : s + (1 << 12)]
        sizes = y - x
        first = np.cumsum(sizes) - sizes
        row = np.repeat(x - first, sizes) + np.arange(int(sizes.sum()))
        ones = np.add.reduceat(np.unpackbits(fps[row].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1), first, axis=0, dtype=np.int32)
        center = np.packbits(2 * ones > sizes[:, None], axis=1).view(">u8").ravel().astype(np.uint64)
        bucket = np.repeat(np.arange(len(x)), sizes)
        medoid = row[np.lexsort((row, np.bitwise_count(fps[row] ^ center[bucket]), bucket))[first]]
        a += [np.delete(row, first + sizes - 1), medoid[bucket]]
        b += [np.delete(row, first), row]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def bucket_members(prints: DataFrame, budget: int, masks: list[int], similarity: float) -> DataFrame:
    """(bucket, node, fp, n, sketch, mates) of the buckets' members; ``mates`` are the opening round's partners.

    Members that nothing in their bucket comes near to are left out: chance brings them together, more and more with more texts.
    """
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = F.array(*(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks)))
    spread = prints.withColumn("bucket", F.explode(keys)).select("bucket", "node", "fp", "n", "sketch").repartition(n, "bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _gathered(batches)
        if got is None:
            return
        (bucket, node, fp, size, sketch), lo, hi = got
        i, j = opening_links(fp, lo, hi)
        ok = (i != j) & (np.bitwise_count(fp[i] ^ fp[j]) <= budget)
        i, j = i[ok], j[ok]
        ok = may_link(size, sketch, i, j, similarity)
        i, j = i[ok], j[ok]
        order = np.argsort(j, kind="stable")
        i, j = i[order], j[order]
        cut = np.searchsorted(j, np.arange(len(fp) + 1))
        mates = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(node[i]))
        stays = np.zeros(len(fp), bool)
        small = hi - lo <= SMALL
        for x, y in zip(lo[~small].tolist(), hi[~small].tolist(), strict=True):
            stays[x:y] = True
        for x, y in trie_pairs(fp, lo[small], hi[small], budget):
            near = may_link(size, sketch, x, y, similarity)
            stays[x[near]] = stays[y[near]] = True
        rows = pa.array(np.flatnonzero(stays))
        cols = [pa.array(bucket), pa.array(node), pa.array(fp.view(np.int64)), pa.array(size.astype(np.int32))]
        for s in range(0, len(rows), 10_000):
            some = rows[s : s + 10_000]
            yield pa.RecordBatch.from_arrays([*(c.take(some) for c in cols), pa.array(sketch.bodies(some.to_numpy()), pa.binary()), mates.take(some)], ["bucket", "node", "fp", "n", "sketch", "mates"])

    return spread.mapInArrow(run, f"{_MEMBER}, mates array<long>")


def cross_pairs(members: DataFrame, budget: int, similarity: float, most: int) -> DataFrame:
    """(a, b, bucket) of (bucket, node, fp, n, sketch, root): pairs of different roots that are within the budget and may link.

    Each member of a bucket gets its ``most`` nearest ones.  Where that is not all, a row without a and b names the bucket.
    """
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _gathered(batches)
        if got is None:
            return
        (bucket, node, fp, size, sketch, root), lo, hi = got
        held, waiting = [np.zeros(0, np.int64)] * 2, 0
        more = np.zeros(len(fp), bool)

        def nearest(i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
            off = np.bitwise_count(fp[i] ^ fp[j])
            x, y, pair = np.concatenate([i, j]), np.concatenate([j, i]), np.tile(np.arange(len(i)), 2)
            by = np.lexsort((node[y], np.tile(off, 2), x))
            x, pair = x[by], pair[by]
            start = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
            rank = np.arange(len(x)) - np.repeat(start, np.diff(start, append=len(x)))
            keep = np.zeros(len(i), bool)
            keep[pair[rank < most]] = True
            more[i[~keep]] = True
            return [i[keep], j[keep]]

        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for i, j in trie_pairs(fp, lo, hi, budget, label=root):
            ok = (root[i] != root[j]) & may_link(size, sketch, i, j, similarity)
            parts.append((i[ok], j[ok]))
            waiting += int(ok.sum())
            if waiting > 1 << 20:
                held = nearest(*(np.concatenate([h, *p]) for h, p in zip(held, zip(*parts, strict=True), strict=True)))
                parts, waiting = [], 0
        if parts:
            held = nearest(*(np.concatenate([h, *p]) for h, p in zip(held, zip(*parts, strict=True), strict=True)))
        i, j = held
        for s in range(0, len(i), 100_000):
            x, y = node[i[s : s + 100_000]], node[j[s : s + 100_000]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.nulls(len(x), pa.int64())], ["a", "b", "bucket"])
        full = np.unique(bucket[more])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(full), pa.int64()), pa.nulls(len(full), pa.int64()), pa.array(full)], ["a", "b", "bucket"])

    return members.select("bucket", "node", "fp", "n", "sketch", "root").repartition(n, "bucket").mapInArrow(run, "a long, b long, bucket long")


def shingle_sets(texts: DataFrame, size: int) -> DataFrame:
    """(node, shingles): the sorted 32-bit hashes of each text's different ``size``-word shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            body = [shingle_hashes(x.as_py(), size).tobytes() for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(body, pa.binary())], ["node", "shingles"])

    return texts.mapInArrow(run, "node long, shingles binary")


def compared(pairs: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """(a, b, ok) of all pairs: whether their shingles are alike by ``similarity``."""
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = written(shingle_sets(texts.join(asked, "node", "left_semi"), size), "shingles", "none")
    sides = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
                both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= similarity * max(len(x), len(y)) else 0
                ok.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    return written(sides.mapInArrow(verify, "a long, b long, ok boolean"), "compared")


def near_labels(prints: DataFrame, texts: DataFrame, size: int, similarity: float, budget: int, masks: list[int]) -> DataFrame:
    """(node, root) of linked texts: components of all pairs of a bucket that are within the budget and alike.

    An opening round compares each member with two others, which gathers most of a family whatever its size.  Each later round
    compares members with their nearest ones of other components, more of them from round to round, until no bucket holds a pair of two
    components that has not been compared.
    """
    members = written(bucket_members(prints, budget, masks, similarity), "members")
    mates = members.select("node", F.explode("mates").alias("mate"))
    pairs = written(mates.select(F.least("node", "mate").alias("a"), F.greatest("node", "mate").alias("b")).distinct(), "candidates")
    done = compared(pairs, texts, size, similarity)
    edges = lambda t: t.where("ok").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    labels = written(connected(edges(done)), "near-labels")
    members, most = members.drop("mates"), PARTNERS
    while True:
        rooted = members.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
        found = written(cross_pairs(rooted, budget, similarity, most), "cross")
        pairs = written(found.where("a IS NOT NULL").select("a", "b").distinct().join(done, ["a", "b"], "left_anti"), "candidates")
        if not pairs.isEmpty():
            new = compared(pairs, texts, size, similarity)
            if not new.where("ok").isEmpty():
                known = labels.select(F.col("node").alias("src"), F.col("root").alias("dst"))
                labels = written(connected(known.unionByName(edges(new))), "near-labels")
            done = done.unionByName(new)
        full = found.where("a IS NULL").select("bucket").distinct()
        if full.isEmpty():
            return labels
        members, most = members.join(full, "bucket", "left_semi"), most * GROWTH


def drop_near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8, budget: int = 12, tables: int = 40, key_bits: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id; all columns stay as they are.

    Equal texts form a group.  Different texts are compared if SimHashes of their words come within ``budget`` bits and agree on all
    bits of one of ``tables`` samples; they are linked if the Jaccard similarity of their ``size``-word shingles reaches
    ``similarity``.  No pair of two groups is left out, however many partners a text has (see ``near_labels``).  Null and blank texts are equal texts.  Of rows with equal ids in a group one stays; a null id is the last choice.
    """
    of = {c: f"o{i}" for i, c in enumerate(docs.columns)}  # no column of the input can clash with those used here
    # texts are dealt once, by row: none of the joins below sends them again
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = bucketed(docs.select(*(F.col(c).alias(o) for c, o in of.items()), F.monotonically_increasing_id().alias("row")).repartition(n, "row"), "numbered", "row")
    name, body = of[id_col], F.coalesce(F.col(of[text_col]), F.lit(""))
    keyed = rows.select("row", F.col(name).alias("id"), F.unhex(F.md5(body)).alias("k"))
    groups = written(keyed.groupBy("k").agg(F.min("row").alias("node"), F.min_by("row", F.struct(F.col("id").isNull(), "id", "row")).alias("kept"), F.min("id").alias("least"), F.count("*").alias("n")), "texts")
    texts = rows.select(F.col("row").alias("node"), body.alias("text"))
    ones = texts.join(groups.select("node"), "node", "left_semi")
    prints = word_set_fingerprints(ones, size)
    labels = near_labels(prints, texts, size, similarity, budget, sampled_keys(tables, key_bits))
    named = groups.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    stays = named.groupBy("root").agg(F.min_by("kept", F.struct(F.col("least").isNull(), "least", "kept")).alias("row"))
    return rows.join(stays.select("row"), "row", "left_semi").select(*(F.col(o).alias(c) for c, o in of.items()))
