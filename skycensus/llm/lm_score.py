"""Language-model scores by deleted interpolation of bigram, unigram and uniform estimates.

Texts are tokenized once into chunks of some 10 MB; a chunk is one row with its distinct words (64-bit hashes) and a code for each
token, in a table bucketed by chunk.  Each chunk sends its distinct words and bigrams, with their training counts, to the key
ranges they belong to; a range adds up the counts of all chunks and returns the totals in the order of each chunk's own keys.
Hot words are thus aggregated before the shuffle, and no task holds more than a range or a chunk.  Totals are joined to their
chunks bucket by bucket, so that tokens are never shuffled.

Mixture weights depend on a bucket of the context's frequency (powers of two).  They are learned by expectation-maximisation on
deleted counts: each training token is scored by the counts without itself.  The driver sees only the histogram of the
quantized estimates of all training tokens, whose size is bounded.

Contracts: a null text is empty and consists of the end token; rows with equal ids are scored each; without any training
document all estimates are uniform; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keyranges import grouped, key_pieces, squeeze, stretch
from .store import bucketed, written
from .toxicity import _words

#: Text bytes in a chunk at about; buckets of a context's frequency; steps of a factor of two in the estimates' histogram.
CHUNK_BYTES, BUCKETS, STEPS = 10 << 20, 24, 8
#: A range of keys takes about as much memory as so many chunks.
CHUNKS_A_RANGE = 2
_END, _START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def is_held_out(doc_id: object) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of an ordered pair of hashes."""
    x = (a * np.uint64(0xFF51AFD7ED558CCD)) ^ (b + np.uint64(0x9E3779B97F4A7C15) + (a >> np.uint64(29)))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(31))


class Chunk:
    """A chunk's tokens: ``codes`` into the sorted ``words``; documents end with the end token."""

    def __init__(self, doc_counts: np.ndarray, held: np.ndarray, words: np.ndarray, codes: np.ndarray) -> None:
        self.doc_counts, self.held, self.words, self.codes = doc_counts, held, words, codes

    @classmethod
    def of_texts(cls, texts: pa.Array, held: np.ndarray) -> Chunk:
        import xxhash

        rows, codes, names = _words(texts)
        digest = xxhash.xxh64_intdigest
        hashes = np.array([*(digest(w) for w in names), int(_END)], np.uint64)
        real = np.ones(len(names), bool)
        if "" in names:
            real[names.index("")] = False
            kept = real[codes]
            rows, codes = rows[kept], codes[kept]
        n = np.bincount(rows, minlength=len(texts)) + 1
        all_codes = np.full(int(n.sum()), len(names), np.int64)
        inner = np.ones(len(all_codes), bool)
        inner[np.cumsum(n) - 1] = False
        all_codes[inner] = codes
        words, place = np.unique(hashes, return_inverse=True)
        return cls(n, held, words, place[all_codes].astype(np.uint32))

    def training(self) -> np.ndarray:
        return np.repeat(~self.held, self.doc_counts)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(sorted distinct bigram hashes, bigram of each token, context code of each token (-1: start), first token of each bigram)."""
        before = np.empty(len(self.codes), np.int64)
        before[1:] = self.codes[:-1]
        before[np.cumsum(self.doc_counts) - self.doc_counts] = -1
        left = np.where(before < 0, _START, self.words[np.maximum(before, 0)])
        # codes are dense, so the pairs of codes sort faster than their hashes
        packed = ((before + 1).astype(np.uint64) << np.uint64(32)) | self.codes
        _, first, inverse = np.unique(packed, return_index=True, return_inverse=True)
        hashes = _pair(left[first], self.words[self.codes[first]])
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return hashes[order], rank[inverse], before, first[order]


def chunk_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row for each chunk, in a table bucketed by ``chunk``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        ids: list[pa.Array] = []
        texts: list[pa.Array] = []
        size = 0

        def row() -> pa.RecordBatch:
            nonlocal ids, texts, size, seq
            names, body = pa.concat_arrays(ids), pa.concat_arrays(texts)
            held = np.fromiter(map(is_held_out, names.to_pylist()), bool, len(names))
            c = Chunk.of_texts(body, held)
            flags = pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), pa.array(held))
            out = [pa.array([part << 32 | seq], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), flags, *(pa.array([squeeze(x)], pa.binary()) for x in (c.doc_counts.astype(np.uint32), np.diff(c.words, prepend=np.uint64(0)), c.codes))]
            ids, texts, size, seq = [], [], 0, seq + 1
            return pa.RecordBatch.from_arrays(out, ["chunk", "doc_ids", "held", "doc_counts", "words", "codes"])

        for b in batches:
            for i in range(0, len(b), 256):
                s = b.slice(i, 256).take(pa.array(np.arange(min(256, len(b) - i))))
                ids.append(s.column(0))
                texts.append(s.column(1).cast(pa.large_string()))
                size += s.column(1).nbytes
                if size >= chunk_bytes:
                    yield row()
        if ids:
            yield row()

    table = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"chunk long, doc_ids array<{kind}>, held array<boolean>, doc_counts binary, words binary, codes binary")
    return bucketed(table, "chunks", "chunk", "none")


def _chunk(b: pa.RecordBatch, i: int) -> Chunk:
    col = {n: b.column(j)[i] for j, n in enumerate(b.schema.names)}
    held = np.array(col["held"].as_py(), bool)
    return Chunk(stretch(col["doc_counts"].as_py(), np.uint32).astype(np.int64), held, np.cumsum(stretch(col["words"].as_py(), np.uint64)), stretch(col["codes"].as_py(), np.uint32))


def total_counts(chunks: DataFrame, n_ranges: int) -> DataFrame:
    """(chunk, kind, range, totals): training counts over all chunks, in the order of the chunk's own keys.

    kind 0: words, 1: bigrams; a row of kind 2 has a range's number of training tokens and of distinct ones.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                c = _chunk(b, i)
                train = c.training()
                bigrams, of, _, _ = c.pairs()
                rows: list[tuple[int, int, bytes, bytes]] = []
                for kind, keys, counts in ((0, c.words, np.bincount(c.codes[train], minlength=len(c.words))), (1, bigrams, np.bincount(of[train], minlength=len(bigrams)))):
                    rows += [(r, kind, squeeze(np.diff(keys[x], prepend=np.uint64(0))), squeeze(counts[x].astype(np.uint32))) for r, x in key_pieces(keys, n_ranges)]
                chunk = pa.array(np.full(len(rows), b.column(0)[i].as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), chunk, pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary())], ["range", "kind", "chunk", "keys", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (r, kind), group in grouped(batches, 2):
            rows = [x[2:] for x in group]
            keys = [np.cumsum(stretch(x[1], np.uint64)) for x in rows]
            sizes = [len(k) for k in keys]
            one, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(inverse, np.concatenate([stretch(x[2], np.uint32) for x in rows]), minlength=len(one)).astype(np.int64)
            parts = np.split(total[inverse].astype(np.uint32), np.cumsum(sizes)[:-1])
            out = [(x[0], kind, squeeze(p)) for x, p in zip(rows, parts, strict=True)]
            if kind == 0:
                out.append((-1, 2, np.array([total.sum(), (total > 0).sum()], np.int64).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array(np.full(len(out), r, np.int32)), pa.array([x[2] for x in out], pa.binary())], ["chunk", "kind", "range", "totals"])

    sent = chunks.mapInArrow(send, "range int, kind int, chunk long, keys binary, counts binary")
    return sent.repartition(n_ranges, "range").sortWithinPartitions("range", "kind").mapInArrow(add, "chunk long, kind int, range int, totals binary")


def _estimates(c: Chunk, words: np.ndarray, bigrams: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each distinct bigram: (bigram of each token, its count, its context's count, its word's count, its training tokens)."""
    _, of, before, first = c.pairs()
    docs = int(words[np.searchsorted(c.words, _END)])
    context = before[first]
    n_context = np.where(context < 0, docs, words[np.maximum(context, 0)])
    return of, bigrams, n_context, words[c.codes[first]], np.bincount(of[c.training()], minlength=len(bigrams))


def _bucket(n_context: np.ndarray) -> np.ndarray:
    return np.where(n_context > 0, np.minimum(1 + np.floor(np.log2(np.maximum(n_context, 1))), BUCKETS - 1), 0).astype(np.int64)


def fit_weights(histogram: list[tuple[int, int, int, int]], rounds: int = 200) -> np.ndarray:
    """Weights of (bigram, unigram, uniform) for each context bucket by expectation-maximisation.

    A histogram row (bucket, i, j, n): n tokens whose bigram and unigram estimates are 2 ** (i / STEPS) and 2 ** (j / STEPS) times
    the uniform one; -1 stands for an estimate of zero.  A bucket without tokens takes the weights of the nearest one below.
    """
    out = np.tile([0.0, 0.9, 0.1], (BUCKETS, 1))
    rows = np.array(histogram, np.float64).reshape(-1, 4)
    for b in range(BUCKETS):
        mine = rows[rows[:, 0] == b]
        if not len(mine):
            out[b] = out[b - 1] if b > 1 else out[b]
            continue
        like = np.column_stack([np.where(mine[:, i] < 0, 0, 2.0 ** (mine[:, i] / STEPS)) for i in (1, 2)] + [np.ones(len(mine))])
        w = np.full(3, 1 / 3)
        for _ in range(rounds):
            share = w * like
            w = (mine[:, 3, None] * share / share.sum(1, keepdims=True)).sum(0) / mine[:, 3].sum()
        w = np.maximum(w, [0, 1e-6, 1e-6])
        out[b] = w / w.sum()
    return out


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    chunks = chunk_table(docs, id_col, text_col, chunk_bytes)
    n_ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chunks.count() // CHUNKS_A_RANGE))
    totals = written(total_counts(chunks, n_ranges), "lm-totals", "none")
    stats = [np.frombuffer(bytes(r.totals), np.int64) for r in totals.where("kind = 2").select("totals").collect()]  # two numbers a range
    n, v = (int(sum(s[i] for s in stats)) for i in (0, 1))
    gathered = totals.where("kind < 2").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("kind", "range", "totals"))).alias("parts"))
    joined = chunks.join(gathered, "chunk")
    uniform = 1 / (v + 1)

    def counts(b: pa.RecordBatch, i: int) -> tuple[Chunk, tuple[np.ndarray, ...]]:
        c = _chunk(b, i)
        got = b.column(b.schema.names.index("parts"))[i].as_py()
        words, bigrams = (np.concatenate([stretch(p["totals"], np.uint32) for p in got if p["kind"] == k]).astype(np.int64) for k in (0, 1))
        return c, _estimates(c, words, bigrams)

    def deleted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                _, (_, n_pair, n_context, n_word, mine) = counts(b, i)
                own = mine > 0
                x, y, z, w = n_pair[own] - 1, n_context[own] - 1, n_word[own] - 1, mine[own]
                with np.errstate(divide="ignore", invalid="ignore"):
                    two = np.where((x > 0) & (y > 0), np.rint(STEPS * np.log2(x / np.maximum(y, 1) / uniform)), -1)
                    one = np.where((z > 0) & (n > 1), np.rint(STEPS * np.log2(z / max(1, n - 1) / uniform)), -1)
                # an estimate below the uniform one counts as equal to it
                two, one = (np.where(e < 0, np.where(zero, -1, 0), e).astype(np.int64) for e, zero in ((two, (x <= 0) | (y <= 0)), (one, z <= 0)))
                key, inverse = np.unique((_bucket(y) << 40) | ((two + 1) << 20) | (one + 1), return_inverse=True)
                weight = np.bincount(inverse, w, minlength=len(key)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(weight)], ["key", "n"])

    histogram = joined.mapInArrow(deleted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
    weights = fit_weights([(r.key >> 40, (r.key >> 20 & 0xFFFFF) - 1, (r.key & 0xFFFFF) - 1, r.n) for r in histogram])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                c, (of, n_pair, n_context, n_word, _) = counts(b, i)
                w = weights[_bucket(n_context)]
                p = w[:, 0] * n_pair / np.maximum(n_context, 1) + w[:, 1] * n_word / max(1, n) + w[:, 2] * uniform
                base = np.log10((n_word + 0.5) / (n + 0.5 * (v + 1)))
                starts = np.cumsum(c.doc_counts) - c.doc_counts
                model, plain, known = (np.add.reduceat(x[of], starts) for x in (np.log10(p), base, (n_word > 0).astype(np.int64)))
                ids = b.column(b.schema.names.index("doc_ids"))[i].values
                yield pa.RecordBatch.from_arrays([ids, pa.array(c.held), pa.array(c.doc_counts), pa.array(known), pa.array(np.full(len(ids), n, np.int64)), pa.array(plain), pa.array(model)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return joined.mapInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
