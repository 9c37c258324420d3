"""Byte-pair encoding and decoding: a priority queue of merge ranks over a doubly linked list of symbols.

Texts are cut into units, and each distinct unit is merged once a worker (see ``tokenize``); a unit's pre-tokens are those of the
vocabulary file.  Decoding puts the vocabulary's byte strings one after another.

A null text is an empty one and has no ids.  The string of a special token is that token, wherever it stands in a text, as the library
has it by default.  Repeated rows, repeated ids and null ids are rows of their own.  A long text is merged pre-token by pre-token, and an
Arrow batch is worked through in slices of about 1 MB, so what a worker holds is a slice, or one text that is longer, some forty times
over (with its ids and places).  An empty table gives no rows; other columns, whatever their names, are carried along.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from .tokenize import UnitCoder, row_ranges, text_sizes, tokenizer_path, whole_texts

#: Pre-tokens whose ids a worker keeps beside its units, and the longest one it keeps.
_KEPT, _KEPT_SYMBOLS = 100_000, 64
#: Bytes of texts that are worked through at once, and ids that are turned into bytes at once.
_SLICE, _BLOCK = 1 << 20, 1 << 18


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is visible, else the next free one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(visible)]
    return [chr(b) if b in set(visible) else chr(256 + others.index(b)) for b in range(256)]


def merged(symbols: list[int], ranks: list[dict[int, int]], made: list[int]) -> list[int]:
    """The symbols after all merges, lowest rank first and leftmost first within a rank.

    ``ranks[a].get(b)`` is the rank of merging ``a`` with ``b``, and ``made`` the symbol by rank.  Symbols are a doubly linked list; the
    queue holds pairs as rank * n + place.  An entry is stale, and skipped, when the pair that now starts at its place has another rank
    or none, as after its place or its second symbol has been merged away.
    """
    n = len(symbols)
    now = [ranks[a].get(b, -1) for a, b in zip(symbols, symbols[1:], strict=False)]
    queue = [r * n + i for i, r in enumerate(now) if r >= 0]
    if not queue:
        return symbols
    heapify(queue)
    symbols = [*symbols]
    now.append(-1)
    before, after = [*range(-1, n - 1)], [*range(1, n + 1)]
    while queue:
        rank, i = divmod(heappop(queue), n)
        if now[i] != rank:
            continue
        j = after[i]
        new = symbols[i] = made[rank]
        symbols[j] = now[j] = now[i] = -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (rank := ranks[new].get(symbols[k], -1)) >= 0:
                now[i] = rank
                heappush(queue, rank * n + i)
        h = before[i]
        if h >= 0:
            rank = now[h] = ranks[symbols[h]].get(new, -1)
            if rank >= 0:
                heappush(queue, rank * n + h)
    return [s for s in symbols if s >= 0]


class Bpe(UnitCoder):
    """Encodes by :func:`merged`; vocabulary, merges and pre-tokens are those of a byte-level file."""

    def __init__(self, path: str) -> None:
        super().__init__(path, "bytes")
        with open(path, encoding="utf-8") as f:
            stored = json.load(f)
        vocabulary = stored["model"]["vocab"]
        #: The rank of each merge by its first and second id, and the id that it makes.
        self.ranks: list[dict[int, int]] = [{} for _ in range(self.lib.get_vocab_size())]
        for rank, (a, b) in enumerate(stored["model"]["merges"]):
            self.ranks[vocabulary[a]][vocabulary[b]] = rank
        self.made = [vocabulary[a + b] for a, b in stored["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        self.letters = {x: vocabulary[x] for x in byte_letters()}
        self.cut = self.lib.pre_tokenizer.pre_tokenize_str
        self.kept: dict[str, list[int]] = {}

    def _ids(self, text: str) -> list[int]:
        """Ids of a text without special tokens."""
        out: list[int] = []
        for pre_token, _ in self.cut(text) if text else ():
            ids = self.kept.get(pre_token)
            if ids is None:
                ids = merged([self.letters[x] for x in pre_token], self.ranks, self.made)
                if len(pre_token) <= _KEPT_SYMBOLS:
                    if len(self.kept) >= _KEPT:
                        self.kept.clear()
                    self.kept[pre_token] = ids
            out += ids
        return out

    def _whole(self, text: str) -> list[int]:
        """Ids of a text that may hold special tokens: what lies between them is cut by itself."""
        out: list[int] = []
        while text:
            at, neg, token = min(((i, -len(t), t) for t in self.special if (i := text.find(t)) >= 0), default=(len(text), 0, ""))
            out += self._ids(text[:at]) + ([self.special[token]] if token else [])
            text = text[at - neg :]
        return out

    def _joined(self, text: str, n: int) -> None:
        """Units are merged one at a time."""

    def _lists(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [self._ids(x) for x in units]
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter((i for x in lists for i in x), np.uint16, int(lengths.sum())), lengths

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = whole_texts(texts)
        special = np.zeros(len(texts), bool)
        for token in self.special:
            special |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if not special.any():
            return super().encode(texts)
        ids, counts, at = [], [], 0
        for i in [*np.flatnonzero(special).tolist(), len(texts)]:
            if i > at:
                own, n = super().encode(whole_texts(texts.slice(at, i - at)))
                ids.append(own)
                counts.append(n)
            if i < len(texts):
                own = np.array(self._whole(texts[i].as_py()), np.uint16)
                ids.append(own)
                counts.append(np.array([len(own)]))
            at = i + 1
        return np.concatenate(ids), np.concatenate(counts)


class Vocabulary:
    """The byte string of each id."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            stored = json.load(f)
        byte = {x: b for b, x in enumerate(byte_letters())}
        strings = {i: bytes(byte[x] for x in token) for token, i in stored["model"]["vocab"].items()}
        strings |= {t["id"]: t["content"].encode() for t in stored["added_tokens"]}
        ordered = [strings.get(i, b"") for i in range(max(strings) + 1)]
        self.flat = np.frombuffer(b"".join(ordered), np.uint8)
        self.lengths = np.fromiter(map(len, ordered), np.int64, len(ordered))
        self.starts = np.cumsum(self.lengths) - self.lengths

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids, the offsets of the texts in them)."""
        ends = np.concatenate([[0], np.cumsum(self.lengths[ids])])
        out = np.empty(int(ends[-1]), np.uint8)
        for i in range(0, len(ids), _BLOCK):
            some = ids[i : i + _BLOCK]
            n = self.lengths[some]
            upto = np.cumsum(n)
            out[ends[i] : ends[i] + upto[-1]] = self.flat[np.repeat(self.starts[some] - (upto - n), n) + np.arange(int(upto[-1]))]
        return out, ends[offsets]


_coders: dict[str, Bpe] = {}
_vocabularies: dict[str, Vocabulary] = {}


def bpe(path: str) -> Bpe:
    """The worker's encoder for a file."""
    if path not in _coders:
        _coders[path] = Bpe(path)
    return _coders[path]


def vocabulary(path: str) -> Vocabulary:
    """The worker's decoder for a file."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """``docs`` with the ids of each text, an array of integers, in place of any column ``ids_col``."""
    rest = docs.drop(ids_col)
    at = rest.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = bpe(tokenizer_path(tokenizer))
        for b in batches:
            for i, n in row_ranges(text_sizes(b.column(at)), _SLICE):
                s = b.slice(i, n)
                ids, counts = code.encode(s.column(at))
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*s.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))], [*s.schema.names, ids_col])

    return rest.mapInArrow(run, StructType([*rest.schema.fields]).add(ids_col, ArrayType(IntegerType(), False)))


def decode(docs: DataFrame, ids_col: str = "ids", decoded_col: str = "decoded", tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """``docs`` with the text of each row's ids in place of any column ``decoded_col``; null ids give an empty text."""
    rest = docs.drop(decoded_col).withColumn(ids_col, F.coalesce(ids_col, F.array().cast("array<int>")))
    at = rest.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(tokenizer_path(tokenizer))
        for b in batches:
            for i, n in row_ranges(4 * pc.list_value_length(b.column(at)).to_numpy(zero_copy_only=False).astype(np.int64), _SLICE):
                s = b.slice(i, n)
                lists = s.column(at)
                offsets = lists.offsets.to_numpy().astype(np.int64)
                data, ends = words.decode(lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0])
                text = pa.StringArray.from_buffers(n, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))
                yield pa.RecordBatch.from_arrays([*s.columns, _readable(text)], [*s.schema.names, decoded_col])

    return rest.mapInArrow(run, StructType([*rest.schema.fields]).add(decoded_col, StringType()))


def _readable(texts: pa.Array) -> pa.Array:
    """Ids of another source may cut a letter in two: what is no UTF-8 gets replacement letters, as in the library."""
    try:
        texts.validate(full=True)
    except pa.ArrowInvalid:
        return pa.array([x.as_py().decode("utf-8", "replace") for x in texts.cast(pa.binary())], pa.string())
    return texts


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each text, from its ids and the text that these decode to."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    coded = decode(encode(own, tokenizer=tokenizer).select("doc_id", "ids"), tokenizer=tokenizer)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2(F.coalesce("decoded", F.lit("")), 256).alias("decoded_sha256"))
