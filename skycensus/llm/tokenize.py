"""Token ids of whole texts with a public tokenizer, through a cache of distinct units.

Both tokenizers cut a text into pre-tokens before merging, and never merge across them.  A white-space run that follows a
visible character always starts a new pre-token, and so does ASCII punctuation after an ASCII letter or digit.  Texts are therefore
cut there, each distinct unit goes through the library once a worker, and a text's ids are its units' ids in order.  A text
with white space that the cut cannot handle goes through the library whole.

Units are never Python objects: they are places in the texts' bytes, told apart by two 64-bit hashes, and unseen ones are copied into
one text for the library, which shows where each begins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Starts a unit safely when it follows an ASCII letter or digit (an apostrophe may open a contraction, a bar a special token).
_TAIL = ".,;:!?%&$*#)"
#: Units kept by one worker, units in one call of the library, and units in one of its texts (it takes longer for each unit of a long one).
_CACHE_UNITS, _CALL_UNITS, _TEXT_UNITS = 1_200_000, 5000, 200
_BYTE = np.arange(256)
_SPACE = np.isin(_BYTE, [9, 10, 11, 12, 13, 32])
_LETTER = ((_BYTE | 32) >= 97) & ((_BYTE | 32) <= 122)
_ALNUM = _LETTER | ((_BYTE >= 48) & (_BYTE <= 57))
_CUT = np.isin(_BYTE, list(_TAIL.encode()))
#: Two odd factors for each of the two hashes of a unit.
_FACTORS = ((0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD), (0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def unit_hashes(data: np.ndarray, first: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each stretch [first, after) of the bytes, from words of eight; stretches are not empty."""
    sizes = after - first
    if not len(sizes):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    words = np.ndarray(len(data), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))  # the eight bytes from each place
    n = (sizes + 7) >> 3
    start = np.cumsum(n) - n
    place = np.arange(int(n.sum())) - np.repeat(start, n)
    word = words[np.repeat(first, n) + 8 * place]
    last = start + n - 1
    word[last] &= np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 * n - sizes) * 8).astype(np.uint64)
    place = place.astype(np.uint64)
    place[last] |= sizes.astype(np.uint64) << np.uint64(32)  # zero bytes at the end count
    out = []
    for one, two in _FACTORS:
        x = (word ^ (place * np.uint64(two))) * np.uint64(one)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(two)
        h = np.add.reduceat((x ^ (x >> np.uint64(29))) * np.uint64(one), start)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(two)
        out.append(h ^ (h >> np.uint64(29)))
    return out[0], out[1]


_coders: dict[tuple[str, str], "UnitCoder"] = {}


def whole_texts(texts: pa.Array) -> pa.Array:
    """Texts without nulls, for the string kernels; these go wrong on a cast slice, so a slice is copied first."""
    if texts.offset:
        texts = texts.take(pa.array(np.arange(len(texts))))
    return pc.fill_null(texts.cast(pa.large_string()), "")


def coder(path: str, kind: str) -> "UnitCoder":
    """The worker's coder for a tokenizer file; kind: ``bytes`` (spaces kept) or ``words`` (white space and case dropped)."""
    if (path, kind) not in _coders:
        _coders[path, kind] = UnitCoder(path, kind)
    return _coders[path, kind]


class UnitCoder:
    def __init__(self, path: str, kind: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.kind = kind
        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True
        #: Ids that begin (bytes: with a space) or end (words) a unit.
        self.edge = np.zeros(self.lib.get_vocab_size(), bool)
        for token, i in self.lib.get_vocab().items():
            self.edge[i] = token.startswith("\u0120") if kind == "bytes" else token.endswith("</w>")
        self._reset()

    def _reset(self) -> None:
        self.keys, self.checks, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.n = self.used = 0
        self.flat = np.zeros(1 << 20, np.uint16)
        self.start = np.zeros(1 << 18, np.int64)
        self.length = np.zeros(1 << 18, np.int32)

    def _append(self, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The rows of new units."""
        n, m = self.n, len(flat)
        while self.used + m > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(lengths) > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        self.flat[self.used : self.used + m] = flat
        self.length[n : n + len(lengths)] = lengths
        self.start[n : n + len(lengths)] = self.used + np.cumsum(lengths) - lengths
        self.used, self.n = self.used + m, n + len(lengths)
        return np.arange(n, self.n)

    def _gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the rows' units one after another, their ends)."""
        lengths = self.length[rows].astype(np.int64)
        ends = np.cumsum(lengths)
        shift = self.start[rows] - (ends - lengths)
        return self.flat[np.repeat(shift, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)], ends

    def _lists(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the units one after another, their numbers)."""
        parts = [np.zeros(0, np.uint16)]
        for i in range(0, len(units), _CALL_UNITS):
            parts += [np.array(e.ids, np.uint16) for e in self.lib.encode_batch_fast(units[i : i + _CALL_UNITS], add_special_tokens=False)]
        return np.concatenate(parts), np.fromiter(map(len, parts[1:]), np.int64, len(units))

    def _joined(self, body: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of units one after another, which end at ``ends``, as a few texts; None if their borders do not show."""
        cut = [0, *ends[_TEXT_UNITS - 1 : -1 : _TEXT_UNITS].tolist(), len(body)]
        found = self.lib.encode_batch_fast([body[x:y].decode() for x, y in zip(cut[:-1], cut[1:], strict=True)], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint16) for e in found])
        border = np.flatnonzero(self.edge[ids])
        if len(border) != len(ends):
            return None
        return ids, np.diff(border, append=len(ids)) if self.kind == "bytes" else np.diff(border, prepend=-1)

    def _learn(self, data: np.ndarray, first: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Encode unseen units; their rows."""
        sizes = after - first
        in_bytes = self.kind == "bytes"
        # a plain unit is one word; in one text with others it shows by its space (bytes) or its end (words)
        ok = (_ALNUM if in_bytes else _LETTER).copy()
        ok[0xC3] = True
        good = ok[data]
        good[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)  # Latin letters of two bytes
        if in_bytes:
            good |= data == 32
        sums = np.concatenate([[0], np.cumsum(good)])
        plain = (sums[after] - sums[first] == sizes) & ((data[first] == 32) & (sizes > 1) if in_bytes else True)
        rows = np.empty(len(first), np.int64)
        at = np.flatnonzero(plain)
        for i in range(0, len(at), _CALL_UNITS):
            some = at[i : i + _CALL_UNITS]
            n = sizes[some] + (not in_bytes)
            ends = np.cumsum(n)
            place = np.arange(int(ends[-1])) - np.repeat(ends - n, n)
            body = data[np.minimum(np.repeat(first[some], n) + place, len(data) - 1)]
            if not in_bytes:
                body[ends - 1] = 32
            got = self._joined(body.tobytes(), ends)
            rows[some] = self._append(*(got or self._lists([data[x:y].tobytes().decode() for x, y in zip(first[some].tolist(), after[some].tolist(), strict=True)])))
        rest = np.flatnonzero(~plain)
        rows[rest] = self._append(*self._lists([data[x:y].tobytes().decode() for x, y in zip(first[rest].tolist(), after[rest].tolist(), strict=True)]))
        return rows

    def _units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first bytes of the units, the bytes after them)."""
        begin = np.zeros(len(data), bool)
        begin[1:] = _CUT[data[1:]] & _ALNUM[data[:-1]]
        if self.kind == "bytes":  # a unit has the space before it, but for the first of its text
            begin |= data == 32
            begin[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
            first = np.flatnonzero(begin)
            return first, np.append(first[1:], len(data))
        inside = ~_SPACE[data]
        begin[0] = True
        begin[1:] |= ~inside[:-1]
        begin[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
        begin &= inside
        first = np.flatnonzero(begin)
        stop = ~inside
        stop[first] = True
        stops = np.append(np.flatnonzero(stop), len(data))
        return first, stops[np.searchsorted(stops, first, side="right")]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another as uint16, their number for each text); a null text has none."""
        texts = whole_texts(texts)
        whole: list[int] = []
        if self.kind == "words":
            texts = pc.ascii_lower(texts)
        else:
            # white space before a space, or a leading space: the library decides on the whole text
            odd = pc.match_substring_regex(texts, r"^ |[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0b\x1c-\x1f] | $")
            whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
        cut = pc.if_else(odd, "", texts) if whole else texts
        offsets = np.frombuffer(cut.buffers()[1], np.int64, len(cut) + 1, cut.offset * 8)
        data = np.frombuffer(cut.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if cut.buffers()[2] is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        ids, counts = self._cut_ids(data, offsets) if len(data) else (np.zeros(0, np.uint16), np.zeros(len(texts), np.int64))
        if whole:
            flat, n_own = self._lists([texts[i].as_py() for i in whole])
            mine = np.split(flat, np.cumsum(n_own)[:-1])
            pieces, at = [], 0
            bounds = np.concatenate([[0], np.cumsum(counts)])
            for i, x in zip(whole, mine, strict=True):
                pieces += [ids[at : bounds[i]], x]
                at = bounds[i + 1]
                counts[i] = len(x)
            ids = np.concatenate([*pieces, ids[at:]])
        return ids, counts

    def _cut_ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.n > _CACHE_UNITS:
            self._reset()
        first, after = self._units(data, offsets)
        if not len(first):
            return np.zeros(0, np.uint16), np.zeros(len(offsets) - 1, np.int64)
        h, check = unit_hashes(data, first, after)
        # distinct units by a hash table, for sorting all of them takes longer; then in order
        coded = pa.array(h).dictionary_encode()
        keys, code = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        lead = np.empty(len(keys), np.int64)
        lead[code[::-1]] = np.arange(len(h))[::-1]  # the first of each
        order = np.argsort(keys)
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        keys, lead, inverse = keys[order], lead[order], place[code]
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        if (check != check[lead][inverse]).any() or (self.checks[at[known]] != check[lead[known]]).any():
            # two units of one hash: nothing is looked up
            return self._lists([data[x:y].tobytes().decode() for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
        rows = np.empty(len(keys), np.int64)
        rows[known] = self.rows[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            by = new[np.argsort(lead[new])]  # in the order of the texts
            rows[by] = self._learn(data, first[lead[by]], after[lead[by]])
            to = np.searchsorted(self.keys, keys[new])
            self.keys, self.checks, self.rows = np.insert(self.keys, to, keys[new]), np.insert(self.checks, to, check[lead[new]]), np.insert(self.rows, to, rows[new])
        ids, ends = self._gather(rows[inverse])
        return ids, np.diff(np.concatenate([[0], ends])[np.searchsorted(first, offsets)])


def row_ranges(sizes: np.ndarray, most: int = 4 << 20) -> list[tuple[int, int]]:
    """(first row, number of rows) of runs of about ``most`` bytes each, one row at least."""
    out, at = [], 0
    ends = np.cumsum(sizes)
    while at < len(sizes):
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
        upto = max(at + 1, upto)
        out.append((at, upto - at))
        at = upto
    return out


def text_sizes(texts: pa.Array) -> np.ndarray:
    """Bytes of each text; 0 for a null."""
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the id ``end`` after each text, and the offsets of the texts."""
    offsets = np.concatenate([[0], np.cumsum(counts + 1)]).astype(np.int64)
    out = np.empty(len(ids) + len(counts), ids.dtype)
    last = np.zeros(len(out), bool)
    last[offsets[1:] - 1] = True
    out[last] = end
    out[~last] = ids
    return out, offsets


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; looked up on the worker."""
    import public_tokenizers

    return public_tokenizers.path(name)


