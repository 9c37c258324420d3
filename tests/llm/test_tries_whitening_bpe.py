"""Prefix trie, whitening and byte-pair encoding: brute force, the library's results, and the defined results of odd input."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from skycensus.llm import bpe, turn_trie, whiten
from skycensus.llm.tokenize import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- prefix trie -------------------------------------------------------------------------------------------------------


def brute_trie(turns):
    """turns by conversation -> the nodes' rows, by building every rebuilt conversation."""
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = turns.get(c - c % 20, [])[:h] + own[h:]
    nodes = collections.defaultdict(list)
    for c, v in out.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    kids = collections.Counter(p[:-1] for p in nodes if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, cs in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(cs) - 1) * len(WORD.findall(p[-1][1])) if p else 0
    sha = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(nodes[p]) if len(out[c]) == len(p)).encode()).hexdigest()
    return sorted((min(cs), len(p), min(nodes[p[:-1]]) if p else None, len(cs), kids[p], leaves[p], saved[p], sha(p)) for p, cs in nodes.items())


def as_rows(df):
    return sorted(tuple(r) for r in df.collect())


def conversations(seed, n):
    r = random.Random(seed)
    turns = {}
    for c in r.sample(range(3 * n), n):
        m = r.choice([0, 1, 2, 3, 3, 4, 5, 7])
        turns[c] = [(r.choice(["user", "assistant", ""]), r.choice(["", "a b", "a  b", "x", "y z w"])) for _ in range(m)]
        if r.random() < 0.3 and c - c % 20 in turns:
            turns[c] = list(turns[c - c % 20])
    return {c: v for c, v in turns.items() if v}


def table(spark, turns, n=5):
    rows = [(c, i, role or None, text or None, "clash", 7) for c, v in turns.items() for i, (role, text) in enumerate(v)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, s0 string, depth int").repartition(n)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_matches_brute_force(spark, seed):
    turns = conversations(seed, 60)
    assert as_rows(turn_trie.trie(table(spark, turns))) == brute_trie(turns)


def test_a_hot_conversation_and_long_texts_over_several_tasks(spark):
    turns = conversations(3, 20)
    turns[40] = [("user", f"t{i % 7} " * (i % 5)) for i in range(300)]
    turns[43] = turns[40][:250] + [("user", "other")]
    turns[60] = [("user", "word " * 60_000)]
    turns[61] = [("user", "word " * 60_000), ("user", "b")]
    got = turn_trie.trie(table(spark, turns))
    assert as_rows(got) == brute_trie(turns)
    stored = turn_trie.stored_turns(table(spark, turns), 0, turn_trie.MODULI, "conv_id", "turn", "role", "text").where("conv_id = 40").orderBy("pos").collect()
    base, p, s = turn_trie._bases(0, turn_trie.MODULI)[0], turn_trie.MODULI[0], 0
    for i, r in enumerate(stored):
        assert r.pos == i and r.e0 == s
        s = (s + (r.s0 - r.e0) % p) % p
        assert r.s0 == s
    terms = [(r.s0 - r.e0) * pow(base, -r.pos, p) % p for r in stored]
    assert [terms[i] for i in range(0, 300, 35)] == [terms[0]] * 9


def test_unlike_turns_of_one_fingerprint_are_found_and_tried_again(spark, monkeypatch):
    turns = conversations(4, 30)
    asked = []
    real = turn_trie.verified
    monkeypatch.setattr(turn_trie, "verified", lambda *a: asked.append(real(*a)) or asked[-1])
    assert as_rows(turn_trie.trie(table(spark, turns), moduli=(3, 3, 3, 3))) == brute_trie(turns)
    assert asked == [False, True]


def test_odd_turns(spark):
    rows = [(5, None, "b", "null turn first"), (5, 1, "a", "x"), (5, 1, "a", "x"), (5, 2, None, None), (None, 0, "a", "no id"), (20, 0, "a", "x"), (-7, 0, "a", "y")]
    got = as_rows(turn_trie.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert got == brute_trie({5: [("b", "null turn first"), ("a", "x"), ("a", "x"), ("", "")], 20: [("a", "x")], -7: [("a", "y")]})
    nothing = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert as_rows(turn_trie.trie(nothing)) == []


def test_many_ends_are_hashed_as_a_stream(spark, monkeypatch):
    monkeypatch.setattr(turn_trie, "_CHUNK", 16)
    turns = {c: [("user", "same")] for c in range(0, 2000, 20)}
    assert as_rows(turn_trie.trie(table(spark, turns))) == brute_trie(turns)


# --- whitening ---------------------------------------------------------------------------------------------------------


def test_inertia_counts_and_components_of_repeated_values():
    r = np.random.default_rng(0)
    for case in range(40):
        d = int(r.integers(1, 40))
        q = np.linalg.qr(r.standard_normal((d, d)))[0]
        e = np.sort(r.exponential(size=d) if case % 2 else r.choice([0, 1e-3, 1, 1, 2, 5, 1 + 1e-9, 1 + 1e-13, 1e4], d))[::-1]
        m = (q * e) @ q.T
        m = (m + m.T) / 2
        w = np.linalg.eigvalsh(m)[::-1]
        shift = float(r.choice(e)) * 1.01 + 1e-9 * e[0] + 1e-9
        assert whiten.eigenvalues_above(m, shift) == (w > shift).sum()
        k = min(8, whiten.eigenvalues_above(m, 16 * d * 2.3e-16 * np.trace(m)))
        if k:
            values, vectors = whiten.feast(m, k)
            assert np.allclose(values, w[:k], rtol=1e-9, atol=1e-11 * w[0])
            assert np.abs(m @ vectors - vectors * values).max() < 1e-11 * w[0] and np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12


def check_whitened(rows, vectors, k):
    """rows of the operator against eigh of the exactly centred covariance; vectors by id."""
    ids = sorted(vectors)
    x = np.array([[int(np.floor(1024 * c)) + 100_000 for c in vectors[i]] for i in ids], object)
    n = len(x)
    away = n * x - x.sum(axis=0)
    y = (away / n).astype(float)
    values, basis = np.linalg.eigh(y.T @ y / n)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    want = y @ basis / np.sqrt(values)
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(got) == len(rows) == n * k
    have = np.array([[got[i, j + 1].whitened for j in range(k)] for i in ids])
    have *= np.sign((have * want).sum(axis=0))
    assert np.abs(have - want).max() < 1e-9
    for i, a in zip(ids, away, strict=True):
        for j in range(k):
            r = got[i, j + 1]
            assert r.n == n and r.deviation == (a**2).sum() and abs(r.explained - values[j] * n / np.trace(y.T @ y)) < 1e-12 and r.identity_error < 1e-9


def test_whitening_matches_a_dense_solution_and_drops_what_takes_no_part(spark):
    r = np.random.default_rng(3)
    good = {i: [float(np.float32(x)) for x in r.standard_normal(12) * np.arange(1, 13)] for i in range(150)}
    good[7] = good[8]
    odd = [(500, None), (501, []), (502, [None] + [1.0] * 11), (503, [float("nan")] + [0.0] * 11), (504, [float("inf")] + [0.0] * 11), (505, [1.0, 2.0]), (506, [3e38] + [0.0] * 11)]
    rows = [(i, v, "clash") for i, v in [*good.items(), *odd]]
    emb = spark.createDataFrame(rows, "vec_id long, embedding array<float>, whitened string").repartition(5)
    check_whitened(whiten.whiten(emb).collect(), good, 8)


def test_whitening_of_few_dimensions_repeated_ids_and_equal_vectors(spark):
    kind = "vec_id long, embedding array<double>"
    rows = [(1, [0.0, 1.0]), (1, [1.0, 0.0]), (None, [2.0, 5.0])]
    got = whiten.whiten(spark.createDataFrame(rows, kind)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2)]
    flat = [(i, [float(i), 2.0, 2.0 * i]) for i in range(5)]  # one direction alone
    check_whitened(whiten.whiten(spark.createDataFrame(flat, kind)).collect(), dict(flat), 1)
    for none in ([(i, [1.0, 2.0]) for i in range(4)], [(1, [1.0])], []):
        assert whiten.whiten(spark.createDataFrame(none, kind)).count() == 0


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(i) * 1e9, -float(i) * 3e8, 5.0]) for i in range(40)]
    got = whiten.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.deviation for r in got} == {None}
    rows = [(i, [float(i) * 1e3, -float(i * i) * 30, 5.0]) for i in range(40)]
    check_whitened(whiten.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), dict(rows), 2)


# --- byte-pair encoding --------------------------------------------------------------------------------------------------

ODD = ["a<|endoftext|> b <|endoftext|>", "  x  <|endoftext|>\n\n", "", None, "don't I'll 's\n \t x", "a" * 900, " lead", "é " * 50, "\x1c a\x85b 　c", "日本語 テスト 👍🏽", "<|endoftext|<|endoftext|>", "A\x00b", "x" * 3 + "\n" * 40 + "y", "same", "same"]
PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_ids_are_the_library_s(library):
    r = random.Random(1)
    texts = [*ODD, "".join(map(chr, range(1, 3000))), *["".join(r.choice("ab é\n'st,.1") for _ in range(r.randint(0, 60))) for _ in range(2000)], *["".join(r.choice("the aningxq") for _ in range(40)) for _ in range(500)]]
    ids, counts = bpe.Bpe(PATH).encode(pa.array(texts))
    offsets = np.concatenate([[0], np.cumsum(counts)])
    data, ends = bpe.Vocabulary(PATH).decode(ids, offsets)
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids
        assert bytes(data[ends[i] : ends[i + 1]]).decode() == (t or "")


def test_merges_skip_stale_entries():
    # 0 1 2 -> rank 0 joins 1 2, after which the pairs (0 1) and (2 3) are stale; then (0 12) joins
    ranks = [{1: 1, 12: 2}, {2: 0}, {3: 1}, {}] + [{}] * 9
    assert bpe.merged([0, 1, 2, 3], ranks, [12, 9, 10]) == [10, 3]
    assert bpe.merged([1, 2, 1, 2], ranks, [12, 9, 10]) == [12, 12] and bpe.merged([3], ranks, []) == [3]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_digests_of_odd_and_long_texts(spark, library):
    texts = [*ODD, "word né " * 700_000, "z" * 300_000]
    rows = [(None if i == 4 else min(i, 14), t, "clash", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int").repartition(3)
    want = collections.Counter()
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))] += 1
    assert collections.Counter(tuple(r) for r in bpe.digests(docs).collect()) == want
    back = bpe.decode(bpe.encode(docs))
    assert set(back.columns) == {"doc_id", "text", "ids", "decoded"} and back.where("coalesce(text, '') <> decoded").count() == 0
    assert bpe.digests(docs.where("doc_id < 0")).count() == 0


def test_ids_that_cut_a_letter_decode_as_in_the_library(spark, library):
    ids = library.encode("👍", add_special_tokens=False).ids
    got = bpe.decode(spark.createDataFrame([(1, ids[:1]), (2, ids), (3, None)], "k int, ids array<int>")).collect()
    assert {r.k: r.decoded for r in got} == {1: library.decode(ids[:1], skip_special_tokens=False), 2: "👍", 3: ""}
