"""The ten operators on small tables: brute force, round trips, and the defined results of odd input."""

from __future__ import annotations

import collections
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skycensus.llm import lm_score, media, mixing, packing, passages, repair_ids, simhash, suffix_dedup, tokenize, topk, toxicity

RNG = np.random.default_rng(11)
WORDS = ["".join(RNG.choice(list("abcdefghij"), RNG.integers(2, 7))) for _ in range(900)]


def prose(n):
    return " ".join(RNG.choice(WORDS, n))


PASSAGE = prose(140)
TEXTS = [PASSAGE + " " + prose(90), prose(60) + " " + PASSAGE, prose(300), prose(300), None, "", "One", "one", prose(40) + " " + PASSAGE + " x", "é " * 300, "  spaced\t out \n text  ", "a" * 900]
TEXTS += [TEXTS[2], TEXTS[3] + " tail", "<|endoftext|> don't I'll", PASSAGE]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i == 3 else f"s{i % 3}", 0, "clash", "k") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string, k string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < 0")


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# --- 1 ----------------------------------------------------------------------------------------------------------------


def brute_spans(texts, n):
    seen = collections.Counter(t[j : j + n] for t in texts for j in range(len(t) - n + 1))
    out = []
    for t in texts:
        cover = np.zeros(len(t) + 1, int)
        for j in range(len(t) - n + 1):
            if seen[t[j : j + n]] > 1:
                cover[j] += 1
                cover[j + n] -= 1
        hit = np.cumsum(cover)[:-1] > 0
        kept = bytes(np.frombuffer(t, np.uint8)[~hit])
        out.append((len(t), int(hit.sum()), int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("most_regions", [512, 1])
def test_repeated_bytes_match_brute_force(docs, most_regions):
    got = by_id(suffix_dedup.dedup_substrings(docs, most_regions=most_regions))
    want = brute_spans([(t or "").encode() for t in TEXTS], 400)
    for i, w in enumerate(want):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == w


def test_split_anchors_give_the_same_marks(spark):
    line, passage, words = prose(20), prose(90), 51
    texts = [prose(int(RNG.integers(60, 90))) + " " + line + " " + prose(int(RNG.integers(60, 90))) for _ in range(40)]
    texts += [prose(30) + " " + line + " " + passage + " " + prose(20), prose(9) + " " + line + " " + passage, passage[-430:] + prose(40), line * 12, line * 9]
    texts += ["ab" * 500 + prose(i) for i in range(3, 9)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got, plain = (by_id(suffix_dedup.dedup_substrings(docs, most_regions=n)) for n in (3, 10_000))
    assert got == plain
    for i, w in enumerate(brute_spans([t.encode() for t in texts], 400)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == w
    split = [t.split() for t in texts]
    seen = collections.Counter(tuple(t[j : j + words]) for t in split for j in range(len(t) - words + 1))
    for i, t in enumerate(split):
        hit = {k for j in range(len(t) - words + 1) if seen[tuple(t[j : j + words])] > 1 for k in range(j, j + words)}
        assert got[i].passage_words == len(hit)


def test_repeats_of_an_empty_table(empty):
    assert suffix_dedup.dedup_substrings(empty).count() == 0


def test_cut_texts_keep_rows_and_columns(docs):
    out = suffix_dedup.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(TEXTS)
    got = by_id(out)
    assert got[4].text is None and got[15].text == "" and got[6].text == "One"


def test_merged_bwts_sort_all_suffixes():
    contents = [bytes(RNG.integers(97, 99, 500, dtype=np.uint8)) for _ in range(5)]
    contents += [contents[0][60:480] + b"z" * 30, contents[1][:410]]
    got = suffix_dedup.repeated_windows([np.frombuffer(c, np.uint8) for c in contents], 400, 50, 3)
    count = collections.Counter(c[j : j + 400] for c in contents for j in range(len(c) - 399))
    for c, g in zip(contents, got, strict=True):
        assert g.tolist() == [count[c[j : j + 400]] > 1 for j in range(len(c) - 399)]


# --- 2, 8 -------------------------------------------------------------------------------------------------------------


def test_unit_hashes_tell_all_stretches_apart():
    """Equal bytes have equal hashes wherever they lie, others do not: zero bytes at the end, words swapped, lengths about eight."""
    bodies = [bytes([c]) * n for c in (0, 1, 32, 255) for n in range(1, 40)] + [b"abcdefgh" + b"ijklmnop", b"ijklmnop" + b"abcdefgh", b"a\0", b"a", b"\0a", b"x" * 5000, b"x" * 5001]
    bodies = list(dict.fromkeys(bodies))
    again = [*bodies, *reversed(bodies)]
    data = np.frombuffer(b"".join(again), np.uint8)
    after = np.cumsum([len(x) for x in again])
    for h in tokenize.unit_hashes(data, after - [len(x) for x in again], after):
        assert (h[: len(bodies)] == h[len(bodies) :][::-1]).all() and len(np.unique(h)) == len(bodies)
    assert [len(h) for h in tokenize.unit_hashes(data[:0], after[:0], after[:0])] == [0, 0]


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", "bytes"), ("word_bpe_49k.json", "words")])
def test_units_give_the_library_s_ids(name, kind):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenize.tokenizer_path(name))
    lib.encode_special_tokens = True
    texts = [*TEXTS, "x!! y.. \n\n z", " lead", "a  b", "İ. İ", "foo's. bar'.'s", "A\x1c b", "9,9 3.14 a1b2"]
    ids, counts = tokenize.UnitCoder(tokenize.tokenizer_path(name), kind).encode(pa.array(texts))
    ends = np.cumsum(counts)
    for i, t in enumerate(texts):
        assert ids[ends[i] - counts[i] : ends[i]].tolist() == lib.encode(t or "", add_special_tokens=False).ids


def library_ids(name, end):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenize.tokenizer_path(name))
    lib.encode_special_tokens = True
    return [[*lib.encode(t or "", add_special_tokens=False).ids, end] for t in TEXTS]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check_packing(rows, ids, window):
    of_doc, of_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        of_doc[r.doc_id].append(r)
        of_sequence[r.sequence_id].append(r)
        assert crc(ids[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    for i, pieces in of_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids[i])
    for pieces in of_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == window or (at < window and at & (at - 1) == 0)
    assert len(of_doc) == len(ids)


@pytest.mark.parametrize("window", [2048, 64])
def test_packing(docs, window):
    check_packing(packing.pack(docs, window=window).collect(), library_ids("word_bpe_49k.json", 1), window)


def test_packing_equal_lengths(spark):
    df = spark.createDataFrame([(i, "w " * 49) for i in range(50)], "doc_id long, text string")
    rows = packing.pack(df, window=128).collect()
    assert sum(r.length for r in rows) == 50 * 50 and max(r.offset + r.length for r in rows) == 128


def test_packing_an_empty_table(empty):
    assert packing.pack(empty).count() == 0


def test_fill_reaches_the_best_sum():
    for _ in range(50):
        counts = {int(x): int(RNG.integers(1, 4)) for x in RNG.integers(1, 60, 6)}
        first = max(counts)
        sums = {0}
        for x, n in counts.items():
            n -= x == first
            sums = {s + k * x for s in sums for k in range(n + 1)}
        best = max(s for s in sums if s + first <= 100) + first
        got = packing.fill(counts, 100)
        assert sum(x * n for x, n in got.items()) == best and all(n <= counts[x] for x, n in got.items())


def test_token_shards(docs):
    ids = library_ids("byte_bpe_50k.json", 0)
    got = repair_ids.read_shards(repair_ids.write_shards(docs, shard_ids=700)).orderBy("doc_id").collect()
    at = 0
    for i, r in enumerate(got):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids[i]), crc(ids[i]))
        at += len(ids[i])


def test_token_shards_of_an_empty_table(empty):
    assert repair_ids.read_shards(repair_ids.write_shards(empty)).count() == 0


def test_grammar_round_trip_and_random_access():
    ids = np.concatenate([np.tile([5, 6, 7, 5, 6], 200), np.full(300, 9), RNG.integers(0, 50, 2000)]).astype(np.uint16)
    offsets = np.array([0, 1000, 1001, 1300, 3300])
    data = repair_ids.pack_shard(ids, offsets, 100, least=2)
    shard = repair_ids.Shard(data)
    assert (shard.all_ids()[0] == ids).all() and len(data) < 4 * len(ids)
    for i in range(4):
        assert (shard.ids(i) == ids[offsets[i] : offsets[i + 1]]).all()
    with pytest.raises(ValueError):
        repair_ids.Shard(b"nothing")


# --- 3 ----------------------------------------------------------------------------------------------------------------


def slow_fingerprint(text, size):
    import xxhash

    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    bits = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(grams))


def test_fingerprints_and_components(docs):
    got = by_id(simhash.near_duplicates(docs))
    fps = [slow_fingerprint(t, 3) for t in TEXTS]
    root = list(range(len(TEXTS)))
    for a in range(len(fps)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= 2:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    for i, f in enumerate(fps):
        assert got[i].fingerprint == f"{f:016x}" and got[i].component_id == root[i]


def test_simhash_of_an_empty_table(empty):
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


@pytest.mark.parametrize("budget", [1, 2, 5])
def test_trie_finds_all_pairs(budget):
    base = RNG.integers(0, 1 << 62, 60, dtype=np.uint64)
    v = np.unique(np.concatenate([base, *(base ^ np.uint64(1 << int(RNG.integers(0, 62))) for _ in range(3)), base ^ np.uint64(7)]))
    got = [p for i, j in simhash.trie_pairs(v, np.array([0]), np.array([len(v)]), budget, most=64) for p in zip(i.tolist(), j.tolist(), strict=True)]
    want = {(a, b) for a in range(len(v)) for b in range(a + 1, len(v)) if bin(int(v[a] ^ v[b])).count("1") <= budget}
    assert len(got) == len(set(got)) and set(map(lambda p: (min(p), max(p)), got)) == want


def test_one_of_each_group_stays(spark):
    text = prose(200)
    near = text.replace(text.split()[50], "changed", 1)
    rows = [(5, text), (2, text), (9, near), (7, prose(200)), (None, text), (11, None), (12, "")]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 7, 11]


# --- 4 ----------------------------------------------------------------------------------------------------------------


def test_top_k_matches_brute_force(spark):
    v = RNG.normal(size=(300, 8)).astype(np.float32)
    v[10:40] = v[10]
    v[100] = 0
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(400, None), (420, [float("nan")] * 8), (440, [1.0, None, *[1.0] * 6]), (460, [float("inf")] * 8)]
    got = collections.defaultdict(list)
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=20, block=64).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    q = np.floor(64 * v.astype(np.float64)).astype(np.int64)
    assert set(got) == set(range(0, 300, 20))
    for i, rows in got.items():
        s = q @ q[i]
        order = [j for j in np.lexsort((np.arange(300), -s)).tolist() if j != i][:20]
        assert sorted(rows) == [(n + 1, j, int(s[j])) for n, j in enumerate(order)]


def test_top_k_of_an_empty_table(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("coordinate_from", [-2.0, 0.5, 2.0])
def test_both_prunings_keep_the_best(coordinate_from):
    c = np.floor(64 * RNG.normal(size=(200, 6)))
    c = c[np.argsort(-np.linalg.norm(c, axis=1))]
    q, ids = c[::10], np.arange(200)
    scores = q @ c.T
    for i in range(len(q)):
        scores[i, i * 10] = -(10**9)
    floor = np.sort(scores, axis=1)[:, -5]
    row, cand, score = topk.best_in_bucket(ids[::10], q, floor.astype(float), ids, c, 5, coordinate_from)
    for i in range(len(q)):
        assert score[row == i].tolist() == np.sort(scores[i])[::-1][:5].astype(int).tolist()


# --- 5 ----------------------------------------------------------------------------------------------------------------


def test_media_round_trip(docs):
    got = by_id(media.media_column(docs), "id")
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        payload = media.padded(raw)
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert got[2].media_sha256 == got[12].media_sha256 and got[2].dct_hash == got[12].dct_hash and len(got[2].dct_hash) == 8


def test_png_filters_and_checksums():
    pixels = RNG.integers(0, 256, (12, 20), dtype=np.uint8)
    pixels[4:8] = pixels[3]
    data = media.png_encode(pixels)
    assert (media.png_decode(data) == pixels).all()
    with pytest.raises(media.MediaError):
        media.png_decode(data[:50] + bytes([data[50] ^ 1]) + data[51:])
    with pytest.raises(media.MediaError):
        media.png_decode(data[:-6])
    above, lines, kinds = np.zeros(20, int), [], np.arange(12) % 5
    for k, row in zip(kinds, pixels.astype(int), strict=True):  # the five filters, forwards
        left, corner = np.concatenate([[0], row[:-1]]), np.concatenate([[0], above[:-1]])
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        lines.append((row - [0 * left, left, above, (left + above) // 2, paeth][k]) % 256)
        above = row
    assert (media.unfilter(kinds.astype(np.uint8), np.array(lines, np.uint8)) == pixels).all()


# --- 6 ----------------------------------------------------------------------------------------------------------------


def test_shared_passages_share_a_class(docs):
    got = by_id(passages.near_duplicate_passages(docs))
    assert {got[i].class_id for i in (0, 1, 8, 15)} == {0} and got[2].class_id == got[12].class_id == 2 and got[13].class_id == 3
    assert all(got[i].n_links == 0 and got[i].class_id == i for i in (4, 5, 6, 7, 10, 14))
    assert got[1].n_links >= 1 and got[1].words_shared >= 130
    assert len(got) == len(TEXTS)


def test_passages_of_an_empty_table(empty):
    assert passages.near_duplicate_passages(empty).count() == 0


def test_compact_windows_cover_every_stretch_once():
    h, offsets = RNG.integers(0, 1 << 63, 160, dtype=np.uint64), np.array([0, 100, 160])
    w = passages.compact_windows(h, offsets, 1, 10)
    owner = collections.Counter()
    for d, l, c, r in zip(w["doc"], w["l"], w["c"], w["r"], strict=True):
        for i in range(l, c + 1):
            for j in range(max(c, i + 9), r + 1):
                owner[d, i, j] += 1
    want = {(d, i, j) for d, n in enumerate((100, 60)) for i in range(n) for j in range(i + 9, n)}
    assert set(owner) == want and set(owner.values()) == {1}


# --- 7 ----------------------------------------------------------------------------------------------------------------


def test_language_model(docs):
    import math
    import re

    got = by_id(lm_score.score_documents(docs, chunk_bytes=2000))
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").encode().lower().decode()) + ["\n"] for t in TEXTS]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(TEXTS))]
    count = collections.Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = sum(count.values()), len(count)
    for i, t in enumerate(tokens):
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held[i], len(t), sum(count[w] > 0 for w in t), n)
        assert got[i].base_score == pytest.approx(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), abs=1e-9)
        assert got[i].score < 0


def test_language_model_of_an_empty_table(empty):
    assert lm_score.score_documents(empty).count() == 0


def test_interpolation_beats_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = lm_score.score_documents(docs).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b


def test_weights_of_a_mixture():
    w = lm_score.fit_weights([(1, 40, -1, 100), (1, -1, 20, 100), (2, -1, -1, 5)])
    assert w[1].sum() == pytest.approx(1) and w[1, 0] == pytest.approx(0.5, abs=0.02) and w[2, 2] > 0.9


# --- 9 ----------------------------------------------------------------------------------------------------------------


def test_mix(docs):
    got = mixing.mix(docs, shards=4, least_block_words=50).collect()
    sizes = {i: len((t or "").split()) for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r["size"] for r in got} == sizes
    source = {r.source: r for r in got}
    assert sum(r.target for r in source.values()) == pytest.approx(sum(sizes.values()))
    for s, r in source.items():
        mine = [x for x in got if x.source == s]
        assert sum(x["size"] for x in mine) == r.source_size and r.target <= 3 * r.source_size + 1e-6
        assert abs(sum(x.taken for x in mine) - r.target) <= max(x["size"] for x in mine)
        assert all(x.taken == x["size"] * len(x.shards) and len(x.shards) <= 3 for x in mine)
    again = mixing.mix(docs.repartition(5), shards=4, least_block_words=50).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_quotas_split_exactly(spark):
    q = spark.createDataFrame([(1, 7), (2, 20), (3, 1)], "rank int, k long")
    leaves = mixing.split_quotas(q, 3).collect()
    assert {r: sum(x.k for x in leaves if x["rank"] == r) for r in (1, 2, 3)} == {1: 7, 2: 20, 3: 1}
    per = collections.Counter()
    for x in leaves:
        per[x.shard] += x.k
    assert max(per.values()) - min(per[i] for i in range(8)) <= 1


def test_shards_have_local_orders(docs):
    mixed = mixing.mix(docs, shards=4, least_block_words=50)
    rows = mixing.shuffled(mixed).collect()
    assert len(rows) == sum(len(r.shards) for r in mixed.collect())
    for s in {r.shard for r in rows}:
        assert sorted(r.position for r in rows if r.shard == s) == list(range(1, 1 + sum(r.shard == s for r in rows)))


def test_mix_of_an_empty_table(empty):
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_mixing_stays_in_the_jvm(docs):
    plan = mixing.mix(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- 10 ---------------------------------------------------------------------------------------------------------------


def test_severity_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels.where("doc_id % 2 = 0"))
    assert (np.diff(model.thresholds) > 0).all()
    got = toxicity.score(docs, model).join(labels.where("doc_id % 2 = 1").select("doc_id", "toxic"), "doc_id")
    r = got.agg(F.avg(F.when(F.col("toxic") == 1, F.col("rejected").cast("int"))).alias("caught"), F.avg(F.when(F.col("toxic") == 0, F.col("rejected").cast("int"))).alias("wrong")).first()
    assert r.caught > 0.85 and r.wrong < 0.02


def test_toxicity_without_toxic_labels(docs, spark):
    labels = spark.createDataFrame([(0, 1, 0), (1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, labels))
    assert out.count() == len(TEXTS) and out.where("rejected").count() == 0 and out.columns[: len(docs.columns)] == docs.columns


def test_severity_grows_with_markers():
    model = toxicity.OrdinalModel(("bad",), np.array([3.0]), np.array([2.0, 4.0, 6.0]))
    p = model.grades(pa.array(["fine words", "a bad word", "bad, bad; bad bad", None]))
    assert p.sum(1)[0] == p.sum(1)[3] < p.sum(1)[1] < p.sum(1)[2]


# --- near duplicates: no cap on partners ------------------------------------------------------------------------------


def test_near_copies_in_thousands_match_all_pairs(spark):
    rng = np.random.default_rng(29)
    base = rng.choice(WORDS, 110)
    texts = []
    for _ in range(2000):
        w = base.copy()
        at = rng.integers(0, len(w), rng.integers(1, 9))
        w[at] = rng.choice(WORDS, len(at))
        texts.append(" ".join(w))
    texts += [" ".join(rng.permutation(base)) for _ in range(20)]  # one SimHash, no shingles in common
    texts += [t + " " + t.split()[0] for t in texts[-20:]]
    texts = list(dict.fromkeys(texts))
    words = [t.encode().lower().split() for t in texts]
    import xxhash

    fps = np.array([simhash.majority(np.array([xxhash.xxh64_intdigest(x) for x in set(w)], np.uint64)) for w in words], np.uint64)
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in words]
    masks = np.array(simhash.sampled_keys(20, 20), np.uint64)
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(texts)):
        apart = fps[:i] ^ fps[i]
        near = (np.bitwise_count(apart) <= 12) & ((apart[:, None] & masks) == 0).any(axis=1)
        for j in np.flatnonzero(near).tolist():
            a, b = top(i), top(j)
            if a != b and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]):
                root[max(a, b)] = min(a, b)
    want = sorted(i for i in range(len(texts)) if top(i) == i)
    kept = simhash.drop_near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4))
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_long_unlike_texts_are_told_apart_by_their_sketches():
    """Sketches never rule out a pair that is alike enough, and rule out long texts without shingles in common."""
    rng = np.random.default_rng(12)
    sets = []
    for size in (0, 1, 5, 250, 260, 900, 1030, 4000, 20_000):
        x = np.unique(rng.integers(0, 1 << 32, size, dtype=np.uint32))
        edited = x.copy()
        at = rng.random(len(x)) < 0.08
        edited[at] = rng.integers(0, 1 << 32, int(at.sum()), dtype=np.uint32)
        sets += [x, np.unique(edited), x[: max(1, int(len(x) * 0.81))], np.unique(rng.integers(0, 1 << 32, size, dtype=np.uint32))]
    n = np.array([len(x) for x in sets])
    i, j = (x.ravel() for x in np.indices((len(sets), len(sets))))
    got = simhash.may_link(n, simhash.Sketches.of([simhash.parity_sketch(x) for x in sets]), i, j, 0.8)
    both = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
    alike = both >= 0.8 * (n[i] + n[j] - both)
    assert got[alike].all() and alike.sum() > 2 * len(sets)
    assert not got[(both < 0.01 * n[i]) & (n[i] >= 900) & (n[j] >= 900)].any()


# --- 6, against brute force -------------------------------------------------------------------------------------------


def test_near_passages_are_found(spark):
    """Planted passages of 50 to 200 words, exact or edited: their texts share a class if the passages' shingles are alike by 0.8."""
    rng = np.random.default_rng(3)
    fresh = lambda n: [f"w{i}" for i in rng.integers(0, 1 << 40, n)]
    texts, asked = [], []
    for k in range(120):
        passage = fresh(int(rng.integers(50, 200)))
        other = list(passage)
        for at in rng.integers(0, len(passage), k % 4):
            other[at] = "edited"
        grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (passage, other)]
        asked.append(len(grams[0] & grams[1]) >= 0.8 * len(grams[0] | grams[1]))
        texts += [" ".join(fresh(60) + passage + fresh(30)), " ".join(fresh(10) + other + fresh(90))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = by_id(passages.near_duplicate_passages(docs))
    found = [got[2 * k].class_id == got[2 * k + 1].class_id for k in range(120)]
    assert sum(f for f, a in zip(found, asked, strict=True) if a) >= 0.95 * sum(asked)
    assert all(got[2 * k].class_id == 2 * k and got[2 * k].class_texts == 1 + found[k] for k in range(120))


def test_texts_whose_minima_lead_to_other_first_texts_are_compared(spark):
    """Each common minimum of two texts, with the 21 shingles around it, lies in an earlier text that shares no passage with them."""
    rng = np.random.default_rng(8)
    fresh = lambda n: [f"w{i}" for i in rng.integers(0, 1 << 40, n)]

    def windows(words):
        c = lm_score.Chunk.of_texts(pa.array([" ".join(words)]), np.zeros(1, bool))
        return passages.compact_windows(*passages.shingles(c))

    passage = fresh(60)
    a, b = fresh(70) + passage + fresh(40), fresh(30) + passage + fresh(90)
    one, two = windows(a), windows(b)
    common = sorted(set(one["key"].tolist()) & set(two["key"].tolist()))
    assert len(set(one["fn"][np.isin(one["key"], np.array(common, np.uint64))].tolist())) >= passages.ENOUGH
    first = []
    for key in common:
        at = int(one["c"][one["key"] == np.uint64(key)][0])
        near = a[max(70, at - 10) : min(130, at + 15)]
        while key not in windows(other := fresh(40) + near + fresh(40))["key"].tolist():
            pass
        first.append(other)
    texts = [" ".join(w) for w in [*first, a, b, fresh(80)]]
    got = by_id(passages.near_duplicate_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)))
    n = len(first)
    assert got[n].class_id == got[n + 1].class_id == n and got[n].class_texts == 2 and got[n].n_links == got[n + 1].n_links == 1
    assert got[n].words_shared == got[n + 1].words_shared == 60
    assert all(got[i].class_id == i and got[i].n_links == 0 for i in (*range(n), n + 2))


@pytest.mark.parametrize("cells", (1, 1 << 22))
def test_alike_windows_match_all_pairs(cells):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 60, 150).astype(np.uint64)
    parts, group, root, block = [], [], [], []
    for i in range(60):
        x = rng.integers(0, 1 << 60, int(rng.integers(46, 150))).astype(np.uint64)
        k = int(rng.integers(0, len(x) + 1))
        x[:k] = base[:k]
        x[rng.integers(0, len(x), int(rng.integers(0, 9)))] = base[0]
        parts.append(x)
        group.append(i % 3)
        root.append(int(rng.integers(0, 9)))
        block.append(i // 3 % 2 if i % 3 == 2 else 0)
    w = {"group": np.array(group, np.uint64), "root": np.array(root), "block": np.array(block, np.uint32), "n": np.array([len(x) for x in parts], np.int32)}
    need = [np.ceil(0.8 * (46 - max(len(y) - len(np.unique(y)) for y in (x[s : s + 46] for s in range(len(x))))) - 1e-9) for x in parts]
    want = {(i, j) for j in range(60) for i in range(j) if group[i] == group[j] and root[i] != root[j] and (group[i] < 2 or block[i] != block[j]) and len(np.intersect1d(parts[i], parts[j])) >= max(need[i], need[j])}
    got = [(i, j) for x, y in passages.alike_windows(w, np.concatenate(parts), cells) for i, j in zip(x.tolist(), y.tolist(), strict=True)]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_a_text_that_repeats_one_word_is_compared_in_bounded_memory():
    x = np.full(20_000, 7, np.uint64)
    assert [p[:4] for p in passages.passages_of(x, x, diagonals=(0, 0))] == [(0, 19_999, 0, 19_999)]


def test_op1_counts_passages_of_words(spark):
    passage = " ".join(f"p{i}" for i in range(51))
    rows = [(0, passage + " a b"), (1, "c  " + passage.replace(" ", "\n", 4)), (2, " ".join(passage.split()[:50])), (3, None)]
    got = by_id(suffix_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [(got[i].passage_words, got[i].n_passages) for i in range(4)] == [(51, 1), (51, 1), (0, 0), (0, 0)]


def test_grammar_goes_on_until_no_pair_repays_its_rule():
    ids = RNG.zipf(1.3, 30_000).astype(np.int64)
    ids = np.where(ids > 90, 7, ids).astype(np.uint16)
    last = np.zeros(len(ids), bool)
    last[[9_999, 29_999]] = True
    seq, end, left, right = repair_ids.grammar(ids, last, 100)
    assert len(seq) < len(ids) and end.sum() == 2 and len(left) == len(right)
    pairs, at = collections.Counter(), 0
    while at < len(seq) - 1:  # pairs that do not overlap, from the left
        if not end[at]:
            pairs[seq[at], seq[at + 1]] += 1
            at += at + 2 < len(seq) and seq[at] == seq[at + 1] == seq[at + 2]
        at += 1
    assert max(pairs.values()) < 2 * repair_ids.LEAST_COUNT


# --- stages as the pipeline uses them ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def clashing(docs):
    extra = ["row", "id", "_id", "_row", "_source", "shard", "node", "root", "place", "copies", "raw", "spans", "rank", "block"]
    return docs.select("*", *(F.concat(F.lit(f"{c}:"), F.col("doc_id")).alias(c) for c in extra))


def test_near_dedup_keeps_columns_of_any_name(clashing):
    before = {r.doc_id: r for r in clashing.collect()}
    got = simhash.drop_near_duplicates(clashing)
    assert got.columns == clashing.columns
    rows = got.collect()
    assert all(r == before[r.doc_id] for r in rows) and {r.doc_id for r in rows} == {0, 1, 2, 3, 4, 6, 8, 9, 10, 11, 14, 15}


def test_mixed_documents_keep_columns_of_any_name_and_lie_in_shards(clashing):
    before = {r.doc_id: r for r in clashing.collect()}
    taken = {r.doc_id: len(r.shards) for r in mixing.mix(clashing, shards=4).collect()}
    mixed = mixing.mixed_documents(clashing, shards=4)
    assert mixed.columns == clashing.columns and mixed.rdd.getNumPartitions() == 4
    rows = mixed.collect()
    assert all(r == before[r.doc_id] for r in rows)
    assert collections.Counter(r.doc_id for r in rows) == {i: n for i, n in taken.items() if n}


def test_what_a_mix_takes_comes_down_the_tree(docs):
    plan = mixing.mix(docs).select("doc_id", "taken")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") >= 4 and plan.count("Generate") >= 4 and "div 2" in plan


def test_near_duplicate_texts_are_dealt_once(spark):
    texts = [" ".join(f"w{(7 * i + j) % 900}" for j in range(60)) for i in range(40)] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = simhash.drop_near_duplicates(docs)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and sorted(r.text for r in kept.collect()) == sorted(set(texts))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


def test_grammar_counts_only_changed_pairs_again(monkeypatch):
    rng = np.random.default_rng(4)
    ids = np.minimum(rng.zipf(1.3, 60_000), 900).astype(np.uint16)
    offsets = np.arange(0, len(ids) + 1, 500)
    whole, kept, binned, rounds = repair_ids._pair_bins, repair_ids._frequent, [], []

    def bins_of(*args):
        binned.append(len(out := whole(*args)))
        return out

    def frequent(seq, bins, counts, *args):
        assert len(bins) == len(seq) - 1 and (counts[:-1] == np.bincount(bins, minlength=len(counts))[:-1]).all()
        rounds.append(len(seq))
        return kept(seq, bins, counts, *args)

    monkeypatch.setattr(repair_ids, "_pair_bins", bins_of)
    monkeypatch.setattr(repair_ids, "_frequent", frequent)
    found, at = repair_ids.Shard(repair_ids.pack_shard(ids, offsets, 1000)).all_ids()
    assert (found == ids).all() and (at == offsets).all()
    assert len(rounds) > 5 and sum(binned) < 0.6 * sum(rounds)
