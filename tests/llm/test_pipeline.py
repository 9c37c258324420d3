"""The pipeline's stages against what they promise."""

from __future__ import annotations

import corpus_pipeline


def test_stages_and_run(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, rows = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf)
        docs.write.parquet(str(tmp_path / name.replace(" ", "-")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "-")))
        rows[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
        if name in ("toxicity", "simhash near-dedup"):
            assert docs.count() <= before.count() and docs.subtract(before).count() == 0
        if name == "suffix-array dedup":
            assert docs.count() == before.count()
    shingles = [{tuple(w[i : i + 5]) for w in [r.text.lower().split()] for i in range(max(1, len(w) - 4))} for r in rows["simhash near-dedup"]]
    for i, a in enumerate(shingles):
        for b in shingles[:i]:
            assert len(a & b) < 0.8 * len(a | b)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, rows["packing"]))


def test_repeated_passages_of_short_words(spark):
    def words(tag, n):
        return " ".join(f"{tag}{i}" for i in range(n))

    passage, fifty, long = words("p", 51), words("q", 50), words("longer-than-eight-bytes", 20)
    assert len(passage) < 400 < len(long)
    texts = [
        words("a", 70) + " " + passage + " " + words("b", 9),
        words("c", 5) + "\n" + passage.replace(" ", "  ", 3) + " é " + words("d", 80),
        fifty + " " + words("e", 60),
        words("f", 60) + " " + fifty,
        words("g", 60) + " " + long,
        long + " " + words("h", 60),
        words("i", 55),
        words("i", 55),
        words("j", 50),
        words("j", 50),
        None,
        "",
    ]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_chars int").repartition(3)
    got = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, docs, "").collect()}
    split = {i: None if t is None else t.split() for i, t in got.items()}
    assert split[0] == (words("a", 70) + " " + words("b", 9)).split()
    assert split[1] == (words("c", 5) + " é " + words("d", 80)).split()
    assert [split[i] for i in (2, 3)] == [texts[i].split() for i in (2, 3)]
    assert [split[i] for i in (4, 5)] == [words("g", 60).split(), words("h", 60).split()]
    assert [split[i] for i in (6, 7, 10, 11)] == [[], [], None, []]
    assert [split[i] for i in (8, 9)] == [texts[8].split()] * 2
