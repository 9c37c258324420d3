"""Toxicity: cumulative-link ordinal regression on sparse text features.

Severity grades 0 (clean) to 3 share one weight vector across ordered thresholds: P(grade >= k) = sigmoid(w.x - t_k).
Labels only say toxic or not, so the grades 1 to 3 of the toxic training texts are the thirds by what they hold of marker words.
Features are marker words and marker word beginnings (4 to 6 letters): those that toxic labelled texts hold far more often
than clean ones.  A feature's value is log2(1 + its count).

The model is fitted on a bounded sample: at most ``MOST_OF_A_CLASS`` labelled texts of either class, the first by a hash
of their id.  Scoring reads every whole text.  Contracts: a null or empty text has no features; a document without a label
plays no part in the fit; of several labels of a document the largest counts; without any toxic label nothing is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written
from .tokenize import whole_texts

#: Labelled texts of either class that the fit may take; markers kept; toxic texts that must hold a marker, as a number and as
#: a share of the toxic ones; least log-odds.
MOST_OF_A_CLASS, MOST_MARKERS, LEAST_SUPPORT, LEAST_SHARE, LEAST_LOG_ODDS = 10_000, 4096, 3, 0.02, 2.0
GRADES = 3
BEGINNINGS = (4, 5, 6)
_EDGE = re.compile(r"^[^\w]+|[^\w]+$")


def features_of(word: str) -> list[str]:
    """A lower-case word without outer punctuation, and its beginnings."""
    word = _EDGE.sub("", word.lower())
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)] if word else []


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(row of each word, code of each word, the distinct words)."""
    units = pc.ascii_split_whitespace(pc.ascii_lower(whole_texts(texts)))
    offsets = np.asarray(units.offsets, dtype=np.int64)
    coded = units.flatten().dictionary_encode()
    lengths = np.diff(offsets)
    # a text that begins or ends with white space gives empty units
    return np.repeat(np.arange(len(lengths)), lengths), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def _counts(texts: pa.Array, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, count) of the known features that the texts hold, and the number of words of each text."""
    rows, codes, names = _words(texts)
    of = [[known[f] for f in features_of(w) if f in known] for w in names]
    hit = np.fromiter(map(bool, of), bool, len(of))
    empty = np.fromiter((not w for w in names), bool, len(names))
    n_words = np.bincount(rows[~empty[codes]], minlength=len(texts)) if len(codes) else np.zeros(len(texts), np.int64)
    at = np.flatnonzero(hit[codes]) if len(codes) else np.zeros(0, np.int64)
    pairs = [(r, f) for r, c in zip(rows[at].tolist(), codes[at].tolist(), strict=True) for f in of[c]]
    if not pairs:
        return *(np.zeros(0, np.int64) for _ in range(3)), n_words
    pairs, count = np.unique(np.array(pairs, np.int64), axis=0, return_counts=True)
    return pairs[:, 0], pairs[:, 1], count, n_words


@dataclass(frozen=True)
class OrdinalModel:
    features: tuple[str, ...]
    weights: np.ndarray
    thresholds: np.ndarray

    def grades(self, texts: pa.Array) -> np.ndarray:
        """P(grade >= k) for k from 1, a row for each text."""
        rows, feats, count, _ = _counts(texts, {f: i for i, f in enumerate(self.features)})
        eta = np.bincount(rows, self.weights[feats] * np.log2(1 + count), minlength=len(texts)) if len(rows) else np.zeros(len(texts))
        return _sigmoid(eta[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit_ordinal(rows: np.ndarray, feats: np.ndarray, values: np.ndarray, grade: np.ndarray, n_feats: int, weight: np.ndarray, steps: int = 1500, ridge: float = 5e-6) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by full-batch adaptive gradient steps on the cumulative-link likelihood.

    Thresholds are a first one and positive gaps, so they stay ordered.  ``weight`` undoes the sampling of the classes.
    """
    n = len(grade)
    weight = weight / weight.sum()
    theta = np.zeros(n_feats + GRADES)
    theta[n_feats:] = [2.0, 0.0, 0.0]
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, gaps = theta[:n_feats], np.exp(theta[n_feats + 1 :])
        t = theta[n_feats] + np.concatenate([[0], np.cumsum(gaps)])
        eta = np.bincount(rows, w[feats] * values, minlength=n) if len(rows) else np.zeros(n)
        at_least = np.column_stack([np.ones(n), _sigmoid(eta[:, None] - t), np.zeros(n)])
        slope = at_least * (1 - at_least)
        k = np.arange(n), grade
        up = np.arange(n), grade + 1
        p = np.maximum(at_least[k] - at_least[up], 1e-12)
        d_low, d_high = weight * slope[k] / p, weight * slope[up] / p
        d_eta = -(d_low - d_high)
        d_t = np.array([(d_low[grade == j + 1]).sum() - (d_high[grade == j]).sum() for j in range(GRADES)])
        grad = np.zeros_like(theta)
        if len(rows):
            grad[:n_feats] = np.bincount(feats, d_eta[rows] * values, minlength=n_feats)
        grad[:n_feats] += ridge * w
        tail = np.cumsum(d_t[::-1])[::-1]
        grad[n_feats] = tail[0]
        grad[n_feats + 1 :] = tail[1:] * gaps
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        theta -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    t = theta[n_feats] + np.concatenate([[0], np.cumsum(np.exp(theta[n_feats + 1 :]))])
    return theta[:n_feats], t


def training_sample(docs: DataFrame, labels: DataFrame, most: int = MOST_OF_A_CLASS, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic") -> DataFrame:
    """(doc_id, toxic, text) of at most ``most`` labelled documents of either class, the first by a hash of their id.

    The chosen ids are at most ``2 * most`` rows, so they are broadcast and no text is shuffled.
    """
    marked = labels.where(F.col(id_col).isNotNull() & F.col(toxic_col).isNotNull()).groupBy(id_col).agg((F.max(toxic_col) > 0).alias("_toxic"))
    order = F.xxhash64(F.col(id_col)), F.col(id_col)
    chosen = marked.where("_toxic").orderBy(*order).limit(most).unionByName(marked.where("NOT _toxic").orderBy(*order).limit(most))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen.withColumnRenamed(id_col, "doc_id")), "doc_id").select("doc_id", F.col("_toxic").alias("toxic"), "text")


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_OF_A_CLASS, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic") -> OrdinalModel:
    """Markers are counted and the sparse rows are made by Spark jobs over the sample; the driver gets bounded tables only."""
    sample = written(training_sample(docs, labels, most, id_col, text_col, toxic_col), "toxic-sample")

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        for b in batches:
            toxic = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            rows, codes, names = _words(b.column(2))
            pairs = np.unique(rows * len(names) + codes) if names else np.zeros(0, np.int64)
            of = [features_of(w) for w in names]
            held: dict[int, set[str]] = {}
            for p in pairs.tolist():
                held.setdefault(p // len(names), set()).update(of[p % len(names)])
            for r, fs in held.items():
                for f in fs:
                    seen.setdefault(f, [0, 0])[0 if toxic[r] else 1] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([x[0] for x in seen.values()], pa.int64()), pa.array([x[1] for x in seen.values()], pa.int64())], ["feature", "n_toxic", "n_clean"])

    # copies of a text would make its words look like markers
    once = sample.dropDuplicates(["toxic", "text"])
    sizes = {bool(r.toxic): r["count"] for r in once.groupBy("toxic").count().collect()}
    a, c = sizes.get(True, 0), sizes.get(False, 0)
    odds = F.log((F.col("n_toxic") + 0.5) / (a + 1)) - F.log((F.col("n_clean") + 0.5) / (c + 1))
    counted = once.select(*sample.columns).mapInArrow(presence, "feature string, n_toxic long, n_clean long").groupBy("feature").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"))
    top = counted.where(F.col("n_toxic") >= max(LEAST_SUPPORT, LEAST_SHARE * a)).withColumn("odds", odds).where(F.col("odds") >= LEAST_LOG_ODDS).withColumn("z", F.col("odds") / F.sqrt(1 / (F.col("n_toxic") + 0.5) + 1 / (F.col("n_clean") + 0.5))).orderBy(F.desc("z"), "feature").limit(MOST_MARKERS)
    markers = sorted(r.feature for r in top.select("feature").collect())
    known = {f: i for i, f in enumerate(markers)}

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, feats, count, n_words = _counts(b.column(2), known)
            cut = np.searchsorted(rows, np.arange(len(b) + 1))
            lists = [pa.array([x[i:j].tolist() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.list_(pa.int64())) for x in (feats, count)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists, pa.array(n_words, pa.int64())], ["doc_id", "toxic", "feats", "counts", "n_words"])

    kind = docs.schema[id_col].dataType.simpleString()
    got = sample.mapInArrow(sparse, f"doc_id {kind}, toxic boolean, feats array<long>, counts array<long>, n_words long").orderBy("doc_id", "n_words").collect()
    held = np.array([np.log2(1 + np.array(r["counts"], np.float64)).sum() for r in got])
    toxic = np.array([r.toxic for r in got], bool)
    grade = np.zeros(len(got), np.int64)
    if toxic.any():
        grade[toxic] = 1 + np.searchsorted(np.quantile(held[toxic], [1 / 3, 2 / 3]), held[toxic], side="left")
    rows = np.repeat(np.arange(len(got)), [len(r.feats) for r in got]) if got else np.zeros(0, np.int64)
    feats = np.array([f for r in got for f in r.feats], np.int64)
    values = np.log2(1 + np.array([x for r in got for x in r["counts"]], np.float64))
    of_all = {bool(r.toxic): r["count"] for r in labels.where(F.col(id_col).isNotNull()).groupBy((F.col(toxic_col) > 0).alias("toxic")).count().where("toxic IS NOT NULL").collect()}
    weight = np.where(toxic, of_all.get(True, 0) / max(1, toxic.sum()), of_all.get(False, 0) / max(1, (~toxic).sum()))
    weights, thresholds = fit_ordinal(rows, feats, values, grade, len(markers), weight) if toxic.any() else (np.zeros(len(markers)), np.array([50.0, 51.0, 52.0]))
    return OrdinalModel(tuple(markers), weights, thresholds)


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", reject_at: float = 0.5) -> DataFrame:
    """Every row of ``docs`` with ``expected_severity``, ``p_toxic`` (of grade 1 or more) and ``rejected`` (p_toxic >= reject_at)."""
    names = docs.columns
    clash = {"expected_severity", "p_toxic", "rejected"} & set(names)
    kept = docs.drop(*clash)
    at = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = model.grades(b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p.sum(1)), pa.array(p[:, 0]), pa.array(p[:, 0] >= reject_at)], [*b.schema.names, "expected_severity", "p_toxic", "rejected"])

    schema = type(kept.schema)([*kept.schema.fields]).add("expected_severity", "double").add("p_toxic", "double").add("rejected", "boolean")
    return kept.mapInArrow(run, schema)
