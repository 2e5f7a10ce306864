"""Quality scores from hashed word n-grams: logistic regression learnt with follow-the-regularised-leader updates.

Words, digits and runs of punctuation are tokens. The features of a text are hashed n-grams of its tokens (one and two) and of their
shapes (one to three): letter case and length of a word, the characters of punctuation. A feature's value is its share among the
features of its kind, so a score is one sparse dot product per text and does not follow its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from countspark.llm.common import bytes_of, groups, id_column, mix, runs, slices

BITS = 18
#: Documents that a model is fitted on at most; those with the smallest hash of their key are taken.
TRAIN_ROWS = 8192
EPOCHS = 4
#: Fixed values of the update rule: step size, offset of the step size, L1 and L2 weight.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
#: Values are shares times this, so that a typical text has features of the order of one.
SCALE = 24.0
#: N-grams without weight that every text has besides its own, so that a few words decide little.
PRIOR = 8.0

#: 1 letters (all bytes above ASCII too), 2 digits, 3 punctuation, 0 white space.
_KINDS = np.full(256, 3, np.uint8)
_KINDS[[0x20, *range(0x09, 0x0E)]] = 0
_KINDS[0x30:0x3A] = 2
_KINDS[0x41:0x5B] = _KINDS[0x61:0x7B] = _KINDS[0x80:] = 1
_UPPER = np.zeros(256, np.int64)
_UPPER[0x41:0x5B] = 1
_SAME = np.arange(256, dtype=np.uint8)


def _ngrams(codes: np.ndarray, owner: np.ndarray, n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``n`` tokens of one text each, and their texts."""
    if len(codes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.full(len(codes) - n + 1, salt, np.uint64)
    for k in range(n):
        h = mix(h ^ codes[k:len(codes) - n + 1 + k])
    inside = owner[:len(h)] == owner[n - 1:]
    return h[inside], owner[:len(h)][inside]


def features(texts: list[bytes], bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For each kind of n-gram: bucket and text of every occurrence."""
    joined, words, owner, starts, lengths = runs(texts, _KINDS, _SAME)
    if len(words) == 0:
        return
    folded = runs(texts, _KINDS)[1]
    kind = _KINDS[joined[starts]]
    upper = np.add.reduceat(_UPPER[joined], np.stack((starts, starts + lengths), 1).ravel())[::2]
    case = np.where(upper == 0, 0, np.where(upper == lengths, 1, np.where((upper == 1) & (_UPPER[joined[starts]] == 1), 2, 3)))
    shape = np.where(kind == 3, words, (kind * 64 + case * 16 + np.minimum(lengths, 12)).astype(np.uint64))
    mask = np.uint64((1 << bits) - 1)
    for salt, (codes, n) in enumerate(((folded, 1), (folded, 2), (shape, 1), (shape, 2), (shape, 3))):
        h, of = _ngrams(codes, owner, n, 1 + salt)
        yield (h & mask).astype(np.int64), of, salt


def sparse_rows(texts: list[bytes], bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets and values of each text, for training."""
    sums: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in texts]
    counts = np.zeros((len(texts), 5))
    for at, part in groups(texts):
        for bucket, of, kind in features(part, bits):
            edges = np.searchsorted(of, np.arange(len(part) + 1))
            for i, row in enumerate(at):
                found, n = np.unique(bucket[edges[i]:edges[i + 1]], return_counts=True)
                sums[row].append((found + (kind << bits), n.astype(float)))
                counts[row, kind] += n.sum()
    out = []
    for row, parts in enumerate(sums):
        if not parts:
            out.append((np.zeros(0, np.int64), np.zeros(0)))
            continue
        found, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        value = np.bincount(where, np.concatenate([p[1] for p in parts])) / (counts[row, found >> bits] + PRIOR) * SCALE
        found, where = np.unique(found & ((1 << bits) - 1), return_inverse=True)
        out.append((found, np.bincount(where, value)))
    return out


def dot_products(texts: list[bytes], weights: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Sparse dot product of each text with the weights."""
    sums, counts = np.zeros((len(texts), 5)), np.zeros((len(texts), 5))
    for at, part in groups(texts):
        rows = np.array(at)
        for bucket, of, kind in features(part, bits):
            np.add.at(sums[:, kind], rows, np.bincount(of, weights[bucket], len(part)))
            np.add.at(counts[:, kind], rows, np.bincount(of, minlength=len(part)))
    return (sums / (counts + PRIOR)).sum(1) * SCALE


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, *, bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and intercept after ``epochs`` passes over the rows in the given order; the intercept is not regularised."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias, bias_n = 0.0, 0.0
    for _ in range(epochs):
        for (at, x), y in zip(rows, labels):
            za, na = z[at], n[at]
            w = np.where(np.abs(za) <= L1, 0.0, -(za - np.sign(za) * L1) / ((BETA + np.sqrt(na)) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(w @ x + bias, -35, 35)))
            g = (p - y) * x
            step = (np.sqrt(na + g * g) - np.sqrt(na)) / ALPHA
            z[at] = za + g - step * w
            n[at] = na + g * g
            bias_n += (p - y) ** 2
            bias -= ALPHA * (p - y) / (BETA + np.sqrt(bias_n))
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)), float(bias)


def held_out(key: str = "doc_id") -> Column:
    """Whether crc32 of the key, as text, leaves 1 when divided by 3; such rows are never learnt from. A null key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS, bits: int = BITS) -> tuple[np.ndarray, float]:
    """Fit on at most ``rows`` labelled documents (those with the smallest hash of their key), in the order of that hash.

    Keys with contradicting labels, without a label or held out are left out. Without rows of both labels all weights are zero.
    """
    chosen = (labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(key)).groupBy(F.col(key).alias("_key"))
              .agg(F.min(label).alias("_low"), F.max(label).alias("_high")).where("_low = _high")
              .select("_key", F.col("_low").cast("int").alias("_y"), F.xxhash64("_key").alias("_h")).orderBy("_h", "_key").limit(rows))
    texts = (docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
             .join(F.broadcast(chosen), F.col("_id") == F.col("_key")).select("_h", "_y", "_text"))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            found = sparse_rows(bytes_of(batch.column(2)), bits)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a.astype(np.int32) for a, _ in found], pa.list_(pa.int32())),
                                              pa.array([v.astype(np.float32) for _, v in found], pa.list_(pa.float32()))], ["h", "y", "at", "x"])

    # a key may be repeated in the documents, so the bound is kept again; the same order, and equal rows are alike
    sparse = texts.mapInArrow(featurise, "h bigint, y int, at array<int>, x array<float>").orderBy("h", F.size("at"), F.xxhash64("at", "x")).limit(rows)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, y = [], []
        for batch in batches:
            y += batch.column(1).to_pylist()
            data += [(np.asarray(a, np.int64), np.asarray(v, float)) for a, v in zip(*[[x.values.to_numpy() for x in batch.column(i)] for i in (2, 3)])]
        weights, bias = ftrl(data, np.array(y, float), bits=bits) if len(set(y)) == 2 else (np.zeros(1 << bits), 0.0)
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype("<f4").tobytes()]), pa.array([bias])], ["weights", "bias"])

    model = sparse.coalesce(1).mapInArrow(fit, "weights binary, bias double").collect()
    if not model:
        return np.zeros(1 << bits, np.float32), 0.0
    return np.frombuffer(model[0]["weights"], "<f4"), model[0]["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, float], *, key: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """``docs`` as (key, text) with ``score``: the chance of label 1, in one pass over the whole texts. The model has a fixed size."""
    weights, bias = np.asarray(model[0], np.float64), model[1]
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            dots = dot_products(bytes_of(batch.column(1)), shared.value, bits) + bias
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(dots, -35, 35))))], ["id", "score"])

    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {id_column(docs, key)}, score double").select(F.col("id").alias(key), "score")


def classify(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per row of ``docs``: key, ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from a score of 0.5).

    Null and empty texts get the score of the intercept. Repeated rows are scored alike; other columns are ignored, and neither labels
    nor keys enter a score. An empty table of documents gives an empty result, one of labels the score 0.5.
    """
    model = train(docs, labels, key=key, text=text, label=label, rows=rows)
    scored = score(docs, model, key=key, text=text)
    return scored.select(key, held_out(key).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


def good_rows(docs: DataFrame, labels: DataFrame, *, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores at least 0.5, unchanged and in one narrow pass."""
    weights, bias = train(docs, labels, text=text)
    shared = docs.sparkSession.sparkContext.broadcast(np.asarray(weights, np.float64))
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, place):
            dots = dot_products(bytes_of(batch.column(place)), shared.value) + bias
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(dots, -35, 35))) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
