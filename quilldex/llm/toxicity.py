"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text, each counted once: its words, the words' first bytes, pairs of
neighbouring words, and pairs with one word between. Training goes over a bounded sample
of labelled rows in one task; per-coordinate rates and L1 leave few weights, which all
tasks that score receive. Scoring is one map over the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work
from .textvec import NOT_ALNUM, mix, texts_of, word_hashes

BITS = 20
PREFIX_BYTES = 5
#: Bounds of the training sample: rows of label 1, rows of label 0, and bytes of a row's text.
MOST_TOXIC, MOST_CLEAN, MOST_BYTES = 4000, 8000, 40_000
THRESHOLD = 0.7
ALPHA, BETA, L1, L2, EPOCHS = 2.0, 1.0, 6.0, 0.5, 5
SLICE_ROWS = 500
_SAMPLE = pa.schema([("label", pa.int32()), ("order", pa.int64()), ("features", pa.binary())])
_WEIGHTS = pa.schema([("feature", pa.int32()), ("weight", pa.float64())])
_SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def features_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, text each belongs to), with repeats."""
    words, counts, starts = word_hashes(texts, NOT_ALNUM, PREFIX_BYTES)
    owner = np.repeat(np.arange(len(texts)), counts)
    out, of = [words, starts], [owner, owner]
    for gap, salt in ((1, 0x2545F4914F6CDD1D), (2, 0x9E6C63D0876A9A47)):
        near = owner[gap:] == owner[:-gap]
        out.append(mix(words[:-gap] * np.uint64(salt) + words[gap:])[near])
        of.append(owner[gap:][near])
    return (np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int32), np.concatenate(of)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            features, owner = features_of(texts_of(part.column(2)))
            keys = np.unique(owner.astype(np.int64) << 32 | features)
            cuts = np.searchsorted(keys >> 32, np.arange(part.num_rows + 1))
            low = (keys & 0xFFFFFFFF).astype("<i4")
            packed = [low[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(packed, pa.binary())], schema=_SAMPLE)


class Ftrl:
    """FTRL-proximal with a rate per coordinate; the last coordinate is the intercept, without L1."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.l1 = np.full(size + 1, L1)
        self.l1[size] = 0

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1[at], 0, (np.sign(z) * self.l1[at] - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def fit(rows: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Features and weights that are not zero, from (label, distinct features) in order."""
    model = Ftrl(1 << BITS)
    rows = [(y, np.append(f, np.int32(1 << BITS))) for y, f in rows]
    for _ in range(EPOCHS):
        for label, at in rows:
            model.learn(at, label)
    w = model.weights(np.arange((1 << BITS) + 1))
    found = np.flatnonzero(w)
    return found.astype(np.int32), w[found]


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        for label, order, packed in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            rows.append((order, label, packed))
    if rows:
        rows.sort()
        found, w = fit([(label, np.frombuffer(f, "<i4")) for _, label, f in rows])
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(w)], schema=_WEIGHTS)


def lowest(known: DataFrame, label: int, most: int) -> DataFrame:
    """Of the rows of a label the ``most`` with the lowest ``order``, ties by doc_id.

    Orders are hashes: a limit on them, from the label's count, leaves about twice as many
    rows to sort whatever the table's size, and is raised until it leaves enough.
    """
    rows = known.filter(F.col("label") == label)
    n, share = rows.count(), 2.0
    while share * most < n:
        below = rows.filter(F.col("order") <= int(-(1 << 63) + share * most / n * (1 << 64)))
        if below.count() >= most:
            rows = below
            break
        share *= 2
    return rows.orderBy("order", "doc_id").limit(most)


def train(docs: DataFrame, labels: DataFrame, work: Work) -> tuple[np.ndarray, np.ndarray]:
    """Weights from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic), both restricted to what may be learnt.

    The sample: per label the rows with the lowest hashes of their doc_id, ties by doc_id, at
    most MOST_TOXIC and MOST_CLEAN, texts up to MOST_BYTES; only this sample comes to one
    task. Null doc_ids and labels other than 0 and 1 don't count, nor do null and longer
    texts. A label that repeats counts once, a doc_id with both labels once for each; of the
    texts of a repeated doc_id the first in order counts. Without labelled texts there are
    no weights. Other columns, whatever their names, don't matter.
    """
    order = F.xxhash64("doc_id", F.lit(3))
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("label"), order.alias("order")).filter("label in (0, 1) and doc_id is not null").distinct()
    known = work.keep(known, "known")
    chosen = work.keep(lowest(known, 1, MOST_TOXIC).unionByName(lowest(known, 0, MOST_CLEAN)), "chosen")
    # at most MOST_TOXIC + MOST_CLEAN rows of three numbers
    texts = docs.filter(F.octet_length("text") <= MOST_BYTES).select("doc_id", "text")
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("label", "order", "doc_id").agg(F.min("text").alias("text"))
    packed = work.keep(sample.select("label", "order", "text").mapInArrow(_featurise, "label int, order long, features binary"), "features")
    rows = packed.repartition(1).mapInArrow(_fit, "feature int, weight double").collect()
    return np.array([r.feature for r in rows], np.int32), np.array([r.weight for r in rows])


def scores_of(texts: list[bytes], dense: np.ndarray) -> np.ndarray:
    features, owner = features_of(texts)
    hit = np.flatnonzero(dense[features])
    keys = np.unique(owner[hit].astype(np.int64) << 32 | features[hit])
    total = np.bincount(keys >> 32, weights=dense[keys & 0xFFFFFFFF], minlength=len(texts)) + dense[1 << BITS]
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, score (0 to 1) for each row of ``docs`` (doc_id, text).

    A text without words, null too, gets the intercept's; without weights all get 0.5. Equal
    texts have equal scores, repeated rows stay repeated, no rows give no rows, very long
    texts are scored whole. Other columns, whatever their names, don't matter. One map.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most 2**BITS weights, a few thousand in practice

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros((1 << BITS) + 1)
        dense[sent.value[0]] = sent.value[1]
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores_of(texts_of(part.column(1)), dense))], schema=_SCORES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
