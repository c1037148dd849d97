"""Quality classification: hashed word n-grams, logistic regression, FTRL.

Features are hashes of words and word pairs, of the same for word shapes, and
of two patterns (a word that repeats its neighbour, a five-word window seen
before).  A document's value for a feature is its share of the document's
n-grams of that kind, so that length alone decides nothing; its score is a
sparse dot product through the logistic function.

Weights are learned by follow-the-regularised-leader updates over a sample of
labelled documents.  The sample is bounded (``max_train``, those with the least
hashed ids) because the updates are sequential; features are computed where
the texts are, and scoring covers every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm import textops as tx


@dataclass(frozen=True)
class Params:
    bits: int = 18
    scale: float = 16.0
    max_train: int = 12_000
    epochs: int = 4
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02
    threshold: float = 0.3


def _shapes(w: tx.Words) -> np.ndarray:
    """A hash of each word's shape: which classes of characters it has, its first and last, and its length's order."""
    kind = np.zeros(256, np.int64)
    kind[65:91], kind[97:123], kind[48:58], kind[128:] = 1, 2, 4, 2
    kind[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 8
    k = kind[w.data]
    out = np.zeros(len(w.start), np.int64)
    for i, bit in enumerate((1, 2, 4, 8)):
        total = np.concatenate([[0], np.cumsum(k == bit)])
        out |= np.minimum(3, total[w.end] - total[w.start]) << (2 * i)
    last = w.data[w.end - 1].astype(np.int64)
    return tx.mix((out | np.where(kind[last] == 8, last, 0) << 8).astype(np.uint64))


def features(column: pa.Array, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, values and documents of all n-grams, not yet summed."""
    w = tx.words(column)
    n = w.counts
    h, shape = tx.word_hashes(w), _shapes(w) if len(w.start) else np.zeros(0, np.uint64)
    ids, docs, vals = [], [], []

    def put(hashes: np.ndarray, doc: np.ndarray, seed: int) -> None:
        share = p.scale / np.maximum(1, np.bincount(doc, minlength=len(n)))
        ids.append((tx.mix(hashes + tx.U64(seed)) >> tx.U64(64 - p.bits)).astype(np.int64))
        docs.append(doc)
        vals.append(share[doc])

    put(h, w.doc, 1)
    put(shape, w.doc, 2)
    for kind, seed in ((h, 3), (shape, 4)):
        s, at = tx.windows(kind, w, 2)
        put(s, w.doc[at], seed)
    if len(h):
        same = np.flatnonzero((h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1]))
        s, at = tx.windows(h, w, 5)
        key = s ^ tx.mix(w.doc[at].astype(np.uint64))
        order = np.argsort(key, kind="stable")
        again = at[order[1:][key[order[1:]] == key[order[:-1]]]]
        for places, seed in ((same, 5), (again, 6)):
            ids.append(np.full(len(places), int(tx.mix(np.array([seed], np.uint64))[0] >> tx.U64(64 - p.bits))))
            docs.append(w.doc[places])
            vals.append(p.scale / np.maximum(1, n[w.doc[places]]))
    return np.concatenate(ids), np.concatenate(vals), np.concatenate(docs)


def ftrl(rows: Iterator[tuple[np.ndarray, np.ndarray, int]], z: np.ndarray, g2: np.ndarray, p: Params) -> None:
    """FTRL-Proximal updates of the state (z, sum of squared gradients) for each row in turn."""
    for idx, val, label in rows:
        zi, ni = z[idx], g2[idx]
        root = np.sqrt(ni)
        w = np.where(np.abs(zi) > p.l1, -(zi - np.sign(zi) * p.l1) / ((p.beta + root) / p.alpha + p.l2), 0.0)
        g = (1.0 / (1.0 + np.exp(-np.clip(w @ val, -35, 35))) - label) * val
        z[idx] += g - (np.sqrt(ni + g * g) - root) / p.alpha * w
        g2[idx] += g * g


def weights(z: np.ndarray, g2: np.ndarray, p: Params) -> np.ndarray:
    return np.where(np.abs(z) > p.l1, -(z - np.sign(z) * p.l1) / ((p.beta + np.sqrt(g2)) / p.alpha + p.l2), 0.0)


def train(docs: DataFrame, labels: DataFrame, params: Params | None = None) -> np.ndarray:
    """Weights from ``docs (doc_id, text)`` and ``labels (doc_id, quality)``.

    Null ids and qualities teach nothing; of repeated labels the least counts;
    labels without a document don't count towards ``max_train``.  Repeated
    rows of one id and text teach once, those of one id with other texts go by
    a hash of the text, so that equal tables give equal weights.  Without
    labelled documents all weights are zero and every score is 0.5.  The last
    feature is a constant.
    """
    p = params or Params()
    labelled = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("label"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    known = rows.select("doc_id", "tie").join(labelled, "doc_id").distinct()
    chosen = known.select("doc_id", "tie", "label", F.xxhash64("doc_id").alias("rank")).orderBy("rank", "doc_id", "tie").limit(p.max_train).select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), "label", "rank")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in tx.slices(batch.column(3)):
                ids, vals, doc = features(part, p)
                key, place = np.unique(doc * (1 << p.bits) + ids, return_inverse=True)
                total = np.bincount(place, weights=vals, minlength=len(key)).astype(np.float32)
                cut = np.searchsorted(key >> p.bits, np.arange(len(part) + 1))
                bound = pa.array(cut.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(at, len(part)) for i in range(3)), pa.ListArray.from_arrays(bound, pa.array((key & ((1 << p.bits) - 1)).astype(np.int32))), pa.ListArray.from_arrays(bound, pa.array(total))],
                    ["rank", "tie", "label", "idx", "val"],
                )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, before = [], None
        for batch in batches:
            for i in range(len(batch)):
                key = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                if key == before:
                    continue
                idx, val = (batch.column(c)[i].values.to_numpy() for c in (3, 4))
                rows.append((np.append(idx, 1 << p.bits), np.append(val, np.float32(1)).astype(np.float64), int(batch.column(2)[i].as_py() > 0)))
                before = key
        z, g2 = np.zeros((1 << p.bits) + 1), np.zeros((1 << p.bits) + 1)
        for _ in range(p.epochs):
            ftrl(iter(rows), z, g2, p)
        yield pa.RecordBatch.from_arrays([pa.array([weights(z, g2, p).astype("<f4").tobytes()], pa.binary())], ["w"])

    sample = rows.join(F.broadcast(chosen), (F.col("doc_id") == F.col("_id")) & (F.col("tie") == F.col("_tie"))).select("rank", "tie", "label", "text")  # max_train rows
    found = sample.mapInArrow(extract, "rank long, tie long, label int, idx array<int>, val array<float>")
    model = found.repartition(1).sortWithinPartitions("rank", "tie").mapInArrow(learn, "w binary").collect()
    # the optimiser may drop the whole job where it knows that there are no rows
    return np.frombuffer(model[0]["w"], "<f4").astype(np.float64) if model else np.zeros((1 << p.bits) + 1)


def score(docs: DataFrame, w: np.ndarray, params: Params | None = None) -> DataFrame:
    """doc_id, score and predicted of each row of ``docs (doc_id, text)``.

    A null text counts as empty; an empty one gets the score of the constant.
    Null and repeated ids are rows of their own; other columns are ignored; an
    empty table gives an empty one.
    """
    p = params or Params()
    shared = docs.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for at, part in tx.slices(batch.column(1)):
                ids, vals, doc = features(part, p)
                dot = np.bincount(doc, weights=w[ids] * vals, minlength=len(part)) + w[-1]
                s = 1.0 / (1.0 + np.exp(-np.clip(dot, -35, 35)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(s), pa.array((s >= p.threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")
