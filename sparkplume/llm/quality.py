"""Quality classifier: a factorisation machine over hashed words, structure statistics and text metadata.

The score is a logistic of ``w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j``. The pairwise sum is taken in linear time
as ``0.5 * sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)``. Words are hashed into ``BUCKETS`` features with damped
counts of unit length; the structure statistics are standardised. Labels, language, source and ids are never inputs.

The machine is fitted on the driver from the features of at most ``TRAIN_ROWS`` labelled rows (a documented bound; rows
are picked by a hash of the id) and then scores every whole text where it lies. Only the model, of fixed size, is broadcast.

Defined results: null and empty texts are scored like any other, by the statistics of an empty text. Without a label of
each kind the score is the share of label 1 seen (0.5 if none). Labels that are null or of a null id are not used; a row
with several labels counts with each. Every input row gives a row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkplume.llm import arrays as A
from sparkplume.llm.decontaminate import IS_WORD
from sparkplume.llm.language import held_out

BUCKETS = 1 << 14
RANK = 8
TRAIN_ROWS = 8000
EPOCHS = 12
BATCH = 64
RATE = 0.08
DECAY = 2e-4

CLASSES = {
    "letters": [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)],
    "upper": [*range(0x41, 0x5B)],
    "digits": [*range(0x30, 0x3A)],
    "blanks": [0x20, 0x09],
    "lines": [0x0A, 0x0D],
    "stops": [0x2E, 0x2C, 0x3B, 0x3A, 0x21, 0x3F],
    "marks": [0x23, 0x24, 0x25, 0x26, 0x2A, 0x40, 0x5E, 0x7C, 0x7E, 0x3C, 0x3E, 0x5B, 0x5D, 0x7B, 0x7D, 0x5C, 0x2F, 0x3D],
    "wide": [*range(0x80, 0x100)],
}
MEMBER = np.zeros((len(CLASSES), 256), dtype=bool)
for _k, _codes in enumerate(CLASSES.values()):
    MEMBER[_k, _codes] = True
STATISTICS = len(CLASSES) + 8

FEATURES = "doc_id long, bucket binary, value binary, dense binary"
SCORED = "doc_id long, score double"


class Features:
    """Of a slice: words as (``bucket``, ``value``) with ``first`` per row, and the dense statistics (rows, STATISTICS)."""

    def __init__(self, column: pa.Array):
        data, ends = A.texts(column)
        lower = A.LOWER[data]
        words = A.Words(lower, ends, IS_WORD)
        rows = len(ends) - 1
        size = np.diff(ends)
        count = np.diff(words.first)

        def per_row(flag: np.ndarray, limits: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate(([0], np.cumsum(flag)))[limits])

        own = per_row((data & 0xC0) != 0x80, ends)
        shares = [per_row(m[data], ends) / np.maximum(size, 1) for m in MEMBER]
        key = words.doc.astype(np.int64) * BUCKETS + (words.hash % np.uint64(BUCKETS)).astype(np.int64)
        pair, n = np.unique(key, return_counts=True)
        row = pair // BUCKETS
        self.first = np.searchsorted(row, np.arange(rows + 1))
        self.bucket = (pair % BUCKETS).astype(np.int32)
        value = np.log1p(n)
        norm = np.sqrt(np.bincount(row, value**2, rows))
        self.value = (value / np.maximum(norm, 1e-12)[row]).astype(np.float32)
        length = words.end - words.start
        again = np.zeros(len(length), dtype=bool)
        again[1:] = words.hash[1:] == words.hash[:-1]
        again[words.first[:-1][count > 0]] = False
        after = np.zeros(len(length), dtype=bool)  # words that run straight into a sign other than a full stop
        nxt = np.minimum(words.end, max(len(data) - 1, 0))
        if len(data):
            after = MEMBER[6][data[nxt]] & (words.end < ends[words.doc + 1])
        total = np.maximum(count, 1)
        spread = per_row(length**2, words.first) / total - (per_row(length, words.first) / total) ** 2
        more = [
            np.log1p(own),
            np.log1p(count),
            np.log1p(size - own),
            per_row(length, words.first) / total,
            np.sqrt(np.maximum(spread, 0)),
            np.diff(self.first) / total,
            per_row(again, words.first) / total,
            per_row(after, words.first) / total,
        ]
        self.dense = np.stack([*shares, *more], axis=1).astype(np.float32)


def _feature_batches(batches):
    for batch in A.slices(batches):
        f = Features(batch.column("text"))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                A.binary_column(f.bucket, f.first),
                A.binary_column(f.value, f.first),
                A.binary_column(f.dense.ravel(), np.arange(len(f.dense) + 1) * STATISTICS),
            ],
            ["doc_id", "bucket", "value", "dense"],
        )


class Machine:
    """Weights of the factorisation machine; dense statistics are the features after the buckets."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, bias: float):
        random = np.random.RandomState(5)
        self.mean, self.spread, self.w0 = mean, spread, bias
        self.w = np.zeros(BUCKETS + STATISTICS)
        self.v = random.normal(0, 0.02, (BUCKETS + STATISTICS, RANK))

    def inputs(self, bucket, value, first, dense):
        """Sparse rows with the standardised statistics appended: (feature, value, row)."""
        rows = len(first) - 1
        scaled = np.clip((dense - self.mean) / self.spread, -4, 4)
        row = np.concatenate((np.repeat(np.arange(rows), np.diff(first)), np.repeat(np.arange(rows), STATISTICS)))
        feature = np.concatenate((bucket, np.tile(np.arange(BUCKETS, BUCKETS + STATISTICS), rows)))
        return feature, np.concatenate((value, scaled.ravel())), row

    def raw(self, feature, value, row, rows):
        """Outputs, and the sums per row and factor that the gradient needs."""
        linear = np.bincount(row, self.w[feature] * value, rows)
        part = self.v[feature] * value[:, None]
        sums = np.stack([np.bincount(row, part[:, f], rows) for f in range(RANK)], axis=1)
        squares = np.bincount(row, (part**2).sum(axis=1), rows)
        return self.w0 + linear + 0.5 * ((sums**2).sum(axis=1) - squares), sums

    def scores(self, f: Features) -> np.ndarray:
        feature, value, row = self.inputs(f.bucket, f.value, f.first, f.dense)
        out, _ = self.raw(feature, value, row, len(f.first) - 1)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fitted(bucket: list, value: list, dense: np.ndarray, label: np.ndarray) -> Machine:
    """Adagrad on the logistic loss, in shuffled batches."""
    share = float(label.mean()) if len(label) else 0.5
    constant = share in (0.0, 1.0) or len(label) == 0
    mean = dense.mean(axis=0) if len(dense) else np.zeros(STATISTICS)
    spread = np.maximum(dense.std(axis=0), 1e-6) if len(dense) else np.ones(STATISTICS)
    bounded = min(max(share, 1e-6), 1 - 1e-6)
    machine = Machine(mean, spread, float(np.log(bounded / (1 - bounded))))
    if constant:
        machine.v[:] = 0
        return machine
    random = np.random.RandomState(11)
    gw, gv, g0 = np.full(machine.w.shape, 1e-2), np.full(machine.v.shape, 1e-2), 1e-2
    for _ in range(EPOCHS):
        for part in np.array_split(random.permutation(len(label)), max(1, len(label) // BATCH)):
            first = np.concatenate(([0], np.cumsum([len(bucket[k]) for k in part])))
            feature, x, row = machine.inputs(
                np.concatenate([bucket[k] for k in part]), np.concatenate([value[k] for k in part]), first, dense[part]
            )
            out, sums = machine.raw(feature, x, row, len(part))
            slope = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - label[part]) / len(part)
            own = machine.v[feature]
            dv = (slope[row] * x)[:, None] * (sums[row] - own * x[:, None])
            touched, place = np.unique(feature, return_inverse=True)
            dw = np.bincount(place, slope[row] * x, len(touched)) + DECAY * machine.w[touched]
            dv = np.stack([np.bincount(place, dv[:, f], len(touched)) for f in range(RANK)], axis=1)
            dv += DECAY * machine.v[touched]
            gw[touched] += dw**2
            gv[touched] += dv**2
            g0 += slope.sum() ** 2
            machine.w[touched] -= RATE * dw / np.sqrt(gw[touched])
            machine.v[touched] -= RATE * dv / np.sqrt(gv[touched])
            machine.w0 -= RATE * slope.sum() / np.sqrt(g0)
    return machine


def bounded_sample(labels: DataFrame, label: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled ids, picked by a hash of the id."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    picked = usable.select("doc_id", F.col(label).cast("int").alias("label"))
    return picked.orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id", "label").limit(rows)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> Machine:
    """Fit on a bounded sample of the labelled rows."""
    sample = bounded_sample(labels, label, rows)
    known = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id").distinct()), "doc_id", "left_semi")
    joined = known.mapInArrow(_feature_batches, FEATURES).join(F.broadcast(sample), "doc_id")
    # at most `rows` rows of features, in an order that does not depend on the partitions
    found = joined.orderBy("doc_id", "label", "value", "bucket").limit(rows).select("bucket", "value", "dense", "label").toArrow()
    bucket = [np.frombuffer(x.as_py(), dtype=np.int32) for x in found["bucket"]]
    value = [np.frombuffer(x.as_py(), dtype=np.float32) for x in found["value"]]
    dense = np.array([np.frombuffer(x.as_py(), dtype=np.float32) for x in found["dense"]], dtype=np.float64)
    return fitted(bucket, value, dense.reshape(-1, STATISTICS), np.array(found["label"].to_pylist(), dtype=np.float64))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        for batch in A.slices(batches):
            scores = held.value.scores(Features(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, SCORED)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 4, fold: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted), learned from the labels outside the fold."""
    machine = train(docs, labels.where(~held_out(F.col("doc_id"), folds, fold)))
    return judged(score(docs, machine), threshold, folds, fold)


def judged(scored: DataFrame, threshold: float, folds: int, fold: int, *more: str) -> DataFrame:
    predicted: Column = (F.col("score") >= threshold).cast("int")
    held = held_out(F.col("doc_id"), folds, fold)
    return scored.select("doc_id", held.alias("held_out"), "score", predicted.alias("predicted"), *more)


def accepted(docs: DataFrame, machine: Machine, threshold: float = 0.7) -> DataFrame:
    """Whole rows of the documents that score at least the threshold."""
    held = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        for batch in A.slices(batches):
            good = held.value.scores(Features(batch.column("text"))) >= threshold
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
