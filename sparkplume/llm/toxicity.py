"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

At most ``EXAMPLES`` labelled rows of each class (a documented bound; picked by a hash of the id) are the examples. Every
word of theirs is indexed. A word that a text holds n times weighs (1 + ln n) * idf * relevance there, where relevance is the
chi-square of word and label among the examples (at least ``FLOOR``): plain TF-IDF is ruled by the topic of a text, while a
text is toxic by few words of it. Texts are vectors of unit length; words that no example holds count in the length.
The index holds, for every word, the examples that contain it with their weights, grouped into blocks of examples, and
the largest weight per block; the DENSE words that most examples hold are columns of each block. A text's cosine with any
example of a block is at most the sum of its weights times those maxima, so a block whose bound is below the K-th best cosine
found is passed over without loss.

The nearest examples vote, weighted by closeness. Votes become scores by a monotone calibration fitted on the examples
themselves, each left out of its own vote, and weighted to the labels' true shares. The nearest ids are the evidence.
Labels, language, source and ids are never inputs of a score; only the index, of bounded size, is broadcast.

Defined results: texts without a word of the index, empty and null ones among them, get the rate of toxic labels among
examples without a neighbour (the share of label 1, if every example has one). With no labels of one class every score is the share of label 1 (0 if there are none). Labels that
are null or of a null id are not used; equal cosines go to the example of the smaller id. Every input row gives a row;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkplume.llm import arrays as A
from sparkplume.llm.decontaminate import words_of
from sparkplume.llm.language import held_out
from sparkplume.llm.quality import bounded_sample, judged

EXAMPLES = 2048
BLOCK = 128
DENSE = 256
GROUP = 256  # texts compared at a time
K = 15
FLOOR = 1e-6
TIE = 12  # digits that decide between cosines

COUNTED = "doc_id long, word binary, n binary"
SCORED = "doc_id long, score double, evidence array<long>"


def counted(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word hashes of each text with their counts, and where each text's begin and end."""
    words = words_of(column)
    order = np.lexsort((words.hash, words.doc))
    h, doc = words.hash[order], words.doc[order]
    head = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))[: len(h)])
    n = np.diff(np.concatenate((head, [len(h)])))
    return h[head], n, np.searchsorted(doc[head], np.arange(len(column) + 1))


def _count_batches(batches):
    for batch in A.slices(batches):
        word, n, first = counted(batch.column("text"))
        columns = [batch.column("doc_id"), A.binary_column(word, first), A.binary_column(n.astype(np.int64), first)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "word", "n"])


class Index:
    """Examples as a block-max inverted index, and the calibration of their votes."""

    def __init__(self, ids: np.ndarray, label: np.ndarray, word: list, n: list, share: float):
        self.share = share
        self.ids, self.label = ids, label.astype(np.float64)
        every = np.concatenate([*word, np.empty(0, dtype=np.uint64)])
        self.term, number = np.unique(every, return_inverse=True)
        if len(self.term) == 0 or not 0 < label.sum() < len(label):
            self.term = np.empty(0, dtype=np.uint64)
            return
        rows, row = len(ids), np.repeat(np.arange(len(word)), [len(w) for w in word])
        df = np.bincount(number)
        self.unknown = (np.log(1 + rows) + 1) * FLOOR
        self.weight = (np.log((1 + rows) / (1 + df)) + 1) * self._relevance(number, row, df)
        value = self._unit(row, self.weight[number], np.concatenate(n), rows)
        self._post(number, row, value, df)
        self._calibrate(number, row, value)

    def _relevance(self, number, row, df) -> np.ndarray:
        """Chi-square of each word's presence and the label."""
        rows, toxic = len(self.ids), self.label.mean()
        expected = df * toxic
        spread = expected * (1 - toxic) * (1 - df / rows)
        off = np.bincount(number, self.label[row], len(df)) - expected
        return np.maximum(np.where(spread > 0, off**2 / np.maximum(spread, 1e-12), 0), FLOOR)

    def _post(self, number, row, value, df) -> None:
        self.blocks = -(-len(self.ids) // BLOCK)
        common = np.argsort(-df, kind="stable")[:DENSE]
        self.column = np.full(len(df), -1, dtype=np.int32)
        self.column[common] = np.arange(len(common))
        self.dense = np.zeros((self.blocks * BLOCK, len(common)))
        wide = self.column[number] >= 0
        self.dense[row[wide], self.column[number[wide]]] = value[wide]
        self.dense_max = self.dense.reshape(self.blocks, BLOCK, -1).max(axis=1)
        number, row, value = number[~wide], row[~wide], value[~wide]
        # postings ordered by word, block, example
        order = np.lexsort((row, number))
        self.post_place, self.post_value = (row[order] % BLOCK).astype(np.int16), value[order]
        cell = number[order] * self.blocks + row[order] // BLOCK
        self.cell_first = np.searchsorted(cell, np.arange(len(df) * self.blocks + 1)).astype(np.int32)
        filled, start = np.unique(cell, return_index=True)
        self.max_block = (filled % self.blocks).astype(np.int16)
        self.max_value = np.maximum.reduceat(self.post_value, start) if len(start) else np.empty(0)
        self.max_first = np.searchsorted(filled // self.blocks, np.arange(len(df) + 1))

    @staticmethod
    def _unit(row, weight, n, rows) -> np.ndarray:
        value = (1 + np.log(n)) * weight
        return value / np.sqrt(np.maximum(np.bincount(row, value**2, rows), 1e-300))[row]

    def query(self, word, n, row, rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, numbers and weights of the words of texts that the index holds."""
        place = np.minimum(np.searchsorted(self.term, word), len(self.term) - 1)
        held = self.term[place] == word
        value = self._unit(row, np.where(held, self.weight[place], self.unknown), n, rows)
        return row[held], place[held], value[held]

    def nearest(self, row, number, value, rows, own: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and places of the K nearest examples of each row (-1 where there are fewer); exact.

        ``own``: row i is example i and is left out of its own result. Words come in the order of their rows.
        """
        best, place = np.zeros((rows, K)), np.full((rows, K), -1)
        first = np.searchsorted(row, np.arange(rows + 1))
        for low in range(0, rows, GROUP):
            high = min(low + GROUP, rows)
            part = slice(first[low], first[high])
            skip = np.arange(low, high) if own else None
            best[low:high], place[low:high] = self._nearest(row[part] - low, number[part], value[part], high - low, skip)
        return best, place

    def _nearest(self, row, number, value, rows, skip):
        wide = self.column[number] >= 0
        query = np.zeros((rows, self.dense.shape[1]))
        query[row[wide], self.column[number[wide]]] = value[wide]
        row, number, value = row[~wide], number[~wide], value[~wide]
        first = np.searchsorted(row, np.arange(rows + 1))
        length = np.diff(self.max_first)[number]
        at = A.runs(self.max_first[number], length)
        bound = query @ self.dense_max.T + np.bincount(
            np.repeat(row, length) * self.blocks + self.max_block[at],
            np.repeat(value, length) * self.max_value[at],
            rows * self.blocks,
        ).reshape(rows, self.blocks)
        score = np.zeros((rows, self.blocks, BLOCK))
        top = np.zeros((rows, K))  # best cosines so far

        def visit(block: int, live: np.ndarray) -> None:
            terms = A.runs(first[live], np.diff(first)[live])
            cell = number[terms] * self.blocks + block
            many = self.cell_first[cell + 1] - self.cell_first[cell]
            some = many > 0
            many, terms = many[some], terms[some]
            post = A.runs(self.cell_first[cell[some]].astype(np.int64), many)
            owner = np.repeat(np.arange(len(live)), np.diff(first)[live])[some]
            found = np.bincount(
                np.repeat(owner, many) * BLOCK + self.post_place[post],
                np.repeat(value[terms], many) * self.post_value[post],
                len(live) * BLOCK,
            ).reshape(len(live), BLOCK)
            found = found + query[live] @ self.dense[block * BLOCK : (block + 1) * BLOCK].T
            if skip is not None:
                found[block * BLOCK + np.arange(BLOCK) == skip[live][:, None]] = 0
            score[live, block] = found
            top[live] = np.partition(np.concatenate((top[live], found), axis=1), BLOCK, axis=1)[:, BLOCK:]

        best_block = bound.argmax(axis=1)
        for block in np.unique(best_block).tolist():
            visit(block, np.flatnonzero(best_block == block))
        for block in range(self.blocks):
            # equal bounds are visited too, for the smaller id
            live = (bound[:, block] > 0) & (bound[:, block] >= top.min(axis=1) - 1e-9) & (best_block != block)
            if live.any():
                visit(block, np.flatnonzero(live))
        # examples are numbered in the order of their ids
        score = score.reshape(rows, -1)
        asker, example = np.nonzero((score > 0) & (score >= top.min(axis=1)[:, None] - 1e-9))
        cosine = score[asker, example]
        order = np.lexsort((example, -np.round(cosine, TIE), asker))
        turn = np.arange(len(asker)) - np.searchsorted(asker, asker)
        kept = turn < K
        best, place = np.zeros((rows, K)), np.full((rows, K), -1)
        best[asker[kept], turn[kept]] = cosine[order][kept]
        place[asker[kept], turn[kept]] = example[order][kept]
        return best, place

    def _votes(self, best, place) -> np.ndarray:
        """Share of label 1 among the nearest, weighted by closeness; -1 without any."""
        weight = np.where(place >= 0, best / (1.0001 - np.minimum(best, 1)), 0)
        total = weight.sum(axis=1)
        return np.where(total > 0, (weight * self.label[place]).sum(axis=1) / np.maximum(total, 1e-12), -1.0)

    def _calibrate(self, number, row, value) -> None:
        vote = self._votes(*self.nearest(row, number, value, len(self.ids), own=True))
        toxic = self.label.mean()
        weight = np.where(self.label > 0, self.share / toxic, (1 - self.share) / (1 - toxic))
        level, mean, mass = [], [], []
        for v in np.unique(vote):  # pool neighbours that break the order
            here = vote == v
            level.append(v)
            mean.append(np.average(self.label[here], weights=weight[here]))
            mass.append(weight[here].sum())
            while len(mean) > 1 and level[-2] >= 0 and mean[-2] > mean[-1]:
                mean[-2:] = [np.average(mean[-2:], weights=mass[-2:])]
                mass[-2:] = [sum(mass[-2:])]
                level.pop(-2)
        self.level, self.rate = np.array(level), np.array(mean)

    def scores(self, column: pa.Array) -> tuple[np.ndarray, list]:
        rows = len(column)
        if len(self.term) == 0:
            return np.full(rows, self.share), [[]] * rows
        word, n, first = counted(column)
        best, place = self.nearest(*self.query(word, n, np.repeat(np.arange(rows), np.diff(first)), rows), rows)
        vote = self._votes(best, place)
        some = self.level >= 0
        score = np.full(rows, self.rate[~some][0] if not some.all() else self.share)
        if some.any():
            score = np.where(vote >= 0, np.interp(vote, self.level[some], self.rate[some]), score)
        return score, [self.ids[p[p >= 0][:3]].tolist() for p in place]


def build(docs: DataFrame, labels: DataFrame, label: str = "toxic", examples: int = EXAMPLES) -> Index:
    """Index of a bounded sample of the labelled rows."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    share = usable.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0
    sides = [bounded_sample(usable.where(F.col(label) == side), label, examples) for side in (0, 1)]
    sample = sides[0].union(sides[1])
    known = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id").distinct()), "doc_id", "left_semi")
    joined = known.mapInArrow(_count_batches, COUNTED).join(F.broadcast(sample), "doc_id")
    found = joined.orderBy("doc_id", "label", "word").limit(2 * examples).toArrow()
    word = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in found["word"]]
    n = [np.frombuffer(x.as_py(), dtype=np.int64) for x in found["n"]]
    return Index(found["doc_id"].to_numpy(), found["label"].to_numpy(), word, n, share)


def score(docs: DataFrame, index: Index) -> DataFrame:
    """(doc_id, score, evidence) of every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        for batch in A.slices(batches):
            scores, evidence = held.value.scores(batch.column("text"))
            columns = [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(evidence, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "evidence"])

    return docs.select("doc_id", "text").mapInArrow(run, SCORED)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 4, fold: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence), learned from the labels outside the fold."""
    index = build(docs, labels.where(~held_out(F.col("doc_id"), folds, fold)))
    scored = score(docs, index)
    return judged(scored, threshold, folds, fold, "evidence")
