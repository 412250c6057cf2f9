"""Benchmark decontamination by suffix arrays over the training text.

Every task cuts its documents into shards of bounded size and builds a suffix array over each: the word suffixes of all
its documents in lexicographic order, to the depth of a window. Every suffix of every benchmark item is then located by
binary search, one word deeper at a time, so that the depth where its range becomes empty is its longest match there.
Ranges that are left at the depth of a window give all places of that window; consecutive places on one diagonal merge
into the longest verbatim match.

Only positions followed by enough words of the benchmark's vocabulary enter a suffix array, which loses no match: a
window cannot lie anywhere else. The benchmark is the stated query set. It goes through in blocks of at most
``BLOCK_WORDS`` words, each a broadcast of bounded size; documents never leave their task.

Defined results: null and empty texts have no words and no hits. Items without words, and items with a null id, have no
windows. Repeated items count once per id. Documents keep one row each, repeated or not, whatever their id; columns
other than ``doc_id`` and ``text`` (``item_id`` and ``text``) are ignored. An empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkplume.llm import arrays as A

WINDOW = 10
BLOCK_WORDS = 1 << 18

IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

MATCHES = "doc_id long, item_id string, doc_word long, item_word long, n_words long"
REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


@dataclass
class Block:
    """Items of one block: their ids, and a row per window with the item, its place and length, and its word numbers."""

    item_ids: list[str]
    vocabulary: np.ndarray  # sorted word hashes; word number is place + 1
    item: np.ndarray
    place: np.ndarray
    length: np.ndarray
    window: np.ndarray  # (windows, WINDOW), 0 beyond the length


def words_of(column: pa.Array) -> A.Words:
    data, ends = A.texts(column)
    return A.Words(A.LOWER[data], ends, IS_WORD)


def block_of(rows: list[tuple]) -> Block:
    words = words_of(pa.array([text for _, text in rows], pa.string()))
    vocabulary = np.unique(words.hash)
    number = np.searchsorted(vocabulary, words.hash) + 1
    size = np.diff(words.first)
    length = np.minimum(size, WINDOW)
    windows = np.where(size > 0, size - length + 1, 0)
    item = np.repeat(np.arange(len(rows)), windows)
    place = A.runs(np.zeros(len(rows), dtype=np.int64), windows)
    at = words.first[item] + place
    need = length[item]
    padded = np.concatenate((number, np.zeros(WINDOW, dtype=number.dtype)))
    window = np.stack([np.where(k < need, padded[at + k], 0) for k in range(WINDOW)], axis=1)
    return Block([str(i) for i, _ in rows], vocabulary, item, place, need, window)


def blocks(benchmark: DataFrame) -> list:
    """Broadcast blocks of the benchmark, each of at most BLOCK_WORDS words (a longer item is a block of its own)."""
    context = benchmark.sparkSession.sparkContext
    out, rows, held = [], [], 0
    items = benchmark.select(F.col("item_id").cast("string"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    for row in items.distinct().toLocalIterator():
        size = len(row[1]) // 2 + 1
        if rows and held + size > BLOCK_WORDS:
            out.append(context.broadcast(block_of(rows)))
            rows, held = [], 0
        rows.append((row[0], row[1]))
        held += size
    if rows:
        out.append(context.broadcast(block_of(rows)))
    return out


def located(words: A.Words, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Window numbers and the word positions where they occur, through a suffix array of the shard."""
    nothing = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    if len(block.item) == 0 or len(words.hash) == 0:
        return nothing
    number = np.searchsorted(block.vocabulary, words.hash)
    known = block.vocabulary[np.minimum(number, len(block.vocabulary) - 1)] == words.hash
    number = np.where(known, number + 1, 0)
    # words of the vocabulary that follow without a break, to the end of the document at most
    count = len(number)
    stop = np.full(count, words.first[-1])
    stop[~known] = np.flatnonzero(~known)
    stop = np.minimum(np.minimum.accumulate(stop[::-1])[::-1], words.first[words.doc + 1])
    kept = np.flatnonzero(stop - np.arange(count) >= block.length.min())
    if len(kept) == 0:
        return nothing
    # sort by doubling is not needed to a fixed depth: ten word numbers are the key
    padded = np.concatenate((number, np.zeros(WINDOW, dtype=number.dtype)))
    left = (stop - np.arange(count))[kept]
    column = [np.where(k < left, padded[kept + k], 0) for k in range(WINDOW)]
    order = np.lexsort(column[::-1])
    suffix = kept[order]
    # binary search of all windows at once, a word deeper each time
    many = len(block.vocabulary) + 2
    low = np.zeros(len(block.item), dtype=np.int64)
    high = np.full(len(block.item), len(suffix))
    group = np.zeros(len(suffix), dtype=np.int64)  # suffixes that agree so far
    for k in range(WINDOW):
        key = group * many + column[k][order]
        open_ = (block.length > k) & (low < high)
        asked = group[np.minimum(low, len(group) - 1)] * many + block.window[:, k]
        low = np.where(open_, np.searchsorted(key, asked, "left"), low)
        high = np.where(open_, np.searchsorted(key, asked, "right"), high)
        group = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
    hits = np.maximum(high - low, 0)
    return np.repeat(np.arange(len(hits)), hits), suffix[A.runs(low, hits)]


def _match_rows(batch: pa.RecordBatch, held: list) -> pa.RecordBatch:
    words = words_of(batch.column("text"))
    parts = []
    for block in (b.value for b in held):
        window, at = located(words, block)
        item, place, length = block.item[window], block.place[window], block.length[window]
        order = np.lexsort((at, at - place, item))
        item, place, length, at = item[order], place[order], length[order], at[order]
        # a run of neighbouring windows of one item on one diagonal of one document is one match
        same = (np.diff(item) == 0) & (np.diff(at - place) == 0) & (np.diff(at) == 1)
        same &= np.diff(words.doc[at]) == 0 if len(at) else True
        head = np.flatnonzero(np.concatenate(([True], ~same)))[: len(at)]
        tail = np.concatenate((head[1:], [len(at)]))[: len(head)] - 1
        doc = words.doc[at[head]]
        parts.append(
            (doc, np.array(block.item_ids, dtype=object)[item[head]], at[head] - words.first[doc], place[head], at[tail] - at[head] + length[tail])
        )
    doc, *rest = [np.concatenate(c).tolist() for c in zip(*parts)] if parts else [[]] * 5
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id").take(pa.array(doc, pa.int64())),
            *(pa.array(c, kind) for c, kind in zip(rest, (pa.string(), pa.int64(), pa.int64(), pa.int64()))),
        ],
        ["doc_id", "item_id", "doc_word", "item_word", "n_words"],
    )


def longest_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All longest verbatim matches of at least a window, with their locations in words."""
    held = blocks(benchmark)

    def run(batches):
        for batch in A.slices(batches):
            yield _match_rows(batch, held)

    return docs.select("doc_id", "text").mapInArrow(run, MATCHES)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document its words, the words inside any occurrence of a window, and the items these came from."""
    held = blocks(benchmark)

    def run(batches):
        for batch in A.slices(batches):
            yield _report_rows(batch, held)

    return docs.select("doc_id", "text").mapInArrow(run, REPORT)


def _report_rows(batch: pa.RecordBatch, held: list) -> pa.RecordBatch:
    words = words_of(batch.column("text"))
    rows = batch.num_rows
    change = np.zeros(len(words.hash) + 1, dtype=np.int64)
    items: dict[int, set[str]] = {}
    for block in (b.value for b in held):
        window, at = located(words, block)
        np.add.at(change, at, 1)
        np.add.at(change, at + block.length[window], -1)
        for doc, item in np.unique(np.stack((words.doc[at], block.item[window])), axis=1).T.tolist():
            items.setdefault(doc, set()).add(block.item_ids[item])
    hit = np.concatenate(([0], np.cumsum(np.cumsum(change)[:-1] > 0)))
    n_hit = hit[words.first[1:]] - hit[words.first[:-1]]
    named = [sorted(items.get(i, ())) for i in range(rows)]
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"),
            pa.array(np.diff(words.first), pa.int64()),
            pa.array(n_hit, pa.int64()),
            pa.array([len(x) for x in named], pa.int64()),
            pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in named], pa.string()),
            pa.array(n_hit > 0, pa.bool_()),
        ],
        ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    )


def uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Whole rows of the documents that hold no window, in the given columns."""
    held = blocks(benchmark)
    schema = docs.schema

    def run(batches):
        for batch in A.slices(batches):
            clean = pc.invert(_report_rows(batch, held).column("contaminated"))
            yield batch.filter(clean)

    return docs.mapInArrow(run, schema)
