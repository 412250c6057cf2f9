"""Periodic runs of words by internal pattern matching.

A run is a stretch of words with smallest period q that reaches at least max(6, 4 q) words and cannot be extended. It
holds a block of L words, L a power of two with q < L <= 2 q, that begins at a multiple of L in its text, and the block stands
again q words to the right or to the left inside the run; no place between is one, since a block of at least q words meets
itself inside the run at multiples of q only. So:

* the suffix array of all words of a slice of texts is refined by doubling; after each step the suffixes that still share
  their first L words are an interval of it, and the aligned blocks among them are asked for;
* a wavelet tree over the array of places answers, for all blocks at once, the next place to the right and to the left
  within the block's interval (range successor, range predecessor);
* a distance of at most L is the difference of the progression in which the block stands there: a candidate period. It is
  extended both ways as far as the words agree, and kept if it is the smallest period and long enough.

Words of different texts never compare equal, so one array serves a whole slice. Only places that share their first two
words with another one enter the tree. No exchange takes place: a row's runs depend on its text alone.

Defined results: a null or empty text has no word and no run. A text of any length is treated whole, alone in its slice if
long. Repeated rows and rows with a null id get a row each. Other columns are ignored. No rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkplume.llm import arrays as A

LEAST = 6  # words of the shortest run
TIMES = 4  # periods in the shortest run

NOT_WORD = np.ones(256, dtype=bool)
NOT_WORD[[0x20, *range(0x09, 0x0E)]] = False

RUN = "struct<start: long, length: long, period: long>"
FOUND = f"doc_id long, runs array<{RUN}>, collapsed string"


class WaveletTree:
    """Values in their order, by bits from the top; answers about intervals of the order, for arrays of questions."""

    def __init__(self, values: np.ndarray):
        self.bits = max(int(values.max()).bit_length(), 1) if len(values) else 1
        self.zeros, self.ones_before = [], []
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit) & 1
            self.ones_before.append(np.concatenate(([0], np.cumsum(one))).astype(np.int32))
            self.zeros.append(len(values) - int(one.sum()))
            values = np.concatenate((values[one == 0], values[one == 1]))

    def smaller(self, low: np.ndarray, high: np.ndarray, than: np.ndarray) -> np.ndarray:
        """How many values of low:high are smaller. Bounds lie within the values' bits."""
        count = np.zeros(len(low), dtype=np.int64)
        for k, (zeros, ones) in enumerate(zip(self.zeros, self.ones_before)):
            l1, h1 = ones[low], ones[high]
            one = ((than >> (self.bits - 1 - k)) & 1).astype(bool)
            count += np.where(one, (high - low) - (h1 - l1), 0)
            low, high = np.where(one, zeros + l1, low - l1), np.where(one, zeros + h1, high - h1)
        return count

    def kth(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value of low:high, from 0."""
        value = np.zeros(len(low), dtype=np.int64)
        for zeros, ones in zip(self.zeros, self.ones_before):
            l1, h1 = ones[low], ones[high]
            without = (high - low) - (h1 - l1)
            one = k >= without
            value = value * 2 + one
            k = np.where(one, k - without, k)
            low, high = np.where(one, zeros + l1, low - l1), np.where(one, zeros + h1, high - h1)
        return value

    def around(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For a value x of each interval: the largest smaller one and the smallest larger one, -1 where there is none."""
        below = self.smaller(low, high, x)
        left, right = np.full(len(x), -1, dtype=np.int64), np.full(len(x), -1, dtype=np.int64)
        a, b = below > 0, below + 1 < high - low
        left[a] = self.kth(low[a], high[a], below[a] - 1)
        right[b] = self.kth(low[b], high[b], below[b] + 1)
        return left, right


def suffix_blocks(symbol: np.ndarray, text_start: np.ndarray, text_end: np.ndarray):
    """Suffix array and, per aligned block that stands twice, (place, length, interval of the array).

    ``symbol`` orders words and differs between texts; the others give each word's text. Also returns the slots of the
    array that share their first two words with a neighbour.
    """
    n = len(symbol)
    array = np.argsort(symbol, kind="stable")
    ordered = symbol[array]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))[:n]
    size = np.diff(np.append(first, n))
    rank = np.empty(n, dtype=np.int64)
    rank[array] = np.repeat(first, size)
    slots = np.flatnonzero(np.repeat(size > 1, size))
    length, questions, pairs = 1, [], None
    while len(slots):
        place = array[slots]
        after = place + length
        inside = after < text_end[place]
        then = np.where(inside, rank[np.minimum(after, n - 1)], -1)
        order = np.lexsort((then, rank[place]))
        place, then = place[order], then[order]
        head = rank[place]
        new = np.concatenate(([True], (head[1:] != head[:-1]) | (then[1:] != then[:-1])))
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(place)))
        array[slots] = place
        rank[place] = np.repeat(slots[first], size)
        again = np.repeat(size > 1, size)
        length *= 2
        place, width = place[again], np.repeat(size, size)[again]
        slots = slots[again]
        if pairs is None:
            pairs = slots
        block = (place - text_start[place]) % length == 0
        low = rank[place[block]]
        questions.append((place[block], np.full(len(low), length), low, low + width[block]))
    if not questions:
        none = np.empty(0, dtype=np.int64)
        return array, none, (none,) * 4
    return array, pairs, tuple(np.concatenate(q) for q in zip(*questions))


def candidate_periods(symbol: np.ndarray, text_start: np.ndarray, text_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(left place, distance) of blocks and their next occurrence in a neighbouring window of their length."""
    array, pairs, (place, length, low, high) = suffix_blocks(symbol, text_start, text_end)
    if len(place) == 0:
        return place, place
    tree = WaveletTree(array[pairs])
    left, right = tree.around(np.searchsorted(pairs, low), np.searchsorted(pairs, high), place)
    a = (left >= 0) & (place - left <= length)
    b = (right >= 0) & (right - place <= length)
    return np.concatenate((left[a], place[b])), np.concatenate(((place - left)[a], (right - place)[b]))


def stretch(word: np.ndarray, low: int, high: int, at: int, period: int) -> tuple[int, int]:
    """The longest stretch around at : at + period within low : high in which words ``period`` apart agree."""
    end, step = at + period, 64
    while end < high:
        m = min(step, high - end)
        other = np.flatnonzero(word[end : end + m] != word[end - period : end - period + m])
        if len(other):
            end += int(other[0])
            break
        end, step = end + m, step * 2
    start, step = at, 64
    while start > low:
        m = min(step, start - low)
        other = np.flatnonzero(word[start - m : start] != word[start - m + period : start + period])
        if len(other):
            start += int(other[-1]) + 1 - m
            break
        start, step = start - m, step * 2
    return start, end


def prime_factors(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + ([n] if n > 1 else [])


def find_runs(symbol: np.ndarray, first: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Per text, its runs (start, length, period) by start, then period. ``first`` bounds the texts' words."""
    count = np.diff(first)
    text = np.repeat(np.arange(len(count)), count)
    at, period = candidate_periods(symbol, first[:-1][text], first[1:][text])
    found: list[set] = [set() for _ in count]
    order = np.lexsort((at, period, text[at]))
    last = (-1, 0, 0)  # period, start and end of the stretch before
    for s, q, t in zip(at[order].tolist(), period[order].tolist(), text[at[order]].tolist()):
        if last[0] == q and last[1] <= s and s + q <= last[2]:
            continue
        low, high = int(first[t]), int(first[t + 1])
        start, end = stretch(symbol, low, high, s, q)
        last = (q, start, end)
        if end - start < max(LEAST, TIMES * q):
            continue
        parts = (q // p for p in prime_factors(q))
        if any((symbol[start : start + q] == symbol[start + d : start + d + q]).all() for d in parts):
            continue
        found[t].add((start - low, end - start, q))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in found]


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Marks of the words that no run repeats."""
    kept = np.ones(n, dtype=bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return kept


def _run_batches(batches):
    for batch in A.slices(batches):
        data, ends = A.texts(batch.column("text"))
        words = A.Words(data, ends, NOT_WORD)
        salt = A.mix(np.arange(1, batch.num_rows + 1, dtype=np.uint64))
        runs = find_runs(A.mix(words.hash ^ salt[words.doc]), words.first)
        raw, collapsed = data.tobytes(), []
        for own, low, high in zip(runs, ends[:-1].tolist(), ends[1:].tolist()):
            text = raw[low:high].split()  # the same white space as NOT_WORD
            if own:
                text = [text[k] for k in np.flatnonzero(kept_words(len(text), own)).tolist()]
            collapsed.append(b" ".join(text))
        cuts = np.cumsum([0, *(len(r) for r in runs)])
        flat = np.array([x for r in runs for x in r], dtype=np.int64).reshape(-1, 3)
        items = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), items),
                pa.array(collapsed, pa.binary()).cast(pa.string()),
            ],
            ["doc_id", "runs", "collapsed"],
        )


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, runs, collapsed): a text's runs by start, then period, and its words less those that repeat a run's first ones."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_run_batches, FOUND)


def looped(docs: DataFrame) -> DataFrame:
    """(doc_id, text): one text in ten, by the checksum of its id, goes round in a loop from some word on."""
    check = F.crc32(F.col("doc_id").cast("string"))
    hit = docs.select(
        F.col("doc_id").cast("long"), "text", (check % 10 == 0).alias("hit"), F.floor(check / 10).cast("long").alias("g")
    )
    w = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    hit = hit.withColumn("w", F.when(F.col("hit"), w)).withColumn("n", F.size("w"))
    hit = hit.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    hit = hit.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    turned = F.expr("transform(sequence(0, n - 1), i -> w[cast(CASE WHEN i < a THEN i ELSE a + (i - a) % p END AS INT)])")
    return hit.select("doc_id", F.when(F.col("n") > 0, F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """Counts, longest run and digests of the rows of ``periodic_runs``."""
    longest = F.expr("array_max(transform(runs, r -> struct(r.length AS a, -r.start AS b, -r.period AS c, r AS r))).r")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    out = found.withColumn("top", longest)
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.start").alias("start"),
        F.col("top.length").alias("length"),
        F.col("top.period").alias("period"),
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
