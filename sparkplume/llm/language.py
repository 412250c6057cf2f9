"""Language identification by rank-order profiles.

A language's profile is the list of its ``PROFILE`` most frequent n-grams (one to three characters, words marked by a
boundary on each side) over all its training texts. A document's own most frequent n-grams are compared with it by the
out-of-place distance: how far each stands from its place in the profile, or ``PROFILE`` when it is not in it. The
language of least distance wins; the score is the share of the largest possible distance that is left.

Training counts are combined in each task and then summed by Spark, so every training text counts in full; the driver
sees PROFILE n-grams per language and nothing else.

Defined results: a text that is null or has no letter is ``und`` with score 0; so is everything when nothing could be
learned. Training rows need a language and an id (the id decides which rows are held out). Ties go to the language that
sorts first, among n-grams to the smaller code. Every input row gives a row; other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sparkplume.llm import arrays as A

PROFILE = 400
BOUNDARY = 1
SHIFT = np.uint64(21)  # bits of a character

COUNTS = "lang string, gram long, n long"
PREDICTED = "doc_id long, lang_pred string, score double"


@functools.lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """The lower-case letter of each code point, BOUNDARY where it is no letter."""
    table = np.full(0x110000, BOUNDARY, dtype=np.uint64)
    for code in range(0x110000):
        if chr(code).isalpha():
            low = chr(code).lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def grams(column: pa.Array) -> list[np.ndarray]:
    """All n-grams of each text as numbers."""
    data, ends = A.texts(column)
    head = (data & 0xC0) != 0x80  # first byte of a character
    limit = np.concatenate(([0], np.cumsum(head)))[ends]
    char = letters()[np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)]
    out = []
    for low, high in zip(limit[:-1], limit[1:]):
        c = np.concatenate(([BOUNDARY], char[low:high], [BOUNDARY])).astype(np.uint64)
        c = c[np.concatenate(([True], (c[1:] != BOUNDARY) | (c[:-1] != BOUNDARY)))]
        if len(c) < 3:
            out.append(np.empty(0, dtype=np.int64))
            continue
        two = (c[:-1] << SHIFT) | c[1:]
        three = ((two[:-1] << SHIFT) | c[2:])[c[1:-1] != BOUNDARY]
        out.append(np.concatenate((c[c != BOUNDARY], two, three)).astype(np.int64))
    return out


def _count_batches(batches):
    for batch in A.slices(batches):
        lang = np.array(batch.column("lang").to_pylist(), dtype=object)
        every = grams(batch.column("text"))
        for name in sorted(set(lang)):
            found, n = np.unique(np.concatenate([g for g, x in zip(every, lang) if x == name]), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(found), pa.string()), pa.array(found), pa.array(n)], ["lang", "gram", "n"]
            )


def profiles(training: DataFrame) -> DataFrame:
    """(lang, gram, n, place) of each language's PROFILE most frequent n-grams, place from 0."""
    usable = training.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    total = usable.mapInArrow(_count_batches, COUNTS).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked = total.withColumn("place", F.row_number().over(order) - 1)
    return ranked.where(F.col("place") < PROFILE)


class Ranks:
    """Profiles as one table: for each n-gram its place in every language, PROFILE if absent."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.langs = sorted({r[0] for r in rows})
        column = {x: k for k, x in enumerate(self.langs)}
        self.gram = np.unique(np.array([r[1] for r in rows], dtype=np.int64))
        self.place = np.full((len(self.gram) + 1, len(self.langs)), PROFILE)
        for lang, gram, place in rows:
            self.place[np.searchsorted(self.gram, gram), column[lang]] = place

    def best(self, found: np.ndarray) -> tuple[str, float]:
        if len(found) == 0 or not self.langs:
            return "und", 0.0
        own, n = np.unique(found, return_counts=True)
        top = own[np.argsort(-n, kind="stable")[:PROFILE]]
        at = np.searchsorted(self.gram, top)
        at[(at == len(self.gram)) | (self.gram[np.minimum(at, len(self.gram) - 1)] != top)] = len(self.gram)
        place = self.place[at]
        away = np.where(place == PROFILE, PROFILE, np.abs(place - np.arange(len(top))[:, None])).sum(axis=0)
        k = int(away.argmin())
        return self.langs[k], 1.0 - float(away[k]) / (PROFILE * len(top))


def identify(docs: DataFrame, learned: DataFrame) -> DataFrame:
    """(doc_id, lang_pred, score) of every text by the given profiles."""
    ranks = Ranks([(r[0], r[1], r[2]) for r in learned.select("lang", "gram", "place").collect()])
    held = docs.sparkSession.sparkContext.broadcast(ranks)  # PROFILE rows per language

    def run(batches):
        for batch in A.slices(batches):
            found = [held.value.best(g) for g in grams(batch.column("text"))]
            lang, score = zip(*found)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, PREDICTED)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether an id falls in the fold that is kept from training; a null id does not."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == fold, F.lit(False))


def predict_languages(docs: DataFrame, folds: int = 3, fold: int = 1) -> DataFrame:
    """Learn from the rows outside the fold and predict all: (doc_id, held_out, lang_pred, score)."""
    training = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
    out = identify(docs, profiles(training))
    return out.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "lang_pred", "score")
