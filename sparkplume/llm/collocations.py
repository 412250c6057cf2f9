"""Collocated phrases of two to four words by SON partitioning.

The documents are dealt into ``SHARDS`` shards by content. A phrase that occurs ``min_count`` times in all occurs at
least ceil(min_count / SHARDS) times in one of them, so every shard is mined completely at that lowered support. What is
frequent in some shard is united in a table of bits, and only phrases whose bit is set are counted, over all texts and by
their strings. A shard is mined by many tasks: each adds up its own phrases first and sends, per range of hashes, packed
keys of 32 bits, shard and count. Two keys that agree by chance only let a candidate more through. Longer phrases are
mined only where all pairs of neighbouring words inside them passed (both within the same shards).

The table has ``TABLE_BITS`` address bits (8 MB) whatever the input: when it fills up, more candidates are counted, none
is lost. The number of ranges follows the bytes of the input, so that a range fits in a task.

Defined results: null texts are empty, a null language is ``und``. Rows count as often as they occur, whatever their id,
which is not used. Phrases never cross a piece or a row. Texts of any length count whole. No rows give no phrases.
Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkplume.llm import arrays as A
from sparkplume.session import materialize

LONGEST = 4
MIN_COUNT = 30
TOP = 2000
SHARDS = 4
TABLE_BITS = 26
RANGE_BYTES = 8 << 20  # text whose phrases make one range of hashes
HOLD_WORDS = 2_000_000  # words whose phrases a task adds up before it sends them
BREAKS = [ord(c) for c in ".,;:!?\n\x0b\x0c\r"]
SCALE = 2_000_000
COVERED = 80  # percent of a phrase's count that a longer one must reach to drop it

BREAK = np.zeros(256, dtype=bool)
BREAK[BREAKS] = True
IN_WORD = ~BREAK
IN_WORD[[0x20, 0x09]] = False

PACKED = "range long, keys binary, shards binary, counts binary"
BITS = "range long, bits binary"
COUNTS = "lang string, phrase string, words int, f long"


def local_support(min_count: int, shards: int = SHARDS) -> int:
    """The least count in some shard of a phrase that has ``min_count`` in all of them together."""
    return -(-min_count // shards)


class Phrases:
    """Words of a slice with hashes that know their language; ``piece`` grows wherever a phrase may not cross."""

    def __init__(self, batch: pa.RecordBatch):
        data, ends = A.texts(batch.column("text"))
        self.data = A.LOWER[data]
        self.words = w = A.Words(self.data, ends, IN_WORD)
        self.lang = [x if x is not None else "und" for x in batch.column("lang").to_pylist()]
        salt = np.array([xxhash.xxh64_intdigest(x.encode()) for x in self.lang], dtype=np.uint64)
        self.hash = A.mix(w.hash ^ salt[w.doc])
        self.piece = np.cumsum(BREAK[self.data])[w.start] + w.doc
        total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(w.hash, dtype=np.uint64)))
        self.shard = A.mix(total[w.first[1:]] - total[w.first[:-1]]) % np.uint64(SHARDS)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of all phrases of n words."""
        size = max(len(self.hash) - n + 1, 0)
        at = np.flatnonzero(self.piece[:size] == self.piece[n - 1 : n - 1 + size])
        h = np.full(len(at), np.uint64(n))
        for k in range(n):
            h += self.hash[at + k] * A.ORDER_VALUE[k]
        return at, A.mix(h)


def in_table(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = h >> np.uint64(64 - TABLE_BITS)
    return (table[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def pairs_in_table(phrases: Phrases, table: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of n words all of whose neighbouring words make a pair of the table."""
    at, h = phrases.of(2)
    good = np.zeros(len(phrases.hash) + n, dtype=bool)
    good[at[in_table(table, h)]] = True
    at, h = phrases.of(n)
    keep = np.logical_and.reduce([good[at + k] for k in range(n - 1)])
    return at[keep], h[keep]


def _send(held: list[np.ndarray], range_bits: int, most: int):
    """Sums of (hash, shard), packed by range of hashes; counts beyond ``most`` say nothing more."""
    keys = np.sort(np.concatenate(held))
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))[: len(keys)]
    count = np.minimum(np.diff(np.append(first, len(keys))), most).astype(np.uint8)
    keys = keys[first]
    ranges = (keys >> np.uint64(63)) >> np.uint64(1) if range_bits == 0 else keys >> np.uint64(64 - range_bits)
    key = ((keys << np.uint64(range_bits)) >> np.uint64(32)).astype(np.uint32)
    shard = (keys & np.uint64(7)).astype(np.uint8)
    cut = np.append(np.flatnonzero(np.concatenate(([True], ranges[1:] != ranges[:-1])))[: len(keys)], len(keys))
    yield pa.RecordBatch.from_arrays(
        [pa.array(ranges[cut[:-1]].astype(np.int64)), *(A.binary_column(x, cut) for x in (key, shard, count))],
        ["range", "keys", "shards", "counts"],
    )


def _local_batches(lengths: tuple[int, ...], table, range_bits: int, support: int):
    def run(batches):
        held, size = [], 0
        for batch in A.slices(batches):
            p = Phrases(batch)
            shard = p.shard[p.words.doc]
            for n in lengths:
                at, h = p.of(n) if table is None else pairs_in_table(p, table.value, n)
                held.append((h & ~np.uint64(7)) | shard[at])
                size += len(h)
            if size > HOLD_WORDS:
                yield from _send(held, range_bits, support)
                held, size = [], 0
        if size:
            yield from _send(held, range_bits, support)

    return run


def _frequent_bits(range_bits: int, support: int):
    """Bits of one range of hashes whose key reaches the support within a shard."""

    def run(group: pa.Table) -> pa.Table:
        name = group.column("range")[0].as_py()
        load = lambda c, t: np.frombuffer(b"".join(group.column(c).to_pylist()), dtype=t)
        key = (load("keys", np.uint32).astype(np.uint64) << np.uint64(3)) | load("shards", np.uint8)
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        total = np.add.reduceat(load("counts", np.uint8)[order].astype(np.int64), first)
        frequent = (key[first][total >= support] >> np.uint64(3)).astype(np.int64)
        bits = np.zeros(max(1 << (TABLE_BITS - range_bits), 8), dtype=np.uint8)
        bits[frequent >> (32 - TABLE_BITS + range_bits)] = 1
        packed = np.packbits(bits, bitorder="little").tobytes()
        return pa.table({"range": pa.array([name], pa.int64()), "bits": pa.array([packed], pa.binary())})

    return run


def _frequent_somewhere(texts: DataFrame, lengths: tuple[int, ...], table, range_bits: int, min_count: int) -> np.ndarray:
    """The table of phrases that are frequent in some shard. Its size is fixed."""
    support = local_support(min_count)
    sent = texts.mapInArrow(_local_batches(lengths, table, range_bits, support), PACKED)
    found = sent.groupBy("range").applyInArrow(_frequent_bits(range_bits, support), BITS)
    out = np.zeros(1 << (TABLE_BITS - 3), dtype=np.uint8)
    width = len(out) >> range_bits
    for row in found.toLocalIterator():
        piece = np.frombuffer(row.bits, dtype=np.uint8)[:width]
        out[row.range * width : row.range * width + len(piece)] |= piece
    return out


class Candidates:
    """What the count needs of a slice: its bytes, its words' places, and per length the phrases that may be frequent."""

    def __init__(self, batch: pa.RecordBatch, table: np.ndarray):
        p = Phrases(batch)
        self.raw, self.lang = p.data.tobytes(), p.lang
        self.start, self.end = p.words.start.astype(np.int32), p.words.end.astype(np.int32)
        self.doc, self.size = p.words.doc.astype(np.int32), np.diff(p.words.first)
        # a phrase with a rare phrase inside is rare itself
        good, self.of = np.ones(len(p.hash) + 1, dtype=bool), []
        for n in range(1, LONGEST + 1):
            at, h = p.of(n)
            keep = in_table(table, h) & good[at] & good[at + (n > 1)]
            at, h = at[keep], h[keep]
            self.of.append((at.astype(np.int32), h))
            good = np.zeros(len(good), dtype=bool)
            good[at] = True

    def name(self, at: int, n: int) -> bytes:
        return b" ".join([self.raw[self.start[j] : self.end[j]] for j in range(at, at + n)])


def _counted(held: list[Candidates]):
    """Counts under strings, of all that is held."""

    def batch(langs, names, n, count):
        names = pa.array(names, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), names, pa.array(np.full(len(names), n), pa.int32()), pa.array(count, pa.int64())],
            ["lang", "phrase", "words", "f"],
        )

    for n in range(1, LONGEST + 1):
        at, h = (np.concatenate([c.of[n - 1][k] for c in held]) for k in (0, 1))
        part = np.repeat(np.arange(len(held)), [len(c.of[n - 1][0]) for c in held])
        _, seen, count = np.unique(h, return_index=True, return_counts=True)
        for low in range(0, len(seen), 1 << 16):
            some = seen[low : low + (1 << 16)]
            places = list(zip(part[some].tolist(), at[some].tolist()))
            langs = [held[k].lang[held[k].doc[i]] for k, i in places]
            yield batch(langs, [held[k].name(i, n) for k, i in places], n, count[low : low + (1 << 16)])
    total: dict[str, int] = {}
    for c in held:
        for lang, size in zip(c.lang, c.size.tolist()):
            total[lang] = total.get(lang, 0) + size
    yield batch(list(total), [b""] * len(total), 0, np.array(list(total.values()), dtype=np.int64))


def _count_batches(table):
    """Counts of a task's candidates under their strings; the words of a language under ``words`` = 0."""

    def run(batches):
        held, size = [], 0
        for batch in A.slices(batches):
            held.append(Candidates(batch, table.value))
            size += len(held[-1].start)
            if size > HOLD_WORDS:
                yield from _counted(held)
                held, size = [], 0
        if held:
            yield from _counted(held)

    return run


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(lang, phrase, words, f): phrases of up to four words that occur at least ``min_count`` times, with exact counts.

    A row with ``words`` = 0 and an empty phrase carries the number of words of the language.
    """
    texts = docs.select("text", "lang")
    spark = docs.sparkSession
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    range_bits = min(max(int(size // RANGE_BYTES).bit_length(), 0), TABLE_BITS - 3)
    short = _frequent_somewhere(texts, (1, 2), None, range_bits, min_count)
    table = spark.sparkContext.broadcast(short)
    long = _frequent_somewhere(texts, (3, 4), table, range_bits, min_count)
    both = spark.sparkContext.broadcast(short | long)
    counted = texts.mapInArrow(_count_batches(both), COUNTS).groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))
    counted = materialize(counted.where((F.col("words") == 0) | (F.col("f") >= min_count)), "phrases")
    table.unpersist()
    both.unpersist()
    return counted


def _part(first, size):
    return F.array_join(F.slice("w", first, size), " ")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each language: (lang, rank, phrase, a, l, r, n, score).

    A phrase's score is that of its weakest cut. A phrase inside a longer one that occurs nearly as often is dropped.
    """
    counted = phrase_counts(docs, min_count)
    parts = counted.where("words > 0 AND words < 4").select("lang", "phrase", "f")
    phrases = counted.where("words > 1").withColumn("w", F.split("phrase", " "))
    cuts = phrases.select("lang", "phrase", "words", "w", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("one"), _part(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("one"), F.col("f").alias("l")), ["lang", "one"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    # decimals: the product may pass 64 bits
    score = F.expr(f"(CAST(a AS DECIMAL(20, 0)) * {SCALE}) DIV (CAST(l AS DECIMAL(20, 0)) + r)")
    cuts = cuts.withColumn("score", score.cast("long"))
    weakest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inside = phrases.where("words > 2").select("lang", "words", "w", F.col("f").alias("longer"), F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inside = inside.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    inside = inside.groupBy("lang", _part(F.col("at"), F.col("size")).alias("phrase")).agg(F.max("longer").alias("longer"))
    kept = weakest.join(inside, ["lang", "phrase"], "left").where(f"longer IS NULL OR 100 * longer < {COVERED} * a")

    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    kept = kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    ranked = kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    sizes = counted.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations_sql(min_count: int = MIN_COUNT, top: int = TOP) -> str:
    """The same in DuckDB SQL, by counting every phrase."""
    return f"""
WITH texts AS (
  SELECT row_number() OVER () AS row_no, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM texts)),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
counts AS (
  SELECT lang, array_to_string(list_slice(w, i, i + s - 1), ' ') AS phrase, s AS words, count(*) AS f
  FROM starts, range(1, 5) t(s) WHERE i + s - 1 <= len(w) GROUP BY ALL HAVING count(*) >= {min_count}),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
cuts AS (
  SELECT lang, phrase, f AS a, k, string_split(phrase, ' ') AS v
  FROM counts, range(1, 4) t(k) WHERE words > 1 AND k < words),
scored AS (
  SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r,
    (c.a::HUGEINT * {SCALE} // (x.f::HUGEINT + y.f))::BIGINT AS score
  FROM cuts c
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(list_slice(v, 1, k), ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(list_slice(v, k + 1, len(v)), ' ')),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(list_slice(v, i, i + s - 1), ' ') AS phrase, max(f) AS longer
  FROM (SELECT lang, f, words, string_split(phrase, ' ') AS v FROM counts WHERE words > 2), range(2, 4) t(s), range(1, 4) u(i)
  WHERE s < words AND i + s - 1 <= words GROUP BY ALL),
kept AS (
  SELECT w.* FROM weakest w LEFT JOIN inside USING (lang, phrase)
  WHERE longer IS NULL OR 100 * longer < {COVERED} * a)
SELECT * FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
  FROM kept JOIN sizes USING (lang))
WHERE rank <= {top}"""
