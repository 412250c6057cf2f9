"""Near-duplicate documents by HyperMinHash.

A document's set holds its distinct shingles of five words. Each of ``BUCKETS`` hash functions keeps, in its bucket, the
smallest hash of the set as a register of 16 bits: the count of leading zeros (6 bits) and the ten bits after the first
one. Registers are banded, bands meet in an equi-join, the estimated similarity (corrected for registers that agree by
chance) prunes pairs far below the limit, and every remaining link is confirmed on the full sets.

Whole groups are never paired with themselves. Equal sets are one node from the start. In each band bucket all nodes are
first compared with one leader; the links found merge components. Only buckets that still hold several components
compare nodes across those components, in blocks of bounded size. Every pair that shares a bucket is thus either
compared or already connected. At similarity 0.85 a pair shares no bucket with probability 2e-8, at 0.80 with 3e-6.
The limit is a parameter: (85, 100) unless the caller gives another.

Defined results: null and empty texts (and texts without words) have an empty set and link with nothing. Rows with a
null ``doc_id`` keep a row with their count, are linked with nothing and kept, with a null component. Rows that repeat
a ``doc_id`` are one document. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkplume.llm import arrays as A
from sparkplume.llm.graph import components
from sparkplume.session import materialize

SHINGLE = 5
BUCKETS = 96
BAND_ROWS = 4
MANTISSA_BITS = 10
LIMIT = (85, 100)  # link when limit[1] * intersection >= limit[0] * union
MARGIN = 0.25  # pairs are pruned this far below the limit: six standard errors of the estimate at 0.8 and above
BLOCK = 128  # nodes of a bucket that meet in one block

NOT_WORD = np.ones(256, dtype=bool)
NOT_WORD[[0x20, *range(0x09, 0x0E)]] = False

_rng = np.random.RandomState(71)
MULTIPLY = _rng.randint(0, 1 << 62, BUCKETS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.randint(0, 1 << 62, BUCKETS, dtype=np.int64).astype(np.uint64)

SKETCHES = "doc_id long, n_shingles long, digest binary, sketch binary"
SETS = "digest binary, shingles binary"


def shingle_sets(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Per row, the sorted distinct 64-bit shingle hashes."""
    data, ends = A.texts(batch.column("text"))
    words = A.Words(A.LOWER[data], ends, NOT_WORD)
    h, first = words.hash, words.first
    full = np.zeros(max(len(h) - SHINGLE + 1, 0), dtype=np.uint64)
    for k in range(SHINGLE):
        full += h[k : k + len(full)] * A.ORDER_VALUE[k]
    full = A.mix(full)
    sets = []
    for low, high in zip(first[:-1], first[1:]):
        if high - low >= SHINGLE:
            sets.append(np.unique(full[low : high - SHINGLE + 1]))
        elif high > low:
            few = (h[low:high] * A.ORDER_VALUE[: high - low]).sum(dtype=np.uint64) + np.uint64(high - low)
            sets.append(A.mix(np.array([few], dtype=np.uint64)))
        else:
            sets.append(np.empty(0, dtype=np.uint64))
    return sets


def registers(lowest: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa bits of each bucket's smallest hash."""
    top = (lowest >> np.uint64(11)).astype(np.float64)  # 53 bits, exact
    fraction, exponent = np.frexp(np.maximum(top, 1.0))
    zeros = 53 - exponent
    mantissa = ((fraction * 2 - 1) * (1 << MANTISSA_BITS)).astype(np.int64)
    return ((zeros << MANTISSA_BITS) | mantissa).astype(np.uint16)


def sketch_of(hashes: np.ndarray) -> np.ndarray:
    """Registers of a set; a long set goes through in pieces, since a minimum can be taken piece by piece."""
    lowest = np.full(BUCKETS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 1024):
        part = hashes[None, at : at + 1024] * MULTIPLY[:, None] + ADD[:, None]
        np.minimum(lowest, part.min(axis=1), out=lowest)
    return registers(lowest)


def set_digest(hashes: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    a = (hashes * A.ORDER_VALUE[20]).sum(dtype=np.uint64)
    b = A.mix(hashes ^ A.ORDER_VALUE[21]).sum(dtype=np.uint64)
    return np.array([a, b], dtype=np.uint64).tobytes()


def _sketch_batches(batches):
    for batch in A.slices(batches):
        sets = shingle_sets(batch)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([set_digest(s) for s in sets], pa.binary()),
                pa.array([sketch_of(s).tobytes() if len(s) else None for s in sets], pa.binary()),
            ],
            ["doc_id", "n_shingles", "digest", "sketch"],
        )


def _set_batches(batches):
    for batch in A.slices(batches):
        sets = shingle_sets(batch)
        yield pa.RecordBatch.from_arrays(
            [pa.array([set_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
            ["digest", "shingles"],
        )


def estimated(one: np.ndarray, other: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimate of registers (rows), less the agreement that chance gives sets of n and m shingles."""
    ratio = np.maximum(n, m) / np.maximum(np.minimum(n, m), 1)
    chance = 0.169919487159739 * 2.0**-MANTISSA_BITS * 4 * ratio / (1 + ratio) ** 2
    share = (one == other).mean(axis=1)
    return np.maximum(share - chance, 0) / (1 - chance)


def _stack(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, BUCKETS)


def prune_below(limit: tuple[int, int]) -> float:
    """The estimate below which a pair is left out."""
    return limit[0] / limit[1] - MARGIN


def _estimate_batches(limit: tuple[int, int]):
    def run(batches):
        for batch in batches:
            n, m = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "m"))
            near = estimated(_stack(batch.column("s")), _stack(batch.column("t")), n, m) >= prune_below(limit)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(near)) for c in ("a", "b")], ["a", "b"])

    return run


def linked(one: np.ndarray, other: np.ndarray, limit: tuple[int, int] = LIMIT) -> bool:
    """The limit, on full sets of distinct hashes."""
    both = len(np.intersect1d(one, other, assume_unique=True))
    return limit[1] * both >= limit[0] * (len(one) + len(other) - both)


def _confirm_batches(limit: tuple[int, int]):
    def run(batches):
        for batch in batches:
            both = zip(batch.column("x"), batch.column("y"))
            keep = [linked(*(np.frombuffer(v.as_py(), dtype=np.uint64) for v in pair), limit) for pair in both]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], ["a", "b"]
            )

    return run


def _block_batches(limit: tuple[int, int]):
    """Links between different components, of one block of a bucket's nodes with itself or another.

    A pair is compared in the first band it shares only. Pairs that the registers put far below the limit are left out;
    the full sets of the others are compared here.
    """

    def run(batches):
        for batch in batches:
            for b, i, j, members in zip(*(batch.column(c).to_pylist() for c in ("band", "i", "j", "members"))):
                ids = np.array([x["id"] for x in members], dtype=np.int64)
                part = np.array([x["part"] for x in members])
                comp = np.array([x["component"] for x in members], dtype=np.int64)
                size = np.array([x["n"] for x in members])
                sketch = np.frombuffer(b"".join(x["sketch"] for x in members), dtype=np.uint16).reshape(-1, BUCKETS)
                sets = [np.frombuffer(x["shingles"], dtype=np.uint64) for x in members]
                left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
                found = []
                for x in left:
                    y = right[(comp[right] != comp[x]) & ((ids[right] > ids[x]) if i == j else True)]
                    y = y[limit[1] * np.minimum(size[y], size[x]) >= limit[0] * np.maximum(size[y], size[x])]
                    y = y[estimated(sketch[y], sketch[x], size[y], size[x]) >= prune_below(limit)]
                    agree = (sketch[y] == sketch[x]).reshape(len(y), BUCKETS // BAND_ROWS, BAND_ROWS).all(axis=2)
                    y = y[agree.argmax(axis=1) == b] if len(y) else y
                    found += [(min(ids[x], ids[k]), max(ids[x], ids[k])) for k in y if linked(sets[x], sets[k], limit)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(p[k]) for p in found], pa.int64()) for k in (0, 1)], ["a", "b"]
                )

    return run


def _sets(docs: DataFrame, nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, shingles) of the given node ids, from the texts."""
    wanted = nodes.join(ids, "id").select(F.col("id").alias("doc_id"), F.col("digest").alias("d"))
    texts = docs.select("doc_id", "text").join(wanted, "doc_id")
    sets = texts.select("text").mapInArrow(_set_batches, SETS).dropDuplicates(["digest"])
    named = wanted.select(F.col("doc_id").alias("id"), F.col("d").alias("digest"))
    return materialize(sets.join(named, "digest").select("id", "shingles"), "sets")


def _confirmed(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, limit: tuple[int, int]) -> DataFrame:
    """Pairs of node ids whose full sets meet the limit."""
    sets = _sets(docs, nodes, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    held = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    held = held.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    return held.select("a", "b", "x", "y").mapInArrow(_confirm_batches(limit), "a long, b long")


def near_duplicates(docs: DataFrame, limit: tuple[int, int] = LIMIT) -> DataFrame:
    """``documents`` to (doc_id, n_shingles, component_id, kept)."""
    rows = materialize(docs.select("doc_id", "text").mapInArrow(_sketch_batches, SKETCHES), "sketches")
    usable = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    nodes = materialize(
        usable.groupBy("digest").agg(
            F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")
        ),
        "nodes",
    )
    bands = BUCKETS // BAND_ROWS
    width = 2 * BAND_ROWS
    keys = F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda i: F.xxhash64(i, F.substring(F.col("sketch"), i * width + 1, F.lit(width))),
    )
    banded = nodes.select("id", F.posexplode(keys).alias("band", "key"))
    crowd = banded.groupBy("band", "key").agg(F.min("id").alias("leader"), F.count("*").alias("size")).where("size > 1")
    shared = materialize(banded.join(crowd, ["band", "key"]), "buckets")

    def looks_alike(pairs: DataFrame) -> DataFrame:
        one = nodes.select(F.col("id").alias("a"), F.col("n"), F.col("sketch").alias("s"))
        other = nodes.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("t"))
        both = pairs.join(other, "b").join(one, "a")
        return both.select("a", "b", "n", "m", "s", "t").mapInArrow(_estimate_batches(limit), "a long, b long")

    led = shared.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    links = materialize(_confirmed(docs, nodes, materialize(looks_alike(led), "pairs"), limit), "links")

    # buckets that still hold several components, other than those whose only pair has been tried
    found = components(links)
    many = shared.where("size > 2").join(found, "id", "left")
    many = materialize(many.select("band", "key", "id", F.coalesce("component", "id").alias("component")), "open")
    mixed = many.groupBy("band", "key").agg(
        F.min("component").alias("c"), F.max("component").alias("d"), F.count("*").alias("size")
    )
    mixed = mixed.where("c <> d").select("band", "key", F.ceil(F.col("size") / BLOCK).cast("int").alias("parts"))
    placed = materialize(many.join(mixed, ["band", "key"]), "mixed")
    sets = _sets(docs, nodes, placed.select("id").distinct())
    placed = placed.join(nodes.select("id", "n", "sketch").join(sets, "id"), "id")
    placed = placed.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    meet = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q"))
    meet = meet.select("*", F.least("part", "q").alias("i"), F.greatest("part", "q").alias("j"))
    blocks = meet.groupBy("band", "key", "i", "j").agg(
        F.collect_list(F.struct("id", "part", "component", "n", "sketch", "shingles")).alias("members")
    )
    more = blocks.select("band", "i", "j", "members").mapInArrow(_block_batches(limit), "a long, b long")
    links = materialize(links.union(more), "links")

    found = components(links)
    named = nodes.select("digest", "id").join(found, "id", "left")
    named = named.select("digest", F.coalesce("component", "id").alias("component"))
    out = rows.select("doc_id", "n_shingles", F.when(F.expr("doc_id IS NOT NULL AND n_shingles > 0"), F.col("digest")).alias("digest"))
    out = out.join(named, "digest", "left")
    component = F.coalesce("component", "doc_id")
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.expr("doc_id <=> coalesce(component, doc_id)").alias("kept")
    )


def deduplicated(docs: DataFrame, limit: tuple[int, int] = LIMIT) -> DataFrame:
    """Whole rows of one document of each group, in the given columns; of rows that repeat an id one stays."""
    own = "kept_id"
    while own in docs.columns:
        own += "_"
    found = near_duplicates(docs, limit).where("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("times"))
    found = materialize(found.withColumnRenamed("doc_id", own), "kept")
    same = docs["doc_id"] == found[own]
    once = docs.join(found.where("times = 1"), same, "left_semi")
    again = docs.join(found.where("times > 1"), same, "left_semi").dropDuplicates(["doc_id"])
    return once.unionByName(again).unionByName(docs.where("doc_id IS NULL"))
