"""Near-duplicate documents by SimHash fingerprints that meet at anchor points of a covering code.

A fingerprint has 64 bits. Two that differ in at most four bits differ in at most two of the 31 low bits or in at most one of
the 33 high bits. Each part has a code as its anchors: the Hamming code of 31 bits, and that code beside two free bits. Every
point lies within one bit (the covering radius) of exactly one anchor, its own. A fingerprint goes to all anchors within
covering radius plus threshold of each part: 156 within three bits of the low part, 4 or 18 within two bits of the high
part. If two fingerprints link, one of them stands at the other's own anchor, and there they are compared on all 64 bits.

Only fingerprints at which another one owns an anchor go on. An anchor with many is compared in blocks of bounded size,
spread over tasks; a block puts out a forest of its links rather than all of them, and compares a fingerprint only with
those it does not hang together with yet. Equal fingerprints are one node from the start.

Defined results: null and empty texts, and texts without words, have fingerprint zero and link like any other. Rows with a
null ``doc_id`` have a fingerprint, no component, and link with nothing. Rows that repeat a ``doc_id`` are one document,
with all their fingerprints. Texts of any length count whole. Other columns are ignored. No rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkplume.llm import arrays as A
from sparkplume.llm.graph import components
from sparkplume.session import materialize

SHINGLE = 4
SEED = 42
THRESHOLD = 4  # differing bits of a link
CODE_BITS = 31
PARTS = ((0, 0, 2), (31, 2, 1))  # lowest bit, free bits beside the code, threshold of the part
RADIUS = 1  # of the code: every word of 31 bits is within one bit of one code word
BLOCK = 4096  # fingerprints of an anchor that meet in one block
SALTS = 16

ROWS = "doc_id long, fp long"
ANCHORS = "anchor long, fp long, own boolean"
CODE_MASK = np.uint64((1 << CODE_BITS) - 1)


def syndrome(word: np.ndarray) -> np.ndarray:
    """Of 31-bit words: zero for code words; else one more than the place of the bit that leads to the nearest one."""
    out = np.zeros(word.shape, dtype=np.uint64)
    for k in range(CODE_BITS):
        out ^= ((word >> np.uint64(k)) & np.uint64(1)) * np.uint64(k + 1)
    return out


def moves(reach: int) -> list[np.ndarray]:
    """Per syndrome, all changes of up to ``reach`` bits that lead to a code word, those of fewest bits first."""
    # place k has syndrome k + 1, so a change of bits i, j, ... has the exclusive or of their i + 1, j + 1, ...
    bits = [(0, 0)]
    out: list[list[int]] = [[] for _ in range(CODE_BITS + 1)]
    for size in range(reach + 1):
        for s, change in bits:
            out[s].append(change)
        bits = [(s ^ (k + 1), c | 1 << k) for s, c in bits for k in range(c.bit_length(), CODE_BITS)]
    return [np.array(x, dtype=np.uint64) for x in out]


def part_moves(free: int, threshold: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per syndrome: changes of a part (free bits above the code's) to all anchors in reach, and which is the own one."""
    reach = RADIUS + threshold
    weight = np.bitwise_count
    out = []
    for s, code in enumerate(moves(reach)):
        both = (code[:, None] | (np.arange(1 << free, dtype=np.uint64) << np.uint64(CODE_BITS))[None, :]).ravel()
        both = both[weight(both) <= reach]
        out.append((both, (both >> np.uint64(CODE_BITS) == 0) & (weight(both) <= min(s, RADIUS))))
    return out


MOVES = [part_moves(free, threshold) for _, free, threshold in PARTS]


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, own): all anchors in reach of each fingerprint; the part is the anchor's sign bit."""
    out = []
    for part, (low, free, _) in enumerate(PARTS):
        word = (fp >> np.uint64(low)) & np.uint64((1 << (CODE_BITS + free)) - 1)
        s = syndrome(word & CODE_MASK)
        for value in np.unique(s).tolist():
            rows = np.flatnonzero(s == value)
            change, own = MOVES[part][value]
            anchor = (word[rows, None] ^ change[None, :]) | np.uint64(part << 63)
            out.append((anchor.ravel(), np.repeat(rows, len(change)), np.tile(own, len(rows))))
    return tuple(np.concatenate(x) for x in zip(*out))


def fingerprint(text: bytes) -> int:
    """Of a lower-cased text."""
    words = text.split()  # white space is exactly the separators
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    reach = min(SHINGLE, len(words))
    stop = ends[reach - 1 :] - 1
    start = np.concatenate(([0], ends))[: len(stop)]
    digest = xxhash.xxh64_intdigest
    count, total = np.zeros(64, dtype=np.int64), len(stop)
    for at in range(0, total, 1 << 16):
        pairs = zip(start[at : at + (1 << 16)].tolist(), stop[at : at + (1 << 16)].tolist())
        h = np.array([digest(joined[a:b], SEED) for a, b in pairs], dtype=">u8")
        count += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > total).tobytes(), "big")


def _fingerprint_batches(batches):
    for batch in A.slices(batches):
        texts = pc.fill_null(batch.column("text"), "").cast(pa.binary()).to_pylist()
        fp = np.array([fingerprint(t.lower()) for t in texts], dtype=np.uint64)  # lower() of bytes is of A-Z alone
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])


def _anchor_batches(batches):
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for low in range(0, len(fp), 1024):
            some = fp[low : low + 1024]
            anchor, row, own = anchors(some)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(some[row].view(np.int64)), pa.array(own)], ["anchor", "fp", "own"]
            )


def _own_batches(batches):
    """Only each fingerprint's own anchors."""
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        own = []
        for part, (low, free, _) in enumerate(PARTS):
            word = (fp >> np.uint64(low)) & np.uint64((1 << (CODE_BITS + free)) - 1)
            s = syndrome(word & CODE_MASK)
            step = np.where(s > 0, np.uint64(1) << (np.maximum(s, np.uint64(1)) - np.uint64(1)), np.uint64(0))
            own.append((word ^ step) | np.uint64(part << 63))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64))], ["anchor"])


def near(one: np.ndarray, other) -> np.ndarray:
    return np.bitwise_count(one ^ other) <= THRESHOLD


def forest(owners: np.ndarray, members: np.ndarray) -> list[tuple[int, int]]:
    """Links of owners with members that join all that their links join; a pair is looked at only while still apart."""
    points, at = np.unique(np.concatenate((owners, members)), return_inverse=True)
    label = np.arange(len(points))
    mine = at[len(owners) :]
    out = []
    for o in at[: len(owners)].tolist():
        apart = mine[label[mine] != label[o]]
        hit = apart[near(points[apart], points[o])]
        if len(hit):
            old = np.unique(label[hit], return_index=True)
            out += [(o, int(hit[k])) for k in old[1]]
            label[np.isin(label, old[0])] = label[o]
    return [(int(points[a]), int(points[b])) for a, b in out]


def _link_batches(batches):
    """Links of a block. Small blocks of a batch are compared together."""
    for batch in batches:
        column = batch.column("members")
        cut = np.asarray(column.offsets)
        flat = column.values
        fp = flat.field("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        owner = flat.field("owner").to_numpy(zero_copy_only=False)
        size = np.diff(cut)
        small = size <= 64
        links = []
        block = np.repeat(np.arange(len(size)), size)
        first = cut[0]
        ask = np.flatnonzero(owner[first : cut[-1]] & small[block]) + first
        of = block[ask - first]
        for low in range(0, len(ask), 1 << 15):
            a, b = ask[low : low + (1 << 15)], of[low : low + (1 << 15)]
            left = np.repeat(a, size[b])
            right = A.runs(cut[b], size[b])
            good = ~owner[right] & (fp[left] != fp[right]) & near(fp[left], fp[right])
            links.append(np.stack((fp[left[good]], fp[right[good]])))
        for k in np.flatnonzero(~small).tolist():
            own, mine = owner[cut[k] : cut[k + 1]], fp[cut[k] : cut[k + 1]]
            links.append(np.array(forest(mine[own], mine[~own]), dtype=np.uint64).reshape(-1, 2).T)
        both = np.concatenate(links, axis=1) if links else np.empty((2, 0), dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).view(np.int64)) for x in both], ["a", "b"])


def linked_fingerprints(nodes: DataFrame) -> DataFrame:
    """(a, b): links among the distinct values of ``fp``, enough to join whatever all links join."""
    placed = nodes.select("fp").mapInArrow(_anchor_batches, ANCHORS)
    owned = nodes.select("fp").mapInArrow(_own_batches, "anchor long").distinct()
    met = materialize(placed.join(owned, "anchor", "left_semi"), "met")
    size = met.groupBy("anchor").agg(F.count("*").alias("size")).where("size > 1")
    met = met.join(size.select("anchor", F.ceil(F.col("size") / BLOCK).cast("int").alias("parts")), "anchor")
    met = met.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    owners = met.where("own").select("anchor", F.col("part").alias("i"), every.alias("j"), "fp", F.lit(True).alias("owner"))
    members = met.select("anchor", every.alias("i"), F.col("part").alias("j"), "fp", F.lit(False).alias("owner"))
    blocks = owners.union(members).groupBy("anchor", "i", "j").agg(F.collect_list(F.struct("fp", "owner")).alias("members"))
    return blocks.select("members").mapInArrow(_link_batches, "a long, b long").distinct()


def simhash_duplicates(docs: DataFrame) -> DataFrame:
    """``documents`` to (doc_id, fingerprint, component_id)."""
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprint_batches, ROWS)
    rows = materialize(rows, "fingerprints")
    known = rows.where("doc_id IS NOT NULL")
    nodes = known.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("times"))
    nodes = materialize(nodes, "nodes")
    links = linked_fingerprints(nodes)
    # several fingerprints of one document hang together
    several = known.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z")
    several = known.join(several, "doc_id").select("a", F.col("fp").alias("b")).where("a <> b")
    found = components(links.union(several)).select(F.col("id").alias("fp"), "component")
    named = nodes.join(found, "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    named = materialize(named.join(least, "root").select("fp", "id", "times", "component_id"), "named")

    # a fingerprint of one row is that row; the others are joined under salts, since one may hold many rows
    alone = named.where("times = 1").select(F.col("id").alias("doc_id"), "fp", "component_id")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    shared = named.where("times > 1").select("fp", "component_id", salts.alias("salt"))
    salted = known.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    shared = salted.join(shared, ["fp", "salt"]).select("doc_id", "fp", "component_id")
    nameless = rows.where("doc_id IS NULL").select("doc_id", "fp", F.lit(None).cast("long").alias("component_id"))
    out = alone.union(shared).union(nameless)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
