"""Repeated passages by the common-prefix interval tree of enhanced suffix arrays, sharded by content.

Every window of ``LENGTH`` bytes is assigned to an anchor, the k-gram of smallest hash inside it; equal windows have equal
anchors. Anchors that occur in two different texts are found first. For those, each document hands out
pieces: the bytes of all consecutive windows that share the anchor. Pieces meet by anchor in shards of bounded size. There

* equal pieces are one string with several places;
* the suffixes of the distinct pieces that have at least LENGTH bytes are sorted, with the length of the common prefix of neighbours;
* a stack scan over these lengths visits every interval of the tree, that is, every repeated string with all its places;
* an interval whose places have different bytes to the left is a maximal repeat and is put out; any other is
  covered by a longer repeat that starts further left.

A place of a group in a document with a larger id than the group's smallest is removed. Together the groups remove exactly the
bytes covered by a string of LENGTH bytes that also starts in a document with a smaller id.

Hot passages are met early: an anchor that a task has seen in two texts is known to be shared without asking further, and
only one place of it is sent for others, with a mark that says so; equal pieces of a shard of documents leave it once, with the
smallest id. All exchanges carry packed arrays.

Defined results: null text is empty; texts shorter than LENGTH lose nothing. Rows with a null id neither lose bytes nor take any
from others. Rows that repeat an id are the same document to each other. Equal texts lose everything but the one of the
smallest id. Every input row gives a row; other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkplume.llm import arrays as A
from sparkplume.session import materialize

LENGTH = 50
GRAM = 20
REACH = LENGTH - GRAM + 1  # grams in a window
SHARD_ANCHORS = 400_000
HOME_BYTES = 6 << 20
FLUSH = 1_000_000  # anchors a task holds before it sends them

UNSTEP = np.uint64(pow(int(A.STEP), -1, 1 << 64))

PACKED = "shard long, known boolean, doc binary, text binary, size binary, data binary, sure binary"
PIECES = "shard long, done boolean, doc binary, text binary, start binary, size binary, anchor binary, data binary"
SPANS = "home long, doc binary, text binary, start binary, stop binary"
CUT = "doc_id long, sha string, n_removed long, n_spans long, kept string"
GROUPS = "repeat_length int, places array<struct<doc_id: long, start: int>>"


# --- arrays


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position, by differences of one running sum."""
    n = len(data)
    if n < GRAM:
        return np.empty(0, dtype=np.uint64)
    value = A.BYTE_VALUE[data] * A.powers(n)
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(value, dtype=np.uint64)))
    back = np.full(n - GRAM + 1, UNSTEP, dtype=np.uint64)
    back[0] = 1
    return A.mix((total[GRAM:] - total[:-GRAM]) * np.multiply.accumulate(back))


def window_anchor(h: np.ndarray) -> np.ndarray:
    """Place of the smallest gram, the leftmost if equal, of the window from each position."""
    n = len(h) - REACH + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    place, span = np.arange(len(h)), 1
    while span * 2 <= REACH:
        one, other = place[:-span], place[span:]
        place = np.where(h[one] <= h[other], one, other)
        span *= 2
    rest = REACH - span
    if rest:
        one, other = place[: len(place) - rest], place[rest:]
        place = np.where(h[one] <= h[other], one, other)
    return place[:n]


def text_mark(raw: bytes) -> int:
    """64 bits that stand for a text."""
    return int.from_bytes(hashlib.sha256(raw).digest()[:8], "little", signed=True)


def short(h: np.ndarray) -> np.ndarray:
    """Half of an anchor's hash, enough within a shard of fixed size: two that agree by chance only cost a piece more."""
    return (h >> np.uint64(32)).astype(np.uint32)


def heads(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of sorted keys begins."""
    new = np.zeros(max(len(keys[0]) - 1, 0), dtype=bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    return np.flatnonzero(np.concatenate(([True], new)))[: len(keys[0])]


def text_anchors(batch: pa.RecordBatch, copies: bool = False):
    """For each text of a slice: id, mark, and per run of windows with one anchor its first window and that gram's hash.

    ``copies``: equal texts of different ids are different texts.
    """
    data, ends = A.texts(batch.column("text"))
    raw = data.tobytes()
    h = gram_hashes(data)
    for doc, low, high in zip(batch.column("doc_id").to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
        if high - low < LENGTH:
            continue
        own = h[low : high - GRAM + 1]
        anchor = own[window_anchor(own)]
        # in a text that repeats itself one anchor may hold on for long: pieces of at most REACH windows
        first = heads(anchor)
        windows = np.diff(np.concatenate((first, [len(anchor)])))
        parts = -(-windows // REACH)
        first = np.repeat(first, parts) + REACH * A.runs(np.zeros(len(parts), dtype=np.int64), parts)
        mark = text_mark(raw[low:high] + (doc.to_bytes(8, "little", signed=True) if copies else b""))
        yield doc, mark, raw[low:high], first, len(anchor), anchor[first]


# --- anchors


def _anchor_rows(shards: int, copies: bool = False):
    def flush(docs, marks, hashes):
        size = np.array([len(x) for x in hashes])
        number = np.repeat(np.arange(len(docs)), size)
        h = np.concatenate(hashes)
        doc, mark = np.array(docs, dtype=np.int64), np.array(marks, dtype=np.int64)
        order = np.lexsort((doc[number], mark[number], h))
        h, number = h[order], number[order]
        one = heads(h, mark[number])  # the smallest id of each text
        h, number = h[one], number[one]
        group = heads(h)
        count = np.diff(np.concatenate((group, [len(h)])))
        shared = np.repeat(count > 1, count)
        ask = np.zeros(len(h), dtype=bool)
        ask[group] = True
        # shared here: known; a single place is asked about, also to answer others, who may hold no text but that one
        yield from _packed(h[shared], doc[number[shared]], mark[number[shared]], None, shards)
        yield from _packed(h[ask], doc[number[ask]], mark[number[ask]], shared[ask], shards)

    def run(batches):
        docs, marks, hashes, held = [], [], [], 0
        for batch in A.slices(batches):
            for doc, mark, _, _, _, h in text_anchors(batch, copies):
                docs.append(doc)
                marks.append(mark)
                hashes.append(np.unique(h))
                held += len(hashes[-1])
                if held > FLUSH:
                    yield from flush(docs, marks, hashes)
                    docs, marks, hashes, held = [], [], [], 0
        if docs:
            yield from flush(docs, marks, hashes)

    return run


def _packed(h, doc, mark, sure, shards):
    """Rows of (shard, texts, anchors); known anchors (``sure`` is None) go by their text, those to be counted by their hash.

    ``sure`` says of each of the latter whether the sender holds it in two texts.
    """
    if len(h) == 0:
        return
    shard = ((h if sure is not None else A.mix(mark.view(np.uint64))) % np.uint64(shards)).astype(np.int64)
    order = np.lexsort((mark, doc, shard))
    h, doc, mark, shard = short(h[order]), doc[order], mark[order], shard[order]
    flags = np.empty(0, dtype=np.uint8) if sure is None else sure[order].astype(np.uint8)
    cut = [*heads(shard).tolist(), len(h)]
    for low, high in zip(cut, cut[1:]):
        part = slice(low, high)
        first = heads(doc[part], mark[part])
        size = np.diff(np.concatenate((first, [high - low]))).astype(np.int32)
        arrays = (doc[part][first], mark[part][first], size, h[part], flags[part])
        values = [int(shard[low]), sure is None, *(x.tobytes() for x in arrays)]
        yield _one_row(PACKED, values)


def _one_row(schema: str, values: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [f.strip().split(" ") for f in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[k]) for v, (_, k) in zip(values, fields)], [n for n, _ in fields])


def _column(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype=kind)


def _shared_rows(homes: int):
    """Anchors of a shard that occur in two texts, to the homes of their documents."""

    def run(table: pa.Table) -> pa.Table:
        known = np.array(table.column("known").to_pylist())
        out = []
        for side in (True, False):
            part = table.filter(pa.array(known == side))
            size = _column(part, "size", np.int32)
            h = _column(part, "data", np.uint32)
            doc = np.repeat(_column(part, "doc", np.int64), size)
            mark = np.repeat(_column(part, "text", np.int64), size)
            if not side:
                sure = h[_column(part, "sure", np.uint8) > 0]
                order = np.lexsort((doc, mark, h))
                h, doc, mark = h[order], doc[order], mark[order]
                one = heads(h, mark)
                h, doc, mark = h[one], doc[one], mark[one]
                group = heads(h)
                count = np.diff(np.concatenate((group, [len(h)])))
                # in two of the texts sent, or in two texts of a sender
                shared = np.repeat((count > 1) | np.isin(h[group], sure), count)
                h, doc, mark = h[shared], doc[shared], mark[shared]
            out.append((h, doc, mark))
        h, doc, mark = (np.concatenate(x) for x in zip(*out))
        home = doc % homes
        order = np.lexsort((h, mark, doc, home))
        h, doc, mark, home = h[order], doc[order], mark[order], home[order]
        cut = [*heads(home).tolist(), len(h)] if len(h) else []
        rows = []
        for low, high in zip(cut, cut[1:]):
            part = slice(low, high)
            first = heads(doc[part], mark[part])
            size = np.diff(np.concatenate((first, [high - low]))).astype(np.int32)
            values = [int(home[low]), True, *(x.tobytes() for x in (doc[part][first], mark[part][first], size, h[part])), b""]
            rows.append(_one_row(PACKED, values))
        empty = _one_row(PACKED, [0, True, *[b""] * 5]).slice(0, 0)
        return pa.Table.from_batches([*rows, empty])

    return run


# --- pieces


def _piece_rows(shards: int, copies: bool = False):
    """Pieces of the shared anchors of a home's documents, to the shards of the anchors; all places of them with ``copies``."""

    def run(texts: pa.Table, shared: pa.Table) -> pa.Table:
        size = _column(shared, "size", np.int32)
        limit = np.concatenate(([0], np.cumsum(size)))
        h = _column(shared, "data", np.uint32)
        wanted: dict[tuple[int, int], list] = {}
        pairs = zip(_column(shared, "doc", np.int64).tolist(), _column(shared, "text", np.int64).tolist())
        for k, key in enumerate(pairs):
            wanted.setdefault(key, []).append(h[limit[k] : limit[k + 1]])
        places: dict[bytes, list] = {}
        done: set[tuple[int, int]] = set()
        for batch in A.slices(texts.to_batches()):
            for doc, mark, raw, first, windows, anchor in text_anchors(batch, copies):
                own = wanted.get((doc, mark))
                if own is None or (doc, mark) in done:
                    continue
                done.add((doc, mark))
                stop = np.concatenate((first[1:], [windows])) + LENGTH - 1
                for k in np.flatnonzero(np.isin(short(anchor), np.concatenate(own))).tolist():
                    piece = raw[first[k] : stop[k]]
                    places.setdefault(piece, []).append((doc, mark, int(first[k]), int(anchor[k])))
        todo, over = [], []
        for piece, found in places.items():
            found.sort()
            if copies:
                todo += [(x[3] % shards, *x, piece) for x in found]
                continue
            todo += [(x[3] % shards, *x, piece) for x in found if x[0] == found[0][0]]
            # the same string in a smaller document of this home: removed, and no news to others
            over += [(m % shards, d, m, s, 0, len(piece)) for d, m, s, _ in found if d > found[0][0]]
        rows = [_one_row(PIECES, [0, True, *[b""] * 6]).slice(0, 0)]
        for flag, items in ((False, todo), (True, over)):
            items.sort(key=lambda x: x[0])
            cut = [*heads(np.array([x[0] for x in items])).tolist(), len(items)] if items else []
            for low, high in zip(cut, cut[1:]):
                _, doc, mark, start, anchor, last = zip(*items[low:high])
                length = last if flag else [len(p) for p in last]
                rows.append(
                    _one_row(
                        PIECES,
                        [
                            items[low][0],
                            flag,
                            np.array(doc, dtype=np.int64).tobytes(),
                            np.array(mark, dtype=np.int64).tobytes(),
                            np.array(start, dtype=np.int32).tobytes(),
                            np.array(length, dtype=np.int32).tobytes(),
                            b"" if flag else short(np.array(anchor, dtype=np.uint64)).tobytes(),
                            b"" if flag else pa.compress(b"".join(last), codec="zstd", asbytes=True),
                        ],
                    )
                )
        return pa.Table.from_batches(rows)

    return run


def _pieces_of(table: pa.Table, size: np.ndarray) -> bytes:
    """The bytes of all pieces of a table's rows, which hold them packed; ``size`` is that of each piece."""
    rows = np.array([len(x.as_py()) // 4 for x in table.column("size")], dtype=np.int64)
    total = np.concatenate(([0], np.cumsum(size)))
    ends = np.cumsum(rows)
    length = total[ends] - total[ends - rows]
    packed = table.column("data").to_pylist()
    return b"".join(pa.decompress(x, int(n), codec="zstd", asbytes=True) for x, n in zip(packed, length))


# --- the suffix array of a shard


class SuffixArray:
    """Sorted suffixes, of at least LENGTH bytes, of distinct pieces; ``common`` is the prefix shared with the one before."""

    def __init__(self, pieces: list[bytes]):
        size = np.array([len(p) for p in pieces], dtype=np.int64)
        base = np.cumsum(size) - size
        wide = -(-int(size.max(initial=0)) // 8) * 8
        flat = np.frombuffer(b"".join(pieces) + bytes(wide), dtype=np.uint8)
        count = np.maximum(size - LENGTH + 1, 0)
        self.piece = np.repeat(np.arange(len(pieces)), count)
        self.offset = A.runs(np.zeros(len(pieces), dtype=np.int64), count)
        at = base[self.piece] + self.offset
        left = size[self.piece] - self.offset
        # words of eight bytes, largest first, zero beyond the end of the piece
        eight = np.zeros(len(flat), dtype=np.uint64)
        for k in range(8):
            eight[: len(flat) - k] |= flat[k:].astype(np.uint64) << np.uint64(56 - 8 * k)
        words = []
        for k in range(0, wide, 8):
            word = eight[np.minimum(at + k, len(flat) - 1)]
            over = np.clip(k + 8 - left, 0, 8).astype(np.uint64)
            words.append(np.where(over >= 8, 0, (word >> (over * np.uint64(8) % np.uint64(64))) << (over * np.uint64(8) % np.uint64(64))))
        order = np.lexsort((left, *words[::-1]))  # a prefix before what goes on with zero bytes
        self.piece, self.offset, at, left = self.piece[order], self.offset[order], at[order], left[order]
        # length of the common prefix with the suffix before
        common = np.zeros(len(order), dtype=np.int64)
        same = np.ones(max(len(order) - 1, 0), dtype=bool)
        for word in words:
            w = word[order]
            differ = w[1:] ^ w[:-1]
            zero = sum((differ < np.uint64(1 << b)).astype(np.int64) for b in range(0, 64, 8))
            common[1:] += np.where(same, zero, 0)
            same &= differ == 0
        common[1:] = np.minimum(common[1:], np.minimum(left[1:], left[:-1]))
        self.common = common
        self.before = np.where(self.offset > 0, flat[np.maximum(at - 1, 0)].astype(np.int64), -1)

    def intervals(self):
        """(length, low, high) of the left-diverse intervals of at least LENGTH common bytes, by a stack scan."""
        common = self.common.tolist()
        before = self.before.tolist()
        common.append(0)
        stack: list[list] = []  # length, low, left byte if all agree so far (else -1)
        for k in range(1, len(common)):
            now = common[k]
            if now < LENGTH and not stack:
                continue
            low, byte = k - 1, before[k - 1]
            while stack and stack[-1][0] > now:
                length, low, own = stack.pop()
                own = own if own == byte else -1
                if own == -1:
                    yield length, low, k
                byte = own
            if now >= LENGTH:
                if stack and stack[-1][0] == now:
                    if stack[-1][2] != byte:
                        stack[-1][2] = -1
                else:
                    stack.append([now, low, byte])


def repeat_groups(pieces: list[bytes]):
    """(suffix array, length, low, high) arrays of the maximal repeats among distinct pieces."""
    tree = SuffixArray(pieces)
    found = np.array(list(tree.intervals()), dtype=np.int64).reshape(-1, 3)
    return tree, found[:, 0], found[:, 1], found[:, 2]


def _span_rows(homes: int):
    """Spans that a shard's repeats remove, to the homes of their documents."""

    def run(table: pa.Table) -> pa.Table:
        flag = np.array(table.column("done").to_pylist())
        spans = []
        over = table.filter(pa.array(flag))
        start = _column(over, "start", np.int32).astype(np.int64)
        spans.append((_column(over, "doc", np.int64), _column(over, "text", np.int64), start, start + _column(over, "size", np.int32)))
        todo = table.filter(pa.array(~flag))
        doc, mark = _column(todo, "doc", np.int64), _column(todo, "text", np.int64)
        start = _column(todo, "start", np.int32).astype(np.int64)
        size = _column(todo, "size", np.int32).astype(np.int64)
        limit = np.concatenate(([0], np.cumsum(size))).tolist()
        raw = _pieces_of(todo, size)
        pieces = [raw[i:j] for i, j in zip(limit, limit[1:])]
        # equal pieces: all but those of the smallest id go
        number: dict[bytes, int] = {}
        own = np.fromiter((number.setdefault(p, len(number)) for p in pieces), dtype=np.int64, count=len(pieces))
        order = np.lexsort((doc, own))
        one = order[heads(own[order])] if len(order) else order
        least = doc[one]
        gone = doc > least[own] if len(own) else np.zeros(0, dtype=bool)
        spans.append((doc[gone], mark[gone], start[gone], start[gone] + size[gone]))
        # distinct pieces: every maximal repeat removes its places beyond the smallest id
        stay = np.flatnonzero(~gone)
        by_piece = stay[np.argsort(own[stay], kind="stable")]
        piece_first = np.searchsorted(own[by_piece], np.arange(len(number) + 1))
        # only pieces whose anchor stands in another piece too can repeat in part
        anchor = _column(todo, "anchor", np.uint32)[one]
        _, place, count = np.unique(anchor, return_inverse=True, return_counts=True)
        partly = np.flatnonzero(count[place] > 1)
        distinct = list(number)
        tree, length, low, high = repeat_groups([distinct[k] for k in partly])
        tree.piece = partly[tree.piece]
        many = high - low
        row = np.repeat(np.arange(len(many)), many)
        suffix = A.runs(low, many)
        if len(row):
            smallest = np.minimum.reduceat(least[tree.piece[suffix]], np.cumsum(many) - many)
            take = least[tree.piece[suffix]] > smallest[row]
            row, suffix = row[take], suffix[take]
            piece = tree.piece[suffix]
            copies = np.diff(piece_first)[piece]
            place = by_piece[A.runs(piece_first[piece], copies)]
            begin = start[place] + np.repeat(tree.offset[suffix], copies)
            spans.append((doc[place], mark[place], begin, begin + np.repeat(length[row], copies)))
        doc, mark, start, stop = (np.concatenate(x) for x in zip(*spans))
        return pa.Table.from_batches([*_span_batches(doc, mark, start, stop, homes), _one_row(SPANS, [0, b"", b"", b"", b""]).slice(0, 0)])

    return run


def merged(key: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching spans of a key as one."""
    if len(key) == 0:
        return key, start, stop
    order = np.lexsort((start, key))
    key, start, stop = key[order], start[order], stop[order]
    wide = int(stop.max()) + 2
    lifted = np.maximum.accumulate(stop + key * wide)
    new = np.concatenate(([True], start[1:] + key[1:] * wide > lifted[:-1]))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(key)])) - 1
    return key[first], start[first], lifted[last] - key[first] * wide


def _span_batches(doc, mark, start, stop, homes):
    if len(doc) == 0:
        return
    order = np.lexsort((mark, doc, doc % homes))
    doc, mark, start, stop = doc[order], mark[order], start[order], stop[order]
    first = heads(doc, mark)
    number = np.repeat(np.arange(len(first)), np.diff(np.concatenate((first, [len(doc)]))))
    key, start, stop = merged(number, start, stop)
    doc, mark = doc[first][key], mark[first][key]
    home = doc % homes
    cut = [*heads(home).tolist(), len(doc)]
    for low, high in zip(cut, cut[1:]):
        part = slice(low, high)
        arrays = (doc[part], mark[part], start[part].astype(np.int32), stop[part].astype(np.int32))
        yield _one_row(SPANS, [int(home[low]), *(x.tobytes() for x in arrays)])


def _cut_rows(texts: pa.Table, spans: pa.Table) -> pa.Table:
    """What is left of a home's documents."""
    doc, mark = _column(spans, "doc", np.int64), _column(spans, "text", np.int64)
    start, stop = _column(spans, "start", np.int32).astype(np.int64), _column(spans, "stop", np.int32).astype(np.int64)
    order = np.lexsort((mark, doc))
    doc, mark, start, stop = doc[order], mark[order], start[order], stop[order]
    first = heads(doc, mark)
    number = np.repeat(np.arange(len(first)), np.diff(np.concatenate((first, [len(doc)]))))
    key, start, stop = merged(number, start, stop)
    limit = np.searchsorted(key, np.arange(len(first) + 1)).tolist()
    at = {pair: k for k, pair in enumerate(zip(doc[first].tolist(), mark[first].tolist()))}
    start, stop = start.tolist(), stop.tolist()
    out = {}
    for batch in A.slices(texts.to_batches()):
        data, ends = A.texts(batch.column("text"))
        raw = data.tobytes()
        for own, low, high in zip(batch.column("doc_id").to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
            text = raw[low:high]
            k = at.get((own, text_mark(text)))
            if k is None:
                continue
            digest, after, gone = hashlib.sha256(), 0, 0
            for i in range(limit[k], limit[k + 1]):
                digest.update(text[after : start[i]])
                after = stop[i]
                gone += stop[i] - start[i]
            digest.update(text[after:])
            sha = hashlib.sha256(text).hexdigest()
            out[own, sha] = (own, sha, gone, limit[k + 1] - limit[k], digest.hexdigest())
    columns = list(zip(*out.values())) or [[]] * 5
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.table({n: pa.array(list(c), k) for n, c, k in zip(("doc_id", "sha", "n_removed", "n_spans", "kept"), columns, kinds)})


# --- the operator


def _release(df: DataFrame) -> None:
    """Let Spark drop the shuffle files of plans that are no longer held; callers let go of them first."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def _layout(docs: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """Rows with size and digest (written), texts that can take part, and the counts of shards and homes."""
    text = F.coalesce("text", F.lit(""))
    rows = materialize(docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha")), "rows")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    homes = 2 * (total // HOME_BYTES) + 1
    shards = total * 2 // (REACH + 1) // SHARD_ANCHORS + 1
    texts = docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH)).select("doc_id", "text")
    return rows, texts, int(shards), int(homes)


def _meeting(texts: DataFrame, shards: int, homes: int, copies: bool = False) -> DataFrame:
    """Pieces of all shared anchors, by shard (written)."""
    anchors = texts.mapInArrow(_anchor_rows(shards, copies), PACKED)
    shared = materialize(anchors.groupBy("shard").applyInArrow(_shared_rows(homes), PACKED), "shared")
    del anchors
    _release(texts)
    homed = texts.withColumn("home", F.pmod("doc_id", F.lit(homes)))
    pieces = homed.groupBy("home").cogroup(shared.withColumnRenamed("shard", "home").groupBy("home"))
    return pieces.applyInArrow(_piece_rows(shards, copies), PIECES)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    rows, texts, shards, homes = _layout(docs)
    pieces = _meeting(texts, shards, homes)
    spans = materialize(pieces.groupBy("shard").applyInArrow(_span_rows(homes), SPANS), "spans")
    del pieces
    _release(docs)
    homed = texts.withColumn("home", F.pmod("doc_id", F.lit(homes)))
    cut = homed.groupBy("home").cogroup(spans.groupBy("home")).applyInArrow(_cut_rows, CUT)
    cut = materialize(cut, "cut")
    del homed
    _release(docs)
    least = rows.where("doc_id IS NOT NULL").groupBy("sha").agg(F.min("doc_id").alias("least"))
    out = rows.join(least, "sha", "left").join(cut, ["doc_id", "sha"], "left")
    copy = F.coalesce((F.col("n_bytes") >= LENGTH) & (F.col("doc_id") > F.col("least")), F.lit(False))
    nothing = F.sha2(F.lit(""), 256)
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, nothing).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def _group_rows(table: pa.Table) -> pa.Table:
    """Maximal repeats of a shard with all their places."""
    todo = table.filter(pa.array(~np.array(table.column("done").to_pylist())))
    doc, start, size = (_column(todo, c, k).astype(np.int64) for c, k in (("doc", np.int64), ("start", np.int32), ("size", np.int32)))
    limit = np.concatenate(([0], np.cumsum(size))).tolist()
    raw = _pieces_of(todo, size)
    held: dict[bytes, list] = {}
    for k, (i, j) in enumerate(zip(limit, limit[1:])):
        held.setdefault(raw[i:j], []).append((int(doc[k]), int(start[k])))
    groups = {p: set(places) for p, places in held.items() if len(places) > 1}
    pieces, every = list(held), list(held.values())
    tree, length, low, high = repeat_groups(pieces)
    for n, i, j in zip(length.tolist(), low.tolist(), high.tolist()):
        at = int(tree.offset[i])
        # a whole piece that stands in longer ones too is one group
        group = groups.setdefault(pieces[tree.piece[i]][at : at + n], set())
        group |= {(d, s + int(tree.offset[k])) for k in range(i, j) for d, s in every[tree.piece[k]]}
    found = [(len(p), sorted(places)) for p, places in groups.items()]
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int32())]))
    places = pa.array([[{"doc_id": d, "start": s} for d, s in p] for _, p in found], kind)
    return pa.table({"repeat_length": pa.array([n for n, _ in found], pa.int32()), "places": places})


def maximal_repeats(docs: DataFrame) -> DataFrame:
    """(repeat_length, places): maximal repeats of at least LENGTH bytes inside pieces, with all their places.

    Equal pieces and exact copies of a text are places like others, so all places of a hot passage meet in its shard.
    """
    _, texts, shards, homes = _layout(docs)
    return _meeting(texts, shards, homes, copies=True).groupBy("shard").applyInArrow(_group_rows, GROUPS)
