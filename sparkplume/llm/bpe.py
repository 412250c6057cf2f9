"""Byte-level BPE with forced-boundary splitting.

A merge only ever joins bytes that stand side by side inside some token. A pair of bytes that no token contains
therefore marks a certain cut. Texts are cut at all such pairs, each distinct fragment is encoded once on its own, and
the ids of the fragments are concatenated. Three kinds of certain cut are left out, since the splitting pattern looks
across them: after white space (a run of it is split by what follows), before an apostrophe (which may begin a
contraction) and inside a character.

A tokenizer is read from a file in the format of the public ``tokenizers`` library, given as a path; tokens that the
file marks as special are recognised in texts first. The merges themselves are done here: short pieces of a task's new
fragments as one stack of arrays, a step for all at a time, and long pieces by a heap.

Defined results: null and empty texts have no ids. Every input row gives a row, whatever its id. Other columns are
ignored. Memory of a task is bounded by its cache of CACHE fragments and its longest text.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sparkplume.llm import arrays as A

CACHE = 300_000
SHORT = 32  # bytes of a piece that is merged in a stack

# fixed values: the characters that count as white space, and the splitting pattern of this kind of tokenizer
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+"
    rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)

IDS = "doc_id long, ids array<int>"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def printable() -> list[str]:
    """The character that stands for each byte in a vocabulary file: itself if printable, else the next free one from 256."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


class Codec:
    """A tokenizer file as tables, and the fragments encoded so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or before["type"] != "ByteLevel" or before["add_prefix_space"] or spec["normalizer"]:
            raise ValueError(f"not a plain byte-level BPE: {path}")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"special tokens with options are not supported: {path}")
        byte = {c: b for b, c in enumerate(printable())}
        vocab = model["vocab"]
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.pattern = regex.compile(PIECE)
        tokens = {i: bytes(byte[c] for c in t) for t, i in vocab.items()}
        tokens |= {i: t for t, i in self.special.items()}
        size = max(tokens) + 1
        spelled = [tokens.get(i, b"") for i in range(size)]
        self.token = _table(spelled)
        self.decimal = _table([b"%d," % i for i in range(size)])
        self.of_byte = np.array([vocab[c] for c in printable()], dtype=np.int64)
        # merges as sorted keys left * size + right, with rank and result
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([vocab[a] * size + vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.size, self.key, self.rank, self.made = size, key[order], order, made[order]
        self.merge = {k: (r, m) for k, r, m in zip(self.key.tolist(), self.rank.tolist(), self.made.tolist())}
        cut = np.ones((256, 256), dtype=bool)
        for t in spelled:
            if len(t) > 1:
                at = np.frombuffer(t, dtype=np.uint8)
                cut[at[:-1], at[1:]] = False
        cut[[0x20, *range(0x09, 0x0E)], :] = False
        cut[:, 0x27] = False
        cut[:, 0x80:0xC0] = False
        self.cut = cut.ravel()
        self.forget()

    def forget(self) -> None:
        self.cache = _Numbers()
        self.flat = np.empty(0, dtype=np.int32)
        self.first = np.zeros(1, dtype=np.int64)

    # --- cutting

    def cuts(self, data: np.ndarray, ends: np.ndarray, raw: bytes) -> np.ndarray:
        """Byte positions between fragments, text limits included."""
        two = data[:-1].astype(np.int32) * 256 + data[1:]
        cut = self.cut[two]
        if len(data) > 2:
            # last byte of what may be a wide space: no cut after it
            wide = (data[1:-1] == 0xC2) & ((data[2:] == 0x85) | (data[2:] == 0xA0))
            wide |= (data[:-2] >= 0xE1) & (data[:-2] <= 0xE3) & np.isin(data[1:-1], (0x80, 0x81, 0x9A))
            cut[2:] &= ~wide[:-1]
            if data[0] == 0xC2:
                cut[1] = False
        at = np.concatenate((np.flatnonzero(cut) + 1, ends))
        for token in self.special:
            place = raw.find(token)
            while place >= 0:
                after = place + len(token)
                text = np.searchsorted(ends, place, "right")
                if ends[text] >= after:
                    at = np.concatenate((at[(at <= place) | (at >= after)], (place, after)))
                    place = raw.find(token, after)
                else:
                    place = raw.find(token, place + 1)
        return np.unique(at)

    # --- encoding

    def encode(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin and end."""
        if len(data) == 0:
            return np.empty(0, dtype=np.int32), np.zeros(len(ends), dtype=np.int64)
        if len(self.cache) > CACHE:
            self.forget()
        raw = data.tobytes()
        at = self.cuts(data, ends, raw)
        places = at.tolist()
        fragments = [raw[i:j] for i, j in zip(places, places[1:])]
        number = np.fromiter(map(self.cache.__getitem__, fragments), dtype=np.int64, count=len(fragments))
        if self.cache.new:
            self._learn(self.cache.new)
            self.cache.new = []
        length = np.diff(self.first)[number]
        ids = self.flat[A.runs(self.first[number], length)]
        total = np.concatenate(([0], np.cumsum(length)))
        return ids, total[np.searchsorted(at, ends)]

    def _learn(self, fragments: list[bytes]) -> None:
        pieces: list[bytes] = []
        owner: list[int] = []
        for k, fragment in enumerate(fragments):
            if fragment in self.special:
                found = [fragment]
            else:
                found = [p.encode() for p in self.pattern.findall(fragment.decode())]
            pieces += found
            owner += [k] * len(found)
        size = np.array([len(p) for p in pieces])
        short = np.flatnonzero(size <= SHORT)
        ids: list[np.ndarray] = [None] * len(pieces)
        for low in range(0, len(short), 1 << 15):
            part = short[low : low + (1 << 15)]
            for k, row in zip(part.tolist(), self._stack([pieces[k] for k in part], size[part])):
                ids[k] = row
        for k in np.flatnonzero(size > SHORT).tolist():
            ids[k] = self._long(pieces[k])
        for k, piece in enumerate(pieces):
            if piece in self.special:
                ids[k] = np.array([self.special[piece]])
        count = np.bincount(np.array(owner, dtype=np.int64), weights=[len(x) for x in ids], minlength=len(fragments))
        self.flat = np.concatenate((self.flat, *ids)).astype(np.int32)
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(count).astype(np.int64)))

    def _stack(self, pieces: list[bytes], size: np.ndarray) -> list[np.ndarray]:
        """Short pieces merged side by side: each round joins the pair of lowest rank in every piece that has one."""
        width = int(size.max())
        grid = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(-1, width)
        ids = self.of_byte[grid]
        left = size.copy()
        ids[np.arange(width) >= left[:, None]] = -1
        open_ = np.flatnonzero(left > 1)
        none = len(self.key)
        while len(open_):
            wide = int(left[open_].max())
            now = ids[open_, :wide]
            key = now[:, :-1] * self.size + now[:, 1:]
            place = np.minimum(np.searchsorted(self.key, key), none - 1)
            known = (self.key[place] == key) & (now[:, 1:] >= 0)
            rank = np.where(known, self.rank[place], none)
            best = rank.argmin(axis=1)
            row = np.arange(len(open_))
            some = rank[row, best] < none
            open_, best, row = open_[some], best[some], row[some]
            if len(open_) == 0:
                break
            column = np.arange(wide)
            source = column + (column > best[:, None])
            moved = np.where(source < wide, np.take_along_axis(now[row], np.minimum(source, wide - 1), axis=1), -1)
            moved[np.arange(len(open_)), best] = self.made[place[row, best]]
            ids[open_, :wide] = moved
            left[open_] -= 1
            open_ = open_[left[open_] > 1]
        return [row[:n] for row, n in zip(ids, left.tolist())]

    def _long(self, piece: bytes) -> np.ndarray:
        """A long piece: a heap of pairs over a linked list."""
        ids = self.of_byte[np.frombuffer(piece, dtype=np.uint8)].tolist()
        last = len(ids) - 1
        after = list(range(1, last + 2))
        before = list(range(-1, last))
        heap = []

        def offer(at: int) -> None:
            if at >= 0 and after[at] <= last:
                rule = self.merge.get(ids[at] * self.size + ids[after[at]])
                if rule:
                    heapq.heappush(heap, (rule[0], at, ids[at], ids[after[at]], rule[1]))

        for at in range(last):
            offer(at)
        while heap:
            _, at, one, other, made = heapq.heappop(heap)
            nxt = after[at]
            if ids[at] != one or nxt > last or ids[nxt] != other:
                continue
            ids[at], ids[nxt] = made, -1
            after[at] = after[nxt]
            if after[at] <= last:
                before[after[at]] = at
            offer(before[at])
            offer(at)
        return np.array([i for i in ids if i >= 0])

    # --- decoding

    def spelled(self, ids: np.ndarray, limits: np.ndarray, table: tuple) -> tuple[bytes, np.ndarray]:
        """Strings of a table for all ids, one after the other, and where those of each text begin and end."""
        flat, first = table
        length = np.diff(first)[ids]
        total = np.concatenate(([0], np.cumsum(length)))
        return flat[A.runs(first[ids], length)].tobytes(), total[limits]


class _Numbers(dict):
    """Fragments to numbers; a new fragment gets the next number and is noted in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, key: bytes) -> int:
        number = self[key] = len(self)
        self.new.append(key)
        return number


def _table(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    first = np.concatenate(([0], np.cumsum([len(s) for s in strings])))
    return np.frombuffer(b"".join(strings), dtype=np.uint8), first


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One per worker process."""
    return Codec(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of every text."""

    def run(batches):
        for batch in A.slices(batches):
            ids, limits = codec(path).encode(*A.texts(batch.column("text")))
            lists = pa.ListArray.from_arrays(pa.array(limits, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, IDS)


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """Rows of ``documents`` with the text as ids: (doc_id, lang, source, n_tokens, ids)."""

    def run(batches):
        for batch in A.slices(batches):
            ids, limits = codec(path).encode(*A.texts(batch.column("text")))
            lists = pa.ListArray.from_arrays(pa.array(limits, pa.int32()), pa.array(ids, pa.int32()))
            kept = [batch.column(c) for c in ("doc_id", "lang", "source")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(np.diff(limits), pa.int64()), lists], ["doc_id", "lang", "source", "n_tokens", "ids"]
            )

    schema = "doc_id long, lang string, source string, n_tokens long, ids array<int>"
    return docs.select("doc_id", "lang", "source", "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of every list of ids; bytes that are no UTF-8 become the replacement character, null is empty."""

    def run(batches):
        for batch in batches:
            lists = [np.array(x or [], dtype=np.int64) for x in batch.column("ids").to_pylist()]
            limits = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
            own = codec(path)
            raw, at = own.spelled(np.concatenate([*lists, np.empty(0, dtype=np.int64)]), limits, own.token)
            text = [raw[i:j].decode(errors="replace") for i, j in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Digests of the ids and of the text decoded from them, for every text."""

    def run(batches):
        for batch in A.slices(batches):
            own = codec(path)
            ids, limits = own.encode(*A.texts(batch.column("text")))
            comma, i = own.spelled(ids, limits, own.decimal)
            raw, j = own.spelled(ids, limits, own.token)
            rows = range(batch.num_rows)
            ids_digest = [hashlib.sha256(comma[i[k] : max(i[k + 1] - 1, i[k])]).hexdigest() for k in rows]
            decoded = (raw[j[k] : j[k + 1]].decode(errors="replace").encode() for k in rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(limits), pa.int64()),
                    pa.array(ids_digest, pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, DIGESTS)
