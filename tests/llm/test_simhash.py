"""Fingerprints and their groups against all pairs."""

import numpy as np
import pytest
import xxhash
from fixtures import SCHEMA, docs, nothing, rows

from sparkplume.llm import simhash as S
from sparkplume.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def fingerprint(text):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(pairs):
    """(doc_id, fingerprint) rows to the expected rows, by all pairs."""
    fps = np.array(sorted({f for i, f in pairs if i is not None}), dtype=np.uint64)
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[k + 1 :] ^ fps[k]) <= 4).tolist():
            root[find(k + 1 + j)] = find(k)
    at = {int(f): k for k, f in enumerate(fps)}
    seen = {}
    for i, f in pairs:
        if i is not None:
            root[find(at[f])] = find(seen.setdefault(i, at[f]))
    low = {}
    for i, f in pairs:
        if i is not None:
            c = find(at[f])
            low[c] = min(low.get(c, i), i)
    return [(i, f"{f:016x}", low[find(at[f])] if i is not None else None) for i, f in pairs]


def ordered(found):
    return sorted((tuple(r) for r in found), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_query_equals_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = groups([(r.doc_id, fingerprint(r.text)) for r in table])
    got = QUERIES["op13_anchor_simhash"](spark, SF)
    assert ordered(got.collect()) == ordered(want)
    assert len({r[2] for r in want}) < len(want)


def test_odd_rows(spark):
    source = [(i, t) for i, t, *_ in rows()] + [(3, "another text of document three, again")]
    frame = spark.createDataFrame([(i, t, "en", "s", 0, "x", 1, 1, None, 3) for i, t in source], SCHEMA)
    want = groups([(i, fingerprint(t)) for i, t in source])
    assert ordered(S.simhash_duplicates(frame).collect()) == ordered(want)
    assert docs(spark).count() == len(rows())
    assert S.simhash_duplicates(nothing(spark)).collect() == []


def cloud(seed, n):
    """Fingerprints around a few centres and at random."""
    r = np.random.RandomState(seed)
    centres = r.randint(0, 1 << 62, 8, dtype=np.int64).astype(np.uint64)
    out = centres[r.randint(0, 8, n)].copy()
    for _ in range(7):
        out ^= np.uint64(1) << r.randint(0, 64, n).astype(np.uint64)
    return np.unique(np.concatenate((out, r.randint(0, 1 << 62, n // 4, dtype=np.int64).astype(np.uint64))))


@pytest.mark.parametrize("block", [4096, 16])
def test_links_of_crowded_anchors(spark, monkeypatch, block):
    """The same groups whether an anchor is one block or many."""
    monkeypatch.setattr(S, "BLOCK", block)
    fps = cloud(1, 400)
    nodes = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    links = [(r.a, r.b) for r in S.linked_fingerprints(nodes).collect()]
    as_bits = np.array(links, dtype=np.int64).view(np.uint64).reshape(-1, 2)
    assert (np.bitwise_count(as_bits[:, 0] ^ as_bits[:, 1]) <= 4).all()
    edge = {}
    for a, b in as_bits.tolist():
        edge.setdefault(a, set()).add(b)
        edge.setdefault(b, set()).add(a)
    part = {}
    for x in fps.tolist():
        todo = [x] if x not in part else []
        while todo:
            y = todo.pop()
            if y not in part:
                part[y] = x
                todo += edge.get(y, ())
    want = groups([(k, x) for k, x in enumerate(fps.tolist())])
    place = {x: k for k, x in enumerate(fps.tolist())}
    assert [place[part[x]] for x in fps.tolist()] == [r[2] for r in want]


def test_every_link_meets_at_an_anchor():
    r = np.random.RandomState(2)
    one = r.randint(0, 1 << 62, 2000, dtype=np.int64).astype(np.uint64)
    other = one.copy()
    for _ in range(4):
        other ^= np.uint64(1) << r.randint(0, 64, 2000).astype(np.uint64)
    anchor, row, own = S.anchors(one)
    assert (np.bincount(row[own], minlength=2000) == 2).all()  # one of its own in each part
    assert np.bincount(row).max() <= 156 + 18
    mine = {}
    for a, i, o in zip(anchor.tolist(), row.tolist(), own.tolist()):
        if o:
            mine.setdefault(i, set()).add(a)
    theirs = {}
    anchor, row, _ = S.anchors(other)
    for a, i in zip(anchor.tolist(), row.tolist()):
        theirs.setdefault(i, set()).add(a)
    assert all(mine[i] & theirs[i] for i in range(2000))


def test_code_covers():
    """All changes to code words within three bits, by brute force over the 31 places."""
    r = np.random.RandomState(4)
    for word in r.randint(0, 1 << 31, 3, dtype=np.int64).astype(np.uint64):
        s = int(S.syndrome(np.array([word]))[0])
        found = word ^ S.moves(3)[s]
        assert len(found) == len(set(found.tolist())) == 156
        assert (S.syndrome(found) == 0).all() and (np.bitwise_count(found ^ word) <= 3).all()


def test_forest_joins_what_links_join():
    fps = cloud(7, 300)
    links = S.forest(fps, fps)
    assert len(links) < len(fps)
    want = groups([(k, x) for k, x in enumerate(fps.tolist())])
    assert len(fps) - len(links) == len({r[2] for r in want})
