"""Removal of repeated passages against brute force; maximal repeats of the interval tree against all substrings."""

import hashlib
import random

import numpy as np
from fixtures import docs, nothing, rows

from sparkplume.llm import repeats as R


def brute(pairs):
    least = {}
    for d, t in pairs:
        b = (t or "").encode()
        for i in range(len(b) - R.LENGTH + 1 if d is not None else 0):
            w = b[i : i + R.LENGTH]
            least[w] = min(least.get(w, d), d)
    out = []
    for d, t in pairs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - R.LENGTH + 1 if d is not None else 0):
            if least[b[i : i + R.LENGTH]] < d:
                gone[i : i + R.LENGTH] = b"\1" * R.LENGTH
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in R.remove_repeats(df).collect()), key=str)


def test_odd_cases(spark):
    assert found(docs(spark)) == brute([(r[0], r[1]) for r in rows()])


def test_empty_table(spark):
    assert R.remove_repeats(nothing(spark)).collect() == []
    assert R.maximal_repeats(nothing(spark)).collect() == []


def test_overlapping_passages_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(R, "SHARD_ANCHORS", 300)
    monkeypatch.setattr(R, "HOME_BYTES", 4000)
    r = random.Random(3)
    base = "".join(r.choice("ab") for _ in range(2000))
    texts = []
    for d in range(150):
        t = ""
        for _ in range(r.randint(0, 5)):
            i = r.randint(0, 1900)
            t += base[i : i + r.randint(20, 150)] + r.choice(["", "x", "é", "\0", "zz"])
        texts.append((d * 3, t))
    texts += [(900, "ab" * 200), (901, "ab" * 300), (902, "a" * 500), (903, "a" * 50), (904, "a" * 49), (4, "a" * 51)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    assert found(df) == brute(texts)


def test_hot_passage_is_asked_once(spark):
    """A task that sees an anchor in two texts sends one question for it, however many documents have it."""
    passage = "a passage that a third of all rows holds, somewhat longer than the limit of fifty bytes. "
    texts = [(k, passage + f"own words {k} " * 6) for k in range(300)]
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    asked = [r for r in df.mapInArrow(R._anchor_rows(1), R.PACKED).collect() if not r.known]
    hashes = np.concatenate([np.frombuffer(r.data, dtype=np.uint32) for r in asked])
    assert len(hashes) == len(np.unique(hashes))
    assert found(df) == brute(texts)


def test_copies_in_two_tasks_beside_a_near_copy(spark):
    """One task knows that an anchor is shared and asks with the very text that the other task has."""
    passage = "a passage that stands in both texts and is a good deal longer than the limit of fifty bytes is. "
    text = "first " * 5 + passage + "own end of the text that is copied."
    orders = set()
    for k in range(6):
        near = f"other {k} " * 5 + passage + f"another end {k} of the near copy."
        orders.add(R.text_mark(text.encode()) < R.text_mark(near.encode()))
        for ids in ((5, 9, 7), (7, 5, 9), (9, 7, 5)):
            one = spark.createDataFrame([(ids[0], text)], "doc_id long, text string").coalesce(1)
            two = spark.createDataFrame([(ids[1], text), (ids[2], near)], "doc_id long, text string").coalesce(1)
            assert found(one.union(two)) == brute([(ids[0], text), (ids[1], text), (ids[2], near)])
    assert orders == {True, False}


def test_interval_tree_puts_out_all_maximal_repeats(monkeypatch):
    monkeypatch.setattr(R, "LENGTH", 3)
    r = random.Random(8)
    for _ in range(60):
        pieces = list({"".join(r.choice("ab\0") for _ in range(r.randint(3, 14))).encode() for _ in range(5)})
        tree, length, low, high = R.repeat_groups(pieces)
        got = {}
        for n, i, j in zip(length.tolist(), low.tolist(), high.tolist()):
            places = {(int(tree.piece[k]), int(tree.offset[k])) for k in range(i, j)}
            p, o = next(iter(places))
            got[pieces[p][o : o + n]] = places
        want = {}
        for n in range(3, 15):
            spots = {}
            for k, p in enumerate(pieces):
                for o in range(len(p) - n + 1):
                    spots.setdefault(p[o : o + n], set()).add((k, o))
            for w, places in spots.items():
                left = [pieces[k][o - 1] if o else None for k, o in places]
                right = [pieces[k][o + n] if o + n < len(pieces[k]) else None for k, o in places]
                diverse = lambda side: None in side or len(set(side)) > 1
                if len(places) > 1 and diverse(left) and diverse(right):
                    want[w] = places
        assert {w: p for w, p in want.items() if len(p) > 1} == got


def test_groups_name_all_places(spark):
    texts = [(k, f"{k} " * 20 + "the same sixty bytes that stand in every one of these documents here" + f" {k}" * 20) for k in range(5)]
    out = R.maximal_repeats(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert max(len({p.doc_id for p in r.places}) for r in out) == 5


def test_groups_hold_long_passages_and_exact_copies(spark):
    """Pieces inside a long passage are equal in all documents, and every piece of a text is equal in its copies."""
    r = random.Random(12)
    passage, text = ("".join(r.choice("abcdefgh ") for _ in range(n)) for n in (600, 400))
    texts = [(k, f"{k} " * 20 + passage + f" {k}" * 20) for k in range(6)] + [(k, text) for k in (20, 21, 22)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    out = R.maximal_repeats(df).collect()
    for string, ids in ((passage, range(6)), (text, (20, 21, 22))):
        covered = set()
        for row in out:
            places = {(p.doc_id, p.start) for p in row.places}
            if {d for d, _ in places} == set(ids):
                first = min(places)
                at = first[1] - dict(texts)[first[0]].index(string)
                covered |= set(range(at, at + row.repeat_length - R.LENGTH + 1))
        assert set(range(len(string) - R.LENGTH + 1)) <= covered
