"""Periodic runs against brute force over all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from fixtures import docs, nothing, rows

from sparkplume.llm import runs as R
from sparkplume.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute(words):
    """All runs by comparing the words with themselves at every distance."""
    ids = {}
    w = np.array([ids.setdefault(x, len(ids)) for x in words], dtype=np.int64)
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        same = np.concatenate(([False], w[q:] == w[:-q], [False]))
        turn = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(turn[::2].tolist(), turn[1::2].tolist()):
            if b - a + q >= max(6, 4 * q):
                out.setdefault((a, b - a + q), q)  # smaller periods come first
    return sorted((s, m, q) for (s, m), q in out.items() if not any((w[s + d : s + m] == w[s : s + m - d]).all() for d in range(1, q)))


def expected(doc_id, text):
    words = [x.decode() for x in (text or "").encode().split()]
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    dropped = {i for s, m, q in found for i in range(s + q, s + m)}
    top = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id,
        len(found),
        *(top if top else (None, None, None)),
        1000 * top[1] // top[2] if top else None,
        sha("".join(f"{s},{m},{q}\n" for s, m, q in found)),
        sha(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def same(df, source):
    got = [tuple(r) for r in df.collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[6], r[7])
    assert sorted(got, key=key) == sorted((expected(*r) for r in source), key=key)
    return got


def digests(frame):
    return R.run_digests(R.periodic_runs(R.looped(frame)))


def test_query_equals_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = same(QUERIES["op12_dyadic_runs"](spark, SF), table)
    assert sum(r[1] > 0 for r in got) > 50  # looped texts with at least four periods


def test_odd_rows(spark):
    same(digests(docs(spark)), [(i, t) for i, t, *_ in rows()])
    assert digests(nothing(spark)).count() == 0
    assert R.periodic_runs(nothing(spark)).columns == ["doc_id", "runs", "collapsed"]


@pytest.mark.parametrize("seed", range(6))
def test_random_periods(seed):
    r = random.Random(seed)
    texts = []
    for _ in range(60):
        text = []
        for _ in range(r.randint(0, 6)):
            unit = [r.choice("ab" if seed % 2 else "abcdefgh") for _ in range(r.randint(1, 12))]
            text += unit * r.randint(1, 7) + unit[: r.randint(0, len(unit))]
        texts.append(text)
    first = np.cumsum([0, *map(len, texts)])
    symbol = np.array([ord(c) + 1000 * k for k, t in enumerate(texts) for c in t], dtype=np.int64)
    assert R.find_runs(symbol, first) == [sorted(brute(t), key=lambda x: (x[0], x[2])) for t in texts]


def test_nested_and_long():
    unit = list("ab" * 5 + "c")  # runs of period two inside one of period eleven
    text = unit * 2000
    got = R.find_runs(np.array([ord(c) for c in text]), np.array([0, len(text)]))[0]
    assert (0, len(text), 11) in got and len(got) == 2001
    assert got == sorted(got)


def test_wavelet_tree_neighbours():
    rng = np.random.RandomState(5)
    values = rng.permutation(500)
    tree = R.WaveletTree(values)
    low = rng.randint(0, 499, 300)
    high = low + 1 + rng.randint(0, 500 - low)
    x = values[low + rng.randint(0, high - low)]
    left, right = tree.around(low, high, x)
    for a, b, v, p, q in zip(low, high, x, left, right):
        own = values[a:b]
        assert p == max(own[own < v], default=-1) and q == min(own[own > v], default=-1)
