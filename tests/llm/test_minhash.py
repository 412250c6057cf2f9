"""Near duplicates against brute force on full sets."""

import re

import corpus_pipeline
import numpy as np
from fixtures import docs, nothing, prose, rows

from sparkplume.llm import minhash as M
from sparkplume.llm.graph import components


def shingles(text):
    w = [x for x in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode().lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(pairs):
    sets = {i: shingles(t) for i, t in pairs if i is not None}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in M.near_duplicates(df).collect() if r.doc_id is not None}


def test_odd_cases(spark):
    assert found(docs(spark)) == brute([(r[0], r[1]) for r in rows()])
    out = M.near_duplicates(docs(spark)).collect()
    assert len(out) == len(rows())
    assert all(r.kept and r.component_id is None for r in out if r.doc_id is None)


def test_empty_table(spark):
    assert M.near_duplicates(nothing(spark)).collect() == []
    assert M.deduplicated(nothing(spark)).collect() == []


def test_crowd_with_edits(spark, monkeypatch):
    """Copies with zero to nine edits: links, near misses and chains in the same buckets, over several blocks."""
    monkeypatch.setattr(M, "BLOCK", 8)
    r = np.random.RandomState(4)
    base = prose(9, 150).split()
    texts = []
    for k in range(60):
        w = list(base)
        for at in r.randint(0, len(w), r.randint(0, 10)):
            w[at] = f"edit{r.randint(0, 4)}"
        texts.append((1000 - k, " ".join(w)))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    assert found(df) == brute(texts)


def test_deduplicated_keeps_rows_and_columns(spark):
    df = docs(spark)
    out = M.deduplicated(df)
    assert out.columns == df.columns
    kept = {i for i, (_, _, k) in brute([(r[0], r[1]) for r in rows()]).items() if k}
    ids = [r.doc_id for r in out.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(kept) and ids.count(None) == 2


def test_pipeline_stage_links_at_four_fifths(spark):
    """Two separate words of a hundred changed: 86 of 106 shingles in common, above 0.80 and below 0.85."""
    base = prose(21, 100).split()
    texts = [(1, " ".join(base))]
    for k, places in enumerate(((30, 60), (30, 60, 80), (10, 50)), 2):
        texts.append((k, " ".join(f"edit{k}" if at in places else w for at, w in enumerate(base))))
    texts += [(9, prose(22, 100))]
    sets = {i: shingles(t) for i, t in texts}
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    assert 0.8 <= alike[1, 2] < 0.85 and alike[1, 3] < 0.8
    parent = {i: i for i in sets}
    for _ in sets:
        for (a, b), s in alike.items():
            if s >= 0.8:
                parent[a] = parent[b] = min(parent[a], parent[b])
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect())
    assert kept == sorted(i for i in sets if parent[i] == i) == [1, 3, 9]
    assert sorted(r.doc_id for r in M.near_duplicates(df).where("kept").collect()) == [1, 2, 3, 4, 9]  # op2's own limit


def test_estimate_is_corrected_for_chance():
    r = np.random.RandomState(1)
    sets = [np.unique(r.randint(0, 1 << 62, 4000).astype(np.uint64)) for _ in range(40)]
    one = np.array([M.sketch_of(s) for s in sets[:20]])
    other = np.array([M.sketch_of(s) for s in sets[20:]])
    n = np.array([len(s) for s in sets])
    assert M.estimated(one, other, n[:20], n[20:]).mean() < 0.01
    assert (M.estimated(one, one, n[:20], n[:20]) == 1).all()
    mixed = np.array([M.sketch_of(np.concatenate((a[:3600], b[:400]))) for a, b in zip(sets[:20], sets[20:])])
    assert abs(M.estimated(one, mixed, n[:20], n[:20]).mean() - 3600 / 4400) < 0.03


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (9, 9), (7, 6), (6, 5), (None, 3), (2, 1), (20, 21), (21, 22), (22, 23), (23, 24)]
    out = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 4, 20: 20, 21: 20, 22: 20, 23: 20, 24: 20}
    chain = [(k, k + 1) for k in range(100)]
    out = components(spark.createDataFrame(chain, "a long, b long")).collect()
    assert len(out) == 101 and {r.component for r in out} == {0}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
