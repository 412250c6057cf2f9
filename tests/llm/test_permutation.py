"""The permutation index: exact scores and order, recall against brute force, odd rows."""

import numpy as np

from sparkplume.llm import permutation as P

SF = "/root/testdata/sf0.01"


def brute(ids, v, k=20):
    score = v @ v.T
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = score[i].copy()
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [int(ids[j]) for j in order]
    return out


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 1000)
    monkeypatch.setattr(P, "QUERIES", 30)
    r = np.random.RandomState(0)
    centre = r.normal(size=(12, 32))
    v = centre[r.randint(0, 12, 6000)] + r.normal(size=(6000, 32))
    ids = np.arange(6000)
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)], "vec_id long, embedding array<double>")
    found = {}
    for row in P.nearest(df.repartition(6)).collect():
        assert abs(row.score - v[row.query_id] @ v[row.vec_id]) < 1e-9
        found.setdefault(row.query_id, []).append((row.rank, -row.score, row.vec_id))
    want = brute(ids, v)
    assert set(found) == set(want)
    for rows in found.values():
        rows.sort()
        assert [x[0] for x in rows] == list(range(1, 21)) and [x[1:] for x in rows] == sorted(x[1:] for x in rows)
    hit = np.mean([len({x[2] for x in found[q]} & set(want[q])) / 20 for q in want])
    assert hit >= 0.9


def test_recall_with_a_third_of_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 3000)
    monkeypatch.setattr(P, "QUERIES", 100)
    r = np.random.RandomState(5)
    v = r.normal(size=(6, 16))[r.randint(0, 6, 6000)] + r.normal(size=(6000, 16))
    same = r.rand(6000) < 1 / 3
    v[same] = v[0]
    ids = np.arange(6000)
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)], "vec_id long, embedding array<double>")
    df = df.repartition(6)
    found = P.nearest(df).toPandas().groupby("query_id").vec_id.apply(set)
    want = brute(ids, v)
    hit = {q: len(found[q] & set(w)) / 20 for q, w in want.items()}
    assert np.mean(list(hit.values())) >= 0.9 and np.mean([hit[q] for q in hit if same[q]]) >= 0.9
    entries = P.entries(P.usable(df), 20)
    assert entries.count() == len(np.unique(v, axis=0))  # so are the pivots
    assert max(len(x.ids) for x in entries.collect()) == 21


def test_table_recall(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = table.toPandas()
    want = brute(rows.vec_id.to_numpy(), np.array(rows.embedding.tolist(), dtype=float))
    found = P.nearest(table).toPandas().groupby("query_id").vec_id.apply(set)
    assert np.mean([len(found[q] & set(w)) / len(w) for q, w in want.items()]) >= 0.9


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    made = [
        (0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]),
        (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, 2.0, 3.0]), (None, [5.0, 5.0]), (40, []), (60, None), (9, [-1.0, 0.5]),
    ]
    df = spark.createDataFrame([(*m, 1, "x") for m in made], "vec_id long, embedding array<float>, rank int, pivots string")
    out = {}
    for r in sorted(P.nearest(df).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert out == {
        0: [(1, 1.0), (2, 1.0), (20, 0.0), (9, -1.0)],
        20: [(1, 2.0), (2, 2.0), (9, 1.0), (0, 0.0)],
    }
    assert P.nearest(df.limit(0)).collect() == []
    assert P.nearest(df.where("vec_id = 1")).collect() == []
