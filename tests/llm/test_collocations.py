"""Collocations against SQL, on given and on crafted tables; the shards lose nothing."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from compare import differences
from fixtures import SCHEMA, docs, nothing, prose

from sparkplume.llm import collocations as C


def against_sql(frame, min_count, top=50):
    con = duckdb.connect()
    given = pa.table(  # noqa: F841
        {c: pa.array([r[c] for r in frame.select("text", "lang").collect()], pa.string()) for c in ("text", "lang")}
    )
    con.execute("CREATE TABLE documents AS SELECT * FROM given")
    found = C.collocations(frame, min_count, top)
    assert differences(found, con, C.collocations_sql(min_count, top)) == []
    return found.collect()


def crafted(spark):
    texts = [("The river  stone\tcloud. The RIVER stone! the river", "en")] * 40
    texts += [("la rivière où; la rivière où la Rivière", None), ("la rivière, où", "und")] * 31
    texts += [("A a a a a a", "en"), ("a a\na a", "en")] * 9
    texts += [("x y z w " * k, "de") for k in range(1, 12)]  # one long phrase, its parts nearly as frequent
    texts += [(prose(k, 200), "en") for k in range(30)] + [(None, "en"), ("", "fr"), (" .;, ", None), ("one", "fr")]
    rows = [(k if k % 7 else None, t, g, "s", 0, "x", k, 1, None, 3) for k, (t, g) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.mark.parametrize("min_count", [30, 13, 7, 1])
def test_crafted_rows(spark, min_count):
    got = against_sql(crafted(spark), min_count)
    assert {r.lang for r in got} >= {"en", "und"}


def test_odd_rows(spark):
    against_sql(docs(spark), 3)
    got = C.collocations(nothing(spark))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and got.count() == 0


def test_many_ranges_and_small_holds(spark, monkeypatch):
    """Packed keys of several ranges and tasks that send often give the same counts."""
    frame = crafted(spark)
    want = sorted(map(tuple, C.phrase_counts(frame, 10).collect()))
    monkeypatch.setattr(C, "RANGE_BYTES", 1000)
    monkeypatch.setattr(C, "HOLD_WORDS", 100)
    assert sorted(map(tuple, C.phrase_counts(frame, 10).collect())) == want


def test_counts_past_64_bits(spark):
    n = 5_000_000_000_000
    counted = [("en", "", 0, 3 * n), ("en", "a", 1, n + 7), ("en", "b", 1, n + 9), ("en", "a b", 2, n)]
    frame = spark.createDataFrame(counted, C.COUNTS)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(C, "phrase_counts", lambda docs, min_count: frame)
        (row,) = C.collocations(frame).collect()
    assert row.score == 2_000_000 * n // (2 * n + 16) and (row.a, row.l, row.r, row.n) == (n, n + 7, n + 9, 3 * n)


def test_local_support_loses_nothing():
    for total in range(1, 100):
        support = C.local_support(total)
        assert C.SHARDS * (support - 1) < total  # counts below the support in every shard cannot reach the total


def test_table_holds_what_is_put_in():
    rng = np.random.RandomState(3)
    h = rng.randint(0, 1 << 62, 1000, dtype=np.int64).astype(np.uint64)
    table = np.zeros(1 << (C.TABLE_BITS - 3), dtype=np.uint8)
    place = (h[:500] >> np.uint64(64 - C.TABLE_BITS)).astype(np.int64)
    np.bitwise_or.at(table, place >> 3, (1 << (place & 7)).astype(np.uint8))
    assert C.in_table(table, h[:500]).all() and C.in_table(table, h[500:]).sum() < 5
