import random

import numpy as np
import pytest

from sparkplume.operators.compare import box_stats, kruskal
from sparkplume.operators.evaluate import rank_runs, row_slice, top_runs
from sparkplume.operators.ordering import quantiles, running_total


def rows(n=3000, seed=4):
    """A third of the rows in one group share one value; some values are missing."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        v = 5.0 if i % 3 == 0 else (None if i % 50 == 1 else round(rng.uniform(0, 10), 2))
        out.append((i, "hot" if i % 3 == 0 else rng.choice("ab"), v, rng.randint(0, 4)))
    return out


@pytest.mark.parametrize("rows_per_range", [100, 10_000_000])
@pytest.mark.parametrize("by", [(), ("g",)])
def test_running_total(spark, rows_per_range, by):
    data = rows()
    df = spark.createDataFrame(data, "id long, g string, v double, w long").repartition(5)
    got = {r["id"]: r["t"] for r in running_total(df, ["v", "id"], by, "w", "t", rows_per_range).collect()}
    want, sums = {}, {}
    for i, g, v, w in sorted(data, key=lambda r: (r[2] is None, r[2] if r[2] is not None else 0.0, r[0])):
        key = g if by else 0
        sums[key] = sums.get(key, 0) + w
        want[i] = sums[key]
    assert got == want


@pytest.mark.parametrize("rows_per_range", [50, 10_000_000])
def test_quantiles_and_boxes(spark, rows_per_range):
    data = [r for r in rows() if r[2] is not None]
    df = spark.createDataFrame(data, "id long, g string, v double, w long")
    got = {r["g"]: r for r in box_stats(df, ["g"], "v", rows_per_range).collect()}
    for g in {r[1] for r in data}:
        v = np.array([r[2] for r in data if r[1] == g])
        q1, q2, q3 = np.percentile(v, [25, 50, 75])
        inside = v[(v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))]
        r = got[g]
        assert r["n_values"] == len(v)
        assert np.allclose(
            [r["q1"], r["median"], r["q3"], r["whisker_low"], r["whisker_high"]],
            [q1, q2, q3, min(inside.min(), q1), max(inside.max(), q3)],
        )
    one = quantiles(df.where("id = 0"), ["g"], "v", {"m": 0.5}).first()
    assert one["m"] == 5.0


@pytest.mark.parametrize("rows_per_range", [60, 10_000_000])
def test_ranks(spark, rows_per_range):
    data = [(f"r{i:04d}", "IDW", "A", None if i % 40 == 0 else float(i % 7), float(-i)) for i in range(400)]
    df = spark.createDataFrame(data, "run_id string, method string, dataset string, rmse double, mae double")
    got = {r["run_id"]: r for r in rank_runs(df, rows_per_range=rows_per_range).collect()}
    by_rmse = sorted(data, key=lambda r: (r[3] is None, r[3] or 0.0, r[0]))
    by_mae = sorted(data, key=lambda r: (r[4], r[0]))
    for i, r in enumerate(by_rmse, 1):
        assert got[r[0]]["rmse_rank"] == i
    for i, r in enumerate(by_mae, 1):
        assert got[r[0]]["mae_rank"] == i


def test_top_and_slice_limit_before_the_exchange(spark):
    data = [(f"r{i}", "IDW", "A", float(i), float(i)) for i in range(20)]
    df = spark.createDataFrame(data, "run_id string, method string, dataset string, rmse double, ave_rank double")
    assert sorted(r["run_id"] for r in top_runs(df, 3).collect()) == ["r0", "r1", "r2"]
    sliced = row_slice(df, 1, 5, ["rmse"])
    assert [r["rmse"] for r in sliced.orderBy("rmse").collect()] == [1.0, 2.0, 3.0, 4.0]
    for frame in (top_runs(df, 3), row_slice(df, 1, 5, ["rmse"], ["method"])):
        assert frame._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2


def test_kruskal_with_split_ranking(spark):
    data = [r for r in rows() if r[2] is not None]
    df = spark.createDataFrame(data, "id long, g string, v double, w long")
    small, large = kruskal(df, "g", "v", 70).first(), kruskal(df, "g", "v").first()
    assert abs(small["h"] - large["h"]) < 1e-9 and small["n"] == len(data)


@pytest.mark.parametrize("groups,values", [(2, 74), (4, 38), (4, 66)])
def test_kruskal_of_groups_that_are_alike(spark, groups, values):
    """H is zero: no rounding may put it below, where the tail has no root."""
    df = spark.createDataFrame([(f"g{g}", float(v)) for g in range(groups) for v in range(values)], "g string, v double")
    r = kruskal(df, "g", "v").first()
    assert (r["n_groups"], r["n"], r["h"], r["p"]) == (groups, groups * values, 0.0, pytest.approx(1.0))
