"""A sweep that was interrupted goes on and ends with the same rasters."""

import random

import pytest

from sparkplume.operators.spatial import Grid
from sparkplume.plans import resume as RS
from sparkplume.plans import runs as R
from sparkplume.plans import sweep as W
from sparkplume.sources.tables import write_runs

GRID = Grid(0.0, 0.0, 10000.0, 6, 5)
RUNS = [
    ("OK", "Spherical", "variable", None, 16000.0, 6, None, None),
    ("OK", "Linear", "variable", None, 16000.0, 6, None, None),
    ("OK", "Linear", "fixed", None, 16000.0, None, 30000.0, 4),
    ("IDW", None, "variable", 2.0, None, 5, None, None),
]


@pytest.fixture(scope="module")
def inputs(spark):
    r = random.Random(8)
    rows = [(k, r.uniform(0, 50000), r.uniform(0, 60000), r.random()) for k in range(60)]
    points = spark.createDataFrame(rows, "system_id long, x double, y double, z double").cache()
    return points, R.with_run_id(R.with_run_name(spark.createDataFrame(RUNS, R.RUNS))).cache()


def values(df):
    rows = df.select("run_id", "row", "col", "value", "variance", "status").collect()
    return {(r[0], r[1], r[2]): tuple(None if v is None else round(v, 9) for v in r[3:5]) + (r[5],) for r in rows}


def test_goes_on_after_an_interruption(spark, inputs, tmp_path, monkeypatch):
    points, runs = inputs
    folder = str(tmp_path / "sweep")
    assert RS.finished(spark, folder).collect() == []
    written = []

    def stop_after_two(df, path):
        if len(written) == 2:
            write_runs(df.where("row < 3"), path)  # half a batch is on disk, nothing is listed
            raise RuntimeError("lost")
        written.append(path)
        write_runs(df, path, rows_per_band=2)

    with monkeypatch.context() as m:
        m.setattr(RS, "write_runs", stop_after_two)
        with pytest.raises(RuntimeError):
            RS.sweep_to(folder, points, GRID, runs, batch=1)
    assert RS.finished(spark, folder).count() == 2
    assert RS.read_sweep(spark, folder).select("run_id").distinct().count() == 2  # the torn one is not read
    assert RS.sweep_to(folder, points, GRID, runs, batch=3) == 2
    assert RS.sweep_to(folder, points, GRID, runs) == 0
    assert values(RS.read_sweep(spark, folder)) == values(W.sweep(points, GRID, runs))
    one = RS.read_sweep(spark, folder, "OK_LnV_lag16km_np6")
    assert one.count() == GRID.size and one.where("variance IS NULL").count() == 0


def test_files_follow_row_bands(spark, inputs, tmp_path):
    points, runs = inputs
    raster = W.sweep(points, GRID, runs.where("method = 'IDW'"))
    write_runs(raster, str(tmp_path / "r"), rows_per_band=2)
    files = list((tmp_path / "r").glob("run_id=*/*.parquet"))
    spans = [spark.read.parquet(str(f)).selectExpr("count(*) n").first().n for f in files]
    assert sum(spans) == GRID.size
    write_runs(raster.withColumn("value", raster["value"] + 1), str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == GRID.size
