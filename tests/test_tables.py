import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkplume.functions import scalars as S
from sparkplume.operators import compare as C
from sparkplume.operators import evaluate as E
from sparkplume.operators import prepare as P
from sparkplume.plans import bindings as B
from sparkplume.plans import runs as R
from sparkplume.plans.prepare import samples_from_file
from sparkplume.plans.sweep import class_scores, sweep_runs
from sparkplume.sources import tables as IO

SAMPLE = "row_id long, system_id long, system_name string, size string, mrl double, units string, region long, state string, contaminant string, water_type string, value double, collection_date date"


def sample(i, system, value, day=1, contaminant="PFOA", water="GW", month=1):
    return (i, system, f"n{i}", "S", 0.004, "ug/L", 1, "X", contaminant, water, value, datetime.date(2024, month, day))


def test_stats_of_small_groups(spark):
    rows = [sample(1, 7, 2.0), sample(2, 7, 4.0, 2), sample(3, 8, None), sample(4, None, 1.0), sample(5, 9, 1.0, water="MX")]
    df = P.impute_nondetect(P.filter_samples(spark.createDataFrame(rows, SAMPLE)))
    got = {r["system_id"]: r for r in P.system_stats(df).collect()}
    assert set(got) == {7, 8}
    assert got[7]["mean_value"] == 3.0 and got[7]["system_name"] == "n1" and got[7]["n_dates"] == 2
    assert got[8]["std_dev"] is None and got[8]["mean_value"] == 0.004 * (1 / 3)
    assert P.system_stats(df.where("false")).count() == 0


def test_first_of_tied_maxima(spark):
    df = spark.createDataFrame([sample(2, 7, 4.0), sample(1, 7, 4.0), sample(3, 7, 1.0)], SAMPLE)
    assert [r["row_id"] for r in P.max_row_per_system(df).collect()] == [1]


def test_seasons(spark):
    df = spark.createDataFrame([sample(m, 7, 1.0, month=m) for m in range(1, 13)], SAMPLE)
    got = {r["row_id"]: r["season"] for r in P.with_season(df).collect()}
    assert got == {12: "win", 1: "win", 2: "win", 6: "sum", 7: "sum", 8: "sum"}


def test_scalars(spark):
    df = spark.createDataFrame(
        [("123", "a/b\\c", 8000.0, 0.004), ("12345", "c", None, 0.01), ("123456", "a/", 7.0, 0.0100001), (None, None, 24000.0, None)],
        "zip string, path string, lag double, v double",
    )
    got = df.select(
        S.zfill(F.col("zip")), S.basename(F.col("path")), S.lag_name(F.col("lag")),
        S.classify(F.col("v"), S.TWO_CLASS_LIMITS), S.classify(F.col("v"), S.THREE_CLASS_LIMITS),
    ).collect()
    assert [tuple(r) for r in got] == [
        ("00123", "c", "8", 1, 1), ("12345", "c", "Arc", 1, 1), ("123456", "", None, 1, 2), (None, None, "24", None, None)
    ]


def test_strict_dates_fail(spark):
    df = spark.createDataFrame([("3/7/2024",), ("2024-03-07",)], "d string")
    assert df.select(S.parse_date(F.col("d"), strict=False).alias("d")).first()["d"] == datetime.date(2024, 3, 7)
    with pytest.raises(Exception):
        df.select(S.parse_date(F.col("d"))).collect()


def test_run_counts_and_names(spark):
    counts = {m: sweep_runs(spark, m) for m in ("IDW", "OK", "UK", "NN")}
    assert {m: r.count() for m, r in counts.items()} == {"IDW": 84, "OK": 420, "UK": 200, "NN": 1}
    for r in counts.values():
        assert r.select("run_id").distinct().count() == r.count()
        assert R.invalid_runs(r).count() == 0
    names = {r[0] for m in counts for r in counts[m].select("out_name").collect()}
    # fixed values: names as the reference prints them
    assert {"V_p0_np5", "F_p2_d16km_np6", "F_p3_d40km_np24", "SpV_lag8km_np12", "CirF_lag16km_d80km_np50",
            "ExV_lagArckm_np100", "GaF_lag16km_d161km_np6", "LnF_lag24km_d16km_np12", "QuV_lagArckm_np12"} <= names
    assert not any(n.startswith(("ExV_lag20", "GaF_lag24")) for n in names)
    replay = R.skip_long_lags(R.param_grid(R.single(spark), "OK"), replay=True)
    assert replay.count() == 460
    bad = counts["OK"].withColumn("model", F.lit("Cubic"))
    assert R.invalid_runs(bad).count() == 420


def test_tail_probabilities():
    assert C.chi_square_tail(25.31, 3) == pytest.approx(1.33e-5, abs=5e-8)
    assert C.chi_square_tail(5.991464547107979, 2) == pytest.approx(0.05)
    assert C.chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert C.chi_square_tail(11.070497693516351, 5) == pytest.approx(0.05)
    assert C.normal_two_sided(1.959963984540054) == pytest.approx(0.05)


def test_rank_tests_of_equal_values(spark):
    df = spark.createDataFrame([(g, 1.0) for g in "aabbb"], "g string, v double")
    r = C.kruskal(df, "g", "v").first()
    assert r["h"] is None and r["p"] is None and r["n"] == 5
    assert C.kruskal(df.where("false"), "g", "v").count() == 0
    pairs = {(r["group_a"], r["group_b"]): r for r in C.dunn(df, "g", "v").collect()}
    assert len(pairs) == 4 and pairs["a", "a"]["p"] == 1.0


def test_recall_without_positives(spark):
    df = spark.createDataFrame([("r", 0.001, 0.002), ("r", 0.003, 0.02)], "run_id string, observed double, predicted double")
    r = class_scores(df).first()
    assert r["accuracy"] == 0.5 and r["recall"] is None
    cm = E.confusion(E.classified(df, S.THREE_CLASS_LIMITS), 3)
    assert cm.count() == 9 and cm.groupBy().sum("n").first()[0] == 2
    means = E.mean_performance(class_scores(df).withColumn("method", F.lit("IDW"))).first()
    assert means["mean_recall"] is None


def test_tab_file_in_latin_1(spark, tmp_path):
    head = "PWSID\tPWSName\tSize\tFacilityWaterType\tContaminant\tMRL\tUnits\tRegion\tState\tAnalyticalResultValue\tCollectionDate\n"
    (tmp_path / "s.txt").write_bytes((head + "A1\tCañon\tS\tGW\tPFOA\t0.004\tug/L\t8\tCO\t\t3/7/2024\n").encode("latin-1"))
    row = IO.read_samples(spark, str(tmp_path / "s.txt")).first()
    assert row["PWSName"] == "Cañon" and row["AnalyticalResultValue"] is None and row["MRL"] == 0.004


@pytest.mark.parametrize("lags", [("8000", "#"), ("8000", "24000"), ("", "16000.0")])
def test_runs_csv(spark, tmp_path, lags):
    (tmp_path / "r.csv").write_text("raster,SemiVar_model,type,lag_dist,num_points\n" + "".join(f"g/n{i},Spherical,variable,{lag},12\n" for i, lag in enumerate(lags)))
    schema = T.StructType([IO.RUN_SCHEMA[c] for c in ("raster", "SemiVar_model", "type", "lag_dist", "num_points")])
    got = [r["lag_dist"] for r in IO.read_runs(spark, str(tmp_path / "r.csv"), schema).orderBy("raster").collect()]
    assert got == [None if lag in ("#", "") else float(lag) for lag in lags]


def test_table_types_and_alias(spark, tmp_path):
    ok = spark.createDataFrame([(1, "a", 1.0, datetime.date(2024, 1, 1))], "a long, b string, c double, d date")
    IO.write_table(ok, str(tmp_path / "t"))
    with pytest.raises(TypeError):
        IO.write_table(ok.selectExpr("int(a) AS a"), str(tmp_path / "u"))
    named = IO.with_alias(ok, "c", "MeanValue")
    IO.write_points(named, str(tmp_path / "p"))
    assert IO.col_by_alias(spark.read.parquet(str(tmp_path / "p")), "MeanValue") == "c"
    with pytest.raises(ValueError):
        IO.col_by_alias(ok, "MeanValue")


def test_raster_prunes_by_run(spark, tmp_path):
    df = spark.range(100).selectExpr("concat('r', id % 5) AS run_id", "id AS row", "id AS col", "double(id) AS value")
    IO.write_raster(df, str(tmp_path / "r"), files_per_run=2)
    one = IO.read_raster(spark, str(tmp_path / "r"), "r3")
    assert one.count() == 20
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan


def test_filters_and_columns_reach_the_scan(spark, tmp_path, capsys):
    B.points(spark, "/root/testdata/sf0.001").explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(o_orderstatus,F)" in plan and "EqualTo(o_orderpriority,1-URGENT)" in plan
    assert "o_orderdate" not in plan and "n_name" not in plan
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    spark.createDataFrame([sample(1, 7, 2.0)], SAMPLE).write.parquet(str(tmp_path / "s"))
    P.impute_nondetect(P.filter_samples(spark.read.parquet(str(tmp_path / "s")))).select("value").explain("formatted")
    plan = capsys.readouterr().out
    assert "In(contaminant, [PFOA,PFOS])" in plan and "In(water_type, [GW,SW])" in plan
    assert "ReadSchema: struct<contaminant:string,water_type:string,value:double>" in plan


def test_rows_of_split_files_keep_their_order(spark, tmp_path):
    """Files by name, then rows by line, although Spark reads the larger file first and cuts it into many blocks."""
    head = "\t".join(f.name for f in IO.SAMPLE_SCHEMA)
    line = "{}\tname {}\tS\tGW\tPFOA\t0.004\tug/L\t1\tX\t{}\t1/2/2024"
    number = 0
    for name, rows in (("a.txt", 40), ("b.txt", 3000), ("c.txt", 500)):
        lines = [line.format(f"s{(number + k) % 37}", number + k, number + k) for k in range(rows)]
        number += rows
        (tmp_path / name).write_text("\n".join([head, *lines]) + "\n", encoding="iso-8859-1")
    small = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        read = samples_from_file(IO.read_samples(spark, str(tmp_path)))
        assert read.rdd.getNumPartitions() > 20
        ordered = [r.value for r in read.orderBy("row_id").select("value").collect()]
        first = P.first_per_key(read.select("system_id", "row_id", "system_name"), ["system_id"], "row_id").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert ordered == [float(k) for k in range(number)]
    assert {r.system_id: r.system_name for r in first} == {f"s{k}": f"name {k}" for k in range(37)}
