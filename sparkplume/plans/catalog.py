"""Every registered query: the operators run over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkplume.functions import scalars as S
from sparkplume.operators import compare as C
from sparkplume.operators import evaluate as E
from sparkplume.operators import idw as I
from sparkplume.operators import kriging as K
from sparkplume.operators import neighbors as N
from sparkplume.operators import prepare as P
from sparkplume.operators import spatial as G
from sparkplume.operators.natural import natural_neighbor
from sparkplume.operators.variogram import MODELS, fit_semivariogram, semivariogram
from sparkplume.plans import bindings as B
from sparkplume.plans import datasets as D
from sparkplume.plans import prepare as PP
from sparkplume.plans import resume as RS
from sparkplume.plans import runs as R
from sparkplume.plans import sweep as W
from sparkplume.session import materialize, shared_folder
from sparkplume.sources import tables as IO

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

GRID = B.GRID
ALL_LAGS = [lag or G.CELL_SIZE for lag in R.LAGS]  # the default lag is the cell size
SOLVED_DIGITS = 9  # of scores from solved systems: drift through as many places as it has terms does not depend on the model
# of drifts of six terms through six places: all such runs of a setting have one score, computed to about nine digits
DRIFT_DIGITS = 7
BUFFER = 40000.0  # evaluation buffer on the coarse fixture grid


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


SHIFT = 1.23456789e-11


def rounded(df: DataFrame, digits: int | None = None, **own: int) -> DataFrame:
    """Doubles rounded for comparison, ``own`` digits by column; adding zero removes a negative zero.

    By default to ten digits on a slightly shifted grid: averages of short decimals fall exactly on the
    limits of the plain grid, where the last bit of a sum would decide.
    """
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]

    def cut(name: str) -> Column:
        places = own.get(name, digits)
        value = F.col(f"`{name}`")
        return (F.round(value + F.lit(SHIFT), 10) if places is None else F.round(value, places)) + F.lit(0.0)

    return df.withColumns({c: cut(c) for c in doubles})


def _filtered(spark: SparkSession, sf: str) -> DataFrame:
    return P.impute_nondetect(_wanted(spark, sf))


def _wanted(spark: SparkSession, sf: str) -> DataFrame:
    return P.filter_samples(B.samples(spark, sf, P.CONTAMINANTS, P.WATER_TYPES))


def _cells(spark: SparkSession) -> DataFrame:
    return G.make_grid(spark, GRID)


def _idw_runs(spark: SparkSession) -> list[Row]:
    """All 84 settings of the sweep."""
    return R.run_rows(W.sweep_runs(spark, "IDW"))


def _idw_raster(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Raster of all runs from the training points, and the test points."""
    train, test = B.train_test(spark, sf)
    return I.idw_sweep(train, GRID, _idw_runs(spark)), test


def _idw_pairs(spark: SparkSession, sf: str) -> DataFrame:
    train, test = B.train_test(spark, sf)
    cells = materialize(W.evaluation_cells(test, GRID, None), "cells")
    return W.evaluate(W.sweep(train, GRID, _runs_frame(spark, _idw_runs(spark)), cells), test, GRID, None)


def _runs_frame(spark: SparkSession, rows: list[Row]) -> DataFrame:
    schema = T.StructType([*R.RUNS.fields, T.StructField("out_name", T.StringType()), T.StructField("run_id", T.StringType())])
    return spark.createDataFrame([tuple(r[f.name] for f in schema) for r in rows], schema)


# --- preparation ---------------------------------------------------------------------------------


@query
def filter_impute(spark, sf):
    df = P.with_dataset(_filtered(spark, sf))
    return rounded(df.select("row_id", "system_id", "contaminant", "water_type", "dataset", "value"))


@query
def parse_season(spark, sf):
    return B.samples(spark, sf).select(
        "row_id",
        S.parse_date(F.col("collection_text")).alias("parsed"),
        S.parse_date(F.concat(F.lit("x"), "collection_text"), strict=False).alias("bad"),
        F.month(S.parse_date(F.col("collection_text"))).alias("month_of"),
        S.season(S.parse_date(F.col("collection_text"))).alias("season"),
    )


@query
def system_stats(spark, sf):
    return rounded(P.system_stats(_filtered(spark, sf)))


@query
def system_stats_seasonal(spark, sf):
    by = ["season", *P.DATASET, "system_id"]
    return rounded(P.system_stats(P.with_season(_filtered(spark, sf)), by))


@query
def first_per_key(spark, sf):
    return P.first_per_key(
        _filtered(spark, sf).select("system_id", "row_id", "system_name", "size", "state"), ["system_id"], "row_id"
    )


@query
def max_row_per_system(spark, sf):
    return rounded(P.max_row_per_system(_filtered(spark, sf)))


@query
def max_by_zip(spark, sf):
    samples = P.filter_samples(B.samples(spark, sf, ["PFOA"], ["GW"]))
    return rounded(P.max_by_zip_of(samples, P.padded_zips(B.zips(spark, sf)), "PFOA", "GW"))


@query
def join_zips(spark, sf):
    joined = P.join_zips(_wanted(spark, sf), P.padded_zips(B.zips(spark, sf)))
    return joined.select("row_id", "system_id", "zip")


@query
def zip_counts(spark, sf):
    return P.count_per_zip(P.padded_zips(B.bridge_rows(spark, sf)))


@query
def zip_systems(spark, sf):
    return P.systems_per_zip(P.padded_zips(B.bridge_rows(spark, sf)))


@query
def zip_set_sizes(spark, sf):
    return P.zip_set_sizes(P.padded_zips(B.bridge_rows(spark, sf)))


@query
def key_overlap(spark, sf):
    return P.key_overlap(_wanted(spark, sf), B.systems(spark, sf))


@query
def unmatched(spark, sf):
    sampled = _wanted(spark, sf)
    return (
        P.unmatched_count(sampled, B.systems(spark, sf))
        .withColumn("against", F.lit("systems"))
        .unionByName(P.unmatched_count(sampled, B.zips(spark, sf)).withColumn("against", F.lit("zips")))
    )


@query
def join_points(spark, sf):
    stats = P.system_stats(P.filter_samples(_filtered(spark, sf), ["PFOA"], ["GW"]), ["system_id"])
    stats = stats.select("system_id", "state", "mean_value", "n_values")
    return rounded(P.join_points(B.systems(spark, sf), stats, "points", "pfoa_gw"))


@query
def scan_points(spark, sf):
    return IO.scan_points(B.samples(spark, sf), ["row_id", "system_id", "state"], "water_type = 'GW' AND state = 'NATION_7'")


@query
def scan_non_null(spark, sf):
    return rounded(IO.scan_non_null(B.samples(spark, sf), ["row_id", "value"]))


@query
def alias_column(spark, sf):
    stats = P.system_stats(P.filter_samples(_filtered(spark, sf), ["PFOA"], ["GW"]), ["system_id"])
    joined = P.join_points(B.systems(spark, sf), stats.select("system_id", "mean_value"), "points", "pfoa_gw")
    key, mean = IO.col_by_alias(joined, "system_id"), IO.col_by_alias(joined, "mean_value")
    return rounded(joined.select(F.col(key).alias("system_id"), F.col(mean).alias("observed")))


# --- sources and sinks ---------------------------------------------------------------------------


def _fresh(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _prepared(spark: SparkSession, sf: str, seasonal: bool) -> DataFrame:
    samples = B.samples(spark, sf, P.CONTAMINANTS, P.WATER_TYPES)
    out = PP.prepared_points(samples, B.systems(spark, sf), G.polygon_edges(B.area(spark)), seasonal)
    return out.select("dataset", "system_id", "x", "y", "state", "mean_value", "n_values", "is_train")


@query
def prepared_points(spark, sf):
    """Filter, impute, statistics, location, clip and split of the four datasets."""
    return rounded(_prepared(spark, sf, False))


@query
def prepared_points_seasonal(spark, sf):
    return rounded(_prepared(spark, sf, True))


def _sample_file(spark: SparkSession, sf: str) -> str:
    raw = B.samples(spark, sf).select(
        F.col("system_id").cast("string").alias("PWSID"),
        F.concat(F.lit("Ca\u00f1on "), "system_name").alias("PWSName"),
        F.col("size").alias("Size"),
        F.col("water_type").alias("FacilityWaterType"),
        F.col("contaminant").alias("Contaminant"),
        F.col("mrl").alias("MRL"),
        F.lit("ug/L").alias("Units"),
        F.col("region").cast("string").alias("Region"),
        F.col("state").alias("State"),
        F.col("value").alias("AnalyticalResultValue"),
        F.col("collection_text").alias("CollectionDate"),
    )
    path = _fresh(spark, "tab")
    raw.write.option("sep", "\t").option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return path


@query
def io_roundtrip_tsv(spark, sf):
    return rounded(IO.read_samples(spark, _sample_file(spark, sf)))


@query
def io_file_to_stats(spark, sf):
    """From a sample file on disk to per-system statistics."""
    samples = PP.samples_from_file(IO.read_samples(spark, _sample_file(spark, sf)))
    stats = P.system_stats(P.impute_nondetect(P.filter_samples(samples)))
    return rounded(stats.select(*P.DATASET, "system_id", "mean_value", "std_dev", "n_values", "n_dates", "first_date"))


@query
def io_roundtrip_zips(spark, sf):
    path = _fresh(spark, "zips")
    zips = B.zips(spark, sf).select(F.col("system_id").cast("string").alias("PWSID"), F.col("zip").alias("ZIPCODE"))
    zips.write.option("sep", "\t").option("header", True).csv(path)
    read = IO.read_zips(spark, path)
    return P.padded_zips(read, "ZIPCODE")


@query
def io_roundtrip_csv(spark, sf):
    path = _fresh(spark, "runs")
    log = B.run_log(spark, sf).select(
        F.col("log_id").cast("string").alias("raster"),
        F.col("model").alias("SemiVar_model"),
        "type",
        "power",
        F.when(F.col("method") != "IDW", F.coalesce(F.col("lag_dist").cast("string"), F.lit("#"))).alias("lag_dist"),
        F.col("num_points").cast("double").alias("num_points"),
        F.col("rmse").alias("RMSE"),
    )
    IO.write_csv(log, path)
    schema = T.StructType([IO.RUN_SCHEMA[c] for c in log.columns])
    runs = IO.read_runs(spark, path, schema)
    return rounded(runs.withColumn("lag_name", S.lag_name(F.col("lag_dist"))))


@query
def io_roundtrip_table(spark, sf):
    path = _fresh(spark, "stats")
    stats = P.system_stats(_filtered(spark, sf))
    IO.write_table(stats, path)
    return rounded(spark.read.parquet(path))


@query
def io_roundtrip_points(spark, sf):
    path = _fresh(spark, "points")
    stats = B.points(spark, sf)
    IO.write_points(IO.with_alias(stats.withColumnRenamed("z", "pfoa_gw_mean_value"), "pfoa_gw_mean_value", "mean_value"), path)
    back = spark.read.parquet(path)
    return rounded(back.select("system_id", F.col(IO.col_by_alias(back, "mean_value")).alias("mean_value")))


@query
def io_roundtrip_raster(spark, sf):
    raster, _ = _idw_raster(spark, sf)
    path = _fresh(spark, "raster")
    IO.write_raster(raster.drop("cell_id"), path)
    return rounded(IO.read_raster(spark, path, "IDW_V_p2_np12_2.0").select("run_id", "row", "col", "value"))


# --- space ---------------------------------------------------------------------------------------


@query
def clip_points(spark, sf):
    return G.clip_points(B.points(spark, sf).select("system_id", "x", "y"), G.polygon_edges(B.area(spark)), 25000.0)


@query
def train_test_split(spark, sf):
    split = G.train_test_split(B.points(spark, sf), 90, 42)
    return split.select("system_id", "is_train")


@query
def make_grid(spark, sf):
    return G.make_grid(spark, GRID, G.cells_touched(B.systems(spark, sf), GRID))


@query
def convex_hull(spark, sf):
    return G.convex_hull(B.points(spark, sf)).select("x", "y")


@query
def knn(spark, sf):
    train, _ = B.train_test(spark, sf)
    rows = N.neighbor_rows(N.knn(N.grid_targets(_cells(spark)), train, 12))
    return rounded(rows.select(F.col("target_id").alias("cell_id"), "rank", F.col("id").alias("system_id"), "d"), 4)


@query
def radius_neighbors(spark, sf):
    train, _ = B.train_test(spark, sf)
    rows = N.radius_neighbors(train, 60000.0, 3, GRID)
    return rounded(rows.select(F.col("target_id").alias("cell_id"), F.col("id").alias("system_id"), "d"), 4)


@query
def zone_cells(spark, sf):
    return G.zone_cells(B.points(spark, sf), BUFFER, GRID)


@query
def idw_variable(spark, sf):
    train, _ = B.train_test(spark, sf)
    runs = [r for r in _idw_runs(spark) if r["type"] == "variable"]
    raster = I.idw_sweep(train, GRID, runs)
    return rounded(raster)


@query
def idw_fixed(spark, sf):
    train, _ = B.train_test(spark, sf)
    runs = [r for r in _idw_runs(spark) if r["type"] == "fixed"]
    return rounded(I.idw_sweep(train, GRID, runs))


@query
def natural_neighbor_grid(spark, sf):
    train, _ = B.train_test(spark, sf)
    return rounded(natural_neighbor(train, GRID))


# --- runs and evaluation -------------------------------------------------------------------------


@query
def run_grid(spark, sf):
    """Every run of every method for each dataset found in the samples."""
    datasets = P.with_dataset(_wanted(spark, sf)).select("dataset").distinct()
    datasets = materialize(datasets, "datasets")
    grids = [R.skip_long_lags(R.param_grid(datasets, m)) for m in ("IDW", "OK", "UK", "NN")]
    return R.with_run_id(reduce(DataFrame.unionByName, grids))


@query
def run_names(spark, sf):
    return R.with_run_id(R.with_run_name(B.run_log(spark, sf))).select("log_id", "out_name", "run_id")


@query
def replay_skip(spark, sf):
    return R.skip_long_lags(B.run_log(spark, sf), replay=True).select("log_id", "model", "lag_dist")


@query
def idw_sweep_metrics(spark, sf):
    """All 84 runs, scored at the cells of the test points and ranked."""
    train, test = B.train_test(spark, sf)
    ranked = W.sweep_and_rank(train, test, GRID, W.sweep_runs(spark, "IDW"), None)
    return rounded(ranked.select("run_id", "n", "rmse", "mae", "rmse_rank", "mae_rank", "ave_rank"))


@query
def idw_sweep_rasters(spark, sf):
    """All 84 rasters over the whole grid."""
    train, _ = B.train_test(spark, sf)
    return rounded(W.sweep(train, GRID, W.sweep_runs(spark, "IDW")).select("run_id", "cell_id", "value"))


@query
def extract_nearest_cell(spark, sf):
    raster, test = _idw_raster(spark, sf)
    return rounded(G.extract_at_points(raster, test.select("system_id", "x", "y"), GRID).select("run_id", "system_id", "prediction"))


@query
def zonal_mean(spark, sf):
    raster, test = _idw_raster(spark, sf)
    return rounded(G.zonal_mean(raster, G.zone_cells(test, BUFFER, GRID)))


@query
def obs_pred_pairs(spark, sf):
    return rounded(_idw_pairs(spark, sf))


@query
def error_metrics(spark, sf):
    return rounded(E.error_metrics(_idw_pairs(spark, sf)))


@query
def rank_runs(spark, sf):
    ranked = E.rank_runs(B.run_log(spark, sf), name="log_id")
    return ranked.select("log_id", "method", "dataset", "rmse_rank", "mae_rank", "ave_rank")


@query
def best_run(spark, sf):
    ranked = E.rank_runs(B.run_log(spark, sf), name="log_id")
    return E.best_run(ranked, name="log_id").select("method", "dataset", "log_id", "ave_rank")


@query
def top_runs(spark, sf):
    ranked = E.rank_runs(B.run_log(spark, sf), name="log_id")
    return E.top_runs(ranked, 75, name="log_id").select("method", "dataset", "log_id", "ave_rank")


@query
def row_slice(spark, sf):
    rows = E.row_slice(B.run_log(spark, sf), 1, 5, ["rmse", "log_id"], ["method", "dataset"])
    return rounded(rows.select("method", "dataset", "log_id", "rmse"))


@query
def replay_top_runs(spark, sf):
    """The 75 best IDW settings of PFOA_GW, run again on PFOS_GW."""
    train, test = B.train_test(spark, sf)
    ranked = W.sweep_and_rank(train, test, GRID, W.sweep_runs(spark, "IDW"), None)
    other_train, other_test = B.train_test(spark, sf, "PFOS", "GW")
    again = W.replay(ranked, 75, other_train, other_test, GRID, BUFFER)
    return rounded(again.select("run_id", "n", "rmse", "mae", "rmse_rank", "mae_rank", "ave_rank"))


def _all_datasets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Training and test points of all four datasets, prepared from the samples."""
    ready = materialize(_prepared(spark, sf, False).withColumnRenamed("mean_value", "z"), "prepared")
    columns = ("dataset", "system_id", "x", "y", "z")
    return ready.where("is_train").select(*columns), ready.where("NOT is_train").select(*columns)


@query
def idw_sweep_datasets(spark, sf):
    """All 84 runs of all four datasets in one job, on cells of 8,046.7 m."""
    train, test = _all_datasets(spark, sf)
    runs = W.sweep_runs(spark, "IDW")
    pairs = D.sweep_pairs(train, test, B.FINE, runs, None)
    ranked = D.rank_datasets(pairs, runs, test)
    return rounded(ranked.select("dataset", "run_id", "status", "n", "rmse", "mae", "rmse_rank", "mae_rank", "ave_rank"))


@query
def zonal_classes_datasets(spark, sf):
    """The five best settings of each dataset: means over five miles around the test points, classes, accuracy and recall."""
    train, test = _all_datasets(spark, sf)
    runs = W.sweep_runs(spark, "IDW")
    pairs = materialize(D.sweep_pairs(train, test, B.FINE, runs), "pairs")
    ranked = D.rank_datasets(pairs, runs, test)
    return rounded(D.top_class_scores(pairs, materialize(ranked, "ranked"), 5))


def _krige_datasets(spark: SparkSession, sf: str, method: str) -> DataFrame:
    """Every kriging run of a method for all four datasets in one job, at the cells of 8,046.7 m that hold the test points."""
    train, test = _all_datasets(spark, sf)
    runs = W.sweep_runs(spark, method)
    digits = DRIFT_DIGITS if method == "UK" else SOLVED_DIGITS
    return D.rank_datasets(D.sweep_pairs(train, test, B.FINE, runs, None), runs, test, digits)


@query
def ok_sweep_datasets(spark, sf):
    return rounded(_krige_datasets(spark, sf, "OK").select("dataset", "run_id", "status", "n", "rmse", "mae", "ave_rank"))


@query
def uk_sweep_datasets(spark, sf):
    """Scores to six digits: a drift of six terms through six places is solved to about nine."""
    ranked = _krige_datasets(spark, sf, "UK")
    return rounded(ranked.select("dataset", "run_id", "status", "n", "rmse", "mae", "ave_rank"), rmse=6, mae=6)


@query
def krige_replay_datasets(spark, sf):
    """The 75 best universal settings of PFOA_GW, run again on the three other datasets."""
    train, test = _all_datasets(spark, sf)
    ranked = materialize(_krige_datasets(spark, sf, "UK"), "ranked")
    again = D.replay_datasets(ranked, "PFOA_GW", 75, train, test, B.FINE, None, DRIFT_DIGITS)
    return rounded(again.select("dataset", "run_id", "status", "n", "rmse", "mae", "ave_rank"), rmse=6, mae=6)


@query
def failed_runs(spark, sf):
    """Quadratic drift from five points cannot be solved; the run keeps its row beside the others."""
    train, test = B.train_test(spark, sf)
    runs = R.with_run_id(
        R.with_run_name(
            spark.createDataFrame(
                [
                    ("IDW", None, "variable", 2.0, None, 12, None, None),
                    ("UK", "QuadDrift", "variable", None, 24000.0, 5, None, None),
                ],
                R.RUNS,
            )
        )
    )
    ranked = W.sweep_and_rank(train, test, GRID, materialize(runs, "runs"), None)
    return rounded(ranked.select("run_id", "status", "n", "rmse", "mae"))


@query
def classify2(spark, sf):
    return _filtered(spark, sf).select("row_id", S.classify(F.col("value"), S.TWO_CLASS_LIMITS).alias("cls"))


@query
def classify3(spark, sf):
    return _filtered(spark, sf).select("row_id", S.classify(F.col("value"), S.THREE_CLASS_LIMITS).alias("cls"))


@query
def confusion2(spark, sf):
    return E.confusion(E.classified(_idw_pairs(spark, sf), S.TWO_CLASS_LIMITS), 2)


@query
def confusion3(spark, sf):
    return E.confusion(E.classified(_idw_pairs(spark, sf), S.THREE_CLASS_LIMITS), 3)


@query
def accuracy_recall(spark, sf):
    pairs = materialize(_idw_pairs(spark, sf), "pairs")
    two = W.class_scores(pairs).withColumn("classes", F.lit(2))
    three = W.class_scores(pairs, S.THREE_CLASS_LIMITS).withColumn("classes", F.lit(3))
    return rounded(two.unionByName(three))


@query
def mean_performance(spark, sf):
    scores = W.class_scores(_idw_pairs(spark, sf), S.THREE_CLASS_LIMITS)
    return rounded(E.mean_performance(scores.withColumn("method", F.substring("run_id", 1, 5)), ["method"]))


# --- comparison ----------------------------------------------------------------------------------


@query
def value_shares(spark, sf):
    cols = ["type", "power", "num_points", "distance", "f_pts", "model", "lag_dist"]
    log = B.run_log(spark, sf).withColumns({c: F.col(c).cast("long") for c in ("distance", "lag_dist")})
    return rounded(C.value_shares(log.withColumn("power", F.col("power").cast("decimal(3,1)")), cols), 6)


@query
def map_replace_labels(spark, sf):
    path = F.concat(F.lit("C:/maps\\"), "method", F.lit("/"), F.col("log_id").cast("string"))
    short = F.regexp_replace("method", "IDW", "IDW_timing")
    return B.run_log(spark, sf).select(
        "log_id",
        S.map_values(F.col("lag_dist"), S.LAG_NAMES).alias("lag_mapped"),
        S.lag_name(F.col("lag_dist")).alias("lag_name"),
        S.replace_values(F.col("method"), S.METHOD_NAMES).alias("method_name"),
        S.basename(path).alias("base"),
        F.replace(short, F.lit("_timing"), F.lit("")).alias("short"),
        S.zfill(F.col("log_id").cast("string")).alias("padded"),
    )


def _method_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of the methods side by side, one row per dataset and parameter set."""
    stats = [("RMSE", "rmse"), ("MAE", "mae")]
    return (
        B.run_log(spark, sf)
        .groupBy("dataset", F.floor(F.col("log_id") / 100).alias("block"))
        .agg(
            *[
                F.max(F.when(F.col("method") == m, F.col(c))).alias(f"{m}_{s}_ppt")
                for m in ("IDW", "OK", "UK")
                for s, c in stats
            ]
        )
    )


@query
def melt_method_stats(spark, sf):
    """Without the two columns of the last method, as in the report."""
    wide = IO.slice_columns(_method_wide(spark, sf), None, -2)
    return rounded(C.melt_method_stats(wide, ["dataset", "block"]))


@query
def box_stats(spark, sf):
    long = C.melt_method_stats(_method_wide(spark, sf), ["dataset", "block"])
    return rounded(C.box_stats(long, ["dataset", "method", "metric"], "value"), 10)


@query
def timing_summary(spark, sf):
    log = B.run_log(spark, sf)
    gw = log.where(F.col("dataset").endswith("GW")).select(
        F.concat("method", F.lit("_timing")).alias("variable"), F.col("seconds").alias("value")
    )
    sw = log.where(F.col("dataset").endswith("SW")).select(
        S.replace_values(F.col("method"), {"OK": "Ord_Krig", "UK": "Univ_Krig"}).alias("Method"),
        F.col("seconds").alias("Time (s)"),
    )
    return rounded(C.timing_summary(gw, sw), 10)


def _means(spark: SparkSession, sf: str) -> DataFrame:
    return (
        P.with_dataset(_filtered(spark, sf))
        .groupBy("dataset", "system_id")
        .agg(F.round(F.avg("value"), 9).alias("mean_value"))
    )


@query
def rank_sums(spark, sf):
    return rounded(C.rank_sums(_means(spark, sf), "dataset", "mean_value"), 6)


@query
def kruskal(spark, sf):
    return rounded(C.kruskal(_means(spark, sf), "dataset", "mean_value"), 6)


@query
def dunn(spark, sf):
    return rounded(C.dunn(_means(spark, sf), "dataset", "mean_value"), 6)


# --- kriging -------------------------------------------------------------------------------------


@query
def semivariogram_bins(spark, sf):
    return rounded(semivariogram(B.points(spark, sf), ALL_LAGS))


@query
def fit_semivariograms(spark, sf):
    fits = fit_semivariogram(semivariogram(B.points(spark, sf), ALL_LAGS), MODELS)
    return rounded(fits, 10, misfit=8)


def _krige(spark: SparkSession, sf: str, models: list[str], num_points: int) -> DataFrame:
    train, _ = B.train_test(spark, sf)
    train = materialize(train, "train")
    drift = set(models) <= set(R.UNIVERSAL_MODELS)
    rows = [("UK" if drift else "OK", m, "variable", None, 24000.0, num_points, None, None) for m in models]
    runs = materialize(R.with_run_id(R.with_run_name(spark.createDataFrame(rows, R.RUNS))), "runs")
    return rounded(W.sweep(train, GRID, runs).select("run_id", "cell_id", "value", "variance", "status"), 8)


@query
def krige_ordinary(spark, sf):
    return _krige(spark, sf, list(R.ORDINARY_MODELS), 12)


@query
def krige_linear_drift(spark, sf):
    return _krige(spark, sf, ["LinearDrift"], 12)


@query
def krige_quadratic_drift(spark, sf):
    return _krige(spark, sf, ["QuadDrift"], 25)


def _some_krige_runs(spark: SparkSession) -> DataFrame:
    """Two models over the 12 nearest, and two over a radius with six places at least."""
    rows = [("OK", m, "variable", None, 24000.0, 12, None, None) for m in ("Spherical", "Linear")]
    rows += [("OK", m, "fixed", None, 24000.0, None, 80500.0, 6) for m in ("Spherical", "Exponential")]
    return materialize(R.with_run_id(R.with_run_name(spark.createDataFrame(rows, R.RUNS))), "runs")


@query
def krige_fixed(spark, sf):
    """Fixed search alone: all places within 80.5 km, six at least."""
    train = materialize(B.train_test(spark, sf)[0], "train")
    runs = _some_krige_runs(spark).where("type = 'fixed'")
    return rounded(W.sweep(train, GRID, runs).select("run_id", "cell_id", "value", "variance", "status"), 8)


@query
def krige_raster_resumed(spark, sf):
    """A sweep that stopped after its first run goes on; values and variances are read back."""
    train = materialize(B.train_test(spark, sf)[0], "train")
    runs, folder = _some_krige_runs(spark), _fresh(spark, "sweep")
    RS.sweep_to(folder, train, GRID, runs.where("model = 'Linear'"))
    RS.sweep_to(folder, train, GRID, runs, batch=1)
    return rounded(RS.read_sweep(spark, folder).select("run_id", "row", "col", "value", "variance", "status"), 8)


def _plain_model(points: DataFrame) -> dict:
    """Spherical model without nugget, range 200 km, with the variance of the data as its sill."""
    sill = points.agg(F.var_pop("z")).first()[0]
    return {"model": "Spherical", "a": 200000.0, "nugget": 0.0, "sill": sill}


@query
def krige_two_neighbors(spark, sf):
    """Two neighbours have a closed-form solution, which the SQL side computes."""
    train, _ = B.train_test(spark, sf)
    train = materialize(K.merge_places(train), "train")
    run = {"run_id": "two", "type": "variable", "num_points": 2, **_plain_model(train)}
    out = K.krige(N.knn(N.grid_targets(_cells(spark)), train, 2), [run])
    return rounded(out.select(F.col("target_id").alias("cell_id"), "value", "variance", "status"), 10)


@query
def krige_three_neighbors(spark, sf):
    """Every ordinary model on three neighbours, again with a closed form on the SQL side."""
    train, _ = B.train_test(spark, sf)
    train = materialize(K.merge_places(train), "train")
    total = _plain_model(train)["sill"]
    runs = [
        {"run_id": m, "model": m, "type": "variable", "num_points": 3, "a": 150000.0, "nugget": 0.1 * total, "sill": 0.9 * total}
        for m in R.ORDINARY_MODELS
    ]
    out = K.krige(N.knn(N.grid_targets(_cells(spark)), train, 3), runs)
    return rounded(out.select("run_id", F.col("target_id").alias("cell_id"), "value", "variance", "status"), 8)


@query
def krige_plane(spark, sf):
    """Linear drift from three neighbours is the plane through them."""
    train, _ = B.train_test(spark, sf)
    train = materialize(K.merge_places(train), "train")
    run = {"run_id": "plane", "type": "variable", "num_points": 3, **_plain_model(train), "model": "LinearDrift"}
    out = K.krige(N.knn(N.grid_targets(_cells(spark)), train, 3), [run])
    return rounded(out.select(F.col("target_id").alias("cell_id"), "value"), 8)


@query
def nn_metrics(spark, sf):
    """Natural neighbour scored at the test points; cells outside the hull give no pair."""
    train, test = B.train_test(spark, sf)
    ranked = W.sweep_and_rank(train, test, GRID, W.sweep_runs(spark, "NN"), None)
    return rounded(ranked.select("run_id", "status", "n", "rmse", "mae", "rmse_rank", "ave_rank"))


@query
def ok_sweep_metrics(spark, sf):
    """All 420 ordinary-kriging runs at the cells of the test points."""
    train, test = B.train_test(spark, sf)
    ranked = W.sweep_and_rank(train, test, GRID, W.sweep_runs(spark, "OK"), None, SOLVED_DIGITS)
    return rounded(ranked.select("run_id", "status", "n", "rmse", "mae", "ave_rank"))


@query
def uk_sweep_metrics(spark, sf):
    """All 200 universal-kriging runs at the cells of the test points."""
    train, test = B.train_test(spark, sf)
    ranked = W.sweep_and_rank(train, test, GRID, W.sweep_runs(spark, "UK"), None, SOLVED_DIGITS)
    return rounded(ranked.select("run_id", "status", "n", "rmse", "mae", "ave_rank"))


@query
def flagship(spark, sf):
    """Samples to scores: prepare, split, 12 nearest, IDW with power 2 at the test points."""
    train, test = B.train_test(spark, sf)
    targets = test.select(F.col("system_id").alias("target_id"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    run = Row(run_id="IDW_V_p2_np12", power=2.0, num_points=12)
    predicted = I.idw_variable(N.knn(targets, train, 12), [run]).select(
        "run_id", F.col("target_id").alias("system_id"), F.col("value").alias("prediction")
    )
    return rounded(E.error_metrics(E.pair_obs_pred(test, predicted)))
