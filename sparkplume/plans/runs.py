"""Parameter sweeps as rows: one row per run, unused parameters NULL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkplume.functions import scalars as S

# The parameter lists of the sweeps.
IDW_POWERS = (0.5, 1.0, 2.0, 3.0)
IDW_NUM_POINTS = (5, 12, 25, 50, 100)
IDW_MIN_POINTS = (2, 6, 12, 24)
DISTANCES = (16000.0, 40250.0, 80500.0, 161000.0)
KRIGE_NUM_POINTS = (12, 25, 50, 100)
KRIGE_MIN_POINTS = (6, 12, 24, 50)
LAGS = (8000.0, 16000.0, 20000.0, 24000.0, None)
ORDINARY_MODELS = ("Spherical", "Circular", "Exponential", "Gaussian", "Linear")
UNIVERSAL_MODELS = ("LinearDrift", "QuadDrift")
SWEEP_LAG_LIMIT = 18000.0
REPLAY_LAG_SKIPPED = 24000.0

MAX_RUNS = 20_000

RUNS = T.StructType(
    [
        T.StructField("method", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("power", T.DoubleType()),
        T.StructField("lag_dist", T.DoubleType()),
        T.StructField("num_points", T.LongType()),
        T.StructField("distance", T.DoubleType()),
        T.StructField("f_pts", T.LongType()),
    ]
)


def _values(values: Sequence, dtype: str) -> Column:
    return F.array(*[F.lit(v).cast(dtype) for v in values])


def _cross(df: DataFrame, **lists: tuple[Sequence, str]) -> DataFrame:
    """Cartesian product with short parameter lists, one explode per list."""
    for name, (values, dtype) in lists.items():
        df = df.withColumn(name, F.explode(_values(values, dtype)))
    return df


def param_grid(base: DataFrame, method: str) -> DataFrame:
    """Every combination of the method's parameters for each row of ``base``.

    ``base`` holds one row per dataset (or a single row). ``method`` is IDW, OK, UK or NN.
    """
    own = [c for c in base.columns]
    if method == "IDW":
        fixed = _cross(base, power=(IDW_POWERS, "double"), distance=(DISTANCES, "double"), f_pts=(IDW_MIN_POINTS, "long"))
        variable = _cross(base, power=(IDW_POWERS, "double"), num_points=(IDW_NUM_POINTS, "long"))
        model = None
    elif method in ("OK", "UK"):
        models = ORDINARY_MODELS if method == "OK" else UNIVERSAL_MODELS
        modelled = _cross(base, model=(models, "string"))
        fixed = _cross(
            modelled, distance=(DISTANCES, "double"), f_pts=(KRIGE_MIN_POINTS, "long"), lag_dist=(LAGS, "double")
        )
        variable = _cross(modelled, num_points=(KRIGE_NUM_POINTS, "long"), lag_dist=(LAGS, "double"))
    elif method == "NN":
        return _shaped(base.withColumn("method", F.lit("NN")), own)
    else:
        raise ValueError(f"unknown method {method!r}")
    runs = fixed.withColumn("type", F.lit("fixed")).unionByName(
        variable.withColumn("type", F.lit("variable")), allowMissingColumns=True
    )
    return _shaped(runs.withColumn("method", F.lit(method)), own)


def _shaped(runs: DataFrame, own: list[str]) -> DataFrame:
    for field in RUNS:
        if field.name not in runs.columns:
            runs = runs.withColumn(field.name, F.lit(None).cast(field.dataType))
    return with_run_name(runs.select(*own, *[f.name for f in RUNS]))


def run_name(method: Column | None = None) -> Column:
    m = F.col("method")
    idw = S.idw_run_name(F.col("type"), F.col("power"), F.col("num_points"), F.col("distance"), F.col("f_pts"))
    krige = S.krige_run_name(
        F.col("model"), F.col("type"), F.col("lag_dist"), F.col("num_points"), F.col("distance"), F.col("f_pts")
    )
    return F.when(m == "IDW", idw).when(m == "NN", F.lit("NatN_Int")).otherwise(krige)


def with_run_name(runs: DataFrame) -> DataFrame:
    return runs.withColumn("out_name", run_name())


def with_run_id(runs: DataFrame) -> DataFrame:
    """Unique key. Powers 0.5 and 0 share an ``out_name``, so the true power is part of the id."""
    power = F.when(F.col("power").isNull(), "").otherwise(F.concat(F.lit("_"), F.col("power").cast("string")))
    return runs.withColumn("run_id", F.concat(F.col("method"), F.lit("_"), F.col("out_name"), power))


def skip_long_lags(runs: DataFrame, replay: bool = False) -> DataFrame:
    """Exponential and Gaussian models leave out long lags: above 18 km when sweeping, 24 km when replaying."""
    lag = F.col("lag_dist")
    long_lag = lag == REPLAY_LAG_SKIPPED if replay else lag > SWEEP_LAG_LIMIT
    skipped = F.col("model").isin("Exponential", "Gaussian") & F.coalesce(long_lag, F.lit(False))
    return runs.where(~F.coalesce(skipped, F.lit(False)))


def invalid_runs(runs: DataFrame) -> DataFrame:
    """Rows that describe no run; callers check this before the work starts."""
    kind = F.col("type")
    needs = (
        ((kind == "variable") & F.col("num_points").isNull())
        | ((kind == "fixed") & (F.col("distance").isNull() | F.col("f_pts").isNull()))
        | ((F.col("method") == "IDW") & F.col("power").isNull())
        | (F.col("method").isin("OK", "UK") & ~F.coalesce(F.col("model").isin(*ORDINARY_MODELS, *UNIVERSAL_MODELS), F.lit(False)))
        | ((F.col("method") != "NN") & ~F.coalesce(kind.isin("fixed", "variable"), F.lit(False)))
    )
    return runs.where(F.coalesce(needs, F.lit(False)))


def run_rows(runs: DataFrame) -> list[Row]:
    """Runs as driver values: parameters only, and never more than ``MAX_RUNS`` of them."""
    rows = runs.limit(MAX_RUNS + 1).collect()
    if len(rows) > MAX_RUNS:
        raise ValueError(f"more than {MAX_RUNS} runs; pass them in batches")
    return rows


def single(spark: SparkSession) -> DataFrame:
    """One row without columns of interest, to build a parameter grid for a single dataset."""
    return spark.range(1).select(F.lit("all").alias("dataset"))
