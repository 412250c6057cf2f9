"""Column expressions. All are built-in functions, so they stay inside generated code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# They decide which rows and classes come out.
NON_DETECT = 0.004 * (1 / 3)
SUMMER_MONTHS = (6, 7, 8)
WINTER_MONTHS = (12, 1, 2)
TWO_CLASS_LIMITS = (0.004,)
THREE_CLASS_LIMITS = (0.004, 0.01)
LAG_NAMES = {8000.0: "8", 16000.0: "16", 20000.0: "20", 24000.0: "24"}
DEFAULT_LAG_NAME = "Arc"
METHOD_NAMES = {"OK": "OrdKrig", "Ord_Krig": "OrdKrig", "UK": "UnivKrig", "Univ_Krig": "UnivKrig"}


def impute(value: Column, fill: float = NON_DETECT) -> Column:
    """A missing result is a non-detect."""
    return F.coalesce(value, F.lit(fill))


def parse_date(text: Column, strict: bool = True) -> Column:
    """``m/d/Y`` with one- or two-digit months. Strict: a bad date fails the query (ANSI mode)."""
    return F.to_date(text, "M/d/yyyy") if strict else F.try_to_date(text, "M/d/yyyy")


def season(date: Column) -> Column:
    """``sum`` for June-August, ``win`` for December-February, NULL for the other months."""
    m = F.month(date)
    return F.when(m.isin(*SUMMER_MONTHS), "sum").when(m.isin(*WINTER_MONTHS), "win")


def zfill(text: Column, width: int = 5) -> Column:
    """Pad with zeros on the left; longer text stays whole."""
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/\\]*$", 0)


def _literal_map(pairs: Mapping) -> Column:
    return F.create_map(*[F.lit(v) for kv in pairs.items() for v in kv])


def map_values(key: Column, pairs: Mapping) -> Column:
    """Look up; a value without an entry becomes NULL."""
    return F.try_element_at(_literal_map(pairs), key)


def replace_values(key: Column, pairs: Mapping) -> Column:
    """Look up; a value without an entry stays as it is."""
    return F.coalesce(map_values(key, pairs), key)


def lag_name(lag: Column) -> Column:
    """Label of a lag distance in run names; NULL lag means the default lag."""
    return F.when(lag.isNull(), DEFAULT_LAG_NAME).otherwise(map_values(lag, LAG_NAMES))


def classify(value: Column, limits: Sequence[float]) -> Column:
    """Class number. The first limit belongs to the class above it, later limits to the class below."""
    first, *rest = limits
    out = F.when(value < first, 0)
    for number, limit in enumerate(rest, start=1):
        out = out.when(value <= limit, number)
    return out.when(value.isNotNull(), len(limits))


def extract_group(text: Column, pattern: str) -> Column:
    """First capture group, NULL without a match."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def whole(value: Column) -> Column:
    """Number printed without its fraction, as run names do."""
    return value.cast("long").cast("string")


# Run-name prefixes of the kriging models.
KRIGE_PREFIX = {
    "Spherical": "Sp",
    "Circular": "Cir",
    "Exponential": "Ex",
    "Gaussian": "Ga",
    "Linear": "Ln",
    "LinearDrift": "Ln",
    "QuadDrift": "Qu",
}


def idw_run_name(kind: Column, power: Column, num_points: Column, distance: Column, f_pts: Column) -> Column:
    """``V_p2_np12`` or ``F_p2_d16km_np6``; the power loses its fraction in the name only."""
    variable = F.concat(F.lit("V_p"), whole(power), F.lit("_np"), whole(num_points))
    fixed = F.concat(
        F.lit("F_p"), whole(power), F.lit("_d"), whole(distance / 1000), F.lit("km_np"), whole(f_pts)
    )
    return F.when(kind == "variable", variable).otherwise(fixed)


def krige_run_name(
    model: Column, kind: Column, lag: Column, num_points: Column, distance: Column, f_pts: Column
) -> Column:
    """``SpV_lag8km_np12`` or ``SpF_lag8km_d16km_np6``."""
    head = F.concat(
        map_values(model, KRIGE_PREFIX),
        F.when(kind == "variable", "V").otherwise("F"),
        F.lit("_lag"),
        lag_name(lag),
        F.lit("km_"),
    )
    variable = F.concat(F.lit("np"), whole(num_points))
    fixed = F.concat(F.lit("d"), whole(distance / 1000), F.lit("km_np"), whole(f_pts))
    return F.concat(head, F.when(kind == "variable", variable).otherwise(fixed))
