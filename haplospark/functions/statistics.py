"""Chi-square tails and the text formats of association tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Statistic of a variant that takes part in no test.
BAD_STATISTIC = -1e9


def chi2_tail(x: float | None) -> float | None:
    """P(chi-square with one degree of freedom > x)."""
    if x is None or math.isnan(x):
        return None
    return 1.0 if x <= 0 else math.erfc(math.sqrt(x / 2))


def six_digits(x: float) -> str:
    return f"{float(x):.6g}"


def p_text(p: float, statistic: float) -> str:
    """One digit behind the point; where p underflows, from the tail's asymptote p = sqrt(2 / (pi x)) exp(-x / 2)."""
    if p:
        return f"{p:.1E}"
    log10p = (math.log(2 / (math.pi * statistic)) - statistic) / (2 * math.log(10))
    power = math.floor(log10p)
    digits = 10.0 ** (log10p - power)
    if digits >= 9.95:
        digits, power = 1.0, power + 1
    return f"{digits:.1f}E{power}"


@F.pandas_udf(DoubleType())
def _chi2_tail(x: pd.Series) -> pd.Series:
    from math import erfc

    v = x.to_numpy(dtype=float)
    return pd.Series(np.array([erfc(math.sqrt(t / 2)) if t > 0 else 1.0 if t <= 0 else np.nan for t in v]))


@F.pandas_udf(StringType())
def _six_digits(x: pd.Series) -> pd.Series:
    return x.map(six_digits)


@F.pandas_udf(StringType())
def _all_digits(x: pd.Series) -> pd.Series:
    return x.map(lambda v: f"{float(v):.17g}", na_action="ignore")


@F.pandas_udf(StringType())
def _p_text(p: pd.Series, statistic: pd.Series) -> pd.Series:
    return pd.Series([p_text(a, b) for a, b in zip(p, statistic, strict=True)], dtype=object)


def chi2_sf(x: Column) -> Column:
    """``chi2_tail`` as an Arrow-batched column; Spark has no error function."""
    return _chi2_tail(x)


def g6(x: Column) -> Column:
    """``six_digits`` as a column (the JVM's %g keeps trailing zeros)."""
    return _six_digits(x)


def g17(x: Column) -> Column:
    """17 significant digits, as C writes them."""
    return _all_digits(x.cast("double"))


def p_value_text(p: Column, statistic: Column) -> Column:
    return _p_text(p, statistic)


def log_delta(h2: float, x_norm2_sum: float, variants: float, dim: float) -> float:
    """Log of the ratio of noise to genetic variance at heritability ``h2``."""
    return math.log(x_norm2_sum / (variants * dim) * (1 - h2) / h2)


def heritability(log_ratio: float, x_norm2_sum: float, variants: float, dim: float) -> float:
    return x_norm2_sum / (x_norm2_sum + variants * dim * math.exp(log_ratio))


def register(spark: SparkSession) -> None:
    """Make ``chi2_sf``, ``g6`` and ``p_value_text`` callable from SQL."""
    for name, f in (("chi2_sf", _chi2_tail), ("g6", _six_digits), ("p_value_text", _p_text)):
        spark.udf.register(name, f)
