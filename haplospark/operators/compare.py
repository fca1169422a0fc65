"""Comparing two tables of association statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that say which variant a row is, those compared, and p-values, which are only reported.
IDENTITY = ("SNP", "CHR", "BP", "GENPOS", "ALLELE1", "ALLELE0", "F_MISS")
NUMERIC = ("A1FREQ", "CHISQ_LINREG", "BETA", "SE", "CHISQ_BOLT_LMM_INF")
P_VALUES = ("P_LINREG", "P_BOLT_LMM_INF")


@dataclass(frozen=True)
class Tolerances:
    """(relative, absolute) by column."""

    frequency: tuple[float, float] = (0.0, 5e-7)
    statistic: tuple[float, float] = (5e-4, 5e-6)

    def of(self, column: str) -> tuple[float, float]:
        return self.frequency if column == "A1FREQ" else self.statistic


def number(c: Column) -> Column:
    """A text column as numbers; -nan, as some writers put it, is not a number."""
    text = F.lower(c.cast("string"))
    return F.when(text.isin("nan", "-nan"), F.lit(float("nan"))).otherwise(text.try_cast("double"))


def _measures(r: Column, a: Column, name: str = "") -> list[Column]:
    """Aggregates over the pairs of which both are numbers: n, max_abs, median_abs, p99_abs, max_rel, median_rel, p99_rel, pearson."""
    both = ~F.isnan(r) & ~F.isnan(a)
    gap = F.when(both, F.abs(a - r))
    rel = F.when(both, F.abs(a - r) / F.greatest(F.abs(r), F.lit(1e-300)))
    share = lambda c, q: F.percentile(c, q)
    found = {
        "n": F.count(gap), "max_abs": F.max(gap), "median_abs": share(gap, 0.5), "p99_abs": share(gap, 0.99), "max_rel": F.max(rel), "median_rel": share(rel, 0.5), "p99_rel": share(rel, 0.99),
        "pearson": F.corr(F.when(both, r), F.when(both, a)),
    }
    return [c.alias(f"{name}{k}") for k, c in found.items()]


def difference(pairs: DataFrame, reference: str, actual: str) -> DataFrame:
    """One row: the measures of two columns."""
    return pairs.select(number(F.col(reference)).alias("r"), number(F.col(actual)).alias("a")).agg(*_measures(F.col("r"), F.col("a")))


def _near(r: Column, a: Column, rtol: float, atol: float) -> Column:
    return F.coalesce(~F.isnan(a - r) & (F.abs(a - r) <= atol + rtol * F.abs(r)), F.lit(False)) | r.eqNullSafe(a)


def compare_stats(reference: DataFrame, actual: DataFrame, tolerances: Tolerances | None = None) -> dict:
    """Summary of two tables that have a ``row`` ordinal besides their columns, from one aggregation over their join by row.

    status: ok, row_count_mismatch, missing_required_columns (an identity column), or identity_mismatch; with
    ``tolerances`` also passed.
    """
    shared = [c for c in (*IDENTITY, *NUMERIC, *P_VALUES) if c in reference.columns and c in actual.columns]
    lost = sorted({*IDENTITY, *NUMERIC, *P_VALUES} - set(shared))
    side = lambda df, mark: df.select("row", F.lit(True).alias(mark), *[(F.col(c) if c in IDENTITY else number(F.col(c))).alias(f"{mark}_{c}") for c in shared])
    both = side(reference, "r").join(side(actual, "a"), "row", "full")
    differs = F.lit(False)
    for c in shared:
        if c in IDENTITY:
            differs = differs | ~F.col(f"r_{c}").eqNullSafe(F.col(f"a_{c}"))
    numbers, measures = [c for c in shared if c not in IDENTITY], []
    for c in numbers:
        measures += _measures(F.col(f"r_{c}"), F.col(f"a_{c}"), f"{c}.")
        if tolerances and c in NUMERIC:
            measures.append(F.count_if(~_near(F.col(f"r_{c}"), F.col(f"a_{c}"), *tolerances.of(c))).alias(f"{c}.off"))
    got = both.agg(F.count("r").alias("r"), F.count("a").alias("a"), F.count_if(differs).alias("differ"), *measures).first().asDict()
    out: dict = {"status": "ok", "reference_rows": got["r"], "actual_rows": got["a"], "identity_mismatches": []}
    if lost:
        out["missing_columns"] = lost
    if got["r"] != got["a"]:
        out["status"] = "row_count_mismatch"
    elif set(lost) & set(IDENTITY):
        out["status"] = "missing_required_columns"
    elif got["differ"]:
        out["status"] = "identity_mismatch"
        out["identity_mismatches"] = [x["row"] for x in both.where(differs).orderBy("row").limit(20).collect()]
    else:
        for c in numbers:
            out[c] = {k.split(".", 1)[1]: v for k, v in got.items() if k.startswith(f"{c}.") and not k.endswith(".off")}
            if tolerances and c in NUMERIC:
                out[c]["passed"] = got[f"{c}.off"] == 0
    if tolerances:
        out["passed"] = out["status"] == "ok" and not lost and all(out[c]["passed"] for c in NUMERIC)
    return out
