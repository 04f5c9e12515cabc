"""Cross-sections: cleaning, weighting, blending and ranking of factors by date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import ratio
from tidemark.functions.windows import whole
from tidemark.operators.relational import winsorised  # noqa: F401 (used and offered here)

#: Weights of the factors by market regime.
REGIME_WEIGHTS = {
    "Bull": {"vsm": 0.22, "bab": 0.06, "qmj": 0.15, "upside": 0.15, "pead": 0.12, "sentiment": 0.13, "capital_flow": 0.12, "accruals": 0.05, "ivol": 0.00},
    "Bear": {"vsm": 0.06, "bab": 0.20, "qmj": 0.28, "upside": 0.12, "pead": 0.10, "sentiment": 0.11, "capital_flow": 0.08, "accruals": 0.05, "ivol": 0.00},
    "Transition": {"vsm": 0.15, "bab": 0.15, "qmj": 0.20, "upside": 0.15, "pead": 0.10, "sentiment": 0.10, "capital_flow": 0.10, "accruals": 0.05, "ivol": 0.00},
    "Unknown": {"vsm": 0.18, "bab": 0.12, "qmj": 0.20, "upside": 0.15, "pead": 0.09, "sentiment": 0.11, "capital_flow": 0.10, "accruals": 0.05, "ivol": 0.00},
}
#: Width of the quartile range in standard deviations of a normal distribution.
QUARTILES_WIDE = 1.35


def z_score(x: str, *by: str) -> Column:
    """x against its group in sample deviations; 0 without spread, null stays null."""
    w = whole(*by)
    return F.when(F.col(x).isNotNull(), F.coalesce(ratio(F.col(x) - F.avg(x).over(w), F.stddev_samp(x).over(w)), F.lit(0.0)))


def robust_z(rows: DataFrame, by: list[str], x: str, out: str) -> DataFrame:
    """rows with x against its group's median in quartile ranges / 1.35; 0 where the range is next to nothing."""
    ends = rows.groupBy(*by).agg(F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    wide = F.col("_q")[2] - F.col("_q")[0]
    score = F.when(wide < 1e-10, 0.0).otherwise((F.col(x) - F.col("_q")[1]) / (wide / QUARTILES_WIDE))
    return rows.join(ends, by).withColumn(out, score).drop("_q")


def neutral(x: str, *by: str) -> Column:
    """x less its group's mean."""
    return F.col(x) - F.avg(x).over(whole(*by))


def cleaned(rows: DataFrame, by: list[str], sector: str, columns: list[str]) -> DataFrame:
    """rows with z_<c> (winsorised, standardised) and z_<c>_neutral (less the sector's mean) for each column."""
    held = winsorised(rows, by, columns).select("*", *[z_score(c, *by).alias(f"z_{c}") for c in columns])
    return held.select("*", *[neutral(f"z_{c}", *by, sector).alias(f"z_{c}_neutral") for c in columns])


def weighted(weights: dict[str, float]) -> Column:
    """Weighted mean of the columns that aren't null, the weights of the others shared out; 0 if all are null."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))
    share = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    return F.coalesce(F.try_divide(total, share), F.lit(0.0))


def ranked(rows: DataFrame, by: list[str], score: str, tie: str = "ticker") -> DataFrame:
    """rows with rank: unique, from the highest score, ties by ``tie``."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie)))


def bucketed(x: Column) -> Column:
    """The conviction that a score of 0 to 1 stands for."""
    return F.when(x >= 0.8, "very high").when(x >= 0.6, "high").when(x >= 0.4, "medium").otherwise("low")
