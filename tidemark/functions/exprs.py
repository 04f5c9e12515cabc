"""Scalar building blocks as Column functions; nothing here leaves whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def clip(x: Column, low: float, high: float) -> Column:
    """x held between two bounds; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def interp(x: Column, low: float, high: float, to_low: float = 0.0, to_high: float = 100.0) -> Column:
    """Linear between (low, to_low) and (high, to_high), flat outside."""
    return to_low + clip((x - low) / (high - low), 0.0, 1.0) * (to_high - to_low)


def finite(x: Column) -> Column:
    """x, or 0 where it is null, NaN or infinite."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def six(x: Column) -> Column:
    """x rounded to six places."""
    return F.round(x, 6)


#: Coefficients of the rational approximation 26.2.17 of the normal distribution function
#: (Abramowitz and Stegun, error below 7.5e-8).
CDF_P, CDF_B = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
#: Coefficients of the rational approximation 26.2.23 of its inverse (error below 4.5e-4).
PPF_C, PPF_D = (2.515517, 0.802853, 0.010328), (1.432788, 0.189269, 0.001308)


def norm_pdf(x: Column, mean: Column | float = 0.0, sd: Column | float = 1.0) -> Column:
    """Gaussian density."""
    z = (x - mean) / sd
    return F.exp(-z * z / 2) / (sd * (2 * 3.141592653589793) ** 0.5)


def norm_cdf(x: Column) -> Column:
    """Normal distribution function."""
    t = 1 / (1 + CDF_P * F.abs(x))
    poly = t * (CDF_B[0] + t * (CDF_B[1] + t * (CDF_B[2] + t * (CDF_B[3] + t * CDF_B[4]))))
    upper = F.exp(-x * x / 2) / (2 * 3.141592653589793) ** 0.5 * poly
    return F.when(x >= 0, 1 - upper).otherwise(upper)


def norm_ppf(p: Column) -> Column:
    """Inverse normal distribution function, for 0 < p < 1."""
    tail = F.least(p, 1 - p)
    t = F.sqrt(-2 * F.ln(tail))
    z = t - (PPF_C[0] + t * (PPF_C[1] + t * PPF_C[2])) / (1 + t * (PPF_D[0] + t * (PPF_D[1] + t * PPF_D[2])))
    return F.when(p < 0.5, -z).otherwise(z)


def cdf_sql(x: str) -> str:
    """DuckDB's form of :func:`norm_cdf`."""
    t = f"(1/(1+{CDF_P}*abs({x})))"
    poly = f"{t}*({CDF_B[0]}+{t}*({CDF_B[1]}+{t}*({CDF_B[2]}+{t}*({CDF_B[3]}+{t}*{CDF_B[4]}))))"
    upper = f"exp(-({x})*({x})/2)/sqrt(2*pi())*({poly})"
    return f"(CASE WHEN ({x}) >= 0 THEN 1-({upper}) ELSE {upper} END)"


def ppf_sql(p: str) -> str:
    """DuckDB's form of :func:`norm_ppf`."""
    t = f"sqrt(-2*ln(least({p},1-({p}))))"
    z = f"({t}-({PPF_C[0]}+{t}*({PPF_C[1]}+{t}*{PPF_C[2]}))/(1+{t}*({PPF_D[0]}+{t}*({PPF_D[1]}+{t}*{PPF_D[2]}))))"
    return f"(CASE WHEN ({p}) < 0.5 THEN -{z} ELSE {z} END)"
