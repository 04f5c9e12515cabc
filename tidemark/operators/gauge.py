"""A market's risk gauge: the last values of daily series, scored from 0 to 100, averaged by weight and rated."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import interp, ratio
from tidemark.functions.windows import whole


class Ladder(NamedTuple):
    """A score runs straight from point to point and is flat outside; from ``high`` on risk is high, from ``middle`` on neutral."""

    weight: float
    points: tuple[tuple[float, float], ...] = ((0.0, 0.0), (100.0, 100.0))
    high: float = 76.0
    middle: float = 45.0


#: Weights, score points and signal bounds of the seven indicators. ``deviation`` (percentile of the distance from
#: the 200-day mean) and ``smart_money`` (that distance itself) are taken of a series' history, the others are last values.
LADDERS = {
    "deviation": Ladder(1.5),
    "volatility": Ladder(1.0, ((10.0, 100.0), (12.0, 80.0), (18.0, 40.0), (38.0, 0.0))),
    "yield_10y": Ladder(0.8, ((2.0, 100.0), (5.0, 0.0))),
    "smart_money": Ladder(1.2, ((-0.1, 0.0), (0.1, 100.0))),
    "put_call": Ladder(1.0, ((0.6, 100.0), (1.2, 0.0)), 70.0, 40.0),
    "rate_3m": Ladder(0.8, ((2.0, 100.0), (5.5, 0.0))),
    "fear_greed": Ladder(2.0),
}
#: A composite above each bound has its rating.
RATINGS = ((75.0, "Extreme Greed / Bubble Risk"), (55.0, "Greed / Elevated Risk"), (45.0, "Neutral"), (25.0, "Fear / Undervalued"))
LOWEST = "Extreme Fear / Opportunity"
LONG, YEARS = 200, 10


def along(x: Column, points: tuple[tuple[float, float], ...]) -> Column:
    """x's height on the line through ``points``, flat beyond both ends."""
    out = F.lit(points[0][1])
    for (a, low), (b, high) in zip(points, points[1:], strict=False):
        out = out + interp(x, a, b, 0.0, high - low)
    return out


def indicators(series: DataFrame, keys: list[str]) -> DataFrame:
    """keys, name, value, score, signal, weight: a row for each series of (keys, name, date, value) that LADDERS knows.

    Null values are left out. The deviation's score is the share of its last ten years' days
    that lie below the last one (days before the 200th lie nowhere); smart_money has no row
    before its 201st day. A series is a row a day, so a window over one is small.
    """
    at = Window.partitionBy(*keys, "name").orderBy("date")
    last = F.max("date").over(whole(*keys, "name"))
    rows = series.where(F.col("value").isNotNull() & F.col("name").isin(*LADDERS)).withColumn("end", last)
    rows = rows.where(F.col("date") > F.add_months("end", -12 * YEARS)).withColumn("k", F.row_number().over(at))
    mean = F.when(F.col("k") >= LONG, F.avg("value").over(at.rowsBetween(1 - LONG, 0)))
    rows = rows.withColumn("away", ratio(F.col("value") - mean, mean))
    rows = rows.withColumn("now", F.max(F.when(F.col("date") == F.col("end"), F.col("away"))).over(whole(*keys, "name")))
    ends = rows.groupBy(*keys, "name").agg(F.max_by("value", "date").alias("last"), F.max("now").alias("now"), (100 * F.avg(F.coalesce(F.col("away") < F.col("now"), F.lit(False)).cast("double"))).alias("below"), F.count("*").alias("n"))
    ends = ends.where((F.col("name") != "smart_money") | (F.col("n") > LONG))
    shown = F.when(F.col("name") == "deviation", 100 * F.col("now")).otherwise(F.col("last"))
    scored = F.when(F.col("name") == "deviation", F.col("below")).when(F.col("name") == "smart_money", F.col("now")).otherwise(F.col("last"))
    score, weight, high, middle = (F.lit(None).cast("double") for _ in range(4))
    for name, x in LADDERS.items():
        own = F.col("name") == name
        score, weight = F.when(own, along(scored, x.points)).otherwise(score), F.when(own, x.weight).otherwise(weight)
        high, middle = F.when(own, x.high).otherwise(high), F.when(own, x.middle).otherwise(middle)
    out = ends.select(*keys, "name", shown.alias("value"), score.alias("score"), weight.alias("weight"), high.alias("high"), middle.alias("middle"))
    signal = F.when(F.col("score") >= F.col("high"), "High Risk").when(F.col("score") >= F.col("middle"), "Neutral").otherwise("Low Risk")
    return out.select(*keys, "name", "value", "score", signal.alias("signal"), "weight")


def composite(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, score, rating: the weighted mean of the indicators that there are."""
    total = F.sum(F.col("score") * F.col("weight")) / F.sum("weight")
    rows = found.where("score IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("n"), total.alias("total"))
    rating = F.lit(LOWEST)
    for bound, name in reversed(RATINGS):
        rating = F.when(F.col("total") > bound, name).otherwise(rating)
    return rows.select(*keys, "n", F.round("total", 1).alias("score"), rating.alias("rating"))
