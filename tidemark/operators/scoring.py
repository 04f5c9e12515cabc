"""Named features and weights: which columns a score is made of, in which order they are computed, and what each counts for."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: Default weights of the factors by category, and what a market regime multiplies them by.
FACTORS = {
    "quality": ("fundamental", 1.0), "value": ("fundamental", 1.0), "momentum": ("technical", 0.8), "volatility": ("technical", 0.6),
    "sentiment": ("sentiment", 0.7), "capital_flow": ("alternative", 0.8), "supply_chain": ("ml_derived", 0.5), "residual_alpha": ("ml_derived", 1.0),
}
MULTIPLIERS = {"Bull": {"momentum": 1.2, "value": 0.8}, "Bear": {"momentum": 0.5, "value": 1.3, "quality": 1.2}, "Neutral": {}}
#: Weights that a ranking adds to those of the regime, and the share of a learnt score in it.
ADDED, LEARNT = {"revisions": 0.10, "advanced_rotation": 0.10}, 0.4
#: The scorecard's weights, the scores of its classes, and where it buys and sells.
CARD = {"rrg_position": 0.25, "rsl_rank": 0.20, "mrs_signal": 0.20, "volume_pattern": 0.20, "fundamental_momentum": 0.15}
QUADRANTS = {"leading": 1.0, "improving": 0.5, "weakening": -0.5, "lagging": -1.0}
SIGNALS = {"breakout": 1.0, "improving": 0.5, "weakening": -0.5, "lagging": -1.0}
PATTERNS = {"rejection": 1.0, "absorption": 0.5, "distribution": -0.8, "none": 0.0}
BUY, SELL = 0.6, -0.3


@dataclass(frozen=True)
class Feature:
    """A column by name: what builds it, the features it reads, and what is known about it."""

    build: Callable[[], Column]
    needs: tuple[str, ...] = ()
    category: str = "technical"
    lookback: int = 1


class Features:
    """Features by name. ``computed`` adds those that are asked for, and what they need, as columns of one plan."""

    def __init__(self) -> None:
        self.held: dict[str, Feature] = {}

    def register(self, name: str, needs: tuple[str, ...] = (), category: str = "technical", lookback: int = 1) -> Callable:
        """Decorator of a function that returns the feature's column; a name is registered once."""

        def keep(build: Callable[[], Column]) -> Callable[[], Column]:
            if name in self.held:
                raise ValueError(f"feature {name} is registered already")
            self.held[name] = Feature(build, needs, category, lookback)
            return build

        return keep

    def levels(self, wanted: list[str] | None = None) -> dict[str, int]:
        """Each feature with the length of its longest chain of needs; unknown names and circles are errors."""
        found: dict[str, int] = {}

        def level(name: str, above: tuple[str, ...]) -> int:
            if name in above:
                raise ValueError(f"features need each other: {' > '.join((*above, name))}")
            if name not in self.held:
                raise ValueError(f"unknown feature {name}")
            if name not in found:
                found[name] = 1 + max((level(n, (*above, name)) for n in self.held[name].needs), default=-1)
            return found[name]

        for name in self.held if wanted is None else wanted:
            level(name, ())
        return found

    def computed(self, rows: DataFrame, wanted: list[str] | None = None) -> DataFrame:
        """rows with a column for each feature, a projection a level; one whose columns are missing is null, as are those above it."""
        at = self.levels(wanted)
        for k in range(max(at.values(), default=-1) + 1):
            rows = rows.withColumns({n: self._column(rows, n) for n, level in at.items() if level == k})
        return rows

    def _column(self, rows: DataFrame, name: str) -> Column:
        """The feature's column if the rows can give it. Only the plan is analysed; errors of data stay errors."""
        column = self.held[name].build()
        try:
            rows.select(column).schema  # noqa: B018 (analysed here)
        except AnalysisException:
            return F.lit(None).cast("double")
        return column

    def catalogue(self, spark: SparkSession) -> DataFrame:
        """name, category, lookback, level: a row a feature."""
        rows = [(n, self.held[n].category, self.held[n].lookback, k) for n, k in self.levels().items()]
        return spark.createDataFrame(rows, "name string, category string, lookback int, level int")


def effective_weights(spark: SparkSession, own: dict[str, float] | None = None, off: tuple[str, ...] = ()) -> DataFrame:
    """regime, factor, category, weight: the default or the user's ``own`` weight, 0 for factors that are ``off``, times the regime's multiplier."""
    own = own or {}
    if wrong := [n for n in (*own, *off) if n not in FACTORS] + [n for n, w in own.items() if w < 0]:
        raise ValueError(f"no such factor, or a weight below 0: {', '.join(wrong)}")
    rows = [
        (regime, name, category, 0.0 if name in off else own.get(name, weight) * times.get(name, 1.0))
        for regime, times in MULTIPLIERS.items()
        for name, (category, weight) in FACTORS.items()
    ]
    return spark.createDataFrame(rows, "regime string, factor string, category string, weight double")


def composite(narrow: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """keys, regime, score: the weighted mean of the factors (keys, factor, value) that are there, under each regime's weights.

    Weights are a few dozen rows by construction, so they are broadcast.
    """
    both = narrow.where("value IS NOT NULL").join(F.broadcast(weights.where("weight > 0")), "factor")
    return both.groupBy(*keys, "regime").agg(F.try_divide(F.sum(F.col("value") * F.col("weight")), F.sum("weight")).alias("score"))


def looked_up(values: dict[str, float], x: Column) -> Column:
    """The value of a class by name; null for null, 0 for a class that isn't known."""
    out = F.when(x.isNull(), F.lit(None).cast("double"))
    for name, value in values.items():
        out = out.when(x == name, value)
    return out.otherwise(0.0)


def complete(weights: dict[str, float]) -> bool:
    """Whether weights add up to 1 within a thousandth."""
    return abs(sum(weights.values()) - 1) < 0.001


def confidence(sharpe: Column) -> Column:
    """What a model's Sharpe ratio multiplies positions by: half at 0, at most 1.2; 1 where it isn't known."""
    return F.coalesce(F.greatest(F.lit(0.5), F.least(F.lit(1.2), 0.5 + 0.5 * sharpe)), F.lit(1.0))


#: The groups of an attribution and the names of metadata that stand for each, the first one there counts; a score from which a position's conviction is high, and medium.
GROUPS = {"value": ("upside", "valuation_composite"), "momentum": ("vsm",), "quality": ("qmj", "roe"), "low_risk": ("bab",), "sentiment": ("revisions", "sentiment")}
HIGH, MEDIUM = 2.0, 1.0


def attributed(targets: DataFrame, signals: DataFrame) -> DataFrame:
    """date, a column for each of GROUPS, high, medium, low: the targets' weighted means of what their signals' metadata (JSON) say, by date, and how many positions have which conviction.

    Weights are shares of all targets of the date, with or without a signal; a name that is not in the
    metadata, or no number, counts 0. A position without a signal has a score of 0. Dates whose weights add up to 0 get 0.
    """
    own = signals.select("date", "ticker", "score", F.from_json("metadata", "map<string,string>").alias("said"))
    rows = targets.select("date", "ticker", "weight").join(own, ["date", "ticker"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))

    def mean(names: tuple[str, ...]) -> Column:
        said = F.coalesce(*[F.try_element_at("said", F.lit(n)).try_cast("double") for n in names], F.lit(0.0))
        return F.coalesce(F.try_divide(F.sum(F.col("weight") * said), F.sum("weight")), F.lit(0.0))

    counts = {"high": F.col("score") >= HIGH, "medium": (F.col("score") >= MEDIUM) & (F.col("score") < HIGH), "low": F.col("score") < MEDIUM}
    return rows.groupBy("date").agg(*[mean(n).alias(g) for g, n in GROUPS.items()], *[F.count_if(c).alias(k) for k, c in counts.items()])
