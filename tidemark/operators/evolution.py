"""Genetic search with the population as rows: tournaments, crossover and mutation by seeded hashes, fitness by one backtest for all.

What is backtested travels as one row of monthly factor returns, so a generation is scored
by column expressions, whatever its size. Each draw is a hash of the seed, the generation,
the individual and the gene: the same seed gives the same rows, on any cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.shared import checkpointed

#: Individuals of a tournament; chances of a pair to cross and of a gene to change; the size of a change, of the range.
TOURNAMENT = 3
CROSS = 0.5
MUTATE = 0.2
STEP = 0.1


def drawn(seed: int, *of: Column | int | str) -> Column:
    """A uniform number of [0, 1) for these values."""
    return F.pmod(F.xxhash64(F.lit(seed), *[x if isinstance(x, Column) else F.lit(x) for x in of]), F.lit(1 << 52)) / float(1 << 52)


def _normal(seed: int, *of: Column | int | str) -> Column:
    return F.sqrt(-2 * F.ln(1 - drawn(seed, *of, "radius"))) * F.cos(2 * 3.141592653589793 * drawn(seed, *of, "angle"))


def factor_returns(rows: DataFrame, by: str, factors: list[str], target: str) -> DataFrame:
    """One row with months: the mean product of each factor and the return after, by date, in order of date: what a unit of the factor earned.

    A list of as many short arrays as there are dates; rows with a null among the columns are left out.
    """
    known = rows.na.drop(subset=[by, *factors, target])
    each = known.groupBy(by).agg(F.array(*[F.avg(F.col(f) * F.col(target)) for f in factors]).alias("earned"))
    return each.agg(F.transform(F.array_sort(F.collect_list(F.struct(by, "earned"))), lambda m: m["earned"]).alias("months"))


def sharpe(genes: Column, months: Column, periods: float = 12.0) -> Column:
    """Yearly ratio of the monthly returns of factor weights, scaled by the weights' absolute sum; null without two months or spread."""
    size = F.aggregate(genes, F.lit(0.0), lambda a, g: a + F.abs(g))
    earned = F.transform(months, lambda m: F.aggregate(F.zip_with(genes, m, lambda g, r: g * r), F.lit(0.0), lambda a, x: a + x) / size)
    n = F.size(earned)
    total = F.aggregate(earned, F.lit(0.0), lambda a, x: a + x)
    squares = F.aggregate(earned, F.lit(0.0), lambda a, x: a + x * x)
    var = (squares - total * total / n) / (n - 1)
    return F.when((n > 1) & (var > 1e-18), total / n / F.sqrt(var) * periods**0.5)


def begun(spark: SparkSession, n: int, ranges: list[tuple[float, float]], seed: int) -> DataFrame:
    """The first generation: k and genes drawn from their ranges."""
    genes = F.array(*[low + (high - low) * drawn(seed, 0, F.col("k"), j) for j, (low, high) in enumerate(ranges)])
    return spark.range(n).select(F.col("id").alias("k"), genes.alias("genes"))


def bred(scored: DataFrame, n: int, ranges: list[tuple[float, float]], seed: int, generation: int) -> DataFrame:
    """The next generation of ``scored`` (k, genes, fitness): the best goes on unchanged as 0, the others come from tournaments.

    A slot draws TOURNAMENT individuals and keeps the fittest (ties: the lower k); slots
    2m and 2m + 1 swap the genes between two points by chance; genes change by chance.
    """
    spark = scored.sparkSession
    slots = spark.range(n).select(F.col("id").alias("slot"), F.explode(F.array(*[F.floor(drawn(seed, generation, F.col("id"), "draw", i) * n) for i in range(TOURNAMENT)])).alias("k"))
    rank = F.struct(F.coalesce("fitness", F.lit(float("-inf"))), -F.col("k"))
    picked = slots.join(scored, "k").groupBy("slot").agg(F.max_by("genes", rank).alias("genes"))
    pair = F.floor(F.col("slot") / 2)
    mate = picked.select((F.col("slot") + 1 - 2 * (F.col("slot") % 2)).alias("slot"), F.col("genes").alias("other"))
    size = len(ranges)
    ends = [F.floor(drawn(seed, generation, pair, "cut", i) * (size + 1)) for i in (0, 1)]
    cross = F.when((drawn(seed, generation, pair, "cross") < CROSS) & F.col("other").isNotNull(), True).otherwise(False)
    made = []
    for j, (low, high) in enumerate(ranges):
        swapped = cross & (F.least(*ends) <= j) & (F.greatest(*ends) > j)
        gene = F.when(swapped, F.get("other", F.lit(j))).otherwise(F.get("genes", F.lit(j)))
        moved = gene + _normal(seed, generation, F.col("slot"), j) * STEP * (high - low)
        gene = F.when(drawn(seed, generation, F.col("slot"), j, "mutate") < MUTATE, moved).otherwise(gene)
        made.append(F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), gene)))
    children = picked.join(mate, "slot", "left").select(F.col("slot").alias("k"), F.array(*made).alias("genes"))
    best = scored.agg(F.max_by("genes", rank).alias("genes")).select(F.lit(0).cast("long").alias("k"), "genes")
    return children.where("k > 0").union(best)


def evolved(months: DataFrame, ranges: list[tuple[float, float]], n: int = 40, generations: int = 5, seed: int = 42) -> DataFrame:
    """generation, k, genes, fitness of every individual of every generation; ``months`` is the row of :func:`factor_returns`."""
    spark = months.sparkSession
    months = checkpointed(months)
    people, out = begun(spark, n, ranges, seed), None
    for g in range(generations):
        scored = checkpointed(people.join(F.broadcast(months)).select("k", "genes", sharpe(F.col("genes"), F.col("months")).alias("fitness")))
        part = scored.select(F.lit(g).alias("generation"), "k", "genes", "fitness")
        out = part if out is None else out.union(part)
        people = bred(scored, n, ranges, seed, g + 1)
    return out
