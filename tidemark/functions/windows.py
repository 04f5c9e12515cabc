"""Window specifications that operators share, so that one exchange and one sort serve them all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_ticker() -> WindowSpec:
    """Rows of a ticker in order of date."""
    return Window.partitionBy("ticker").orderBy("date")


def last_n(n: int, by: WindowSpec | None = None) -> WindowSpec:
    """The row and the n - 1 before it."""
    return (by or by_ticker()).rowsBetween(1 - n, 0)


def so_far(by: WindowSpec | None = None) -> WindowSpec:
    """All rows up to the row."""
    return (by or by_ticker()).rowsBetween(Window.unboundedPreceding, 0)


def whole(*keys: str) -> WindowSpec:
    """All rows of a key."""
    return Window.partitionBy(*keys)


def rolling(f: Callable[[Column], Column], x: Column, n: int, least: int | None = None) -> Column:
    """f over the last n rows, null until ``least`` (n unless given) values are there."""
    w = last_n(n)
    return F.when(F.count(x).over(w) >= (n if least is None else least), f(x).over(w))


def change(x: Column, n: int = 1) -> Column:
    """x over its value n rows before, less 1; null at first and where that is 0."""
    return F.try_divide(x, F.lag(x, n).over(by_ticker())) - 1


class Rolling:
    """Values about each row of a ticker, as windows."""

    def now(self, c: str) -> Column:
        """A column of the row."""
        return F.col(c)

    def before(self, c: str, n: int) -> Column:
        """A column n rows before."""
        return F.lag(c, n).over(by_ticker())

    def over(self, n: int, f: Callable[..., Column], *xs: Column | str) -> Column:
        """f of the row and the n - 1 before it."""
        return f(*xs).over(last_n(n))

    def rolling(self, f: Callable[[Column], Column], x: Column, n: int) -> Column:
        """f over the last n rows, null where fewer have a value."""
        return F.when(self.over(n, F.count, x) >= n, self.over(n, f, x))


class Ending(Rolling):
    """The same about a ticker's last row alone, as aggregates of rows that :func:`placed` gives: each row is added once, where a frame is summed anew for every row."""

    def now(self, c: str) -> Column:
        return self.before(c, 0)

    def before(self, c: str, n: int) -> Column:
        return F.max(F.when(F.col("place") == n + 1, F.col(c)))

    def over(self, n: int, f: Callable[..., Column], *xs: Column | str) -> Column:
        return f(*[F.when(F.col("place") <= n, F.col(x) if isinstance(x, str) else x) for x in xs])


class Running(Rolling):
    """The same as differences of a ticker's running sums: each row is added once, where a frame is summed anew for every row. What is no sum is read from the frame."""

    def over(self, n: int, f: Callable[..., Column], *xs: Column | str) -> Column:
        cols = [F.col(x) if isinstance(x, str) else x for x in xs]
        there = cols[0].isNotNull()
        for x in cols[1:]:
            there = there & x.isNotNull()

        def total(x: Column) -> Column:
            x = F.when(there, x)
            return F.coalesce(F.sum(x).over(so_far()), F.lit(0.0)) - F.coalesce(F.sum(x).over(by_ticker().rowsBetween(Window.unboundedPreceding, -n)), F.lit(0.0))

        k = total(F.lit(1.0))
        if f is F.count:
            return k
        if f is F.sum:
            return F.when(k > 0, total(cols[0]))
        if f is F.avg:
            return F.try_divide(total(cols[0]), k)
        if f in (F.var_pop, F.var_samp, F.stddev_pop, F.stddev_samp):
            x = cols[0].cast("double")
            rest = F.greatest(total(x * x) - F.try_divide(total(x) * total(x), k), F.lit(0.0))
            var = F.try_divide(rest, k if f in (F.var_pop, F.stddev_pop) else k - 1)
            return var if f in (F.var_pop, F.var_samp) else F.sqrt(var)
        if f in (F.covar_pop, F.covar_samp):
            x, y = (c.cast("double") for c in cols)
            return F.try_divide(total(x * y) - F.try_divide(total(x) * total(y), k), k if f is F.covar_pop else k - 1)
        return super().over(n, f, *xs)


ROLLING, ENDING, RUNNING = Rolling(), Ending(), Running()


def filled(x: Column) -> Column:
    """x or its last value before."""
    return F.last(x, ignorenulls=True).over(so_far())


def rank_share(x: Column, *keys: str) -> Column:
    """Average rank over count, as a share of 1 (ties share their mean rank)."""
    w = Window.partitionBy(*keys).orderBy(x)
    ties = F.count("*").over(Window.partitionBy(*keys, x))
    return (F.rank().over(w) + (ties - 1) / 2) / F.count("*").over(whole(*keys))


def rolled(rows: DataFrame, wide: int, **sums: Column) -> DataFrame:
    """rows with the sum of each expression over a ticker's last ``wide`` rows, as the difference of two running sums.

    Each row is added once, where a frame is summed anew for every row.
    """
    running = rows.select("*", *[F.coalesce(F.sum(x).over(so_far()), F.lit(0.0)).alias(f"_{k}") for k, x in sums.items()])
    before = {k: F.coalesce(F.lag(f"_{k}", wide).over(by_ticker()), F.lit(0.0)) for k in sums}
    return running.select("*", *[(F.col(f"_{k}") - before[k]).alias(k) for k in sums]).drop(*[f"_{k}" for k in sums])


def month_ends(rows: DataFrame) -> DataFrame:
    """Each ticker's last row of a month, with as_of, the month's last day.

    Read off the ticker's next row, so rows that lie by ticker in order of date are neither shuffled nor sorted.
    """
    rows = rows.withColumn("as_of", F.last_day("date"))
    more, then = F.lead(F.lit(1)).over(by_ticker()), F.lead("as_of").over(by_ticker())
    return rows.withColumn("_last", more.isNull() | ~F.col("as_of").eqNullSafe(then)).where("_last").drop("_last")


def placed(rows: DataFrame, n: int) -> DataFrame:
    """The last n rows of each ticker with their place, 1 for the last."""
    latest = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))
    return rows.withColumn("place", latest).where(F.col("place") <= n)


def recent(rows: DataFrame, n: int) -> DataFrame:
    """The last n rows of each ticker."""
    return placed(rows, n).drop("place")
