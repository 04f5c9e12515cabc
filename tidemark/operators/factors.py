"""Alpha factors of a ticker's bars, as columns over shared windows: one exchange and one sort serve a panel of them."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import clip, interp, ratio
from tidemark.functions.windows import ROLLING, Rolling, by_ticker, last_n, rolling, so_far, whole
from tidemark.shared import checkpointed, laid_out

YEAR = 252


def _lag(c: str, n: int) -> Column:
    return F.lag(c, n).over(by_ticker())


def _moved(at: Rolling, n: int) -> Column:
    return F.try_divide(at.now("close"), at.before("close", n)) - 1


def high_momentum(at: Rolling = ROLLING) -> Column:
    """Close against the highest close of 252 rows: 70 % scores 0, 100 % scores 100."""
    return interp(ratio(at.now("close"), at.rolling(F.max, F.col("close"), YEAR)), 0.70, 1.0)


def vol_scaled_momentum(at: Rolling = ROLLING) -> Column:
    """252-row change over annualised volatility; 0 where there is less history."""
    return F.coalesce(ratio(_moved(at, YEAR), at.rolling(F.stddev_samp, F.col("ret"), YEAR) * YEAR**0.5), F.lit(0.0))


def vol_targeted_momentum(at: Rolling = ROLLING) -> Column:
    """12-1 momentum at a 12 % volatility target, volatility of the last 60 returns (population)."""
    vol = at.over(60, F.stddev_pop, "ret") * YEAR**0.5
    return F.when(at.over(253, F.count, "close") >= 253, momentum_12m(at) * ratio(F.lit(0.12), vol))


def vol_scaled_total(at: Rolling = ROLLING) -> Column:
    """Compounded return of 252 rows over annualised volatility."""
    total = F.exp(at.over(YEAR, F.sum, F.ln(1 + F.col("ret")))) - 1
    return F.when(at.over(YEAR, F.count, "ret") >= YEAR, ratio(total, at.over(YEAR, F.stddev_samp, "ret") * YEAR**0.5))


def betting_against_beta(mixed: bool = False, at: Rolling = ROLLING) -> Column:
    """Minus beta over 252 rows of ret and mkt; ``mixed`` divides a sample covariance by a population variance."""
    var = at.over(YEAR, F.var_pop if mixed else F.var_samp, "mkt")
    return F.when(at.over(YEAR, F.count, "ret") >= 200, -ratio(at.over(YEAR, F.covar_samp, "ret", "mkt"), var))


def momentum_difference(at: Rolling = ROLLING) -> Column:
    """12-month less 1-month return."""
    return (ratio(at.now("close"), at.before("close", 251)) - 1) - (ratio(at.now("close"), at.before("close", 20)) - 1)


def momentum_12m(at: Rolling = ROLLING) -> Column:
    return ratio(at.before("close", 20), at.before("close", 251)) - 1


def momentum_6m(at: Rolling = ROLLING) -> Column:
    return ratio(at.now("close"), at.before("close", 125)) - 1


def volatility_60d(at: Rolling = ROLLING) -> Column:
    return at.rolling(F.stddev_samp, F.col("ret"), 59) * YEAR**0.5


def idiosyncratic_vol(at: Rolling = ROLLING) -> Column:
    """Minus the annualised spread of the residuals of ret on mkt, last 21 rows: sqrt(var (1 - corr^2))."""
    rest = at.over(21, F.var_pop, "ret") * (1 - F.pow(at.over(21, F.corr, "ret", "mkt"), 2))
    return F.when(at.over(21, F.count, "ret") >= 21, -F.sqrt(F.greatest(rest, F.lit(0.0))) * YEAR**0.5)


def amihud(at: Rolling = ROLLING) -> Column:
    """Mean absolute return a unit of turnover, last 21 rows, times 1e6."""
    return 1e6 * at.over(21, F.avg, ratio(F.abs("ret"), F.col("close") * F.col("volume")))


def obv() -> Column:
    """On-balance volume: volume signed by the close's direction, summed."""
    return F.sum(F.when(F.col("ret").isNull(), 0.0).otherwise(F.sign("ret") * F.col("volume"))).over(so_far())


def obv_z(at: Rolling = ROLLING) -> Column:
    """On-balance volume (column obv) against its last 252 rows (20 at least), within 5 deviations."""
    z = ratio(at.now("obv") - at.over(YEAR, F.avg, "obv"), at.over(YEAR, F.stddev_samp, "obv"))
    return F.when(at.over(YEAR, F.count, "obv") >= 20, clip(F.coalesce(z, F.lit(0.0)), -5.0, 5.0)).otherwise(0.0)


def obv_trend(band: float = 0.01, at: Rolling = ROLLING) -> tuple[Column, Column]:
    """Least-squares slope of the last 20 values over their mean size, and its class."""
    size = at.over(20, F.avg, F.abs("obv"))
    slope = F.when(at.over(20, F.count, "obv") >= 20, ratio(at.over(20, F.covar_pop, "k", "obv"), at.over(20, F.var_pop, "k")) / F.nullif(size, F.lit(0.0)))
    return slope, F.when(slope > band, "rising").when(slope < -band, "falling").otherwise("flat")


def money_flow_index(n: int = 14) -> Column:
    """Money flow index of columns up and down (typical price times volume on rising and falling rows), 50 while warming up."""
    up, down = F.sum("up").over(last_n(n)), F.sum("down").over(last_n(n))
    index = F.when(down == 0, F.when(up == 0, 50.0).otherwise(100.0)).otherwise(100 - 100 / (1 + ratio(up, down)))
    return F.when(F.row_number().over(by_ticker()) <= n, 50.0).otherwise(index)


def with_flows(bars: DataFrame) -> DataFrame:
    """Bars with k (place), typical price, up and down flows and obv."""
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    rows = bars.withColumn("typical", typical).withColumn("was", F.lag("typical").over(by_ticker()))
    flow = F.col("typical") * F.col("volume")
    return rows.select(
        "*", F.row_number().over(by_ticker()).cast("double").alias("k"), obv().alias("obv"),
        F.when(F.col("typical") > F.col("was"), flow).otherwise(0.0).alias("up"), F.when(F.col("typical") < F.col("was"), flow).otherwise(0.0).alias("down"),
    )


def swings(rows: DataFrame, reach: int = 5, size: float = 0.02) -> DataFrame:
    """Rows whose high (low) is the extreme of ``reach`` bars either side, in a 20-bar range of at least ``size``."""
    near, trail = by_ticker().rowsBetween(-reach, reach), last_n(20)
    full = F.count("*").over(near) == 2 * reach + 1
    wide = ratio(F.max("high").over(trail) - F.min("low").over(trail), F.min("low").over(trail)) >= size
    out = rows.withColumns({"swing_high": full & wide & (F.col("high") == F.max("high").over(near)), "swing_low": full & wide & (F.col("low") == F.min("low").over(near))})
    return out.where("swing_high OR swing_low")


def divergences(found: DataFrame, indicator: str) -> DataFrame:
    """ticker, kind, confidence: the last two swing lows (highs) where price and indicator part ways."""
    sides = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(flag).alias("found"), F.col(price).alias("p")) for kind, flag, price in (("bullish", "swing_low", "low"), ("bearish", "swing_high", "high"))])
    # one pass over the swings for both kinds: what they are found from is worked out once
    last = found.select("ticker", "date", F.col(indicator).alias("i"), F.inline(sides)).where("found")
    last = last.withColumn("n", F.row_number().over(Window.partitionBy("ticker", "kind").orderBy(F.desc("date")))).where("n <= 2")
    two = last.groupBy("ticker", "kind").agg(*[F.max(F.when(F.col("n") == k, F.col(c))).alias(f"{c}{k}") for c in "pi" for k in (1, 2)])
    dp, di = ratio(F.col("p1") - F.col("p2"), F.abs("p2")), ratio(F.col("i1") - F.col("i2"), F.abs("i2"))
    parts = F.when(F.col("kind") == "bullish", (dp < 0) & (di > 0)).otherwise((dp > 0) & (di < 0))
    return two.where(parts).select("ticker", "kind", F.least(F.lit(1.0), (F.abs(dp) + F.abs(di)) / 0.1).alias("confidence"))


def levy(n: int = 130, at: Rolling = ROLLING) -> Column:
    """Close over its mean of n rows."""
    return ratio(at.now("close"), at.rolling(F.avg, F.col("close"), n))


def with_mansfield(rows: DataFrame, n: int = YEAR) -> DataFrame:
    """Rows (close, level: the market's level) with rs, mansfield, slope5 and crossed (-1, 0, 1)."""
    out = rows.withColumn("rs", ratio(F.col("close"), F.col("level")))
    out = out.withColumn("mansfield", 100 * (ratio(F.col("rs"), rolling(F.avg, F.col("rs"), n)) - 1))
    was = _lag("mansfield", 1)
    return out.withColumns({
        "slope5": (F.col("mansfield") - _lag("mansfield", 5)) / 5,
        "crossed": F.when((was <= 0) & (F.col("mansfield") > 0), 1).when((was >= 0) & (F.col("mansfield") < 0), -1).otherwise(0),
    })


def volume_structure(n: int = 20, least: int = 5, burst: float = 2.0) -> tuple[Column, Column]:
    """Volume against its last n rows in deviations, and the pattern: rejection before absorption before distribution."""
    w = last_n(n)
    z = F.when(F.count("volume").over(w) >= least, F.coalesce(ratio(F.col("volume") - F.avg("volume").over(w), F.stddev_samp("volume").over(w)), F.lit(0.0))).otherwise(0.0)
    place = ratio(F.col("close") - F.col("low"), F.col("high") - F.col("low"))
    low, high = F.col("low") <= F.min("low").over(w), F.col("high") >= F.max("high").over(w)
    pattern = (
        F.when((z > burst) & low & (place >= 0.75), "rejection")
        .when((z > burst) & (F.abs(F.coalesce("ret", F.lit(0.0))) < 0.005), "absorption")
        .when((z > burst) & high & (place <= 0.25), "distribution")
        .otherwise("none")
    )
    return z, pattern


def relative_rotation(pairs: DataFrame, n: int = 14) -> DataFrame:
    """Rows (sector, date, price, base) with ratio, momentum, quadrant, the quadrant before and score.

    The ratio is the n-row mean of 100 price / base over its mean of the first n rows; momentum its n-row change.
    """
    w = Window.partitionBy("sector").orderBy("date")
    rows = pairs.withColumns({"raw": ratio(F.col("price"), F.col("base")), "k": F.row_number().over(w)})
    first = F.avg(F.when(F.col("k") <= n, F.col("raw"))).over(whole("sector"))
    rows = rows.withColumn("ratio", F.when(F.col("k") >= n, 100 * F.avg(ratio(F.col("raw"), first)).over(w.rowsBetween(1 - n, 0))))
    rows = rows.withColumn("momentum", 100 * F.try_divide(F.col("ratio"), F.lag("ratio", n).over(w)))
    up, fast = F.col("ratio") >= 100, F.col("momentum") >= 100
    rows = rows.where("momentum IS NOT NULL").withColumn("quadrant", F.when(up & fast, "leading").when(up, "weakening").when(fast, "improving").otherwise("lagging"))
    score = F.when(F.col("quadrant") == "leading", 1.0).when(F.col("quadrant") == "improving", 0.5).when(F.col("quadrant") == "weakening", -0.5).otherwise(-1.0)
    return rows.select("sector", "date", "ratio", "momentum", "quadrant", F.lag("quadrant").over(w).alias("before"), score.alias("score"))


def triple_barrier(rows: DataFrame, horizon: int = 20, up: float = 2.0, down: float = 2.0, span: int = 20, keep: tuple[str, ...] = ()) -> DataFrame:
    """ticker, date, label, touched, ret: which barrier the next ``horizon`` closes touch first (1 gain, -1 loss, 0 none); and the columns to ``keep``.

    Barriers lie at multiples of the last ``span`` returns' spread; on a tie the loss wins. Each close ahead
    is a column, so no list is made for a row.
    """
    w, close = by_ticker(), F.col("close")
    steps = range(1, horizon + 1)
    last = F.last(F.struct("date", "close")).over(w.rowsBetween(1, horizon))
    ahead = {f"_c{j}": F.lead("close", j).over(w) for j in steps} | {f"_d{j}": F.lead("date", j).over(w) for j in steps}
    out = rows.withColumns({"vol": rolling(F.stddev_samp, F.col("ret"), span), "_any": F.lead(F.lit(1)).over(w), "_end": last, **ahead}).where("vol IS NOT NULL AND _any IS NOT NULL")

    def touches(j: int) -> Column:
        move = F.col(f"_c{j}") / close - 1
        return F.abs(move) >= F.lit(up) * F.col("vol") if up == down else (move >= up * F.col("vol")) | (move <= -down * F.col("vol"))

    def hit(c: str) -> Column:  # a barrier is touched by closes there are, so none is null where one is touched
        return F.coalesce(*[F.when(touches(j), F.col(f"_{c}{j}")) for j in steps])

    return out.select(
        "ticker", "date", *keep, F.coalesce(F.sign(hit("c") - close).cast("int"), F.lit(0)).alias("label"),
        hit("d").alias("touched"), (F.coalesce(hit("c"), F.col("_end.close")) / close - 1).alias("ret"),
    )


def propagated(edges: DataFrame, signal: DataFrame, rounds: int = 2, decay: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """by, ticker, value: a signal spread over a graph, each round adding decay^(k + 1) times the neighbours' weighted mean.

    edges: ticker, other, weight in both directions; neighbours outside the signal's universe don't count.
    ``by`` names columns of the signal, such as its date: each of their values is a signal of its own over the same graph.
    """
    keys = [*(by or []), "ticker"]
    now = signal.select(*keys, "value")
    if by:
        return _propagated_by(edges, now, rounds, decay, by)
    for k in range(rounds):
        seen = edges.join(now.select(*keys[:-1], F.col("ticker").alias("other"), F.col("value").alias("v")), "other")
        mean = seen.groupBy(*keys).agg(F.try_divide(F.sum(F.col("weight") * F.col("v")), F.sum("weight")).alias("m"))
        now = now.join(mean, keys, "left").select(*keys, (F.col("value") + decay ** (k + 1) * F.coalesce("m", F.lit(0.0))).alias("value"))
    return now


#: Values of ``by`` that one edge carries together.
BLOCK = 12
#: A graph of n names is cut into cells by sqrt(n / NAMES) groups of names on either side, ``GROUPS`` at least.
NAMES, GROUPS = 1600, 4
#: Edges whose values a task multiplies at once: they stay in its cache.
AT_ONCE = 8192


def _packed(edges: DataFrame, groups: int, kind: str) -> DataFrame:
    """cell, tickers, others and, as bytes, the first edge of each ticker, each edge's place among others and its weight: a row a cell, edges met twice added up."""

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        weight = rows["weight"].fill_null(0.0).to_numpy()
        names, ticker = np.unique(rows["ticker"].to_numpy(), return_inverse=True)
        others, at = np.unique(rows["other"].to_numpy(), return_inverse=True)
        place = ticker.astype(np.int64) * len(others) + at
        if (weight == weight[0]).all():  # numbers alone sort much faster than weights in their order
            place.sort()
        else:
            order = place.argsort()
            place, weight = place[order], weight[order]
        new = np.flatnonzero(np.diff(place, prepend=-1))
        place, weight = place[new], np.add.reduceat(weight, new)
        first = np.searchsorted(place, np.arange(len(names)) * len(others)).astype(np.int64)
        held = [zlib.compress(x.tobytes(), 1) for x in (first, (place % len(others)).astype(np.int32), weight)]
        return pa.table({"cell": [key[0]], "tickers": pa.array([names]), "others": pa.array([others]), **{n: [b] for n, b in zip(("first", "at", "weight"), held, strict=True)}})

    def group(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(groups))

    ids = edges.na.drop(subset=["ticker", "other"]).select(F.col("ticker").cast(kind).alias("ticker"), F.col("other").cast(kind).alias("other"), F.col("weight").cast("double").alias("weight"))
    cells = ids.select((group("ticker") * groups + group("other")).cast("int").alias("cell"), "ticker", "other", "weight")
    out = cells.groupBy("cell").applyInArrow(pack, f"cell int, tickers array<{kind}>, others array<{kind}>, first binary, at binary, weight binary")
    return laid_out(out.repartition("cell"))


def _met(packed: DataFrame, wide: DataFrame, groups: int, columns: list[str]) -> DataFrame:
    """ticker, block and s_<column>: for each cell that a ticker is in, what its neighbours there have of the columns, times the edges' weights; null counts as 0."""
    kind = wide.schema["ticker"].dataType.simpleString()
    out = ["ticker", "block", *[f"s_{c}" for c in columns]]
    schema = f"ticker {kind}, block int, {', '.join(f'{c} double' for c in out[2:])}"

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        for k in range(left.num_rows if right.num_rows else 0):
            tickers, others = left["tickers"][k].values, left["others"][k].values.to_numpy(zero_copy_only=False)
            first, at, weight = (np.frombuffer(zlib.decompress(left[c][k].as_py()), t) for c, t in (("first", np.int64), ("at", np.int32), ("weight", np.float64)))
            ends = np.append(first[1:], len(at))
            ids, blocks = right["ticker"].to_numpy(), right["block"].to_numpy()
            place = np.searchsorted(others, ids)
            there = others[np.minimum(place, len(others) - 1)] == ids
            told = np.column_stack([right[c].cast(pa.float64()).fill_null(0.0).to_numpy() for c in columns])
            for block in np.unique(blocks):
                mine = there & (blocks == block)
                values, sums = np.zeros((len(others), len(columns))), np.empty((len(first), len(columns)))
                values[place[mine]] = told[mine]
                a = 0
                while a < len(first):
                    b = max(a + 1, int(np.searchsorted(ends, first[a] + AT_ONCE, "right")))
                    of = slice(first[a], ends[b - 1])
                    each = np.take(values, at[of], axis=0)
                    each *= weight[of, None]
                    sums[a:b] = np.add.reduceat(each, first[a:b] - first[a], axis=0)
                    a = b
                found.append(pa.table([tickers, pa.array(np.full(len(first), block, np.int32)), *map(pa.array, sums.T)], out))
        return pa.concat_tables(found) if found else pa.table([pa.array([], t) for t in (right.schema.field("ticker").type, pa.int32(), *[pa.float64()] * len(columns))], out)

    group = F.pmod(F.xxhash64("ticker"), F.lit(groups))
    asked = wide.where("ticker IS NOT NULL").select(F.explode(F.expr(f"sequence(0, {groups - 1})")).alias("_of"), group.alias("_group"), "ticker", "block", *columns)
    asked = asked.select((F.col("_of") * groups + F.col("_group")).cast("int").alias("cell"), "ticker", "block", *columns)
    return packed.groupBy("cell").cogroup(asked.groupBy("cell")).applyInArrow(meet, schema)


def _propagated_by(edges: DataFrame, now: DataFrame, rounds: int, decay: float, by: list[str]) -> DataFrame:
    """:func:`propagated` for many signals over one graph: an edge is met once for ``BLOCK`` of them, not once for each.

    The values of ``by`` are numbered; a name's signals lie side by side, with how many rows each has. Edges
    lie in cells by a group of names on either side, from which one row a name and block comes back, so what
    is shuffled grows with names and groups, not with edges and signals; edges move once.
    """
    place = F.row_number().over(Window.orderBy(*by)) - 1  # over the distinct values of by alone
    places = now.select(*by).na.drop().distinct().select(*by, F.floor(place / BLOCK).cast("int").alias("block"), (place % BLOCK).alias("at"))
    rows = checkpointed(now.join(F.broadcast(places), by, "left"))
    each = range(BLOCK)

    def told(name: str, f: Callable[[Column], Column]) -> list[Column]:
        return [f(F.col("at") == j).alias(f"{name}{j}") for j in each]

    # the sum of a name's values, how many rows it has, and how many with a value
    sides = [*told("v", lambda at: F.sum(F.when(at, F.col("value")))), *told("n", F.count_if), *told("c", lambda at: F.count(F.when(at, F.col("value"))))]
    wide = rows.where("block IS NOT NULL").groupBy("ticker", "block").agg(*sides).withColumns({f"a{j}": F.lit(0.0) for j in each})
    packed = None
    for k in range(rounds):
        wide = checkpointed(wide)
        if packed is None:
            groups = max(GROUPS, math.ceil((wide.select("ticker").distinct().count() / NAMES) ** 0.5))
            packed = _packed(edges, groups, wide.schema["ticker"].dataType.simpleString())
        seen = _met(packed, wide, groups, [f"{c}{j}" for c in "vn" for j in each])
        sums = [F.try_divide(F.sum(f"s_v{j}"), F.sum(f"s_n{j}")).alias(f"m{j}") for j in each]
        wide = wide.join(seen.groupBy("ticker", "block").agg(*sums), ["ticker", "block"], "left")
        more = [decay ** (k + 1) * F.coalesce(f"m{j}", F.lit(0.0)) for j in each]
        wide = wide.select("ticker", "block", *[(F.col(f"v{j}") + F.col(f"c{j}") * m).alias(f"v{j}") for j, m in enumerate(more)], *[f"{c}{j}" for c in "nc" for j in each], *[(F.col(f"a{j}") + m).alias(f"a{j}") for j, m in enumerate(more)])
    added = wide.select("ticker", "block", F.array(*[f"a{j}" for j in each]).alias("added"))
    out = rows.join(added, ["ticker", "block"], "left")
    return out.select(*by, "ticker", (F.col("value") + F.coalesce(F.get("added", F.col("at")), F.lit(0.0))).alias("value"))
