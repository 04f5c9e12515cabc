"""Quality rules with host verdicts, in DataFrame operations only.

Each text is counted once (words, symbols, repeated lines, repeated windows of
three words) and fails or passes the base rules. Failures are summed by host; an
empirical beta prior, fitted to the hosts' failure rates by moments less what
sampling alone spreads them, shrinks each rate, so that small hosts lean to the corpus and large
ones to themselves. A host is rejected, and with it every document of it, if its shrunk rate
less ``SURE`` standard deviations is ``TIMES`` the mean rate of hosts at least. The counts are written to the shared folder between the two passes, so
that texts are read once.

Nulls: a null text has no words and fails; a null host is a host of its own.
Empty and very long texts take the same path. Repeated rows count each. An empty
table has no hosts and gives no rows. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.shared import written

#: A host is rejected from so many times the mean failure rate on, so many standard deviations of its own rate surely.
TIMES, SURE = 2.0, 1.645
#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _covered(places: Column) -> Column:
    """Words that windows at sorted places cover: min(3, the next place less this one), the last three."""
    start = F.struct(F.lit(-3).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(places, start, lambda a, p: F.struct(p.alias("end"), (a["n"] + F.least(F.lit(3), p - a["end"])).alias("n")), lambda a: a["n"])


def _repeated_words(windows: Column) -> Column:
    """Words inside windows (by their hashes, in order) that occur twice or more.

    Texts all of whose windows differ are done at once. Else sorted hashes give
    those that repeat; where they are few their places are found by looking each
    window up, else by sorting windows with their places.
    """

    def by_few(w: Column, twice: Column) -> Column:
        places = F.filter(F.transform(w, lambda x, i: F.when(F.array_contains(twice, x), i)), lambda i: i.isNotNull())
        return _covered(places)

    def by_sort(w: Column) -> Column:
        placed = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def same(p: Column) -> Column:
            beside = lambda v, k: F.coalesce(F.get(p, k)["x"] == v["x"], F.lit(False))
            marked = F.transform(p, lambda v, k: F.when(beside(v, k - 1) | beside(v, k + 1), v["i"]))
            return _covered(F.sort_array(F.filter(marked, lambda i: i.isNotNull())))

        return _let(placed, same)

    def repeats(w: Column) -> Column:
        def twice(ordered: Column) -> Column:
            return F.array_distinct(F.filter(F.transform(ordered, lambda x, k: F.when(F.get(ordered, k - 1) == x, x)), lambda x: x.isNotNull()))

        found = _let(_let(F.sort_array(w), twice), lambda t: F.when(F.size(t) <= 48, by_few(w, t)).otherwise(by_sort(w)))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(found)

    return _let(windows, repeats)


def counted(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the counts of every row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(F.translate("text", "\t\n\x0b\x0c\r", "     "), " "), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != "")

    def of_words(w: Column) -> Column:
        starts = F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0)))
        windows = F.transform(starts, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return F.struct(F.size(w).cast("long").alias("n_words"), _repeated_words(windows).cast("long").alias("n_repeat_words"))

    rows = docs.select("doc_id", F.col(host).alias("host"), text.alias("text")).select(
        "doc_id", "host", _let(words, of_words).alias("w"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    return rows.select("doc_id", "host", "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def host_verdicts(rows: DataFrame, times: float = TIMES, sure: float = SURE) -> DataFrame:
    """host, its documents and failures, the shrunk rate and whether it is rejected; from host and failed.

    With mean m and variance v of the hosts' rates, and w the mean of m (1 - m) / docs, which sampling adds to v,
    the prior is Beta(m s, (1 - m) s), s = m (1 - m) / (v - w) - 1, held between 1 and 1e6; v - w of 0 or less gives 1e6.
    """
    hosts = rows.groupBy("host").agg(F.count("*").alias("docs"), F.sum(F.col("failed").cast("long")).alias("failures"))
    rate = F.col("failures") / F.col("docs")
    prior = hosts.agg(F.avg(rate).alias("m"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("v"), F.avg(1 / F.col("docs")).alias("each"))
    spread = F.col("m") * (1 - F.col("m"))
    own = F.col("v") - spread * F.col("each")
    strength = F.when(own > 1e-12, F.least(F.greatest(spread / own - 1, F.lit(1.0)), F.lit(1e6))).otherwise(F.lit(1e6))
    # one row of prior: a scalar beside each host
    hosts = hosts.join(F.broadcast(prior.select("m", strength.alias("s"))), F.lit(True), "left")
    hosts = hosts.withColumn("host_rate", (F.col("failures") + F.col("m") * F.col("s")) / (F.col("docs") + F.col("s")))
    least = F.col("host_rate") - sure * F.sqrt(F.col("host_rate") * (1 - F.col("host_rate")) / (F.col("docs") + F.col("s") + 1))
    return hosts.select("host", "docs", "failures", "host_rate", ((F.col("failures") > 0) & (least >= times * F.col("m"))).alias("host_rejected"))


def judged(docs: DataFrame, host: str = "source", times: float = TIMES, sure: float = SURE) -> DataFrame:
    """Every row of ``docs`` with its counts, base_failed, the host's shrunk rate and kept.

    Only hosts that are rejected matter to documents, so that side is what is joined;
    a hot host's rows are split by Spark's skew join, or the few hosts broadcast themselves.
    """
    rows = written(counted(docs, host).withColumn("base_failed", base_failed()), "quality")
    hosts = host_verdicts(rows.select("host", F.col("base_failed").alias("failed")), times, sure)
    hosts = written(hosts.withColumnRenamed("host", "of"), "hosts")
    return rows.join(hosts, F.col("host").eqNullSafe(F.col("of")), "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.coalesce(F.col("host_rejected"), F.lit(False))).alias("kept"), "host_rate",
    )
