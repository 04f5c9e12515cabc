"""Packing into optimal length buckets and token-budget batches.

The global histogram of lengths goes to the driver: d different lengths sum up to
d^2 / 2 words or more, so d is at most the root of twice the corpus's words (some
10^4 for texts of up to 20,000 words, and below 7 million rows of two numbers for
100 TB whatever the texts). There dynamic programming chooses the bucket boundaries
of least padding over all lengths that occur: with lengths in order, the cost of
ending a bucket at i is a line in L_i, so the best previous boundary is found on a
convex hull and each further bucket takes one pass.
A bucket's texts are dealt into shards of about ``SHARD`` batches by a hash, and each
shard is cut into batches whose padded size keeps the token budget. No task ever holds
a bucket, and only a shard's last batch may be part full.

A text longer than the budget is a batch of its own: nothing is cut or dropped.

Nulls: a null or empty text has 0 tokens and takes a place of length 1; ids may be
null or repeat, each row takes its place. An empty table gives no rows. Columns other
than doc_id and text are never read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.shared import written

BUCKETS, BUDGET, SHARD = 16, 16_384, 64


def n_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, the tokens counted unless the caller brings others."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """At most ``buckets`` ends of buckets, of ``lengths`` in rising order, that make the least padding.

    A bucket (i, j] costs L_j (C_j - C_i) places, C being the running count.
    """
    m = len(lengths)
    if not m:
        return []
    size = [int(x) for x in lengths]
    total = [0, *np.cumsum(counts).tolist()]
    best = [size[j] * total[j + 1] for j in range(m)]  # one bucket
    choice = [np.full(m, -1, np.int32)]
    for _ in range(1, min(buckets, m)):
        hull: list[int] = []  # previous ends i whose line best[i] + L (C_j - C_i) is least for some L
        now, back, at = [0] * m, [-1] * m, 0

        def line(i: int) -> tuple[int, int]:
            return -total[i + 1], best[i]

        for j in range(m):
            now[j], back[j] = best[j], -2  # one bucket more may be no better
            if hull:
                at = min(at, len(hull) - 1)
                while at + 1 < len(hull) and line(hull[at + 1])[0] * size[j] + line(hull[at + 1])[1] <= line(hull[at])[0] * size[j] + line(hull[at])[1]:
                    at += 1
                slope, start = line(hull[at])
                if (cost := slope * size[j] + start + size[j] * total[j + 1]) < now[j]:
                    now[j], back[j] = cost, hull[at]
            k, b = line(j)
            while len(hull) > 1:
                (k1, b1), (k2, b2) = line(hull[-2]), line(hull[-1])
                if (b - b1) * (k1 - k2) <= (b2 - b1) * (k1 - k):
                    hull.pop()
                else:
                    break
            hull.append(j)
        choice.append(np.array(back, np.int32))
        best = now
    ends, j, k = [], m - 1, len(choice) - 1
    while j >= 0:
        while choice[k][j] == -2:
            k -= 1
        ends.append(size[j])
        j = int(choice[k][j])
        k -= 1
    return ends[::-1]


def packed(docs: DataFrame, tokens: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_length, batch, place and padding of every row of ``docs``."""
    size = (n_words(F.col("text")) if tokens is None else tokens).alias("n_tokens")
    rows = written(docs.select("doc_id", size, F.monotonically_increasing_id().alias("rid")), "lengths")
    place = F.greatest(F.col("n_tokens"), F.lit(1))
    shown = rows.groupBy(place.alias("length")).agg(F.count("*").alias("n")).toArrow().sort_by("length")
    lengths, counts = (shown.column(c).to_numpy() for c in ("length", "n"))
    ends = boundaries(lengths, counts, buckets)
    which, least = np.searchsorted(ends, lengths), [max(1, budget // e) for e in ends]
    many = np.bincount(which, counts, len(ends)) if ends else []
    shards = [max(1, int(m // (c * SHARD))) for m, c in zip(many, least, strict=True)]
    bucket, length, room, shard = (F.lit(0), *(F.lit(0).cast("long"),) * 3)
    for k in reversed(range(len(ends))):  # from the longest down: the first end that holds the text wins
        fits = place <= ends[k]
        bucket, length, room, shard = F.when(fits, k).otherwise(bucket), F.when(fits, F.lit(ends[k]).cast("long")).otherwise(length), F.when(fits, F.lit(least[k]).cast("long")).otherwise(room), F.when(fits, F.lit(shards[k]).cast("long")).otherwise(shard)
    dealt = rows.select("*", bucket.alias("bucket"), length.alias("bucket_length"), room.alias("room"), F.pmod(F.xxhash64("rid"), shard).alias("shard"))
    order = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy(F.xxhash64("doc_id", "rid"), "rid")) - 1
    dealt = dealt.withColumn("k", order)
    return dealt.select(
        "doc_id", "n_tokens", "bucket", "bucket_length", F.concat_ws("-", "bucket", "shard", F.floor(F.col("k") / F.col("room"))).alias("batch"),
        (F.col("k") % F.col("room")).cast("int").alias("place"), (F.col("bucket_length") - F.col("n_tokens")).alias("padding"),
    )
