"""Exact order statistics and running counts of values that no task sees all of."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cuts of a round, and rows that are few enough to be put in order at once.
CUTS, FEW = 255, 1 << 16


def ranged(df: DataFrame, value: str, cuts: list[float], name: str) -> DataFrame:
    """Add the number of ascending ``cuts`` at or below a value, by binary search; null for null."""
    from pyspark.ml.feature import Bucketizer

    if not cuts:
        return df.withColumn(name, F.when(F.col(value).isNotNull(), 0))
    splits = [-math.inf, *cuts, math.inf]
    out = Bucketizer(splits=splits, inputCol=value, outputCol=name, handleInvalid="keep").transform(df.withColumn(value, F.col(value).cast("double")))
    return out.withColumn(name, F.when(F.col(value).isNotNull(), F.col(name).cast("int")))


def cuts_of(df: DataFrame, value: str, number: int) -> list[float]:
    """About so many different values that cut the rows into like parts, from a sketch of bounded size."""
    if number < 1:
        return []
    return sorted({float(x) for x in df.stat.approxQuantile(value, [(k + 1) / (number + 1) for k in range(number)], 1 / (4 * (number + 1)))})


def order_statistics(df: DataFrame, value: str, ranks: list[int], cuts: int = CUTS, few: int = FEW) -> dict[int, float]:
    """The values with some ranks (from 0) in ascending order, exactly; nulls and NaN have none.

    Each round cuts the rows that may hold a rank at approximate quantiles and counts the rows at each cut and between
    cuts, which leaves the value itself or about one in ``cuts`` of the rows; so rounds grow with the logarithm of the
    rows.  Only counts reach the driver, and at the end the ``few`` rows that are left.
    """
    x = df.select(F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v")).persist()
    found: dict[int, float] = {}
    # Rows strictly between two values, how many rows are at or below the lower one, and the ranks looked for.
    todo = [(None, None, 0, x.count(), sorted(set(ranks)))]
    while todo:
        low, high, before, n, wanted = todo.pop()
        part = x
        part = part if low is None else part.where(F.col("v") > low)
        part = part if high is None else part.where(F.col("v") < high)
        if n <= few:
            at = before
            for r in part.groupBy("v").count().orderBy("v").collect():
                found |= {k: r.v for k in wanted if at <= k < at + r["count"]}
                at += r["count"]
            continue
        edges = cuts_of(part, "v", cuts)
        of = ranged(part, "v", edges, "k")
        at_cut = F.col("v") == F.get(F.array(*[F.lit(e) for e in edges]), F.col("k") - 1)
        counts = {(r.k, r.c): r["count"] for r in of.groupBy("k", F.coalesce(at_cut, F.lit(False)).alias("c")).count().collect()}
        at = before
        for k in range(len(edges) + 1):
            here = counts.get((k, True), 0)
            found |= {r: edges[k - 1] for r in wanted if at <= r < at + here}
            at += here
            between = counts.get((k, False), 0)
            inside = [r for r in wanted if at <= r < at + between]
            if inside:
                todo.append((edges[k - 1] if k else low, edges[k] if k < len(edges) else high, at, between, inside))
            at += between
    x.unpersist()
    return found


def quantiles(df: DataFrame, value: str, probabilities: list[float], cuts: int = CUTS, few: int = FEW) -> list[float | None]:
    """Exact quantiles, interpolated between neighbouring values; None without any value."""
    n = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).count()
    if not n:
        return [None] * len(probabilities)
    places = [p * (n - 1) for p in probabilities]
    got = order_statistics(df, value, [r for p in places for r in (math.floor(p), math.ceil(p))], cuts, few)
    return [got[math.floor(p)] + (got[math.ceil(p)] - got[math.floor(p)]) * (p - math.floor(p)) for p in places]
