"""As-of joins by union and window: one exchange by key, no inequality join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def asof(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: str = "act_symbol", forward: bool = False, payload: dict[str, str] | None = None, period: str | None = None, tasks: int | None = None) -> DataFrame:
    """Add to each left row the nearest right row at or before it (``forward``: at or after it), null if there is none.

    ``payload`` maps right columns to new names; all columns of a match come from one row, nulls included.  Of right
    rows with one key and time, the one with the largest payload counts.  A left row without a time has no match.

    With a ``period`` (day, month, year, ...) the rows of a key are dealt by their period, so that one key of very many
    rows does not meet in one task; a period's rows get what the periods before (after) it carry into it, which is found
    over one row a key and period.  The result is the same.

    ``tasks`` says that left rows lie by key in so many tasks: then the right rows are dealt alike and left rows stay.
    The result lies as the left rows do.
    """
    payload = payload or {c: c for c in right.columns if c != by}
    r = right.groupBy(by, F.col(right_on).alias("_t")).agg(F.max(F.struct(*[F.col(c).alias(n) for c, n in payload.items()])).alias("_p"))
    r = r.repartition(tasks, by) if tasks and period is None else r
    l = left.withColumns({"_t": F.col(left_on), "_own": F.struct(*[F.col(c) for c in left.columns if c != by])}).select(by, "_t", "_own")
    both = l.withColumn("_p", F.lit(None).cast(r.schema["_p"].dataType)).unionByName(r.withColumn("_own", F.lit(None).cast(l.schema["_own"].dataType)))
    direction = lambda c: F.col(c).desc() if forward else F.col(c).asc()
    before = lambda *keys: W.partitionBy(*keys).rowsBetween(W.unboundedPreceding, 0)
    # Right rows come first among equals, so an exact match counts.
    order = [direction("_t"), F.col("_own").isNotNull()]
    last = F.last("_p", ignorenulls=True)
    if period is None:
        out = both.withColumn("_m", last.over(before(by).orderBy(*order)))
    else:
        both = both.withColumn("_b", F.date_trunc(period, "_t"))
        nearest = (F.min_by if forward else F.max_by)("_p", F.when(F.col("_p").isNotNull(), F.col("_t")))
        carried = both.groupBy(by, "_b").agg(nearest.alias("_p"))
        carried = carried.select(F.col(by).alias("_k"), F.col("_b").alias("_c"), last.over(before(by).rowsBetween(W.unboundedPreceding, -1).orderBy(direction("_b"))).alias("_carry"))
        out = both.withColumn("_m", last.over(before(by, "_b").orderBy(*order)))
        out = out.join(carried, out[by].eqNullSafe(carried["_k"]) & out["_b"].eqNullSafe(carried["_c"]), "left").withColumn("_m", F.coalesce("_m", "_carry"))
    out = out.where("_own is not null").withColumn("_m", F.when(F.col("_t").isNotNull(), F.col("_m")))
    return out.select(*[F.col(by) if c == by else F.col("_own")[c].alias(c) for c in left.columns], *[F.col("_m")[n].alias(n) for n in payload.values()])
