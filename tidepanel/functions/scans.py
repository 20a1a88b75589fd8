"""Recursions y = keep * y + b over a symbol's rows, as associative scans of DataFrame operations.

Two steps of such a recursion compose to one: (a, b) then (c, d) is (a c, b c + d).  A symbol's rows are cut into short
pieces by their place.  Inside a piece y is a running sum with its powers of ``keep`` factored out; a piece as a whole is
one pair (keep ** length, its last sum); the pairs, one a piece, are folded in order into what each piece starts from.
So no task has to hold a symbol's rows one after the other, and no row leaves the JVM.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidepanel.sources import scratch

#: What places a row among the blocks.
PLACE = ("act_symbol", "date", "_pos", "_block")

#: Rows of a piece, a power of two; fewer where powers of ``keep`` would leave the range of doubles.
PIECE = 256


@dataclass
class Scan:
    """y starts at place ``begin + n - 1`` as the sum of the n values so far, each by ``weight``, and goes on by keep and gain."""

    name: str
    x: Column
    begin: Column
    n: int
    keep: float
    gain: float
    weight: float
    #: The first place with a result, counted from the seed.
    wait: int = 0


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read again, so that joining it with itself makes no plan twice.

    The folder is that of ``spark.checkpoint.dir``; without the setting a local master takes one of its own.
    """
    checkpoints(df.sparkSession)
    return df.checkpoint()


def checkpoints(spark) -> None:
    """Name the folder that checkpoints go to."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{scratch.root(spark)}/panel")


def forget(context, path: str | None) -> None:
    """Delete a checkpoint that nothing reads any more."""
    if path:
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def piece_rows(scans: list[Scan]) -> int:
    rows = PIECE
    for s in scans:
        while s.keep and rows * -math.log(s.keep) > 500:
            rows //= 2
    return rows


def first_place(df: DataFrame, found: dict[str, Column], blocked: bool) -> DataFrame:
    """Add the place of each symbol's first value of some columns; null without any."""
    least = {name: F.min(F.when(x.isNotNull(), F.col("_pos"))) for name, x in found.items()}
    if not blocked:
        return df.withColumns({name: x.over(W.partitionBy("act_symbol")) for name, x in least.items()})
    # Joined by symbol and block, as rows lie.
    g = df.groupBy("act_symbol").agg(*[x.alias(name) for name, x in least.items()], F.max("_block").alias("_to"))
    return df.join(g.select("act_symbol", *found, F.explode(F.sequence(F.lit(0).cast("long"), "_to")).alias("_block")), ["act_symbol", "_block"])


def scanned(df: DataFrame, scans: list[Scan], block_rows: int | None) -> DataFrame:
    """Add the scans' results.  ``_pos`` numbers a symbol's rows from 0; with ``block_rows`` rows lie by symbol and ``_block``."""
    size = piece_rows(scans)
    pos, at = F.col("_pos"), F.pmod("_pos", F.lit(size))
    held, seeds, bad = {}, {}, {}
    for k, s in enumerate(scans):
        seeds[k] = s.begin + (s.n - 1)
        power = F.pow(F.lit(s.keep), seeds[k] - pos) if s.keep else F.lit(1.0)
        # Up to the seed, values are raised so that they arrive there with their weight.
        b = F.when(pos < s.begin, 0.0).when(pos <= seeds[k], s.x * s.weight / power).otherwise(s.x * s.gain)
        held[f"_b{k}"] = F.coalesce(b, F.lit(0.0))
        bad[k] = F.when((pos >= s.begin) & s.x.isNull(), pos)
    df = df.withColumns({**held, "_piece": F.floor(pos / size)})
    inside = W.partitionBy("act_symbol", *(["_block"] if block_rows else []), "_piece").orderBy("_pos").rowsBetween(W.unboundedPreceding, 0)
    local = {f"_l{k}": F.sum(F.col(f"_b{k}") * F.pow(F.lit(s.keep), -at)).over(inside) * F.pow(F.lit(s.keep), at) if s.keep else F.col(f"_b{k}") for k, s in enumerate(scans)}
    df = df.withColumns(local)
    # A full piece's last row has its pair; those of a symbol are few.
    end = F.when(at == size - 1, F.struct("_piece", *[f"_l{k}" for k in range(len(scans))]))
    facts = {"_ends": F.collect_list(end), **{f"_bad{k}": F.min(x) for k, x in bad.items()}}
    starts = {f"_c{k}": _starts(s.keep**size, k) for k, s in enumerate(scans)}
    if block_rows:
        g = df.groupBy("act_symbol").agg(*[x.alias(n) for n, x in facts.items()])
        per = block_rows // size
        g = g.withColumns(starts).select("act_symbol", *[f"_bad{k}" for k in bad], F.explode(F.sequence(F.lit(0), F.floor(F.size("_c0") / per).cast("int"))).alias("_block"), *starts)
        g = g.select("act_symbol", F.col("_block").cast("long").alias("_block"), *[f"_bad{k}" for k in bad], *[F.slice(c, F.col("_block") * per + 1, per).alias(c) for c in starts])
        df, piece = df.join(g, ["act_symbol", "_block"]), (F.col("_piece") - F.col("_block") * per).cast("int")
        df = df.withColumns({c: F.get(c, piece) for c in starts})
    else:
        whole = W.partitionBy("act_symbol")
        df = df.withColumns({n: x.over(whole) for n, x in facts.items()})
        # The fold is made at the head of a piece, for all its rows.
        df = df.withColumns({c: F.when(at == 0, F.get(x, F.col("_piece").cast("int"))) for c, x in starts.items()})
        df = df.withColumns({c: F.first(c, ignorenulls=True).over(inside) for c in starts})
    out = {}
    for k, s in enumerate(scans):
        y = F.col(f"_l{k}") + F.pow(F.lit(s.keep), at + 1) * F.col(f"_c{k}") if s.keep else F.col(f"_l{k}")
        ok = (pos >= seeds[k] + s.wait) & (F.col(f"_bad{k}").isNull() | (pos < F.col(f"_bad{k}")))
        out[s.name] = F.when(ok, y)
    spare = [*held, "_piece", *local, *facts, *starts]
    return df.withColumns(out).drop(*spare)


def _starts(whole: float, k: int) -> Column:
    """What each piece starts from: 0, then piece by piece the last one carried through and its own sum."""
    step = lambda acc, e: F.array_append(acc, F.element_at(acc, -1) * whole + e[f"_l{k}"])
    return F.aggregate(F.sort_array("_ends"), F.array(F.lit(0.0)), step)
