"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions only.

Targets come from water filling: a source takes its weight's share of the budget but no more than ``max_epochs`` times
its size.  Each source's documents are shuffled by a hash and cut into blocks of equal words.  Van der Corput points
(bit-reversed slot numbers) are mapped through the sources' cumulative block counts, so every stretch of the schedule
holds each source in proportion; slots are ranked per source, and rank r takes block r of the shuffled source, pass
after pass.  The last block of a source is cut where its target is met.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidepanel.llm._shared import keep_ids, materialize, ordered, partitions, word_count

WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 1024
CELLS = 4096
CHUNK = 65_536
#: The table of sources has a row each; it is broadcast up to this many.
BROADCAST_SOURCES = 10_000


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col).cast("string")).alias("size"),
    )


def plan_sources(rows: DataFrame, weights=WEIGHTS, share: float = 1.5, max_epochs: int = 2, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per source: its size, target and the blocks that meet it, with the range of points that it owns."""
    every = W.orderBy(F.col("source").asc_nulls_last())
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    at = F.pmod(F.row_number().over(every) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), at + 1)
    t = totals.withColumn("src", F.row_number().over(every) - 1).withColumn("weight", weight)
    t = t.withColumn("cap", F.col("source_size") * max_epochs)
    # Water filling: in the order of cap / weight, all before the first source that is not full are.
    fill = W.orderBy(F.col("cap") / F.col("weight"), "src")
    alone = W.partitionBy(F.lit(0))
    t = t.withColumn("budget", F.sum("source_size").over(alone) * share)
    t = t.withColumn("full", F.coalesce(F.sum("cap").over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    t = t.withColumn("level", (F.col("budget") - F.col("full")) / F.sum("weight").over(fill.rowsBetween(0, W.unboundedFollowing)))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "src", "level"))
    t = t.withColumn("level", F.min(fits).over(alone)["level"])
    t = t.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double"))))
    t = t.withColumn("words", F.least(F.round("target").cast("long"), F.col("cap")))
    t = t.withColumn("blocks", F.expr(f"(source_size + {block_words - 1}) div {block_words}"))
    t = t.withColumn("passes", F.expr("if(source_size > 0, words div source_size, 0L)"))
    t = t.withColumn("rest", F.col("words") - F.col("passes") * F.col("source_size"))
    t = t.withColumn("need", F.expr(f"passes * blocks + (rest + {block_words - 1}) div {block_words}"))
    t = t.withColumn("hi", F.sum("need").over(W.orderBy("src").rowsBetween(W.unboundedPreceding, 0)))
    return t.select("source", "src", "source_size", "target", "words", "blocks", "passes", "rest", "need", (F.col("hi") - F.col("need")).alias("lo"), "hi")


def schedule(sources: DataFrame, points: int, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(slot, src, pass, block, words)``: which block of which source each slot takes."""
    spark = sources.sparkSession
    bits = max(1, (max(1, points) - 1).bit_length())
    point = F.conv(F.reverse(F.lpad(F.bin("id"), bits, "0")), 2, 10).cast("long")
    slots = spark.range(1 << bits).select(F.col("id").alias("slot"), point.alias("point")).where(F.col("point") < points)
    cell = max(1, -(-points // CELLS))
    owners = sources.where("need > 0").select(
        "src", "lo", "hi", "source_size", "blocks", "passes", "rest",
        F.explode(F.expr(f"sequence(lo div {cell}, (hi - 1) div {cell})")).alias("cell"),
    )
    slots = slots.withColumn("cell", F.expr(f"point div {cell}"))
    owned = slots.join(owners, (slots["cell"] == owners["cell"]) & (F.col("point") >= F.col("lo")) & (F.col("point") < F.col("hi")))
    owned = owned.drop("cell", "lo", "hi", "point").withColumn("chunk", F.expr(f"slot div {CHUNK}"))
    # Ranks per source in two steps, so that no task orders all the slots of a large source.
    counts = owned.groupBy("src", "chunk").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("src").orderBy("chunk")) - F.col("n")
    counts = counts.select("src", "chunk", before.alias("before"))
    owned = owned.withColumn("rank", F.row_number().over(W.partitionBy("src", "chunk").orderBy("slot")) - 1)
    ranked = owned.join(counts, ["src", "chunk"]).withColumn("rank", F.col("rank") + F.col("before"))
    ranked = ranked.withColumn("pass", F.expr("rank div blocks")).withColumn("block", F.expr("rank % blocks"))
    whole = F.when(F.col("pass") < F.col("passes"), F.col("source_size")).otherwise(F.col("rest"))
    words = F.least(F.lit(block_words).cast("long"), whole - F.col("block") * block_words)
    return ranked.select("slot", "src", "pass", "block", words.alias("words"), F.least(F.lit(block_words).cast("long"), F.col("source_size") - F.col("block") * block_words).alias("block_words"))


def positions(rows: DataFrame) -> DataFrame:
    """Each document's first word in its shuffled source (``start``), by the order of the ids' MD5.

    Sums per source and 3-digit prefix come first; only rows of one source and prefix are ordered together.
    """
    h = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"))
    rows = rows.withColumn("h", h).withColumn("bucket", F.substring("h", 1, 3))
    sums = rows.groupBy("src", "bucket").agg(F.sum("size").alias("n"))
    sums = sums.select("src", "bucket", (F.sum("n").over(W.partitionBy("src").orderBy("bucket")) - F.col("n")).alias("before"))
    within = W.partitionBy("src", "bucket").orderBy("h", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("start", F.sum("size").over(within) - F.col("size"))
    return rows.join(sums, ["src", "bucket"]).withColumn("start", F.col("start") + F.col("before")).drop("h", "bucket", "before")


def _mix(rows: DataFrame, weights, share: float, max_epochs: int, block_words: int) -> tuple[DataFrame, DataFrame]:
    """Per row of ``(doc_id, source, size)`` what the schedule takes of it, and the schedule."""
    sources = materialize(plan_sources(rows, weights, share, max_epochs, block_words).coalesce(1), "sources")
    got = sources.agg(F.max("hi").alias("points"), F.count("*").alias("n")).first()
    slots = materialize(schedule(sources, got["points"] or 0, block_words), "slots")
    uses = slots.groupBy("src", "block").agg(
        F.sum(F.when(F.col("words") == F.col("block_words"), 1).otherwise(0)).alias("whole"),
        F.coalesce(F.max(F.when(F.col("words") < F.col("block_words"), F.col("words"))), F.lit(0)).alias("cut"),
        F.min("slot").alias("slot"),
    )
    facts = sources.select("source", "src", "source_size", "target")
    facts = F.broadcast(facts) if got["n"] <= BROADCAST_SOURCES else facts
    f = facts.withColumnRenamed("source", "s")
    rows = rows.join(f, rows["source"].eqNullSafe(f["s"])).drop("s")
    placed = positions(rows)
    some = placed.where("size > 0")
    parts = some.withColumn("block", F.explode(F.expr(f"sequence(start div {block_words}, (start + size - 1) div {block_words})")))
    lo, end = F.col("block") * block_words, F.col("start") + F.col("size")
    parts = parts.join(uses, ["src", "block"], "left")
    full = F.least(end, lo + block_words) - F.greatest(F.col("start"), lo)
    cut = F.greatest(F.lit(0), F.least(end, lo + F.col("cut")) - F.greatest(F.col("start"), lo))
    words = F.coalesce(full * F.col("whole") + cut, F.lit(0))
    keys = ["doc_id", "source", "src", "start", "size", "source_size", "target"]
    taken = parts.groupBy(*keys).agg(F.sum(words).alias("taken"), F.min(F.when(words > 0, F.col("slot"))).alias("first_slot"))
    none = placed.where("size = 0").select(*keys, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"))
    return taken.unionByName(none), slots


def mix(
    docs: DataFrame, weights=WEIGHTS, share: float = 1.5, max_epochs: int = 2, block_words: int = BLOCK_WORDS,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row per document: ``(doc_id, source, size, source_size, target, taken, first_slot)``.

    ``taken`` counts the words that the schedule's blocks take from the document, repeats included; per source they
    add up to the rounded target.  ``first_slot`` is the schedule's first slot that takes any of them, null if none
    does.  A null text has size 0 and takes nothing; null sources form one source, last in order; null ids are ordered
    as the string ``null``; repeated rows are separate documents; an empty table gives an empty result; other columns
    are ignored.
    """
    rows = materialize(sized(docs, id_col, text_col, source_col), "sized")
    taken, _ = _mix(rows, weights, share, max_epochs, block_words)
    return taken.select("doc_id", "source", "size", "source_size", "target", "taken", "first_slot")


def mixed_rows(
    docs: DataFrame, weights=WEIGHTS, share: float = 1.5, max_epochs: int = 2, block_words: int = BLOCK_WORDS,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", slot_col: str | None = None,
) -> DataFrame:
    """The rows of ``docs`` in the order of the schedule, each as often as the mix takes it whole.

    A document cut at a target counts from a half on.  Its k-th copy stands at the slot that takes its first word in
    the k-th pass, so every stretch of the result holds each source in proportion; partitions are ranges of slots in
    order.  ``slot_col`` names a column with the slot, if wanted.  Null and repeated values are taken as in :func:`mix`.
    """
    d = ordered(docs, id_col, text_col, rows=True)
    rows = materialize(d.select(F.col("ord").alias("doc_id"), F.col("row")[source_col].cast("string").alias("source"), word_count(F.col("text")).alias("size")).distinct(), "sized")
    taken, slots = _mix(rows, weights, share, max_epochs, block_words)
    times = F.round(F.try_divide(F.col("taken").cast("double"), F.col("size"))).cast("int")
    copies = taken.withColumn("times", times).where("times > 0").select(
        F.col("doc_id").alias("ord"), "src", "start", F.expr(f"start div {block_words}").alias("block"), F.explode(F.expr("sequence(0L, times - 1L)")).alias("pass"),
    )
    copies = copies.join(slots.select("src", "pass", "block", "slot"), ["src", "pass", "block"], "left")
    at = F.min(F.struct(F.coalesce("slot", F.lit(2**62)).alias("slot"), "start"))
    copies = copies.groupBy("ord", "pass").agg(at.alias("at")).select("ord", "pass", F.col("at.slot").alias("_slot"), "at.start")
    copies = materialize(copies, "copies")
    placed = keep_ids(d.select("ord", "row"), copies, "ord")
    n = partitions(docs.sparkSession)
    placed = placed.repartitionByRange(n, "_slot", "start", "ord").sortWithinPartitions("_slot", "start", "ord")
    return placed.select("row.*", *([F.col("_slot").alias(slot_col)] if slot_col else []))


def op5_low_discrepancy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "source", "size", "source_size", F.round("target", 3).alias("target"), "taken", "first_slot")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, 2 * source_size AS cap FROM s
), f AS (
  SELECT *, (sum(source_size) OVER () * 1.5 - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), l AS (
  SELECT level FROM f WHERE level * weight <= cap ORDER BY cap / weight, source NULLS LAST LIMIT 1
), t AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT level FROM l) * weight, cap::DOUBLE)) AS target FROM w
), q AS (
  SELECT *, round(target)::BIGINT AS words, (source_size + 1023) // 1024 AS blocks FROM t
), n AS (
  SELECT *, CASE WHEN source_size > 0 THEN words // source_size * blocks + (words % source_size + 1023) // 1024 ELSE 0 END AS need FROM q
), o AS (
  SELECT *, coalesce(sum(need) OVER (ORDER BY source NULLS LAST), 0) AS hi FROM n
), v AS (
  SELECT slot, ('0b' || reverse(lpad(bin(slot), bits, '0')))::BIGINT AS point
  FROM (SELECT len(bin(greatest(1, max(hi))::BIGINT - 1))::INT AS bits FROM o), range(0, (1::BIGINT << bits)) AS r(slot)
), z AS (
  SELECT source, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank, slot FROM v JOIN o ON point >= hi - need AND point < hi
), p AS (
  SELECT d.doc_id, d.source, d.size, q.source_size, q.target, q.words,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, 'null')), d.doc_id NULLS LAST, d.size ROWS UNBOUNDED PRECEDING) - d.size AS start
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
), k AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE (words // source_size) * size
    + greatest(0, least(start + size, words % source_size) - start) END::BIGINT AS taken FROM p
)
SELECT doc_id, k.source, size, source_size, round(target, 3) AS target, taken, CASE WHEN taken > 0 THEN slot END AS first_slot
FROM k LEFT JOIN z ON k.source IS NOT DISTINCT FROM z.source AND start // 1024 = rank
"""
