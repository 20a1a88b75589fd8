"""Line dedup by content-defined chunks of lines, with DataFrame functions only.

Each line has a hash; the rolling hash at a line is the sum of the hashes of the last ``ROLL`` lines, and a chunk ends
where it is 0 modulo ``MEAN``.  As boundaries depend on nearby lines only, lines put in or taken out elsewhere do not
shift them.  A chunk of at least two lines that comes earlier as well is removed whole.  Chunks are grouped by their
bytes, combined map-side first, so a chunk that many documents share costs one row a task; documents learn by two hashes
which chunks to drop, and hashes that two different chunks share (which grouping by bytes shows) drop nothing.

A shared passage seldom begins and ends with a chunk.  So what is left is compared by pairs of adjacent lines: those
inside each distinct chunk, once and where it comes first, and those that meet at a boundary.  A pair that comes earlier
goes, so every run of two or more lines does, whatever stands around it.  Repeated chunks spare all their pairs.  A pair
is its SHA-256 digest.  Chunks and pairs of very many occurrences are looked up where they are, not gathered by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm._shared import join_counted, let, materialize, ordered

ROLL = 3
MEAN = 4
#: A place is one number, so that the least one is found in a hash table: the document's times this, plus the line's.
PLACES = 2**31


def place(ord: Column, line: Column) -> Column:
    return (ord.cast("decimal(19,0)") * F.lit(PLACES).cast("decimal(10,0)") + line.cast("decimal(10,0)")).cast("decimal(31,0)")


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def marked_lines(text: Column) -> Column:
    """The text's lines, each behind a mark: ``b`` where a chunk begins and ``c`` where it goes on."""

    def hashes(lines: Column) -> Column:
        return F.transform(lines, lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 8), 16, 10).cast("long"))

    def marked(lines: Column, h: Column) -> Column:
        def mark(x: Column, i: Column) -> Column:
            rolling = sum((F.coalesce(F.get(h, i - j), F.lit(0)) for j in range(2, ROLL + 1)), F.get(h, i - 1))
            return F.concat(F.when((i == 0) | (rolling % MEAN == 0), "b").otherwise("c"), x)

        return F.transform(lines, mark)

    return let(lines_of(text), lambda lines: let(hashes(lines), lambda h: marked(lines, h)))


def unmarked(line: Column) -> Column:
    return F.substring(line, F.lit(2), F.char_length(line))


def begins(marked: Column) -> Column:
    """The places of the lines at which chunks begin."""
    return F.filter(F.sequence(F.lit(0), F.size(marked) - 1), lambda i: F.get(marked, i).startswith("b"))


def chunks_of(text: Column) -> Column:
    """The text's chunks in order, as ``(start, chunk)``: the first line's place, and the lines joined by line feeds.

    Lines have no line feeds, so a line feed before a mark is unmistakable.
    """

    def cut(marked: Column) -> Column:
        chunks = F.split(F.array_join(marked, "\n"), "\n(?=b)", -1)
        chunks = F.transform(chunks, lambda c: F.replace(unmarked(c), F.lit("\nc"), F.lit("\n")))
        return F.arrays_zip(begins(marked), chunks).cast("array<struct<start:int,chunk:string>>")

    return let(marked_lines(text), cut)


def pair_key(line: Column, following: Column) -> Column:
    """The digest of two adjacent lines; null where both are blank."""
    pair = F.concat(line, F.lit("\n"), following)
    return F.when(pair.rlike(r"\S"), F.unhex(F.sha2(pair.cast("binary"), 256)))


def inner_pairs(chunk: Column) -> Column:
    """The keys of the pairs of adjacent lines inside a chunk, in order."""

    def keys(lines: Column) -> Column:
        return F.transform(F.slice(lines, F.lit(1), F.size(lines) - 1), lambda x, i: pair_key(x, F.get(lines, i + 1)))

    return let(lines_of(chunk), keys)


def edge_pairs(text: Column) -> Column:
    """``(line, key)`` of the pairs whose second line begins a chunk; ``line`` is the place of the first."""

    def pairs(marked: Column) -> Column:
        def pair(i: Column) -> Column:
            key = pair_key(unmarked(F.get(marked, i - 1)), unmarked(F.get(marked, i)))
            return F.struct((i - 1).alias("line"), key.alias("key"))

        return F.transform(F.filter(begins(marked), lambda i: i > 0), pair)

    return let(marked_lines(text), pairs)


def line_count(text: Column) -> Column:
    return (F.regexp_count(text, F.lit("\n")) + 1).cast("int")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_lines, n_chunks, n_removed_lines, text)``: texts without the chunks and runs of lines seen earlier.

    Earlier is a smaller doc_id, or the same document further up; a run may overlap the place where it comes first.
    Kept lines are joined by line feeds; a text with nothing removed stays as it is.  A null text is empty: one line,
    nothing to remove.  Null ids come last; rows that repeat an id are ordered by a hash of the text; rows that repeat id
    and text are one document listed twice.  Blank chunks and pairs of blank lines (white space only) remove nothing.
    An empty table gives an empty result; other columns are ignored.
    """
    d = ordered(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    several = d.where(F.col("text").contains("\n"))
    chunks = several.select("ord", F.inline(chunks_of(F.col("text"))))
    # A chunk of several lines has a line feed.
    chunks = chunks.where(F.col("chunk").contains("\n") & F.col("chunk").rlike(r"\S"))
    chunks = chunks.withColumn("place", place(F.col("ord"), F.col("start")))
    keys = [F.xxhash64("chunk").alias("h"), F.xxhash64(F.lit(ROLL), F.col("chunk")).alias("g")]
    # Grouped by bytes: where the chunk comes first, and how often it comes.
    distinct = chunks.groupBy("chunk").agg(F.min("ord").alias("ord"), F.min("place").alias("first"), F.count("*").alias("n"))
    distinct = materialize(
        distinct.select("ord", "first", "n", *keys, line_count(F.col("chunk")).alias("lines"), inner_pairs(F.col("chunk")).alias("pairs")), "chunks"
    )
    repeated = distinct.groupBy("h", "g").agg(*[F.max(c).alias(c) for c in ("first", "lines", "n")], F.count("*").alias("texts"))
    repeated = materialize(repeated.where("n > 1 and texts = 1").drop("texts"), "repeated-chunks")
    again = join_counted(chunks.select("ord", "start", "place", *keys), repeated, ["h", "g"], "n").where("place > first")
    drops = again.groupBy("ord").agg(F.collect_set(F.struct("start", "lines")).alias("chunks"))

    inside = distinct.select("ord", "first", F.posexplode("pairs").alias("i", "key"))
    inside = inside.select("ord", (F.col("first") + F.col("i")).cast("decimal(31,0)").alias("place"), "key")
    edges = several.select("ord", F.inline(edge_pairs(F.col("text")))).select("ord", place(F.col("ord"), F.col("line")).alias("place"), "key")
    pairs = materialize(inside.unionByName(edges).where("key is not null"), "pairs")
    seen = pairs.groupBy("key").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count("*").alias("n"))
    seen = materialize(seen.where("first < last").select("key", "first", "n"), "repeated-pairs")
    again = join_counted(pairs, seen, "key", "n").where("place > first")
    line = (F.col("place") - place(F.col("ord"), F.lit(0))).cast("int")
    gone = again.groupBy("ord").agg(F.collect_set(line).alias("pairs"))

    d = d.join(drops, "ord", "left").join(gone, "ord", "left")
    whole = F.flatten(F.transform("chunks", lambda x: F.sequence(x["start"], x["start"] + x["lines"] - 1)))
    none = F.array().cast("array<int>")
    lost = F.array_union(F.coalesce(whole, none), F.coalesce(F.array_union("pairs", F.transform("pairs", lambda i: i + 1)), none))

    # Lines are bound before the lambda that looks into them; Catalyst may put a column's expression into a lambda.
    def kept(lines: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), lost)
        return F.array_join(F.transform(places, lambda k: F.get(lines, k)), "\n")

    return d.select(
        "doc_id", line_count(F.col("text")).cast("long").alias("n_lines"), let(marked_lines(F.col("text")), lambda m: F.size(begins(m))).cast("long").alias("n_chunks"),
        F.size(lost).cast("long").alias("n_removed_lines"),
        F.when(F.size(lost) == 0, F.col("text")).otherwise(let(lines_of(F.col("text")), kept)).alias("text"),
    )


def op1_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_chunks", "n_removed_lines", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), h AS (
  SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS v, count(*) OVER (PARTITION BY doc_id) AS n FROM l
), e AS (
  SELECT *, i = n OR sum(v) OVER (PARTITION BY doc_id ORDER BY i ROWS 2 PRECEDING) % 4 = 0 AS ends FROM h
), c AS (
  SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k,
    lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM e
), t AS (
  SELECT doc_id, k, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS n FROM c GROUP BY doc_id, k
), r AS (
  SELECT doc_id, k, n >= 2 AND regexp_replace(chunk, '\s', '', 'g') <> '' AND row_number() OVER (PARTITION BY chunk ORDER BY doc_id, k) > 1 AS whole FROM t
), p AS (
  SELECT doc_id, k, i, line,
    next IS NOT NULL AND regexp_replace(line || next, '\s', '', 'g') <> '' AND row_number() OVER (PARTITION BY line, next ORDER BY doc_id, i) > 1 AS again FROM c
), g AS (
  SELECT doc_id, k, i, line, whole OR again OR coalesce(lag(again) OVER (PARTITION BY doc_id ORDER BY i), false) AS gone FROM p JOIN r USING (doc_id, k)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(DISTINCT k)::BIGINT AS n_chunks, count(*) FILTER (gone)::BIGINT AS n_removed_lines,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM g GROUP BY doc_id
"""
