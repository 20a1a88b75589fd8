"""Document fingerprints by a threshold-scaled sketch, with DataFrame functions only.

A sketch keeps the hash of every shingle (five consecutive words; all words of a shorter text) that is below a fixed
fraction of the hash range.  Whether a hash is kept depends on the hash alone, so the sketch of two texts' shingles
together is the union of their sketches, and the share of one sketch that lies in another estimates containment even
between very unequal documents.

A fingerprint is the sketch, ``kept``, and ``n``, how many distinct shingles the text has; ``n`` only tells a sketch
that is empty by chance from the sketch of a text without shingles.  Every comparison uses the sketches alone, whatever
the lengths of the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidepanel.llm._shared import let, materialize, numbered_rows

SHINGLE = 5
#: One hash in so many is kept.
SCALE = 2


def words(text: Column) -> Column:
    """The text's words: runs of characters other than ASCII white space."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingle_hashes(text: Column, n: int = SHINGLE) -> Column:
    """The distinct hashes of a text's shingles."""

    def shingles(w: Column) -> Column:
        one = lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(n)])
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), one)).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<long>"))

    return F.array_distinct(let(words(text), shingles))


def fingerprint(text: Column, scale: int = SCALE, n: int = SHINGLE) -> Column:
    """``struct(kept, n)``, the hashes sorted; ``scale`` is a power of two."""
    bits = scale.bit_length() - 1
    # The unsigned hash is below 2**64 / scale if its top bits are 0.
    low = lambda h: F.shiftrightunsigned(h, 64 - bits) == 0 if bits else F.lit(True)
    return let(shingle_hashes(text, n), lambda hashes: F.struct(F.array_sort(F.filter(hashes, low)).alias("kept"), F.size(hashes).alias("n")))


def sketch(text: Column, scale: int = SCALE, n: int = SHINGLE) -> Column:
    """The scaled sketch alone: the part that merges."""
    return fingerprint(text, scale, n)["kept"]


def merge(a: Column, b: Column) -> Column:
    """The scaled sketch of two texts' shingles together, from their scaled sketches."""
    return F.array_sort(F.array_union(a, b))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two texts' shingles by their sketches.

    Two empty sketches tell only by the texts' numbers of shingles: alike if these are equal, not alike otherwise.
    """
    x, y, both = F.size(a["kept"]), F.size(b["kept"]), F.size(F.array_intersect(a["kept"], b["kept"]))
    return F.when((x == 0) & (y == 0), (a["n"] == b["n"]).cast("double")).otherwise(F.try_divide(both.cast("double"), x + y - both))


def containment(a: Column, b: Column) -> Column:
    """The share of the first text's shingles that the second has; a text without any is contained in all.

    Null where the first text has shingles but its sketch has none of them: then it tells nothing.
    """
    both = F.size(F.array_intersect(a["kept"], b["kept"]))
    return F.when(a["n"] == 0, 1.0).otherwise(F.try_divide(both.cast("double"), F.size(a["kept"])))


def as_string(print_: Column) -> Column:
    """A fingerprint as text: 16 hexadecimal digits a hash, then after a colon the number of shingles."""
    digits = F.array_join(F.transform(print_["kept"], lambda h: F.lpad(F.hex(h), 16, "0")), "")
    return F.concat(digits, F.lit(":"), print_["n"].cast("string"))


def fingerprints(docs: DataFrame, scale: int = SCALE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_chars, print)`` of every whole text.

    A null text is empty and has an empty fingerprint; null and repeated ids pass through; an empty table gives an
    empty result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.char_length(text).cast("long").alias("n_chars"), fingerprint(text, scale).alias("print"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scale: int = SCALE) -> DataFrame:
    """Every document with the next one's in descending order of doc_id (after the last: the first).

    ``(doc_id, text, print, edited, next_print)``; ``edited`` is the text whose last third (rounded down) gives way
    to as many first characters of the next text.  Only ids and lengths are put in order; texts then move once by key,
    and of the next text no more than what is needed moves again.  Null ids come last, repeated ids in the order of a
    hash of the text; rows that repeat id and text take the same place and get the same result.  Ids are whole numbers.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("h", F.xxhash64("text"))
    keys = base.groupBy("doc_id", "h").agg(F.max(F.floor(F.char_length("text") / 3)).alias("k"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("h").asc()]
    placed = materialize(numbered_rows(keys, order, "i"), "placed")
    total = placed.count()
    after = placed.select(F.pmod(F.col("i") - 1, F.lit(max(1, total))).alias("i"), F.col("doc_id").alias("next_id"), F.col("h").alias("next_h"))
    pairs = materialize(placed.join(after, "i").select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("null_id"), "h", "k", F.coalesce("next_id", F.lit(0)).alias("next_id"), F.col("next_id").isNull().alias("next_null"), "next_h"), "pairs")
    key = ["id", "null_id", "h"]
    texts = base.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("null_id"), "h", "text").repartition(*key)
    once = texts.withColumn("r", F.row_number().over(W.partitionBy(*key).orderBy(F.lit(1)))).where("r = 1").drop("r")
    nexts = once.join(pairs.select(F.col("id").alias("for_id"), F.col("null_id").alias("for_null"), F.col("h").alias("for_h"), "k", F.col("next_id").alias("id"), F.col("next_null").alias("null_id"), F.col("next_h").alias("h")), key)
    # Fingerprints are made after texts have moved, so that only the next text's moves.
    nexts = nexts.select(F.col("for_id").alias("id"), F.col("for_null").alias("null_id"), F.col("for_h").alias("h"), "k", F.substring("text", F.lit(1), F.col("k").cast("int")).alias("head"), fingerprint(F.col("text"), scale).alias("next_print"))
    n = F.char_length("text")
    return texts.join(nexts, key).select(
        F.when(~F.col("null_id"), F.col("id")).alias("doc_id"), "text", fingerprint(F.col("text"), scale).alias("print"),
        F.concat(F.substring("text", F.lit(1), (n - F.col("k")).cast("int")), "head").alias("edited"), "next_print",
    )


def op6_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also ``contained_edited`` and ``contained_next``: the shares of the text's shingles in the other two."""
    docs = with_next(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("edited_print", fingerprint(F.col("edited")))
    own, edited, after = F.col("print"), F.col("edited_print"), F.col("next_print")
    return docs.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_string(own).alias("fingerprint"), as_string(edited).alias("edited_fingerprint"),
        likeness(own, edited).alias("near_edited"), likeness(own, after).alias("near_next"),
        containment(own, edited).alias("contained_edited"), containment(own, after).alias("contained_next"),
    )
