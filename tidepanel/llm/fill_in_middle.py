"""Fill-in-middle transformation: texts cut at two ranks of an indexable skip list.

A text is a sequence of units (a word with the white space before it, or white space at the end).  Its skip list links
every unit to the next in the lowest lane; each lane above keeps about a quarter of the nodes below.  A link carries
how many units and how many code points it passes, so a descent by accumulated widths reaches the place before any
rank, and its code point, in about log n steps and without reading the text again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm._shared import long_rows
from tidepanel.llm._text import arrow_slices, mix, with_columns

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
SEED = 42
#: Of 100 texts, those that are transformed, and of 100 transformed ones those that put the suffix first.
FIM_RATE, SPM_RATE = 50, 80

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def unit_widths(text: str) -> np.ndarray:
    """The code points of each unit ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+`` from left to right."""
    code = np.frombuffer(text.encode("ascii"), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(code):
        return np.zeros(0, np.int64)
    word = (code != 0x20) & ((code < 0x09) | (code > 0x0D))
    # A unit ends with its word; what is left at the end is one unit of white space.
    last = np.flatnonzero(word[:-1] > word[1:])
    return np.diff(np.concatenate(([-1], last, [len(code) - 1])))


class SkipList:
    """Units in order.  The node with number i of a lane stands before its unit; the first node of each lane is the head."""

    def __init__(self, widths: np.ndarray, odds: int = 4, least: int = 8):
        n = len(widths)
        self.n = n
        #: Lanes from the lowest: units and code points that each link passes, and the node's number one lane below.
        self.lanes = [(np.ones(n, np.int64), widths, None)]
        coins = mix(np.arange(1, n + 1, dtype=np.uint64))
        while len(coins) > least:
            up = np.flatnonzero(coins % np.uint64(odds) == 0)
            up = np.concatenate(([0], up[up > 0]))
            units, chars, _ = self.lanes[-1]
            if len(up) == len(units):
                break
            self.lanes.append((np.add.reduceat(units, up), np.add.reduceat(chars, up), up))
            coins = coins[up] // np.uint64(odds)

    def chars_before(self, rank: int) -> int:
        """The code points before the unit with that rank (0 to n)."""
        node = passed = chars = 0
        for units, wide, below in reversed(self.lanes):
            while node < len(units) and passed + units[node] <= rank:
                passed += int(units[node])
                chars += int(wide[node])
                node += 1
            if passed == rank:
                break
            node = int(below[node]) if below is not None else node
        return chars


def transform(text: str, doc_id: int | None, seed: int = SEED, fim_rate: int = FIM_RATE, spm_rate: int = SPM_RATE) -> tuple:
    """``(n, form, prefix_chars, middle_chars, output)`` of one text."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    widths = unit_widths(text)
    n = len(widths)
    if not text or h3 % 100 >= fim_rate or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    units = SkipList(widths)
    a, b = (units.chars_before(rank) for rank in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_rate:
        return n, "spm", a, b - a, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return n, "psm", a, b - a, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, fim_rate: int = FIM_RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)``, a row per row of ``docs``; rows do not depend on each other.

    ``n`` counts units.  The form is ``plain`` (``output`` is the text) where the text is empty or has one of the three
    marks, and for texts that the rate leaves out by a hash of the id; otherwise ``psm`` or ``spm``.  A null text is
    empty.  A null id is hashed as the empty string.  Repeated rows get equal results.  An empty table gives an empty
    result; other columns are ignored.  A text is held in memory with about 20 bytes a code point.
    """
    long_rows(docs.sparkSession)

    def cut(batches):
        for part in arrow_slices(batches, "text"):
            ids, texts = (part.column(k).to_pylist() for k in (0, 1))
            n, form, a, b, out = zip(*[transform(t or "", i, seed, fim_rate, spm_rate) for i, t in zip(ids, texts, strict=True)], strict=True)
            yield with_columns(part, ("text",), n=pa.array(n, pa.int64()), form=pa.array(form), prefix_chars=pa.array(a, pa.int64()), middle_chars=pa.array(b, pa.int64()), output=pa.array(out, pa.string()))

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(cut, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of; a transformed text has none of the marks, so they cut it exactly."""
    part = F.split(output, "|".join(MARKS), -1)
    first, second, third = (F.get(part, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, third, second)).when(form == "spm", F.concat(second, third, first)).otherwise(output)


def op11_skip_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id::VARCHAR) AS hex,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents
), h AS (
  SELECT doc_id, t, units, len(units) AS n, ('0x' || substr(hex, 1, 8))::BIGINT AS h1, ('0x' || substr(hex, 9, 8))::BIGINT AS h2,
    ('0x' || substr(hex, 17, 8))::BIGINT AS h3, ('0x' || substr(hex, 25, 8))::BIGINT AS h4
  FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), p AS (
  SELECT doc_id, t, n, form, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix
  FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
