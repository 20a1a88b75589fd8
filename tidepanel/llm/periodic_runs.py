"""Periodic runs of words: a stretch that repeats itself with a smallest period, as far as it goes.

Longest common extensions (LCE) are found over a difference cover D modulo v: for any two places i and j there is a
shift s < v with (i + s) % v and (j + s) % v both in D.  Only suffixes at places of D are sorted, by doubling with steps
of v (a place of D plus v is one again), and only their neighbours' common prefixes are kept, under a sparse table of
range minima.  An extension compares the few words up to the shift and reads the rest off the table.

A run of period q and e or more repeats has (e - 1) q places whose words equal those q later, so one of the places 0,
(e - 1) q, 2 (e - 1) q, ... lies among them: over all q these grids have about n / (e - 1) * ln n places, and extending
both ways from those that match gives every run.
"""

from __future__ import annotations

from functools import cached_property
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm._shared import WORD, let, long_rows
from tidepanel.llm._text import arrow_slices, covered, with_columns
from tidepanel.llm.substring_dedup import AT_COVER, PERIOD

MIN_LENGTH, MIN_REPEATS = 6, 4
#: Grid places that are looked at together.
GRID = 1 << 19

#: By the residues of two places, the least shift that brings both into the cover.
SHIFT = np.array([[next(s for s in range(PERIOD) if AT_COVER[(i + s) % PERIOD] and AT_COVER[(j + s) % PERIOD]) for j in range(PERIOD)] for i in range(PERIOD)])

SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, text string"


class Extensions:
    """LCE of any two different places of ``x``, in which every text ends with a number of its own."""

    def __init__(self, x: np.ndarray):
        self.size = len(x)
        top = int(x.max()) + 1
        self.x = np.concatenate((x, np.arange(top, top + PERIOD)))

    @cached_property
    def _sorted(self):
        """Place -> its suffix's rank among the sampled ones, and the sparse table of their common prefixes."""
        x, bits = self.x, int(self.x.max()).bit_length()
        at = np.flatnonzero(AT_COVER[np.arange(self.size) % PERIOD])
        number = np.full(self.size + PERIOD, -1)
        number[at] = np.arange(len(at))
        keys, width = [], max(1, 63 // bits)
        for a in range(0, PERIOD, width):
            key = np.zeros(len(at), np.int64)
            for k in range(a, min(PERIOD, a + width)):
                key = key << bits | x[at + k]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        differ = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
        levels, step = [_ranks(order, differ)], PERIOD
        while levels[-1].max(initial=0) < len(at) - 1:
            rank = levels[-1]
            later = at + step
            inside = later < self.size
            following = np.zeros(len(at), np.int64)
            following[inside] = rank[number[later[inside]]] + 1
            key = rank * (len(at) + 1) + following
            order = np.argsort(key, kind="stable")
            levels.append(_ranks(order, key[order][1:] != key[order][:-1]))
            step *= 2
        a, b = at[order[:-1]], at[order[1:]]
        common = np.zeros(len(a), np.int64)
        for rank in reversed(levels[:-1]):
            step //= 2
            i, j = a + common, b + common
            ok = np.flatnonzero(np.maximum(i, j) < self.size)
            common[ok] += step * (rank[number[i[ok]]] == rank[number[j[ok]]])
        common += self._few(a + common, b + common, np.full(len(a), PERIOD))
        table = [common]
        while 2 * (span := 1 << (len(table) - 1)) <= len(common):
            table.append(np.minimum(table[-1][:-span], table[-1][span:]))
        place = np.full(self.size + PERIOD, -1)
        place[at] = levels[-1]
        return place, table

    def _few(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from i and j on are equal, up to ``most`` each."""
        out = np.zeros(len(i), np.int64)
        on = np.arange(len(i))
        for t in range(PERIOD):
            on = on[most[on] > t]
            on = on[np.maximum(i[on], j[on]) + t < len(self.x)]
            on = on[self.x[i[on] + t] == self.x[j[on] + t]]
            if not len(on):
                break
            out[on] += 1
        return out

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        shift = SHIFT[i % PERIOD, j % PERIOD]
        out = self._few(i, j, shift)
        far = np.flatnonzero(out == shift)
        if len(far):
            place, table = self._sorted
            a, b = place[i[far] + shift[far]], place[j[far] + shift[far]]
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            level = np.frexp(hi - lo)[1] - 1
            for k in np.unique(level).tolist():
                on = level == k
                out[far[on]] += np.minimum(table[k][lo[on]], table[k][hi[on] - (1 << k)])
        return out


def _ranks(order: np.ndarray, differ: np.ndarray) -> np.ndarray:
    rank = np.zeros(len(order), np.int64)
    rank[order[1:]] = np.cumsum(differ)
    return rank


def runs_of(x: np.ndarray, first: np.ndarray, count: np.ndarray, min_length: int = MIN_LENGTH, repeats: int = MIN_REPEATS) -> tuple:
    """Document, start, length and period of all runs, in the order of document, start and period.

    ``x`` has a number of its own before the first and after each document; these begin at ``first``.
    """
    ahead, back = Extensions(x), Extensions(x[::-1])
    n_periods = np.maximum(count // repeats, 0)
    doc = np.repeat(np.arange(len(count)), n_periods)
    q = np.arange(len(doc)) - np.repeat(np.cumsum(n_periods) - n_periods, n_periods) + 1
    step = (repeats - 1) * q
    places = -(-(count[doc] - q) // step)
    found = []
    edges = np.flatnonzero(np.diff(np.cumsum(places) // GRID, prepend=0))
    for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(q)], strict=True):
        m = places[i:j]
        row = np.repeat(np.arange(i, j), m)
        at = (np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)) * step[row] + first[doc[row]]
        same = x[at] == x[at + q[row]]
        row, at = row[same], at[same]
        period = q[row]
        right = ahead.of(at, at + period)
        left = back.of(len(x) - at, len(x) - at - period)
        length = right + left + period
        long = length >= np.maximum(min_length, repeats * period)
        got = np.stack((doc[row], at - left - first[doc[row]], length, period))[:, long]
        found.append(_smallest(got))
    return tuple(_smallest(np.concatenate(found, axis=1)))


def _smallest(runs: np.ndarray) -> np.ndarray:
    """Of each stretch the row of its smallest period: a stretch of two periods or more has its others as multiples."""
    d, start, length, period = runs
    order = np.lexsort((period, length, start, d))
    out = runs[:, order]
    new = np.ones(len(order), bool)
    new[1:] = np.any(out[:3, 1:] != out[:3, :-1], axis=0)
    out = out[:, new]
    return out[:, np.lexsort((out[3], out[1], out[0]))]


def _found(min_length: int, repeats: int):
    def find(batches):
        for part in arrow_slices(batches, "text", rows=4096):
            texts = part.column(1).to_pylist()
            words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
            count = np.array([len(w) for w in words], np.int64)
            number = {w: k for k, w in enumerate(dict.fromkeys(chain.from_iterable(words)))}
            # A document's words, then a number that is nowhere else.
            first = np.cumsum(count + 1) - count
            inside = np.ones(int(count.sum()) + len(words) + 1, bool)
            inside[np.concatenate(([0], first + count))] = False
            x = np.empty(len(inside), np.int64)
            x[inside] = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64, int(count.sum()))
            x[~inside] = len(number) + np.arange(len(words) + 1)
            doc, start, length, period = runs_of(x, first, count, min_length, repeats)
            gone = covered(first[doc] + start + period, first[doc] + start + length, len(x))
            kept = [b" ".join(compress(w, ~gone[a : a + len(w)])).decode("utf-8", "surrogatepass") for w, a in zip(words, first.tolist(), strict=True)]
            rows = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (start, length, period)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(words) + 1)), pa.int32()), rows)
            yield with_columns(part, ("text",), n_words=pa.array(count), runs=lists, text=pa.array(kept, pa.string()))

    return find


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, repeats: int = MIN_REPEATS) -> DataFrame:
    """``(doc_id, n_words, runs, text)``, a row per row of ``docs``; rows do not depend on each other.

    ``runs`` are all stretches of words with smallest period q and at least ``min_length`` and ``repeats * q`` words that
    no neighbouring word extends, by start and period.  ``text`` is what is left without the words that come after the
    first q of any run, joined by one space.  A null text has no words, no runs and the empty text left.  Repeated rows
    get equal results; ids are passed on, null ones too.  An empty table gives an empty result; other columns are
    ignored.  Words are compared exactly.  A text of n words takes about 200 n bytes.
    """
    if repeats < 2:
        raise ValueError("a run repeats its period at least twice")
    long_rows(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(_found(min_length, repeats), SCHEMA)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Documents of which one in ten, by crc32 of the id, repeats a few of its own words to its end (the query's contract)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def planted(words):
        g, n = F.floor(h / 10).cast("long"), F.size(words).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))).cast("long")
        turn = lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + F.pmod(i - a, p)).cast("int")))
        return F.array_join(F.transform(words, turn), " ")

    words = F.regexp_extract_all("text", F.lit(f"({WORD})"))
    chosen = F.coalesce(F.pmod(h, F.lit(10)) == 0, F.lit(False)) & F.col("text").rlike(WORD)
    return docs.withColumn("text", F.when(chosen, let(words, planted)).otherwise(F.col("text")))


def op12_harmonic_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = periodic_runs(with_planted_runs(docs))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("brief"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return out.withColumn("_l", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_l.before")).alias("start"), F.col("_l.length").alias("length"), (-F.col("_l.brief")).alias("period"),
        F.floor(1000 * F.col("_l.length") / -F.col("_l.brief")).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"),
    )
