"""Substring dedup over words with difference-cover anchors.

A difference cover D modulo v has, for any two positions i and j, a shift s < v with (i + s) % v and (j + s) % v both
in D.  So of two equal windows of w words, both have an anchor (a run of w - v + 1 words at a position in D modulo v)
at the same place inside.  First only anchors are hashed and counted over the corpus; a window without a repeated
anchor cannot repeat.  Then repeated anchors extend to the windows around them, and these are compared.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import _rounds as R
from tidepanel.llm._shared import ordered
from tidepanel.llm._text import BASE2, covered, join_texts, run_hashes, word_bounds, word_hashes

WINDOW = 20
#: A perfect difference cover: every difference modulo 13 occurs once.
PERIOD, COVER = 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1

IN_WORD = np.ones(256, bool)
IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
AT_COVER = np.isin(np.arange(PERIOD), COVER)

SCHEMA = "doc_id long, n_words long, n_removed long, text string"


class _Words:
    """The words of a block's documents."""

    def __init__(self, pdf: pd.DataFrame):
        self.ids = pdf["ord"].to_numpy(np.int64)
        self.buf, self.offsets = join_texts(list(pdf["text"]))
        self.starts, self.ends = word_bounds(self.buf, IN_WORD)
        self.doc = np.searchsorted(self.offsets, self.starts, "right") - 1
        self.count = np.bincount(self.doc, minlength=len(self.ids)).astype(np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.hash = word_hashes(self.buf, self.starts, self.ends)
        self.check = word_hashes(self.buf, self.starts, self.ends, BASE2)

    def inside(self, width: int) -> np.ndarray:
        """Whether the run of ``width`` words from each word on lies in one document."""
        n = len(self.doc)
        return self.doc[width - 1 :] == self.doc[: n - width + 1] if n >= width else np.zeros(0, bool)

    def anchors(self):
        """Positions and hashes of the anchors; distinct hashes, where each anchor has its own, and their counts."""
        ok = self.inside(ANCHOR)
        place = np.arange(len(ok)) - self.first[self.doc[: len(ok)]]
        at = np.flatnonzero(ok & AT_COVER[place % PERIOD])
        return at, *np.unique(run_hashes(self.hash, ANCHOR)[at], return_inverse=True, return_counts=True)

    def windows(self, answers: dict[int, bytes], n: int):
        """Windows that may repeat: positions in order, the class of each, and each class's hash, check and first."""
        at, distinct, own, counts = self.anchors()
        again = (R.read_bits(distinct, n, answers) | (counts > 1))[own]
        a = at[again]
        lo = np.maximum(a - (PERIOD - 1), self.first[self.doc[a]])
        near = covered(lo, a + 1, len(self.hash))
        ok = self.inside(WINDOW)
        p = np.flatnonzero(near[: len(ok)] & ok)
        h, check = run_hashes(self.hash, WINDOW)[p], (run_hashes(self.check, WINDOW, BASE2)[p] >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((p, check, h))
        new = np.ones(len(p), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (check[order][1:] != check[order][:-1])
        own = np.empty(len(p), np.int64)
        own[order] = np.cumsum(new) - 1
        first = order[new]
        return p, own, h[first], check[first], p[first]


def _ask_anchors(pdf):
    _, distinct, _, _ = _Words(pdf).anchors()
    return distinct, lambda at: distinct[at].tobytes()


def _ask_windows(n):
    def ask(pdf, answers):
        words = _Words(pdf)
        _, _, h, check, first = words.windows(answers, n)
        owner = words.ids[words.doc[first]]
        pack = zstandard.ZstdCompressor(3).compress
        return h, lambda at: pack(h[at].tobytes() + check[at].tobytes() + owner[at].tobytes())

    return ask


def _not_first(payloads: list[bytes]) -> list[bytes]:
    """Which windows have an equal one in a document of smaller ``ord`` elsewhere."""
    raw = [zstandard.ZstdDecompressor().decompress(p) for p in payloads]
    sizes = [len(r) // 20 for r in raw]
    h = np.concatenate([np.frombuffer(r, np.uint64, n) for r, n in zip(raw, sizes, strict=True)])
    check = np.concatenate([np.frombuffer(r, np.uint32, n, 8 * n) for r, n in zip(raw, sizes, strict=True)])
    owner = np.concatenate([np.frombuffer(r[12 * n :], np.int64, n) for r, n in zip(raw, sizes, strict=True)])
    order = np.lexsort((owner, check, h))
    same = np.zeros(len(h), bool)
    same[1:] = (h[order][1:] == h[order][:-1]) & (check[order][1:] == check[order][:-1])
    out = np.empty(len(h), bool)
    out[order] = same
    return [R.write_bits(x) for x in np.split(out, np.cumsum(sizes)[:-1])]


def _remove(n):
    def last(pdf, answers1, answers2):
        words = _Words(pdf)
        p, own, h, _, first = words.windows(answers1, n)
        gone = R.read_bits(h, n, answers2)[own]
        if len(p):
            # Rows that share ``ord`` are one document: its windows start at the same places, none of them earlier.
            o, f = words.ids[words.doc[p]], words.ids[words.doc[first]][own]
            place, start = p - words.first[words.doc[p]], (first - words.first[words.doc[first]])[own]
            gone |= (o != f) | (place > start)
        hit = covered(p[gone], p[gone] + WINDOW, len(words.hash))
        keep = ~hit
        # Kept words with one space after each; the byte after a word is always a separator.
        out = words.buf.copy()
        out[words.ends] = 0x20
        mask = covered(words.starts[keep], words.ends[keep] + 1, len(out))
        edge = np.concatenate(([0], np.cumsum(mask)))[words.offsets]
        out = out[mask].tobytes()
        texts = [out[a : b - 1].decode("utf-8", "replace") if b > a else "" for a, b in zip(edge[:-1], edge[1:], strict=True)]
        removed = np.bincount(words.doc[hit], minlength=len(words.ids))
        return pd.DataFrame({"doc_id": pdf["doc_id"], "n_words": words.count, "n_removed": removed.astype(np.int64), "text": texts})

    return last


def dedup_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_removed, text)``: texts without the words of windows that start earlier as well.

    A window is 20 consecutive words of a document; earlier means a smaller doc_id, or the same document and an
    earlier start.  Kept words are joined by one space.  A null text has no words.  Null ids come last; rows that
    repeat an id are ordered by a hash of the text, and rows that repeat id and text are one document listed twice:
    they get the same result.  An empty table gives an empty result; other columns are ignored.  Windows are compared
    by a hash of 64 and one of 32 bits, each over word hashes of its own.
    """
    rounds = R.Rounds(ordered(docs, id_col, text_col))
    n = rounds.buckets
    return rounds.run(_ask_anchors, R.asked_elsewhere, _ask_windows(n), _not_first, _remove(n), SCHEMA)


def op3_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
