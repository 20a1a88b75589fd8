"""Suffix-array dedup over bytes by prefix-free parsing.

A rolling hash picks triggers: the grams that are least in some window of ``LENGTH`` bytes.  They cut texts into
phrases, and every string of ``LENGTH`` bytes holds at least one trigger, at the same place wherever the string occurs.
So a string is a suffix of what comes before its trigger and a prefix of what comes from it on, and it reaches
``LEFT`` bytes back and ``LENGTH`` bytes on at most.  Triggers whose gram occurs once are dropped.

For the others, by buckets of grams:

* The dictionary: the distinct sides of the triggers, the phrases before one (read backwards) and from one on, as far
  as a string can reach.  Sorted by their bytes they get ranks, and each the length of the common prefix with the one
  before it: the suffix order of the dictionary and, as a trigger's right side is its parse's beginning, of the parse.
* The parse: each distinct surrounding of a trigger as the pair of ranks of its sides, once a block however often it
  repeats.
* Combined: at every split l + (``LENGTH`` - l) a run of the left order with common prefixes of l or more, and one of
  the right order with ``LENGTH`` - l or more, are classes of equal bytes; two triggers with the same pair of classes
  have an equal string there.

A gram that more than ``HOT`` blocks have would bring ever more surroundings to one bucket.  The strings around such a
gram are dealt by their own 256-bit BLAKE2 digests instead, each distinct one once a block: a digest stands for the
bytes, as no two texts with the same one are known.  The result does not depend on ``HOT``.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import _rounds as R
from tidepanel.llm._shared import ordered
from tidepanel.llm._text import BASE, BYTE_CODES, covered, join_texts, mix, powers, prefix_sums

LENGTH = 200
GRAM = 64
#: Bytes of a string that may lie before its trigger.
LEFT = LENGTH - GRAM
WIDTH = LEFT + LENGTH
STEP = 1 << 17
#: Beyond so many blocks that have a gram, its surroundings do not meet in one bucket.
HOT = 512

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """The best of every ``width`` consecutive values."""
    n, w = len(x) - width + 1, 1
    while 2 * w <= width:
        x = best(x[:-w], x[w:])
        w *= 2
    return best(x[:n], x[width - w : width - w + n])


class _Phrases:
    """A block's bytes and its triggers."""

    def __init__(self, pdf: pd.DataFrame):
        self.buf, self.offsets = join_texts(list(pdf["text"]))
        self.begin, self.end = self.offsets[:-1], self.offsets[1:] - 1
        self.at, self.gram = self._triggers()
        self.doc = np.searchsorted(self.offsets, self.at, "right") - 1
        self.distinct, self.own, self.counts = np.unique(self.gram, return_inverse=True, return_counts=True)

    def _triggers(self):
        n = len(self.buf) - LENGTH + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        some = self.end - self.begin >= LENGTH
        ok = covered(self.begin[some], self.end[some] - LENGTH + 1, n)
        found, grams = [], []
        for a in range(0, n, STEP):
            valid = ok[a : a + STEP]
            if not valid.any():
                continue
            s = prefix_sums(BYTE_CODES[self.buf[a : a + len(valid) + LENGTH - 1]], BASE)
            m = len(s) - GRAM
            g = mix((s[GRAM:] - s[:-GRAM]) * powers(BASE, m)[1])
            short = (g >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
            least = np.where(valid, _sliding(short, LEFT + 1, np.minimum), np.uint32(0))
            pad = np.zeros(LEFT, np.uint32)
            reach = _sliding(np.concatenate((pad, least, pad)), LEFT + 1, np.maximum)
            q = np.flatnonzero(short == reach)
            found.append(q + a)
            grams.append(g[q])
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at, first = np.unique(np.concatenate(found), return_index=True)
        return at, np.concatenate(grams)[first]

    def surroundings(self, answers: dict[int, bytes], n: int):
        """Repeated triggers; the surroundings of each, by number; the distinct ones, their grams, counts and heat.

        A surrounding is LEFT bytes backwards from the trigger, then LENGTH bytes from it on, each plus 1 (no UTF-8
        byte is 255), and 0 beyond the document.
        """
        elsewhere, often = R.read_bits(self.distinct, n, answers, 2)
        again = (elsewhere | (self.counts > 1))[self.own]
        at, doc, gram, hot = self.at[again], self.doc[again], self.gram[again], often[self.own][again]
        rows = np.zeros((len(at), WIDTH), np.uint8)
        back, on = -1 - np.arange(LEFT), np.arange(LENGTH)
        for a in range(0, len(at), 4096):
            t, d = at[a : a + 4096, None], doc[a : a + 4096, None]
            i = t + back
            rows[a : a + 4096, :LEFT] = np.where(i >= self.begin[d], self.buf[np.maximum(i, 0)] + 1, 0)
            i = t + on
            rows[a : a + 4096, LEFT:] = np.where(i < self.end[d], self.buf[np.minimum(i, len(self.buf) - 1)] + 1, 0)
        if not len(at):
            return at, np.zeros(0, np.int64), rows, gram, np.zeros(0, np.int64), hot
        _, first, own, counts = np.unique(rows.view(f"V{WIDTH}").ravel(), return_index=True, return_inverse=True, return_counts=True)
        # Cold ones first, as their messages come first.
        order = np.argsort(hot[first], kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        first = first[order]
        return at, place[own], rows[first], gram[first], counts[order], hot[first]


def _ask_grams(pdf):
    distinct = _Phrases(pdf).distinct
    return distinct, lambda at: distinct[at].tobytes()


DIGEST = 32


def _strings(rows: np.ndarray):
    """The distinct strings in hot surroundings.

    A string counts with the place of its trigger, as it is seen from each trigger in it.  The bucket hash and digest of
    each; the surrounding and the bytes before the trigger of every occurrence, and its
    string.
    """
    none = np.zeros(0, np.int64)
    if not len(rows):
        return np.zeros(0, np.uint64), np.zeros((0, DIGEST), np.uint8), none, none, none
    n_left, n_right = (rows[:, :LEFT] > 0).sum(axis=1), (rows[:, LEFT:] > 0).sum(axis=1)
    before = np.arange(LEFT + 1)
    of, at = np.nonzero((n_left[:, None] >= before) & (n_right[:, None] >= LENGTH - before))
    whole = [rows[k, LEFT - 1 :: -1].tobytes() + rows[k, LEFT:].tobytes() for k in range(len(rows))]
    digests = b"".join(blake2b(bytes([b]) + whole[k][LEFT - b : LEFT - b + LENGTH], digest_size=DIGEST).digest() for k, b in zip(of.tolist(), at.tolist(), strict=True))
    distinct, own = np.unique(np.frombuffer(digests, f"V{DIGEST}"), return_inverse=True)
    digest = distinct.view(np.uint8).reshape(-1, DIGEST)
    return np.ascontiguousarray(digest[:, :8]).view(np.uint64).ravel(), digest, of, at, own


def _asked_where(payloads: list[bytes]) -> list[bytes]:
    """For payloads of distinct grams two rows of bits: which ones others have too, and which more than ``HOT`` have."""
    sizes = [len(p) // 8 for p in payloads]
    _, own, times = np.unique(np.frombuffer(b"".join(payloads), np.uint64), return_inverse=True, return_counts=True)
    times = np.split(times[own], np.cumsum(sizes)[:-1])
    return [np.packbits(t > 1).tobytes() + np.packbits(t > HOT).tobytes() if (t > 1).any() else b"" for t in times]


def _ask_surroundings(n):
    def ask(pdf, answers):
        _, _, rows, gram, _, hot = _Phrases(pdf).surroundings(answers, n)
        cold = int((~hot).sum())
        h, digest, _, _, _ = _strings(rows[cold:])
        pack = zstandard.ZstdCompressor(3).compress

        def payload(at):
            c, w = at[at < cold], at[at >= cold] - cold
            return np.uint32(len(c)).tobytes() + pack(rows[c].tobytes() + digest[w].tobytes())

        return np.concatenate((gram[:cold], h)), payload

    return ask


def _answer(payloads: list[bytes]) -> list[bytes]:
    """Per payload two bytes a surrounding, then a bit a string, see :func:`_equal_strings`."""
    raw = [(int(np.frombuffer(p, np.uint32, 1)[0]), zstandard.ZstdDecompressor().decompress(p[4:])) for p in payloads]
    ranges = _equal_strings([r[: k * WIDTH] for k, r in raw])
    rest = [r[k * WIDTH :] for k, r in raw]
    _, own, times = np.unique(np.frombuffer(b"".join(rest), f"V{DIGEST}"), return_inverse=True, return_counts=True)
    shared = times[own] > 1 if len(own) else np.zeros(0, bool)
    bits = np.split(shared, np.cumsum([len(r) // DIGEST for r in rest])[:-1])
    return [x.tobytes() + np.packbits(b).tobytes() if x.any() or b.any() else b"" for x, b in zip(ranges, bits, strict=True)]


def _dictionary(sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each side's rank among the distinct ones, and how many bytes each of these shares with the one before it."""
    width = sides.shape[1]
    _, first, rank = np.unique(np.ascontiguousarray(sides).view(f"S{width}").ravel(), return_index=True, return_inverse=True)
    words = sides[first]
    common = np.zeros(len(words), np.int64)
    for a in range(1, len(words), STEP // width):
        differ = words[a : a + STEP // width] != words[a - 1 : a - 1 + STEP // width][: len(words) - a]
        common[a : a + STEP // width] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return rank, common


def _equal_strings(raw: list[bytes]) -> list[np.ndarray]:
    """Per surrounding two bytes: 1 + the least and the most bytes before the trigger of strings that repeat, or 0, 0."""
    sizes = [len(r) // WIDTH for r in raw]
    rows = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, WIDTH)
    out = np.zeros((len(rows), 2), np.uint8)
    if len(rows) > 1:
        left, right = rows[:, :LEFT], rows[:, LEFT:]
        n_left, n_right = (left > 0).sum(axis=1), (right > 0).sum(axis=1)
        # The parse is the pair of ranks.
        (rank_l, common_l), (rank_r, common_r) = _dictionary(left), _dictionary(right)
        for before in range(LEFT + 1):
            some = np.flatnonzero((n_left >= before) & (n_right >= LENGTH - before))
            if len(some) < 2:
                continue
            class_l, class_r = np.cumsum(common_l < before), np.cumsum(common_r < LENGTH - before)
            key = class_l[rank_l[some]] * (len(class_r) + 1) + class_r[rank_r[some]]
            order = np.argsort(key)
            same = np.zeros(len(some), bool)
            same[1:] = key[order[1:]] == key[order[:-1]]
            same[:-1] |= same[1:]
            hit = some[order[same]]
            out[hit, 0] = np.where(out[hit, 0] == 0, before + 1, out[hit, 0])
            out[hit, 1] = before + 1
    return np.split(out, np.cumsum(sizes)[:-1])


def _remove(n):
    def last(pdf, answers1, answers2):
        text = _Phrases(pdf)
        at, own, rows, gram, counts, heat = text.surroundings(answers1, n)
        cold = int((~heat).sum())
        h, _, of, before, string = _strings(rows[cold:])
        told, again = np.zeros((len(rows), 2), np.int64), np.bincount(string, weights=counts[cold:][of], minlength=len(h)) > 1
        order, groups = R.by_bucket(np.concatenate((gram[:cold], h)), n)
        for b, i, j in groups:
            if b in answers2:
                mine = order[i:j]
                c, w = mine[mine < cold], mine[mine >= cold] - cold
                told[c] = np.frombuffer(answers2[b], np.uint8, 2 * len(c)).reshape(-1, 2)
                again[w] |= np.unpackbits(np.frombuffer(answers2[b][2 * len(c) :], np.uint8), count=len(w)).astype(bool)
        repeated = again[string]
        of, before = of[repeated] + cold, before[repeated] + 1
        low = np.full(len(rows), WIDTH)
        np.minimum.at(low, of, before)
        np.maximum.at(told[:, 1], of, before)
        told[cold:, 0] = np.where(low[cold:] < WIDTH, low[cold:], 0)
        # A surrounding that this block has twice repeats with all the strings in it.
        most, least = (rows[:, :LEFT] > 0).sum(axis=1), np.maximum(0, LENGTH - (rows[:, LEFT:] > 0).sum(axis=1))
        twice = (counts > 1) & (most >= least)
        told[twice] = np.stack((least, most), axis=1)[twice] + 1
        told = told[own] if len(at) else told
        hit = told[:, 1] > 0
        gone = covered(at[hit] - (told[hit, 1] - 1), at[hit] + LENGTH - (told[hit, 0] - 1), len(text.buf))
        size = text.end - text.begin
        total = np.concatenate(([0], np.cumsum(gone)))
        removed = total[text.end] - total[text.begin]
        # A removed run ends at a document's end, as the byte that follows a text is never removed.
        starts = np.concatenate(([0], np.cumsum(np.diff(gone.astype(np.int8), prepend=0) == 1)))
        spans = starts[text.end] - starts[text.begin]
        kept = [text.buf[a:b][~gone[a:b]].tobytes() if r else text.buf[a:b].tobytes() for a, b, r in zip(text.begin, text.end, removed, strict=True)]
        return pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": size, "n_removed": removed.astype(np.int64), "n_spans": spans.astype(np.int64), "kept": kept})

    return last


def dedup_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept)``: texts without the bytes of 200-byte strings that occur again.

    Every occurrence goes, the first one included, also where strings overlap or repeat in one document; strings never
    cross documents.  ``kept`` is binary, as a cut may fall inside a character.  A null text is empty.  Null and
    repeated ids are no matter: each row is a document, so rows that repeat a text of 200 bytes or more lose it.  An
    empty table gives an empty result; other columns are ignored.
    """
    rounds = R.Rounds(ordered(docs, id_col, text_col))
    n = rounds.buckets
    return rounds.run(_ask_grams, _asked_where, _ask_surroundings(n), _answer, _remove(n), SCHEMA)


def op4_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_strings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
