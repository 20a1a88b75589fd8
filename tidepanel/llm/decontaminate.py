"""Benchmark decontamination by a prefix-filtered set join.

An item is a set of windows: each 13 consecutive words, or all its words where it has fewer.  As a window counts only
if all its words occur in order, its necessary prefix in the order of rarity is one word, the rarest by the counts
over all documents.  Document words are joined with these prefix words; the word's place in the window (positional
bound) and the room left in the document (length bound) give the only place where the window can be; there all words
are compared, first by hash and then by their bytes.

The benchmark's windows are broadcast while its words, which are counted first, number at most ``BROADCAST_WINDOWS``.
A larger benchmark is cut on executors, and words, places and windows are joined by shuffles; a window is then known by
the SHA-256 digest of its words instead of the words.  What is broadcast there has a fixed size: a bitmap of words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm._shared import join_counted, long_rows, materialize, ordered
from tidepanel.llm._text import arrow_slices, covered, join_texts, run_hashes, slices, tidy, with_columns, word_bounds, word_hashes

WINDOW = 13
#: About 200 bytes each: 40 MB at most are broadcast at once.
BROADCAST_WINDOWS = 200_000

#: Bits, and bits a row, of the map that says which words may matter; a false yes costs a row of the join, no result.
BITS, ROW_BITS = 1 << 26, 1 << 12
#: A place in a window of a width is one number, so all of a word's fit two longs.
WIDTHS = np.repeat(np.arange(1, WINDOW + 1), np.arange(1, WINDOW + 1))
PLACES = np.concatenate([np.arange(n) for n in range(1, WINDOW + 1)])
LOW = 63

IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class _Words:
    """The lower-case words of texts."""

    def __init__(self, texts: list):
        buf, self.offsets = join_texts(texts)
        self.buf = LOWER[buf]
        self.starts, self.ends = word_bounds(self.buf, IN_WORD)
        self.doc = np.searchsorted(self.offsets, self.starts, "right") - 1
        self.count = np.bincount(self.doc, minlength=len(texts)).astype(np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.hash = word_hashes(self.buf, self.starts, self.ends)

    def bytes_of(self, i: int, n: int) -> bytes:
        """Words i to i + n, with one space after each."""
        return b"".join(self.buf[a:b].tobytes() + b" " for a, b in zip(self.starts[i : i + n], self.ends[i : i + n], strict=True))


class Windows:
    """The distinct windows of some items, each with its words and the items that hold it."""

    def __init__(self, items: list[tuple]):
        text = _Words([t for _, t in items])
        found: dict[bytes, tuple[dict, np.ndarray]] = {}
        for k, (item, _) in enumerate(items):
            n, at = int(text.count[k]), int(text.first[k])
            width = min(n, WINDOW)
            for i in range(at, at + n - width + 1 if width else at):
                ids, _ = found.setdefault(text.bytes_of(i, width), ({}, text.hash[i : i + width]))
                ids[item] = True
        self.words = list(found)
        self.items = [list(ids) for ids, _ in found.values()]
        self.hashes = [h for _, h in found.values()]
        self.vocabulary = np.unique(np.concatenate(self.hashes)) if found else np.zeros(0, np.uint64)

    def index(self, counts: dict[int, int]) -> None:
        """Order each window's words by rarity and keep its prefix: the rarest word (the first of equals)."""
        self.width = np.array([len(h) for h in self.hashes], np.int64)
        self.place = np.array([min(range(len(h)), key=lambda i: (counts.get(int(h[i]), 0), i)) for h in self.hashes], np.int64)
        prefix = np.array([h[p] for h, p in zip(self.hashes, self.place, strict=True)], np.uint64)
        self.whole = np.array([run_hashes(h, len(h))[0] for h in self.hashes], np.uint64)
        self.order = np.argsort(prefix, kind="stable")
        self.prefix, self.from_, self.times = np.unique(prefix[self.order], return_index=True, return_counts=True)

    def occurrences(self, text: _Words) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``text`` and the windows that occur there."""
        at = np.searchsorted(self.prefix, text.hash)
        at[at == len(self.prefix)] = 0
        word = np.flatnonzero(self.prefix[at] == text.hash)
        k = at[word]
        n = self.times[k]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        window = self.order[np.repeat(self.from_[k], n) + step]
        word = np.repeat(word, n)
        doc = text.doc[word]
        start = word - self.place[window]
        fits = (start >= text.first[doc]) & (start + self.width[window] <= text.first[doc] + text.count[doc])
        start, window = start[fits], window[fits]
        same = np.zeros(len(start), bool)
        for width in np.unique(self.width[window]):
            of = np.flatnonzero(self.width[window] == width)
            same[of] = run_hashes(text.hash, int(width))[start[of]] == self.whole[window[of]]
        start, window = start[same], window[same]
        equal = np.array([text.bytes_of(s, self.width[w]) == self.words[w] for s, w in zip(start, window, strict=True)], bool)
        return start[equal], window[equal]


def _count_words(docs: DataFrame, vocabulary: np.ndarray) -> dict[int, int]:
    """How often each word of the benchmark occurs in all documents; sums of arrays as long as the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def counted(batches):
        words = shared.value
        total = np.zeros(len(words), np.int64)
        for pdf in batches:
            texts = list(pdf["text"])
            for i, j in slices(texts):
                h = _Words(texts[i:j]).hash
                at = np.searchsorted(words, h)
                at[at == len(words)] = 0
                total += np.bincount(at[words[at] == h], minlength=len(words))
        tidy()
        some = np.flatnonzero(total)
        yield pd.DataFrame({"word": some.astype(np.int64), "n": total[some]})

    got = docs.select("text").mapInPandas(counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    shared.destroy()
    return {int(vocabulary[r["word"]]): r["n"] for r in got}


def _n_words(benchmark: DataFrame) -> int:
    """About how many words, and so at most how many windows, the benchmark has."""
    n = F.sum(F.size(F.split("text", "[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+")))
    return benchmark.agg(n.alias("n")).first()["n"] or 0


def _finished(text: _Words, start: np.ndarray, end: np.ndarray, found: list) -> dict:
    """Counts, spans and the verdict from the places of windows."""
    hit = covered(start, end, len(text.hash)) if len(start) else np.zeros(len(text.hash), bool)
    doc = text.doc
    same = doc[1:] == doc[:-1]
    begins, ends = hit.copy(), hit.copy()
    begins[1:] &= ~(hit[:-1] & same)
    ends[:-1] &= ~(hit[1:] & same)
    spans: list[list] = [[] for _ in found]
    for s, e in zip(np.flatnonzero(begins), np.flatnonzero(ends), strict=True):
        spans[doc[s]].append([int(s - text.first[doc[s]]), int(e + 1 - text.first[doc[s]])])
    n_hit = np.bincount(doc[hit], minlength=len(found)).astype(np.int64)
    return {"n_words": text.count, "n_hit": n_hit, "items": [sorted(x - {None}) + [None] * (None in x) for x in found], "spans": spans, "contaminated": (n_hit > 0) & (20 * n_hit >= text.count)}


FOUND = "n_words long, n_hit long, items array<string>, spans array<array<long>>, contaminated boolean"
ARROW = {"n_words": pa.int64(), "n_hit": pa.int64(), "items": pa.list_(pa.string()), "spans": pa.list_(pa.list_(pa.int64())), "contaminated": pa.bool_()}


def _at_once(rows: DataFrame, texts: str, items: DataFrame) -> DataFrame:
    """The benchmark is small: its windows are broadcast, documents stay where they are."""
    windows = Windows([(r["item_id"], r["text"]) for r in items.collect()])
    windows.index(_count_words(rows.select(F.col(texts).alias("text")), windows.vocabulary) if len(windows.vocabulary) else {})
    shared = rows.sparkSession.sparkContext.broadcast(windows)

    def joined(batches):
        w = shared.value
        for part in arrow_slices(batches, texts):
            text = _Words(part.column(part.schema.get_field_index(texts)).to_pylist())
            none = np.zeros(0, np.int64)
            start, window = w.occurrences(text) if w.words else (none, none)
            found: list[set] = [set() for _ in range(part.num_rows)]
            for d, k in zip(text.doc[start], window, strict=True):
                found[d].update(w.items[k])
            got = _finished(text, start, start + w.width[window] if w.words else none, found)
            yield with_columns(part, ("_text",), **{k: pa.array(v, ARROW[k]) for k, v in got.items()})

    return rows.mapInArrow(joined, f"{_fields(rows)}, {FOUND}")


def _item_windows(items: DataFrame) -> DataFrame:
    """``(item_id, window, words)``: the digest and the word hashes of every window of every item."""

    def cut(batches):
        for pdf in batches:
            for item, whole in zip(pdf["item_id"], pdf["text"], strict=True):
                text = _Words([whole])
                n = len(text.hash)
                width = min(n, WINDOW)
                last = n - width + 1 if width else 0
                words = text.hash.view(np.int64)
                for i in range(0, last, 4096):
                    at = range(i, min(i + 4096, last))
                    digests = [hashlib.sha256(text.bytes_of(k, width)).digest() for k in at]
                    yield pd.DataFrame({"item_id": pd.Series([item] * len(at), dtype=object), "window": digests, "words": [words[k : k + width] for k in at]})

    return items.mapInPandas(cut, "item_id string, window binary, words array<long>")


def _bitmap(words: DataFrame) -> np.ndarray:
    """A map of ``BITS`` bits with those of the given words set, whatever their number; packed on executors."""

    def pack(pdf):
        bits = np.zeros(ROW_BITS, bool)
        bits[pdf["bit"].to_numpy()] = True
        return pd.DataFrame({"row": pdf["row"].iloc[:1], "bits": [np.packbits(bits).tobytes()]})

    slot = F.pmod("word", F.lit(BITS))
    slots = words.select(F.floor(slot / ROW_BITS).alias("row"), F.pmod(slot, F.lit(ROW_BITS)).alias("bit")).distinct()
    out = np.zeros((BITS // ROW_BITS, ROW_BITS // 8), np.uint8)
    for r in slots.groupBy("row").applyInPandas(pack, "row long, bits binary").collect():
        out[r["row"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def _may_matter(bitmap: np.ndarray, words: np.ndarray) -> np.ndarray:
    slot = np.mod(words.view(np.int64), BITS)
    return (bitmap[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1


def _word_counts(docs: DataFrame, bitmap) -> DataFrame:
    """``(word, n)``: how often words of the bitmap occur in all documents, summed by slices before the shuffle."""

    def counted(batches):
        for pdf in batches:
            texts = list(pdf["text"])
            for i, j in slices(texts):
                h = _Words(texts[i:j]).hash
                word, n = np.unique(h[_may_matter(bitmap.value, h)], return_counts=True)
                yield pd.DataFrame({"word": word.view(np.int64), "n": n.astype(np.int64)})
        tidy()

    return docs.select("text").mapInPandas(counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _word_places(docs: DataFrame, bitmap) -> DataFrame:
    """``(ord, at, word)``: where documents have words of the bitmap."""

    def found(batches):
        for pdf in batches:
            texts, ords = list(pdf["text"]), pdf["ord"].to_numpy()
            for i, j in slices(texts):
                text = _Words(texts[i:j])
                k = np.flatnonzero(_may_matter(bitmap.value, text.hash))
                doc = text.doc[k]
                yield pd.DataFrame({"ord": ords[i:j][doc], "at": k - text.first[doc], "word": text.hash[k].view(np.int64)})
        tidy()

    return docs.select("ord", "text").mapInPandas(found, "ord long, at long, word long")


def _candidates(docs: DataFrame) -> DataFrame:
    """``(ord, start, end, window)``: the digests of the documents' own windows at the places that prefixes name."""

    def bit(value, k):
        return (np.array(value, np.int64)[:, None] >> k) & 1 == 1

    def cut(batches):
        for pdf in batches:
            texts, ords = list(pdf["text"]), pdf["ord"].to_numpy()
            for i, j in slices(texts):
                text = _Words(texts[i:j])
                for k, spots in enumerate(pdf["spots"].iloc[i:j]):
                    at = np.array([s["at"] for s in spots], np.int64)
                    low, high = bit([s["low"] for s in spots], np.arange(LOW)), bit([s["high"] for s in spots], np.arange(len(WIDTHS) - LOW))
                    spot, code = np.nonzero(np.hstack([low, high]))
                    start = at[spot] - PLACES[code]
                    fits = (start >= 0) & (start + WIDTHS[code] <= text.count[k])
                    places = np.unique(np.stack([start[fits], start[fits] + WIDTHS[code][fits]], 1), axis=0)
                    first = int(text.first[k])
                    digests = [hashlib.sha256(text.bytes_of(first + int(a), int(b - a))).digest() for a, b in places]
                    yield pd.DataFrame({"ord": np.full(len(places), ords[i + k]), "start": places[:, 0], "end": places[:, 1], "window": digests})
        tidy()

    return docs.mapInPandas(cut, "ord long, start long, end long, window binary")


def _by_join(rows: DataFrame, texts: str, items: DataFrame) -> DataFrame:
    """The benchmark is large: words, places and windows meet in shuffles, each of linear size."""
    share = rows.sparkSession.sparkContext.broadcast
    d = ordered(rows, "_id", texts, rows=True)
    cut = materialize(_item_windows(items), "item_windows")
    windows = cut.groupBy("window").agg(F.first("words").alias("words"))
    spots = materialize(windows.select("window", F.size("words").alias("width"), F.posexplode("words").alias("place", "word")), "window_words")
    vocabulary = share(_bitmap(spots))
    times = spots.groupBy("word").agg(F.count("*").alias("times"))
    # A window with a word that no document has occurs nowhere: the join leaves it fewer words than its width.
    counts = materialize(times.join(_word_counts(d, vocabulary), "word"), "word_counts")
    vocabulary.destroy()
    ranked = join_counted(spots, counts, "word", "times").groupBy("window").agg(F.min(F.struct("n", "place", "word")).alias("rarest"), F.count("*").alias("known"), F.first("width").alias("width"))
    code = F.expr("width * (width - 1) div 2 + rarest.place")
    prefixes = ranked.where("known = width").select("rarest.word", "rarest.n", code.cast("int").alias("code"))
    low, high = F.expr(f"if(code < {LOW}, shiftleft(1L, code), 0L)"), F.expr(f"if(code >= {LOW}, shiftleft(1L, code - {LOW}), 0L)")
    prefixes = materialize(prefixes.groupBy("word").agg(F.first("n").alias("n"), F.bit_or(low).alias("low"), F.bit_or(high).alias("high")), "prefixes")
    wanted = share(_bitmap(prefixes))
    places = join_counted(_word_places(d, wanted), prefixes, "word", "n")
    # A document's spots number its words at most.
    spots_of = places.groupBy("ord").agg(F.collect_set(F.struct("at", "low", "high")).alias("spots"))
    found = materialize(_candidates(d.select("ord", "text").join(spots_of, "ord")), "candidates")
    wanted.destroy()
    held = cut.select("window", "item_id").distinct()
    held = materialize(found.groupBy("window").agg(F.count("*").alias("times")).join(held, "window"), "held")
    hits = join_counted(found, held.select("window", "times").distinct(), "window", "times")
    ids = join_counted(found.select("ord", "window").distinct(), held, "window", "times")
    at = hits.groupBy("ord").agg(F.collect_set(F.struct("start", "end")).alias("places"))
    ids = ids.groupBy("ord").agg(F.collect_set(F.struct("item_id")).alias("found"))
    joined = d.join(at.join(ids, "ord"), "ord", "left").select("row.*", F.col("text").alias("_whole"), "places", "found")

    def finished(batches):
        for pdf in batches:
            whole = list(pdf["_whole"])
            for i, j in slices(whole):
                text = _Words(whole[i:j])
                at = [(text.first[k] + p["start"], text.first[k] + p["end"]) for k, ps in enumerate(pdf["places"].iloc[i:j]) if ps is not None for p in ps]
                start, end = np.array(at, np.int64).reshape(-1, 2).T
                ids = [{x["item_id"] for x in xs} if xs is not None else set() for xs in pdf["found"].iloc[i:j]]
                yield pdf.iloc[i:j].drop(columns=["_whole", "places", "found", "_text"], errors="ignore").assign(**_finished(text, start, end, ids))

    return joined.mapInPandas(finished, f"{_fields(rows)}, {FOUND}")


def _fields(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_text")


def contamination(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", unnamed: bool = False) -> DataFrame:
    """``(doc_id, n_words, n_hit, items, spans, contaminated)`` and the ``keep`` columns for every whole text.

    ``items`` are the ids, as sorted strings, of items with a window in the text; ``spans`` the maximal runs of hit
    words.  A text is contaminated if a word is hit and at least a twentieth of all are.  Null texts and items have no
    words; null item ids are left out, or with ``unnamed`` hit like others and are together one null at the end of
    ``items``; repeated items count once by id; repeated rows are separate documents; empty
    tables give empty or clean results; other columns are ignored.
    """
    long_rows(docs.sparkSession)
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("text is not null" if unnamed else "item_id is not null and text is not null")
    names = [f"_k{i}" for i in range(len(keep))]
    texts = names[keep.index(text_col)] if text_col in keep else "_text"
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.col(id_col).alias("_id"), *[F.col(text_col).cast("string").alias("_text")] * (texts == "_text"))
    out = (_at_once if _n_words(items) <= BROADCAST_WINDOWS else _by_join)(rows, texts, items)
    names_out = [F.col(n).alias(c) for n, c in zip(names, keep, strict=True) if c != "doc_id"]
    return out.select(F.col("_id").alias("doc_id"), *names_out, "n_words", "n_hit", "items", "spans", "contaminated")


def op8_prefix_filtered_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), unnamed=True)
    ids = F.concat_ws(",", "items").cast("binary")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), "contaminated")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT DISTINCT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), m AS (
  SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.n = bw.n
), h AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id
), k AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id)
"""
