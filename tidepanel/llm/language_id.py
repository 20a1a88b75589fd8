"""Language identification by nearest centroid.

A text is a vector of hashed character n-gram counts (1 to 3 characters, letters only, lower case), damped by
log(1 + count), weighted by inverse document frequency and scaled to length 1.  Each language has several centroids
from spherical k-means over a bounded sample.  A text gets the language of the centroid with the largest cosine; it is
rejected where that cosine is far below what the language's own sample reaches.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidepanel.llm._shared import discard, long_rows, materialize
from tidepanel.llm._text import arrow_slices, tidy, with_columns

#: Rows per language that the classifier is fitted on, chosen by the hash of the id.
SAMPLE_ROWS = 500
CENTROIDS = 3
DIMS = 1 << 13
#: Characters that are counted at a time.
PIECE = 1 << 17
#: A text is rejected below this part of the least cosines (1st percentile) in its language's sample.
REJECT = 0.5
UNKNOWN = "und"

_lower: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point -> its lower-case letter, or a space."""
    if not _lower:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _lower.append(table)
    return _lower[0]


def _pieces(texts: list):
    """Groups of (row, characters, n-gram starts) of bounded size; long texts are cut with an overlap of 2."""
    group, size = [], 0
    for row, text in enumerate(texts):
        text = text or ""
        for a in range(0, len(text), PIECE):
            part = text[a : a + PIECE + 2]
            group.append((row, part, min(PIECE, len(text) - a)))
            size += len(part)
            if size >= PIECE or len(group) >= 64:
                yield group
                group, size = [], 0
    if group:
        yield group


def count_ngrams(texts: list) -> np.ndarray:
    """A row of n-gram counts per text; all zeros without a letter."""
    out = np.zeros((len(texts), DIMS), np.float32)
    lower = _letters()
    for group in _pieces(texts):
        lengths = np.array([len(p) for _, p, _ in group])
        joined = "".join(p for _, p, _ in group).encode("utf-32-le", "surrogatepass")
        c = lower[np.frombuffer(joined, np.uint32)].astype(np.uint64)
        item = np.repeat(np.arange(len(group)), lengths)
        place = np.arange(len(c)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        own = place < np.array([n for _, _, n in group])[item]
        space = c == 32
        key = c.copy()
        keys, items = [], []
        for n in (1, 2, 3):
            m = len(c) - n + 1
            if m <= 0:
                break
            if n > 1:
                key = key[:m] * np.uint64(0x100000001B3) + c[n - 1 :]
            same = own[:m] & (item[:m] == item[n - 1 :])
            # A single letter, or a run of letters with a space at either end at most.
            good = ~space[:m] if n == 1 else ~(space[:m] & space[1 : m + 1]) & ~(space[n - 2 : n - 2 + m] & space[n - 1 :])
            at = np.flatnonzero(same & good)
            keys.append(((key[at] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(51))
            items.append(item[at])
        if keys:
            flat = np.concatenate(items) * DIMS + np.concatenate(keys).astype(np.int64)
            got = np.bincount(flat, minlength=len(group) * DIMS).reshape(len(group), DIMS)
            np.add.at(out, [row for row, _, _ in group], got.astype(np.float32))
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def has_letter(text) -> bool:
    return text is not None and any(unicodedata.category(ch)[0] == "L" for ch in text)


@dataclass
class Model:
    """Centroids with their languages, term weights, and the cosine below which a language's texts are rejected."""

    langs: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    reject: np.ndarray

    def score(self, texts: list) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and whether the text is rejected."""
        counts = count_ngrams(texts)
        none = counts.sum(axis=1) == 0
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cosines = unit(np.log1p(counts) * self.idf) @ self.centroids.T
        best = self.owner[cosines.argmax(axis=1)]
        top = np.where(none, 0.0, np.clip(cosines.max(axis=1), 0.0, 1.0))
        return [UNKNOWN if x else self.langs[b] for b, x in zip(best, none, strict=True)], top, none | (top < self.reject[best])


def spherical_means(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means by cosine; begins with rows that are far from those chosen so far."""
    chosen = [unit(rows.mean(axis=0, keepdims=True))[0]]
    while len(chosen) < min(k, len(rows)):
        chosen.append(rows[(rows @ np.array(chosen).T).max(axis=1).argmin()])
    centers = np.array(chosen)
    for _ in range(rounds):
        at = (rows @ centers.T).argmax(axis=1)
        centers = np.array([unit(rows[at == i].mean(axis=0, keepdims=True))[0] if (at == i).any() else c for i, c in enumerate(centers)])
    return centers


#: What the fit keeps of a text: the places and values of its n-gram counts.
COUNTED = "doc_id long, lang string, at binary, n binary"
#: Fits are compared and merged per language; so many languages at most have their centroids gathered on the driver.
MAX_LANGS = 1000


def _counted(batches):
    for pdf in batches:
        for a in range(0, len(pdf), 256):
            part = pdf.iloc[a : a + 256]
            rows = count_ngrams(list(part["text"]))
            at = [np.flatnonzero(row) for row in rows]
            yield pd.DataFrame({"doc_id": part["doc_id"], "lang": part["lang"], "at": [x.astype(np.uint16).tobytes() for x in at], "n": [row[x].tobytes() for row, x in zip(rows, at, strict=True)]})
    tidy()


def _dense(pdf: pd.DataFrame) -> np.ndarray:
    """A language's sample as rows of counts, in the order of the ids; texts without a letter are left out."""
    pdf = pdf[pdf["n"].map(len) > 0].sort_values("doc_id", kind="stable")
    rows = np.zeros((len(pdf), DIMS), np.float32)
    for row, at, n in zip(rows, pdf["at"], pdf["n"], strict=True):
        row[np.frombuffer(at, np.uint16)] = np.frombuffer(n, np.float32)
    return rows


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, centroids: int = CENTROIDS) -> Model:
    """Fit on ``(doc_id, text, lang)``: at most ``sample_rows`` rows of each language, those with the least id hashes.

    Ids are counted per language first; only those whose hash is below about four times the sample's share are ranked,
    so that the ranking of a language reads a few thousand ids at any size.  Of rows that repeat an id and language the
    least text counts.  Each language is a group of at most ``sample_rows`` rows of n-gram counts (49 KB each) and is
    fitted on an executor.  The driver gets two arrays a language, document frequencies and centroids, and refuses more
    than ``MAX_LANGS`` languages.
    """
    long_rows(labelled.sparkSession)
    spark = labelled.sparkSession
    usable = labelled.where("doc_id is not null and lang is not null and text is not null")
    ids = usable.select("doc_id", "lang").distinct()
    n = materialize(ids.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    if n.count() > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    h = F.xxhash64("doc_id")
    few = ids.join(F.broadcast(n), "lang").where(h <= F.least(F.lit(1.0), 4.0 * sample_rows / F.col("n")) * 2.0**64 - 2.0**63)
    order = W.partitionBy("lang").orderBy(h, "doc_id")
    ids = few.withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample_rows).select("doc_id", "lang")
    # At most sample_rows * MAX_LANGS ids.
    texts = usable.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi").groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    sample = materialize(texts.select("doc_id", "text", "lang").mapInPandas(_counted, COUNTED), "language-sample")

    def frequencies(key, pdf):
        rows = _dense(pdf)
        return pd.DataFrame({"lang": [key[0]], "rows": [len(rows)], "df": [(rows > 0).sum(axis=0).astype(np.int64).tobytes()]})

    got = [r for r in sample.groupBy("lang").applyInPandas(frequencies, "lang string, rows long, df binary").collect() if r["rows"]]
    total = sum(r["rows"] for r in got)
    df = sum((np.frombuffer(r["df"], np.int64) for r in got), np.zeros(DIMS, np.int64))
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)

    def fitted(key, pdf):
        mine = _dense(pdf)
        if not len(mine):
            return pd.DataFrame({"lang": [], "centers": [], "reject": []})
        mine = unit(np.log1p(mine) * idf)
        c = spherical_means(mine, centroids).astype(np.float32)
        return pd.DataFrame({"lang": [key[0]], "centers": [c.tobytes()], "reject": [float(REJECT * np.percentile((mine @ c.T).max(axis=1), 1))]})

    found = sorted(sample.groupBy("lang").applyInPandas(fitted, "lang string, centers binary, reject double").collect(), key=lambda r: r["lang"])
    centers = [np.frombuffer(r["centers"], np.float32).reshape(-1, DIMS) for r in found]
    owner = np.repeat(np.arange(len(found)), [len(c) for c in centers]).astype(int)
    discard(sample)
    return Model([r["lang"] for r in found], owner, np.concatenate(centers) if centers else np.zeros((0, DIMS), np.float32), idf, np.array([r["reject"] for r in found]))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns, then ``(doc_id, lang_pred, score, rejected)`` for every whole text.

    A null text and one without a letter get ``und``, score 0 and are rejected.  Null and repeated ids pass through;
    an empty table gives an empty result; columns not in ``keep`` are ignored.
    """
    long_rows(docs.sparkSession)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    names = [f"_k{i}" for i in range(len(keep))]
    texts = names[keep.index(text_col)] if text_col in keep else "_text"
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.col(id_col).alias("_id"), *[F.col(text_col).cast("string").alias("_text")] * (texts == "_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_text")

    def predicted(batches):
        m = shared.value
        for part in arrow_slices(batches, texts):
            lang, score, rejected = m.score(part.column(part.schema.get_field_index(texts)).to_pylist())
            yield with_columns(part, ("_text",), lang_pred=pa.array(lang, pa.string()), score=pa.array(score.astype(float)), rejected=pa.array(rejected))

    out = rows.mapInArrow(predicted, f"{fields}, lang_pred string, score double, rejected boolean")
    names_out = [F.col(n).alias(c) for n, c in zip(names, keep, strict=True) if c != "doc_id"]
    return out.select(F.col("_id").alias("doc_id"), *names_out, "lang_pred", "score", "rejected")


def held_out() -> F.Column:
    """Every third document by the CRC of its id is never learned from; a null id isn't held out, nor learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learned(docs: DataFrame) -> Model:
    return fit(docs.where(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "text", "lang"))


def op2_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs, learned(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
