"""MinHash near-dedup by a multi-index Hamming join.

A document's signature has 128 symbols: the low 16 bits of as many minima of hashes of its shingles.  Two sets of Jaccard
similarity s differ in a symbol with probability 1 - s, so linked ones (0.85) differ in few.  The first 40 symbols are
split into ten chunks of four.  Two signatures that differ in at most 19 of them have, by the pigeonhole principle, a
chunk with at most one error, so every document is listed under each chunk with each one of its symbols left out (40
keys), and such pairs meet under a key for certain.  A pair of similarity 0.85 differs in 20 or more of 40 with
probability 2e-7, and in more than ``FAR`` of 128, beyond which a meeting is not followed up, with 4e-7.

Components are wanted, not all links, so pairs are tested in turns.  Each bucket (documents under a key) tests its members
against one of them, its pivot.  Members of buckets that are not all connected yet are peeled: one with more than 0.15 of
its shingles in no other such member can have no further link, and without it others may have none.  What is left is listed
under its rarest shingles, so many that linked documents share one; under each, pairs that are not connected are tested in
blocks, unless what comes before that shingle leaves too few to share.  Every test compares the full sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidepanel.llm._shared import discard, join_counted, keep_ids, materialize, ordered, partitions
from tidepanel.llm._text import arrow_slices, mix, tidy, with_columns
from tidepanel.llm.jaccard_join import components, overlap, shingle_sets

#: Documents are linked if they share at least UP / DOWN of their union.
UP, DOWN = 85, 100
SYMBOLS, INDEXED, CHUNK = 128, 40, 4
#: Symbols of 128 in which a pair that is followed up may differ.
FAR = 42
#: How often members that can have no link are peeled off; what is left is compared.
PEELS = 3
#: Members of a bucket that a block holds, and about as many shingles as a task of blocks holds.
PART, TASK_SHINGLES = 2048, 1 << 20
#: Pairs that meet one copy of a document's text.
SPREAD = 1024

_RANDOM = np.random.default_rng(13)
XOR = _RANDOM.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)
TIMES = _RANDOM.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def lower(text: str | None) -> str:
    """A to Z in lower case, other letters as they are."""
    return (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def signatures(hashes: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """A row of 16-bit symbols for each set ``hashes[edge[k]:edge[k + 1]]``; zeros for empty ones."""
    out = np.zeros((len(edge) - 1, SYMBOLS), np.uint16)
    some = np.flatnonzero(np.diff(edge))
    if len(some):
        work = np.empty(len(hashes), np.uint64)
        for k in range(SYMBOLS):
            np.bitwise_xor(hashes, XOR[k], out=work)
            np.multiply(work, TIMES[k], out=work)
            out[some, k] = mix(np.minimum.reduceat(work, edge[some])).astype(np.uint16)
    return out


def index_keys(sig: np.ndarray) -> np.ndarray:
    """The 40 keys of each signature: a chunk with one symbol left out, and which one, packed without collisions."""
    parts = sig[:, :INDEXED].astype(np.int64).reshape(len(sig), -1, CHUNK)
    out = np.zeros((len(sig), INDEXED), np.int64)
    for c in range(INDEXED // CHUNK):
        for left_out in range(CHUNK):
            key = np.full(len(sig), c * CHUNK + left_out, np.int64)
            for k in range(CHUNK):
                if k != left_out:
                    key = key << 16 | parts[:, c, k]
            out[:, c * CHUNK + left_out] = key
    return out


def _signed(batches):
    for part in arrow_slices(batches, "text", rows=4096):
        texts = [lower(t) for t in part.column(part.schema.get_field_index("text")).to_pylist()]
        h, edge = shingle_sets(texts)
        digest = [hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        sig = [row.tobytes() for row in signatures(h, edge)]
        yield with_columns(part, ("text",), n=pa.array(np.diff(edge).astype(np.int64)), digest=pa.array(digest, pa.binary()), sig=pa.array(sig, pa.binary()))


def _symbols(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(-1, SYMBOLS)


def _listed(batches):
    for batch in batches:
        keys = index_keys(_symbols(batch.column(1).to_pylist()))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * INDEXED, pa.int32()), pa.array(keys.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["rep", "keys"])


def _alike(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return DOWN * np.minimum(n, m) >= UP * np.maximum(n, m)


def _near(batches):
    """Pairs whose signatures are near enough to be followed up."""
    for batch in batches:
        get = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
        errors = np.count_nonzero(_symbols(get("sig_a").to_pylist()) != _symbols(get("sig_b").to_pylist()), axis=1)
        ok = (errors <= FAR) & _alike(get("n_a").to_numpy(), get("n_b").to_numpy())
        yield pa.RecordBatch.from_arrays([get("a"), get("b")], names=["a", "b"]).filter(pa.array(ok))


def _beside(pairs: DataFrame, side: str, other: str, table: DataFrame) -> DataFrame:
    """``pairs`` with the columns of ``table`` for the document of one side; a document of very many pairs is dealt out in copies."""
    counts = materialize(pairs.groupBy(F.col(side).alias("_k")).agg(F.count("*").alias("_n")), "counts")
    rows = counts.join(table, "_k")
    if (counts.agg(F.max("_n")).first()[0] or 0) <= SPREAD:
        return pairs.withColumnRenamed(side, "_k").join(rows.drop("_n"), "_k").withColumnRenamed("_k", side)
    copies = F.ceil(F.col("_n") / SPREAD)
    pairs = join_counted(pairs.withColumnRenamed(side, "_k"), counts, "_k", "_n", SPREAD).withColumn("_s", F.pmod(F.xxhash64(other), copies)).drop("_n")
    rows = rows.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1))).drop("_n")
    return pairs.join(rows, ["_k", "_s"]).drop("_s").withColumnRenamed("_k", side)


def _squeezed(batches):
    for part in arrow_slices(batches, "text", rows=4096):
        pack = zstandard.ZstdCompressor(3).compress
        bodies = [pack(lower(t).encode("utf-8", "surrogatepass")) for t in part.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bodies, pa.binary())], names=["_k", "body"])


def _linked(batches):
    """Pairs whose full sets reach the threshold."""
    for batch in batches:
        a, b = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("body_a", "body_b"))
        open_ = zstandard.ZstdDecompressor().decompress
        ok = np.zeros(batch.num_rows, bool)
        for i in range(0, batch.num_rows, 64):
            # Neighbouring rows often have the same document on one side.
            number = {body: k for k, body in enumerate(dict.fromkeys(a[i : i + 64] + b[i : i + 64]))}
            h, edge = shingle_sets([open_(body).decode("utf-8", "surrogatepass") for body in number])
            sets = [h[x:y] for x, y in zip(edge[:-1], edge[1:], strict=True)]
            for k, (x, y) in enumerate(zip(a[i : i + 64], b[i : i + 64], strict=True), i):
                x, y = sets[number[x]], sets[number[y]]
                ok[k] = (UP + DOWN) * shared(x, y) >= UP * (len(x) + len(y))
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in ("a", "b")], names=["a", "b"]).filter(pa.array(ok))
        tidy()


class _Tests:
    """Tests of pairs ``(a, b)`` by signature and then by full sets; a document is ``b`` in at most 40 of them."""

    def __init__(self, docs: DataFrame, signed: DataFrame):
        self.texts = docs.select(F.col("ord").alias("_k"), "text")
        self.signed = signed.select(F.col("rep").alias("_k"), "n", "sig")

    def bodies(self, ids: DataFrame) -> DataFrame:
        """``(_k, body)``, the packed texts of some documents."""
        return keep_ids(self.texts, materialize(ids.distinct(), "ids"), "_k", "left_semi").dropDuplicates(["_k"]).mapInArrow(_squeezed, "_k long, body binary")

    def near(self, pairs: DataFrame) -> DataFrame:
        of = lambda side: self.signed.select("_k", F.col("n").alias(f"n_{side}"), F.col("sig").alias(f"sig_{side}"))
        pairs = _beside(pairs.join(of("b").withColumnRenamed("_k", "b"), "b"), "a", "b", of("a"))
        return materialize(pairs.mapInArrow(_near, "a long, b long"), "near")

    def links(self, near: DataFrame) -> DataFrame:
        bodies = materialize(self.bodies(near.select(F.explode(F.array("a", "b")).alias("_k"))), "bodies")
        pairs = near.join(bodies.select(F.col("_k").alias("b"), F.col("body").alias("body_b")), "b")
        pairs = _beside(pairs, "a", "b", bodies.withColumnRenamed("body", "body_a"))
        out = materialize(pairs.mapInArrow(_linked, "a long, b long"), "links")
        discard(bodies)
        return out


def _shingles(batches):
    for part in arrow_slices(batches, "text", rows=4096):
        h, edge = shingle_sets([lower(t) for t in part.column(1).to_pylist()])
        rep = np.repeat(part.column(0).to_numpy(), np.diff(edge))
        yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(h.view(np.int64))], names=["rep", "shingle"])


def _peeled(members: DataFrame, tests: _Tests) -> DataFrame:
    """``(key, rep, comp, c)``: members under their rarest shingles, without those that can have no link to another."""
    reps = members.select(F.col("rep").alias("_k"))
    held = keep_ids(tests.texts, reps, "_k", "left_semi").dropDuplicates(["_k"]).mapInArrow(_shingles, "rep long, shingle long")
    held = materialize(held, "shingles")
    sizes = materialize(tests.signed.withColumnRenamed("_k", "rep").join(reps.withColumnRenamed("_k", "rep"), "rep").select("rep", "n"), "sizes")
    for _ in range(PEELS):
        own = held.groupBy("shingle").agg(F.count("*").alias("c"), F.min("rep").alias("rep")).where("c = 1").groupBy("rep").agg(F.count("*").alias("own"))
        gone = materialize(sizes.join(own, "rep").where(DOWN * F.col("own") > (DOWN - UP) * F.col("n")).select("rep"), "gone")
        if not gone.take(1):
            break
        last, held = held, materialize(keep_ids(held, gone, "rep", "left_anti"), "shingles")
        discard(last)
    counts = materialize(held.groupBy(F.col("shingle").alias("key")).agg(F.count("*").alias("c")), "frequencies")
    rare = W.partitionBy("rep").orderBy("c", "key")
    facts = materialize(members.join(sizes, "rep"), "facts")
    ranked = join_counted(held.withColumnRenamed("shingle", "key"), counts, "key", "c").withColumn("place", F.row_number().over(rare).cast("long"))
    # Linked sets share ceil(0.85 n) shingles of each, so one of the first n - ceil(0.85 n) + 1.
    few = F.expr(f"n - (n * {UP} + {DOWN} - 1) div {DOWN} + 1")
    listed = materialize(ranked.where("c > 1").join(facts, "rep").where(F.col("place") <= few).select("key", "c", "rep", "comp", "n", "place"), "listed")
    discard(held)
    # Shingles with the same members are one; of these the first in order counts.
    same = [F.count("*").alias("_c"), F.first("c").alias("_f"), F.min("comp").alias("_a"), F.max("comp").alias("_b"), F.bit_xor(F.xxhash64("rep")).alias("_x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("_y")]
    once = listed.groupBy("key").agg(*same).where("_a != _b").groupBy("_c", "_x", "_y").agg(F.min(F.struct("_f", "key"))["key"].alias("key")).select("key", F.col("_c").alias("c"))
    return join_counted(listed.drop("c"), materialize(once, "once"), "key", "c")


def _blocks(parts_of: int):
    """Members under the pairs of blocks that compare them."""

    def dealt(batches):
        for pdf in batches:
            parts = -(-pdf["c"].to_numpy() // parts_of)
            mine = (mix(pdf["rep"].to_numpy(np.int64).view(np.uint64)) % parts.astype(np.uint64)).astype(np.int64)
            row = np.repeat(np.arange(len(pdf)), parts)
            meets = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            out = pdf.iloc[row].drop(columns="c").assign(i=np.minimum(mine[row], meets), j=np.maximum(mine[row], meets), part=mine[row])
            yield out[["key", "i", "j", "part", "rep", "comp", "n", "place", "body"]]
            tidy()

    return dealt


BLOCKS = "key long, i long, j long, part long, rep long, comp long, n long, place long, body binary"


def _crossing(pdf: pd.DataFrame) -> pd.DataFrame:
    """A forest of the links between members of a task's blocks that were not connected before."""
    n, comp, rep, part, place = (pdf[c].to_numpy() for c in ("n", "comp", "rep", "part", "place"))
    reps, first, who = np.unique(rep, return_index=True, return_inverse=True)
    open_ = zstandard.ZstdDecompressor().decompress
    sets = []
    for k in range(0, len(reps), 256):
        h, edge = shingle_sets([open_(body).decode("utf-8", "surrogatepass") for body in pdf["body"].iloc[first[k : k + 256]]])
        sets += [h[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]
    root = {int(c): int(c) for c in np.unique(comp)}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    found = []
    for (_, i, j), at in pdf.groupby(["key", "i", "j"], sort=False).indices.items():
        x, y = (at, at) if i == j else (at[part[at] == i], at[part[at] == j])
        for lo in range(0, len(x), 512):
            xs = x[lo : lo + 512]
            now = np.array([find(c) for c in comp[np.concatenate((xs, y))].tolist()])
            a, b = (k[:, None] if side == 0 else k[None, :] for side, k in ((0, xs), (1, y)))
            # At the first shingle that two sets share, those before it are lost to both.
            most = np.minimum((n - place)[a], (n - place)[b]) + 1
            able = (now[: len(xs)][:, None] != now[len(xs) :][None, :]) & ((UP + DOWN) * most >= UP * (n[a] + n[b]))
            if i == j:
                able &= rep[a] < rep[b]
            p, q = np.nonzero(able)
            if len(p) > 4 * (len(xs) + len(y)):
                common = overlap([sets[who[k]] for k in xs], [sets[who[k]] for k in y])[p, q].astype(np.int64)
            else:
                common = np.array([shared(sets[who[xs[k]]], sets[who[y[m]]]) for k, m in zip(p, q, strict=True)], np.int64)
            for k in np.flatnonzero((UP + DOWN) * common >= UP * (n[xs[p]] + n[y[q]])).tolist():
                one, two = find(int(comp[xs[p[k]]])), find(int(comp[y[q[k]]]))
                if one != two:
                    root[max(one, two)] = min(one, two)
                    found.append((int(rep[xs[p[k]]]), int(rep[y[q[k]]])))
    del sets
    tidy()
    return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)


def shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted arrays without repeats have in common."""
    if len(x) > len(y):
        x, y = y, x
    return int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))


def _open(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members of buckets that have members of two components, with the component of each."""
    roots = components(links).withColumnRenamed("node", "rep")
    members = materialize(members.join(roots, "rep", "left").select("key", "rep", F.coalesce("root", "rep").alias("comp")), "members")
    facts = members.groupBy("key").agg(F.count("*").alias("_c"), F.min("comp").alias("_a"), F.max("comp").alias("_b")).where("_a != _b").select("key", "_c")
    return materialize(join_counted(members, materialize(facts, "open"), "key", "_c").select("rep", "comp").distinct(), "open_members")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(ord, doc_id, n_shingles, component_id)``, a row per row of ``docs``.

    Texts are lower-cased from A to Z; a set holds the distinct runs of five words, or all words where there are fewer.
    Documents whose sets share at least 0.85 of their union are linked; ``component_id`` is the least id among all that are
    linked directly or through others, its own if there is none.  Texts without words, null ones included, have no
    shingles and no links.  Ids are doc_ids; where these repeat or are null, documents are numbered by (doc_id with
    nulls last, hash of the text), ``component_id`` is such a number (``ord``), and rows that repeat id and text are one
    document listed twice.  An empty table gives an empty result; other columns are ignored.
    """
    d = ordered(docs, id_col, text_col)
    signed = materialize(d.select("ord", "doc_id", "text").mapInArrow(_signed, "ord long, doc_id long, n long, digest binary, sig binary"), "signed")
    classes = materialize(signed.where("n > 0").groupBy("n", "digest").agg(F.min("ord").alias("rep"), F.count("*").alias("mult")), "classes")
    own = signed.join(classes.select(F.col("rep").alias("ord")), "ord").select(F.col("ord").alias("rep"), "n", "sig").dropDuplicates(["rep"])
    own = materialize(own, "own")
    tests = _Tests(d, own)
    keyed = materialize(own.select("rep", "sig").mapInArrow(_listed, "rep long, keys array<long>").select("rep", F.explode("keys").alias("key")), "keyed")

    # Buckets with the same members are one bucket.
    members = [F.count("*").alias("c"), F.min("rep").alias("a"), F.max("rep").alias("b"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y")]
    buckets = keyed.groupBy("key").agg(*members).where("c > 1").groupBy("c", "x", "y", "a", "b").agg(F.min("key").alias("key"))
    buckets = materialize(buckets.select("key", "c", "a", "b"), "buckets")
    large = materialize(buckets.where("c > 2").select("key", "c", "a"), "large")
    open_ = materialize(join_counted(keyed, large, "key", "c"), "members")
    discard(keyed)

    pairs = buckets.where("c = 2").select("a", "b").unionByName(open_.where("a != rep").select("a", F.col("rep").alias("b"))).distinct()
    links = tests.links(tests.near(materialize(pairs, "pairs")))
    open_ = _open(open_, links)
    if open_.take(1):
        open_ = materialize(_peeled(open_, tests), "members")
        links = links.unionByName(_open_links(open_, tests))
    roots = components(links)
    facts = classes.join(roots, classes["rep"] == roots["node"], "left").select("n", "digest", "mult", F.coalesce("root", "rep").alias("component_id"))
    facts = materialize(facts, "facts")
    some = join_counted(signed.select("ord", "doc_id", "n", "digest"), facts, ["n", "digest"], "mult")
    none = signed.where("n = 0").withColumn("component_id", F.col("ord"))
    names = ["ord", "doc_id", F.col("n").alias("n_shingles"), "component_id"]
    return some.select(*names).unionByName(none.select(*names))


def _open_links(members: DataFrame, tests: _Tests) -> DataFrame:
    """Links that connect what is not connected yet, between members under a key."""
    bodies = materialize(tests.bodies(members.select(F.col("rep").alias("_k"))), "bodies")
    dealt = _beside(members, "rep", "key", bodies).select("key", "c", "rep", "comp", "n", "place", "body").mapInPandas(_blocks(PART), BLOCKS)
    size = members.agg(F.sum(F.ceil(F.col("c") / PART) * F.col("n"))).first()[0] or 0
    tasks = max(partitions(members.sparkSession), size // TASK_SHINGLES + 1)
    dealt = dealt.withColumn("task", F.pmod(F.xxhash64("key", "i", "j"), F.lit(tasks)))
    return materialize(dealt.groupBy("task").applyInPandas(_crossing, "a long, b long"), "links")


def op13_hamming_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("ord") == F.col("component_id")).alias("kept"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest([array_to_string(words[i:i + 4], ' ') FOR i IN range(1, greatest(2, len(words) - 3))]) AS shingle FROM w WHERE len(words) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id
), links AS (
  SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 85 * (na.n + nb.n - common)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), roots AS (
  SELECT a, min(b) AS root FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.root AS component_id, d.doc_id = r.root AS kept
FROM documents d JOIN roots r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
