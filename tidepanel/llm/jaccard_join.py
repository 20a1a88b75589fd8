"""N-gram Jaccard self-join by chosen paths.

A document is the set of its five-word shingles (all its words, where it has fewer).  Equal sets form a class and go on
as one.  In each run a set x takes every token whose hash is below 1 / (DENSITY |x|) and joins the buckets of these
tokens; the hashes are shared, so similar sets take the same tokens.  A bucket with more than ``LIMIT`` sets is split in
the same way by a second token, and so on, unless a single child would hold most of it again; then its sets are alike
and are compared, block by block.  Two sets of similarity 0.8 share 1.6 tokens or more a run on average and so miss
each other in one with probability e**-1.6 = 0.20 in buckets that are not split, and 0.28, 0.32, 0.33 where they must
share a path of 2, 3, 4 tokens.  Runs are repeated until the target ``recall`` of such pairs is reached at the deepest
level (:func:`runs_for`): twelve for the default.

Buckets with the same sets are compared once, and a pair counts in the least bucket that both share, so links are
exact without a list of pairs.  Each task reports links and its part of a spanning forest; components follow by
alternating star contraction over tables.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm._shared import discard, join_counted, keep_ids, materialize, ordered, partitions, repeats
from tidepanel.llm._text import arrow_slices, join_texts, mix, run_hashes, slices, tidy, with_columns, word_bounds, word_hashes

SHINGLE = 5
#: Sets are similar if they share at least UP / DOWN of their union.
UP, DOWN = 4, 5
DENSITY = 0.5
LIMIT = 1024
DEPTH = 4
#: The share of pairs of similarity 0.8 that the runs together must find, wherever their buckets are split.
RECALL = 0.999997
#: Distinct shingles of the sets that one part of a bucket, and about as many that one task, holds at a time.
PART_SHINGLES = 1 << 19
TASK_SHINGLES = 1 << 20
#: A bucket is not split if one child would hold this part of it.
ALIKE = 0.7

IN_WORD = np.ones(256, bool)
IN_WORD[[0x20, *range(0x09, 0x0E)]] = False


def miss_of_a_run(depth: int = DEPTH) -> float:
    """The probability that two sets of similarity 0.8 share no path of ``depth`` tokens in a run."""
    miss = 0.0
    for _ in range(depth):
        miss = math.exp(-UP / DOWN / DENSITY * (1 - miss))
    return miss


def runs_for(recall: float, depth: int = DEPTH) -> int:
    """How many runs find the share ``recall`` of pairs of similarity 0.8."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(miss_of_a_run(depth))))


def seeds_for(runs: int) -> np.ndarray:
    return np.random.default_rng(7).integers(1, 1 << 63, runs, dtype=np.uint64)


RUNS = runs_for(RECALL)
SEEDS = seeds_for(RUNS)


def shingle_sets(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts one after the other, and where each text's begin (one more at the end)."""
    buf, offsets = join_texts(texts)
    starts, ends = word_bounds(buf, IN_WORD)
    doc = np.searchsorted(offsets, starts, "right") - 1
    count = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(count) - count
    words = word_hashes(buf, starts, ends)
    n = max(0, len(words) - SHINGLE + 1)
    inside = np.flatnonzero(doc[SHINGLE - 1 :] == doc[:n]) if n else np.zeros(0, np.int64)
    hashes, owners = [run_hashes(words, SHINGLE)[inside]], [doc[inside]]
    for k in range(1, SHINGLE):
        short = np.flatnonzero(count == k)
        if len(short):
            hashes.append(mix(run_hashes(words, k)[first[short]] + np.uint64(k)))
            owners.append(short)
    h, d = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], np.searchsorted(d[new], np.arange(len(texts) + 1))


def _chosen(hashes: np.ndarray, seed, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens a step takes, and the key of the path that ends with each."""
    u = mix(hashes ^ seed)
    most = np.minimum(2.0**64 / (DENSITY * np.maximum(size, 1)), 2.0**64 - 2048)
    return np.flatnonzero(u <= most.astype(np.uint64)), mix(u + np.uint64(1))


def _first_paths(seeds):
    return lambda batches: _paths_of(batches, seeds)


def _paths_of(batches, seeds):
    for part in arrow_slices(batches, "text", rows=4096):
        h, edge = shingle_sets(part.column(part.schema.get_field_index("text")).to_pylist())
        n = np.diff(edge)
        some = n > 0
        sums = np.zeros((2, len(n)), np.uint64)
        if len(h):
            for row, x in zip(sums, (mix(h), mix(h ^ np.uint64(0x5555))), strict=True):
                row[some] = np.add.reduceat(x, edge[:-1][some])
        owner = np.repeat(np.arange(len(n)), n)
        size = n[owner]
        rows, keys = [], []
        for seed in seeds:
            at, key = _chosen(h, seed, size)
            rows.append(owner[at])
            keys.append(key[at])
        rows, keys = np.concatenate(rows), np.concatenate(keys).view(np.int64)
        order = np.argsort(rows, kind="stable")
        where = np.searchsorted(rows[order], np.arange(len(n) + 1))
        lists = pa.ListArray.from_arrays(pa.array(where, pa.int32()), pa.array(keys[order]))
        yield with_columns(part, ("text",), n=pa.array(n), s1=pa.array(sums[0].view(np.int64)), s2=pa.array(sums[1].view(np.int64)), keys=lists)


def _next_paths(batches):
    for pdf in batches:
        texts = list(pdf["text"])
        for i, j in slices(texts):
            h, edge = shingle_sets(texts[i:j])
            rows = []
            for k in range(j - i):
                own = h[edge[k] : edge[k + 1]]
                for parent in pdf["paths"].iloc[i + k]:
                    at, key = _chosen(own, mix(np.array([parent], np.int64).view(np.uint64))[0], np.full(len(own), len(own)))
                    rows += [(pdf["rep"].iloc[i + k], len(own), parent, x) for x in key[at].view(np.int64).tolist()]
            yield pd.DataFrame(rows, columns=["rep", "n", "parent", "key"])
        tidy()


def _leaves(docs: DataFrame, level: DataFrame) -> DataFrame:
    """``(rep, n, key)``: the buckets where sets are compared; ``n`` is the size of the set."""
    leaves = None
    for depth in range(1, DEPTH + 1):
        level = materialize(level, f"paths{depth}")
        sizes = materialize(level.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), f"sizes{depth}")
        large = sizes.where(F.col("c") > LIMIT)
        some = large.count() > 0
        cold = keep_ids(level, large.select("key"), "key", "left_anti") if some else level
        small = cold.join(sizes.where(F.col("c") <= LIMIT).select("key"), "key").select("rep", "n", "key")
        leaves = small if leaves is None else leaves.unionByName(small)
        if not some:
            break
        members = keep_ids(level, large.select("key"), "key").select("rep", "n", "key")
        if depth == DEPTH:
            leaves = leaves.unionByName(members)
            break
        paths = materialize(members.groupBy("rep").agg(F.collect_list("key").alias("paths")), f"members{depth}")
        # A set has a few paths only, but all of them together grow with the input: texts are filtered, then joined.
        texts = keep_ids(docs.select(F.col("ord").alias("rep"), "text"), paths.select("rep"), "rep", "left_semi").join(paths, "rep")
        children = materialize(texts.mapInPandas(_next_paths, "rep long, n long, parent long, key long"), f"children{depth}")
        most = children.groupBy("parent", "key").agg(F.count("*").alias("n")).groupBy("parent").agg(F.max("n").alias("n"))
        fate = large.join(most, large["key"] == most["parent"], "left").select("key", (F.coalesce("n", F.lit(0)) >= ALIKE * F.col("c")).alias("alike"))
        fate = materialize(fate, f"fate{depth}")
        leaves = leaves.unionByName(keep_ids(members, fate.where("alike").select("key"), "key").select("rep", "n", "key"))
        level = keep_ids(children, fate.where("not alike").select(F.col("key").alias("parent")), "parent").select("rep", "n", "key").distinct()
    return leaves


def _packed(limit: int, n_tasks: int):
    def pack(batches):
        squeeze = zstandard.ZstdCompressor(3).compress
        for pdf in (batch.iloc[a : a + 256] for batch in batches for a in range(0, len(batch), 256)):
            rows = []
            for rep, mult, buckets, text in zip(pdf["rep"], pdf["mult"], pdf["buckets"], pdf["text"], strict=True):
                keys = np.sort(np.array([b["key"] for b in buckets], np.int64)).tobytes()
                body = squeeze(text.encode("utf-8", "surrogatepass"))
                mine = int(mix(np.array([rep], np.int64).view(np.uint64))[0])
                for b in buckets:
                    parts = max(-(-b["c"] // limit), -(-b["w"] // PART_SHINGLES))
                    p = mine % parts
                    for q in range(parts):
                        i, j = min(p, q), max(p, q)
                        task = int(mix(np.array([b["key"] ^ (i * 1_000_003 + j)], np.int64).view(np.uint64))[0] >> np.uint64(1)) % n_tasks
                        rows.append((task, b["key"], i, j, p, rep, mult, keys, body))
            yield pd.DataFrame(rows, columns=["task", "key", "i", "j", "part", "rep", "mult", "keys", "body"])

    return pack


PACKED = "task int, key long, i int, j int, part int, rep long, mult long, keys binary, body binary"
LINKED = "rep long, links long, root long"


class _Sets:
    """The sets of a task's members, as sorted token numbers."""

    def __init__(self, texts: list[str]):
        found = [shingle_sets(texts[i:j]) for i, j in slices(texts)]
        self.n = np.concatenate([np.diff(e) for _, e in found])
        self.edge = np.concatenate(([0], np.cumsum(self.n)))
        tokens = np.concatenate([h for h, _ in found])
        distinct, self.token = np.unique(tokens, return_inverse=True)
        self.m = len(distinct)

    def of(self, k: int) -> np.ndarray:
        return self.token[self.edge[k] : self.edge[k + 1]]

    def similar(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether sets a[k] and b[k] reach the threshold."""
        ok = DOWN * np.minimum(self.n[a], self.n[b]) >= UP * np.maximum(self.n[a], self.n[b])
        out = np.zeros(len(a), bool)
        todo = np.flatnonzero(ok)
        size = np.cumsum(self.n[a[todo]] + self.n[b[todo]])
        for part in np.split(todo, np.flatnonzero(np.diff(size // (1 << 21))) + 1):
            if not len(part):
                continue
            flat = []
            for side in (a[part], b[part]):
                n = self.n[side]
                at = np.repeat(self.edge[side], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                flat.append(np.repeat(np.arange(len(part)), n) * self.m + self.token[at])
            both = np.sort(np.concatenate(flat))
            twice = both[1:][both[1:] == both[:-1]] // max(1, self.m)
            common = np.bincount(twice, minlength=len(part))
            out[part] = (UP + DOWN) * common >= UP * (self.n[a[part]] + self.n[b[part]])
        return out

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return overlap([self.of(k) for k in x], [self.of(k) for k in y])


def overlap(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """How many values each array of distinct values in xs shares with each in ys, by products of 0/1 matrices."""
    members = [*xs, *ys]
    values = np.concatenate(members)
    row = np.repeat(np.arange(len(members)), [len(m) for m in members])
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    keep = times[column] > 1
    number = np.cumsum(times > 1) - 1
    column, row = number[column[keep]], row[keep]
    out = np.zeros((len(xs), len(ys)), np.float32)
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    width = 2048
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        i, j = np.searchsorted(column, (a, a + width))
        m = np.zeros((len(members), width), np.float32)
        m[row[i:j], column[i:j] - a] = 1
        out += m[: len(xs)] @ m[len(xs) :].T
    return out


def _find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links and local components of a task's buckets."""
    reps, at, where = np.unique(pdf["rep"].to_numpy(), return_index=True, return_inverse=True)
    open_ = zstandard.ZstdDecompressor().decompress
    sets = _Sets([open_(pdf["body"].iloc[k]).decode("utf-8", "surrogatepass") for k in at])
    mult = pdf["mult"].to_numpy()[at]
    keys = [np.frombuffer(pdf["keys"].iloc[k], np.int64) for k in at]
    own = [set(k.tolist()) for k in keys]
    links = np.zeros(len(reps), np.int64)
    parent = list(range(len(reps)))

    def link(a, b):
        np.add.at(links, a, mult[b])
        np.add.at(links, b, mult[a])
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = _find(parent, x), _find(parent, y)
            parent[max(x, y)] = min(x, y)

    few_a, few_b = [], []
    table = pd.DataFrame({"key": pdf["key"].to_numpy(), "i": pdf["i"].to_numpy(), "j": pdf["j"].to_numpy(), "part": pdf["part"].to_numpy(), "k": where}).drop_duplicates(["key", "i", "j", "k"])
    for (key, i, j), g in table.groupby(["key", "i", "j"], sort=False):
        k = g["k"].to_numpy()
        part = g["part"].to_numpy()
        x, y = (k, k) if i == j else (k[part == i], k[part == j])
        if len(x) * len(y) <= 1024:
            for p, a in enumerate(x.tolist()):
                for b in y[p + 1 :].tolist() if i == j else y.tolist():
                    if min(own[a] & own[b]) == key:
                        few_a.append(a)
                        few_b.append(b)
            continue
        for lo in range(0, len(x), 512):
            xs = x[lo : lo + 512]
            common = sets.common(xs, y)
            nx, ny = sets.n[xs][:, None], sets.n[y][None, :]
            near = (UP + DOWN) * common >= UP * (nx + ny)  # below 2**24, so exact
            if i == j:
                near &= np.arange(lo, lo + len(xs))[:, None] < np.arange(len(y))[None, :]
            a, b = np.nonzero(near)
            if len(a):
                # Leave out pairs that share a smaller bucket.
                first = overlap([keys[t][keys[t] < key] for t in xs], [keys[t][keys[t] < key] for t in y])[a, b] == 0
                a, b = a[first], b[first]
                link(xs[a], y[b])
    if few_a:
        a, b = np.array(few_a), np.array(few_b)
        near = sets.similar(a, b)
        link(a[near], b[near])
    root = np.array([_find(parent, x) for x in range(len(reps))], np.int64)
    linked = np.flatnonzero(links > 0)
    # A set whose links all count elsewhere is not reported: its component comes from there.
    out = pd.DataFrame({"rep": reps[linked], "links": links[linked], "root": reps[root[linked]]})
    del sets, own, keys
    tidy()
    return out


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of edges ``(a, b)``: the least node of each node's component, by alternating star contraction."""
    e = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialize(e, "edges")
    check = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())
    before = check(e)
    while before[0]:
        # Large star: of a node's neighbours the larger ones go to the least of all.
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        last, e = e, both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        e = materialize(e, "edges")
        discard(last)
        # Small star: a node and its smaller neighbours go to the least of these.
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        last, e = e, e.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        e = materialize(e, "edges")
        discard(last)
        after = check(e)
        if after == before:
            break
        before = after
    return e.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL) -> DataFrame:
    """``(ord, doc_id, class_id, n_links)``, a row per row of ``docs``.

    ``n_links`` counts the other documents (copies included) of Jaccard similarity 0.8 or more; ``class_id`` is the
    least id among all that are linked directly or through others, its own if there is none.  Texts without words,
    null ones included, have no links.  Ids are doc_ids; where these repeat or are null, documents are numbered by
    (doc_id with nulls last, hash of the text) and ``class_id`` is such a number (``ord``).  An empty table gives an
    empty result; other columns are ignored.
    """
    return _join(ordered(docs, id_col, text_col), recall)


def _join(d: DataFrame, recall: float = RECALL) -> DataFrame:
    spark = d.sparkSession
    light = d.select("ord", "doc_id", "text").mapInArrow(_first_paths(seeds_for(runs_for(recall))), "ord long, doc_id long, n long, s1 long, s2 long, keys array<long>")
    light = materialize(light, "sets")
    same = ["n", "s1", "s2"]
    classes = light.where("n > 0").groupBy(*same).agg(F.min("ord").alias("rep"), F.count("*").alias("mult"))
    classes = materialize(classes, "classes")
    keyed = light.select(F.col("ord").alias("rep"), "n", "keys").join(classes.select("rep"), "rep")
    leaves = materialize(_leaves(d, keyed.select("rep", "n", F.explode("keys").alias("key")).distinct()), "leaves")
    marked = leaves.groupBy("key").agg(F.count("*").alias("c"), F.sum("n").alias("w"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"))
    once = materialize(marked.where("c > 1").groupBy("c", "w", "x", "y").agg(F.min("key").alias("key")).select("key", "c", "w"), "buckets")
    members = join_counted(leaves, once, "key", "c", LIMIT).groupBy("rep").agg(F.first("n").alias("n"), F.collect_list(F.struct("key", "c", "w")).alias("buckets"))
    members = materialize(members.join(classes.select("rep", "mult"), "rep"), "members")
    discard(leaves)
    # Every set goes to a task for each part of its buckets that it meets.
    sent = F.aggregate("buckets", F.lit(0.0), lambda a, b: a + F.greatest(F.ceil(b["c"] / LIMIT), F.ceil(b["w"] / PART_SHINGLES)))
    n_tasks = max(partitions(spark), int((members.agg(F.sum(F.col("n") * sent)).first()[0] or 0) / TASK_SHINGLES) + 1)
    texts = keep_ids(d.select(F.col("ord").alias("rep"), "text").where("text is not null"), members.select("rep"), "rep", "left_semi")
    tasks = texts.join(members.drop("n"), "rep").mapInPandas(_packed(LIMIT, n_tasks), PACKED)
    linked = materialize(tasks.groupBy("task").applyInPandas(_compare, LINKED), "links")
    links = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(linked.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    roots = roots.select(F.col("node").alias("rep"), "root")
    facts = classes.join(links, "rep", "left").join(roots, "rep", "left").select(
        *[F.col(c).alias(f"_{c}") for c in same], F.coalesce("root", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"),
    )
    facts = materialize(facts, "facts")
    discard(members, once, linked)
    on = (light["n"] == facts["_n"]) & (light["s1"] == facts["_s1"]) & (light["s2"] == facts["_s2"])
    some = light.where("n > 0").join(facts, on).select("ord", "doc_id", "class_id", "n_links")
    none = light.where("n = 0").select("ord", "doc_id", F.col("ord").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return some.unionByName(none)


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that come first in their group of near-duplicates; a row that is there twice stays once."""
    d = ordered(docs, id_col, text_col, rows=True)
    dropped = materialize(_join(d).where("ord != class_id").select("ord").distinct(), "dropped")
    kept = keep_ids(d.select("ord", "row"), dropped, "ord", "left_anti")
    kept = kept.dropDuplicates(["ord"]) if repeats(kept, "ord") else kept
    return kept.select("row.*")


def op10_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "class_id", "n_links")
