"""Boosted trees over binned rows, several ensembles at once: a job a level for all of them.

Rows lie as bytes, one a feature, in a block a partition, which tasks map into memory from the scratch folder.  A level's job sends the counts and sums of each node and bin,
from which the splits are chosen; so what reaches the driver has the same size for any number of rows.
"""

from __future__ import annotations

import contextlib
import os
import shutil
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from tidepanel.functions import scans as S
from tidepanel.sources import scratch

BINS = 32
#: Rows of a partition where there are more than the cores' own; partitions whose tables meet at once on the driver.
BLOCK_ROWS, MEET = 500_000, 64
#: Rows that are counted at once, so few that their keys stay in a core's cache.
CHUNK = 1 << 16
#: Rounds after which the rows' state is checkpointed, as each round's is made from the last one.
KEPT_ROUNDS = 25


def partitions(rows: int, few: int, cores: int) -> int:
    """A partition for each ``few`` rows, up to the cores; beyond that one for each :data:`BLOCK_ROWS`."""
    return max(1, min(-(-rows // few), max(cores, -(-rows // BLOCK_ROWS))))


def cuts_of(df: DataFrame, columns: list[str], bins: int = BINS) -> list[list[float]]:
    """Cuts at approximate quantiles of all rows; a bin holds what is above its lower cut, up to its upper one."""
    at = [k / bins for k in range(1, bins)]
    return [sorted(set(c)) for c in df.stat.approxQuantile(columns, at, 1 / (4 * bins))]


def hashed(seeds: np.ndarray, number: int) -> np.ndarray:
    """Spark's ``xxhash64`` of an int, after columns whose ``xxhash64`` is ``seeds`` (as unsigned numbers)."""
    first, second, third, fifth = (np.uint64(n) for n in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    turn, back, half, low = (np.uint64(n) for n in (23, 41, 33, 29))
    with np.errstate(over="ignore"):
        h = (seeds + (fifth + np.uint64(4))) ^ (np.uint64(number) * first)
        h = ((h << turn) | (h >> back)) * second + third
        h = (h ^ (h >> half)) * second
        h = (h ^ (h >> low)) * third
    return h ^ (h >> np.uint64(32))


def shadows(x: np.ndarray, group: np.ndarray, hashes: np.ndarray, seeds: list[int]) -> np.ndarray:
    """The columns, and for each seed a shadow of each: in each group its bins in the order of a hash of its own."""
    p = len(x)
    out = np.concatenate([x, np.empty((p * len(seeds), x.shape[1]), np.uint8)])
    ends = [*np.flatnonzero(group[1:] != group[:-1]) + 1, len(group)]
    for i, seed in enumerate(seeds):
        of_seed = hashed(hashes, seed)
        for k in range(p):
            order, to, begin = hashed(of_seed, k).view(np.int64), out[p * (i + 1) + k], 0
            for end in ends:
                to[begin:end] = x[k, begin:end][order[begin:end].argsort(kind="stable")]
                begin = end
    return out


def packed(df: DataFrame, columns: list[str], label: str, cuts: list[list[float]], seeds: list[int] | None = None):
    """An RDD of ``(bins by column and row, labels)``, one a partition that has rows.

    With ``seeds``, rows lie by ``_group``, a partition whole groups, and have ``_hash``; :func:`shadows` follow the columns.
    """
    edges = [np.array(c) for c in cuts]
    seeds = seeds or []
    p = len(columns)
    dealt = ["_group", "_hash"] if seeds else []

    def pack(batches):
        x, y, g, h = [], [], [], []
        for b in batches:
            x.append(np.stack([np.searchsorted(e, b.column(k).to_numpy(zero_copy_only=False)).astype(np.uint8) for k, e in enumerate(edges)]))
            y.append(b.column(p).to_numpy(zero_copy_only=False))
            for k, held in enumerate((g, h)[: len(dealt)]):
                held.append(b.column(p + 1 + k).to_numpy(zero_copy_only=False))
        if x:
            bins = np.concatenate(x, axis=1)
            if seeds:
                bins = shadows(bins, np.concatenate(g), np.concatenate(h).view(np.uint64), seeds)
            yield pa.RecordBatch.from_arrays([pa.array([bins.tobytes()], pa.binary()), pa.array([np.concatenate(y).tobytes()], pa.binary())], names=["x", "y"])

    rows = df.select(*[f"`{c}`" for c in columns], f"`{label}`", *dealt).mapInArrow(pack, "x binary, y binary")
    width = p * (1 + len(seeds))
    return rows.rdd.map(lambda r: (np.frombuffer(r.x, np.uint8).reshape(width, -1), np.frombuffer(r.y, np.float64)))


@dataclass
class Tree:
    """Nodes as in a heap: the children of k are 2k and 2k + 1; a node without a feature is a leaf or not reached."""

    depth: int
    feature: np.ndarray = field(init=False)
    bin: np.ndarray = field(init=False)
    value: np.ndarray = field(init=False)

    def __post_init__(self):
        n = 2 ** (self.depth + 1)
        self.feature, self.bin, self.value = np.full(n, -1), np.zeros(n, np.uint8), np.zeros(n)

    def nodes(self, x: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row, as many levels down or where it ends before."""
        at = np.ones(x.shape[1], np.min_scalar_type(2 ** (levels + 1)))
        for k in range(1, 2**levels):
            if self.feature[k] >= 0:
                # From k to 2 k or 2 k + 1, in bytes and without branches.
                to = (x[self.feature[k]] > self.bin[k]).astype(at.dtype)
                to += at.dtype.type(k)
                to *= at == k
                at += to
        return at


def residuals(y: np.ndarray, f: np.ndarray | None, logistic: bool) -> np.ndarray:
    """What the next tree is fitted to: the labels, then the loss's negative gradient."""
    if f is None:
        return y
    return 4 * y / (1 + np.exp(2 * y * f)) if logistic else 2 * (y - f)


def tables(x: np.ndarray, rest, tree: Tree, level: int, columns: list[int], bins: int, count: bool = True) -> np.ndarray:
    """Counts and sums of ``rest(part)``, a slice's residuals, by column, node of the level and bin; sums alone without ``count``.

    Two columns share a pass: counts and sums by pairs of their bins hold those of both.
    """
    n = 2**level
    pairs = [range(k, min(k + 2, len(columns))) for k in range(0, len(columns), 2)]
    sums = [np.zeros((2, n * bins ** len(two))) for two in pairs]
    for begin in range(0, x.shape[1], CHUNK):
        part = slice(begin, begin + CHUNK)
        r, mine, node = rest(part), x[:, part], None
        if level:
            at = tree.nodes(mine, level)
            if at.min() < n:
                here = at >= n
                r, mine, at = r[here], mine[:, here], at[here]
            node = (at - at.dtype.type(n)).astype(np.int64) * bins**2
        for two, held in zip(pairs, sums, strict=True):
            key = mine[columns[two[0]]].astype(np.uint16)
            if len(two) == 2:
                key *= np.uint16(bins)
                key += mine[columns[two[1]]]
            key = key.astype(np.int64) if node is None else (node if len(two) == 2 else node // bins) + key
            if count:
                held[0] += np.bincount(key, minlength=held.shape[1])
            held[1] += np.bincount(key, r, minlength=held.shape[1])
    out = np.empty((2, len(columns), n, bins))
    for two, held in zip(pairs, sums, strict=True):
        if len(two) == 1:
            out[:, two[0]] = held.reshape(2, n, bins)
        else:
            held = held.reshape(2, n, bins, bins)
            out[:, two[0]], out[:, two[1]] = held.sum(axis=3), held.sum(axis=2)
    return out


def grown(tree: Tree, level: int, table: np.ndarray, columns: list[int], gain: np.ndarray) -> None:
    """Split the level's nodes where the squared error falls most, and add by how much to the columns' gains."""
    n, s = table.cumsum(axis=3)
    for k in range(2**level):
        node = 2**level + k
        all_n, all_s = n[0, k, -1], s[0, k, -1]
        if level and tree.feature[node // 2] < 0 or not all_n:
            continue
        if level == 0:
            tree.value[node] = all_s / all_n
        left, right = n[:, k, :-1], all_n - n[:, k, :-1]
        with np.errstate(divide="ignore", invalid="ignore"):
            fall = np.where((left > 0) & (right > 0), s[:, k, :-1] ** 2 / left + (all_s - s[:, k, :-1]) ** 2 / right - all_s**2 / all_n, -1.0)
        c, b = np.unravel_index(int(fall.argmax()), fall.shape)
        if fall[c, b] <= 1e-12 * abs(all_s**2 / all_n):
            continue
        tree.feature[node], tree.bin[node] = columns[c], b
        tree.value[2 * node], tree.value[2 * node + 1] = s[c, k, b] / left[c, b], (all_s - s[c, k, b]) / right[c, b]
        gain[columns[c]] += fall[c, b]


def moved(x: np.ndarray, f: np.ndarray | None, tree: Tree, weight: float) -> np.ndarray:
    """The rows' predictions, of which ``f`` are those before, with one more tree."""
    out = np.zeros(x.shape[1]) if f is None else np.array(f)
    value = tree.value * weight
    for at in range(0, len(out), CHUNK):
        part = slice(at, at + CHUNK)
        out[part] += value[tree.nodes(x[:, part], tree.depth)]
    return out


class Mapped:
    """Blocks as files of a folder that all machines see, mapped into memory by each task: no row goes through a socket.

    A round's predictions are a new file beside the last round's, so that a task may run again.
    """

    def __init__(self, blocks, folder: str, ensembles: int):
        def store(rows):
            for x, y in rows:
                name = f"{folder}/{uuid.uuid4().hex}"
                x.tofile(f"{name}.x")
                y.tofile(f"{name}.y")
                yield name, x.shape

        self.folder, self.ensembles = folder, ensembles
        os.makedirs(folder, exist_ok=True)
        self.blocks = blocks.mapPartitions(store).collect()
        self.context = blocks.context
        self.round, self.told = 0, None

    def add(self, trees: list[Tree], weight: float) -> None:
        self.round, self.told = self.round + 1, (trees, weight)

    def each(self, of):
        t, told, ensembles = self.round, self.told, self.ensembles

        def run(block):
            name, (p, n) = block
            x, y = np.memmap(f"{name}.x", np.uint8, "r", shape=(p, n)), np.memmap(f"{name}.y", np.float64, "r")
            lie = lambda t: np.memmap(f"{name}.{t}", np.float64, "r", shape=(ensembles, n)) if t else None
            if told:
                before, new = lie(t - 1), f"{name}.{t}-{uuid.uuid4().hex}"
                with open(new, "wb") as file:
                    for k, tree in enumerate(told[0]):
                        moved(x, None if before is None else before[k], tree, told[1]).tofile(file)
                os.replace(new, f"{name}.{t}")
            return of((x, y, lie(t)))

        return self.context.parallelize(self.blocks, len(self.blocks)).map(run)

    def settled(self) -> None:
        """What :meth:`each` ran has its round's predictions written: the last round's go."""
        if self.told and self.round > 1:
            for name, _ in self.blocks:
                with contextlib.suppress(FileNotFoundError):
                    os.remove(f"{name}.{self.round - 1}")
        self.told = None

    def close(self) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


class Persisted:
    """Blocks as an RDD, where the scratch folder is no file system of the machines."""

    def __init__(self, blocks):
        self.state, self.last, self.old, self.round, self.marked = blocks.map(lambda b: (*b, None)).persist(StorageLevel.MEMORY_AND_DISK_DESER), None, None, 0, False
        self.context = blocks.context

    def add(self, trees: list[Tree], weight: float) -> None:
        def told(b):
            x, y, f = b
            return x, y, np.stack([moved(x, None if f is None else f[k], tree, weight) for k, tree in enumerate(trees)])

        self.last, self.round = self.state, self.round + 1
        # Blocks are bytes already: kept as they are, they are not copied at each level.
        self.state = self.state.map(told).persist(StorageLevel.MEMORY_AND_DISK_DESER)
        self.marked = self.round % KEPT_ROUNDS == 0
        if self.marked:
            self.state.checkpoint()

    def each(self, of):
        return self.state.map(of)

    def settled(self) -> None:
        if self.last is not None:
            self.last.unpersist()
        if self.marked:
            S.forget(self.context, self.old)
            self.old = self.state.getCheckpointFile()
        self.last, self.marked = None, False

    def close(self) -> None:
        self.state.unpersist()
        S.forget(self.context, self.old)


def gains(blocks, sets: list[list[int]], columns: int, depth: int, rounds: int, step: float, logistic: bool = False, bins: int = BINS) -> list[np.ndarray]:
    """By ensemble, how much each column lowered the squared error over all trees and nodes.

    ``sets`` are the columns that each ensemble may split on.  The first tree is fitted to the labels and counts whole,
    the others to the loss's negative gradient and count by ``step``.
    """
    total, roots = [np.zeros(columns) for _ in sets], []
    folder = scratch.folder(SparkSession.active(), "blocks")
    held = Mapped(blocks, folder, len(sets)) if folder else Persisted(blocks)
    trees: list[Tree] = []
    for t in range(rounds):
        if t:
            held.add(trees, 1.0 if t == 1 else step)
        trees = [Tree(depth) for _ in sets]
        for level in range(depth):
            # The root's counts are the same in all rounds.
            count = level > 0 or t == 0

            def counted(b, trees=trees, level=level, count=count):
                x, y, f = b
                rest = [lambda part, k=k: residuals(y[part], None if f is None else f[k, part], logistic) for k in range(len(trees))]
                return np.concatenate([tables(x, rest[k], tree, level, sets[k], bins, count).ravel() for k, tree in enumerate(trees)])

            each = held.each(counted)
            both = each.treeReduce(np.add) if each.getNumPartitions() > MEET else each.reduce(np.add)
            at = 0
            for k, (tree, mine, gain) in enumerate(zip(trees, sets, total, strict=True)):
                shape = (2, len(mine), 2**level, bins)
                table = both[at : at + np.prod(shape)].reshape(shape)
                at += np.prod(shape)
                if not count:
                    table[0] = roots[k]
                elif not level:
                    roots.append(table[0].copy())
                grown(tree, level, table, mine, gain)
            if level == 0:
                held.settled()
    held.close()
    return total
