"""Runs of lines that are planted in other surroundings, and periodic texts."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from tidepanel.llm import line_dedup


def planted(lengths, times, seed=0):
    """Rows of a source of passages and of documents with one passage each between lines of their own."""
    rng = random.Random(seed)
    line = lambda: f"line {rng.getrandbits(60)}"
    passages = [[line() for _ in range(n)] for n in lengths for _ in range(times)]
    rows = [(0, "\n".join(x for p in passages for x in [*p, line()]))]
    rows += [(i, "\n".join([line() for _ in range(9)] + p + [line() for _ in range(9)])) for i, p in enumerate(passages, 1)]
    return rows, [len(p) for p in passages]


def removed(spark, rows, run):
    got = run(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_removed_lines").collect()
    return {r.doc_id: r.n_removed_lines for r in got}


def test_planted_passages_all_go(spark):
    rows, lengths = planted((2, 3, 4, 5, 6), 20)
    got = removed(spark, rows, line_dedup.dedup_lines)
    assert got[0] == 0 and [got[i] for i in range(1, len(rows))] == lengths


def test_periodic_and_lone_lines(spark):
    periodic = "\n".join(["a", "b"] * 48 + ["a"])
    equal = "\n".join(["same"] * 40)
    lone = "\n".join(["only here", "same", "only there"])
    rows = [(1, periodic), (2, equal), (3, lone), (4, "\n\n\n"), (5, None), (6, periodic), (6, periodic)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: (r.n_removed_lines, r.text) for r in out.collect()}
    # Of a run the first pair stays where it is first; the line it shares with its repeat goes.
    assert got[1] == (95, "a\nb") and got[2] == (39, "same")
    assert got[3] == (0, lone) and got[4] == (0, "\n\n\n") and got[5] == (0, "") and got[6] == (97, "")
    assert out.where(F.col("doc_id") == 6).count() == 2


def test_chunks_cut_a_text_and_pairs_cover_what_they_leave(spark):
    """Chunks joined are the text; the pairs inside chunks and at boundaries are all pairs, each once."""
    texts = ["\n".join(f"line {i % 37} {i // 9}" for i in range(n)) for n in (1, 2, 3, 50, 400)] + ["", "\n", "\n\n\na", "x\r\n\u2028\nb\nc b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    text = F.col("text")
    chunks = line_dedup.chunks_of(text)
    out = df.select("text", chunks.alias("chunks"), F.transform(chunks, lambda c: line_dedup.inner_pairs(c["chunk"])).alias("inner"), line_dedup.edge_pairs(text).alias("edges"))
    for r in out.collect():
        lines = r.text.split("\n")
        assert "\n".join(c.chunk for c in r.chunks) == r.text
        assert [c.start for c in r.chunks] == [sum(len(b.chunk.split("\n")) for b in r.chunks[:i]) for i in range(len(r.chunks))]
        keys = {c.start + i: k for c, inner in zip(r.chunks, r.inner) for i, k in enumerate(inner)} | {e.line: e.key for e in r.edges}
        pair = lambda i: lines[i] + "\n" + lines[i + 1]
        want = {i: hashlib.sha256(pair(i).encode()).digest() if re.search(r"[^ \t\n\x0b\f\r]", pair(i)) else None for i in range(len(lines) - 1)}
        assert {i: k and bytes(k) for i, k in keys.items()} == want


def test_against_brute_force(spark):
    """Few distinct lines, blank ones among them, so chunks and pairs repeat inside documents and across."""
    rng = random.Random(5)
    rows = [(i, "\n".join(rng.choice(["", " ", *"abcdefgh"]) for _ in range(rng.choice([1, 2, 5, 30])))) for i in range(-20, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cut = {r.doc_id: [(c.start, c.chunk) for c in r.chunks] for r in df.select("doc_id", line_dedup.chunks_of(F.col("text")).alias("chunks")).collect()}
    first = set()
    want = {}
    for i, text in rows:
        lines, gone = text.split("\n"), set()
        for k in range(len(lines) - 1):
            if (lines[k] + lines[k + 1]).strip() and (lines[k], lines[k + 1]) in first:
                gone |= {k, k + 1}
            first.add((lines[k], lines[k + 1]))
        for start, chunk in cut[i]:
            if "\n" in chunk and chunk.strip() and (chunk,) in first:
                gone |= set(range(start, start + chunk.count("\n") + 1))
            first.add((chunk,))
        want[i] = (len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone))
    got = {r.doc_id: (r.n_removed_lines, r.text) for r in line_dedup.dedup_lines(df).collect()}
    assert got == want
