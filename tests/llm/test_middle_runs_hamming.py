"""Fill-in-middle, periodic runs and the multi-index Hamming join against plain versions, and on odd inputs."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import fill_in_middle, jaccard_join, minhash_dedup, periodic_runs, queries

Q = queries.queries()
LONG = " ".join(f"w{i % 977}x{i}" for i in range(40_000))
ODD = [
    (1, None), (2, ""), (3, "one"), (4, "  \n\t "), (5, "a b c d e f g"), (6, "A b C d e f g"), (7, LONG), (8, LONG + " end"), (9, "Ünïcödé – 漢字 x 'tis <P> 12 ſ  "), (10, " lead and trail\n"),
    (11, "x"), (12, "same " * 5), (13, "same " * 6), (14, "a b " * 12), (15, "\U0001f600 é\x0b\x0cz \x00 \x1c\x85 end"), (16, "tick tock " * 9000), (17, "I İ ı STRASSE straße É é"), (18, "i İ ı strasse straße É é"),
]
REPEATED = [(None, "no id at all here"), (None, "a b c d e f g"), (5, "a b c d e f g"), (5, "a b c d e f g"), (5, "another text with the same id")]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def table(spark, rows):
    """Documents with columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit(1) for c in ("n", "form", "output", "ord", "rep", "key", "c", "sig", "digest", "runs", "_k", "a", "b", "comp", "task", "h1")})


# Fill-in-middle.


def test_cuts_of_odd_texts(spark):
    rows = [(i + 100 * k, t) for k in range(8) for i, t in ODD] + REPEATED
    out = fill_in_middle.fill_in_middle(table(spark, rows))
    got = out.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows) and {r.form for r in got} == {"plain", "psm", "spm"}
    for r, (i, t) in zip(got, rows, strict=True):
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute.cut_in_middle(i, t) and r.doc_id == i and r.back == (t or "")


def test_cuts_at_other_rates(spark, docs):
    out = fill_in_middle.fill_in_middle(table(spark, docs), seed=7, fim_rate=100, spm_rate=0)
    got = out.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    assert {r.form for r in got if r.n} == {"psm"} and {r.doc_id: r.back for r in got} == {i: t or "" for i, t in docs}
    assert fill_in_middle.fill_in_middle(table(spark, docs).limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 9, 500, 20_000])
def test_skip_list_reaches_every_rank(n):
    widths = np.random.default_rng(n).integers(1, 30, n)
    units = fill_in_middle.SkipList(widths)
    ranks = range(n + 1) if n < 1000 else range(0, n + 1, 97)
    before = [0, *np.cumsum(widths).tolist()]
    assert [units.chars_before(r) for r in ranks] == [before[r] for r in ranks]
    assert all(int(u.sum()) == n and int(c.sum()) == before[-1] for u, c, _ in units.lanes)
    assert n < 1000 or len(units.lanes) >= 5


# Periodic runs.


def plain_runs(rows):
    out = {}
    for i, t in rows:
        w = brute.planted_words(i, t)
        runs = brute.word_runs(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        listed = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
        out[i] = (len(runs), *best, 1000 * best[1] // best[2] if runs else None, brute.sha(listed.encode()), brute.sha(brute.collapsed(w, runs).encode()))
    return out


def run_rows(df):
    return {r.doc_id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in df.collect()}


def test_runs_match_brute_force(spark, sf, docs):
    want = plain_runs(docs)
    assert run_rows(Q["op12_harmonic_grid"](spark, sf)) == want and sum(w[0] for w in want.values()) > 15


def test_runs_of_odd_texts(spark, tmp_path):
    rng = random.Random(4)
    rows = [r for r in ODD if r[0] not in (7, 8)]
    for i in range(300):
        part = [f"w{rng.randrange(rng.choice([1, 2, 3, 40]))}" for _ in range(rng.randrange(1, 30))]
        rows.append((1000 + i, " ".join(part * rng.choice([1, 2, 3, 4, 5, 8]) + part[: rng.randrange(len(part))] + ["end"] * rng.randrange(8))))
    rows[rows.index((16, "tick tock " * 9000))] = (16, "tick tock " * 700)
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = plain_runs(rows)
    assert run_rows(Q["op12_harmonic_grid"](spark, str(tmp_path))) == want
    assert any(w[0] > 1 for w in want.values())


@pytest.mark.parametrize("least,repeats,grid", [(6, 4, 50), (2, 2, 1 << 19), (5, 3, 7)])
def test_runs_by_other_rules(spark, monkeypatch, least, repeats, grid):
    monkeypatch.setattr(periodic_runs, "GRID", grid)
    rng = np.random.default_rng(2)
    for _ in range(40):
        texts = [rng.integers(0, k, n) for k, n in zip(rng.integers(1, 5, 12), rng.integers(0, 60, 12), strict=True)]
        count = np.array([len(t) for t in texts])
        first = np.cumsum(count + 1) - count
        x = 1000 + np.arange(count.sum() + 13)
        for a, t in zip(first, texts, strict=True):
            x[a : a + len(t)] = t
        doc, start, length, period = periodic_runs.runs_of(x, first, count, least, repeats)
        for d, t in enumerate(texts):
            got = list(zip(start[doc == d].tolist(), length[doc == d].tolist(), period[doc == d].tolist(), strict=True))
            assert got == brute.word_runs(t.tolist(), least, repeats)


def test_extensions_of_all_places():
    rng = np.random.default_rng(1)
    x = np.concatenate((np.tile([1, 2, 1], 60), rng.integers(0, 2, 80), np.tile([1, 2, 1], 40)))
    x = np.concatenate((x, [9]))
    i, j = (k.ravel() for k in np.meshgrid(np.arange(len(x)), np.arange(len(x))))
    i, j = i[i != j], j[i != j]
    got = periodic_runs.Extensions(x).of(i, j)
    for a, b, n in zip(i[::37].tolist(), j[::37].tolist(), got[::37].tolist(), strict=True):
        m = min(len(x) - a, len(x) - b)
        differ = np.flatnonzero(x[a : a + m] != x[b : b + m])
        assert n == (differ[0] if len(differ) else m)


def test_runs_of_long_and_repeated_rows(spark):
    rows = [r for r in ODD if r[0] in (7, 8, 16)] + REPEATED
    got = periodic_runs.periodic_runs(table(spark, rows)).collect()
    assert [(r.doc_id, [tuple(x) for x in r.runs]) for r in got] == [(7, []), (8, []), (16, [(0, 18_000, 2)])] + [(i, []) for i, _ in REPEATED]
    assert got[2].text == "tick tock" and got[0].text == LONG
    assert periodic_runs.periodic_runs(table(spark, rows).limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(table(spark, rows), repeats=1)


# The multi-index Hamming join.


def plain_components(rows):
    low = [(i, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for i, t in rows]
    links = brute.jaccard_links(low, 0.85)
    parts = brute.components(links)
    return {i: (len(brute.shingles(t)), parts[i], parts[i] == i) for i, t in low}


def result(spark, rows):
    return {r.ord: (r.n_shingles, r.component_id, r.ord == r.component_id) for r in minhash_dedup.near_duplicates(table(spark, rows)).collect()}


def test_components_match_brute_force(spark, sf, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in Q["op13_hamming_join"](spark, sf).collect()}
    want = plain_components(docs)
    assert got == want and sum(not w[2] for w in want.values()) > 10


def test_components_of_odd_texts(spark):
    got, want = result(spark, ODD), plain_components(ODD)
    assert got == want and got[6][1] == 5 and got[8][1] == 7 and got[18][1] == 17 and got[1] == (0, 1, True) == (got[2][0], 1, True)


def near_group(n, words, most, seed):
    """Texts around one, with up to ``most`` changed words: some pairs are linked, some are not."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        w = [f"b{seed}w{k}" for k in range(words)]
        for k in rng.choice(words, int(rng.integers(0, most)), replace=False):
            w[k] = f"e{i}_{k}"
        out.append(" ".join(w))
    return out


def passage_group(n, shared, own, seed):
    """Texts that share a passage of about half their words, and are no near-duplicates."""
    return [" ".join([f"p{seed}w{k}" for k in range(shared)] + [f"o{seed}_{i}_{k}" for k in range(own)]) for i in range(n)]


@pytest.mark.parametrize("peels,part,spread", [(3, 2048, 1024), (0, 8, 4), (1, 5, 2)])
def test_components_of_large_groups(spark, monkeypatch, peels, part, spread):
    """With and without peeling, by blocks, and with documents of many pairs dealt out."""
    monkeypatch.setattr(minhash_dedup, "PEELS", peels)
    monkeypatch.setattr(minhash_dedup, "PART", part)
    monkeypatch.setattr(minhash_dedup, "SPREAD", spread)
    texts = near_group(60, 150, 9, 1) + near_group(30, 60, 8, 2) + passage_group(40, 60, 40, 3) + passage_group(30, 60, 7, 4)
    random.Random(1).shuffle(texts)
    rows = list(enumerate(texts + texts[:20]))
    want = plain_components(rows)
    assert result(spark, rows) == want
    assert 40 < sum(w[2] for w in want.values()) < 150


def test_components_of_repeated_rows(spark):
    rows = REPEATED + [(7, "a b c d e f g"), (8, None), (None, None)]
    got = minhash_dedup.near_duplicates(table(spark, rows)).collect()
    assert len(got) == len(rows)
    same = {r.component_id for r in got if r.n_shingles == 3 and r.doc_id in (5, 7) or r.doc_id is None and r.n_shingles == 3}
    assert len(same) == 1 and same == {r.ord for r in got if r.ord in same}
    assert minhash_dedup.near_duplicates(table(spark, rows).limit(0)).count() == 0
    assert minhash_dedup.near_duplicates(table(spark, [(1, None), (2, " ")])).count() == 2


def test_pairs_under_the_distance_meet():
    """Any two signatures that differ in 19 of the indexed symbols share a key, and keys of different chunks never meet."""
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 16, (500, minhash_dedup.SYMBOLS)).astype(np.uint16)
    b = rng.integers(0, 1 << 16, a.shape).astype(np.uint16)
    for x, y in zip(a, b, strict=True):
        y[: minhash_dedup.INDEXED] = x[: minhash_dedup.INDEXED]
        y[rng.choice(minhash_dedup.INDEXED, 19, replace=False)] += 1
    keys_a, keys_b = minhash_dedup.index_keys(a), minhash_dedup.index_keys(b)
    assert all(set(x.tolist()) & set(y.tolist()) for x, y in zip(keys_a, keys_b, strict=True))
    assert all(len(set(x.tolist())) == 40 for x in keys_a)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    for s in (0.5, 0.85):
        common = int(2000 * s / (1 + s) * 2)
        h = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
        a, b = np.sort(h[:2000]), np.sort(np.concatenate((h[:common], h[2000 : 4000 - common])))
        sig = minhash_dedup.signatures(np.concatenate((a, b)), np.array([0, 2000, 4000, 4000]))
        true = common / (4000 - common)
        assert abs(np.mean(sig[0] == sig[1]) - true) < 4 * (true * (1 - true) / 128) ** 0.5 and not sig[2].any()


def test_shingles_are_those_of_the_jaccard_join():
    h, edge = jaccard_join.shingle_sets(["a b c d e f", "", "a b"])
    assert np.diff(edge).tolist() == [2, 0, 1]
