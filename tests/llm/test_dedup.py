import re
from collections import Counter

import numpy as np
import pytest
from helpers import NASTY, SCHEMA, empty, nasty
from pyspark.sql import functions as F

from terracast.llm import embedding_dedup, linededup, minhash
from terracast.llm.components import components


def reach(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [tuple(map(int, rng.integers(0, 60, 2))) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)] + [(200, i) for i in range(201, 230)] + [(3, 3), (None, 4)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == reach({x for e in real for x in e}, real)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# ---- minhash --------------------------------------------------------------------------
def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i:i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def near_brute(rows, k, percent):
    sets = [shingle_set(t, k) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    part = reach(range(len(rows)), links)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if part[j] == part[i] and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids, default=None) if sets[i] else doc))
    return Counter(out)


def variants(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(int(rng.integers(0, edits + 1))):
            w[int(rng.integers(len(w)))] = f"new{rng.integers(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [1 << 20, 900])
def test_minhash_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = np.random.default_rng(1)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 500, n)]
    texts = [t for size in (30, 60, 120, 200) for t in variants(rng, word(size), 25, max(2, size // 20))]
    texts += [" ".join(word(40)) for _ in range(30)] + ["a b", "A  B", "a b c", "x", None, "", " \n ", "same text here now", "Same text\there  now"] + [texts[0]] * 10
    rows = [(int(i), t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, "alone with no id"), (500, texts[40]), (500, texts[40])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as row", "2 as component_id").repartition(4)
    out = minhash.near_duplicates(df, shingle=4).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == near_brute(rows, 4, 80)
    kept = Counter(r.component_id for r in out if r.kept and r.n_shingles)
    assert set(kept.values()) == {1} and all(r.kept for r in out if not r.n_shingles)


def test_minhash_of_odd_tables(spark):
    assert minhash.near_duplicates(empty(spark)).count() == 0
    out = minhash.near_duplicates(nasty(spark)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == near_brute([(i, t) for i, t, *_ in NASTY], 5, 80)


def test_posterior_bound():
    steps = minhash.least_equal(0.8)
    assert steps[-1][0] == minhash.SIZE and all(0 < m < 0.8 * n for n, m in steps)


# ---- lines ----------------------------------------------------------------------------
def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def lines_brute(rows, shortest):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    first = {}
    for i in order:
        for no, line in enumerate(rows[i][1].split("\n") if rows[i][1] is not None else []):
            if re.search(r"[^ \t\r]", line):
                first.setdefault(line, (i, no))
    rank = {i: k for k, i in enumerate(order)}
    key = lambda line: (rank[first[line][0]], first[line][1])
    long = [x for x in first if len(x) >= shortest]
    near = {b for b in long for a in long if a != b and key(a) < key(b) and abs(len(a) - len(b)) < 2 and distance(a, b) <= 1}
    out = []
    for i, (doc, text) in enumerate(rows):
        if text is None:
            out.append((doc, None, 0, 0))
            continue
        stay, exact, close = [], 0, 0
        for no, line in enumerate(text.split("\n")):
            again, gone = line in first and first[line] != (i, no), line in near and first[line] == (i, no)
            exact, close = exact + again, close + gone
            if not again and not gone:
                stay.append(line)
        out.append((doc, "\n".join(stay), exact, close))
    return Counter(out)


@pytest.mark.parametrize("crowd", [64, 2])
def test_lines_against_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(linededup, "CROWD", crowd)
    rng = np.random.default_rng(3)
    base = ["the quick brown fox jumps over it", "ünïcode lines äre lines too, yes", "x" * 40, "short", "exactly twenty chars"]

    def edit(s):
        at, kind = int(rng.integers(0, len(s) + 1)), int(rng.integers(0, 4))
        return [s, s[:at] + "é" + s[at:], s[:at] + s[at + 1:], s[:at] + "z" + s[at + 1:]][kind]

    rows = [(i, "\n".join([edit(edit(str(rng.choice(base)))) if rng.random() < 0.8 else str(rng.choice(["", "  ", "a\r", "lone %d" % i])) for _ in range(int(rng.integers(0, 6)))])) for i in range(60)]
    rows += [(60, None), (61, ""), (None, base[0]), (62, "\n\n"), (63, base[1] + "\n" + base[1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as uid", "2 as cut", "3 as N_LINES", "4 as line").repartition(3)
    got = linededup.dedup_lines(df, shortest=15)
    assert "uid" in got.columns and got.where("uid = 1 and cut = 2 and line = 4").count() == len(rows)
    assert Counter((r.doc_id, r.text, r.n_exact, r.n_near) for r in got.collect()) == lines_brute(rows, 15)


def test_lines_of_odd_tables(spark):
    assert linededup.dedup_lines(empty(spark)).count() == 0
    got = linededup.dedup_lines(nasty(spark)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in NASTY)
    assert sum("one two three four" in (r.text or "") for r in got) == 1


@pytest.mark.parametrize("edits", [1, 2])
def test_banded_distance(spark, edits):
    rng = np.random.default_rng(edits)
    word = lambda: "".join(rng.choice(list("abé"), int(rng.integers(0, 9))))
    pairs = [(word(), word()) for _ in range(1500)]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", linededup.within_edits(F.col("a"), F.col("b"), edits).alias("near"))
    for r in df.collect():
        assert r.near == (distance(r.a, r.b) <= edits), r


# ---- embeddings -----------------------------------------------------------------------
def test_embeddings_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL", 32)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((900, 16))
    hub = rng.standard_normal(16)
    x[:150] = hub + 0.12 * rng.standard_normal((150, 16))
    for i in range(200, 400):
        x[i] = x[i + 200] + 0.25 * rng.standard_normal(16)
    x[880:] = x[0]
    vecs = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] + [1.0] * 15), (904, [float("inf")] + [1.0] * 15), (905, [None] + [1.0] * 15), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (None, vecs[0][1])]
    df = spark.createDataFrame(vecs + odd, "vec_id bigint, embedding array<float>").selectExpr("*", "1 as size", "2 as class").repartition(5)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    y = np.array([v for _, v in vecs], dtype=np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = y @ y.T >= 0.95
    a, b = np.nonzero(np.triu(near, 1))
    part = reach(range(900), list(zip(a.tolist(), b.tolist(), strict=True)))
    links = near.sum(1) - 1 + near[0]  # the row without an id equals row 0
    found = np.array([got[i].n_links for i in range(900)])
    assert (found <= links).all() and found.sum() >= 0.999 * links.sum()
    assert np.mean([got[i].component_id == part[i] for i in range(900)]) > 0.99
    assert got[None].component_id == 0 and not got[None].kept
    for i in range(900, 906):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[906].n_links == got[907].n_links == 1 and got[907].component_id == 906
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert embedding_dedup.near_duplicates(none).count() == 0


def test_calibration_grows_slowly():
    s, l = embedding_dedup.calibrate(10_000, 0.95), embedding_dedup.calibrate(10_000_000, 0.95)
    assert s.signs < l.signs and s.tables < l.tables < 120 and 0 < s.least < s.projections
