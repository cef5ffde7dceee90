"""Hard negatives, repeated passages and source divergence against plain versions, with odd rows and empty tables."""

from __future__ import annotations

import random
import re
import sys
from collections import Counter
from math import floor
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import plain  # noqa: E402

from corpusloom.llm import divergence, hyperplane_tree, suffix_forest  # noqa: E402

VECTORS = "vec_id long, embedding array<float>, label int, row long, dim string"


def mined_plainly(rows, positives=5, negatives=3):
    distinct = []
    for vec_id, v, label, *_ in rows:
        if vec_id is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        row = (vec_id, label, tuple(floor(256 * float(np.float32(x))) for x in v))
        if row not in distinct:
            distinct.append(row)
    found = []
    for anchor in distinct:
        if anchor[0] % 50:
            continue
        others = [(sum(a * b for a, b in zip(anchor[2], x[2])), x) for x in distinct if x is not anchor and len(x[2]) == len(anchor[2])]
        others = sorted(others, key=lambda s: (-s[0], s[1][0]))
        for p, positive in [s for s in others if s[1][1] == anchor[1] and s[1][0] != anchor[0]][:positives]:
            fits = [s for s in others if s[1][1] != anchor[1] and 50 * p <= 100 * s[0] <= 95 * p]
            found += [(anchor[0], positive[0], k + 1, x[0], p, n) for k, (n, x) in enumerate(fits[:negatives])]
    return sorted(found)


def clustered(seed: int, n: int, dim: int = 6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    return [
        (i, [float(x) for x in centres[i % 5] + 0.3 * rng.normal(size=dim)], int(rng.integers(0, 3)), i % 3, "x")
        for i in range(n)
    ]


def mine(spark, rows, **how):
    frame = spark.createDataFrame(rows, VECTORS).repartition(3)
    return hyperplane_tree.mine(frame, F.col("vec_id") % 50 == 0, F.col("label"), **how)


@pytest.mark.parametrize("leaf", [8, 4096])
def test_negatives_match_all_pairs(spark, leaf):
    rows = clustered(4, 400)
    nan, inf = float("nan"), float("inf")
    rows += [(1000, None, 1, 0, "x"), (None, rows[0][1], 1, 0, "x"), (1050, rows[0][1], None, 0, "x")]
    rows += [(1100, [1.0, nan], 1, 0, "x"), (1150, [inf, 1.0], 1, 0, "x"), (1200, [1.0, None], 1, 0, "x")]
    rows += [(1250, [], 1, 0, "x"), (1300, [1.0, 2.0], 1, 0, "x"), (1301, [2.0, 1.0], 1, 0, "x"), (1302, [1.0, 1.0], 2, 0, "x")]
    rows += rows[:60]  # repeated rows
    rows += [(2000 + i, rows[3][1], i % 2, 0, "x") for i in range(40)]  # ties
    got = sorted(tuple(r) for r in mine(spark, rows, leaf=leaf, fan=4).collect())
    assert got == mined_plainly(rows) and got


def test_mining_of_empty_and_tiny_tables(spark):
    assert mine(spark, []).collect() == []
    assert mine(spark, [(0, [1.0], 1, 0, "x")]).collect() == []
    assert mine(spark, [(0, [1.0], 1, 0, "x"), (1, [1.0], 1, 0, "x")]).collect() == []


def test_ranges_leave_subtrees_out():
    """Far clusters are not reached, and what lies in the annulus always is."""
    rng = np.random.default_rng(2)
    centres = 4000 * rng.normal(size=(12, 8))
    vectors = np.floor(np.repeat(centres, 100, axis=0) + 20 * rng.normal(size=(1200, 8))).astype(np.int64)
    most = float((vectors.astype(float) ** 2).sum(axis=1).max()) + 1
    tree = hyperplane_tree.plant(vectors[::7], len(vectors), most, 4, 50)
    raised = hyperplane_tree.raise_(vectors, most)
    leaf, seen = tree.place(raised)
    for node, apart, nearest in seen:
        for j in np.unique(nearest):
            node.low[:, j] = apart[nearest == j].min(axis=0)
            node.high[:, j] = apart[nearest == j].max(axis=0)
    assert tree.leaves > 8 and len(tree.nodes) > 2
    anchors = np.concatenate([vectors[::50].astype(float), np.zeros((24, 1))], axis=1)
    apart = hyperplane_tree.distances(anchors, raised)
    inner, outer = np.quantile(apart, 0.02, axis=1), np.quantile(apart, 0.06, axis=1)
    open_ = tree.reached(anchors, inner, outer)
    for k in range(len(anchors)):
        inside = (apart[k] >= inner[k]) & (apart[k] <= outer[k])
        assert open_[k, leaf[inside]].all()
    assert open_.mean() < 0.7


def audited_plainly(rows):
    groups: dict = {}
    spread: dict = {}
    for _, text, lang, source, *_ in rows:
        text, lang, source = text or "", lang or "", source or ""
        terms = re.findall("[a-z\x80-\U0010ffff]+", plain.lower(text))
        groups.setdefault((lang, source), Counter()).update(terms)
        spread.setdefault(lang, Counter()).update(set(terms))
    out = []
    for lang, documents in spread.items():
        kept = [t for t, n in documents.items() if n >= 10]
        own = {s: c for (x, s), c in groups.items() if x == lang}
        whole = Counter()
        for c in own.values():
            whole.update(c)
        both = own | {None: whole}
        size = {s: sum(c[t] for t in kept) + 2 * len(kept) for s, c in both.items()}
        share = {s: {t: 1 + 10**9 * (c[t] + 2) // size[s] for t in kept} for s, c in both.items()}
        def apart(p, q):
            return (p - q) ** 2 // (p + q)
        for s in own:
            pairs = [(sum(apart(share[s][t], share[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(apart(share[s][t], share[None][t]), t) for t in kept if own[s][t] and share[s][t] > share[None][t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 10)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)]
    return sorted(out)


def test_divergence_matches_dense_sums(spark):
    rng = random.Random(5)
    rows = []
    for i in range(260):
        lang, source = rng.choice(["a", "b", "", None]), rng.choice(["s1", "s2", "é", None, "", "s10"])
        words = [f"{rng.choice('ABcdé')}{rng.choice(['x', 'Y', 'zÉ', '漢'])}" for _ in range(rng.randrange(0, 40))]
        rows.append((i, rng.choice([" ", "1", "\n", "_"]).join(words), lang, source, 1, 2, "x", 0.5))
    rows += [(300, None, "a", "only", 1, 2, "x", 0.5), (301, "", "lone", "s", 1, 2, "x", 0.5), (302, "", "two", "s", 1, 2, "x", 0.5)]
    rows += [(303, "few", "two", "t", 1, 2, "x", 0.5), (None, "Few words", "two", "t", 1, 2, "x", 0.5)]
    rows += rows[:20]
    rows.append((400, "term " * 400_000 + "q" * 3_000_000, "a", "s1", 1, 2, "x", 0.5))  # longer than a piece
    got = divergence.audit(spark.createDataFrame(rows, plain.DOC_SCHEMA).repartition(4))
    assert sorted(tuple(r) for r in got.collect()) == audited_plainly(rows)


def test_scattered_rows_with_few_held_counts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "_POSTINGS", 7)
    rng = np.random.default_rng(3)
    term, group = rng.integers(0, 30, 200), rng.integers(0, 6, 200)
    pairs = sorted(set(zip(term.tolist(), group.tolist())))
    term, group = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    count, total = rng.integers(1, 50, len(pairs)), 10**6 + group * 10**4
    p, z = divergence.shares(count, total), divergence.shares(0 * count, total)
    want: Counter = Counter()
    for i in range(len(pairs)):
        for j in range(len(pairs)):
            if term[i] == term[j] and group[i] < group[j]:
                f = divergence.distance
                want[group[i], group[j]] += int(f(p[i], p[j]) - f(p[i], z[j]) - f(z[i], p[j]) + f(z[i], z[j]))
    got = {(a, int(b)): int(v) for a, found, value in divergence.scatter_rows(term, group, count, total) for b, v in zip(found, value)}
    assert got == {k: v for k, v in want.items() if v}


def test_shares_are_exact():
    counts = np.array([0, 1, 10**12, 9 * 10**15 - 10], dtype=np.int64)
    total = np.full(4, 9 * 10**15, dtype=np.int64)
    assert divergence.shares(counts, total).tolist() == [1 + 10**9 * (int(c) + 2) // (9 * 10**15) for c in counts]


def test_divergence_of_an_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], plain.DOC_SCHEMA)).collect() == []


def kept_plainly(rows):
    texts = [(doc_id, plain.WORD.findall(text or "")) for doc_id, text, *_ in rows]
    least: dict = {}
    for doc_id, words in texts:
        for i in range(len(words) - 49):
            if doc_id is not None:
                window = tuple(words[i : i + 50])
                least[window] = min(least.get(window, doc_id), doc_id)
    out = []
    for doc_id, words in texts:
        covered = set()
        for i in range(len(words) - 49):
            if doc_id is not None and least[tuple(words[i : i + 50])] < doc_id:
                covered.update(range(i, i + 50))
        out.append((doc_id, len(words), len(covered), " ".join(w for i, w in enumerate(words) if i not in covered)))
    return sorted(out, key=str)


def repeated_corpus(seed: int):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "A", "b\x0bc", "é", "漢", "x" * rng.randrange(1, 9), f"w{rng.randrange(500)}"])
    some = lambda n: [word() for _ in range(n)]
    passages = [some(n) for n in (49, 50, 51, 70, 130, 400)]
    rows = [(i, t) for i, t in enumerate([None, "", " \n", "one", "same " * 60, "same " * 80, "a b " * 2000, "b a " * 90])]
    for i in range(8, 120):
        parts = some(rng.randrange(0, 60))
        for _ in range(rng.randrange(0, 4)):
            parts += rng.choice(passages)[: rng.choice([50, 60, 400])] + some(rng.randrange(0, 30))
        rows.append((i, "".join(w + rng.choice([" ", "\n", "  ", "\t"]) for w in parts)))
    rows += [(500 - i, rows[20 + i % 3][1]) for i in range(60)] + [(None, rows[30][1]), (None, rows[30][1]), (30, rows[30][1])]
    rows += [(40, rows[31][1]), (-5, rows[32][1]), (600, " ".join(some(30_000))), (601, " ".join(passages[5]) + "\n" + " ".join(some(40_000)))]
    rng.shuffle(rows)
    return [(doc_id, text, "en", "src", 1, 7, "x", 0.5) for doc_id, text in rows]


@pytest.mark.parametrize("small", [False, True])
def test_removed_words_match_all_windows(spark, monkeypatch, small):
    """With small groups, crowded seeds take the whole window as their prefix."""
    rows = repeated_corpus(1 + small)
    if small:
        for name, value in (("GROUP", 5), ("WORDS_AT_ONCE", 64)):
            monkeypatch.setattr(suffix_forest, name, value)
    docs = spark.createDataFrame(rows, plain.DOC_SCHEMA).repartition(4)
    got = suffix_forest.remove_repeats(docs, F.col("doc_id"), F.col("text")).collect()
    assert sorted((tuple(r) for r in got), key=str) == kept_plainly(rows)


def test_cut_parts_have_the_windows_of_the_whole(monkeypatch):
    rows = [r[1] for r in repeated_corpus(3)] + ["y" * 5000 + " z " * 300, " " * 9000 + "q"]
    column = pa.array(rows)
    def windows():
        seen = set()
        for words in suffix_forest.places_of(column):
            seeds, at, n = suffix_forest.seed_runs(words)
            for s, a, k in zip(seeds, at, n):
                seen |= {(int(words.text[a]), int(words.number[a]) + j, int(s)) for j in range(int(k))}
        return seen
    whole = windows()
    monkeypatch.setattr(suffix_forest, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(suffix_forest, "PIECE", 3)
    assert windows() == whole


def test_deep_nodes_are_equal_windows():
    rng = np.random.default_rng(6)
    words = rng.integers(0, 3, 3000).astype(np.uint64)
    words[1000:1200] = words[100:300]
    suffixes = np.arange(0, 2940)
    node = suffix_forest.deep_nodes(words, suffixes, 50)
    by_window: dict = {}
    for i in suffixes:
        by_window.setdefault(tuple(words[i : i + 50].tolist()), []).append(i)
    for members in by_window.values():
        found = {int(node[i]) for i in members}
        assert found == {-1} if len(members) == 1 else len(found) == 1 and -1 not in found
    assert len({int(x) for x in node if x >= 0}) == sum(len(m) > 1 for m in by_window.values())


def test_repeats_of_empty_tables(spark):
    assert suffix_forest.remove_repeats(spark.createDataFrame([], plain.DOC_SCHEMA), F.col("doc_id"), F.col("text")).collect() == []
