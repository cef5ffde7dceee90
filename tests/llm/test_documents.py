"""Operators on documents against plain versions, with nulls, empty and long texts, repeats and empty tables."""

from __future__ import annotations

import random
import sys
import zlib
from collections import Counter
from math import exp, floor, log, log10
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import plain  # noqa: E402

from corpusloom.llm import decontamination, huffman_ids, jaccard_join, language_id, mixing, suffix_tree_lm  # noqa: E402
from corpusloom.llm.common import ROW, materialise, settle, with_row_numbers  # noqa: E402
from corpusloom.llm.components import components  # noqa: E402
from corpusloom.llm.queries import public_tokenizer  # noqa: E402
from corpusloom.llm.words import words_of  # noqa: E402
from corpusloom.session import new_path  # noqa: E402


def text_of(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(rng: random.Random, text: str, edits: int) -> str:
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed: int = 3) -> list[str | None]:
    """Near copies of several sizes, a passage that many share, and odd texts."""
    rng = random.Random(seed)
    passage = text_of(rng, 60)
    texts: list[str | None] = [None, "", " \n\t", "one", "One", "one two", "the  same\nwords", "THE same words"]
    texts += [text_of(rng, rng.randrange(5, 120)) for _ in range(40)]
    for size in (12, 40, 150, 600):
        base = text_of(rng, size)
        texts += [edited(rng, base, k % 5) for k in range(14)] + [base, base]
    texts += [f"{text_of(rng, 25)} {passage} {text_of(rng, 25)}" for _ in range(20)]
    texts += [passage, text_of(rng, 30_000)]
    base = text_of(rng, 100)
    texts += [edited(rng, base, rng.randrange(1, 8)) for _ in range(60)]
    return texts


def frame(spark, rows, schema=plain.DOC_SCHEMA, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


def test_words_are_those_of_the_pattern():
    texts = ["A  b\x0bc\x1cd\x85e É", None, "", "\n", "x"]
    for words in words_of(pa.array(texts)):
        for i, text in enumerate(texts[words.first : words.last]):
            assert words.bounds[i + 1] - words.bounds[i] == len(plain.words(text))
    same = next(words_of(pa.array(["Ab c", "aB", "ab\tC"])))
    assert same.of(0).tolist() == same.of(2).tolist() and same.of(1)[0] == same.of(0)[0]


@pytest.mark.parametrize("seed", range(60))
def test_linked_sets_share_a_signature(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.choice([5, 6, 9, 14, 40, 200, 900]))
    a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
    lost = int(rng.integers(0, max(1, n // 9) + 1))
    b = np.unique(np.r_[a[rng.permutation(len(a))[lost:]], rng.integers(0, 1 << 63, int(rng.integers(0, lost + 1)), dtype=np.uint64)])
    both = len(np.intersect1d(a, b))
    if 100 * both < 80 * (len(a) + len(b) - both):
        return
    share = rng.choice([0.0, 0.3, 0.9, 1.0])
    common = lambda x: (x >> np.uint64(7)) % np.uint64(1000) < np.uint64(1000 * share)
    signed = [set(jaccard_join.signatures_of(x, common(x), common(x), 80)[0].tolist()) for x in (a, b)]
    if not np.array_equal(a, b):
        assert signed[0] & signed[1]


def test_groups_match_all_pairs(spark):
    rows = plain.rows_with_edges(corpus())
    rows += [rows[20], rows[20], (None, rows[21][1], *rows[21][2:]), (None, None, *rows[0][2:])]
    got = jaccard_join.jaccard_groups(frame(spark, rows)).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(plain.groups([r[:2] for r in rows]), key=key)


def test_groups_of_overlapping_lists_match_all_pairs(spark):
    """A large group of near copies, more or less far from each other: frequent tokens, long lists, blocks."""
    rng = random.Random(11)
    base = text_of(rng, 150, 10_000)
    texts = [edited(rng, base, rng.randrange(1, 7)) for _ in range(700)]
    rows = plain.rows_with_edges(texts)
    got = jaccard_join.jaccard_groups(frame(spark, rows, parts=1)).collect()
    assert sorted(map(tuple, got)) == sorted(plain.groups([r[:2] for r in rows]))


@pytest.mark.parametrize("percent", [60, 80])
def test_groups_of_long_lists_of_rare_tokens_match_all_pairs(spark, percent):
    """Near copies dealt so thinly that none of their tokens is frequent anywhere, of sizes that differ."""
    rng = random.Random(17)
    texts = []
    for size in (60, 90, 200):
        base = text_of(rng, size, 10_000).split()
        for _ in range(40):
            start, end = rng.randrange(size // 8), size - rng.randrange(size // 8)
            texts.append(edited(rng, " ".join(base[start:end]), rng.randrange(0, size // 12)))
    rows = plain.rows_with_edges(texts)
    got = jaccard_join.jaccard_groups(frame(spark, rows, parts=60), percent=percent).collect()
    assert sorted(map(tuple, got)) == sorted(plain.groups([r[:2] for r in rows], percent))


def test_open_pairs_have_enough_lists_in_common(spark):
    """Of a list of 30 sets only two share so many lists that a link is possible; sizes alone would allow all pairs."""
    schema = "sig long, of_pairs long, cls long, n long, whole int, alone long, root long, head long"
    lists = [(1, cls) for cls in range(30)] + [(sig, cls) for sig in range(2, 11) for cls in (4, 9)]
    still_open = spark.createDataFrame([(sig, 0, cls, 100, 0, None, cls, 0) for sig, cls in lists], schema)
    tested = spark.createDataFrame([], "a long, b long")
    assert [tuple(r) for r in jaccard_join._open_pairs(still_open, tested, 80).collect()] == [(4, 9)]


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_smallest_sets_meet_sets_with_one_token_more(spark, percent):
    # Texts of n + 4 words have n shingles; the longer one of a pair holds all of the shorter one.
    rows = []
    for n in range(1, 13):
        words = [f"w{n}x{i}" for i in range(n + 5)]
        rows += [(2 * n, " ".join(words[:-1])), (2 * n + 1, " ".join(words))]
    docs = frame(spark, rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_groups(docs, percent=percent).collect()}
    linked = {n for n in range(1, 13) if got[2 * n + 1] == 2 * n}
    assert linked == {n for n in range(1, 13) if 100 * n >= percent * (n + 1)}


def test_members_of_a_list_beyond_what_is_held_stay_connected():
    """Every class of a list, however it is cut, is reported, linked through pairs, and not taken for alone."""
    for length in (8, 9, 10, 11, 25, 41):
        for most in (8, 20):
            for size in (1, 3, 7, 50):
                sig = np.r_[np.full(length, 5), [6]].astype(np.int64)
                rows = [sig, 0 * sig, np.arange(length + 1), 0 * sig + 10, 0 * sig + 1]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
                batches = [
                    pa.record_batch([pa.array(x[at : at + size], type=k) for x, k in zip(rows, kinds)], names=list("abcde"))
                    for at in range(0, length + 1, size)
                ]
                found = [r for b in jaccard_join._pairer(80, most)(iter(batches)) for r in b.to_pylist()]
                assert {r["a"] for r in found if r["kind"] == 1} == set(range(length))
                assert {r["a"] for r in found if r["kind"] == 3} == {length}
                near = {0}
                for _ in range(length):
                    near |= {x for r in found if r["kind"] == 0 and {r["a"], r["b"]} & near for x in (r["a"], r["b"])}
                assert near == set(range(length))


def test_numbers_of_stored_rows_are_their_places(spark):
    path = new_path(spark, "numbered")
    spark.createDataFrame([(i, f"t{i % 4}") for i in range(50)], "doc_id long, text string").repartition(5).write.parquet(path)
    rows = with_row_numbers(spark.read.parquet(path), stored=True)
    first, second = ({r[ROW]: (r.doc_id, r.text) for r in rows.collect()} for _ in range(2))
    assert first == second and len(first) == 50 and rows.columns == ["doc_id", "text", ROW]


def test_settled_steps_leave_their_result_only(spark):
    seen = []
    def step():
        inner = materialise(spark.range(5).toDF("x"), "inner")
        seen.append(inner.inputFiles()[0])
        return inner.filter("x > 2")
    kept = settle(spark, "outer", step)
    assert sorted(r.x for r in kept.collect()) == [3, 4]
    assert not Path(seen[0].removeprefix("file://")).exists()


def test_items_without_an_id_are_leaks_too(spark):
    rng = random.Random(12)
    texts = [text_of(rng, 80) for _ in range(6)]
    docs = frame(spark, [(i, t, "en", "s", 1, 7, "x", 0.5) for i, t in enumerate(texts)])
    items = spark.createDataFrame([(None, texts[2]), (5, texts[4]), (None, None)], "item_id long, text string")
    kept = decontamination.drop_leaky(docs, items)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 3, 5]


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated rows, clashing columns; then empty tables."""
    import corpus_pipeline

    rng = random.Random(9)
    rows = [(i, text_of(rng, 60), ["en", "fr"][i % 2], f"s{i % 3}", 1, 7, "x", 0.5) for i in range(40)]
    rows += [rows[3], (None, rows[5][1], "en", "s1", 1, 7, "x", 0.5), (None, text_of(rng, 50), "en", None, None, None, None, None)]
    rows += [(100, None, None, None, None, None, None, None), (101, "", "en", "s1", 0, 0, "", 0.0)]
    items = [(1, rows[7][1]), (None, None), (2, "")]
    for name, docs, bench in (("odd", rows, items), ("empty", [], [])):
        spark.createDataFrame(docs, plain.DOC_SCHEMA).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / name / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert got and {r.doc_id for r in got} <= {r[0] for r in rows[:42]}
    assert 7 not in {r.doc_id for r in got}
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).collect() == []


def test_one_of_each_group_stays(spark):
    rows = plain.rows_with_edges(corpus())
    rows += [rows[20], (None, None, *rows[0][2:])]
    kept = jaccard_join.keep_one_of_each_group(frame(spark, rows))
    wanted = [r for r, g in zip(rows, plain.groups([r[:2] for r in rows])) if g[0] == g[2]]
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, wanted))
    assert kept.columns == [x.split()[0] for x in plain.DOC_SCHEMA.split(", ")]


def test_empty_tables(spark):
    none = frame(spark, [])
    assert jaccard_join.jaccard_groups(none).count() == 0
    assert jaccard_join.keep_one_of_each_group(none).count() == 0
    assert mixing.plan_mix(none, F.col("doc_id"), F.col("source"), F.col("text")).count() == 0
    assert mixing.mix_rows(none).count() == 0
    model = language_id.train(none)
    assert language_id.keep_identified(none, model).count() == 0
    tree = suffix_tree_lm.train(none.select("text"))
    assert suffix_tree_lm.score(none, tree, F.col("doc_id"), F.col("text"), F.lit(False)).count() == 0
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontamination.find_leaks(none, items).count() == 0
    assert decontamination.find_leaks(frame(spark, plain.rows_with_edges(["a"])), items.limit(0)).count() == 0
    path = new_path(spark, "test-ids")
    huffman_ids.write_ids(none, path, public_tokenizer())
    assert huffman_ids.read_ids(spark, path).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 180)] + [(300, 301), (301, 300), (9, 9)]
    rng.shuffle(links)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 180)} | {300: 300, 301: 300}


def test_leaks_match_all_windows(spark):
    rng = random.Random(8)
    items = [(k, text_of(rng, rng.randrange(15, 60), 5000)) for k in range(12)]
    items += [(12, "tiny item"), (13, None), (14, ""), (15, items[0][1]), (None, items[1][1])]
    texts: list[str | None] = [None, "", "word", "tiny item", "a tiny item here"]
    for _, passage in items[:12]:
        texts.append(f"{text_of(rng, 40, 5000)} {passage.upper()}\n{text_of(rng, 30, 5000)}")
        texts.append(f"{text_of(rng, 10, 5000)} {edited(rng, passage, 1)} {text_of(rng, 30, 5000)}")
        texts.append(f"{text_of(rng, 10, 5000)} {' '.join(passage.split()[2:])} {text_of(rng, 30, 5000)}")
        texts.append(" ".join(passage.split()[1:]))
        texts.append(f"{text_of(rng, 50, 5000)} {' '.join(passage.split()[:9])} {text_of(rng, 50, 5000)}")
    texts.append(text_of(rng, 20_000, 5000) + " " + items[3][1])
    rows = plain.rows_with_edges(texts)
    rows += [rows[5], (None, *rows[6][1:])]
    bench = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, doc_id string")
    got = decontamination.find_leaks(frame(spark, rows), bench).collect()
    wanted = plain.leaks([r[:2] for r in rows], [x for x in items if x[0] is not None])
    assert {(r.doc_id, r.item_id) for r in got} == wanted and wanted
    assert sum(r.doc_id == rows[5][0] and r.item_id == 0 for r in got) == 2
    left = {r.doc_id for r in decontamination.drop_leaky(frame(spark, rows), bench).collect()}
    assert left == {r[0] for r in rows} - {d for d, _ in wanted}


def test_long_items_with_a_run_of_changed_words_are_found(spark):
    """At a similarity of 0.8 an item of 500 words may differ in 51 words in a row."""
    rng = random.Random(12)
    items, texts = [], []
    for k in range(60):
        words = text_of(rng, 500, 5000).split()
        at = rng.randrange(20, 420)
        items.append((k, " ".join(words)))
        changed = [*words[:at], *[f"new{rng.randrange(10**6)}" for _ in range(51 + k % 2)], *words[at + 51 + k % 2 :]]
        texts.append(f"{text_of(rng, 8, 5000)} {' '.join(changed)} {text_of(rng, 8, 5000)}")
    rows = plain.rows_with_edges(texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(frame(spark, rows), bench).collect()}
    assert {(k, k) for k in range(0, 60, 2)} <= got
    assert got == {(k, k) for k, (_, x) in enumerate(items) if plain.leaks([(k, texts[k])], [(k, x)])}


def test_blocks_find_all_prints_within_the_radius():
    rng = np.random.default_rng(4)
    words = [rng.integers(0, 2**63, 24).astype(np.uint64) for _ in range(300)]
    group = decontamination.Group(24, list(range(300)), words)
    probes = group.prints[rng.integers(0, 300, 200)].copy()
    for i, probe in enumerate(probes):
        for bit in rng.choice(decontamination.BITS, i % 100, replace=False):
            probe[bit // 16] ^= np.uint16(1 << (bit % 16))
    for most in (0, 3, 15, 16, 40, 75, 100):
        window, item, bits = group.near(probes, most)
        apart = np.array([[sum((int(x) ^ int(y)).bit_count() for x, y in zip(p, q)) for q in group.prints] for p in probes])
        assert sorted(zip(window, item)) == sorted(zip(*np.nonzero(apart <= most))) and len(window)
        assert (bits == apart[window, item]).all()


def test_allowances_leave_no_print_out():
    for most in range(200):
        allowed = decontamination.allowances(most)
        assert sum(x + 1 for x in allowed) == most + 1 and min(allowed) >= -1


def test_prints_of_windows_are_those_of_their_sets():
    rng = np.random.default_rng(5)
    shingles = decontamination.mix(rng.integers(0, 40, 400).astype(np.uint64))
    shingles[100:200] = decontamination.mix(np.arange(100, 200).astype(np.uint64))
    shingles[300:350] = shingles[0]
    for span in (1, 7, 60):
        starts = np.r_[0:90, 95:180, 250:341]
        got = decontamination.window_prints(shingles, starts, span)
        for start, own in zip(starts.tolist(), got):
            window = Counter(shingles[start : start + span].tolist())
            single = [(x, k) for x, n in window.items() for k in range(n)]
            features = [decontamination.mix(np.array([x], dtype=np.uint64) + np.array([k], dtype=np.uint64) * decontamination._NEXT) for x, k in single]
            assert (own == decontamination.print_of(np.concatenate(features))).all()


def test_similar_sets_lie_within_the_radius():
    """However the sets are made, those that are just similar enough have a bounded distance."""
    rng = np.random.default_rng(6)
    assert decontamination.radius(1, 1) == decontamination.radius(8, 8) == 0
    for size in (9, 10, 18, 55, 500):
        shared = decontamination.least_shared(size, size)
        most = decontamination.radius(size, size)
        assert most < 90
        for _ in range(60):
            both = rng.integers(0, 2**63, shared).astype(np.uint64)
            one, other = (np.r_[both, rng.integers(0, 2**63, size - shared).astype(np.uint64)] for _ in range(2))
            prints = decontamination.print_of(one) ^ decontamination.print_of(other)
            assert sum(int(x).bit_count() for x in prints) <= most


def test_repeated_words_and_items_of_one_size_are_found(spark):
    rng = random.Random(13)
    items = [(k, text_of(rng, 40, 6)) for k in range(10)] + [(10, "la " * 40), (11, "la " * 20 + "lu " * 20)]
    texts: list[str | None] = ["la " * 3000, "la " * 12, "la lu " * 300, "la " * 25 + "lu " * 35]
    texts += [f"{text_of(rng, 30, 6)} {edited(rng, x, k % 2)} {text_of(rng, 300, 6)}" for k, x in items]
    rows = plain.rows_with_edges(texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(frame(spark, rows), bench).collect()}
    assert got == plain.leaks([r[:2] for r in rows], items) and {(0, 10), (3, 11), (4, 0)} <= got


def plain_targets(sizes: dict, share: float = 1.5, repeats: float = 2.0) -> dict:
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), share * sum(sizes.values())
    while free:
        per = rest / sum(weight[s] for s in free)
        full = {s for s in free if per * weight[s] > repeats * sizes[s]}
        if not full:
            return target | {s: per * weight[s] for s in free}
        for s in full:
            target[s] = repeats * sizes[s]
            rest -= target[s]
        free -= full
    return target


def test_mix_meets_targets(spark):
    rng = random.Random(2)
    rows = []
    for i in range(3000):
        source = rng.choice(["big"] * 6 + ["b", "C", "é", None, "tiny", "zero"])
        text = None if source == "zero" else text_of(rng, rng.choice([0, 1, 30, 30, 80, 300]))
        rows.append((i if i % 50 else None, text, "en", source, 0, 1, "", 0.0))
    rows += [rows[1]] * 3
    docs = frame(spark, rows)
    plan = mixing.plan_mix(docs, F.col("doc_id"), F.col("source"), F.col("text")).collect()
    assert len(plan) == len(rows)
    sizes: Counter = Counter()
    for r in rows:
        sizes[r[3]] += len(plain.words(r[1]))
    target, taken = plain_targets(dict(sizes)), Counter()
    for r in plan:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.taken == r.copies * r["size"] <= 2 * r["size"]
        assert abs(r.target - target[r.source]) < 1e-6 * max(1, r.target)
    for source, wanted in target.items():
        assert abs(taken[source] - wanted) <= 600
    again = mixing.plan_mix(frame(spark, rows[::-1], parts=5), F.col("doc_id"), F.col("source"), F.col("text")).collect()
    assert sorted(map(str, again)) == sorted(map(str, plan))
    python = mixing.plan_mix(docs, F.col("doc_id"), F.col("source"), F.col("text"))._jdf.queryExecution().toString()
    assert "Python" not in python and "InArrow" not in python


def test_copies_are_those_of_plain_systematic_sampling(spark):
    """Running sums of expected copies from one offset for each source: a copy for each integer that is passed."""
    rng = random.Random(8)
    rows = [(i, text_of(rng, rng.choice([0, 3, 3, 40])), "en", rng.choice(["a", "b", "b", None]), 0, 1, "", 0.0) for i in range(400)]
    docs = frame(spark, rows)
    plan = {r.doc_id: r for r in mixing.plan_mix(docs, F.col("doc_id"), F.col("source"), F.col("text")).collect()}
    seed = F.lit(mixing.SEED)
    drawn = docs.select("doc_id", "source", F.xxhash64(seed, "doc_id"), F.xxhash64(seed, F.lit("offset"), "source")).collect()
    sizes: Counter = Counter()
    for r in rows:
        sizes[r[3]] += len(plain.words(r[1]))
    target = plain_targets(dict(sizes))
    for source in sizes:
        own = [r for r in drawn if r.source == source]
        own.sort(key=lambda r: (len(plain.words(rows[r.doc_id][1])), r[2], r.doc_id))
        rate, at = target[source] / sizes[source], own[0][3] % 2**31 / 2**31
        for k, r in enumerate(own):
            low, high = at + k * rate, at + (k + 1) * rate
            rounding = min(abs(low - round(low)), abs(high - round(high))) < 1e-9
            assert rounding or plan[r.doc_id].copies == floor(high) - floor(low)


def test_mixed_rows_come_as_often_as_planned(spark):
    rng = random.Random(4)
    rows = [(i, text_of(rng, 20), "en", rng.choice("abc"), 0, 1, "", 0.0) for i in range(300)]
    docs = frame(spark, rows)
    plan = {r.doc_id: r.copies for r in mixing.plan_mix(docs, F.col("doc_id"), F.col("source"), F.col("text")).collect()}
    got = mixing.mix_rows(docs)
    assert Counter(r.doc_id for r in got.collect()) == {k: v for k, v in plan.items() if v}
    assert got.columns == docs.columns


def test_rows_without_id_are_judged_one_by_one(spark):
    rng = random.Random(13)
    row = lambda i, text: (i, text, "en", "s", 0, 1, "", 0.0)
    item, text, copy = text_of(rng, 30, 5000), text_of(rng, 40, 5000), text_of(rng, 40, 5000)
    rows = [row(None, f"before {item} after"), *[row(None, text)] * 3, row(7, copy), row(None, copy), row(7, f"x {item}")]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = decontamination.drop_leaky(frame(spark, rows), bench)
    assert Counter(r.text for r in left.collect()) == {text: 3, copy: 2} and left.columns == frame(spark, rows).columns
    kept = jaccard_join.keep_one_of_each_group(frame(spark, rows[:6])).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == {(None, rows[0][1]): 1, (None, text): 1, (7, copy): 1}
    rows = [(None, text_of(rng, 20), "en", "abc"[i % 3], 0, 1, "", 0.0) for i in range(600)]
    docs = frame(spark, rows)
    plan = mixing.plan_mix(docs, F.col("doc_id"), F.col("source"), F.col("text"), share=0.3).collect()
    wanted = Counter()
    for r in plan:
        wanted[r.source] += r.copies
    assert Counter(r.source for r in mixing.mix_rows(docs, share=0.3).collect()) == wanted and wanted.total() < 300


@pytest.mark.parametrize("n", [2, 3, 7, 8, 30])
def test_code_words_are_apart(n):
    words = language_id.code_words(n)
    assert set(np.unique(words)) <= {-1, 1} and (np.abs(words.sum(axis=0)) < n).all()
    apart = [(words[i] != words[j]).sum() for i in range(n) for j in range(i)]
    assert min(apart) >= (1 if n < 3 else 2 if n == 3 else 3)


def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = language_id.train(docs.filter(~held_out))
    keep = {"doc_id": F.col("doc_id"), "lang": F.col("lang")}
    got = language_id.predict(docs.filter(held_out), model, keep).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_texts(spark):
    rows = [(1, "the of and", "en"), (2, "der die das", "de"), (3, None, "en"), (4, "der die und", None)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert model.languages == ["de", "en"]
    odd = [None, "", "123 !?", "中文", "the and " * 100_000, "die der", "— …"]
    frame_ = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(odd)], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in language_id.predict(frame_, model, {"doc_id": F.col("doc_id")}).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2, 6)] == ["und"] * 4 and got[0].score == 0.0
    assert got[3].lang_pred in ("de", "en") and got[4].lang_pred == "en" and got[5].lang_pred == "de"
    kept = language_id.keep_identified(frame_, model)
    assert kept.columns == ["doc_id", "text", "score"]
    assert {4, 5} <= {r.doc_id for r in kept.collect()} and not {0, 1, 2, 6} & {r.doc_id for r in kept.collect()}


def test_language_is_that_of_a_plain_decoder(spark):
    """Every n-gram counted one by one, every bit's loss added up one by one; and no text changes another's score."""
    rng = random.Random(21)
    vocabulary = {"en": "the of and to in", "de": "der die und das ist", "fr": "le la et les des", "ru": "и в не на что"}
    rows = [(i, " ".join(rng.choices(vocabulary[x].split(), k=rng.randrange(1, 60))), x) for i, x in enumerate([*vocabulary] * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    odd = [None, "", " ", "The, AND 12", "a", "zz", "№ 5", "в", "der the le", "und " * 300]
    probes = [(1000 + i, t, None) for i, t in enumerate(odd)] + rows

    def buckets(text):
        data = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in (text or "").encode()] + [32, 32]
        for n in range(1, language_id.ORDERS + 1):
            for i in range(len(data)):
                key = 0
                for b in (data + [32, 32])[i : i + n]:
                    key = (key * 256 + b) % 2**32
                yield ((key + (n << 28)) % 2**32 * 2654435769 % 2**32) >> 18

    languages = sorted(vocabulary)
    counts = np.zeros((len(languages), language_id.BUCKETS))
    for _, text, lang in rows:
        for b in buckets(text):
            counts[languages.index(lang), b] += 1
    model = language_id.train(docs)
    plainly = language_id.fit(languages, counts)
    assert model.languages == languages and (model.weights == plainly.weights).all() and (model.trust == plainly.trust).all()

    def decoded(text):
        found = list(buckets(text))
        sure = min(1.0, len(found) / language_id.FULL_EVIDENCE) ** 0.5
        losses = []
        for word in model.words:
            loss = 0.0
            for bit, sign in enumerate(word):
                margin = sum(float(model.weights[b, bit]) for b in found) / len(found)
                normal = max(-5.0, min(5.0, (margin - model.centre[bit]) / model.scale[bit]))
                loss += model.trust[bit] * log(1 + exp(-sign * normal * language_id.STEEPNESS * sure))
            losses.append(loss)
        return languages[losses.index(min(losses))], 1 / sum(exp(min(losses) - x) for x in losses)

    for parts in (1, 5):
        frame_ = spark.createDataFrame(probes, "doc_id long, text string, lang string").repartition(parts)
        got = {r.doc_id: r for r in language_id.predict(frame_, model, {"doc_id": F.col("doc_id")}).collect()}
        assert len(got) == len(probes)
        for doc_id, text, _ in probes:
            if not any(c.isalpha() for c in text or ""):
                assert (got[doc_id].lang_pred, got[doc_id].score) == ("und", 0.0)
                continue
            lang, score = decoded(text)
            assert got[doc_id].lang_pred == lang and abs(got[doc_id].score - score) < 1e-4


def test_scores_of_texts(spark):
    rng = random.Random(6)
    texts = [None, "", "  ", "a"] + [f"the cat sat on the {rng.choice(['mat', 'hat'])} {text_of(rng, 5, 50)}" for _ in range(400)]
    rows = plain.rows_with_edges(texts)
    rows += [rows[5], rows[5], (None, "the cat", *rows[0][2:])]
    docs = frame(spark, rows)
    held_out = F.coalesce(F.col("doc_id") % 5 == 1, F.lit(False))
    tree = suffix_tree_lm.train(docs.filter(~held_out).select("text"))
    got = suffix_tree_lm.score(docs, tree, F.col("doc_id"), F.col("text"), held_out).collect()
    known: Counter = Counter()
    for doc_id, text, *_ in rows:
        if doc_id is None or doc_id % 5 != 1:
            known.update([*plain.words(text), None])
    total, distinct = known.total(), len(known)
    by_id = {r[0]: r[1] for r in rows}
    assert len(got) == len(rows)
    for r in got:
        tokens = [*plain.words(by_id[r.doc_id]), None]
        base = sum(log10((known[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in tokens)
        assert (r.n_tokens, r.train_tokens) == (len(tokens), total)
        assert r.n_known == sum(known[t] > 0 for t in tokens) and abs(r.base_score - base) < 1e-6
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


@pytest.mark.parametrize("common", [suffix_tree_lm.COMMON, 0.02, 1.0])
def test_scores_are_those_of_a_plain_suffix_tree(spark, monkeypatch, common):
    """With all runs at every worker, some of them, and none; the plain tree's distributions sum to one."""
    monkeypatch.setattr(suffix_tree_lm, "COMMON", common)
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["a b c", "a b d", "x b c", "y", f"z{rng.randrange(60)}"]) for _ in range(6)) for _ in range(150)]
    texts += [None, "", " \t", "A b", "a b c " * 500]
    docs = frame(spark, plain.rows_with_edges(texts)).withColumn("key", F.lit(1)).withColumn("n", F.lit("x"))
    tree = suffix_tree_lm.train(docs.select("text"))
    expected = plain.SuffixTree(texts, suffix_tree_lm.DEPTH, suffix_tree_lm.LEAST, suffix_tree_lm.GAIN, suffix_tree_lm.PRIOR)
    assert {len(c) for c in expected.kept} == {1, 2, 3}
    assert tree.numbers.filter("c is null or value <> 0").count() > 10
    probes = [*texts, "a b q", "q", "b c a b d y", "z1 a b", "c a b"]
    rows = plain.rows_with_edges(probes)
    by_id = {r[0]: r[1] for r in rows}
    got = suffix_tree_lm.score(frame(spark, rows), tree, F.col("doc_id"), F.col("text"), F.lit(False)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert abs(r.score - expected.score(by_id[r.doc_id])) < 1e-6
    for context in [("a",), ("a", "b"), ("x", "b"), ("c", "a", "b"), ("q",)]:
        known = sum(expected.p(context, token) for token in expected.single)
        assert abs(known + expected.p(context, "never seen") - 1) < 1e-9


def test_runs_travel_packed_and_meet_in_many_parts(spark, monkeypatch):
    """With a few tokens to a part, scores are those of a plain tree, and what is shuffled for counting and scoring has
    rows by blocks and parts, not by runs."""
    monkeypatch.setattr(suffix_tree_lm, "PART", 100)
    rng = random.Random(11)
    texts = [" ".join(rng.choice(["a b c", "a b d", "x b c", "y", f"z{rng.randrange(300)}"]) for _ in range(8)) for _ in range(300)]
    texts += [None, "", "A b", "a b c " * 500]
    docs = frame(spark, plain.rows_with_edges(texts)).coalesce(1)
    tree = suffix_tree_lm.train(docs.select("text"))
    assert tree.parts > 50
    for length in (2, 3, 4):
        counts = docs.select("text").mapInArrow(suffix_tree_lm._gram_counts(length, 0, tree.parts), suffix_tree_lm._COUNTS)
        assert 0 < counts.count() <= tree.parts
    expected = plain.SuffixTree(texts, suffix_tree_lm.DEPTH, suffix_tree_lm.LEAST, suffix_tree_lm.GAIN, suffix_tree_lm.PRIOR)
    rows = plain.rows_with_edges([*texts[-40:], "a b q", "q", "b c a b d y", "z1 a b"])
    by_id = {r[0]: r[1] for r in rows}
    got = suffix_tree_lm.score(frame(spark, rows), tree, F.col("doc_id"), F.col("text"), F.lit(False)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert abs(r.score - expected.score(by_id[r.doc_id])) < 1e-6


def test_rare_phrases_of_a_large_corpus_are_learned(spark):
    """A phrase that occurs eight times among a million tokens, less than a hundred-thousandth of them."""
    rng = random.Random(10)
    texts = [text_of(rng, 20_000, 3000) for _ in range(50)] + ["quaint zephyr"] * 8
    docs = frame(spark, plain.rows_with_edges(texts))
    tree = suffix_tree_lm.train(docs.select("text"))
    probe = frame(spark, plain.rows_with_edges(["quaint zephyr"]))
    got = suffix_tree_lm.score(probe, tree, F.col("doc_id"), F.col("text"), F.lit(True)).collect()
    assert got[0].score > got[0].base_score + 5


@pytest.mark.parametrize("seed", range(12))
def test_huffman_codes(seed):
    rng = np.random.default_rng(seed)
    n, limit = int(rng.integers(1, 300)), int(rng.integers(9, 16))
    counts = np.maximum(1, (rng.pareto(0.4, n) * 3)).astype(np.int64) if seed % 2 else np.ones(n, dtype=np.int64)
    lengths = huffman_ids.code_lengths(counts, limit)
    assert lengths.max() <= limit and (2.0**-lengths).sum() <= 1
    symbols = np.sort(rng.choice(60_000, n, replace=False))
    code = huffman_ids.Code(symbols, lengths)
    for size in (0, 1, 255, 256, 257, 5000):
        ids = rng.choice(symbols, size)
        bits, offsets = code.encode(ids)
        assert (code.decode(bits, offsets, size) == ids).all()


def test_code_lengths_are_optimal():
    """Without a binding limit the cost is that of a Huffman code built by merging the two smallest."""
    import heapq

    rng = np.random.default_rng(1)
    counts = rng.integers(1, 1000, 50)
    heap, cost = sorted(counts.tolist()), 0
    while len(heap) > 1:
        merged = heapq.heappop(heap) + heapq.heappop(heap)
        cost += merged
        heapq.heappush(heap, merged)
    assert (huffman_ids.code_lengths(counts, 30) * counts).sum() == cost


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_ids_come_back(spark, name):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizer(name))
    odd = [None, "", " ", "It's 'S x., a.b, É. --. 3.5", "<|endoftext|>. A<|startoftext|>b.", "\x1cx \x85y　z", "é. Σας", "x" * 70_000]
    rng = random.Random(7)
    odd += ["".join(rng.choice("aAbZ.,' \n\té́É3-—\x1c\x85ß’s") for _ in range(rng.randrange(60))) for _ in range(300)]
    rows = [(i - 3, t, "en", "s", 0, 1, "", 0.0) for i, t in enumerate(odd)] + [(5, "again", *plain.rows_with_edges(["x"])[0][2:])] * 2
    rows.append((None, "no id", *rows[0][2:]))
    path = new_path(spark, "test-ids")
    huffman_ids.write_ids(frame(spark, rows, parts=4), path, public_tokenizer(name))
    got = sorted(huffman_ids.read_ids(spark, path).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids[0] is None and ids[1:] == sorted(r[0] for r in rows if r[0] is not None)
    at = 0
    wanted = Counter()
    for doc_id, text, *_ in rows:
        found = library.encode(text or "", add_special_tokens=False).ids + [2]
        wanted[doc_id, zlib.crc32(np.array(found, dtype="<u4").tobytes()), len(found)] += 1
    for r in got:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    assert Counter((r.doc_id, zlib.crc32(r.ids), r.n_tokens) for r in got) == wanted


def test_added_tokens_in_other_case():
    """The library matches added tokens with case, on the text as it is."""
    from tokenizers import Tokenizer

    path = public_tokenizer("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = ["a <|ENDOFTEXT|> b", "a <|endoftext|> B", "X<|EndOfText|>Y. Z", "<|StartOfText|>", "<|", "ENDOFTEXT|> A", "<|startoftext|>,"]
    data = [x.encode() for x in texts]
    cuts = np.r_[0, np.cumsum([len(x) for x in data])]
    counts, flat = huffman_ids.tokenizer_at(path).encode(np.frombuffer(b"".join(data), dtype=np.uint8), cuts)
    wanted = [library.encode(x, add_special_tokens=False).ids for x in texts]
    assert counts.tolist() == [len(x) for x in wanted] and flat.tolist() == sum(wanted, [])
