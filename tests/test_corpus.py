"""Store, frontier, text and task operators on small frames, some against brute force."""

from __future__ import annotations

import random
import re
from datetime import datetime

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import tokens
from corpusloom.operators import aggregates, documents, extraction, field_index, frontier, listing, mutations, search, similar, tasks, text_analysis
from corpusloom.plans import queries_extraction, queries_shop, queries_streams
from corpusloom.session import broadcast_if_small, dealt, is_small, new_path
from corpusloom.sources import sinks, snapshots
from corpusloom.sources.raw_pages import as_raw_pages


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_top_keys_are_cut_before_short_ones_are_dropped(spark):
    docs = spark.createDataFrame([("a",)] * 3 + [("bb",)] * 2 + [("cc",)], "domain string")
    assert rows(aggregates.docs_per_domain(docs, 2)) == [("bb", 2)]


def test_word_counts_count_documents(spark):
    docs = spark.createDataFrame([("d", "aa aa bb"), ("d", "aa"), ("e", "aa")], "domain string, content string")
    assert rows(aggregates.words_of_domain(docs, "d")) == [("aa", 2), ("bb", 1)]


def test_empty_days_are_zero(spark):
    docs = spark.createDataFrame([("d", datetime(2024, 1, 1)), ("d", datetime(2024, 1, 4))], "domain string, gatherTime timestamp")
    assert [r["n_docs"] for r in aggregates.daily_histogram(docs, "d").collect()] == [1, 0, 0, 1]


def test_paging_and_lookups(spark):
    docs = spark.createDataFrame([(i, "d", datetime(2024, 1, 1 + i % 3)) for i in range(10)], "id int, domain string, gatherTime timestamp")
    assert [r["id"] for r in documents.newest(docs, 4, 2).collect()] == [4, 7, 0, 3]
    assert documents.of_domains(docs, [], 5, 1).count() == 0
    assert documents.exists_where(docs, F.col("id") == 3) and len(list(documents.scroll(docs))) == 10
    with pytest.raises(LookupError):
        documents.by_id(docs, 99)
    with pytest.raises(ValueError):
        documents.newest(docs, 5, 0)


def test_updates_keep_old_values_for_nulls(spark):
    store = spark.createDataFrame([("1", "a", 1), ("2", "b", 2)], "id string, x string, y int")
    updates = spark.createDataFrame([("1", None, 9), ("3", "c", 3)], "id string, x string, y int")
    assert rows(mutations.partial_update(store, updates)) == [("1", "a", 9), ("2", "b", 2)]
    assert rows(mutations.unknown_keys(store, updates)) == [("3",)]
    twice = spark.createDataFrame([("1", "late", None, 2), ("1", "soon", 7, 1)], "id string, x string, y int, v int")
    assert rows(mutations.partial_update(store, twice, version="v")) == [("1", "late", 7), ("2", "b", 2)]
    assert rows(mutations.insert_or_update(store, updates, F.lit("made"))) == [("1", "a", 9), ("2", "b", 2), ("3", "c", 3)]
    assert rows(mutations.delete_where(store, F.lit(None).cast("boolean"))) == rows(store)


def test_upsert_is_idempotent_and_last_write_wins(spark):
    store = spark.createDataFrame([("1", "old", datetime(2024, 1, 1))], "id string, x string, gatherTime timestamp")
    new = spark.createDataFrame(
        [("1", "new", datetime(2024, 1, 3)), ("1", "mid", datetime(2024, 1, 2)), ("2", "two", datetime(2024, 1, 1))], store.schema
    )
    once = mutations.upsert(store, new)
    assert {(r["id"], r["x"]) for r in once.collect()} == {("1", "new"), ("2", "two")}
    assert rows(mutations.upsert(once, new)) == rows(once)


def test_snapshots_are_never_overwritten(spark):
    root = new_path(spark, "test")
    snapshots.write_snapshot(spark.range(3), root)
    changed = snapshots.change(spark, root, lambda df: df.filter("id > 0"))
    files = snapshots._Files(spark, root)
    assert changed.count() == 2 and snapshots.read_snapshot(spark, root, 0).count() == 3
    with pytest.raises(LookupError):
        snapshots.read_snapshot(spark, root, 7)
    ids = spark.range(40)
    snapshots.write_snapshot(ids, root, buckets=4)
    five = ids.filter("id = 5")
    left = snapshots.change(spark, root, lambda df: mutations.delete_keys(df, five), five)
    assert sorted(r["id"] for r in left.collect()) == [i for i in range(40) if i != 5]
    before = snapshots._manifest(files)
    assert len(before["deltas"]) == 1
    assert snapshots.change(spark, root, lambda df: df, five.limit(0)).count() == 39
    snapshots.compact(spark, root)
    after = snapshots._manifest(files)
    assert not after["deltas"] and sum(v != before["versions"].get(b) for b, v in after["versions"].items()) == 1
    assert snapshots.compact(spark, root) is None
    assert snapshots.expire(spark, root, keep=1) == 3 and snapshots.read_snapshot(spark, root).count() == 39
    assert snapshots.change(spark, root, lambda df: df.limit(0)).count() == 0


def test_a_delta_costs_what_it_weighs(spark):
    """What a batch writes doesn't depend on the store, and all of the store's files stay as they are."""
    root = new_path(spark, "deltas")
    rows = spark.range(200_000).select(F.col("id").cast("string").alias("id"), F.md5(F.col("id").cast("string")).alias("x"))
    snapshots.write_snapshot(rows, root, buckets=8)
    files = snapshots._Files(spark, root)
    whole, versions = files.size("data"), snapshots._manifest(files)["versions"]
    few = rows.filter("id < 40").withColumn("x", F.lit("new"))
    snapshots.write_delta(spark, root, few, rows.filter("id = 50"))
    assert files.size("data") + files.size("marks") - whole < whole / 50
    assert snapshots._manifest(files)["versions"] == versions
    found = {r.id: r.x for r in snapshots.read_snapshot(spark, root).filter("id < 60").collect()}
    assert len(found) == 59 and "50" not in found and all((v == "new") == (int(k) < 40) for k, v in found.items())


def test_deltas_merge_in_turn(spark, monkeypatch):
    """Random changes against a dictionary, with null keys, between and after compactions, and dealt anew."""
    import random

    rng = random.Random(4)
    schema = "id string, v long"
    root = new_path(spark, "turns")
    held = {str(i): i for i in range(30)}
    nulls = [(None, -1)]
    snapshots.write_snapshot(spark.createDataFrame([*held.items(), *nulls], schema), root, buckets=1)
    for turn in range(8):
        new = {str(k): 100 * turn + k for k in rng.sample(range(40), rng.randrange(0, 12))}
        gone = [str(k) for k in rng.sample(range(40), rng.randrange(0, 6))]
        if turn == 3:
            nulls.append((None, -2))
        added = spark.createDataFrame([*new.items(), *(nulls[-1:] if turn == 3 else [])], schema)
        snapshots.write_delta(spark, root, added, spark.createDataFrame([(k,) for k in gone], "id string"))
        held = {k: v for k, v in held.items() if k not in gone} | new
        if turn == 4:
            snapshots.compact(spark, root)
        if turn == 6:
            monkeypatch.setattr(snapshots, "BUCKET_BYTES", 500)
            snapshots.compact(spark, root)
        found = sorted(((r.id, r.v) for r in snapshots.read_snapshot(spark, root).collect()), key=str)
        assert found == sorted([*held.items(), *nulls], key=str)
    assert snapshots._manifest(snapshots._Files(spark, root))["buckets"] > 1


def test_sinks_can_be_switched_off(spark):
    docs = spark.createDataFrame([("1", "r")], "id string, spiderUUID string")
    path = new_path(spark, "off")
    sinks.fan_out(docs, [sinks.publish_sink("text", enabled=False, path=path)])
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.text(path)


def test_broadcast_is_checked(spark):
    assert is_small(spark.range(10), max_rows=10) and not is_small(spark.range(11), max_rows=10)
    assert not is_small(spark.range(10).select(F.repeat(F.lit("x"), 100)), max_bytes=500)
    assert broadcast_if_small(spark.range(5), max_rows=3).count() == 5


@pytest.mark.parametrize("salts", [1, 7])
def test_first_per_group_matches_brute_force(spark, salts):
    random.seed(5)
    data = [("hot" if random.random() < 0.5 else f"g{random.randrange(5)}", i, f"u{i}") for i in range(400)]
    df = spark.createDataFrame(data, "run_id string, n int, url string")
    got = frontier.first_per_group(df, "run_id", [F.col("n")], F.lit(20), 20, F.col("url"), salts)
    wanted = [r for g in {d[0] for d in data} for r in sorted((d for d in data if d[0] == g), key=lambda d: d[1])[:20]]
    assert {tuple(r)[:3] for r in got.collect()} == set(wanted)


def test_queue_takes_one_more_than_its_cap(spark):
    links = spark.createDataFrame([("r", f"u{i}", i) for i in range(9)], "run_id string, url string, n int")
    assert frontier.cap_queue(links, [F.col("n")], cap=4).count() == 5


def test_budget(spark):
    def kept(flags, most):
        pages = spark.createDataFrame([("r", f"u{i}", i, bool(f), most) for i, f in enumerate(flags)],
                                      "run_id string, url string, n int, effective boolean, maxPageGather int")
        return frontier.within_budget(pages, [F.col("n")]).count()

    assert kept([1, 1, 1, 1], 2) == 2  # stops at the maximum of effective pages
    assert kept([0] * 9, 2) == 5  # more than twice the maximum handled
    assert kept([0] * 9, 0) == 9  # no limit


def test_frames_need_the_whole_rule_and_are_not_filtered(spark):
    html = "<a href='/a.js#x'>1</a><A class=b HREF=/b#c>2</A><iframe src='http://a.com/f.js#k'></iframe><iframe src='/rel'></iframe><!-- <a href='/no'> -->"
    pages = spark.createDataFrame([("http://a.com/", html)], "url string, html string")
    by_site = spark.createDataFrame([("t", "a.com")], "id string, domain string")
    links = frontier.discover_links(extraction.match_templates(pages, by_site), "r")
    assert sorted(r["url"] for r in links.collect()) == ["http://a.com/b", "http://a.com/f.js#k"]
    by_rule = spark.createDataFrame([("t", "a.com", r"http://a\.com/[ab]")], "id string, domain string, urlReg string")
    links = frontier.discover_links(extraction.match_templates(pages, by_rule), "r")
    assert sorted(r["url"] for r in links.collect()) == ["http://a.com/a", "http://a.com/b"]


def test_fetch_guards(spark):
    log = spark.createDataFrame(
        [("a", 200, "text/html", 5, None), ("b", 200, "image/png", 5, " "), ("c", 200, "image/png", 5, "gbk"), ("d", 500, None, 5, None),
         ("e", 200, None, 1_048_577, ""), ("f", 200, None, 1_048_576, "")],
        "url string, status int, content_type string, content_length long, charset string")
    judged = frontier.judge_fetches(log)
    assert sorted(r["url"] for r in frontier.accepted_fetches(judged).collect()) == ["a", "c", "f"]
    assert dict(rows(frontier.failed_fetches(judged)))["e"] == "length 1048577"


def test_cjk_tokens_are_pairs(spark):
    row = spark.range(1).select(tokens.tokens(F.lit("爬虫程序 Abc-1 中 x爬虫")).alias("t"), tokens.tokens(F.lit("")).alias("e")).first()
    assert row["t"] == ["爬虫", "虫程", "程序", "abc", "1", "中", "x", "爬虫"] and row["e"] == []


def test_term_counts(spark):
    df = spark.createDataFrame([(["b", "a", "b"],), ([],)], "t array<string>")
    got = [[tuple(x) for x in r["c"]] for r in df.select(tokens.term_counts(F.col("t")).alias("c")).collect()]
    assert got == [[("a", 1), ("b", 2)], []]


def test_ranks_are_worked_out_for_few_texts_at_a_time(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(n, " ".join(rng.choice("abcdeféz") for _ in range(rng.randrange(30)))) for n in range(40)] + [(40, ""), (41, "x x")]
    docs = spark.createDataFrame([*rows, (42, None)], "id long, content string").coalesce(1)
    every = sorted(map(tuple, text_analysis.rank_scores(docs, 3).collect()))
    batch = pa.record_batch([pa.array([n for n, _ in rows]), pa.array([t for _, t in rows])], names=["id", "words"])
    slices = [(len(ids), sum(len(t) for t in texts.to_pylist())) for ids, texts in text_analysis._some_texts(batch, 100)]
    assert sum(n for n, _ in slices) == 42 and max(size for _, size in slices) <= 200 and len(slices) > 5
    monkeypatch.setattr(text_analysis, "RANK_BYTES", 1)
    alone = sorted(map(tuple, text_analysis.rank_scores(docs, 3).collect()))
    assert [r[:2] for r in alone] == [r[:2] for r in every] == sorted({(n, w) for n, t in rows for w in t.split()})
    assert [r[2] for r in alone] == pytest.approx([r[2] for r in every])


def test_entities_of_several_words(spark):
    docs = spark.createDataFrame([(1, "Ada Lovelace met IBM.<br/>In London"), (2, "x")], "id int, content string")
    names = spark.createDataFrame([("ada lovelace", "nr"), ("ibm", "nt"), ("ibm in", "ns")], "surface string, type string")
    row = text_analysis.named_entities(docs, names).first()["namedEntity"]
    assert (row["nr"], row["ns"], row["nt"]) == (["ada lovelace"], ["ibm in"], ["ibm"])


def test_salted_join_keeps_every_row(spark):
    left = spark.createDataFrame([(i, "hot" if i % 2 else f"t{i}") for i in range(100)], "id int, term string")
    right = spark.createDataFrame([("hot", 1), ("t2", 2)], "term string, df int")
    assert text_analysis.join_on_term(left, right, "id").count() == 51


def test_stored_index_answers_like_the_built_one(spark):
    docs = spark.createDataFrame([(i, f"word{i % 4} common text{i % 3} {'x ' * (i % 5)}") for i in range(40)], "id int, content string")
    built, path = search.build_index(docs), new_path(spark, "index")
    search.write_index(built, path, buckets=4)
    stored = search.read_index(spark, path)
    for query in ("word1 x", "common", "missing"):
        assert rows(search.search(stored, query, 10, 1)) == rows(search.search(built, query, 10, 1))
    seed = docs.filter("id = 3")
    alike = rows(search.more_like_this(stored, seed, 5))
    assert alike and alike == rows(search.more_like_this(built, seed, 5))


def test_field_search_refuses_tokens_in_exact_fields(spark):
    docs = spark.createDataFrame([("1", "u", ["k"])], "id string, url string, keywords array<string>")
    assert docs.filter(search.matching(docs, [search.Clause("keywords", "is", "k")])).count() == 1
    with pytest.raises(ValueError):
        search.matching(docs, [search.Clause("url", "match", "u")])


def sequential(messages):
    """Entries one message at a time."""
    found, anchor = {}, {}
    for task, ms in sorted(messages):
        if task not in anchor or ms - anchor[task] >= 2000:
            anchor[task] = ms
        found[(task, anchor[task])] = found.get((task, anchor[task]), 0) + 1
    return found


@pytest.mark.parametrize("seed", range(3))
def test_log_entries_match_one_by_one_reading(spark, seed):
    random.seed(seed)
    gaps = [50, 400, 1500, 5000, 70000]
    messages = []
    for task in ("a", "b"):
        ms = random.randrange(100_000)
        for _ in range(1500):
            ms += random.randrange(gaps[random.randrange(len(gaps) if random.random() < 0.1 else 3)])
            messages.append((task, ms))
    df = spark.createDataFrame([(t, i, ms, "m") for i, (t, ms) in enumerate(messages)], "task_id string, seq int, ts_ms long, message string")
    got = {(r["task_id"], r["anchor_ms"]): r["n_messages"] for r in tasks.coalesce_log(df).collect()}
    assert got == sequential(messages)


def test_log_anchors_are_first_messages(spark):
    times = (0, 1500, 1999, 2100, 3900, 4200)
    df = spark.createDataFrame([("t", i, ms, str(ms)) for i, ms in enumerate(times)], "task_id string, seq int, ts_ms long, message string")
    got = rows(tasks.coalesce_log(df).select("anchor_ms", "text"))
    assert got == [(0, "0<br/>1500<br/>1999"), (2100, "2100<br/>3900"), (4200, "4200")]


def test_re_extraction_with_the_same_template_changes_nothing(spark):
    pages = spark.createDataFrame([(f"http://a.com/{i}", f"<title>T{i}</title><b>body {i}</b>") for i in range(3)], "url string, html string")
    template = spark.createDataFrame([("t", "a.com", "<b>(.*?)</b>")], "id string, domain string, contentReg string")
    store = extraction.collected(extraction.extract_documents(pages, template, "r", datetime(2024, 1, 1)))
    updates = extraction.re_extract(store, "t", template, "t", "r", datetime(2024, 1, 1))
    shown = ["id", "url", "title", "content", "spiderInfoId", "gatherTime", "rawHTML"]
    assert rows(mutations.partial_update(store, updates).select(*shown)) == rows(store.select(*shown))
    in_place = extraction.re_extracted_store(store, "t", template, "t", "r", datetime(2024, 1, 1))
    assert rows(in_place.select(*shown)) == rows(store.select(*shown))
    lean = spark.createDataFrame([("n", True)], "id string, needContent boolean")
    wanted = mutations.partial_update(store, extraction.re_extract(store, "t", lean, "n", "r2", datetime(2024, 2, 1)))
    got = extraction.re_extracted_store(store, "t", lean, "n", "r2", datetime(2024, 2, 1))
    assert rows(got.select(*shown)) == rows(wanted.select(*shown))
    with pytest.raises(ValueError):
        extraction.re_extract(store, "t", template, "unknown", "r", datetime(2024, 1, 1))


def test_raw_pages_get_missing_columns(spark):
    assert as_raw_pages(spark.createDataFrame([("u",)], "url string")).columns == ["url", "html", "status", "content_type", "content_length"]


@pytest.mark.parametrize("size", [1, 4])
def test_similar_pages_are_those_of_each_seed_alone(spark, size):
    """All seeds at once, by bounds, against all matches; and far fewer pairs are scored than match."""
    rng = random.Random(size)
    topics = [[f"t{k}w{i}" for i in range(25)] for k in range(12)]
    common = [f"common{i}" for i in range(15)]
    docs = []
    for i in range(240):
        words = [rng.choice(rng.choice(topics) if rng.random() < 0.1 else topics[i % 12]) for _ in range(rng.randrange(0, 60))]
        docs.append((i, " ".join(words + rng.choices(common, k=rng.randrange(0, 30)))))
    docs += [(500 + i, docs[i][1]) for i in range(20)]
    frame = spark.createDataFrame(docs, "id long, content string")
    index = search.build_index(frame)
    wanted = rows(search.more_like_this(index, frame, size).select("seed_id", "id", "score"))
    assert rows(similar.similar_pages(index, size).select("seed_id", "id", "score")) == wanted and wanted
    terms = similar.typical_of_all(index, search.MLT_TERMS, search.MLT_MIN_DOC_FREQ, search.MLT_MIN_MATCH)
    postings = similar.weighted_postings(index, terms)
    bars = similar.scores_to_reach(terms, postings, size)
    scored = similar.candidates(similar.lookups(terms, postings, bars), postings).count()
    matches = terms.join(postings.select("term", "id"), "term").count()
    assert scored < matches / 4


def test_terms_are_counted_in_odd_texts(spark):
    """Empty and null texts have no terms but count as documents; a repeated id counts each time."""
    docs = [(1, "B a<br/>a"), (2, ""), (3, None), (None, "x"), (1, "a"), (4, "日本語 ok"), (5, "...")]
    frame = spark.createDataFrame(docs, "id long, content string")
    wanted = [(1, "a", 2, 3), (1, "b", 1, 3), (None, "x", 1, 1), (1, "a", 1, 1), (4, "日本", 1, 3), (4, "本語", 1, 3), (4, "ok", 1, 3)]
    assert sorted(map(str, map(tuple, text_analysis.term_vectors(frame).collect()))) == sorted(map(str, wanted))
    index, path = search.build_index(frame), new_path(spark, "index")
    assert tuple(index.totals.first()) == (7, 8 / 6)
    search.write_index(index, path, buckets=2)
    assert tuple(search.read_index(spark, path).totals.select("n_docs", "mean_length").first()) == (7, 8 / 6)


def test_frequent_terms_do_not_travel_for_their_frequency(spark, monkeypatch):
    docs = [(i, " ".join(["the", f"t{i % 3}", f"t{i % 3}", f"w{i % 7}", f"rare{i}"])) for i in range(30)]
    frame = spark.createDataFrame(docs, "id long, content string")
    wanted = rows(text_analysis.keyword_scores(frame))
    monkeypatch.setattr(text_analysis, "FREQUENT_TERMS", 6)
    assert rows(text_analysis.keyword_scores(frame)) == wanted and len(wanted) == 120


def test_mentions_are_sorted_for_a_bounded_number_of_documents(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 20, f"ann{i} met bob") for i in range(40)] + [(None, "bob")], "id long, content string").coalesce(1)
    names = [("bob", "nr")] + [(f"ann{i}", "ns") for i in range(40)]
    path = new_path(spark, "names")
    spark.createDataFrame(names, "surface string, type string").write.parquet(path)
    monkeypatch.setattr(text_analysis, "DOCS_A_TASK", 2)
    names = spark.read.parquet(path)
    found = text_analysis.named_entities(docs, names)
    assert found.rdd.getNumPartitions() >= 20
    wanted = text_analysis.named_entities(docs, names, few=False)
    assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect())) and found.count() == 21


def test_similar_pages_of_documents_that_come_twice(spark, monkeypatch):
    """In blocks of a few postings; no pairs are written on the way."""
    words = [f"w{i}" for i in range(12)]
    docs = [(i, " ".join(words[(i * k) % 12] for k in range(1, 8))) for i in range(40)]
    frame = spark.createDataFrame(docs + docs[5:9], "id long, content string")
    index, labels, stored = search.build_index(frame), [], text_analysis.stored
    wanted = rows(search.more_like_this(index, frame, 3).select("seed_id", "id", "score"))
    monkeypatch.setattr(similar, "BLOCK_POSTINGS", 10)
    monkeypatch.setattr(similar, "CELLS", 7)
    monkeypatch.setattr(text_analysis, "stored", lambda df, label: labels.append(label) or stored(df, label))
    assert rows(similar.similar_pages(index, 3).select("seed_id", "id", "score")) == wanted and wanted
    assert "candidates" not in labels


def test_stream_of_log_entries(spark):
    """Messages out of order and over batches; entries over a batch edge, without a text, and still open."""
    from corpusloom.plans.queries_streams import _in_two_batches
    from corpusloom.streaming import live

    rng = random.Random(2)
    start, schema = 1_700_000_000_000, "task_id string, seq long, ts_ms long, message string"
    messages = []
    for task in ("a", "b", None):
        at = start
        for seq in range(150):
            at += rng.choice([0, 10, 500, 1500, 1999, 2000, 2500])
            messages.append((task, seq, at, rng.choice(["x", "y", None, "<br/>"])))
    middle = start + 80_000
    early = [m for m in messages if m[2] < middle]
    # Some late ones come with the second batch, within the allowed lateness.
    held = [m for m in early if m[2] > middle - 4000 and m[1] % 2]
    first = [m for m in early if m not in held]
    second = held + [m for m in messages if m[2] >= middle] + [("end", 0, start + 10**7, "end"), ("a", 0, None, "no time")]
    rng.shuffle(first)
    rng.shuffle(second)
    path, whole = new_path(spark, "entries"), spark.createDataFrame(messages, schema)
    with live.rocksdb_state(spark):
        _in_two_batches(spark, spark.createDataFrame(first, schema), spark.createDataFrame(second, schema), live.log_stream, path)
    got = spark.read.parquet(path)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, tasks.coalesce_log(whole).collect()), key=str)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_streams_read_tables_of_one_file_and_of_many(spark, tmp_path):
    page = '<html lang="en"><h1>t</h1><article>a</article><p>&copy; me 2024-01-02</p><script>track(1);</script></html>'
    rows = [(n, f"http://h{n % 12}.org/en/{n}", page) for n in range(48)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    events = spark.range(20).selectExpr("id as event_id", "id % 4 as user_id", "cast(id as double) as value")
    for name, df in (("pages", pages), ("events", events)):
        df.repartition(3).write.parquet(f"{tmp_path}/many/{name}.parquet")
        pq.write_table(df.toArrow(), tmp_path / f"{name}.parquet")
    for query in (queries_streams.collect_stream, queries_streams.run_counters):
        one, many = ([tuple(r) for r in query(spark, str(d)).collect()] for d in (tmp_path, tmp_path / "many"))
        assert one and sorted(many) == sorted(one)


def test_product_pages_are_dealt_out_and_parsed_once(spark, tmp_path):
    part = "id as p_partkey, 'n' as p_name, 'b' as p_brand, 't' as p_type, 1 as p_size"
    spark.range(0, 90, 1, 1).selectExpr(*part.split(", ")).write.parquet(f"{tmp_path}/part.parquet")
    assert queries_shop._product_pages(spark, str(tmp_path)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    found = queries_shop.other_colours(spark, str(tmp_path))
    assert found.count() == 30
    named = queries_shop.products(spark, str(tmp_path)).filter("name is not null")
    for df in (found, named):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1
        assert plan.index("ArrowEvalPython") < plan.index("Repartition")


def test_short_rows_are_dealt_by_number(spark, tmp_path):
    spark.range(0, 1000, 1, 1).selectExpr("id as event_id", "timestamp_seconds(id) as ts").write.parquet(f"{tmp_path}/events.parquet")
    for query in (queries_extraction.dates_by_language, queries_extraction.format_date):
        parts = query(spark, str(tmp_path)).rdd.glom().map(len).collect()
        assert sum(parts) == 1000 and max(parts) <= 2 * 1000 / spark.sparkContext.defaultParallelism
    cut = dealt(spark.range(0, 1000, 1, 2), 40).rdd.glom().map(len).collect()
    assert len(cut) % spark.sparkContext.defaultParallelism == 0 and len(cut) >= 25 and max(cut) <= 40


def test_run_state_is_dropped(spark):
    from corpusloom.plans.queries_streams import _in_two_batches  # noqa: F401
    from corpusloom.streaming import live

    source, progress, out = (new_path(spark, label) for label in ("source", "progress", "out"))

    def run() -> int:
        stream = spark.readStream.schema("run_id string, url string").parquet(source)
        query = live.unseen_urls(stream).writeStream.format("parquet").option("path", out)
        query.option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(out).count()

    links = spark.createDataFrame([("r", "u"), ("r", "v"), ("r", "u")], "run_id string, url string")
    links.write.parquet(source)
    assert run() == 2
    links.write.mode("append").parquet(source)
    assert run() == 2
    assert live.drop_run_state(spark, progress) and not live.drop_run_state(spark, progress)
    out = new_path(spark, "out")
    assert run() == 2


def test_indexed_field_search_gives_what_a_scan_gives(spark):
    rng = random.Random(8)
    words = ["red", "green", "blue", "Sky", "sea"]
    schema = (
        "id string, content string, title string, domain string, keywords array<string>, gatherTime timestamp, "
        "n long, dynamic_fields map<string,string>"
    )
    docs = []
    for i in range(120):
        text = " ".join(rng.choices(words, k=rng.randrange(0, 5)))
        fields = {"colour": rng.choice(words), "note": text} if i % 3 else None
        docs.append((f"d{i}", rng.choice([text, None]), rng.choice([text, None]), rng.choice(["a.com", "b.com", None]),
                     rng.choice([None, [], words[:2], words[2:]]), datetime(2024, 1, 1 + i % 9), rng.choice([None, i % 17]), fields))
    frame = spark.createDataFrame(docs, schema)
    path = new_path(spark, "field-index")
    fields = ("content", "title", "domain", "keywords", "dynamic_fields", "n")
    field_index.write_field_index(frame, path, fields, ("gatherTime", "n"), buckets=16, rows_per_file=200)
    index = field_index.read_field_index(spark, path)
    choices = [
        ("content", "match", "red sky"), ("title", "match", "blue"), ("title", "match", "nothing here"), ("domain", "is", "a.com"),
        ("keywords", "is", "red"), ("n", "is", 5), ("n", "from", 4), ("n", "to", 12), ("gatherTime", "from", datetime(2024, 1, 4)),
        ("gatherTime", "to", datetime(2024, 1, 7)), ("dynamic_fields.colour", "is", "Sky"), ("dynamic_fields.note", "match", "sea"),
    ]
    for turn in range(14):
        picked = rng.sample(choices, rng.randrange(1, 5))
        needs = ["not"] if turn == 0 else ["should", "not"] if turn % 3 == 0 else ["must", "should", "not"]
        clauses = [search.Clause(*c, rng.choice(needs)) for c in picked]
        wanted = search.search_fields(frame, clauses, 15, 1 + turn % 2).select("id", "n_should")
        got = field_index.search_fields(index, clauses, 15, 1 + turn % 2).select("id", "n_should")
        assert rows(got) == rows(wanted), clauses
    plan = field_index.looked_up(index, [search.Clause("domain", "is", "a.com")])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and re.search(r"PushedFilters: \[[^\]]*key", plan)
    with pytest.raises(ValueError, match="no zones"):
        field_index.search_fields(index, [search.Clause("title", "from", "a")], 5, 1)


def _some_rows(n):
    rng = random.Random(5)
    times = [None, *(datetime(2024, 1, 1 + d, 3, 4, 5, d * 1001 + 1) for d in range(5))]
    groups = ["hot"] * 6 + ["b", None, "c"]
    return [(i, rng.choice(groups), rng.choice(times), f"x{i}") for i in range(n)]


def _listed(spark, rows, by, order, rows_per_file=7):
    path = new_path(spark, "listing")
    frame = spark.createDataFrame(rows, "id int, g string, t timestamp, part string")
    listing.write_listing(frame, path, order, by, rows_per_file)
    return listing.read_listing(spark, path)


def _in_order(rows, newest):
    """Nulls last in descending, first in ascending order."""
    last = datetime(1, 1, 1)
    by_id = sorted(rows, key=lambda r: r[0])
    return sorted(by_id, key=lambda r: r[2] or last, reverse=newest)


@pytest.mark.parametrize("newest", [True, False])
def test_pages_and_cursors_of_a_listing(spark, newest):
    data = _some_rows(120)
    found = _listed(spark, data, "g", (("t", newest), ("id", False)))
    for group in ("hot", None, "b", "none such"):
        wanted = [r[0] for r in _in_order([r for r in data if r[1] == group], newest)]
        assert listing.total(found, group) == len(wanted)
        for number in (1, 2, 6, 40):
            got = [r["id"] for r in listing.page(found, 9, number, group).collect()]
            assert got == wanted[9 * number - 9 : 9 * number]
        batches = list(listing.scroll(found, 25, group))
        assert [r["id"] for b in batches for r in b] == wanted
        assert all(len(b) == 25 for b in batches[:-1])


def test_a_page_reads_the_parts_it_lies_in(spark):
    found = _listed(spark, _some_rows(200), None, (("id", False),))
    deep = listing.page(found, 5, 30)
    assert [r["id"] for r in deep.collect()] == list(range(145, 150))
    plan = deep._jdf.queryExecution().executedPlan().toString()
    filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan).group(1)
    named = {int(x) for x in re.findall(r"__part#\d+ = (\d+)", filters)}
    held = {r["__part"]: r["n"] for r in found.parts.collect()}
    assert len(held) >= 20 and 1 <= len(named) <= 3 and sum(held[x] for x in named) <= 60
    assert deep.columns == ["id", "g", "t", "part"]


def test_cursors_outlive_their_listing(spark):
    """Written again with rows before and behind, a cursor goes on where it was, also if its row is gone."""
    order = (("t", True), ("id", False))
    data = _some_rows(60)
    first = listing.after(_listed(spark, data, None, order), 20).collect()
    more = [(r[0] + 1000, *r[1:]) for r in data]
    again = _listed(spark, [r for r in data if r[0] != first[-1]["id"]] + more, None, order)
    wanted = _in_order(data + more, True)
    at = [r[0] for r in wanted].index(first[-1]["id"])
    got = listing.after(again, 500, first[-1]["cursor"]).collect()
    assert [r["id"] for r in got] == [r[0] for r in wanted[at + 1 :]]


def test_listings_of_nothing(spark):
    found = _listed(spark, [], "g", (("t", True), ("id", False)))
    assert listing.total(found, "hot") == 0 and not list(listing.scroll(found, 5, "hot"))
    assert listing.page(found, 5, 1, "hot").collect() == [] and listing.page(found, 0, 1).collect() == []
    with pytest.raises(ValueError):
        listing.page(found, 5, 0)


@pytest.mark.parametrize("listed, cells, share", [(0, 1 << 20, 40), (3, 7, 8), (400, 300, 4), (400, 1 << 20, 16)])
def test_best_of_a_block_are_those_of_plain_sums(monkeypatch, listed, cells, share):
    """Queries with and without a bar, by lists and by rows; rows of one term and id count as one."""
    monkeypatch.setattr(similar, "LISTED", listed)
    monkeypatch.setattr(similar, "CELLS", cells)
    monkeypatch.setattr(similar, "ROW_SHARE", share)
    rng = np.random.default_rng(listed + cells)
    for trial in range(30):
        n_docs, n_terms, size = (int(rng.integers(*x)) for x in ((2, 60), (1, 30), (1, 6)))
        pairs = np.stack([rng.integers(0, n_docs, 400) * 3, rng.zipf(1.5, 400) % n_terms], 1)[: rng.integers(1, 400)]
        pairs = np.unique(pairs, axis=0) if trial % 2 else pairs
        parts = np.round(rng.random(len(pairs)) * 5, 1) + 0.1
        terms = [rng.integers(0, n_terms, rng.integers(1, 13)) for _ in range(20)]
        needed = np.array([max(1, int(len(t) * 0.3)) for t in terms])
        bars = np.where(rng.random(20) < 0.4, 0.0, rng.random(20) * 12)
        own = rng.integers(0, n_docs + 3, 20) * 3
        block = similar._Block(pa.array(pairs[:, 0]), pairs[:, 1], parts)
        known = [np.searchsorted(block.terms, t[np.isin(t, block.terms)]) for t in terms]
        query = np.repeat(np.arange(20), [len(t) for t in known])
        ids = block.ids.to_pylist()
        places = np.array([ids.index(i) if i in ids else -1 for i in own])
        row, doc, score = block.best(np.concatenate(known), query, needed, bars, places, size)
        wanted = {}
        for q, its in enumerate(terms):
            rows_of = [(i, p) for t in its for (i, u), p in zip(pairs, parts) if t == u]
            sums = [(sum(p for j, p in rows_of if j == i), i) for i in {i for i, _ in rows_of} - {own[q]} if sum(j == i for j, _ in rows_of) >= needed[q]]
            sums = sorted((s for s in sums if s[0] >= bars[q] - similar.SLACK), reverse=True)
            wanted |= {(q, i): s for s, i in sums if s >= sums[min(size, len(sums)) - 1][0] - similar.SLACK}
        found = {(q, ids[d]): s for q, d, s in zip(row, doc, score)}
        assert found.keys() == wanted.keys() and all(abs(found[k] - wanted[k]) < 1e-9 for k in found)


def test_a_bar_keeps_most_documents_of_a_block_from_being_scored(monkeypatch):
    rng = np.random.default_rng(1)
    pairs = np.unique(np.stack([rng.integers(0, 500, 9000), rng.zipf(1.3, 9000) % 200], 1), axis=0)
    block = similar._Block(pa.array(pairs[:, 0]), pairs[:, 1], rng.random(len(pairs)) * 5)
    scored, scores = [], similar._Block.scores
    monkeypatch.setattr(similar._Block, "scores", lambda self, doc, *a: scored.append(len(doc)) or scores(self, doc, *a))
    lists = np.tile(np.arange(12), 20)
    query, needed, own = np.repeat(np.arange(20), 12), np.full(20, 3), np.full(20, -1)
    top = block.best(lists, query, needed, np.zeros(20), own, 5)[2].reshape(20, -1).min(axis=1)
    scored.clear()
    assert len(block.best(lists, query, needed, top, own, 5)[0]) == 100
    assert sum(scored) < 200


@pytest.mark.parametrize("sampled", [1, 3, 50])
def test_similar_pages_by_the_scores_of_a_sample(spark, monkeypatch, sampled):
    rng = random.Random(sampled)
    docs = [(i, " ".join(rng.choices([f"w{i % 4}{k}" for k in range(8)] + ["of", "and"], k=rng.randrange(0, 12)))) for i in range(60)]
    frame = spark.createDataFrame(docs + docs[5:9] + [(None, "of and w00"), (70, None)], "id long, content string")
    index = search.build_index(frame)
    wanted = rows(search.more_like_this(index, frame, 3).select("seed_id", "id", "score"))
    for name, value in (("SAMPLE_FROM", 0), ("SAMPLED", sampled), ("BLOCK_POSTINGS", 100)):
        monkeypatch.setattr(similar, name, value)
    assert rows(similar.similar_pages(index, 3).select("seed_id", "id", "score")) == wanted and wanted


def test_few_surfaces_that_are_no_names_are_shuffled(spark, monkeypatch):
    surfaces = spark.range(4000).select("id", F.concat(F.lit("word"), F.col("id").cast("string")).alias("term"))
    names = surfaces.filter("id % 16 = 3").select("term", F.lit("nr").alias("type"))
    left = text_analysis.possible_names(surfaces, names)
    assert left.columns == ["id", "term"] and left.filter("id % 16 = 3").count() == 250
    assert left.count() < 800
    monkeypatch.setattr(text_analysis, "FILTER_WORDS", 1)
    assert text_analysis.possible_names(surfaces, names).filter("id % 16 = 3").count() == 250
    assert text_analysis.possible_names(surfaces, names.limit(0)).count() == 0


def test_mentions_travel_as_rows(spark, monkeypatch):
    docs = [(i % 50, f"ann{i % 9} met bob and carl {i}") for i in range(60)] + [(None, "bob"), (None, "carl met"), (70, None), (71, "nobody")]
    docs = spark.createDataFrame(docs, "id long, content string")
    path = new_path(spark, "names")
    names = [("bob", "nr"), ("bob", "ns"), ("carl", "nr"), ("met bob", "nt"), (None, "nr")] + [(f"ann{i}", "ns") for i in range(5)]
    spark.createDataFrame(names, "surface string, type string").write.parquet(path)
    names = spark.read.parquet(path)
    wanted = text_analysis.named_entities(docs, names, few=True)
    monkeypatch.setattr(text_analysis, "DOCS_A_SHUFFLE_TASK", 2)
    found = text_analysis.named_entities(docs, names, few=False)
    assert "partial_collect_set" not in found._jdf.queryExecution().executedPlan().toString().partition("Exchange hashpartitioning(id")[2]
    assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect())) and found.count() == 51
