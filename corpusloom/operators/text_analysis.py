"""Keywords, summaries and named entities as jobs over the whole corpus.

Documents come as ``id, content``. The three analyses can be replaced one by one (see
``plans.collect``). Their results are this package's own: no statistical language model is used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import tokens, values
from corpusloom.session import broadcast_if_small, giving_back, is_small, new_path

KEYWORDS = 10
SUMMARY_SENTENCES = 5
RANK_WINDOW = 5
RANK_DAMPING = 0.85
RANK_ROUNDS = 30
#: Text whose terms a worker ranks at once.
RANK_BYTES = 1 << 20
#: Text whose terms a worker counts at once.
TEXT_BYTES = 1 << 20
#: As many terms as this, those of most documents, are joined by broadcast.
FREQUENT_TERMS = 100_000
#: Copies of the per-term side of a join; a term of every document is spread over as many tasks.
TERM_SALTS = 16
#: Documents whose mentions of names a task sorts, and whose words and runs of words a task of a shuffle gets.
DOCS_A_TASK = 10_000
DOCS_A_SHUFFLE_TASK = 2_000
#: Bits that every name of a gazetteer gets in the filter of a shuffle, and words of 64 bits that the filter has at most.
BITS_A_NAME = 16
FILTER_WORDS = 1 << 20


def plain_content(content: Column) -> Column:
    """Stored content as text. A mark becomes a space, so that words on both sides stay apart."""
    return F.replace(content, F.lit("<br/>"), F.lit(" "))


def term_vectors(docs: DataFrame, only: list[str] | None = None) -> DataFrame:
    """``id, term, tf, doc_length``: one row per distinct term of a document, counted inside the row.

    ``only`` keeps the rows of a few terms; the length still counts every token.
    """
    if only is None:
        return counted_terms(docs, F.col("content"), "id").select("id", "term", "tf", "doc_length")
    found = docs.select("id", tokens.tokens(plain_content(F.col("content"))).alias("tokens"))
    wanted = F.filter("tokens", lambda t: t.isin(*only) if only else F.lit(False))
    return found.select(
        "id", F.size("tokens").cast("long").alias("doc_length"), F.explode(tokens.term_counts(wanted)).alias("t")
    ).select("id", "t.term", "t.tf", "doc_length")


def counted_terms(docs: DataFrame, text: Column, *keep: str) -> DataFrame:
    """The columns ``keep`` and ``term, tf, doc_length``: one row per distinct term of the text of a row.

    The tokens cross over as one text joined by spaces, which no token has, and are counted in slices of ``TEXT_BYTES``.
    """
    schema = T.StructType([docs.schema[name] for name in keep])
    schema = schema.add("term", T.StringType()).add("tf", T.LongType()).add("doc_length", T.LongType())

    def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _some_rows(batch, TEXT_BYTES):
                lists = pc.split_pattern(rows.column(0), " ")
                coded = lists.flatten().dictionary_encode()
                lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                n = max(1, len(coded.dictionary))
                codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                pairs, tf = np.unique(np.repeat(np.arange(len(lists)) * n, lengths) + codes, return_counts=True)
                row, terms = pairs // n, coded.dictionary.take(pa.array(pairs % n))
                found = pa.record_batch(
                    [rows.column(k).take(pa.array(row)) for k in range(1, rows.num_columns)]
                    + [terms, pa.array(tf.astype(np.int64)), pa.array(lengths[row])],
                    names=schema.names,
                )
                yield found.filter(pc.not_equal(terms, ""))

    words = F.array_join(tokens.tokens(plain_content(text)), " ")
    return docs.select(words.alias("_words"), *keep).mapInArrow(giving_back(count_batches), schema)


def term_statistics(vectors: DataFrame) -> DataFrame:
    """``term, df, cf``: documents with the term, and occurrences."""
    return vectors.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """``term, df`` alone, which needs no counting inside the documents."""
    terms = F.array_distinct(tokens.tokens(plain_content(F.col("content"))))
    return docs.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def join_on_term(
    left: DataFrame, per_term: DataFrame, spread: str, salts: int = TERM_SALTS, parts: int | None = None
) -> DataFrame:
    """Inner join on ``term`` in which the rows of a frequent term are dealt out by ``spread``.

    ``per_term`` has few rows per term. It is copied once per salt, which is little next to the
    postings it is joined with, and no task gets more than its share of the hottest term. ``parts`` is the least
    number of tasks, if the session's number of partitions is not to decide alone.
    """
    copies = per_term.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = left.withColumn("_salt", values.salt_of(F.col(spread), salts))
    if parts and parts > int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        salted, copies = (side.repartition(parts, "term", "_salt") for side in (salted, copies))
    return salted.join(copies, ["term", "_salt"]).drop("_salt")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back, for what is cut from the texts and used twice."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_frequencies(vectors: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Add ``df`` to rows of ``id, term``. Both are stored tables, as they are read more than once.

    The ``FREQUENT_TERMS`` terms of most documents make up most rows. These rows never travel for their frequency,
    and none is a hot key: they meet it by broadcast, after a check of its size, and only the rows of rarer
    terms are shuffled. If the terms are too long to broadcast, all rows are dealt out by salts.
    """
    known = frequencies.select("term", "df")
    at_least = known.select("df").orderBy(F.col("df").desc()).limit(FREQUENT_TERMS + 1).agg(F.min("df"), F.count("*")).first()
    if at_least[0] is None or at_least[1] <= FREQUENT_TERMS:
        return vectors.join(broadcast_if_small(known), "term")
    frequent = F.col("df") > at_least[0]
    if known.filter(frequent).isEmpty():
        return vectors.join(known, "term")
    if not is_small(known.filter(frequent)):
        return join_on_term(vectors, known, "id")
    served = vectors.join(F.broadcast(known.filter(frequent)), "term")
    rest = vectors.join(F.broadcast(known.filter(frequent).select("term")), "term", "left_anti")
    return served.unionByName(rest.join(known.filter(~frequent), "term"))


def inverse_frequency(df: Column, n_docs: Column) -> Column:
    return F.log(1 + n_docs / df)


def top_terms(scored: DataFrame, k: int = KEYWORDS, *also: str) -> DataFrame:
    """The ``k`` best terms of every document: ``id, term, score, position`` and the columns ``also``."""
    best = Window.partitionBy("id").orderBy(F.col("score").desc(), F.col("term"))
    return (
        scored.withColumn("position", F.row_number().over(best))
        .filter(F.col("position") <= k)
        .select("id", "term", "score", "position", *also)
    )


def document_count(docs: DataFrame) -> Column:
    return docs.agg(F.count("*").alias("n")).scalar()


def keyword_scores(docs: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """``id, term, score`` with score = tf * ln(1 + N / df).

    The texts are cut into terms once. ``corpus`` is where N and df come from; without it, ``docs``.
    """
    vectors = stored(term_vectors(docs), "term-vectors")
    if corpus is None:
        frequencies = vectors.groupBy("term").agg(F.count("*").alias("df"))
    else:
        frequencies = document_frequencies(corpus).join(vectors.select("term").distinct(), "term", "left_semi")
    n_docs = document_count(docs if corpus is None else corpus)
    joined = with_frequencies(vectors, stored(frequencies, "term-frequencies"))
    weight = F.col("tf") * inverse_frequency(F.col("df"), n_docs)
    return joined.select("id", "term", F.round(weight, 6).alias("score"))


def keywords(docs: DataFrame, k: int = KEYWORDS, corpus: DataFrame | None = None) -> DataFrame:
    """``id, keywords``: the best terms by frequency here against frequency everywhere."""
    return gather_terms(top_terms(keyword_scores(docs, corpus), k))


def gather_terms(ranked: DataFrame) -> DataFrame:
    """Put at most ``k`` ranked terms per document back into one array."""
    ordered = F.sort_array(F.collect_list(F.struct("position", "term")))
    return ranked.groupBy("id").agg(F.transform(ordered, lambda t: t["term"]).alias("keywords"))


def _rank_one(codes: np.ndarray, rounds: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes of one text, ascending, and their scores."""
    terms, codes = np.unique(codes, return_inverse=True)
    n = len(terms)
    pairs = [
        np.stack([codes[:-gap], codes[gap:]]) for gap in range(1, min(window, len(codes)))
    ]
    if n < 2 or not pairs:
        return terms, np.ones(n)
    low, high = np.sort(np.concatenate(pairs, axis=1), axis=0)
    edges = np.unique(low[low != high] * n + high[low != high])
    left, right = np.concatenate([edges // n, edges % n]), np.concatenate([edges % n, edges // n])
    degree = np.bincount(left, minlength=n)
    score = np.ones(n)
    for _ in range(rounds):
        passed = np.bincount(right, weights=score[left] / degree[left], minlength=n)
        score = (1 - RANK_DAMPING) + RANK_DAMPING * passed
    return terms, score


def _slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """First row and length of slices of neighbouring texts of ``most`` bytes, or one text if that is longer."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    parts = (np.cumsum(sizes) - 1).clip(0) // most
    edges = np.r_[0, np.flatnonzero(np.diff(parts)) + 1, len(parts)]
    for first, last in zip(edges[:-1], edges[1:]):
        if last > first:
            yield first, last - first


def _some_rows(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose first column is a text."""
    for first, length in _slices(batch.column(0), most):
        yield batch.slice(first, length)


def _some_texts(batch: pa.RecordBatch, most: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """``(ids, texts)`` of a batch in slices."""
    for first, length in _slices(batch.column(1), most):
        yield batch.column(0).slice(first, length), batch.column(1).slice(first, length)


def rank_scores(docs: DataFrame, rounds: int = RANK_ROUNDS, window: int = RANK_WINDOW) -> DataFrame:
    """``id, term, score`` from rank rounds on the graph of neighbouring terms of each document.

    Terms are neighbours if they occur less than ``window`` places apart. Every term starts at 1; a
    round gives it 0.15 plus 0.85 of what its neighbours pass on, each sharing its score equally.
    The only term of a document has no neighbours and stays at 1.
    A graph never leaves its document, so the rounds run where the row is and nothing is shuffled. The tokens cross
    over as one text joined by spaces, which no token has; a worker holds the terms of ``RANK_BYTES`` of them.
    """
    schema = T.StructType(
        [
            T.StructField("id", docs.schema["id"].dataType),
            T.StructField("term", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def rank_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _some_texts(batch, RANK_BYTES):
                lists = pc.split_pattern(texts, " ")
                coded = lists.flatten().dictionary_encode()
                order = pc.array_sort_indices(coded.dictionary)
                place = np.empty(len(order), dtype=np.int64)
                place[order.to_numpy()] = np.arange(len(order))
                codes = place[coded.indices.to_numpy(zero_copy_only=False)]
                ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
                ranked = [_rank_one(part, rounds, window) for part in np.split(codes, ends[:-1])]
                row = np.repeat(np.arange(len(ranked)), [len(terms) for terms, _ in ranked])
                found = pa.array(np.concatenate([terms for terms, _ in ranked]))
                scores = pa.array(np.concatenate([score for _, score in ranked]))
                yield pa.record_batch(
                    [ids.take(pa.array(row)), coded.dictionary.take(order.take(found)), scores], names=schema.names
                )

    words = docs.select("id", tokens.tokens(plain_content(F.col("content"))).alias("words"))
    joined = words.filter(F.size("words") > 0).select("id", F.array_join("words", " ").alias("words"))
    return joined.mapInArrow(giving_back(rank_batches), schema)


def rank_keywords(docs: DataFrame, k: int = KEYWORDS, rounds: int = RANK_ROUNDS) -> DataFrame:
    """``id, keywords`` by co-occurrence rank."""
    # Few rounds give short decimals; the shift keeps those that end in 5 on one side.
    scored = rank_scores(docs, rounds).withColumn("score", F.round(F.col("score") + 1e-9, 6))
    return gather_terms(top_terms(scored, k))


def sentence_scores(docs: DataFrame) -> DataFrame:
    """``id, at, score``: the mean of ln(1 + N / df) over the tokens of each sentence."""
    cut = docs.select("id", F.posexplode(tokens.sentences(plain_content(F.col("content")))).alias("at", "sentence"))
    terms = cut.select(
        "id", "at", F.explode(tokens.term_counts(tokens.tokens(F.col("sentence")))).alias("t")
    ).select("id", "at", "t.term", "t.tf")
    n_docs = document_count(docs)
    frequencies = stored(document_frequencies(docs), "term-frequencies")
    weighted = with_frequencies(stored(terms, "sentence-terms"), frequencies).select(
        "id", "at", "tf", (F.col("tf") * inverse_frequency(F.col("df"), n_docs)).alias("weight")
    )
    return weighted.groupBy("id", "at").agg(F.round(F.sum("weight") / F.sum("tf"), 6).alias("score"))


def summaries(docs: DataFrame, k: int = SUMMARY_SENTENCES) -> DataFrame:
    """``id, summary``: the best ``k`` sentences in the order of the text.

    Only sentence numbers are ranked; the texts are cut again at the end, so they do not travel
    with the terms.
    """
    best = Window.partitionBy("id").orderBy(F.col("score").desc(), F.col("at"))
    chosen = (
        sentence_scores(docs)
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .groupBy("id")
        .agg(F.sort_array(F.collect_list("at")).alias("chosen"))
    )
    cut = docs.select("id", tokens.sentences(plain_content(F.col("content"))).alias("cut"))
    return cut.join(chosen, "id").select(
        "id", F.transform("chosen", lambda at: F.get(F.col("cut"), at)).alias("summary")
    )


def possible_names(surfaces: DataFrame, names: DataFrame) -> DataFrame:
    """The rows of ``surfaces`` whose ``term`` has a hash that some name has, too, and a few others.

    The hashes are broadcast as bits. There are at most ``FILTER_WORDS`` times 64, however many names there are."""
    size = min(FILTER_WORDS, 1 << (names.count() * BITS_A_NAME // 64).bit_length())
    number = F.xxhash64("term")
    place = F.pmod(F.shiftright(number, 6), F.lit(size)).cast("int").alias("_place")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), number.bitwiseAND(F.lit(63)).cast("int"))
    bits = names.groupBy(place).agg(F.bit_or(bit).alias("_bits"))
    found = surfaces.select("*", place).join(F.broadcast(bits), "_place").filter(F.col("_bits").bitwiseAND(bit) != 0)
    return found.drop("_place", "_bits")


def entity_mentions(docs: DataFrame, gazetteer: DataFrame, few: bool | None = None) -> DataFrame:
    """``id, type, surface``, distinct. ``gazetteer`` is a stored table with ``surface`` (tokens joined
    by a space) and ``type`` (nr person, ns place, nt organisation).

    A gazetteer that has been measured as small is broadcast; otherwise surfaces and names meet by a shuffle in
    which the rows of a frequent surface are dealt out, and which few surfaces enter that are no names. ``few`` settles
    which without measuring."""
    longest = gazetteer.agg(F.max(F.size(F.split("surface", " ")))).first()[0] or 1
    def grams(words: Column) -> Column:
        return F.array_distinct(F.concat(*(tokens.grams(words, n) for n in range(1, longest + 1))))

    words = tokens.tokens(plain_content(F.col("content")))
    surfaces = docs.select("id", F.explode(values.let(words, grams)).alias("term"))
    names = gazetteer.select(F.col("surface").alias("term"), "type").distinct()
    few = is_small(names) if few is None else few
    if few:
        found = surfaces.join(F.broadcast(names), "term")
    else:
        found = join_on_term(possible_names(surfaces, names), names, "id", parts=-(-docs.count() // DOCS_A_SHUFFLE_TASK))
    return found.select("id", "type", F.col("term").alias("surface"))


def named_entities(docs: DataFrame, gazetteer: DataFrame, few: bool | None = None) -> DataFrame:
    """``id, namedEntity`` with one array per type; ``few`` is that of ``entity_mentions``.

    With a broadcast gazetteer the documents are dealt by id first: mentions then stay in their task, which sorts
    those of ``DOCS_A_TASK`` documents however large the splits of the input are. Otherwise mentions are shuffled by id
    as they are: those of a document come from nearly as many tasks, where sets of one each would weigh more."""
    few = is_small(gazetteer.select("surface", "type").distinct()) if few is None else few
    if few:
        cores = docs.sparkSession.sparkContext.defaultParallelism
        docs = docs.repartition(max(cores, -(-docs.count() // DOCS_A_TASK)), "id")
    per_type = [
        F.sort_array(F.collect_set(F.when(F.col("type") == kind, F.col("surface")))).alias(kind)
        for kind in ("nr", "ns", "nt")
    ]
    found = entity_mentions(docs, gazetteer, few)
    if not few:
        found = found.repartition("id")
    found = found.groupBy("id").agg(*per_type)
    return found.select("id", F.struct("nr", "ns", "nt").alias("namedEntity"))
