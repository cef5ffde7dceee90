"""URL verdicts: host rules first, then naive Bayes over segmented host and path words.

Host and path are cut into runs of letters, and these into words by a unigram Viterbi search. The
dictionary is made of the words of the labelled examples and of the runs that stand by themselves in the
URLs of at least two hosts; anything else is an unknown word, the less likely the longer it is. A
multinomial naive Bayes classifier, learned from the examples, adds up what the words say.

All work on names is done once for each distinct host, path and run of letters, however many URLs have it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialise

ALLOW, BLOCK = "allow", "block"

#: Labelled names to learn from: what unwanted and what wanted sites tend to be called. A parameter.
EXAMPLES: tuple[tuple[str, str], ...] = tuple(
    [(words, BLOCK) for words in (
        "casino online", "casino bonus win", "poker slots jackpot", "online betting bets", "free bets today",
        "free spins casino", "win cash prize", "win big lottery", "cheap pills", "buy cheap viagra pills",
        "cheap meds pharmacy", "discount pills rx", "payday loan fast cash", "easy credit loan", "spam mail",
        "spam links farm", "link farm seo", "buy backlinks cheap", "ads server", "ad click", "track click ads",
        "ads tracker pixel", "popup ads banner", "banner track", "adult cam live", "xxx porn tube", "hot sex chat",
        "hack crack warez", "keygen crack serial", "torrent warez free download", "replica watches cheap",
        "miracle weight loss diet", "make money fast", "get rich quick", "crypto giveaway double", "free gift prize",
    )]
    + [(words, ALLOW) for words in (
        "news daily", "city times press", "morning post journal", "science magazine", "nature review", "blog",
        "my travel blog", "cooking recipes", "garden diary blog", "open source docs", "developer guide", "wiki",
        "public library", "school district", "university research", "college archive", "museum history", "art gallery",
        "weather service", "health center", "hospital clinic", "city council", "government law", "forum community",
        "support help center", "music band", "book store", "shop local market", "sports club", "football team",
        "photo studio", "family home", "church parish", "software project", "data science lab", "mobile",
    )]
)

#: Longest word that is looked up, and occurrences that a word of the examples counts for.
LONGEST = 20
#: Letters of a run whose words are looked up together: a row of the lookup carries these and ``LONGEST`` more.
WINDOW = 64
EXAMPLE_WEIGHT = 20
SMOOTHING = 1.0

_WORDS = "piece string, words array<string>, evidence double"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there up to
    ``?``, ``#`` or the end. Both are empty if the URL is null or has no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.coalesce(lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1), F.lit(""))
    return host, path


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, as a struct of rule and verdict, or null.

    A rule is a host and the beginning of a path; it fits the host and its subdomains.
    """
    found = None
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r)):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def pieces_of(name: Column) -> Column:
    """The runs of letters of a name."""
    return F.array_remove(F.split(lower_ascii(name), r"[^\p{L}]+"), "")


def host_pieces(host: Column) -> Column:
    """The runs of letters of a host, without its last label."""
    return pieces_of(F.regexp_replace(host, r"\.?[^.]*$", ""))


def naive_bayes(examples: Sequence[tuple[str, str]]) -> dict[str, float]:
    """For every word of the examples what it adds to the log odds of being unwanted; the prior under ``""``."""
    counts = {ALLOW: Counter(), BLOCK: Counter()}
    for words, verdict in examples:
        counts[verdict].update(words.split())
    known = set(counts[ALLOW]) | set(counts[BLOCK])
    totals = {v: c.total() + SMOOTHING * len(known) for v, c in counts.items()}
    odds = {
        w: math.log((counts[BLOCK][w] + SMOOTHING) / totals[BLOCK]) - math.log((counts[ALLOW][w] + SMOOTHING) / totals[ALLOW])
        for w in known
    }
    labels = Counter(v for _, v in examples)
    odds[""] = math.log((labels[BLOCK] + 1) / (labels[ALLOW] + 1))
    return odds


def segment(piece: str, hits: Sequence[tuple[int, int, int]], total: int) -> list[str]:
    """The most likely words of a run of letters. ``hits``: start, length and count of dictionary words in it."""
    n = len(piece)
    ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for start, length, count in hits:
        ending[start + length].append((start, math.log(count / total)))
    best, came = [0.0] + [-math.inf] * n, [0] * (n + 1)
    # An unknown word of any length: begun once, then a letter at a time.
    unknown, begun = -math.inf, 0
    start_cost, letter_cost = math.log(1.0 / total), math.log(1 / 12)
    for at in range(1, n + 1):
        if best[at - 1] + start_cost >= unknown:
            unknown, begun = best[at - 1] + start_cost, at - 1
        unknown += letter_cost
        best[at], came[at] = unknown, begun
        for start, weight in ending[at]:
            if best[start] + weight > best[at]:
                best[at], came[at] = best[start] + weight, start
    words, at = [], n
    while at:
        words.append(piece[came[at] : at])
        at = came[at]
    return words[::-1]


def _segmenter(odds: dict[str, float], total: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = batch.column(0).to_pylist()
            words = []
            for piece, hits in zip(pieces, batch.column(1).to_pylist()):
                found = [(h["start"] - 1, h["length"], h["n"]) for h in hits or () if h["n"] is not None]
                words.append(segment(piece, found, total))
            evidence = [sum(odds.get(w, 0.0) for w in found) for found in words]
            yield pa.record_batch(
                [pa.array(pieces), pa.array(words, type=pa.list_(pa.string())), pa.array(evidence, type=pa.float64())],
                names=["piece", "words", "evidence"],
            )

    return run


def _dictionary(pieces: DataFrame, examples: Sequence[tuple[str, str]]) -> DataFrame:
    """``(word, n)``: runs of letters in URLs of two hosts or more, and the words of the examples."""
    spark = pieces.sparkSession
    seen = pieces.groupBy("piece").agg(F.sum("hosts").alias("n")).filter("n >= 2").select(F.col("piece").alias("word"), "n")
    given = Counter(w for words, _ in examples for w in words.split())
    taught = spark.createDataFrame([(w, EXAMPLE_WEIGHT * n) for w, n in given.items()] or [("", 0)], "word string, n long")
    return seen.union(taught.filter("n > 0")).groupBy("word").agg(F.sum("n").alias("n"))


def _words_of_pieces(pieces: DataFrame, examples: Sequence[tuple[str, str]]) -> DataFrame:
    """``(piece, words, evidence)`` for distinct runs of letters."""
    dictionary = materialise(_dictionary(pieces, examples), "url-dictionary")
    total = dictionary.agg(F.coalesce(F.sum("n"), F.lit(1))).first()[0]
    distinct = pieces.select("piece").distinct().withColumn("id", F.xxhash64("piece"))
    steps = F.sequence(F.lit(0), F.length("piece") - 1, F.lit(WINDOW))
    cut = F.transform(steps, lambda at: F.substr("piece", at + 1, F.lit(WINDOW + LONGEST - 1)))
    windows = distinct.select("id", F.posexplode(cut).alias("at", "window"))
    starts = windows.withColumn("inside", F.explode(F.sequence(F.lit(1), F.least(F.length("window"), F.lit(WINDOW)))))
    left = F.length("window") - F.col("inside") + 1
    inner = starts.withColumn("length", F.explode(F.sequence(F.lit(1), F.least(left, F.lit(LONGEST)))))
    inner = inner.select(
        "id", (F.col("at") * WINDOW + F.col("inside")).alias("start"), "length",
        F.col("window").substr(F.col("inside"), F.col("length")).alias("word"),
    )
    hits = inner.join(dictionary, "word").groupBy("id").agg(F.collect_list(F.struct("start", "length", "n")).alias("hits"))
    segmenter = _segmenter(naive_bayes(examples), int(total))
    return distinct.join(hits, "id", "left").select("piece", "hits").mapInArrow(segmenter, _WORDS)


def judge(
    pages: DataFrame,
    url: Column,
    keep: dict[str, Column],
    rules: Sequence[tuple[str, str]],
    examples: Sequence[tuple[str, str]] = EXAMPLES,
) -> DataFrame:
    """``keep`` columns of every row with ``host, path, rule, verdict, log_odds, host_words``.

    ``verdict`` is that of the longest fitting rule; without one it is ``block`` if the log odds of the host's and
    path's words being unwanted are above 0. The last label of a host is no word, and neither are digits. A
    null URL, one without ``://`` and one without letters have the odds of the examples alone. Long runs of letters
    are segmented whole. Repeated rows are judged each. Other columns are not looked at. An empty table gives an empty one.
    """
    host, path = host_and_path(url.cast("string"))
    rows = pages.select(*[c.alias(n) for n, c in keep.items()], host.alias("host"), path.alias("path"))
    names = materialise(rows.select("host", "path").distinct(), "url-names")
    hosts = names.select("host").distinct().select("host", F.posexplode(host_pieces(F.col("host"))).alias("at", "piece"))
    paths = names.select("path").distinct().select("path", F.posexplode(pieces_of(F.col("path"))).alias("at", "piece"))
    in_paths = names.select("host", F.explode(pieces_of(F.col("path"))).alias("piece"))
    per_host = hosts.select("host", "piece").union(in_paths).distinct()
    pieces = materialise(per_host.groupBy("piece").agg(F.count("*").alias("hosts")), "url-pieces")
    words = materialise(_words_of_pieces(pieces, examples), "url-words")

    of_host = hosts.join(words, "piece").groupBy("host").agg(
        F.sum("evidence").alias("host_odds"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda x: x["words"])).alias("host_words"),
    )
    of_path = paths.join(words, "piece").groupBy("path").agg(F.sum("evidence").alias("path_odds"))
    judged = rows.join(of_host, "host", "left").join(of_path, "path", "left")
    prior = naive_bayes(examples)[""]
    odds = F.lit(prior) + F.coalesce("host_odds", F.lit(0.0)) + F.coalesce("path_odds", F.lit(0.0))
    judged = judged.withColumn("log_odds", odds).withColumn("found", rule_for(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("log_odds") > 0, BLOCK).otherwise(ALLOW)
    return judged.select(
        *keep, "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce(F.col("found.verdict"), own).alias("verdict"), "log_odds",
        F.coalesce(F.array_join("host_words", " "), F.lit("")).alias("host_words"),
    )
