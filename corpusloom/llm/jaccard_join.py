"""Documents whose word shingles overlap: an exact Jaccard join by token-combination prefixes.

Tokens are the distinct shingles of a document, as 64-bit hashes. Documents with equal sets form a
class and are linked by that alone; the join runs on classes.

All sets are put into one order of tokens: rare tokens before frequent ones, by hash within either.
Sets of sizes n and m that reach the threshold t share at least ``ceil(t * n)`` tokens, so a set can lose
``n - ceil(t * n)`` tokens of a prefix and the pair still meets there. Rare tokens are indexed one by
one; each counts for one. Frequent tokens are dealt into groups, and every pair of one group is
indexed; a group counts for its tokens less one. The prefix is extended until its tokens count for
``n - ceil(t * n) + 1``: then one signature at least is common to both. Only documents that consist of
frequent tokens almost entirely ever reach that part.

Whether a token is frequent is read from a bitmap of fixed size. It only moves tokens within the order,
the same for all sets, so a wrong bit costs time and never a link.

If the prefixes of both sets go on to frequent tokens, all their rare tokens are indexed, and those that
met no other set bound the overlap of the pair. That sorts out most sets that resemble a large group
of near copies without being linked with it.

Lists of a signature are not expanded into all pairs. A short list gives its pairs, a long one the pairs
with one of its first classes. Links found so contract into components. Classes of a long list that are still
in different components are then compared: for lists of rare tokens in pairs that have enough of these lists in common
for a link, in blocks for the overlapping lists of frequent ones, so no component falls apart.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import ROW, bitmap_words, collect_bitmap, giving_back, in_bitmap, materialise, settle, take, with_row_numbers
from corpusloom.llm.components import components
from corpusloom.llm.words import mix, shingle_sets, words_of

#: Shingles that are counted together to find frequent tokens, and the classes a token must be in there.
BLOCK = 1 << 21
FREQUENT = 3
HOT = 64
#: Parts into which lists of hot token pairs are split.
SALTS = 16
#: Longest list that gives all its pairs at once.
SHORT_LIST = 4
#: A long list gives the pairs with one class of its first so many; which one is the list's own choice, so
#: sets that share many lists meet all of these.
LEADERS = 16
#: Rows of one list that are held in a worker at most.
HELD = 1 << 16
#: Classes of a block in which a cluster is compared.
CLUSTER_BLOCK = 512
#: Tokens below this hash go into the sketch that sorts out most candidates.
LOW = np.uint64(1 << 62)

_PROFILE = "kind int, doc_id long, cls long, n long, rest int, slack int, low array<int>"
_SETS = "cls long, tokens array<long>"
#: ``salt`` is 0 for a rare token, 1 for a pair of frequent ones, more for parts of a split list. ``whole``
#: says that all rare tokens of the set are indexed, because the prefix goes on to frequent ones.
_SIGNATURES = "sig long, salt int, cls long, n long, whole int"
#: Kind 0: a pair. 1: a member of a long list, ``nb`` telling whether of frequent pairs. 2: the first class of
#: a part of a split list. 3: ``na`` rare tokens of a class were found in no other list.
_CANDIDATES = "kind int, sig long, a long, na long, wa int, b long, nb long, wb int"


def class_of(tokens: np.ndarray) -> np.uint64:
    """One number for a set of tokens."""
    parts = mix(tokens + np.uint64(0x632BE59BD9B4E019))
    crossed = mix(np.bitwise_xor.reduce(parts, keepdims=True))
    return mix(parts.sum(dtype=np.uint64, keepdims=True) + crossed)[0]


def _frequent_rows(sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    tokens = np.sort(np.concatenate(sets)) if sets else np.zeros(0, dtype=np.uint64)
    starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]]) if len(tokens) else np.zeros(0, dtype=int)
    lengths = np.diff(np.r_[starts, len(tokens)])
    for kind, least in ((1, FREQUENT), (2, HOT)):
        words, bits = bitmap_words(tokens[starts[lengths >= least]])
        if len(words):
            empty = pa.nulls(len(words), pa.int64())
            yield pa.record_batch(
                [
                    pa.array(np.full(len(words), kind, dtype=np.int32)),
                    empty,
                    pa.array(words),
                    pa.array(bits),
                    pa.nulls(len(words), pa.int32()),
                    pa.nulls(len(words), pa.int32()),
                    pa.nulls(len(words), pa.list_(pa.int32())),
                ],
                names=["kind", "doc_id", "cls", "n", "rest", "slack", "low"],
            )


def _lists(arrays: list[np.ndarray | None], kind: pa.DataType) -> pa.Array:
    lengths = [0 if x is None else len(x) for x in arrays]
    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    full = [x for x in arrays if x is not None]
    values = pa.array(np.concatenate(full) if full else np.zeros(0), type=kind)
    mask = pa.array([x is None for x in arrays])
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=mask)


def _profiler(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        block: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for words in words_of(batch.column(1)):
                classes, counts, rest, slack, lows = [], [], [], [], []
                for tokens in shingle_sets(words, size):
                    cls = int(class_of(tokens).view(np.int64)) if len(tokens) else 0
                    low = None
                    below = int(np.searchsorted(tokens, LOW))
                    if len(tokens) and cls not in seen:
                        seen.add(cls)
                        block.append(tokens)
                        held += len(tokens)
                        low = np.unique((tokens[:below] & np.uint64(0xFFFFFFFF)).astype(np.uint32)).view(np.int32)
                    classes.append(cls)
                    counts.append(len(tokens))
                    rest.append(len(tokens) - below)
                    slack.append(0 if low is None else below - len(low))
                    lows.append(low)
                    if held >= BLOCK:
                        yield from _frequent_rows(block)
                        block, held, seen = [], 0, set()
                yield pa.record_batch(
                    [
                        pa.array(np.zeros(len(classes), dtype=np.int32)),
                        batch.column(0).slice(words.first, words.last - words.first),
                        pa.array(classes, type=pa.int64()),
                        pa.array(counts, type=pa.int64()),
                        pa.array(rest, type=pa.int32()),
                        pa.array(slack, type=pa.int32()),
                        _lists(lows, pa.int32()),
                    ],
                    names=["kind", "doc_id", "cls", "n", "rest", "slack", "low"],
                )
        yield from _frequent_rows(block)

    return run


def needed_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def links_others(n: int, percent: int) -> bool:
    """Whether a set of ``n`` tokens can be linked with another one: with a smaller set, or with one that has a token more."""
    return needed_overlap(n, percent) < n or percent * (n + 1) <= 100 * n


def size_class(n: int, percent: int) -> int:
    """Sizes that a link allows are in the same or in neighbouring classes."""
    return int(math.log(n) / (1.0001 * math.log(100 / percent))) if percent < 100 else n


def _group_count(scheme: int, percent: int) -> int:
    """Groups of frequent tokens for sets of about this size: some eight tokens of a prefix in each."""
    if percent >= 100:
        return 1
    size = (100 / percent) ** scheme
    return max(1, math.ceil(size * (1 - percent / 100) * 1.5 / 8))


def signatures_of(
    tokens: np.ndarray, frequent: np.ndarray, hot: np.ndarray, percent: int
) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of one set, and for each whether it is a rare token (0), a pair (1) or a pair of hot ones (2).

    ``tokens`` are ascending; ``frequent`` and ``hot`` say for each which class it is in.
    """
    n = len(tokens)
    need = n - needed_overlap(n, percent) + 1
    rare = tokens[~frequent]
    if len(rare) >= need:
        return rare[:need], np.zeros(need, dtype=np.int64)
    found, split = [rare], [np.zeros(len(rare), dtype=np.int64)]
    common, common_hot = tokens[frequent], hot[frequent]
    own = size_class(n, percent)
    for scheme in (own, own + 1):
        group = (common >> np.uint64(20)) % np.uint64(_group_count(scheme, percent))
        order = np.argsort(group, kind="stable")
        again = np.zeros(len(common), dtype=bool)
        again[order[1:]] = group[order[1:]] == group[order[:-1]]
        reach = int(np.searchsorted(np.cumsum(again), need - len(rare))) + 1
        kept, kept_hot, kept_group = common[:reach], common_hot[:reach], group[:reach]
        order = np.argsort(kept_group, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(kept_group[order])) + 1):
            i, j = np.triu_indices(len(part), 1)
            first, second = kept[part[i]], kept[part[j]]
            found.append(mix(first * np.uint64(0x9E3779B97F4A7C15) + second + np.uint64(scheme)))
            split.append(1 + (kept_hot[part[i]] & kept_hot[part[j]]))
    return np.concatenate(found), np.concatenate(split)


def _signer(size: int, percent: int, frequent, hot) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common_bits, hot_bits = frequent.value, hot.value
        seen: set[int] = set()
        for batch in batches:
            for words in words_of(batch.column(0)):
                sigs, salts, classes, sizes, wholes = [], [], [], [], []
                for tokens in shingle_sets(words, size):
                    n = len(tokens)
                    if not n or not links_others(n, percent):
                        continue  # only an equal set can be linked with it
                    cls = class_of(tokens).view(np.int64)
                    if int(cls) in seen:
                        continue
                    if len(seen) >= HELD:
                        seen.clear()
                    seen.add(int(cls))
                    found, salt = signatures_of(
                        tokens, in_bitmap(common_bits, tokens), in_bitmap(hot_bits, tokens), percent
                    )
                    sigs.append(found)
                    salts.append(np.where(salt == 2, 2 + int(cls) % SALTS, salt).astype(np.int32))
                    classes.append(np.full(len(found), cls))
                    sizes.append(np.full(len(found), n))
                    wholes.append(np.full(len(found), salt.any(), dtype=np.int32))
                if sigs:
                    columns = [np.concatenate(sigs).view(np.int64)]
                    columns += [np.concatenate(x) for x in (salts, classes, sizes, wholes)]
                    yield pa.record_batch(
                        [pa.array(x) for x in columns], names=["sig", "salt", "cls", "n", "whole"]
                    )

    return run


def _candidate_rows(kind: int, n: int, **columns: np.ndarray) -> pa.RecordBatch:
    nothing = np.zeros(n, dtype=np.int64)
    whole = {"wa", "wb"}
    found = [pa.array(np.full(n, kind, dtype=np.int32))]
    for name in ("sig", "a", "na", "wa", "b", "nb", "wb"):
        found.append(pa.array(columns.get(name, nothing).astype(np.int32 if name in whole else np.int64)))
    return pa.record_batch(found, names=["kind", "sig", "a", "na", "wa", "b", "nb", "wb"])


def _pairs_of_lists(sig, salt, cls, n, whole, percent: int, goes_on: bool = False) -> Iterator[pa.RecordBatch]:
    """Candidates of lists, sorted by class. With ``goes_on`` the first list has had members before: it is long,
    however few are left of it."""
    if not len(sig):
        return
    edge = np.r_[True, (sig[1:] != sig[:-1]) | (salt[1:] != salt[:-1])]
    starts = np.flatnonzero(edge)
    lengths = np.diff(np.r_[starts, len(sig)])
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    split = salt[starts] > 1
    long = lengths > SHORT_LIST
    long[0] |= goes_on
    for m in range(2, SHORT_LIST + 1):
        at = starts[~split & ~long & (lengths == m)]
        for i in range(m):
            for j in range(i + 1, m):
                pairs.append((at + i, at + j))
    chosen = mix(sig[starts].view(np.uint64)) % np.minimum(lengths, LEADERS).astype(np.uint64)
    leader = np.repeat(starts + chosen.astype(np.int64), lengths)
    member = np.flatnonzero(np.repeat(split | long, lengths))
    pairs.append((leader[member], member))
    first, second = (np.concatenate(x) for x in zip(*pairs))
    close = (cls[first] != cls[second]) & (
        percent * np.maximum(n[first], n[second]) <= 100 * np.minimum(n[first], n[second])
    )
    first, second = first[close], second[close]
    low, high = np.minimum(cls[first], cls[second]), np.maximum(cls[first], cls[second])
    _, at = np.unique(np.stack([low, high], axis=1), axis=0, return_index=True)
    swap = cls[first] > cls[second]
    first, second = np.where(swap, second, first), np.where(swap, first, second)
    if len(at):
        x, y = first[at], second[at]
        yield _candidate_rows(
            0, len(at), a=cls[x], na=n[x], wa=whole[x], b=cls[y], nb=n[y], wb=whole[y]
        )
    if len(member):
        of_pairs = (salt[member] > 0).astype(np.int64)
        yield _candidate_rows(
            1, len(member), sig=sig[member], a=cls[member], na=n[member], wa=whole[member], nb=of_pairs
        )
    parts = starts[split]
    if len(parts):
        yield _candidate_rows(2, len(parts), sig=sig[parts], a=cls[parts], na=n[parts], wa=whole[parts])
    alone = starts[~long & (lengths == 1) & (salt[starts] == 0) & (whole[starts] == 1)]
    if len(alone):
        classes, counts = np.unique(cls[alone], return_counts=True)
        yield _candidate_rows(3, len(classes), a=classes, na=counts)


def _pairer(percent: int, most: int) -> Callable:
    """Rows come sorted by (sig, salt, cls); equal rows come from copies in different files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (np.int64, np.int32, np.int64, np.int64, np.int32)
        held: list[np.ndarray] = [np.zeros(0, dtype=x) for x in kinds]
        goes_on = False
        for batch in batches:
            fresh = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(kinds))]
            rows = [np.concatenate(x) for x in zip(held, fresh)]
            if not len(rows[0]):
                continue
            new = np.ones(len(rows[0]), dtype=bool)
            new[1:] = np.any([x[1:] != x[:-1] for x in rows[:3]], axis=0)
            rows = [x[new] for x in rows]
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            cut += int(np.searchsorted(rows[1][cut:], rows[1][-1]))
            if len(rows[0]) - cut > most:
                # A list longer than what is held: these members meet one of them, and the first one stays.
                yield from _pairs_of_lists(*rows, percent, goes_on)
                held, goes_on = [x[cut : cut + 1] for x in rows], True
            else:
                yield from _pairs_of_lists(*[x[:cut] for x in rows], percent, goes_on)
                held, goes_on = [x[cut:] for x in rows], goes_on and cut == 0
        yield from _pairs_of_lists(*held, percent, goes_on)

    return run


def _set_reader(size: int, wanted) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        seen: set[int] = set()
        for batch in batches:
            for words in words_of(batch.column(0)):
                classes, sets = [], []
                for tokens in shingle_sets(words, size):
                    if not len(tokens):
                        continue
                    cls = class_of(tokens)
                    if int(cls) in seen or not in_bitmap(bits, np.array([cls]))[0]:
                        continue
                    if len(seen) >= HELD:
                        seen.clear()
                    seen.add(int(cls))
                    classes.append(int(cls.view(np.int64)))
                    sets.append(tokens.view(np.int64))
                if classes:
                    yield pa.record_batch(
                        [pa.array(classes, type=pa.int64()), _lists(sets, pa.int64())], names=["cls", "tokens"]
                    )

    return run


def _wanted_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, bits = bitmap_words(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        yield pa.record_batch([pa.array(words), pa.array(bits)], names=["word", "bits"])


def _both(pairs: DataFrame, sides: DataFrame) -> DataFrame:
    """The pairs with the columns of both their classes, as ``x_...`` and ``y_...``."""
    for side, key in (("x", "a"), ("y", "b")):
        named = sides.select(*[F.col(c).alias(f"{side}_{c}") for c in sides.columns])
        pairs = pairs.join(named, pairs[key] == named[f"{side}_cls"])
    return pairs


def _reaches(overlap, n, m, percent: int):
    """Whether ``overlap`` of sets of sizes ``n`` and ``m`` is at least ``percent`` of their union."""
    return (100 + percent) * overlap >= percent * (n + m)


class _Verifier:
    def __init__(self, texts: DataFrame, profile: DataFrame, size: int, percent: int) -> None:
        self.texts, self.size, self.percent = texts, size, percent
        first = [F.first(c).alias(c) for c in ("n", "rest", "slack", "low")]
        self.sketches = profile.filter("low is not null").groupBy("cls").agg(*first)

    def sets(self, wanted: DataFrame) -> DataFrame:
        """``(cls, tokens)`` of the wanted classes, and of some that share a bit of the bitmap with them."""
        bits = collect_bitmap(wanted.mapInArrow(_wanted_bits, "word long, bits long"), "word", "bits")
        reader = _set_reader(self.size, self.texts.sparkSession.sparkContext.broadcast(bits))
        sets = self.texts.mapInArrow(giving_back(reader), _SETS).groupBy("cls").agg(F.first("tokens").alias("tokens"))
        return materialise(sets, "jaccard-sets")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs ``(a, b)`` that are links: sketches bound the overlap, then whole sets decide."""
        overlap = (
            F.size(F.array_intersect("x_low", "y_low"))
            + F.col("x_slack")
            + F.col("y_slack")
            + F.least("x_rest", "y_rest")
        )
        possible = _both(pairs, self.sketches).filter(
            _reaches(overlap, F.col("x_n"), F.col("y_n"), self.percent)
        )
        possible = materialise(possible.select("a", "b", "x_n", "y_n"), "jaccard-possible")
        if possible.isEmpty():
            return possible.select("a", "b")
        sets = self.sets(possible.select(F.explode(F.array("a", "b")).alias("cls")).distinct())
        exact = F.size(F.array_intersect("x_tokens", "y_tokens"))
        found = _both(possible, sets).filter(_reaches(exact, F.col("x_n"), F.col("y_n"), self.percent))
        return materialise(found.select("a", "b"), "jaccard-links")


def jaccard_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80
) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs``.

    A document's set holds the distinct shingles of ``size`` words of its whole text; with fewer words
    the whole sequence is one shingle. Two documents are linked if ``100 * |intersection| >= percent *
    |union|``. ``component_id`` is the smallest id that links lead to, itself included.

    Null and blank texts have an empty set and are linked with nothing. Rows with a null id are
    documents too, but give no ``component_id`` to others; it is null if no document of the component has
    an id. Repeated rows come out as often as they came in. Other columns of ``docs`` are not looked at.
    An empty table gives an empty table.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    texts = rows.select("text")
    profile = materialise(rows.mapInArrow(giving_back(_profiler(size)), _PROFILE), "jaccard-profile")
    members = profile.filter("kind = 0")
    share = spark.sparkContext.broadcast
    frequent = share(collect_bitmap(profile.filter("kind = 1"), "cls", "n"))
    hot = share(collect_bitmap(profile.filter("kind = 2"), "cls", "n"))

    signed = texts.mapInArrow(giving_back(_signer(size, percent, frequent, hot)), _SIGNATURES)
    sorted_lists = signed.repartition("sig", "salt").sortWithinPartitions("sig", "salt", "cls")
    candidates = materialise(sorted_lists.mapInArrow(giving_back(_pairer(percent, HELD)), _CANDIDATES), "jaccard-candidates")

    alone = candidates.filter("kind = 3").groupBy(F.col("a").alias("cls")).agg(F.sum("na").alias("alone"))
    alone = materialise(alone, "jaccard-alone")
    pairs = materialise(_first_pairs(candidates, alone, percent), "jaccard-pairs")
    verifier = _Verifier(texts, members, size, percent)
    links = verifier.links(pairs)
    roots = materialise(components(links, "a", "b"), "jaccard-roots")

    still_open = _open_members(candidates, alone, roots, percent)
    more = [verifier.links(materialise(_open_pairs(still_open, pairs, percent), "jaccard-open"))]
    more += _links_of_clusters(verifier, still_open)
    for found in more:
        links = links.union(found)
    roots = materialise(components(links, "a", "b"), "jaccard-roots")

    classes = members.groupBy("cls").agg(F.min("doc_id").alias("least"))
    named = classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select(
        "cls", "least", F.coalesce("root", "cls").alias("root")
    )
    smallest = named.groupBy("root").agg(F.min("least").alias("smallest"))
    of_class = named.join(smallest, "root").select("cls", "smallest")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("smallest"))
    return members.join(of_class, "cls", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")
    )


def _can_reach(n, whole, alone, m, other_whole, other_alone, percent: int):
    """Whether two sets can be linked, by their sizes and by rare tokens that either has to itself."""
    sizes = percent * F.greatest(n, m) <= 100 * F.least(n, m)
    bound = F.least(n - F.coalesce(alone, F.lit(0)), m - F.coalesce(other_alone, F.lit(0)))
    return sizes & ((whole + other_whole < 2) | _reaches(bound, n, m, percent))


def _first_pairs(candidates: DataFrame, alone: DataFrame, percent: int) -> DataFrame:
    """Pairs of short lists, pairs with the first class of long ones, and first classes of split ones."""
    heads = candidates.filter("kind = 2").groupBy("sig").agg(
        F.min(F.struct("a", "na", "wa")).alias("head"), F.collect_set(F.struct("a", "na", "wa")).alias("heads")
    )  # as many as there are parts of a list at most
    heads = heads.select("head", F.explode("heads").alias("other")).select(
        "head.a", "head.na", "head.wa",
        F.col("other.a").alias("b"), F.col("other.na").alias("nb"), F.col("other.wa").alias("wb"),
    )
    pairs = candidates.filter("kind = 0").select(*heads.columns).union(heads.filter("a <> b"))
    pairs = pairs.distinct().join(alone.toDF("a", "alone_a"), "a", "left").join(alone.toDF("b", "alone_b"), "b", "left")
    c = F.col
    possible = _can_reach(c("na"), c("wa"), c("alone_a"), c("nb"), c("wb"), c("alone_b"), percent)
    return pairs.filter(possible).select("a", "b")


def _open_members(candidates: DataFrame, alone: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Members of long lists whose classes lie in different components so far, with these as ``root``."""
    members = candidates.filter("kind = 1").select(
        "sig", F.col("a").alias("cls"), F.col("na").alias("n"), F.col("wa").alias("whole"), F.col("nb").alias("of_pairs")
    )
    known = members.join(alone, "cls", "left").filter(
        # All sets of a list of frequent pairs are indexed whole: this one alone may have too little to share.
        (F.col("of_pairs") == 0) | (100 * (F.col("n") - F.coalesce("alone", F.lit(0))) >= percent * F.col("n"))
    )
    labelled = known.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select(
        "sig", "of_pairs", "cls", "n", "whole", "alone", F.coalesce("root", "cls").alias("root")
    )
    mixed = labelled.groupBy("sig").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("cls").alias("head")
    )
    mixed = mixed.filter("lo <> hi").select("sig", "head")
    return materialise(labelled.join(mixed, "sig"), "jaccard-open-members")


def _open_pairs(still_open: DataFrame, tested: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components from lists of rare tokens that have not been tested and can be linked.

    Rare tokens that two untested classes have in common are all in open lists, as far as both index them. The set
    whose index ends first has no other of its indexed tokens in common with the other set, so its open lists must
    make up for what ``needed_overlap`` lacks to the overlap of the pair. It looks for partners in its short lists
    first, and in each only for those that it and the lists still to come can suffice for. Which of two indexes ends
    first isn't known here, so both look; a set that is indexed whole only looks for others of its kind.
    """
    members = still_open.filter("of_pairs = 0").select("sig", "cls", "n", "whole", "alone", "root")
    others = members.toDF("sig", "b", "nb", "whole_b", "alone_b", "root_b")
    c = F.col
    lengths = members.groupBy("sig").agg(F.count("*").alias("length"))
    left = F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("length"), "sig"))
    looking = members.filter("whole = 0").join(lengths, "sig").withColumn("left", left)
    most = F.ceil(percent * c("n") / 100) - 1 + c("left")
    sizes = percent * F.greatest("n", "nb") <= 100 * F.least("n", "nb")
    found = looking.join(others, "sig").filter((c("root") != c("root_b")) & sizes & _reaches(most, c("n"), c("nb"), percent))
    possible = _can_reach(c("n"), c("whole"), c("alone"), c("nb"), c("whole_b"), c("alone_b"), percent)
    whole = members.filter("whole = 1").join(others.filter("whole_b = 1"), "sig")
    whole = whole.filter((c("cls") < c("b")) & (c("root") != c("root_b")) & possible)
    met = found.select("cls", "b").union(whole.select("cls", "b"))
    pairs = met.select(F.least("cls", "b").alias("a"), F.greatest("cls", "b").alias("b")).distinct()
    return pairs.join(tested, ["a", "b"], "left_anti")


def _links_of_clusters(verifier: _Verifier, still_open: DataFrame) -> list[DataFrame]:
    """Links between different components among classes that lists of frequent pairs bring together.

    Such lists overlap strongly, so classes are not paired list by list. Lists that share a class form a
    cluster; a cluster is dealt into blocks of bounded size, and every two blocks are compared with their
    whole sets in one task, which returns only links that join components.
    """
    frequent = still_open.filter("of_pairs = 1")
    if frequent.isEmpty():
        return []
    clusters = components(frequent.filter("cls <> head"), "cls", "head").withColumnRenamed("root", "cluster")
    clusters = materialise(clusters, "jaccard-clusters")
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.count("*") / CLUSTER_BLOCK).cast("int").alias("blocks"))
    of_root = frequent.groupBy("cls").agg(F.max("root").alias("root"))
    members = clusters.join(sizes, "cluster").join(of_root, F.col("node") == F.col("cls"))
    sets = verifier.sets(of_root.select("cls"))
    own = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    dealt = members.join(sets, "cls").select(
        "cluster", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "cls", "root", "tokens"
    )
    pairs = dealt.select(
        "cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cls", "root", "tokens"
    )
    together = pairs.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "own", "cls")
    found = together.mapInArrow(giving_back(_block_comparer(verifier.percent)), "a long, b long")
    return [materialise(found, "jaccard-cluster-links")]


def _block_comparer(percent: int) -> Callable:
    """Rows come sorted by (cluster, i, j, own); a group is two blocks, or one with itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            for row in zip(*[batch.column(k).to_pylist() for k in range(6)], batch.column(6)):
                if row[:3] != key:
                    yield from _compare(rows, percent)
                    key, rows = row[:3], []
                rows.append((row[3], row[4], row[5], row[6].values.to_numpy()))
        yield from _compare(rows, percent)

    return run


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many tokens every set of ``a`` has in common with every set of ``b``."""
    shared = np.intersect1d(np.concatenate(a), np.concatenate(b))
    found = np.zeros((len(a), len(b)), dtype=np.float32)
    for at in range(0, len(shared), 4096):
        part = shared[at : at + 4096]
        sides = []
        for sets in (a, b):
            side = np.zeros((len(sets), len(part)), dtype=np.float32)
            for i, tokens in enumerate(sets):
                place = np.minimum(np.searchsorted(part, tokens), len(part) - 1)
                side[i, place[part[place] == tokens]] = 1
            sides.append(side)
        found += sides[0] @ sides[1].T
    return found


def _compare(rows: list[tuple], percent: int) -> Iterator[pa.RecordBatch]:
    first = [r for r in rows if r[0] == rows[0][0]]
    second = first if len(first) == len(rows) else rows[len(first) :]
    if len({r[2] for r in rows}) < 2:
        return
    common = overlaps([r[3] for r in first], [r[3] for r in second])
    sizes = np.array([len(r[3]) for r in first])[:, None] + np.array([len(r[3]) for r in second])[None, :]
    apart = np.array([r[2] for r in first])[:, None] != np.array([r[2] for r in second])[None, :]
    links = np.argwhere(apart & ((100 + percent) * common >= percent * sizes))
    parent = {r[2]: r[2] for r in rows}

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found = []
    for i, j in links.tolist():
        x, y = top(first[i][2]), top(second[j][2])
        if x != y:
            parent[x] = y
            found.append((min(first[i][1], second[j][1]), max(first[i][1], second[j][1])))
    if found:
        a, b = zip(*found)
        yield pa.record_batch([pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64())], names=["a", "b"])


def keep_one_of_each_group(docs: DataFrame, stored: bool = False, **options) -> DataFrame:
    """The rows of ``docs`` whose document is the first, by id, of its component; all their columns.

    Rows of a component that repeat its first id are one document and stay together. Of a component without
    any id one row stays. ``stored`` is that of ``with_row_numbers``. Options are those of ``jaccard_groups``.
    """
    rows = with_row_numbers(docs, stored)
    ids = rows.select(ROW, F.col(options.get("doc_id", "doc_id")).cast("long").alias("id"))

    def first_rows() -> DataFrame:
        groups = jaccard_groups(rows, **(options | {"doc_id": ROW})).select(F.col("doc_id").alias(ROW), "component_id")
        members = materialise(groups.join(ids, ROW), "group-members")
        first = members.groupBy("component_id").agg(F.min("id").alias("id"))
        named = members.join(first.filter("id is not null"), ["component_id", "id"], "left_semi").select(ROW)
        return named.union(first.filter("id is null").select(F.col("component_id").alias(ROW)))

    return take(rows, settle(docs.sparkSession, "first-rows", first_rows)).select(*docs.columns)
