"""Plain versions of what the operators compute, for small tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from math import log, log10

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, cls string, score double"


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text: str | None) -> list[str]:
    return WORD.findall(lower(text or ""))


def shingles(text: str | None, size: int = 5) -> set[tuple[str, ...]]:
    own = words(text)
    if not own:
        return set()
    return {tuple(own[i : i + size]) for i in range(max(1, len(own) - size + 1))}


def groups(docs: list[tuple[int, str | None]], percent: int = 80) -> list[tuple[int, int, int]]:
    """(doc_id, n_shingles, component_id) of every row, by comparing all pairs."""
    sets = [shingles(text) for _, text in docs]
    top = list(range(len(docs)))

    def find(i: int) -> int:
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * len(a | sets[j]):
                top[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [
        (doc_id, len(sets[i]), least.get(find(i)) if sets[i] else doc_id) for i, (doc_id, _) in enumerate(docs)
    ]


def leaks(docs, items, percent: int = 80) -> set[tuple[int, int]]:
    """(doc_id, item_id) where a window as long as the item has the similarity, by trying every window."""
    found = set()
    for doc_id, text in docs:
        own = words(text)
        for item_id, passage in items:
            wanted = words(passage)
            if not own or not wanted:
                continue
            target = Counter(tuple(wanted[i : i + 5]) for i in range(max(1, len(wanted) - 4)))
            size = min(len(wanted), len(own))
            for at in range(len(own) - size + 1):
                window = own[at : at + size]
                here = Counter(tuple(window[i : i + 5]) for i in range(max(1, size - 4)))
                both = sum((here & target).values())
                if 100 * both >= percent * (here.total() + target.total() - both):
                    found.add((doc_id, item_id))
                    break
    return found


def rows_with_edges(texts: list[str | None]) -> list[tuple]:
    """Documents of the texts, with columns of other meaning whose names operators use inside."""
    return [(i, t, "en", f"src{i % 3}", len(t or ""), 7, "x", 0.5) for i, t in enumerate(texts)]


class SuffixTree:
    """The probabilistic suffix tree over tuples of words; ``None`` ends a text."""

    def __init__(self, texts, depth, least, gain, prior):
        self.depth, self.least, self.prior = depth, least, prior
        self.counts = Counter()
        for text in texts:
            tokens = (*words(text), None)
            for size in range(1, depth + 2):
                self.counts.update(tokens[i : i + size] for i in range(len(tokens) - size + 1))
        single = {run[0]: n for run, n in self.counts.items() if len(run) == 1}
        self.single, self.total = single, sum(single.values())
        self.kept = {}
        for size in range(2, depth + 2):
            following = defaultdict(list)
            for run, n in self.counts.items():
                if len(run) == size and n >= least:
                    following[run[:-1]].append((run[-1], n))
            found = {}
            for context, stored in following.items():
                occurs = self.counts[context]
                rest = occurs - sum(n for _, n in stored)
                gained = 0.0
                for token, n in stored:
                    below = self.p(context[1:], token)
                    gained += n * (log(self.mixed(n, rest, occurs, below)) - log(below))
                if gained + rest * log((rest + prior) / (occurs + prior)) >= gain * len(stored):
                    found[context] = (rest, occurs)
            self.kept |= found

    def mixed(self, n, rest, occurs, below):
        return (n + (rest + self.prior) * below) / (occurs + self.prior)

    def p(self, context, token):
        """The probability of ``token`` after ``context``, of which the last words count."""
        context = tuple(context)[max(0, len(context) - self.depth) :]
        if not context:
            return (self.single.get(token, 0) + 0.5) / (self.total + 0.5 * (len(self.single) + 1))
        below = self.p(context[1:], token)
        if context not in self.kept:
            return below
        n = self.counts[(*context, token)]
        return self.mixed(n if n >= self.least else 0, *self.kept[context], below)

    def score(self, text):
        tokens = (*words(text), None)
        return sum(log10(self.p(tokens[:i], token)) for i, token in enumerate(tokens))
