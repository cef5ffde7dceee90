"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page is a stream of tags and text. The wrapper of a host is such a stream with quantifiers: a group may be
optional, repeated, or both, and text stands in slots. It is found by aligning page after page with it:
equal siblings in a row, or in rows of up to four, become one repeated group whose inside is aligned; siblings
that only one side has become optional; differing text becomes a slot. Pages are aligned where they are read,
and the wrappers of one host from all parts are aligned with each other in the same way.

Each place carries the hashes of the contents that all pages with this place share there. Where several pages
that differ share one, it is the template's text; all else is a slot. The wrapper tells where the host's pages
keep their main text: in ``article`` or ``main``, whole, or else in the innermost element that holds nearly all text
of slots, without the template's. Pages are matched by label path and content, so optional and repeated places
are found wherever a page has them.
"""

from __future__ import annotations

import hashlib
import html as html_entities
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialise
from corpusloom.session import broadcast_if_small

# Fixed values of HTML: elements without content, with raw content, and those that begin a new block.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe template svg audio video canvas select".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
#: An element of the first kind ends open ones of the second, up to those of the third.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"datalist"}),
}
_PARAGRAPH_ENDERS = BLOCKS - {"html", "body", "caption", "tbody", "thead", "tfoot", "tr", "td", "th", "legend", "option"}
_PARAGRAPH_KEEPERS = {"td", "th", "table", "caption", "body", "article", "main", "section", "div"}

#: Elements that never belong to the main text, and words of class, id or role that say so.
DROPPED = set("nav header footer aside form button dialog head menu".split())
DROPPED_WORDS = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar "
    "navigation sidebar side footer header masthead comment comments respond replies disqus cookie cookies consent "
    "notice notices alert popup modal overlay share sharing social related recommended breadcrumb breadcrumbs "
    "newsletter subscribe subscription signup login widget pagination pager toolbar complementary contentinfo "
    "search".split()
)
_EXEMPT = {"html", "body", "main"}
#: Deeper elements count as children of the one at this depth.
DEEPEST = 150
#: Siblings in one repeated group, and the share of text that makes an element worth entering.
PERIOD = 4
HOLDS = 0.85
#: Share of text from which an element stays whatever its class, id or role says.
MOST = 2 / 3
#: Pairs of siblings that are compared to align two rows; longer rows keep one group for each label.
LONGEST_ALIGNMENT = 250_000

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Attributes without any of these need not be taken apart.
_TELLING = re.compile("class|id|role|hidden|style", re.IGNORECASE)
_UNSEEN = re.compile(r"display\s*:\s*none", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+")


def label_of(tag: str, attributes: str) -> str:
    """The tag, with ``!`` before it if the element is not part of the main text, ``?`` if only words say so.

    A word of class, id or role counts if all its parts are in ``DROPPED_WORDS``: ``cookie-notice`` does,
    ``has-sidebar`` doesn't.
    """
    if tag in DROPPED or tag in RAW:
        return "!" + tag
    if attributes and tag not in _EXEMPT and _TELLING.search(attributes):
        given: dict[str, str] = {}
        for m in _ATTRIBUTE.finditer(attributes):
            given.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        if "hidden" in given or given.get("aria-hidden", "").lower() == "true" or _UNSEEN.search(given.get("style", "")):
            return "!" + tag
        marks = {w for name in ("class", "id", "role") for w in given.get(name, "").lower().split()}
        if any((parts := _WORDS.findall(w)) and DROPPED_WORDS.issuperset(parts) for w in marks):
            return "?" + tag
        if tag != "article" and given.get("role", "").lower() == "main":
            return "main"
    return tag


def events(html: str) -> list[tuple[str, str]]:
    """``(open, label)``, ``(close, label)``, ``(text, text)`` and ``(space, "")``, balanced, entities decoded.

    An element that only words would drop stays if it holds most of the text of the page's articles (or of the
    page, if no article or main element is outside such elements), or if it holds its only ones.
    """
    found = list(_marked_events(html))
    if not any(kind == "open" and value.startswith("?") for kind, value in found):
        return found
    path: list[tuple[str, int, int, int, bool, bool]] = []
    held: dict[int, tuple[int, bool, bool]] = {}  # opening -> characters, holds an article, is in one
    dropped = marked = scopes = chars = scoped = articles = 0
    for at, (kind, value) in enumerate(found):
        if kind == "open":
            path.append((value, at, chars, articles, scopes > 0, opens := value in ("article", "main") and not dropped and not marked))
            articles += value in ("article", "main") and not dropped
            scopes += opens
            dropped += value.startswith("!")
            marked += value.startswith("?")
        elif kind == "close" and value != "hr":
            label, opening, before, seen, inside, opens = path.pop()
            if label.startswith("?"):
                marked -= 1
                held[opening] = (chars - before, articles > seen, inside)
            dropped -= label.startswith("!")
            scopes -= opens
        elif kind == "text" and not dropped:
            chars += len(value.strip())
            scoped += len(value.strip()) if scopes else 0
    alone = not scoped
    whole = chars if alone else scoped
    out, names = [], []
    for at, (kind, value) in enumerate(found):
        if kind == "open":
            if value.startswith("?"):
                size, holds, inside = held[at]
                stays = (alone or inside) and size >= MOST * whole > 0 or alone and holds
                value = value[1:] if stays else "!" + value[1:]
            names.append(value)
        elif kind == "close" and value != "hr":
            value = names.pop()
        out.append((kind, value))
    return out


def _marked_events(html: str) -> Iterator[tuple[str, str]]:
    stack: list[tuple[str, str]] = []
    # Nothing after the last > is a tag, so the search for the end of one never runs further; a comment or
    # declaration that begins there goes on to the end.
    last = html.rfind(">") + 1
    at, end = 0, min((x for x in (html.find("<!", last), html.find("<?", last)) if x >= 0), default=len(html))
    while at < end:
        found = _TAG.search(html, at, last) if at < last else None
        text = html[at : found.start() if found else end]
        if text:
            yield "text", html_entities.unescape(text)
        if not found:
            break
        at = found.end()
        if found[2]:
            closing, tag, attributes = found[1], found[2].lower(), found[3]
        elif found[5]:
            closing, tag, attributes = found[4], found[5].lower(), found[6]
        else:
            if found[0].startswith("<![CDATA["):
                yield "text", found[0][9:].removesuffix("]]>")
            continue
        if closing:
            if any(t == tag for t, _ in stack):
                while stack:
                    popped, label = stack.pop()
                    yield "close", label
                    if popped == tag:
                        break
            continue
        if tag in VOID:
            if tag in ("br", "hr", "wbr"):
                yield ("close", "hr") if tag == "hr" else ("space", "")
            continue
        if tag in RAW:
            ending = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(html, at)
            if not attributes.endswith("/"):
                at = ending.end() if ending else end
            continue
        yield from _implied_ends(tag, stack)
        label = label_of(tag, attributes)
        stack.append((tag, label))
        yield "open", label
    while stack:
        yield "close", stack.pop()[1]


def _implied_ends(tag: str, stack: list[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    ended, stops = _ENDS.get(tag, (set(), set()))
    if tag in _PARAGRAPH_ENDERS:
        yield from _pop_to({"p"}, _PARAGRAPH_KEEPERS, stack)
    if ended:
        yield from _pop_to(ended, stops, stack)


def _pop_to(ended: set[str], stops: set[str], stack: list[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    last = None
    for k in range(len(stack) - 1, -1, -1):
        if stack[k][0] in stops:
            break
        if stack[k][0] in ended:
            last = k
    while last is not None and len(stack) > last:
        yield "close", stack.pop()[1]


@dataclass
class Group:
    """An element of a wrapper: may it be missing, may it be repeated, how much text it took, which contents
    all pages with it share, the least hash of these pages, and whether they differ."""

    label: str
    optional: bool = False
    repeated: bool = False
    chars: int = 0
    inside: list[Group] = field(default_factory=list)
    shared: set[str] = field(default_factory=set)
    page: str = ""
    several: bool = False

    def plain(self) -> list:
        own = [self.label, int(self.optional), int(self.repeated), self.chars, [g.plain() for g in self.inside]]
        return [*own, sorted(self.shared), self.page, int(self.several)]

    def template(self) -> set[str]:
        return self.shared if self.several else set()

    @staticmethod
    def of(plain: list) -> Group:
        inside = [Group.of(x) for x in plain[4]]
        return Group(plain[0], bool(plain[1]), bool(plain[2]), plain[3], inside, set(plain[5]), plain[6], bool(plain[7]))


def contents(found: list[tuple[str, str]]) -> dict[int, str]:
    """A hash of labels and text for every opening of ``found``, and for the page at -1; empty without text.

    Elements that are dropped don't count for those around them.
    """
    hashes: dict[int, str] = {}
    path: list[tuple[int, list[str]]] = [(-1, [""])]

    def close() -> str:
        at, items = path.pop()
        hashes[at] = hashlib.blake2b("\0".join(items).encode("utf-8", "replace"), digest_size=8).hexdigest() if len(items) > 1 else ""
        return hashes[at]

    for at, (kind, value) in enumerate(found):
        if kind == "open":
            path.append((at, [value]))
        elif kind == "close" and value != "hr":
            own = close()
            if own and not value.startswith("!"):
                path[-1][1].append(own)
        elif kind == "text" and (text := " ".join(value.split())):
            path[-1][1].append("#" + text)
    close()
    return hashes


def page_stream(html: str) -> Group:
    """The wrapper of one page alone."""
    found = events(html)
    hashes = contents(found)
    root = Group("", page=hashes[-1])
    path, deeper = [root], 0
    for at, (kind, value) in enumerate(found):
        if kind == "open":
            if len(path) > DEEPEST:
                deeper += 1
            else:
                path[-1].inside.append(Group(value, shared={hashes[at]} - {""}, page=hashes[-1]))
                path.append(path[-1].inside[-1])
        elif kind == "close" and value != "hr":
            if deeper:
                deeper -= 1
            else:
                folded = path.pop()
                folded.inside = fold(folded.inside)
        elif kind == "text":
            path[-1].chars += len(value.strip())
    root.inside = fold(root.inside)
    return root


def fold(siblings: list[Group]) -> list[Group]:
    """Rows of up to ``PERIOD`` siblings that come again at once become repeated groups."""
    for period in range(1, PERIOD + 1):
        out: list[Group] = []
        for group in siblings:
            out.append(group)
            if len(out) >= 2 * period:
                first, second = out[-2 * period : -period], out[-period:]
                if [g.label for g in first] == [g.label for g in second]:
                    out[-2 * period :] = [align(a, b, repeated=True, same_page=True) for a, b in zip(first, second)]
        siblings = out
    return siblings


def align(a: Group, b: Group, repeated: bool = False, same_page: bool = False) -> Group:
    """One group for two of a label: siblings that are found in either, in an order that both keep.

    Groups of the same pages have the contents of both, those of different pages what both share.
    """
    return Group(
        a.label,
        a.optional or b.optional,
        a.repeated or b.repeated or repeated,
        a.chars + b.chars,
        fold(_align_siblings(a.inside, b.inside, same_page)),
        a.shared | b.shared if same_page or a.page == b.page and not (a.several or b.several) else a.shared & b.shared,
        min(a.page, b.page),
        a.several or b.several or a.page != b.page,
    )


def _align_siblings(a: list[Group], b: list[Group], same_page: bool) -> list[Group]:
    if [g.label for g in a] == [g.label for g in b]:
        return [align(x, y, same_page=same_page) for x, y in zip(a, b)]
    if len(a) * len(b) > LONGEST_ALIGNMENT:
        return _loosened(a + b)
    longest = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            if a[i].label == b[j].label:
                longest[i][j] = longest[i + 1][j + 1] + 1
            else:
                longest[i][j] = max(longest[i + 1][j], longest[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i].label == b[j].label:
            out.append(align(a[i], b[j], same_page=same_page))
            i, j = i + 1, j + 1
        else:
            take_a = j >= len(b) or (i < len(a) and longest[i + 1][j] >= longest[i][j + 1])
            group = a[i] if take_a else b[j]
            group.optional = True
            out.append(group)
            i, j = (i + 1, j) if take_a else (i, j + 1)
    return out


def _loosened(groups: list[Group]) -> list[Group]:
    """One optional repeated group for each label: what is left of long rows without any period."""
    found: dict[str, Group] = {}
    for group in groups:
        found[group.label] = align(found[group.label], group, repeated=True, same_page=True) if group.label in found else group
        found[group.label].optional = True
    return list(found.values())


def expression(group: Group) -> str:
    """The wrapper as a regular expression, for people to read."""
    inside = ("#" if group.chars else "") + "".join(expression(g) for g in group.inside)
    own = f"<{group.label}>{inside}</{group.label}>" if group.label else inside
    mark = {(False, False): "", (True, False): "?", (False, True): "+", (True, True): "*"}[group.optional, group.repeated]
    return f"({own}){mark}" if mark else own


def _text_within(group: Group) -> int:
    return 0 if group.label.startswith("!") else group.chars + sum(map(_text_within, group.inside))


def _slots_within(group: Group) -> int:
    """Characters outside of elements that are the same on all pages."""
    if group.label.startswith("!") or (group.template() and not group.repeated):
        return 0
    return group.chars + sum(map(_slots_within, group.inside))


def template_texts(wrapper: Group, paths: list[list[str]]) -> list[list]:
    """``[label path, contents]`` of places that are the same on all pages: what the main text leaves out.

    Articles and main elements are the main text whole, whatever pages share in them.
    """
    if any(path and path[-1] in ("article", "main") for path in paths):
        return []
    found: dict[tuple[str, ...], set[str]] = {}
    todo = [(g, (g.label,)) for g in wrapper.inside]
    while todo:
        group, path = todo.pop()
        if group.label.startswith("!"):
            continue
        if group.template():
            found.setdefault(path, set()).update(group.template())
            if not group.repeated:
                continue
        todo += [(g, (*path, g.label)) for g in group.inside]
    return [[list(path), sorted(texts)] for path, texts in sorted(found.items())]


def main_paths(wrapper: Group) -> list[list[str]]:
    """The label paths of the elements that hold the main text."""
    for wanted in ("article", "main"):
        found: list[list[str]] = []
        todo = [(g, [g.label]) for g in wrapper.inside]
        while todo:
            group, path = todo.pop()
            if group.label.startswith("!"):
                continue
            if group.label == wanted:
                if _text_within(group) and path not in found:
                    found.append(path)
                continue
            todo += [(g, [*path, g.label]) for g in group.inside]
        if found:
            return sorted(found)
    path, here = [], wrapper
    held = _slots_within if _slots_within(wrapper) else _text_within
    while True:
        whole = held(here)
        inner = [g for g in here.inside if g.label in BLOCKS - {"p"} and whole and held(g) >= HOLDS * whole]
        if len(inner) != 1:
            return [path]
        here = inner[0]
        path = [*path, here.label]


def main_text(html: str, paths: list[list[str]], template: list[list] = ()) -> tuple[str, bool]:
    """The blocks of the elements at ``paths`` less ``template``, and whether the page has any such element.

    A page that has no text but the template's keeps that.
    """
    found = events(html)
    text, met = _text_of(found, {tuple(p) for p in paths}, {tuple(p): set(x) for p, x in template})
    if template and met and not text:
        text, met = _text_of(found, {tuple(p) for p in paths}, {})
    return text, met


def _text_of(found: list[tuple[str, str]], wanted: set[tuple], template: dict[tuple, set[str]]) -> tuple[str, bool]:
    hashes = contents(found) if template else {}
    blocks: list[str] = []
    words: list[str] = []
    path: list[str] = []
    left_out: list[bool] = []
    inside, dropped = (1, 0) if () in wanted else (0, 0)
    met = () in wanted

    def flush() -> None:
        block = " ".join("".join(words).split())
        words.clear()
        if block:
            blocks.append(block)

    for at, (kind, value) in enumerate(found):
        if kind == "text":
            if inside and not dropped:
                words.append(value)
        elif kind == "space":
            if inside and not dropped:
                words.append(" ")
        else:
            tag = value.removeprefix("!")
            if tag in BLOCKS and not dropped:
                flush()
            if kind == "open":
                path.append(value)
                left_out.append(
                    value.startswith("!")
                    or bool(template) and len(path) <= DEEPEST and hashes[at] in template.get(tuple(path), ())
                )
                if left_out[-1]:
                    dropped += 1
                elif len(path) <= DEEPEST and tuple(path) in wanted:
                    inside += 1
                    met = True
            elif value != "hr":
                if left_out.pop():
                    dropped -= 1
                elif len(path) <= DEEPEST and tuple(path) in wanted:
                    inside -= 1
                path.pop()
    flush()
    return "\n".join(blocks), met


def _inferrer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        wrappers: dict[str, Group] = {}
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if html:
                page = page_stream(html)
                wrappers[host] = align(wrappers[host], page) if host in wrappers else page
        if wrappers:
            plain = [json.dumps(w.plain()) for w in wrappers.values()]
            yield pa.record_batch([pa.array(list(wrappers)), pa.array(plain)], names=["host", "wrapper"])


def _merger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per host from wrappers sorted by host; holds one wrapper."""
    host, merged = None, None

    def row() -> pa.RecordBatch:
        paths = main_paths(merged)
        columns = [host, expression(merged), json.dumps(paths), json.dumps(template_texts(merged, paths))]
        return pa.record_batch([pa.array([x]) for x in columns], names=["host", "expression", "paths", "template"])

    for batch in batches:
        for own, plain in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            wrapper = Group.of(json.loads(plain))
            if own == host:
                merged = align(merged, wrapper)
                continue
            if merged is not None:
                yield row()
            host, merged = own, wrapper
    if merged is not None:
        yield row()


def infer_wrappers(pages: DataFrame, host: Column, html: Column) -> DataFrame:
    """``(host, expression, paths, template)``: the wrapper of every host, where its main text is, and which
    texts at which places are the same on all pages.

    Every page takes part. Null and empty pages have no say. Partial wrappers are aligned in a given order.
    """
    rows = pages.select(F.coalesce(host, F.lit("")).alias("host"), html.cast("string").alias("html"))
    partial = rows.mapInArrow(_inferrer, "host string, wrapper string")
    ordered = partial.repartition("host").sortWithinPartitions("host", "wrapper")
    return ordered.mapInArrow(_merger, "host string, expression string, paths string, template string")


def _extractor(keep: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], tuple[list, list]] = {}
        for batch in batches:
            texts = []
            for html, *host in zip(*[batch.column(keep + k).to_pylist() for k in range(3)]):
                if not html:
                    texts.append("")
                    continue
                if tuple(host) not in known:
                    paths, template = host
                    known[tuple(host)] = (json.loads(paths) if paths else [[]], json.loads(template) if template else [])
                text, met = main_text(html, *known[tuple(host)])
                if not met:  # a page unlike the others of its host speaks for itself
                    text, _ = main_text(html, main_paths(page_stream(html)))
                texts.append(text)
            columns = [*batch.columns[:keep], pa.array(texts, type=pa.string())]
            columns.append(pa.array([len(t) for t in texts], type=pa.int64()))
            yield pa.record_batch(columns, names=[*batch.schema.names[:keep], "text", "n_chars"])

    return run


def extract_main_text(pages: DataFrame, host: Column, html: Column, keep: dict[str, Column]) -> DataFrame:
    """``keep`` columns of every row of ``pages`` with ``text`` and ``n_chars``.

    ``text`` is the main text, a block a line: without elements that are dropped by name or by a word of
    their class, id or role, white space inside a block turned into one space. Null, empty and text-free
    pages give an empty text. Outside of articles and main elements, what all pages of a host share at a place
    is left out if there are several that differ. Pages of one host share a wrapper; a null host is a host of its own. Broken
    mark-up is balanced, elements deeper than ``DEEPEST`` are treated as if they were not nested further.
    Repeated rows are extracted each. Other columns are not looked at. An empty table gives an empty one.
    """
    wrappers = materialise(infer_wrappers(pages, host, html).select("host", "paths", "template"), "wrappers")
    names = list(keep)
    rows = pages.select(
        *[c.alias(n) for n, c in keep.items()],
        html.cast("string").alias("__html"),
        F.coalesce(host, F.lit("")).alias("__host"),
    )
    found = broadcast_if_small(wrappers.withColumnsRenamed({"host": "__host", "paths": "__paths", "template": "__template"}))
    joined = rows.join(found, "__host", "left").select(*names, "__html", "__paths", "__template")
    schema = joined.select(*names).schema.add("text", "string").add("n_chars", "long")
    return joined.mapInArrow(_extractor(len(names)), schema)
