"""Path and CSS rules on HTML, which built-in functions cannot express on ordinary markup.

Rules for one element that can't nest, with at most one attribute test, are followed by built-in functions.
For the others one Arrow batch call evaluates all rules of a page on a single parse. The supported subset is
declared here; a rule outside it is refused by ``check_rule`` when templates are validated.

* XPath: ``//tag``, ``/tag``, ``*``, ``[n]``, ``[@a]``, ``[@a='v']``, ``[contains(@a,'v')]``, ending
  in ``@attr``, ``text()``, ``allText()``, ``tidyText()`` or nothing (markup of the element).
* CSS, written ``css:<selector>|<output>``: ``tag``, ``#id``, ``.class``, ``[a]``, ``[a=v]``,
  ``:eq(n)``, descendant and ``>``; the output is an attribute name, ``text``, ``allText`` or empty.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import markup, values

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSED_BY_BLOCK = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main "
    "nav ol p pre section table ul".split()
)
_CLOSED_BY_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
                   "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class Node:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def elements(self):
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self):
        stack = self.elements()[::-1]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(node.elements()[::-1])

    def own_text(self):
        return "".join(c for c in self.children if isinstance(c, str))

    def pieces(self, breaks=""):
        """Text pieces in document order; ``breaks`` goes before block elements and line breaks."""
        stack = [self]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                yield item
            elif item.tag not in ("script", "style"):
                if breaks and item is not self and (item.tag == "br" or item.tag in _CLOSED_BY_BLOCK):
                    yield breaks
                stack.extend(item.children[::-1])

    def all_text(self):
        return " ".join("".join(self.pieces(breaks=" ")).split())

    def tidy_text(self):
        lines = "".join(self.pieces(breaks="\n")).split("\n")
        return "\n".join(line for line in (" ".join(raw.split()) for raw in lines) if line)

    def markup(self):
        """The element written out; without recursion, as pages may be nested to any depth."""
        out, todo = [], [self]
        while todo:
            item = todo.pop()
            if isinstance(item, Node):
                attrs = "".join(f' {k}="{escape(v)}"' for k, v in item.attrs.items())
                out.append(f"<{item.tag}{attrs}>")
                if item.tag not in _VOID:
                    todo.append((f"</{item.tag}>",))
                    todo.extend(item.children[::-1])
            else:
                out.append(item[0] if isinstance(item, tuple) else escape(item, quote=False))
        return "".join(out)


class _TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def _close(self, tags, stop=()):
        node = self.at
        while node.parent is not None and node.tag not in stop:
            if node.tag in tags:
                self.at = node.parent
                return
            node = node.parent

    def handle_starttag(self, tag, attrs):
        if tag in _CLOSED_BY_BLOCK:
            self._close({"p"}, stop=("td", "th", "li", "table"))
        if tag in _CLOSED_BY_SAME:
            self._close(_CLOSED_BY_SAME[tag], stop=("ul", "ol", "dl", "table", "select"))
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        self._close({tag})

    def handle_data(self, data):
        self.at.children.append(data)


def parse_html(html: str) -> Node:
    builder = _TreeBuilder()
    builder.feed(html)
    builder.close()
    return builder.root


_XPATH_STEP = re.compile(r"(//?)(\*|[\w-]+)((?:\[[^\]]*\])*)(?=/|$)")
_XPATH_OUTPUT = re.compile(r"//?(@[\w:-]+|text\(\)|allText\(\)|tidyText\(\)|html\(\)|outerHtml\(\))$")
_XPATH_TEST = re.compile(
    r"""\[\s*(?:(?P<nth>\d+)|@(?P<name>[\w:-]+)(?:\s*=\s*(?P<q>["'])(?P<value>.*?)(?P=q))?"""
    r"""|contains\(\s*@(?P<cname>[\w:-]+)\s*,\s*(?P<cq>["'])(?P<cvalue>.*?)(?P=cq)\s*\))\s*\]"""
)
_CSS_STEP = re.compile(r"(\s*>\s*|\s+|^)((?:[\w*-]+)?(?:\#[\w-]+|\.[\w-]+|\[[\w:-]+(?:=[^\]]*)?\]|:eq\(\d+\))*)")
_CSS_TEST = re.compile(r"\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[(?P<name>[\w:-]+)(?:=(?P<value>[^\]]*))?\]|:eq\((?P<nth>\d+)\)")


def _steps(pattern: re.Pattern, text: str, rule: str):
    at, found = 0, []
    while at < len(text):
        match = pattern.match(text, at)
        if not match or match.end() == at:
            raise ValueError(f"unsupported path rule: {rule!r}")
        found.append(match)
        at = match.end()
    if not found:
        raise ValueError(f"unsupported path rule: {rule!r}")
    return found


@lru_cache(maxsize=4096)
def compile_rule(rule: str):
    """``(steps, output)``; a step is ``(deep, tag, tests, nth)`` with ``nth`` per parent or overall."""
    text = rule.strip()
    steps = []
    if text.startswith("css:"):
        selector, _, output = text[4:].partition("|")
        for match in _steps(_CSS_STEP, selector.strip(), rule):
            tag = re.match(r"[\w*-]*", match.group(2)).group() or "*"
            tests, nth = [], None
            for test in _CSS_TEST.finditer(match.group(2)):
                if test["nth"] is not None:
                    nth = ("overall", int(test["nth"]))
                elif test["id"]:
                    tests.append(("equals", "id", test["id"]))
                elif test["cls"]:
                    tests.append(("word", "class", test["cls"]))
                elif test["value"] is not None:
                    tests.append(("equals", test["name"], test["value"].strip("\"'")))
                else:
                    tests.append(("has", test["name"], None))
            steps.append((">" not in match.group(1), tag.lower(), tests, nth))
        output = output.strip() or "html()"
        return steps, output + "()" if output in ("text", "allText") else output if output == "html()" else "@" + output
    output = "html()"
    tail = _XPATH_OUTPUT.search(text)
    if tail:
        output, text = tail.group(1), text[: tail.start()]
    for match in _steps(_XPATH_STEP, text, rule):
        tests, nth = [], None
        rest = match.group(3)
        for test in _XPATH_TEST.finditer(rest):
            if test["nth"]:
                nth = ("per parent", int(test["nth"]) - 1)
            elif test["cname"]:
                tests.append(("contains", test["cname"], test["cvalue"]))
            elif test["value"] is not None:
                tests.append(("equals", test["name"], test["value"]))
            else:
                tests.append(("has", test["name"], None))
        if _XPATH_TEST.sub("", rest):
            raise ValueError(f"unsupported path rule: {rule!r}")
        steps.append((match.group(1) == "//", match.group(2).lower(), tests, nth))
    return steps, "html()" if output == "outerHtml()" else output


def check_rule(rule: str | None) -> str | None:
    """The reason why a rule is not supported, or None."""
    if rule is None or not rule.strip():
        return None
    try:
        compile_rule(rule)
    except ValueError as error:
        return str(error)
    return None


def _passes(node: Node, tests) -> bool:
    for kind, name, wanted in tests:
        value = node.attrs.get(name)
        if value is None:
            return False
        if kind == "equals" and value != wanted or kind == "contains" and wanted not in value:
            return False
        if kind == "word" and wanted not in value.split():
            return False
    return True


def select_nodes(root: Node, steps) -> list[Node]:
    current = [root]
    for deep, tag, tests, nth in steps:
        following: dict[int, Node] = {}
        per_parent: dict[int, int] = {}
        for start in current:
            for node in start.walk() if deep else start.elements():
                if id(node) in following or (tag != "*" and node.tag != tag) or not _passes(node, tests):
                    continue
                if nth and nth[0] == "per parent":
                    seen = per_parent[id(node.parent)] = per_parent.get(id(node.parent), -1) + 1
                    if seen != nth[1]:
                        continue
                following[id(node)] = node
        current = list(following.values())
        if nth and nth[0] == "overall":
            current = current[nth[1] : nth[1] + 1]
    return current


def read_node(node: Node, output: str) -> str | None:
    if output.startswith("@"):
        return node.attrs.get(output[1:])
    return {"text()": node.own_text, "allText()": node.all_text, "tidyText()": node.tidy_text, "html()": node.markup}[
        output
    ]()


def evaluate(root: Node, rule: str) -> list[str]:
    steps, output = compile_rule(rule)
    values = (read_node(node, output) for node in select_nodes(root, steps))
    return [v for v in values if v is not None]


# A path rule that built-in functions can follow: one element that can't hold another of its kind, perhaps
# with one attribute test, and an output that needs no tree.
_FLAT = r"""^//(h[1-6]|title|a|button|option)(?:\[@([\w:-]+)=(["'])([^"'\]]*)\3\])?/(text\(\)|allText\(\)|@[\w:-]+)$"""
_OPEN = r"""(?:[^>"']|"[^"]*"|'[^']*')*"""


def is_flat(rule: Column) -> Column:
    return F.trim(rule).rlike(_FLAT)


def flat_rule(rule: Column) -> Column:
    """A flat rule taken apart, once per template: regexes for the element, its tested and its read attribute."""

    def part(n: int) -> Column:
        return F.regexp_extract(F.trim(rule), _FLAT, n)

    def attribute(name: Column) -> Column:
        quoted = F.concat(F.lit(r"\Q"), name, F.lit(r"\E"))
        return F.concat(F.lit(r"(?is)\s"), quoted, F.lit(r"""(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?=[\s/>]))"""))

    opening = F.concat(F.lit("(?is)<"), part(1), F.lit(rf"(?=[\s/>]){_OPEN}>"))
    whole = F.concat(opening, F.lit(r".*?</"), part(1), F.lit(r"\s*>"))
    reads = part(5).startswith("@")
    return F.struct(
        rule.alias("rule"),
        F.when(reads, opening).otherwise(whole).alias("element"),
        F.when(part(2) != "", attribute(part(2))).alias("tested"),
        part(4).alias("wanted"),
        F.when(reads, attribute(F.substring(part(5), 2, 200))).alias("read"),
        (part(5) == "text()").alias("own_text"),
    )


def flat_values(html: Column, flat: Column) -> Column:
    """``map<rule, matches>`` for an array of ``flat_rule``, without Python; elements need their end tags."""

    def value(opening: Column, pattern: Column) -> Column:
        written = F.regexp_replace(F.call_function("regexp_extract", opening, pattern, F.lit(1)), r"""^["']|["']$""", "")
        return F.when(F.call_function("rlike", opening, pattern), markup.unescape(written, "\u00a0"))

    def text(element: Column, own: Column) -> Column:
        inner = F.regexp_extract(element, rf"(?is)^<{_OPEN}>(.*)</[^>]*>$", 1)
        alone = F.regexp_replace(inner, r"(?is)<([a-z][a-z0-9]*)\b[^>]*>.*?</\1\s*>", "")
        broken = F.regexp_replace(inner, rf"(?i)<(?:br|{'|'.join(sorted(_CLOSED_BY_BLOCK))})\b[^>]*>", " ")
        bare = F.regexp_replace(F.when(own, alone).otherwise(broken), r"(?s)</?[a-zA-Z][^>]*>", "")
        plain = markup.unescape(bare, "\u00a0")
        return F.when(own, plain).otherwise(F.trim(F.regexp_replace(plain, r"[\s\u00a0]+", " ")))

    def matches(visible: Column, r: Column) -> Column:
        found = F.call_function("regexp_extract_all", visible, r["element"], F.lit(0))
        passed = F.filter(found, lambda e: r["tested"].isNull() | F.coalesce(value(e, r["tested"]) == r["wanted"], F.lit(False)))
        read = F.transform(passed, lambda e: F.when(r["read"].isNotNull(), value(e, r["read"])).otherwise(text(e, r["own_text"])))
        return F.array_compact(read)

    visible = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "")
    entries = values.let(
        visible, lambda v: F.transform(flat, lambda r: F.struct(r["rule"].alias("key"), matches(v, r).alias("value")))
    )
    return F.map_from_entries(entries)


@F.pandas_udf(T.MapType(T.StringType(), T.ArrayType(T.StringType())))
def _path_values(html: pd.Series, rules: pd.Series) -> pd.Series:
    def one(page, wanted):
        if page is None or wanted is None or len(wanted) == 0:
            return None
        root = parse_html(page)
        return {rule: evaluate(root, rule) for rule in set(wanted) if rule}

    return pd.Series([one(p, r) for p, r in zip(html, rules)], dtype=object)


def path_values(html: Column, rules: Column) -> Column:
    """``map<rule, matches>`` for an array of rules. Pages without rules cross over as nulls."""
    return _path_values(F.when(F.size(rules) > 0, html), rules)


def _items(root: Node, item_rule: str, part_rules) -> list[list[str | None]]:
    steps, _ = compile_rule(item_rule)
    return [[next(iter(evaluate(node, rule)), None) for rule in part_rules] for node in select_nodes(root, steps)]


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _item_values(html: pd.Series, items: pd.Series, parts: pd.Series) -> pd.Series:
    found = [None if page is None else _items(parse_html(page), *rules) for page, *rules in zip(html, items, parts)]
    return pd.Series(found, dtype=object)


_PAGE_VALUES = T.StructType(
    [
        T.StructField("paths", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
        T.StructField("items", T.ArrayType(T.ArrayType(T.StringType()))),
    ]
)


@F.pandas_udf(_PAGE_VALUES)
def _page_values(html: pd.Series, rules: pd.Series, items: pd.Series, parts: pd.Series) -> pd.DataFrame:
    found = []
    for page, wanted, *of_items in zip(html, rules, items, parts):
        root = None if page is None else parse_html(page)
        found.append((None, None) if root is None else ({r: evaluate(root, r) for r in wanted}, _items(root, *of_items)))
    return pd.DataFrame(found, columns=_PAGE_VALUES.names, dtype=object)


def page_values(html: Column, rules: list[str], item_rule: str, part_rules: list[str]) -> Column:
    """``struct<paths, items>``: what ``path_values`` and ``item_values`` give, from one parse of the page."""
    listed = [F.array(*(F.lit(r) for r in some)) for some in (rules, part_rules)]
    # A filter on what was found would otherwise parse the page once more, before pages are dealt out.
    return _page_values.asNondeterministic()(html, listed[0], F.lit(item_rule), listed[1])


def item_values(html: Column, item_rule: str, part_rules: list[str]) -> Column:
    """For each element matched by ``item_rule``, the first match of every part rule inside it."""
    return _item_values(html, F.lit(item_rule), F.array(*(F.lit(r) for r in part_rules)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def unsupported_rules(rules: pd.Series) -> pd.Series:
    """Messages for the rules of an array that ``compile_rule`` does not accept."""
    return pd.Series([[m for m in map(check_rule, r if r is not None else []) if m] for r in rules], dtype=object)
