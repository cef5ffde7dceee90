"""HTML text clean-up and automatic body detection with built-in functions only."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.values import let

# Fixed values of the line-block density method, with blocks of three lines.
BLOCK_THRESHOLD = 86
MIN_LINE_LENGTH = 5

_BLOCK_TAGS = (
    "address|article|aside|blockquote|body|br|center|dd|div|dl|dt|fieldset|footer|form|h[1-6]|head|"
    "header|hr|html|iframe|li|link|main|meta|nav|noscript|ol|option|p|pre|section|select|table|"
    "tbody|td|tfoot|th|thead|title|tr|ul"
)


_REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


def _named_characters(hard_space: str) -> Column:
    """The names of the standard table and the apostrophe, as a map."""
    table = {**name2codepoint, "nbsp": ord(hard_space), "apos": 39}
    return F.create_map(*(F.lit(x) for name, code in sorted(table.items()) for x in (name, chr(code))))


def unescape(text: Column, hard_space: str = " ") -> Column:
    """Character references decoded, by number and by name; what is none stays as it is. A hard space becomes
    ``hard_space``."""

    def decoded(name: Column) -> Column:
        digits = F.substring(name, 2, 8)
        number = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 8), 16, 10)).otherwise(digits)
        code = number.try_cast("int")
        known = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(known, code)), 8, "0")), "UTF-32")
        plain = F.when(code == 160, F.lit(hard_space)).otherwise(char)
        return F.when(name.startswith("#"), plain).otherwise(F.try_element_at(_named_characters(hard_space), name))

    def part(p: Column, i: Column) -> Column:
        name = F.regexp_extract(p, _REFERENCE, 1)
        value = F.when(name != "", decoded(name))
        tail = F.substr(p, F.length(name) + 2)
        return F.when(i == 0, p).otherwise(F.coalesce(F.concat(value, tail), F.concat(F.lit("&"), p)))

    joined = F.array_join(F.transform(F.split(text, "&"), part), "")
    return F.when(text.contains("&"), joined).otherwise(text)


def page_title(html: Column) -> Column:
    """Text of the first ``<title>``; an empty string if there is none."""
    raw = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.trim(F.regexp_replace(unescape(raw), r"\s+", " "))


# What is replaced in extracted markup, in this order. Entries without pattern signs
# are plain text.
CLEAN_STEPS = (
    (r"<script([\s\S]*?)</script>", ""),
    (r"<style([\s\S]*?)</style>", ""),
    ("</p>", "***"),
    ("<BR>", "***"),
    (r"<([\s\S]*?)>", ""),
    (r"\*\*\*", "<br/>"),
    (r"\n", "<br/>"),
    (r"(<br/>\s*){2,}", "<br/> "),
    (r"(&nbsp;\s*)+", " "),
)


def clean_body(raw: Column) -> Column:
    """Turn extracted markup into text with ``<br/>`` marks."""
    for pattern, by in CLEAN_STEPS:
        raw = F.regexp_replace(raw, pattern, by)
    return raw


def visible_lines(html: Column) -> Column:
    """The page as an array of trimmed text lines, one or more per block element."""
    text = F.regexp_replace(html, r"(?is)<!--.*?-->|<!doctype[^>]*>", "")
    text = F.regexp_replace(text, r"(?is)<(script|style)\b.*?</\1\s*>", "")
    text = F.regexp_replace(
        text, r"""(?is)<(\w+)\b[^>]*\bstyle\s*=\s*(["'])[^"'>]*display:none[^"'>]*\2[^>]*>.*?</\1\s*>""", ""
    )
    text = F.regexp_replace(text, r"(?i)(</p\s*>|<br\s*/?>)", r"\*\*\*$1")
    text = F.regexp_replace(text, rf"(?is)</?(?:{_BLOCK_TAGS})\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"(?s)<.*?>", "")
    text = F.regexp_replace(text, r"&[#\w]{2,6};", " ")
    return F.transform(
        F.split(text, "\n"), lambda line: F.trim(F.regexp_replace(line, r"\s+", " "))
    )


def auto_body(html: Column) -> Column:
    """Dense runs of lines.

    The score of a line is the number of non-space characters in it and the two lines after it.
    A run opens at a line that scores over the threshold and closes at the first line whose own
    or next score is zero; its lines of five characters or more are kept. One fold per page, so
    no row leaves its partition.
    """
    start = F.struct(F.lit(False).alias("open"), F.expr("cast(array() as array<string>)").alias("kept"))

    def score(weights: Column) -> Column:
        return F.transform(
            weights,
            lambda w, i: w
            + F.coalesce(F.get(weights, i + F.lit(1)), F.lit(0))
            + F.coalesce(F.get(weights, i + F.lit(2)), F.lit(0)),
        )

    def step(state: Column, s: Column) -> Column:
        inside = state["open"] | (s["score"] > BLOCK_THRESHOLD)
        keep = inside & (F.length(s["line"]) >= MIN_LINE_LENGTH)
        return F.struct(
            (inside & (s["score"] > 0) & (s["next_score"] > 0)).alias("open"),
            F.when(keep, F.concat(state["kept"], F.array(s["line"]))).otherwise(state["kept"]).alias("kept"),
        )

    def dense(lines: Column, scores: Column) -> Column:
        scored = F.transform(
            lines,
            lambda line, i: F.struct(
                line.alias("line"),
                F.get(scores, i).alias("score"),
                F.coalesce(F.get(scores, i + F.lit(1)), F.lit(0)).alias("next_score"),
            ),
        )
        return F.aggregate(scored, start, step, lambda state: F.array_join(state["kept"], "\n"))

    def body(lines: Column) -> Column:
        weights = F.transform(lines, lambda line: F.length(F.replace(line, F.lit(" "), F.lit(""))))
        return let(let(weights, score), lambda scores: dense(lines, scores))

    return let(visible_lines(html), body)
