"""Extraction rules on hand-written pages."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import dates, markup, rules, selectors, urls
from corpusloom.operators import extraction, template_admin
from corpusloom.sources.templates import parse_templates

NOW = datetime(2024, 3, 5, 8)


def one(spark, value):
    return spark.range(1).select(value.alias("v")).first()["v"]


def extract(spark, html, url="http://a.com/x", **template):
    names = {"id": "t", "domain": "a.com", "startURL": ["http://a.com/"], **template}
    fields = spark.createDataFrame([("{}",)], "j string").select(
        *(F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in names.items())
    )
    pages = spark.createDataFrame([(url, html)], "url string, html string")
    return extraction.extract_documents(pages, fields, "r", NOW).first()


PAGE = "<title> A &amp; B </title><h1 id=h>Head</h1><div class='c'>one<p>two</p></div><i>2024-01-02</i>"


def test_path_beats_regex_and_blank_rules_are_absent(spark):
    assert extract(spark, PAGE, titleXPath="//h1/text()", titleReg="<i>(.*?)</i>")["title"] == "Head"
    assert extract(spark, PAGE, titleXPath=" ", titleReg="<i>(.*?)</i>")["title"] == "2024-01-02"
    assert extract(spark, PAGE, titleXPath="", titleReg="")["title"] == "A & B"
    # A rule that finds nothing does not fall back to the next one.
    assert extract(spark, PAGE, titleXPath="//h2/text()", titleReg="<i>(.*?)</i>")["title"] is None


def test_regex_without_group_gives_the_whole_match(spark):
    assert extract(spark, PAGE, titleReg=r"\d{4}")["title"] == "2024"
    grouped = {r"a(b)": r"a(b)", r"[(]x": r"([(]x)", r"\(x\)": r"(\(x\))", r"(?:a)b": r"((?:a)b)", r"(?<n>a)": r"(?<n>a)"}
    for rule, wanted in grouped.items():
        assert one(spark, rules.with_group(F.lit(rule))) == wanted


def test_body_matches_are_joined_and_cleaned_in_order(spark):
    html = "<p>x</p>a***b<BR>c<br>d\n\ne&nbsp; &nbsp;f<script>1</script><style>2</style>"
    assert one(spark, markup.clean_body(F.lit(html))) == "x<br/>a<br/>b<br/>cd<br/> e f"
    assert extract(spark, "<b>1</b><b>2</b>", contentReg="<b>(.*?)</b>")["content"] == "12"


def test_automatic_body_keeps_dense_lines(spark):
    text = "long enough " * 12
    html = (
        f"<html><body><ul><li>a</li></ul>{'<br>' * 0}<div></div><div></div><div></div>"
        f"<div style='x;display:none'>{text}hidden</div><p>{text}</p><p>ab</p><p>second line here</p>"
        "<script>var x = 1;</script><div></div><div></div><div></div><div></div><div>foot</div></body></html>"
    )
    body = one(spark, markup.auto_body(F.lit(html)))
    assert "long enough" in body and "second line here***" in body
    assert "hidden" not in body and "foot" not in body and "var x" not in body


def test_start_pages_and_missing_fields_are_not_collected(spark):
    start = extract(spark, PAGE, url="http://a.com/")
    assert start["is_start_page"] and start["skip_reason"] is None
    assert extract(spark, "<p>", needContent=True, contentReg="zzz")["skip_reason"] == "content"
    assert extract(spark, "<p>", needTitle=True)["skip_reason"] == "title"
    assert extract(spark, "<p>", needPublishTime=True)["skip_reason"] == "publish_time"


def test_date_detection_runs_only_without_format_and_value(spark):
    assert extract(spark, PAGE, autoDetectPublishDate=True)["publishTime"] == datetime(2024, 1, 2)
    # Found by rule, but no format: the value is lost.
    assert extract(spark, PAGE, autoDetectPublishDate=True, publishTimeReg="<i>(.*?)</i>")["publishTime"] is None
    # A format without a value stops the detection.
    assert extract(spark, PAGE, autoDetectPublishDate=True, publishTimeFormat="yyyy")["publishTime"] is None


@pytest.mark.parametrize(
    ("text", "moment"),
    [
        ("x 2024-05-06 07:08:09 y", datetime(2024, 5, 6, 7, 8, 9)),
        ("05月06日 and 2023/01/02", datetime(2023, 1, 2)),
        ("2024-13-01", datetime(2025, 1, 1)),
        ("12-2024-01-02 10:10", datetime(2024, 1, 2, 10, 10)),
        ("02-29", datetime(2024, 3, 1)),
        ("none", None),
    ],
)
def test_detected_dates(spark, text, moment):
    found = dates.parse_detected(dates.detect_date(F.lit(text)), F.lit(2024))
    assert one(spark, found) == moment


@pytest.mark.parametrize(
    ("fmt", "text", "moment"),
    [
        ("yyyy-MM-dd hh:mm", "2024-05-06 13:11 tail", datetime(2024, 5, 6, 13, 11)),
        ("yyyy-MM-dd hh:mm", "2024-05-06 12:11", datetime(2024, 5, 6, 0, 11)),
        ("MMM d, yyyy h:mm a", "Jan 5, 2023 2:05 PM", datetime(2023, 1, 5, 14, 5)),
        ("yyyyMMddHHmm", "202405061314", datetime(2024, 5, 6, 13, 14)),
        ("yyyy'T'M", "2024T13", datetime(2025, 1, 1)),
        (" yyyy年MM月dd日 HH:mm　来源：", " 2016年05月06日 07:08　来源：x", datetime(2016, 5, 6, 7, 8)),
        ("yyyy-mm-dd", "2016-30-05", datetime(2016, 1, 5, 0, 30)),
        ("MM-dd", "12-31", datetime(2024, 12, 31)),
        ("yyyy-MM-dd", "05/06/2024", None),
    ],
)
def test_dates_by_format(spark, fmt, text, moment):
    frame = spark.createDataFrame([(fmt, text)], "fmt string, text string")
    ruled = frame.withColumn("pieces", dates.format_pieces(F.col("fmt"))).withColumn(
        "rules", dates.format_rules("fmt", "pieces")
    )
    found = ruled.select(dates.parse_by_format(F.col("text"), F.col("rules"), F.lit(2024)).alias("v"))
    assert found.first()["v"] == moment


def test_long_numbers_in_dates(spark):
    frame = spark.createDataFrame([("yyyy-MM-dd", "12024-03-05"), ("yyyy-MM-dd", "2024-03-99999999999")], "fmt string, text string")
    ruled = frame.withColumn("pieces", dates.format_pieces(F.col("fmt"))).withColumn("rules", dates.format_rules("fmt", "pieces"))
    moment = dates.parse_by_format(F.col("text"), F.col("rules"), F.lit(2024))
    assert [r["y"] for r in ruled.select(F.year(moment).alias("y")).collect()] == [12024, None]


FLAT_PAGE = (
    "<title>T &amp; t</title><!-- <h1>no</h1> --><script>var a='<h1>no</h1>';</script><h1 class=x>a <b>bold</b>&nbsp;c<br>d</h1>"
    "<H1 data-k='v > w'>two</H1><h2></h2><a href='/q?a=1&amp;b=2' rel=\"x y\">l<i>i</i></a><a name=here>n</a><a href>e</a>"
    "<ul><li><a rel='x y' href=/z>zed</a></ul>"
)


def test_flat_rules_agree_with_the_tree(spark):
    listed = [
        "//h1/text()", "//h1/allText()", "//h1[@class='x']/text()", "//h1[@data-k='v > w']/text()", "//h2/text()",
        "//title/text()", "//a/@href", '//a[@rel="x y"]/@href', "//a[@rel='x y']/allText()", "//a/text()", "//h3/text()",
    ]
    root = selectors.parse_html(FLAT_PAGE)
    frame = spark.createDataFrame([(FLAT_PAGE, listed)], "html string, rules array<string>")
    assert frame.select(F.forall("rules", selectors.is_flat)).first()[0]
    flat = frame.select(selectors.flat_values(F.col("html"), F.transform("rules", selectors.flat_rule)).alias("v"))
    assert flat.first()["v"] == {rule: selectors.evaluate(root, rule) for rule in listed}
    other = ["//div/text()", "//h1", "//h1//b/text()", "//a[2]/@href", "css:h1|text", "//a[contains(@href,'q')]/@href"]
    kept = spark.createDataFrame([(other,)], "rules array<string>").select(F.exists("rules", selectors.is_flat))
    assert not kept.first()[0]


def test_flat_rules_need_no_python(spark):
    templates = spark.createDataFrame([("t", "d.example", "//h1/text()")], "id string, domain string, titleXPath string")
    pages = spark.createDataFrame([("http://d.example/1", "<h1>x</h1>")], "url string, html string")
    found = extraction.match_templates(pages, templates).select(extraction.title().alias("title"))
    assert found.first()["title"] == "x" and "Python" not in found._jdf.queryExecution().toString()


def test_markup_of_deep_pages():
    root = selectors.parse_html("<div>" * 5000 + "x &lt; y<br>" + "</div>" * 5000)
    assert selectors.evaluate(root, "/div")[0] == "<div>" * 5000 + "x &lt; y<br>" + "</div>" * 5000


@pytest.mark.parametrize(
    ("text", "plain"),
    [
        ("a &mdash; b&#8217;s caf&eacute; &#x1F600;", "a — b’s café 😀"),
        ("&amp;lt; &nbsp;| &#160;| &apos;&quot;", "&lt;  |  | '\""),
        ("AT&T & &unknown; &#0; &#xD800; &;", "AT&T & &unknown; &#0; &#xD800; &;"),
        ("none", "none"),
    ],
)
def test_character_references(spark, text, plain):
    assert one(spark, markup.unescape(F.lit(text))) == plain


def test_path_rules():
    root = selectors.parse_html(
        "<div id=a class='x y'><p>one<b>two</b><br>three<p>four</div><ul class=g><li>1<li>2</ul><a href='/q?a=1&amp;b=2'>l</a>"
    )
    wanted = {
        "//p/text()": ["onethree", "four"],
        "//div[@id='a']/allText()": ["onetwo three four"],
        "//div[@class='x y']/tidyText()": ["onetwo\nthree\nfour"],
        "//li[2]/text()": ["2"],
        "//a/@href": ["/q?a=1&b=2"],
        "//div[contains(@class,'y')]/p/b/text()": ["two"],
        "//b": ["<b>two</b>"],
        "css:div.x p:eq(1)|text": ["four"],
        "css:ul.g>li|text": ["1", "2"],
        "css:#a b|allText": ["two"],
    }
    assert {rule: selectors.evaluate(root, rule) for rule in wanted} == wanted
    assert selectors.check_rule("//a[position()<3]/text()") and selectors.check_rule("a b c")


def test_unsupported_rules_are_reported(spark):
    templates = parse_templates(
        spark.createDataFrame([('{"id":"1","titleXPath":"//a[last()]"}',), ('{"id":"2","titleXPath":"//a"}',)], "j string"), "j"
    )
    assert [r["id"] for r in template_admin.unsupported_path_rules(templates).collect()] == ["1"]


def test_templates_take_numbers_as_text_and_ignore_unknown_keys(spark):
    text = '{"id":"x","thread":"3","timeout":"abc","doNLP":"false","odd":{"a":1},"dynamicFields":[{"name":"n","regex":"r","need":"true"}]}'
    row = parse_templates(spark.createDataFrame([(text,)], "j string"), "j").first()
    assert (row["thread"], row["timeout"], row["doNLP"], row["retry"], row["saveCapture"]) == (3, 5000, False, 2, True)
    assert row["dynamicFields"][0]["need"] is True and row["startURL"] == []


def test_relative_links(spark):
    base = F.lit("http://a.com/b/c?d=1#e")
    wanted = {
        "x": "http://a.com/b/x",
        "/x": "http://a.com/x",
        "//b.org/x": "http://b.org/x",
        "?q": "http://a.com/b/c?q",
        "#f": "http://a.com/b/c?d=1#f",
        "../x/./y": "http://a.com/x/y",
        "https://c.org/../z": "https://c.org/z",
    }
    for href, absolute in wanted.items():
        assert one(spark, urls.resolve_url(base, F.lit(href))) == absolute, href


def test_suffix_list_needs_no_dot_and_rejects_repeats(spark):
    assert one(spark, urls.has_ignored_suffix(F.lit("http://a/nodejs"))) is True
    assert one(spark, urls.has_ignored_suffix(F.lit("http://a/x.PDF"))) is True
    assert one(spark, urls.has_ignored_suffix(F.lit("http://a/x.html"))) is False
    assert urls.add_ignored_suffix(("a",), "b") == ("a", "b")
    with pytest.raises(ValueError):
        urls.add_ignored_suffix(("a",), "a")
