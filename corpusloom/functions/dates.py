"""Publish-time parsing by template format and by automatic detection.

Parsing is lenient: a month 13 is January of the next year, text after the date is ignored, and
fields that the format lacks keep their 1970-01-01 00:00:00 value.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.values import let

# The date forms to look for, in the order in which they are tried. Y stands for
# four digits, every other letter for two.
DATE_FORMS = (
    "Y年M月D日 h:m:s",
    "Y-M-D h:m:s",
    "Y年M月D日h:m:s",
    "Y/M/D h:m:s",
    "Y-M-Dh:m:s",
    "Y/M/Dh:m:s",
    "Y年M月D日 h:m",
    "M月D日 h:m:s",
    "Y-M-D h:m",
    "Y年M月D日h:m",
    "Y/M/D h:m",
    "M月D日h:m:s",
    "M-D h:m:s",
    "Y-M-Dh:m",
    "Y/M/Dh:m",
    "M-Dh:m:s",
    "M月D日 h:m",
    "M月D日h:m",
    "M-D h:m",
    "M-Dh:m",
    "Y年M月D日",
    "Y-M-D",
    "Y/M/D",
    "M月D日",
    "M-D",
)


def form_regex(form: str) -> str:
    """``Y-M-D`` -> ``[0-9]{4}-[0-9]{2}-[0-9]{2}``."""
    return "".join("[0-9]{4}" if c == "Y" else "[0-9]{2}" if c in "MDhms" else c for c in form)


def detect_date(html: Column) -> Column:
    """The first hit of the first form that occurs anywhere in the page, or null.

    Every form consists of the characters of one class, so one scan cuts the page down to the
    runs of that class and the forms are tried on the runs alone.
    """
    runs = F.array_join(F.regexp_extract_all(html, F.lit("([0-9年月日:/ -]{5,})"), F.lit(1)), "\n")

    def first_form(text: Column) -> Column:
        hits = [F.regexp_extract(text, f"({form_regex(form)})", 1) for form in DATE_FORMS]
        tried = F.coalesce(*(F.when(hit != "", hit) for hit in hits))
        # Every form has a month and a day, so texts without that shape need no tries.
        return F.when(text.rlike("[0-9]{2}[-/月][0-9]{2}"), tried)

    return let(runs, first_form)


def _moment(parts: dict[str, Column]) -> Column:
    """A timestamp from numbers that may be out of their usual range."""
    day = F.date_add(
        F.add_months(F.make_date(parts["year"], F.lit(1), F.lit(1)), parts["month"] - 1), parts["day"] - 1
    )
    time = F.make_dt_interval(F.lit(0), parts["hour"], parts["minute"], parts["second"].cast("decimal(18,6)"))
    return day.cast("timestamp") + time


def _in_year(moment: Column, year: Column) -> Column:
    shift = F.make_ym_interval(year - F.year(moment), F.lit(0))
    return moment + shift


def parse_detected(hit: Column, current_year: Column) -> Column:
    """The moment named by a hit of ``detect_date``; hits without a year get ``current_year``."""
    digits = F.regexp_replace(hit, "[^0-9]", "")
    has_year = hit.rlike("^[0-9]{4}")
    offset = F.when(has_year, F.lit(4)).otherwise(F.lit(0))

    def two(at: int) -> Column:
        return F.coalesce(F.substring(digits, offset + F.lit(at), F.lit(2)).try_cast("int"), F.lit(0))

    moment = _moment(
        {
            "year": F.when(has_year, F.substring(digits, 1, 4).try_cast("int")).otherwise(F.lit(1970)),
            "month": two(1),
            "day": two(3),
            "hour": two(5),
            "minute": two(7),
            "second": two(9),
        }
    )
    return F.when(has_year, moment).when(hit.isNotNull(), _in_year(moment, current_year))


# Date-format letters by the part they set.
PART_LETTERS = {
    "year": "y", "month": "M", "day": "d", "hour": "HhKk", "minute": "m", "second": "s", "half": "a",
}
#: Numbers from here on are no part of a date that a timestamp can hold.
_FAR = 100_000
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


#: Months and half-days of a language, as columns of templates: lower-case names, long ones first.
MONTHS_TYPE = "array<struct<name:string,month:int>>"
PM_TYPE = "array<string>"
#: How a month may be written: in a date or alone, in full or short.
_MONTH_FORMS = ("MMMM", "LLLL", "MMM", "LLL")


def language_tag(lang: Column, country: Column) -> Column:
    """``fr`` or ``fr-CA``; null if the language is blank or no language code."""
    code, region = F.lower(F.trim(lang)), F.upper(F.trim(country))
    tag = F.when(region.rlike("^(?:[A-Z]{2}|[0-9]{3})$"), F.concat(code, F.lit("-"), region)).otherwise(code)
    return F.when(code.rlike("^[a-z]{2,8}$"), tag)


def _spellings(name: Column) -> Column:
    """A name as it may be written: as it is, without its last stop, with plain spaces, without signs."""
    lowered = F.lower(F.regexp_replace(name, '^"|"$', ""))
    spaced = F.regexp_replace(lowered, r"[\s\u00a0\u202f]+", " ")
    return F.array_distinct(
        F.array(lowered, spaced, F.regexp_replace(spaced, r"\.$", ""), F.regexp_replace(spaced, r"[ .]", ""))
    )


def language_names(spark: SparkSession, tags: list[str]) -> DataFrame:
    """``tag, months, halves``: names of months and half-days, as the formatter of each language writes them.

    ``halves`` has the spellings of both half-days, ``pm`` those of the second.
    """
    first = F.make_timestamp(F.lit(2001), (F.col("id") + 1).cast("int"), F.lit(1), F.when(F.col("id") < 6, 1).otherwise(13), F.lit(0), F.lit(0))

    def written(form: str, tag: str) -> Column:
        return F.to_csv(F.struct(first), {"timestampFormat": form, "locale": tag})

    tables = []
    for tag in tags:
        names = F.flatten(F.array(*(_spellings(written(form, tag)) for form in _MONTH_FORMS)))
        tables.append(
            F.struct(F.lit(tag).alias("tag"), names.alias("names"), _spellings(written("a", tag)).alias("half"))
        )
    rows = spark.range(12).select((F.col("id") + 1).cast("int").alias("month"), F.explode(F.array(*tables)).alias("t"))
    named = rows.select("month", "t.tag", "t.names", "t.half")
    longest = F.struct((-F.length("name")).alias("n"), "name", "month")
    months = named.select("tag", "month", F.explode("names").alias("name")).groupBy("tag").agg(
        F.transform(F.array_sort(F.collect_set(longest)), lambda m: F.struct(m["name"].alias("name"), m["month"].alias("month"))).alias("months")
    )
    halves = named.groupBy("tag").agg(
        F.flatten(F.collect_set("half")).alias("halves"),
        F.flatten(F.collect_set(F.when(F.col("month") > 6, F.col("half")))).alias("pm"),
    )
    return months.join(halves, "tag")


def with_language_names(templates: DataFrame) -> DataFrame:
    """Templates with ``months``, ``halves`` and ``pm`` of their language; null without one, which reads English."""
    tagged = templates.withColumn("_tag", language_tag(F.col("lang"), F.col("country")))
    # As many as there are languages among the templates' formats.
    tags = sorted(r[0] for r in tagged.filter("_tag is not null").select("_tag").distinct().collect())
    if not tags:
        nothing = {"months": MONTHS_TYPE, "halves": PM_TYPE, "pm": PM_TYPE}
        return tagged.drop("_tag").withColumns({name: F.lit(None).cast(kind) for name, kind in nothing.items()})
    names = language_names(templates.sparkSession, tags).withColumnRenamed("tag", "_tag")
    return tagged.join(F.broadcast(names), "_tag", "left").drop("_tag")


def _any_of(names: Column) -> Column:
    return F.array_join(F.transform(names, lambda n: F.concat(F.lit(r"\Q"), n, F.lit(r"\E"))), "|")


def format_pieces(fmt: Column, months: Column | None = None, halves: Column | None = None) -> Column:
    """A date format as ``array<struct<letter, body>>``: one regex per field or literal character.

    Adjacent numeric fields have a fixed width, others take all digits. A literal has no letter. With the names of a
    language, months and half-days are written as there.
    """
    months = F.lit(None).cast(MONTHS_TYPE) if months is None else months
    halves = F.lit(None).cast(PM_TYPE) if halves is None else halves
    named_month = F.concat(F.lit("(?iu:"), _any_of(F.transform(months, lambda m: m["name"])), F.lit(")"))
    named_half = F.concat(F.lit("(?iu:"), _any_of(halves), F.lit("|am|pm|上午|下午)"))
    parts = F.regexp_extract_all(fmt, F.lit(r"('[^']*'|([A-Za-z])\2*|[^A-Za-z'])"), F.lit(1))
    numeric = r"^(?:[ydHhkKmsSDFwWu]+|M{1,2})$"

    def body(token: Column, following: Column) -> Column:
        fixed = F.concat(F.lit("[0-9]{"), F.length(token).cast("string"), F.lit("}"))
        return (
            F.when(token == "''", F.lit("'"))
            .when(token.startswith("'"), F.concat(F.lit(r"\Q"), F.replace(token, F.lit("'"), F.lit("")), F.lit(r"\E")))
            .when(~token.rlike("^[A-Za-z]"), F.concat(F.lit(r"\Q"), token, F.lit(r"\E")))
            .when(token.rlike(numeric), F.when(following.rlike(numeric), fixed).otherwise(F.lit("[0-9]+")))
            .when(token.startswith("a"), F.coalesce(named_half, F.lit("(?i:am|pm|上午|下午)")))
            .when(token.startswith("M") & months.isNotNull(), named_month)
            .otherwise(F.lit(r"[\p{L}.:+-]+[0-9:]*"))
        )

    return let(
        parts,
        lambda tokens: F.transform(
            tokens,
            lambda token, i: F.struct(
                F.regexp_extract(token, "^[A-Za-z]", 0).alias("letter"),
                body(token, F.get(tokens, i + F.lit(1))).alias("body"),
            ),
        ),
    )


def format_rules(fmt: str, pieces: str, months: str | None = None, pm: str | None = None) -> Column:
    """Struct of regexes, one per date part, with group 1 around that part.

    Takes the names of the format column and of its ``format_pieces``, and of the columns that have the months and
    second half-days of its language. Worked out once per template.
    """
    lead = r"if(p.letter = '', '', r'[ \t]*')"

    def rule(letters: str) -> str:
        wrapped = f"if(p.letter rlike '^[{letters}]$', concat('(', p.body, ')'), p.body)"
        return f"concat('^', array_join(transform({pieces}, p -> concat({lead}, {wrapped})), ''))"

    parts = ", ".join(
        f"'{part}', if({fmt} rlike '[{letters}]', {rule(letters)}, null)" for part, letters in PART_LETTERS.items()
    )
    # Clocks that start at one write the hour zero as 12 or as 24.
    midnight = f"case when contains({fmt}, 'h') then 12 when contains({fmt}, 'k') then 24 end"
    return F.expr(
        f"named_struct('whole', {rule('0')}, {parts}, "
        f"'without_year', not contains({fmt}, 'yyyy'), 'midnight', {midnight}, "
        f"'months', cast({months or 'null'} as {MONTHS_TYPE}), 'pm', cast({pm or 'null'} as {PM_TYPE}))"
    )


def parse_by_format(value: Column, rules: Column, current_year: Column) -> Column:
    """Parse ``value`` with the rules of ``format_rules``; null if it does not have the form."""

    def text(part: str) -> Column:
        rule = rules[part]
        found = F.call_function("regexp_extract", value, rule, F.lit(1))
        return F.when(rule.isNotNull() & (found != ""), found)

    def number(part: str, default: int) -> Column:
        found = text(part)
        # What is too long for a number is far off too; names of months are none.
        return F.when(found.rlike("^[0-9]+$"), F.least(found.try_cast("int"), F.lit(_FAR))).otherwise(default)

    month_name = F.array_position(
        F.array(*(F.lit(m) for m in _MONTHS)), F.lower(F.substring(F.coalesce(text("month"), F.lit("")), 1, 3))
    ).cast("int")
    spoken = F.lower(F.coalesce(text("month"), F.lit("")))
    of_language = F.get(F.filter(rules["months"], lambda m: m["name"] == spoken), 0)["month"]
    month = F.coalesce(of_language, F.when(month_name > 0, month_name), number("month", 1))
    hour = number("hour", 0)
    hour = F.when(hour == rules["midnight"], F.lit(0)).otherwise(hour)
    half = F.lower(text("half"))
    second_half = half.isin("pm", "下午") | F.coalesce(F.array_contains(rules["pm"], half), F.lit(False))
    hour = F.when(second_half, hour + 12).otherwise(hour)
    moment = _moment(
        {
            "year": number("year", 1970),
            "month": month,
            "day": number("day", 1),
            "hour": hour,
            "minute": number("minute", 0),
            "second": number("second", 0),
        }
    )
    fixed = F.when(rules["without_year"], _in_year(moment, current_year)).otherwise(moment)
    near = [number(part, 0) < _FAR for part in ("year", "month", "day", "hour", "minute", "second")]
    return F.when(F.call_function("rlike", value, rules["whole"]) & reduce(and_, near), fixed)
