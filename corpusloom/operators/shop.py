"""The shop recipe: list pages, product pages, price tables and attribute lists."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import selectors, urls, values

# The places of a list item and of a product page.
LIST_ITEM = "css:div.items div.item"
LIST_PARTS = ["css:img|data-src", "css:div.title>a|allText", "css:div.title>a|href"]
PRODUCT_RULES = {
    "title": "css:title|text",
    "brand": "css:div.product-name:eq(0) h2|text",
    "name": "css:div.product-name:eq(0) h1|text",
    "attributes": "css:ul.product-attribute-list li|text",
    "other_colors": "css:div.other-colors-inner a|href",
    "single_picture": "css:div.desktop-product-image img|src",
    "price": "css:div.product-shop span.price:eq(0)|text",
    "sizes": "css:ul.list-size:eq(0) button|text",
    "priceJson": "css:div.product-data-mine|data-lookup",
}
TEXT_FIELDS = ("name", "brand", "code", "color", "startTime", "price", "priceJson")
LIST_FIELDS = ("picUrls", "picRetinaUrls", "sizes")
SLIDE_ITEM = "css:ul.bxslider li"
SLIDE_PARTS = ["css:a|data-url-zoom", "css:img|src"]


def is_list_page(url: Column, html: Column) -> Column:
    """The URL has a page number, or the page shows a product grid."""
    grid = html.rlike(r"""(?is)<ul\b[^>]*\bclass\s*=\s*["'][^"'>]*(?<![\w-])products-grid(?![\w-])""")
    return url.contains("p=") | grid


def is_first_list_page(url: Column) -> Column:
    return url.contains("p=1") | ~url.contains("p=")


def list_items(pages: DataFrame) -> DataFrame:
    """One row per list item: ``list_url, imageUrl, name, url``."""
    items = selectors.item_values(F.col("html"), LIST_ITEM, LIST_PARTS)
    return pages.select(F.col("url").alias("list_url"), F.explode(items).alias("item")).select(
        "list_url",
        F.coalesce(F.get("item", 0), F.lit("")).alias("imageUrl"),
        F.trim(F.coalesce(F.get("item", 1), F.lit(""))).alias("name"),
        F.coalesce(F.get("item", 2), F.lit("")).alias("url"),
    )


def list_item_links(items: DataFrame, run_id: str) -> DataFrame:
    """List items as frontier rows that are marked as product pages. List pages are not stored."""
    return items.select(
        F.lit(run_id).alias("run_id"),
        urls.strip_fragment(F.col("url")).alias("url"),
        F.col("list_url").alias("source_url"),
        F.lit(True).alias("detail"),
    )


def product_fields(pages: DataFrame) -> DataFrame:
    """Product pages with one column per field, parsed once per page (list pages are left out).

    Expects ``url, html``; other columns are carried through.
    """
    values_of = selectors.page_values(F.col("html"), list(PRODUCT_RULES.values()), SLIDE_ITEM, SLIDE_PARTS)
    parsed = (
        pages.filter(~is_list_page(F.col("url"), F.col("html")))
        .withColumn("_page", values_of)
        .withColumns({"_found": F.col("_page.paths"), "_slides": F.col("_page.items")})
    )

    def every(field: str) -> Column:
        return F.element_at("_found", F.lit(PRODUCT_RULES[field]))

    def first(field: str) -> Column:
        return F.get(every(field), 0)

    zoomed = F.transform("_slides", lambda s: F.get(s, 0))
    single = F.when(first("single_picture").isNotNull(), F.array(first("single_picture"))).otherwise(
        F.expr("cast(array() as array<string>)")
    )
    return parsed.withColumns(
        {
            "title": first("title"),
            "name": first("name"),
            "brand": first("brand"),
            "code": F.get(every("attributes"), 0),
            "color": F.get(every("attributes"), 1),
            "startTime": F.get(every("attributes"), 2),
            "picUrls": F.transform("_slides", lambda s: F.get(s, 1)),
            "picRetinaUrls": F.when(F.size("_slides") > 0, zoomed).otherwise(single),
            "price": first("price"),
            "sizes": every("sizes"),
            "priceJson": first("priceJson"),
            "other_colors": every("other_colors"),
        }
    ).drop("_page", "_found", "_slides")


def other_color_links(products: DataFrame, run_id: str) -> DataFrame:
    """Links from product pages to the same product in other colours."""
    return products.select(
        F.lit(run_id).alias("run_id"),
        F.explode("other_colors").alias("url"),
        F.col("url").alias("source_url"),
        F.lit(False).alias("detail"),
    )


def product_documents(
    products: DataFrame,
    template_id: Column,
    domain: Column,
    static_fields: Column,
    run_id: str,
    gather_time: datetime,
) -> DataFrame:
    """Product pages as documents; the product itself is in ``dynamic_fields``."""
    at = F.lit(gather_time).cast("timestamp")
    listed = {name: F.to_json(name) for name in LIST_FIELDS}
    plain = {name: F.col(name) for name in TEXT_FIELDS}
    fields = {"productUrl": F.col("url"), **plain, **listed}
    return products.select(
        F.md5("url").alias("id"),
        "url",
        domain.alias("domain"),
        F.lit(run_id).alias("spiderUUID"),
        template_id.alias("spiderInfoId"),
        "title",
        F.col("name").alias("content"),
        F.col("brand").alias("category"),
        F.col("html").alias("rawHTML"),
        F.array(F.lit("-")).alias("keywords"),
        F.array(F.lit("-")).alias("summary"),
        at.alias("gatherTime"),
        at.alias("publishTime"),
        F.create_map(*(part for name, value in fields.items() for part in (F.lit(name), value))).alias(
            "dynamic_fields"
        ),
        F.when(F.size(static_fields) > 0, static_fields).alias("staticFields"),
    )


def typed_products(documents: DataFrame, domain: str) -> DataFrame:
    """Product records from the documents of one shop; those without a name are left out."""
    field = F.col("dynamic_fields")
    return (
        documents.filter((F.col("domain") == domain) & (F.size("dynamic_fields") > 0))
        .select(
            "id",
            *(field[name].alias(name) for name in ("productUrl", *TEXT_FIELDS)),
            *(F.from_json(field[name], "array<string>").alias(name) for name in LIST_FIELDS),
        )
        .filter(F.col("name").isNotNull())
    )


def explode_skus(products: DataFrame, id_column: str, json_column: str) -> DataFrame:
    """One row per stock unit: ``<id>, sku, size, price``.

    The price table is single-quoted JSON of two nested objects. The outer key -1 is not a
    condition and is passed over, as are nodes out of stock, without a dollar price, or broken.
    """
    options = {"allowSingleQuotes": "true"}
    outer = products.select(
        id_column, F.explode(F.from_json(json_column, "map<string,string>", options)).alias("condition", "units")
    ).filter(F.col("condition") != "-1")
    inner = outer.select(
        id_column, F.explode(F.from_json("units", "map<string,string>", options)).alias("unit", "node")
    )
    node = F.from_json("node", "qty string, price string, sku string, size string", options)
    units = inner.select(id_column, node.alias("n"))
    return units.filter(
        (F.col("n.qty").try_cast("double").cast("int") > 0)
        & F.col("n.sku").isNotNull()
        & F.col("n.size").isNotNull()
        & F.col("n.price").contains("$")
    ).select(
        id_column,
        F.col("n.sku").alias("sku"),
        F.col("n.size").alias("size"),
        F.regexp_extract("n.price", r"(\$[^<]+)", 1).alias("price"),
    ).filter(F.col("price") != "")


def with_skus(products: DataFrame, id_column: str, json_column: str) -> DataFrame:
    """Products that have a price table, with ``skus`` and the ``sizes`` of those; others unchanged."""
    skus = explode_skus(products, id_column, json_column).groupBy(id_column).agg(
        F.sort_array(F.collect_list(F.struct("sku", "size", "price"))).alias("_skus")
    )
    empty = F.expr("cast(array() as array<struct<sku:string,size:string,price:string>>)")
    found = F.when(F.col(json_column).isNotNull(), F.coalesce("_skus", empty))
    joined = products.join(skus, id_column, "left").withColumn("skus", found)
    sizes = F.transform("skus", lambda s: s["size"])
    if "sizes" in products.columns:
        sizes = F.coalesce(sizes, F.col("sizes"))
    return joined.withColumn("sizes", sizes).drop("_skus")


def attribute_map(attributes: Column) -> Column:
    """``name:value`` texts as a map; a full-width colon counts too, the last of equal names wins.

    A text with no value, or with more than two parts, is rejected.
    """
    parts = F.transform(attributes, lambda a: F.split(F.regexp_replace(a, "[:：]+$", ""), ":|："))
    pairs = F.transform(
        F.filter(parts, lambda p: F.size(p) == 2),
        lambda p: F.struct(F.get(p, 0).alias("name"), F.get(p, 1).alias("value")),
    )
    return F.map_from_entries(values.last_by_name(pairs))


def attribute_work(catalogue: DataFrame) -> DataFrame:
    """Product URLs whose attributes are still to be fetched: ``id, url``."""
    wanted = F.col("fetchKeywords") & ~F.coalesce(F.col("fetchAttrs"), F.lit(False))
    return (
        catalogue.filter(wanted)
        .select("id", F.explode("productUrls").alias("url"))
        .filter(F.coalesce(F.col("url").rlike(r"^\s*(?i:https?|ftp|file|jar|mailto):"), F.lit(False)))
    )


def push_attributes(catalogue: DataFrame, fetched: DataFrame) -> DataFrame:
    """Append the fetched maps (``id, attr_map``) to ``attrs`` and mark those products as done.

    A product has a handful of pages, so its maps fit in one row.
    """
    new = fetched.groupBy("id").agg(F.collect_list("attr_map").alias("_new"))
    none = F.expr("cast(array() as array<map<string,string>>)")
    return (
        catalogue.join(new, "id", "left")
        .withColumns(
            {
                "attrs": F.when(
                    F.col("_new").isNotNull(), F.concat(F.coalesce("attrs", none), F.col("_new"))
                ).otherwise(F.col("attrs")),
                "fetchAttrs": F.when(F.col("_new").isNotNull(), F.lit(True)).otherwise(F.col("fetchAttrs")),
            }
        )
        .drop("_new")
    )
