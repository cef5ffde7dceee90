"""Registered queries: the shop recipe.

The pages get the markup of a shop list or product page appended, made from their own data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import frontier, shop
from corpusloom.plans import fixtures as fx
from corpusloom.plans.collect import shop_recipe
from corpusloom.session import dealt, new_path
from corpusloom.sources.sinks import product_sink


def _list_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as the items of list pages, 25 a page."""
    key = F.col("p_partkey").cast("string")
    item = F.concat(
        F.lit("<div class='item wide'><img src=x data-src='/img/"), key, F.lit(".jpg'><div class='title'><a href='https://shop.example.com/i/"),
        key, F.lit("#top'> "), F.col("p_name"), F.lit(" <b>"), F.col("p_brand"), F.lit("</b></a></div></div>"),
    )
    number = F.floor(F.col("p_partkey") / 25).cast("long")
    parts = fx.table(spark, sf_dir, "part").select(number.alias("number"), "p_partkey", item.alias("item"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "item"))), lambda i: i["item"]), "")
    return parts.groupBy("number").agg(body.alias("body")).select(
        F.concat(F.lit("https://shop.example.com/list?p="), F.col("number").cast("string")).alias("url"),
        F.concat(F.lit("<html><body><div class='items'>"), "body", F.lit("</div></body></html>")).alias("html"),
    )


def _product_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as product pages with none to three attributes, a slider or one picture, and links to colours."""
    n = F.col("p_partkey")
    key = n.cast("string")

    def when(condition: Column, *pieces: Column) -> Column:
        return F.when(condition, F.concat(*pieces)).otherwise(F.lit(""))

    html = F.concat(
        F.lit("<html><head><title>Part "), key, F.lit("</title></head><body><div class='product-name'><h1>"),
        F.col("p_name"), F.lit("</h1><h2>"), F.col("p_brand"), F.lit("</h2></div><ul class='product-attribute-list'>"),
        when(n % 4 >= 1, F.lit("<li>c"), key, F.lit("</li>")),
        when(n % 4 >= 2, F.lit("<li>"), F.col("p_type"), F.lit("</li>")),
        when(n % 4 >= 3, F.lit("<li>2017</li>")),
        F.lit("</ul>"),
        when(n % 2 == 0, F.lit("<ul class='bxslider'><li><a data-url-zoom='/z/"), key, F.lit("'><img src='/s/"), key, F.lit("'></a></li></ul>")),
        when(n % 2 == 1, F.lit("<div class='desktop-product-image'><img src='/one/"), key, F.lit("'></div>")),
        F.lit("<div class='product-shop'><span class='price'>$"), F.col("p_size").cast("string"),
        F.lit("</span></div><ul class='list-size'><li><button>7</button></li><li><button>8</button></li></ul>"),
        F.lit("<div class='product-data-mine' data-lookup=\"{'1':{}}\"></div><div class='other-colors-inner'>"),
        when(n % 3 == 0, F.lit("<a href='https://shop.example.com/i/"), (n + 1).cast("string"), F.lit("'>other</a>")),
        F.lit("</div></body></html>"),
    )
    # A part is a few bytes in its file and takes long as a page.
    return dealt(fx.table(spark, sf_dir, "part")).select(
        F.concat(F.lit("https://shop.example.com/i/"), key).alias("url"), html.alias("html")
    )


def list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shop.list_items(_list_pages(spark, sf_dir))


def list_item_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shop.list_item_links(shop.list_items(_list_pages(spark, sf_dir)), fx.RUN)


def page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _list_pages(spark, sf_dir).unionByName(_product_pages(spark, sf_dir)).unionByName(
        fx.pages(spark, sf_dir).select("url", F.concat("html", F.lit('<UL id="a" class="wide products-grid">')).alias("html"))
    )
    url = F.col("url")
    is_list = shop.is_list_page(url, F.col("html"))
    return both.select("url", is_list.alias("is_list"), (is_list & shop.is_first_list_page(url)).alias("is_first"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shop.product_fields(_product_pages(spark, sf_dir))
    lists = ("picUrls", "picRetinaUrls", "sizes")
    return found.select(
        "url", "title", "name", "brand", "code", "color", "startTime", "price", "priceJson",
        *(F.array_join(c, ",").alias(c) for c in lists),
    )


def other_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = shop.other_color_links(shop.product_fields(_product_pages(spark, sf_dir)), fx.RUN)
    nothing_stored = spark.createDataFrame([], "id string")
    return frontier.new_links(links, nothing_stored).select("url", "source_url")


def skus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shop.explode_skus(fx.price_json(spark, sf_dir), "id", "price_json")


def sku_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shop.with_skus(fx.price_json(spark, sf_dir), "id", "price_json")
    return found.select("id", F.size("skus").cast("long").alias("n_skus"), F.array_join("sizes", ",").alias("sizes"))


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.attr_list(spark, sf_dir).select("id", F.explode(shop.attribute_map(F.col("attrs"))).alias("name", "value"))


def attribute_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shop.attribute_work(fx.catalogue(spark, sf_dir))


def pushed_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes fetched for every URL of the work list."""
    catalogue = fx.catalogue(spark, sf_dir)
    fetched = shop.attribute_work(catalogue).select("id", F.create_map(F.lit("from"), "url").alias("attr_map"))
    done = shop.push_attributes(catalogue, fetched)
    values = F.sort_array(F.flatten(F.transform("attrs", lambda m: F.map_values(m))))
    return done.select("id", F.array_join(values, ",").alias("values"), "fetchAttrs")


def product_sink_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shop recipe and its sink; a second host's products are not for this sink."""
    pages = _product_pages(spark, sf_dir)
    others = pages.withColumn("url", F.replace("url", F.lit("shop.example.com"), F.lit("other.example.com")))
    templates = spark.createDataFrame(
        [("t1", "shop.example.com"), ("t2", "other.example.com")], "id string, domain string"
    )
    path = new_path(spark, "products")
    product_sink(path, "shop.example.com")(shop_recipe(pages.unionByName(others), templates, fx.RUN, fx.GATHERED))
    stored = spark.read.parquet(path)
    return stored.select("id", "productUrl", "name", "brand", "price", F.size("picUrls").cast("long").alias("n_pictures"))


QUERIES = {
    "a6_product_sink": product_sink_rows,
    "d12_other_colours": other_colours,
    "e20_list_items": list_items,
    "e20_list_item_links": list_item_links,
    "e21_page_kinds": page_kinds,
    "e22_products": products,
    "e23_skus": skus,
    "e23_sku_sizes": sku_sizes,
    "e24_attributes": attributes,
    "e25_attribute_work": attribute_work,
    "e26_pushed_attributes": pushed_attributes,
}

_SKUS = """skus AS (SELECT l_partkey AS id, 's' || l_suppkey || '-' || l_orderkey || '-' || l_linenumber AS sku,
  l_linenumber || 'y' AS size, '$' || l_quantity::INTEGER AS price
  FROM lineitem WHERE l_returnflag <> 'R' AND l_discount <> 0 AND l_linenumber <> 7)"""
_ITEM_URL = "'https://shop.example.com/list?p=' || (p_partkey // 25)"
_PRODUCT_URL = "'https://shop.example.com/i/' || p_partkey"
_WORK = (
    fx.CATALOGUE_SQL
    + """, work AS (SELECT id, url FROM (SELECT id, unnest(links) AS url FROM catalogue
  WHERE keywords_wanted AND attrs_done IS NOT TRUE) WHERE url LIKE 'http%')"""
)

CHECKS = {
    "a6_product_sink": f"""SELECT md5({_PRODUCT_URL}) AS id, {_PRODUCT_URL} AS "productUrl", p_name AS name,
        p_brand AS brand, '$' || p_size AS price, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS n_pictures FROM part""",
    "d12_other_colours": f"""SELECT 'https://shop.example.com/i/' || (p_partkey + 1) AS url, {_PRODUCT_URL} AS source_url
        FROM part WHERE p_partkey % 3 = 0""",
    "e20_list_items": f"""SELECT {_ITEM_URL} AS list_url, '/img/' || p_partkey || '.jpg' AS "imageUrl",
        p_name || ' ' || p_brand AS name, 'https://shop.example.com/i/' || p_partkey || '#top' AS url FROM part""",
    "e20_list_item_links": f"""SELECT 'run-1' AS run_id, {_PRODUCT_URL} AS url, {_ITEM_URL} AS source_url, true AS detail FROM part""",
    "e21_page_kinds": f"""SELECT DISTINCT {_ITEM_URL} AS url, true AS is_list, contains({_ITEM_URL}, 'p=1') AS is_first FROM part
        UNION ALL SELECT {_PRODUCT_URL}, false, false FROM part
        UNION ALL SELECT url, true, contains(url, 'p=1') OR NOT contains(url, 'p=') FROM pages""",
    "e22_products": f"""SELECT {_PRODUCT_URL} AS url, 'Part ' || p_partkey AS title, p_name AS name, p_brand AS brand,
        CASE WHEN p_partkey % 4 >= 1 THEN 'c' || p_partkey END AS code, CASE WHEN p_partkey % 4 >= 2 THEN p_type END AS color,
        CASE WHEN p_partkey % 4 >= 3 THEN '2017' END AS "startTime", '$' || p_size AS price,
        '{{''1'':{{}}}}' AS "priceJson", CASE WHEN p_partkey % 2 = 0 THEN '/s/' || p_partkey ELSE '' END AS "picUrls",
        CASE WHEN p_partkey % 2 = 0 THEN '/z/' ELSE '/one/' END || p_partkey AS "picRetinaUrls", '7,8' AS sizes FROM part""",
    "e23_skus": fx.with_sql(_SKUS) + "SELECT id, sku, size, price FROM skus",
    "e23_sku_sizes": fx.with_sql(_SKUS)
    + """SELECT p.id, count(sku) AS n_skus, coalesce(string_agg(size, ',' ORDER BY sku), '') AS sizes
        FROM (SELECT DISTINCT l_partkey AS id FROM lineitem) p LEFT JOIN skus USING (id) GROUP BY p.id""",
    "e24_attributes": """SELECT p_partkey AS id, 'brand' AS name, CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE p_brand END AS value
        FROM part UNION ALL SELECT p_partkey, 'type', p_type FROM part""",
    "e25_attribute_work": fx.with_sql(_WORK) + "SELECT id, url FROM work",
    "e26_pushed_attributes": fx.with_sql(_WORK)
    + """SELECT c.id, array_to_string(CASE WHEN id % 2 = 0 OR new IS NOT NULL THEN
          list_sort(list_concat(CASE WHEN id % 2 = 0 THEN [p_brand] ELSE []::VARCHAR[] END, coalesce(new, []::VARCHAR[]))) END, ',') AS values,
        CASE WHEN new IS NOT NULL THEN true ELSE attrs_done END AS "fetchAttrs"
        FROM catalogue c LEFT JOIN (SELECT id, list(url) AS new FROM work GROUP BY id) USING (id)""",
}
