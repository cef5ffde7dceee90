"""Schemas of the tables that the package reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()

RAW_PAGE = T.StructType(
    [
        T.StructField("url", _S),
        T.StructField("html", _S),
        T.StructField("status", T.IntegerType()),
        T.StructField("content_type", _S),
        T.StructField("content_length", T.LongType()),
    ]
)

NAMED_ENTITY = T.StructType([T.StructField(kind, T.ArrayType(_S)) for kind in ("nr", "ns", "nt")])

WEBPAGE = T.StructType(
    [
        T.StructField("id", _S),
        T.StructField("url", _S),
        T.StructField("domain", _S),
        T.StructField("spiderUUID", _S),
        T.StructField("spiderInfoId", _S),
        T.StructField("title", _S),
        T.StructField("content", _S),
        T.StructField("category", _S),
        T.StructField("rawHTML", _S),
        T.StructField("keywords", T.ArrayType(_S)),
        T.StructField("summary", T.ArrayType(_S)),
        T.StructField("namedEntity", NAMED_ENTITY),
        T.StructField("gatherTime", T.TimestampType()),
        T.StructField("publishTime", T.TimestampType()),
        T.StructField("dynamic_fields", T.MapType(_S, _S)),
        T.StructField("staticFields", T.MapType(_S, _S)),
        T.StructField("attachmentList", T.ArrayType(_S)),
        T.StructField("imageList", T.ArrayType(_S)),
        T.StructField("processTime", T.LongType()),
    ]
)

DYNAMIC_FIELD = "struct<regex:string,xpath:string,name:string,need:boolean>"
STATIC_FIELD = "struct<name:string,value:string>"

# Fixed value: the agent name of templates that give none.
DEFAULT_USER_AGENT = (
    "Mozilla/5.0 (Windows NT 5.2) AppleWebKit/534.30 (KHTML, like Gecko) Chrome/12.0.742.122 Safari/534.30"
)

#: Template columns with their Spark type and the value used when the JSON lacks them.
TEMPLATE_COLUMNS: dict[str, tuple[str, object]] = {
    "id": ("string", None),
    "siteName": ("string", None),
    "domain": ("string", None),
    "startURL": ("array<string>", []),
    "urlReg": ("string", None),
    "contentReg": ("string", None),
    "contentXPath": ("string", None),
    "titleReg": ("string", None),
    "titleXPath": ("string", None),
    "categoryReg": ("string", None),
    "categoryXPath": ("string", None),
    "defaultCategory": ("string", None),
    "publishTimeReg": ("string", None),
    "publishTimeXPath": ("string", None),
    "publishTimeFormat": ("string", None),
    "lang": ("string", None),
    "country": ("string", None),
    "charset": ("string", None),
    "userAgent": ("string", DEFAULT_USER_AGENT),
    "callbackURL": ("array<string>", []),
    "proxyHost": ("string", None),
    "proxyPort": ("int", 0),
    "proxyUsername": ("string", None),
    "proxyPassword": ("string", None),
    "thread": ("int", 1),
    "retry": ("int", 2),
    "sleep": ("int", 0),
    "timeout": ("int", 5000),
    "maxPageGather": ("int", 10),
    "priority": ("int", 0),
    "gatherFirstPage": ("boolean", False),
    "needTitle": ("boolean", False),
    "needContent": ("boolean", False),
    "needPublishTime": ("boolean", False),
    "saveCapture": ("boolean", True),
    "autoDetectPublishDate": ("boolean", False),
    "doNLP": ("boolean", True),
    "ajaxSite": ("boolean", False),
    "dynamicFields": (f"array<{DYNAMIC_FIELD}>", []),
    "staticFields": (f"array<{STATIC_FIELD}>", []),
}

#: Columns that do not make two templates different.
NOT_COMPARED = ("id", "callbackURL", "ajaxSite", "proxyHost", "proxyPort", "proxyUsername", "proxyPassword")
