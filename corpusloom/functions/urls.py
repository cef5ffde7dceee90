"""URL parts, resolution of relative links, and the suffix blacklist."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# File suffixes whose links are not followed.
IGNORED_SUFFIXES = (
    "zip", "exe", "doc", "docx", "jpg", "png", "jpeg", "mp3", "mp4", "mkv", "rmvb", "ppt", "pptx",
    "iso", "dmg", "apk", "jar", "pdf", "xls", "xlsx", "js", "cpp", "gif", "rar", "xml",
)


def host_of(url: Column) -> Column:
    """Host name without port, or an empty string."""
    return F.regexp_extract(url, r"^\w+://([^/:?#]+)", 1)


def link_domain(url: Column) -> Column:
    """The text between the protocol and the next slash, without port; also for protocol-less text."""
    return F.regexp_extract(url, r"^(?:\w+://)?([^:]?[^/:]*)", 1)


def strip_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def domain_link_regex(domain: Column) -> Column:
    """Links of one site; only the dots of the domain are escaped."""
    return F.concat(F.lit("(https?://"), F.replace(domain, F.lit("."), F.lit("\\.")), F.lit("/.*)"))


def add_ignored_suffix(suffixes: Sequence[str], suffix: str) -> tuple[str, ...]:
    """The blacklist with one more suffix; a suffix that is already there is an error."""
    if suffix in suffixes:
        raise ValueError(f"suffix {suffix!r} is already ignored")
    return (*suffixes, suffix)


def has_ignored_suffix(url: Column, suffixes: Sequence[str] = IGNORED_SUFFIXES) -> Column:
    """Ends with a listed suffix, whether or not a dot precedes it."""
    if not suffixes:
        return F.lit(False)
    quoted = "|".join(r"\Q" + s.lower() + r"\E" for s in suffixes)
    return F.lower(url).rlike(f"(?:{quoted})$")


def _without_dot_segments(path: Column) -> Column:
    def step(kept: Column, segment: Column) -> Column:
        return (
            F.when(segment == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1))))
            .when(segment == ".", kept)
            .otherwise(F.concat(kept, F.array(segment)))
        )

    # A path that ends in a dot segment names a folder.
    as_folder = F.regexp_replace(path, r"(/\.{1,2})$", "$1/")
    segments = F.split(as_folder, "/")
    return F.array_join(F.aggregate(segments, F.expr("cast(array() as array<string>)"), step), "/")


def resolve_url(base: Column, href: Column) -> Column:
    """``href`` as an absolute URL, seen from the page at ``base``."""
    link = F.trim(href)
    page = strip_fragment(base)
    scheme = F.regexp_extract(base, r"^([A-Za-z][\w+.-]*):", 1)
    root = F.regexp_extract(base, r"^([A-Za-z][\w+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][\w+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, r"[^/]*$", ""))
    joined = (
        F.when(link.rlike(r"^[A-Za-z][\w+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(root, path, link))
        .when((link == "") | link.startswith("#"), F.concat(page, link))
        .otherwise(F.concat(root, folder, link))
    )
    joined_root = F.regexp_extract(joined, r"^([A-Za-z][\w+.-]*://[^/?#]*)", 1)
    joined_path = F.regexp_extract(joined, r"^[A-Za-z][\w+.-]*://[^/?#]*([^?#]*)", 1)
    tail = F.regexp_extract(joined, r"([?#].*)$", 1)
    return F.when(
        joined_path.rlike(r"/\.{1,2}(?:/|$)"),
        F.concat(joined_root, _without_dot_segments(joined_path), tail),
    ).otherwise(joined)
