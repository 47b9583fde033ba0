"""String expressions. All of them are native columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def text_array(values: Sequence[str]) -> Column:
    """Array literal of strings, parsed in one go."""
    quoted = ", ".join("'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'" for value in values)
    return F.expr(f"array({quoted})")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), 0)


# Unicode white space plus the four separator controls.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007" \
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(value: Column | str) -> Column:
    """Trim white space of every script; ``F.trim`` alone drops blanks only."""
    return F.trim(as_col(value), F.lit(WHITE_SPACE))


def file_suffix(name: Column | str) -> Column:
    """Lower-cased extension with its dot, or ''. A leading or a closing dot starts no extension."""
    return F.lower(F.regexp_extract(as_col(name), r"(?s)[^/](\.[^./]+)$", 1))


def file_stem(name: Column | str) -> Column:
    return F.regexp_replace(as_col(name), r"(?s)(?<=[^/])\.[^./]+$", "")


def base_name(path: Column | str) -> Column:
    return F.regexp_extract(as_col(path), r"([^/]*)$", 1)


def parent_path(path: Column | str) -> Column:
    """Everything before the last '/', or ''."""
    return F.regexp_extract(as_col(path), r"(?s)^(.*)/[^/]*$", 1)


def title_case(value: Column | str) -> Column:
    return F.initcap(F.replace(as_col(value), F.lit("_"), F.lit(" ")))


def percent_decode(value: Column | str) -> Column:
    """Percent-decoding that keeps '+' and gives undecodable input back unchanged."""
    raw = as_col(value)
    return F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)


def url_filename(url: Column | str, disposition: Column | str | None = None, as_of: Column | None = None) -> Column:
    """File name of a fetched URL: the header's ``filename=``, else the last path part, else a dated name."""
    path = F.regexp_extract(as_col(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    from_path = F.regexp_replace(base_name(path), r";.*$", "")
    stamp = F.date_format(F.current_timestamp() if as_of is None else as_of, "yyyyMMdd_HHmmss")
    name = F.when(F.length(from_path) > 0, percent_decode(from_path)).otherwise(
        F.concat(F.lit("document_"), stamp, F.lit(".pdf"))
    )
    if disposition is None:
        return name
    header = as_col(disposition)
    quoted = F.regexp_replace(F.element_at(F.split(header, "filename="), -1), "^[\"']+|[\"']+$", "")
    return F.when(F.coalesce(header.contains("filename="), F.lit(False)), percent_decode(quoted)).otherwise(name)


# Entities decoded in page text, in this order: "&amp;" last, so that "&amp;lt;" reads "&lt;".
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


# What becomes a blank in the text of a page, in this order, and how its blanks are joined. Read alike by Java and Python.
MARKUP = (r"(?s)<!--.*?-->", r"(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>", r"(?s)<[^>]+>")
BLANKS = r"[ \t\r\n\f]+"


def _decode_entities(value: Column) -> Column:
    for entity, char in ENTITIES:
        value = F.replace(value, F.lit(entity), F.lit(char))
    return value


def text_counts(text: Column | str) -> dict[str, Column]:
    """Characters, lines and paragraphs (parted by blank lines, blank ones left out) of a text."""
    value = as_col(text)
    paragraphs = F.filter(F.split(value, r"\n[ \t]*\n"), lambda part: F.length(F.trim(part, F.lit(" \t\n"))) > 0)
    return {
        "char_count": F.length(value).cast("long"),
        "line_count": (F.regexp_count(value, F.lit("\n")) + 1).cast("long"),
        "paragraph_count": F.size(paragraphs).cast("long"),
    }


def html_text(html: Column | str) -> Column:
    """Visible text of a page on one line."""
    value = as_col(html)
    for pattern in MARKUP:
        value = F.regexp_replace(value, pattern, " ")
    return F.trim(F.regexp_replace(_decode_entities(value), BLANKS, " "))


def html_title(html: Column | str) -> Column:
    raw = F.regexp_extract(as_col(html), r"(?is)<title[^>]*>(.*?)</title\s*>", 1)
    return F.trim(F.regexp_replace(_decode_entities(raw), BLANKS, " "))
