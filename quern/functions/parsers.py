"""Text, HTML and XML parsers as column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Language of a text by content type, then by extension.
LANGUAGE_BY_TYPE = {"text/markdown": "markdown", "application/json": "json", "application/xml": "xml", "application/yaml": "yaml"}
LANGUAGE_BY_EXTENSION = {
    "md": "markdown", "rs": "rust", "js": "javascript", "mjs": "javascript", "py": "python", "ts": "typescript", "html": "html", "htm": "html", "css": "css", "json": "json",
    "yaml": "yaml", "yml": "yaml", "toml": "toml", "xml": "xml", "sql": "sql", "sh": "shell", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "java": "java", "go": "go",
}
BOM = "﻿"


def lines(text: Column) -> Column:
    """Lines as an array, without a last empty one."""
    parts = F.split(text, r"\r\n|\n")
    return F.when(text == "", F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def title(text: Column) -> Column:
    """The first line that is not blank, trimmed."""
    return F.regexp_extract(text, r"(?s)^\s*([^\r\n]*[^\s])", 1)


def language(filename: Column, content_type: Column) -> Column:
    by_type = F.create_map(*(F.lit(x) for kv in LANGUAGE_BY_TYPE.items() for x in kv))
    by_extension = F.create_map(*(F.lit(x) for kv in LANGUAGE_BY_EXTENSION.items() for x in kv))
    ext = F.regexp_extract(filename, r"\.([^.]+)$", 1)
    return F.coalesce(F.try_element_at(by_type, content_type), F.try_element_at(by_extension, ext), F.lit("plaintext"))


def text_metadata(text: Column, filename: Column, content_type: Column) -> dict[str, Column]:
    has_bom = text.startswith(BOM)
    text = F.regexp_replace(text, f"^{BOM}", "")
    return {
        "title": title(text),
        "line_count": F.size(lines(text)),
        "word_count": word_count(text),
        "char_count": F.length(text),
        "language": language(filename, content_type),
        "is_empty": F.trim(text) == "",
        "has_bom": has_bom,
    }


def is_html(text: Column) -> Column:
    return F.lower(text).rlike(r"<!doctype html|<html")


_NUMERIC = r"&#(?:x[0-9A-Fa-f]+|[0-9]+);"


def _sign(m: re.Match) -> str:
    body = m[0][2:-1]
    code = int(body[1:], 16) if body[0] == "x" else int(body)
    return chr(code) if code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else m[0]


@F.pandas_udf(T.StringType())
def _decode_numeric(values: pd.Series) -> pd.Series:
    return values.map(lambda v: re.sub(_NUMERIC, _sign, v), na_action="ignore")


def decode_entities(text: Column) -> Column:
    """amp, lt, gt, quot, apos and nbsp, and numbers; others stay. Only texts with numbers reach the UDF."""
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    numbers = text.rlike(_NUMERIC)
    text = F.when(numbers, _decode_numeric(F.when(numbers, text))).otherwise(text)
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def strip_tags(text: Column) -> Column:
    """Without comments, scripts and styles; each other tag is a blank; white space collapsed."""
    for pattern in (r"(?s)<!--.*?-->", r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?s)<[^>]*>"):
        text = F.regexp_replace(text, pattern, " ")
    return text


def html_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(decode_entities(strip_tags(text)), r"\s+", " "))


def _tidy(text: Column) -> Column:
    return F.trim(F.regexp_replace(strip_tags(text), r"\s+", " "))


def _meta(text: Column, name: str) -> Column:
    first = F.regexp_extract(text, rf"""(?is)<meta\b[^>]*\bname\s*=\s*["']{name}["'][^>]*\bcontent\s*=\s*["']([^"']*)["']""", 1)
    other = F.regexp_extract(text, rf"""(?is)<meta\b[^>]*\bcontent\s*=\s*["']([^"']*)["'][^>]*\bname\s*=\s*["']{name}["']""", 1)
    return F.nullif(F.coalesce(F.nullif(first, F.lit("")), other), F.lit(""))


def html_metadata(text: Column) -> dict[str, Column]:
    headings = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]\s*>"), 1), _tidy), lambda h: h != "")
    found = F.nullif(_tidy(F.regexp_extract(text, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)), F.lit(""))
    return {
        "title": F.coalesce(found, F.get(headings, 0), F.lit("")),
        "description": _meta(text, "description"),
        "keywords": _meta(text, "keywords"),
        "headings": headings,
        "link_count": F.regexp_count(text, F.lit(r"(?i)<a[ >]")),
        "text": html_text(text),
    }


def xml_metadata(text: Column) -> dict[str, Column]:
    spaces = F.regexp_extract_all(text, F.lit(r"""\bxmlns(?::\w+)?\s*=\s*["']([^"']*)["']"""), 1)
    return {"root_element": F.nullif(F.regexp_extract(text, r"<([A-Za-z_][\w.:-]*)", 1), F.lit("")), "namespaces": F.array_distinct(spaces)}
