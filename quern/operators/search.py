"""Search over collections, and where its hits stand in a text."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import paths
from quern.plans import predicates
from quern.plans.collections import Catalog
from quern.plans.query import Request, matches

MOST_RESULTS, MOST_LOCATORS = 1000, 50


def _fields(node) -> set[str]:
    if isinstance(node, predicates.Leaf):
        return {node.field}
    return _fields(node.child) if isinstance(node, predicates.Not) else set().union(*map(_fields, node.children), set())


def hits(spark: SparkSession, catalog: Catalog, source: str, base: str = "/", query: str | None = None, where=None) -> DataFrame:
    """(path, source, score, matched_by, fields): one row per file with its best score; a query goes before a where clause."""
    found = []
    for c in catalog.below(base):
        if query is not None:
            for f in c.text_fields:
                df = matches(c.load(spark, source), Request(predicates.Leaf(f, "match", query)))
                found.append(df.select("path", F.lit(c.path).alias("source"), "score", "matched_by", F.array(F.lit(f)).alias("fields")))
        elif where is not None:
            node, df = predicates.parse(where), c.load(spark, source)
            if all(f in df.columns or f.startswith("@") for f in _fields(node)):
                names = sorted(f for f in _fields(node))
                found.append(matches(df, Request(node)).select("path", F.lit(c.path).alias("source"), "score", "matched_by", F.array(*map(F.lit, names)).cast("array<string>").alias("fields")))
        else:
            raise predicates.QueryError("a search needs a query or a where clause")
    if not found:
        return spark.createDataFrame([], "path string, source string, score double, matched_by array<string>, fields array<string>")
    every = reduce(lambda a, b: a.unionByName(b), found).where(paths.under(F.col("path"), base))
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return every.groupBy("path").agg(F.min("source").alias("source"), F.max("score").alias("score"), flat("matched_by").alias("matched_by"), flat("fields").alias("fields"))


def search(spark: SparkSession, catalog: Catalog, source: str, base: str = "/", query: str | None = None, where=None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Hits by score, then path."""
    ordered = hits(spark, catalog, source, base, query, where).orderBy(F.desc("score"), "path")
    return (ordered.offset(offset) if offset else ordered).limit(min(limit, MOST_RESULTS))


def terms(node) -> list[str]:
    """The texts of a tree that locators look for: none under not, none of ranges, the first of a list."""
    if isinstance(node, predicates.Not):
        return []
    if isinstance(node, predicates.Leaf):
        if node.op in ("gt", "lt", "between"):
            return []
        value = (node.value[0] if node.value else None) if node.op == "in" else node.value
        return [str(value)] if value not in (None, "") else []
    return list(dict.fromkeys(t for c in node.children for t in terms(c)))


def first_hit(text: Column, term: str) -> Column:
    """Offset (characters from 0) of the first place of a term, letter case aside; null without one."""
    at = F.locate(term.lower(), F.lower(text))
    return F.when(at > 0, at - 1)


def snippet(text: Column, start: Column, length: int, width: int = 160) -> dict[str, Column]:
    """Text around a hit, and whether it was cut on either side."""
    width = min(4096, max(16, width))
    begin = F.greatest(start - (width - length) // 2, F.lit(0)).cast("int")
    return {"snippet": F.substring(text, begin + 1, F.lit(width)), "truncated_before": begin > 0, "truncated_after": begin + width < F.length(text)}


def line_and_column(text: Column, start: Column) -> tuple[Column, Column]:
    """Line and column (both from 1) of a character offset."""
    before = F.substring(text, F.lit(1), start.cast("int"))
    return F.size(F.split(before, "\n")), start - F.length(before) + F.length(F.substring_index(before, "\n", -1)) + 1


LOCATOR = "array<struct<term:string,start_char:int,end_char:int,start_byte:int,end_byte:int,line:int,column:int>>"


def locators(text: Column, wanted: list[str], most: int = 5) -> Column:
    """Up to ``most`` hits of any of the terms, by place. For the rows of one final page: it runs in Python."""
    most, low = min(most, MOST_LOCATORS), [(t, t.lower()) for t in wanted]

    def places(value: str) -> list[dict]:
        folded, out = value.lower(), []
        if len(folded) != len(value):  # lower-casing moved offsets: fold letter by letter
            folded = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
        for t, l in low:
            at = folded.find(l)
            while at >= 0 and len(out) < most * len(low):
                out.append((at, t, at + len(l)))
                at = folded.find(l, at + max(1, len(l)))
        rows = []
        for a, t, b in sorted(out)[:most]:
            line_start = value.rfind("\n", 0, a) + 1
            rows.append({"term": t, "start_char": a, "end_char": b, "start_byte": len(value[:a].encode()), "end_byte": len(value[:b].encode()), "line": value.count("\n", 0, a) + 1, "column": a - line_start + 1})
        return rows

    @F.pandas_udf(LOCATOR)
    def run(values: pd.Series) -> pd.Series:
        return values.map(places, na_action="ignore")

    return run(text)


def _leaves(node) -> list:
    """The conditions of a tree outside any not."""
    if isinstance(node, predicates.Leaf):
        return [node]
    return [] if isinstance(node, predicates.Not) else [x for c in node.children for x in _leaves(c)]


def field_locators(found: DataFrame, node, fetch: str) -> DataFrame:
    """(path, field, term, value, fetch): for each row, which metadata, columns and JSON fields hold the terms of the tree.

    value is the field's text; fetch names the collection to ask for the row. Terms
    of eq and in must be the value, others be inside it, letter case aside.
    """
    parts = []
    for leaf in _leaves(node):
        for term in terms(leaf):
            value = predicates.field_column(found, leaf.field).cast("string")
            holds = value == term if leaf.op in ("eq", "in") else F.contains(F.lower(value), F.lit(term.lower()))
            parts.append(F.when(holds, F.struct(F.lit(leaf.field).alias("field"), F.lit(term).alias("term"), value.alias("value"))))
    if not parts:
        return found.select("path", F.lit("").alias("field"), F.lit("").alias("term"), F.lit("").alias("value"), F.lit(fetch).alias("fetch")).limit(0)
    rows = found.select("path", F.explode(F.array_compact(F.array(*parts))).alias("l"))
    return rows.select("path", "l.field", "l.term", "l.value", F.lit(fetch).alias("fetch"))
