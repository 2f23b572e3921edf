"""Listings, text ranges, batch fetch and tree metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import json_values, parsers, paths

MAX_RANGE_BYTES = 4 << 20


def recursive(files: DataFrame, base: str = "/", depth: int | None = None, glob: str | None = None, limit: int | None = None) -> DataFrame:
    """All files at or below base, at most ``depth`` levels down, whose name or path the glob fits."""
    stem = paths.normalise(base).rstrip("/")
    out = files.where(paths.under(F.col("path"), base))
    if depth is not None:
        out = out.where(F.size(F.split("path", "/")) - len(stem.split("/")) <= depth)
    if glob:
        out = out.where(paths.listing_glob(F.col("path"), base, glob))
    return out.orderBy("path").limit(limit) if limit is not None else out


def directory(files: DataFrame, base: str = "/", sort: str = "name", descending: bool = False, limit: int | None = None, offset: int = 0) -> DataFrame:
    """One level: name, is_dir, size, created_at, updated_at, n_files; directories first. Sizes of directories are sums."""
    stem = paths.normalise(base).rstrip("/")
    below = F.substring(F.col("path"), len(stem) + 2, 1 << 30)
    rows = files.where(F.col("path").startswith(stem + "/")).select(F.substring_index(below, "/", 1).alias("name"), F.contains(below, F.lit("/")).alias("is_dir"), "size", "created_at", "updated_at")
    out = rows.groupBy("name", "is_dir").agg(F.sum("size").alias("size"), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"), F.count("*").alias("n_files"))
    key = F.col(sort) if sort != "name" else F.lower("name")
    out = out.orderBy(F.col("is_dir").desc(), key.desc() if descending else key.asc(), "name")
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit is not None else out


def tree_metrics(files: DataFrame) -> DataFrame:
    """Files, directories (all ancestors but the root) and logical bytes."""
    dirs = files.select(F.explode(paths.ancestors(F.col("path"))).alias("d")).where("d <> '/'").agg(F.count_distinct("d").alias("directories"))
    return files.agg(F.count("*").alias("files"), F.sum("size").alias("logical_bytes")).crossJoin(dirs)  # one row each


def line_range(text: Column, first: int, last: int) -> Column:
    """Lines first to last, counted from 1, both included; line ends CRLF, CR or LF."""
    return F.array_join(F.slice(F.split(text, "\r\n|\r|\n"), first, max(0, last - first + 1)), "\n")


def char_range(text: Column, start: int, end: int) -> Column:
    """Characters from start (0-based) up to end."""
    return F.substring(text, start + 1, max(0, end - start))


def byte_range(content: Column, start: int, end: int) -> Column:
    return F.substring(content.cast("binary"), start + 1, max(0, end - start))


def http_range(content: Column, header: str) -> Column:
    """bytes=a-b, bytes=a- and bytes=-n."""
    kind, _, spec = header.partition("=")
    first, dash, last = spec.strip().partition("-")
    if kind.strip() != "bytes" or not dash or "," in spec or not (first or last) or not (first + last).isdigit():
        raise ValueError(f"bad range {header!r}")
    data = content.cast("binary")
    if not first:
        return F.when(F.octet_length(data) <= int(last), data).otherwise(F.substring(data, -int(last), int(last)))
    return F.substring(data, int(first) + 1, int(last) - int(first) + 1 if last else 1 << 30)


def truncate_utf8(text: Column, most: int = MAX_RANGE_BYTES) -> tuple[Column, Column]:
    """(text of at most ``most`` bytes that ends with a whole character, truncated)."""
    data = text.cast("binary")
    cut = F.substring(data, 1, most)
    whole = F.coalesce(*(F.try_validate_utf8(F.substring(data, 1, most - k).cast("string")) for k in range(4)))
    return F.when(F.octet_length(data) <= most, text).otherwise(F.when(F.is_valid_utf8(cut.cast("string")), cut.cast("string")).otherwise(whole)), F.octet_length(data) > most


def json_range(text: Column, pointer: str) -> Column:
    return json_values.pointer(text, pointer)


def fetch(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Answers to (path, if_content_hash, if_updated_at): status ok, missing or stale, and the body where it is ok."""
    both = requests.join(files.select("path", "content_hash", "updated_at", "body", F.lit(True).alias("_there")), "path", "left")
    stale = (F.col("if_content_hash").isNotNull() & (F.col("if_content_hash") != F.col("content_hash"))) | (F.col("if_updated_at").isNotNull() & (F.col("if_updated_at") != F.col("updated_at")))
    status = F.when(F.col("_there").isNull(), "missing").when(stale, "stale").otherwise("ok")
    return both.select("path", status.alias("status"), F.when(status == "ok", F.col("body")).alias("body"))


def text_statistics(files: DataFrame) -> DataFrame:
    meta = parsers.text_metadata(F.col("body"), F.col("filename"), F.col("content_type"))
    return files.select("path", *(c.alias(n) for n, c in meta.items()))
