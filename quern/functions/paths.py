"""Paths: normalisation, parts, globs. Column forms stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(path: str) -> str:
    """Without NULs and surrounding blanks; slashes collapsed; . and .. resolved; the root is /."""
    out: list[str] = []
    for part in path.replace("\0", "").strip().split("/"):
        if part == "..":
            out = out[:-1]
        elif part not in ("", "."):
            out.append(part)
    return "/" + "/".join(out)


def normalise_column(path: Column) -> Column:
    parts = F.filter(F.split(F.trim(F.replace(path, F.lit("\0"), F.lit(""))), "/"), lambda p: ~p.isin("", "."))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda done, p: F.when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, p)))
    return F.concat(F.lit("/"), F.array_join(walked, "/"))


def parent(path: Column) -> Column:
    """The directory of a path; the root's is the root."""
    return F.when(path == "/", F.lit("/")).otherwise(F.coalesce(F.nullif(F.regexp_replace(path, "/[^/]*$", ""), F.lit("")), F.lit("/")))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(name: Column) -> Column:
    """What follows the last dot, or the empty text without a dot."""
    return F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1)).otherwise(F.lit(""))


def under(path: Column, base: str) -> Column:
    """The path is base or lies below it: a prefix predicate, which reaches the Parquet scan."""
    base = normalise(base)
    return F.lit(True) if base == "/" else (path == base) | path.startswith(base + "/")


def glob_regex(pattern: str) -> str:
    """* is any run within a segment, ** any run, ? one sign of a segment."""
    out, k = [], 0
    while k < len(pattern):
        if pattern.startswith("**/", k):
            out.append("(?:.*/)?")
            k += 3
        elif pattern.startswith("**", k):
            out.append(".*")
            k += 2
        else:
            c = pattern[k]
            out.append({"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c))
            k += 1
    return "^" + "".join(out) + "$"


def glob_match(path: Column, pattern: str) -> Column:
    return path.rlike(glob_regex(pattern))


def listing_glob(path: Column, base: str, pattern: str) -> Column:
    """The glob fits the name, the path relative to base, or the whole path."""
    base = normalise(base).rstrip("/") + "/"
    relative = F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 30)).otherwise(path)
    return glob_match(file_name(path), pattern) | glob_match(relative, pattern) | glob_match(path, pattern)


def ancestors(path: Column) -> Column:
    """['/', '/a', '/a/b', ...]: the directories above a path, root first."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    n = F.greatest(F.size(parts) - 1, F.lit(0))
    below = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, k), "/")))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.lit("/")), below)
