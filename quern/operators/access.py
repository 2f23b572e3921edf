"""Access: permissions folded over directory levels, rules of API keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import paths
from quern.sources.shared import small_side

#: The letters of the eight operations.
FLAGS = "crudlify"


def _has(flags: str, letter: str) -> Column:
    return F.coalesce(F.contains(F.col(flags), F.lit(letter)), F.lit(False))


def effective(files: DataFrame, permissions: DataFrame, groups: list[str], letter: str = "r") -> DataFrame:
    """(path, allowed) for a member of the groups.

    permissions: (level, group, allow, deny, others_allow, others_deny, pattern).
    Levels fold from the root down: a level's allow sets, its deny clears and wins
    there; members take allow and deny, others the others_ pair; a pattern holds
    only for that file name directly in the level.
    """
    member = F.col("group").isin(*groups) if groups else F.lit(False)
    links = permissions.select(
        "level", "pattern",
        F.when(member, _has("allow", letter)).otherwise(_has("others_allow", letter)).alias("a"),
        F.when(member, _has("deny", letter)).otherwise(_has("others_deny", letter)).alias("d"),
    ).where("a or d")
    levels = files.select("path", F.posexplode(paths.ancestors(F.col("path"))).alias("depth", "level"))
    # the links are few: by broadcast, "/" and other levels of many files are no hot keys
    hit = levels.join(small_side(links), "level").where(F.col("pattern").isNull() | ((F.col("level") == paths.parent(F.col("path"))) & (F.col("pattern") == paths.file_name(F.col("path")))))
    per_level = hit.groupBy("path", "depth").agg(F.max("d").alias("d"))
    decided = per_level.groupBy("path").agg((~F.max_by("d", "depth")).alias("allowed"))
    return files.select("path").join(decided, "path", "left").select("path", F.coalesce("allowed", F.lit(False)).alias("allowed"))


def navigable(directories: DataFrame, allowed: DataFrame) -> DataFrame:
    """Directories (path) on the way to an allowed file: they may be read and listed."""
    way = allowed.where("allowed").select(F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct()
    return directories.join(way, "path", "left_semi")


def filter_readable(files: DataFrame, permissions: DataFrame, groups: list[str]) -> DataFrame:
    """The files that may be read; before any limit, so that pages are full."""
    return files.join(effective(files.select("path"), permissions, groups).where("allowed"), "path", "left_semi")


def first_rule(path: Column, rules: list[tuple[str, str]]) -> Column:
    """The flags of the first (glob, flags) that fits; none: no flags."""
    out = F.lit("")
    for glob, flags in reversed(rules):
        out = F.when(paths.glob_match(path, glob), flags).otherwise(out)
    return out


def on_shared_path(path: Column, rules: list[tuple[str, str]]) -> Column:
    """The path leads to, or lies below, a rule's fixed part."""
    out = F.lit(False)
    for glob, _ in rules:
        if glob != "**":
            fixed = glob.rstrip("/").removesuffix("**").rstrip("/")
            out = out | (path == fixed) | path.startswith(fixed + "/") | F.startswith(F.lit(fixed), F.concat(F.when(path == "/", F.lit("")).otherwise(path), F.lit("/")))
    return out


def combine_rules(decisions: DataFrame, key: str = "path") -> DataFrame:
    """deny beats redact beats allow; without a decision it is allow."""
    rank = F.when(F.col("decision") == "deny", 2).when(F.col("decision") == "redact", 1).otherwise(0)
    worst = decisions.groupBy(key).agg(F.max(rank).alias("_r"))
    return worst.select(key, F.when(F.col("_r") == 2, "deny").when(F.col("_r") == 1, "redact").otherwise("allow").alias("decision"))
