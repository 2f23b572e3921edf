"""Materialised indexes: token postings of a field, candidates by shared tokens, statistics.

Queries do not need them (fields are columns); they pay where one selective text
query is asked of a very large collection again and again. A postings table is
written partitioned by field and strategy and sorted by token, so a query reads
the few row groups that hold its tokens; Python then runs over candidates only.
"""

from __future__ import annotations

from functools import reduce
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import phonetic, text
from quern.plans.predicates import MATCH_SIMILARITY, And, Leaf, Or, fuzziness

STRATEGIES = ("string", "trigram", "soundex", "dmetaphone")


def tokens(field: Column, strategy: str) -> Column:
    """The array of tokens of a value."""
    field = field.cast("string")
    if strategy == "string":
        return F.array(field)
    if strategy == "trigram":
        return text.trigrams(field)
    if strategy == "soundex":
        return phonetic.soundex_codes(field)
    if strategy == "dmetaphone":
        return phonetic.dmetaphone_codes(field, alt=True)
    raise ValueError(f"unknown strategy {strategy!r}")


def query_tokens(query: str, strategy: str) -> list[str]:
    sound, meta = phonetic.query_codes(query)
    return {"string": [query], "trigram": text.trigrams_of(query), "soundex": sound, "dmetaphone": meta}[strategy]


def postings(df: DataFrame, field: str, strategy: str) -> DataFrame:
    """(field, strategy, token, path): one row for each distinct token of each document that has the field."""
    rows = df.where(F.col(field).isNotNull()).select("path", F.explode(F.array_distinct(tokens(F.col(field), strategy))).alias("token"))
    return rows.select(F.lit(field).alias("field"), F.lit(strategy).alias("strategy"), "token", "path")


def reindex(df: DataFrame, fields: dict[str, list[str]], folder: str, resume: bool = False) -> list[dict]:
    """Write the postings of the fields, each with its strategies; what was there of them is replaced.

    One folder for each index, complete when Spark has marked it so: with resume,
    complete ones stay and a run that was cut off goes on. Gives the progress:
    field, strategy, step, of, state (written or kept).
    """
    spark, due = df.sparkSession, [(f, s) for f, strategies in fields.items() for s in strategies]
    progress = []
    for k, (field, strategy) in enumerate(due, 1):
        target = f"{folder.rstrip('/')}/field={quote(field, safe='')}/strategy={strategy}"
        kept = resume and _exists(spark, f"{target}/_SUCCESS")
        if not kept:
            rows = postings(df, field, strategy).select("token", "path")
            rows.repartitionByRange("token", "path").sortWithinPartitions("token").write.mode("overwrite").parquet(target)
        progress.append({"field": field, "strategy": strategy, "step": k, "of": len(due), "state": "kept" if kept else "written"})
    return progress


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def refreshed(index: DataFrame, changed: DataFrame, removed: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """The postings after documents changed (rows of the collection) or went (path)."""
    gone = changed.select("path").unionByName(removed.select("path")).distinct()
    new = [postings(changed, f, s) for f, strategies in fields.items() for s in strategies]
    return reduce(DataFrame.unionByName, new, index.select("field", "strategy", "token", "path").join(gone, "path", "left_anti").select("field", "strategy", "token", "path"))


class Index:
    """Postings that queries read. They must cover the collection: reindex, or refresh, after it changes.

    Entries of documents that are gone do no harm: candidates only narrow what is read.
    """

    def __init__(self, rows: DataFrame):
        self.rows = rows
        self.kinds = {(r.field, r.strategy) for r in rows.select("field", "strategy").distinct().collect()}  # one row an index

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Index:
        return cls(spark.read.parquet(folder))

    def statistics(self) -> DataFrame:
        return statistics(self.rows)

    def _sharing(self, field: str, query: str, *strategies: str) -> DataFrame | None:
        """(path) of documents that share a token with the query by any of the strategies; None if one has no index."""
        if any((field, s) not in self.kinds for s in strategies):
            return None
        return reduce(DataFrame.unionByName, (candidates(self.rows, field, s, query).select("path") for s in strategies))

    def narrow(self, node) -> DataFrame | None:
        """(path), distinct: no row outside can fit the tree; None where the postings do not tell."""
        found = self._narrow(node)
        return None if found is None else found.distinct()

    def _narrow(self, node) -> DataFrame | None:
        if isinstance(node, Leaf):
            return self._leaf(node)
        if not isinstance(node, (And, Or)) or not node.children:
            return None
        known = [self._narrow(c) for c in node.children]
        if isinstance(node, Or):
            return None if any(k is None for k in known) else reduce(DataFrame.unionByName, known)
        known = [k for k in known if k is not None]
        return reduce(lambda a, b: a.join(b, "path", "left_semi"), known) if known else None

    def _leaf(self, leaf: Leaf) -> DataFrame | None:
        field, q = leaf.field, leaf.value
        if leaf.op == "eq":
            return self._sharing(field, q, "string") if isinstance(q, str) else None
        if leaf.op == "contains":
            inner = text.trigrams_inside(q)
            if not inner or (field, "trigram") not in self.kinds:
                return None
            return _holding(self.rows, field, "trigram", inner, len(inner)).select("path")
        if leaf.op == "similar":
            return self._sharing(field, q, "trigram") if text.trigrams_of(q) else None
        if leaf.op == "phonetic":
            return self._sharing(field, q, "soundex", "dmetaphone")
        if leaf.op == "fuzzy":
            near = leaf.option("require_candidate") or leaf.option("algorithm", "damerau_levenshtein") != "jaro_winkler" and _edits_share(q, fuzziness(leaf, q))
            return self._sharing(field, q, "trigram") if near and text.trigrams_of(q) else None
        if leaf.op == "match":
            return self._sharing(field, q, "trigram", "soundex", "dmetaphone") if MATCH_SIMILARITY >= 0 and _edits_share(q, text.auto_fuzziness(q)) else None
        return None


def _edits_share(query: str, edits: int) -> bool:
    """A text within so many edits keeps a trigram of the query: an edit or swap touches at most four windows, five to be sure."""
    return len(text.trigrams_of(query)) > 5 * edits


def _holding(index: DataFrame, field: str, strategy: str, wanted: list[str], least: int = 1) -> DataFrame:
    hit = index.where((F.col("field") == field) & (F.col("strategy") == strategy) & F.col("token").isin(*wanted))
    found = hit.groupBy("path").agg(F.count("*").alias("shared"))
    return found.where(F.col("shared") >= least) if least > 1 else found


def candidates(index: DataFrame, field: str, strategy: str, query: str, every: bool = False) -> DataFrame:
    """(path, shared): documents that share a token with the query (with every: all of them)."""
    wanted = query_tokens(query, strategy)
    return _holding(index, field, strategy, wanted, len(wanted) if every else 1)


def scan(index: DataFrame, field: str, low: str | None = None, high: str | None = None) -> DataFrame:
    """(token, path) of the string postings of a field from low to high, both included; None is open. Row groups outside are not read."""
    rows = index.where((F.col("field") == field) & (F.col("strategy") == "string"))
    rows = rows if low is None else rows.where(F.col("token") >= low)
    return (rows if high is None else rows.where(F.col("token") <= high)).select("token", "path")


def records(entries: DataFrame, df: DataFrame) -> DataFrame:
    """The rows of the collection that index entries (path) lead to; entries of documents that are gone lead nowhere."""
    return df.join(entries.select("path").distinct(), "path", "left_semi")


def statistics(index: DataFrame) -> DataFrame:
    """(field, strategy, entries, values, documents) of each index."""
    return index.groupBy("field", "strategy").agg(F.count("*").alias("entries"), F.count_distinct("token").alias("values"), F.count_distinct("path").alias("documents"))


def similar_pairs(df: DataFrame, field: str, by: str, threshold: float) -> DataFrame:
    """(a, b, score): pairs of documents with equal ``by`` whose trigram Dice score is at least the threshold, a before b.

    Prefix filtering: with the trigrams of a value ordered from the rarest, two
    values of n and m of them that score t share one among the first
    n - ceil(t n / (2 - t)) + 1 of each; only those rare ones are joined.
    """
    rows = df.where(F.col(field).isNotNull()).select("path", F.col(by).alias("by"), F.xxhash64(by, field).alias("value"), text.trigrams(F.col(field).cast("string")).alias("tokens")).where("size(tokens) > 0")
    # equal values are one: their pairs follow from the pairs of distinct values
    distinct = rows.groupBy("by", "value").agg(F.any_value("tokens").alias("tokens"))
    often = distinct.select("by", F.explode("tokens").alias("token")).groupBy("by", "token").agg(F.count("*").alias("n"))
    spread = distinct.select("by", "value", F.explode("tokens").alias("token")).join(often, ["by", "token"])
    ranked = spread.groupBy("by", "value").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "token"))), lambda x: x["token"]).alias("tokens"))
    size = F.size("tokens")
    first = F.slice("tokens", F.lit(1), (size - F.ceil(size * threshold / (2 - threshold)) + 1).cast("int"))
    heads = ranked.select("by", "value", "tokens", F.explode(first).alias("token"))
    a, b = heads.alias("a"), heads.alias("b")
    met = a.join(b, F.expr("a.by = b.by and a.token = b.token and a.value < b.value")).select(F.col("a.by").alias("by"), F.col("a.value").alias("v"), F.col("b.value").alias("w"), F.col("a.tokens").alias("t"), F.col("b.tokens").alias("u"))
    score = text.dice(F.col("t"), F.col("u"))
    linked = met.dropDuplicates(["by", "v", "w"]).select("by", "v", "w", score.alias("score")).where(F.col("score") >= threshold)
    same = distinct.select("by", F.col("value").alias("v"), F.col("value").alias("w"), F.lit(1.0).alias("score"))
    member = rows.select("by", "value", "path")
    every = linked.unionByName(linked.select("by", F.col("w").alias("v"), F.col("v").alias("w"), "score")).unionByName(same)
    left = every.join(member.select("by", F.col("value").alias("v"), F.col("path").alias("a")), ["by", "v"])
    return left.join(member.select("by", F.col("value").alias("w"), F.col("path").alias("b")), ["by", "w"]).where("a < b").select("a", "b", "score")
