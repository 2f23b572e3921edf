"""The queries opN_<name> and their SQL: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import oracles


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm import decontaminate

    hits = decontaminate.benchmark_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    n = F.size("item_ids").cast("long")
    return hits.select("doc_id", "n_words", "n_hit", n.alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (n >= 2).alias("contaminated"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm import packing

    return packing.pack(_table(spark, sf_dir, "documents"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm import quality
    from quern.llm.common import bucket

    docs, held_out = _table(spark, sf_dir, "documents"), bucket(F.col("doc_id"), 5) == 0
    model = quality.fit(docs, _table(spark, sf_dir, "labels"), ~held_out)
    scored = quality.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm import language
    from quern.llm.common import bucket

    docs, held_out = _table(spark, sf_dir, "documents"), bucket(F.col("doc_id"), 4) == 2
    net = language.fit(docs, ~held_out)
    return language.identify(docs, net).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm import token_counts

    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm import jaccard

    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"), width=3, percent=90)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm import pii

    def digest(spans: str):
        return F.expr(f"array_join(transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")

    found = pii.find_pii(_table(spark, sf_dir, "documents"))
    counts = [F.expr(f"size(filter(base, x -> x.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(digest("base").cast("binary"), 256).alias("base_sha256"), digest("spans").alias("spans"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm import suffixes

    found = suffixes.repeated_passages(_table(spark, sf_dir, "documents"))
    words = [F.expr(f"aggregate({c}, 0L, (n, x) -> n + x.end - x.start)").alias(n) for c, n in (("spans", "n_words"), ("later", "n_removed"))]
    return found.select("doc_id", F.size("spans").cast("long").alias("n_spans"), *words, "spans", "later", "kept_in")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm import sentence_spans

    found = sentence_spans.repeated_spans(_table(spark, sf_dir, "documents"), min_words=1)
    chars = F.expr("aggregate(spans, 0L, (n, x) -> n + x.end - x.start)")
    return found.select("doc_id", F.size("spans").cast("long").alias("n_spans"), chars.alias("n_removed"), "spans", "kept_in")


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm import neardup_graph

    return neardup_graph.near_duplicates(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_language_id, op3_ngram_jaccard_join, op4_suffix_array_dedup, op5_benchmark_decontamination, op6_packing, op7_pii, op8_embedding_near_dedup, op9_substring_dedup, op10_token_counts)}

#: The others have models, tokenizers or choices of their own; the tests hold them against brute force.
ORACLES = {"op3_ngram_jaccard_join": oracles.OP3, "op5_benchmark_decontamination": oracles.OP5, "op8_embedding_near_dedup": oracles.OP8}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
