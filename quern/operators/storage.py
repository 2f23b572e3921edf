"""Content-addressed storage as DataFrames: chunks, missing chunks, dedup figures, sync."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import paths

CHUNK_BYTES = 262_144
# What the type of compressed content contains, and the least size worth compressing.
COMPRESSED_TYPES = ("image/jpeg", "image/png", "image/gif", "image/webp", "video/", "audio/", "zip", "compressed", "zstd")
LEAST_COMPRESSED_BYTES = 500


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def chunks(files: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    """(path, n, chunk_hash, bytes): fixed-size pieces of each body."""
    data = F.col("body").cast("binary")
    count = F.greatest(F.ceil(F.octet_length(data) / size), F.lit(1)).cast("int")
    rows = files.select("path", data.alias("data"), F.explode(F.sequence(F.lit(0), count - 1)).alias("n"))
    piece = F.expr(f"substring(data, n * {size} + 1, {size})")
    return rows.select("path", "n", F.sha2(piece, 256).alias("chunk_hash"), F.octet_length(piece).cast("long").alias("bytes"))


def missing(offered: DataFrame, stored: DataFrame, key: str = "content_hash") -> DataFrame:
    """Hashes that the store lacks."""
    return offered.select(key).distinct().join(stored.select(key), key, "left_anti")


def commit(store: DataFrame, uploaded: DataFrame, key: str = "content_hash") -> DataFrame:
    """The store with what was uploaded and is new."""
    return store.unionByName(uploaded.dropDuplicates([key]).join(store.select(key), key, "left_anti").select(*store.columns))


def dedup_figures(files: DataFrame) -> DataFrame:
    """Files, distinct contents, logical and stored bytes, and their ratio."""
    per = files.groupBy("content_hash").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    logical, stored = F.sum(F.col("n") * F.col("size")), F.sum("size")
    return per.agg(F.sum("n").alias("files"), F.count("*").alias("contents"), logical.alias("logical_bytes"), stored.alias("stored_bytes"), F.round(1 - stored / logical, 6).alias("savings"))


def sync_diff(mine: DataFrame, theirs: DataFrame, globs: list[str] | None = None) -> DataFrame:
    """Their rows that I lack or have otherwise, below the given globs."""
    wanted = theirs
    if globs:
        fits = F.lit(False)
        for g in globs:
            fits = fits | paths.glob_match(F.col("path"), g)
        wanted = theirs.where(fits)
    return wanted.join(mine.select("path", "content_hash"), ["path", "content_hash"], "left_anti")


def should_compress(size: Column, content_type: Column) -> Column:
    return (size >= LEAST_COMPRESSED_BYTES) & ~F.lower(F.coalesce(content_type, F.lit(""))).rlike("|".join(COMPRESSED_TYPES))


ZSTD_LEVEL = 1


def by_hash(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """The files with the given content (content_hash): the hash is a column, so the filter prunes row groups."""
    return files.join(hashes.select("content_hash").distinct(), "content_hash", "left_semi").select(*files.columns)


def packed(files: DataFrame, content: str = "content") -> DataFrame:
    """files with their content in column stored: zstd where should_compress() says so and it gets smaller; compressed tells which."""
    import zstandard

    @F.pandas_udf("binary")
    def pack(values: pd.Series) -> pd.Series:
        compressor = zstandard.ZstdCompressor(level=ZSTD_LEVEL)
        return values.map(lambda v: compressor.compress(bytes(v)), na_action="ignore")

    data = F.col(content).cast("binary")
    tried = files.withColumn("_zstd", pack(F.when(should_compress(F.octet_length(data), F.col("content_type")), data)))
    smaller = F.coalesce(F.octet_length("_zstd") < F.octet_length(data), F.lit(False))
    return tried.withColumn("compressed", smaller).withColumn("stored", F.when(smaller, F.col("_zstd")).otherwise(data)).drop("_zstd", content)


def unpacked(stored: DataFrame, content: str = "content") -> DataFrame:
    """The reverse of packed()."""
    import zstandard

    @F.pandas_udf("binary")
    def unpack(values: pd.Series) -> pd.Series:
        return values.map(lambda v: zstandard.ZstdDecompressor().decompress(bytes(v)), na_action="ignore")

    plain = F.when(F.col("compressed"), unpack(F.when(F.col("compressed"), F.col("stored")))).otherwise(F.col("stored"))
    return stored.withColumn(content, plain).drop("compressed", "stored")


def content_type(content: Column) -> Column:
    """By magic bytes, then text if the first 8 KB are UTF-8 without control signs, else octets."""
    # Leading bytes of formats.
    magic = [("89504E47", "image/png"), ("FFD8FF", "image/jpeg"), ("47494638", "image/gif"), ("25504446", "application/pdf"), ("504B0304", "application/zip"), ("1F8B", "application/gzip"), ("28B52FFD", "application/zstd"), ("424D", "image/bmp"), ("4F676753", "audio/ogg"), ("494433", "audio/mpeg"), ("664C6143", "audio/flac"), ("1A45DFA3", "video/webm")]
    data = content.cast("binary")
    # a character that the 8 KB cut does not count
    head = F.coalesce(*(F.try_validate_utf8(F.substring(data, 1, n).cast("string")) for n in (8192, 8191, 8190, 8189)), F.lit(""))
    out = F.when(~head.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]") & (head != ""), "text/plain").otherwise("application/octet-stream")
    for lead, kind in reversed(magic):
        out = F.when(F.startswith(F.hex(F.substring(data, 1, 8)), F.lit(lead)), kind).otherwise(out)
    return out
