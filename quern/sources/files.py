"""Files in and out: folders of documents, backups, archives, parser dispatch."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import binary_parsers, parsers, paths
from quern.operators import storage


def read_folder(spark: SparkSession, folder: str, glob: str | None = None, base: str = "/") -> DataFrame:
    """Every file below a folder as a row: path, filename, extension, content_type, size, times, content_hash, content."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).load(folder)
    at = F.substring_index(F.col("path"), folder.rstrip("/") + "/", -1)
    path = F.concat(F.lit(paths.normalise(base).rstrip("/") + "/"), at)
    name = paths.file_name(path)
    stamp = F.unix_millis("modificationTime")
    return rows.select(path.alias("path"), name.alias("filename"), paths.extension(name).alias("extension"), storage.content_type(F.col("content")).alias("content_type"), F.col("length").alias("size"), stamp.alias("created_at"), stamp.alias("updated_at"), storage.content_hash(F.col("content")).alias("content_hash"), "content")


def store(files: DataFrame, folder: str, mode: str = "append") -> None:
    """Files as zstd-compressed Parquet, one folder for each top directory, so that path predicates prune."""
    top = F.coalesce(F.nullif(F.get(F.split("path", "/"), 1), F.lit("")), F.lit("_root"))
    files.withColumn("top", top).write.mode(mode).option("compression", "zstd").partitionBy("top").parquet(folder)


def export_backup(store_: DataFrame, folder: str, version: str | None = None) -> None:
    """All versions, or one."""
    (store_ if version is None else store_.where(F.col("version") == version)).write.mode("errorifexists").parquet(folder)


def import_backup(spark: SparkSession, folder: str, current: DataFrame | None = None, mode: str = "restore") -> DataFrame:
    """restore: the backup alone; merge: the later row of each path (and version), ties to the greater hash."""
    backup = spark.read.parquet(folder)
    if mode == "restore" or current is None:
        return backup
    if mode != "merge":
        raise ValueError("mode is restore or merge")
    keys = [c for c in ("version", "path") if c in backup.columns]
    rest = [c for c in backup.columns if c not in keys]
    both = current.select(*backup.columns).unionByName(backup)
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("updated_at", "content_hash")).alias("_r"))
    return last.select(*keys, "_r.*").select(*backup.columns)


def write_archives(files: DataFrame, archives: int) -> DataFrame:
    """(archive, zip): the files (path, content) dealt to so many ZIP archives by path; an archive is one task's, so choose enough of them."""
    schema = pa.schema([("archive", pa.int32()), ("zip", pa.binary())])

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for path, body in zip(pdf["path"], pdf["content"], strict=True):
                z.writestr(path.lstrip("/"), bytes(body) if body is not None else b"")
        return pd.DataFrame({"archive": [int(pdf["archive"].iloc[0])], "zip": [out.getvalue()]}, columns=schema.names)

    dealt = files.select("path", F.col("content").cast("binary").alias("content"), F.pmod(F.xxhash64("path"), F.lit(archives)).cast("int").alias("archive"))
    return dealt.groupBy("archive").applyInPandas(pack, "archive int, zip binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """(path, content) of every file in ZIP archives (column zip)."""
    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])

    def unpack(batches):
        for batch in batches:
            for value in batch.column(0):
                with zipfile.ZipFile(io.BytesIO(value.as_py())) as z:
                    for info in z.infolist():  # a file at a time: an archive may be large
                        yield pa.RecordBatch.from_arrays([pa.array([info.filename]), pa.array([z.read(info)], pa.binary())], schema=schema)

    return archives.select("zip").mapInArrow(unpack, "path string, content binary")


def parsed(files: DataFrame) -> DataFrame:
    """(path, title, text, metadata as JSON): text and HTML by column expressions, binary formats by their parsers."""
    kinds = [e for e in binary_parsers.FORMATS]
    binary = files.where(F.lower("extension").isin(kinds))
    texts = files.where(~F.lower("extension").isin(kinds)).withColumn("body", F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))).where("body is not null")
    markup = F.lower("extension").isin("html", "htm", "xhtml") | F.col("content_type").isin("text/html", "application/xhtml+xml")
    html = texts.where(markup)
    about = parsers.html_metadata(F.col("body"))
    html = html.select("path", about["title"].alias("title"), about["text"].alias("text"), F.to_json(F.struct(*(c.alias(n) for n, c in about.items() if n not in ("title", "text")))).alias("metadata"))
    plain = parsers.text_metadata(F.col("body"), F.col("filename"), F.col("content_type"))
    text = texts.where(~markup).select("path", plain["title"].alias("title"), F.col("body").alias("text"), F.to_json(F.struct(*(c.alias(n) for n, c in plain.items() if n != "title"))).alias("metadata"))
    return html.unionByName(text).unionByName(binary_parsers.parse_files(binary).select("path", "title", "text", "metadata"))


class Host:
    """What a user's query function may ask: collections, of which it sees the rows that its caller may read."""

    def __init__(self, spark: SparkSession, catalog, source: str | DataFrame, permissions: DataFrame, groups: list[str]):
        self.spark, self.catalog, self.source, self.permissions, self.groups = spark, catalog, source, permissions, groups

    def query(self, path: str, request: dict) -> DataFrame:
        """A page of a collection; access filters before conditions and limits."""
        from quern.operators import access
        from quern.plans import query

        readable = access.filter_readable(self.catalog.at(path).load(self.spark, self.source), self.permissions, self.groups)
        return query.rows(readable, query.Request.from_json(request))


class Functions:
    """Named functions of a user: parsers (binary -> JSON), mappers of field values, query functions, static methods of Java classes.

    Parsers are found by their name or by the content type that they are given for.
    """

    def __init__(self):
        self.types: dict[str, str] = {}
        self.natives: dict[str, tuple[str, str]] = {}
        self.parsers: dict[str, Callable[[bytes], dict]] = {}
        self.mappers: dict[str, Callable[[object], object]] = {}
        self.queries: dict[str, Callable] = {}

    def parser(self, name: str, content: Column) -> Column:
        function = self.parsers[name]

        @F.pandas_udf("string")
        def run(values: pd.Series) -> pd.Series:
            return values.map(lambda v: json.dumps(function(bytes(v))), na_action="ignore")

        return run(content)

    def parser_of(self, content_type: str) -> str | None:
        """The parser of a content type: its own, or that of its main type (as "text/*")."""
        return self.types.get(content_type) or self.types.get(content_type.split("/")[0] + "/*")

    def parse(self, files: DataFrame, content: str = "content") -> DataFrame:
        """files with column parsed (JSON) by the parser of their content type; null where there is none."""
        out = F.lit(None).cast("string")
        for kind, name in self.types.items():
            fits = F.col("content_type").startswith(kind[:-1]) if kind.endswith("/*") else F.col("content_type") == kind
            mine = fits if not kind.endswith("/*") else fits & ~F.col("content_type").isin(*(k for k in self.types if not k.endswith("/*")))
            out = F.coalesce(out, self.parser(name, F.when(mine, F.col(content).cast("binary"))))
        return files.withColumn("parsed", out)

    def native(self, name: str, *args: Column) -> Column:
        """A static method of a class in the JVM, by (class, method); null where it fails. No Python process takes part."""
        return F.call_function("try_reflect", *map(F.lit, self.natives[name]), *args)

    def mapper(self, name: str, value: Column, result: str = "string") -> Column:
        function = self.mappers[name]

        @F.pandas_udf(result)
        def run(values: pd.Series) -> pd.Series:
            return values.map(function, na_action="ignore")

        return run(value)

    def query(self, name: str, *args, **options) -> DataFrame:
        return self.queries[name](*args, **options)
