"""Collections: a directory of documents described over a table.

A collection's rows have the metadata columns of every file (path, filename,
extension, content_type, size, created_at, updated_at, content_hash, body) and
typed fields. All are lazy expressions: what a query does not use is pruned.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import paths

METADATA = ("path", "filename", "extension", "content_type", "size", "created_at", "updated_at", "content_hash")
#: names of metadata fields in queries
VIRTUAL = {f"@{m}": m for m in METADATA} | {"@file_name": "filename", "@hash": "content_hash"}
CONTENT_TYPES = {"json": "application/json", "txt": "text/plain", "html": "text/html"}


@dataclass(frozen=True)
class Collection:
    """path: its directory. table: file it is read from. name: expression of a file's path below the directory.

    fields: name -> SQL expression or function of the table; None takes all
    columns as they are. body: expression of the content. text_fields: fields
    that the broad search reads.
    """

    path: str
    table: str
    name: str
    fields: dict[str, str | Callable[[DataFrame], Column]] | None = None
    body: str | None = None
    created: str | None = None
    text_fields: tuple[str, ...] = ()
    extra: dict[str, str] = field(default_factory=dict)

    def load(self, spark: SparkSession, source: str | DataFrame) -> DataFrame:
        """source: a folder of Parquet tables, or the table itself."""
        rows = spark.read.parquet(f"{source}/{self.table}.parquet") if isinstance(source, str) else source
        own = self.fields if self.fields is not None else {c: c for c in rows.columns}
        fields = {n: (F.expr(e) if isinstance(e, str) else e(rows)) for n, e in own.items()} | {n: F.expr(e) for n, e in self.extra.items()}
        body = F.expr(self.body) if self.body else F.to_json(F.struct(*rows.columns))
        path = F.concat(F.lit(self.path + "/"), F.expr(self.name))
        name = F.substring_index(path, "/", -1)
        ext = paths.extension(name)
        kinds = F.create_map(*(F.lit(x) for kv in CONTENT_TYPES.items() for x in kv))
        made = F.unix_millis(F.expr(self.created).cast("timestamp")) if self.created else F.lit(0).cast("long")
        meta = {
            "path": path, "filename": name, "extension": ext, "content_type": F.coalesce(F.try_element_at(kinds, ext), F.lit("application/octet-stream")),
            "size": F.octet_length(body).cast("long"), "created_at": made, "updated_at": made, "content_hash": F.sha2(body.cast("binary"), 256), "body": body,
        }
        clash = set(meta) & set(fields)
        return rows.select(*(c.alias(n) for n, c in meta.items()), *(c.alias(n) for n, c in fields.items() if n not in clash))


class Catalog:
    def __init__(self, *collections: Collection):
        self.by_path = {c.path: c for c in collections}

    def at(self, path: str) -> Collection:
        """The collection that owns a path: itself or its nearest ancestor."""
        path = paths.normalise(path)
        while path not in self.by_path and path != "/":
            path = path.rsplit("/", 1)[0] or "/"
        if path not in self.by_path:
            raise LookupError(f"no collection at {path}")
        return self.by_path[path]

    def below(self, base: str) -> list[Collection]:
        """Collections at or under base, and those that own it."""
        base = paths.normalise(base)
        stem = base.rstrip("/") + "/"
        return [c for p, c in sorted(self.by_path.items()) if p == base or p.startswith(stem) or base.startswith(p + "/")]


def standard() -> Catalog:
    """The collections over the TPC-H-like tables and the text tables."""
    return Catalog(
        Collection("/regions", "region", "concat(r_regionkey, '.json')", text_fields=("r_name",)),
        Collection("/nations", "nation", "concat(n_nationkey, '.json')", text_fields=("n_name",)),
        Collection("/customers", "customer", "concat(c_custkey, '.json')", text_fields=("c_name",)),
        Collection("/suppliers", "supplier", "concat(s_suppkey, '.json')", text_fields=("s_name",)),
        Collection("/parts", "part", "concat(p_partkey, '.json')", text_fields=("p_name",)),
        Collection("/orders", "orders", "concat(o_orderkey, '.json')", created="o_orderdate"),
        Collection("/lineitems", "lineitem", "concat_ws('-', l_orderkey, l_partkey, l_suppkey, concat(l_linenumber, '.json'))", created="l_shipdate"),
        Collection("/events", "events", "concat(event_id, '.json')", created="ts"),
        Collection("/documents", "documents", "concat(coalesce(source, 'none'), '/', doc_id, '.txt')", body="text"),
        Collection("/pages", "pages", "concat(page_id, '.html')", body="html"),
        Collection("/conversations", "conversations", "concat(conv_id, '/', turn, '.json')", text_fields=()),
    )
