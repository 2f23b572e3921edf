"""More registered queries: types and JSON, indexes, files and formats, versions, access, events, tasks, user functions."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.catalogue import CUSTOMER, DOCUMENT, EVENT, ORDER, PAGE, PART, _trigrams, asked, collection, event_rows, found, registered
from quern.functions import binary_parsers, json_values, parsers, scalars, text
from quern.operators import access, bitmaps, indexes, listing, search, storage, tasks, versions
from quern.plans import query
from quern.plans.builder import Field, Query, all_of, any_of, none_of
from quern.plans.collections import Collection, standard
from quern.plans.predicates import QueryError, parse
from quern.plans.query import Request
from quern.sources import files
from quern.sources.shared import shared_folder
from quern.streaming import events as event_streams


def _table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fresh(spark, name: str) -> str:
    """A new folder that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- literals of other types, JSON fields -----------------------------------


@registered(f"SELECT {CUSTOMER} AS path, c_nationkey FROM customer WHERE c_nationkey = 1")
def filter_type_mismatch(spark, sf_dir):
    """Literals of another kind find nothing, and nothing aborts."""
    where = {"or": [{"field": "c_nationkey", "op": "eq", "value": "abc"}, {"field": "c_name", "op": "eq", "value": 5}, {"field": "c_name", "op": "gt", "value": 5}, {"field": "c_nationkey", "op": "in", "value": [1, "x"]}, {"field": "c_acctbal", "op": "between", "value": "low", "value2": 3}, {"field": "c_acctbal", "op": "lt", "value": True}]}
    return found(spark, sf_dir, "/customers", where, "c_nationkey")


@registered(f"SELECT {ORDER} AS path FROM orders WHERE o_orderdate > TIMESTAMP '1998-06-01' AND epoch_ms(o_orderdate) < 946684800000")
def filter_times(spark, sf_dir):
    """A time column against a text and against milliseconds."""
    return found(spark, sf_dir, "/orders", {"and": [{"field": "o_orderdate", "op": "gt", "value": "1998-06-01"}, {"field": "o_orderdate", "op": "lt", "value": 946684800000}]})


@registered(f"SELECT {EVENT} AS path, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50")
def json_field_gt(spark, sf_dir):
    rows = found(spark, sf_dir, "/events", {"field": "props.k", "op": "gt", "value": 50}, "props")
    return rows.select("path", json_values.resolve(F.col("props"), ["k"], "bigint").alias("k"))


@registered(f"SELECT {EVENT} AS path, json_extract_string(props, '$.k') AS k FROM events WHERE value > 0 ORDER BY CAST(json_extract(props, '$.k') AS BIGINT) DESC NULLS LAST, path LIMIT 200")
def json_field_sort(spark, sf_dir):
    """The first 200 by a number inside JSON."""
    page = asked(spark, sf_dir, "/events", {"where": {"field": "value", "op": "gt", "value": 0}, "order_by": [{"field": "props.k", "direction": "desc"}], "limit": 200, "select": ["@path", "props.k"]})
    return page.withColumnRenamed("props.k", "k")


@registered("SELECT event_type, count(*) AS count, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS DOUBLE) AS total, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS most FROM events WHERE value > 0 GROUP BY 1")
def json_field_sum(spark, sf_dir):
    df = asked(spark, sf_dir, "/events", {"where": {"field": "value", "op": "gt", "value": 0}, "aggregate": {"group_by": ["event_type"], "sum": ["props.k"], "max": ["props.k"]}})
    return df.select("event_type", "count", F.col("`sum_props.k`").alias("total"), F.col("`max_props.k`").cast("bigint").alias("most"))


def _order_items(spark, sf_dir) -> DataFrame:
    """Orders with their items as a JSON list."""
    item = F.struct(F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("line"))
    rows = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.to_json(F.struct(F.collect_list(item).alias("items"))).alias("content"))
    return Collection("/baskets", "baskets", "concat(o_orderkey, '.json')").load(spark, rows)


@registered("SELECT DISTINCT '/baskets/' || l_orderkey || '.json' AS path FROM lineitem WHERE l_returnflag = 'R'")
def json_fanout_eq(spark, sf_dir):
    """A path that fans out equals a value if any element does."""
    where = {"field": "content.items[].flag", "op": "eq", "value": "R"}
    return query.matches(_order_items(spark, sf_dir), Request.from_json({"where": where})).select("path")


@registered("SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem WHERE l_linenumber >= 3 GROUP BY 1")
def jq_select(spark, sf_dir):
    """jq: the items of each order from line 3 on."""
    rows = _order_items(spark, sf_dir).select("o_orderkey", F.size(json_values.jq(F.col("content"), ".items | .[] | select(.line >= 3)")).cast("long").alias("n"))
    return rows.where("n > 0")


@registered(f"SELECT {EVENT} AS path, json_extract_string(json_merge_patch(props, '{{\"seen\": {{\"a\": 1}}}}'), '$.seen.a') AS a, json_extract_string(props, '/k') AS k FROM events")
def deep_merge_and_pointer(spark, sf_dir):
    merged = json_values.deep_merge(F.col("props"), F.lit('{"seen": {"a": 1}}'))
    rows = collection(spark, sf_dir, "/events").select("path", merged.alias("m"))
    return rows.select("path", F.get_json_object("m", "$.seen.a").alias("a"), json_values.pointer(F.col("m"), "/k").alias("k"))


@registered("SELECT (SELECT count(*) FROM lineitem WHERE l_discount < 0.08) AS total, least(count(*), 20) AS groups, count(*) > 20 AS has_more, count(*) > 20 AS default_limit_hit FROM (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_discount < 0.08)")
def agg_group_envelope(spark, sf_dir):
    """The page of groups: how many rows all groups have, and whether there are more groups."""
    page = query.groups(collection(spark, sf_dir, "/lineitems"), Request.from_json({"where": {"field": "l_discount", "op": "lt", "value": 0.08}, "aggregate": {"group_by": ["l_suppkey"]}}))
    return spark.createDataFrame([(page.total, page.items.count(), page.has_more, page.default_limit_hit)], "total long, groups long, has_more boolean, default_limit_hit boolean")


@registered("SELECT 1 AS errors_at_33, 1 AS unknown_field, 1 AS text_sum")
def request_errors(spark, sf_dir):
    """A tree of more than 32 levels, a field that is not there and the sum of a text are errors of the request."""
    deep, parts = {"field": "p_size", "op": "eq", "value": 1}, collection(spark, sf_dir, "/parts")
    for _ in range(33):
        deep = {"not": deep}

    def refused(ask) -> int:
        try:
            ask()
        except QueryError:
            return 1
        return 0

    row = (refused(lambda: parse(deep)), refused(lambda: query.matches(parts, Request.from_json({"where": {"field": "absent", "op": "eq", "value": 1}}))), refused(lambda: Query(parts).where(Field("p_size").gt(0)).aggregate(sum=["p_name"])))
    return spark.createDataFrame([row], "errors_at_33 int, unknown_field int, text_sum int")


@registered(f"SELECT {PART} AS path, p_size FROM part WHERE (p_size BETWEEN 10 AND 20 OR p_size IN (1, 2, 50)) AND NOT contains(lower(p_name), 'gear')")
def builder_query(spark, sf_dir):
    node = all_of(any_of(Field("p_size").between(10, 20), Field("p_size").is_in([1, 2, 50])), none_of(Field("p_name").contains("gear")))
    return query.matches(collection(spark, sf_dir, "/parts"), Query(None).where(node).request).select("path", "p_size")


# --- indexes -----------------------------------------------------------------


def _indexed(spark, sf_dir, where: dict) -> DataFrame:
    """The parts that a condition selects, by postings that were written and are read back."""
    df, folder = collection(spark, sf_dir, "/parts"), _fresh(spark, "index")
    indexes.reindex(df, {"p_name": list(indexes.STRATEGIES)}, folder)
    r = Request.from_json({"where": where})
    r.index = indexes.Index.open(spark, folder)
    return query.matches(df, r)


@registered(f"""WITH t AS (SELECT {PART} AS path, {_trigrams('p_name')} AS a, {_trigrams("'red widget'")} AS b FROM part)
SELECT path, round(2.0 * len(list_intersect(a, b)) / (len(a) + len(b)), 6) AS score FROM t WHERE 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) >= 0.3""")
def similar_by_index(spark, sf_dir):
    return _indexed(spark, sf_dir, {"field": "p_name", "op": "similar", "value": "red widget"}).select("path", F.round("score", 6).alias("score"))


@registered(f"SELECT {PART} AS path FROM part WHERE contains(lower(p_name), 'd widg') OR p_name = 'red bold'")
def contains_and_eq_by_index(spark, sf_dir):
    return _indexed(spark, sf_dir, {"or": [{"field": "p_name", "op": "contains", "value": "D WIDG"}, {"field": "p_name", "op": "eq", "value": "red bold"}]}).select("path")


@registered(f"SELECT {PART} AS path, round(1 - levenshtein(p_name, 'red widget') / greatest(strlen(p_name), 10)::DOUBLE, 6) AS score FROM part WHERE damerau_levenshtein(p_name, 'red widget') <= 2 AND levenshtein(p_name, 'red widget') = damerau_levenshtein(p_name, 'red widget')")
def fuzzy_by_index(spark, sf_dir):
    return _indexed(spark, sf_dir, {"field": "p_name", "op": "fuzzy", "value": "red widget"}).select("path", F.round("score", 6).alias("score"))


@registered("SELECT 'string' AS strategy, count(DISTINCT p_name) AS values, count(*) AS entries FROM part")
def reindex_resumed(spark, sf_dir):
    """An index that a second, resumed run leaves as it is, and its figures as a query explains them."""
    df, folder = collection(spark, sf_dir, "/parts"), _fresh(spark, "index")
    indexes.reindex(df, {"p_name": ["string"]}, folder)
    if [p["state"] for p in indexes.reindex(df, {"p_name": ["string"]}, folder, resume=True)] != ["kept"]:
        raise AssertionError("a complete index was written again")
    r = Request.from_json({"where": {"field": "p_name", "op": "eq", "value": "x"}})
    r.index = indexes.Index.open(spark, folder)
    rows = [(i["strategy"], i["values"], i["entries"]) for i in query.explain(df, r)["indexes"]]
    return spark.createDataFrame(rows, "strategy string, values long, entries long")


@registered(f"""WITH n AS (SELECT *, CASE WHEN p_partkey % 10 = 3 THEN 'zinc bolt' ELSE p_name END AS name FROM part WHERE p_partkey % 10 <> 7)
SELECT {PART} AS path FROM n WHERE len(list_intersect({_trigrams('name')}, {_trigrams("'zinc'")})) = 5""")
def index_refreshed(spark, sf_dir):
    """Postings after a tenth of the parts got another name and a tenth went."""
    parts = _table(spark, sf_dir, "part")
    old = standard().at("/parts").load(spark, parts)
    changed = standard().at("/parts").load(spark, parts.where("p_partkey % 10 = 3").withColumn("p_name", F.lit("zinc bolt")))
    gone = old.where("p_partkey % 10 = 7").select("path")
    new = indexes.refreshed(indexes.postings(old, "p_name", "trigram"), changed, gone, {"p_name": ["trigram"]})
    return indexes.candidates(new, "p_name", "trigram", "zinc", every=True).select("path")


@registered(f"SELECT {PART} AS path, p_name FROM part WHERE p_name BETWEEN 'blue' AND 'old' AND p_partkey % 4 <> 0")
def index_range_scan(spark, sf_dir):
    """Entries of a range of values and their records; a quarter of the entries is stale and dropped."""
    df, folder = collection(spark, sf_dir, "/parts"), _fresh(spark, "index")
    indexes.reindex(df, {"p_name": ["string"]}, folder)
    live = df.where("p_partkey % 4 <> 0")
    return indexes.records(indexes.scan(spark.read.parquet(folder), "p_name", "blue", "old"), live).select("path", "p_name")


_RAW = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(p_name), '[^\\p{L}\\p{M}\\p{N}]+'), lambda w: w <> ''), lambda w: CASE WHEN length(w) < 3 THEN [w] ELSE list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3)) END)))"


@registered(f"SELECT {PART} AS path, list_sort({_RAW}) AS trigrams FROM part")
def trigrams_unpadded(spark, sf_dir):
    return collection(spark, sf_dir, "/parts").select("path", F.array_sort(text.trigrams_raw(F.col("p_name"))).alias("trigrams"))


@registered(f"""WITH t AS (SELECT {PART} AS path, p_brand, list_sort({_trigrams('p_name')}) AS t FROM part), x AS (SELECT path, p_brand, t, unnest(t) AS k FROM t),
p AS (SELECT a.path AS a, b.path AS b, count(*) AS i, any_value(len(a.t)) AS n, any_value(len(b.t)) AS m FROM x a JOIN x b ON a.k = b.k AND a.p_brand = b.p_brand AND a.path < b.path GROUP BY 1, 2)
SELECT a, b, round(2.0 * i / (n + m), 6) AS score FROM p WHERE 2.0 * i / (n + m) >= 0.9""")
def near_dup_pairs(spark, sf_dir):
    """Parts of one brand whose names have nearly the same trigrams: candidates by a rare shared trigram, then verified."""
    return indexes.similar_pairs(collection(spark, sf_dir, "/parts"), "p_name", "p_brand", 0.9).withColumn("score", F.round("score", 6))


# --- files, ranges, formats ----------------------------------------------------


@registered("SELECT '/nations/' || n_nationkey || '.json' AS path, n_name AS content, strlen(n_name) AS size, sha256(n_name) AS content_hash FROM nation")
def live_read(spark, sf_dir):
    """Files written and read back from their folder."""
    folder = _fresh(spark, "files")
    rows = _table(spark, sf_dir, "nation").select(F.col("n_nationkey"), F.col("n_name").alias("value"))
    rows.repartition("n_nationkey").write.option("lineSep", "\x00").partitionBy("n_nationkey").text(folder)
    back = files.read_folder(spark, folder, glob="part-*")
    body = F.rtrim(F.col("content").cast("string"), F.lit("\x00"))
    key = F.regexp_extract("path", "n_nationkey=([0-9]+)", 1)
    return back.select(F.concat(F.lit("/nations/"), key, F.lit(".json")).alias("path"), body.alias("content"), F.octet_length(body).cast("long").alias("size"), F.sha2(body.cast("binary"), 256).alias("content_hash"))


@registered(f"SELECT {DOCUMENT} AS path, sha256(text) AS content_hash FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents WHERE lang = 'fr')")
def read_by_hash(spark, sf_dir):
    docs = collection(spark, sf_dir, "/documents")
    return storage.by_hash(docs.select("path", "content_hash"), docs.where("lang = 'fr'"))


@registered(f"SELECT {DOCUMENT} AS path, substr(hex(encode(text)), 201, 200) AS middle, right(hex(encode(text)), 40) AS last FROM documents WHERE text IS NOT NULL")
def http_byte_ranges(spark, sf_dir):
    body = F.col("text")
    return collection(spark, sf_dir, "/documents").where("text is not null").select("path", F.hex(listing.http_range(body, "bytes=100-199")).alias("middle"), F.hex(listing.http_range(body, "bytes=-20")).alias("last"))


@registered(f"SELECT {DOCUMENT} AS path, CASE WHEN strlen(text) <= 101 THEN text ELSE left(text, list_max(list_filter(range(0, 102), lambda n: strlen(left(text, n)) <= 101))) END AS part, strlen(text) > 101 AS truncated FROM documents")
def truncated_text(spark, sf_dir):
    """At most 101 bytes, never half a character."""
    part, cut = listing.truncate_utf8(F.col("text"), 101)
    return collection(spark, sf_dir, "/documents").select("path", part.alias("part"), cut.alias("truncated"))


@registered(f"""WITH h AS (SELECT {DOCUMENT} AS path, text, instr(lower(text), 'the and') - 1 AS hit FROM documents WHERE contains(lower(text), 'the and'))
SELECT path, substr(text, greatest(hit - 76, 0) + 1, 160) AS snippet, hit - 76 > 0 AS truncated_before, greatest(hit - 76, 0) + 160 < length(text) AS truncated_after FROM h""")
def hit_snippets(spark, sf_dir):
    at = search.first_hit(F.col("text"), "the and")
    rows = collection(spark, sf_dir, "/documents").where(at.isNotNull())
    return rows.select("path", *(c.alias(n) for n, c in search.snippet(F.col("text"), at, len("the and")).items()))


@registered("SELECT term FROM (VALUES ('x y'), ('BUILDING'), ('7')) v(term)")
def locator_terms(spark, sf_dir):
    """What locators look for in a tree: nothing under not, nothing of ranges, the first of a list."""
    tree = {"and": [{"field": "c_name", "op": "contains", "value": "x y"}, {"or": [{"field": "c_mktsegment", "op": "in", "value": ["BUILDING", "MACHINERY"]}, {"field": "c_nationkey", "op": "eq", "value": 7}]}, {"not": {"field": "c_name", "op": "eq", "value": "z"}}, {"field": "c_acctbal", "op": "gt", "value": 1}]}
    return spark.createDataFrame([(t,) for t in search.terms(parse(tree))], "term string")


@registered(f"SELECT {CUSTOMER} AS path, '@path' AS field, {CUSTOMER} AS value, '/customers' AS fetch FROM customer WHERE c_custkey::VARCHAR LIKE '12%' UNION ALL SELECT {CUSTOMER}, 'c_mktsegment', c_mktsegment, '/customers' FROM customer WHERE c_custkey::VARCHAR LIKE '12%' AND c_mktsegment = 'BUILDING'")
def field_locators(spark, sf_dir):
    """Which metadata and fields of a hit hold the terms, and where to fetch them."""
    df = collection(spark, sf_dir, "/customers")
    node = parse({"or": [{"field": "@path", "op": "contains", "value": "/customers/12"}, {"field": "c_mktsegment", "op": "eq", "value": "BUILDING"}]})
    hits = query.matches(df, Request.from_json({"where": {"field": "@path", "op": "contains", "value": "/customers/12"}}))
    return search.field_locators(hits, node, "/customers").select("path", "field", "value", "fetch")


@registered("SELECT '/nations/' || n_nationkey || '.json' AS path FROM nation WHERE contains(lower(n_name), 'nation_1')")
def search_query_before_where(spark, sf_dir):
    """Where a search has both, the query goes before the condition."""
    both = search.hits(spark, standard(), sf_dir, "/nations", query="NATION_1", where={"field": "n_nationkey", "op": "eq", "value": 3})
    return both.where(F.contains(F.lower("path"), F.lit("/nations/")) & F.array_contains("matched_by", "trigram")).join(collection(spark, sf_dir, "/nations").where(F.contains(F.lower("n_name"), F.lit("nation_1"))).select("path"), "path", "left_semi").select("path")


@registered(f"SELECT {DOCUMENT} AS path, sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL")
def zip_download(spark, sf_dir):
    """Every document by way of ZIP archives, read again."""
    docs = collection(spark, sf_dir, "/documents").where("text is not null").select("path", F.col("text").alias("content"))
    back = files.read_archives(files.write_archives(docs, 16))
    return back.select(F.concat(F.lit("/"), "path").alias("path"), F.sha2("content", 256).alias("content_hash"))


@registered(f"SELECT {DOCUMENT} AS path, strlen(text) >= 500 AS tried, sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL")
def zstd_storage(spark, sf_dir):
    """Contents stored by the compression rule and read again."""
    docs = collection(spark, sf_dir, "/documents").where("text is not null").select("path", "content_type", F.col("text").cast("binary").alias("content"))
    back = storage.unpacked(storage.packed(docs))
    return back.select("path", storage.should_compress(F.octet_length("content"), F.col("content_type")).alias("tried"), F.sha2("content", 256).alias("content_hash"))


@registered(f"SELECT {DOCUMENT} AS path, CASE WHEN text = '' OR regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]') THEN 'application/octet-stream' ELSE 'text/plain' END AS kind FROM documents WHERE text IS NOT NULL UNION ALL SELECT {PAGE}, 'text/plain' FROM pages UNION ALL SELECT '/png', 'image/png' UNION ALL SELECT '/zip', 'application/zip'")
def mime_sniff(spark, sf_dir):
    bodies = collection(spark, sf_dir, "/documents").where("text is not null").select("path", F.col("text").cast("binary").alias("b")).unionByName(collection(spark, sf_dir, "/pages").select("path", F.col("body").cast("binary").alias("b")))
    made = spark.createDataFrame([("/png", bytearray(b"\x89PNG\r\n\x1a\n0000")), ("/zip", bytearray(b"PK\x03\x04..."))], "path string, b binary")
    return bodies.unionByName(made).select("path", storage.content_type(F.col("b")).alias("kind"))


@registered(f"SELECT {PAGE} AS path, trim(regexp_replace(regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1), '\\s+', ' ', 'g')) AS title FROM pages UNION ALL SELECT {DOCUMENT}, coalesce(regexp_extract(text, '(?s)^\\s*([^\\r\\n]*[^\\s])', 1), '') FROM documents WHERE lang = 'fr'")
def parser_dispatch(spark, sf_dir):
    """Pages and documents of one folder, each by the parser of its kind."""
    pages = collection(spark, sf_dir, "/pages").select("path", "filename", "extension", F.lit("text/html").alias("content_type"), F.col("body").cast("binary").alias("content"))
    docs = collection(spark, sf_dir, "/documents").where("lang = 'fr' and text is not null").select("path", "filename", "extension", "content_type", F.col("text").cast("binary").alias("content"))
    return files.parsed(pages.unionByName(docs)).select("path", "title")


@registered("SELECT n_nationkey, 'nation' AS root_element, ['http://a/' || n_regionkey] AS namespaces FROM nation")
def xml_parse(spark, sf_dir):
    body = F.format_string('<?xml version="1.0"?><nation xmlns="http://a/%d"><name>%s</name></nation>', "n_regionkey", "n_name")
    rows = _table(spark, sf_dir, "nation").withColumn("body", body)
    return rows.select("n_nationkey", *(c.alias(n) for n, c in parsers.xml_metadata(F.col("body")).items()))


def _int32(c) -> F.Column:
    return F.unhex(F.lpad(F.hex(c.cast("int")), 8, "0"))


def _little(c, size: int):
    """A number as bytes, the least first."""
    byte = lambda k: F.unhex(F.lpad(F.hex(F.shiftright(c.cast("int"), 8 * k).bitwiseAND(255)), 2, "0"))
    return F.concat(*(byte(k) for k in range(size)))


def _parsed(rows: DataFrame, name: str, *fields: str) -> DataFrame:
    """Fields of the metadata of files (key, content) that are all of one format."""
    named = rows.select(F.concat(F.lit("/"), "key", F.lit(name)).alias("path"), F.concat("key", F.lit(name)).alias("filename"), F.lit(name[1:]).alias("extension"), F.lit("application/octet-stream").alias("content_type"), "content")
    got = binary_parsers.parse_files(named)
    key = F.regexp_extract("path", "^/([0-9]+)", 1).cast("bigint").alias("key")
    return got.select(key, "title", "text", *(F.get_json_object("metadata", f"$.{f}").alias(f) for f in fields))


@registered("SELECT c_custkey AS key, c_custkey::VARCHAR AS width, (c_nationkey + 1)::VARCHAR AS height, 'png' AS format FROM customer UNION ALL SELECT c_custkey, c_custkey::VARCHAR, (c_nationkey + 1)::VARCHAR, 'bmp' FROM customer")
def image_headers(spark, sf_dir):
    """PNG and BMP files of sizes that follow from the row."""
    rows = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_custkey").cast("int").alias("w"), (F.col("c_nationkey") + 1).cast("int").alias("h"))
    png = rows.select("key", F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), _int32(F.col("w")), _int32(F.col("h")), F.unhex(F.lit("080600000000000000"))).alias("content"))
    bmp = rows.select("key", F.concat(F.unhex(F.lit("424D" + "00" * 16)), _little(F.col("w"), 4), _little(F.col("h"), 4), F.unhex(F.lit("01001800"))).alias("content"))
    return _parsed(png, ".png", "width", "height", "format").unionByName(_parsed(bmp, ".bmp", "width", "height", "format")).drop("title", "text")


@registered("SELECT n_nationkey AS key, '2' AS channels, (8000 * (n_regionkey + 1))::VARCHAR AS sample_rate, round((n_nationkey + 1) / (n_regionkey + 1), 3) AS seconds FROM nation")
def audio_headers(spark, sf_dir):
    """WAV files: rate and length follow from the row."""
    rows = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), (8000 * (F.col("n_regionkey") + 1)).cast("int").alias("rate"), ((F.col("n_nationkey") + 1) * 32000).cast("int").alias("size"))
    head = F.concat(F.lit("RIFF").cast("binary"), _little(F.col("size") + 36, 4), F.lit("WAVEfmt ").cast("binary"), _little(F.lit(16), 4), _little(F.lit(1), 2), _little(F.lit(2), 2), _little(F.col("rate"), 4), _little(F.col("rate") * 4, 4), _little(F.lit(4), 2), _little(F.lit(16), 2), F.lit("data").cast("binary"), _little(F.col("size"), 4))
    content = F.concat(head, F.unhex(F.expr("repeat('00', size)")))
    got = _parsed(rows.select("key", content.alias("content")), ".wav", "channels", "sample_rate", "duration_seconds")
    return got.select("key", "channels", "sample_rate", F.col("duration_seconds").cast("double").alias("seconds"))


@registered("SELECT n_nationkey AS key, (n_nationkey + 1) / 2.0::DOUBLE AS seconds, (n_nationkey + 100)::VARCHAR AS width, '360' AS height, 'isom' AS brand FROM nation")
def video_headers(spark, sf_dir):
    """MP4 boxes: length and width follow from the row."""
    rows = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_nationkey").cast("int").alias("n"))
    raw = lambda s: F.lit(s).cast("binary")
    zeros = lambda n: F.unhex(F.lit("00" * n))
    box = lambda kind, size, *body: F.concat(_int32(F.lit(8 + size)), raw(kind), *body)
    mvhd = box("mvhd", 100, zeros(12), _int32(F.lit(1000)), _int32((F.col("n") + 1) * 500), zeros(80))
    tkhd = box("tkhd", 84, zeros(76), _int32((F.col("n") + 100) * 65536), _int32(F.lit(360 * 65536)))
    hdlr = box("hdlr", 24, zeros(8), raw("vide"), zeros(12))
    stsd = box("stsd", 24, zeros(8), _int32(F.lit(16)), raw("avc1"), zeros(8))
    mdia = box("mdia", 32 + 48, hdlr, box("minf", 40, box("stbl", 32, stsd)))
    moov = box("moov", 108 + 8 + 92 + 88, mvhd, box("trak", 92 + 88, tkhd, mdia))
    content = F.concat(box("ftyp", 8, raw("isom"), zeros(4)), moov)
    got = _parsed(rows.select("key", content.alias("content")), ".mp4", "duration_seconds", "width", "height", "brand")
    return got.select("key", F.col("duration_seconds").cast("double").alias("seconds"), "width", "height", "brand")


@registered("SELECT n_nationkey AS key, n_name AS title, 'Hello ' || n_nationkey AS text, '1' AS page_count FROM nation")
def pdf_text(spark, sf_dir):
    body = F.format_string("%%PDF-1.4\n1 0 obj <</Type /Pages /Count 1>> endobj\n2 0 obj <</Type /Page>> endobj\n3 0 obj <</Title (%s)>> endobj\n4 0 obj <<>>\nstream\nBT (Hello %d) Tj ET\nendstream endobj", "n_name", "n_nationkey")
    rows = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), body.cast("binary").alias("content"))
    return _parsed(rows, ".pdf", "page_count").select("key", "title", "text", "page_count")


def _zipped(parts: dict[str, str]):
    """A column function: archives of files whose text holds {0} and {1}."""

    @F.pandas_udf("binary")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        import io
        import zipfile

        def one(x, y):
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as z:
                for name, body in parts.items():
                    z.writestr(name, body.replace("{0}", str(x)).replace("{1}", str(y)))
            return out.getvalue()

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])

    return run


@registered("SELECT n_nationkey AS key, 'docx' AS format, n_name AS title, 'Nation ' || n_nationkey || chr(10) || n_name AS text FROM nation UNION ALL SELECT n_nationkey, 'xlsx', n_name, n_name || chr(10) || n_nationkey FROM nation UNION ALL SELECT n_nationkey, 'odt', n_name, n_name || chr(10) || 'Body ' || n_nationkey FROM nation")
def office_documents(spark, sf_dir):
    """DOCX, XLSX and ODT archives made from each nation, and what their parser reads."""
    core = '<c xmlns:d="u"><d:title>{1}</d:title></c>'
    kinds = {
        ".docx": {"word/document.xml": '<w:d xmlns:w="u"><w:p><w:r><w:t>Nation {0}</w:t></w:r></w:p><w:p><w:t>{1}</w:t></w:p></w:d>', "docProps/core.xml": core},
        ".xlsx": {"xl/workbook.xml": '<w><sheets><sheet name="S"/></sheets></w>', "xl/sharedStrings.xml": "<s><si><t>{1}</t></si><si><t>{0}</t></si></s>", "docProps/core.xml": core},
        ".odt": {"mimetype": "application/vnd.oasis.opendocument.text", "content.xml": '<o xmlns:t="u"><t:h>{1}</t:h><t:p>Body {0}</t:p></o>', "meta.xml": '<m xmlns:e="u"><e:title>{1}</e:title></m>'},
    }
    out = None
    for name, parts in kinds.items():
        rows = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), _zipped(parts)(F.col("n_nationkey").cast("string"), F.col("n_name")).alias("content"))
        got = _parsed(rows, name, "format")
        out = got if out is None else out.unionByName(got)
    return out.select("key", "format", "title", "text")


# --- versions ------------------------------------------------------------------


def _three(spark, sf_dir):
    from quern.catalogue import _three as three

    return three(spark, sf_dir)


@registered("SELECT version, count(*) AS files FROM (SELECT 'a2' AS version FROM orders WHERE o_orderdate < '2000-01-01' UNION ALL SELECT 'b' FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1")
def snapshots_taken(spark, sf_dir):
    """Snapshots added, renamed and dropped."""
    base, local, _ = _three(spark, sf_dir)
    store = versions.add_snapshot(versions.add_snapshot(base.withColumn("version", F.lit("a")), local, "b"), base, "c")
    return versions.drop_snapshot(versions.rename_snapshot(store, "a", "a2"), "c").groupBy("version").agg(F.count("*").alias("files"))


@registered("SELECT 'head' AS version, count(*) AS files FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 'kept', count(*) FROM orders WHERE o_orderdate < '2000-01-01'")
def forks_promoted(spark, sf_dir):
    """Forks created, one promoted to the head, one abandoned, one left."""
    base, local, remote = _three(spark, sf_dir)
    forks = versions.create_fork(base.withColumn("version", F.lit("kept")), local, "work")
    forks = versions.abandon_fork(versions.create_fork(forks, remote, "gone"), "gone")
    head, forks = versions.promote_fork(base, forks, "work")
    return versions.list_forks(head.withColumn("version", F.lit("head")).unionByName(forks))


_CONFLICTS = """WITH o AS (SELECT *, '/orders/' || o_orderkey || '.json' AS path FROM orders)
SELECT path, conflict FROM (SELECT path, CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN NULL
WHEN o_orderstatus = 'P' THEN CASE WHEN o_orderstatus = 'F' OR o_orderpriority = '4-NOT SPECIFIED' THEN 'modify_delete' END
WHEN o_orderpriority = '5-LOW' THEN CASE WHEN o_orderpriority IN ('1-URGENT', '4-NOT SPECIFIED') THEN 'modify_delete' END END AS conflict FROM o WHERE o_orderdate < '2000-01-01')
WHERE conflict IS NOT NULL"""


@registered(_CONFLICTS)
def conflicts_listed(spark, sf_dir):
    """The conflicts of a merge in which one side changed what the other deleted; the others are dismissed."""
    ops = versions.three_way_merge(*_three(spark, sf_dir))
    return versions.list_conflicts(ops).where("conflict = 'modify_delete'").select("path", "conflict")


@registered("SELECT '/l/' || c_custkey AS path, CASE WHEN c_custkey % 3 = 0 THEN 'add' ELSE 'none' END AS operation, CASE WHEN c_custkey % 6 = 0 THEN 'modify_modify' END AS conflict, CASE WHEN c_custkey % 3 = 0 THEN '/r/' ELSE '/l/' END || c_nationkey AS target FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0")
def links_merged(spark, sf_dir):
    """Links of which every third is led elsewhere by the remote side (later) and every second by the local one."""
    c = _table(spark, sf_dir, "customer").select(F.concat(F.lit("/l/"), "c_custkey").alias("path"), "c_custkey", F.col("c_nationkey").cast("string").alias("n"))
    side = lambda every, stem, at: c.select("path", F.when(F.col("c_custkey") % every == 0, F.concat(F.lit(stem), "n")).otherwise(F.lit("/base")).alias("target"), F.lit(at).alias("updated_at"))
    ops = versions.merge_links(side(1 << 30, "", 1), side(2, "/l/", 2), side(3, "/r/", 3))
    return ops.select("path", "operation", "conflict", "target")


@registered("SELECT '/l/' || n_nationkey AS path, '/f/' || (n_nationkey // 5) AS target, 'resolved' AS status FROM nation UNION ALL SELECT '/c/' || r_regionkey, NULL, 'cycle' FROM region")
def links_resolved(spark, sf_dir):
    """Chains of up to five links to a file, and a circle."""
    n = _table(spark, sf_dir, "nation").select(F.concat(F.lit("/l/"), "n_nationkey").alias("path"), F.when(F.col("n_nationkey") % 5 == 4, F.expr("concat('/f/', n_nationkey div 5)")).otherwise(F.expr("concat('/l/', n_nationkey + 1)")).alias("target"))
    size = _table(spark, sf_dir, "region").count()
    c = _table(spark, sf_dir, "region").select(F.concat(F.lit("/c/"), "r_regionkey").alias("path"), F.concat(F.lit("/c/"), ((F.col("r_regionkey") + 1) % size).cast("string")).alias("target"))
    out = versions.resolve_links(n.unionByName(c))
    return out.select("path", F.when(F.col("status") == "resolved", F.col("target")).alias("target"), "status")


@registered(f"SELECT {DOCUMENT} AS path, CASE WHEN doc_id % 10 = 0 AND lang = 'en' THEN 'lost' WHEN doc_id % 10 = 0 THEN 'repaired' ELSE 'ok' END AS status FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM documents WHERE text IN (SELECT text FROM documents GROUP BY 1 HAVING count(*) > 1))")
def verify_and_repair(spark, sf_dir):
    """Every tenth body is broken; a store of contents has those of all languages but English."""
    docs = collection(spark, sf_dir, "/documents").where("text is not null")
    single = docs.groupBy("content_hash").count().where("count = 1").select("content_hash")
    docs = docs.join(single, "content_hash", "left_semi")
    held = docs.where("lang is null or lang <> 'en'").select("content_hash", "body")
    damaged = docs.select("path", "content_hash", F.when(F.col("doc_id") % 10 == 0, F.lit("broken")).otherwise(F.col("body")).alias("body"))
    return versions.repaired(damaged, held).select("path", "status")


@registered("SELECT '/users/' || user_id AS path FROM (SELECT user_id, arg_max(event_type, event_id) AS e, count(*) FILTER (event_type <> 'error') AS n FROM events GROUP BY 1) WHERE e <> 'error' OR n > 0")
def restore_deleted(spark, sf_dir):
    """A log in which deleted paths are brought back with their last content."""
    log = _table(spark, sf_dir, "events").select(F.concat(F.lit("/users/"), "user_id").alias("path"), F.col("event_id").cast("long").alias("seq"), (F.col("event_type") == "error").alias("deleted"), F.when(F.col("event_type") != "error", F.sha2(F.col("event_id").cast("string").cast("binary"), 256)).alias("content_hash"))
    back = versions.restored(log, versions.deleted(log), 1 << 40)
    return versions.live(log.unionByName(back)).select("path")


@registered("SELECT '/users/' || user_id AS path, event_id AS seq FROM (SELECT user_id, arg_max(event_type, event_id) AS e, max(event_id) FILTER (event_type <> 'error') AS event_id FROM events GROUP BY 1) WHERE e = 'error'")
def deleted_listed(spark, sf_dir):
    log = _table(spark, sf_dir, "events").select(F.concat(F.lit("/users/"), "user_id").alias("path"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("deleted"), F.when(F.col("event_type") != "error", F.col("event_id").cast("string")).alias("content_hash"))
    return versions.deleted(log).select("path", F.col("content_hash").cast("bigint").alias("seq"))


@registered("SELECT '/documents/' || coalesce(source, 'none') || '/' || doc_id || '.txt' AS path FROM documents WHERE coalesce(source, 'none') <> 'src2' UNION ALL SELECT '/copy/' || doc_id || '.txt' FROM documents WHERE source = 'src1'")
def copy_and_remove_directory(spark, sf_dir):
    docs = collection(spark, sf_dir, "/documents").select("path", "content_hash")
    return versions.removed_directory(versions.moved(docs, "/documents/src1", "/copy", copy=True), "/documents/src2", recursive=True).select("path")


@registered(f"SELECT {DOCUMENT} AS path, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS updated_at FROM documents")
def backup_merged(spark, sf_dir):
    """A backup written, and read back into a state of which every second file is newer."""
    docs, folder = collection(spark, sf_dir, "/documents").select("path", "content_hash", "doc_id"), _fresh(spark, "backup")
    files.export_backup(docs.withColumn("updated_at", F.lit(1)), folder)
    now = docs.where("doc_id % 2 = 0").withColumn("updated_at", F.lit(2))
    return files.import_backup(spark, folder, now, "merge").select("path", "updated_at")


@registered(f"SELECT {DOCUMENT} AS path, sha256(text) AS content_hash FROM documents WHERE source = 'src1'")
def store_and_scan(spark, sf_dir):
    """Documents stored by top directory; a scan of one directory prunes the rest."""
    folder = _fresh(spark, "store")
    docs = collection(spark, sf_dir, "/documents").select(F.substring("path", len("/documents") + 1, 1 << 30).alias("path"), "content_hash")
    files.store(docs, folder)
    back = spark.read.parquet(folder).where("top = 'src1'")
    return back.select(F.concat(F.lit("/documents"), "path").alias("path"), "content_hash")


# --- access, sets, scalars -------------------------------------------------------


def _permissions(spark) -> DataFrame:
    from quern.catalogue import PERMISSIONS

    return spark.createDataFrame(list(PERMISSIONS), "level string, group string, allow string, deny string, others_allow string, others_deny string, pattern string")


@registered(f"SELECT {DOCUMENT} AS path FROM documents WHERE coalesce(source, 'none') NOT IN ('src2', 'src3') ORDER BY path LIMIT 50")
def readable_page(spark, sf_dir):
    """A page of what a member of staff may read: access filters before the limit."""
    readable = access.filter_readable(collection(spark, sf_dir, "/documents"), _permissions(spark), ["staff"])
    return readable.orderBy("path").limit(50).select("path")


@registered("SELECT DISTINCT '/documents/' || coalesce(source, 'none') AS path FROM documents WHERE coalesce(source, 'none') NOT IN ('src2', 'src3')")
def navigable_directories(spark, sf_dir):
    docs = collection(spark, sf_dir, "/documents")
    dirs = docs.select(F.regexp_extract("path", "^(.*)/", 1).alias("path")).distinct()
    return access.navigable(dirs, access.effective(docs, _permissions(spark), ["staff"]))


@registered("SELECT c_mktsegment AS path, CASE max(CASE WHEN c_acctbal < -900 THEN 2 WHEN c_acctbal < -500 THEN 1 ELSE 0 END) WHEN 2 THEN 'deny' WHEN 1 THEN 'redact' ELSE 'allow' END AS decision FROM customer GROUP BY 1")
def rules_combined(spark, sf_dir):
    made = F.when(F.col("c_acctbal") < -900, "deny").when(F.col("c_acctbal") < -500, "redact").otherwise("allow")
    return access.combine_rules(_table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("path"), made.alias("decision")))


@registered("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'), n AS (SELECT max(o_custkey) + 1 AS n FROM orders)
SELECT 'and' AS op, count(*) AS count FROM a JOIN b USING (k) UNION ALL SELECT 'or', count(*) FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'xor', count(*) FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL
UNION ALL SELECT 'minus', count(*) FROM a ANTI JOIN b USING (k) UNION ALL SELECT 'not', any_value(n.n) - count(a.k) FROM a, n""")
def bitmap_algebra(spark, sf_dir):
    """Customers with finished and with urgent orders, as bitmaps."""
    orders = _table(spark, sf_dir, "orders")
    a, b = bitmaps.of(orders.where("o_orderstatus = 'F'"), "o_custkey"), bitmaps.of(orders.where("o_orderpriority = '1-URGENT'"), "o_custkey")
    size = orders.agg(F.max("o_custkey")).first()[0] + 1
    sets = {"and": bitmaps.intersection(a, b), "or": bitmaps.union(a, b), "xor": bitmaps.symmetric_difference(a, b), "minus": bitmaps.difference(a, b), "not": bitmaps.complement(a, size)}
    out = None
    for name, s in sets.items():
        row = bitmaps.count(s).select(F.lit(name).alias("op"), "count")
        out = row if out is None else out.unionByName(row)
    return out


@registered("SELECT DISTINCT o_custkey AS number FROM orders WHERE o_orderstatus = 'F'")
def bitmap_numbers(spark, sf_dir):
    return bitmaps.numbers(bitmaps.of(_table(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), "o_custkey"))


@registered("SELECT c_custkey, round(least(greatest((c_acctbal + 500) / 5000.0, 0), 1), 9) AS balance, round(least(ascii(c_name) / 255.0 * 0.7 + least(strlen(c_name) / 1024.0, 1) * 0.3, 1), 9) AS name, round(least((c_custkey * 86400000) / 4102444800000.0, 1), 9) AS day FROM customer")
def scalar_places(spark, sf_dir):
    """Numbers, texts and times scaled to [0, 1]."""
    day = scalars.time(F.col("c_custkey") * 86_400_000)
    return _table(spark, sf_dir, "customer").select("c_custkey", F.round(scalars.number(F.col("c_acctbal"), -500, 4500), 9).alias("balance"), F.round(scalars.text(F.col("c_name")), 9).alias("name"), F.round(day, 9).alias("day"))


# --- events, tasks, user functions -------------------------------------------------


def _hmac_sql(secret: str, body: str) -> str:
    inner, outer = (bytes(b ^ pad for b in secret.encode().ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({body}))))"


@registered(f"SELECT event_id, {_hmac_sql('key', 'props')} AS signature FROM events")
def event_signatures(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", event_streams.signature("key", F.col("props")).alias("signature"))


@registered(f"SELECT props AS body, {_hmac_sql('key', 'props')} AS signature, count(*) AS n FROM (SELECT '{{\"event_id\":' || event_id || '}}' AS props FROM events WHERE event_type = 'error') GROUP BY 1, 2")
def webhook_deliveries(spark, sf_dir):
    """What a webhook sends for each error, delivered to a folder as a stream runs to its end."""
    folder = _fresh(spark, "webhook")
    schema = _table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir).where("event_type = 'error'").select("event_id")
    bodies = stream.select(F.to_json(F.struct("event_id")).alias("body"))
    signed = bodies.withColumn("signature", event_streams.signature("key", F.col("body")))
    event_streams.run_available(signed, f"{folder}/out", f"{folder}/state")
    return spark.read.schema(signed.schema).parquet(f"{folder}/out").groupBy("body", "signature").agg(F.count("*").alias("n"))


@registered("SELECT event_id FROM events WHERE event_type <> 'purchase' OR user_id = 7")
def event_recipient(spark, sf_dir):
    """Purchases go to their user only; the stream of user 7."""
    events = event_rows(_table(spark, sf_dir, "events")).join(_table(spark, sf_dir, "events").select("event_id", "user_id"), "event_id")
    own = events.withColumn("recipient_user_id", F.when(F.col("event_type") == "purchase", F.col("user_id").cast("string")))
    return event_streams.select_events(own, recipient="7").select("event_id")


@registered("SELECT '32' AS types, count(*) AS frames, min(frame) AS ready, sum(length(frame)) AS length FROM (SELECT 'event: server_ready' || chr(10) || 'data: {}' || chr(10) || chr(10) AS frame UNION ALL SELECT 'id: ' || event_id || chr(10) || 'event: ' || event_type || chr(10) || 'data: ' || props || chr(10) || chr(10) FROM events)")
def event_frames(spark, sf_dir):
    """Server-sent frames: the ready frame, then every event."""
    events = _table(spark, sf_dir, "events").select("event_id", "event_type", F.col("props").alias("payload"))
    known = event_streams.catalogue(spark).count()
    return event_streams.frames(events).agg(F.lit(str(known)).alias("types"), F.count("*").alias("frames"), F.min("frame").alias("ready"), F.sum(F.length("frame")).cast("long").alias("length"))


@registered("SELECT 'heartbeat' AS event_type, n * 15000 AS intent_time, 3 AS node_id FROM (SELECT unnest(range((min(epoch_us(ts)) // 1000 + 14999) // 15000, (min(epoch_us(ts)) // 1000 + 3600000 + 14999) // 15000)) AS n FROM events)")
def heartbeats_of_an_hour(spark, sf_dir):
    start = _table(spark, sf_dir, "events").agg(F.min(F.unix_millis(F.col("ts").cast("timestamp")))).first()[0]
    return event_streams.heartbeats(spark, start, start + 3_600_000, 3)


@registered("""WITH s AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS start, user_id, arg_max(event_id, ts) AS writes, max(ts) AS seen FROM (SELECT * FROM events WHERE ts IS NOT NULL) GROUP BY 1, 2)
SELECT start, user_id, writes, round(coalesce((writes - lag(writes) OVER w) * 1000.0 / nullif(epoch_us(seen) // 1000 - epoch_us(lag(seen) OVER w) // 1000, 0), 0), 6) AS writes_per_second FROM s WINDOW w AS (PARTITION BY user_id ORDER BY start)""")
def metrics_pulse(spark, sf_dir):
    """A counter of each user as metrics events of an hour."""
    counters = _table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("event_id").alias("writes"))
    out = event_streams.pulse(counters, every="1 hour", by=("user_id",))
    return out.select("start", "user_id", "writes", F.round("writes_per_second", 6).alias("writes_per_second"))


@registered("SELECT p_name AS token, count(*) AS n FROM part WHERE p_size > 25 GROUP BY 1")
def reindex_on_events(spark, sf_dir):
    """An index that is written when events say that its configuration changed."""
    folder = _fresh(spark, "reindex")
    spark.createDataFrame([(1, "indexes_updated"), (2, "heartbeat")], "event_id long, event_type string").write.parquet(f"{folder}/in")
    stream = event_streams.read(spark, f"{folder}/in", "event_id long, event_type string")
    parts = collection(spark, sf_dir, "/parts").where("p_size > 25")
    event_streams.reindex_on(stream, lambda _: indexes.reindex(parts, {"p_name": ["string"]}, f"{folder}/index"), f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/index").groupBy("token").agg(F.count("*").alias("n"))


@registered("SELECT event_id, 'nightly' AS schedule FROM events WHERE minute(ts) = 30 AND hour(ts) = 2 UNION ALL SELECT event_id, 'often' FROM events WHERE minute(ts) % 20 = 0")
def tasks_due(spark, sf_dir):
    rows = _table(spark, sf_dir, "events")
    out = tasks.due(rows.select("ts", "event_id"), [("nightly", "30 2 * * *", "backup"), ("often", "*/20 * * * *", "gc")])
    return out.join(rows.select("event_id", "ts"), "ts").select("event_id", "schedule").distinct()


def _task_log(spark, sf_dir) -> DataFrame:
    """Events of a user as the states of a task: a click is pending, a view running, an error failed, a purchase completed."""
    state = F.create_map(*(F.lit(x) for kv in {"click": "pending", "view": "running", "error": "failed", "purchase": "completed"}.items() for x in kv))
    return _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("task_id"), F.col("event_id").alias("seq"), F.lit("gc").alias("task_type"), F.lit("{}").alias("args"), F.coalesce(F.try_element_at(state, F.col("event_type")), F.lit("pending")).alias("status"), F.col("ts").cast("timestamp").alias("at"))


_TASKS = "WITH c AS (SELECT user_id::VARCHAR AS task_id, arg_max(event_type, event_id) AS e, arg_max(ts, event_id) AS seen, min(ts) AS created FROM events GROUP BY 1)"


@registered(_TASKS + " SELECT task_id, 'running' AS status FROM (SELECT task_id FROM c WHERE e NOT IN ('view', 'error', 'purchase') ORDER BY created, task_id LIMIT 10)")
def tasks_claimed(spark, sf_dir):
    """The ten tasks that have waited longest begin."""
    log = _task_log(spark, sf_dir)
    return tasks.moved_to(log, tasks.next_pending(log, 10), tasks.RUNNING, F.current_timestamp()).select("task_id", "status")


@registered(_TASKS + " SELECT user_id::VARCHAR AS task_id, event_id AS seq FROM events WHERE user_id::VARCHAR NOT IN (SELECT task_id FROM c WHERE e IN ('error', 'purchase') AND seen < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR)")
def tasks_cleaned(spark, sf_dir):
    """The log without tasks that were done an hour before its end."""
    log = _task_log(spark, sf_dir)
    end = log.agg(F.max("at")).first()[0]
    return tasks.cleaned(log, F.lit(end) - F.expr("INTERVAL 1 HOUR")).select("task_id", "seq")


@registered(f"SELECT {PAGE} AS path, strlen(html) AS bytes, NULL::BIGINT AS words, upper(page_id::VARCHAR || 'x') AS mapped FROM pages UNION ALL SELECT {DOCUMENT}, NULL, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\x0b\\x0c]+'), lambda w: w <> '')), upper(doc_id::VARCHAR || 'x') FROM documents WHERE text IS NOT NULL")
def user_functions(spark, sf_dir):
    """Parsers of a user by content type, and a mapper."""
    own = files.Functions()
    own.parsers |= {"bytes": lambda b: {"bytes": len(b)}, "words": lambda b: {"words": len(b.split())}}
    own.types |= {"text/html": "bytes", "text/*": "words"}
    own.mappers["shout"] = str.upper
    pages = collection(spark, sf_dir, "/pages").select("path", F.lit("text/html").alias("content_type"), F.col("body").alias("content"), F.col("page_id").cast("string").alias("id"))
    docs = collection(spark, sf_dir, "/documents").where("text is not null").select("path", "content_type", F.col("text").alias("content"), F.col("doc_id").cast("string").alias("id"))
    got = own.parse(pages.unionByName(docs))
    return got.select("path", F.get_json_object("parsed", "$.bytes").cast("bigint").alias("bytes"), F.get_json_object("parsed", "$.words").cast("bigint").alias("words"), own.mapper("shout", F.concat("id", F.lit("x"))).alias("mapped"))


@registered(f"SELECT {DOCUMENT} AS path FROM documents WHERE source IN ('src1', 'src2') AND coalesce(source, 'none') NOT IN ('src2', 'src3') ORDER BY path LIMIT 30")
def user_query_authorised(spark, sf_dir):
    """A query function of a user asks through its host, which shows what the caller may read."""
    own = files.Functions()
    own.queries["recent"] = lambda host, n: host.query("/documents", {"where": {"field": "source", "op": "in", "value": ["src1", "src2"]}, "order_by": [{"field": "@path"}], "limit": n, "select": ["@path"]})
    return own.query("recent", files.Host(spark, standard(), sf_dir, _permissions(spark), ["staff"]), 30)


@registered("SELECT c_custkey, md5(c_name) AS digest, url_decode('a%20b') AS decoded FROM customer")
def native_functions(spark, sf_dir):
    """Static methods of Java classes by name."""
    own = files.Functions()
    own.natives |= {"decode": ("java.net.URLDecoder", "decode"), "digest": ("org.apache.commons.codec.digest.DigestUtils", "md5Hex")}
    return _table(spark, sf_dir, "customer").select("c_custkey", own.native("digest", F.col("c_name")).alias("digest"), own.native("decode", F.lit("a%20b"), F.lit("UTF-8")).alias("decoded"))
