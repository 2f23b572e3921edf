"""Every registered query of the engine with its SQL equivalent.

A query takes (spark, sf_dir) and returns a DataFrame over the whole of its
tables; the SQL gives the same rows from views of the same names.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import json_values, parsers, paths, phonetic, schedule, text
from quern.operators import access, indexes, listing, rates, search, storage, versions
from quern.plans import query
from quern.plans.collections import standard
from quern.plans.query import Request
from quern.streaming import events as event_streams

_QUERIES: dict = {}
_SQL: dict = {}


def registered(sql: str | None = None):
    def add(function):
        _QUERIES[function.__name__] = function
        if sql is not None:
            _SQL[function.__name__] = sql
        return function

    return add


def _more() -> None:
    from quern import catalogue_more  # noqa: F401  it registers its queries here


def queries() -> dict:
    _more()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _more()
    return dict(_SQL)


def collection(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    return standard().at(path).load(spark, sf_dir)


def found(spark: SparkSession, sf_dir: str, path: str, where, *columns: str) -> DataFrame:
    """All rows of a collection that a JSON condition selects."""
    rows = query.matches(collection(spark, sf_dir, path), Request.from_json({"where": where}))
    return rows.select("path", *columns)


def asked(spark: SparkSession, sf_dir: str, path: str, request: dict) -> DataFrame:
    """A page: what a JSON request to a collection returns."""
    df, r = collection(spark, sf_dir, path), Request.from_json(request)
    return (query.aggregate if r.aggregate else query.rows)(df, r)


#: A limit that no table reaches, where a page of all rows is asked for.
ALL_ROWS = (1 << 31) - 1

CUSTOMER = "'/customers/' || c_custkey || '.json'"
PART = "'/parts/' || p_partkey || '.json'"
ORDER = "'/orders/' || o_orderkey || '.json'"
ITEM = "'/lineitems/' || l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber || '.json'"
EVENT = "'/events/' || event_id || '.json'"
DOCUMENT = "'/documents/' || coalesce(source, 'none') || '/' || doc_id || '.txt'"
PAGE = "'/pages/' || page_id || '.html'"

# --- filters ---------------------------------------------------------------


@registered(f"SELECT {CUSTOMER} AS path, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def filter_eq(spark, sf_dir):
    return found(spark, sf_dir, "/customers", {"field": "c_mktsegment", "op": "eq", "value": "BUILDING"}, "c_name")


@registered(f"SELECT {CUSTOMER} AS path, c_acctbal FROM customer WHERE c_acctbal > 5000")
def filter_gt(spark, sf_dir):
    return found(spark, sf_dir, "/customers", {"field": "c_acctbal", "op": "gt", "value": 5000}, "c_acctbal")


@registered(f"SELECT {CUSTOMER} AS path, c_acctbal FROM customer WHERE c_acctbal < 0")
def filter_lt(spark, sf_dir):
    return found(spark, sf_dir, "/customers", {"field": "c_acctbal", "op": "lt", "value": 0}, "c_acctbal")


@registered(f"SELECT {ITEM} AS path, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12.5")
def filter_between(spark, sf_dir):
    return found(spark, sf_dir, "/lineitems", {"field": "l_quantity", "op": "between", "value": 10, "value2": 12.5}, "l_quantity")


@registered(f"SELECT {ORDER} AS path, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
def filter_in(spark, sf_dir):
    return found(spark, sf_dir, "/orders", {"field": "o_orderpriority", "op": "in", "value": ["1-URGENT", "5-LOW"]}, "o_orderpriority")


@registered(f"SELECT {CUSTOMER} AS path FROM customer WHERE c_mktsegment > 'F' AND c_mktsegment < 'MB'")
def filter_string_range(spark, sf_dir):
    return found(spark, sf_dir, "/customers", {"and": [{"field": "c_mktsegment", "op": "gt", "value": "F"}, {"field": "c_mktsegment", "op": "lt", "value": "MB"}]})


@registered(f"SELECT {DOCUMENT} AS path FROM documents WHERE contains(lower(text), 'the and')")
def filter_contains(spark, sf_dir):
    return found(spark, sf_dir, "/documents", {"field": "text", "op": "contains", "value": "The AND"})


@registered(f"SELECT {CUSTOMER} AS path FROM customer WHERE (c_acctbal > 4000 AND c_mktsegment = 'BUILDING') OR (NOT c_nationkey < 20 AND c_acctbal < 1000)")
def bool_and_or_not(spark, sf_dir):
    return found(spark, sf_dir, "/customers", {"or": [
        {"and": [{"field": "c_acctbal", "op": "gt", "value": 4000}, {"field": "c_mktsegment", "op": "eq", "value": "BUILDING"}]},
        {"and": [{"not": {"field": "c_nationkey", "op": "lt", "value": 20}}, {"field": "c_acctbal", "op": "lt", "value": 1000}]},
    ]})


@registered(f"SELECT {DOCUMENT} AS path, CAST(quality AS VARCHAR) AS quality FROM documents LEFT JOIN labels USING (doc_id) WHERE NOT coalesce(quality = 1, false)")
def not_with_nulls(spark, sf_dir):
    """Documents without a label lack the field; "not" keeps them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "left")
    df = standard().at("/documents").load(spark, docs)
    return query.matches(df, Request.from_json({"where": {"not": {"field": "quality", "op": "eq", "value": 1}}})).select("path", F.col("quality").cast("string").alias("quality"))


@registered(f"SELECT {CUSTOMER} AS path FROM customer WHERE c_nationkey = 3 AND c_mktsegment = 'MACHINERY'")
def legacy_array_and(spark, sf_dir):
    return found(spark, sf_dir, "/customers", [{"field": "c_nationkey", "op": "eq", "value": 3}, {"field": "c_mktsegment", "op": "eq", "value": "MACHINERY"}])


@registered(f"SELECT {CUSTOMER} AS path FROM customer WHERE false")
def empty_where(spark, sf_dir):
    return query.matches(collection(spark, sf_dir, "/customers"), Request.from_json({"where": {}})).select("path")


@registered(f"SELECT {CUSTOMER} AS path, CAST(c_custkey AS BIGINT) AS c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000 ORDER BY c_acctbal DESC, path LIMIT 50")
def filter_and_sort_customers(spark, sf_dir):
    return asked(spark, sf_dir, "/customers", {
        "where": {"and": [{"field": "c_mktsegment", "op": "eq", "value": "BUILDING"}, {"field": "c_acctbal", "op": "gt", "value": 9000}]},
        "order_by": [{"field": "c_acctbal", "direction": "desc"}], "limit": 50, "select": ["@path", "c_custkey"],
    })


# --- metadata fields -------------------------------------------------------


@registered(f"SELECT {DOCUMENT} AS path, 'txt' AS extension, '/documents/' || coalesce(source, 'none') AS parent FROM documents")
def virtual_extension_eq(spark, sf_dir):
    return found(spark, sf_dir, "/documents", {"field": "@extension", "op": "eq", "value": "txt"}, "extension").withColumn("parent", paths.parent(F.col("path")))


@registered(f"SELECT {DOCUMENT} AS path, CAST(strlen(text) AS BIGINT) AS size FROM documents WHERE strlen(text) BETWEEN 1000 AND 3000")
def virtual_size_between(spark, sf_dir):
    return found(spark, sf_dir, "/documents", {"field": "@size", "op": "between", "value": 1000, "value2": 3000}, "size")


@registered(f"SELECT {DOCUMENT} AS path FROM documents WHERE contains({DOCUMENT}, '/src1/')")
def virtual_path_contains(spark, sf_dir):
    return found(spark, sf_dir, "/documents", {"field": "@path", "op": "contains", "value": "/SRC1/"})


@registered(f"SELECT {DOCUMENT} AS path, sha256(text) AS content_hash, CAST(strlen(text) AS BIGINT) AS size, 'text/plain' AS content_type FROM documents")
def file_metadata(spark, sf_dir):
    return collection(spark, sf_dir, "/documents").select("path", "content_hash", "size", "content_type")


@registered(f"SELECT {ORDER} AS path, epoch_ms(o_orderdate) AS created_at FROM orders WHERE epoch_ms(o_orderdate) > 883612800000")
def virtual_created_gt(spark, sf_dir):
    return found(spark, sf_dir, "/orders", {"field": "@created_at", "op": "gt", "value": 883612800000}, "created_at")


# --- text ------------------------------------------------------------------

_WORDS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda w: w <> '')"
_TRIGRAMS = "list_distinct(flatten(list_transform(" + _WORDS + ", lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def _trigrams(column: str) -> str:
    return _TRIGRAMS.format(column)


@registered(f"""WITH t AS (SELECT {PART} AS path, p_name, {_trigrams('p_name')} AS a, {_trigrams("'red widget'")} AS b FROM part),
s AS (SELECT path, p_name, 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) AS score FROM t)
SELECT path, p_name, round(score, 6) AS score FROM s WHERE score >= 0.3""")
def similar_part_name(spark, sf_dir):
    rows = found(spark, sf_dir, "/parts", {"field": "p_name", "op": "similar", "value": "red widget"}, "p_name", "score")
    return rows.withColumn("score", F.round("score", 6))


@registered(f"SELECT {PART} AS path, list_sort({_trigrams('p_name')}) AS trigrams FROM part")
def trigram_tokens(spark, sf_dir):
    return collection(spark, sf_dir, "/parts").select("path", F.array_sort(text.trigrams(F.col("p_name"))).alias("trigrams"))


def _soundex_sql(word: str) -> str:
    letters = f"regexp_replace(upper({word}), '[^A-Z]', '', 'g')"
    code = f"translate(substr({letters}, 1, 1) || regexp_replace(substr({letters}, 2), '[HW]', '', 'g'), 'BFPVCGJKQSXZDTLMNRAEIOUYHW', '11112222222233455600000000')"
    for d in "123456":
        code = f"regexp_replace({code}, '{d}{d}+', '{d}', 'g')"
    return f"CASE WHEN {letters} = '' THEN '' ELSE substr(substr({letters}, 1, 1) || replace(substr({code}, 2), '0', '') || '000', 1, 4) END"


_SOUNDEX = "list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array({0}, '\\s+'), lambda w: " + _soundex_sql("w") + "), lambda c: c <> '')))"


@registered(f"SELECT {PART} AS path, {_SOUNDEX.format('p_name')} AS codes FROM part")
def soundex_codes(spark, sf_dir):
    return collection(spark, sf_dir, "/parts").select("path", phonetic.soundex_codes(F.col("p_name")).alias("codes"))


@registered(f"SELECT {PART} AS path, p_name FROM part WHERE list_contains({_SOUNDEX.format('p_name')}, {_soundex_sql(chr(39) + 'widgit' + chr(39))})")
def soundex_match(spark, sf_dir):
    df = collection(spark, sf_dir, "/parts")
    return df.where(F.array_contains(phonetic.soundex_codes(F.col("p_name")), phonetic.soundex_of("widgit"))).select("path", "p_name")


def _rules_sql() -> str:
    """The rules of Double Metaphone as rows: what stands before a letter becomes a test of the sign before it."""
    rows = []
    for letter, rules in phonetic.RULES.items():
        for rank, (before, pattern, code, used) in enumerate(rules):
            one = {"": "^.?$", "^": "^$"}.get(before) or (f"^[^{before[4:-1].strip('[]')}]?$" if before.startswith("(?<!") else f"^{before}$")
            pattern = re.sub(r"\(\?!\[(.*?)\]\)", r"([^\1]|$)", pattern)
            rows.append(f"('{letter}', {rank}, '{one}', '^{pattern}', '{code}', {used})")
    return ", ".join(rows)


def _metaphone_sql(texts: str) -> str:
    """CTEs over rows (text): meta(text, codes), the distinct codes of a text's words."""
    return f"""rules(letter, rank, one, pat, code, used) AS (VALUES {_rules_sql()}),
spoken AS (SELECT DISTINCT text, w FROM (SELECT text, unnest(regexp_split_to_array(text, '\\s+')) AS w FROM ({texts})) WHERE regexp_matches(w, '\\p{{L}}')),
heard(w, s, k, out) AS (SELECT w, s, CASE WHEN regexp_matches(s, '^({phonetic.SILENT_START.pattern})') THEN 1 ELSE 0 END, '' FROM (SELECT DISTINCT w, regexp_replace(upper(w), '[^A-Z]', '', 'g') AS s FROM spoken)
UNION ALL SELECT w, s, k + used, out || code FROM (SELECT w, s, k, out, used, code, row_number() OVER (PARTITION BY w ORDER BY rank) AS n FROM heard JOIN rules ON letter = substr(s, k + 1, 1) AND regexp_matches(CASE WHEN k = 0 THEN '' ELSE substr(s, k, 1) END, one) AND regexp_matches(substr(s, k + 1), pat) WHERE k < length(s) AND length(out) < 4) WHERE n = 1),
coded AS (SELECT w, left(arg_max(out, k), 4) AS c, any_value(s) AS s FROM heard GROUP BY w),
sounds AS (SELECT w, c FROM coded UNION SELECT w, 'S' || substr(c, 2) FROM coded WHERE s LIKE 'SCH%' AND left(c, 1) <> 'S'),
meta AS (SELECT text, coalesce(list(DISTINCT c ORDER BY c) FILTER (c <> ''), []) AS codes FROM spoken JOIN sounds USING (w) GROUP BY text)"""


def _strings(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]::VARCHAR[]"


def _match_sql(texts: str, query_: str) -> str:
    """CTEs that end with found(text, score, names): texts that the operator match finds."""
    sound, meta = phonetic.query_codes(query_)
    q, k = "'" + query_ + "'", text.auto_fuzziness(query_)
    return f"""{_metaphone_sql(texts)},
tested AS (SELECT text, lower(text) = {q} AS exact, CASE WHEN len({_trigrams("text")}) + len({_trigrams(q)}) > 0 THEN 2.0 * len(list_intersect({_trigrams("text")}, {_trigrams(q)})) / (len({_trigrams("text")}) + len({_trigrams(q)})) ELSE 0 END AS dice,
list_has_any({_SOUNDEX.format("text")}, {_strings(sound)}) AS sound, coalesce(list_has_any(codes, {_strings(meta)}), false) AS meta, CASE WHEN damerau_levenshtein(text, {q}) <= {k} THEN 1 - damerau_levenshtein(text, {q}) / greatest(strlen(text), {len(query_.encode())})::DOUBLE END AS edits
FROM (SELECT DISTINCT text FROM ({texts}) WHERE text IS NOT NULL) LEFT JOIN meta USING (text)),
found AS (SELECT text, round(greatest(CASE WHEN exact OR sound OR meta THEN 1.0 ELSE 0.0 END, CASE WHEN dice > 0.3 THEN dice ELSE 0.0 END, CASE WHEN edits > 0 THEN edits ELSE 0.0 END)::DOUBLE, 6) AS score,
list_filter([CASE WHEN exact THEN 'exact' END, CASE WHEN dice > 0.3 THEN 'trigram' END, CASE WHEN sound THEN 'soundex' END, CASE WHEN meta THEN 'dmetaphone' END, CASE WHEN edits > 0 THEN 'fuzzy' END], lambda x: x IS NOT NULL) AS names
FROM tested WHERE exact OR dice > 0.3 OR sound OR meta OR coalesce(edits > 0, false))"""


@registered(f"WITH RECURSIVE {_metaphone_sql('SELECT p_name AS text FROM part')} SELECT w AS word, coalesce(list(DISTINCT c ORDER BY c) FILTER (c <> ''), []) AS codes FROM sounds GROUP BY w")
def dmetaphone_codes(spark, sf_dir):
    """Codes of each distinct word of the part names (rules without an SQL form; the tests hold fixed cases)."""
    words = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.explode(phonetic.phonetic_words(F.col("p_name"))).alias("word")).distinct()
    return words.select("word", phonetic.dmetaphone_codes(F.col("word"), alt=True).alias("codes"))


@registered(f"""WITH RECURSIVE {_metaphone_sql('SELECT p_name AS text FROM part')},
t AS (SELECT {PART} AS path, p_name, list_has_any({_SOUNDEX.format('p_name')}, {_strings(phonetic.query_codes('wijit reed')[0])}) AS sound, coalesce(list_has_any(codes, {_strings(phonetic.query_codes('wijit reed')[1])}), false) AS meta FROM part LEFT JOIN meta ON text = p_name)
SELECT path, p_name, list_filter([CASE WHEN sound THEN 'soundex' END, CASE WHEN meta THEN 'dmetaphone' END], lambda x: x IS NOT NULL) AS matched_by FROM t WHERE sound OR meta""")
def phonetic_match(spark, sf_dir):
    return found(spark, sf_dir, "/parts", {"field": "p_name", "op": "phonetic", "value": "wijit reed"}, "p_name", "matched_by")


@registered(f"SELECT {PART} AS path, p_name, round(1 - levenshtein(p_name, 'red bold') / 8.0, 6) AS score FROM part WHERE damerau_levenshtein(p_name, 'red bold') <= 1")
def fuzzy_osa_k1(spark, sf_dir):
    rows = found(spark, sf_dir, "/parts", {"field": "p_name", "op": "fuzzy", "value": "red bold", "fuzziness": 1}, "p_name", "score")
    return rows.withColumn("score", F.round("score", 6))


@registered(f"SELECT {PART} AS path, p_name, round(1 - damerau_levenshtein(p_name, 'rde wdiget') / greatest(strlen(p_name), 10)::DOUBLE, 6) AS score FROM part WHERE damerau_levenshtein(p_name, 'rde wdiget') <= 2")
def fuzzy_osa_auto(spark, sf_dir):
    rows = found(spark, sf_dir, "/parts", {"field": "p_name", "op": "fuzzy", "value": "rde wdiget"}, "p_name", "score")
    return rows.withColumn("score", F.round("score", 6))


@registered()
def fuzzy_jaro_winkler(spark, sf_dir):
    rows = found(spark, sf_dir, "/parts", {"field": "p_name", "op": "fuzzy", "value": "red wigdet", "algorithm": "jaro_winkler"}, "p_name", "score")
    return rows.withColumn("score", F.round("score", 6))


@registered(f"WITH RECURSIVE {_match_sql('SELECT p_name AS text FROM part', 'red wigdet')} SELECT {PART} AS path, p_name, score, names AS matched_by FROM part JOIN found ON text = p_name")
def match_fused(spark, sf_dir):
    rows = found(spark, sf_dir, "/parts", {"field": "p_name", "op": "match", "value": "red wigdet"}, "p_name", "score", "matched_by")
    return rows.withColumn("score", F.round("score", 6))


@registered(f"SELECT {PART} AS path, round(len(list_intersect({_trigrams('p_name')}, {_trigrams(chr(39) + 'gear' + chr(39))})) * 2.0 / (len({_trigrams('p_name')}) + len({_trigrams(chr(39) + 'gear' + chr(39))})), 6) AS score FROM part WHERE p_size > 25 AND len(list_intersect({_trigrams('p_name')}, {_trigrams(chr(39) + 'gear' + chr(39))})) * 2.0 / (len({_trigrams('p_name')}) + len({_trigrams(chr(39) + 'gear' + chr(39))})) >= 0.5")
def text_inside_boolean_tree(spark, sf_dir):
    where = {"and": [{"field": "p_size", "op": "gt", "value": 25}, {"field": "p_name", "op": "similar", "value": "gear", "threshold": 0.5}]}
    return found(spark, sf_dir, "/parts", where, "score").withColumn("score", F.round("score", 6))


@registered(f"""WITH t AS (SELECT {PART} AS path, unnest({_trigrams('p_name')}) AS token FROM part)
SELECT path, count(*) AS shared FROM t WHERE list_contains({_trigrams("'gear'")}, token) GROUP BY 1""")
def postings_candidates(spark, sf_dir):
    """Documents that share a trigram with a query, by the postings of a field."""
    return indexes.candidates(indexes.postings(collection(spark, sf_dir, "/parts"), "p_name", "trigram"), "p_name", "trigram", "gear")


@registered(f"""WITH t AS (SELECT {PART} AS path, unnest({_trigrams('p_name')}) AS token, 'trigram' AS strategy FROM part UNION ALL SELECT {PART}, p_name, 'string' FROM part)
SELECT 'p_name' AS field, strategy, count(*) AS entries, count(DISTINCT token) AS values, count(DISTINCT path) AS documents FROM t GROUP BY strategy""")
def index_statistics(spark, sf_dir):
    df = collection(spark, sf_dir, "/parts")
    return indexes.statistics(indexes.postings(df, "p_name", "trigram").unionByName(indexes.postings(df, "p_name", "string")))


# --- aggregates ------------------------------------------------------------


@registered("""SELECT count(*) AS count, round(sum(l_extendedprice), 2) AS sum_l_extendedprice, round(avg(l_discount), 8) AS avg_l_discount, min(l_shipmode_free) AS min_l_returnflag, max(l_quantity) AS max_l_quantity
FROM (SELECT *, l_returnflag AS l_shipmode_free FROM lineitem WHERE l_quantity > 10)""")
def agg_count_sum_avg_min_max(spark, sf_dir):
    df = asked(spark, sf_dir, "/lineitems", {"where": {"field": "l_quantity", "op": "gt", "value": 10}, "aggregate": {"sum": ["l_extendedprice"], "avg": ["l_discount"], "min": ["l_returnflag"], "max": ["l_quantity"]}})
    return df.withColumns({"sum_l_extendedprice": F.round("sum_l_extendedprice", 2), "avg_l_discount": F.round("avg_l_discount", 8)})


@registered("SELECT l_returnflag, count(*) AS count, round(sum(l_quantity), 2) AS sum_l_quantity FROM lineitem WHERE l_discount < 0.08 GROUP BY 1")
def agg_group_by(spark, sf_dir):
    df = asked(spark, sf_dir, "/lineitems", {"where": {"field": "l_discount", "op": "lt", "value": 0.08}, "aggregate": {"group_by": ["l_returnflag"], "sum": ["l_quantity"]}})
    return df.withColumn("sum_l_quantity", F.round("sum_l_quantity", 2))


@registered("SELECT o_orderstatus, o_orderpriority, count(*) AS count, round(avg(o_totalprice), 4) AS avg_o_totalprice FROM orders WHERE o_totalprice > 1000 GROUP BY 1, 2 ORDER BY count DESC, 1, 2 LIMIT 10")
def agg_group_multi(spark, sf_dir):
    df = asked(spark, sf_dir, "/orders", {"where": {"field": "o_totalprice", "op": "gt", "value": 1000}, "limit": 10, "aggregate": {"group_by": ["o_orderstatus", "o_orderpriority"], "avg": ["o_totalprice"]}})
    return df.withColumn("avg_o_totalprice", F.round("avg_o_totalprice", 4))


@registered("SELECT CAST(quality AS VARCHAR) AS quality, count(*) AS count FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def agg_group_null_key(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "left")
    return query.aggregate(standard().at("/documents").load(spark, docs), Request(all_rows=True, aggregate={"group_by": ["quality"]})).withColumn("quality", F.col("quality").cast("string"))


@registered("SELECT o_custkey, count(*) AS count FROM orders WHERE o_totalprice > 0 GROUP BY 1 ORDER BY count DESC, o_custkey LIMIT 20")
def agg_group_top20(spark, sf_dir):
    return asked(spark, sf_dir, "/orders", {"where": {"field": "o_totalprice", "op": "gt", "value": 0}, "aggregate": {"group_by": ["o_custkey"]}})


# --- order and pages -------------------------------------------------------


@registered(f"SELECT {PART} AS path, p_size FROM part WHERE p_size > 10 ORDER BY p_size DESC, p_name, path LIMIT 100")
def sort_multi(spark, sf_dir):
    return asked(spark, sf_dir, "/parts", {"where": {"field": "p_size", "op": "gt", "value": 10}, "order_by": [{"field": "p_size", "direction": "desc"}, {"field": "p_name"}], "limit": 100, "select": ["@path", "p_size"]})


@registered(f"SELECT {DOCUMENT} AS path, CAST(quality AS VARCHAR) AS quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY labels.quality ASC NULLS FIRST, path")
def sort_nulls(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "left")
    return query.rows(standard().at("/documents").load(spark, docs), Request(all_rows=True, order_by=[("quality", False)], limit=ALL_ROWS, select=["@path", "quality"])).withColumn("quality", F.col("quality").cast("string"))


@registered(f"SELECT {CUSTOMER} AS path FROM customer WHERE c_acctbal > 0 ORDER BY c_acctbal, path LIMIT 30 OFFSET 45")
def page_offset(spark, sf_dir):
    return asked(spark, sf_dir, "/customers", {"where": {"field": "c_acctbal", "op": "gt", "value": 0}, "order_by": [{"field": "c_acctbal"}], "limit": 30, "offset": 45, "select": ["@path"]})


def _cursor_request() -> dict:
    return {"where": {"field": "c_acctbal", "op": "gt", "value": 0}, "order_by": [{"field": "c_mktsegment"}, {"field": "c_acctbal", "direction": "desc"}], "limit": 25, "select": ["@path"]}


_CURSOR = f"""WITH o AS (SELECT {CUSTOMER} AS path, row_number() OVER (ORDER BY c_mktsegment, c_acctbal DESC, {CUSTOMER}) AS n FROM customer WHERE c_acctbal > 0),
a AS (SELECT min(n) AS n FROM o WHERE path = (SELECT min(path) FROM o))"""


@registered(_CURSOR + " SELECT o.path FROM o, a WHERE o.n > a.n ORDER BY o.n LIMIT 25")
def page_keyset_after(spark, sf_dir):
    df, r = collection(spark, sf_dir, "/customers"), Request.from_json(_cursor_request())
    first = query.matches(df, r).agg(F.min("path")).first()[0]
    r.after = query.cursor_of(df, r, first)
    return query.rows(df, r)


@registered(_CURSOR + " SELECT o.path FROM o, a WHERE o.n < a.n ORDER BY o.n DESC LIMIT 25")
def page_before(spark, sf_dir):
    df, r = collection(spark, sf_dir, "/customers"), Request.from_json(_cursor_request())
    first = query.matches(df, r).agg(F.min("path")).first()[0]
    r.before = query.cursor_of(df, r, first)
    return query.rows(df, r)


@registered(f"SELECT {CUSTOMER} AS path FROM customer WHERE c_nationkey < 10 ORDER BY path LIMIT 20")
def default_limit(spark, sf_dir):
    return asked(spark, sf_dir, "/customers", {"where": {"field": "c_nationkey", "op": "lt", "value": 10}, "select": ["@path"]})


@registered("SELECT count(*) AS total, least(count(*), 20) AS returned, count(*) > 20 AS has_more FROM customer WHERE c_nationkey < 10")
def include_total(spark, sf_dir):
    page = query.page(collection(spark, sf_dir, "/customers"), Request.from_json({"where": {"field": "c_nationkey", "op": "lt", "value": 10}, "include_total": True}))
    return spark.createDataFrame([(page.total, page.items.count(), page.has_more)], "total long, returned long, has_more boolean")


@registered(f"SELECT {CUSTOMER} AS path, c_name, 1.0::DOUBLE AS score FROM customer WHERE c_nationkey = 7 ORDER BY path")
def select_projection(spark, sf_dir):
    return asked(spark, sf_dir, "/customers", {"where": {"field": "c_nationkey", "op": "eq", "value": 7}, "limit": ALL_ROWS, "select": ["@path", "c_name", "@score"]})


# --- search ----------------------------------------------------------------


@registered("SELECT path, source FROM (SELECT '/nations/' || n_nationkey || '.json' AS path, '/nations' AS source FROM nation WHERE n_name = 'NATION_3')")
def global_search_structured(spark, sf_dir):
    return search.hits(spark, standard(), sf_dir, "/", where={"field": "n_name", "op": "eq", "value": "NATION_3"}).select("path", "source")


_NAMED = "SELECT '/regions/' || r_regionkey || '.json' AS path, '/regions' AS source, r_name AS text, 'r_name' AS field FROM region UNION ALL SELECT '/nations/' || n_nationkey || '.json', '/nations', n_name, 'n_name' FROM nation UNION ALL SELECT '/customers/' || c_custkey || '.json', '/customers', c_name, 'c_name' FROM customer UNION ALL SELECT '/suppliers/' || s_suppkey || '.json', '/suppliers', s_name, 's_name' FROM supplier UNION ALL SELECT '/parts/' || p_partkey || '.json', '/parts', p_name, 'p_name' FROM part"


@registered(f"WITH RECURSIVE named AS ({_NAMED}), {_match_sql('SELECT text FROM named', 'red widget')} SELECT path, source, score, list_sort(names) AS matched_by, [field] AS fields FROM named JOIN found USING (text) ORDER BY score DESC, path LIMIT 1000")
def global_search_broad(spark, sf_dir):
    return search.search(spark, standard(), sf_dir, "/", query="red widget", limit=1000).withColumn("score", F.round("score", 6))


@registered(f"""SELECT {DOCUMENT} AS path, CAST(instr(lower(text), 'the and') - 1 AS INTEGER) AS start_char,
CAST(1 + length(left(text, instr(lower(text), 'the and') - 1)) - length(replace(left(text, instr(lower(text), 'the and') - 1), chr(10), '')) AS INTEGER) AS line
FROM documents WHERE contains(lower(text), 'the and')""")
def hit_locators(spark, sf_dir):
    df = collection(spark, sf_dir, "/documents")
    at = search.first_hit(F.col("text"), "the and")
    return df.where(at.isNotNull()).select("path", at.cast("int").alias("start_char"), search.line_and_column(F.col("text"), at)[0].alias("line"))


# --- JSON ------------------------------------------------------------------


@registered(f"SELECT {EVENT} AS path, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_path_props(spark, sf_dir):
    return collection(spark, sf_dir, "/events").select("path", json_values.resolve(F.col("props"), ["k"], "bigint").alias("k"))


@registered("""SELECT o_orderkey, unnest(list_sort(list(l_returnflag))) AS flag FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")
def json_fanout(spark, sf_dir):
    """Orders as JSON with a list of items; the path items[].flag fans out."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("l_returnflag").alias("flag"))).alias("items"))).alias("body"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey").join(items, "o_orderkey")
    return orders.select("o_orderkey", F.explode(json_values.walk_paths(F.col("body"), ["items", "", "flag"])).alias("v")).select("o_orderkey", F.try_variant_get("v", "$", "string").alias("flag"))


@registered(f"SELECT {CUSTOMER} AS path, unnest([c_acctbal, CAST(c_custkey AS DOUBLE)]) AS v FROM customer")
def json_regex_keys(spark, sf_dir):
    """Values of the keys that /^c_(acctbal|custkey)$/ fits, out of each row's JSON body."""
    rows = collection(spark, sf_dir, "/customers").select("path", F.explode(json_values.walk_paths(F.col("body"), ["/^c_(ACCTBAL|custkey)$/i"])).alias("v"))
    return rows.select("path", F.try_variant_get("v", "$", "double").alias("v"))


@registered(f"SELECT {EVENT} AS path, CAST(json_extract_string(json_merge_patch(props, '{{\"k\": null, \"seen\": true}}'), '$.seen') AS VARCHAR) AS seen, json_extract_string(json_merge_patch(props, '{{\"k\": null, \"seen\": true}}'), '$.k') AS k FROM events")
def merge_patch_props(spark, sf_dir):
    patched = json_values.merge_patch(F.col("props"), F.lit('{"k": null, "seen": true}'))
    df = collection(spark, sf_dir, "/events").select("path", patched.alias("p"))
    return df.select("path", F.get_json_object("p", "$.seen").alias("seen"), F.get_json_object("p", "$.k").alias("k"))


@registered(f"SELECT {EVENT} AS path, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ms FROM events")
def timestamp_parse(spark, sf_dir):
    return collection(spark, sf_dir, "/events").select("path", json_values.parse_timestamp(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("ms"))


# --- parsers ---------------------------------------------------------------


@registered(f"""SELECT {DOCUMENT} AS path, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS INTEGER) AS word_count,
CAST(CASE WHEN text = '' THEN 0 ELSE len(string_split(rtrim(text, chr(10)), chr(10))) END AS INTEGER) AS line_count, CAST(length(text) AS INTEGER) AS char_count, 'plaintext' AS language FROM documents""")
def text_parser_stats(spark, sf_dir):
    return listing.text_statistics(collection(spark, sf_dir, "/documents")).select("path", "word_count", "line_count", "char_count", "language")


_STRIP = "html"
for _p in ("(?s)<!--.*?-->", "(?is)<script\\b.*?</script\\s*>", "(?is)<style\\b.*?</style\\s*>", "(?s)<[^>]*>"):
    _STRIP = f"regexp_replace({_STRIP}, '{_p}', ' ', 'g')"
for _n, _s in (("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&apos;", "chr(39)"), ("&#39;", "chr(39)"), ("&amp;", "'&'")):
    _STRIP = f"replace({_STRIP}, '{_n}', {_s})"


@registered(f"""SELECT {PAGE} AS path, trim(regexp_replace(regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1), '\\s+', ' ', 'g')) AS title,
CAST(len(regexp_extract_all(html, '(?i)<a[ >]')) AS INTEGER) AS link_count, sha256(trim(regexp_replace({_STRIP}, '\\s+', ' ', 'g'))) AS text_hash FROM pages""")
def html_title_links_text(spark, sf_dir):
    meta = parsers.html_metadata(F.col("body"))
    return collection(spark, sf_dir, "/pages").select("path", meta["title"].alias("title"), meta["link_count"].alias("link_count"), F.sha2(meta["text"].cast("binary"), 256).alias("text_hash"))


# --- listings and ranges ---------------------------------------------------


@registered("SELECT coalesce(source, 'none') AS name, true AS is_dir, count(*) AS n_files, CAST(sum(strlen(text)) AS BIGINT) AS size FROM documents GROUP BY 1")
def dir_listing(spark, sf_dir):
    return listing.directory(collection(spark, sf_dir, "/documents"), "/documents").select("name", "is_dir", "n_files", "size")


@registered(f"SELECT {DOCUMENT} AS path FROM documents WHERE regexp_matches({DOCUMENT}, '^/documents/src[^/]/[^/]*7\\.txt$')")
def glob_filter(spark, sf_dir):
    df = collection(spark, sf_dir, "/documents")
    return df.where(paths.glob_match(F.col("path"), "/documents/src?/*7.txt")).select("path")


@registered(f"SELECT {DOCUMENT} AS path FROM documents WHERE regexp_matches(doc_id || '.txt', '^[^/]*42\\.txt$') AND source = 'src2'")
def recursive_listing(spark, sf_dir):
    return listing.recursive(collection(spark, sf_dir, "/documents"), "/documents/src2", depth=1, glob="*42.txt").select("path")


@registered("SELECT count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS logical_bytes, 1 + count(DISTINCT coalesce(source, 'none')) AS directories FROM documents")
def live_tree_metrics(spark, sf_dir):
    return listing.tree_metrics(collection(spark, sf_dir, "/documents"))


@registered(f"SELECT {DOCUMENT} AS path, array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)) AS part FROM documents")
def line_range(spark, sf_dir):
    return collection(spark, sf_dir, "/documents").select("path", listing.line_range(F.col("text"), 2, 4).alias("part"))


@registered(f"SELECT {DOCUMENT} AS path, substr(text, 11, 30) AS part FROM documents")
def char_range(spark, sf_dir):
    return collection(spark, sf_dir, "/documents").select("path", listing.char_range(F.col("text"), 10, 40).alias("part"))


@registered(f"""WITH r AS (SELECT {DOCUMENT} AS path, CASE WHEN lang = 'en' THEN sha256(text) WHEN lang = 'fr' THEN 'old' END AS h, text FROM documents UNION ALL SELECT '/documents/none/x.txt', NULL, NULL)
SELECT path, CASE WHEN text IS NULL THEN 'missing' WHEN h = 'old' THEN 'stale' ELSE 'ok' END AS status FROM r""")
def batch_fetch(spark, sf_dir):
    files = collection(spark, sf_dir, "/documents")
    guard = F.when(F.col("lang") == "en", F.col("content_hash")).when(F.col("lang") == "fr", "old")
    wanted = files.select("path", guard.alias("if_content_hash"), F.lit(None).cast("long").alias("if_updated_at"))
    absent = spark.range(1).select(F.lit("/documents/none/x.txt").alias("path"), F.lit(None).cast("string").alias("if_content_hash"), F.lit(None).cast("long").alias("if_updated_at"))
    return listing.fetch(wanted.unionByName(absent), files).select("path", "status")


# --- storage ---------------------------------------------------------------


@registered("""WITH p AS (SELECT sha256(text) AS h, count(*) AS n, max(strlen(text)) AS size FROM documents GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS files, count(*) AS contents, CAST(sum(n * size) AS BIGINT) AS logical_bytes, CAST(sum(size) AS BIGINT) AS stored_bytes, round(1 - sum(size) / sum(n * size), 6) AS savings FROM p""")
def content_dedup(spark, sf_dir):
    return storage.dedup_figures(collection(spark, sf_dir, "/documents"))


@registered("SELECT DISTINCT sha256(text) AS content_hash FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en')")
def missing_chunks(spark, sf_dir):
    files = collection(spark, sf_dir, "/documents")
    return storage.missing(files, files.where("lang = 'en'"))


# --- versions --------------------------------------------------------------


def _orders(spark, sf_dir) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.concat(F.lit("/orders/"), "o_orderkey", F.lit(".json")).alias("path"), F.sha2(F.concat_ws("|", "o_orderstatus", "o_orderpriority"), 256).alias("content_hash"), F.lit("application/json").alias("content_type"), F.col("o_orderkey").alias("updated_at"), "o_orderstatus", "o_orderpriority", "o_orderdate")


def _variant(rows: DataFrame, changed: str, mark: str, times: str) -> DataFrame:
    new = F.sha2(F.concat_ws("|", F.lit(mark), "o_orderstatus"), 256)
    return rows.select("path", F.when(F.expr(changed), new).otherwise(F.col("content_hash")).alias("content_hash"), "content_type", F.expr(times).alias("updated_at"))


def _three(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    o = _orders(spark, sf_dir)
    base = o.where("o_orderdate < '2000-01-01'").select("path", "content_hash", "content_type", "updated_at")
    local = _variant(o.where("o_orderstatus <> 'P'"), "o_orderpriority = '1-URGENT' or o_orderpriority = '4-NOT SPECIFIED'", "changed", "updated_at")
    remote = _variant(o.where("o_orderpriority <> '5-LOW'"), "o_orderstatus = 'F' or o_orderpriority = '4-NOT SPECIFIED'", "changed", "case when o_orderdate < '1998-01-01' then updated_at else 0 end")
    return base, local, remote


_THREE = f"""WITH o AS (SELECT *, {ORDER} AS path, sha256(o_orderstatus || '|' || o_orderpriority) AS h, sha256('changed|' || o_orderstatus) AS c FROM orders),
base AS (SELECT path, h FROM o WHERE o_orderdate < '2000-01-01'),
loc AS (SELECT path, CASE WHEN o_orderpriority IN ('1-URGENT', '4-NOT SPECIFIED') THEN c ELSE h END AS h, o_orderkey AS t FROM o WHERE o_orderstatus <> 'P'),
rem AS (SELECT path, CASE WHEN o_orderstatus = 'F' OR o_orderpriority = '4-NOT SPECIFIED' THEN c ELSE h END AS h, CASE WHEN o_orderdate < '1998-01-01' THEN o_orderkey ELSE 0 END AS t FROM o WHERE o_orderpriority <> '5-LOW'),
d AS (SELECT coalesce(base.path, loc.path) AS path, base.h AS old_hash, loc.h AS new_hash, CASE WHEN base.h IS NULL THEN 'added' WHEN loc.h IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM base FULL JOIN loc USING (path) WHERE base.h IS DISTINCT FROM loc.h)"""


@registered(_THREE + " SELECT path, change, old_hash, new_hash FROM d")
def tree_diff(spark, sf_dir):
    base, local, _ = _three(spark, sf_dir)
    return versions.diff(base, local)


@registered(_THREE + """, l AS (SELECT coalesce(b.path, n.path) AS path, n.h IS NULL AS gone, n.h, n.t FROM base b FULL JOIN loc n ON b.path = n.path WHERE b.h IS DISTINCT FROM n.h),
r AS (SELECT coalesce(b.path, n.path) AS path, n.h IS NULL AS gone, n.h, n.t FROM base b FULL JOIN rem n ON b.path = n.path WHERE b.h IS DISTINCT FROM n.h),
m AS (SELECT coalesce(l.path, r.path) AS path, l.h AS lh, r.h AS rh, l.t AS lt, r.t AS rt, coalesce(l.gone, false) AS lg, coalesce(r.gone, false) AS rg FROM l FULL JOIN r ON l.path = r.path),
f AS (SELECT *, lh IS NOT NULL AND rh IS NOT NULL AND lh <> rh AS differ, lt > rt OR (lt = rt AND lh >= rh) AS later FROM m),
w AS (SELECT *, (differ AND NOT later) OR (rh IS NOT NULL AND lh IS NULL) AS rw, CASE WHEN differ THEN 'modify_modify' WHEN (lh IS NOT NULL AND rg) OR (rh IS NOT NULL AND lg) THEN 'modify_delete' END AS conflict FROM f)
SELECT path, CASE WHEN rw THEN 'add' WHEN rg AND lh IS NULL AND NOT lg THEN 'delete' ELSE 'none' END AS operation, conflict, CASE WHEN conflict IS NULL THEN NULL WHEN rw THEN 'remote' ELSE 'local' END AS winner, CASE WHEN rw THEN rh ELSE lh END AS content_hash FROM w""")
def three_way_merge(spark, sf_dir):
    return versions.three_way_merge(*_three(spark, sf_dir))


SNAPSHOTS = (("s1", "1997-01-01"), ("s2", "1999-01-01"), ("s3", "2001-01-01"))


def _store(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Three snapshots of the orders: those placed by then; low ones are deleted in s3, urgent ones change in it."""
    o, parts = _orders(spark, sf_dir), []
    for name, day in SNAPSHOTS:
        rows = o.where(F.col("o_orderdate") < F.lit(day).cast("timestamp"))
        rows = rows.where("o_orderpriority <> '5-LOW'") if name == "s3" else rows
        parts.append(_variant(rows, "o_orderpriority = '1-URGENT'" if name == "s3" else "false", "changed", "updated_at").withColumn("version", F.lit(name)))
    taken = spark.createDataFrame(list(SNAPSHOTS), "version string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    return reduce(lambda a, b: a.unionByName(b), parts), taken


_STORE = f"""WITH o AS (SELECT *, {ORDER} AS path, sha256(o_orderstatus || '|' || o_orderpriority) AS h, sha256('changed|' || o_orderstatus) AS c FROM orders),
s AS (SELECT 1 AS n, path, h FROM o WHERE o_orderdate < '1997-01-01' UNION ALL SELECT 2, path, h FROM o WHERE o_orderdate < '1999-01-01'
UNION ALL SELECT 3, path, CASE WHEN o_orderpriority = '1-URGENT' THEN c ELSE h END FROM o WHERE o_orderdate < '2001-01-01' AND o_orderpriority <> '5-LOW')"""


@registered(_STORE + """, g AS (SELECT DISTINCT path FROM s), x AS (SELECT g.path, v.n, s.h, lag(s.h) OVER (PARTITION BY g.path ORDER BY v.n) AS b FROM g CROSS JOIN (VALUES (1), (2), (3)) v(n) LEFT JOIN s ON s.path = g.path AND s.n = v.n)
SELECT path, 's' || n AS version, CASE WHEN h IS NULL THEN 'deleted' WHEN b IS NULL THEN 'added' WHEN b = h THEN 'unchanged' ELSE 'modified' END AS change FROM x WHERE h IS NOT NULL OR b IS NOT NULL""")
def file_history(spark, sf_dir):
    return versions.history(*_store(spark, sf_dir)).select("path", "version", "change")


@registered(_STORE + " SELECT path, h AS content_hash FROM s WHERE n = 2")
def read_at_version(spark, sf_dir):
    return versions.at_version(_store(spark, sf_dir)[0], "s2").select("path", "content_hash")


@registered(_STORE + " SELECT DISTINCT h AS content_hash FROM (SELECT h FROM o UNION SELECT c FROM o) WHERE h NOT IN (SELECT h FROM s WHERE n = 3)")
def gc_unreachable(spark, sf_dir):
    o = _orders(spark, sf_dir)
    every = o.select("content_hash").union(o.select(F.sha2(F.concat_ws("|", F.lit("changed"), "o_orderstatus"), 256))).distinct()
    return versions.unreachable(every, versions.at_version(_store(spark, sf_dir)[0], "s3"))


@registered("SELECT 'o' || o_orderkey AS version FROM orders WHERE (o_orderstatus = 'F' AND epoch(TIMESTAMP '2001-08-01') - epoch(o_orderdate) > 86400 * 360) OR (o_orderstatus = 'O' AND epoch(TIMESTAMP '2001-08-01') - epoch(o_orderdate) > 86400 * 720)")
def retention_prune(spark, sf_dir):
    snaps = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("o"), "o_orderkey").alias("version"), F.col("o_orderstatus").alias("kind"), F.col("o_orderdate").alias("created_at"))
    return versions.expired(snaps, F.lit("2001-08-01").cast("timestamp"), {"F": 12, "O": 24}).select("version")


@registered(_THREE + " SELECT path, h AS content_hash FROM loc")
def incremental_backup(spark, sf_dir):
    """The base with the patch from base to local is local."""
    base, local, _ = _three(spark, sf_dir)
    return versions.apply_patch(base, versions.patch(base, local)).select("path", "content_hash")


@registered(f"SELECT {DOCUMENT} AS path FROM documents WHERE lang <> 'en' AND (source = 'src1' OR source = 'src2')")
def replication_diff(spark, sf_dir):
    files = collection(spark, sf_dir, "/documents")
    return storage.sync_diff(files.where("lang = 'en'"), files, ["/documents/src1/**", "/documents/src2/**"]).select("path")


@registered("SELECT CASE WHEN source = 'src1' THEN '/documents/archive/' ELSE '/documents/' || coalesce(source, 'none') || '/' END || doc_id || '.txt' AS path FROM documents")
def rename_directory(spark, sf_dir):
    return versions.moved(collection(spark, sf_dir, "/documents").select("path", "content_hash"), "/documents/src1", "/documents/archive").select("path")


@registered("SELECT '/users/' || user_id AS path, user_id FROM (SELECT user_id, arg_max(event_type, event_id) AS e FROM events GROUP BY 1) WHERE e <> 'error'")
def deleted_and_live(spark, sf_dir):
    """A log of events by user: an error stands for a deletion; the last entry decides."""
    log = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("/users/"), "user_id").alias("path"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("deleted"), "user_id")
    return versions.live(log).select("path", "user_id")


# --- access ----------------------------------------------------------------

PERMISSIONS = (
    ("/", "staff", "r", None, None, None, None),
    ("/documents", "staff", "rl", None, "r", None, None),
    ("/documents/src2", "staff", None, "r", None, None, None),
    ("/documents/src3", "guests", None, None, None, "r", None),
    ("/documents/src3", "staff", "r", None, None, None, "3.txt"),
)


@registered(f"SELECT {DOCUMENT} AS path, coalesce(source, 'none') NOT IN ('src2', 'src3') AS allowed FROM documents")
def permission_fold(spark, sf_dir):
    links = spark.createDataFrame(list(PERMISSIONS), "level string, group string, allow string, deny string, others_allow string, others_deny string, pattern string")
    return access.effective(collection(spark, sf_dir, "/documents"), links, ["staff"])


@registered(f"""SELECT {DOCUMENT} AS path, CASE WHEN source = 'src1' THEN 'r' WHEN doc_id::VARCHAR LIKE '%7' THEN 'crud' WHEN source = 'src4' THEN '' ELSE 'rl' END AS flags FROM documents""")
def api_key_first_match(spark, sf_dir):
    rules = [("/documents/src1/**", "r"), ("**/*7.txt", "crud"), ("/documents/src4/*", ""), ("**", "rl")]
    return collection(spark, sf_dir, "/documents").select("path", access.first_rule(F.col("path"), rules).alias("flags"))


# --- rates, events, schedules ----------------------------------------------


def _samples(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("event_id").alias("value"))


def _rate_sql(minutes: int) -> str:
    w = f"(PARTITION BY user_id ORDER BY ms RANGE BETWEEN {minutes * 60000} PRECEDING AND CURRENT ROW)"
    return f"round(coalesce((event_id - first_value(event_id) OVER {w}) * 1000.0 / nullif(ms - first_value(ms) OVER {w}, 0), 0), 6) AS rate_{minutes}m"


_EVENTS_MS = "(SELECT *, epoch_us(ts) // 1000 AS ms FROM events)"


@registered(f"SELECT user_id, event_id AS value, {_rate_sql(1)}, {_rate_sql(5)}, {_rate_sql(15)} FROM {_EVENTS_MS}")
def rolling_rate_1m_5m_15m(spark, sf_dir):
    out = rates.rolling(_samples(spark, sf_dir), by=("user_id",))
    return out.select("user_id", "value", *(F.round(f"rate_{m}m", 6).alias(f"rate_{m}m") for m in rates.MINUTES))


@registered(f"""WITH s AS (SELECT user_id, event_id AS value, ms, (event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY ms)) * 1000.0 / nullif(ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms), 0) AS step FROM {_EVENTS_MS})
SELECT user_id, value, round(coalesce(max(step) OVER (PARTITION BY user_id ORDER BY ms ROWS BETWEEN 58 PRECEDING AND CURRENT ROW), 0), 6) AS peak FROM s""")
def peak_rate(spark, sf_dir):
    return rates.peak(_samples(spark, sf_dir), by=("user_id",)).select("user_id", "value", F.round("peak", 6).alias("peak"))


def event_rows(events: DataFrame) -> DataFrame:
    """Events with the payload that filters read: entries with the paths of the event and its user."""
    payload = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("/events/"), "event_id").alias("path")), F.struct(F.concat(F.lit("/users/"), "user_id").alias("path"))).alias("entries")))
    return events.select("event_id", "event_type", payload.alias("payload"), F.lit(None).cast("string").alias("recipient_user_id"), "ts")


@registered("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'error') AND user_id = 7")
def event_filter(spark, sf_dir):
    rows = event_rows(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return event_streams.select_events(rows, ["click", "error"], "/users/7").select("event_id", "event_type")


@registered("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'error') AND user_id = 7")
def event_filter_stream(spark, sf_dir):
    """The same filter on a stream of the file, run to its end."""
    import uuid

    from quern.sources.shared import shared_folder

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    chosen = event_streams.select_events(event_rows(stream), ["click", "error"], "/users/7").select("event_id", "event_type")
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    event_streams.run_available(chosen, f"{folder}/out", f"{folder}/state")
    return spark.read.schema(chosen.schema).parquet(f"{folder}/out")


@registered("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def tumbling_events(spark, sf_dir):
    out = event_streams.tumbling(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", "1 hour", ("event_type",), value="value")
    return out.select("start", "event_type", "n", F.round("total", 2).alias("total"))


@registered("""WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS b FROM events),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM a) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, g""")
def session_events(spark, sf_dir):
    return event_streams.sessions(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", "2 hours", ("user_id",)).select("user_id", "start", "n")


@registered("SELECT event_id FROM events WHERE minute(ts) % 15 = 0 AND hour(ts) BETWEEN 8 AND 17 AND dayofweek(ts) BETWEEN 1 AND 5")
def cron_match(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").where(schedule.cron_match(F.col("ts"), "*/15 8-17 * * 1-5")).select("event_id")


# --- collections together --------------------------------------------------


@registered("SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY 1")
def collection_join(spark, sf_dir):
    """An extension: documents of two collections joined by a field."""
    customers = found(spark, sf_dir, "/customers", {"field": "c_acctbal", "op": "gt", "value": 0}, "c_custkey", "c_mktsegment").drop("path")
    orders = collection(spark, sf_dir, "/orders").select("o_custkey", "o_totalprice")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def explain_json(spark: SparkSession, sf_dir: str) -> str:
    """The plan of the flagship query, as JSON."""
    request = Request.from_json({"where": {"field": "c_acctbal", "op": "gt", "value": 9000}})
    return json.dumps(query.explain(collection(spark, sf_dir, "/customers"), request))
