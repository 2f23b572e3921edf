import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from quern.operators import access, indexes, listing, rates, search, storage, versions
from quern.plans import builder, query
from quern.plans.builder import Field, Query, all_of, any_of, none_of
from quern.plans.collections import Catalog, Collection
from quern.plans.predicates import QueryError, parse
from quern.plans.query import Request
from quern.streaming import events


@pytest.fixture(scope="module")
def items(spark):
    rows = [(i, i * 10, f"item {i}", None if i % 5 == 0 else float(i)) for i in range(50)]
    table = spark.createDataFrame(rows, "id int, value int, name string, part double").cache()
    return Collection("/items", "items", "concat('item_', lpad(id, 3, '0'), '.json')").load(spark, table)


def count(df, where):
    return query.matches(df, Request.from_json({"where": where})).count()


@pytest.mark.parametrize(("where", "n"), [
    ({"field": "value", "op": "eq", "value": 100}, 1), ({"field": "value", "op": "gt", "value": 400}, 9), ({"field": "value", "op": "lt", "value": 100}, 10),
    ({"field": "value", "op": "between", "value": 100, "value2": 200}, 11), ({"field": "value", "op": "in", "value": [100, 200, 300]}, 3), ({"field": "value", "op": "in", "value": []}, 0),
    ({"field": "value", "op": "eq", "value": 105}, 0), ({"field": "value", "op": "lt", "value": 501}, 50), ({"and": []}, 0), ({"or": []}, 0), ({}, 0),
    ({"not": {"field": "part", "op": "gt", "value": 40}}, 42), ({"not": {"field": "part", "op": "lt", "value": 1000}}, 10), ({"not": {"and": []}}, 50),
    ({"field": "@filename", "op": "contains", "value": "ITEM_04"}, 10), ({"field": "@extension", "op": "eq", "value": "json"}, 50), ([{"field": "value", "op": "gt", "value": 100}, {"field": "value", "op": "lt", "value": 130}], 2),
    ({"or": [{"field": "value", "op": "eq", "value": 0}, {"not": {"or": [{"field": "value", "op": "gt", "value": 10}]}}]}, 2),
])
def test_counts(items, where, n):
    assert count(items, where) == n


@pytest.mark.parametrize("where", [{"field": "value", "op": "like", "value": 1}, {"op": "eq", "value": 1}, {"field": "value", "op": "in", "value": 3}, {"field": "value", "op": "between", "value": 3}, {"field": "value", "op": "eq", "value": None}, {"and": {}}, 5, {"field": "name", "op": "fuzzy", "value": "x", "algorithm": "none"}, {"field": "name", "op": "match", "value": 4}])
def test_bad_conditions(where):
    with pytest.raises(QueryError):
        parse(where)


def test_depth_limit():
    node = {"field": "a", "op": "eq", "value": 1}
    for _ in range(32):
        node = {"not": node}
    parse(node)
    with pytest.raises(QueryError):
        parse({"not": node})


def test_unknown_field(items):
    with pytest.raises(QueryError):
        count(items, {"field": "absent", "op": "eq", "value": 1})


def test_filters_reach_the_scan(spark, sf_dir):
    from quern import catalogue

    df = catalogue.filter_gt(spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(c_acctbal,5000.0)" in plan and "ReadSchema: struct<c_custkey:bigint,c_acctbal:double>" in plan


def test_pages_walk_all_rows(items):
    seen, r = [], Request.from_json({"where": {"field": "value", "op": "lt", "value": 1000}, "order_by": [{"field": "part", "direction": "desc"}], "limit": 7, "include_total": True})
    while True:
        page = query.page(items, r)
        seen += [x.path for x in page.items.collect()]
        assert page.total == 50
        if not page.has_more:
            break
        r.after = page.next_cursor
    ordered = query.rows(items, Request.from_json({"where": {"field": "value", "op": "lt", "value": 1000}, "order_by": [{"field": "part", "direction": "desc"}], "limit": 1000}))
    assert seen == [x.path for x in ordered.collect()] and len(set(seen)) == 50
    assert [x.part for x in ordered.collect()][-10:] == [None] * 10  # missing values last when descending
    r.after, r.before = None, query.cursor_of(items, r, seen[20])
    assert [x.path for x in query.page(items, r).items.collect()] == seen[13:20] == [x.path for x in query.rows(items, r).collect()]


def test_cursor_through_missing_values(items):
    request = {"where": {"field": "value", "op": "lt", "value": 1000}, "order_by": [{"field": "part"}], "limit": 1000}
    every = [x.path for x in query.rows(items, Request.from_json(request)).collect()]
    for at in (0, 5, 9, 10, 30):
        r = Request.from_json(request)
        r.after = query.cursor_of(items, r, every[at])
        assert [x.path for x in query.rows(items, r).collect()] == every[at + 1 :]


def test_cursor_errors(items):
    for cursor in ("%%%", "bm8=", query.encode_cursor([("@path", None, False)], {"_k0": "x"})):
        with pytest.raises(QueryError):
            query.rows(items, Request.from_json({"where": {"field": "value", "op": "gt", "value": 0}, "order_by": [{"field": "value"}], "after": cursor}))


def test_default_limit_and_projection(items):
    page = query.page(items, Request.from_json({"where": {"field": "value", "op": "lt", "value": 1000}, "select": ["@path", "value"]}))
    assert page.items.columns == ["path", "value"] and page.items.count() == 20 and page.has_more and page.default_limit_hit
    assert query.rows(items, Request.from_json({"where": {"field": "value", "op": "lt", "value": 1000}, "limit": 0})).count() == 0
    assert query.rows(items, Request.from_json({"where": {"field": "value", "op": "lt", "value": 1000}, "offset": 60})).count() == 0


def test_builder(items):
    rows = Query(items).where(any_of(Field("value").eq(10), all_of(Field("value").between(200, 230), none_of(Field("value").eq(210))))).order_by("value", descending=True).all().collect()
    assert [r.value for r in rows] == [230, 220, 200, 10]
    assert Query(items).where(Field("value").is_in([10, 20])).count() == 2 and Query(items).where(Field("value").gt(470)).where(Field("value").lt(490)).first().value == 480
    assert builder.Query(items).where(Field("value").lt(50)).select("value").limit(2).page().has_more


def test_aggregates(items):
    out = Query(items).where(Field("value").lt(100)).aggregate(sum=["part"], avg=["part"], min=["name"], max=["value"]).first()
    assert (out["count"], out.sum_part, out.avg_part, out.min_name, out.max_value) == (10, 40.0, 5.0, "item 0", 90)
    none = Query(items).where(Field("value").gt(9999)).aggregate(sum=["part"]).first()
    assert none["count"] == 0 and none.sum_part is None
    with pytest.raises(QueryError):
        Query(items).where(Field("value").gt(0)).aggregate(sum=["name"])


def test_explain(items):
    out = query.explain(items, Request.from_json({"where": {"and": [{"field": "value", "op": "gt", "value": 1}, {"not": {"field": "name", "op": "contains", "value": "9"}}]}}), analyze=True)
    assert out["tree"]["type"] == "and" and out["text"] and out["matched"] == 44 and out["returned"] == 20 and "Filter" in out["plan"]


def test_text_queries(spark):
    table = spark.createDataFrame([(1, "Mr. Bennett"), (2, "benet"), (3, "Smythe"), (4, None), (5, "zzz")], "id int, name string")
    df = Collection("/p", "p", "concat(id, '.json')").load(spark, table)
    ask = lambda where: [(r.id, round(r.score, 4), r.matched_by) for r in query.rows(df, Request.from_json({"where": where})).collect()]
    assert [x[0] for x in ask({"field": "name", "op": "eq", "value": "Mr. Bennett"})] == [1]
    assert ask({"field": "name", "op": "phonetic", "value": "Smith"}) == [(3, 1.0, ["soundex", "dmetaphone"])]
    assert ask({"field": "name", "op": "fuzzy", "value": "bennet"}) == [(2, round(1 - 1 / 6, 4), ["fuzzy"])]
    assert [x[0] for x in ask({"field": "name", "op": "match", "value": "bennett"})] == [1, 2]
    assert ask({"field": "name", "op": "match", "value": "SMYTHE"})[0][2][:1] == ["exact"]
    assert {x[0] for x in ask({"not": {"field": "name", "op": "contains", "value": "b"}})} == {3, 4, 5}
    assert [x[0] for x in ask({"field": "name", "op": "fuzzy", "value": "Smyhte", "algorithm": "jaro_winkler"})] == [3]


def test_search(spark):
    people = Collection("/people", "people", "concat(id, '.json')", text_fields=("name",))
    products = Collection("/products", "products", "concat(id, '.json')", text_fields=("title",))
    import tempfile

    folder = tempfile.mkdtemp()
    spark.createDataFrame([(1, "Alice Stone", 30), (2, "Bob", 41)], "id int, name string, age int").write.parquet(f"{folder}/people.parquet")
    spark.createDataFrame([(7, "alice in wonderland", 12)], "id int, title string, price int").write.parquet(f"{folder}/products.parquet")
    catalog = Catalog(people, products)
    assert [r.path for r in search.search(spark, catalog, folder, query="alice").collect()] == ["/people/1.json", "/products/7.json"]
    assert [r.path for r in search.search(spark, catalog, folder, base="/products", query="alice").collect()] == ["/products/7.json"]
    assert [r.path for r in search.search(spark, catalog, folder, where={"field": "age", "op": "gt", "value": 35}).collect()] == ["/people/2.json"]
    with pytest.raises(QueryError):
        search.search(spark, catalog, folder)
    assert catalog.at("/people/x/y").path == "/people"


def test_indexes(spark, tmp_path):
    table = spark.createDataFrame([(1, "red widget"), (2, "blue wijit"), (3, None)], "id int, name string")
    df = Collection("/p", "p", "concat(id, '.json')").load(spark, table)
    indexes.reindex(df, {"name": ["trigram", "dmetaphone", "string", "soundex"]}, str(tmp_path / "i"))
    index = spark.read.parquet(str(tmp_path / "i"))
    ask = lambda *a, **o: sorted(r.path for r in indexes.candidates(index, "name", *a, **o).collect())
    assert ask("string", "red widget") == ["/p/1.json"] and ask("dmetaphone", "wijit") == ["/p/1.json", "/p/2.json"]
    assert ask("trigram", "widget", every=True) == ["/p/1.json"] and ask("trigram", "wi") == ["/p/1.json", "/p/2.json"] and ask("soundex", "rad") == ["/p/1.json"]
    assert {(r.strategy, r.documents) for r in indexes.statistics(index).collect()} == {(s, 2) for s in indexes.STRATEGIES}


def test_forks(spark):
    store = spark.createDataFrame([("s1", "/a", "1"), ("w", "/a", "2")], "version string, path string, content_hash string")
    forks = spark.createDataFrame([("w", "/b", "9")], "version string, path string, content_hash string")
    assert [r.path for r in versions.at_version(store, "w", forks).collect()] == ["/b"] and [r.path for r in versions.at_version(store, "s1", forks).collect()] == ["/a"]
    head, rest = versions.promote_fork(store.drop("version"), forks, "w")
    assert [r.content_hash for r in head.collect()] == ["9"] and rest.count() == 0
    assert versions.drop_snapshot(versions.rename_snapshot(versions.add_snapshot(store, head, "n"), "n", "m"), "s1").select("version").distinct().count() == 2


def test_locators(spark):
    row = spark.createDataFrame([("one é two\nTWO three",)], "t string").select(search.locators(F.col("t"), ["two"]).alias("l"), search.first_hit(F.col("t"), "TWO").alias("at")).first()
    assert [(x.start_char, x.start_byte, x.line, x.column) for x in row.l] == [(6, 7, 1, 7), (10, 11, 2, 1)] and row.at == 6
    assert search.terms(parse({"and": [{"field": "a", "op": "eq", "value": "x"}, {"not": {"field": "a", "op": "eq", "value": "y"}}, {"field": "b", "op": "gt", "value": 1}, {"field": "c", "op": "in", "value": ["p", "q"]}]})) == ["x", "p"]
    cut = search.snippet(F.lit("a" * 300 + "needle" + "b" * 300), F.lit(300), 6)
    out = spark.range(1).select(*(c.alias(n) for n, c in cut.items())).first()
    assert "needle" in out.snippet and len(out.snippet) == 160 and out.truncated_before and out.truncated_after


def test_listing(spark):
    df = spark.createDataFrame([("/a/x.txt", 3), ("/a/b/y.txt", 5), ("/a/b/c/z.md", 7), ("/q.txt", 1)], "path string, size long").withColumns({"created_at": F.lit(0), "updated_at": F.lit(0)})
    assert [(r.name, r.is_dir, r["size"]) for r in listing.directory(df, "/a").collect()] == [("b", True, 12), ("x.txt", False, 3)]
    assert [r.path for r in listing.recursive(df, "/a", depth=2, glob="*.txt").orderBy("path").collect()] == ["/a/b/y.txt", "/a/x.txt"]
    assert listing.tree_metrics(df).first().asDict() == {"files": 4, "logical_bytes": 16, "directories": 3}


def test_ranges(spark):
    get = lambda c: spark.range(1).select(c.alias("x")).first().x
    t = F.lit("l1\r\nl2\rl3\nl4")
    assert get(listing.line_range(t, 2, 3)) == "l2\nl3" and get(listing.line_range(t, 4, 9)) == "l4" and get(listing.char_range(t, 0, 2)) == "l1"
    data = F.lit("abcdef").cast("binary")
    assert [bytes(get(listing.http_range(data, h))) for h in ("bytes=1-2", "bytes=4-", "bytes=-2", "bytes=-99")] == [b"bc", b"ef", b"ef", b"abcdef"]
    with pytest.raises(ValueError):
        listing.http_range(data, "bytes=1-2,4-5")
    text, cut = listing.truncate_utf8(F.lit("aé漢"), 4)
    assert get(text) == "aé" and get(cut) is True


def test_fetch(spark):
    files = spark.createDataFrame([("/a", "h1", 5, "A"), ("/b", "h2", 6, "B")], "path string, content_hash string, updated_at long, body string")
    wanted = spark.createDataFrame([("/a", None, None), ("/b", "old", None), ("/b", "h2", 6), ("/c", None, None), ("/a", None, 4)], "path string, if_content_hash string, if_updated_at long")
    assert sorted((r.path, r.status, r.body or "") for r in listing.fetch(wanted, files).collect()) == [("/a", "ok", "A"), ("/a", "stale", ""), ("/b", "ok", "B"), ("/b", "stale", ""), ("/c", "missing", "")]


def version(spark, rows):
    return spark.createDataFrame([(p, h, "t", len(h), t) for p, h, t in rows], "path string, content_hash string, content_type string, size int, updated_at long")


def test_merge_table(spark):
    base = version(spark, [(p, "0", 1) for p in "abcdefgh"])
    local = version(spark, [("a", "L", 5), ("b", "0", 1), ("c", "L", 5), ("d", "S", 2), ("e", "L", 3), ("g", "0", 1), ("h", "L", 4), ("n", "N", 1)])
    remote = version(spark, [("a", "0", 1), ("b", "R", 5), ("c", "R", 4), ("d", "S", 9), ("f", "R", 2), ("g", "0", 1), ("h", "R", 4), ("m", "M", 1)])
    ops = {r.path: (r.operation, r.conflict, r.winner) for r in versions.three_way_merge(base, local, remote).collect()}
    assert ops == {
        "a": ("none", None, None), "b": ("add", None, None), "c": ("none", "modify_modify", "local"), "d": ("none", None, None), "e": ("none", "modify_delete", "local"),
        "f": ("add", "modify_delete", "remote"), "h": ("add", "modify_modify", "remote"), "n": ("none", None, None), "m": ("add", None, None),
    }
    assert {r.path: r.content_hash for r in versions.merged(base, local, remote).collect()} == {"a": "L", "b": "R", "c": "L", "d": "S", "e": "L", "f": "R", "g": "0", "h": "R", "n": "N", "m": "M"}
    chosen = versions.resolve_conflicts(versions.three_way_merge(base, local, remote), {"c": "remote"})
    assert {r.path: r.winner for r in chosen.where("conflict is not null").collect()} == {"c": "remote", "e": "local", "f": "remote", "h": "remote"}


def test_patch_round_trip(spark):
    old, new = version(spark, [("a", "1", 1), ("b", "1", 1), ("c", "1", 1)]), version(spark, [("a", "1", 1), ("b", "2", 2), ("d", "3", 3)])
    assert {(r.path, r.change) for r in versions.diff(old, new).collect()} == {("b", "modified"), ("c", "deleted"), ("d", "added")}
    assert sorted(versions.apply_patch(old, versions.patch(old, new)).collect()) == sorted(new.collect())
    assert versions.tree_hash(old).first() != versions.tree_hash(new).first() == versions.tree_hash(new.orderBy(F.desc("path"))).first()
    assert [r.content_hash for r in versions.new_chunks(old, new).orderBy("content_hash").collect()] == ["2", "3"]


def test_history_and_retention(spark):
    store = spark.createDataFrame([("s1", "/a", "1", "t"), ("s2", "/a", "1", "u"), ("s3", "/a", "2", "u"), ("s1", "/b", "1", "t"), ("s3", "/b", "1", "t")], "version string, path string, content_hash string, content_type string")
    taken = spark.createDataFrame([("s1", 1), ("s2", 2), ("s3", 3), ("s4", 4)], "version string, created_at int")
    got = sorted((r.path, r.version, r.change) for r in versions.history(store, taken).collect())
    assert got == [("/a", "s1", "added"), ("/a", "s2", "modified"), ("/a", "s3", "modified"), ("/a", "s4", "deleted"), ("/b", "s1", "added"), ("/b", "s2", "deleted"), ("/b", "s3", "added"), ("/b", "s4", "deleted")]
    snaps = spark.createDataFrame([("old", "auto", "2024-01-01"), ("new", "auto", "2024-05-01"), ("kept", "manual", "2020-01-01"), ("_system_x", "auto", "2020-01-01")], "version string, kind string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    assert [r.version for r in versions.expired(snaps, F.lit("2024-06-01").cast("timestamp"), {"auto": 3}).collect()] == ["old"]


def test_log_links_and_moves(spark):
    log = spark.createDataFrame([("/a", 1, False, "h1"), ("/a", 2, True, None), ("/b", 1, True, None), ("/b", 3, False, "h2")], "path string, seq int, deleted boolean, content_hash string")
    assert [(r.path, r.content_hash) for r in versions.live(log).collect()] == [("/b", "h2")] and [(r.path, r.content_hash) for r in versions.deleted(log).collect()] == [("/a", "h1")]
    links = spark.createDataFrame([("/l1", "/l2"), ("/l2", "/f"), ("/x", "/y"), ("/y", "/x")], "path string, target string")
    assert {r.path: (r.target, r.status) for r in versions.resolve_links(links).collect()}["/l1"] == ("/f", "resolved")
    assert {r.path: r.status for r in versions.resolve_links(links).collect()}["/x"] == "cycle"
    files = spark.createDataFrame([("/d/a", "1"), ("/d/e/b", "2"), ("/dd", "3"), ("/n/a", "4")], "path string, content_hash string")
    assert sorted((r.path, r.content_hash) for r in versions.moved(files, "/d", "/n").collect()) == [("/dd", "3"), ("/n/a", "1"), ("/n/e/b", "2")]
    assert versions.moved(files, "/d", "/n", copy=True).count() == 5


def test_permissions(spark):
    files = spark.createDataFrame([(p,) for p in ("/x", "/d/a", "/d/s/b", "/d/s/open.txt", "/e/c")], "path string")
    links = spark.createDataFrame([("/", "g", "r", None, None, None, None), ("/d", "g", None, "r", None, None, None), ("/d/s", "o", None, None, None, "l", None), ("/d/s", "g", "r", None, None, None, "open.txt"), ("/e", "other", None, None, "r", "r", None)], "level string, group string, allow string, deny string, others_allow string, others_deny string, pattern string")
    allowed = {r.path: r.allowed for r in access.effective(files, links, ["g"]).collect()}
    assert allowed == {"/x": True, "/d/a": False, "/d/s/b": False, "/d/s/open.txt": True, "/e/c": False}
    assert {r.allowed for r in access.effective(files, links, []).collect()} == {False}
    dirs = spark.createDataFrame([("/d",), ("/d/s",), ("/e",)], "path string")
    assert sorted(r.path for r in access.navigable(dirs, access.effective(files, links, ["g"])).collect()) == ["/d", "/d/s"]
    assert access.filter_readable(files, links, ["g"]).count() == 2


def test_rules(spark):
    get = lambda c: spark.range(1).select(c.alias("x")).first().x
    rules = [("/p/docs/**", "r"), ("/p/*", "rw"), ("**", "")]
    assert [get(access.first_rule(F.lit(p), rules)) for p in ("/p/docs/a/b", "/p/x", "/z/q")] == ["r", "rw", ""]
    assert [get(access.on_shared_path(F.lit(p), [("/p/docs/**", "r")])) for p in ("/", "/p", "/p/docs", "/p/docs/x", "/q", "/p/do")] == [True, True, True, True, False, False]
    rows = spark.createDataFrame([("a", "allow"), ("a", "redact"), ("b", "redact"), ("b", "deny"), ("c", "allow")], "path string, decision string")
    assert {r.path: r.decision for r in access.combine_rules(rows).collect()} == {"a": "redact", "b": "deny", "c": "allow"}


def test_storage(spark):
    files = spark.createDataFrame([("/a", "x" * 10), ("/b", "x" * 10), ("/c", "y" * 4)], "path string, body string").withColumns({"content_hash": storage.content_hash(F.col("body")), "size": F.length("body")})
    row = storage.dedup_figures(files).first()
    assert (row.files, row.contents, row.logical_bytes, row.stored_bytes, row.savings) == (3, 2, 24, 14, round(1 - 14 / 24, 6))
    assert [(r.n, r.bytes) for r in storage.chunks(files.where("path = '/a'"), 4).orderBy("n").collect()] == [(0, 4), (1, 4), (2, 2)]
    assert storage.missing(files, files.where("path = '/a'")).count() == 1 and storage.commit(files.limit(0), files).count() == 2
    assert storage.sync_diff(files.where("path = '/a'"), files, ["/b", "/a"]).count() == 1
    kinds = spark.createDataFrame([(b"\x89PNG\r\n\x1a\n",), (b"plain",), (b"\x00\x01",), (b"PK\x03\x04",)], "b binary").select(storage.content_type(F.col("b")).alias("k"))
    assert [r.k for r in kinds.collect()] == ["image/png", "text/plain", "application/octet-stream", "application/zip"]
    assert not spark.range(1).select(storage.should_compress(F.lit(499), F.lit("text/plain"))).first()[0]


def test_rates(spark):
    df = spark.createDataFrame([(0, 0), (1000, 5), (61_000, 65), (61_000 + 300_000, 65)], "ts_ms long, value long")
    rows = rates.rolling(df).orderBy("ts_ms").collect()
    assert [r.rate_1m for r in rows] == [0.0, 5.0, 1.0, 0.0] and rows[2].rate_5m == pytest.approx(65 / 61)
    assert [r.peak for r in rates.peak(df).orderBy("ts_ms").collect()] == [0.0, 5.0, 5.0, 5.0]


def test_event_stream(spark, tmp_path):
    rows = [(1, "files_created", '{"entries":[{"path":"/a/x"},{"path":"/b"}]}', None), (2, "files_deleted", '{"path":"/a"}', "u1"), (3, "files_created", '{"path":"/ab"}', None), (4, "ping", None, None)]
    df = spark.createDataFrame(rows, "id int, event_type string, payload string, recipient_user_id string")
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(events.select_events(df, ["files_created"])) == [1, 3] and ids(events.select_events(df, prefix="/a")) == [1, 2]
    assert ids(events.select_events(df, recipient="u2")) == [1, 3, 4] and ids(events.select_events(df, globs=["/a?"])) == [3] and ids(events.select_events(df, [])) == []
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.select_events(events.read(spark, str(tmp_path / "in"), df.schema, 1), prefix="/a")
    for _ in range(2):  # a second run finds nothing new
        events.run_available(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    assert ids(spark.read.parquet(str(tmp_path / "out"))) == [1, 2]


def test_windows_on_a_stream(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01 00:00:10", "a"), ("2024-01-01 00:00:50", "a"), ("2024-01-01 00:01:10", "b"), ("2024-01-01 01:00:00", "z")], "t string, k string").withColumn("ts", F.col("t").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    out = events.tumbling(events.read(spark, str(tmp_path / "in"), df.schema), "ts", "1 minute", ("k",))
    events.run_available(out, str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted((r.k, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 2), ("b", 1)]
    batch = events.sessions(df, "ts", "1 minute", ("k",)).collect()
    assert sorted((r.k, r.n) for r in batch) == [("a", 2), ("b", 1), ("z", 1)]


def test_signature():
    assert events.sign("key", "body") == hmac.new(b"key", b"body", hashlib.sha256).hexdigest()


# --- literals of other types, JSON fields, indexes -------------------------


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(1, "a", True, [1, 2], '{"k":5,"l":[1,2],"t":"5","o":{"p":"x"}}', "2024-01-01 00:00:00"), (2, "5", False, [3], '{"k":"n/a","l":[],"o":[{"p":"x"},{"p":"y"}]}', "2024-02-01 00:00:00"), (3, "b", None, None, '{"k":100,"l":2,"t":null}', None), (4, "c", True, [], "no json", None), (5, None, None, None, None, None), (6, "d", False, [2], '{"k":10,"o":{"p":"z"}}', None)]
    table = spark.createDataFrame(rows, "id int, name string, flag boolean, nums array<int>, body_text string, day string").withColumn("day", F.col("day").cast("timestamp"))
    return Collection("/m", "m", "concat(id, '.json')").load(spark, table)


@pytest.mark.parametrize(("where", "ids"), [
    ({"field": "id", "op": "eq", "value": "abc"}, []), ({"field": "id", "op": "eq", "value": "3"}, [3]), ({"field": "name", "op": "eq", "value": 5}, []), ({"field": "name", "op": "gt", "value": 5}, []),
    ({"field": "id", "op": "in", "value": [1, "x"]}, [1]), ({"field": "id", "op": "in", "value": ["x"]}, []), ({"field": "id", "op": "gt", "value": True}, []), ({"field": "id", "op": "lt", "value": 10**30}, [1, 2, 3, 4, 5, 6]),
    ({"field": "flag", "op": "eq", "value": True}, [1, 4]), ({"field": "flag", "op": "eq", "value": "false"}, [2, 6]), ({"field": "flag", "op": "eq", "value": 1}, []), ({"field": "id", "op": "between", "value": 2, "value2": "x"}, []),
    ({"not": {"field": "id", "op": "eq", "value": "abc"}}, [1, 2, 3, 4, 5, 6]), ({"field": "nums", "op": "eq", "value": 2}, [1, 6]), ({"field": "nums", "op": "in", "value": [3, "q"]}, [2]), ({"field": "nums", "op": "gt", "value": 1}, [1, 2, 6]),
    ({"field": "day", "op": "gt", "value": "2024-01-15"}, [2]), ({"field": "day", "op": "lt", "value": 1_705_000_000_000}, [1]), ({"field": "day", "op": "gt", "value": "soon"}, []),
    ({"field": "body_text.k", "op": "gt", "value": 5}, [3, 6]), ({"field": "body_text.k", "op": "eq", "value": 5}, [1]), ({"field": "body_text.k", "op": "eq", "value": "5"}, []), ({"field": "body_text.t", "op": "eq", "value": "5"}, [1]),
    ({"field": "body_text.k", "op": "between", "value": 5, "value2": 10}, [1, 6]), ({"field": "body_text.k", "op": "in", "value": ["n/a", 100]}, [2, 3]), ({"field": "body_text.k", "op": "lt", "value": "z"}, [2]),
    ({"field": "body_text.l", "op": "eq", "value": 2}, [1, 3]), ({"field": "body_text.l[]", "op": "eq", "value": 2}, [1]), ({"field": "body_text.o[].p", "op": "eq", "value": "y"}, [2]), ({"field": "body_text.o.p", "op": "eq", "value": "z"}, [6]),
    ({"not": {"field": "body_text.k", "op": "gt", "value": 5}}, [1, 2, 4, 5]), ({"field": "body_text.l[0]", "op": "eq", "value": 1}, [1]), ({"field": "body_text./^[kt]$/", "op": "eq", "value": "5"}, [1]),
])
def test_literals_meet_their_own_kind(mixed, where, ids):
    assert sorted(r.id for r in query.matches(mixed, Request.from_json({"where": where})).collect()) == ids


def test_json_fields_order_as_numbers_and_sum(mixed):
    request = {"where": {"field": "id", "op": "gt", "value": 0}, "order_by": [{"field": "body_text.k"}], "select": ["id", "body_text.k"]}
    got = query.rows(mixed, Request.from_json(request)).collect()
    assert [r.id for r in got] == [4, 5, 1, 6, 3, 2] and got[2]["body_text.k"] == "5"
    seen, r = [], Request.from_json(request | {"limit": 2})
    while True:
        page = query.page(mixed, r)
        seen += [x.id for x in page.items.collect()]
        if not page.has_more:
            break
        r.after = page.next_cursor
    assert seen == [4, 5, 1, 6, 3, 2]
    out = query.aggregate(mixed, Request.from_json({"where": {"field": "id", "op": "gt", "value": 0}, "aggregate": {"sum": ["body_text.k"], "min": ["body_text.k"], "max": ["body_text.k"]}})).first()
    assert (out["sum_body_text.k"], out["min_body_text.k"], out["max_body_text.k"]) == (115.0, "5", "n/a")


def test_groups(items):
    page = query.groups(items, Request.from_json({"where": {"field": "value", "op": "lt", "value": 1000}, "aggregate": {"group_by": ["id"]}}))
    assert page.items.count() == 20 and page.total == 50 and page.has_more and page.default_limit_hit
    page = query.groups(items, Request.from_json({"where": {"field": "value", "op": "lt", "value": 30}, "limit": 3, "aggregate": {"group_by": ["id"]}}))
    assert page.items.count() == 3 and page.total == 3 and not page.has_more and not page.default_limit_hit


TEXTS = ["red widget", "blue wijit", "rde wdiget", "WIDGET RED", "widgets redder", "gear", "", None, "smythe", "wid get red", "reed widgit", "x", "the redwidget", "Red  Widget"]


@pytest.mark.parametrize("where", [
    {"op": "match", "value": "red widget"}, {"op": "match", "value": "gear"}, {"op": "similar", "value": "red widget"}, {"op": "similar", "value": "gears", "threshold": 0.1}, {"op": "contains", "value": "D WIDG"}, {"op": "contains", "value": "x"},
    {"op": "phonetic", "value": "Smith"}, {"op": "fuzzy", "value": "red widget"}, {"op": "fuzzy", "value": "red wigdet", "require_candidate": True}, {"op": "fuzzy", "value": "red widget", "algorithm": "jaro_winkler"}, {"op": "eq", "value": "gear"},
])
def test_answers_are_the_same_with_an_index(spark, tmp_path_factory, where):
    table = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, name string")
    df = Collection("/p", "p", "concat(id, '.json')").load(spark, table)
    folder = str(tmp_path_factory.mktemp("index"))
    assert {p["state"] for p in indexes.reindex(df, {"name": list(indexes.STRATEGIES)}, folder)} == {"written"}
    assert {p["state"] for p in indexes.reindex(df, {"name": ["trigram"]}, folder, resume=True)} == {"kept"}
    index = indexes.Index.open(spark, folder)
    both = {"or": [{"field": "name"} | where, {"and": [{"field": "name"} | where, {"field": "id", "op": "lt", "value": 9}]}]}
    for w in ({"field": "name"} | where, both, {"not": both}):
        answers = []
        for i in (None, index):
            r = Request.from_json({"where": w})
            r.index = i
            answers.append(sorted((x.id, round(x.score, 9), x.matched_by) for x in query.matches(df, r).collect()))
        assert answers[0] == answers[1]
    r.index = index
    assert {x["strategy"] for x in query.explain(df, r)["indexes"]} == set(indexes.STRATEGIES)


def test_python_runs_once_a_row(items):
    where = {"and": [{"field": "name", "op": "match", "value": "item number 3"}, {"field": "value", "op": "gt", "value": 100}]}
    plan = query.matches(items, Request.from_json({"where": where}))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1
    assert plan.index("ArrowEvalPython [") < plan.index("> 100")  # the plain condition filters below it


def test_index_refresh_and_stale_entries(spark):
    table = spark.createDataFrame([(1, "red widget"), (2, "blue gear"), (3, "red gear")], "id int, name string")
    df = Collection("/p", "p", "concat(id, '.json')").load(spark, table)
    old = indexes.postings(df, "name", "trigram")
    changed = Collection("/p", "p", "concat(id, '.json')").load(spark, spark.createDataFrame([(2, "green bolt")], "id int, name string"))
    new = indexes.refreshed(old, changed, spark.createDataFrame([("/p/3.json",)], "path string"), {"name": ["trigram"]})
    assert {r.path for r in indexes.candidates(new, "name", "trigram", "red").collect()} == set()
    assert {r.path for r in indexes.candidates(new, "name", "trigram", "bolt").collect()} == {"/p/2.json"}
    r = Request.from_json({"where": {"field": "name", "op": "similar", "value": "red"}})
    r.index = indexes.Index(old)
    assert sorted(x.id for x in query.matches(df.where("id < 3"), r).collect()) == [1]  # the entry of /p/3.json leads nowhere


# --- bitmaps, tasks, forks, repair, streams ----------------------------------


def test_bitmap_sets(spark):
    from quern.operators import bitmaps

    a, b = {0, 1, 63, 64, 200, 5000}, {1, 64, 65, 4999}
    frame = lambda xs: bitmaps.of(spark.createDataFrame([(x,) for x in [*xs, *xs, None, -3]], "n long"), "n")
    numbers = lambda m: {r.number for r in bitmaps.numbers(m).collect()}
    x, y = frame(a), frame(b)
    assert numbers(x) == a and numbers(bitmaps.intersection(x, y)) == a & b and numbers(bitmaps.union(x, y)) == a | b
    assert numbers(bitmaps.symmetric_difference(x, y)) == a ^ b and numbers(bitmaps.difference(x, y)) == a - b
    assert numbers(bitmaps.complement(y, 130)) == set(range(130)) - b and bitmaps.count(x).first()["count"] == 6
    assert bitmaps.count(frame(set())).first()["count"] == 0


def test_task_queue(spark):
    from quern.operators import tasks

    log = spark.createDataFrame([("a", 1, "gc", "{}", "pending", 10), ("b", 1, "gc", "{}", "pending", 5), ("c", 1, "backup", "{}", "pending", 1), ("c", 2, "backup", "{}", "completed", 3), ("d", 1, "gc", "{}", "pending", 2), ("d", 2, "gc", "{}", "running", 4)], "task_id string, seq int, task_type string, args string, status string, at long")
    assert [r.task_id for r in tasks.next_pending(log, 5).collect()] == ["b", "a"]
    begun = log.unionByName(tasks.moved_to(log, tasks.next_pending(log), tasks.RUNNING, F.lit(20).cast("long")))
    assert {r.task_id: r.status for r in tasks.current(begun).collect()} == {"a": "pending", "b": "running", "c": "completed", "d": "running"}
    assert tasks.moved_to(log, log.where("task_id = 'c'"), tasks.CANCELLED, F.lit(9).cast("long")).count() == 0
    assert {r.task_id for r in tasks.cleaned(log, F.lit(4)).collect()} == {"a", "b", "d"}


def test_forks_repair_and_directories(spark):
    head = version(spark, [("/a", "1", 1)])
    forks = versions.create_fork(head.withColumn("version", F.lit("x")), head, "y")
    with pytest.raises(ValueError):
        versions.create_fork(forks, head, "y")
    assert {r.version: r.files for r in versions.list_forks(versions.abandon_fork(forks, "x")).collect()} == {"y": 1}
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    files = spark.createDataFrame([("/a", h("A"), "A"), ("/b", h("B"), "damaged"), ("/c", h("C"), None)], "path string, content_hash string, body string")
    held = spark.createDataFrame([(h("B"), "B"), (h("C"), "not C")], "content_hash string, body string")
    assert {r.path: (r.status, r.body) for r in versions.repaired(files, held).collect()} == {"/a": ("ok", "A"), "/b": ("repaired", "B"), "/c": ("lost", None)}
    assert {r.path for r in versions.broken(files).collect()} == {"/b"}
    with pytest.raises(ValueError):
        versions.removed_directory(spark.createDataFrame([("/d/a",)], "path string"), "/d")
    assert versions.removed_directory(spark.createDataFrame([("/d/a",), ("/dd",)], "path string"), "/d", recursive=True).count() == 1
    links = spark.createDataFrame([("/l", "/x")], "path string, target string")
    assert {r.target for r in versions.linked(versions.linked(links, "/l", "/y"), "/m", "/z").collect()} == {"/y", "/z"}
    ops = versions.three_way_merge(version(spark, [("a", "0", 1)]), version(spark, [("a", "1", 1)]), version(spark, [("a", "2", 2)]))
    assert versions.list_conflicts(ops).count() == 1 and versions.list_conflicts(versions.dismiss_conflicts(ops, ["a"])).count() == 0


def test_event_types_and_heartbeats(spark, tmp_path):
    assert events.checked_types(["heartbeat"]) == ["heartbeat"]
    with pytest.raises(ValueError):
        events.checked_types(["ping"])
    assert [r.intent_time for r in events.heartbeats(spark, 1, 45_000).orderBy("intent_time").collect()] == [15_000, 30_000]
    assert events.heartbeat_stream(spark).isStreaming
    body = spark.createDataFrame([("body",), ("é" * 100,)], "b string")
    for secret in ("key", "k" * 100):
        assert [r.s for r in body.select(events.signature(secret, F.col("b")).alias("s")).collect()] == [events.sign(secret, r.b) for r in body.collect()]
    seen = []
    spark.createDataFrame([(1, "indexes_updated"), (2, "gc_started")], "event_id long, event_type string").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        events.reindex_on(events.read(spark, str(tmp_path / "in"), "event_id long, event_type string"), lambda df: seen.append(df.count()), str(tmp_path / "state")).awaitTermination()
    assert seen == [1]


def test_storage_round_trip_and_kinds(spark):
    rows = spark.createDataFrame([("/a", "text/plain", bytearray(b"x" * 5000)), ("/b", "image/png", bytearray(b"x" * 5000)), ("/c", "text/plain", bytearray(b"short")), ("/d", "text/plain", None)], "path string, content_type string, content binary")
    held = storage.packed(rows)
    assert {r.path: r.compressed for r in held.collect()} == {"/a": True, "/b": False, "/c": False, "/d": False}
    assert sorted(map(str, storage.unpacked(held).select(*rows.columns).collect())) == sorted(map(str, rows.collect()))
    long = spark.createDataFrame([("é" * 5000,), ("a" + "é" * 5000,), ("\x01" + "a" * 9000,)], "t string").select(storage.content_type(F.col("t")).alias("k")).collect()
    assert [r.k for r in long] == ["text/plain", "text/plain", "application/octet-stream"]
