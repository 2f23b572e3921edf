import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import json_values, parsers, paths, phonetic, schedule, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("word", "code"), [("Robert", "R163"), ("Rupert", "R163"), ("Smith", "S530"), ("Smythe", "S530"), ("Ashcraft", "A261"), ("Ashcroft", "A261"), ("A", "A000"), ("Lee", "L000"), ("Al", "A400"), ("Aeiou", "A000"), ("12345", ""), ("Tymczak", "T522"), ("Pfister", "P236")])
def test_soundex(spark, word, code):
    assert phonetic.soundex_of(word) == code == one(spark, phonetic.soundex_word(F.lit(word)))


@pytest.mark.parametrize(("word", "code"), [("Thompson", "0MPS"), ("Schmidt", "XMTT"), ("knight", "NT"), ("phone", "FN"), ("xerox", "KSRK"), ("edge", "AJ"), ("ghost", "KST"), ("station", "STXN"), ("church", "XRX"), ("", ""), ("12", ""), ("Wright", "RT"), ("city", "ST"), ("yes", "AS")])
def test_dmetaphone(word, code):
    assert phonetic.dmetaphone(word) == code == phonetic.dmetaphone(word.upper())


@given(st.text(max_size=12))
@settings(max_examples=300, deadline=None)
def test_dmetaphone_is_short_and_ignores_case(word):
    assert len(phonetic.dmetaphone(word)) <= 4
    if word.isascii():
        assert phonetic.dmetaphone(word) == phonetic.dmetaphone(word.lower())


def test_second_code():
    assert phonetic.dmetaphone_alt("Schmidt") == "SMTT" and phonetic.dmetaphone_alt("Smith") is None


def test_trigrams(spark):
    assert text.trigrams_of("hello") == ["  h", " he", "hel", "ell", "llo", "lo "]
    for t in ("hello", "Two words", "a", "", "é-ß x9", "aaa aaa"):
        assert one(spark, text.trigrams(F.lit(t))) == text.trigrams_of(t)
    assert one(spark, text.trigrams_raw(F.lit("ab hello"))) == ["ab", "hel", "ell", "llo"]
    assert one(spark, text.trigram_similarity(F.lit(""), "")) == 0.0


def test_fuzziness_by_length():
    assert [text.auto_fuzziness("a" * n) for n in range(8)] == [0, 0, 0, 1, 1, 1, 2, 2] and text.auto_fuzziness("éé") == 1


@pytest.mark.parametrize(("a", "b", "d"), [("cat", "cats", 1), ("cat", "act", 1), ("ca", "abc", 3), ("", "ab", 2), ("same", "same", 0), ("kitten", "sitting", 3)])
def test_osa(a, b, d):
    assert text.osa(a, b) == text.osa(b, a) == d


@given(st.text(alphabet="abc", max_size=8), st.text(alphabet="abc", max_size=8))
@settings(max_examples=200, deadline=None)
def test_osa_bounds(a, b):
    def levenshtein(x, y):
        row = list(range(len(y) + 1))
        for i, p in enumerate(x, 1):
            row, old = [i], row
            for j, q in enumerate(y, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (p != q)))
        return row[-1]

    assert text.osa(a, b) <= levenshtein(a, b) <= 2 * text.osa(a, b)


def test_jaro_winkler():
    assert text.jaro_winkler("", "") == 1 and text.jaro_winkler("a", "") == 0 and text.jaro_winkler("abc", "xyz") == 0
    assert text.jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.961111, abs=1e-6)
    assert text.jaro_winkler("DIXON", "DICKSONX") == pytest.approx(0.813333, abs=1e-6)


def test_distance_udf_runs_behind_the_prefilter(spark):
    df = spark.createDataFrame([("cat",), ("cats",), ("tac",), (None,), ("elephant",)], "s string")
    assert [r.d for r in df.select(text.osa_within(F.col("s"), "cat", 1).alias("d")).collect()] == [0, 1, None, None, None]


BODY = '{"user": {"name": "Ada", "tags": ["rust", "db"], "a/b": {"~": 5}}, "list": [{"v": 1}, {"v": 2}], "3": "three", "n": null}'


@pytest.mark.parametrize(("path", "values"), [(["user", "name"], ["Ada"]), (["user", "tags", ""], ["rust", "db"]), (["list", "", "v"], ["1", "2"]), (["list", 1, "v"], ["2"]), ([3], ["three"]), (["user", "/^T/i", ""], ["rust", "db"]), (["user", "tags", "/^r/"], ["rust"]), (["absent"], []), (["user", "name", "x"], []), (["list", 9], [])])
def test_walk_paths(spark, path, values):
    assert one(spark, F.transform(json_values.walk_paths(F.lit(BODY), path), json_values.comparable)) == values


def test_json_helpers(spark):
    b = F.lit(BODY)
    assert one(spark, json_values.resolve(b, ["list", 0, "v"], "int")) == 1
    assert one(spark, json_values.pointer(b, "/user/a~1b/~0", "int")) == 5 and one(spark, json_values.pointer(b, "/list/1/v", "int")) == 2
    assert one(spark, json_values.any_equal(b, ["user", "tags", ""], "rust")) and not one(spark, json_values.any_equal(b, ["user", "tags", ""], "go"))
    assert one(spark, F.size(json_values.jq(b, ".list[] | .v"))) == 2
    assert one(spark, json_values.resolve(F.lit("no json"), ["a"])) is None
    for wrong in ("sort_by(.x)", ".a as $x", "if .a then .b end"):
        with pytest.raises(ValueError):
            json_values.jq(b, wrong)
    outputs = lambda e: one(spark, F.transform(json_values.jq(b, e), lambda v: F.to_json(v)))
    assert outputs(".list | .[] | select(.v > 1)") == ['{"v":2}'] and outputs(".list | map(.v)") == ["[1,2]"] and outputs(".user | keys") == ['["a/b","name","tags"]']
    assert outputs(".list | length") == ["2"] and outputs('.user | .tags | .[] | select(. != "db")') == ['"rust"'] and outputs(".list | .[] | select(.v <= 1) | .v") == ["1"]
    assert one(spark, json_values.merge_patch(F.lit("{bad"), F.lit('{"a":1}'))) is None and one(spark, json_values.deep_merge(F.lit('{"a":{"b":1}}'), F.lit("no"))) is None
    assert json_values.segments_of("items[].flag") == ["items", "", "flag"] and json_values.segments_of("a.0./x.y/i") == ["a", 0, "/x.y/i"]


@pytest.mark.parametrize(("target", "patch", "depth", "out"), [
    ({"a": 1, "b": 2}, {"b": None, "c": 3}, None, {"a": 1, "c": 3}),
    ({"u": {"n": 1, "p": {"t": 1, "l": 2}}}, {"u": {"p": {"t": 9}}}, None, {"u": {"n": 1, "p": {"t": 9, "l": 2}}}),
    ({"u": {"n": 1, "p": {"t": 1}}}, {"u": {"p": {"x": 9}}}, 1, {"u": {"p": {"x": 9}}}),
    ({"u": {"n": 1, "p": {"t": 1}}}, {"u": {"p": {"x": 9}, "n": 2}}, 2, {"u": {"n": 2, "p": {"x": 9}}}),
    ({"u": {"n": 1}}, {"u": {"n": 2}, "w": 1, "z": {}}, -1, {"u": {"n": 1}, "w": 1}),
    ({"u": 1}, {"x": 2}, 0, {"x": 2}), ({"a": 1}, [1], None, [1]), (5, {"a": {"b": None}}, None, {"a": {}}),
])
def test_merge_patch(target, patch, depth, out):
    assert json_values.merge_patch_value(target, patch, depth) == out


def test_deep_merge_keeps_nulls():
    assert json_values.deep_merge_value({"a": {"b": 1}, "c": 1}, {"a": {"b": None, "d": 2}}) == {"a": {"b": None, "d": 2}, "c": 1}


@pytest.mark.parametrize(("value", "ms"), [("1970-01-01T00:00:01Z", 1000), ("1970-01-01T00:00:01.5", 1500), ("1970-01-02", 86_400_000), ("1234", 1234), ("1970-01-01T01:00:00+01:00", 0), ("never", 0)])
def test_timestamps(spark, value, ms):
    assert one(spark, json_values.parse_timestamp(F.lit(value))) == ms


@pytest.mark.parametrize(("path", "out"), [("/a//b/", "/a/b"), ("a/./b/../c", "/a/c"), ("/../..", "/"), ("", "/"), (" /x\0y ", "/xy")])
def test_paths(spark, path, out):
    assert paths.normalise(path) == out == one(spark, paths.normalise_column(F.lit(path)))


@pytest.mark.parametrize(("glob", "path", "fits"), [("*.txt", "a.txt", True), ("*.txt", "d/a.txt", False), ("**/*.txt", "d/e/a.txt", True), ("**/*.txt", "a.txt", True), ("a?c", "abc", True), ("a?c", "a/c", False), ("/x/**", "/x/y/z", True), ("a.c", "abc", False)])
def test_globs(spark, glob, path, fits):
    assert one(spark, paths.glob_match(F.lit(path), glob)) is fits


def test_path_parts(spark):
    assert one(spark, paths.ancestors(F.lit("/a/b/c.txt"))) == ["/", "/a", "/a/b"] and one(spark, paths.parent(F.lit("/a"))) == "/"
    assert one(spark, paths.extension(F.lit("x.tar.gz"))) == "gz" and one(spark, paths.extension(F.lit("none"))) == ""


def test_cron(spark):
    at = F.lit("2024-01-07 08:30:59").cast("timestamp")  # a Sunday
    for expression, fits in (("30 8 * * 0", True), ("30 8 * * 7", True), ("30 8 * * sun", True), ("*/15 * * * *", True), ("* * * * 1-5", False), ("31 8 * * *", False), ("30 8 7 1 *", True), ("0,30 6-9/2 * jan *", True)):
        assert one(spark, schedule.cron_match(at, expression)) is fits, expression
    with pytest.raises(ValueError):
        schedule.cron_match(at, "* * * *")


def test_text_parser(spark):
    meta = parsers.text_metadata(F.col("t"), F.lit("a.py"), F.lit("text/plain"))
    row = spark.createDataFrame([("﻿\n  Title here \r\nx y\n",), ("",)], "t string").select(*(c.alias(n) for n, c in meta.items())).collect()
    assert (row[0].title, row[0].line_count, row[0].word_count, row[0].language, row[0].has_bom) == ("Title here", 3, 4, "python", True)
    assert (row[1].title, row[1].line_count, row[1].is_empty) == ("", 0, True)


def test_html_parser(spark):
    page = '<html><head><TITLE>A &amp; B</title><meta name="description" content="d1"><style>p{}</style></head><!-- <a href=x> --><body><h2>One <b>two</b></h2><script>var t="</p>";</script><a href="1">x</a><p>5 &lt; 6 &#65;&#x42; &copy; &amp;lt;</p></body></html>'
    meta = parsers.html_metadata(F.lit(page))
    row = spark.range(1).select(*(c.alias(n) for n, c in meta.items())).first()
    assert (row.title, row.description, row.headings) == ("A &amp; B", "d1", ["One two"]) and row.link_count == 2
    assert row.text == "A & B One two x 5 < 6 AB &copy; &lt;"
    xml = parsers.xml_metadata(F.lit('<?xml version="1.0"?><feed xmlns="u:a" xmlns:m="u:b"><x/></feed>'))
    assert one(spark, xml["root_element"]) == "feed" and one(spark, xml["namespaces"]) == ["u:a", "u:b"]
