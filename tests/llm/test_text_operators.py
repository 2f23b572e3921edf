import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.llm import decontaminate, language, packing, pii, quality, textops, token_counts
from tests.llm.helpers import awkward, edge_rows, lower, words

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@given(st.lists(st.text(alphabet="aB é\n\t1-Ω", max_size=30), max_size=12))
@settings(max_examples=150, deadline=None)
def test_words_match_the_patterns(texts):
    data, offsets = textops.utf8(pa.array(texts, pa.string()))
    low = textops.lower_table()[data]
    for table, pattern in ((textops.ALNUM, ALNUM), (textops.SPACED, re.compile(r"[^\x20\x09-\x0D]+"))):
        starts, stops, first = textops.split_words(low, offsets, table)
        got = [[bytes(low[a:b]).decode() for a, b in zip(starts[i:j], stops[i:j])] for i, j in zip(first, first[1:])]
        assert got == [pattern.findall(lower(t)) for t in texts]


def test_hashes_depend_on_the_word_alone():
    data, offsets = textops.utf8(pa.array(["xx ab ab yy", "ab", "ba"]))
    starts, stops, _ = textops.split_words(data, offsets, textops.SPACED)
    h = textops.hash_words(data, starts, stops, textops.Powers(), textops.byte_values())
    assert h[1] == h[2] == h[4] and len({*h.tolist()}) == 4


# --- decontamination -------------------------------------------------------


def brute_hits(docs, items, window=8):
    owners = {}
    for i, t in items:
        w = ALNUM.findall(lower(t or ""))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            owners.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, found = ALNUM.findall(lower(t or "")), set(), set()
        for p, own in owners.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    found |= own
                    hit |= set(range(k, k + len(p)))
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


@given(st.integers(0, 10_000))
@settings(max_examples=25, deadline=None)
def test_fm_index_finds_what_brute_force_finds(seed):
    rng = random.Random(seed)
    items = [(k, words(rng.randrange(0, 14), rng, 5)) for k in range(6)]
    docs = [(k, words(rng.randrange(0, 60), rng, 7)) for k in range(9)]
    got = decontaminate.scan(pa.array([t for _, t in docs]), decontaminate.Phrases(items, 4))
    assert sorted([(d[0], *g[:3]) for d, g in zip(docs, got)], key=str) == brute_hits(docs, items, 4)


def test_decontamination_of_awkward_rows(spark):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog again"), (2, "same text"), (2, "same text"), (3, None), (4, ""), (None, "one")], "item_id long, text string")
    docs = awkward(spark, [*edge_rows(), (20, "X! The QUICK, brown fox jumps over the lazy dog", "en")])
    rows = decontaminate.benchmark_hits(docs, items).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows}
    assert (by[1].n_words, by[1].n_hit, by[1].item_ids) == (0, 0, [])
    assert by[9].item_ids == ["2"] and by[9].n_hit == 2
    assert by[20].item_ids == ["1"] and by[20].n_hit == 9 and [tuple(s) for s in by[20].spans] == [(3, 47)]
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, None, 5, 6, 7, 8, 10}
    empty = items.limit(0)
    assert decontaminate.drop_contaminated(docs, empty).count() == docs.count()
    assert decontaminate.benchmark_hits(docs.limit(0), items).collect() == []


# --- packing ---------------------------------------------------------------


def check_packed(rows, docs, size=2048):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in docs}
    pieces, sequences = {}, {}
    for r in rows:
        own = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(own) == r.length and zlib.crc32(own.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i in ids:
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at
            at += length
        assert at == len(ids[i])
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return sum(map(len, ids.values())) / (size * len(sequences))


def test_packing_is_a_partition_of_all_ids(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fill = check_packed(packing.pack(docs.repartition(5), places=4).collect(), docs.select("doc_id", "text").collect())
    assert fill > 0.95  # four places for 200 documents in five partitions


def test_packing_of_awkward_rows(spark):
    rows = [(i, t, l) for i, t, l in edge_rows() if i not in (9, None)] + [(30, "a <|endoftext|> b", "en")]
    docs = awkward(spark, rows)
    check_packed(packing.pack(docs).collect(), [(i, t) for i, t, _ in rows])
    assert packing.pack(docs.limit(0)).collect() == []
    twice = awkward(spark, [(9, "same text", "en"), (9, "same text", "en"), (None, "x", None)])
    assert packing.pack(twice).count() == 3


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_both_forms_of_the_tokenizer_agree(text):
    ours = test_both_forms_of_the_tokenizer_agree.bpe = getattr(test_both_forms_of_the_tokenizer_agree, "bpe", None) or packing.byte_bpe()
    theirs = test_both_forms_of_the_tokenizer_agree.hf = getattr(test_both_forms_of_the_tokenizer_agree, "hf", None) or Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert ours.encode(text, allowed_special="all") == theirs.encode(text, add_special_tokens=False).ids


# --- PII -------------------------------------------------------------------

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and sum(v - 9 if (v := int(c) * (1 + k % 2)) > 9 else v for k, c in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


@given(st.text(alphabet="a@.b-1 2+(0)é%", max_size=40))
@settings(max_examples=500, deadline=None)
def test_base_spans_follow_the_rules(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_pii_of_awkward_rows(spark):
    docs = awkward(spark, [*edge_rows(), (20, "mail a.b@c.de now", "en")])
    rows = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    assert rows[1].base == rows[2].spans == [] and [tuple(s) for s in rows[20].base] == [(5, 13, "email")]
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    changed = {r.doc_id: r for r in out.collect()}
    assert changed[20].text == "mail [EMAIL] now" and changed[20].n_chars == 16 and changed[1].text is None and changed[2].text == ""
    assert pii.find_pii(docs.limit(0)).collect() == [] and pii.redact(docs.limit(0)).collect() == []


def _card(k):
    body = f"41111111111{k:04d}"
    return next(body + str(c) for c in range(10) if pii.luhn(body + str(c)))


def test_a_cue_discovers_what_the_rules_miss(spark):
    rows = [(k, f"some words card: {_card(k)} and more the end", "en") for k in range(40)]
    odd = _card(77)[:-1] + str((int(_card(77)[-1]) + 1) % 10)  # fails Luhn
    rows += [(100, f"again card: {odd} here", "en"), (101, f"the {odd} alone", "en")]
    got = {r.doc_id: r for r in pii.find_pii(awkward(spark, rows)).collect()}
    assert got[100].base == [] and [tuple(s) for s in got[100].spans] == [(12, 28, "card")]
    assert got[101].spans == []


def test_discovered_identifiers_induce_patterns(spark):
    def odd(k):  # fails Luhn
        return _card(k)[:-1] + str((int(_card(k)[-1]) + 1) % 10)

    rows = [(k, f"some words card: {_card(k)} and more the end", "en") for k in range(90)]
    rows += [(100 + k, f"again card: {odd(k)} here", "en") for k in range(12)]
    rows += [(200 + k, f"paid by konto: {odd(k)} here", "en") for k in range(12)]
    rows += [(300, f"paid by konto: {odd(50)} here", "en")]
    got = {r.doc_id: r for r in pii.find_pii(awkward(spark, rows)).collect()}
    assert got[300].base == [] and [tuple(s) for s in got[300].spans] == [(15, 31, "card")]


def test_a_cue_may_be_joined_to_its_mention(spark):
    rows = [(k, f"some words card:{_card(k)} and more the end", "en") for k in range(40)]
    odd = _card(77)[:-1] + str((int(_card(77)[-1]) + 1) % 10)
    rows += [(100, f"again card: {odd} here", "en"), *[(200 + k, f"odd: word and odd:word, {_card(k)}", "en") for k in range(3)]]
    got = {r.doc_id: r for r in pii.find_pii(awkward(spark, rows)).collect()}
    assert got[100].base == [] and [tuple(s) for s in got[100].spans] == [(12, 28, "card")]
    assert list(pii._heads("mail:x@y.z"))[:3] == ["mail:x@y.z", "mail", "mail:"] and list(pii._heads("card41")) == ["card41", "card"]
    assert {r.doc_id: r.text for r in pii.redact(awkward(spark, rows)).collect()}[100] == "again card: [CARD] here"


# --- quality, language, token counts ---------------------------------------


def test_quality_learns_and_keeps_columns(spark):
    rng = random.Random(1)
    good = [(200 + k, words(60, rng) + ". " + words(20, rng) + ".", "en") for k in range(150)]
    bad = [(1000 + k, " ".join(f"W{rng.randrange(99)}!!###" for _ in range(60)), "en") for k in range(40)]
    docs = awkward(spark, [*good, *bad, *edge_rows()])
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in good[:120]] + [(i, 0, 0) for i, _, _ in bad[:24]] + [(5, None, None), (None, 1, 1), (200, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels, F.lit(True))
    scores = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert all(0 <= s <= 1 for s in scores.values())
    assert min(scores[i] for i, _, _ in good) > max(scores[i] for i, _, _ in bad)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {i for i, _, _ in good} <= {r.doc_id for r in kept.collect()}
    nothing = quality.fit(docs.limit(0), labels.limit(0), F.lit(True))
    assert {r.score for r in quality.score(docs, nothing).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).collect() == []


def test_non_negative_risk_separates_without_negatives():
    rng = np.random.default_rng(0)
    p, n = rng.normal(1, 0.5, (300, quality.WIDTH)), rng.normal(-1, 0.5, (100, quality.WIDTH))
    net = quality.Network(0.75).fit(p[:150].astype("f"), np.r_[p[150:], n].astype("f"))
    assert net.score(p).min() > net.score(n).max()


def test_language_of_awkward_rows(spark):
    rng = random.Random(2)
    en = [(200 + k, " ".join(rng.choice(["the", "and", "with", "thing", "where"]) for _ in range(80)), "en") for k in range(40)]
    fr = [(300 + k, " ".join(rng.choice(["été", "où", "leçon", "avec", "eaux"]) for _ in range(80)), "fr") for k in range(40)]
    docs = awkward(spark, [*en, *fr, *edge_rows()])
    net = language.fit(docs, F.lit(True))
    got = {r.doc_id: r for r in language.identify(docs, net).collect()}
    assert {got[i].lang_pred for i, _, _ in en} == {"en"} and {got[i].lang_pred for i, _, _ in fr} == {"fr"}
    assert [got[i].lang_pred for i in (1, 2, 3, 10)] == ["und"] * 4 and all(0 <= r.score <= 1 for r in got.values())
    none = language.fit(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in language.identify(docs, none).collect()} == {"und"}


def test_byte_net_windows_cover_every_byte():
    data, offsets = textops.utf8(pa.array(["a" * 700, "", "bc"]))
    s, row, count = language.windows(data, offsets, np.arange(256, dtype=np.uint8))
    assert count.tolist() == [256, 256, 188, 2] and row.tolist() == [0, 0, 0, 2] and (s[2, 188:] == 0).all() and (s[2, :188] == 97).all()


def brute_tokens(word, table, longest, byte):
    marked = token_counts.MARK + word
    best = [(0.0, 0)]
    for j in range(1, len(marked) + 1):
        b = len(marked[j - 1].encode())
        options = [(best[j - 1][0] + b * byte, best[j - 1][1] + b)]
        options += [(best[i][0] + table[marked[i:j]], best[i][1] + 1) for i in range(max(0, j - longest), j) if marked[i:j] in table]
        top = max(s for s, _ in options)
        best.append((top, min(n for s, n in options if s > top - token_counts.LEAST)))
    return best[-1][1]


def test_trie_shared_counts_equal_word_by_word_counts(spark):
    table, longest, byte = token_counts.unigram()
    rng = random.Random(3)
    some = sorted({"".join(rng.choice("abcethéßЖ漢") for _ in range(rng.randrange(1, 14))) for _ in range(400)} | {"the", "there", "therefore", "x" * 300})
    brute = {w: brute_tokens(w, table, longest, byte) for w in some}
    assert token_counts.count_sorted(some, table, longest, byte) == brute
    some += ["a\0", "\0", "b\0c", "𝔘x", "e" * 47, "e" * 48, "e" * 49]
    rng.shuffle(some)
    trie = token_counts.Trie(table, longest, byte)
    assert trie.counts(some) == brute | {w: brute_tokens(w, table, longest, byte) for w in some} and trie.counts([]) == {}
    # pieces that tie: fewer tokens
    assert token_counts.Trie({"▁a": -1.0, "b": -1.0, "▁ab": -2.0}, 3, -9.0).counts(["ab", "a", "abz"]) == {"ab": 1, "a": 1, "abz": 2}
    got = token_counts.count_tokens(awkward(spark, edge_rows())).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(edge_rows()) and (by[1].n_tokens, by[2].n_tokens, by[3].n_words) == (0, 0, 0)
    assert by[9].n_tokens == sum(brute_tokens(w, table, longest, byte) for w in "same text here again".split())


@pytest.mark.parametrize("name", ["op5_benchmark_decontamination", "op6_packing", "op7_pii", "op10_token_counts"])
def test_map_queries_answer_every_document(spark, sf_dir, name):
    from quern.llm import queries

    assert queries.queries()[name](spark, sf_dir).select("doc_id").distinct().count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_held_out_columns(spark, sf_dir):
    from quern.llm import queries

    for name, n, rest in (("op1_quality_classifier", 5, 0), ("op2_language_id", 4, 2)):
        rows = queries.queries()[name](spark, sf_dir).collect()
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == rest) for r in rows)


@pytest.mark.parametrize("share", [0.15, 0.4, 0.8])
def test_class_prior_of_a_known_mixture(share):
    """Positives and unlabelled rows only: the estimate is near the true share, and not above it by much."""
    rng = np.random.default_rng(int(100 * share))
    good, bad = (lambda n: rng.normal(1.5, 1, (n, 12))), (lambda n: rng.normal(-1.5, 1, (n, 12)))
    n = 3000
    k = int(share * n)
    estimate = quality.estimate_prior(good(1500), np.r_[good(k), bad(n - k)])
    assert share - 0.08 <= estimate <= share + 0.03
    assert quality.estimate_prior(good(5), bad(500)) == 0.5


def test_held_out_quality_and_languages(spark):
    """On the given tables: area under the curve and accuracy of held-out rows."""
    from quern.llm import queries

    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality is not null").collect()}
    rows = [(r.score, r.predicted, labels[r.doc_id]) for r in queries.op1_quality_classifier(spark, sf).collect() if r.held_out and r.doc_id in labels]
    good, bad = [s for s, _, q in rows if q == 1], [s for s, _, q in rows if q == 0]
    assert len(good) > 20 and len(bad) > 5
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad)) >= 0.95
    assert sum(p == q for _, p, q in rows) >= 0.9 * len(rows)
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").where("lang is not null").collect()}
    rows = [(r.lang_pred, lang[r.doc_id]) for r in queries.op2_language_id(spark, sf).collect() if r.held_out and r.doc_id in lang]
    assert len(rows) > 100 and sum(p == t for p, t in rows) >= 0.95 * len(rows)


def test_ids_equal_the_named_tokenizer_on_all_documents(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    named, own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.byte_bpe()
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").toLocalIterator():
        assert own.encode(r.text or "", allowed_special="all") == named.encode(r.text or "", add_special_tokens=False).ids
