import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import common, jaccard, neardup_graph, queries, sentence_spans, suffixes
from tests.llm.helpers import awkward, components, edge_rows, spaced, words


def near_copies(seed=5, groups=6, per=9):
    rng = random.Random(seed)
    rows, k = [], 100
    for g in range(groups):
        base = words(rng.choice([4, 9, 30, 120, 400]), rng, 5000).split()
        for _ in range(per):
            own = list(base)
            for _ in range(rng.randrange(0, max(2, len(own) // 25))):
                own[rng.randrange(len(own))] = f"edit{rng.randrange(10**6)}"
            rows.append((k, " ".join(own), "en"))
            k += 1
    return rows


def brute_components(rows, width, percent):
    sets = {}
    for i, t, *_ in rows:
        w = spaced(t)
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in components(ids, links).items()}


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components_are_exact(spark, width, percent):
    rows = [r for r in edge_rows() if r[0] is not None] + near_copies()
    got = jaccard.jaccard_components(awkward(spark, rows), width, percent).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, width, percent)


def test_jaccard_of_awkward_rows(spark):
    docs = awkward(spark, edge_rows())
    got = jaccard.jaccard_components(docs).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(edge_rows()) and by[None].component_id is None and by[None].n_shingles == 3
    assert by[7].component_id == 6 and by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0
    assert jaccard.jaccard_components(docs.limit(0)).collect() == []
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, None, 5, 6, 8, 9, 10], key=str)


@given(st.integers(0, 100_000), st.sampled_from([80, 90]))
@settings(max_examples=150, deadline=None)
def test_linked_sets_share_a_signature(seed, percent):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, rng.choice([rng.integers(1, 300), rng.integers(300, 5000)]), dtype=np.uint64)
    b = a[rng.random(len(a)) > rng.choice([0.03, 0.06, 0.1])]
    b = np.unique(np.r_[b, rng.integers(0, 1 << 63, rng.integers(0, 1 + len(a) // 15), dtype=np.uint64)])
    a = np.unique(a)
    common_ = len(np.intersect1d(a, b))
    if len(b) and 100 * common_ >= percent * (len(a) + len(b) - common_):
        bands = jaccard.Bands(percent)
        short = frozenset({jaccard.falls_short(s, bands) for s in (a, b)} - {None})
        assert np.intersect1d(jaccard.signatures(a, bands, short), jaccard.signatures(b, bands, short)).size
        x, y = (np.array(jaccard.sketch(s), np.int64) for s in (a, b))
        assert sum(int(v).bit_count() for v in (x ^ y).view(np.uint64)) <= len(a) + len(b) - 2 * common_ <= jaccard.difference(len(a) + len(b), percent)


def test_components_of_chains_stars_and_circles(spark):
    rng = random.Random(8)
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(300, 301), (301, 302), (302, 300)] + [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(60)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for e in edges for x in e if e[0] != e[1]}
    assert got == {i: c for i, c in components(sorted(linked), edges).items()}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- passages --------------------------------------------------------------


def passages(seed=6):
    rng = random.Random(seed)
    shared = [words(n, rng, 10**6) for n in (55, 60, 80, 300)]
    rows = []
    for k in range(24):
        parts = [words(rng.randrange(5, 120), rng, 10**6)]
        if k % 2 == 0:
            parts += [shared[k // 2 % 4], words(rng.randrange(5, 120), rng, 10**6)]
        rows.append((k, " ".join(parts), "en"))
    return rows, shared


def test_suffixes_find_every_long_passage(spark):
    rows, shared = passages()
    got = {r.doc_id: r for r in suffixes.repeated_passages(awkward(spark, rows)).collect()}
    assert set(got) == {k for k in range(24) if k % 2 == 0}
    for k, r in got.items():
        t, p = spaced(rows[k][1]), spaced(shared[k // 2 % 4])
        at = next(i for i in range(len(t)) if t[i : i + len(p)] == p)
        assert [tuple(s) for s in r.spans] == [(at, at + len(p))] and k not in r.kept_in
        assert (r.later, r.kept_in) == ([], []) if k < 8 else r.later == r.spans and k % 8 in r.kept_in and {x % 8 for x in r.kept_in} == {k % 8} and max(r.kept_in) < k


def test_suffixes_of_awkward_rows(spark):
    docs = awkward(spark, [*edge_rows(), (40, "und " * 500, "de")])
    got = {r.doc_id: r for r in suffixes.repeated_passages(docs).collect()}
    assert set(got) == {6, 7} and [tuple(s) for s in got[6].spans] == [(0, 20_000)] and got[6].later == got[6].kept_in == [] and got[7].later == got[7].spans and got[7].kept_in == [6]
    assert suffixes.repeated_passages(docs.limit(0)).collect() == []


def overlapping(seed, n=160):
    """Documents with passages that nest and overlap among many of them; places such as 100 and 104 begin in many."""
    rng = random.Random(seed)
    pool, out = words(4000, rng, 10**6).split(), []
    for k in range(n):
        parts = [words(rng.randrange(0, 40), rng, 10**6)]
        for _ in range(rng.randrange(0, 4)):
            a = rng.choice([0, 17, 33, 90, 100, 104, 130, rng.randrange(3800)])
            parts += [" ".join(pool[a : a + rng.choice([20, 36, 49, 50, 51, 60, 75, 140])]), words(rng.randrange(0, 30), rng, 10**6)]
        out.append((k, " ".join(parts), "en"))
    return out


def brute_cover(rows, n, earlier):
    """By document: its words inside runs of n words that another (or an earlier) document has too."""
    texts, owners, out = {i: spaced(t) for i, t, _ in rows}, {}, {}
    for i, w in texts.items():
        for k in range(len(w) - n + 1):
            owners.setdefault(tuple(w[k : k + n]), set()).add(i)
    for i, w in texts.items():
        out[i] = set()
        for k in range(len(w) - n + 1):
            own = owners[tuple(w[k : k + n])]
            if (min(own) < i) if earlier else len(own) > 1:
                out[i].update(range(k, k + n))
    return out


@pytest.mark.parametrize("parts", [3, 40])
def test_suffixes_cover_every_shared_word(spark, parts, monkeypatch):
    """Exactly the words of 50-word passages, and none that no shared run of 35 words holds; with 40 ranges keys are cut by many borders."""
    monkeypatch.setattr(suffixes, "range_parts", lambda df: parts)
    rows = overlapping(parts)
    docs = awkward(spark, rows)
    found = common.materialise(suffixes.repeated_passages(docs))
    got = {r.doc_id: r for r in found.collect()}
    for column, earlier in (("spans", False), ("later", True)):
        must, may = brute_cover(rows, 50, earlier), brute_cover(rows, 35, earlier)
        for i, *_ in rows:
            have = {x for s in (got[i][column] if i in got else []) for x in range(s.start, s.end)}
            assert must[i] <= have <= may[i]
    # every word that is cut out (they are as good as unique) is left elsewhere, and no passage is left twice
    left = suffixes.remove_passages(docs, found)
    assert left.columns == docs.columns
    texts = [(r.doc_id, r.text, "en") for r in left.collect()]
    assert {w for _, t, _ in rows for w in spaced(t)} == {w for _, t, _ in texts for w in spaced(t)}
    assert sum(len(spaced(t)) for _, t, _ in rows) - sum(len(spaced(t)) for _, t, _ in texts) == sum(s.end - s.start for r in got.values() for s in r.later)
    assert not any(brute_cover([(i, t, "en") for i, t, _ in texts], 50, False).values())


@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 3)), max_size=60), st.integers(1, 9))
@settings(max_examples=200, deadline=None)
def test_rows_of_shared_keys_from_any_batches(rows, size):
    rows = sorted((k, d, n) for n, (k, d) in enumerate(rows))
    columns = [np.array([r[c] for r in rows], np.int64) for c in range(3)]
    batches = [[c[a : a + size] for c in columns] for a in range(0, len(rows), size)]
    got = [tuple(int(c[n]) for c in b) for b in suffixes.shared_rows(iter(batches)) for n in range(len(b[0]))]
    docs = {}
    for k, d, _ in rows:
        docs.setdefault(k, set()).add(d)
    edge = {rows[0][0], rows[-1][0]} if rows else set()
    assert got == [r for r in rows if len(docs[r[0]]) > 1 or r[0] in edge]


def brute_runs(rows):
    """First places of all runs, in plain Python."""
    import re

    seen, lost = {}, {}
    for i, t, *_ in sorted(rows):
        pieces = []
        for line in re.split("[\n\r]", t or ""):
            own = []
            for m in re.finditer("[^\x20\x09-\x0d]+", line):
                own.append(m)
                if m[0][-1] in ".!?":
                    pieces += [own[k : k + 20] for k in range(0, len(own), 20)]
                    own = []
            pieces += [own[k : k + 20] for k in range(0, len(own), 20)]
        out = []
        for a in range(len(pieces)):
            n = next((b for b in range(a + 1, len(pieces)) if b - a >= 1 and sum(map(len, pieces[a : b + 1])) >= 25), None)
            if n is not None:
                out.append(" ".join(m[0] for p in pieces[a : n + 1] for m in p).lower())
        for a, key in enumerate(out):
            if key in seen:
                lost.setdefault(i, set()).add(key)
            seen.setdefault(key, (i, a))
    return lost


def test_sentence_runs_agree_with_plain_python(spark):
    rng = random.Random(9)
    pool = [" ".join(f"v{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 30))) + rng.choice(".!?") for _ in range(40)]
    rows = [(k, " ".join(pool[(a := rng.randrange(40)) : a + rng.randrange(1, 12)]), "en") for k in range(60)]
    got = {r.doc_id for r in sentence_spans.repeated_spans(awkward(spark, rows)).collect()}
    assert got == set(brute_runs(rows))


def test_repeated_sentences_go_but_once(spark):
    rng = random.Random(10)
    p = ". ".join(words(14, rng, 10**6) for _ in range(4)) + "."
    own = [words(12, rng, 10**6) + "." for _ in range(6)]
    docs = awkward(spark, [(1, f"{own[0]} {p} {own[1]}", "en"), (2, f"{own[2]}\n{p}\n{own[3]}", "en"), (3, f"{own[4]} {own[5]}", "en"), *[(i and i + 50, t, l) for i, t, l in edge_rows()]])
    spans = sentence_spans.repeated_spans(docs)
    got = {r.doc_id: r for r in spans.collect()}
    assert set(got) == {2, 57} and got[2].kept_in == [1]
    left = {r.doc_id: r.text for r in sentence_spans.remove_spans(docs, spans).collect()}
    assert spaced(left[2]) == spaced(f"{own[2]} {own[3]}") and spaced(left[1]) == spaced(f"{own[0]} {p} {own[1]}")
    assert sentence_spans.repeated_spans(docs.limit(0)).collect() == []


def test_short_runs_of_sentences_are_found(spark, tmp_path):
    rng = random.Random(14)
    own = [words(12, rng, 10**6) + "." for _ in range(8)]
    p = ". ".join(words(14, rng, 10**6) for _ in range(4)) + "."
    rows = [(1, f"{own[0]} Read on. See below. {own[1]}", "en"), (2, f"{own[2]} Read on. See below. {own[3]}", "en"), (3, "One two. Three!", "en"), (4, "one two. three!", "en"), (5, f"{own[4]} Read on. {own[5]}", "en"), (6, f"{own[6]} {p}", "en"), (7, f"{p} {own[7]}", "en")]
    awkward(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op9_substring_dedup(spark, str(tmp_path)).collect()}
    kept = {i: [t[a:b] for a, b in got[i].spans] for i, t, _ in rows if i in got}
    assert kept == {2: ["Read on. See below."], 4: ["one two. three!"], 7: [p]}
    assert {i: r.kept_in for i, r in got.items()} == {2: [1], 4: [3], 7: [6]}


# --- embeddings ------------------------------------------------------------


def vectors(seed, n, clusters, dims=24):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        c = np.random.default_rng(k % clusters).normal(size=dims)
        v = c + rng.normal(size=dims) * (0.22 if k % 3 else 0.02)
        rows.append((k, [float(np.float32(x)) for x in v], k % clusters % 3))
    return rows


def brute_links(rows, threshold=0.93):
    good = [(i, np.array(v), l) for i, v, l in rows if i is not None and v and l is not None and None not in v and np.isfinite(v).all() and any(v)]
    links = [(a, b) for x, (a, u, l) in enumerate(good) for b, w, m in good[x + 1 :] if l == m and len(u) == len(w) and u @ w / np.linalg.norm(u) / np.linalg.norm(w) >= threshold]
    ids = sorted({i for i, _, _ in rows if i is not None})
    n = {i: 0 for i in ids}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    comp = components(ids, links)
    return {i: (n[i], comp[i], comp[i] == i) for i in ids}


def test_graph_search_reaches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup_graph, "LARGE", 100)
    monkeypatch.setattr(neardup_graph, "CELL", 60)
    monkeypatch.setattr(neardup_graph, "BLOCK", 50)  # so that cells and blocks occur
    rows = vectors(1, 700, 40)
    rows += [(1000 + k, rows[0][1], rows[0][2]) for k in range(20)]  # exact copies
    got = neardup_graph.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    expected = brute_links(rows)
    assert len(got) == len(rows)
    true, have = sum(v[0] for v in expected.values()), sum(r.n_links for r in got)
    assert all(r.n_links <= expected[r.vec_id][0] for r in got) and have >= 0.97 * true


def test_embeddings_of_awkward_rows(spark):
    nan, v = float("nan"), [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (2, [2.0, 4.0, 6.0], 0), (3, v, 1), (4, v, None), (5, None, 0), (6, [0.0, 0.0, 0.0], 0), (7, [1.0, None, 3.0], 0), (8, [nan, 2.0, 3.0], 0), (9, [], 0), (10, v + [0.0], 0), (11, v, 0), (11, v, 0), (None, v, 0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, rep string, n int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup_graph.near_duplicates(df).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 11: (2, 1, False), **{i: (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10)}}
    assert neardup_graph.near_duplicates(df.limit(0)).collect() == []


def test_links_of_large_labels_are_whole(spark, monkeypatch):
    """Single near pairs among isotropic vectors, which many pivots part, and copied groups, whose many links are easily found."""
    rng = np.random.default_rng(12)
    monkeypatch.setattr(neardup_graph, "LARGE", 60)
    monkeypatch.setattr(neardup_graph, "CELL", 20)
    monkeypatch.setattr(neardup_graph, "BLOCK", 30)
    plain = rng.normal(size=(3000, 64))
    near = plain[:100] / np.linalg.norm(plain[:100], axis=1)[:, None]
    side = rng.normal(size=near.shape)
    side -= (side * near).sum(1)[:, None] * near
    near = 0.935 * near + np.sqrt(1 - 0.935**2) * side / np.linalg.norm(side, axis=1)[:, None]
    groups = rng.normal(size=(40, 64))
    copies = np.repeat(np.r_[groups, groups + 1e-3], 20, 0)
    rows = [(k, v.tolist(), 0) for k, v in enumerate(np.r_[plain, near, copies])]
    got = neardup_graph.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    links = {r.vec_id: r.n_links for r in got}
    assert len(got) == len(rows) and sum(links[k] > 0 for k in range(100)) >= 97


@pytest.mark.parametrize("chunk", [32 << 20, 40_000])
def test_what_cannot_be_audited_is_compared_exactly(spark, monkeypatch, chunk):
    monkeypatch.setattr(neardup_graph, "LARGE", 100)
    monkeypatch.setattr(neardup_graph, "CELL", 60)
    monkeypatch.setattr(neardup_graph, "BLOCK", 50)
    monkeypatch.setattr(neardup_graph, "CHUNK", chunk)
    monkeypatch.setattr(neardup_graph, "search", lambda v, *_: np.zeros((len(v), len(v)), bool))  # a search that finds nothing
    rows = vectors(2, 500, 40)
    rows += [(1000 + k, rows[0][1], rows[0][2]) for k in range(9)]
    got = neardup_graph.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == brute_links(rows)


def test_labels_of_any_type(spark):
    rows = [(1, [1.0, 0.0], "a/2"), (2, [1.0, 0.01], "a/2"), (3, [1.0, 0.0], "a"), (4, [1.0, 0.0], None), (5, [1.0, 0.02], "a/2")]
    text = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    assert {r.vec_id: (r.n_links, r.component_id) for r in neardup_graph.near_duplicates(text).collect()} == {1: (2, 1), 2: (2, 1), 5: (2, 1), 3: (0, 3), 4: (0, 4)}
    wide = text.withColumn("label", text.label.isNotNull().cast("long") * (1 << 40))
    assert sum(r.n_links for r in neardup_graph.near_duplicates(wide.where("label is not null")).collect()) == 4 * 3


def test_lists_of_small_clusters_hold_the_near_ones():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 32))
    v = np.r_[base, base[:200] + 0.1 * rng.normal(size=(200, 32)), rng.normal(size=(1500, 32)), np.repeat(rng.normal(size=(1, 32)), 500, 0)]
    v /= np.linalg.norm(v, axis=1)[:, None]
    near = neardup_graph.build(v)
    one, place = np.nonzero(near >= 0)
    assert near.shape == (2500, neardup_graph.DEGREE) and (near != np.arange(2500)[:, None]).all()
    found = neardup_graph.search(v, neardup_graph.undirected(one, near[one, place], len(v)), 0.93, neardup_graph.SLACK)
    true = v @ v.T >= 0.93
    np.fill_diagonal(true, False)
    assert not (found & ~true).any() and found.sum() >= 0.995 * true.sum()


def test_jaccard_of_near_copies_that_mostly_do_not_link(spark):
    """A large star with many components."""
    rng = random.Random(21)
    base = words(120, rng, 10**6).split()
    rows = []
    for k in range(150):
        own = list(base)
        for _ in range(rng.choice([1, 3, 3, 4, 4])):
            own[rng.randrange(len(own))] = f"edit{rng.randrange(10**6)}"
        rows.append((k, " ".join(own), "en"))
    got = jaccard.jaccard_components(awkward(spark, rows), 3, 90).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 3, 90)
    assert 1 < len({r.component_id for r in got}) < len(rows)


def test_large_graphs_are_resolved_by_joins(spark, monkeypatch):
    monkeypatch.setattr(common, "SMALL_GRAPH", 0)
    rng = random.Random(9)
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(60)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict(components(sorted({x for e in edges for x in e if e[0] != e[1]}), edges).items())


@pytest.mark.parametrize(("rows", "small"), [(1_000_000, True), (1_100_000, False)])
def test_broadcasts_are_bounded_by_bytes(spark, rows, small):
    df = spark.range(5)
    assert common.is_small(df, rows) == small and not common.is_small(df.selectExpr("id", "id as b", "cast(id as string) as t"), rows)
    hinted = "broadcast" in common.small_side(df, rows)._jdf.queryExecution().logical().toString().lower()
    assert hinted == small


def test_spans_are_cut_from_tables_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "abc def", "s"), (2, None, "t"), (3, "xyz", "u")], "doc_id long, text string, _spans string")
    spans = spark.createDataFrame([(1, [(0, 4)])], "doc_id long, spans array<struct<start:int,end:int>>")
    assert sorted(map(tuple, sentence_spans.remove_spans(docs, spans).collect()), key=str) == [(1, "def", "s"), (2, None, "t"), (3, "xyz", "u")]


def test_spans_equal_brute_force(spark):
    """Spans and keepers of two-sentence runs, word for word."""
    rng = random.Random(13)
    pool = [words(rng.randrange(2, 9), rng, 60) + rng.choice(".!?") for _ in range(40)]
    rows = [(k, rng.choice([" ", "\n"]).join(rng.choice(pool) for _ in range(rng.randrange(0, 12))), "en") for k in range(60)]
    got = {r.doc_id: r for r in sentence_spans.repeated_spans(awkward(spark, rows), min_words=1).collect()}
    first, cover, keepers = {}, {}, {}
    for i, t, _ in rows:
        cut, at = [], 0
        for m in __import__("re").finditer(r"[^\s][^.!?\n]*[.!?]", t):
            cut.append((m.start(), m.end(), tuple(spaced(m[0]))))
        for (a, _, x), (_, b, y) in zip(cut, cut[1:]):
            key = (x + y)
            if key in first:
                cover.setdefault(i, set()).update(range(a, b))
                keepers.setdefault(i, set()).add(first[key])
            else:
                first[key] = i
    assert set(got) == set(cover)
    for i, r in got.items():
        assert {x for s in r.spans for x in range(s.start, s.end)} == cover[i] and set(r.kept_in) == keepers[i]
