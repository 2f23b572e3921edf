"""Small fixtures with every awkward row, and brute-force references."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, held_out string, key string, at int, rep long, sig long, start int"
EXTRA = (0.5, "x", "k", 1, 2, 3, 4)


def words(n, rng, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def awkward(spark, texts, first=0):
    """Rows of documents (with clashing extra columns) from (doc_id, text, lang)."""
    rows = [(i, t, l, None, None if t is None else len(t), *EXTRA) for i, t, l in texts]
    return spark.createDataFrame(rows, SCHEMA)


def edge_rows():
    rng = random.Random(4)
    long = words(20_000, rng)
    return [(1, None, "en"), (2, "", "en"), (3, "  \n\t ", None), (None, "a row without an id", "en"), (5, "one", None), (6, long, "en"), (7, long, "en"), (8, "é" * 3000, "fr"), (9, "same text here again", "en"), (9, "same text here again", "en"), (10, "12 34 !! ??", None)]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def spaced(t):
    return [w for w in re.split("[\x20\x09-\x0d]+", lower(t or "")) if w]


def components(ids, links):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
