"""Text functions: trigrams, Dice similarity, edit distances.

Trigram functions and prefilters are built-in expressions; only the exact
distances that Spark lacks run as Arrow-batched UDFs, behind the prefilters.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{IsAlphabetic}\p{N}]+"), lambda w: w != "")


def _windows(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(word) - 2), lambda k: F.substring(word, k, F.lit(3)))


def trigrams(text: Column) -> Column:
    """Distinct three-letter windows of each lower-cased word, padded by two blanks before and one behind."""
    return F.array_distinct(F.flatten(F.transform(_words(text), lambda w: _windows(F.concat(F.lit("  "), w, F.lit(" "))))))


def trigrams_raw(text: Column) -> Column:
    """Windows without padding; a word of fewer than three letters counts whole."""
    return F.array_distinct(F.flatten(F.transform(_words(text), lambda w: F.when(F.length(w) < 3, F.array(w)).otherwise(_windows(w)))))


def trigrams_of(text: str) -> list[str]:
    """trigrams() of a literal, computed once on the driver."""
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return list(dict.fromkeys(p[k : k + 3] for w in words for p in [f"  {w} "] for k in range(len(p) - 2)))


def trigrams_inside(text: str) -> list[str]:
    """Windows that lie inside the words of a literal: whatever contains it has all of them."""
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return list(dict.fromkeys(w[k : k + 3] for w in words for k in range(len(w) - 2)))


def dice(a: Column, b: Column) -> Column:
    """2 |A n B| / (|A| + |B|) of two token arrays; 0 if both are empty."""
    total = F.size(a) + F.size(b)
    return F.when(total > 0, 2.0 * F.size(F.array_intersect(a, b)) / total).otherwise(F.lit(0.0))


def trigram_similarity(text: Column, query: str) -> Column:
    tokens = trigrams_of(query)
    return dice(trigrams(text), F.array(*map(F.lit, tokens)).cast("array<string>"))


def auto_fuzziness(query: str) -> int:
    """Edits allowed by the length of the query in bytes: 0 below 3, 1 below 6, else 2."""
    n = len(query.encode())
    return 0 if n < 3 else 1 if n < 6 else 2


def osa(a: str, b: str) -> int:
    """Optimal string alignment: edits and swaps of neighbours, no part edited twice."""
    older, old = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            cost = min(old[j] + 1, new[j - 1] + 1, old[j - 1] + (x != y))
            if older is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            new.append(cost)
        older, old = old, new
    return old[-1]


def jaro_winkler(a: str, b: str) -> float:
    """Half transpositions are not rounded; a common prefix of up to four signs counts 0.1 each."""
    if not a or not b:
        return float(not a and not b)
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free = [True] * len(b)
    left = []
    for i, x in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if free[j] and b[j] == x), None)
        if j is not None:
            free[j] = False
            left.append(x)
    if not left:
        return 0.0
    right = [y for y, f in zip(b, free, strict=True) if not f]
    swapped = sum(x != y for x, y in zip(left, right, strict=True)) / 2
    m = len(left)
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    prefix = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro)


def _distinct_apply(values: pd.Series, function) -> pd.Series:
    """function once for each distinct non-null value of a batch."""
    known = {v: function(v) for v in values.dropna().unique()}
    return values.map(known)


def osa_distance(text: Column, query: str, once: bool = False) -> Column:
    """once: the optimiser may not copy the call into every place that refers to it."""

    @F.pandas_udf("int")
    def distance(values: pd.Series) -> pd.Series:
        return _distinct_apply(values, lambda v: osa(v, query)).astype("Int32")

    return (distance.asNondeterministic() if once else distance)(text)


def osa_near(text: Column, query: str, k: int) -> Column:
    """The text where its distance can be at most k, else null: it spares the UDF almost every row."""
    near = (F.abs(F.length(text) - len(query)) <= k) & (F.levenshtein(text, F.lit(query), 2 * k) != -1)
    return F.when(near, text)


def osa_within(text: Column, query: str, k: int) -> Column:
    """The distance where it is at most k, else null."""
    d = osa_distance(osa_near(text, query, k), query)
    return F.when(d <= k, d)


def jaro_winkler_score(text: Column, query: str, once: bool = False) -> Column:
    @F.pandas_udf("double")
    def score(values: pd.Series) -> pd.Series:
        return _distinct_apply(values, lambda v: jaro_winkler(v, query)).astype("Float64")

    return (score.asNondeterministic() if once else score)(text)
