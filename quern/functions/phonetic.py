"""Soundex (built in) and a reduced Double Metaphone (rules as data, one scanner)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# A reduced form of the published algorithm: no rules for Slavic, Germanic, Spanish
# or French spellings, TH always 0, a second code for SCH only, codes of four signs.
# For each letter its rules in order, as (what stands before, what
# the letter and its followers look like, code, letters consumed). An empty
# condition always holds; ^ is the word's start.
RULES: dict[str, list[tuple[str, str, str, int]]] = {
    "A": [("^", "A", "A", 1), ("", "A", "", 1)],
    "B": [("", "BB", "P", 2), ("", "B", "P", 1)],
    "C": [("", "CH", "X", 2), ("", "C[IEY]", "S", 2), ("", "CC(?![IE])", "K", 2), ("", "C", "K", 1)],
    "D": [("", "DG[IEY]", "J", 3), ("", "DD", "T", 2), ("", "D", "T", 1)],
    "E": [("^", "E", "A", 1), ("", "E", "", 1)],
    "F": [("", "FF", "F", 2), ("", "F", "F", 1)],
    "G": [("[AEIOU]", "GH", "", 2), ("", "GH", "K", 2), ("", "GN", "", 2), ("(?<!G)", "G[IEY]", "J", 2), ("^", "GG", "K", 2), ("", "GG", "", 2), ("", "G", "K", 1)],
    "H": [("(?<![AEIOU])", "H[AEIOU]", "H", 1), ("", "H", "", 1)],
    "I": [("^", "I", "A", 1), ("", "I", "", 1)],
    "J": [("", "JJ", "J", 2), ("", "J", "J", 1)],
    "K": [("C", "K", "K", 2), ("", "K", "K", 1)],
    "L": [("", "LL", "L", 2), ("", "L", "L", 1)],
    "M": [("", "MM", "M", 2), ("", "M", "M", 1)],
    "N": [("", "NN", "N", 2), ("", "N", "N", 1)],
    "O": [("^", "O", "A", 1), ("", "O", "", 1)],
    "P": [("", "PH", "F", 2), ("", "PP", "P", 2), ("", "P", "P", 1)],
    "Q": [("", "QQ", "K", 2), ("", "Q", "K", 1)],
    "R": [("", "RR", "R", 2), ("", "R", "R", 1)],
    "S": [("", "SH", "X", 2), ("", "SCH", "X", 3), ("", "S[IE][OA]", "X", 3), ("", "S[SZ]", "S", 2), ("", "S", "S", 1)],
    "T": [("", "TH", "0", 2), ("", "TI[OA]", "X", 3), ("", "TT", "T", 2), ("", "T", "T", 1)],
    "U": [("^", "U", "A", 1), ("", "U", "", 1)],
    "V": [("", "VV", "F", 2), ("", "V", "F", 1)],
    "W": [("", "W[AEIOU]", "A", 1), ("", "W", "", 1)],
    "X": [("", "XX", "KS", 2), ("", "X", "KS", 1)],
    "Y": [("", "Y[AEIOU]", "A", 1), ("", "Y", "", 1)],
    "Z": [("", "ZZ", "S", 2), ("", "Z", "S", 1)],
}
SILENT_START = re.compile("GN|KN|PN|AE|WR")
CODE_LENGTH = 4


def _compiled():
    def before(b: str) -> str:
        return "^" if b == "^" else f"(?<={b})" if b.startswith("[") or b.isalpha() else b

    return {c: [(re.compile(before(b) + p), code, used) for b, p, code, used in rules] for c, rules in RULES.items()}


def dmetaphone(word: str) -> str:
    """The primary code, at most four signs."""
    letters = re.sub("[^A-Z]", "", word.upper())
    rules, out, k = _COMPILED, "", 1 if SILENT_START.match(letters) else 0
    while k < len(letters) and len(out) < CODE_LENGTH:
        code, used = next((code, used) for pattern, code, used in rules[letters[k]] if pattern.match(letters, k))
        out, k = out + code, k + used
    return out[:CODE_LENGTH]


_COMPILED = _compiled()


def dmetaphone_alt(word: str) -> str | None:
    """A second code, for words that begin with SCH only."""
    first = dmetaphone(word)
    letters = re.sub("[^A-Z]", "", word.upper())
    return "S" + first[1:] if letters.startswith("SCH") and first[:1] != "S" else None


def phonetic_words(text: Column) -> Column:
    """White-space words with a letter."""
    return F.filter(F.split(text, r"\s+"), lambda w: w.rlike(r"\p{IsAlphabetic}"))


def soundex_word(word: Column) -> Column:
    return F.soundex(F.regexp_replace(F.upper(word), "[^A-Z]", ""))


def soundex_codes(text: Column) -> Column:
    """Sorted distinct codes of the words; words without A-Z have none."""
    codes = F.transform(phonetic_words(text), soundex_word)
    return F.array_sort(F.array_distinct(F.filter(codes, lambda c: c != "")))


def _codes(text: str, alt: bool) -> list[str]:
    words = [w for w in text.split() if any(c.isalpha() for c in w)]
    found = {dmetaphone(w) for w in words} | ({a for w in words if (a := dmetaphone_alt(w))} if alt else set())
    return sorted(found - {""})


def dmetaphone_codes(text: Column, alt: bool = False, once: bool = False) -> Column:
    """Sorted distinct codes of the words (with alt, second codes too), computed once for each distinct value of a batch.

    once: the optimiser may not copy the call into every place that refers to it.
    """

    @F.pandas_udf("array<string>")
    def codes(values: pd.Series) -> pd.Series:
        known = {v: _codes(v, alt) for v in values.dropna().unique()}
        return pd.Series([known.get(v) for v in values], dtype=object)

    return (codes.asNondeterministic() if once else codes)(text)


def soundex_of(word: str) -> str:
    """Soundex of a literal, by the same rules as the built-in function."""
    groups = {c: str(d) for d, cs in enumerate(("BFPV", "CGJKQSXZ", "DT", "L", "MN", "R"), 1) for c in cs}
    letters = re.sub("[^A-Z]", "", word.upper())
    if not letters:
        return ""
    out, last = letters[0], groups.get(letters[0])
    for c in letters[1:]:
        code = groups.get(c)
        if code and code != last:
            out += code
        if c not in "HW":
            last = code
    return (out + "000")[:4]


def query_codes(query: str) -> tuple[list[str], list[str]]:
    """(Soundex codes, Double Metaphone codes) of a query."""
    words = [w for w in query.split() if any(c.isalpha() for c in w)]
    return sorted({c for w in words if (c := soundex_of(w))}), _codes(query, True)
