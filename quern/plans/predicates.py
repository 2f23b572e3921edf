"""The predicate tree: JSON where clause -> small AST -> column expressions.

A compiled node is (condition, score, matched_by). A condition on a missing
field is null, which a filter drops; "not" reads it as false, so that rows that
lack the field stay. Plain comparisons reach the Parquet scan as they are.

A literal compares only with values of its own kind: numbers with numbers, texts
with texts, booleans with booleans. A text that spells a number, a time or a
boolean stands for it where a column of that type is asked; a time is a number of
milliseconds too. Whatever does not convert equals nothing and is in no order;
it is never an error. Arrays, and JSON paths that lead to arrays or fan out,
satisfy a comparison if any element does.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import json_values, phonetic, text
from quern.plans.collections import VIRTUAL

MAX_DEPTH = 32
OPERATORS = ("eq", "gt", "lt", "between", "in", "contains", "similar", "phonetic", "fuzzy", "match")
TEXT_OPERATORS = ("contains", "similar", "phonetic", "fuzzy", "match")
MATCH_SIMILARITY = 0.3


class QueryError(ValueError):
    """A request that cannot be answered."""


@dataclass(frozen=True)
class Leaf:
    field: str
    op: str
    value: object = None
    value2: object = None
    options: tuple = ()

    def option(self, name, default=None):
        return dict(self.options).get(name, default)


@dataclass(frozen=True)
class And:
    children: tuple


@dataclass(frozen=True)
class Or:
    children: tuple


@dataclass(frozen=True)
class Not:
    child: object


def parse(where, depth: int = 0):
    """JSON to a tree. A list is an "and"; deeper than MAX_DEPTH is an error."""
    if depth > MAX_DEPTH:
        raise QueryError(f"where is nested more than {MAX_DEPTH} levels deep")
    if isinstance(where, (Leaf, And, Or, Not)):
        return where
    if isinstance(where, list):
        return And(tuple(parse(x, depth + 1) for x in where))
    if not isinstance(where, dict):
        raise QueryError("where must be an object or a list")
    for name, kind in (("and", And), ("or", Or)):
        if name in where:
            if not isinstance(where[name], list):
                raise QueryError(f"'{name}' takes a list")
            return kind(tuple(parse(x, depth + 1) for x in where[name]))
    if "not" in where:
        return Not(parse(where["not"], depth + 1))
    if "field" not in where:
        raise QueryError("a condition names a field, 'and', 'or' or 'not'")
    return _leaf(where)


def _literal(value):
    if isinstance(value, (int, float, str, bool)):
        return value
    raise QueryError(f"a value is a number, a text or a boolean, not {value!r}")


def _leaf(where: dict) -> Leaf:
    op = where.get("op", "eq")
    if op not in OPERATORS:
        raise QueryError(f"unknown operator {op!r}")
    if op == "in":
        if not isinstance(where.get("value"), list):
            raise QueryError("'in' takes a list")
        return Leaf(where["field"], op, tuple(map(_literal, where["value"])))
    value = _literal(where.get("value"))
    if op == "between":
        return Leaf(where["field"], op, value, _literal(where.get("value2")))
    if op in TEXT_OPERATORS and not isinstance(value, str):
        raise QueryError(f"{op!r} takes a text")
    options = {k: where[k] for k in ("threshold", "fuzziness", "algorithm", "require_candidate") if k in where}
    if options.get("algorithm", "damerau_levenshtein") not in ("damerau_levenshtein", "jaro_winkler"):
        raise QueryError(f"unknown algorithm {options['algorithm']!r}")
    return Leaf(where["field"], op, value, options=tuple(sorted(options.items())))


@dataclass
class Match:
    condition: Column
    score: Column
    matched_by: Column


def _names(*names: str) -> Column:
    return F.array(*map(F.lit, names)).cast("array<string>")


@dataclass(frozen=True)
class JsonField:
    """A path into a column of JSON texts."""

    body: Column
    segments: tuple


def field_of(df: DataFrame, name: str) -> Column | JsonField:
    """A metadata field, a column, a field of a struct, or a path into a JSON text (segments joined by dots)."""
    if name in VIRTUAL:
        return F.col(VIRTUAL[name])
    if name in df.columns:
        return F.col(f"`{name}`")
    head, dot, rest = name.partition(".")
    head, places = (head.split("[", 1)[0], head[head.index("[") :]) if "[" in head else (head, "")
    if (dot or places) and head in df.columns:
        if isinstance(df.schema[head].dataType, T.StructType):
            return reduce(lambda c, s: c.getField(s), rest.split("."), F.col(f"`{head}`"))
        return JsonField(F.col(f"`{head}`"), tuple(json_values.segments_of(".".join(x for x in (places, rest) if x))))
    raise QueryError(f"no field {name!r}")


def field_column(df: DataFrame, name: str) -> Column:
    """A field as one value; of a JSON path the first, as text."""
    found = field_of(df, name)
    return json_values.resolve(found.body, list(found.segments)) if isinstance(found, JsonField) else found


def type_of(df: DataFrame, column: Column) -> T.DataType:
    return df.select(column.alias("_")).schema[0].dataType


def _number(text_: str):
    for kind in (int, float):
        try:
            return kind(text_)
        except ValueError:
            continue
    return None


def as_type(value, kind: T.DataType) -> Column | None:
    """The literal as a value of a column's type, or None where it is none."""
    if isinstance(kind, T.BooleanType):
        known = value if isinstance(value, bool) else {"true": True, "false": False}.get(value.lower()) if isinstance(value, str) else None
        return None if known is None else F.lit(known)
    if isinstance(value, bool):
        return None
    if isinstance(kind, T.NumericType):
        number = _number(value) if isinstance(value, str) else value
        return None if number is None else F.lit(float(number) if isinstance(number, int) and abs(number) >= 1 << 63 else number)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.try_to_timestamp(F.lit(value)) if isinstance(value, str) else F.timestamp_millis(F.lit(int(value)).cast("long")) if abs(value) < 1 << 53 else None
    return F.lit(value) if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)) and isinstance(value, str) else None


def _compares(c: Column, kind: T.DataType, leaf: Leaf) -> Column:
    """A column of that type against the leaf's literals."""
    if isinstance(kind, T.ArrayType):
        return F.exists(c, lambda x: _compares(x, kind.elementType, leaf))
    values = leaf.value if leaf.op == "in" else (leaf.value, leaf.value2) if leaf.op == "between" else (leaf.value,)
    literals = [as_type(v, kind) for v in values]
    if leaf.op == "in":
        known = [x for x in literals if x is not None]
        return c.isin(*known) if known else F.lit(False)
    if any(x is None for x in literals):
        return F.lit(False)
    return {"eq": lambda: c == literals[0], "gt": lambda: c > literals[0], "lt": lambda: c < literals[0], "between": lambda: c.between(*literals)}[leaf.op]()


def _json_compares(found: JsonField, leaf: Leaf) -> Column:
    def test(v: Column) -> Column:
        if leaf.op == "in":
            return reduce(lambda a, b: a | b, (json_values.compare(v, "eq", x) for x in leaf.value), F.lit(False))
        if leaf.op == "between":
            return ~json_values.compare(v, "lt", leaf.value) & ~json_values.compare(v, "gt", leaf.value2) & _ordered(v, leaf.value) & _ordered(v, leaf.value2)
        return json_values.compare(v, leaf.op, leaf.value)

    return F.exists(json_values.values_at(found.body, list(found.segments)), test)


def _ordered(v: Column, literal) -> Column:
    """The variant has an order with the literal."""
    if isinstance(literal, bool):
        return F.lit(False)
    kind = F.schema_of_variant(v)
    return kind == "STRING" if isinstance(literal, str) else kind.rlike(json_values.NUMBERS)


def compile_node(node, df: DataFrame, held: dict[str, Column] | None = None) -> Match:
    """With held, what only Python computes is put there under names that the match refers to, so that it is computed once a row."""
    if isinstance(node, Leaf):
        return _compile_leaf(node, df, held)
    if isinstance(node, Not):
        inner = compile_node(node.child, df, held)
        return Match(~F.coalesce(inner.condition, F.lit(False)), F.lit(1.0), _names())
    if not node.children:
        return Match(F.lit(False), F.lit(0.0), _names())
    # cheap conditions first: text operators may call UDFs
    parts = [compile_node(c, df, held) for c in sorted(node.children, key=_cost)]
    names = F.array_distinct(F.concat(*(F.when(p.condition, p.matched_by).otherwise(_names()) for p in parts)))
    if isinstance(node, And):
        score = F.least(*(p.score for p in parts)) if len(parts) > 1 else parts[0].score
        return Match(reduce(lambda a, b: a & b, (p.condition for p in parts)), score, names)
    scores = [F.when(p.condition, p.score).otherwise(0.0) for p in parts]
    return Match(reduce(lambda a, b: a | b, (p.condition for p in parts)), F.greatest(*scores) if len(parts) > 1 else scores[0], names)


def plain_part(node):
    """What an "and" asks besides the operators that Python computes, or None: it can go before them."""
    if not isinstance(node, And):
        return None
    plain = tuple(c for c in node.children if _cost(c) < PYTHON)
    return And(plain) if plain and len(plain) < len(node.children) else None


#: From this cost on an operator runs in Python.
PYTHON = 3


def _cost(node) -> int:
    if isinstance(node, Leaf):
        return {"contains": 1, "similar": 2, "phonetic": 3, "fuzzy": 3, "match": 4}.get(node.op, 0)
    children = (node.child,) if isinstance(node, Not) else node.children
    return max((_cost(c) for c in children), default=0)


def scored(node) -> bool:
    """The tree has a text operator, so results have an order by score."""
    if isinstance(node, Leaf):
        return node.op in TEXT_OPERATORS
    return scored(node.child) if isinstance(node, Not) else any(map(scored, node.children))


def _compile_leaf(leaf: Leaf, df: DataFrame, held: dict[str, Column] | None) -> Match:
    if leaf.op in TEXT_OPERATORS:
        return _compile_text(leaf, field_column(df, leaf.field).cast("string"), held)
    found = field_of(df, leaf.field)
    condition = _json_compares(found, leaf) if isinstance(found, JsonField) else _compares(found, type_of(df, found), leaf)
    return Match(condition, F.lit(1.0), _names())


def _once(held: dict[str, Column] | None, c: Column) -> Column:
    """A reference to what held computes."""
    if held is None:
        return c
    name = f"_python_{len(held)}"
    held[name] = c
    return F.col(name)


def _compile_text(leaf: Leaf, c: Column, held: dict[str, Column] | None) -> Match:
    q, one = leaf.value, F.lit(1.0)
    if leaf.op == "contains":
        return Match((F.contains(F.lower(c), F.lower(F.lit(q)))), one, _names("contains"))
    if leaf.op == "similar":
        score = text.trigram_similarity(c, q)
        return Match(((score >= float(leaf.option("threshold", 0.3))) & (score > 0)), score, _names("trigram"))
    if leaf.op == "phonetic":
        sound, meta = _phonetic(c, q, held)
        return Match((sound | meta), one, _which(("soundex", sound), ("dmetaphone", meta)))
    if leaf.op == "fuzzy":
        score = _jaro(leaf, c, q, held) if leaf.option("algorithm") == "jaro_winkler" else _edits(c, q, fuzziness(leaf, q), held)
        condition = score.isNotNull() & (score > 0)
        if leaf.option("require_candidate"):
            condition = condition & F.arrays_overlap(text.trigrams(c), F.array(*map(F.lit, text.trigrams_of(q))).cast("array<string>"))
        return Match((condition), F.coalesce(score, F.lit(0.0)), _names("fuzzy"))
    dice = text.trigram_similarity(c, q)
    sound, meta = _phonetic(c, q, held)
    edits = _edits(c, q, text.auto_fuzziness(q), held)
    tests = [("exact", F.lower(c) == q.lower(), one), ("trigram", dice > MATCH_SIMILARITY, dice), ("soundex", sound, one), ("dmetaphone", meta, one), ("fuzzy", edits.isNotNull() & (edits > 0), edits)]
    score = F.greatest(*(F.when(t, s).otherwise(0.0) for _, t, s in tests))
    return Match(reduce(lambda a, b: a | b, (t for _, t, _ in tests)), score, _which(*((n, t) for n, t, _ in tests)))


def _which(*tests) -> Column:
    return F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in tests)))


def _phonetic(c: Column, q: str, held: dict[str, Column] | None) -> tuple[Column, Column]:
    sound, meta = phonetic.query_codes(q)
    overlap = lambda codes, own: F.arrays_overlap(codes, F.array(*map(F.lit, own))) if own else F.lit(False)
    return overlap(phonetic.soundex_codes(c), sound), overlap(_once(held, phonetic.dmetaphone_codes(c, alt=True, once=held is not None)), meta) if meta else F.lit(False)


def fuzziness(leaf: Leaf, q: str) -> int:
    f = leaf.option("fuzziness", "auto")
    return text.auto_fuzziness(q) if f == "auto" else int(f)


def _edits(c: Column, q: str, k: int, held: dict[str, Column] | None) -> Column:
    longest = F.greatest(F.octet_length(c), F.lit(len(q.encode())), F.lit(1))
    distance = _once(held, text.osa_distance(text.osa_near(c, q, k), q, once=held is not None))
    return 1 - F.when(distance <= k, distance) / longest


def _jaro(leaf: Leaf, c: Column, q: str, held: dict[str, Column] | None) -> Column:
    score = _once(held, text.jaro_winkler_score(c, q, once=held is not None))
    f = leaf.option("fuzziness", "auto")
    longest = F.greatest(F.octet_length(c), F.lit(len(q.encode())), F.lit(1))
    least = F.lit(0.8) if f == "auto" else 1 - int(f) / longest
    return F.when(score >= least, score)


def describe(node) -> dict:
    """The tree as JSON, for explain()."""
    if isinstance(node, Leaf):
        return {"type": "field", "field": node.field, "op": node.op, "value": node.value, "text": node.op in TEXT_OPERATORS}
    if isinstance(node, Not):
        return {"type": "not", "child": describe(node.child)}
    return {"type": "and" if isinstance(node, And) else "or", "children": [describe(c) for c in node.children]}
