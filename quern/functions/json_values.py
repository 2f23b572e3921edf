"""JSON: paths with fan-out and regex segments, pointers, merge patch, jq subset, timestamps."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MAP = "map<string,variant>"
LIST = "array<variant>"


def _is_regex(segment) -> bool:
    return isinstance(segment, str) and re.fullmatch(r"/.+/i?", segment) is not None


def _pattern(segment: str) -> str:
    body, flags = segment[1:].rsplit("/", 1)
    return f"(?i){body}" if "i" in flags else body


def _json_path(segment) -> str:
    return f"[{segment}]" if isinstance(segment, int) else "['" + segment.replace("\\", "\\\\").replace("'", "\\'") + "']"


def _step(segment):
    """The values that one segment leads to, as a function of a variant."""
    none = F.array().cast(LIST)
    if segment == "":
        return lambda v: F.coalesce(F.try_variant_get(v, "$", LIST), F.map_values(F.try_variant_get(v, "$", MAP)), none)
    if _is_regex(segment):
        pattern = _pattern(segment)
        in_list = lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.to_json(x)).rlike(pattern)
        in_map = lambda k, _: k.rlike(pattern)
        return lambda v: F.coalesce(F.filter(F.try_variant_get(v, "$", LIST), in_list), F.map_values(F.map_filter(F.try_variant_get(v, "$", MAP), in_map)), none)
    ways = ["$" + _json_path(segment)] + (["$" + _json_path(str(segment))] if isinstance(segment, int) else [])
    return lambda v: F.array(F.coalesce(*(F.try_variant_get(v, way, "variant") for way in ways)))


def walk_paths(body: Column, segments: list) -> Column:
    """All values (array of variants) at a path in a JSON text.

    A text is a key, a number an array place (or the key of that name); "" fans
    out over all elements or values; "/regex/flags" over those whose key (in
    objects) or text (in arrays) the pattern fits.
    """
    values = F.array(F.try_parse_json(body))
    values = F.filter(values, lambda v: v.isNotNull())
    for s in segments:
        step = _step(s)
        values = F.filter(F.flatten(F.transform(values, step)), lambda v: v.isNotNull())
    return values


def resolve(body: Column, segments: list, kind: str = "string") -> Column:
    """The first value at a path. Static paths are one variant_get."""
    if all(isinstance(s, int) or (s and not _is_regex(s)) for s in segments):
        return F.try_variant_get(F.try_parse_json(body), "$" + "".join(map(_json_path, segments)), kind)
    return F.try_variant_get(F.get(walk_paths(body, segments), 0), "$", kind)


def segments_of(path: str) -> list:
    """A dotted path as segments: numbers are places, [] and an empty segment fan out, /.../ is a pattern (dots in it are its own)."""
    out: list = []
    for part in re.findall(r"/(?:[^/]|(?<=\\)/)+/i?|[^.]+|(?<=\.)(?=\.)|(?<=\.)$", path):
        if _is_regex(part):
            out.append(part)
            continue
        name, *places = re.split(r"\[(\d*)\]", part)
        out += ([] if not name and places else [int(name) if name.isdigit() else name]) + [int(x) if x else "" for x in places[::2]]
    return out


NUMBERS = "^(BIGINT|DECIMAL|DOUBLE|FLOAT)"


def values_at(body: Column, segments: list) -> Column:
    """The values (array of variants) that conditions compare: those at the path, the elements of an array each for itself, no nulls."""
    if all(isinstance(s, int) or (s and not _is_regex(s)) for s in segments):
        one = F.try_variant_get(F.try_parse_json(body), "$" + "".join(map(_json_path, segments)), "variant")
        values = F.coalesce(F.try_variant_get(one, "$", LIST), F.array(one))
    else:
        values = F.flatten(F.transform(walk_paths(body, segments), lambda v: F.coalesce(F.try_variant_get(v, "$", LIST), F.array(v))))
    return F.filter(values, lambda v: v.isNotNull() & ~F.is_variant_null(v))


def compare(value: Column, op: str, literal) -> Column:
    """A variant against a literal of its own kind: a number with a number, a text with a text; others are unequal and in no order."""
    kind = F.schema_of_variant(value)
    order = {"eq": lambda a, b: a == b, "gt": lambda a, b: a > b, "lt": lambda a, b: a < b}[op]
    if isinstance(literal, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == literal) if op == "eq" else F.lit(False)
    if isinstance(literal, str):
        return (kind == "STRING") & order(F.try_variant_get(value, "$", "string"), F.lit(literal))
    number = kind.rlike(NUMBERS) & order(F.try_variant_get(value, "$", "double"), F.lit(float(literal)))
    if isinstance(literal, int) and abs(literal) < 1 << 63:  # whole numbers exactly
        return F.when(kind == "BIGINT", order(F.try_variant_get(value, "$", "bigint"), F.lit(literal))).otherwise(number)
    return number


def sort_keys(body: Column, segments: list) -> tuple[Column, Column, Column]:
    """(kind, number, text) of the first value: numbers order as numbers and come before all else; nulls are missing."""
    value = F.get(walk_paths(body, segments), 0)
    value = F.when(~F.is_variant_null(value), value)
    number = F.when(F.schema_of_variant(value).rlike(NUMBERS), F.try_variant_get(value, "$", "double"))
    return F.when(value.isNotNull(), F.when(number.isNotNull(), 0).otherwise(1)), number, comparable(value)


def comparable(value: Column) -> Column:
    """A variant as text for comparisons: scalars plainly, arrays and objects as JSON."""
    return F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value))


def any_equal(body: Column, segments: list, value) -> Column:
    """A fanned-out path, or an array, equals the value if any element does."""
    return F.exists(values_at(body, segments), lambda v: compare(v, "eq", value))


def pointer(body: Column, path: str, kind: str = "string") -> Column:
    """A JSON pointer; ~1 is a slash, ~0 a tilde. Numbers are tried as array places too."""
    parts = [p.replace("~1", "/").replace("~0", "~") for p in path.split("/")[1:]]
    found = [resolve(body, parts, kind)]
    if any(p.isdigit() for p in parts):
        found.append(resolve(body, [int(p) if p.isdigit() else p for p in parts], kind))
    return F.coalesce(*found)


def merge_patch_value(target, patch, depth: int | None = None):
    """RFC 7396; null deletes. depth None: unbounded; 0: the patch replaces all; n: objects beyond n levels replace; -n: beyond are left as they are."""
    if depth == 0 or not isinstance(patch, dict):
        return patch
    out = dict(target) if isinstance(target, dict) else {}
    levels = None if depth is None else abs(depth) - 1
    for key, value in patch.items():
        if value is None:
            out.pop(key, None)
        elif not isinstance(value, dict):
            out[key] = value
        elif levels is None:
            out[key] = merge_patch_value(out.get(key, {}), value)
        elif levels:
            out[key] = merge_patch_value(out.get(key, {}), value, levels if depth > 0 else -levels)
        elif depth > 0:
            out[key] = value
    return out


def deep_merge_value(target, patch):
    """Objects merge; everything else, null too, replaces."""
    if isinstance(target, dict) and isinstance(patch, dict):
        return target | {k: deep_merge_value(target.get(k), v) if k in target else v for k, v in patch.items()}
    return patch


def _json_udf(function):
    """function over two JSON texts; null where either is null or no JSON."""

    def merged(x, y):
        try:
            return json.dumps(function(json.loads(x), json.loads(y)), separators=(",", ":"), ensure_ascii=False)
        except (ValueError, RecursionError):
            return None

    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else merged(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    return run


def merge_patch(target: Column, patch: Column, depth: int | None = None) -> Column:
    """RFC 7396 merge patch; null where target or patch is null or malformed."""
    return _json_udf(lambda a, b: merge_patch_value(a, b, depth))(target, patch)


def deep_merge(target: Column, patch: Column) -> Column:
    """Objects merged; null where either is null or malformed."""
    return _json_udf(deep_merge_value)(target, patch)


_JQ_STEP = re.compile(r"\.?(?:\[(-?\d*)\]|\[\"([^\"]*)\"\]|([A-Za-z_]\w*)|\"([^\"]*)\")")
_JQ_SELECT = re.compile(r"select\(\s*(.+?)\s*(==|!=|<=|>=|<|>)\s*(.+?)\s*\)$")
_JQ_OPS = {"==": ("eq", False), "!=": ("eq", True), ">": ("gt", False), "<": ("lt", False), "<=": ("gt", True), ">=": ("lt", True)}


def _jq_path(stage: str) -> list:
    segments: list = []
    rest = "" if stage == "." else stage
    while rest:
        m = _JQ_STEP.match(rest)
        if not m or not m[0]:
            raise ValueError(f"unsupported jq expression: {stage}")
        place = m[1]
        segments.append("" if place == "" else int(place) if place is not None else next(x for x in m.groups()[1:] if x is not None))
        rest = rest[m.end() :]
    return segments


def _jq_stages(expression: str) -> list[str]:
    """The parts between pipes that are in no brackets."""
    out, depth = [""], 0
    for c in expression:
        depth += (c in "([") - (c in ")]")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return [s.strip() for s in out]


def _walked(values: Column, segments: list) -> Column:
    for s in segments:
        step = _step(s)
        values = F.filter(F.flatten(F.transform(values, step)), lambda v: v.isNotNull())
    return values


def _selector(path: list, op: str, turned: bool, literal):
    def fits(v: Column) -> Column:
        hit = F.exists(_walked(F.array(v), path), lambda x: compare(x, op, literal))
        return ~hit if turned else hit

    return fits


def _mapper(path: list):
    return lambda v: F.parse_json(F.to_json(_walked(_step("")(v), path)))


def jq(body: Column, expression: str) -> Column:
    """Outputs (array of variants) of a jq expression: paths (.a.b, .[0], .[], .["k"]), pipes of them, select(path op literal), map(...), keys, length."""
    values = F.filter(F.array(F.try_parse_json(body)), lambda v: v.isNotNull())
    for stage in _jq_stages(expression):
        if m := _JQ_SELECT.match(stage):
            path, (op, turned), literal = _jq_path(m[1]), _JQ_OPS[m[2]], json.loads(m[3])

            values = F.filter(values, _selector(path, op, turned, literal))
        elif stage.startswith("map(") and stage.endswith(")"):
            inner = [_jq_path(s) for s in _jq_stages(stage[4:-1])]
            path = [x for p in inner for x in p]
            values = F.transform(values, _mapper(path))
        elif stage == "keys":
            values = F.transform(values, lambda v: F.parse_json(F.to_json(F.array_sort(F.map_keys(F.try_variant_get(v, "$", MAP))))))
        elif stage == "length":
            size = lambda v: F.coalesce(F.size(F.try_variant_get(v, "$", LIST)), F.size(F.map_keys(F.try_variant_get(v, "$", MAP))), F.length(F.try_variant_get(v, "$", "string")))
            values = F.transform(values, lambda v: F.parse_json(size(v).cast("string")))
        else:
            values = _walked(values, _jq_path(stage))
    return values


def parse_timestamp(text: Column) -> Column:
    """Milliseconds since 1970 UTC: RFC 3339, date and time, date, or a number of milliseconds; anything else is 0."""
    shaped = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?)?$"), F.try_to_timestamp(text))
    return F.coalesce(F.unix_millis(shaped), text.try_cast("bigint"), F.lit(0).cast("long"))
