"""Requests: filter, score, order, page, project, aggregate, explain."""

from __future__ import annotations

import base64
import json
import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import json_values
from quern.operators.indexes import Index
from quern.plans import predicates
from quern.plans.collections import METADATA, VIRTUAL
from quern.plans.predicates import JsonField, QueryError

DEFAULT_LIMIT = 20
ENVELOPE = ("path", "size", "content_type", "created_at", "updated_at", "score", "matched_by")


@dataclass
class Request:
    """where None means no condition, which finds nothing; everything() asks for all rows.

    index: postings of the collection's fields. Text operators then look only at
    the rows that share tokens with the query, and give the same answer.
    """

    where: object = None
    order_by: list[tuple[str, bool]] = field(default_factory=list)  # (field, descending)
    limit: int | None = None
    offset: int = 0
    after: str | None = None
    before: str | None = None
    include_total: bool = False
    select: list[str] | None = None
    aggregate: dict | None = None
    all_rows: bool = False
    index: Index | None = None

    @classmethod
    def from_json(cls, request: dict) -> Request:
        order = [(o["field"], str(o.get("direction", "asc")).lower() == "desc") for o in request.get("order_by") or []]
        where = request.get("where")
        return cls(
            predicates.parse(where) if where not in (None, {}, []) else None, order, request.get("limit"), int(request.get("offset") or 0), request.get("after"), request.get("before"),
            bool(request.get("include_total")), request.get("select"), request.get("aggregate"),
        )


@dataclass
class Page:
    items: DataFrame
    has_more: bool
    default_limit_hit: bool
    total: int | None
    next_cursor: str | None
    previous_cursor: str | None


def everything() -> Request:
    return Request(all_rows=True)


def matches(df: DataFrame, request: Request) -> DataFrame:
    """The rows that the request's condition selects, with score and matched_by."""
    if request.all_rows:
        return df.withColumns({"score": F.lit(1.0), "matched_by": F.array().cast("array<string>")})
    if request.where is None:
        return df.withColumns({"score": F.lit(1.0), "matched_by": F.array().cast("array<string>")}).where(F.lit(False))
    node = predicates.parse(request.where)
    candidates = request.index.narrow(node) if request.index else None
    if candidates is not None:
        df = df.join(candidates, "path", "left_semi")
    held: dict[str, Column] = {}
    match = predicates.compile_node(node, df, held)
    if held:
        plain = predicates.plain_part(node)
        df = (df if plain is None else df.where(predicates.compile_node(plain, df).condition)).withColumns(held)
    return df.where(match.condition).withColumns({"score": match.score, "matched_by": match.matched_by}).drop(*held)


def _order(df: DataFrame, request: Request) -> list[tuple[str, Column, bool]]:
    """(name, column, descending), ending with the path so that the order is total; unknown @ fields are ignored.

    A JSON path orders by the kind of its value, then by number, then by text.
    """
    out = []
    for name, desc in request.order_by:
        if name == "@score":
            out.append((name, F.col("score"), desc))
        elif name in VIRTUAL or not name.startswith("@"):
            found = predicates.field_of(df, name)
            if isinstance(found, JsonField):
                out += [(f"{name}:{k}", c, desc) for k, c in zip(("kind", "number", "text"), json_values.sort_keys(found.body, list(found.segments)), strict=True)]
            else:
                out.append((name, found, desc))
    if not request.order_by and request.where is not None and predicates.scored(predicates.parse(request.where)):
        out.append(("@score", F.col("score"), True))
    return [*out, ("@path", F.col("path"), False)]


def _sorted(df: DataFrame, order, backwards: bool = False) -> DataFrame:
    return df.orderBy(*(c.desc_nulls_last() if desc != backwards else c.asc_nulls_first() for _, c, desc in order))


def _beyond(order, values: list, after: bool) -> Column:
    """Rows after (or before) the cursor: missing values come first in ascending order."""
    out, same = F.lit(False), F.lit(True)
    for (_, c, desc), v in zip(order, values, strict=True):
        less = F.lit(False) if v is None else c.isNull() | (c < F.lit(v))
        more = c.isNotNull() if v is None else c > F.lit(v)
        step = more if desc != after else less
        out = out | (same & F.coalesce(step, F.lit(False)))
        same = same & (c.eqNullSafe(F.lit(v)))
    return out


def encode_cursor(order, row) -> str:
    values = []
    for k, (_, _, _) in enumerate(order):
        v = row[f"_k{k}"]
        values.append({"ts": v.isoformat()} if hasattr(v, "isoformat") else v)
    return base64.b64encode(json.dumps({"k": [n for n, _, _ in order], "v": values}).encode()).decode()


def decode_cursor(cursor: str, order) -> list:
    try:
        held = json.loads(base64.b64decode(cursor, validate=True))
        if held["k"] != [n for n, _, _ in order]:
            raise QueryError("the cursor belongs to another order")
        import datetime

        return [datetime.datetime.fromisoformat(v["ts"]) if isinstance(v, dict) else v for v in held["v"]]
    except (ValueError, KeyError, TypeError) as e:
        raise e if isinstance(e, QueryError) else QueryError("the cursor cannot be read") from e


def _project(df: DataFrame, request: Request, fields: list[str]) -> DataFrame:
    """select keeps the named keys; by default the envelope and all fields."""
    if request.select is None:
        return df.select(*ENVELOPE, *(c for c in fields if c not in ENVELOPE))
    named = {"@score": "score", "@matched_by": "matched_by"} | VIRTUAL
    return df.select(*(F.col(named[s]) if s in named else predicates.field_column(df, s).alias(s) for s in request.select))


def rows(df: DataFrame, request: Request) -> DataFrame:
    """The requested page as one lazy plan."""
    fields = [c for c in df.columns if c not in METADATA and c != "body"]
    found = matches(df, request)
    order = _order(found, request)
    limit = DEFAULT_LIMIT if request.limit is None else request.limit
    if request.after:
        found = found.where(_beyond(order, decode_cursor(request.after, order), after=True))
    if request.before:  # the page that precedes the cursor
        found = found.where(_beyond(order, decode_cursor(request.before, order), after=False))
        return _project(_sorted(_sorted(found, order, backwards=True).limit(limit), order), request, fields)
    ordered = _sorted(found, order)
    return _project((ordered.offset(request.offset) if request.offset else ordered).limit(limit), request, fields)


def cursor_of(df: DataFrame, request: Request, path: str) -> str:
    """The cursor that stands at the row with this path."""
    found = matches(df, request)
    order = _order(found, request)
    row = found.where(F.col("path") == path).select(*(c.alias(f"_k{k}") for k, (_, c, _) in enumerate(order))).first()
    if row is None:
        raise QueryError(f"no row at {path}")
    return encode_cursor(order, row)


def page(df: DataFrame, request: Request) -> Page:
    """The page and what surrounds it: one job for limit + 1 rows, one more for a total."""
    limit = DEFAULT_LIMIT if request.limit is None else request.limit
    found = matches(df, request)
    order = _order(found, request)
    if request.after:
        found = found.where(_beyond(order, decode_cursor(request.after, order), after=True))
    if request.before:
        found = found.where(_beyond(order, decode_cursor(request.before, order), after=False))
    ordered = _sorted(found, order, backwards=bool(request.before))
    if request.offset and not request.before:
        ordered = ordered.offset(request.offset)
    fields = [c for c in df.columns if c not in METADATA and c != "body"]
    wide = ordered.limit(limit + 1).withColumns({f"_k{k}": c for k, (_, c, _) in enumerate(order)})
    keep = list(dict.fromkeys([*ENVELOPE, *METADATA, *fields]))
    got = wide.select(*keep, *(f"_k{k}" for k in range(len(order)))).collect()  # at most limit + 1 rows
    more, got = len(got) > limit, got[:limit]
    if request.before:
        got.reverse()
    schema = T.StructType([f for f in wide.select(*keep).schema.fields])
    items = _project(df.sparkSession.createDataFrame([tuple(r[c] for c in keep) for r in got], schema), request, fields)
    total = matches(df, request).count() if request.include_total else None
    first, last = (encode_cursor(order, got[k]) if got else None for k in (0, -1))
    return Page(items, more, more and request.limit is None, total, last if more or request.before else None, first if request.after or request.offset or (request.before and more) else None)


NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _aggregates(df: DataFrame, spec: dict) -> list[Column]:
    out = [F.count("*").alias("count")]
    for name in ("sum", "avg", "min", "max"):
        for f in spec.get(name) or []:
            found = predicates.field_of(df, f)
            if isinstance(found, JsonField):
                kind, number, text = json_values.sort_keys(found.body, list(found.segments))
                c = number if name in ("sum", "avg") else F.struct(kind, number, text.alias("text"))
                c = getattr(F, name)(F.when(kind.isNotNull(), c))
                out.append((c if name in ("sum", "avg") else c["text"]).alias(f"{name}_{f}"))
                continue
            c = found
            if name in ("sum", "avg"):
                if not isinstance(df.select(c).schema[0].dataType, NUMERIC):
                    raise QueryError(f"{name} needs a number; {f!r} is none")
                c = c.cast("double")
            out.append(getattr(F, name)(c).alias(f"{name}_{f.lstrip('@')}"))
    return out


@dataclass
class Groups:
    items: DataFrame
    total: int
    has_more: bool
    default_limit_hit: bool


def _grouped(df: DataFrame, request: Request, keys: list[str]) -> DataFrame:
    found = matches(df, request)
    named = [predicates.field_column(found, k).alias(k.lstrip("@")) for k in keys]
    grouped = found.groupBy(*named).agg(*_aggregates(found, request.aggregate or {}))
    return grouped.orderBy(F.col("count").desc(), *(F.col(f"`{k.lstrip('@')}`").asc_nulls_first() for k in keys))


def aggregate(df: DataFrame, request: Request) -> DataFrame:
    """Totals, or one row per group: most rows first, then by key; 20 groups unless the limit says otherwise.

    Sums and averages of a JSON path take its numbers; its least and greatest value come as text.
    """
    keys = (request.aggregate or {}).get("group_by") or []
    if not keys:
        found = matches(df, request)
        return found.agg(*_aggregates(found, request.aggregate or {}))
    return _grouped(df, request, keys).limit(DEFAULT_LIMIT if request.limit is None else request.limit)


def groups(df: DataFrame, request: Request) -> Groups:
    """The groups of aggregate() and what surrounds them: the rows of all groups, and whether there are more groups."""
    keys = (request.aggregate or {}).get("group_by") or []
    if not keys:
        raise QueryError("groups need group_by")
    limit = DEFAULT_LIMIT if request.limit is None else request.limit
    wide = _grouped(df, request, keys).limit(limit + 1)
    got = wide.collect()  # at most limit + 1 rows
    more = len(got) > limit
    return Groups(df.sparkSession.createDataFrame(got[:limit], wide.schema), matches(df, request).count(), more, more and request.limit is None)


def explain(df: DataFrame, request: Request, analyze: bool = False) -> dict:
    """The predicate tree, the fields it reads and Spark's plan; with analyze, rows and milliseconds too."""
    node = predicates.parse(request.where) if request.where is not None else None
    plan = (aggregate if request.aggregate else rows)(df, request)
    text = plan._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    out = {"tree": predicates.describe(node) if node else None, "text": bool(node) and predicates.scored(node), "plan": text}
    if request.index:
        out["indexes"] = [r.asDict() for r in request.index.statistics().collect()]  # one row an index
    if analyze:
        start = time.perf_counter()
        out |= {"matched": matches(df, request).count(), "returned": plan.count(), "milliseconds": round(1000 * (time.perf_counter() - start), 3)}
    return out
