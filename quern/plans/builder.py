"""A fluent builder over a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quern.plans import query
from quern.plans.predicates import And, Leaf, Not, Or
from quern.plans.query import Request


class Field:
    """Conditions on one field; each returns a node that the builder's where() takes."""

    def __init__(self, name: str):
        self.name = name

    def eq(self, value):
        return Leaf(self.name, "eq", value)

    def gt(self, value):
        return Leaf(self.name, "gt", value)

    def lt(self, value):
        return Leaf(self.name, "lt", value)

    def between(self, low, high):
        return Leaf(self.name, "between", low, high)

    def is_in(self, values):
        return Leaf(self.name, "in", tuple(values))

    def contains(self, text: str):
        return Leaf(self.name, "contains", text)

    def similar(self, text: str, threshold: float = 0.3):
        return Leaf(self.name, "similar", text, options=(("threshold", threshold),))

    def phonetic(self, text: str):
        return Leaf(self.name, "phonetic", text)

    def fuzzy(self, text: str, fuzziness="auto", algorithm: str = "damerau_levenshtein"):
        return Leaf(self.name, "fuzzy", text, options=(("algorithm", algorithm), ("fuzziness", fuzziness)))

    def match(self, text: str):
        return Leaf(self.name, "match", text)


def all_of(*nodes):
    return And(tuple(nodes))


def any_of(*nodes):
    return Or(tuple(nodes))


def none_of(node):
    return Not(node)


class Query:
    """Query(df).where(...).order_by(...).limit(...).all()"""

    def __init__(self, df: DataFrame):
        self.df, self.request = df, Request()

    def where(self, *nodes) -> Query:
        old = self.request.where
        both = (*([old] if old is not None else []), *nodes)
        self.request.where = both[0] if len(both) == 1 else And(both)
        return self

    def order_by(self, name: str, descending: bool = False) -> Query:
        self.request.order_by.append((name, descending))
        return self

    def limit(self, n: int) -> Query:
        self.request.limit = n
        return self

    def offset(self, n: int) -> Query:
        self.request.offset = n
        return self

    def after(self, cursor: str) -> Query:
        self.request.after = cursor
        return self

    def before(self, cursor: str) -> Query:
        self.request.before = cursor
        return self

    def select(self, *names: str) -> Query:
        self.request.select = list(names)
        return self

    def with_total(self) -> Query:
        self.request.include_total = True
        return self

    def all(self) -> DataFrame:
        return query.rows(self.df, self.request)

    def first(self):
        return self.limit(1).all().first()

    def count(self) -> int:
        return query.matches(self.df, self.request).count()

    def page(self) -> query.Page:
        return query.page(self.df, self.request)

    def aggregate(self, **spec) -> DataFrame:
        self.request.aggregate = spec
        return query.aggregate(self.df, self.request)

    def explain(self, analyze: bool = False) -> dict:
        return query.explain(self.df, self.request, analyze)
