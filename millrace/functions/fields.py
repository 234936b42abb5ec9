"""Typed fields of documents: predicates, orderings, vector components, class probabilities and labels.

Predicates refuse bool(), so Python's and/or/chained comparisons raise rather than mean something else; conjunction is
one `where` after another. Nulls satisfy no comparison. Integers and floats compare exactly, not as doubles.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import text as T

OPS = {"=": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}


@dataclass(frozen=True)
class Predicate:
    name: str
    op: str
    value: object
    column: Column = field(compare=False, repr=False)

    def __bool__(self):
        raise TypeError("a predicate has no truth value; write one where() after another")

    def recipe(self) -> list:
        v = self.value
        return [self.name, self.op, v.hex() if isinstance(v, float) else list(v) if isinstance(v, (tuple, frozenset)) else v]


@dataclass(frozen=True)
class Ordering:
    name: str
    column: Column = field(compare=False, repr=False)
    kind: str
    descending: bool = False

    def recipe(self) -> list:
        return [self.name, "desc" if self.descending else "asc"]

    def sort(self) -> Column:
        return self.column.desc_nulls_last() if self.descending else self.column.asc_nulls_last()


def compare(column: Column, kind: str, op: str, value) -> Column:
    """column OP value, exactly. An integer column against a float becomes a comparison with an integer bound."""
    if kind == "integer" and isinstance(value, float):
        if math.isnan(value):
            raise ValueError("a constant must be finite")
        if math.isinf(value) or not -(2**63) <= value < 2**63:
            low = value > 0
            truth = {"=": False, "!=": True, "<": low, "<=": low, ">": not low, ">=": not low}[op]
            return column.isNotNull() if truth else column.isNull() & column.isNotNull()
        if value.is_integer():
            value = int(value)
        else:
            if op in "=!=":
                return column.isNotNull() if op == "!=" else column.isNull() & column.isNotNull()
            op, value = ("<=", math.floor(value)) if op in ("<", "<=") else (">=", math.ceil(value))
    if kind == "integer" and not -(2**63) <= value < 2**63:
        return compare(column, kind, op, math.inf if value > 0 else -math.inf)
    if kind == "number" and isinstance(value, int) and int(float(value)) != value:
        # No double equals it: move to the next double on the side that the comparison asks for.
        near = float(value)
        if op in ("=", "!="):
            return column.isNotNull() if op == "!=" else column.isNull() & column.isNotNull()
        below = near if int(near) < value else math.nextafter(near, -math.inf)
        op, value = ("<=", below) if op in ("<", "<=") else (">", below)
    return getattr(column, OPS[op])(F.lit(float(value) if kind == "number" else value))


class Field:
    """kind: count, integer, number, text, boolean."""

    def __init__(self, name: str, kind: str, column: Column | str | None = None, filters: bool = True):
        self.name, self.kind, self.filters = name, kind, filters
        self._column = name if column is None else column

    @property
    def column(self) -> Column:
        return F.col(f"`{self._column}`") if isinstance(self._column, str) else self._column

    def _compare(self, op: str, value) -> Predicate:
        if not self.filters:
            raise NotImplementedError(f"{self.name} can't be filtered on")
        if self.kind in ("text", "boolean"):
            if op not in ("=", "!=") and self.name not in ("object.uri",):
                raise TypeError(f"{self.name} has = and != only")
            if not isinstance(value, str if self.kind == "text" else bool):
                raise TypeError(f"{self.name} is compared with a {self.kind} constant")
            return Predicate(self.name, op, value, getattr(self.column, OPS[op])(F.lit(value)))
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise TypeError(f"{self.name} is compared with a number")
        if isinstance(value, float) and not math.isfinite(value):
            raise ValueError("a constant must be finite")
        if self.kind == "count" and (not isinstance(value, int) or not 0 <= value < 2**64):
            raise ValueError(f"{self.name} is compared with an unsigned integer")
        return Predicate(self.name, op, value, compare(self.column, "integer" if self.kind == "count" else self.kind, op, value))

    __hash__ = None
    __eq__ = lambda self, v: self._compare("=", v)
    __ne__ = lambda self, v: self._compare("!=", v)
    __lt__ = lambda self, v: self._compare("<", v)
    __le__ = lambda self, v: self._compare("<=", v)
    __gt__ = lambda self, v: self._compare(">", v)
    __ge__ = lambda self, v: self._compare(">=", v)

    def is_null(self) -> NullTest:
        return NullTest(self)

    def is_in(self, values: Sequence) -> Predicate:
        chosen = tuple(sorted(set(values)))
        return Predicate(self.name, "in", chosen, self.column.isin(list(chosen)) if chosen else F.lit(False))

    def asc(self) -> Ordering:
        return Ordering(self.name, self.column, self.kind)

    def desc(self) -> Ordering:
        return Ordering(self.name, self.column, self.kind, True)


class NullTest(Predicate):
    """field.is_null(), which may itself be compared with True and False."""

    def __init__(self, of: Field, wanted: bool = True):
        super().__init__(of.name, "is null" if wanted else "is not null", None, of.column.isNull() if wanted else of.column.isNotNull())
        object.__setattr__(self, "of", of)

    __hash__ = None

    def __eq__(self, value: bool):
        return NullTest(self.of, value)

    def __ne__(self, value: bool):
        return NullTest(self.of, not value)


class VectorField:
    def __init__(self, name: str, width: int, column: str | None = None):
        self.name, self.width, self._column = name, width, column or name

    @property
    def column(self) -> Column:
        return F.col(f"`{self._column}`")

    def component(self, i: int) -> Field:
        if not 0 <= i < self.width:
            raise IndexError(f"{self.name} has components 0 to {self.width - 1}")
        return Field(f"{self.name}[{i}]", "number", F.element_at(self.column, i + 1).cast("double"))


class ClassField(VectorField):
    """Logits of named classes."""

    def __init__(self, name: str, classes: Sequence[str], transform: str = "softmax", temperature: float = 1.0, column: str | None = None):
        super().__init__(name, len(classes), column)
        if transform not in ("softmax", "sigmoid") or not temperature > 0:
            raise ValueError("a transform is softmax or sigmoid, at a temperature above zero")
        self.classes, self.transform, self.temperature = list(classes), transform, temperature

    def probabilities(self) -> Column:
        return (T.softmax if self.transform == "softmax" else T.sigmoid)(self.column, self.temperature)

    def __getitem__(self, name: str) -> Field:
        if name not in self.classes:
            raise KeyError(name)
        return Field(f"{self.name}[{name}]", "number", F.element_at(self.probabilities(), self.classes.index(name) + 1))

    @property
    def label(self) -> Field:
        if self.transform == "sigmoid":
            raise TypeError(f"{self.name} has independent classes and so no top class")
        return Field(f"{self.name}.label", "text", T.top_class(self.column, self.classes))


BYTES = Field("text.bytes", "count", "n_bytes")
CHARACTERS = Field("text.characters", "count", "n_chars")
URI = Field("object.uri", "text", "source_key")
CORPUS = Field("source.corpus_id", "text", "corpus_id", filters=False)
DOCUMENT = Field("document_id", "integer", "doc_id")
