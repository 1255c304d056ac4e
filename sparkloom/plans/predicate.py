"""Predicates: conjunctions, alternatives of conjunctions, and text conditions.

Comparisons are typed: the value takes the column's type.  ``compare="text"``
compares both sides as text, so ``"9" > "10"``.  A missing value satisfies no
comparison, ``!=`` included.
"""

from __future__ import annotations

import datetime
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import PredicateError

OPERATORS = {
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    ">=": lambda a, b: a >= b,
    ">": lambda a, b: a > b,
}


def literal(value: Any) -> Column:
    """A literal; datetimes without zone become timestamps without zone, as in the files."""
    if isinstance(value, datetime.datetime) and value.tzinfo is None:
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(value)


@dataclass(frozen=True)
class Pred:
    """``column op value``."""

    column: str
    op: str
    value: Any

    def to_column(self, compare: str = "typed") -> Column:
        if self.op not in OPERATORS:
            raise PredicateError(f"unknown operator {self.op}")
        a, b = F.col(self.column), literal(self.value)
        if compare == "text":
            a, b = a.cast("string"), F.lit(str(self.value))
        return OPERATORS[self.op](a, b)


@dataclass(frozen=True)
class Where:
    """``all_of`` AND (one of ``any_of``) AND the text conditions.

    ``any_of`` is a list of maps column -> value; all maps have the same columns and
    each means equality in all of them.
    """

    all_of: Sequence[Pred] = ()
    any_of: Sequence[Mapping[str, Any]] = ()
    contains: Mapping[str, str] = field(default_factory=dict)
    matches: Mapping[str, str] = field(default_factory=dict)
    starts: Mapping[str, str] = field(default_factory=dict)
    between: Mapping[str, tuple[Any, Any]] = field(default_factory=dict)
    in_list: Mapping[str, Sequence[Any]] = field(default_factory=dict)
    compare: str = "typed"

    def columns(self) -> set[str]:
        """Every column that a condition names."""
        named = {p.column for p in self.all_of} | {c for m in self.any_of for c in m}
        for m in (self.contains, self.matches, self.starts, self.between, self.in_list):
            named |= set(m)
        return named

    def to_column(self) -> Column | None:
        """One condition, or None if nothing is asked."""
        if self.any_of:
            keys = {frozenset(m) for m in self.any_of}
            if len(keys) != 1 or not next(iter(keys)):
                raise PredicateError("all alternatives need the same, at least one, columns")
        parts = [p.to_column(self.compare) for p in self.all_of]
        if self.any_of:
            options = []
            for m in self.any_of:
                terms = [Pred(c, "=", v).to_column(self.compare) for c, v in m.items()]
                option = terms[0]
                for t in terms[1:]:
                    option = option & t
                options.append(option)
            some = options[0]
            for o in options[1:]:
                some = some | o
            parts.append(some)
        parts += [F.col(c).contains(v) for c, v in self.contains.items()]
        parts += [F.col(c).rlike(f"(?s){v}") for c, v in self.matches.items()]
        parts += [F.col(c).startswith(v) for c, v in self.starts.items()]
        parts += [F.col(c).between(literal(lo), literal(hi)) for c, (lo, hi) in self.between.items()]
        parts += [F.col(c).isin(*vs) if vs else F.lit(False) for c, vs in self.in_list.items()]
        if not parts:
            return None
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out
