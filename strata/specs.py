"""What a pipeline is made of, as plain values. Everything else in the library is generic over these."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A check on rows: `passes` is a condition, or `unique` names columns whose values may stand in one row only.

    A row of which the condition is NULL has an unknown outcome.
    """

    name: str
    passes: Callable[[], Column] | None = None
    unique: tuple[str, ...] = ()


def not_null(name: str, *columns: str) -> Rule:
    def passes() -> Column:
        out = F.lit(True)
        for c in columns:
            out = out & F.col(c).isNotNull()
        return out

    return Rule(name, passes)


def in_domain(name: str, column: str, *values: str) -> Rule:
    return Rule(name, lambda: F.col(column).isin(*values))


def not_after(name: str, column: str, as_of: str | None = None) -> Rule:
    """Dates up to as_of (today where none is given)."""
    return Rule(name, lambda: F.col(column) <= (F.lit(as_of).cast("date") if as_of else F.current_date()))


def unique(name: str, *columns: str) -> Rule:
    return Rule(name, unique=columns)


@dataclass(frozen=True)
class Lookup:
    """Attach `key` of `dimension` where columns agree: pairs of (column of the rows, column of the dimension)."""

    dimension: str
    key: str
    on: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Dimension:
    """A dimension: natural key, attributes, optional parent lookups and how its name columns are canonicalised."""

    name: str
    key: str
    natural: tuple[str, ...]
    attributes: tuple[str, ...] = ()
    parents: tuple[Lookup, ...] = ()
    canonical: tuple[str, ...] = ()
    survivor: tuple[str, ...] = ()
    audit: bool = True


@dataclass(frozen=True)
class Fact:
    name: str
    key: str
    natural: tuple[str, ...]
    lookups: tuple[Lookup, ...]
    order: tuple[str, ...]
    columns: tuple[str, ...] = ()
    audit: bool = True


@dataclass(frozen=True)
class Pipeline:
    """Source to star schema."""

    name: str
    required: tuple[str, ...]
    keys: tuple[str, ...]
    rules: tuple[Rule, ...]
    dimensions: tuple[Dimension, ...]
    fact: Fact
    dates: tuple[str, ...] = ()
    calendar: tuple[str, str] = ("2020-01-01", "2035-12-31")
    preserve: tuple[str, ...] = ("created_at",)
    optional: tuple[str, ...] = ()
    strict_nulls: bool = True
    buckets: int = 16
    options: dict = field(default_factory=dict, hash=False)


def load(path: str | Path) -> Pipeline:
    """A pipeline from a JSON file: the fields of the classes above; rules as [kind, name, arguments ...]."""
    return from_dict(json.loads(Path(path).read_text()))


def from_dict(raw: dict) -> Pipeline:
    kinds = {f.__name__: f for f in (not_null, not_after, in_domain, unique)}

    def fixed(value):
        return tuple(map(fixed, value)) if isinstance(value, list) else value

    def lookups(values: list[dict]) -> tuple[Lookup, ...]:
        return tuple(Lookup(**{k: fixed(v) for k, v in x.items()}) for x in values)

    def dimension(x: dict) -> Dimension:
        return Dimension(**({k: fixed(v) for k, v in x.items()} | {"parents": lookups(x.get("parents", []))}))

    unknown = {r[0] for r in raw["rules"]} - kinds.keys()
    if unknown:
        raise ValueError(f"no such kinds of rules: {sorted(unknown)}")
    fact = Fact(**({k: fixed(v) for k, v in raw["fact"].items()} | {"lookups": lookups(raw["fact"]["lookups"])}))
    made = {"rules": tuple(kinds[k](*rest) for k, *rest in raw["rules"]), "dimensions": tuple(map(dimension, raw["dimensions"])), "fact": fact}
    return Pipeline(**({k: v if k == "options" else fixed(v) for k, v in raw.items()} | made))
