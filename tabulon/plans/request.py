"""Requests over one table: immutable, and checked by rules that are listed with their fields."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping
from dataclasses import MISSING, dataclass, fields
from pathlib import Path
from typing import Any, ClassVar

# What a request may ask for.
FILTERS = ("eq", "ne", "gt", "gte", "lt", "lte", "in", "not_in", "between", "contains")
AGGREGATIONS = ("sum", "mean", "median", "min", "max", "count", "nunique")
DIRECTIONS = ("asc", "desc")
MOST_ROWS, USUAL_ROWS = 1000, 100

Rule = Callable[[Any, str], Any]


# ---------------------------------------------------------------- rules: a value and its place, to the value as kept


def is_a(kind: type | tuple[type, ...], what: str, but: tuple[type, ...] = ()) -> Rule:
    def rule(value: Any, place: str) -> Any:
        if not isinstance(value, kind) or isinstance(value, but):
            raise TypeError(f"{place} must be {what}")
        return value

    return rule


def both(*rules: Rule) -> Rule:
    def rule(value: Any, place: str) -> Any:
        for r in rules:
            value = r(value, place)
        return value

    return rule


def must(holds: Callable[[Any], bool], what: str) -> Rule:
    def rule(value: Any, place: str) -> Any:
        if not holds(value):
            raise ValueError(f"{place} {what}")
        return value

    return rule


def name(value: Any, place: str) -> str:
    return must(bool, "must not be blank")(is_a(str, "text")(value, place).strip(), place)


def word_of(allowed: tuple[str, ...]) -> Rule:
    return both(name, lambda value, _: value.lower(), must(allowed.__contains__, f"must be one of {', '.join(allowed)}"))


def every(rule: Rule) -> Rule:
    return lambda value, place: tuple(rule(v, place) for v in is_a((list, tuple), "a list")(value, place))


def part(kind: type[Checked]) -> Rule:
    return lambda value, place: value if isinstance(value, kind) else kind.read(value, place)


distinct = must(lambda names: len(set(names)) == len(names), "must not repeat a name")
single = is_a(object, "one value", but=(list, tuple, dict, set))
several = both(every(lambda v, _: v), must(bool, "must not be empty"))
#: What an operator's value has to be, where that isn't a single value.
VALUES: dict[str, Rule] = {
    "in": several, "not_in": several, "between": both(several, must(lambda v: len(v) == 2, "must be two values")), "contains": is_a(str, "text"),
}


class Checked:
    """Walks the rules of its fields, in their order, then those that hold across fields."""

    rules: ClassVar[Mapping[str, Rule]]
    across: ClassVar[tuple[tuple[Callable[[Any], bool], str], ...]] = ()
    #: Fields that have a default in Python but not in a mapping.
    spelled_out: ClassVar[frozenset[str]] = frozenset()

    def __post_init__(self) -> None:
        for field, rule in self.rules.items():
            object.__setattr__(self, field, rule(getattr(self, field), f"{type(self).__name__.lower()} {field}"))
        for holds, says in self.across:
            if not holds(self):
                raise ValueError(says)

    @classmethod
    def read(cls, given: Any, place: str) -> Any:
        """From a mapping that names every field without a default and no others."""
        given = is_a(Mapping, "an object")(given, place)
        known = {f.name: f.default is MISSING or f.name in cls.spelled_out for f in fields(cls)}
        unknown = sorted(str(k) for k in given if k not in known)
        lacking = sorted(k for k, needed in known.items() if needed and k not in given)
        if unknown or lacking:
            raise ValueError(f"{place}: " + "; ".join(f"{what} {', '.join(names)}" for what, names in (("unknown", unknown), ("missing", lacking)) if names))
        return cls(**given)

    def to_dict(self) -> dict[str, Any]:
        return {f.name: _plain(getattr(self, f.name)) for f in fields(self)}


def _plain(value: Any) -> Any:
    if isinstance(value, Checked):
        return value.to_dict()
    return [_plain(v) for v in value] if isinstance(value, tuple) else value


@dataclass(frozen=True)
class Filter(Checked):
    column: str
    operator: str
    value: Any = None

    rules = {"column": name, "operator": word_of(FILTERS)}
    spelled_out = frozenset({"value"})

    def __post_init__(self) -> None:
        super().__post_init__()
        object.__setattr__(self, "value", VALUES.get(self.operator, single)(self.value, f"the value of {self.operator}"))


@dataclass(frozen=True)
class Aggregation(Checked):
    column: str
    operation: str
    alias: str | None = None

    rules = {"column": name, "operation": word_of(AGGREGATIONS), "alias": lambda value, place: value if value is None else name(value, place)}

    def __post_init__(self) -> None:
        super().__post_init__()
        object.__setattr__(self, "alias", self.alias or f"{self.operation}_{self.column}")


@dataclass(frozen=True)
class Order(Checked):
    column: str
    direction: str = "asc"

    rules = {"column": name, "direction": word_of(DIRECTIONS)}


def _all_differ(names: Iterable[str]) -> bool:
    names = [*names]
    return len(set(names)) == len(names)


@dataclass(frozen=True)
class Request(Checked):
    table: str
    columns: tuple[str, ...] = ()
    filters: tuple[Filter, ...] = ()
    group_by: tuple[str, ...] = ()
    aggregations: tuple[Aggregation, ...] = ()
    order_by: tuple[Order, ...] = ()
    limit: int = USUAL_ROWS

    rules = {
        "table": name, "columns": both(every(name), distinct), "filters": every(part(Filter)), "group_by": both(every(name), distinct),
        "aggregations": every(part(Aggregation)), "order_by": every(part(Order)),
        "limit": both(is_a(int, "a whole number", but=(bool,)), must(lambda n: 1 <= n <= MOST_ROWS, f"must lie between 1 and {MOST_ROWS}")),
    }
    across = (
        (lambda r: r.aggregations or not r.group_by, "group_by needs an aggregation"),
        (lambda r: not (r.aggregations and r.columns), "columns can't be combined with aggregations"),
        (lambda r: _all_differ([*r.group_by, *(a.alias for a in r.aggregations)]), "aliases must differ from each other and from the group keys"),
    )


def parse_request(source: Mapping[str, Any] | str) -> Request:
    """A request from a mapping or JSON text; unknown and missing keys are errors at every level."""
    if isinstance(source, str):
        try:
            source = json.loads(source)
        except ValueError as e:
            raise ValueError(f"not valid JSON: {e}") from e
    return Request.read(source, "the request")


def read_request(path: str) -> Request:
    """A request from a JSON file, with or without a byte order mark."""
    return parse_request(Path(path).read_text("utf-8-sig"))
