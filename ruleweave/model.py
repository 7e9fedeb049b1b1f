"""Rules and patterns: JSON in, checked dataclasses out."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

ACTIVE, INACTIVE = 1, 2
AGGREGATES = ("COUNT", "SUM", "AVG", "MAX", "MIN")
OPERATORS = (">", "<", ">=", "<=", "=", "==", "!=", "IN", "NOT_IN")
DEFAULT_RETENTION_MINUTES = 24 * 60
_NAME = re.compile(r"[a-zA-Z_][a-zA-Z0-9_]*")
_UNIT_MINUTES = {"minutes": 1, "hours": 60, "days": 1440}


class DefinitionError(ValueError):
    """A rule or pattern that can't be used."""


@dataclass(frozen=True)
class TimeWindow:
    """A length of time. Units are minutes, hours and days in any case; any other unit counts as minutes."""

    value: int
    unit: str = "minutes"

    @property
    def minutes(self) -> int:
        return self.value * _UNIT_MINUTES.get(self.unit.lower(), 1)

    @property
    def seconds(self) -> int:
        return 60 * self.minutes


@dataclass(frozen=True)
class AggregateKey:
    """One windowed aggregate that a rule reads, as `Behavior:AGG[:field]` over a window."""

    path: str
    window: TimeWindow | None = None

    @property
    def cache_key(self) -> str:
        return self.path if self.window is None else f"{self.path}|{self.window.value}{self.window.unit}"

    @property
    def parts(self) -> tuple[str, str, str | None]:
        found = self.path.split(":", 2)
        return found[0], found[1].upper(), found[2] if len(found) > 2 else None

    @property
    def seconds(self) -> int:
        return self.window.seconds if self.window else 0


@dataclass(frozen=True)
class Node:
    """A boolean node over children, or a condition on a field."""

    type: str
    children: tuple[Node, ...] = ()
    field: str = ""
    operator: str = ""
    value: Any = None
    window: TimeWindow | None = None

    def walk(self) -> Iterator[Node]:
        yield self
        for child in self.children:
            yield from child.walk()


@dataclass(frozen=True)
class Rule:
    id: int
    name: str
    node: Node
    status: int = ACTIVE
    description: str = ""


@dataclass(frozen=True)
class State:
    name: str
    condition: Node
    max_wait: TimeWindow | None = None
    negative: bool = False
    binding: tuple[tuple[str, str], ...] = ()  # (variable, "$event.field")


@dataclass(frozen=True)
class Pattern:
    id: str
    name: str
    states: tuple[State, ...]
    status: int = ACTIVE

    @property
    def longest_wait(self) -> int:
        """Seconds of the longest wait of any state, 0 if none has one."""
        return max((s.max_wait.seconds for s in self.states if s.max_wait), default=0)


def _window(raw: dict | None) -> TimeWindow | None:
    return None if raw is None else TimeWindow(int(raw["value"]), str(raw.get("unit", "minutes")))


def node_from_json(raw: str | dict) -> Node:
    raw = json.loads(raw) if isinstance(raw, str) else raw
    value = raw.get("value")
    return Node(str(raw.get("type", "")), tuple(node_from_json(c) for c in raw.get("children") or ()), raw.get("field") or "", raw.get("operator") or "", tuple(value) if isinstance(value, list) else value, _window(raw.get("window")))


def pattern_from_json(id_: str, name: str, states: str | list, status: int = ACTIVE) -> Pattern:
    raw = json.loads(states) if isinstance(states, str) else states
    made = tuple(State(s.get("name", ""), node_from_json(s["condition"]), _window(s.get("max_wait")), bool(s.get("is_negative")), tuple((s.get("context_binding") or {}).items())) for s in raw)
    pattern = Pattern(id_, name, made, status)
    validate_pattern(pattern)
    return pattern


def aggregate_keys(node: Node) -> list[AggregateKey]:
    """The aggregates under a node, each once."""
    return unique_keys([AggregateKey(n.field, n.window) for n in node.walk() if n.type == "CONDITION" and ":" in n.field])


def unique_keys(keys: Iterable[AggregateKey]) -> list[AggregateKey]:
    return list({k.cache_key: k for k in keys}.values())


def retention_seconds(keys: Iterable[AggregateKey]) -> int:
    """How long buckets are kept: the longest window, a day if there is none."""
    return max((k.seconds for k in keys), default=0) or 60 * DEFAULT_RETENTION_MINUTES


def validate_node(node: Node) -> None:
    """What is refused when a rule is written: unknown aggregates and malformed aggregate paths. Types and operators are refused by check_compiles."""
    for n in node.walk():
        if n.type == "CONDITION" and ":" in n.field:
            behavior, aggregate, field = AggregateKey(n.field).parts
            if aggregate not in AGGREGATES:
                raise DefinitionError(f"unknown aggregate {aggregate!r} in {n.field!r}")
            if not behavior or field is not None and not _NAME.fullmatch(field):
                raise DefinitionError(f"malformed aggregate path {n.field!r}")


def check_compiles(node: Node) -> None:
    """Types, operators and the arity of NOT."""
    for n in node.walk():
        if n.type not in ("AND", "OR", "NOT", "CONDITION"):
            raise DefinitionError(f"unknown node type {n.type!r}")
        if n.type == "NOT" and len(n.children) != 1:
            raise DefinitionError("NOT takes one child")
        if n.type == "CONDITION" and n.operator.upper() not in OPERATORS:
            raise DefinitionError(f"unknown operator {n.operator!r}")


def validate_pattern(pattern: Pattern) -> None:
    states = pattern.states
    if not states:
        raise DefinitionError("a pattern needs a state")
    if states[0].negative:
        raise DefinitionError("the first state can't be negative")
    for i, s in enumerate(states):
        check_compiles(s.condition)
        if s.negative and i < len(states) - 1:
            raise DefinitionError("only the last state can be negative")
        if s.negative and (s.max_wait is None or s.max_wait.minutes <= 0):
            raise DefinitionError("a negative state needs a wait")
