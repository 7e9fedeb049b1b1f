"""Conditions as Catalyst columns.

A compiled node is a boolean column in which null stands for an evaluation error. AND and OR take the
first of their children that is an error or ends the search, as an interpreter with short circuits would,
which SQL's own three-valued AND and OR do not. Inside, nodes are numbers (0 false, 1 error, 2 true), and each child occurs
once in its parent's column, so plans grow in proportion to the rule.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ruleweave.functions.rendering import MISSING, render, render_number
from ruleweave.model import AggregateKey, Node, check_compiles


@dataclass(frozen=True)
class Operand:
    """A value as a number (null where it is none) and as text (never null)."""

    number: Column
    text: Column


@dataclass
class Scope:
    """Where names are found. fields: names to operands; aggregates: cache keys to double columns, none inside patterns."""

    fields: Mapping[str, Operand]
    aggregates: Mapping[str, Column] | None = None
    variables: Mapping[str, Operand] = field(default_factory=dict)

    def field(self, name: str, key: AggregateKey | None) -> Operand:
        if key is not None and self.aggregates is not None:
            x = self.aggregates.get(key.cache_key)
            return nothing() if x is None else Operand(x, render_number(x))
        return self.fields.get(name) or nothing()

    def variable(self, name: str, default: Any) -> Operand:
        """A variable; where it isn't bound (its text is that of a missing field), the default."""
        own, other = self.variables.get(name), literal(default)
        if own is None:
            return other
        bound = own.text != MISSING
        return Operand(F.when(bound, own.number).otherwise(other.number), F.when(bound, own.text).otherwise(other.text))


def nothing() -> Operand:
    return Operand(F.lit(None).cast("double"), F.lit(MISSING))


def literal(value: Any) -> Operand:
    number = float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None
    return Operand(F.lit(number).cast("double"), F.lit(render(value)))


def number_field(x: Column) -> Operand:
    """A field that is a number wherever it is not null."""
    return Operand(x.cast("double"), F.coalesce(render_number(x.cast("double")), F.lit(MISSING)))


def text_field(x: Column) -> Operand:
    return Operand(F.lit(None).cast("double"), F.coalesce(x.cast("string"), F.lit(MISSING)))


def compile_node(node: Node, scope: Scope) -> Column:
    check_compiles(node)
    return _pick(_node(node, scope), [F.lit(False), F.lit(None).cast("boolean"), F.lit(True)])


def _pick(code: Column, values: list[Column]) -> Column:
    """The value at a code, which occurs once."""
    return F.get(F.array(*values), code)


def _node(node: Node, scope: Scope) -> Column:
    """0 false, 1 error, 2 true."""
    if node.type == "CONDITION":
        return F.coalesce(_condition(node, scope).cast("int") * 2, F.lit(1))
    children = [_node(c, scope) for c in node.children]
    if node.type == "NOT":
        return 2 - children[0]
    stop, go_on = (2, 0) if node.type == "OR" else (0, 2)
    if not children:
        return F.lit(go_on)
    # The first child that stops or fails has the least number; the rest of a number by 3 is its code.
    ranked = [_pick(c, [F.lit(3 * len(children) + go_on if k == go_on else 3 * i + k) for k in range(3)]) for i, c in enumerate(children)]
    return (ranked[0] if len(ranked) == 1 else F.least(*ranked)) % 3


def _condition(node: Node, scope: Scope) -> Column:
    op = node.operator.upper()
    key = AggregateKey(node.field, node.window) if ":" in node.field else None
    left = scope.variable(node.field[1:], None) if node.field.startswith("$") else scope.field(node.field, key)
    if op in ("IN", "NOT_IN"):
        if not isinstance(node.value, (list, tuple)):
            return F.lit(None).cast("boolean")
        inside = _inside(left, node.value) if node.value else F.lit(False)
        return inside if op == "IN" else ~inside
    value = node.value
    right = scope.variable(value[1:], value) if isinstance(value, str) and value.startswith("$") else literal(value)
    both = left.number.isNotNull() & right.number.isNotNull()
    if op in ("=", "==", "!="):
        same = F.when(both, left.number == right.number).otherwise(left.text == right.text)
        return ~same if op == "!=" else same
    compared = {">": left.number > right.number, "<": left.number < right.number, ">=": left.number >= right.number, "<=": left.number <= right.number}[op]
    return F.when(both, compared)


def _inside(left: Operand, items: list[Any] | tuple[Any, ...]) -> Column:
    """Membership by text. Texts of numbers are not made where the numbers decide: different ones but 0 and -0 have different texts."""
    texts = [render(v) for v in items]
    numbers = [x for x in map(_as_number, texts) if x]
    same = left.number.isin(numbers) if numbers else F.lit(False)
    return F.when(left.number.isNotNull() & (left.number != 0) & ~F.isnan(left.number), same).otherwise(left.text.isin(texts))


def _as_number(text: str) -> float | None:
    """The number that looks like a text, if one does."""
    try:
        x = float(text)
    except ValueError:
        return None
    return x if render(x) == text and x == x else None


def fires(condition: Column) -> Column:
    """Errors count as not fired."""
    return F.coalesce(condition, F.lit(False))
