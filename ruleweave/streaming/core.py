"""The engine one event at a time: what streams run for each shard, and what batch plans are tested against."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from ruleweave.functions.rendering import render
from ruleweave.model import AggregateKey, Node, Pattern, Rule, aggregate_keys, retention_seconds, unique_keys

SECOND, MINUTE = 1_000_000, 60_000_000


class EvaluationError(Exception):
    """A condition that has no answer."""


def _number(x: Any) -> float | None:
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None


def evaluate(node: Node, fields: Mapping[str, Any], aggregates: Mapping[str, float] | None, variables: Mapping[str, Any]) -> bool:
    """A node by walking the tree."""
    if node.type == "AND":
        return all(evaluate(c, fields, aggregates, variables) for c in node.children)
    if node.type == "OR":
        return any(evaluate(c, fields, aggregates, variables) for c in node.children)
    if node.type == "NOT":
        return not evaluate(node.children[0], fields, aggregates, variables)
    op = node.operator.upper()
    if node.field.startswith("$"):
        left = variables.get(node.field[1:])
    elif ":" in node.field and aggregates is not None:
        left = aggregates.get(AggregateKey(node.field, node.window).cache_key)
    else:
        left = fields.get(node.field)
    if op in ("IN", "NOT_IN"):
        if not isinstance(node.value, (list, tuple)):
            raise EvaluationError("a list is needed")
        return (render(left) in map(render, node.value)) == (op == "IN")
    right = node.value
    if isinstance(right, str) and right.startswith("$"):
        right = variables.get(right[1:], right)
    a, b = _number(left), _number(right)
    if op in ("=", "==", "!="):
        same = a == b if a is not None and b is not None else render(left) == render(right)
        return same != (op == "!=")
    if a is None or b is None:
        raise EvaluationError("numbers are needed")
    return {">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op]


def holds(node: Node, fields: Mapping[str, Any], aggregates: Mapping[str, float] | None, variables: Mapping[str, Any]) -> bool:
    try:
        return evaluate(node, fields, aggregates, variables)
    except EvaluationError:
        return False


@dataclass
class Bucket:
    count: int = 0
    sums: dict[str, float] = field(default_factory=dict)
    maxs: dict[str, float] = field(default_factory=dict)
    mins: dict[str, float] = field(default_factory=dict)
    ids: set[str] = field(default_factory=set)


@dataclass
class Progress:
    pattern: int
    member: str
    start: int
    start_seq: int
    step: int
    variables: dict[str, Any]
    seen: set[str]
    deadline: int | None = None
    last_seq: int = 0


@dataclass
class Member:
    buckets: dict[str, dict[int, Bucket]] = field(default_factory=dict)
    progresses: dict[str, Progress] = field(default_factory=dict)


@dataclass
class Result:
    late: bool = False
    rules: list[int] = field(default_factory=list)
    matches: list[tuple[str, str, int, int, dict[str, Any], int]] = field(default_factory=list)  # pattern, member, start seq, end seq, variables, time


class ShardCore:
    """State of one shard: members' buckets and progresses, the watermark and the deadlines."""

    def __init__(self, rules: list[Rule] = (), patterns: list[Pattern] = (), lateness: float = 5, semantics: str = "as_coded"):
        self.rules = [r for r in rules if r.status == 1]
        self.patterns = [p for p in patterns if p.status == 1]
        self.keys = unique_keys(k for r in self.rules for k in aggregate_keys(r.node))
        self.retention = retention_seconds(self.keys) * SECOND
        self.lateness, self.semantics = int(lateness * SECOND), semantics
        self.members: dict[str, Member] = {}
        self.watermark, self.deadlines = 0, []

    # Recovery.
    def snapshot(self) -> bytes:
        return pickle.dumps((self.members, self.watermark))

    def restore(self, raw: bytes) -> None:
        self.members, self.watermark = pickle.loads(raw)
        self.deadlines = [(p.deadline, m, i) for m, s in self.members.items() for i, p in s.progresses.items() if p.deadline is not None]
        heapq.heapify(self.deadlines)

    def forget(self) -> None:
        """As new: nothing of the members so far is kept."""
        self.members, self.watermark, self.deadlines = {}, 0, []

    def advance(self, watermark: float) -> Result:
        """The watermark as events of members that aren't here have moved it, and the matches that this settles."""
        self.watermark = max(self.watermark, watermark)
        self._drain(out := Result())
        return out

    # Aggregates.
    def _fold(self, member: Member, event_id: str, behavior: str, fields: Mapping[str, Any], t: int) -> None:
        at = t // MINUTE * MINUTE
        own = member.buckets.setdefault(behavior, {})
        bucket = own.setdefault(at, Bucket())
        if event_id in bucket.ids:
            return
        bucket.ids.add(event_id)
        bucket.count += 1
        for name, value in fields.items():
            if (x := _number(value)) is not None:
                bucket.sums[name] = bucket.sums.get(name, 0.0) + x
                bucket.maxs[name] = max(bucket.maxs.get(name, x), x)
                bucket.mins[name] = min(bucket.mins.get(name, x), x)
        oldest = (t - self.retention - (0 if self.semantics == "as_coded" else self.lateness)) // MINUTE * MINUTE
        for b in [b for b in own if b < oldest]:
            del own[b]

    def aggregate(self, member: Member, key: AggregateKey, t: int) -> float:
        behavior, kind, name = key.parts
        high = t // MINUTE * MINUTE
        low = (t - key.seconds * SECOND) // MINUTE * MINUTE if key.seconds else None
        near = [x for b, x in member.buckets.get(behavior, {}).items() if b <= high and (low is None or b >= low)]
        if kind == "COUNT":
            return float(sum(x.count for x in near))
        if kind in ("SUM", "AVG"):
            total = sum(x.sums.get(name, 0.0) for x in near)
            n = sum(x.count for x in near)
            return total if kind == "SUM" else total / n if n else 0.0
        values = [x for b in near if (x := (b.maxs if kind == "MAX" else b.mins).get(name)) is not None]
        return (max(values) if kind == "MAX" else min(values)) if values and kind in ("MAX", "MIN") else 0.0

    # Events.
    def process(self, seq: int, event_id: str, member_id: str, behavior: str, fields: Mapping[str, Any], t: int) -> Result:
        """One event in arrival order; t in microseconds."""
        member = self.members.setdefault(member_id, Member())
        late = t < self.watermark
        self._fold(member, event_id, behavior, fields, t)
        if late:
            return Result(late=True)
        self.watermark = max(self.watermark, t - self.lateness)
        view = {**fields, "behavior": behavior, "member_id": member_id}
        values = {k.cache_key: self.aggregate(member, k, t) for k in self.keys}
        out = Result(rules=[r.id for r in self.rules if holds(r.node, view, values, {})])
        self._patterns(member, member_id, seq, event_id, fields, view, t, out)
        self._drain(out)
        return out

    def _bind(self, state, fields: Mapping[str, Any]) -> dict[str, Any]:
        return {name: fields[source[7:]] for name, source in state.binding if source.startswith("$event.") and source[7:] in fields}

    def _swept(self, p: Progress) -> bool:
        longest = self.patterns[p.pattern].longest_wait
        if self.semantics != "as_coded" and p.deadline is not None:
            return False
        return bool(longest) and self.watermark - p.start > longest * SECOND

    def _patterns(self, member: Member, member_id: str, seq: int, event_id: str, fields, view, t: int, out: Result) -> None:
        live = member.progresses
        for i in [i for i, p in live.items() if self._swept(p)]:
            del live[i]
        for i, p in list(live.items()):
            pattern = self.patterns[p.pattern]
            state = pattern.states[p.step]
            if event_id in p.seen:
                continue
            if state.negative:
                if holds(state.condition, view, None, p.variables):
                    del live[i]
                continue
            if state.max_wait and t > p.start + state.max_wait.seconds * SECOND:
                del live[i]
                continue
            if not holds(state.condition, view, None, p.variables):
                continue
            p.variables = {**p.variables, **self._bind(state, fields)}
            p.seen.add(event_id)
            p.step, p.last_seq = p.step + 1, seq
            if p.step == len(pattern.states):
                out.matches.append((pattern.id, member_id, p.start_seq, seq, p.variables, t))
                del live[i]
            else:
                self._park(member_id, i, p)
        for k, pattern in enumerate(self.patterns):
            if not holds(pattern.states[0].condition, view, None, {}):
                continue
            bound = self._bind(pattern.states[0], fields)
            if len(pattern.states) == 1:
                out.matches.append((pattern.id, member_id, seq, seq, bound, t))
                continue
            i = f"{pattern.id}|{member_id}|{event_id}"
            if i not in live:
                live[i] = p = Progress(k, member_id, t, seq, 1, bound, {event_id}, last_seq=seq)
                self._park(member_id, i, p)

    def _park(self, member_id: str, i: str, p: Progress) -> None:
        state = self.patterns[p.pattern].states[p.step]
        if state.negative:
            p.deadline = p.start + state.max_wait.seconds * SECOND
            heapq.heappush(self.deadlines, (p.deadline, member_id, i))

    def _drain(self, out: Result) -> None:
        while self.deadlines and self.watermark > self.deadlines[0][0]:
            deadline, member_id, i = heapq.heappop(self.deadlines)
            p = self.members[member_id].progresses.get(i)
            if p is not None and p.deadline == deadline:
                out.matches.append((self.patterns[p.pattern].id, member_id, p.start_seq, p.last_seq, p.variables, deadline))
                del self.members[member_id].progresses[i]
