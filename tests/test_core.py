"""Scenarios for one shard, event by event."""

import pytest

from ruleweave.functions.rendering import render
from ruleweave.model import AggregateKey, DefinitionError, Node, Rule, TimeWindow, check_compiles, node_from_json, pattern_from_json, retention_seconds, validate_node
from ruleweave.streaming.core import MINUTE, SECOND, EvaluationError, ShardCore, evaluate

T0 = 1_780_000_000 * SECOND // MINUTE * MINUTE
BIG = Rule(1, "big", Node("CONDITION", (), "Withdraw:SUM:amount", ">", 10_000, TimeWindow(5)))


def feed(core, rows):
    return [core.process(i, e, m, b, {"amount": a} if a is not None else {}, T0 + int(at * MINUTE)) for i, (e, m, b, a, at) in enumerate(rows)]


def waits(*states):
    return pattern_from_json("p", "p", [{"name": b, "condition": {"type": "CONDITION", "field": "behavior", "operator": "=", "value": b}, "max_wait": w and {"value": w, "unit": "minutes"}, "is_negative": n} for b, w, n in states])


def test_sum_fires_on_third():
    out = feed(ShardCore([BIG]), [(f"e{i}", "u", "Withdraw", 4000.0, i) for i in range(3)])
    assert [r.rules for r in out] == [[], [], [1]]


def test_five_minutes_cover_six_minutes():
    rows = [("a", "u", "Withdraw", 9000.0, 0), ("b", "u", "Withdraw", 2000.0, 5.9)]
    assert feed(ShardCore([BIG]), rows)[1].rules == [1]
    assert feed(ShardCore([BIG]), [rows[0], ("b", "u", "Withdraw", 2000.0, 6)])[1].rules == []


def test_repeat_counts_once_but_is_evaluated_again():
    core = ShardCore([Rule(1, "r", Node("CONDITION", (), "Withdraw:SUM:amount", ">=", 5000, TimeWindow(5)))])
    out = feed(core, [("a", "u", "Withdraw", 5000.0, 0)] * 2)
    assert [r.rules for r in out] == [[1], [1]]
    assert core.members["u"].buckets["Withdraw"][T0].count == 1


def test_no_future_leak():
    out = feed(ShardCore([BIG], lateness=3600), [("a", "u", "Withdraw", 8000.0, 5), ("b", "u", "Withdraw", 8000.0, 0)])
    assert not any(r.rules for r in out)


def test_late_events_count_but_are_not_evaluated():
    core = ShardCore([BIG], lateness=0)
    out = feed(core, [("a", "u", "Withdraw", 1000.0, 1), ("b", "u", "Withdraw", 90_000.0, 0), ("c", "u", "Withdraw", 1.0, 1)])
    assert [r.late for r in out] == [False, True, False] and out[1].rules == [] and out[2].rules == [1]


def test_order_does_not_matter_inside_the_window():
    rows = [("a", "u", "Withdraw", 3000.0, 0), ("b", "u", "Withdraw", 7000.0, 1), ("c", "u", "Withdraw", 4500.0, 2), ("d", "u", "Withdraw", 5000.0, 3)]
    one, two = ShardCore([BIG], lateness=0), ShardCore([BIG], lateness=0)
    feed(one, rows)
    feed(two, [rows[i] for i in (2, 0, 3, 1)])
    assert one.members["u"].buckets == two.members["u"].buckets


def test_snapshot_overlap():
    rows = [("a", "u", "Withdraw", 3000.0, 0), ("b", "u", "Withdraw", 4000.0, 1), ("c", "u", "Withdraw", 5000.0, 2)]
    whole, first, second = ShardCore([BIG]), ShardCore([BIG]), ShardCore([BIG])
    feed(whole, rows)
    feed(first, rows[:2])
    second.restore(first.snapshot())
    assert feed(second, rows)[2].rules == [1]
    assert second.members == whole.members


def test_aab_leaves_the_second_progress():
    core = ShardCore(patterns=[waits(("f", None, False), ("f", 5, False), ("s", 5, False))])
    out = feed(core, [("a", "u", "f", None, 0), ("b", "u", "f", None, 1), ("c", "u", "s", None, 2)])
    assert [len(r.matches) for r in out] == [0, 0, 1] and out[2].matches[0][2:4] == (0, 2)
    assert len(core.members["u"].progresses) == 1


def test_wait_counts_from_the_start_and_includes_its_end():
    p = waits(("a", None, False), ("b", 5, False))
    assert feed(ShardCore(patterns=[p]), [("1", "u", "a", None, 0), ("2", "u", "b", None, 5)])[1].matches
    assert not feed(ShardCore(patterns=[p]), [("1", "u", "a", None, 0), ("2", "u", "b", None, 6)])[1].matches


def test_completing_event_again():
    out = feed(ShardCore(patterns=[waits(("a", None, False), ("b", 5, False))]), [("1", "u", "a", None, 0), ("2", "u", "b", None, 1), ("2", "u", "b", None, 1)])
    assert sum(len(r.matches) for r in out) == 1


NEGATIVE = waits(("login", None, False), ("verify", 5, True))


def test_negative_fires_for_a_silent_member_strictly_after():
    core = ShardCore(patterns=[NEGATIVE], lateness=0)
    feed(core, [("1", "alice", "login", None, 0)])
    assert not core.process(1, "2", "bob", "browse", {}, T0 + 5 * MINUTE).matches
    assert core.process(2, "3", "bob", "browse", {}, T0 + 5 * MINUTE + 1).matches == [("p", "alice", 0, 0, {}, T0 + 5 * MINUTE)]


def test_negative_aborted():
    out = feed(ShardCore(patterns=[NEGATIVE], lateness=0), [("1", "alice", "login", None, 0), ("2", "alice", "verify", None, 2), ("3", "bob", "browse", None, 10)])
    assert not any(r.matches for r in out)


@pytest.mark.parametrize("semantics, found", [("as_coded", 0), ("intent", 1)])
def test_negative_when_the_member_moves_the_clock(semantics, found):
    out = feed(ShardCore(patterns=[NEGATIVE], lateness=0, semantics=semantics), [("1", "alice", "login", None, 0), ("2", "alice", "browse", None, 9)])
    assert len(out[1].matches) == found


def test_bound_variables_reach_conditions():
    p = pattern_from_json("p", "p", [
        {"name": "a", "condition": {"type": "CONDITION", "field": "behavior", "operator": "=", "value": "in"}, "context_binding": {"x": "$event.amount"}},
        {"name": "b", "condition": {"type": "CONDITION", "field": "amount", "operator": ">", "value": "$x"}, "max_wait": {"value": 1, "unit": "hours"}},
    ])
    out = feed(ShardCore(patterns=[p]), [("1", "u", "in", 5.0, 0), ("2", "u", "out", 4.0, 1), ("3", "u", "out", 6.0, 2)])
    assert [len(r.matches) for r in out] == [0, 0, 1] and out[2].matches[0][4] == {"x": 5.0}


def test_aggregates_over_nothing():
    core = ShardCore()
    core.process(0, "a", "u", "view", {"w": "text"}, T0)
    m = core.members["u"]
    assert [core.aggregate(m, AggregateKey(f"view:{k}:w", TimeWindow(1, "days")), T0) for k in ("COUNT", "SUM", "AVG", "MAX", "MIN")] == [1, 0, 0, 0, 0]
    assert core.aggregate(m, AggregateKey("none:COUNT", None), T0) == 0


@pytest.mark.parametrize("states", [[], [("a", 5, True)], [("a", None, False), ("b", 5, True), ("c", 5, False)], [("a", None, False), ("b", None, True)]])
def test_invalid_patterns(states):
    with pytest.raises(DefinitionError):
        waits(*states)


@pytest.mark.parametrize("node", [Node("XOR"), Node("NOT", (Node("AND"), Node("AND"))), Node("CONDITION", (), "a", "~", 1)])
def test_nodes_that_do_not_compile(node):
    with pytest.raises(DefinitionError):
        check_compiles(node)


@pytest.mark.parametrize("path", ["Trade:MEDIAN:x", "Trade:SUM:a-b", "Trade:SUM:1x", ":SUM:x"])
def test_malformed_aggregates(path):
    with pytest.raises(DefinitionError):
        validate_node(Node("CONDITION", (), path, ">", 1))


def test_errors_and_missing_fields():
    c = lambda f, o, v: Node("CONDITION", (), f, o, v)
    ev = lambda n: evaluate(n, {"a": 1.0, "s": "x"}, {}, {})
    assert ev(c("none", "!=", "x")) and ev(c("none", "NOT_IN", ("x",))) and ev(c("none", "=", "<nil>"))
    assert not ev(c("none", "IN", ("x",)))
    for bad in (c("s", ">", 1), c("none", "<", 1), c("a", "IN", 3), Node("OR", (c("s", ">", 1), c("a", "=", 1)))):
        with pytest.raises(EvaluationError):
            ev(bad)
    assert ev(Node("OR", (c("a", "=", 1), c("s", ">", 1)))) and ev(Node("AND", ())) and not ev(Node("OR", ()))


def test_rendering():
    values = {100000.0: "100000", 1e6: "1e+06", 1234567.0: "1.234567e+06", 0.5: "0.5", 1e-4: "0.0001", 1e-5: "1e-05", -2.5: "-2.5", 1e21: "1e+21", 0.0: "0"}
    assert {k: render(k) for k in values} == values and (render(None), render(True), render("a")) == ("<nil>", "true", "a")


def test_windows_and_keys():
    assert [TimeWindow(2, u).minutes for u in ("minutes", "HOURS", "Days", "weeks")] == [2, 120, 2880, 2]
    assert AggregateKey("A:sum:x", TimeWindow(1, "hours")).cache_key == "A:sum:x|1hours" and AggregateKey("A:sum:x").parts == ("A", "SUM", "x")
    assert retention_seconds([]) == 86400 and retention_seconds([AggregateKey("A:COUNT", TimeWindow(7, "days"))]) == 7 * 86400
    assert node_from_json('{"type":"AND","children":[{"type":"CONDITION","field":"a","operator":"IN","value":[1,2]}]}').children[0].value == (1, 2)
