"""Batch plans against the event-by-event engine on random streams, and against SQL on the small tables."""

import random
import time
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from ruleweave.functions.rendering import render, render_number
from ruleweave.model import AggregateKey, DefinitionError, Node, Rule, TimeWindow, pattern_from_json
from ruleweave.operators.aggregates import columns_for, with_aggregates
from ruleweave.operators.events import with_time
from ruleweave.operators.patterns import pattern_matches
from ruleweave.operators.rules import compile_ruleset, late_events, rule_matches
from ruleweave.plans import catalog
from ruleweave.plans.compiler import Operand, Scope, compile_node
from ruleweave.sources.events import identified
from ruleweave.streaming.core import MINUTE, ShardCore
from ruleweave.streaming.engine import replay

DATA = "/root/testdata/sf0.001"
KEYS = [AggregateKey(f"{b}:{k}:amount", w) for b in "ab" for k in ("COUNT", "SUM", "AVG", "MAX", "MIN") for w in (TimeWindow(5), TimeWindow(1, "hours"))]
SCHEMA = "seq bigint, event_id string, member_id string, behavior string, occurred_at timestamp, num_amount double"


def stream(seed: int, disorder: int = 0, repeats: bool = False, n: int = 250):
    r = random.Random(seed)
    rows, t = [], 1_700_000_000_000_000
    for i in range(n):
        t += r.randrange(0, 4 * MINUTE)
        rows.append([f"e{i}", r.choice("uvw"), r.choice("abc"), t, r.choice([None, float(r.randrange(1, 50))])])
    if disorder:
        rows.sort(key=lambda x: x[3] + r.randrange(0, disorder) * MINUTE)
    if repeats:
        rows = [x for row in rows for x in ([row, row] if r.random() < 0.1 else [row])]
    return [(i, *row) for i, row in enumerate(rows)]


def frame(spark, rows):
    made = spark.createDataFrame([(s, e, m, b, t, a) for s, e, m, b, t, a in rows], "seq bigint, event_id string, member_id string, behavior string, t bigint, num_amount double")
    return made.select("seq", "event_id", "member_id", "behavior", F.timestamp_micros("t").alias("occurred_at"), "num_amount")


def simulate(rows, **options):
    core = ShardCore(**options)
    return core, [(s, m, core.process(s, e, m, b, {} if a is None else {"amount": a}, t), t) for s, e, m, b, t, a in rows]


@pytest.mark.parametrize("seed, disorder, repeats", [(1, 0, False), (2, 0, True), (3, 60, False), (4, 90, True), (5, 200, False)])
def test_aggregates(spark, seed, disorder, repeats):
    rows = stream(seed, disorder, repeats)
    rules = [Rule(1, "r", Node("AND", tuple(Node("CONDITION", (), k.path, ">=", 0, k.window) for k in KEYS)))]
    core = ShardCore(rules, lateness=0)
    want = {}
    for s, e, m, b, t, a in rows:
        core.process(s, e, m, b, {} if a is None else {"amount": a}, t)
        want[s] = [core.aggregate(core.members[m], k, t) for k in KEYS]
    names = columns_for(KEYS)
    order = "disordered" if disorder else "in_order"
    got = with_aggregates(with_time(frame(spark, rows)), KEYS, order).select("seq", *names.values()).collect()
    assert len(got) == len(rows)
    for r in got:
        assert list(r)[1:] == pytest.approx(want[r.seq], abs=1e-9), r.seq


@pytest.mark.parametrize("seed, disorder", [(6, 0), (7, 100)])
def test_rules_and_late_events(spark, seed, disorder):
    rows = stream(seed, disorder, True)
    node = Node("OR", (Node("CONDITION", (), "a:COUNT", ">=", 3, TimeWindow(30)), Node("CONDITION", (), "amount", ">", 30)))
    rules = [Rule(1, "one", node), Rule(2, "two", Node("NOT", (node,))), Rule(3, "off", node, status=2)]
    _, out = simulate(rows, rules=rules, lateness=600)
    e = frame(spark, rows)
    got = {(r.seq, r.rule_id) for r in rule_matches(e, rules, "disordered", 600).collect()}
    assert got == {(s, i) for s, _, r, _ in out for i in r.rules}
    assert {r.seq for r in late_events(e, 600).collect()} == {s for s, _, r, _ in out if r.late}
    assert {(r.seq, r.rule_id) for r in replay(e, rules, lateness=600, shards=1).filter("kind = 'rule'").collect()} == got


def _pattern(*states):
    from tests.test_core import waits

    return waits(*states)


@pytest.mark.parametrize("states", [
    [("a", None, False)], [("a", None, False), ("b", 20, False)], [("a", None, False), ("a", 30, False), ("b", 30, False)], [("a", None, False), ("b", 15, False), ("c", None, False)],
    [("a", None, False), ("b", None, False)], [("a", None, False), ("c", 10, True)], [("a", None, False), ("b", 40, False), ("c", 20, True)], [("a", None, False), ("b", 20, False), ("c", 40, True)],
])
@pytest.mark.parametrize("semantics", ["as_coded", "intent"])
def test_patterns_in_order(spark, states, semantics):
    rows = [r for r in stream(11, n=300)]
    pattern = _pattern(*states)
    _, out = simulate(rows, patterns=[pattern], lateness=120, semantics=semantics)
    want = sorted((m, s, e, t) for _, _, r, _ in out for _, m, s, e, _, t in r.matches)
    got = sorted((r.member_id, r.start_seq, r.end_seq, r.t) for r in pattern_matches(frame(spark, rows), pattern, 120, semantics=semantics).withColumn("t", F.unix_micros("matched_at")).collect())
    assert got == want and want


@pytest.mark.parametrize("negative", [False, True])
def test_patterns_with_variables(spark, negative):
    """Variables on either side, bound late, bound again and not bound, against the event-by-event engine."""
    rows = [r for r in stream(31, n=300)]
    is_ = lambda b: {"type": "CONDITION", "field": "behavior", "operator": "=", "value": b}
    both = lambda *c: {"type": "AND", "children": list(c)}
    states = [
        {"name": "a", "condition": is_("a"), "context_binding": {"x": "$event.amount", "gone": "$event.nothing"}},
        {"name": "b", "condition": both(is_("b"), {"type": "CONDITION", "field": "amount", "operator": ">", "value": "$x"}, {"type": "CONDITION", "field": "amount", "operator": "!=", "value": "$gone"}), "max_wait": {"value": 60, "unit": "minutes"}, "context_binding": {"x": "$event.amount", "y": "$event.amount"}},
        {"name": "c", "condition": both(is_("c"), {"type": "CONDITION", "field": "$x", "operator": ">", "value": 10}, {"type": "CONDITION", "field": "amount", "operator": "<", "value": "$y"}), "max_wait": {"value": 90, "unit": "minutes"}, "is_negative": negative},
    ]
    pattern = pattern_from_json("p", "p", states)
    _, out = simulate(rows, patterns=[pattern], lateness=120)
    want = sorted((m, s, e, t) for _, _, r, _ in out for _, m, s, e, _, t in r.matches)
    got = sorted((r.member_id, r.start_seq, r.end_seq, r.t) for r in pattern_matches(frame(spark, rows).withColumn("txt_amount", render_number(F.col("num_amount"))), pattern, 120).withColumn("t", F.unix_micros("matched_at")).collect())
    assert got == want and want


def test_disorder_is_seen(spark):
    """By default the order is looked at: disordered input has late events and other aggregates, and patterns refuse it."""
    rows = stream(7, 100, True)
    rules = [Rule(1, "one", Node("CONDITION", (), "a:COUNT", ">=", 3, TimeWindow(30)))]
    e = frame(spark, rows)
    assert sorted(map(tuple, rule_matches(e, rules).collect())) == sorted(map(tuple, rule_matches(e, rules, "disordered").collect()))
    with pytest.raises(DefinitionError):
        pattern_matches(e, _pattern(("a", None, False), ("b", 20, False)))
    with pytest.raises(DefinitionError):
        pattern_matches(frame(spark, stream(2, 0, True)), _pattern(("a", None, False), ("b", 20, False)))


def test_plans_grow_with_the_rule(spark):
    node = Node("CONDITION", (), "num", ">", 3)
    sizes = []
    for depth in range(13):
        node = Node("AND" if depth % 2 else "OR", (node, Node("CONDITION", (), "num", "<", depth)))
        sizes.append(len(compile_node(node, Scope({"num": Operand(F.col("x"), F.col("x").cast("string"))}))._jc.toString()))
    assert sizes[12] < 4 * sizes[3]
    e = spark.range(10).select(F.col("id").cast("double").alias("x"))
    began = time.perf_counter()
    assert e.filter(compile_node(node, Scope({"num": Operand(F.col("x"), F.col("x").cast("string"))}))).count() == 10
    assert time.perf_counter() - began < 5


def test_equal_offsets_of_two_partitions(spark):
    """Two members' purchases of 10 and 500 at one offset each: only one of them fires."""
    raw = spark.createDataFrame([(0, 5, "u", 10.0), (1, 5, "v", 500.0)], "partition int, offset bigint, member_id string, num_amount double")
    seq = identified(raw.withColumn("value", F.lit(""))).select("seq", "shard")
    e = raw.join(seq, raw["partition"] == seq["shard"]).select("seq", F.col("member_id").alias("event_id"), "member_id", F.lit("buy").alias("behavior"), F.timestamp_micros(F.lit(1_700_000_000_000_000)).alias("occurred_at"), "num_amount")
    rule = Rule(1, "sum", Node("CONDITION", (), "buy:SUM:amount", ">", 400, TimeWindow(1, "hours")))
    assert [r.member_id for r in rule_matches(e, [rule], "disordered").collect()] == ["v"]


def test_replay_mutes_the_late_sink(spark):
    e = frame(spark, stream(8, 200))
    told = replay(e, lateness=60, shards=1).filter("kind = 'late'").count()
    assert told and replay(e, lateness=60, shards=1, replay_until=10_000).filter("kind = 'late'").count() == 0


def test_bad_rules_are_set_apart():
    good = Rule(1, "g", Node("CONDITION", (), "a", "=", 1))
    found = compile_ruleset([good, Rule(2, "b", Node("WHAT")), Rule(3, "c", Node("CONDITION", (), "a:MODE:b", ">", 1))])
    assert [r.id for r in found.rules] == [1] and set(found.errors) == {2, 3}


def test_numbers_as_text(spark):
    values = [0.0, 1.0, -2.5, 0.1, 99999.0, 100000.0, 999999.5, 1e6, 1234567.0, 2.5e6, 1e7, 1.5e20, 1e21, 0.001, 0.0005, 0.00015, 1e-5, -3e-7, 123456.789]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", render_number(F.col("v")).alias("s")).collect()
    assert {r.v: r.s for r in got} == {v: render(v) for v in values}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_against_sql(spark, con, name):
    got = catalog.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    rows = sorted(map(repr, map(tuple, got.select(columns).collect())))
    con.execute(f"create or replace table o as {catalog.SQL[name]}")
    assert columns == sorted(r[0] for r in con.execute("describe o").fetchall())
    want = con.execute("select " + ", ".join(f'"{c}"' for c in columns) + " from o").fetchall()
    assert rows == sorted(map(repr, want))
