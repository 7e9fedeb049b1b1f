"""Streams: the same outcomes as a replay, over restarts and redelivery."""

import pytest
from pyspark.sql import functions as F

from ruleweave.model import Node, Rule, TimeWindow
from ruleweave.sources.events import decode_json, encode_json, generate, read_log
from ruleweave.sources.store import RuleStore, patterns_from_table, rules_from_table
from ruleweave.streaming.core import ShardCore
from ruleweave.streaming.engine import CHUNK, _packed, _told, replay, stream, write_outcomes
from tests.test_core import waits
from tests.test_plans import frame, simulate, stream as made

RULES = [Rule(1, "r", Node("CONDITION", (), "a:COUNT", ">=", 3, TimeWindow(30)))]


def test_stream_over_a_restart(spark, tmp_path):
    rows = made(21, disorder=30, repeats=True)
    e = frame(spark, rows)
    patterns = [waits(("a", None, False), ("b", 20, False), ("c", 30, True))]
    log, out, check = str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "check")
    for low, high in ((0, 90), (90, 10**9)):  # the second part arrives while the query is down
        e.filter((F.col("seq") >= low) & (F.col("seq") < high)).coalesce(1).write.mode("append").parquet(log)
        found = stream(read_log(spark, log, e.schema.simpleString()[7:-1].replace(":", " "), True), RULES, patterns, lateness=300, shards=2)
        write_outcomes(found, out, check).awaitTermination()
    want = replay(e, RULES, patterns, lateness=300, shards=2)
    for kind, columns in (("rule", ["seq", "rule_id"]), ("late", ["seq"]), ("pattern", ["member_id", "start_seq", "end_seq", "matched_at"])):
        got = sorted(map(tuple, spark.read.parquet(f"{out}/{kind}").select(*columns).collect()))
        assert got == sorted(map(tuple, want.filter(F.col("kind") == kind).select(*columns).collect())), kind
        assert got or kind == "late"


def test_json_messages(spark):
    rows = [(0, '{"event_id":"1","member_id":"m","behavior":"b","fields":{"n":1.5,"s":"12","t":true,"z":null,"o":{"a":1}},"occurred_at":"2026-01-01T00:00:00.000001Z"}'), (1, "nonsense"), (2, '{"event_id":"","member_id":"m","behavior":"b","occurred_at":"2026-01-01T00:00:00Z"}'), (3, '{"event_id":"3","member_id":"m","behavior":"b"}')]
    events, dead = decode_json(spark.createDataFrame(rows, "seq bigint, value string"), ["n", "s", "t", "z", "gone"])
    assert [d.seq for d in dead.collect()] == [1, 2]
    assert events.filter("seq = 3").select(F.unix_micros("occurred_at") < 0).collect()[0][0]  # late whatever the watermark
    events = events.filter("seq = 0")
    r = events.collect()
    assert (r[0].num_n, r[0].num_s, r[0].num_t, r[0].num_z) == (1.5, None, None, None)
    assert (r[0].txt_n, r[0].txt_s, r[0].txt_t, r[0].txt_z, r[0].txt_gone) == ("1.5", "12", "true", None, None)
    again, _ = decode_json(encode_json(events), ["n", "s"])
    assert again.select("num_n", "txt_s", F.unix_micros("occurred_at")).collect()[0] == (1.5, "12", 1767225600000001)


def test_generator(spark):
    e = generate(spark, 1000, members=10)
    assert e.count() == 1000 and e.select("member_id").distinct().count() == 10 and e.filter("num_amount between 0 and 10000").count() == 1000


def test_store(spark, tmp_path):
    store = RuleStore(str(tmp_path / "rules.json"))
    node = {"type": "CONDITION", "field": "amount", "operator": ">", "value": 5}
    a, b = store.create("one", node), store.create("two", node, "text")
    store.update(a.id, name="uno")
    store.set_status(b.id, 2)
    assert [r.name for r in store.list()] == ["uno", "two"] and [r.id for r in store.compiled().rules] == [a.id] and store.get(b.id).status == 2
    for bad in ({"type": "CONDITION", "field": "x", "operator": "~", "value": 1}, {"type": "CONDITION", "field": "A:NOPE:x", "operator": ">", "value": 1}):
        try:
            store.create("bad", bad)
            raise AssertionError
        except ValueError:
            pass
    spark.createDataFrame([(1, "n", "", '{"type":"AND"}', 1), (2, "m", "", '{"type":"AND"}', 2)], "id bigint, name string, description string, rule_node string, status int").write.parquet(str(tmp_path / "rules"))
    assert [r.id for r in rules_from_table(spark, str(tmp_path / "rules"))] == [1]
    spark.createDataFrame([("p", "n", '[{"name":"a","condition":{"type":"AND"}}]', 1)], "id string, name string, states string, status int").write.parquet(str(tmp_path / "patterns"))
    assert patterns_from_table(spark, str(tmp_path / "patterns"))[0].id == "p"


def _spread(spark, found):
    """Rows of a replay, and how many tasks they came from."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = found.withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return rows, len({r.task for r in rows})


def _many(seed, members=12, **options):
    """A stream of more members than that of the plans' tests."""
    return [(s, e, f"{m}{int(e[1:]) % members}", b, t, a) for s, e, m, b, t, a in made(seed, **options)]


def test_replayed_rules_of_a_shard_are_spread_over_tasks(spark):
    """rule_interpreter: members of one shard in several tasks, in batches, with the outcomes of one engine for the shard."""
    rows = _many(41, disorder=40, repeats=True, n=600)
    rules = [*RULES, Rule(2, "two", Node("CONDITION", (), "amount", ">", 30))]
    _, want = simulate(rows, rules=rules, lateness=600)
    found = replay(frame(spark, rows), rules, lateness=600, shards=1)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
    got, tasks = _spread(spark, found)
    assert tasks > 1
    assert sorted((r.seq, r.rule_id) for r in got if r.kind == "rule") == sorted((s, i) for s, _, r, _ in want for i in r.rules)
    assert sorted(r.seq for r in got if r.kind == "late") == [s for s, _, r, _ in want if r.late] != []


def _fed(rows, order, lateness, **options):
    """Rows as a task of the replay of one shard gets them."""
    mark, out = 0, []
    for s, e, m, b, t, a in rows:
        out.append({"seq": s, "event_id": e, "member_id": m, "behavior": b, "num_amount": a, "t_": t, "shard_": 0, "wm_before_": mark})
        mark = max(mark, t - lateness * 1_000_000)
    return sorted(out, key=lambda r: (r["member_id"], r["seq"])) if order else out


def test_replayed_repeats_hold_one_member_at_a_time():
    """replay_repeated: the engine of a task forgets a member when the next one begins."""
    rows = _many(42, repeats=True, n=600)
    patterns = [waits(("a", None, False), ("b", 20, False))]
    cores, most = [], 0

    def make():
        cores.append(ShardCore(patterns=patterns, lateness=60))
        return cores[-1]

    got = []
    for _, kind, seq, _, member, _, _, start, end, *_ in _told(make, _fed(rows, True, 60), ["amount"]):
        most = max(most, sum(len(c.members) for c in cores))
        got.append((seq, member, start, end))
    _, want = simulate(rows, patterns=patterns, lateness=60)
    assert most == 1
    assert sorted(got) == sorted((s, m, a, b) for s, _, r, _ in want for _, m, a, b, _, _ in r.matches) != []


@pytest.mark.parametrize("semantics", ["as_coded", "intent"])
@pytest.mark.parametrize("states", [[("a", None, False), ("c", 10, True)], [("a", None, False), ("b", 20, False), ("c", 40, True)]])
def test_replayed_negatives_name_the_event_that_settled_them(spark, states, semantics):
    """replay_negative: deadlines pass by events of other members, in other tasks; disordered and repeated events too."""
    rows = _many(43, members=2, disorder=15, repeats=True, n=600)
    patterns = [waits(*states), waits(("b", None, False), ("b", 30, False))]
    _, want = simulate(rows, patterns=patterns, rules=RULES, lateness=300, semantics=semantics)
    got, tasks = _spread(spark, replay(frame(spark, rows), RULES, patterns, lateness=300, shards=1, semantics=semantics).withColumn("t", F.unix_micros("matched_at")))
    assert tasks > 1
    ids = {s: e for s, e, *_ in rows}
    assert sorted((r.seq, r.event_id, r.member_id, r.start_seq, r.end_seq, r.t) for r in got if r.kind == "pattern") == sorted((s, ids[s], m, a, b, t) for s, _, r, _ in want for _, m, a, b, _, t in r.matches)
    assert any(m != own for _, own, r, _ in want for _, m, *_ in r.matches)
    assert sorted((r.seq, r.rule_id) for r in got if r.kind == "rule") == sorted((s, i) for s, _, r, _ in want for i in r.rules) and {r.kind for r in got} == {"rule", "pattern", "late"}


def test_a_restarted_replay_holds_no_shard():
    """replay_over_restart: each member goes on from its own snapshot, with what one engine without a restart finds."""
    rows = _many(44, members=2, disorder=40, repeats=True, n=600)
    patterns = [waits(("a", None, False), ("b", 20, False), ("c", 30, True)), waits(("b", None, False), ("a", 40, False))]
    restored = []

    class Core(ShardCore):
        def restore(self, raw):
            super().restore(raw)
            restored.append(len(self.members))

    fed = _fed(rows, True, 300)
    got = list(_told(lambda: Core(RULES, patterns, 300), fed, ["amount"], restart_after=300))
    assert got == list(_told(lambda: ShardCore(RULES, patterns, 300), fed, ["amount"])) and {o[1] for o in got} == {"rule", "late", "pattern", "pending"}
    assert len(restored) == len({r["member_id"] for r in fed if r["seq"] > 300}) and max(restored) == 1


def test_replayed_disorder_is_told_as_it_is_read():
    """replay_rules_disordered: outcomes of a task leave before its later events are read."""
    rows = _many(45, disorder=60, n=600)
    read = 0

    def counted():
        nonlocal read
        for row in _fed(rows, True, 600):
            read += 1
            yield row

    told = _told(lambda: ShardCore(RULES, lateness=600), counted(), ["amount"])
    assert next(told)[1] in ("rule", "late") and read < 100
    assert len(list(told)) > 1 and read == 600


def test_late_events_leave_a_replay_in_batches():
    """replay_late_events: however many events are late, a batch of outcomes is bounded."""
    rows = [{"seq": i, "event_id": f"e{i}", "member_id": f"m{i // 5}", "behavior": "a", "t_": 5, "shard_": 0, "wm_before_": 9} for i in range(2 * CHUNK + 7)]
    batches = list(_packed(_told(ShardCore, rows, [])))
    assert [b.num_rows for b in batches] == [CHUNK, CHUNK, 7]
    assert [x for b in batches for x in b.column("seq").to_pylist()] == [r["seq"] for r in rows] and set(batches[0].column("kind").to_pylist()) == {"late"}


def test_muted_replay_of_a_shard_is_spread_over_tasks(spark):
    """replay_muted: late events of the second part only, of one shard in several tasks."""
    rows = _many(47, disorder=200, n=600)
    _, want = simulate(rows, lateness=60)
    got, tasks = _spread(spark, replay(frame(spark, rows), lateness=60, shards=1, replay_until=300))
    assert tasks > 1
    assert sorted(r.seq for r in got) == [s for s, _, r, _ in want if r.late and s > 300] != []
