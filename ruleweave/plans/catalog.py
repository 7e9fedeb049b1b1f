"""One query for each operator, over the event and order tables, and the SQL that says the same."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleweave.functions.partitioning import key_group, shard_of
from ruleweave.model import AggregateKey, DefinitionError, Node, Rule, TimeWindow, check_compiles, node_from_json, pattern_from_json, validate_node
from ruleweave.operators.aggregates import columns_for, member_buckets, with_aggregates
from ruleweave.operators.events import with_fresh, with_time, with_watermark
from ruleweave.operators.patterns import pattern_matches
from ruleweave.operators.rules import late_events, rule_matches
from ruleweave.sources.events import BEHAVIORS, decode_json, encode_json, from_table, generate, identified, producer_records
from ruleweave.sources.store import RuleStore
from ruleweave.streaming.engine import replay

Query = Callable[[SparkSession, str], DataFrame]
DAYS3, DAYS7, HOURS12 = TimeWindow(3, "days"), TimeWindow(7, "days"), TimeWindow(12, "hours")
LATE = 6 * 3600


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    return from_table(raw, "event_id", "event_id", "user_id", "event_type", "ts", {"value": F.col("value"), "k": F.get_json_object("props", "$.k")})


def shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events, arriving up to 997 minutes late."""
    e = events(spark, sf_dir)
    i = F.col("event_id").cast("bigint")
    delay = F.pmod(i * 7919, F.lit(997)) * 60_000_000
    return e.withColumn("seq", (F.unix_micros("occurred_at") + delay) * 1000 + F.pmod(i, F.lit(1000)))


def repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events, every seventh delivered again at the end."""
    e = events(spark, sf_dir)
    return e.unionByName(e.filter(F.col("seq") % 7 == 0).withColumn("seq", F.col("seq") + 1_000_000_000))


EV = """ev AS (SELECT event_id AS seq, CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS member_id, event_type AS behavior, epoch_us(ts) AS t, (epoch_us(ts) // 60000000) * 60 AS b, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, ts FROM events)"""
SHUFFLED = """ev AS (SELECT (epoch_us(ts) + (event_id * 7919 % 997) * 60000000) * 1000 + event_id % 1000 AS seq, CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS member_id, event_type AS behavior, epoch_us(ts) AS t, (epoch_us(ts) // 60000000) * 60 AS b, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, ts FROM events)"""
CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({m}, ''), lambda c: ascii(c)::BIGINT)), lambda a, x: list_reduce(list_prepend(xor(a, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::BIGINT) ELSE r >> 1 END)), 4294967295::BIGINT)"
GROUP = f"CAST({CRC.format(m='member_id')} % 128 AS INTEGER)"


def condition(field: str, operator: str, value, window: TimeWindow | None = None) -> Node:
    return Node("CONDITION", (), field, operator, value, window)


def _and(*children: Node) -> Node:
    return Node("AND", children)


def _or(*children: Node) -> Node:
    return Node("OR", children)


def _not(child: Node) -> Node:
    return Node("NOT", (child,))


# Aggregates.
KEYS = {
    "agg_count_w": AggregateKey("purchase:COUNT", DAYS3),
    "agg_sum_w": AggregateKey("purchase:SUM:value", DAYS3),
    "agg_avg_w": AggregateKey("click:AVG:value", DAYS7),
    "agg_max_w": AggregateKey("view:MAX:value", DAYS3),
    "agg_min_w": AggregateKey("view:MIN:k", HOURS12),
    "agg_missing_behavior": AggregateKey("transfer:SUM:value", DAYS3),
    "agg_missing_field": AggregateKey("view:AVG:weight", DAYS3),
    "agg_unknown": AggregateKey("purchase:MEDIAN:value", DAYS3),
}
_SQL_FOLD = {"MEDIAN": "0", "COUNT": "count(x.seq)", "SUM": "coalesce(sum(x.{f}), 0)", "AVG": "CASE WHEN count(x.seq) > 0 THEN coalesce(sum(x.{f}), 0) / count(x.seq) ELSE 0 END", "MAX": "coalesce(max(x.{f}), 0)", "MIN": "coalesce(min(x.{f}), 0)"}


def _aggregate(key: AggregateKey, source: Query = events, order: str = "in_order") -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = with_aggregates(with_time(source(spark, sf_dir)), [key], order)
        return found.select("seq", F.round(columns_for([key])[key.cache_key], 6).alias("agg"))

    return run


def _aggregate_sql(key: AggregateKey, ev: str = EV) -> str:
    behavior, kind, field = key.parts
    fold = _SQL_FOLD[kind].format(f=field if field in ("value", "k") else "none_")
    return f"WITH {ev}, x AS (SELECT *, CAST(NULL AS DOUBLE) AS none_ FROM ev WHERE behavior = '{behavior}') SELECT e.seq, round(CAST({fold} AS DOUBLE), 6) AS agg FROM ev e LEFT JOIN x ON x.member_id = e.member_id AND x.b BETWEEN e.b - {key.seconds} AND e.b AND x.seq <= e.seq GROUP BY e.seq"


NO_WINDOW = AggregateKey("purchase:COUNT")
NO_WINDOW_SQL = f"""WITH {EV}, p AS (SELECT * FROM ev WHERE behavior = 'purchase'),
    c AS (SELECT e.seq, e.member_id, count(x.seq) AS n FROM p e JOIN p x ON x.member_id = e.member_id AND x.b BETWEEN e.b - 86400 AND e.b AND x.seq <= e.seq GROUP BY ALL)
    SELECT e.seq, CAST(coalesce(c.n, 0) AS DOUBLE) AS agg FROM ev e ASOF LEFT JOIN c ON c.member_id = e.member_id AND e.seq >= c.seq"""

# Rules: a node, and the SQL condition over events joined with what they need (purchase sum and count of three days).
BIG = condition("purchase:SUM:value", ">", 400, DAYS3)
RULES: dict[str, tuple[Node, str]] = {
    "rule_threshold": (BIG, "s3 > 400"),
    "rule_and": (_and(condition("behavior", "=", "purchase"), condition("value", ">", 50)), "behavior = 'purchase' AND value > 50"),
    "rule_or": (_or(condition("behavior", "=", "error"), condition("k", "<", 10)), "behavior = 'error' OR k < 10"),
    "rule_not": (_not(condition("behavior", "IN", ("view", "click"))), "NOT behavior IN ('view', 'click')"),
    "rule_nested": (_and(_or(condition("behavior", "==", "view"), _and(condition("k", ">=", 50), _not(condition("k", ">", 60)))), condition("purchase:COUNT", ">=", 2, DAYS3)), "(behavior = 'view' OR (k >= 50 AND NOT k > 60)) AND n3 >= 2"),
    "rule_cmp_gt": (condition("value", ">", 25.5), "value > 25.5"),
    "rule_cmp_lt": (condition("value", "<", 5), "value < 5"),
    "rule_cmp_ge": (condition("k", ">=", 90), "k >= 90"),
    "rule_cmp_le": (condition("k", "<=", 9), "k <= 9"),
    "rule_cmp_eq": (condition("k", "=", 42), "k = 42"),
    "rule_cmp_ne": (condition("behavior", "!=", "signup"), "behavior <> 'signup'"),
    "rule_in": (condition("k", "IN", (1, 2, "3", True)), "k IN (1, 2, 3)"),
    "rule_not_in": (condition("behavior", "not_in", ("view", "click", "error")), "behavior NOT IN ('view', 'click', 'error')"),
    "rule_missing_field": (_and(condition("country", "NOT_IN", ("TW", "JP")), condition("country", "!=", "US"), _not(condition("country", "=", "TW"))), "true"),
    "rule_missing_ordered": (_or(condition("k", "<", 5), condition("country", ">", 3)), "k < 5"),
    "rule_error_short_circuit": (_not(_or(_and(condition("k", ">", 1000), condition("country", ">", 1)), condition("behavior", ">", 1))), "false"),
    "rule_error_hidden": (_not(_and(condition("k", ">", 50), condition("country", ">", 1))), "NOT k > 50"),
    "rule_unbound_variable": (condition("behavior", "!=", "$who"), "true"),
    "rule_member_override": (condition("member_id", "=", "7"), "member_id = '7'"),
}
#: Rules beside the set.
EMPTY = {"rule_empty_and": (_and(), "true"), "rule_empty_or": (_or(), "false"), "rule_empty_nested": (_or(_and(_or()), _and(condition("k", "<", 5), _and())), "k < 5")}
_CONTEXT = f"{EV}, p AS (SELECT * FROM ev WHERE behavior = 'purchase'), c AS (SELECT e.*, coalesce(x.s3, 0) AS s3, coalesce(x.n3, 0) AS n3 FROM ev e LEFT JOIN (SELECT e.seq, sum(x.value) AS s3, count(x.seq) AS n3 FROM ev e JOIN p x ON x.member_id = e.member_id AND x.b BETWEEN e.b - 259200 AND e.b AND x.seq <= e.seq GROUP BY e.seq) x USING (seq))"
_PLAIN = f"{EV}, c AS (SELECT * FROM ev)"


def _context(sql: str) -> str:
    return _CONTEXT if "s3" in sql or "n3" in sql else _PLAIN


def _rule(node: Node) -> Query:
    return lambda spark, sf_dir: rule_matches(events(spark, sf_dir), [Rule(1, "r", node)], "in_order").select("seq", "event_id", "member_id", "rule_id")


def rule_set_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules at once: one pass, every aggregate computed once."""
    rules = [Rule(i, name, node) for i, (name, (node, _)) in enumerate(RULES.items(), 1)]
    return rule_matches(events(spark, sf_dir), rules, "in_order").select("seq", "rule_id", "rule_name")


RULE_SET_SQL = f"WITH {_CONTEXT} " + " UNION ALL ".join(f"SELECT seq, CAST({i} AS BIGINT) AS rule_id, '{name}' AS rule_name FROM c WHERE {sql}" for i, (name, (_, sql)) in enumerate(RULES.items(), 1))

# Lateness and disorder.
SHARDS = 4
_MARKS = f"{SHUFFLED}, s AS (SELECT *, {GROUP} * {SHARDS} // 128 AS shard FROM ev), w AS (SELECT *, greatest(0, coalesce(max(t - {LATE * 1_000_000}) OVER (PARTITION BY shard ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS wm FROM s)"


def watermark_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_watermark(with_time(shuffled(spark, sf_dir)), LATE, SHARDS)
    return found.select("seq", F.col("shard_").cast("int").alias("shard"), F.col("wm_before_").alias("wm_before"), F.col("wm_").alias("wm_after"), F.col("late_").alias("late"))


def late_side_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return late_events(shuffled(spark, sf_dir), LATE, SHARDS).select("seq", "event_id", "member_id", "behavior")


DISORDERED_RULE = Rule(1, "busy", condition("purchase:COUNT", ">=", 3, DAYS3))
_SURVIVORS = "p AS (SELECT * FROM ev WHERE behavior = 'purchase'), g AS (SELECT a.seq, a.member_id, a.b, (SELECT min(z.seq) FROM p z WHERE z.member_id = a.member_id AND z.seq > a.seq AND z.b - 259200 > a.b) AS kill FROM p a)"
_DISORDERED_SQL = f"WITH {_MARKS}, {_SURVIVORS} SELECT w.seq, w.event_id, w.member_id, CAST(1 AS BIGINT) AS rule_id FROM w JOIN g ON g.member_id = w.member_id AND g.b BETWEEN w.b - 259200 AND w.b AND g.seq <= w.seq AND (g.kill IS NULL OR w.seq < g.kill) WHERE NOT w.t < w.wm GROUP BY ALL HAVING count(*) >= 3"


def on_time_rules_disordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_matches(shuffled(spark, sf_dir), [DISORDERED_RULE], "disordered", LATE, SHARDS).select("seq", "event_id", "member_id", "rule_id")


def replay_rules_disordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the state machine that streams run."""
    found = replay(shuffled(spark, sf_dir).drop("num_k", "txt_k"), [DISORDERED_RULE], lateness=LATE, shards=SHARDS)
    return found.filter("kind = 'rule'").select("seq", "event_id", "member_id", "rule_id")


def replay_late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = replay(shuffled(spark, sf_dir), lateness=LATE, shards=SHARDS)
    return found.filter("kind = 'late'").select("seq", "event_id", "member_id")


# Patterns.
def _state(name: str, behavior: str, wait: tuple[int, str] | None = None, negative: bool = False, more: list | None = None, binding: dict | None = None) -> dict:
    own = {"type": "CONDITION", "field": "behavior", "operator": "=", "value": behavior}
    return {"name": name, "condition": {"type": "AND", "children": [own, *more]} if more else own, "max_wait": wait and {"value": wait[0], "unit": wait[1]}, "is_negative": negative, "context_binding": binding or {}}


PATTERNS = {
    "cep_sequence": [_state("a", "signup"), _state("b", "click", (24, "hours")), _state("c", "purchase", (48, "hours"))],
    "cep_repeat_aab": [_state("a", "error"), _state("b", "error", (48, "hours")), _state("c", "signup", (48, "hours"))],
    "cep_expiry": [_state("a", "signup"), _state("b", "purchase", (90, "minutes"))],
    "cep_mixed_waits": [_state("a", "click", (24, "hours")), _state("b", "purchase", (24, "hours")), _state("c", "view")],
    "cep_single_state": [_state("a", "purchase", more=[{"type": "CONDITION", "field": "value", "operator": ">", "value": 90}])],
    "cep_bindings": [_state("a", "signup", binding={"first": "$event.k", "gone": "$event.nothing"}), _state("b", "purchase", (72, "hours"), binding={"last": "$event.k"})],
    "cep_no_aggregates": [_state("a", "signup", more=[{"type": "CONDITION", "field": "purchase:COUNT", "operator": "=", "value": "<nil>"}]), _state("b", "view", (24, "hours"))],
    "cep_negative_as_coded": [_state("a", "signup"), _state("b", "purchase", (24, "hours"), True)],
    "cep_negative_intent": [_state("a", "signup"), _state("b", "purchase", (24, "hours"), True)],
    "cep_negative_three": [_state("a", "signup"), _state("b", "click", (36, "hours")), _state("c", "purchase", (24, "hours"), True)],
    "cep_lhs_variable": [_state("a", "signup", binding={"amount": "$event.value"}), _state("b", "click", (72, "hours"), more=[{"type": "CONDITION", "field": "$amount", "operator": "<", "value": 20}])],
    "cep_rhs_variable": [_state("a", "signup", binding={"amount": "$event.value"}), _state("b", "purchase", (72, "hours"), more=[{"type": "CONDITION", "field": "value", "operator": ">", "value": "$amount"}])],
}


def _pattern(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pattern = pattern_from_json(name, name, PATTERNS[name])
        found = pattern_matches(events(spark, sf_dir), pattern, semantics="intent" if name.endswith("intent") else "as_coded", trusted=True)
        out = ["member_id", "start_seq", "end_seq", F.unix_micros("matched_at").alias("matched_at")]
        if name == "cep_bindings":
            out += [F.col("variables")["first"].alias("first"), F.col("variables")["last"].alias("last"), F.size("variables").alias("bound")]
        return found.select(*out)

    return run


def _chain_sql(steps: list[tuple[str, int]], longest: int, lateness: int = 5, extra: str = "", start: str = "true") -> str:
    """Steps as (condition, wait in seconds or 0)."""
    n = len(steps)
    pointers = ", ".join(f"min(CASE WHEN {c} THEN seq END) OVER later AS n{i}" for i, (c, _) in enumerate(steps) if i)
    joins = " ".join(f"JOIN q e{i} ON e{i}.seq = e{i - 1}.n{i}" for i in range(1, n))
    waits = "".join((f" AND e{i}.t <= e0.t + {w}000000" if w else "") + (f" AND e{i}.t <= e0.t + {longest + lateness}000000" if longest else "") for i, (_, w) in enumerate(steps) if i)
    first = steps[0][0]
    return f"WITH {EV}, q AS (SELECT *, {pointers + ', ' if pointers else ''} 1 AS one FROM ev WINDOW later AS (PARTITION BY member_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) SELECT e0.member_id, e0.seq AS start_seq, e{n - 1}.seq AS end_seq, e{n - 1}.t AS matched_at{extra} FROM (SELECT * FROM q WHERE {first}) e0 {joins} WHERE {start}{waits}"


def _negative_sql(steps: list[tuple[str, int]], forbidden: str, wait: int, longest: int, as_coded: bool) -> str:
    chain = _chain_sql(steps, longest).replace("e0.member_id,", "e0.member_id, e0.t AS start_t,", 1)
    with_part, select = chain.split(" SELECT e0.member_id", 1)
    lost = f" AND NOT (fe.seq > end_seq AND fe.member_id = c.member_id AND fe.t - 5000000 - start_t > {longest}000000)" if as_coded else ""
    return f"""{with_part}, c AS (SELECT e0.member_id{select}), d AS (SELECT *, start_t + {wait}000000 AS deadline FROM c),
    f AS (SELECT d.*, greatest(end_seq, (SELECT min(m.seq) FROM ev m WHERE m.t - 5000000 > d.deadline)) AS fe_seq, (SELECT min(m.seq) FROM ev m WHERE m.t - 5000000 > d.deadline) AS passed FROM d)
    SELECT c.member_id, start_seq, end_seq, deadline AS matched_at FROM f c JOIN ev fe ON fe.seq = c.fe_seq WHERE passed IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM ev x WHERE x.member_id = c.member_id AND x.seq > c.end_seq AND x.seq <= c.fe_seq AND ({forbidden})){lost}"""


_IS = "behavior = '{}'".format
PATTERN_SQL = {
    "cep_sequence": _chain_sql([(_IS("signup"), 0), (_IS("click"), 86400), (_IS("purchase"), 172800)], 172800),
    "cep_repeat_aab": _chain_sql([(_IS("error"), 0), (_IS("error"), 172800), (_IS("signup"), 172800)], 172800),
    "cep_expiry": _chain_sql([(_IS("signup"), 0), (_IS("purchase"), 5400)], 5400),
    "cep_mixed_waits": _chain_sql([(_IS("click"), 86400), (_IS("purchase"), 86400), (_IS("view"), 0)], 86400),
    "cep_single_state": _chain_sql([(_IS("purchase") + " AND value > 90", 0)], 0),
    "cep_bindings": _chain_sql([(_IS("signup"), 0), (_IS("purchase"), 259200)], 259200, extra=", CAST(CAST(e0.k AS BIGINT) AS VARCHAR) AS first, CAST(CAST(e1.k AS BIGINT) AS VARCHAR) AS last, 2 AS bound"),
    "cep_no_aggregates": _chain_sql([(_IS("signup"), 0), (_IS("view"), 86400)], 86400),
    "cep_negative_as_coded": _negative_sql([(_IS("signup"), 0)], _IS("purchase"), 86400, 86400, True),
    "cep_negative_intent": _negative_sql([(_IS("signup"), 0)], _IS("purchase"), 86400, 86400, False),
    "cep_negative_three": _negative_sql([(_IS("signup"), 0), (_IS("click"), 129600)], _IS("purchase"), 86400, 129600, True),
    "cep_lhs_variable": f"WITH {EV} SELECT a.member_id, a.seq AS start_seq, min(b.seq) AS end_seq, min_by(b.t, b.seq) AS matched_at FROM ev a JOIN ev b ON b.member_id = a.member_id AND b.seq > a.seq AND b.behavior = 'click' WHERE a.behavior = 'signup' AND a.value < 20 GROUP BY a.member_id, a.seq, a.t HAVING min_by(b.t, b.seq) <= a.t + 259200000000",
    "cep_rhs_variable": f"WITH {EV} SELECT a.member_id, a.seq AS start_seq, min(b.seq) AS end_seq, min_by(b.t, b.seq) AS matched_at FROM ev a JOIN ev b ON b.member_id = a.member_id AND b.seq > a.seq AND b.behavior = 'purchase' AND b.value > a.value WHERE a.behavior = 'signup' GROUP BY a.member_id, a.seq, a.t HAVING min_by(b.t, b.seq) <= a.t + 259200000000",
}


# What the engine does one event at a time, and around it.
MIDDLE = 1_705_276_800_000_000  # microseconds, in the middle of the events


def _replayed(spark: SparkSession, e: DataFrame, name: str) -> DataFrame:
    found = replay(e, patterns=[pattern_from_json(name, name, PATTERNS[name])], shards=1)
    return found.filter("kind = 'pattern'").select("member_id", "start_seq", "end_seq", F.unix_micros("matched_at").alias("matched_at"))


def replay_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deadlines from the queue of a shard."""
    return _replayed(spark, events(spark, sf_dir), "cep_negative_as_coded")


def replay_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events delivered twice neither start nor advance a pattern again."""
    e = events(spark, sf_dir).withColumn("seq", F.col("seq") * 2)
    return _replayed(spark, e.unionByName(e.filter(F.col("seq") % 14 == 0).withColumn("seq", F.col("seq") + 1)), "cep_sequence")


def replay_over_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of a replay of which the second half starts from a snapshot."""
    found = replay(shuffled(spark, sf_dir).drop("num_k", "txt_k"), [DISORDERED_RULE], lateness=LATE, shards=SHARDS, restart_after=MIDDLE * 1000)
    return found.filter("kind = 'rule'").select("seq", "event_id", "member_id", "rule_id")


def replay_muted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late events of a log of which the first half was told before."""
    found = replay(shuffled(spark, sf_dir), lateness=LATE, shards=SHARDS, replay_until=MIDDLE * 1000)
    return found.filter("kind = 'late'").select("seq", "event_id", "member_id")


def rule_interpreter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules by walking their trees."""
    rules = [Rule(i, name, node) for i, (name, (node, _)) in enumerate(RULES.items(), 1)]
    return replay(events(spark, sf_dir), rules).filter("kind = 'rule'").select("seq", "rule_id")


def watermark_before_1970(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watermarks start at 1970: events before it are late."""
    e = events(spark, sf_dir).withColumn("occurred_at", F.timestamp_micros(F.unix_micros("occurred_at") - F.lit(MIDDLE)))
    return with_watermark(with_time(e)).select("seq", F.col("b_").alias("bucket"), F.col("late_").alias("late"))


def rule_field_clash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields called behavior and member_id give way to the event's own."""
    e = events(spark, sf_dir).withColumns({"txt_behavior": F.lit("raw"), "txt_member_id": F.lit("raw")})
    node = _and(condition("behavior", "=", "purchase"), condition("member_id", "!=", "raw"))
    return rule_matches(e, [Rule(1, "r", node)], "in_order").select("seq", "event_id", "member_id", "rule_id")


def load_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = generate(spark, 1_000, members=10)
    return made.select("seq", "event_id", F.col("behavior").isin(*BEHAVIORS).alias("known"), F.col("num_amount").between(0, 10_000).alias("in_range"))


def kafka_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return producer_records(events(spark, sf_dir), 8).select("seq", "key", "partition")


def kafka_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of two partitions with equal offsets."""
    i = F.col("event_id")
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select((i % 2).alias("partition"), F.floor(i / 2).alias("offset"), F.col("props").alias("value"))
    return identified(raw).select("seq", "shard")


def rule_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The active rules of a store after changes, over the events."""
    store = RuleStore(f"{tempfile.mkdtemp()}/rules.json")
    node = {"type": "CONDITION", "field": "behavior", "operator": "=", "value": "view"}
    for name in ("one", "two", "three"):
        store.create(name, node)
    store.update(2, "zwei", {**node, "value": "click"})
    store.set_status(3, 2)
    return rule_matches(events(spark, sf_dir), store.compiled(), "in_order").select("seq", "rule_id", "rule_name")


_VALIDATION = [
    ("fine", {"type": "AND", "children": []}, True), ("node type", {"type": "XOR"}, False), ("operator", {"type": "CONDITION", "field": "a", "operator": "~"}, False), ("two under not", {"type": "NOT", "children": [{"type": "AND"}, {"type": "AND"}]}, False),
    ("aggregate", {"type": "CONDITION", "field": "a:MODE:b", "operator": ">"}, False), ("path", {"type": "CONDITION", "field": "a:SUM:b c", "operator": ">"}, False), ("aggregate in lower case", {"type": "CONDITION", "field": "a:sum:b", "operator": ">"}, True),
]
_STATES = [("fine", [(None, False), (20, True)], True), ("none", [], False), ("negative first", [(20, True)], False), ("negative inside", [(None, False), (20, True), (20, False)], False), ("negative without wait", [(None, False), (None, True)], False)]


def _accepted(check: Callable, given: object) -> bool:
    try:
        check(given)
    except DefinitionError:
        return False
    return True


def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions that are taken, and those that are refused."""
    rules = [(f"rule: {n}", _accepted(lambda raw: compile_checked(node_from_json(raw)), raw)) for n, raw, _ in _VALIDATION]
    patterns = [(f"pattern: {n}", _accepted(lambda raw: pattern_from_json("p", "p", raw), [_state("s", "a", w and (w, "minutes"), neg) for w, neg in states])) for n, states, _ in _STATES]
    return spark.createDataFrame(rules + patterns, "definition string, accepted boolean")


def compile_checked(node: Node) -> None:
    validate_node(node)
    check_compiles(node)


# Partitioning, buckets, duplicates, codecs.
def key_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("member_id").distinct().select("member_id", key_group(F.col("member_id")).alias("key_group"))


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("member_id").distinct().select("member_id", *[shard_of(F.col("member_id"), n).alias(f"shard_{n}") for n in (1, 3, 8)])


def bucket_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_time(events(spark, sf_dir)).select("seq", F.col("b_").alias("bucket"))


def dedup_first_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_fresh(with_time(repeated(spark, sf_dir))).filter("fresh_").select("seq", "event_id")


def member_state_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = member_buckets(with_time(repeated(spark, sf_dir)), ["value", "k"])
    return found.select("member_id", "behavior", "bucket", "events", *[F.round(f"{n}_{c}", 4).alias(f"{n}_{c}") for c in ("value", "k") for n in ("sum", "max", "min")])


def rule_repeated_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events delivered again count once, but are evaluated again."""
    rule = Rule(1, "busy", condition("purchase:COUNT", ">=", 2, TimeWindow(30, "days")))
    return rule_matches(repeated(spark, sf_dir), [rule], "disordered", 60 * 86400).select("seq", "event_id", "rule_id")


def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON messages and back."""
    got, _ = decode_json(encode_json(events(spark, sf_dir)), ["value", "k"])
    return got.select("seq", "event_id", "member_id", "behavior", F.unix_micros("occurred_at").alias("t"), F.round("num_value", 4).alias("value"))


def json_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages without member, and malformed ones."""
    e = events(spark, sf_dir)
    value = F.when(F.col("seq") % 5 == 0, F.lit("{not json")).when(F.col("seq") % 5 == 1, F.concat(F.lit('{"event_id":"'), F.col("event_id"), F.lit('","member_id":"","behavior":"view","fields":{},"occurred_at":"2024-01-01T00:00:00Z"}')))
    value = value.otherwise(F.concat(F.lit('{"event_id":"'), F.col("event_id"), F.lit('","member_id":"m","behavior":"view","fields":{"a":1},"occurred_at":"2024-01-01T00:00:00Z"}')))
    _, dead = decode_json(e.select("seq", value.alias("value")), ["a"])
    return dead.select("seq")


def rendered_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals as text, rounded to thousands so that both forms of numbers occur."""
    from ruleweave.functions.rendering import render_number

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select("o_orderkey", render_number(F.floor(F.col("o_totalprice") / 1000).cast("double") * 100_000).alias("rendered"))


def orders_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as events: totals of urgent orders over 30 days."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    e = from_table(orders, "o_orderkey", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate", {"amount": F.col("o_totalprice")})
    rule = Rule(1, "urgent", condition("1-URGENT:SUM:amount", ">", 300_000, TimeWindow(365, "days")))
    return rule_matches(e, [rule], "disordered", 3650 * 86400, semantics="intent").select("seq", "member_id", "rule_id")


ORDERS_SQL = """WITH ev AS (SELECT o_orderkey AS seq, CAST(o_custkey AS VARCHAR) AS member_id, o_orderpriority AS behavior, (epoch_us(CAST(o_orderdate AS TIMESTAMP)) // 60000000) * 60 AS b, o_totalprice AS amount FROM orders)
    SELECT e.seq, e.member_id, CAST(1 AS BIGINT) AS rule_id FROM ev e JOIN ev x ON x.member_id = e.member_id AND x.behavior = '1-URGENT' AND x.b BETWEEN e.b - 31536000 AND e.b AND x.seq <= e.seq GROUP BY e.seq, e.member_id HAVING sum(x.amount) > 300000"""

_REPEATED = EV.replace("ev AS (", "o AS (") + ", ev AS (SELECT * FROM o UNION ALL SELECT * REPLACE (seq + 1000000000 AS seq) FROM o WHERE seq % 7 = 0)"

QUERIES: dict[str, Query] = {
    "key_group": key_groups, "shard_of": shards, "bucket_align": bucket_align, "dedup_first_arrival": dedup_first_arrival, "member_state_buckets": member_state_buckets,
    **{n: _aggregate(k) for n, k in KEYS.items()}, "agg_nowindow": _aggregate(NO_WINDOW),
    **{n: _rule(node) for n, (node, _) in (RULES | EMPTY).items()}, "rule_set_all": rule_set_all, "rule_repeated_delivery": rule_repeated_delivery, "orders_rule": orders_rule,
    "watermark_trace": watermark_trace, "late_events": late_side_output, "on_time_rules_disordered": on_time_rules_disordered, "replay_rules_disordered": replay_rules_disordered, "replay_late_events": replay_late_events,
    **{n: _pattern(n) for n in PATTERNS}, "json_round_trip": json_round_trip, "json_dead_letters": json_dead_letters, "rendered_numbers": rendered_numbers,
    "replay_negative": replay_negative, "replay_repeated": replay_repeated, "replay_over_restart": replay_over_restart, "replay_muted": replay_muted, "rule_interpreter": rule_interpreter, "watermark_before_1970": watermark_before_1970,
    "rule_field_clash": rule_field_clash, "load_generator": load_generator, "kafka_records": kafka_records, "kafka_identity": kafka_identity, "rule_store": rule_store, "validation": validation,
}

SQL: dict[str, str] = {
    "key_group": f"WITH {EV} SELECT member_id, {GROUP} AS key_group FROM (SELECT DISTINCT member_id FROM ev)",
    "shard_of": f"WITH {EV} SELECT member_id, " + ", ".join(f"CAST({GROUP} * {n} // 128 AS INTEGER) AS shard_{n}" for n in (1, 3, 8)) + " FROM (SELECT DISTINCT member_id FROM ev)",
    "bucket_align": f"WITH {EV} SELECT seq, b AS bucket FROM ev",
    "dedup_first_arrival": f"WITH {EV} SELECT seq, event_id FROM ev",
    "member_state_buckets": f"WITH {EV} SELECT member_id, behavior, b AS bucket, count(*) AS events, " + ", ".join(f"round({n}({c}), 4) AS {n}_{c}" for c in ("value", "k") for n in ("sum", "max", "min")) + " FROM ev GROUP BY ALL",
    **{n: _aggregate_sql(k) for n, k in KEYS.items()},
    "agg_nowindow": NO_WINDOW_SQL,
    **{n: f"WITH {_context(sql)} SELECT seq, event_id, member_id, CAST(1 AS BIGINT) AS rule_id FROM c WHERE {sql}" for n, (_, sql) in (RULES | EMPTY).items()},
    "rule_set_all": RULE_SET_SQL,
    "rule_repeated_delivery": f"WITH {_REPEATED} SELECT e.seq, e.event_id, CAST(1 AS BIGINT) AS rule_id FROM ev e JOIN o x ON x.behavior = 'purchase' AND x.member_id = e.member_id AND x.b <= e.b AND x.b >= e.b - 2592000 AND x.seq <= e.seq GROUP BY e.seq, e.event_id HAVING count(*) >= 2",
    "orders_rule": ORDERS_SQL,
    "watermark_trace": f"WITH {_MARKS} SELECT seq, CAST(shard AS INTEGER) AS shard, wm AS wm_before, greatest(wm, t - {LATE * 1_000_000}) AS wm_after, t < wm AS late FROM w",
    "late_events": f"WITH {_MARKS} SELECT seq, event_id, member_id, behavior FROM w WHERE t < wm",
    "on_time_rules_disordered": _DISORDERED_SQL,
    "replay_rules_disordered": _DISORDERED_SQL,
    "replay_late_events": f"WITH {_MARKS} SELECT seq, event_id, member_id FROM w WHERE t < wm",
    **PATTERN_SQL,
    "replay_negative": PATTERN_SQL["cep_negative_as_coded"],
    "replay_repeated": f"SELECT member_id, 2 * start_seq AS start_seq, 2 * end_seq AS end_seq, matched_at FROM ({PATTERN_SQL['cep_sequence']})",
    "replay_over_restart": _DISORDERED_SQL,
    "replay_muted": f"WITH {_MARKS} SELECT seq, event_id, member_id FROM w WHERE t < wm AND seq > {MIDDLE * 1000}",
    "rule_interpreter": f"SELECT seq, rule_id FROM ({RULE_SET_SQL})",
    "watermark_before_1970": f"WITH {EV} SELECT seq, CAST(floor((t - {MIDDLE}) / 60000000.0) AS BIGINT) * 60 AS bucket, t < {MIDDLE} AS late FROM ev",
    "rule_field_clash": f"WITH {EV} SELECT seq, event_id, member_id, CAST(1 AS BIGINT) AS rule_id FROM ev WHERE behavior = 'purchase'",
    "load_generator": "SELECT range AS seq, 'e' || range AS event_id, true AS known, true AS in_range FROM range(1000)",
    "kafka_records": f"WITH {EV}, p AS (SELECT member_id, CAST({GROUP} * 8 // 128 AS INTEGER) AS partition FROM (SELECT DISTINCT member_id FROM ev)) SELECT seq, member_id AS key, partition FROM ev JOIN p USING (member_id)",
    "kafka_identity": "SELECT event_id // 2 * 65536 + event_id % 2 AS seq, event_id % 2 AS shard FROM events",
    "rule_store": f"WITH {EV} SELECT seq, CAST(1 AS BIGINT) AS rule_id, 'one' AS rule_name FROM ev WHERE behavior = 'view' UNION ALL SELECT seq, CAST(2 AS BIGINT), 'zwei' FROM ev WHERE behavior = 'click'",
    "validation": "SELECT * FROM (VALUES " + ", ".join([f"('rule: {n}', {str(ok).lower()})" for n, _, ok in _VALIDATION] + [f"('pattern: {n}', {str(ok).lower()})" for n, _, ok in _STATES]) + ") AS t(definition, accepted)",
    "json_round_trip": f"WITH {EV} SELECT seq, event_id, member_id, behavior, t, round(value, 4) AS value FROM ev",
    "json_dead_letters": f"WITH {EV} SELECT seq FROM ev WHERE seq % 5 < 2",
    "rendered_numbers": "WITH x AS (SELECT o_orderkey, CAST(floor(o_totalprice / 1000) AS BIGINT) * 100000 AS v FROM orders) SELECT o_orderkey, CASE WHEN v < 1000000 THEN CAST(v AS VARCHAR) ELSE regexp_replace(regexp_replace(CAST(v AS VARCHAR)[1] || '.' || CAST(v AS VARCHAR)[2:], '0+$', ''), '[.]$', '') || 'e+' || lpad(CAST(length(CAST(v AS VARCHAR)) - 1 AS VARCHAR), 2, '0') END AS rendered FROM x",
}
