"""Multi-step patterns over event frames in arrival order, as window functions.

Going backwards through a member's events, each event that meets a state remembers the nearest later event
that meets the next one, so a whole chain is read off its first event: one shuffle by member and no
join. Where conditions use variables, each state takes one join of the chains so far with the events that could meet it, by member and stretch of time.
A terminal negative state is settled by the first event of the shard whose watermark passes the deadline,
found among watermarks and deadlines in one order, cut into stretches.

Repeated events and disorder need the replay of ruleweave.streaming: pattern_matches refuses them, unless told not to look.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleweave.functions.rendering import MISSING
from ruleweave.model import DefinitionError, Node, Pattern, State, validate_pattern
from ruleweave.operators.events import LATENESS, SECOND, STRETCHES, arrives_in_order, scope_fields, stretch_between, with_fresh, with_time, with_watermark
from ruleweave.plans.compiler import Operand, Scope, compile_node, fires, text_field


def _reads_variables(node: Node) -> bool:
    return any(n.field.startswith("$") or isinstance(n.value, str) and n.value.startswith("$") for n in node.walk())


def uses_variables(pattern: Pattern) -> bool:
    return any(_reads_variables(s.condition) for s in pattern.states)


def _bound(state: State, events: DataFrame) -> Column:
    """What a state binds, as a map of rendered values; absent fields aren't bound."""
    raw = scope_fields(events, raw_only=True)
    pairs = [F.struct(F.lit(name).alias("key"), raw[source.removeprefix("$event.")].text.alias("value")) for name, source in state.binding if source.startswith("$event.") and source.removeprefix("$event.") in raw]
    if not pairs:
        return F.create_map().cast("map<string,string>")
    return F.map_from_entries(F.filter(F.array(*pairs), lambda e: e["value"] != MISSING))


def pattern_matches(events: DataFrame, pattern: Pattern, lateness: float = LATENESS, shards: int = 1, semantics: str = "as_coded", trusted: bool = False) -> DataFrame:
    """pattern_id, pattern_name, member_id, start_seq, end_seq, variables, matched_at of an event frame in order.

    as_coded loses a negative match if the event that passes the deadline is the member's own and the pattern's longest wait is over by then; `intent` keeps it.
    """
    validate_pattern(pattern)
    timed = with_time(events)
    if not trusted and not (arrives_in_order(timed) and not with_fresh(timed).filter("not fresh_").take(1)):
        raise DefinitionError("disordered or repeated events need a replay")
    positive = [s for s in pattern.states if not s.negative]
    negative = next((s for s in pattern.states if s.negative), None)
    if uses_variables(pattern):
        found = _chains_with_variables(timed, events, pattern, positive, negative, lateness)
        return _settled(found, timed, pattern, negative, lateness, shards, semantics)
    scope = Scope(scope_fields(events))
    back = Window.partitionBy("member_id").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    if negative:
        timed = timed.withColumn("forbidden_", F.last(F.when(fires(compile_node(negative.condition, scope)), F.col("seq")), ignorenulls=True).over(back))
    else:
        timed = timed.withColumn("forbidden_", F.lit(None).cast("bigint"))
    out, later = timed, None
    for i in range(len(positive) - 1, -1, -1):
        here = F.array(F.struct("seq", F.col("t_").alias("t"), F.col("forbidden_").alias("forbidden"), _bound(positive[i], events).alias("bound")))
        chain = here if later is None else F.concat(here, F.col("next_.chain"))
        meets = F.when(fires(compile_node(positive[i].condition, scope)), F.struct(chain.alias("chain")))
        if i == 0:
            out = out.withColumn("chain_", meets["chain"]).filter("chain_ is not null")
        else:
            out = out.withColumn("meets_", meets).withColumn("next_", F.last("meets_", ignorenulls=True).over(back))
            later = out
    start, last = F.col("chain_")[0], F.col("chain_")[len(positive) - 1]
    for i, s in enumerate(positive[1:], 1):
        if s.max_wait:
            out = out.filter(F.col("chain_")[i]["t"] <= start["t"] + s.max_wait.seconds * SECOND)
        if pattern.longest_wait:  # what the sweep leaves alive
            out = out.filter(F.col("chain_")[i]["t"] <= start["t"] + F.lit(int((pattern.longest_wait + lateness) * SECOND)))
    variables = F.aggregate(F.transform("chain_", lambda c: c["bound"]), F.create_map().cast("map<string,string>"), lambda a, b: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b))
    found = out.select("member_id", start["seq"].alias("start_seq"), last["seq"].alias("end_seq"), start["t"].alias("start_t_"), last["t"].alias("end_t_"), last["forbidden"].alias("forbidden_"), variables.alias("variables"))
    return _settled(found, timed, pattern, negative, lateness, shards, semantics)


def _settled(found: DataFrame, timed: DataFrame, pattern: Pattern, negative: State | None, lateness: float, shards: int, semantics: str) -> DataFrame:
    """Chains as matches, after their negative state if there is one."""
    matched = F.col("end_t_")
    if negative:
        found = _undisturbed(found, timed, pattern, negative, lateness, shards, semantics)
        matched = F.col("deadline_")
    return found.select(F.lit(pattern.id).alias("pattern_id"), F.lit(pattern.name).alias("pattern_name"), "member_id", "start_seq", "end_seq", "variables", F.timestamp_micros(matched).alias("matched_at"))


def _values(state: State, events: DataFrame) -> dict[str, Column]:
    """What a state binds, as structs of number and text; the text of a missing field where it isn't bound."""
    raw = scope_fields(events, raw_only=True)
    own = {n: raw.get(s.removeprefix("$event.")) for n, s in state.binding if s.startswith("$event.")}
    return {n: F.struct(v.number.alias("number"), v.text.alias("text")) for n, v in own.items() if v is not None}


def _chains_with_variables(timed: DataFrame, events: DataFrame, pattern: Pattern, positive: list[State], negative: State | None, lateness: float) -> DataFrame:
    """Chains state by state: of the later events of the member that meet a state, with the chain's variables, the first one. Events are joined by stretches as long as the state's wait, where it has one."""
    fields = scope_fields(events)
    first = positive[0]
    known = {n: v.alias(f"v_{n}") for n, v in _values(first, events).items()}
    chains = timed.filter(fires(compile_node(first.condition, Scope(fields)))).select("member_id", F.col("seq").alias("start_seq"), F.col("seq").alias("end_seq"), F.col("t_").alias("start_t_"), F.col("t_").alias("end_t_"), _bound(first, events).alias("bound_"), *known.values())

    def met(chains: DataFrame, state: State, until: int | None, columns: list[Column], how: str) -> DataFrame:
        """Chains with next_, the first event that meets the state, in at most until microseconds after the start."""
        names = [c for c in chains.columns if c.startswith("v_")]
        plain = Node("AND", tuple(c for c in (state.condition.children if state.condition.type == "AND" else (state.condition,)) if not _reads_variables(c)))
        able = timed.filter(fires(compile_node(plain, Scope(fields))))
        size = until or None
        place = (lambda t: F.floor(t / F.lit(size))) if size else (lambda t: F.lit(0))
        able = able.withColumn("place_", place(F.col("t_"))).withColumnsRenamed({"member_id": "m_", "seq": "s_"})
        spread = chains.withColumn("place_", F.explode(F.array(place(F.col("start_t_")), place(F.col("start_t_")) + 1) if size else F.array(F.lit(0))))
        variables = {n[2:]: Operand(F.coalesce(F.col(n)["number"], F.lit(None).cast("double")), F.coalesce(F.col(n)["text"], F.lit(MISSING))) for n in names}
        own = {n: Operand(x.number, x.text) for n, x in fields.items()} | {"member_id": text_field(F.col("m_"))}
        on = (F.col("member_id") == F.col("m_")) & (spread["place_"] == able["place_"]) & (F.col("s_") > F.col("end_seq"))
        if until:
            on = on & (F.col("t_") <= F.col("start_t_") + F.lit(until))
        pairs = spread.join(able, on).filter(fires(compile_node(state.condition, Scope(own, None, variables))))
        found = pairs.groupBy(F.col("start_seq").alias("of_")).agg(F.min(F.struct(F.col("s_").alias("seq"), F.col("t_").alias("t"), *columns)).alias("next_"))
        return chains.join(found, F.col("start_seq") == F.col("of_"), how).drop("of_")

    for state in positive[1:]:
        waits = [s * SECOND for s in ([state.max_wait.seconds] if state.max_wait else []) + ([pattern.longest_wait + lateness] if pattern.longest_wait else [])]
        new = _values(state, events)
        columns = [_bound(state, events).alias("bound"), *(v.alias(n) for n, v in new.items())]
        # Maps can't be compared: seq alone decides.
        columns = [F.struct(*[F.to_json(columns[0]).alias("bound")], *columns[1:]).alias("new")]
        out = met(chains, state, int(min(waits)) if waits else None, columns, "inner")
        later = F.from_json(F.col("next_.new.bound"), "map<string,string>")
        merged = F.map_concat(F.map_filter("bound_", lambda k, _: ~F.map_contains_key(later, k)), later)
        kept = {n: F.when(F.col(f"next_.new.{n}")["text"] != MISSING, F.col(f"next_.new.{n}")).otherwise(F.col(f"v_{n}") if f"v_{n}" in chains.columns else F.lit(None)) for n in new}
        rest = [F.col(c) for c in chains.columns if c.startswith("v_") and c[2:] not in new]
        chains = out.select("member_id", "start_seq", F.col("next_.seq").alias("end_seq"), "start_t_", F.col("next_.t").alias("end_t_"), merged.alias("bound_"), *(v.alias(f"v_{n}") for n, v in kept.items()), *rest)
    if negative:
        chains = met(chains, negative, None, [], "left").withColumn("forbidden_", F.col("next_.seq"))
    else:
        chains = chains.withColumn("forbidden_", F.lit(None).cast("bigint"))
    return chains.select("member_id", "start_seq", "end_seq", "start_t_", "end_t_", "forbidden_", F.col("bound_").alias("variables"))


def first_passed(asked: DataFrame, deadline: Column, marked: DataFrame, timed: DataFrame, names: list[str], shards: int) -> DataFrame:
    """asked with passed_: of the events in marked, names and watermark (wm) of the shard's first one that moves the watermark past the deadline. timed has the same events."""
    marks = marked.filter("wm_ > wm_before_").select("shard_", F.col("wm_").alias("v_"), F.lit(1).alias("kind_"), F.struct(*names, F.col("wm_").alias("wm")).alias("mark_"))
    asked = asked.select("shard_", deadline.alias("v_"), F.lit(0).alias("kind_"), F.struct(*asked.columns).alias("entry_"))
    # From the latest backwards, a deadline sees the least watermark above it: of its stretch of time, or else of the next one that has any.
    low, high = timed.agg(F.min("t_"), F.max("t_")).first()
    stretch = stretch_between(F.col("v_"), low, high)
    marks, asked = marks.withColumn("stretch_", stretch), asked.withColumn("stretch_", stretch)
    lowest = marks.groupBy("shard_", "stretch_").agg(F.min_by("mark_", "v_").alias("low_"))
    grid = timed.sparkSession.range(shards * (STRETCHES + 1)).select((F.col("id") % shards).cast("int").alias("shard_"), F.floor(F.col("id") / shards).alias("stretch_"))
    from_there = Window.partitionBy("shard_").orderBy(F.desc("stretch_")).rowsBetween(Window.unboundedPreceding, -1)
    next_ = grid.join(lowest, ["shard_", "stretch_"], "left").select("shard_", "stretch_", F.last("low_", ignorenulls=True).over(from_there).alias("next_mark_"))
    both = marks.unionByName(asked, allowMissingColumns=True)
    order = Window.partitionBy("shard_", "stretch_").orderBy(F.desc("v_"), "kind_").rowsBetween(Window.unboundedPreceding, -1)
    met = both.withColumn("passed_", F.last("mark_", ignorenulls=True).over(order)).filter("entry_ is not null").join(F.broadcast(next_), ["shard_", "stretch_"])  # at most 128 shards of STRETCHES rows
    return met.select("entry_.*", F.coalesce("passed_", "next_mark_").alias("passed_"))


def _undisturbed(entries: DataFrame, timed: DataFrame, pattern: Pattern, negative: State, lateness: float, shards: int, semantics: str) -> DataFrame:
    """The entries into a negative state whose deadline passes before any forbidden event."""
    marked = with_watermark(timed.select("seq", "member_id", "t_"), lateness, shards)
    own = marked.select(F.col("seq").alias("end_seq"), "shard_", F.col("wm_").alias("own_wm_"))
    entries = entries.withColumn("deadline_", F.col("start_t_") + F.lit(negative.max_wait.seconds * SECOND)).join(own, "end_seq")
    met = first_passed(entries, F.col("deadline_"), marked, timed, ["seq", "member_id"], shards)
    at_entry = F.col("own_wm_") > F.col("deadline_")  # the deadline had passed when the state was entered
    met = met.withColumn("fe_seq_", F.when(at_entry, F.col("end_seq")).otherwise(F.col("passed_.seq"))).withColumn("fe_member_", F.when(at_entry, F.col("member_id")).otherwise(F.col("passed_.member_id"))).withColumn("fe_wm_", F.when(at_entry, F.col("own_wm_")).otherwise(F.col("passed_.wm")))
    kept = met.filter("fe_seq_ is not null and (forbidden_ is null or forbidden_ > fe_seq_)")
    if semantics == "as_coded":
        # The sweep runs before the deadline queue, on the member's own events after the entry.
        lost = ~at_entry & (F.col("fe_member_") == F.col("member_id")) & (F.col("fe_wm_") - F.col("start_t_") > F.lit(pattern.longest_wait * SECOND))
        kept = kept.filter(~lost)
    return kept
