"""The engine over streams, one state for each shard, and as a replay of any event log, member by member.

Watermarks and deadlines are the shard's, so shards are a stream's unit of parallelism, up to 128 of them. State
lives in the query's state store and checkpoint: a restarted query goes on where it stopped,
and redelivered events meet the ids kept with their minute.

A replay knows the whole log: the watermarks that a shard's events meet are computed first, so its members need
nothing else of each other, and are spread over tasks. A task keeps the state of one member, and batches of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Mapping
from itertools import groupby, islice
from operator import itemgetter
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ruleweave.functions.partitioning import shard_of
from ruleweave.functions.rendering import MISSING, render
from ruleweave.model import Pattern, Rule
from ruleweave.operators.events import LATENESS, with_time, with_watermark
from ruleweave.operators.patterns import first_passed
from ruleweave.streaming.core import Result, ShardCore

OUTPUT = "kind string, seq bigint, event_id string, member_id string, rule_id bigint, pattern_id string, start_seq bigint, end_seq bigint, variables map<string,string>, matched_at timestamp"
_NAMES = [c.strip().split(" ")[0] for c in "kind,seq,event_id,member_id,rule_id,pattern_id,start_seq,end_seq,variables,matched_at".split(",")]
#: Outcomes that a replay hands over at once.
CHUNK = 10_000
#: A negative match that an event of another member settles, if any does.
_PENDING = "pending"
# Of an outcome that has no time, at_ is the event's.
_TOLD = f"shard_ int, {OUTPUT}".replace("matched_at timestamp", "at_ bigint")
_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "map<string,string>": pa.map_(pa.string(), pa.string())}
_TOLD_ARROW = pa.schema([(name, _ARROW[kind]) for name, kind in (c.split(" ") for c in _TOLD.split(", "))])


def _values(row: Mapping[str, Any], fields: list[str]) -> dict[str, Any]:
    values: dict[str, Any] = {}
    for name in fields:
        number, text = row.get(f"num_{name}"), row.get(f"txt_{name}")
        if number is not None and number == number:
            values[name] = float(number)
        elif isinstance(text, str) and text != MISSING:
            values[name] = text
    return values


def _outcomes(r: Result, seq: int | None, event_id: str | None, member_id: str | None, muted_until: int | None, matched: str = "pattern") -> Iterator[tuple]:
    """An event's outcomes as tuples, times in microseconds; late ones up to muted_until were told before and aren't again."""
    if r.late and (muted_until is None or seq > muted_until):
        yield ("late", seq, event_id, member_id, None, None, None, None, None, None)
    for i in r.rules:
        yield ("rule", seq, event_id, member_id, i, None, None, None, None, None)
    for p, m, s, e, b, t in r.matches:
        yield (matched, seq, event_id, m, None, p, s, e, {k: render(v) for k, v in b.items()}, t)


def _fields(columns: Iterable[str]) -> list[str]:
    return sorted({c[4:] for c in columns if c.startswith(("num_", "txt_"))})


def _records(core: ShardCore, pdf: pd.DataFrame, muted_until: int | None = None) -> pd.DataFrame:
    """Outcomes of events in order of seq."""
    fields = _fields(pdf.columns)
    out: list[tuple] = []
    for row in pdf.sort_values("seq").to_dict("records"):
        r = core.process(row["seq"], row["event_id"], row["member_id"], row["behavior"], _values(row, fields), row["t_"])
        out += [(*o, None if t is None else pd.Timestamp(t, unit="us")) for *o, t in _outcomes(r, row["seq"], row["event_id"], row["member_id"], muted_until)]
    made = pd.DataFrame(out, columns=_NAMES)
    return made.astype({c: "Int64" for c in ("seq", "rule_id", "start_seq", "end_seq")}).assign(matched_at=lambda d: d["matched_at"].astype("datetime64[us]"))


def _rows(batch: pa.RecordBatch) -> Iterator[dict[str, Any]]:
    names = batch.schema.names
    return (dict(zip(names, row)) for row in zip(*(c.to_numpy(zero_copy_only=False).tolist() for c in batch.columns)))


def _told(make: Callable[[], ShardCore], rows: Iterable[dict[str, Any]], fields: list[str], muted_until: int | None = None, restart_after: int | None = None) -> Iterator[tuple]:
    """Shard and outcome of events in order of member and seq. Of the members' states only the present one is held."""
    core, spare = make(), make()
    for member_id, own in groupby(rows, itemgetter("member_id")):
        core.forget()
        before = True
        for row in own:
            seq, shard = row["seq"], row["shard_"]
            if before and restart_after is not None and seq > restart_after:
                before = False
                spare.forget()
                spare.restore(core.snapshot())
                core, spare = spare, core
            settled = core.advance(row["wm_before_"])
            for o in _outcomes(settled, None, None, member_id, None, _PENDING):
                yield (shard, *o)
            r = core.process(seq, row["event_id"], member_id, row["behavior"], _values(row, fields), row["t_"])
            for *o, at in _outcomes(r, seq, row["event_id"], member_id, muted_until):
                yield (shard, *o, row["t_"] if at is None else at)
        for o in _outcomes(core.advance(math.inf), None, None, member_id, None, _PENDING):
            yield (shard, *o)


def _packed(told: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    while chunk := list(islice(told, CHUNK)):
        columns = dict(zip(_TOLD_ARROW.names, zip(*chunk)))
        columns["variables"] = [None if v is None else list(v.items()) for v in columns["variables"]]
        yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in _TOLD_ARROW], schema=_TOLD_ARROW)


def _settled(told: DataFrame, marked: DataFrame, timed: DataFrame, shards: int) -> DataFrame:
    """Outcomes with pending matches as matches of the event that moved the shard's watermark past them; without those that none did."""
    pending = F.col("kind") == _PENDING
    met = first_passed(told, F.col("at_"), marked, timed, ["seq", "event_id"], shards).filter(~pending | F.col("passed_").isNotNull())
    new = {c: F.when(pending, F.col(f"passed_.{c}")).otherwise(F.col(c)) for c in ("seq", "event_id")}
    return met.withColumns(new | {"kind": F.when(pending, F.lit("pattern")).otherwise(F.col("kind"))}).drop("passed_")


def _given(events: DataFrame, shards: int) -> DataFrame:
    kept = ["seq", "event_id", "member_id", "behavior", *[c for c in events.columns if c.startswith(("num_", "txt_"))]]
    return with_time(events).select(*kept, "t_", shard_of(F.col("member_id"), shards).alias("shard_"))


def stream(events: DataFrame, rules: list[Rule] = (), patterns: list[Pattern] = (), lateness: float = LATENESS, shards: int = 8, semantics: str = "as_coded", replay_until: int | None = None) -> DataFrame:
    """A streaming event frame to a stream of outcomes: kind is rule, pattern or late. Each micro-batch is taken in order of seq. Up to replay_until events rebuild the state, and late ones aren't told again."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        core = ShardCore(rules, patterns, lateness, semantics)
        if state.exists:
            core.restore(bytes(state.get[0]))
        out = _records(core, pd.concat(list(batches)), replay_until)
        state.update((core.snapshot(),))
        yield out

    return _given(events, shards).groupBy("shard_").applyInPandasWithState(step, OUTPUT, "snapshot binary", "append", GroupStateTimeout.NoTimeout)


def replay(events: DataFrame, rules: list[Rule] = (), patterns: list[Pattern] = (), lateness: float = LATENESS, shards: int = 8, semantics: str = "as_coded", replay_until: int | None = None, restart_after: int | None = None) -> DataFrame:
    """The same outcomes from a stored log, whatever its disorder and repetition. restart_after: a snapshot is taken there, and a new engine goes on from it."""
    kept = ["seq", "event_id", "member_id", "behavior", *[c for c in events.columns if c.startswith(("num_", "txt_"))], "t_", "shard_", "wm_before_"]
    timed = with_time(events)
    given = with_watermark(timed, lateness, shards)
    # Of two events of one seq, that comes second whose watermark knows the other.
    ordered = given.select(*kept, "wm_").repartition("member_id").sortWithinPartitions("member_id", "seq", "wm_before_", "wm_", "event_id").select(*kept)

    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in _rows(b))
        return _packed(_told(lambda: ShardCore(rules, patterns, lateness, semantics), rows, _fields(kept), replay_until, restart_after))

    told = ordered.mapInArrow(step, _TOLD)
    if any(s.negative for p in patterns for s in p.states):
        told = _settled(told, given, timed, shards)
    return told.withColumn("matched_at", F.when(F.col("kind") == "pattern", F.timestamp_micros("at_"))).select(*_NAMES)


def write_outcomes(outcomes: DataFrame, path: str, checkpoint: str, **trigger):
    """Start a query that writes rule matches, pattern matches and late events to tables of their own. A repeated batch overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for kind in ("rule", "pattern", "late"):
            batch.filter(F.col("kind") == kind).write.mode("overwrite").parquet(f"{path}/{kind}/batch={number}")
        batch.unpersist()

    return outcomes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
