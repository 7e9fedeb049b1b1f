"""Trailing-window aggregates for every event, the event itself included.

A window of W seconds covers the minutes from W before the event's minute up to that minute, both
included, and of the event's own minute only what has arrived so far. AVG divides by all events of the
behavior, and aggregates over nothing are 0.

In arrival order two frames give this: a range over earlier minutes and a running frame within the
minute. Both are cut along members and stretches of time: each stretch also gets the rows that its
windows look back to, so that a member with very many events is spread over tasks. Disordered or
repeated input takes a join of events with earlier arrivals instead, over the same stretches.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleweave.model import AggregateKey, retention_seconds
from ruleweave.operators.events import with_fresh

#: A stretch is so many times as long as what its windows look back to.
STRETCH = 4


def columns_for(keys: Iterable[AggregateKey]) -> dict[str, str]:
    """Column names of aggregates by cache key."""
    return {k.cache_key: f"agg_{i}" for i, k in enumerate(keys)}


def _measures(key: AggregateKey, mine: Column, columns: list[str]) -> dict[str, Column]:
    """What has to be folded for an aggregate: names to (null where an event doesn't count) columns."""
    behavior, kind, field = key.parts
    own = mine & (F.col("behavior") == behavior)
    value = F.when(own, F.col(f"num_{field}")) if field and f"num_{field}" in columns else F.lit(None).cast("double")
    one = F.when(own, F.lit(1))
    return {"COUNT": {"n": one}, "SUM": {"s": value}, "AVG": {"s": value, "n": one}, "MAX": {"x": value}, "MIN": {"m": value}}.get(kind, {})


_FOLD = {"n": F.sum, "s": F.sum, "x": F.max, "m": F.min}


def _joined(name: str, a: Column, b: Column) -> Column:
    """Two partial folds as one; null where both are."""
    if name in "ns":
        return F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    return F.greatest(a, b) if name == "x" else F.least(a, b)


def _value(kind: str, folded: dict[str, Column]) -> Column:
    zero = F.lit(0.0)
    if kind == "AVG":
        return F.when(F.coalesce(folded["n"], F.lit(0)) > 0, F.coalesce(folded["s"], zero) / folded["n"]).otherwise(zero)
    return F.coalesce(next(iter(folded.values())).cast("double"), zero) if folded else zero


def _stretches(events: DataFrame, back: int) -> DataFrame:
    """Each event in its own stretch of time (own_), and as history in the next one if windows there reach it."""
    size = STRETCH * back
    at = F.floor(F.col("b_") / size)
    reaches = F.col("b_") + back >= (at + 1) * size
    places = F.when(reaches, F.array(at, at + 1)).otherwise(F.array(at))
    return events.withColumn("own_place_", at).withColumn("stretch_", F.explode(places)).withColumn("own_", F.col("own_place_") == F.col("stretch_")).drop("own_place_")


def in_order(events: DataFrame, keys: list[AggregateKey]) -> DataFrame:
    """Timed events with a column for each aggregate, for input whose arrival follows event time."""
    names = columns_for(keys)
    back = retention_seconds(keys)
    windowed = [k for k in keys if k.seconds]
    out = events
    if "fresh_" not in out.columns and len(windowed) < len(keys):
        out = with_fresh(out)
    if windowed:
        # One shuffle serves all frames, repeated events too: they share their minute, so their stretch.
        out = _stretches(out, back).repartition("member_id", "stretch_")
        if "fresh_" not in out.columns:
            out = out.withColumn("fresh_", F.row_number().over(Window.partitionBy("member_id", "stretch_", "behavior", "b_", "event_id").orderBy("seq")) == 1)
        member = Window.partitionBy("member_id", "stretch_")
        within = Window.partitionBy("member_id", "stretch_", "b_").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        for k in windowed:
            earlier = member.orderBy("b_").rangeBetween(-k.seconds, -60)
            folded = {n: _joined(n, _FOLD[n](c).over(earlier), _FOLD[n](c).over(within)) for n, c in _measures(k, F.col("fresh_"), events.columns).items()}
            out = out.withColumn(names[k.cache_key], _value(k.parts[1], folded))
        out = out.filter("own_").drop("own_", "stretch_")
    for k in keys:
        if not k.seconds:  # as it stood at the behavior's last event, over what was kept then
            member = Window.partitionBy("member_id")
            within = Window.partitionBy("member_id", "b_").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            earlier = member.orderBy("b_").rangeBetween(-back, -60)
            folded = {n: _joined(n, _FOLD[n](c).over(earlier), _FOLD[n](c).over(within)) for n, c in _measures(k, F.col("fresh_"), events.columns).items()}
            at_event = F.when((F.col("behavior") == k.parts[0]) & F.col("fresh_"), _value(k.parts[1], folded))
            out = out.withColumn("now_", at_event).withColumn(names[k.cache_key], F.coalesce(F.last("now_", ignorenulls=True).over(member.orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0.0))).drop("now_")
    return out


def _with_kill(given: DataFrame, back: int) -> DataFrame:
    """kill_: the first later arrival, of a member's behavior, by which an event's minute is forgotten, because it is more than back seconds younger.

    As long as no earlier arrival was that young, it is the first that makes the running maximum pass the event's minute plus back: found among
    maxima and limits in one order, without a join. Only events that arrived when the maximum was already past it are joined with later ones.
    """
    own = Window.partitionBy("m2_", "x2_")
    known = given.withColumn("limit_", F.col("b2_") + back).withColumn("top_", F.max("b2_").over(own.orderBy("s2_").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    marks = known.groupBy("m2_", "x2_", F.col("top_").alias("at_")).agg(F.min("s2_").alias("mark_"))
    asked = known.filter("top_ <= limit_").withColumn("at_", F.col("limit_"))
    least = F.last("mark_", ignorenulls=True).over(own.orderBy(F.desc("at_"), F.col("mark_").isNotNull()).rowsBetween(Window.unboundedPreceding, -1))
    usual = marks.unionByName(asked, allowMissingColumns=True).withColumn("kill_", least).filter("s2_ is not null").select(*given.columns, "kill_")
    stray = known.filter("top_ > limit_").select(*given.columns, "limit_")
    later = given.select(F.col("m2_").alias("m3_"), F.col("x2_").alias("x3_"), F.col("b2_").alias("b3_"), F.col("s2_").alias("s3_"))
    met = stray.join(later, (F.col("m2_") == F.col("m3_")) & (F.col("x2_") == F.col("x3_")) & (F.col("s3_") > F.col("s2_")) & (F.col("b3_") > F.col("limit_")), "left")
    return usual.unionByName(met.groupBy(*given.columns).agg(F.min("s3_").alias("kill_")))


def disordered(events: DataFrame, keys: list[AggregateKey], as_coded: bool = True) -> DataFrame:
    """The same for any arrival order. as_coded: minutes are forgotten as soon as a later event of the behavior arrives that is more than the longest window younger, whatever the lateness."""
    names = columns_for(keys)
    back = retention_seconds(keys)
    behaviors = sorted({k.parts[0] for k in keys})
    fields = sorted({k.parts[2] for k in keys if k.parts[2] and f"num_{k.parts[2]}" in events.columns})
    given = events.filter(F.col("fresh_") & F.col("behavior").isin(behaviors)).select(F.col("member_id").alias("m2_"), F.col("behavior").alias("x2_"), F.col("b_").alias("b2_"), F.col("seq").alias("s2_"), *[F.col(f"num_{f}").alias(f"v2_{f}") for f in fields])
    if as_coded:
        given = _with_kill(given, back)
    else:
        given = given.withColumn("kill_", F.lit(None).cast("bigint"))
    size = back  # short stretches: each event meets those of two at most
    bounded = all(k.seconds for k in keys)
    probe = events.select("seq", F.col("member_id").alias("m1_"), F.col("b_").alias("b1_"), (F.floor(F.col("b_") / size) if bounded else F.lit(0)).alias("k1_"))
    at = F.floor(F.col("b2_") / size)
    given = given.withColumn("k2_", F.explode(F.when(F.col("b2_") + back >= (at + 1) * size, F.array(at, at + 1)).otherwise(F.array(at))) if bounded else F.lit(0))
    met = probe.join(given, (F.col("m1_") == F.col("m2_")) & (F.col("k1_") == F.col("k2_")) & (F.col("s2_") <= F.col("seq")) & (F.col("kill_").isNull() | (F.col("seq") < F.col("kill_"))))
    aggs, values = [], {}
    for i, k in enumerate(keys):
        behavior, kind, field = k.parts
        near = (F.col("x2_") == behavior) & (F.col("b2_") <= F.col("b1_"))
        near = near & (F.col("b2_") >= F.col("b1_") - k.seconds) if k.seconds else near
        value = F.when(near, F.col(f"v2_{field}")) if field in fields else F.lit(None).cast("double")
        parts = {"COUNT": {"n": F.when(near, 1)}, "SUM": {"s": value}, "AVG": {"s": value, "n": F.when(near, 1)}, "MAX": {"x": value}, "MIN": {"m": value}}.get(kind, {})
        for n, c in parts.items():
            aggs.append(_FOLD[n](c).alias(f"f{i}{n}_"))
        values[names[k.cache_key]] = _value(kind, {n: F.col(f"f{i}{n}_") for n in parts})
    folded = met.groupBy("seq").agg(*aggs) if aggs else probe.select("seq")
    return events.join(folded, "seq", "left").withColumns(values).drop(*[c for c in folded.columns if c != "seq"])


def with_aggregates(events: DataFrame, keys: list[AggregateKey], order: str = "in_order", semantics: str = "as_coded") -> DataFrame:
    """order: `in_order` where arrival follows event time, else `disordered`."""
    if not keys:
        return events
    if order == "in_order":
        return in_order(events, keys)
    return disordered(events if "fresh_" in events.columns else with_fresh(events), keys, semantics == "as_coded")


def member_buckets(events: DataFrame, fields: list[str]) -> DataFrame:
    """A member's state: count, sums, maxima and minima of each behavior and minute, repeated events once."""
    fresh = with_fresh(events).filter("fresh_")
    folds = [f(F.col(f"num_{c}")).alias(f"{n}_{c}") for c in fields for n, f in (("sum", F.sum), ("max", F.max), ("min", F.min))]
    return fresh.groupBy("member_id", "behavior", F.col("b_").alias("bucket")).agg(F.count(F.lit(1)).alias("events"), *folds)
