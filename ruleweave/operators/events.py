"""Events as frames, lateness and duplicates.

An event frame has seq (arrival order), event_id, member_id, behavior, occurred_at, and, for each field
that the rules read, num_<field> (null where it is no number) and txt_<field> (null where it is missing). with_time adds
t_ (microseconds) and b_ (the minute's first second).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleweave.functions.partitioning import bucket, shard_of
from ruleweave.functions.rendering import MISSING
from ruleweave.plans.compiler import Operand, text_field

SECOND = 1_000_000
#: Allowed lateness, in seconds.
LATENESS = 5


def with_time(events: DataFrame) -> DataFrame:
    t = F.unix_micros(F.col("occurred_at").cast("timestamp"))
    return events.withColumn("t_", t).withColumn("b_", bucket(F.col("t_")))


def scope_fields(events: DataFrame, raw_only: bool = False) -> dict[str, Operand]:
    """The fields of an event frame, with behavior and member_id before fields of the same names unless raw_only."""
    names = {c[4:] for c in events.columns if c.startswith(("num_", "txt_"))}
    number = lambda n: F.col(f"num_{n}") if f"num_{n}" in events.columns else F.lit(None).cast("double")
    text = lambda n: F.coalesce(F.col(f"txt_{n}"), F.lit(MISSING)) if f"txt_{n}" in events.columns else F.lit(MISSING)
    found = {n: Operand(number(n), text(n)) for n in names}
    return found if raw_only else found | {n: text_field(F.col(n)) for n in ("behavior", "member_id")}


#: Stretches of arrival order, or of time, into which a shard's rows are cut for running values.
STRETCHES = 1024


def stretch_of(rows: DataFrame, column: str) -> Column:
    """The number of a row's stretch: equal parts of a column's range, in its order. Takes one pass over the column."""
    return stretch_between(F.col(column), *rows.agg(F.min(column), F.max(column)).first())


def stretch_between(value: Column, low: int | None, high: int | None) -> Column:
    """The same for a known range, 0 to STRETCHES; values outside belong to its ends."""
    width = 1 if low is None else (high - low) // STRETCHES + 1
    return F.greatest(F.lit(0), F.least(F.lit(STRETCHES), F.floor((value - F.lit(low or 0)) / F.lit(width)))).cast("bigint")


def with_watermark(events: DataFrame, lateness: float = LATENESS, shards: int = 1) -> DataFrame:
    """shard_, wm_before_, late_ and wm_ (after the event), in microseconds, of timed events.

    The watermark follows each shard's arrival order and starts at 1970. Late events never raise it: they are older than the maximum.
    Shards are cut into stretches of arrival order: the greatest time of those before a stretch, one row each, is carried into it, so no task sorts a whole shard.
    """
    seen = F.col("t_") - F.lit(int(lateness * SECOND))
    cut = events.withColumn("shard_", shard_of(F.col("member_id"), shards)).withColumn("stretch_", stretch_of(events, "seq"))
    tops = cut.groupBy("shard_", "stretch_").agg(F.max(seen).alias("top_"))
    before = tops.select("shard_", "stretch_", F.max("top_").over(Window.partitionBy("shard_").orderBy("stretch_").rowsBetween(Window.unboundedPreceding, -1)).alias("carried_"))
    out = cut.join(F.broadcast(before), ["shard_", "stretch_"])  # at most 128 shards of STRETCHES rows
    within = F.max(seen).over(Window.partitionBy("shard_", "stretch_").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    out = out.withColumn("wm_before_", F.greatest(F.lit(0), F.coalesce(within, F.lit(0)), F.coalesce("carried_", F.lit(0)))).drop("stretch_", "carried_")
    return out.withColumn("late_", F.col("t_") < F.col("wm_before_")).withColumn("wm_", F.greatest(F.col("wm_before_"), seen))


def arrives_in_order(timed: DataFrame) -> bool:
    """Whether no event is older than one that arrived before it."""
    return not with_watermark(timed.filter("t_ >= 0"), 0).filter("late_").take(1) and not timed.filter("t_ < 0").take(1)


def with_fresh(events: DataFrame) -> DataFrame:
    """fresh_: the first arrival of an event id for its member, behavior and minute."""
    by = Window.partitionBy("member_id", "behavior", "b_", "event_id").orderBy("seq")
    return events.withColumn("fresh_", F.row_number().over(by) == 1)
