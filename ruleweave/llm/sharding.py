"""Operator 9: shards by best-fit-decreasing bin packing of indivisible groups.

Groups of equal texts are packed whole, largest first, each into the shard with the tightest
remaining capacity that still takes it, found in an ordered list of capacities (as many as shards, where their number is given). Groups of one size
are interchangeable, so the packing itself runs over classes of sizes (all sizes below 4096 exactly,
larger ones by their 12 leading bits: at most 2048 classes for each doubling, whatever the input),
and each class is dealt to shards in runs of ranks. Ranks and slots come from counts of salted parts.

Null text has size 1. Repeated rows and ids are rows of their own. An empty table gives no rows. Groups of one size go by their digests. Very long texts are rows like others; other columns of the input are never read, whatever their names.
A group larger than an equal share has its shard to itself; the rest shares the other shards evenly.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleweave.llm.common import materialize, salted, salts_for

_BITS = 12


def size_class(size: Column) -> Column:
    """The size with all but its 12 leading bits cleared."""
    shift = F.greatest(F.lit(0), F.floor(F.log2(size.cast("double"))).cast("int") - (_BITS - 1))
    unit = F.pow(F.lit(2.0), shift).cast("bigint")
    return (F.floor(size / unit) * unit).cast("bigint")


def plan(classes: list[tuple[int, int, int]], capacity: float, shards: int | None = None) -> tuple[list[tuple[int, int, int, int]], int]:
    """Best-fit decreasing over (class, groups, bytes): runs (class, first rank, end rank, shard), and the shards used.

    With shards, the number stops there: what no longer fits goes to the emptiest shard.
    """
    free: list[tuple[float, int]] = []  # (remaining capacity, shard), kept in order
    runs, used = [], 0
    for size, count, total in sorted(classes, reverse=True):
        each, at = total / count, 0
        while at < count:
            k = bisect_left(free, (each, -1))
            if k < len(free):
                room, shard = free.pop(k)
                n = min(count - at, int(room // each))
            elif shards is None or used < shards:
                room, shard, n = capacity, used, min(count - at, max(1, int(capacity // each)))
                used += 1
            else:
                room, shard = free.pop()
                n = 1
            insort(free, (room - n * each, shard))
            runs.append((size, at, at + n, shard))
            at += n
    return runs, used


def equal_capacity(classes: list[tuple[int, int, int]], shards: int) -> tuple[float, int]:
    """The least capacity, nearly, with which the packing needs no more shards, for the sizes beside those over an equal share."""
    low = max(1.0, sum(t for _, _, t in classes) / shards)
    high = low + max([t / n for _, n, t in classes], default=1)
    while plan(classes, high)[1] > shards:
        high *= 1.01
    for _ in range(14):
        mid = (low + high) / 2
        low, high = (low, mid) if plan(classes, mid)[1] <= shards else (mid, high)
    return high, shards


def plan_equal(classes: list[tuple[int, int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """Runs for a fixed number of shards of near equal sizes."""
    rest, own, runs = sorted(classes, reverse=True), 0, []
    taken: dict[int, int] = {}
    while rest and own < shards - 1 and rest[0][2] / rest[0][1] > sum(t for _, _, t in rest) / (shards - own):
        size, n, total = rest[0]
        at = taken.get(size, 0)
        runs.append((size, at, at + 1, own))
        taken[size], own = at + 1, own + 1
        rest[0] = (size, n - 1, total - total // n)
        if n == 1:
            rest.pop(0)
    if rest:
        capacity, _ = equal_capacity(rest, shards - own)
        runs += [(s, a + taken.get(s, 0), b + taken.get(s, 0), k + own) for s, a, b, k in plan(rest, capacity, shards - own)[0]]
    return runs


def _ranked(rows: DataFrame, within: str, order: list[str], salts: int) -> DataFrame:
    """rank_ from 0, gapless within each value of a column: places in salted parts after the counts of the parts before."""
    rows = rows.withColumn("part_", F.pmod(F.xxhash64(*order), F.lit(salts)))
    counts = rows.groupBy(within, "part_").agg(F.count(F.lit(1)).alias("c_"))
    before = counts.select(within, "part_", (F.sum("c_").over(Window.partitionBy(within).orderBy("part_")) - F.col("c_")).alias("before_"))
    placed = rows.withColumn("in_", F.row_number().over(Window.partitionBy(within, "part_").orderBy(*order)) - 1)
    return placed.join(before, [within, "part_"]).withColumn("rank_", F.col("before_") + F.col("in_")).drop("part_", "before_", "in_")


def shard(docs: DataFrame, shards: int | None = 16, capacity: int | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard. Give a number of shards, or a capacity to need as few as possible."""
    spark = docs.sparkSession
    salts = salts_for(spark)
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = materialize(docs.select(F.col(key).alias("id_"), (F.octet_length(raw) + 1).cast("bigint").alias("size_"), F.crc32(raw).alias("crc_"), F.sha2(raw, 256).alias("group_")), "shard-rows")
    groups = materialize(rows.groupBy("group_").agg(F.sum("size_").alias("bytes_"), F.count(F.lit(1)).alias("n_")).withColumn("class_", size_class(F.col("bytes_"))), "shard-groups")
    # With a capacity, every group of a class counts as its largest, so that no shard exceeds it.
    classes = [tuple(r) for r in groups.groupBy("class_").agg(F.count(F.lit(1)), F.max("bytes_") * F.count(F.lit(1)) if capacity else F.sum("bytes_")).collect()]
    runs = plan(classes, capacity)[0] if capacity else plan_equal(classes, shards)
    table = spark.createDataFrame(runs or [(0, 0, 0, 0)], "class_ bigint, lo_ bigint, hi_ bigint, shard int")
    dealt = _ranked(groups, "class_", ["group_"], salts)
    found = dealt.join(F.broadcast(table), (dealt.class_ == table.class_) & (F.col("rank_") >= F.col("lo_")) & (F.col("rank_") < F.col("hi_"))).select("group_", "shard", "n_")  # the runs are bounded by the classes
    # A group may hold a third of all rows: the rows of such are salted.
    spread, found = salted(rows, found, "group_", "n_", rows.count(), ["id_", "size_"])
    placed = spread.join(found, ["group_", "salt_"]).select("id_", "size_", "crc_", "shard")
    out = _ranked(materialize(placed, "shard-placed"), "shard", ["id_", "crc_", "size_"], salts * 4)
    return out.select(F.col("id_").alias(key), F.col("size_").alias("size"), F.col("crc_").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("rank_").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
