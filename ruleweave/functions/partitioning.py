"""Key groups, shards and minute buckets as columns."""

from __future__ import annotations

import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_GROUPS = 128


def key_group(member: Column) -> Column:
    return (F.crc32(member.cast("binary")) % KEY_GROUPS).cast("int")


def shard_of_group(group: Column, shards: int) -> Column:
    return F.floor(group * F.lit(shards) / KEY_GROUPS).cast("int")


def shard_of(member: Column, shards: int) -> Column:
    return shard_of_group(key_group(member), shards)


def shard_of_member(member: str, shards: int) -> int:
    """The same on the driver."""
    return zlib.crc32(member.encode()) % KEY_GROUPS * shards // KEY_GROUPS


def bucket(micros: Column) -> Column:
    """Seconds of the minute's start, floored before 1970 too."""
    return (F.floor(micros / F.lit(60_000_000)) * 60).cast("bigint")
