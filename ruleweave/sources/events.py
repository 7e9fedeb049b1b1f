"""Where events come from and go to: JSON messages, stored tables, a load generator, Kafka."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleweave.functions.partitioning import shard_of
from ruleweave.functions.rendering import render_number

ENVELOPE = "event_id string, member_id string, behavior string, fields variant, occurred_at timestamp"
BEHAVIORS = ("Login", "Trade", "CryptoWithdraw", "CryptoDeposit", "FiatWithdraw", "FiatDeposit")


def _json_fields(names: list[str]) -> dict[str, Column]:
    """num_ and txt_ of the flat keys of a variant column `fields`; only JSON numbers are numbers."""
    out: dict[str, Column] = {}
    for name in names:
        path = "$['" + name.replace("'", "\\'") + "']"
        value = F.try_variant_get("fields", path, "variant")
        kind = F.schema_of_variant(value)
        number = F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.try_variant_get("fields", path, "double"))
        out[f"num_{name}"] = number
        out[f"txt_{name}"] = F.when(value.isNotNull() & (kind != "VOID"), F.coalesce(render_number(number), F.try_variant_get("fields", path, "string")))
    return out


def decode_json(messages: DataFrame, fields: list[str], value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Event frame and dead letters of JSON messages (seq, value). Malformed messages, and those without event_id or member_id, are dead letters; those without a time have the zero time, which is late."""
    parsed = messages.select("seq", F.col(value).cast("string").alias("raw_"), F.from_json(F.col(value).cast("string"), ENVELOPE).alias("e_"))
    fine = F.coalesce((F.col("e_.event_id") != "") & (F.col("e_.member_id") != ""), F.lit(False))
    events = parsed.filter(fine).select("seq", "e_.*").withColumn("occurred_at", F.coalesce("occurred_at", F.lit("0001-01-01 00:00:00").cast("timestamp"))).withColumns(_json_fields(fields)).drop("fields")
    return events, parsed.filter(~fine).select("seq", F.col("raw_").alias("value"))


def encode_json(events: DataFrame) -> DataFrame:
    """seq, key (the member) and value of an event frame: JSON with numbers as numbers and microseconds kept."""
    names = sorted({c[4:] for c in events.columns if c.startswith(("num_", "txt_"))})
    either = lambda n: F.expr("coalesce(" + ", ".join(f"cast(`{c}` as variant)" for c in (f"num_{n}", f"txt_{n}") if c in events.columns) + ")")
    fields = F.struct(*[either(n).alias(n) for n in names]) if names else F.create_map().cast("map<string,string>")
    time = F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return events.select("seq", F.col("member_id").alias("key"), F.to_json(F.struct("event_id", "member_id", "behavior", fields.alias("fields"), time.alias("occurred_at"))).alias("value"))


def from_table(table: DataFrame, seq: str, event_id: str, member: str, behavior: str, time: str, numbers: dict[str, Column] | None = None, texts: dict[str, Column] | None = None) -> DataFrame:
    """An event frame from any table: only the columns that it names are read."""
    numbers, texts = numbers or {}, texts or {}
    read = table.select(
        F.col(seq).cast("bigint").alias("seq"), F.col(event_id).cast("string").alias("event_id"), F.col(member).cast("string").alias("member_id"), F.col(behavior).alias("behavior"), F.col(time).cast("timestamp").alias("occurred_at"),
        *[c.cast("double").alias(f"num_{n}") for n, c in numbers.items()], *[c.cast("string").alias(f"txt_{n}") for n, c in texts.items()],
    ).filter("event_id <> '' and member_id <> '' and occurred_at is not null")
    # Numbers are columns before they are texts, so that each is computed once.
    return read.withColumns({f"txt_{n}": render_number(F.col(f"num_{n}")) for n in numbers if n not in texts})


def read_log(spark: SparkSession, path: str, schema: str, streaming: bool = False, per_trigger: int = 1_000) -> DataFrame:
    """Files of JSON messages as a table or a stream, so many files a trigger at most."""
    reader = spark.readStream.option("maxFilesPerTrigger", per_trigger) if streaming else spark.read
    return reader.schema(schema).parquet(path)


def read_kafka(spark: SparkSession, servers: str, topic: str, per_trigger: int = 100_000) -> DataFrame:
    """Messages of a topic as seq, shard, value; offsets live in the query's checkpoint. Needs Spark's Kafka package."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", per_trigger).load()
    return identified(raw)


#: More partitions than a topic has.
PARTITIONS = 1 << 16


def identified(records: DataFrame) -> DataFrame:
    """seq, shard, value of Kafka records (partition, offset, value): seq is unique over all partitions and follows the offsets of each."""
    return records.select((F.col("offset") * PARTITIONS + F.col("partition")).alias("seq"), F.col("partition").alias("shard"), "value")


def producer_records(events: DataFrame, shards: int) -> DataFrame:
    """Events as records: seq, key, value, and as partition the member's shard."""
    return encode_json(events).withColumn("partition", shard_of(F.col("key"), shards))


def write_kafka(events: DataFrame, servers: str, topic: str, checkpoint: str, shards: int):
    """Events to a topic: the partition is the member's shard. Needs Spark's Kafka package."""
    out = producer_records(events, shards)
    return out.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()


def generate(spark: SparkSession, rows: int, members: int = 1_000, seed: int = 42, start: str = "2026-01-01 00:00:00", per_second: float = 100.0) -> DataFrame:
    """Synthetic load: amounts up to 10,000, members drawn evenly, so many events a second of event time."""
    i = F.col("id")
    pick = F.floor(F.rand(seed) * len(BEHAVIORS)).cast("int") + 1
    return spark.range(rows).select(
        i.alias("seq"), F.concat(F.lit("e"), i.cast("string")).alias("event_id"), F.concat(F.lit("m"), F.floor(F.rand(seed + 1) * members).cast("string")).alias("member_id"),
        F.element_at(F.array(*map(F.lit, BEHAVIORS)), pick).alias("behavior"), F.timestamp_micros((F.unix_micros(F.lit(start).cast("timestamp")) + i * int(1e6 / per_second))).alias("occurred_at"), (F.rand(seed + 2) * 10_000).alias("num_amount"),
    )


def generate_stream(spark: SparkSession, per_second: int = 100, members: int = 1_000) -> DataFrame:
    """The same as a rate-limited stream."""
    i = F.col("value")
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load().select(i.alias("seq"), F.concat(F.lit("e"), i.cast("string")).alias("event_id"), F.concat(F.lit("m"), F.pmod(F.xxhash64(i), F.lit(members)).cast("string")).alias("member_id"), F.element_at(F.array(*map(F.lit, BEHAVIORS)), F.pmod(F.hash(i), F.lit(len(BEHAVIORS))) + 1).alias("behavior"), F.col("timestamp").alias("occurred_at"), (F.pmod(F.xxhash64(i, F.lit(1)), F.lit(1_000_000)) / 100).alias("num_amount"))
