"""What the operators share: reading tables, tables written in the shared folder, batches of texts."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts that Python holds at once come in slices of about so many characters (one longer text is one slice).
SLICE_CHARS = 2_000_000
#: Rows that go to Python at once while a table is written: texts and sets are large.
BATCH_ROWS, _BATCH = 2_000, "spark.sql.execution.arrow.maxRecordsPerBatch"
_libc = ctypes.CDLL(None)
_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Only a local master may do without it."""
    conf = spark.sparkContext.getConf()
    if found := conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not (conf.get("spark.master", "local") or "").startswith("local") or "cluster" in conf.get("spark.master", ""):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + tempfile.gettempdir() + "/ruleweave-shared"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: it cuts the lineage, is computed once and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    rows = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(BATCH_ROWS, int(rows)) if int(rows) > 0 else BATCH_ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, rows)
    _made.append((spark, path))
    made = spark.read.schema(df.schema).parquet(path)
    made.table_path_ = path
    return made


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables whose last reader is itself a table that has been written."""
    for df in tables:
        for entry in [e for e in _made if e[1] == df.table_path_]:
            _delete(*entry)


def _delete(session: SparkSession, path: str) -> None:
    p = session._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
    _made.remove((session, path))


def drop_tables(spark: SparkSession | None = None) -> None:
    """Delete the tables that materialize wrote; results that read them can't be used afterwards."""
    for entry in list(_made):
        session, path = entry
        if spark is None or session is spark:
            try:
                _delete(session, path)
            except Exception:  # noqa: BLE001 - at exit the JVM may be gone already
                _made.remove(entry)


atexit.register(drop_tables)


def crc_of_id(col: Column) -> Column:
    """crc32 of an id written as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def release() -> None:
    """Give free memory of this process back to the system, where that can be asked for."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str, chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about so many bytes of the text column. What earlier tasks of the worker left free goes back to the system first."""
    release()
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        begin = total = 0
        for i, n in enumerate(lengths):
            if total + n > chars and i > begin:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        if begin < len(lengths):
            yield batch.slice(begin)


#: A key held by more than one row in so many is hot: there are never more hot keys than this.
HOT_SHARE, HOT_LEAST = 1_000, 5_000


def salts_for(spark: SparkSession) -> int:
    """Parts into which hot keys are split: as many as shuffles have partitions."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def salted(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows and their groups (one row a key, with its count of rows), both with salt_, to be joined on key and salt_.

    Rows of hot keys are spread by a hash of the columns in by, and the groups of hot keys, at most
    HOT_SHARE of them whatever the input, are repeated for each salt. All others have salt 0.
    """
    s = salts_for(rows.sparkSession)
    least = max(HOT_LEAST, total // HOT_SHARE)
    hot = groups.filter(F.col(count) > least).select(F.col(key).alias("hot_"))
    spread = rows.join(F.broadcast(hot), F.col(key) == F.col("hot_"), "left")
    spread = spread.withColumn("salt_", F.when(F.col("hot_").isNull(), 0).otherwise(F.pmod(F.xxhash64(*by), F.lit(s)).cast("int"))).drop("hot_")
    return spread, groups.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.when(F.col(count) > least, s - 1).otherwise(0))))


#: Bits of the filters that let rows pass by a join, for each wanted key and at most (32 MB). A full filter costs time, never rows.
BITS_PER_KEY, MOST_BITS = 16, 1 << 28


def filter_bits(wanted: int) -> int:
    """Bits of a filter for so many keys: a power of two."""
    return min(MOST_BITS, max(1 << 15, 1 << (BITS_PER_KEY * max(1, wanted) - 1).bit_length()))


def _parts(wanted: DataFrame, hashed: Column, bits: int) -> DataFrame:
    """The filter of the wanted rows in parts of 4 KB: part_, map_."""
    placed = wanted.select((F.pmod(hashed, F.lit(bits)) + 1).alias("place_"))
    return placed.groupBy(F.bitmap_bucket_number("place_").alias("part_")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place_")).alias("map_"))


def may_match(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> DataFrame:
    """rows with maybe_: false only where no wanted row has an equal key. The filter, sized by a count of the wanted rows, is broadcast; no row is shuffled."""
    bits = filter_bits(wanted.count())
    maps = _parts(wanted, F.xxhash64(wanted_key), bits)
    placed = rows.withColumn("at_", F.pmod(F.xxhash64(key), F.lit(bits)) + 1).withColumn("in_", F.bitmap_bucket_number("at_"))
    met = placed.join(F.broadcast(maps), F.col("in_") == F.col("part_"), "left")
    bit = F.bitmap_bit_position("at_")
    byte = F.conv(F.hex(F.substring("map_", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    set_ = byte.bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) > 0
    return met.withColumn("maybe_", F.coalesce(set_, F.lit(False))).drop("at_", "in_", "part_", "map_")


class Passing:
    """The same filter for use in Python: a key passes if the bit of its 64-bit hash is set."""

    def __init__(self, wanted: DataFrame, hashed: Column):
        self.bits = filter_bits(wanted.count())
        made = np.zeros(self.bits // 8, dtype=np.uint8)
        for r in _parts(wanted, hashed, self.bits).toLocalIterator():
            made[(r.part_ - 1) * 4096 : r.part_ * 4096] = np.frombuffer(r.map_, dtype=np.uint8)
        self.shared = wanted.sparkSession.sparkContext.broadcast(made)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = np.mod(hashes, np.int64(self.bits))
        return ((self.shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
