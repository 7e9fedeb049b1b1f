"""Operator 6: exact de-duplication with static binary-fuse filters.

An immutable snapshot keeps, for each bucket of digests, a static binary-fuse filter of its distinct
digests. Digests of a new batch are screened by the filter of their bucket: negatives can't be in the
snapshot and only meet their own batch; positives join the exact buckets. Wherever two rows share a
digest, the texts themselves are compared: groups are those of equal bytes, not of equal digests.

Only digests and ids are shuffled, and of repeated digests the texts, which a filter tells from the others (of 16 bits a
digest up to 2^28 bits; beyond, it fills and all texts are shuffled once). Counts are combined before shuffles, and repeated
digests are salted, so a text that holds a third of all rows is split. Buckets are sized by the snapshot or the
batch, whichever has more digests, so neither an empty snapshot nor a small one gathers a batch in one task.

Null text counts as empty. Repeated rows (equal doc_id and text): all but one are dropped. Null ids
sort last: a group of null ids only keeps one row, whose keep_id is null. An empty table gives none.
Very long texts are rows like others; other columns of the input are never read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleweave.llm.common import crc_of_id, discard, materialize, may_match, salted, salts_for

#: Digests for which one filter is made, about; at 9 bits each.
DIGESTS_PER_FILTER = 200_000
#: Repeated rows of one id and text that a task writes at once.
REPEATS = 10_000
_U64 = np.uint64


def _mix(h: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = h + _U64(seed)
        h = (h ^ (h >> _U64(33))) * _U64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> _U64(33))) * _U64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> _U64(33))


class BinaryFuse:
    """A static filter of 64-bit keys with 8-bit fingerprints and three neighbouring segments; built by peeling."""

    def __init__(self, keys: np.ndarray):
        keys = np.unique(np.asarray(keys, dtype=_U64))
        n = len(keys)
        self.segment = 1 << max(2, min(18, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))))
        factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 3)))
        self.segments = max(1, -(-int(n * factor) // self.segment))
        self.table = np.zeros((self.segments + 2) * self.segment, dtype=np.uint8)
        for seed in range(1, 200):
            self.seed = seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1
            if self._fill(keys):
                return
        raise ValueError("no filter was found")

    def _places(self, h: np.ndarray) -> np.ndarray:
        """Three slots in consecutive segments, as rows of a matrix."""
        first = ((h >> _U64(32)) * _U64(self.segments)) >> _U64(32)
        m = _U64(self.segment - 1)
        return np.stack([(first + _U64(k)) * _U64(self.segment) + ((h >> _U64(18 * k if k < 2 else 7)) & m) for k in range(3)]).astype(np.int64)

    def _fill(self, keys: np.ndarray) -> bool:
        h = _mix(keys, self.seed)
        at = self._places(h)
        size = len(self.table)
        count = np.zeros(size, np.int64)
        xor = np.zeros(size, np.int64)
        ids = np.arange(len(keys))
        for row in at:
            np.add.at(count, row, 1)
            np.bitwise_xor.at(xor, row, ids)
        order: list[tuple[np.ndarray, np.ndarray]] = []
        left = len(keys)
        single = np.flatnonzero(count == 1)
        while len(single):
            owner, where = np.unique(xor[single], return_index=True)  # a key may be alone in several slots
            slot = single[where]
            order.append((owner, slot))
            left -= len(owner)
            touched = at[:, owner]
            for row in touched:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(xor, row, owner)
            near = np.unique(touched)
            single = near[count[near] == 1]
        if left:
            return False
        prints = self._prints(h)
        for owner, slot in reversed(order):  # keys of one layer don't own each other's slots
            self.table[slot] = 0
            own = at[:, owner]
            self.table[slot] = prints[owner] ^ self.table[own[0]] ^ self.table[own[1]] ^ self.table[own[2]]
        return True

    @staticmethod
    def _prints(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> _U64(32))) & _U64(0xFF)).astype(np.uint8)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        h = _mix(np.asarray(keys, dtype=_U64), self.seed)
        a, b, c = self._places(h)
        return self._prints(h) == self.table[a] ^ self.table[b] ^ self.table[c]

    def to_bytes(self) -> bytes:
        return np.array([self.seed, self.segment, self.segments], dtype=_U64).tobytes() + self.table.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> BinaryFuse:
        out = cls.__new__(cls)
        out.seed, out.segment, out.segments = map(int, np.frombuffer(raw[:24], dtype=_U64))
        out.table = np.frombuffer(raw[24:], dtype=np.uint8)
        return out


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def _keys(rows: DataFrame) -> DataFrame:
    """Distinct digests of a part, with the smallest id and the number of rows."""
    return rows.groupBy("sha_").agg(F.min("id_").alias("low_"), F.count(F.lit(1)).alias("n_"))


def build_filters(snapshot: DataFrame, buckets: int) -> DataFrame:
    """One filter for each bucket of a snapshot's distinct digests (sha_): bucket_, filter_."""

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bucket_": [key[0]], "filter_": [BinaryFuse(pdf["h_"].to_numpy().view(_U64)).to_bytes()]})

    return snapshot.select(_bucket(buckets), F.xxhash64("sha_").alias("h_")).groupBy("bucket_").applyInPandas(build, "bucket_ bigint, filter_ binary")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.conv(F.substring("sha_", 1, 12), 16, 10).cast("bigint"), F.lit(buckets)).alias("bucket_")


def screen(batch: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """The digests of a batch with maybe_: whether the snapshot's filter passes them."""

    def look(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame({"sha_": [], "maybe_": []}).astype({"maybe_": bool})
        hit = BinaryFuse.from_bytes(right["filter_"].iloc[0]).contains(left["h_"].to_numpy().view(_U64)) if len(right) else np.zeros(len(left), bool)
        return pd.DataFrame({"sha_": left["sha_"], "maybe_": hit})

    given = batch.select("sha_", _bucket(buckets), F.xxhash64("sha_").alias("h_"))
    return given.groupBy("bucket_").cogroup(filters.groupBy("bucket_")).applyInPandas(look, "sha_ string, maybe_ boolean")


def exact_groups(docs: DataFrame, in_snapshot: Column, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row; in_snapshot marks the rows of the immutable snapshot."""
    spark = docs.sparkSession
    texts = docs.select(F.col(key).alias("id_"), normalised(F.col(text)).alias("norm_"), in_snapshot.alias("old_"))
    rows = materialize(texts.select("id_", "old_", F.sha2("norm_", 256).alias("sha_")), "exact-rows")
    old, new = (materialize(_keys(rows.filter(which)), "exact-keys") for which in (F.col("old_"), ~F.col("old_")))
    buckets = max(1, -(-max(old.count(), new.count()) // DIGESTS_PER_FILTER))
    screened = screen(new, build_filters(old, buckets), buckets)
    batch = materialize(new.join(screened, "sha_"), "exact-screened")
    met = old.join(batch.filter("maybe_").select("sha_", F.col("low_").alias("low2_"), F.col("n_").alias("n2_")), "sha_", "left")
    both = met.select("sha_", F.least("low_", "low2_").alias("low_"), (F.col("n_") + F.coalesce("n2_", F.lit(0))).alias("n_"))
    alone = batch.join(old.select("sha_"), "sha_", "left_anti").select("sha_", "low_", "n_")
    repeated = materialize(both.union(alone).filter("n_ > 1"), "exact-repeated")

    discard(old, new, batch)

    # Byte checks: the texts behind each repeated digest; hot ones are salted, and equal texts combined within each salt first.
    total = rows.count()
    some = may_match(texts.select("id_", "norm_", F.sha2("norm_", 256).alias("sha_")), F.col("sha_"), repeated, F.col("sha_")).filter("maybe_").drop("maybe_")
    spread, wanted = salted(some, repeated.select("sha_", "n_"), "sha_", "n_", total, ["id_"])
    met_texts = spread.join(wanted.select("sha_", "salt_"), ["sha_", "salt_"], "left_semi")
    part = met_texts.groupBy("sha_", "salt_", "norm_").agg(F.min("id_").alias("low_"), F.count(F.lit(1)).alias("n_"))
    exact = materialize(part.groupBy("sha_", "norm_").agg(F.min("low_").alias("keep_"), F.sum("n_").alias("size_")).select("sha_", F.xxhash64("norm_", F.lit(7)).alias("text_"), "keep_", "size_"), "exact-groups")
    clash = exact.groupBy("sha_").agg(F.count(F.lit(1)).alias("c_")).filter("c_ > 1").select("sha_")
    whole = exact.join(clash, "sha_", "left_anti").select("sha_", "keep_", "size_")

    # Rows: repeated (id, digest) pairs are counted, so that of equal rows one can stay.
    pairs = rows.groupBy("sha_", "id_").agg(F.count(F.lit(1)).alias("m_"))
    pairs, group = salted(pairs, whole, "sha_", "size_", total, ["id_"])
    told = pairs.join(group, ["sha_", "salt_"], "left")
    told = told.select("id_", "sha_", "m_", F.when(F.col("size_").isNull(), F.col("id_")).otherwise(F.col("keep_")).alias("keep_"), F.coalesce("size_", "m_").alias("size_"))
    if clash.take(1):  # digests shared by different texts, which SHA-256 never showed yet: told apart by text
        hard = texts.select("id_", "norm_", F.sha2("norm_", 256).alias("sha_")).join(clash, "sha_", "left_semi").groupBy("sha_", "id_", F.xxhash64("norm_", F.lit(7)).alias("text_")).agg(F.count(F.lit(1)).alias("m_"))
        told = told.join(clash, "sha_", "left_anti").unionByName(hard.join(exact, ["sha_", "text_"]).select("id_", "sha_", "m_", "keep_", "size_"))
    # Rows of one id and text are written again from their count, many of them by several tasks.
    few = told.filter(F.col("m_") <= REPEATS).withColumn("nth_", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("m_"))))
    parts = told.filter(F.col("m_") > REPEATS).withColumn("part_", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("m_") - 1) / REPEATS)))).repartition(salts_for(spark), "part_")
    many = parts.withColumn("nth_", F.explode(F.sequence(F.col("part_") * REPEATS + 1, F.least(F.col("m_"), (F.col("part_") + 1) * REPEATS)))).drop("part_")
    each = few.unionByName(many)
    return each.select(F.col("id_").alias(key), F.col("keep_").alias("keep_id"), F.col("size_").alias("group_size"), (F.col("id_").eqNullSafe(F.col("keep_")) & (F.col("nth_") == 1)).alias("kept"), F.col("sha_").alias("text_sha256"))


def half_snapshot(key: str = "doc_id") -> Column:
    """Rows taken as the snapshot where a table has no batches: those with an even checksum of their id."""
    return crc_of_id(F.col(key)) % 2 == 0
