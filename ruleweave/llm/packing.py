"""Operator 5: best-fit packing of documents into sequences, by hierarchical residual packing.

Each input partition cuts its documents into pieces and packs them best-fit, longest first. Nearly
full bins are final, and so is, after every round, each bin that the smallest underfull one no longer fits. Other underfull bins become items
of the next round: they are dealt anew, by a hash of their number, to as few groups as hold at most about BLOCK of them each, and packed best-fit there. The
last round is the one of a single group, or the first that joins less than one in STALE of its bins; no task ever gets all of a large table's bins. Only underfull bins move.

A null or empty text is its end id alone. Rows with equal doc_id are documents of their own. Equal sizes keep the order of their rows. An
empty table gives no rows. Very long texts are one slice each. Other columns of the input are never read, whatever their names.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleweave.llm.bpe import _Cache, byte_alphabet
from ruleweave.llm.common import materialize, slices

#: Items that a task packs at once; a bin with at most SLACK free places is final.
BLOCK, SLACK, STALE = 150_000, 2, 50
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteBpe:
    """Ids of a byte-level BPE file. A single space between two visible characters always begins a
    new word of this tokenizer, so texts are cut there and the stretches, which recur, are kept."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        back = {c: b for b, c in enumerate(byte_alphabet())}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.library = Tokenizer.from_file(path)
        self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.raw = [i.to_bytes(4, "little") for i in range(max([*ranks.values(), *self.special.values()]) + 1)]
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.cut = re.compile(r"(?<=\S) (?=\S)")
        self.first: _Cache = _Cache(self._ids)
        self.later: _Cache = _Cache(lambda part: self._ids(" " + part))

    def forget(self) -> None:
        for cache in (self.first, self.later):
            cache.clear()
            cache.old = {}

    def _ids(self, part: str) -> bytes:
        if part.isascii() or max(part) < "ɐ":
            ids = self.fast.encode_ordinary(part)
        else:
            ids = self.library.encode(part, add_special_tokens=False).ids
        return b"".join([self.raw[i] for i in ids])

    def encode_bytes(self, text: str) -> bytes:
        out = []
        for k, part in enumerate(self.split_special.split(text) if "<|" in text else [text]):
            if k % 2:
                out.append(self.special[part].to_bytes(4, "little"))
            elif part:
                if part.replace("\n", "").isprintable() and "  " not in part and " \n" not in part and "\n " not in part and part[0] != " " and part[-1] != " ":
                    cut = part.split(" ")
                else:
                    cut = self.cut.split(part)
                out.append(self.first[cut[0]])
                out += map(self.later.__getitem__, cut[1:])
        return b"".join(out)


@functools.lru_cache(maxsize=1)
def coder_for(path: str) -> ByteBpe:
    """One coder for each Python worker; what it keeps of texts goes with the task, see ByteBpe.forget."""
    return ByteBpe(path)


def best_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each size, and each bin's fill. Bins lie in stacks by free places; a bit mask finds the tightest that fits."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins, offsets, fills = 0, [0] * len(sizes), [0] * len(sizes), []
    for i in order:
        n = sizes[i]
        if m := mask >> n:
            free = n + (m & -m).bit_length() - 1
            b = stacks[free].pop()
            if not stacks[free]:
                mask &= ~(1 << free)
        else:
            free, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += n
        stacks[free - n].append(b)
        mask |= 1 << (free - n)
    return bins, offsets, fills


def pieces_of(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids; only the first piece may be shorter than capacity."""
    n = len(ids) // 4
    begin = 0
    end = n % capacity or capacity
    for k in range(-(-n // capacity)):
        yield k, begin, end - begin, zlib.crc32(ids[4 * begin : 4 * end])
        begin, end = end, end + capacity


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece."""
    key_type = docs.schema[key].dataType.simpleString()

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = coder_for(path), TaskContext.get().partitionId()
        end = end_id.to_bytes(4, "little")
        keys: list = []
        rows: list[tuple] = []
        made = 0

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal made
            bins, offsets, fills = best_fit_decreasing([r[2] for r in rows], capacity)
            base = (part << 36) + made
            made += len(fills)
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(keys, type=key_arrow), *(pa.array(c, pa.int64()) for c in cols), pa.array([base + b for b in bins], pa.int64()), pa.array(offsets, pa.int64()), pa.array([fills[b] for b in bins], pa.int64())], ["key_", "piece", "start", "length", "ids_crc32", "bin_", "at_", "fill_"])
            keys.clear()
            rows.clear()

        key_arrow = None
        for batch in slices(batches, "text_"):
            key_arrow = batch.schema.field("key_").type
            for k, t in zip(batch.column("key_").to_pylist(), batch.column("text_").to_pylist()):
                own = list(pieces_of(coder.encode_bytes(t or "") + end, capacity))
                keys += [k] * len(own)
                rows += own
                if len(rows) >= BLOCK:
                    yield from emit()
        if rows:
            yield from emit()
        coder.forget()

    given = docs.select(F.col(key).alias("key_"), F.col(text).alias("text_"))
    placed = materialize(given.mapInArrow(local, f"key_ {key_type}, piece bigint, start bigint, length bigint, ids_crc32 bigint, bin_ bigint, at_ bigint, fill_ bigint"), "pack-local")
    return merge_residuals(placed, capacity).select(F.col("key_").alias(key), "piece", "start", "length", "ids_crc32", F.col("bin_").alias("sequence_id"), F.col("at_").alias("offset"))


def merge_residuals(placed: DataFrame, capacity: int) -> DataFrame:
    """Tree-merge the underfull bins of placed rows (bin_, at_, fill_, any other columns)."""
    under = F.col("fill_") < capacity - SLACK
    # Bins as items, with the bin that now holds each and its place there. One row a bin: its piece at 0.
    items = materialize(placed.filter(under & (F.col("at_") == 0)).select("bin_", F.col("bin_").alias("root_"), F.lit(0).cast("long").alias("shift_"), F.col("fill_").alias("size_")), "pack-residual")

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("root_", ignore_index=True)
        bins, offsets, _ = best_fit_decreasing(pdf["size_"].tolist(), capacity)
        heads = {b: r for b, r, offset in zip(bins, pdf["root_"], offsets) if not offset}
        return pd.DataFrame({"root_": pdf["root_"], "new_": [heads[b] for b in bins], "add_": offsets}).astype("int64")

    turn = 0
    while True:
        roots = items.groupBy("root_").agg(F.sum("size_").alias("size_")).filter(F.col("size_") < capacity - SLACK)
        least = roots.agg(F.min("size_")).first()[0]
        fit = roots.filter(F.col("size_") <= capacity - least) if least else roots
        count = fit.count()
        if count < 2:
            break
        groups = -(-count // BLOCK)
        dealt = fit.withColumn("group_", F.pmod(F.xxhash64("root_", F.lit(turn)), F.lit(groups)))
        joined = materialize(dealt.groupBy("group_").applyInPandas(again, "root_ bigint, new_ bigint, add_ bigint").filter("new_ <> root_"), "pack-round")
        merged = joined.count()
        if merged:
            items = materialize(items.join(joined, "root_", "left").select("bin_", F.coalesce("new_", "root_").alias("root_"), (F.col("shift_") + F.coalesce("add_", F.lit(0))).alias("shift_"), "size_"), "pack-residual")
        if groups == 1 or merged * STALE < count:
            break
        turn += 1
    moved = items.filter("bin_ <> root_ or shift_ > 0").select(F.col("bin_"), "root_", "shift_")
    rest = placed.filter(under).join(moved, "bin_", "left")
    names = [c for c in placed.columns if c not in ("bin_", "at_", "fill_")]
    return placed.filter(~under).select(*names, "bin_", "at_").unionByName(rest.select(*names, F.coalesce("root_", "bin_").alias("bin_"), (F.col("at_") + F.coalesce("shift_", F.lit(0))).alias("at_")))
