"""Operator 1: near-duplicates by min-max hashing, confirmed on full sets.

Each permutation of a document's shingles gives two signature values, its minimum and its maximum, so
64 hash evaluations a shingle make 128 values. Bands of five values bring documents together: two of
similarity 0.8 share one with probability 0.99995.

Nodes are distinct shingle sets, numbered by a 64-bit digest: copies never meet. Buckets of one node
only, most of them, are told by a filter and never shuffled with their nodes. In each other bucket the
node that shares most buckets with others is the centre, and every node is compared with the centre it meets most
often. Where a bucket still holds different components, nodes are compared with other members of the
centre's component, one each, in ROUNDS rounds; so groups of thousands of near copies are settled in
a few comparisons a node. What is left, nodes of different components in one bucket, is compared pair by pair, in blocks of bounded
size spread over tasks: signatures first (a pair passes unless its estimate lies five standard
deviations under the threshold), then full sets. No bucket is capped. Links, components and sets stay
distributed, and tables go as soon as their last reader is written.

A document with fewer words than a shingle has its whole sequence as one; one without words, or a null
text, has none and is linked with nothing. Rows with a null id are linked with nothing and kept.
Repeated rows have equal sets and one component; all rows with the smallest id of a component are kept.
An empty table gives no rows. Very long texts are one slice each. Other columns of the input are never read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleweave.llm.common import Passing, discard, materialize, may_match, release, salted, slices

WORDS, PERMUTATIONS, BAND, BLOCK, ROUNDS = 5, 64, 5, 1_000, 3
#: Members of small buckets that one group of a task takes, about.
GROUP = 10_000
CACHE_WORDS = 150_000
_P = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20_240_607)
_A = (_rng.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)


class Words(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: list[str | None], words: dict[bytes, int], size: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    split = [t.encode("utf-8", "surrogatepass").lower().split() if t else [] for t in texts]  # bytes: only A-Z are lower-cased, and ASCII white space splits
    lengths = np.array([len(x) for x in split], dtype=np.int64)
    flat = np.fromiter((h for x in split for h in map(words.__getitem__, x)), dtype=np.uint64, count=int(lengths.sum()))
    out = []
    with np.errstate(over="ignore"):
        h = np.zeros(max(0, len(flat) - size + 1), dtype=np.uint64)
        for k in range(size):
            h = h * _P + flat[k : k + len(h)]
        h = _finish(h)
        begin = 0
        for n in lengths.tolist():
            if n >= size:
                out.append(np.unique(h[begin : begin + n - size + 1]))
            elif n:
                whole = np.uint64(n)
                for w in flat[begin : begin + n]:
                    whole = whole * _P + w
                out.append(_finish(np.array([whole ^ np.uint64(0xA5A5A5A5A5A5A5A5)])))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
            begin += n
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima, then maxima, of each non-empty set under each permutation."""
    out = np.zeros((len(sets), 2 * PERMUTATIONS), dtype=np.uint32)
    begin = 0
    while begin < len(sets):  # about so many shingles at once as the cache holds
        end, n = begin, 0
        while end < len(sets) and (end == begin or n + len(sets[end]) <= 60_000):
            n += len(sets[end])
            end += 1
        x = (np.concatenate(sets[begin:end]) >> np.uint64(32)).astype(np.uint32)
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets[begin : end - 1]], dtype=np.int64)]).astype(np.int64)
        y = np.empty_like(x)
        for j in range(PERMUTATIONS):
            np.multiply(x, _A[j], out=y)
            np.add(y, _B[j], out=y)
            out[begin:end, j] = np.minimum.reduceat(y, at)
            out[begin:end, PERMUTATIONS + j] = np.maximum.reduceat(y, at)
        begin = end
    return out


def number_of(shingles: np.ndarray) -> int:
    """The node of a set: a 64-bit digest."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def linked(a: int, b: int, common: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


def sketches(docs: DataFrame, text: str, key: str) -> DataFrame:
    """id_, n_ (distinct shingles), node_ (null if there are none, or no id) and signature_ of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in slices(batches, "text_"):
            sets = shingle_sets(batch.column("text_").to_pylist(), words)
            known = [bool(len(s)) and i for s, i in zip(sets, batch.column("id_").is_valid().to_pylist())]
            full = [s for s, k in zip(sets, known) if k]
            made = iter(signatures(full))
            yield pa.RecordBatch.from_arrays([batch.column("id_"), pa.array([len(s) for s in sets], pa.int64()), pa.array([number_of(s) if k else None for s, k in zip(sets, known)], pa.int64()), pa.array([next(made).tobytes() if k else None for k in known], pa.binary())], ["id_", "n_", "node_", "signature_"])

    return docs.select(F.col(key).alias("id_"), F.col(text).alias("text_")).mapInArrow(run, f"id_ {docs.schema[key].dataType.simpleString()}, n_ bigint, node_ bigint, signature_ binary")


def band_rows(rows: DataFrame, passing: Passing | None = None) -> DataFrame:
    """bucket_, node_, n_ for each band of each node, of each batch of rows once; with passing, only of buckets that it lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = 2 * PERMUTATIONS // BAND
        release()
        for batch in batches:
            node, first = np.unique(batch.column("node_").to_numpy(), return_index=True)
            sig = np.frombuffer(b"".join(batch.column("signature_").take(pa.array(first)).to_pylist()), dtype=np.uint32).reshape(-1, 2 * PERMUTATIONS).astype(np.uint64)
            keys = np.empty((len(sig), bands), dtype=np.uint64)
            with np.errstate(over="ignore"):
                for b in range(bands):
                    h = np.full(len(sig), b + 1, dtype=np.uint64)
                    for k in range(BAND):
                        h = _finish(h * _P + sig[:, b * BAND + k])
                    keys[:, b] = h
            bucket = keys.reshape(-1).view(np.int64)
            at = np.arange(len(bucket)) if passing is None else np.flatnonzero(passing(bucket))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[at]), pa.array(node[at // bands]), pa.array(batch.column("n_").to_numpy()[first][at // bands])], ["bucket_", "node_", "n_"])

    return rows.filter("node_ is not null").select("node_", "n_", "signature_").mapInArrow(run, "bucket_ bigint, node_ bigint, n_ bigint")


def node_sets(docs: DataFrame, text: str, key: str, wanted: DataFrame) -> DataFrame:
    """node_ and shingles_ of the wanted nodes (node_, id_: the document to read); other rows pass by without work."""
    passing = Passing(wanted, F.xxhash64("id_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = Words(), set()
        for batch in batches:
            some = batch.filter(pa.array(passing(batch.column("hash_").to_numpy())))
            for part in slices(iter([some]), "text_"):
                sets = {number_of(s): s for s in shingle_sets(part.column("text_").to_pylist(), words) if len(s)}
                new = [n for n in sets if n not in seen]
                seen.update(new)
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.int64()), pa.array([sets[n].tobytes() for n in new], pa.binary())], ["node_", "shingles_"])

    given = docs.select(F.col(key).alias("id_"), F.col(text).alias("text_")).filter("id_ is not null").select("text_", F.xxhash64("id_").alias("hash_"))
    return given.mapInArrow(run, "node_ bigint, shingles_ binary").groupBy("node_").agg(F.first("shingles_").alias("shingles_"))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a_, b_, a table) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x_"), batch.column("y_")):
                a, b = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                both = np.concatenate([a, b])
                both.sort(kind="stable")  # merges two sorted runs
                keep.append(linked(len(a), len(b), int((both[1:] == both[:-1]).sum()), percent))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a_", "b_"])

    def side(of: str, shingles: str) -> DataFrame:
        return may_match(sets, F.col("node_"), pairs, F.col(of)).filter("maybe_").select(F.col("node_").alias(of), F.col("shingles_").alias(shingles))

    return pairs.select("a_", "b_").join(side("a_", "x_"), "a_").join(side("b_", "y_"), "b_").select("a_", "b_", "x_", "y_").mapInArrow(run, "a_ bigint, b_ bigint").distinct()


def components(links: DataFrame) -> DataFrame:
    """node_ and root_ (the smallest node reachable) for every node of the links (a_, b_): least labels spread along links and jump."""
    if not links.take(1):
        return links.select(F.col("a_").alias("node_"), F.col("b_").alias("root_"))
    both = materialize(links.select(F.col("a_").alias("u_"), F.col("b_").alias("v_")).union(links.select("b_", "a_")).distinct(), "links")
    labels = materialize(both.groupBy(F.col("u_").alias("node_")).agg(F.least(F.min("v_"), F.first("u_")).alias("root_")), "labels")
    while True:
        near = both.join(labels, F.col("v_") == F.col("node_")).groupBy(F.col("u_").alias("node_")).agg(F.min("root_").alias("low_"))
        lower = labels.join(near, "node_").select("node_", F.col("root_").alias("was_"), F.least("root_", "low_").alias("mid_"))
        jump = labels.select(F.col("node_").alias("mid_"), F.col("root_").alias("far_"))
        new = materialize(lower.join(jump, "mid_").select("node_", "was_", F.least("mid_", "far_").alias("root_")), "labels")
        discard(labels)
        labels = new.select("node_", "root_")
        labels.table_path_ = new.table_path_
        if not new.filter("root_ <> was_").take(1):
            discard(both)
            return labels


def block_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs among the members (bucket_, node_, n_, root_, signature_; a table) of unsettled buckets. Buckets of one block share tasks' groups, larger ones are taken block by block."""
    groups = 1 + members.count() // GROUP
    counts = members.groupBy("bucket_").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks_"))
    own = members.join(counts, "bucket_").withColumn("block_", F.pmod(F.xxhash64("node_"), F.col("blocks_")).cast("int"))
    own = own.withColumn("many_", F.col("blocks_") > 1).withColumn("group_", F.when(F.col("many_"), F.col("bucket_")).otherwise(F.pmod(F.xxhash64("bucket_"), F.lit(groups))))
    spread = own.withColumn("other_", F.explode(F.sequence(F.lit(0), F.col("blocks_") - 1))).select("many_", "group_", F.least("block_", "other_").alias("i_"), F.greatest("block_", "other_").alias("j_"), "bucket_", "block_", "node_", "n_", "root_", "signature_")
    threshold = percent / 100
    least = threshold - 5 * np.sqrt(threshold * (1 - threshold) / (2 * PERMUTATIONS))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bucket_", ignore_index=True)
        sig = np.frombuffer(b"".join(pdf["signature_"]), dtype=np.uint32).reshape(len(pdf), -1)
        n, root, node, block = pdf["n_"].to_numpy(), pdf["root_"].to_numpy(), pdf["node_"].to_numpy(), pdf["block_"].to_numpy()
        bucket = pdf["bucket_"].to_numpy()
        cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(pdf)]
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for begin, end in zip(cuts, cuts[1:]):
            for i in range(begin, end):
                if block[i] != key[2]:
                    continue
                low = i + 1 if key[2] == key[3] else begin
                own = slice(low, end)
                at = low + np.flatnonzero((100 * np.minimum(n[own], n[i]) >= percent * np.maximum(n[own], n[i])) & (root[own] != root[i]) & (block[own] == key[3]))
                if len(at):
                    at = at[(sig[at] == sig[i]).mean(1) >= least]
                    a.append(np.minimum(node[i], node[at]))
                    b.append(np.maximum(node[i], node[at]))
        return pd.DataFrame({"a_": np.concatenate(a), "b_": np.concatenate(b)})

    return spread.groupBy("many_", "group_", "i_", "j_").applyInPandas(run, "a_ bigint, b_ bigint").distinct()


def _best(tries: DataFrame) -> DataFrame:
    """Of each node's tries (node_, to_, one row a bucket), the partner met most often: a_, b_."""
    met = tries.groupBy("node_", "to_").agg(F.count(F.lit(1)).alias("c_"))
    return met.groupBy("node_").agg(F.max_by("to_", F.struct("c_", "to_")).alias("a_")).select("a_", F.col("node_").alias("b_"))


def bucket_members(rows: DataFrame) -> DataFrame:
    """The nodes of every bucket of several nodes (bucket_, node_, n_, degree_: in how many pairs of a bucket the node is)."""
    shared = materialize(band_rows(rows).groupBy("bucket_").agg(F.min("node_").alias("lo_"), F.max("node_").alias("hi_")).filter("lo_ < hi_").select("bucket_"), "minhash-buckets")
    met = materialize(band_rows(rows, Passing(shared, F.col("bucket_"))).join(shared, "bucket_", "left_semi").distinct(), "minhash-met")
    sizes = met.groupBy("bucket_").agg((F.count(F.lit(1)) - 1).alias("others_"))
    degree = met.join(sizes, "bucket_").groupBy("node_").agg(F.sum("others_").alias("degree_"))
    members = materialize(met.join(degree, "node_").select("bucket_", "node_", "n_", "degree_"), "minhash-members")
    discard(shared, met)
    return members


def links_of(members: DataFrame, rows: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """All links that don't lie inside a component of others, and the components."""
    fits = lambda other: F.greatest("n_", other) * percent <= F.least("n_", other) * 100
    centre = members.groupBy("bucket_").agg(F.max(F.struct("degree_", "node_", "n_")).alias("c_"))
    tries = members.join(centre, "bucket_").filter(F.col("node_") != F.col("c_.node_")).filter(fits(F.col("c_.n_"))).select("node_", F.col("c_.node_").alias("to_"))
    tried = materialize(_best(tries), "minhash-pairs")
    links = materialize(confirm(tried, sets, percent), "minhash-links")
    labels = components(links)

    def labelled() -> DataFrame:
        return members.join(labels, "node_", "left").withColumn("root_", F.coalesce("root_", "node_"))

    for i in range(ROUNDS):
        # Of each bucket, its components with one member each, and the component of its centre.
        known = labelled().groupBy("bucket_", "root_").agg(F.max(F.struct("degree_", "node_")).alias("top_"), F.max_by(F.struct("node_", "n_"), F.xxhash64("node_", F.lit(i))).alias("some_"))
        main = known.groupBy("bucket_").agg(F.max(F.struct("top_", "root_", "some_")).alias("m_"), F.count(F.lit(1)).alias("c_")).filter("c_ > 1").select("bucket_", "m_")
        tries = labelled().join(main, "bucket_").filter(F.col("root_") != F.col("m_.root_")).filter(fits(F.col("m_.some_.n_"))).select("node_", F.col("m_.some_.node_").alias("to_"))
        new = materialize(_best(tries).join(tried, ["a_", "b_"], "left_anti"), "minhash-pairs")
        if not new.take(1):
            break
        more = materialize(confirm(new, sets, percent), "minhash-links")
        tried = tried.union(new)
        if not more.take(1):
            break
        links = links.union(more)
        labels = components(links)

    # What is left: buckets in which two components still meet.
    open_ = labelled().groupBy("bucket_").agg((F.min("root_") < F.max("root_")).alias("open_")).filter("open_").select("bucket_")
    left = materialize(labelled().join(open_, "bucket_", "left_semi").select("bucket_", "node_", "n_", "root_"), "minhash-left")
    if not left.take(1):
        return links, labels
    signed = may_match(rows.filter("node_ is not null").select("node_", "signature_"), F.col("node_"), left, F.col("node_")).filter("maybe_").groupBy("node_").agg(F.first("signature_").alias("signature_"))
    pairs = block_pairs(materialize(left.join(signed, "node_"), "minhash-open"), percent)
    tried = tried.select(F.least("a_", "b_").alias("a_"), F.greatest("a_", "b_").alias("b_"))
    new = materialize(pairs.join(tried, ["a_", "b_"], "left_anti"), "minhash-pairs")
    if not new.take(1):
        return links, labels
    last = materialize(confirm(new, sets, percent), "minhash-links")
    links = links.union(last)
    return links, components(links) if last.take(1) else labels


def near_duplicates(docs: DataFrame, percent: int = 85, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row."""
    rows = materialize(sketches(docs, text, key), "minhash-rows")
    total = rows.count()
    nodes = materialize(rows.filter("node_ is not null").groupBy("node_").agg(F.min("id_").alias("low_"), F.count(F.lit(1)).alias("copies_")), "minhash-nodes")
    members = bucket_members(rows)
    wanted = materialize(members.select("node_").distinct().join(nodes.select("node_", F.col("low_").alias("id_")), "node_"), "minhash-wanted")
    sets = materialize(node_sets(docs, text, key, wanted), "minhash-sets")
    _, labels = links_of(members, rows, sets, percent)

    joined = nodes.join(labels, "node_", "left").select("node_", "low_", "copies_", F.coalesce("root_", "node_").alias("root_"))
    lowest = joined.groupBy("root_").agg(F.min("low_").alias("component_"))
    told = materialize(joined.join(lowest, "root_").select("node_", "component_", "copies_"), "minhash-components")
    discard(nodes, members, wanted, sets)
    spread, told = salted(rows.select("id_", "n_", "node_"), told, "node_", "copies_", total, ["id_"])
    out = spread.join(told, ["node_", "salt_"], "left")
    component = F.coalesce("component_", "id_")
    return out.select(F.col("id_").alias(key), F.col("n_").alias("n_shingles"), component.alias("component_id"), F.col("id_").eqNullSafe(component).alias("kept"))
