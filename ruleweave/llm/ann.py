"""Operator 2: approximate nearest neighbours by stable projections and kd-trees.

Vectors are projected on a few random Gaussian directions. The squared ratio of a pair's projected and
true distance then follows a chi-square law, so once the next projected neighbour is so far that a true
neighbour nearer than the current worst would hardly ever (1 - CONFIDENCE) lie there, a search stops.

The projected space is cut into cells by the top of a kd-tree, fitted on a bounded sample; every vector is
in one cell, and each cell (split further where it is too full) has a kd-tree of its own, which leaves out branches
beyond the stopping distance. Of the others, points are taken in the order of their projected distances, each verified on its original vector,
until the test holds for the worst of the k nearest found. A query searches
its home cell, which bounds its k-th distance, and then the cells that the test can't rule out.

With DIMENSIONS projections the k-th neighbour itself is missed with probability 1 - CONFIDENCE, nearer ones less often. How many
points are verified depends on the data: of vectors in groups, those of a query's group; of vectors without any structure, whose tenth distance is not much below the mean one, still a
quarter. More directions verify fewer points but cost as much to compare.

Vectors that are null, zero, of another dimension than most, or hold null or non-finite components take no part, nor do null ids. Rows that share the query's id are its own. A repeated query id counts
once, with its least vector; repeated candidates are candidates each; equal distances go to the smaller id. Fewer than k candidates give
fewer rows; an empty table gives none. Other columns of the input are never read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ruleweave.llm.common import materialize

#: Projected dimensions, rows of a cell about, cells and sampled rows at most, rows of a tree's leaf.
DIMENSIONS, CELL, MAX_CELLS, SAMPLE, LEAF, CONFIDENCE = 24, 16_384, 4_096, 50_000, 256, 0.93
#: Points verified at a time.
STEP = 512

#: By how much equal projections may differ.
_ROUNDING = 1e-9


def chi2_cdf(x: np.ndarray, m: int = DIMENSIONS) -> np.ndarray:
    """Of an even number of degrees of freedom."""
    h = np.asarray(x, dtype=np.float64) / 2
    term, total = np.ones_like(h), np.ones_like(h)
    for i in range(1, m // 2):
        term = term * h / i
        total = total + term
    return 1 - np.exp(-h) * total


def chi2_point(p: float, m: int = DIMENSIONS) -> float:
    low, high = 0.0, 1e3
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(np.array(mid), m) < p else (low, mid)
    return high


def directions(width: int) -> np.ndarray:
    return np.random.default_rng(7_919 + width).standard_normal((width, DIMENSIONS))


class Cells:
    """Cuts of the projected space: axis and place of each inner node of a full binary tree, and the leaves' boxes."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.axis = np.zeros(max(1, (1 << depth) - 1), dtype=np.int64)
        self.at = np.zeros(max(1, (1 << depth) - 1))
        box = np.tile(np.array([[-np.inf], [np.inf]]), (1, DIMENSIONS))
        parts, boxes = [sample], [box]
        for level in range(depth):
            next_parts, next_boxes = [], []
            for i, (p, b) in enumerate(zip(parts, boxes)):
                node = (1 << level) - 1 + i
                axis = int(np.argmax(p.max(0) - p.min(0))) if len(p) else level % DIMENSIONS
                cut = float(np.median(p[:, axis])) if len(p) else 0.0
                self.axis[node], self.at[node] = axis, cut
                left, right = b.copy(), b.copy()
                left[1, axis], right[0, axis] = min(cut, b[1, axis]), max(cut, b[0, axis])
                below = p[:, axis] < cut
                next_parts += [p[below], p[~below]]
                next_boxes += [left, right]
            parts, boxes = next_parts, next_boxes
        self.low, self.high = np.stack([b[0] for b in boxes]), np.stack([b[1] for b in boxes])

    def home(self, projected: np.ndarray) -> np.ndarray:
        node = np.zeros(len(projected), dtype=np.int64)
        for _ in range(self.depth):
            right = projected[np.arange(len(projected)), self.axis[node]] >= self.at[node]
            node = 2 * node + 1 + right
        return node - ((1 << self.depth) - 1)

    def distances(self, q: np.ndarray) -> np.ndarray:
        """Projected distances of one point to all cells."""
        return np.sqrt((np.maximum(0, np.maximum(self.low - q, q - self.high)) ** 2).sum(1))


class Tree:
    """A kd-tree over projected points: leaves of neighbouring points, with their boxes."""

    def __init__(self, projected: np.ndarray):
        leaves, todo = [], [np.arange(len(projected))]
        while todo:
            own = todo.pop()
            if len(own) <= LEAF:
                leaves.append(own)
                continue
            p = projected[own]
            axis = int(np.argmax(p.max(0) - p.min(0)))
            order = np.argpartition(p[:, axis], len(own) // 2)
            todo += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
        self.projected = projected[np.concatenate(leaves)]
        self.place = np.concatenate(leaves)
        self.ends = np.cumsum([len(x) for x in leaves])
        self.low = np.stack([projected[x].min(0) for x in leaves])
        self.high = np.stack([projected[x].max(0) for x in leaves])
        self.verified = self.skipped = 0

    def nearest(self, q: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, self_id: int, k: int, bound: float, reach: float) -> list[tuple[float, int]]:
        """Points by projected distance, verified on true distances until the test holds for the k-th found, or the bound known before."""
        slack = _ROUNDING * (1 + float(np.abs(own).max()))
        gap = np.sqrt((np.maximum(0, np.maximum(self.low - own, own - self.high)) ** 2).sum(1))
        far = np.repeat(gap > bound * reach + slack, np.diff(self.ends, prepend=0))
        at = np.flatnonzero(~far)
        apart = np.sqrt(((self.projected[at] - own) ** 2).sum(1))
        near = apart <= bound * reach + slack
        at, apart = self.place[at[near]], apart[near]
        other = ids[at] != self_id
        at, apart = at[other], apart[other]
        first = np.argpartition(apart, STEP)[:STEP] if len(at) > STEP else np.arange(len(at))
        best = _merged([], q, first, at, vectors, ids, k, bound)
        done = len(first)
        if len(at) > STEP:
            # What the first points leave within reach, nearest first.
            rest = np.ones(len(at), dtype=bool)
            rest[first] = False
            worst = min(bound, best[k - 1][0] if len(best) >= k else math.inf)
            rest = np.flatnonzero(rest & (apart <= worst * reach + slack))
            rest = rest[np.argsort(apart[rest], kind="stable")]
            for begin in range(0, len(rest), STEP):
                worst = min(bound, best[k - 1][0] if len(best) >= k else math.inf)
                if apart[rest[begin]] > worst * reach + slack:
                    break
                best = _merged(best, q, rest[begin : begin + STEP], at, vectors, ids, k, worst)
                done += len(rest[begin : begin + STEP])
        self.verified, self.skipped = self.verified + done, self.skipped + len(ids) - done
        return best


def _merged(best: list[tuple[float, int]], q: np.ndarray, some: np.ndarray, at: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, worst: float) -> list[tuple[float, int]]:
    """The k best with some points verified."""
    own = at[some]
    true = np.sqrt(((vectors[own] - q) ** 2).sum(1))
    near = true <= worst
    return sorted(best + list(zip(true[near].tolist(), ids[own][near].tolist())))[:k] if near.any() else best


def usable(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """Rows that take part (id_, vec_ of doubles), and their dimension."""
    raw = vectors.select(F.col(key).cast("bigint").alias("id_"), F.col(vector).cast("array<double>").alias("vec_"))
    fine = F.forall("vec_", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec_", lambda x: x != 0)
    rows = raw.filter(F.col("id_").isNotNull() & F.col("vec_").isNotNull() & fine)
    width = rows.groupBy(F.size("vec_").alias("d_")).count().orderBy(F.desc("count"), "d_").first()
    return (rows.filter(F.size("vec_") == width.d_), width.d_) if width else (rows, 1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, width)


def search(vectors: DataFrame, k: int = 10, queries: str = "id_ % 100 = 0", key: str = "vec_id", vector: str = "embedding", confidence: float = CONFIDENCE) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row the k nearest rows found."""
    spark = vectors.sparkSession
    rows, width = usable(vectors, key, vector)
    total = rows.count()
    depth = max(0, math.ceil(math.log2(max(1, min(MAX_CELLS, total / CELL)))))
    share = min(1.0, SAMPLE / max(1, total))
    sample = rows.filter(F.pmod(F.xxhash64("id_", F.lit(11)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("vec_").toArrow() if depth else None
    matrix = directions(width)
    cells = Cells(_matrix(sample.column("vec_").combine_chunks(), width) @ matrix if sample is not None and sample.num_rows else np.zeros((0, DIMENSIONS)), depth)
    reach = math.sqrt(chi2_point(confidence))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home = cells.home(_matrix(batch.column("vec_"), width) @ matrix)
            yield pa.RecordBatch.from_arrays([batch.column("id_"), batch.column("vec_"), pa.array(home)], ["id_", "vec_", "cell_"])

    placed = materialize(rows.mapInArrow(place, "id_ bigint, vec_ array<double>, cell_ bigint"), "ann-cells")
    parts = {r.cell_: -(-r["count"] // (2 * CELL)) for r in placed.groupBy("cell_").count().collect()}  # at most MAX_CELLS rows
    table = F.broadcast(spark.createDataFrame(list(parts.items()) or [(0, 1)], "cell_ bigint, parts_ int"))
    indexed = placed.join(table, "cell_").withColumn("part_", F.pmod(F.xxhash64("id_"), F.col("parts_")).cast("int")).drop("parts_")
    asked = materialize(placed.filter(queries).groupBy("id_").agg(F.min(F.struct("vec_", "cell_")).alias("q_")).select("id_", "q_.*"), "ann-asked")

    def look(key_: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(left) and len(right):
            own = np.stack(left["vec_"].to_list()).astype(np.float64)
            ids, projected = left["id_"].to_numpy(), own @ matrix
            tree = Tree(projected)
            for i, v, bound in zip(right["id_"], right["vec_"], right["bound_"]):
                q = np.asarray(v, dtype=np.float64)
                out += [(i, x, d) for d, x in tree.nearest(q, q @ matrix, own, ids, i, k, bound, reach)]
        return pd.DataFrame(out, columns=["query_", "id_", "score_"]).astype({"query_": "int64", "id_": "int64", "score_": "float64"})

    def visit(requests: DataFrame) -> DataFrame:
        """Requests (id_, vec_, cell_, bound_) meet every part of their cell."""
        each = requests.join(table, "cell_").withColumn("part_", F.explode(F.sequence(F.lit(0), F.col("parts_") - 1))).drop("parts_")
        each = each.select(*[F.col(c).alias(c) for c in each.columns])  # names of its own beside the index
        return indexed.groupBy("cell_", "part_").cogroup(each.groupBy("cell_", "part_")).applyInPandas(look, "query_ bigint, id_ bigint, score_ double")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank_", F.row_number().over(Window.partitionBy("query_").orderBy("score_", "id_"))).filter(F.col("rank_") <= k)

    first = materialize(ranked(visit(asked.withColumn("bound_", F.lit(math.inf)))), "ann-first")
    if not depth:
        return first.select(F.col("query_").alias("query_id"), F.col("rank_").alias("rank"), F.col("id_").alias("vec_id"), F.col("score_").alias("score"))
    bounds = first.groupBy(F.col("query_").alias("id_")).agg(F.max("score_").alias("far_"), F.count(F.lit(1)).alias("n_"))
    bounded = asked.join(bounds, "id_", "left").select("id_", "vec_", "cell_", F.when(F.col("n_") >= k, F.col("far_")).otherwise(F.lit(math.inf)).alias("bound_"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _matrix(batch.column("vec_"), width) @ matrix
            rows_, to = [], []
            for i, (p, home, bound) in enumerate(zip(own, batch.column("cell_").to_pylist(), batch.column("bound_").to_pylist())):
                near = np.flatnonzero(cells.distances(p) <= bound * reach + _ROUNDING * (1 + np.abs(p).max()))
                near = near[near != home]
                rows_ += [i] * len(near)
                to += near.tolist()
            at = pa.array(rows_, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id_").take(at), batch.column("vec_").take(at), pa.array(to, pa.int64()), batch.column("bound_").take(at)], ["id_", "vec_", "cell_", "bound_"])

    second = visit(bounded.mapInArrow(route, "id_ bigint, vec_ array<double>, cell_ bigint, bound_ double"))
    return ranked(first.drop("rank_").unionByName(second)).select(F.col("query_").alias("query_id"), F.col("rank_").alias("rank"), F.col("id_").alias("vec_id"), F.col("score_").alias("score"))
