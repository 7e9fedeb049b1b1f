"""Operator 3: toxicity by nearest labelled examples.

Texts are cut into passages of about PASSAGE terms, labelled ones and searched ones alike. A term is a word cut to its
first STEM letters, so that inflected forms meet (a word of more than LONG letters, as in scripts without
spaces, gives a term for every STEM letters); terms are hashed to TERMS numbers, so that their document
frequencies, counted over all documents, have a fixed size. No term of any text is left out. A passage's vector is
its TF-IDF weights over unit length.

The passages of a bounded sample of labelled documents lie in blocks of an inverted index, which keeps the greatest
weight of each term in each block. Lists of the rarer terms are added up first; the lists of the COMMON most
common ones are stored by block, and a block is opened only if its sums so far and the greatest weights of its common terms can still
reach the NEIGHBOURS nearest found. So the nearest examples by cosine are exact, but for rounding of single-precision
sums. Their labels vote, weighted by nearness and by how thinly their label was sampled. A text's vote is that of
its most toxic passage; a logistic curve, fitted on the votes that each example gets from all others, makes
it a calibrated score, which allows for the number of passages. The nearest examples of that passage are the evidence.

A text without words (empty and null ones too), or without a term of any example, has the vote of no neighbours: the rate
of toxic examples. Without examples of both labels every score is that rate. Several labels of one
document count as toxic if one does; null labels and labels of null ids don't count. Labelled texts of the same terms in the same order count once, with their
weights summed. Cosines equal to six digits are ties and go to the smaller id. Repeated rows are scored each for
themselves. An empty table gives no rows. Very long texts are passages like others. Columns beside those named are never read, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleweave.llm.common import crc_of_id, discard, materialize, slices

#: The bounded sample: examples of each label, and their passages, about.
MAX_TOXIC, MAX_CLEAN, MAX_PASSAGES = 300, 600, 4_500
#: Letters of a term, letters from which a word gives several, numbers of terms, terms of a passage, terms with lists by block.
STEM, LONG, TERMS, PASSAGE, COMMON = 4, 24, 1 << 18, 128, 512
#: Neighbours in an index of MAX_PASSAGES (by the square root of its size in a smaller one), passages of a block, axes by which passages are put in order, passages searched together, stems that a task keeps.
NEIGHBOURS, BLOCK, AXES, TOGETHER, KNOWN = 100, 64, 6, 128, 150_000
_SLACK = 1e-5


class Terms(dict):
    """The term of each stem."""

    def __missing__(self, stem: str) -> int:
        if len(self) >= KNOWN:
            self.clear()
        value = self[stem] = xxhash.xxh32_intdigest(stem.encode("utf-8", "surrogatepass")) % TERMS
        return value


@functools.cache
def _letters() -> np.ndarray:
    """Which code points are letters or digits."""
    return np.fromiter(map(str.isalnum, map(chr, range(0x110000))), dtype=bool, count=0x110000)


def terms_of(texts: list[str | None], known: Terms) -> list[np.ndarray]:
    """All terms of each text, in order. Words are cut from all texts at once, as arrays of code points; Python sees each distinct stem once."""
    low = [t.lower() if t else "" for t in texts]
    if not low:
        return []
    whole = "\0".join(["", *low, "\0" * STEM])
    code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    edges = np.flatnonzero(np.diff(_letters()[code])) + 1
    begin, size = edges[::2], edges[1::2] - edges[::2]
    if (size > LONG).any():
        parts = np.where(size > LONG, -(-size // STEM), 1)
        skip = STEM * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        begin, size = np.repeat(begin, parts) + skip, np.repeat(size, parts) - skip
    # Four code points of 16 bits are one number; stems with greater ones (wide) are looked up one by one.
    packed, wide = np.zeros(len(begin), dtype="<u8"), np.zeros(len(begin), dtype=bool)
    for k in range(STEM):
        own = np.where(size > k, code[begin + k], 0)
        wide |= own > 0xFFFF
        packed |= own.astype("<u8") << np.uint64(16 * k)
    packed[wide] = 0
    met = pa.array(packed).dictionary_encode()
    stems = (x.to_bytes(8, "little").decode("utf-16-le").rstrip("\0") for x in met.dictionary.to_pylist())
    found = np.fromiter(map(known.__getitem__, stems), dtype=np.int64)[met.indices.to_numpy()]
    for i in np.flatnonzero(wide):
        found[i] = known[whole[begin[i] : begin[i] + min(STEM, size[i])]]
    return np.split(found, np.searchsorted(begin, np.cumsum([len(t) + 1 for t in low[:-1]])))


def passages(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts as terms: the text of each passage (a text without terms has none), and passage, term and count of each distinct term of a passage."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    parts = -(-lengths // PASSAGE)
    first = np.cumsum(parts) - parts
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    own = np.repeat(first, lengths) + place * np.repeat(parts, lengths) // np.repeat(lengths, lengths)
    met, count = np.unique(own * TERMS + (np.concatenate(texts) if texts else np.zeros(0, np.int64)), return_counts=True)
    return np.repeat(np.arange(len(texts)), parts), met // TERMS, met % TERMS, count


def weigh(row: np.ndarray, term: np.ndarray, count: np.ndarray, rows: int, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights over unit length of rows."""
    raw = (1 + np.log(count)) * idf[term]
    norm = np.sqrt(np.bincount(row, weights=raw * raw, minlength=rows))
    return raw / np.maximum(norm, 1e-300)[row]


class Index:
    """Block-max inverted index of weighted passages (row, term, x): exact nearest rows by cosine."""

    def __init__(self, row: np.ndarray, term: np.ndarray, x: np.ndarray, rows: int, common: int = COMMON):
        self.rows, self.blocks = rows, max(1, -(-rows // BLOCK))
        width = self.blocks * BLOCK
        often = np.bincount(term, minlength=TERMS)
        self.common = np.sort(np.argsort(-often, kind="stable")[: min(common, int((often > 0).sum()))])
        self.at = np.full(TERMS, -1, dtype=np.int32)
        self.at[self.common] = np.arange(len(self.common))
        of = self.at[term]
        # Rows alike lie together, so that blocks differ: by the sides of the main axes of their common terms.
        plain = np.zeros((rows, len(self.common)), dtype=np.float32)
        plain[row[of >= 0], of[of >= 0]] = x[of >= 0]
        axes = np.linalg.eigh(np.cov(plain, rowvar=False).reshape(len(self.common), -1))[1][:, ::-1][:, :AXES] if rows > 1 and len(self.common) else np.zeros((len(self.common), 1))
        side = (plain - plain.mean(0)) @ axes
        self.order = np.lexsort([*(side[:, k] > 0 for k in range(side.shape[1] - 1, -1, -1))])
        place = np.empty(rows, dtype=np.int64)
        place[self.order] = np.arange(rows)
        row, self.place = place[row], place
        lists = np.zeros((len(self.common), width), dtype=np.float32)
        lists[of[of >= 0], row[of >= 0]] = x[of >= 0]
        by_block = lists.reshape(len(self.common), self.blocks, BLOCK)
        self.most = by_block.max(2)
        self.lists = np.ascontiguousarray(by_block.transpose(1, 0, 2))
        rare = np.flatnonzero(of < 0)
        rare = rare[np.argsort(term[rare], kind="stable")]
        self.rare_rows, self.rare_x = row[rare].astype(np.int32), x[rare]
        self.starts = np.searchsorted(term[rare], np.arange(TERMS + 1)).astype(np.int64)
        self.opened = self.met = 0

    def cosines(self, row: np.ndarray, term: np.ndarray, x: np.ndarray, rows: int, k: int, barred: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Cosines of queries with all rows of the index; those of blocks that can't hold one of a query's k nearest are less than the true ones. barred: pairs (query, row) that count as 0."""
        width = self.blocks * BLOCK
        of = self.at[term]
        dense = np.zeros((rows, len(self.common)), dtype=np.float32)
        dense[row[of >= 0], of[of >= 0]] = x[of >= 0]
        rare = of < 0
        begin, size = self.starts[term[rare]], self.starts[term[rare] + 1] - self.starts[term[rare]]
        each = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(each)) + np.repeat(begin - (np.cumsum(size) - size), size)
        found = np.bincount(row[rare][each] * width + self.rare_rows[at], weights=x[rare][each] * self.rare_x[at], minlength=rows * width).astype(np.float32).reshape(rows, width)
        if barred is not None:
            found[barred[0], self.place[barred[1]]] = -np.inf
        sums = found.reshape(rows, self.blocks, BLOCK)
        bound = sums.max(2) + dense @ self.most
        opened = np.zeros((rows, self.blocks), dtype=bool)

        def open_(which: np.ndarray) -> None:
            for b in np.flatnonzero(which.any(0)):
                own = np.flatnonzero(which[:, b])
                if 2 * len(own) > rows:
                    sums[own, b] += (dense @ self.lists[b])[own]
                else:
                    sums[own, b] += dense[own] @ self.lists[b]
            opened[which] = True

        # The most promising blocks give a k-th best cosine, below which other blocks stay closed.
        few = min(self.blocks, -(-2 * k // BLOCK))
        lead = np.zeros_like(opened)
        np.put_along_axis(lead, np.argpartition(-bound, few - 1, axis=1)[:, :few], True, axis=1)
        open_(lead)
        if few < self.blocks:
            best = sums[lead].reshape(rows, few * BLOCK)
            worst = np.partition(best, few * BLOCK - k, axis=1)[:, few * BLOCK - k]
            open_(~opened & (bound >= np.maximum(worst, 0)[:, None] - _SLACK))
        self.opened, self.met = self.opened + int(opened.sum()), self.met + opened.size
        return found[:, self.place]

    def nearest(self, row: np.ndarray, term: np.ndarray, x: np.ndarray, rows: int, k: int, barred: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of each query's k nearest, nearest first; where fewer share a term, cosines are 0."""
        k = min(k, self.rows)
        found = np.round(np.maximum(self.cosines(row, term, x, rows, k, barred), 0), 6)
        order = found - np.arange(self.rows) * (1e-7 / max(1, self.rows))  # ties: the smaller id
        near = np.argpartition(-order, k - 1, axis=1)[:, :k] if k < self.rows else np.tile(np.arange(self.rows), (rows, 1))
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(order, near, axis=1), axis=1), axis=1)
        return near, np.take_along_axis(found, near, axis=1)


class Model:
    """Examples, their index and the curve that makes votes scores."""

    def __init__(self, idf: np.ndarray, docs: list[tuple], row: np.ndarray, term: np.ndarray, count: np.ndarray, owner: np.ndarray):
        """docs: (id, label, weight) of each example; row, term and count of their passages, and the example of each row, in order of ids."""
        self.idf, self.rows = idf, len(owner)
        self.ids = [d[0] for d in docs]
        labels, weights = np.array([d[1] for d in docs], dtype=np.float64), np.array([d[2] for d in docs], dtype=np.float64)
        self.prior = float((labels * weights).sum() / max(1e-9, weights.sum()))
        self.owner, self.labels, self.weights = owner, labels[owner], weights[owner]
        self.index = None
        self.curve = None
        if not self.rows or not 0 < self.prior < 1:
            return
        self.k = max(5, min(NEIGHBOURS, int(NEIGHBOURS * np.sqrt(self.rows / MAX_PASSAGES))))
        x = weigh(row, term, count, self.rows, idf)
        self.index = Index(row, term, x, self.rows)
        cut = np.searchsorted(row, np.arange(0, self.rows + TOGETHER, TOGETHER))
        votes = []
        for i, (a, b) in enumerate(zip(cut, cut[1:])):
            low, n = i * TOGETHER, min(self.rows, (i + 1) * TOGETHER) - i * TOGETHER
            same = np.flatnonzero(owner[low : low + n, None] == owner[None, :])
            votes.append(self._votes(*self.index.nearest(row[a:b] - low, term[a:b], x[a:b], n, self.k, (same // self.rows, same % self.rows))))
        vote, parts = np.zeros(len(docs)), np.bincount(owner, minlength=len(docs))
        np.maximum.at(vote, owner, np.concatenate(votes))
        seen = parts > 0
        self.curve = _logistic(self._features(vote[seen], parts[seen]), labels[seen], weights[seen])

    def _votes(self, near: np.ndarray, cos: np.ndarray) -> np.ndarray:
        weight = self.weights[near] / (1.05 - np.minimum(cos, 1)) * (cos > 0)
        total = weight.sum(1)
        return np.where(total > 0, (weight * self.labels[near]).sum(1) / np.maximum(total, 1e-300), self.prior)

    @staticmethod
    def _features(vote: np.ndarray, parts: np.ndarray) -> np.ndarray:
        p = np.clip(vote, 1e-3, 1 - 1e-3)
        return np.stack([np.ones(len(p)), np.log(p / (1 - p)), np.log(np.maximum(parts, 1))], axis=1)

    def score(self, texts: list[np.ndarray], evidence: int = 0) -> tuple[np.ndarray, list[list[tuple[object, float]]]]:
        """Scores of texts as terms, and ids and cosines of the examples nearest to the most toxic passage of each."""
        n = len(texts)
        proof: list[list[tuple[object, float]]] = [[] for _ in texts]
        if self.index is None:
            return np.full(n, self.prior), proof
        of, row, term, count = passages(texts)
        vote, parts, best = np.zeros(n), np.bincount(of, minlength=n), np.full(n, -1)
        vote[parts == 0] = self.prior
        x = weigh(row, term, count, len(of), self.idf)
        for low in range(0, len(of), TOGETHER):
            high = min(len(of), low + TOGETHER)
            a, b = np.searchsorted(row, [low, high])
            near, cos = self.index.nearest(row[a:b] - low, term[a:b], x[a:b], high - low, self.k)
            own = self._votes(near, cos)
            for i, v in zip(range(low, high), own):
                if best[of[i]] < 0 or v > vote[of[i]]:
                    vote[of[i]], best[of[i]] = v, i
                    if evidence:
                        proof[of[i]] = [(self.ids[self.owner[r]], float(c)) for r, c in zip(near[i - low, :evidence], cos[i - low, :evidence]) if c > 0]
        return 1 / (1 + np.exp(-self._features(vote, parts) @ self.curve)), proof


def _logistic(features: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted logistic curve by Newton steps, with Platt's targets and a slight ridge; the vote never counts against toxicity."""
    p, q = float(labels.sum()), float((1 - labels).sum())
    target = np.where(labels > 0, (p + 1) / (p + 2), 1 / (q + 2))
    w = weights * len(weights) / weights.sum()
    ridge = np.diag([1e-6, 1e-2, 1.0])
    b = np.array([0.0, 1.0, 0.0])
    for _ in range(50):
        z = 1 / (1 + np.exp(-np.clip(features @ b, -30, 30)))
        step = np.linalg.solve((features * (w * np.maximum(z * (1 - z), 1e-6))[:, None]).T @ features + ridge, features.T @ (w * (target - z)) - ridge @ b)
        b = b + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return b if b[1] > 0 else np.array([np.log(p / q), 0.0, 0.0])


def frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """In how many texts each term number occurs, and the number of texts; of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums, rows = Terms(), np.zeros(TERMS + 1, dtype=np.int64), 0
        for batch in slices(batches, "text_"):
            found = terms_of(batch.column("text_").to_pylist(), known)
            rows += len(found)
            sums[:TERMS] += np.bincount(np.concatenate([np.unique(t) for t in found]), minlength=TERMS) if found else 0
        sums[TERMS] = rows
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["term_", "n_"])

    made = docs.select(F.col(text).alias("text_")).mapInArrow(run, "term_ bigint, n_ bigint").groupBy("term_").agg(F.sum("n_").alias("n_")).toArrow()
    sums = np.zeros(TERMS + 1, dtype=np.int64)
    sums[made.column("term_").to_numpy()] = made.column("n_").to_numpy()
    return sums[:TERMS], int(sums[TERMS])


def sampled(labels: DataFrame, key: str, label: str) -> DataFrame:
    """One row for each labelled id that may be learnt from, sampled by a hash of the id, with the weight that makes up for it: key_, label_, weight_."""
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & (crc_of_id(F.col(key)) % 5 != 0)).groupBy(F.col(key).alias("key_")).agg(F.max(F.col(label).cast("int")).alias("label_")).filter("label_ in (0, 1)")
    counts = {r.label_: r["count"] for r in known.groupBy("label_").count().collect()}
    share = {y: min(1.0, most / max(1, counts.get(y, 0))) for y, most in ((1, MAX_TOXIC), (0, MAX_CLEAN))}
    h = F.pmod(F.xxhash64("key_", F.lit(3)), F.lit(1 << 20))
    of = lambda y, v: F.when(F.col("label_") == 1, v(share[1])).otherwise(v(share[0]))
    return known.filter(h < of("label_", lambda s: int(s * (1 << 20)) + 1)).withColumn("weight_", of("label_", lambda s: 1 / s))


def example_passages(texts: DataFrame) -> DataFrame:
    """Passages of labelled texts (key_, text_, label_, weight_): key_, label_, weight_, digest_ of all terms, part_, terms_, counts_."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Terms()
        for batch in slices(batches, "text_"):
            found = terms_of(batch.column("text_").to_pylist(), known)
            of, row, term, count = passages(found)
            cut = np.searchsorted(row, np.arange(len(of) + 1))
            lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x)) for x in (term, count)]
            digests = [hashlib.blake2b(t.tobytes(), digest_size=16).digest() for t in found]
            part = np.arange(len(of)) - np.searchsorted(of, of)
            at = pa.array(of)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("key_", "label_", "weight_")), pa.array(digests, pa.binary()).take(at), pa.array(part), *lists], ["key_", "label_", "weight_", "digest_", "part_", "terms_", "counts_"])

    kind = texts.schema["key_"].dataType.simpleString()
    return texts.select("key_", "label_", "weight_", "text_").mapInArrow(run, f"key_ {kind}, label_ int, weight_ double, digest_ binary, part_ bigint, terms_ array<bigint>, counts_ array<bigint>")


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Model:
    """The model: idf over all documents, examples from the labelled ones that aren't held out."""
    chosen = materialize(sampled(labels, key, label), "toxicity-sample")
    texts = docs.select(F.col(key).alias("key_"), F.col(text).alias("text_")).join(F.broadcast(chosen), "key_")  # about MAX_TOXIC + MAX_CLEAN rows
    made = materialize(example_passages(texts), "toxicity-passages")
    share = min(1.0, MAX_PASSAGES / max(1, made.count()))
    some = made.filter(F.pmod(F.xxhash64("key_", "part_", F.lit(5)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy("key_", "digest_", "part_").collect()
    df, total = frequencies(docs, text)
    idf = np.log(1 + total / (1 + df))
    # Texts of the same terms and label count once; the weights of a repeated id aren't summed.
    stays: dict[tuple, int] = {}
    weights: dict[int, dict] = {}
    number: dict[tuple, int] = {}
    examples: list[tuple] = []
    row, term, count, owner = [], [], [], []
    parts: set[tuple[int, int]] = set()
    for r in some:
        same = (r.digest_, r.label_)
        if same not in stays:
            stays[same] = len(examples)
            examples.append((r.key_, r.label_))
        i = stays[same]
        weights.setdefault(i, {})[r.key_] = r.weight_
        if number.setdefault(same, r.key_) == r.key_ and (i, r.part_) not in parts:
            parts.add((i, r.part_))
            term.append(np.array(r.terms_, dtype=np.int64))
            count.append(np.array(r.counts_, dtype=np.int64))
            row.append(np.full(len(r.terms_), len(owner)))
            owner.append(i)
    discard(chosen, made)
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return Model(idf, [(k, y, sum(weights[i].values())) for i, (k, y) in enumerate(examples)], cat(row), cat(term), cat(count), np.array(owner, dtype=np.int64))


def keep_clean(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows that score below the threshold, with all their columns; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample of examples and TERMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = shared.value, Terms()
        for batch in slices(batches, text):
            scores, _ = own.score(terms_of(batch.column(text).to_pylist(), known))
            yield batch.filter(pa.array(scores < threshold))

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id", evidence: int = 5) -> DataFrame:
    """doc_id, score and evidence (id and cosine of examples) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = shared.value, Terms()
        for batch in slices(batches, "text_"):
            scores, proof = own.score(terms_of(batch.column("text_").to_pylist(), known), evidence)
            told = pa.array([[{"id": i, "cosine": c} for i, c in p] for p in proof], pa.list_(pa.struct([("id", batch.schema.field("key_").type), ("cosine", pa.float64())])))
            yield pa.RecordBatch.from_arrays([batch.column("key_"), pa.array(scores, pa.float64()), told], [key, "score", "evidence"])

    return docs.select(F.col(key).alias("key_"), F.col(text).alias("text_")).mapInArrow(run, f"`{key}` {kind}, score double, evidence array<struct<id:{kind},cosine:double>>")


def held_out(key: str = "doc_id") -> Column:
    return crc_of_id(F.col(key)) % 5 == 0


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence for each row."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
