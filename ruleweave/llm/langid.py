"""Operator 7: languages of texts, mixed ones too.

The script of a word, that of most of its letters, narrows its candidate languages: only those stay of which at least
MIN_SCRIPT of the training letters are in that script. Each word gets a naive Bayes score for each candidate from hashed
character n-grams, and Viterbi with a penalty for switching labels the words, so that a text falls
into spans of one language. The text's language is the one that holds most letters; the score is its
share of them.

Null texts, texts without letters and texts with more than half of their letters in scripts of no learned
language are `und` with score 0. A language that was not learned, in a script that was, is not told from the learned ones. Ties go to the language first by name. With no training
rows every text is `und`. Repeated rows and ids are predicted each for themselves. An empty table gives no rows. A very long text is a slice of its own; where no stretch of it
speaks for another language by more than half a switch, as in any text of one language, one pass over its scores proves the single label best, else Viterbi takes a step a word.
Other columns of the input are never read, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleweave.llm.common import crc_of_id, slices

#: Training rows taken (about, by a hash of the id) of all languages together, and the least of each that has so many; n-gram buckets; nats for a switch.
MAX_TRAIN, LEAST_TRAIN, BUCKETS, SWITCH, MIN_SCRIPT = 12_000, 500, 1 << 16, 12.0, 0.02
#: Words that a task keeps with their scores, and characters in a slice, for up to 64 languages; see _bounds. Nats by which a barred language loses a word.
CACHE_WORDS, CHARS, BARRED = 200_000, 2_000_000, 1e6
#: Characters of words whose n-grams are held at once: they take some 200 bytes a character.
FEATURE_CHARS = 100_000
UNKNOWN = "und"
_STARTS, _SCRIPTS = np.array([0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0x980, 0xA00, 0xE00, 0xE80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3100, 0x3130, 0x3190, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0xFB50, 0xFE00, 0x20000]), np.array([0, 1, 2, 3, 4, 5, 3, 6, 7, 3, 8, 3, 3, 9, 3, 0, 1, 0, 10, 11, 9, 11, 11, 3, 9, 3, 11, 0, 5, 0, 11])
N_SCRIPTS = 12  # Latin, Greek, Cyrillic, other, Hebrew, Arabic, Devanagari, Bengali, Thai, Hangul, kana, Han


def _bounds(k: int) -> tuple[int, int]:
    """CACHE_WORDS and CHARS for k languages, so that memory doesn't grow with them."""
    return CACHE_WORDS * 64 // max(64, k), CHARS * 64 // max(64, k)


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words' n-grams (1 to 4 characters, spaces around): bucket and owner; each word's letters and script."""
    cleaned = [" ".join("".join([c if c.isalpha() else " " for c in w]).split()) if not w.isalpha() else w for w in words]
    joined = " " + "  ".join(cleaned) + "  "
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.array([len(w) for w in cleaned], dtype=np.int64)
    owner = np.full(len(code), -1, dtype=np.int64)
    inner = np.repeat(np.arange(len(words)), lengths + 2)
    owner[: len(inner)] = inner  # a word owns the space before and after it
    space = code == 32
    buckets, owners = [], []
    h = np.zeros(len(code), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, 5):
            m = len(code) - n + 1
            if m <= 0:
                break
            h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + (code[n - 1 :] + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
            ok = (owner[:m] >= 0) & (owner[:m] == owner[n - 1 :][:m])
            if n == 1:
                ok &= ~space
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            buckets.append(((mixed >> np.uint64(33)) % np.uint64(BUCKETS)).astype(np.int64)[ok])
            owners.append(owner[:m][ok])
    letters = np.array([len(w) - w.count(" ") for w in cleaned], dtype=np.int64)
    scripts = np.zeros(len(words), dtype=np.int64)
    far = np.flatnonzero((code >= _STARTS[1]) & (owner >= 0))  # letters beyond Latin
    if len(far):
        at, own = np.unique(owner[far], return_inverse=True)
        by = np.bincount(own * N_SCRIPTS + _SCRIPTS[np.searchsorted(_STARTS, code[far].astype(np.int64), side="right") - 1], minlength=len(at) * N_SCRIPTS).reshape(-1, N_SCRIPTS)
        by[:, 0] += letters[at] - by.sum(1)
        scripts[at] = by.argmax(1)
    return np.concatenate(buckets) if buckets else np.zeros(0, np.int64), np.concatenate(owners) if owners else np.zeros(0, np.int64), letters, scripts


def _stretches(words: list[str]) -> Iterator[slice]:
    """Stretches of the words of about FEATURE_CHARS characters (one longer word is one)."""
    begin = held = 0
    for i, w in enumerate(words):
        if i > begin and held + len(w) > FEATURE_CHARS:
            yield slice(begin, i)
            begin, held = i, 0
        held += len(w)
    if begin < len(words):
        yield slice(begin, len(words))


class Model:
    """Log-probabilities of n-gram buckets for each language, and the scripts in which it is written."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        total = counts.sum(1, keepdims=True)
        self.logs = np.log((counts + 0.2) / (total + 0.2 * BUCKETS)).T.astype(np.float32).copy()
        share = scripts / np.maximum(1, scripts.sum(1, keepdims=True))
        self.allowed = (share >= MIN_SCRIPT).T  # script x language
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.langs)), dtype=np.float32)
        self.letters = np.zeros(0, dtype=np.int64)
        self.strange = np.zeros(0, dtype=np.int64)

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        scores, letters, strange = np.zeros((len(words), len(self.langs)), dtype=np.float32), np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        for some in _stretches(words):
            scores[some], letters[some], strange[some] = self._score(words[some])
        return scores, letters, strange

    def _score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        buckets, owners, letters, scripts = _features(words)
        n, k = len(words), len(self.langs)
        out = np.zeros((n, k), dtype=np.float32)
        for j in range(k):
            out[:, j] = np.bincount(owners, weights=self.logs[buckets, j], minlength=n)
        allowed = self.allowed[scripts]
        some = allowed.any(1)
        out[~allowed & some[:, None]] = -np.inf
        out -= out.max(1, keepdims=True) if k else 0
        out[np.isneginf(out)] = -BARRED
        out[~some | (letters == 0)] = 0
        return out, letters, np.where(some, 0, letters)

    def lookup(self, texts: Iterable[list[str]]) -> list[np.ndarray]:
        """Numbers of the texts' words; new words are scored together. Of the texts, one after another, only new words are held."""
        if len(self.ids) > _bounds(len(self.langs))[0]:
            self.clear()
        ids = self.ids
        new: list[str] = []
        found = []
        for words in texts:
            for w in set(words).difference(ids):
                ids[w] = len(ids)
                new.append(w)
            found.append(np.fromiter(map(ids.__getitem__, words), dtype=np.int64, count=len(words)))
        if new:
            scores, letters, strange = self.score(new)
            self.scores, self.letters, self.strange = np.concatenate([self.scores, scores]), np.concatenate([self.letters, letters]), np.concatenate([self.strange, strange])
        return found

    def label(self, texts: Iterable[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Language of every word of every text, the texts' lengths in words, the letters of each language in each text, and whether a text has letters, at least half of them in scripts of learned languages."""
        found = self.lookup(texts)
        lengths = np.array([len(x) for x in found], dtype=np.int64)
        flat = np.concatenate([np.zeros(0, np.int64), *found])
        label = best_labels(self.scores[flat], lengths)
        n, k = len(found), len(self.langs)
        doc = np.repeat(np.arange(n), lengths)
        by = np.bincount(doc * k + label, weights=self.letters[flat], minlength=n * k).reshape(n, k)
        total = by.sum(1)
        return label, lengths, by, (total > 0) & (2 * np.bincount(doc, weights=self.strange[flat], minlength=n) <= total)


def best_labels(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """As viterbi, but texts in which no stretch gains more than half a switch over the best single label keep that label without a step a word: any path with other labels then loses."""
    n, total = len(lengths), int(lengths.sum())
    filled = np.flatnonzero(lengths)
    if not total or scores.shape[1] < 2:
        return np.zeros(total, dtype=np.int64)
    doc = np.repeat(np.arange(n), lengths)
    starts = (np.cumsum(lengths) - lengths)[filled]
    best = np.zeros(n, dtype=np.int64)
    best[filled] = np.add.reduceat(scores, starts, axis=0, dtype=np.float64).argmax(1)
    own = scores[np.arange(total), best[doc]].astype(np.float64)
    gain = np.zeros(n)
    for j in range(scores.shape[1]):
        run = np.cumsum(scores[:, j] - own)
        before = np.concatenate([[0.0], run[:-1]])
        step = 1 + 2 * float(np.abs(run).max())  # sinks a text's sums below those of the texts before it, so that the least so far is its own
        least = np.minimum.accumulate(before - doc * step) + doc * step
        gain[filled] = np.maximum(gain[filled], np.maximum.reduceat(run - least, starts))
    hard = np.flatnonzero(gain > switch / 2 - 0.1)  # less what rounding may hide
    label = best[doc]
    if len(hard):
        some = np.isin(doc, hard)
        label[some] = viterbi(scores[some], lengths[hard], switch)
    return label


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of each row for texts one after another; all texts advance together, one word a step."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    rank = np.empty(len(lengths), dtype=np.int64)
    rank[order] = np.arange(len(lengths))
    longest = int(lengths.max())
    active = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(longest), side="right")  # texts with a word at each step
    begin = np.concatenate([[0], np.cumsum(active)])
    position = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = begin[position] + np.repeat(rank, lengths)  # by step, then by text
    s = np.empty_like(scores)
    s[place] = scores
    stay = np.ones(s.shape, dtype=bool)
    came = np.zeros(total, dtype=np.int16)
    v = s[: active[0]].copy()
    last = [(int(active[0]), v)]
    ends = np.zeros(len(lengths), dtype=np.int64)
    for t in range(1, longest):
        a, b = begin[t], begin[t + 1]
        n = b - a
        if n < len(v):
            ends[n : len(v)] = v[n:].argmax(1)
            v = v[:n]
        best = v.argmax(1)
        floor = (v[np.arange(n), best] - switch)[:, None]
        np.greater_equal(v, floor, out=stay[a:b])
        came[a:b] = best
        v = np.maximum(v, floor) + s[a:b]
    ends[: len(v)] = v.argmax(1)
    del last
    label = np.empty(total, dtype=np.int64)
    now = ends
    for t in range(longest - 1, -1, -1):
        a, b = begin[t], begin[t + 1]
        own = now[: b - a]
        label[a:b] = own
        if t:
            now[: b - a] = np.where(stay[a:b][np.arange(b - a), own], own, came[a:b])
    return label[place]


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def fit(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """Learn from the rows that train marks: about MAX_TRAIN of them by a hash of the id, but about LEAST_TRAIN of each language that has so many, and else all of it."""
    known = docs.filter(train & F.col(lang).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(lang).agg(F.count(F.lit(1)).alias("n_")).collect()}  # a row for each language
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((0, BUCKETS)), np.zeros((0, N_SCRIPTS)))
    common = MAX_TRAIN / sum(counts.values())
    below = F.broadcast(docs.sparkSession.createDataFrame([(x, int(min(1.0, max(common, LEAST_TRAIN / n)) * (1 << 20)) + 1) for x, n in counts.items()], "of_ string, below_ int").coalesce(1))
    hashed = known.select(F.col(text).alias("text_"), F.col(lang).alias("lang_"), F.pmod(F.xxhash64(F.col(key), F.lit(1)), F.lit(1 << 20)).alias("h_"))
    chosen = hashed.join(below, (F.col("lang_") == F.col("of_")) & (F.col("h_") < F.col("below_"))).select("text_", "lang_")
    at = {x: i for i, x in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for x, own in sums.items():
                bucket = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bucket), x, np.int32)), pa.array(bucket.astype(np.int32)), pa.array(own[bucket])], ["lang_", "bucket_", "n_"])
            sums.clear()

        for batch in slices(batches, "text_"):
            by: dict[int, dict[str, int]] = {}
            for t, x in zip(batch.column("text_").to_pylist(), batch.column("lang_").to_pylist()):
                own = by.setdefault(at[x], {})
                for w in words_of(t):
                    own[w] = own.get(w, 0) + 1
            for x, own in by.items():
                if x not in sums:
                    if len(sums) >= 64:
                        yield from told()
                    sums[x] = np.zeros(BUCKETS + N_SCRIPTS, dtype=np.int64)
                words, counted = list(own), np.array(list(own.values()), dtype=np.int64)
                for some in _stretches(words):
                    times = counted[some]
                    buckets, owners, letters, scripts = _features(words[some])
                    sums[x][:BUCKETS] += np.bincount(buckets, weights=times[owners], minlength=BUCKETS).astype(np.int64)
                    sums[x][BUCKETS:] += np.bincount(scripts, weights=letters * times, minlength=N_SCRIPTS).astype(np.int64)
        yield from told()

    rows = chosen.mapInArrow(count, "lang_ int, bucket_ int, n_ bigint").groupBy("lang_", "bucket_").agg(F.sum("n_").alias("n_"))
    table = rows.toArrow()  # at most BUCKETS + N_SCRIPTS rows a language
    sums = np.zeros((len(langs), BUCKETS + N_SCRIPTS), dtype=np.float32)
    if table.num_rows:
        sums[table.column("lang_").to_numpy(), table.column("bucket_").to_numpy()] = table.column("n_").to_numpy()
    return Model(langs, sums[:, :BUCKETS].astype(float) if len(langs) <= 64 else sums[:, :BUCKETS], sums[:, BUCKETS:])


def predict(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id", with_spans: bool = False) -> DataFrame:
    """doc_id, held_out_, lang_pred, score for each row; with_spans adds spans (language, first word, end word)."""
    model.clear()
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # BUCKETS * 4 bytes a language
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, lang_pred string, score double" + ", spans array<struct<lang:string,begin:bigint,end:bigint>>" * with_spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(shared.value)  # a task's own: what it keeps goes with it
        k = len(own.langs)
        for batch in slices(batches, "text_", _bounds(k)[1]):
            n = len(batch)
            preds, scores, spans = [UNKNOWN] * n, np.zeros(n), [[] for _ in range(n)]
            if k and n:
                label, lengths, by, known = own.label(map(words_of, batch.column("text_").to_pylist()))
                best = by.argmax(1)
                preds = [own.langs[b] if y else UNKNOWN for b, y in zip(best, known)]
                scores = np.where(known, by[np.arange(n), best] / np.maximum(by.sum(1), 1), 0.0)
                if with_spans:
                    ends = np.cumsum(lengths)
                    for i, (e, m) in enumerate(zip(ends, lengths)):
                        l = label[e - m : e]
                        cut = [0, *(np.flatnonzero(np.diff(l)) + 1).tolist(), int(m)] if m else []
                        spans[i] = [{"lang": own.langs[l[a]], "begin": a, "end": b} for a, b in zip(cut, cut[1:])]
            out = [batch.column("key_"), pa.array(preds, pa.string()), pa.array(scores, pa.float64())]
            names = [key, "lang_pred", "score"]
            if with_spans:
                out.append(pa.array(spans, pa.list_(pa.struct([("lang", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(out, names)

    return docs.select(F.col(key).alias("key_"), F.col(text).alias("text_")).mapInArrow(run, schema)


def keep_known(docs: DataFrame, model: Model, least: float = 0.0, text: str = "text") -> DataFrame:
    """The rows whose text has a known language that holds at least a share of its letters, with all their columns; nothing is shuffled."""
    model.clear()
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(shared.value)  # a task's own: what it keeps goes with it
        k = len(own.langs)
        for batch in slices(batches, text, _bounds(k)[1]):
            keep = np.zeros(len(batch), dtype=bool)
            if k and len(batch):
                _, _, by, known = own.label(map(words_of, batch.column(text).to_pylist()))
                keep = known & (by.max(1) >= least * by.sum(1))
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def held_out(key: str = "doc_id") -> Column:
    return crc_of_id(F.col(key)) % 3 == 1


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the rows that aren't held out, then predict all."""
    model = fit(docs, ~held_out())
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
