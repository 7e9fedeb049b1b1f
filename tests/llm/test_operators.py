"""Each operator against brute force on small tables with nulls, empty and long texts, repeats and clashing columns."""

import hashlib
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ruleweave.llm import ann, bpe, common, exact, html, langid, licenses, minhash, packing, registry, sharding, toxicity

DATA = "/root/testdata/sf0.001"
NAMES = ("id_", "text_", "key_", "n_", "set_", "sha_", "salt_", "root_", "kept", "shard", "score")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [None, "", " ", "\n\t", "one", "One two", "a  b\n\nc", "ﬁ ² ½ 中文 字 русский 😀", "x<|endoftext|>y <|startoftext|>", "it's I'LL 3.14", "é é ñ", "q" * 400, "word " * 30_000, "ΣΑΣ İ", " a b", "a\x1cb", " lead", "trail ", "\r\nx \r\n y"]


def words(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    out = [(i, t) for i, t in enumerate(ODD)]
    base = [words(r, r.randrange(8, 90)) for _ in range(12)]
    for b in base:
        for _ in range(r.randrange(1, 6)):
            w = b.split()
            for _ in range(r.randrange(0, 3)):
                w[r.randrange(len(w))] = f"v{r.randrange(99)}"
            out.append((len(out), "  ".join(w) if r.random() < 0.3 else " ".join(w)))
    out += [(len(out) + i, out[20][1]) for i in range(8)]
    out += [out[3], out[25], out[25], (None, "lost one here now and then"), (None, None), (None, out[25][1])]
    return out


def clash():
    """Extra columns with names that operators use inside."""
    return {c: F.lit("x") for c in NAMES}


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3).withColumns(clash())


@pytest.fixture(scope="module")
def docs(spark, rows):
    return docs_of(spark, rows)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize("percent", [85, 50])
def test_near_duplicates(docs, rows, percent, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(minhash, "GROUP", 20)
    given = [(i, plain_set(t)) for i, t in rows]
    parent = list(range(len(given)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(given):
        for b, (j, y) in enumerate(given[:a]):
            if x and y and i is not None and j is not None and 100 * len(x & y) >= percent * len(x | y):
                parent[find(a)] = find(b)
    low = defaultdict(list)
    for a, (i, _) in enumerate(given):
        if i is not None:
            low[find(a)].append(i)
    want = Counter((i, len(x), min(low[find(a)]) if i is not None else None, i is None or i == min(low[find(a)])) for a, (i, x) in enumerate(given))
    got = Counter(map(tuple, minhash.near_duplicates(docs, percent).select("doc_id", "n_shingles", "component_id", "kept").collect()))
    if percent == 85:
        assert got == want
    else:  # bands meet almost all pairs of half similarity, not all
        assert sum((got & want).values()) >= 0.7 * len(rows)


def test_hot_bucket_pairs_cross_blocks(spark):
    r = random.Random(1)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[: r.randrange(100)] + [f"x{i}"] + base[r.randrange(100, 101) :])) for i in range(3)] + [(10 + i, " ".join([*base, *[f"t{i}"]])) for i in range(40)]
    got = minhash.near_duplicates(docs_of(spark, rows)).filter("doc_id >= 10").select("component_id").distinct().collect()
    assert [x[0] for x in got] == [10]


def test_filters_at_their_ends(spark, monkeypatch):
    monkeypatch.setattr(common, "MOST_BITS", 1 << 15)  # one part; places 1 and 32768 are its ends
    ids = spark.range(300_000).filter(F.pmod(F.xxhash64("id"), F.lit(1 << 15)).isin(0, (1 << 15) - 1))
    assert ids.count() > 4
    wanted = ids.filter("id < 40000")
    keys = {r.id for r in wanted.collect()}
    passing = common.Passing(wanted, F.xxhash64("id"))
    rows = spark.range(40_000).select("id", F.xxhash64("id").alias("h")).toPandas()
    through = set(rows["id"][passing(rows["h"].to_numpy())])
    assert keys and keys <= through and len(through) < 40
    assert keys <= {r.id for r in common.may_match(spark.range(40_000), F.col("id"), wanted, F.col("id")).filter("maybe_").collect()}


def test_recall_on_a_whole_table(spark):
    """All links of sf0.01, by counting common shingles, against those found."""
    docs = spark.read.parquet(DATA.replace("0.001", "0.01") + "/documents.parquet")
    rows = [(r.doc_id, plain_set(r.text)) for r in docs.select("doc_id", "text").collect()]
    parent, owners = {i: i for i, _ in rows}, defaultdict(list)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    size = {i: len(s) for i, s in rows}
    for i, s in rows:
        both = Counter(j for x in s for j in owners[x])
        for j, n in both.items():
            if 100 * n >= 85 * (size[i] + size[j] - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for x in s:
            owners[x].append(i)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, 85).collect()}
    assert sum(got[i] == find(i) for i, _ in rows) >= 0.99 * len(rows)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(71, 72), (72, 71)], "a_ bigint, b_ bigint")
    assert {r.node_: r.root_ for r in minhash.components(links).collect()} == {i: 0 for i in range(31)} | {71: 71, 72: 71}


@pytest.mark.parametrize("cell", [40, 100_000])
def test_nearest(spark, cell, monkeypatch):
    monkeypatch.setattr(ann, "CELL", cell)
    rng = np.random.default_rng(3)
    v = rng.standard_normal((700, 16)).round(2)
    v[50:120] = v[50]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (1000, [0.0] * 16), (1001, [1.0, None] + [0.0] * 14), (1002, [float("nan")] + [1.0] * 15), (1100, [1.0] * 15), (None, v[0].tolist()), (7, v[8].tolist())]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumns({"id_": F.lit(1), "vec_": F.lit(2), "cell_": F.lit(3)})
    got = defaultdict(list)
    for r in ann.search(table).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got[r.query_id]) + 1
        got[r.query_id].append((r.score, r.vec_id))
    f = {i: np.array(x, dtype=np.float32).astype(float) for i, x in rows[:700]}
    pairs = [*f.items(), (7, f[8])]
    assert set(got) == {i for i in f if i % 100 == 0}
    hits = 0
    for q, found in got.items():
        best = sorted((float(np.sqrt(((x - f[q]) ** 2).sum())), i) for i, x in pairs if i != q)[:10]
        hits += len({i for _, i in found} & {i for _, i in best})
        assert len(found) == 10 and [x[0] for x in found] == sorted(x[0] for x in found)
        for s, i in found:
            assert i == 7 or s == pytest.approx(float(np.sqrt(((f[i] - f[q]) ** 2).sum())), rel=1e-12)
    assert hits >= 0.9 * 10 * len(got)


@pytest.mark.parametrize("groups, least", [(1, 0.2), (40, 0.9)])
def test_points_are_left_out(groups, least):
    """Shares of points that are never verified, and recall: without any structure, and in groups."""
    rng = np.random.default_rng(5)
    v = 3 * rng.standard_normal((groups, 64))[rng.integers(0, groups, 8_000)] + rng.standard_normal((8_000, 64))
    matrix = ann.directions(64)
    tree, hits = ann.Tree(v @ matrix), 0
    reach = np.sqrt(ann.chi2_point(ann.CONFIDENCE))
    for i in range(60):
        got = tree.nearest(v[i], v[i] @ matrix, v, np.arange(8_000), i, 10, np.inf, reach)
        true = np.sqrt(((v - v[i]) ** 2).sum(1))
        true[i] = np.inf
        hits += len({j for _, j in got} & set(np.argsort(true)[:10].tolist()))
        assert all(d == true[j] for d, j in got)
    assert hits >= 0.95 * 600 and tree.skipped >= least * (tree.skipped + tree.verified)


def test_recall_on_a_whole_table_of_vectors(spark):
    rows = spark.read.parquet(DATA.replace("0.001", "0.1") + "/embeddings.parquet")
    v = {r.vec_id: np.array(r.embedding, dtype=float) for r in rows.collect() if r.embedding}
    ids, m = np.array(list(v)), np.stack(list(v.values()))
    got = defaultdict(set)
    for r in ann.search(rows).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((m - v[q]) ** 2).sum(1))
        d[ids == q] = np.inf
        hits += len(found & set(ids[np.argsort(d)[:10]].tolist()))
    assert len(got) == sum(i % 100 == 0 for i in v) and hits >= 0.9 * 10 * len(got)


def test_few_vectors(spark):
    t = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 0.0])], "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in ann.search(t).collect()] == [(0, 1, 1, 2.0)]
    assert ann.search(t.filter("false")).count() == 0 and ann.search(t.filter("vec_id = 0")).count() == 0


def test_chi_square():
    assert ann.chi2_cdf(np.array(ann.chi2_point(0.9))) == pytest.approx(0.9) and ann.chi2_point(0.95) == pytest.approx(36.415, abs=1e-3)


def passages_of(r, n, vocabulary):
    """Passages that share frequent terms, as row, term, weight and as a matrix."""
    made = np.zeros((n, vocabulary))
    for i in range(n):
        for w in r.choices(range(vocabulary), [1 / (v + 1) for v in range(vocabulary)], k=25):
            made[i, w] += r.random() + 0.1
    made /= np.sqrt((made**2).sum(1))[:, None]
    row, term = np.nonzero(made)
    return row, term, made[row, term], made


@pytest.mark.parametrize("common_terms", [0, 8, 500])
def test_block_max_is_exact(common_terms):
    r = random.Random(2)
    row, term, x, docs = passages_of(r, 900, 300)
    index = toxicity.Index(row, term, x, 900, common_terms)
    row, term, x, queries = passages_of(r, 40, 300)
    barred = (np.array([0, 1]), np.array([5, 7]))
    near, cos = index.nearest(row, term, x, 40, 10, barred)
    want = queries @ docs.T
    want[barred] = 0
    for i in range(40):
        assert cos[i] == pytest.approx(np.sort(want[i])[::-1][:10], abs=2e-6)
        assert want[i][near[i]] == pytest.approx(cos[i], abs=2e-6)


def test_blocks_stay_closed():
    """Of passages in groups of their own words, only blocks of the query's group are opened."""
    row, term, x = [], [], []
    for i in range(1_280):
        for w in range(8):
            row.append(i), term.append(100 * (i % 10) + (w * (1 + i % 7)) % 90 if w else 100 * (i % 10)), x.append(1.0)
    row, term, x = np.array(row), np.array(term), np.array(x) / np.sqrt(8)
    index = toxicity.Index(row, term, x, 1_280, 60)
    index.nearest(row[:80], term[:80], x[:80], 10, 5)
    assert index.opened < 0.5 * index.met


def test_whole_texts_against_all_examples(spark):
    """Every passage of every text meets all passages of all examples: votes and evidence as by brute force."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    texts = [r.text for r in docs.select("text").collect()]
    known = toxicity.Terms()
    found = toxicity.terms_of(texts, known)
    assert sum(map(len, found)) >= sum(len((t or "").split()) for t in texts) * 0.9
    df = Counter(t for f in found for t in set(f.tolist()))
    for t in list(df)[:500]:
        assert model.idf[t] == pytest.approx(np.log(1 + len(texts) / (1 + df[t])))
    scores, proof = model.score(found, 5)
    assert all(p or not len(f) for p, f in zip(proof, found)) and ((scores >= 0) & (scores <= 1)).all()
    matrix = np.zeros((model.rows, toxicity.TERMS), dtype=np.float32)
    examples = {r.doc_id: r.text for r in docs.filter(F.col("doc_id").isin(model.ids)).collect()}
    row = 0
    for i in model.ids:
        of, r, term, count = toxicity.passages(toxicity.terms_of([examples[i]], known))
        matrix[row + r, term] = toxicity.weigh(r, term, count, len(of), model.idf)
        row += len(of)
    assert row == model.rows
    for f in found[:40]:
        of, r, term, count = toxicity.passages([f])
        if len(of):
            own = np.zeros((len(of), toxicity.TERMS), dtype=np.float32)
            own[r, term] = toxicity.weigh(r, term, count, len(of), model.idf)
            want = np.sort(own @ matrix.T, axis=1)[:, ::-1][:, : model.k]
            _, cos = model.index.nearest(r, term, own[r, term], len(of), model.k)
            assert cos == pytest.approx(want, abs=3e-6)


def test_terms_are_those_of_plain_python(rows):
    """Terms cut from arrays of code points are those of each text's words, one by one."""
    r = random.Random(9)
    letters = "ab1_ -é中\x1c Σİ²\ud800𐐀.́\0"
    texts = [t for _, t in rows] + ["x" * 24, "x" * 25, "x" * 26 + " y", "中文" * 30 + " 中", "𝔘𝔫𝔦𝔠𝔬𝔡𝔢 𐐀𐐁b", "a\0b\0", "\0", "end", None]
    texts += ["".join(r.choice(letters) for _ in range(r.randrange(200))) for _ in range(300)]
    texts += ["".join("k" if r.random() < 0.94 else r.choice(letters) for _ in range(r.randrange(200))) for _ in range(300)]

    def plain(t):
        words = "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
        stems = [s for w in words for s in ([w[: toxicity.STEM]] if len(w) <= toxicity.LONG else [w[k : k + toxicity.STEM] for k in range(0, len(w), toxicity.STEM)])]
        return [toxicity.xxhash.xxh32_intdigest(s.encode()) % toxicity.TERMS for s in stems]

    assert [t.tolist() for t in toxicity.terms_of(texts, toxicity.Terms())] == [plain(t) for t in texts]
    for few in ([], [None], ["", "a"], ["𐐀"], ["a", None]):
        assert [t.tolist() for t in toxicity.terms_of(few, toxicity.Terms())] == [plain(t) for t in few]


def test_terms_cost_by_stems(monkeypatch):
    """Words that differ after their stem, or in the marks around them, are hashed once: the cost of a text isn't that of its distinct words."""
    hashed, plain = [], toxicity.xxhash.xxh32_intdigest
    monkeypatch.setattr(toxicity.xxhash, "xxh32_intdigest", lambda b: hashed.append(b) or plain(b))
    texts = [" ".join(f"st{i % 50:02}x{k}i{i}," for i in range(1_000)) for k in range(20)]
    found = toxicity.terms_of(texts, toxicity.Terms())
    assert [len(t) for t in found] == [1_000] * 20 and len(set(np.concatenate(found).tolist())) == 50
    assert len(hashed) == 50


def test_scores_are_calibrated(spark):
    """On held-out rows of sf0.1: mean score and rate of toxic ones agree in low, middle and high scores."""
    d = DATA.replace("0.001", "0.1")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.toxicity(spark.read.parquet(f"{d}/documents.parquet"), labels).filter("held_out").join(labels, "doc_id").select("score", "toxic", "predicted").toPandas()
    toxic, clean = got[got.toxic == 1], got[got.toxic == 0]
    assert (toxic.predicted == 1).mean() >= 0.85 and (clean.predicted == 1).mean() <= 0.01
    for low, high in ((0, 0.2), (0.2, 0.8), (0.8, 1.01)):
        part = got[(got.score >= low) & (got.score < high)]
        assert abs(part.score.mean() - part.toxic.mean()) <= 0.02 + 3 * np.sqrt(0.25 / len(part))  # three standard errors at most
    assert ((got.score - got.toxic) ** 2).mean() < 0.03


def test_toxicity(spark):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        w = words(r, 60).split()
        for _ in range(3 * toxic):
            w.insert(r.randrange(60), r.choice(["scum", "Idiot!", "trash,"]))
        rows.append((i, " ".join(w)))
        if i % 4:
            labels.append((i, 1, int(toxic)))
    labels += [(None, 1, 1), (5, 1, None), (9_999, 0, 1), labels[0]]
    rows += [(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "scum"), rows[1]]
    l = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = toxicity.toxicity(docs_of(spark, rows), l).collect()
    assert Counter(x.doc_id for x in got) == Counter(i for i, _ in rows)
    told = defaultdict(list)
    for x in got:
        assert 0 <= x.score <= 1 and x.predicted == (x.score >= 0.5)
        if x.doc_id is not None:
            assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0)
            told[x.doc_id % 6 == 0 and x.doc_id < 600].append(x.predicted)
    assert np.mean(told[True]) >= 0.8 and np.mean(told[False]) <= 0.02
    # Labels of held-out rows don't matter.
    flipped = spark.createDataFrame([(i, q, 1 - y if i is not None and y is not None and zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, q, y in labels], "doc_id bigint, quality int, toxic int")
    assert {(x.doc_id, x.score) for x in toxicity.toxicity(docs_of(spark, rows), flipped).collect()} == {(x.doc_id, x.score) for x in got}


@pytest.mark.parametrize("every, caps", [(6, (60, 60)), (6, (60, 120)), (3, (6_000, 12_000)), (2, (6_000, 12_000))])
def test_toxicity_at_any_ratio(spark, monkeypatch, every, caps):
    monkeypatch.setattr(toxicity, "MAX_TOXIC", caps[0])
    monkeypatch.setattr(toxicity, "MAX_CLEAN", caps[1])
    r = random.Random(6)
    rows = [(i, words(r, 60) + " scum idiot" * (i % every == 0)) for i in range(600)]
    labels = spark.createDataFrame([(i, 1, int(i % every == 0)) for i, _ in rows], "doc_id bigint, quality int, toxic int")
    docs = docs_of(spark, rows)
    got = {x.doc_id: x.predicted for x in toxicity.toxicity(docs, labels).collect()}
    assert np.mean([got[i] for i in got if i % every == 0]) >= 0.7 and np.mean([got[i] for i in got if i % every]) <= 0.08
    kept = toxicity.keep_clean(docs, toxicity.fit(docs, labels))
    assert {x.doc_id for x in kept.collect()} == {i for i in got if not got[i]}


def test_toxicity_without_anything(spark, empty):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert toxicity.toxicity(empty, labels).count() == 0
    assert {x.score for x in toxicity.toxicity(docs_of(spark, [(1, "a"), (2, None)]), labels).collect()} == {0.0}


def test_bpe(docs, rows):
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = Counter()
    for i, t in rows:
        e = lib.encode(t or "", add_special_tokens=False).ids
        want[(i, len(e), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in e)).hexdigest(), hashlib.sha256(lib.decode(e, skip_special_tokens=False).encode()).hexdigest())] += 1
    got = bpe.encode_decode(docs, P.path("word_bpe_49k.json"), with_ids=True).collect()
    assert Counter(tuple(r)[:4] for r in got) == want
    coder = bpe.coder_for(P.path("word_bpe_49k.json"))
    assert all(coder.decode(r.ids) == r.decoded for r in got)


def test_forced_boundaries():
    coder = bpe.coder_for(P.path("word_bpe_49k.json"))
    cuts = coder.fragments_of("qzxjqvvzq")
    assert "".join(cuts) == "qzxjqvvzq" and all((a[-1], b[0]) not in coder.joinable for a, b in zip(cuts, cuts[1:]))


def test_packing(docs, rows, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 10)
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = Counter()
    total = 0
    for i, t in rows:
        e = lib.encode(t or "", add_special_tokens=False).ids + [2]
        total += len(e)
        at = 0
        for k, n in enumerate([len(e) % 64 or 64, *[64] * ((len(e) - 1) // 64)]):
            want[(i, k, at, n, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in e[at : at + n])))] += 1
            at += n
    got = packing.pack(docs, P.path("byte_bpe_50k.json"), capacity=64).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 64
    assert len(bins) <= 1.02 * total / 64 + 8


def test_packing_never_gathers(spark, monkeypatch):
    """Documents of which no two fit together: no round is begun for them, and no group holds many bins."""
    monkeypatch.setattr(packing, "BLOCK", 20)
    seen = spark.sparkContext.accumulator(0)
    inner = packing.best_fit_decreasing

    def counted(sizes, capacity):
        if len(sizes) > 60:
            seen.add(1)
        return inner(sizes, capacity)

    monkeypatch.setattr(packing, "best_fit_decreasing", counted)
    placed = spark.range(600).select(F.col("id").alias("bin_"), F.lit(0).cast("bigint").alias("at_"), F.lit(600).cast("bigint").alias("fill_"), F.col("id").alias("k"))
    out = packing.merge_residuals(placed, 1024).collect()
    assert len({r.bin_ for r in out}) == 600 and seen.value == 0
    mixed = spark.range(600).select(F.col("id").alias("bin_"), F.lit(0).cast("bigint").alias("at_"), (F.col("id") % 7 * 100 + 50).alias("fill_"), F.col("id").alias("k"))
    out = packing.merge_residuals(mixed, 1024).collect()
    fills = defaultdict(list)
    for r in out:
        fills[r.bin_].append((r.at_, r.k % 7 * 100 + 50))
    for own in fills.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(fills) <= 1.1 * sum(i % 7 * 100 + 50 for i in range(600)) / 1024 and seen.value == 0


def test_best_fit():
    bins, offsets, fills = packing.best_fit_decreasing([5, 5, 3, 3, 2, 2], 10)
    assert fills == [10, 10] and sorted(zip(bins, offsets)) == [(0, 0), (0, 5), (1, 0), (1, 3), (1, 6), (1, 8)]
    assert packing.best_fit_decreasing([], 10) == ([], [], [])


def test_exact(docs, rows):
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    want = con.execute(f"select {', '.join(columns)} from ({registry.SQL['op6_exact_dedup']})").fetchall()
    got = [tuple(r) for r in exact.exact_groups(docs, exact.half_snapshot()).select(columns).collect()]
    assert Counter(got) == Counter(want)


def test_exact_with_an_empty_snapshot(spark, monkeypatch):
    """A first batch is spread over filters as a snapshot of its size would be; repeated rows are written in parts."""
    monkeypatch.setattr(exact, "DIGESTS_PER_FILTER", 50)
    monkeypatch.setattr(exact, "REPEATS", 7)
    used = []
    inner = exact.screen
    monkeypatch.setattr(exact, "screen", lambda batch, filters, buckets: used.append(buckets) or inner(batch, filters, buckets))
    rows = [(i, f"text {i % 500}") for i in range(1_000)] + [(5, "text 5")] * 40
    got = Counter(map(tuple, exact.exact_groups(docs_of(spark, rows), F.lit(False)).select("doc_id", "keep_id", "group_size", "kept").collect()))
    assert used == [10]
    size = Counter(t for _, t in rows)
    want = Counter((i, i % 500, size[t], False) for i, t in rows)
    for i in range(500):
        want[(i, i, size[f"text {i}"], False)] -= 1
        want[(i, i, size[f"text {i}"], True)] += 1
    assert got == +want


def test_binary_fuse():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 50, 5_000, 100_000):
        keys = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        f = exact.BinaryFuse.from_bytes(exact.BinaryFuse(keys).to_bytes())
        assert f.contains(keys).all()
        assert f.contains(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)).mean() < 0.01


def test_viterbi():
    rng = np.random.default_rng(0)
    lengths = np.array([0, 5, 1, 9, 0, 7])
    scores = rng.normal(0, 4, (lengths.sum(), 3)).astype(np.float32)
    got = langid.viterbi(scores, lengths, 3.0)

    def value(s, path):
        return s[np.arange(len(s)), path].sum() - 3.0 * (np.diff(path) != 0).sum()

    at = 0
    for n in lengths:
        s, own = scores[at : at + n], got[at : at + n]
        if n:
            v = s[0].astype(float)
            for x in s[1:]:
                v = np.maximum(v, v.max() - 3.0) + x
            assert value(s, own) == pytest.approx(v.max(), rel=1e-5)
        at += n


def test_single_labels_need_no_steps(monkeypatch):
    rng = np.random.default_rng(3)
    lengths = np.array([4, 0, 3_000, 60])
    scores = rng.normal(0, 0.1, (lengths.sum(), 3)).astype(np.float32)
    scores[:, 1] -= 1
    scores[3_010:3_030, 1] += 40
    want = langid.viterbi(scores, lengths)
    seen = []
    inner = langid.viterbi
    monkeypatch.setattr(langid, "viterbi", lambda s, n, w: seen.append(n.tolist()) or inner(s, n, w))
    got = langid.best_labels(scores, lengths)
    assert (got[3_004:] == want[3_004:]).all() and set(got[3_010:3_030]) == {1} and seen == [[60]]
    assert scores[np.arange(4, 3_004), got[4:3_004]].sum() >= scores[np.arange(4, 3_004), want[4:3_004]].sum() - 1e-3


def test_scripts_bar_languages():
    counts = np.ones((2, langid.BUCKETS))
    scripts = np.zeros((2, langid.N_SCRIPTS))
    scripts[0, 0], scripts[1, 2] = 100, 100  # one Latin, one Cyrillic
    model = langid.Model(["la", "ru"], counts, scripts)
    scores, letters, strange = model.score(["word", "слово", "wслово", "中文", "12"])
    assert (scores[0] == [0, -langid.BARRED]).all() and (scores[1] == [-langid.BARRED, 0]).all() and (scores[2] == scores[1]).all()
    assert (scores[3:] == 0).all() and letters.tolist() == [4, 5, 6, 2, 0] and strange.tolist() == [0, 0, 0, 2, 0]


def test_language(spark):
    r = random.Random(3)
    kinds = {"aa": ["the", "thing", "ation", "ough", "ly"], "bb": ["sch", "ung", "keit", "über", "ein"], "cc": ["привет", "мир", "слово", "ние"]}
    rows = [(i, " ".join("".join(r.choices(kinds[k], k=r.randrange(1, 3))) for _ in range(30)), k) for i, k in enumerate(r.choices(list(kinds), k=300))]
    rows += [(1000, rows[0][1] + " " + rows[1][1], None), (1001, None, "aa"), (1002, "12 34 ...", "bb"), (1003, "", None), (None, "the thing", "aa"), rows[5]]
    table = spark.createDataFrame([(i, t, l, "s", 0) for i, t, l in rows], SCHEMA).repartition(3).withColumns(clash())
    got = langid.identify(table).collect()
    assert Counter(x.doc_id for x in got) == Counter(x[0] for x in rows)
    by = {x.doc_id: x for x in got}
    for i, _, l in rows[:300]:
        assert by[i].lang_pred == l and by[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and by[i].score > 0.9
    assert [by[i].lang_pred for i in (1001, 1002, 1003)] == ["und"] * 3 and by[1001].score == 0
    mixed = spark.createDataFrame([(1, "the thing ation " * 10 + "schung keit über ein " * 10, None, "s", 0)], SCHEMA)
    spans = langid.predict(mixed, langid.fit(table, ~langid.held_out()), with_spans=True).collect()[0].spans
    assert [(s.lang, s.begin, s.end) for s in spans] == [("aa", 0, 30), ("bb", 30, 70)]


def test_rare_and_many_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_TRAIN", 20)
    r = random.Random(9)
    letters = "bcdfghjklm"

    def text(k):
        return " ".join(a + v + b for a, v, b in [(letters[k // 10], r.choice("aeiou"), letters[k % 10]) for _ in range(20)])

    rows = [(1000 * k + i, text(k), f"l{k:02d}") for k in range(80) for i in range(40 if k < 10 else 4)]
    table = spark.createDataFrame([(i, t, l, "s", 0) for i, t, l in rows], SCHEMA).repartition(3)
    model = langid.fit(table, F.lit(True))
    assert model.langs == sorted({l for _, _, l in rows})
    got = {x.doc_id: x.lang_pred for x in langid.predict(table, model).collect()}
    assert got == {i: l for i, _, l in rows}


def test_language_holds_few_ngrams_at_once(monkeypatch):
    r = np.random.default_rng(3)
    made = ["".join(w) for w in r.choice(list("abcdefghijклмн7"), (60_000, 9))]
    model = langid.Model(["x", "y"], r.integers(0, 9, (2, langid.BUCKETS)), r.integers(0, 9, (2, langid.N_SCRIPTS)))
    texts = [made[i : i + 300] for i in range(0, len(made), 300)] + [[], made[:7]]
    tracemalloc.start()
    got = model.label(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    model.clear()
    monkeypatch.setattr(langid, "FEATURE_CHARS", 1 << 40)
    assert all((a == b).all() for a, b in zip(got, model.label(texts), strict=True))


def test_language_without_training(spark, empty):
    assert langid.identify(empty).count() == 0
    assert [x.lang_pred for x in langid.identify(spark.createDataFrame([(1, "text", None, "s", 4)], SCHEMA)).collect()] == ["und"]


def test_licences(spark):
    rows = [
        (1, "a/b/x.py", "Some text.\nReleased under the MIT License.\nMore"), (2, "a/LICENSE", "Licensed under the Apache License, Version 2.0."), (3, "a/b/y.py", "nothing"), (4, "a/b/c/z.py", None),
        (5, "q/z.py", ""), (6, None, "nothing"), (7, "a/b/LICENSE.txt", "SPDX-License-Identifier: GPL-3.0"), (8, "a/d/e.py", "My licence plate is new"), (9, "top.py", "Licensed under CC BY-NC 4.0.  "), (3, "a/b/y.py", "nothing"),
    ]
    t = spark.createDataFrame(rows, "doc_id bigint, path string, text string").withColumns(clash())
    got = Counter((r.doc_id, r.license, r.via, r.origin_id) for r in licenses.scan(t).collect())
    assert got == Counter([
        (1, "MIT", "header", 1), (2, "Apache-2.0", "header", 2), (3, "GPL-3.0", "directory", 7), (3, "GPL-3.0", "directory", 7), (4, "GPL-3.0", "directory", 7), (5, None, "none", None), (6, None, "none", None),
        (7, "GPL-3.0", "header", 7), (8, "Apache-2.0", "directory", 2), (9, "CC-BY-NC-4.0", "header", 9),
    ])
    assert licenses.scan(t.filter("false")).count() == 0


def wrapped(text):
    lines, line = [], ""
    for w in text.split():
        line = f"{line} {w}".strip()
        if len(line) > 60:
            lines.append(line)
            line = ""
    return "\n".join([*lines, line])


def test_licence_files(spark):
    """Licence files as wholes; the files below inherit."""
    whole = dict(reversed(licenses.WHOLE))
    filler = "\n\n".join(f"{i}. Each contributor grants you terms under clause {i} of these conditions, see the GNU Affero General Public License." for i in range(9))
    texts = {
        "Apache-2.0": "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n" + filler,
        "GPL-3.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n" + filler,
        "BSD-2-Clause": "BSD 2-Clause License\n\nCopyright (c) 2020, Someone\n\n" + wrapped(whole["BSD-2-Clause"].removeprefix("Copyright All rights reserved. ")),
        "BSD-3-Clause": "Copyright (c) 2020, Someone\n\n" + wrapped(whole["BSD-3-Clause"].removeprefix("Copyright All rights reserved. ")),
        "MIT": wrapped(whole["MIT"]), "ISC": wrapped(whole["ISC"]),
    }
    rows = [x for i, (name, text) in enumerate(texts.items()) for x in ((10 * i, f"{name}/LICENSE", text), (10 * i + 1, f"{name}/src/a.py", "code"))]
    rows.append((900, "long/LICENSE", "word " * 200_000))
    got = {r.doc_id: (r.license, r.via) for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, path string, text string")).collect()}
    assert got == {900: (None, "none")} | {k: v for i, name in enumerate(texts) for k, v in ((10 * i, (name, "header")), (10 * i + 1, (name, "directory")))}


def test_licence_ties(spark):
    rows = [(1, "a.py", "SPDX-License-Identifier: MIT\nSPDX-License-Identifier: AGPL-3.0"), (3, "b/LICENSE", "SPDX-License-Identifier: MIT"), (2, "b/COPYING", "SPDX-License-Identifier: MIT"), (4, "b/c.py", None)]
    got = {r.doc_id: (r.license, r.origin_id) for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, path string, text string")).collect()}
    assert got[1] == ("AGPL-3.0", 1) and got[4] == ("MIT", 2)


def test_shards(docs, rows):
    got = sharding.shard(docs, 4).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    by, groups = defaultdict(list), defaultdict(set)
    for r in got:
        by[r.shard].append(r)
        groups[r.text_crc32, r.size].add(r.shard)
    assert all(len(s) == 1 for s in groups.values()) and set(by) <= {0, 1, 2, 3}
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))


def test_shard_sizes(spark):
    r = random.Random(8)
    rows = [(i, "x" * r.randrange(1, 3_000) + str(i)) for i in range(900)] + [(900 + i, "same") for i in range(200)]
    sizes = Counter()
    for x in sharding.shard(docs_of(spark, rows), 16).collect():
        sizes[x.shard] += x.size
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 0.005 * sum(sizes.values()) / 16
    hot = [(i, "the same text") for i in range(300)] + [(300 + i, f"t{i}" * 5) for i in range(100)]
    assert len({x.shard for x in sharding.shard(docs_of(spark, hot), 4).collect()}) == 4
    assert max(x.shard for x in sharding.shard(docs_of(spark, rows), None, 100_000).collect()) + 1 <= sum(sizes.values()) // 100_000 + 2


def test_plan_is_best_fit_decreasing():
    """Runs of classes against one size at a time."""
    r = random.Random(12)
    sizes = [r.choice([3, 5, 5, 8, 13, 21, 34]) for _ in range(300)]
    free, used = [], 0
    for n in sorted(sizes, reverse=True):
        fit = [f for f in free if f >= n]
        if fit:
            free.remove(min(fit))
            free.append(min(fit) - n)
        else:
            free.append(50 - n)
    runs, used = sharding.plan([(n, c, n * c) for n, c in Counter(sizes).items()], 50)
    fill, met = Counter(), Counter()
    for n, a, b, shard in runs:
        fill[shard] += n * (b - a)
        met[n] += b - a
    assert used == len(free) and met == Counter(sizes) and max(fill.values()) <= 50
    assert sorted(50 - x for x in fill.values()) == sorted(free)


def test_capacity_holds_for_large_sizes(spark):
    rows = [(i, "x" * (4_100 + 37 * i)) for i in range(60)]
    fills = Counter()
    for x in sharding.shard(docs_of(spark, rows), None, 20_000).collect():
        fills[x.shard] += x.size
    assert max(fills.values()) <= 20_000


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<html></html>", ""), ("plain words only here", "plain words only here"),
    ("<body><nav><a href='/'>Home</a></nav><article><h1>T &amp; U</h1><p>One&nbsp; <b>t</b>wo\n x<p>Three<br>four</article><footer>f</footer>", "T & U One two x Three four"),
    ("<article><p>Body</p><aside>no</aside><div class='comments'><p>no</p></div><form>no<input></form><p>End</p><div class=ad>no</div></article>", "Body End"),
    ("<main><script>var t='<p>no</p>';</script><style>p{}</style><p>Yes <!-- no <p> --> it</p></main>", "Yes it"),
    ("<header>no</header><div id='sidebar-left'><p>no</p></div><div class='content'><p>" + "Long main text of the page. " * 10 + "</p><p>short</p><p>" + "And more main text here. " * 8 + "</p></div><div class='cookie-notice'>no</div>", ("Long main text of the page. " * 10 + "short " + "And more main text here. " * 8).strip()),
    ("<article><p title=\"a>b\">x < y &lt;z&gt; &#65;</p></article>", "x < y <z> A"),
])
def test_pages(page, text):
    assert html.main_text(page) == text


LONG = "Long main text of the page. " * 10


@pytest.mark.parametrize("page, text", [
    (f"<div class='content'><p>{LONG}</p></div><article class='comment'><p>no</p></article><article id='comment-7' class='odd'>no</article>", LONG.strip()),
    (f"<div class='content'><p>{LONG}</p></div><aside><article><p>no</p></article></aside><div class='sidebar'><main>no</main></div>", LONG.strip()),
    ("<div><article class=\"comment-body\"><p>X</p></article></div><article><p>Body</p></article>", "Body"),
    ("<article class='related'><p>X</p></article><article><p>Body</p></article>", "Body"),
    ("<article><div class='form-factor'>one</div><div class='notice-board'>two</div><div class='search-results'>three</div></article>", "one two three"),
    ("<article><object><p>Body</p><iframe><p>More</p></article>", "Body More"),
    ("<article><p>Body</p><script>no", "Body"),
    (f"<article><p>{LONG}</p><ul><li><a>no</a><li><a>no</a><li><a>no</a><li><a>no</a></ul><p>End <a>of it</a></p></article>", f"{LONG}End of it"),
    (f"<p>{LONG}</p><ul><li><a>no</a><li><a>no</a><li><a>no</a></ul>", LONG.strip()),
    (f"<article class='post has-sidebar'><p>{LONG}</p><article class='comment'>no</article><p>End</p></article>", f"{LONG}End"),
    (f"<div class='content'><h1>Title</h1><ul class='share'><li>no<li>no<li>no</ul><p>{LONG}</p><div class='ad'><p>no</p><p>no</p><p>no</p></div><p>short</p></div><div><p>Far</p></div>", f"Title {LONG}short"),
])
def test_pages_without_article(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize("seed", range(20))
def test_line_blocks(seed):
    """Surges and dives by their definition: a line is text if a surge comes before it, or at it, with no dive between, or if its container has a surge's longest line."""
    r = random.Random(seed)
    lengths = [r.choice([0, 0, 0, 5, 30, 90, 200]) for _ in range(25)]
    boxes = [i // 5 for i in range(25)]
    sums = [sum(lengths[i : i + html.WINDOW]) for i in range(25)]
    least = max(1, min(html.SURGE, max(sums) // 2))
    surges = [i for i in range(25) if lengths[i] and sums[i] >= least]
    dense = {boxes[max(range(i, min(25, i + html.WINDOW)), key=lengths.__getitem__)] for i in surges}
    want = [any(s <= i and all(sums[s : i + 1]) for s in surges) or bool(lengths[i]) and boxes[i] in dense for i in range(25)]
    assert html.text_lines(lengths, boxes) == want


def test_odd_pages():
    assert html.main_text("<div>" * 20_000 + "deep") == "deep"
    assert len(html.main_text("<article>" + "<p>word word</p>" * 100_000)) == 1_000_000 - 1
    assert html.main_text("<article><object>" * 3_000 + "x").endswith("x")
    html.main_text("<a b='" * 3_000 + "<!--" * 3_000)


def test_page_rows(spark):
    t = spark.createDataFrame([(1, "u", "<article>a</article>"), (1, "u", "<article>a</article>"), (2, None, None)], "page_id bigint, url string, html string").withColumns({"text": F.lit("x"), "html_": F.lit("y")})
    assert Counter(map(tuple, html.extract(t).collect())) == Counter([(1, "u", "a", 1)] * 2 + [(2, None, "", 0)])
    assert html.extract(t.filter("false")).count() == 0


def test_empty_tables(empty):
    assert minhash.near_duplicates(empty).count() == 0
    assert exact.exact_groups(empty, exact.half_snapshot()).count() == 0
    assert sharding.shard(empty).count() == 0
    assert packing.pack(empty, P.path("byte_bpe_50k.json")).count() == 0
    assert bpe.encode_decode(empty, P.path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    got = registry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    con.execute(f"create table o as {registry.SQL[name]}")
    want = con.execute("select " + ", ".join(f'"{c}"' for c in columns) + " from o").fetchall()
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, want))
