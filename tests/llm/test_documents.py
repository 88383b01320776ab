"""Operators over documents against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import re
import struct
import time
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from parchmint.llm import chunk_bpe, line_dedup, mixing, ngram_join, order_minhash, quality, queries, rans, token_files, tokenizing
from parchmint.llm.common import scratch
from tests.conftest import SF

LINE = "This very line stands in several documents."
WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
NEAR = " ".join(WORDS * 3 + [f"w{i}" for i in range(60)])
ROWS = [
    (1, f"{LINE}\nfirst own line, which is long enough", "en", "b"),
    (2, f"  {LINE.upper()}\t\nsecond", "en", "b"),
    (3, f"{LINE}\r\n{LINE}", None, "a"),
    (4, None, "en", None),
    (5, "", "de", "a"),
    (6, " \t\n ", "de", "c"),
    (7, NEAR, "en", "a"),
    (8, NEAR + " tail", "en", "a"),
    (9, NEAR.upper(), "en", "b"),
    (10, "x" * 20_000, "en", "c"),
    (11, " ".join(f"long{i} é" for i in range(30_000)), "fr", None),
    (12, "une école, déjà vue! une école", "fr", "b"),
    (12, "une école, déjà vue! une école", "fr", "b"),
    (None, "no id here at all, but words", "en", "b"),
    (14, "a b", "en", "a"),
    (15, "A  B", "en", "a"),
]
#: Names that operators use inside or give to results.
CLASHING = ("id", "_id", "n", "v", "g", "key", "cut", "left", "gone", "size", "ids", "score", "label", "kept_text", "_text", "epochs", "rest")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASHING:
        df = df.withColumn(c, F.lit(f"clash {c}"))
    return df.repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false").persist()


def by_id(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r["doc_id"] is not None, r["doc_id"]))


def test_line_dedup(docs, empty):
    def keys(t):
        return [x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)}) for x in (t or "").split("\n")]

    held = defaultdict(set)
    for d, t, *_ in ROWS:
        for k in keys(t):
            if len(k) >= 20:
                held[k].add(d if d is not None else -1)
    found = by_id(line_dedup.dedup_lines(docs))
    assert len(found) == len(ROWS)
    for r in found:
        d, t = r["doc_id"], r["text"]
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, keys(t), strict=True) if len(k) < 20 or len(held[k]) < 3 or max(held[k]) == (d if d is not None else -1)]
        assert (r["n_lines"], r["n_dropped"]) == (len(lines), len(lines) - len(kept))
        assert r["kept_sha256"] == hashlib.sha256("\n".join(kept).encode()).hexdigest()
        assert r["gone"] == "clash gone" and r["kept_text"] != "clash kept_text"
    assert {r["doc_id"] for r in found if r["n_dropped"]} == {1, 2}
    assert line_dedup.dedup_lines(empty).count() == 0


@pytest.mark.parametrize("ids", [lambda k: (-1) ** k * (9 * 10**18 - k), lambda k: 9 * 10**18 if k == 5 else k, lambda k: None if k % 2 else k, lambda k: k % 5])
def test_line_dedup_of_any_ids(spark, ids):
    rows = [(ids(k), "\n".join(f"this is line number {(k * j) % 17} of all" for j in range(6)) + f"\nan own line of text {k}") for k in range(120)]
    low = lambda d: -(2**63) if d is None else d
    held = defaultdict(set)
    for d, t in rows:
        for line in t.split("\n"):
            held[line].add(low(d))
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    want = [(low(d), "\n".join(x for x in t.split("\n") if len(held[x]) < 3 or max(held[x]) == low(d))) for d, t in rows]
    assert sorted((low(r.doc_id), r.kept_text or "") for r in found) == sorted(want)


def test_runs_are_levelled(spark):
    runs = line_dedup.Runs(scratch(spark, "runs"), fan_out=2)
    batches = [[(1, 1, 9), (2, 2, 9)], [(1, 1, 8), (3, 3, 8)], [(1, 1, 7)], [(1, 1, 6), (2, 2, 6)], [(1, 1, 5), (3, 3, 5)]]
    for b in batches:
        runs.add(spark.createDataFrame(b, "h1 long, h2 long, id long"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert [tuple(r) for r in runs.frequent().collect()] == [(1, 1, 9)]
    # A settled hash isn't added again: the last batch's run lacks it.
    assert [{r.h1: r.documents for r in t.collect()} for t in runs.tables()] == [{3: 1}, {1: 4, 2: 2, 3: 1}]


def shingles(t):
    w = (t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def classes(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    root = list(range(len(sets)))
    for a, b in combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            ra, rb = root[a], root[b]
            root = [ra if r == rb else r for r in root]
    least = {}
    for (d, _), r in zip(sets, root, strict=True):
        least[r] = min(least.get(r, d), d)
    return sorted((d, len(s), least[r]) for (d, s), r in zip(sets, root, strict=True))


def test_ngram_join(spark, docs, empty):
    rows = [(d if d is not None else -(2**63), t) for d, t, *_ in ROWS]
    found = ngram_join.near_classes(docs)
    assert sorted((r.id, r.n, r.component) for r in found.collect()) == classes(rows)
    kept = [r["doc_id"] for r in by_id(ngram_join.keep_one(docs))]
    assert kept == [None, 1, 2, 3, 4, 5, 6, 7, 10, 11, 12, 14]
    assert ngram_join.keep_one(docs).columns == docs.columns
    assert ngram_join.near_classes(empty).count() == 0 and ngram_join.keep_one(empty).count() == 0


def near_copies(rng, n, base, edits):
    """n copies of base, with up to `edits` words replaced in each."""
    out = []
    for d in range(n):
        words = list(base)
        for at in rng.choice(len(base), rng.integers(0, edits + 1), replace=False):
            words[at] = f"r{d}_{at}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("block", [5, 512])
def test_ngram_join_of_many_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = np.random.default_rng(3)
    base = [f"t{i}" for i in range(150)]
    rows = list(enumerate(near_copies(rng, 60, base, 5)))
    rows += [(100 + i, " ".join(f"u{i}_{j}" for j in range(40))) for i in range(10)]
    # Pages of one template that aren't near copies, some that are, and chains of ever more distant copies.
    rows += [(200 + i, " ".join(base[:110] + [f"own{i}_{j}" for j in range(30)])) for i in range(30)]
    rows += [(300 + i, " ".join(base[:110] + [f"own{i // 2}_{j}" for j in range(29)] + [f"x{i}"])) for i in range(20)]
    chain = [f"c{i}" for i in range(300)]
    rows += [(400 + i, " ".join(chain[4 * i : 4 * i + 100])) for i in range(40)]
    rows += [(500 + i, " ".join(chain[:k])) for i, k in enumerate((3, 4, 5, 6, 7, 5, 4, 30, 31, 34, 36, 40))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted((r.id, r.n, r.component) for r in ngram_join.near_classes(df).collect()) == classes(rows)


def test_ngram_join_of_thousands(spark):
    """One cluster of near copies and one of pages of a template, both of thousands."""
    rng = np.random.default_rng(5)
    base = [f"t{i}" for i in range(120)]
    rows = list(enumerate(near_copies(rng, 2500, base, 4)))
    rows += [(10_000 + i, " ".join(base[:60] + [f"own{i}_{j}" for j in range(12)])) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    found = {r.id: r.component for r in ngram_join.near_classes(df).collect()}
    # By brute force, with sets as rows of a matrix.
    sets = [shingles(t) for _, t in rows]
    place = {}
    for x in sets:
        for k in x:
            place.setdefault(k, len(place))
    m = np.zeros((len(sets), len(place)), dtype=np.float32)
    for r, x in zip(m, sets, strict=True):
        r[[place[k] for k in x]] = 1
    both, size = m @ m.T, m.sum(1)
    link = 100 * both >= 80 * (size[:, None] + size[None, :] - both)
    root = np.arange(len(sets))
    while True:
        new = np.array([root[r].min() for r in link])
        new = new[new]
        if (new == root).all():
            break
        root = new
    assert found == {d: rows[r][0] for (d, _), r in zip(rows, root, strict=True)}


def test_ngram_join_of_null_ids(spark):
    """Copies under one null id cost what copies under their own ids cost."""
    rng = np.random.default_rng(6)
    texts = near_copies(rng, 600, [f"t{i}" for i in range(100)], 3)
    took = []
    for ids in (range(600), [None] * 600):
        df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(4)
        began = time.perf_counter()
        found = ngram_join.near_classes(df).collect()
        took.append(time.perf_counter() - began)
        kept = ngram_join.keep_one(df).count()
        assert len(found) == 600 and kept == len({k for _, _, k in classes(list(enumerate(texts)))})
    assert took[1] < 1.5 * took[0] + 2


def test_quality(spark, docs, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    all_ = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.learned(all_, labels)
    found = quality.scored(docs, model)
    assert {0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found.collect()} == {True}
    assert found.columns == [c for c in docs.columns if c != "score"] + ["score", "predicted"]
    # Equal texts score alike, whatever stands beside them in a batch.
    rows = [(k, "twice the same text" if k in (1, 700, 1501) else f"text {k} " * (k % 40)) for k in range(1600)]
    same = quality.scored(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), model).where("doc_id in (1, 700, 1501)").collect()
    assert len({r.score for r in same}) == 1
    assert quality.scored(empty, model).count() == 0
    nothing = quality.learned(all_, labels.where("false"))
    assert {r.score for r in quality.scored(docs, nothing).collect()} == {0.5}


def term_counts(text):
    """Terms of a text, counted one by one."""
    b = (text or "").encode()
    pairs, words = Counter(), Counter()
    for x, y in zip(b, b[1:]):
        pairs[(x * 251 + y * 17) % 4096] += 1
    if len(b) == 1:
        pairs[b[0] * 251 % 4096] += 1

    def kind(w):
        bare = "".join(chr(c) if c < 128 else "a" for c in w.strip(b".,;:!?\"'()"))
        if bare.isalpha():
            return "lower" if bare == bare.lower() else "upper" if bare == bare.upper() else "title" if bare == bare.title() else "mixed"
        return "marks" if not bare else "digits" if bare.isdigit() else "alnum" if bare.isalnum() else "other"

    w = b.split()
    for x, y in zip(w, w[1:]):
        words[kind(x), kind(y)] += 1
    for lag in (1, 2, 3, 4):
        words[lag] += sum(x == y for x, y in zip(w, w[lag:]))
    out = {}
    for view in (pairs, words):
        damp = {k: np.log1p(n) for k, n in view.items() if n}
        norm = sum(x * x for x in damp.values()) ** 0.5
        out |= {k: x / norm for k, x in damp.items()}
    return out


def brute_scores(texts, sample, labels, share):
    """Votes among labelled texts by a plain singular value decomposition."""
    known = [term_counts(x) for x in sample]
    names = {k: i for i, k in enumerate(sorted({k for x in known for k in x}, key=str))}

    def row(counts, kind=np.float32):
        out = np.zeros(len(names))
        for k, x in counts.items():
            if k in names:
                out[names[k]] = kind(x)
        return out

    x = np.array([row(c, np.float16) for c in known])
    weights = np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1
    _, s, right = np.linalg.svd(x * weights, full_matrices=False)
    keep = (s**2 > s[0] ** 2 * 1e-6) & (np.arange(len(s)) < 48)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    vectors, y = unit((x * weights) @ right[keep].T), np.array(labels)
    odds = share / (1 - share) / (y.mean() / (1 - y.mean()))
    out = []
    for text in texts:
        near = np.maximum(unit((row(term_counts(text)) * weights)[None] @ right[keep].T)[0] @ vectors.T, 0).round(6)
        vote = np.where(near >= np.sort(near)[-15:][0], near**4, 0)
        one, zero = vote[y == 1].sum() * odds, vote[y == 0].sum()
        out.append(one / (one + zero) if one + zero else share)
    return out


def test_quality_by_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    ids = [i for i in labels if i in docs]
    assert len(set(labels.values())) == 2 and len(ids) < 800
    want = brute_scores(list(docs.values()), [docs[i] for i in ids], [labels[i] for i in ids], sum(labels.values()) / len(labels))
    found = {r.doc_id: r for r in queries.op3_quality_classifier(spark, SF).collect()}
    assert len(found) == len(docs)
    off = [abs(found[d].score - s) for d, s in zip(docs, want, strict=True)]
    assert max(off) < 0.01 and np.mean(off) < 1e-4  # terms are single, or half in the sample
    assert sum(found[d].predicted != (s >= 0.5) for d, s in zip(docs, want, strict=True)) <= len(docs) // 100


def test_quality_held_out(spark):
    sf = SF.replace("0.001", "0.01")
    found = queries.op3_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in found) / len(found) > 0.95
    assert {r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found} == {True}


def sizes(rows):
    return [(d, len((t or "").encode().split()), s) for d, t, _, s in rows]


@pytest.mark.parametrize("sources", ["broadcast", "joined"])
def test_mixing(docs, empty, monkeypatch, sources):
    monkeypatch.setattr(mixing, "BROADCAST", 100_000 if sources == "broadcast" else 1)
    found = by_id(mixing.mixed(docs))
    digest = [(r["doc_id"], *(r[c] for c in mixing.RESULTS)) for r in found]
    assert sorted(digest, key=str) == sorted((tuple(r) for r in mixing.shares(docs).drop("source").collect()), key=str)
    total = sum(n for _, n, _ in sizes(ROWS))
    per = defaultdict(int)
    for _, n, s in sizes(ROWS):
        per[s] += n
    weight = {"a": 5, "b": 2, "c": 1, None: 5}
    open_, left, target = set(per), float(total), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * per[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * per[s]
            left -= target[s]
            open_.discard(s)
    target |= share
    taken = defaultdict(int)
    for r in found:
        assert r["source_size"] == per[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in per:
        assert abs(taken[s] - target[s]) <= len(ROWS)
    whole = mixing.materialized(docs)
    assert whole.columns == docs.columns
    words = {s: n for s, n in whole.groupBy("source").agg(F.sum(mixing.n_words(F.col("text")))).collect()}
    assert {s: words[s] for s in words} == {s: taken[s] for s in words}
    assert mixing.mixed(empty).count() == 0 and mixing.materialized(empty).count() == 0


def test_first_words(spark):
    df = spark.createDataFrame([(" a  b\nc ", 2), ("a", 5), ("", 1), ("x y", 0)], "t string, n long")
    assert [r[0] for r in df.select(mixing.first_words(F.col("t"), F.col("n"))).collect()] == [" a  b", "a", "", ""]


def test_rans_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 1024, 1025, 200_000):
        ids = rng.zipf(1.4, n) % 3000
        symbols, counts = np.unique(ids, return_counts=True)
        table = rans.scaled(symbols, counts)
        block = rans.encode(ids, table)
        assert (rans.decode(block, table) == ids).all()
        parts = [rans.decode(block, table, k, k + 1) for k in range(len(block["marks"]) // 8)]
        assert (np.concatenate([*parts, np.empty(0)]) == ids).all()


def ids_of(rows):
    t = tokenizing.loaded(tokenizing.default_path())
    return [t.encode(x or "", add_special_tokens=False).ids for _, x, *_ in rows]


def test_token_files(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 500)
    folder = scratch(spark, "files")
    token_files.write(docs, folder)
    order = sorted(zip([r[0] for r in ROWS], ids_of(ROWS), strict=True), key=lambda x: -(2**63) if x[0] is None else x[0])
    start, want = 0, []
    for d, ids in order:
        packed = np.array([*ids, 1], dtype="<u4")
        want.append((-(2**63) if d is None else d, start, len(packed), zlib.crc32(packed.tobytes())))
        start += len(packed)
    found = sorted(tuple(r) for r in token_files.digests(spark, folder).collect())
    assert found == sorted(want)
    assert sum(len(r.ids) for r in token_files.read(spark, folder).collect()) == start
    nothing = scratch(spark, "files")
    token_files.write(empty, nothing)
    assert token_files.digests(spark, nothing).count() == 0


def test_ids_of_any_kind(spark):
    """op2 and op7 with ids near both limits, one far away, null and repeated."""
    big = 9 * 10**18
    rows = [(i, f"some words of text number {k % 7} that go on for a while") for k, i in enumerate([big, -big, 1, 2, None, None, big - 1, 1, 1, -big + 1, 2**63 - 1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    low = [(-(2**63) if d is None else d, t) for d, t in rows]
    assert sorted((r.id, r.n, r.component) for r in ngram_join.near_classes(df).collect()) == classes(low)
    folder = scratch(spark, "files")
    token_files.write(df, folder)
    found = sorted(token_files.digests(spark, folder).collect(), key=lambda r: r.start)
    assert [r.id for r in found] == sorted(d for d, _ in low)
    packed = {d: set() for d, _ in low}
    for (d, _), ids in zip(low, ids_of(rows), strict=True):
        packed[d].add(zlib.crc32(np.array([*ids, 1], dtype="<u4").tobytes()))
    assert all(r.ids_crc32 in packed[r.id] for r in found) and found[-1].start + found[-1].n_tokens == sum(len(x) + 1 for x in ids_of(rows))


def test_damaged_block_is_noticed(spark, docs):
    table = rans.scaled(np.array([1, 2]), np.array([5, 5]))
    block = rans.encode(np.array([1, 2, 1, 1]), table) | {"part": 0, "block": 0}
    with pytest.raises(ValueError, match="checksum"):
        token_files.unpacked(block | {"crc": block["crc"] ^ 1}, table)


def test_chunk_reuse(docs, empty):
    t = tokenizing.loaded(tokenizing.default_path())
    want = sorted((str(d), ids, t.decode(ids, skip_special_tokens=False)) for (d, *_), ids in zip(ROWS, ids_of(ROWS), strict=True))
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in chunk_bpe.encode_decode(docs).collect()) == want
    assert chunk_bpe.encode_decode(empty).count() == 0


def test_shared_chunks(spark, monkeypatch):
    """Passages that many documents share, equal rows under one id, more shared chunks than are broadcast."""
    rng = np.random.default_rng(8)
    passages = [" ".join(f"word{i}x{j}" for j in range(400)) for i in range(6)]
    rows = [(k if k % 4 else None, " ".join([f"own {k}", *rng.choice(passages, 3), "é" * (k % 5)])) for k in range(80)] + [(None, passages[0])] * 50 + [(3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    t = tokenizing.loaded(tokenizing.default_path())
    want = sorted((str(d), t.encode(x or "", add_special_tokens=False).ids) for d, x in rows)
    held = defaultdict(set)
    for k, (_, x) in enumerate(rows):
        for c in chunk_bpe.chunks((x or "").encode()):
            held[chunk_bpe.digest(c)].add(k)
    several = {h for h, ks in held.items() if len(ks) > 1}
    found = chunk_bpe.shared_chunks(df, tokenizing.default_path())
    assert set(found) == several and len(several) > 5
    assert len(chunk_bpe.shared_chunks(df, tokenizing.default_path(), 5)) == 5
    for most in (5, 2048):
        monkeypatch.setattr(chunk_bpe, "shared_chunks", lambda docs, path, n=most: dict(list(found.items())[:n]))
        assert sorted((str(r.doc_id), r.ids) for r in chunk_bpe.encode_decode(df).collect()) == want


@pytest.mark.parametrize("letters", ["ab", "aé. '", "x<|endoftext|>1", "日本語 ́", "a b c\x85\x1c", "İSs'S", "a,B!? É"])
def test_chunk_joins_are_exact(letters):
    rng = np.random.default_rng(len(letters))
    base, t = tokenizing.Encoder(tokenizing.default_path()), tokenizing.loaded(tokenizing.default_path())
    for n in (0, 1, 700, 9000, 40_000):
        text = "".join(rng.choice(list(letters), n))
        found = chunk_bpe.ChunkEncoder(base, {}).encode_all([text.encode()])[0]
        assert base.ids(found).tolist() == t.encode(text, add_special_tokens=False).ids
        assert b"".join(chunk_bpe.chunks(text.encode())) == text.encode()


def spark_hash(*values):
    """XXH64 of a row's values as Spark has it: each hashed with the one before as its seed."""
    seed = 42
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<i" if isinstance(v, np.int32) else "<q", v), seed)
    return seed - 2**64 if seed >= 2**63 else seed


def signature(text):
    """Order MinHash by itself: numbered 2-mers of symbols, the 64 least by hash, neighbours in text order."""
    w = [spark_hash(x) for x in re.findall(r"[^\x20\x09-\x0D]{1,12}", text or "")]
    kmers = [spark_hash(*w[i : i + 2]) & (2**33 - 1) for i in range(max(len(w) - 1, min(len(w), 1)))]
    seen, numbered = defaultdict(int), []
    for at, k in enumerate(kmers):
        seen[k] += 1
        numbered.append((spark_hash(k, np.int32(seen[k])) & (2**33 - 1), at))
    least = sorted(numbered)[:64]
    pairs = list(zip(least, least[1:])) if len(least) > 1 else [(x, None) for x in least]
    return sorted({(spark_hash(a[0], None) if b is None else spark_hash(a[0], b[0]) if a[1] < b[1] else spark_hash(b[0], a[0])) & 0xFFFFFFFF for a, b in pairs})


def likeness(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0


def check_fingerprints(found, rows):
    """Every column of every row against the definition; rows: (doc_id, text)."""
    low = lambda d: -(2**63) if d is None else d
    order = sorted(rows, key=lambda r: (low(r[0]), spark_hash(r[1])))
    want = []
    for k, (d, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, other, changed = signature(text), signature(after), signature(edited)
        written = lambda s: "".join(f"{x:08x}" for x in s)
        want.append((low(d), len(text), edited, written(own), written(changed), round(likeness(own, changed), 9), round(likeness(own, other), 9)))
    got = [(low(r.doc_id), r.n_chars, r.edited, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in found.collect()]
    assert sorted(got) == sorted(want)


def test_order_minhash(spark, docs, empty):
    check_fingerprints(order_minhash.fingerprints(docs), [r[:2] for r in ROWS])
    of = {r["doc_id"]: r for r in by_id(order_minhash.fingerprints(docs))}
    assert of[4]["fingerprint"] == of[5]["fingerprint"] == of[6]["fingerprint"] == ""
    assert of[5]["near_next"] == 1.0 and of[7]["near_next"] > 0.8
    assert order_minhash.fingerprints(empty).count() == 0


@pytest.mark.parametrize("ids", ["near both limits", "one far away", "mostly null", "repeated"])
def test_order_minhash_in_ranges(spark, monkeypatch, ids):
    for name, value in (("PER_RANGE", 7), ("SAMPLE", 64), ("HOT", 20), ("HOT_SHARE", 50)):
        monkeypatch.setattr(order_minhash, name, value)
    n = 300
    kinds = {"near both limits": lambda k: (-1) ** k * (9 * 10**18 - k), "one far away": lambda k: 9 * 10**18 if k == 5 else k, "mostly null": lambda k: k if k % 3 == 0 else None, "repeated": lambda k: k % 4}
    rows = [(kinds[ids](k), f"words of {k % 50} {k // 7} and more {k % 3}") for k in range(n)] + [(kinds[ids](5), "one text many times")] * 60
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    check_fingerprints(order_minhash.fingerprints(df), rows)


def test_order_minhash_sees_order_and_occurrence(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join(words[200:] + words[:200])), (3, " ".join(words[:-1] + ["z"])), (4, " ".join(np.random.default_rng(1).permutation(words))), (5, "a b " * 5), (6, "a b " * 9)]
    df = order_minhash.with_signature(spark.createDataFrame(rows, "doc_id long, text string"), "text", "s")
    s = {r.doc_id: set(r.s) for r in df.collect()}
    like = lambda a, b: len(s[a] & s[b]) / len(s[a] | s[b])
    assert like(1, 3) > 0.8 > 0.6 > like(1, 2) > 0.15 > 0.05 > like(1, 4)
    assert s[5] != s[6]
    assert {r.doc_id: r.s for r in df.collect()} == {d: signature(x) for d, x in rows}
