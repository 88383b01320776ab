"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A document's terms, all of its whole text, are its byte pairs, the pairs of its words' shapes
(lower, Title, UPPER, digits, ...), and at which lag up to LAGS a word comes again. Term counts are
dampened, scaled to unit length (bytes and words apart) and weighted by rarity; a truncated singular value decomposition
of the labelled sample's matrix gives LATENT dimensions. No count is compared with a threshold:
all that a term says, it says through the latent vectors. The sample, SAMPLE documents of each
label at most, chosen by a hash of the id, bounds what is fitted on the driver and what is
broadcast (2 * SAMPLE vectors).

Every document is multiplied with all labelled vectors in blocks; exact cosines of the
NEIGHBOURS nearest, to the power 4, weigh their labels. Cosines are rounded to DIGITS digits, so
equal texts score alike in any batch, and all that tie with the last neighbour vote. Labels are
weighed by how common they are among all learnable labels, so that an even sample gives honest
scores.

Nulls: a null text is an empty one; documents without any term score PRIOR. Labels that are null
aren't learned from; an id with several labels counts as its least. Without labels of both kinds
every score is the share of label 1 (PRIOR if there are none).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmint.llm.common import bytes_of, keeping, per_batch, scratch

PAIRS, LATENT = 4096, 48
SAMPLE, NEIGHBOURS, DIGITS = 800, 15, 6
PRIOR = 0.5
BLOCK = 512
SHAPES, LAGS = 8, 4
TERMS = PAIRS + SHAPES * SHAPES + LAGS
#: Marks that may hang on a word, and bytes that count as lower-case letters: all beyond ASCII.
MARKS = b".,;:!?\"'()"
LETTERS = bytes(c if c < 128 else ord("a") for c in range(256))
CACHE_ENTRIES = 200_000


class Words(dict):
    """Shape and hash of words, kept while they are few enough: hash * SHAPES + shape."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[word] = value = (xxhash.xxh32_intdigest(word) * SHAPES) + shape(word)
        return value


def shape(word: bytes) -> int:
    bare = word.strip(MARKS).translate(LETTERS)
    if bare.isalpha():
        return 0 if bare.islower() else 1 if bare.isupper() else 2 if bare.istitle() else 3
    return 4 if not bare else 5 if bare.isdigit() else 6 if bare.isalnum() else 7


def terms(texts: list[bytes], words: Words | None = None) -> np.ndarray:
    """Dampened term counts, those of bytes and those of words of unit length each, one row for each text; the whole text counts."""
    out = np.zeros((len(texts), TERMS), dtype=np.float32)
    words = Words() if words is None else words
    for k, text in enumerate(texts):
        b = np.frombuffer(text, dtype=np.uint8).astype(np.uint32)
        if len(b) > 1:
            out[k, :PAIRS] = np.bincount((b[:-1] * 251 + b[1:] * 17) % PAIRS, minlength=PAIRS)
        elif len(b):
            out[k, int(b[0]) * 251 % PAIRS] = 1
        split = text.split()
        w = np.fromiter(map(words.__getitem__, split), dtype=np.int64, count=len(split))
        kind = w % SHAPES
        out[k, PAIRS : PAIRS + SHAPES * SHAPES] = np.bincount(kind[:-1] * SHAPES + kind[1:], minlength=SHAPES * SHAPES)
        out[k, PAIRS + SHAPES * SHAPES :] = [np.count_nonzero(w[lag:] == w[:-lag]) for lag in range(1, LAGS + 1)]
    np.log1p(out, out=out)
    for view in (out[:, :PAIRS], out[:, PAIRS:]):
        norm = np.linalg.norm(view, axis=1, keepdims=True)
        np.divide(view, norm, out=view, where=norm > 0)
    return out


@dataclass
class Model:
    """weights: rarity of terms; basis: terms to latent; vectors and labels: the sample's, unit length."""

    weights: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    share: float
    balance: float

    def latent(self, rows: np.ndarray) -> np.ndarray:
        x = (rows * self.weights).astype(np.float64) @ self.basis
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)

    def score(self, texts: list[bytes], words: Words | None = None) -> np.ndarray:
        out = np.full(len(texts), self.share)
        if not len(self.vectors):
            return out
        one = (self.labels == 1).astype(np.float64)
        for start in range(0, len(texts), BLOCK):
            x = self.latent(terms(texts[start : start + BLOCK], words))
            near = np.maximum((x @ self.vectors.T).round(DIGITS), 0)
            k = min(NEIGHBOURS, near.shape[1])
            last = -np.partition(-near, k - 1, axis=1)[:, k - 1 : k]
            weight = np.where(near >= last, (near * near) ** 2, 0)
            ones = weight @ one * self.balance
            zeros = weight @ (1 - one)
            known = ones + zeros > 0
            out[start : start + len(x)][known] = (ones[known] / (ones + zeros)[known]).round(2 * DIGITS)
        return out


def fitted(rows: np.ndarray, labels: np.ndarray, share: float) -> Model:
    """rows: the sample's terms; share: of label 1 among all labels that may be learned from."""
    if len(set(labels.tolist())) < 2:
        empty = np.zeros((0, 1))
        return Model(np.ones(TERMS, np.float32), empty, empty, labels, share, 1.0)
    weights = (np.log((1 + len(rows)) / (1 + (rows > 0).sum(0))) + 1).astype(np.float32)
    x = rows * weights
    # Left singular vectors from the small Gram matrix; the sample bounds its side.
    values, left = np.linalg.eigh((x @ x.T).astype(np.float64))
    top = np.argsort(-values)[: min(LATENT, int((values > values.max() * 1e-6).sum()))]
    basis = (x.T @ (left[:, top] / np.sqrt(values[top])).astype(np.float32)).astype(np.float64)
    del x, left
    ones = (labels == 1).mean()
    model = Model(weights, basis, np.zeros((0, 1)), labels, share, 1.0)
    # By blocks: all rows at once, in double precision, are twice what the sample itself takes.
    model.vectors = np.concatenate([model.latent(rows[start : start + BLOCK]) for start in range(0, len(rows), BLOCK)])
    model.balance = float(np.clip(share, 0.01, 0.99) / (1 - np.clip(share, 0.01, 0.99)) / (ones / (1 - ones)))
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learned(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on at most sample labelled documents of each label, none of them held out."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    counts = {r.label: r.k for r in known.groupBy("label").agg(F.count("*").alias("k")).collect()}
    ones, all_ = counts.get(1, 0), counts.get(1, 0) + counts.get(0, 0)
    share = ones / all_ if all_ else PRIOR
    key = F.xxhash64("doc_id")
    # Some of the labelled ids may have no document, so a few more ids than needed are looked up.
    parts = [known.where(F.col("label") == v).orderBy(key, "doc_id").limit(2 * sample) for v in (0, 1)]
    wanted = F.broadcast(parts[0].union(parts[1]))  # 4 * sample rows at most

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = terms(bytes_of(batch.column(2))).astype("<f2")
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in rows], pa.binary())], names=["doc_id", "label", "terms"])

    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(wanted, "doc_id").select("doc_id", "label", "text").mapInArrow(per_batch(step), "doc_id long, label int, terms binary")
    y: list[int] = []
    x = np.zeros((2 * sample, TERMS), dtype=np.float32)
    for v in (0, 1):
        for r in found.where(F.col("label") == v).orderBy(key, "doc_id", "terms").limit(sample).toLocalIterator():
            x[len(y)] = np.frombuffer(r.terms, dtype="<f2")
            y.append(v)
    return fitted(x[: len(y)], np.array(y, dtype=np.int64), share)


@keeping("text", results=("score", "predicted"))
def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1) and predicted (0 or 1) added; only text is looked at."""
    scratch(docs.sparkSession, "quality")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    rows = docs.select(*[docs[c] for c in names], docs["text"].cast("string").alias("_text"))
    words = Words()

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = np.clip(shared.value.score(bytes_of(batch.column(batch.num_columns - 1)), words), 0.0, 1.0)
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema), "score double", "predicted int"])
    return rows.mapInArrow(per_batch(step), schema)
