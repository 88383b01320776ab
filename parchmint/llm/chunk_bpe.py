"""BPE encoding and decoding with content-defined chunk reuse.

A text is cut where a rolling hash of the last WINDOW bytes before a space has MASK's bits
clear, or after MAX_CHUNK bytes at the latest; the same passage thus gives the same chunks
wherever it stands. A chunk that several documents share is encoded once:

1. Chunk hashes are counted over all documents (hashes alone are shuffled). Of the chunks that
   more than one document holds, the SHARED that save the most bytes are fetched, encoded once
   by one task each and broadcast; their number and length are bounded, whatever the input.
2. Every task encodes any other chunk once, on its first sight, and keeps its ids while they fit
   a bounded cache.

Joins: where a chunk ends in the middle of a word (a run of non-space longer than MAX_CHUNK),
the words at the join are re-encoded as one. The ids that stand there for the cut pieces must be
exactly what encoding these pieces gives; while they disagree, the window grows by a word on
each side. A join at a space needs no repair, as the tokenizer never looks across one.

Nulls: a null text is an empty one, with no ids. Repeated rows come back repeated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.llm.common import bytes_of, keeping, per_batch, released, scratch
from parchmint.llm.shingles import mix
from parchmint.llm.tokenizing import Encoder, default_path, encoder

WINDOW, MASK, MAX_CHUNK = 16, 63, 8192
SHARED, CACHE_BYTES = 2048, 8 << 20
FACTORS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 2**64) for k in range(WINDOW)], dtype=np.uint64)
SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def cuts(text: bytes) -> list[int]:
    """Where the chunks of a text end, ascending; the last is the text's length."""
    n = len(text)
    if n <= WINDOW:
        return [n]
    data = np.frombuffer(text, dtype=np.uint8)
    at = np.flatnonzero(SPACES[data])
    at = at[at >= WINDOW]
    h = np.zeros(len(at), dtype=np.uint64)
    for k in range(WINDOW):
        h += data[at - 1 - k] * FACTORS[k]
    ends = (at[(mix(h) & np.uint64(MASK)) == 0] + 1).tolist()
    out, start = [], 0
    for end in [*ends, n]:
        while end - start > MAX_CHUNK:
            start += MAX_CHUNK
            while text[start] & 0xC0 == 0x80:  # not within a code point
                start -= 1
            out.append(start)
        if end > start:
            out.append(end)
            start = end
    return out


def chunks(text: bytes) -> list[bytes]:
    out, start = [], 0
    for end in cuts(text):
        out.append(text[start:end])
        start = end
    return out


def digest(chunk: bytes) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


class ChunkEncoder:
    """Encodes texts by chunks, with the ids of shared chunks given and those of others kept a while."""

    def __init__(self, base: Encoder, shared: dict[bytes, bytes]) -> None:
        self.base, self.shared = base, shared
        self.kept: dict[bytes, bytes] = {}
        self.size = 0

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        pieces = [chunks(x) for x in texts]
        names = [[digest(c) for c in cs] for cs in pieces]
        new = {h: c for hs, cs in zip(names, pieces, strict=True) for h, c in zip(hs, cs, strict=True) if h not in self.shared and h not in self.kept}
        if self.size > CACHE_BYTES:
            self.kept, self.size = {h: self.kept[h] for hs in names for h in hs if h in self.kept}, 0
            self.size = sum(map(len, self.kept.values()))
        for h, ids in zip(new, self.base.encode_all(list(new.values())), strict=True):
            self.kept[h] = ids
            self.size += len(ids)
        return [self.joined(cs, [self.shared[h] if h in self.shared else self.kept[h] for h in hs]) for cs, hs in zip(pieces, names, strict=True)]

    def joined(self, pieces: list[bytes], ids: list[bytes]) -> bytes:
        """The ids of the pieces' concatenation."""
        if not self.base.by_word:  # no white space to lean on: the whole text is the window
            return self.base.encode(b"".join(pieces))
        out: list[tuple[bytes, bytes]] = []
        for piece, found in zip(pieces, ids, strict=True):
            if out and piece and not (SPACES[out[-1][0][-1]] or SPACES[piece[0]]):
                out[-1] = self.repaired(*out[-1], piece, found)
            elif piece:
                out.append((piece, found))
        return b"".join(found for _, found in out)

    def repaired(self, left: bytes, left_ids: bytes, right: bytes, right_ids: bytes) -> tuple[bytes, bytes]:
        """Two pieces that meet within a word, as one piece with its ids."""
        words = 1
        while True:
            a, b = last_words(left, words), first_words(right, words)
            tail, head = self.base.encode(left[a:]), self.base.encode(right[:b])
            more_left, more_right = bool(left[:a].strip()), bool(right[b:].strip())
            if not (more_left or more_right) or left_ids.endswith(tail) and right_ids.startswith(head) and len(tail) and len(head):
                middle = self.base.encode(left[a:] + right[:b])
                return left + right, left_ids[: len(left_ids) - len(tail)] * more_left + middle + right_ids[len(head) :] * more_right
            words += 1


def last_words(text: bytes, n: int) -> int:
    """Where the last n runs of non-space begin."""
    parts = text.rsplit(None, n)
    return len(text) - len(text.lstrip()) if len(parts) <= n else len(text) - len(text[len(parts[0]) :].lstrip())


def first_words(text: bytes, n: int) -> int:
    """Where the first n runs of non-space end."""
    parts = text.split(None, n)
    return len(text.rstrip()) if len(parts) <= n else len(text[: len(text) - len(parts[-1])].rstrip())


def shared_chunks(docs: DataFrame, path: str, most: int = SHARED) -> dict[bytes, bytes]:
    """The ids of the chunks whose reuse saves most; at most `most` of MAX_CHUNK bytes each."""

    def count(batches):
        found: dict[bytes, list[int]] = {}
        for batch in batches:
            for text in bytes_of(batch.column(0)):
                for c in set(chunks(text)):
                    found.setdefault(digest(c), [0, len(c)])[0] += 1
            if len(found) > 200_000:
                yield counted(found)
                found = {}
        yield counted(found)
        found.clear()
        released()

    def counted(found: dict[bytes, list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"h": pa.array(found.keys(), pa.binary()), "k": pa.array([x[0] for x in found.values()], pa.int64()), "size": pa.array([x[1] for x in found.values()], pa.int64())})

    texts = docs.select(F.col("text").cast("string"))
    saves = texts.mapInArrow(count, "h binary, k long, size long").groupBy("h").agg(F.sum("k").alias("k"), F.first("size").alias("size")).where("k > 1")
    best = {bytes(r.h) for r in saves.orderBy(F.desc(F.expr("(k - 1) * size")), "h").limit(most).collect()}
    if not best:
        return {}
    wanted = docs.sparkSession.sparkContext.broadcast(best)

    def fetch(batches):
        left = set(wanted.value)
        for batch in batches:
            found = {}
            for text in bytes_of(batch.column(0)) if left else ():
                for c in chunks(text):
                    if (h := digest(c)) in left:
                        found[h] = c
                        left.discard(h)
            yield pa.RecordBatch.from_pydict({"h": pa.array(found.keys(), pa.binary()), "chunk": pa.array(found.values(), pa.binary())})

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"h": batch.column(0), "ids": pa.array(encoder(path).encode_all(batch.column(1).to_pylist()), pa.binary())})

    once = texts.mapInArrow(fetch, "h binary, chunk binary").dropDuplicates(["h"])
    return {bytes(r.h): bytes(r.ids) for r in once.mapInArrow(per_batch(encode), "h binary, ids binary").collect()}


@keeping("text", results=("ids", "decoded"))
def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with ids (array<int>) and decoded (string) added."""
    scratch(docs.sparkSession, "chunk_bpe")
    file = path or default_path()
    names = [c for c in docs.columns if c not in ("ids", "decoded")]
    rows = docs.select(*[docs[c] for c in names], docs["text"].cast("string").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(shared_chunks(docs, file))

    def run(batches):
        base = encoder(file)
        by_chunk = ChunkEncoder(base, shared.value)
        for batch in batches:
            if batch.num_rows:
                found = by_chunk.encode_all(bytes_of(batch.column(batch.num_columns - 1)))
                offsets = np.cumsum([0, *(len(x) // base.dtype.itemsize for x in found)])
                ids = base.ids(b"".join(found)).astype(np.int32)
                decoded = [base.decode(ids[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids)), pa.array(decoded, pa.string())], names=[*names, "ids", "decoded"])
        base.words.clear()
        by_chunk.kept.clear()
        released()

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema), "ids array<int>", "decoded string"])
    return rows.mapInArrow(run, schema)
