"""Line dedup: levelled sorted runs of line hashes, compacted periodically.

A line's key is the line without ASCII space at both ends and with A-Z lower-cased. Keys of at
least MIN_CHARS code points that at least MIN_DOCS documents hold lose all their lines, except
in the largest doc_id that holds them; all other lines stay.

A run is a table (hash, documents, keeper), sorted by hash in ranges. Documents come in batches
of equal numbers, the larger ids first; their bounds are quantiles of the ids.
A new batch is aggregated to one row a hash, merge-anti-joined against the runs (what a run
already calls frequent, with a keeper as large, is settled: the batch needn't add it again), and
the rest is added as a run of level 0. FAN_OUT runs of one level are merged into one of the
next. At the end the lines of all documents are merge-joined against the frequent hashes of all
runs, and lines of other documents than the keeper go.

Only hashes and ids are shuffled for the runs, pre-aggregated; a line that a third of all
documents hold is one row of each task. In the last join such a hash would gather its postings
in one task, so hashes with more than 1 / HOT_SHARE of all postings (HOT_SHARE at most, hence a
bounded broadcast) are joined by broadcast and the others by merge.

Nulls: a null text is one empty line and comes back null. A null doc_id is a document below
every other; rows of one id are one document, but each row's lost lines are gathered by (id, hash
of its text), so that many texts of one id, or of none, don't meet in one cell.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.llm.common import bytes_of, id_or_least, keeping, per_batch, saved, scratch

MIN_CHARS, MIN_DOCS = 20, 3
N_BATCHES, FAN_OUT = 4, 2
HOT_SHARE = 20_000
STRIP = b" \t\n\x0b\x0c\r"


def keys(text: bytes) -> list[bytes]:
    """The keys of a text's lines, in order."""
    return [x.strip(STRIP) for x in text.lower().split(b"\n")]  # bytes.lower() knows A-Z alone


def long_enough(key: bytes) -> bool:
    return len(key) >= MIN_CHARS and (len(key) >= 4 * MIN_CHARS or len(key.decode()) >= MIN_CHARS)


def hashed(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def postings(docs: DataFrame) -> DataFrame:
    """docs (id, th, text). (h1, h2, id, th): each long enough key of each row once."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [{hashed(k) for k in set(keys(x)) if long_enough(k)} for x in bytes_of(batch.column(2))]
        ids, texts = (np.repeat(batch.column(k).to_numpy(), [len(x) for x in found]) for k in (0, 1))
        two = np.frombuffer(b"".join(h for x in found for h in x), dtype="<i8").reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(two[:, 0]), pa.array(two[:, 1]), pa.array(ids), pa.array(texts)], names=["h1", "h2", "id", "th"])

    return docs.mapInArrow(per_batch(step), "h1 long, h2 long, id long, th long")


class Runs:
    """Levelled sorted runs (h1, h2, documents, keeper) in a shared folder."""

    def __init__(self, folder: str, fan_out: int = FAN_OUT) -> None:
        self.folder, self.fan_out, self.written = folder, fan_out, 0
        self.levels: list[list[DataFrame]] = []

    def tables(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def merged(self, runs: list[DataFrame]) -> DataFrame:
        whole = runs[0]
        for run in runs[1:]:
            whole = whole.unionByName(run)
        return whole.groupBy("h1", "h2").agg(F.sum("documents").alias("documents"), F.max("keeper").alias("keeper"))

    def write(self, run: DataFrame) -> DataFrame:
        self.written += 1
        return saved(run.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2"), f"{self.folder}/run{self.written}")

    def add(self, batch: DataFrame) -> None:
        """batch: (h1, h2, id), each pair once. A document must not be split over batches."""
        new = batch.groupBy("h1", "h2").agg(F.count("*").alias("documents"), F.max("id").alias("keeper"))
        for run in self.tables():
            settled = run.where(F.col("documents") >= MIN_DOCS).select("h1", "h2", F.col("keeper").alias("kept"))
            new = new.join(settled, (new.h1 == settled.h1) & (new.h2 == settled.h2) & (settled.kept >= new.keeper), "left_anti")
        run, level = self.write(new), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fan_out:
                return
            run, self.levels[level], level = self.write(self.merged(self.levels[level])), [], level + 1

    def frequent(self) -> DataFrame:
        """(h1, h2, keeper) of the keys that enough documents hold."""
        return self.merged(self.tables()).where(F.col("documents") >= MIN_DOCS).select("h1", "h2", "keeper")


def dropped_lines(docs: DataFrame, batches: int = N_BATCHES) -> DataFrame:
    """docs (id, th, text). (id, th, gone): per row that loses lines, the hashes of their keys."""
    path = scratch(docs.sparkSession, "line_dedup")
    # Larger ids first: what is settled then stays settled.
    shares = [1 - (k + 1) / batches for k in range(batches - 1)]
    bounds = docs.agg(F.percentile_approx("id", shares, 10_000)).first()[0] if shares else None
    batch = sum((F.when(F.col("id") <= b, 1).otherwise(0) for b in bounds or ()), F.lit(0))
    held = postings(docs).withColumn("batch", batch)
    held.write.partitionBy("batch").parquet(f"{path}/postings")
    held = docs.sparkSession.read.schema("h1 long, h2 long, id long, th long, batch int").parquet(f"{path}/postings")
    runs = Runs(path)
    for k in range(batches):
        runs.add(held.where(F.col("batch") == k).select("h1", "h2", "id").distinct())
    frequent = saved(runs.frequent(), f"{path}/frequent")
    total = held.count()
    hot = held.groupBy("h1", "h2").agg(F.count("*").alias("k")).where(F.col("k") > max(MIN_DOCS, total // HOT_SHARE)).select("h1", "h2")
    hot = F.broadcast(frequent.join(hot, ["h1", "h2"]))
    rest = held.select("h1", "h2", "id", "th").join(hot.select("h1", "h2"), ["h1", "h2"], "left_anti")
    gone = held.join(hot, ["h1", "h2"]).select("id", "th", "keeper", "h1", "h2").unionByName(rest.join(frequent, ["h1", "h2"]).select("id", "th", "keeper", "h1", "h2")).where("id < keeper")
    # A text's own lines bound what is gathered for it.
    return gone.groupBy("id", "th").agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))


RESULTS = ("kept_text", "n_lines", "n_dropped", "kept_sha256")


@keeping("doc_id", "text", results=RESULTS)
def dedup_lines(docs: DataFrame, batches: int = N_BATCHES) -> DataFrame:
    """docs with kept_text, n_lines, n_dropped and kept_sha256 added.

    kept_text is null where text is null or where all of its lines go.
    """
    text = F.col("text").cast("string")
    gone = dropped_lines(docs.select(id_or_least().alias("id"), F.xxhash64(text).alias("th"), text.alias("text")), batches)
    names = [c for c in docs.columns if c not in RESULTS]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: tuple[list, ...] = ([], [], [], [])
        column = batch.column(batch.schema.get_field_index("_text"))
        lists = batch.column(batch.schema.get_field_index("gone"))
        for text, null, lost in zip(bytes_of(column), column.is_null().to_pylist(), lists.to_pylist(), strict=True):
            lines = text.split(b"\n")
            kept = lines
            if lost:
                away = {np.array([x["h1"], x["h2"]], dtype="<i8").tobytes() for x in lost}
                kept = [line for line, key in zip(lines, keys(text), strict=True) if not (long_enough(key) and hashed(key) in away)]
            rest = b"\n".join(kept)
            for column_, x in zip(out, (None if null or not kept else rest, len(lines), len(lines) - len(kept), hashlib.sha256(rest).hexdigest()), strict=True):
                column_.append(x)
        own = [batch.column(batch.schema.get_field_index(c)) for c in names]
        new = [pa.array(out[0], pa.binary()).cast(pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())]
        return pa.RecordBatch.from_arrays(own + new, names=[*names, *RESULTS])

    rows = docs.select(*[docs[c] for c in names], docs["text"].cast("string").alias("_text"), id_or_least().alias("_id"), F.xxhash64(docs["text"].cast("string")).alias("_th"))
    joined = rows.join(gone.withColumnsRenamed({"id": "_id", "th": "_th"}), ["_id", "_th"], "left").drop("_id", "_th")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema), "kept_text string", "n_lines long", "n_dropped long", "kept_sha256 string"])
    return joined.mapInArrow(per_batch(step), schema)
