"""Token-ID files: static rANS blocks with shared frequency tables, checkpoints and checksums.

Layout of a folder, every part of it written and committed by Spark's own writer, so that a
lost executor's attempt leaves nothing behind:

- `table`: one row (symbol, frequency) for each id that occurs, shared by all blocks.
- `blocks`: rows (part, block, n, docs, lengths, words, marks, states, crc). part numbers ranges
  of doc_id, ascending; block numbers the blocks of a part. A block holds whole documents, at
  least BLOCK_IDS ids unless the part ends, and is decoded by itself; marks and states are its
  checkpoints (rans.py); crc is checked when it is read.

Ids of all documents are counted for the table. Documents are range-partitioned by doc_id, ties
by a hash and equal rows at random, so an id that many rows hold doesn't fill one part. Nulls: a null text is an empty
one and encodes to the end id alone; a null doc_id comes before every other.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchmint.llm import rans
from parchmint.llm.common import bytes_of, id_or_least, released, saved
from parchmint.llm.tokenizing import default_path, encoder

END_ID = 1
BLOCK_IDS = 131_072
BLOCKS = "part int, block int, n long, docs array<bigint>, lengths array<bigint>, words binary, marks binary, states binary, crc long"


def encoded(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(id, ids): each document's ids with the end id, packed as the encoder packs them."""
    file = path or default_path()

    def run(batches):
        e = encoder(file)
        end = np.array([end_id], dtype=e.dtype).tobytes()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x + end for x in e.encode_all(bytes_of(batch.column(1)))], pa.binary())], names=["id", "ids"])
        e.words.clear()
        released()

    return docs.select(id_or_least().alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "id long, ids binary")


def counted(ids: DataFrame, file: str) -> DataFrame:
    def count(batches):
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            found = np.bincount(encoder(file).ids(b"".join(batch.column(0).to_pylist())))
            if len(found) > len(total):
                total, found = found, total
            total[: len(found)] += found
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"symbol": pa.array(at, pa.int64()), "k": pa.array(total[at], pa.int64())})

    return ids.select("ids").mapInArrow(count, "symbol long, k long").groupBy("symbol").agg(F.sum("k").alias("k"))


def read_table(spark: SparkSession, folder: str) -> rans.Table:
    rows = spark.read.schema("symbol long, frequency long").parquet(f"{folder}/table").orderBy("symbol").collect()
    return rans.Table(np.array([r.symbol for r in rows], dtype=np.int64), np.array([r.frequency for r in rows], dtype=np.int64))


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> None:
    """Encode docs (doc_id, text) and write them in ascending doc_id order."""
    spark, file = docs.sparkSession, path or default_path()
    ids = saved(encoded(docs, file, end_id), f"{folder}/ids")
    found = sorted(counted(ids, file).collect())  # one row for each id of the vocabulary at most
    table = rans.scaled(np.array([r.symbol for r in found], dtype=np.int64), np.array([r.k for r in found], dtype=np.int64))
    spark.createDataFrame([(int(s), int(f)) for s, f in zip(table.symbols, table.freq, strict=True)], "symbol long, frequency long").coalesce(1).write.parquet(f"{folder}/table")
    shared = spark.sparkContext.broadcast(table)

    def pack(batches):
        part, block, held, names, lengths = TaskContext.get().partitionId(), 0, [], [], []
        e = encoder(file)

        def row() -> pa.RecordBatch:
            body = rans.encode(e.ids(b"".join(held)).astype(np.int64), shared.value)
            cells = [part, block, body["n"], names, lengths, body["words"], body["marks"], body["states"], body["crc"]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], names=[c.split()[0] for c in BLOCKS.split(", ")])

        n = 0
        for batch in batches:
            for name, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append(packed)
                names.append(name)
                lengths.append(len(packed) // e.dtype.itemsize)
                n += lengths[-1]
                if n >= BLOCK_IDS:
                    yield row()
                    block, n, held, names, lengths = block + 1, 0, [], [], []
        if held:
            yield row()

    ordered = ids.withColumn("tie", F.xxhash64("ids")).withColumn("deal", F.rand(7)).repartitionByRange("id", "tie", "deal").sortWithinPartitions("id", "tie").select("id", "ids")
    ordered.mapInArrow(pack, BLOCKS).write.parquet(f"{folder}/blocks")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(part, block, place, id, ids array<bigint>) of every document, from the blocks; checksums are checked."""
    shared = spark.sparkContext.broadcast(read_table(spark, folder))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [unpacked(row, shared.value) for row in batch.to_pylist()]
        lengths = [n for row in batch.column(4).to_pylist() for n in row]
        per_row = [len(x) for x in batch.column(3).to_pylist()]
        offsets = np.cumsum([0, *lengths])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(batch.column(0).to_numpy(), per_row)),
                pa.array(np.repeat(batch.column(1).to_numpy(), per_row)),
                pa.array(np.concatenate([np.arange(n) for n in per_row]), pa.int32()),
                pa.array([x for row in batch.column(3).to_pylist() for x in row], pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids).astype(np.int32))),
            ],
            names=["part", "block", "place", "id", "ids"],
        )

    return spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").mapInArrow(few_rows(step), "part int, block int, place int, id long, ids array<int>")


def few_rows(step, rows: int = 8):
    """Like per_batch, a few rows at a time, since a block holds many documents."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield step(batch.slice(at, rows))

    return run


def unpacked(row: dict, table: rans.Table) -> np.ndarray:
    ids = rans.decode(row, table)
    if rans.crc(ids) != row["crc"]:
        raise ValueError(f"checksum of part {row['part']}, block {row['block']} is wrong")
    return ids


def starts(spark: SparkSession, folder: str) -> DataFrame:
    """(part, block, start): how many ids come before each block."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").select("part", "block", "n")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n").alias("n"))  # a row for each part, not each block
    parts = parts.select("part", F.coalesce(F.sum("n").over(before.orderBy("part")), F.lit(0)).alias("ahead"))
    within = F.coalesce(F.sum("n").over(before.partitionBy("part").orderBy("block")), F.lit(0))
    return blocks.withColumn("within", within).join(parts, "part").select("part", "block", (F.col("ahead") + F.col("within")).alias("start"))


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, read back from the files."""
    shared = spark.sparkContext.broadcast(read_table(spark, folder))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        cells: tuple[list, ...] = ([], [], [], [], [], [])
        for row in batch.to_pylist():
            ids = unpacked(row, shared.value).astype("<u4").tobytes()
            end = 0
            for place, (name, n) in enumerate(zip(row["docs"], row["lengths"], strict=True)):
                for column, x in zip(cells, (row["part"], row["block"], name, end, n, zlib.crc32(ids[4 * end : 4 * (end + n)])), strict=True):
                    column.append(x)
                end += n
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=["part", "block", "id", "ahead", "n_tokens", "ids_crc32"])

    rows = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").mapInArrow(few_rows(step), "part int, block int, id long, ahead long, n_tokens long, ids_crc32 long")
    return rows.join(starts(spark, folder), ["part", "block"]).select("id", (F.col("start") + F.col("ahead")).alias("start"), "n_tokens", "ids_crc32")
