"""Queries that SQL can't check: plug-ins, image variants, space-aligned tables, streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.functions import kernels
from parchmint.operators import aligned, measures, process, variants
from parchmint.plans import fixtures, more_fixtures
from parchmint.plans.dialect import Spark
from parchmint.session import shared_folder
from parchmint.sources import engines
from parchmint.streaming import tasks


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, content): embeddings as 8 by 8 grey images in PGM files."""
    pixels = spark.sql(f"SELECT image_id, y, x, v FROM {more_fixtures.pixels(Spark(sf_dir))}")
    cells = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "v"))), lambda p: F.lpad(F.hex(p["v"]), 2, "0")), "")
    return pixels.groupBy("image_id").agg(F.concat(F.encode(F.lit("P5\n8 8\n255\n"), "utf-8"), F.unhex(cells)).alias("content"))


def p_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variants of every strategy for every picture."""
    found = variants.every_variant(pictures(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism * 2))
    return found.select("image_id", "strategy", "ord", "variant", "height", "width", "brightness", "contrast", F.md5("data").alias("data_md5"))


def drawn(key: int, image_type: str) -> bytes:
    """A page of lines in a PGM file: turned, or as a slanted sheet on a dark ground for natural images."""
    h, w = 240, 320
    y, x = np.mgrid[:h, :w]
    g = np.where((y % 20 < 3) & (y > 40) & (y < 200) & (x > 40) & (x < 280), 30, 220).astype(np.uint8)
    if image_type == "natural":
        d = key % 9 * 2
        sheet = (y > 15 + d * x / w) & (y < 225 - d * x / w) & (x > 20 + d * y / h) & (x < 300 - d * y / h)
        g = np.where(sheet, g, 10).astype(np.uint8)
    else:
        g = kernels.rotated(g, (key % 13 - 6) * 7)
    return b"P5\n%d %d\n255\n" % (w, h) + g.tobytes()


#: Types that drawn pages have in turn.
DRAWN = ("natural", "document", "id_card", "receipt")


def drawn_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, strategy, content): a drawn page for each nation, types dealt in turn."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kinds = [DRAWN[k % len(DRAWN)] for k in pdf["image_id"]]
            yield pd.DataFrame({"image_id": pdf["image_id"], "strategy": kinds, "content": [drawn(k, kind) for k, kind in zip(pdf["image_id"], kinds, strict=True)]})

    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("image_id"))
    return nations.mapInPandas(run, "image_id long, strategy string, content binary")


def p_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perspective, rotation and card clean-up of drawn pages."""
    return variants.image_corrections(drawn_nations(spark, sf_dir)).select("image_id", "ord", F.col("variant").alias("step"), "height", "width", "brightness", "contrast", F.md5("data").alias("data_md5"))


def drawn_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, filename, content): a drawn page for each nation, and one file that isn't an image."""
    name = F.concat(F.lit("page"), "image_id")
    pages = drawn_nations(spark, sf_dir).select(name.alias("image_id"), F.concat(name, F.lit(".pgm")).alias("filename"), "content")
    return pages.unionByName(spark.createDataFrame([("broken", "broken.png", bytearray(b"no image"))], "image_id string, filename string, content binary"))


def i_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, likelihoods and types of drawn pages and of all pictures, from their pixels."""
    small = pictures(spark, sf_dir).select(F.concat(F.lit("img"), "image_id").alias("image_id"), F.lit("x.pgm").alias("filename"), "content")
    d = Spark(session=spark)
    path = shared_folder(spark, "measures")
    measures.measured(drawn_pages(spark, sf_dir).unionByName(small)).write.parquet(path)
    return spark.sql(measures.typed(d, f"parquet.`{path}`"))


def process_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawn pages from files to results; without an engine their texts are empty, and the broken file is an error row."""
    return process.process_images(drawn_pages(spark, sf_dir))


def o4_recognise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of all engines; those that aren't installed say unavailable."""
    files = pictures(spark, sf_dir).select(F.concat(F.lit("img"), F.col("image_id"), F.lit(".pgm")).alias("path"), "content")
    return engines.recognise(files, list(engines.ENGINES))


def spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM {fixtures.tables(Spark(sf_dir))}").withColumn("text", F.regexp_replace("text", r" \| ", "     "))


def e7_space_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned.space_tables(spaced(spark, sf_dir))


def e5_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of piped, tabbed and space-aligned tables, each by its own arm."""
    d = Spark(sf_dir)
    piped, tabbed = (spark.sql(f"SELECT doc_id + {k} AS doc_id, text FROM {fixtures.tables(d, p)}") for k, p in ((1000, " | "), (2000, "\t")))
    return aligned.tables(spaced(spark, sf_dir).unionByName(piped).unionByName(tabbed))


def l6_space_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned.rewritten(spaced(spark, sf_dir), aligned.organized_table, "organized")


def l14_space_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned.rewritten(spaced(spark, sf_dir), aligned.formatted_table, "formatted")


def w4_task_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of every task after its last event, by a stream run to its end."""
    folder = shared_folder(spark, "task_status")
    source = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parque[t]")
    kind = F.when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "error").otherwise("processing")
    events = source.select(F.concat(F.lit("task"), "user_id").alias("task_id"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("event"), (60 + F.col("user_id") % 5 * 100000).alias("timeout_s"))
    # Timers of processing time ask for empty batches for ever; a replay ends with its data.
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    was = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        writer = tasks.task_status(events).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state")
        writer.foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, was)
    return tasks.latest(spark.read.schema(f"{tasks.OUTPUT}, batch long").parquet(f"{folder}/rows"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p_variants, p_corrections, i_measures, process_images, o4_recognise, e5_tables, e7_space_tables, l6_space_tables, l14_space_tables, w4_task_stream)}

#: The replayed stream in SQL: what has ended first stays ended.
ORACLES: dict[str, str] = {
    "w4_task_stream": """
SELECT task_id, coalesce(ended.event, 'processing') AS status, CASE WHEN ended IS NULL THEN 202 ELSE 200 END AS code, coalesce(ended.ts, last) - began AS elapsed
FROM (
  SELECT task_id, min(ts) AS began, max(ts) AS last, arg_min(struct_pack(event := event, ts := ts), ts) FILTER (WHERE event <> 'processing') AS ended
  FROM (SELECT 'task' || user_id AS task_id, CAST(floor(epoch(ts)) AS bigint) AS ts, CASE WHEN event_type = 'purchase' THEN 'complete' WHEN event_type = 'error' THEN 'error' ELSE 'processing' END AS event FROM events)
  GROUP BY task_id
)""",
}
