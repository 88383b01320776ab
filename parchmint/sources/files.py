"""Files in and out: images and PDF pages by binaryFile, Markdown and JSON by Spark's writers."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.plans.dialect import SPARK
from parchmint.sources import names


def read_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, modificationTime, length, content) of the files that may come in, found by the reader's own listing.

    content is only read where it is used.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(path).where(F.expr(names.allowed(SPARK, "path")))


def stream_files(spark: SparkSession, path: str) -> DataFrame:
    """read_files as a stream of new files."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(path).where(F.expr(names.allowed(SPARK, "path")))


def with_upload(files: DataFrame, language: str = "eng+ind", page: int = 1, summary_length: int = 200, summary_style: str = "concise", process_type: str = "auto", as_sign: bool = False) -> DataFrame:
    """The parameters of an upload beside each file; they are columns, so that files may differ."""
    given = {"language": language, "page": page, "summary_length": summary_length, "summary_style": summary_style, "asked": process_type, "as_sign": as_sign}
    return files.withColumns({k: F.lit(v) for k, v in given.items()}).withColumn("is_large", F.col("length") > 5 * 1024 * 1024)


def unique_names(files: DataFrame, as_of: int | None = None) -> DataFrame:
    """files with stored_name: base, time and eight characters of a random name."""
    seconds = str(as_of) if as_of is not None else "unix_timestamp()"
    token = f"md5(concat(path, '{uuid.uuid4().hex}'))"
    base = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("_base", base).withColumn("stored_name", F.expr(names.unique(SPARK, "_base", seconds, token))).drop("_base")


def write_markdown(rows: DataFrame, path: str) -> None:
    """rows (filename, md): one document for each row, under its file name as a partition."""
    rows.select(F.expr(names.base(SPARK, "filename")).alias("name"), F.col("md").alias("value")).write.mode("append").partitionBy("name").option("lineSep", "\n").text(path)


def list_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(filename, created, size, url) of the documents written to path, the newest first."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).drop("content")
    name = F.regexp_extract("path", r"name=([^/]*)/", 1)
    return found.where("length > 0").select(F.concat(name, F.lit(".md")).alias("filename"), F.col("modificationTime").alias("created"), F.col("length").alias("size")).where("filename <> '.md'").withColumn("url", F.concat(F.lit("/api/markdown/"), "filename")).orderBy(F.desc("created"), "filename")


def read_markdown(spark: SparkSession, path: str, filename: str) -> DataFrame:
    """(value): the lines of one document; nothing if there is none. Only its partition is read."""
    return spark.read.text(path).where(F.col("name") == filename.removesuffix(".md")).select("value")


def write_results(rows: DataFrame, path: str) -> None:
    """Result rows as JSON lines."""
    rows.write.mode("append").json(path)


TITLE = "Document recognition API"
ENDPOINTS = (
    ("/api/", "GET", "catalogue"),
    ("/api/process", "POST", "read_files, pdf_pages, process_images, process_reports"),
    ("/api/task_status/<id>", "GET", "w5_status"),
    ("/api/markdown", "GET", "list_markdown"),
    ("/api/markdown/<filename>", "GET", "read_markdown"),
    ("/api/stats", "GET", "s11_stats"),
    ("/api/docs", "GET", "catalogue"),
    ("/health", "GET", "catalogue"),
)


def catalogue(spark: SparkSession) -> DataFrame:
    """What the service offers, as rows: endpoint, method, what stands for it here, and what the index and the documents say."""
    listed = json.dumps({"name": TITLE, "endpoints": [{"path": path, "method": method} for path, method, _ in ENDPOINTS]})
    said = {"/api/": json.dumps({"name": TITLE}), "/api/docs": listed, "/health": json.dumps({"status": "healthy"})}
    return spark.createDataFrame([(path, method, query, said.get(path)) for path, method, query in ENDPOINTS], "endpoint string, method string, query string, says string")
