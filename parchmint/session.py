"""The Spark session that the plans expect."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession

#: Settings that results or plans depend on; everything else is the cluster's business.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}
#: The filter it infers below an explode repeats the exploded expression, once for each element of its inputs.
EXCLUDED = "org.apache.spark.sql.catalyst.optimizer.InferFiltersFromGenerate"
#: A setting of this engine: how many tasks every input table is dealt to, whatever its size; 0 leaves tables as their files are cut.
SPREAD = "parchmint.spread"


def session(master: str | None = None, **more: str) -> SparkSession:
    """A session with SETTINGS; master and more are for tests and benches."""
    builder = SparkSession.builder.appName("parchmint").config(map=SETTINGS | more)
    return ready((builder.master(master) if master else builder).getOrCreate())


def ready(spark: SparkSession) -> SparkSession:
    """Apply SETTINGS to a session that exists, and let its Python workers find this package."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    rules = [r for r in (spark.conf.get("spark.sql.optimizer.excludedRules", None) or "").split(",") if r]
    if EXCLUDED not in rules:
        spark.conf.set("spark.sql.optimizer.excludedRules", ",".join([*rules, EXCLUDED]))
    root = str(Path(__file__).resolve().parent.parent)
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))
    return spark


def shared_root(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir.

    Where that isn't set, a local master gets a folder of the machine's own; a cluster gets an
    error, since its executors wouldn't see such a folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="parchmint-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/parchmint/{spark.sparkContext.applicationId}"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below shared_root."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Bytes of files that a task of a stage reads at most; text costs far more to work on than to read.
SPLIT = 2 << 20


@contextlib.contextmanager
def finely_read(spark: SparkSession) -> Iterator[None]:
    """Stages are read by more tasks than there are cores, so that none waits for a task with dearer rows; the session's setting comes back."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, str(SPLIT))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def clean(spark: SparkSession) -> None:
    """Remove all that this application wrote below shared_root; results that still read from there are lost."""
    remove(spark, shared_root(spark))
