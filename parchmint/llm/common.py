"""What the operators of this folder share: scratch tables, tokens, Arrow loops."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchmint.session import shared_folder

#: The white space of every contract here, as a regular-expression class and as characters.
SPACE = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a null id where ids are compared: below every real one.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows in an Arrow batch, so that long texts don't fill a Python worker; a number that the user has set stays.
ARROW_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "500")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder, for an operator that begins; what those before it left in the driver goes."""
    driver_released(spark)
    key, default, rows = ARROW_ROWS
    if spark.conf.get(key) == default:
        spark.conf.set(key, rows)
    return shared_folder(spark, name)


def saved(df: DataFrame, path: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_or_least(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def bytes_of(column: pa.Array) -> list[bytes]:
    """The UTF-8 of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def released() -> None:
    """Give memory back at the end of a task: idle Python workers stay beside the executor's JVM."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


#: Share of the driver's heap that may be used before spent plans are collected.
USED = 0.25


def driver_released(spark: SparkSession) -> None:
    """Give back what spent plans hold in the driver.

    Spark lets go of a plan's broadcasts and shuffles when the driver's JVM finds that nothing
    refers to them, and the JVM rather grows than looks. Its native memory, which compiled plans
    take, stays with the allocator until it is asked for; a JVM without that command keeps it.
    """
    gc.collect()  # frames that Python doesn't refer to any more are held for it by the JVM
    released()
    jvm = spark.sparkContext._jvm
    heap = jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() - heap.freeMemory() > USED * heap.maxMemory():
        jvm.java.lang.System.gc()
    commanded(spark, "systemTrimNativeHeap")


def commanded(spark: SparkSession, name: str) -> str | None:
    """What a diagnostic command without arguments answers; None from a JVM that doesn't have it."""
    jvm = spark.sparkContext._jvm
    args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), name
    # The server's own class isn't public; its interface is.
    call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    try:
        return call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        return None


def per_batch(step: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that applies step to each batch that has rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := step(batch)) is not None:
                yield out
        released()

    return run


def keeping(*needed: str, results: tuple[str, ...] = ()) -> Callable:
    """For operators that take a table and return its rows with results added.

    The operator sees the needed columns and, as one struct of a fresh name, all others; so no
    other column can clash with what it uses inside. Columns come back in their order, results
    after them; a column that has a result's name gives way to the result.
    """

    def wrap(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(operator)
        def run(rows: DataFrame, *args, **kwargs) -> DataFrame:
            names = list(dict.fromkeys(rows.columns))
            extra = [c for c in names if c not in needed and c not in results]
            box = f"rest_{uuid.uuid4().hex}"
            own = [F.col(f"`{c}`") for c in needed]
            out = operator(rows.select(*own, F.struct(*[F.col(f"`{c}`") for c in extra]).alias(box)) if extra else rows.select(*own), *args, **kwargs)
            back = [F.col(f"{box}.`{c}`").alias(c) if c in extra else F.col(f"`{c}`") for c in names if c not in results]
            return out.select(*back, *results)

        return run

    return wrap


def n_words(text: Column) -> Column:
    """How many runs of non-space a text has; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def summed_before(rows: DataFrame, order: list[Column], sums: dict[str, Column], path: str) -> DataFrame:
    """rows with the sum over all rows before them, in the given order, for each of sums.

    Rows are range-partitioned by the order and written; ranges are summed, and only one row for
    each range is summed in one task.
    """
    dealt = saved(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), path)
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    whole = dealt.groupBy("_range").agg(*[F.sum(x).alias(f"_all_{k}") for k, x in sums.items()])
    ahead = whole.select("_range", *[F.coalesce(F.sum(f"_all_{k}").over(before.orderBy("_range")), F.lit(0)).alias(f"_ahead_{k}") for k in sums])
    within = before.partitionBy("_range").orderBy(*order)
    out = dealt.withColumns({f"_within_{k}": F.coalesce(F.sum(x).over(within), F.lit(0)) for k, x in sums.items()}).join(F.broadcast(ahead), "_range")  # a row for each partition
    names = rows.columns
    return out.select(*names, *[(F.col(f"_ahead_{k}") + F.col(f"_within_{k}")).alias(k) for k in sums])
