"""Connected components of a table of links, as tables all the way."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from parchmint.llm.common import driver_released, saved, scratch


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(v, root) for every vertex of links (a long, b long); root is the least vertex of its component.

    Each round takes the least root among a vertex and its neighbours, then the root of that
    root; each halves the distances, and the loop ends when nothing changes. A hub's
    neighbours are pre-aggregated before they are shuffled. Labels are written to the shared
    folder each round, so that a lost executor costs one round at most.
    """
    spark = links.sparkSession
    path = scratch(spark, "components")
    both = saved(links.where("a <> b").select("a", "b").union(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))), f"{path}/links")
    labels = saved(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("a")).alias("root")), f"{path}/0")
    for k in range(1, rounds + 1):
        driver_released(spark)
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("root").alias("near"))
        least = labels.join(near, "v").select("v", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        # What a vertex has found is told to its former root too, which its other members then see.
        told = least.select(F.col("was").alias("v"), "root").groupBy("v").agg(F.min("root").alias("told"))
        least = saved(least.join(told, "v", "left").select("v", "was", F.least("root", F.coalesce("told", "root")).alias("root")), f"{path}/{k}a")
        jump = least.select(F.col("v").alias("root"), F.col("root").alias("over"))
        new = least.join(jump, "root", "left").select("v", "was", F.least("root", F.coalesce("over", "root")).alias("root"))
        # Counted while it is written: to look for a changed row afterwards takes several jobs where there is none.
        changed = Observation()
        labels = saved(new.observe(changed, F.count_if(F.col("root") != F.col("was")).alias("rows")), f"{path}/{k}").select("v", "root")
        if not changed.get["rows"]:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
