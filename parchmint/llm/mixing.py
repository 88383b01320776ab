"""Mixing sources to target weights, by hash-random keys and distributed prefix sums.

All of it is DataFrame operations. A document's size is its number of words. The whole mix is as
large as the whole input; sources, by code point with null last, share it by WEIGHTS, repeating.
No target exceeds MAX_EPOCHS times its source's size; what is cut off there is shared by weight
among the others until none is above.

Within a source, documents are ordered by a hash-random key. The key's leading bits split each
source into RANGES ranges of equal expectation; sizes are summed by range before they are
shuffled, a prefix sum over ranges finds the one where the source's budget ends, and only this
range's documents (one in RANGES of their source) are sorted and summed one by one. The cut is
then one row for each source: whole epochs, the key where the last epoch ends, and what is left
for that key. It is applied to all documents without moving any text. A source that holds a
third of all rows costs no more than the others: no task sees it whole.

There may be as many sources as hosts. Their ranks and caps are prefix sums over ranges of the
sorted sources, so no task sees them all. Up to BROADCAST sources (a row of some 100 bytes each)
are broadcast to the documents; beyond, documents and sources are joined by source, dealt to SALTS
salts each.

Shares need no text: `shares` reads each text once, for its size, and goes on with ids, sources,
keys and sizes alone. `mixed` gives the documents themselves and counts their words a second time,
because joining sizes back by id would move every text.

The cut is exact: the document at the cut is taken in part, so that a source's taken words are
its target rounded down. Documents with one key (repeated rows) at the cut share what is left in
proportion to their sizes, rounded down.

Nulls: a null text has size 0; a null source is a source of its own, the last; a null doc_id has
a key of its own. Empty tables mix to empty tables. Sources without words have target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmint.llm.common import SPACE, keeping, n_words, saved, scratch, summed_before

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Ranges of each source, a power of 16.
RANGES = 4096
KEY_BITS = 60
BROADCAST, SALTS = 100_000, 16


def key_of(doc_id: Column, seed: int) -> Column:
    """60 hash-random bits of the id, as MD5 gives them."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """sizes: (source, source_size), one row for each source. Adds weight and target.

    A source is capped if most * size is below its share of what the capped ones leave. With
    sources by rising most * size / weight, that level is the largest of (all words - caps so
    far) / (weights from here on).
    """
    folder = scratch(sizes.sparkSession, "mix_targets")
    name = [F.col("source").isNull(), F.col("source").cast("binary")]
    ranked = summed_before(sizes, name, {"_rank": F.lit(1)}, f"{folder}/names")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    w = ranked.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most).drop("_rank")
    run = summed_before(w, [F.col("cap") / F.col("weight"), *name], {"_caps": F.col("cap"), "_weights": F.col("weight")}, f"{folder}/caps")
    words, weights_ = run.agg(F.sum("source_size"), F.sum("weight")).first()
    level = run.agg(F.max((F.lit(words or 0) - F.col("_caps")) / (F.lit(weights_ or 0) - F.col("_weights")))).first()[0]
    return run.select("source", "source_size", "weight", F.least(F.col("cap").cast("double"), F.lit(level or 0.0) * F.col("weight")).alias("target"))


def beside(rows: DataFrame, of_source: DataFrame, n_sources: int, by: Column) -> DataFrame:
    """rows with the columns of their source; of_source: (_source, ...), one row for each."""
    if n_sources <= BROADCAST:
        return rows.join(F.broadcast(of_source), rows["source"].eqNullSafe(of_source["_source"])).drop("_source")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    every = of_source.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return salted.join(every, salted["source"].eqNullSafe(every["_source"]) & (salted["_salt"] == every["_salt"])).drop("_source", "_salt")


def cuts(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS) -> tuple[DataFrame, int]:
    """sized: (source, key, size). One row for each source: _source, source_size, target, epochs, cut, left, at_cut; and how many sources.

    A document is taken epochs times, once more where its key is below cut, and where its key is
    the cut for left / at_cut of its size.
    """
    folder = scratch(sized.sparkSession, "mix_cuts")
    part = F.shiftright("key", KEY_BITS - (RANGES.bit_length() - 1))
    ranges = saved(sized.groupBy("source", part.alias("part")).agg(F.sum("size").alias("size")), f"{folder}/ranges")
    aims = targets(ranges.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    aims = aims.withColumn("epochs", F.coalesce(F.expr("floor(target) div nullif(source_size, 0)"), F.lit(0)))
    aims = saved(aims.withColumn("rest", (F.floor("target") - F.col("epochs") * F.col("source_size")).cast("long")).withColumnRenamed("source", "_source"), f"{folder}/aims")
    n = aims.count()
    running = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = ranges.withColumn("ahead", F.coalesce(F.sum("size").over(running), F.lit(0)))
    at = beside(ahead, aims.select("_source", "rest"), n, F.col("part"))
    at = at.where((F.col("ahead") <= F.col("rest")) & (F.col("rest") < F.col("ahead") + F.col("size"))).select(F.col("source").alias("_source"), F.col("part").alias("_part"), "ahead", "rest")
    near = beside(sized.withColumn("part", part), at, n, F.col("key")).where("part = _part")
    keys = near.groupBy("source", "key", "ahead", "rest").agg(F.sum("size").alias("size"))
    within = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    keys = keys.withColumn("ahead", F.col("ahead") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    cut = keys.where((F.col("ahead") <= F.col("rest")) & (F.col("rest") < F.col("ahead") + F.col("size"))).select("source", F.col("key").alias("cut"), (F.col("rest") - F.col("ahead")).alias("left"), F.col("size").alias("at_cut"))
    whole = aims.join(cut, aims["_source"].eqNullSafe(cut["source"]), "left")
    return saved(whole.select("_source", "source_size", "target", F.col("epochs").cast("long").alias("epochs"), "cut", "left", "at_cut"), f"{folder}/cuts"), n


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, source, key, size), written."""
    rows = docs.select("doc_id", "source", key_of(F.col("doc_id"), seed).alias("key"), n_words(F.col("text")).alias("size"))
    return saved(rows, scratch(docs.sparkSession, "mix_sizes"))


def taken(rows: DataFrame, of_source: DataFrame, n: int, by: Column) -> DataFrame:
    """rows (source, _key, size, ...) with source_size, target, epochs and taken."""
    more = F.when(F.col("_key") < F.col("cut"), F.col("size")).when(F.col("_key") == F.col("cut"), F.expr("size * left div at_cut")).otherwise(F.lit(0))
    return beside(rows, of_source, n, by).withColumn("taken", (F.col("epochs") * F.col("size") + more).cast("long"))


def shares(docs: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """(doc_id, source, size, source_size, target, epochs, taken) of docs (doc_id, text, source; others are left out)."""
    rows = sized(docs, seed)
    of_source, n = cuts(rows, weights, most)
    return taken(rows.withColumnRenamed("key", "_key"), of_source, n, F.col("_key")).select("doc_id", "source", *RESULTS)


RESULTS = ("size", "source_size", "target", "epochs", "taken")


@keeping("doc_id", "text", "source", results=RESULTS)
def mixed(docs: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """docs (doc_id, text, source and any others) with size, source_size, target, epochs and taken added."""
    of_source, n = cuts(sized(docs, seed), weights, most)
    names = [c for c in docs.columns if c not in RESULTS]
    rows = docs.select(*[docs[c] for c in names], n_words(docs["text"]).alias("size"), key_of(docs["doc_id"], seed).alias("_key"))
    return taken(rows, of_source, n, F.col("_key")).select(*names, *RESULTS)


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, its white space as it was."""
    pieces = F.split(text, f"(?<=[^{SPACE}])(?=[{SPACE}])")
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


@keeping("doc_id", "text", "source")
def materialized(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix itself: each document as often as it is taken, the one at a cut with its first words."""
    names = docs.columns
    found = mixed(docs, seed).withColumn("_part", F.expr("taken - epochs * size"))
    # Documents without words cost nothing and come once.
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise((F.col("taken") + F.col("size") - 1) / F.greatest("size", F.lit(1))).cast("int")
    each = found.withColumn("_copies", copies).where("_copies > 0").withColumn("_copy", F.explode(F.expr("sequence(1, _copies)")))
    last = (F.col("_copy") > F.col("epochs")) & (F.col("_part") < F.col("size")) & (F.col("_part") > 0)
    return each.withColumn("text", F.when(last, first_words(F.col("text"), F.col("_part"))).otherwise(F.col("text"))).select(*names)
