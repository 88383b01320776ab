"""Document fingerprints by Order MinHash, in DataFrame functions alone.

Symbols are runs of non-space cut to CUT code points (so that text without spaces has many).
The k-mers are K symbols long (fewer symbols make one k-mer). Equal k-mers of a text are numbered
by occurrence, and every numbered k-mer is hashed. The SKETCH least hashes are selected; each two
neighbours among them, by hash and so anywhere in the text, form a tuple that keeps the order
they have in the text and is hashed to one element of the signature. Elements thus agree where
texts share k-mers in the same order, which is what a small edit distance means; shuffled words
change them all, and moved blocks those whose order they turn.

This is Order MinHash with tuples of two. The original draws each tuple under a hash function of
its own; here all tuples are chained neighbours of one bottom sketch, so a text is hashed once
and not SKETCH times. An element still is a pair of least numbered k-mers in text order, but
neighbouring elements share a k-mer: they err together, which widens the spread of the likeness
without moving its order.

Everything happens within a row, in time n log n of its length: occurrence numbers come from
sorting (k-mer, place) and counting through each run of equal k-mers. Hash and place share one
number, so all sorting is of plain integers.

Documents are dealt to ranges of (id, hash of the text) to meet their next one. Bounds of the
ranges are quantiles of a sample of these keys, so no distribution of ids makes a large range;
rows that are equal in id and text, beyond HOT of them, go once and are multiplied at the end.

A signature is a set of 32-bit elements; likeness is its Jaccard similarity, 1 for two empty
ones. Nulls: a null text is an empty one, whose fingerprint is the empty string; a null id comes
before every other. Rows of one id follow each other by the hash of their text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmint.llm.common import SPACE, id_or_least, saved, scratch

K, CUT = 2, 12
SKETCH = 64
#: Bits of a place in a text; a Spark string has fewer symbols.
PLACE_BITS = 30
#: Keys in a range, how many ranges there are at most (hence a bounded broadcast), and how many sampled keys bound them.
PER_RANGE, MAX_RANGES, SAMPLE = 1000, 100_000, 1 << 18
#: Equal rows that go once: more than this, and more than 1 / HOT_SHARE of all rows (HOT_SHARE keys at most).
HOT, HOT_SHARE = 1000, 20_000


def with_signature(rows: DataFrame, text: str, name: str) -> DataFrame:
    """rows with column `name` added: the sorted signature of column `text`, an array<bigint>.

    Each step is a column of its own, so that none is evaluated twice.
    """
    place = (1 << PLACE_BITS) - 1
    hash_mask = (1 << (63 - PLACE_BITS)) - 1
    steps = [
        ("_w", F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"[^{SPACE}]{{1,{CUT}}}"), F.lit(0)), lambda w: F.xxhash64(w))),
        # (k-mer, place) in one number; k-mers by 33 bits, the places below them.
        ("_k", F.expr(f"transform(slice(_w, 1, greatest(size(_w) - {K - 1}, least(size(_w), 1))), (h, i) -> shiftleft(xxhash64(h{''.join(f', get(_w, i + {j})' for j in range(1, K))}) & {hash_mask}L, {PLACE_BITS}) | cast(i as bigint))")),
        ("_s", F.sort_array("_k")),
        # Where runs of equal k-mers begin, then 1, 2, ... through each.
        ("_b", F.expr(f"filter(transform(_s, (x, i) -> if(i = 0 or shiftright(x, {PLACE_BITS}) <> shiftright(get(_s, i - 1), {PLACE_BITS}), i, -1)), i -> i >= 0)")),
        ("_o", F.expr("flatten(transform(_b, (b, j) -> sequence(1, coalesce(get(_b, j + 1), size(_s)) - b)))")),
        # The least numbered k-mers by hash, each with its place below the hash.
        ("_h", F.expr(f"zip_with(_s, _o, (x, o) -> shiftleft(xxhash64(shiftright(x, {PLACE_BITS}), o) & {hash_mask}L, {PLACE_BITS}) | (x & {place}L))")),
        ("_m", F.slice(F.sort_array("_h"), 1, SKETCH)),
        # Neighbours by hash stand anywhere in the text; each pair is hashed in the order it has there.
        (name, F.expr(f"sort_array(array_distinct(transform(slice(_m, 1, greatest(size(_m) - 1, least(size(_m), 1))), (e, r) -> if(coalesce((get(_m, r + 1) & {place}L) < (e & {place}L), false), xxhash64(shiftright(get(_m, r + 1), {PLACE_BITS}), shiftright(e, {PLACE_BITS})), xxhash64(shiftright(e, {PLACE_BITS}), shiftright(get(_m, r + 1), {PLACE_BITS}))) & 4294967295L)))")),
    ]
    for column, value in steps:
        rows = rows.withColumn(column, value)
    return rows.drop(*[c for c, _ in steps[:-1]])


def written(signature: Column) -> Column:
    """A signature as text: eight hexadecimal digits for each element."""
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def ranged(keys: DataFrame, folder: str) -> tuple[Callable[[DataFrame], DataFrame], DataFrame]:
    """keys (_id, _tie): what adds their range's number to rows, and the first key of each range with the range before it."""
    spark = keys.sparkSession
    n = keys.count()
    ranges = max(1, min(MAX_RANGES, n // PER_RANGE))
    key = F.struct("_id", "_tie")
    taken = keys.where(F.pmod(F.xxhash64("_tie", "_id"), F.lit(max(1, n // SAMPLE))) == 0)
    listed = taken.agg(F.sort_array(F.collect_list(key)).alias("all"))
    step = f"ceil(size(all) / {ranges})"
    bounds = saved(listed.select(F.expr(f"filter(all, (x, i) -> i > 0 and i % {step} = 0)").alias("bounds")), f"{folder}/bounds")
    bounds.createOrReplaceTempView(view := f"bounds_{uuid.uuid4().hex}")
    halves = ", ".join(str(1 << k) for k in reversed(range(ranges.bit_length())))

    def numbered(rows: DataFrame) -> DataFrame:
        """rows with _range: how many bounds are at most their key, by halving steps through one array for all rows."""
        step = "(a, s) -> if(coalesce(get(_bounds, a + s - 1) <= struct(_id, _tie), false), a + s, a)"
        return rows.withColumn("_bounds", F.expr(f"(SELECT bounds FROM {view})")).withColumn("_range", F.expr(f"aggregate(array({halves}), 0, {step})")).drop("_bounds")

    found = numbered(keys).groupBy("_range").agg(F.min(key).alias("_first"))
    firsts = saved(found, f"{folder}/firsts")
    order = Window.orderBy("_range")  # MAX_RANGES rows at most
    before = F.lag("_range").over(order)
    last = F.max("_range").over(Window.partitionBy())
    return numbered, firsts.select(F.col("_first._id").alias("_first_id"), F.col("_first._tie").alias("_first_tie"), F.coalesce(before, last).alias("_to"), before.isNull().alias("_wrap"))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, signature, next_text, next_signature): the document that follows by doc_id, after the last the first.

    The text moves once: each row goes to its range of ids, and the first of a range also to the
    range before, marked as not its own.
    """
    folder = scratch(docs.sparkSession, "fingerprints")
    keyed = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumns({"_id": id_or_least(), "_tie": F.xxhash64(F.col("text").cast("string"))})
    counted = saved(keyed.groupBy("_id", "_tie").agg(F.count("*").alias("_copies")), f"{folder}/keys")
    total = counted.agg(F.sum("_copies")).first()[0] or 0
    hot = F.broadcast(counted.where(F.col("_copies") > max(HOT, total // HOT_SHARE)))
    # Equal rows: one of them stands for all, pre-aggregated by task.
    single = keyed.join(hot, ["_id", "_tie"], "left_anti").withColumn("_copies", F.lit(1).cast("long"))
    merged = keyed.join(hot.select("_id", "_tie"), ["_id", "_tie"], "left_semi").groupBy("_id", "_tie").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("_copies"))
    numbered, firsts = ranged(counted.select("_id", "_tie"), folder)
    rows = numbered(with_signature(single.unionByName(merged), "text", "signature"))
    rows = rows.join(F.broadcast(firsts), (rows["_id"] == firsts["_first_id"]) & (rows["_tie"] == firsts["_first_tie"]), "left")
    own = F.struct(F.col("_range").alias("to"), F.lit(True).alias("own"), F.lit(0).alias("turn"))
    other = F.struct(F.col("_to").alias("to"), F.lit(False).alias("own"), F.col("_wrap").cast("int").alias("turn"))
    placed = rows.withColumn("_at", F.explode(F.when(F.col("_first_id").isNull(), F.array(own)).otherwise(F.array(own, other))))
    order = Window.partitionBy("_at.to").orderBy("_at.turn", "_id", "_tie", F.desc("_at.own"))
    follows = lambda c: F.lead(c).over(order)
    paired = placed.select("doc_id", "text", "signature", "_copies", F.col("_at.own").alias("_own"), follows("text").alias("next_text"), follows("signature").alias("next_signature")).where("_own")
    # All but the last of equal rows are followed by their equal.
    each = paired.withColumn("_copy", F.explode(F.expr("sequence(1L, _copies)")))
    same = lambda a, b: F.when(F.col("_copy") < F.col("_copies"), F.col(b)).otherwise(F.col(a)).alias(a)
    return each.select("doc_id", "text", "signature", same("next_text", "text"), same("next_signature", "signature"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document of docs (doc_id, text; others are left out): n_chars, edited text, fingerprints and likenesses.

    The edited text replaces the last half of a document's code points (rounded down) by as many
    of the next document's first, or all of them.
    """
    pairs = with_next(docs.select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.char_length(text) / 2).cast("int")
    pairs = pairs.withColumn("n_chars", F.char_length(text).cast("long"))
    pairs = pairs.withColumn("edited", F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half)))
    pairs = with_signature(pairs, "edited", "edited_signature")
    return pairs.select(
        "doc_id",
        "n_chars",
        "edited",
        written(F.col("signature")).alias("fingerprint"),
        written(F.col("edited_signature")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )
