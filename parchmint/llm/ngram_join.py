"""N-gram Jaccard join: a grouped prefix join over word shingles, and near-duplicate classes.

A document is the set of its distinct five-word shingles (shingles.py). Two documents link when
100 * intersection >= 80 * union. All shingles get one order, the rarest first: rarity is read
from a fixed-size array of counts over the whole corpus (any fixed order gives the same links;
this one keeps passages that many documents share out of the prefixes). Two linked documents
share a shingle among the first n - ceil(0.8 n) + 1 of each.

1. Collapse: documents with the same set are one class; classes with the same prefix and size are
   one group.
2. Meet: groups stand in the lists of their prefix shingles, in overlapping bands of size (two
   linked sizes differ by a factor of 1.25 at most and so share a band). Each list names its best
   connected group as hub.
3. Group pairs: each list pairs its hub with every other group of it, one pair a row. Pairs whose
   sizes, or whose places of the shared shingle, rule out enough overlap are filtered. What is
   left is expanded to classes and verified: the hub's first class against all others of the
   pair. A group of several classes is paired with itself as well.
4. What may still be missing are links of two classes other than a hub's first. A list needs no
   more work if all of them are linked to one class by step 3, as near copies are, or if there is
   one alone, as in most lists. Those that are open are expanded and verified among themselves, in
   blocks; blocks of classes that are linked already aren't paired. An inverted index inside the
   task counts intersections, and only a spanning forest of the links leaves it.
5. Links become classes of near copies (components.py).

All verification is on sorted shingle hashes, made once for each class that stands in a pair. A
task gets BLOCK classes, or two blocks of them, whatever the size of a list.

Nulls: a null text is an empty one; an empty document links with nothing. A null id is below
every other. Repeated rows of one id count as documents of their own, in one class if their
texts agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmint.llm.common import NULL_ID, SPACE, bytes_of, driver_released, id_or_least, keeping, per_batch, released, saved, scratch
from parchmint.llm.components import components
from parchmint.llm.segments import summed
from parchmint.llm.shingles import WordHashes, shingle_set

#: Counts of the order of shingles: 2**22 counters, 32 MB where they are used, at any size of the input.
ORDER_BITS = 22
#: The most classes in one block of a list's or a group's; a task holds two blocks.
BLOCK = 512
MEMBERS = "id long, th long, v long, g long, n long, prefix array<bigint>"


def least_overlap(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    return -(-percent * n // 100)


def shingle_order(docs: DataFrame) -> np.ndarray:
    """Counts by the low bits of a shingle's hash, over all documents."""
    mask = np.uint64((1 << ORDER_BITS) - 1)

    def indexes(batch: pa.RecordBatch) -> np.ndarray:
        hashes = WordHashes()
        sets = [shingle_set(x, hashes) for x in bytes_of(batch.column(0))]
        return (np.concatenate(sets) & mask).astype(np.int32) if sets else np.empty(0, np.int32)

    return summed(docs.select(F.col("text").cast("string")), indexes, ORDER_BITS)


def signed(digest: int) -> int:
    return digest - 2**64 if digest >= 2**63 else digest


def set_id(x: np.ndarray) -> int:
    """Names a set; documents with one set are one class."""
    return signed(xxhash.xxh3_64_intdigest(x.tobytes(), 1))


def members(docs: DataFrame, percent: int) -> DataFrame:
    """Per document: id, hash th of the text, class v, group g, size n and prefix, in the order of all shingles."""
    order = docs.sparkSession.sparkContext.broadcast(shingle_order(docs).clip(max=2**31 - 1).astype(np.int32))
    mask = np.uint64((1 << ORDER_BITS) - 1)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, counts, rows = WordHashes(), order.value, []
        for text in bytes_of(batch.column(2)):
            x = shingle_set(text, hashes)
            n = len(x)
            prefix = x[np.lexsort((x, counts[(x & mask).astype(np.int64)]))[: n - least_overlap(n, percent) + 1]] if n else x
            group = signed(xxhash.xxh3_64_intdigest(n.to_bytes(8, "little") + prefix.tobytes(), 2))
            rows.append((set_id(x), group, n, prefix.view(np.int64)))
        v, g, n, prefix = zip(*rows, strict=True)
        offsets = np.cumsum([0, *map(len, prefix)], dtype=np.int32)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(v, pa.int64()), pa.array(g, pa.int64()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(prefix)))], names=["id", "th", "v", "g", "n", "prefix"])

    return keyed(docs).mapInArrow(per_batch(step), MEMBERS)


def keyed(docs: DataFrame) -> DataFrame:
    """(id, th, text): id and th tell rows apart whose texts differ, also where ids are null or repeated."""
    text = F.col("text").cast("string")
    return docs.select(id_or_least().alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def sets_of(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(v, hashes): the sorted hashes of each class of needed (id, th, v), from one of its documents."""

    def run(batches):
        hashes, last = WordHashes(), None
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for *key, v, text in zip(*(c.to_pylist() for c in batch.columns[:3]), bytes_of(batch.column(3)), strict=True):
                if key != last and set_id(x := shingle_set(text, hashes)) == v:  # equal rows stand side by side
                    out[0].append(v)
                    out[1].append(x.tobytes())
                last = key
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())], names=["v", "hashes"])
        released()

    return keyed(docs).join(needed, ["id", "th"]).select("id", "th", "v", "text").mapInArrow(run, "v long, hashes binary")


def overlaps(values: np.ndarray, owner: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """How many values of x each of n owners has; values are sorted."""
    low, high = np.searchsorted(values, x, "left"), np.searchsorted(values, x, "right")
    length = high - low
    at = np.repeat(low - (np.cumsum(length) - length), length) + np.arange(length.sum())
    return np.bincount(owner[at], minlength=n)


def star(found: pa.Table, percent: int) -> tuple[list[int], list[int]]:
    """Links of the centre with the others of a table (v, centre, hashes)."""
    rows = list(zip(found["v"].to_pylist(), found["centre"].to_pylist(), found["hashes"].to_pylist(), strict=True))
    centre = next(((v, np.frombuffer(h, dtype=np.uint64)) for v, c, h in rows if c), None)
    sets = {v: np.frombuffer(h, dtype=np.uint64) for v, c, h in rows if not c and centre and v != centre[0]}
    if not sets:
        return [], []
    both = [len(np.intersect1d(x, centre[1], assume_unique=True)) for x in sets.values()]
    near = [v for (v, x), k in zip(sets.items(), both, strict=True) if 100 * k >= percent * (len(x) + len(centre[1]) - k)]
    return [centre[0]] * len(near), near


def linked(found: pa.Table, percent: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the links of a table (v, root, hashes), beyond what shares a root."""
    sets = {v: np.frombuffer(h, dtype=np.uint64) for v, h in zip(found["v"].to_pylist(), found["hashes"].to_pylist(), strict=True)}
    of = dict(zip(found["v"].to_pylist(), found["root"].to_pylist(), strict=True))
    names = sorted(sets, key=lambda v: (len(sets[v]), v))
    if len(set(of.values())) < 2:
        return [], []
    size = np.array([len(sets[v]) for v in names])
    values = np.concatenate([sets[v] for v in names])
    owner = np.repeat(np.arange(len(names)), size)
    by = np.argsort(values, kind="stable")
    values, owner = values[by], owner[by]
    _, root = np.unique([of[v] for v in names], return_inverse=True)
    a, b = [], []
    # The best connected one first: in a cluster of near copies it links most others at once.
    often = np.searchsorted(values, values, "right") - np.searchsorted(values, values, "left")
    weight = np.bincount(owner, weights=often, minlength=len(names)) / size
    for k in np.argsort(-weight, kind="stable"):
        both = overlaps(values, owner, sets[names[k]], len(names))
        near = np.flatnonzero((100 * both >= percent * (size + size[k] - both)) & (root != root[k]))
        for m in near:
            if root[m] != root[k]:
                a.append(names[k])
                b.append(names[m])
                root[root == root[m]] = root[k]
        if (root == root[0]).all():
            break
    return a, b


def verified(rows: DataFrame, keys: tuple[str, ...], check, percent: int) -> DataFrame:
    """Links (a, b) that check finds in each group of rows."""

    def run(found: pa.Table) -> pa.Table:
        a, b = check(found, percent)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy(*keys).applyInArrow(run, "a long, b long")


def met(groups: DataFrame, percent: int, path: str) -> DataFrame:
    """groups (g, classes, n, prefix). (token, band, hub, g, classes, k, fits) for each group of a list.

    k: how many classes the list has; fits: whether hub and g may link, by sizes and places.
    """
    # One list for each shingle and band; a list of one group has nothing to compare.
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent)) - 1e-9)
    tokens = groups.select("g", "classes", "n", F.posexplode("prefix").alias("at", "token"))
    # Dealt by shingle alone, so that a row moves once for both of its bands.
    lists = tokens.repartition("token").select("g", "classes", "n", "at", "token", F.explode(F.array(band, band + 1)).alias("band"))
    of_list = Window.partitionBy("token", "band")
    hub = F.max(F.struct(F.xxhash64("g").alias("hash"), "g", "n", "at")).over(of_list)
    lists = lists.withColumn("k", F.sum("classes").over(of_list)).withColumn("groups", F.count("*").over(of_list)).withColumn("hub", hub).where("groups > 1")
    # Of the first shingle that two groups share, no more than what follows it can be shared.
    most = F.least(F.col("n") - F.col("at"), F.col("hub.n") - F.col("hub.at"))
    fits = (100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n")) & ((100 + percent) * most >= percent * (F.col("n") + F.col("hub.n")))
    return saved(lists.select("token", "band", F.col("hub.g").alias("hub"), "g", "classes", "k", fits.alias("fits")), f"{path}/met")


def blocked(rows: DataFrame) -> DataFrame:
    """rows (hub, v, root) dealt to pairs of blocks: adds i and j.

    Classes of one root fill blocks of their own where they are many; blocks of one and the same
    root alone aren't paired, nor with themselves. The others share blocks by hash.
    """
    sizes = rows.groupBy("hub", "root").agg(F.count("*").alias("k"))
    whole = sizes.groupBy("hub").agg(F.ceil(F.sum(F.when(F.col("k") <= BLOCK, F.col("k"))) / BLOCK).alias("shared"), F.count("*").alias("roots")).where("roots > 1")
    of = F.when(F.col("k") > BLOCK, F.col("root"))
    part = F.when(F.col("k") > BLOCK, F.pmod(F.xxhash64("v"), F.ceil(F.col("k") / BLOCK))).otherwise(F.pmod(F.xxhash64("root"), F.col("shared")))
    placed = rows.join(sizes, ["hub", "root"]).join(whole, "hub").select("hub", "v", "root", of.alias("of"), F.concat_ws(":", F.coalesce(of.cast("string"), F.lit("")), part).alias("own"))
    blocks = placed.select("hub", "of", F.col("own").alias("i")).distinct()
    pairs = blocks.join(blocks.select("hub", F.col("of").alias("with"), F.col("i").alias("j")), "hub").where("i <= j and coalesce(of <> with, true)")
    either = pairs.select("hub", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("own"))
    return placed.join(either, ["hub", "own"]).select("hub", "v", "root", "i", "j")


def near_classes(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Per document of docs (doc_id, text): id, v (its set), n (its size) and component (least id reachable by links).

    id is doc_id, or NULL_ID where that is null. One row for each row of docs. head, (id, th), is
    the least document of the component; th tells apart texts of one id.
    """
    spark = docs.sparkSession
    path = scratch(spark, "ngram_join")
    rows = saved(members(docs, percent), f"{path}/members")
    full = rows.where("n > 0")
    classes = saved(full.groupBy("v").agg(F.min(F.struct("id", "th")).alias("of"), F.first("g").alias("g")).select("v", "of.id", "of.th", "g"), f"{path}/classes")
    firsts = saved(classes.groupBy("g").agg(F.min(F.struct("id", "th", "v")).alias("of"), F.count("*").alias("classes")).select("g", "of.id", "of.th", F.col("of.v").alias("first"), "classes"), f"{path}/firsts")
    heads = firsts.select(F.col("g").alias("hub"), "first")
    groups = full.select("g", "id", "th", "n", "prefix").join(firsts.select("g", "id", "th", "classes"), ["g", "id", "th"]).dropDuplicates(["g", "id", "th"])  # dealt by these already
    lists = met(groups, percent, path)
    many = firsts.where("classes > 1").select(F.col("g").alias("hub"), "g")
    # The group pairs, expanded to classes against the hub's first.
    pairs = lists.where("fits and hub <> g").select("hub", "g").union(many).distinct()
    expanded = saved(pairs.join(classes.select("g", "v"), "g").join(heads, "hub").where("v <> first").select("hub", "v", "first"), f"{path}/pairs")
    # Lists of two classes are settled by their one pair; all of any other list may be needed.
    wide = lists.where("k > 2").select("g").distinct().join(classes, "g").select("v")
    needed = expanded.select("v").union(expanded.select("first")).union(wide).distinct().join(classes, "v").select("id", "th", "v")
    sets = saved(sets_of(docs, needed), f"{path}/sets")
    spread = expanded.groupBy("hub", "first").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    centres = spread.select("hub", F.col("first").alias("v"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("centre"))
    others = expanded.join(spread.select("hub", "blocks"), "hub").select("hub", "v", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("centre"))
    driver_released(spark)
    links = saved(verified(centres.union(others).join(sets, "v"), ("hub", "block"), star, percent), f"{path}/links")
    # What one class links is one root; unequal roots may still be linked.
    roots = links.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("root"))
    own = saved(classes.join(roots, "v", "left").select("g", "v", F.coalesce("root", "v").alias("root")), f"{path}/own")
    # What is open: two roots beside the hub's first class.
    ends = (F.min("root").alias("least"), F.max("root").alias("most"))
    beside = own.join(firsts.select("g", "first"), "g").where("v <> first").groupBy("g").agg(*ends)
    spans = own.groupBy("g").agg(*ends)
    wide = lists.where("k > 2")
    within = wide.where("hub <> g").join(spans, "g").unionByName(wide.where("hub = g and classes > 1").join(beside, "g"))
    open_ = within.groupBy("token", "band").agg(F.min("least").alias("least"), F.max("most").alias("most")).where("least < most").select("token", "band")
    left = wide.join(open_, ["token", "band"], "left_semi").select("hub", "g")
    inside = many.join(beside.where("least < most"), "g", "left_semi").select("hub", "g")
    clusters = left.union(inside).distinct().join(own, "g").join(heads, "hub").where("v <> first").select("hub", "v", "root")
    dealt = blocked(saved(clusters, f"{path}/clusters"))
    driver_released(spark)
    more = verified(dealt.join(sets, "v"), ("hub", "i", "j"), linked, percent)
    roots = components(saved(links.unionByName(more).distinct(), f"{path}/all_links"))
    of_class = classes.join(roots, "v", "left").select("v", "id", "th", F.coalesce("root", "v").alias("root"))
    driver_released(spark)
    least = of_class.groupBy("root").agg(F.min(F.struct("id", "th")).alias("head"))
    named = saved(of_class.join(least, "root").select("v", "head"), f"{path}/named")
    return rows.select("id", "v", "n").join(named, "v", "left").select("id", "v", "n", F.coalesce("head.id", "id").alias("component"), "head")


def real_id(name: str) -> Column:
    return F.when(F.col(name) != NULL_ID, F.col(name))


@keeping("doc_id", "text")
def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs without near copies: of each class the document with the least id, by hash of text where ids are equal.

    Every column is kept as it is. Documents without words stay, all of them. Of rows equal in id
    and text one stays, whichever that is.
    """
    heads = near_classes(docs.select("doc_id", "text"), percent).where("n > 0").select(F.col("head.id").alias("_id"), F.col("head.th").alias("_th")).distinct()
    marked = docs.withColumns({"_id": id_or_least(), "_th": F.xxhash64(F.col("text").cast("string"))})
    words = F.coalesce(F.col("text").cast("string").rlike(f"[^{SPACE}]"), F.lit(False))
    one = marked.where(words).join(heads, ["_id", "_th"], "left_semi").dropDuplicates(["_id", "_th"])
    return one.unionByName(marked.where(~words)).select(*docs.columns)
