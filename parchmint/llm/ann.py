"""Approximate nearest neighbours by inner product: inverted lists with an adaptive dimension scan.

Rows are scaled by M, the largest norm, and get one more dimension, sqrt(1 - |x|^2), which turns
the largest inner product with a query of unit length into the least distance. Lists are k-means
cells of about LIST vectors (CENTRES lists at most; with more than LIST * CENTRES vectors they
grow). Their centres are fitted on one half of a sample of FIT rows; the other half, which the
fit hasn't seen, tells how many lists hold REACHED of its own exact neighbours, as near to the
query as the neighbours among all rows would be. It also gives every query its first candidates,
and so a radius that its top-th neighbour can't exceed. Every vector is indexed. A query probes its nearest lists, that many or
until they hold enough ids, without those whose farthest vector is out of its radius by the
triangle inequality.

Vectors are turned by a random orthogonal matrix and laid out in blocks of COLUMNS columns. The
queries of a list are scanned together: distances grow block by block, and after each block a
hypothesis test abandons every pair whose partial distance is too large for one within the
radius. For a random rotation the share of s among d columns in a squared length follows the
Beta distribution of s/2 and (d - s)/2; the test cuts Z standard deviations above its mean. Blocks
are multiplied as matrices while more than DENSE of the pairs are left, then pair by pair. The
radius shrinks to the top-th best seen. What survives is scored in double precision on the
original vectors.

Neighbouring lists travel in one bundle of about BUNDLE vectors, so a query is copied once for a
bundle. A bundle of more than SEGMENT vectors is dealt out over segments, more than QUERIES
queries of it over parts, by hash. Equal vectors in a task are measured once, and only their
least ids, which win ties, are carried on. Only centres, the rotation, the sample and one row for
each list are broadcast or collected.

Vectors that are null, all zero, of another than the most frequent length, or that hold null or
non-finite numbers take no part; so don't rows whose id is null. Rows that share an id are one
candidate, at the best of their scores; where they are queries, the least of their vectors asks.
A query's own id is never among its neighbours. Ties go to the smaller id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmint.llm.common import saved, scratch

FIT, LIST, CENTRES, ROUNDS = 16_384, 64, 2048, 8
TOP = 20
#: Rows of the sample's second half that ask for the number of lists, and the share of neighbours to be reached.
TUNED, REACHED = 1024, 0.92
COLUMNS, Z, DENSE = 16, 2.6, 0.1
BUNDLE, SEGMENT, QUERIES = 4096, 20_000, 4_000
#: Rows of a list, or of a sample, that are measured at once.
CHUNK = 1024
#: What rounding in single precision may add to a squared distance of unit vectors.
ROUNDING = 1e-5


def usable(vector: Column) -> Column:
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & good & F.exists(vector, lambda x: x != 0), F.lit(False))


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of a and of b."""
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T, 0)


@dataclass
class Index:
    """norm: M; centres and the sample's second half (known, with its ids and vectors) in the turned space; bundle: of each list."""

    norm: float
    rotation: np.ndarray
    centres: np.ndarray
    bundle: np.ndarray
    known: np.ndarray
    ids: np.ndarray
    vectors: np.ndarray

    def rows(self, vectors: np.ndarray) -> np.ndarray:
        x = vectors / self.norm
        return (np.concatenate([x, np.sqrt(np.maximum(1 - (x**2).sum(1), 0))[:, None]], axis=1) @ self.rotation).astype(np.float32)

    def queries(self, vectors: np.ndarray) -> np.ndarray:
        x = vectors / np.abs(vectors).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        return (x @ self.rotation[:-1]).astype(np.float32)

    def seeds(self, turned: np.ndarray, ids: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Per query the nearest of the known rows, and the squared distance that its top-th neighbour can't exceed."""
        d = squares(turned, self.known)
        d[ids[:, None] == self.ids[None, :]] = np.inf
        if d.shape[1] <= top:
            return np.tile(np.arange(d.shape[1]), (len(d), 1)), np.full(len(d), np.inf, dtype=np.float32)
        near = np.argpartition(d, top - 1, axis=1)[:, :top]
        return near, np.take_along_axis(d, near, 1).max(1) * (1 + ROUNDING) + ROUNDING


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k centres, from evenly spread starting rows; cells that run empty restart at far rows."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own, far = np.empty(len(x), dtype=np.int64), np.empty(len(x), dtype=np.float32)
        for i in range(0, len(x), CHUNK):
            d = squares(x[i : i + CHUNK], centres)
            own[i : i + CHUNK] = d.argmin(1)
            far[i : i + CHUNK] = d.min(1)
        n = np.bincount(own, minlength=k)
        by = np.argsort(own, kind="stable")
        held = np.flatnonzero(n)
        centres[held] = np.add.reduceat(x[by], (np.cumsum(n) - n)[held], axis=0) / n[held, None]
        if (n == 0).any():
            centres[n == 0] = x[np.argsort(-far)[: (n == 0).sum()]]
    return centres


def bundles(centres: np.ndarray, most: int) -> np.ndarray:
    """A number for each centre: halves along the longest axis, until a part has `most` centres at most."""
    out, parts, k = np.zeros(len(centres), dtype=np.int32), [np.arange(len(centres))], 0
    while parts:
        part = parts.pop()
        if len(part) <= most:
            out[part] = k
            k += 1
            continue
        axis = np.linalg.svd(centres[part] - centres[part].mean(0), full_matrices=False)[2][0]
        by = part[np.argsort(centres[part] @ axis, kind="stable")]
        parts += [by[: len(by) // 2], by[len(by) // 2 :]]
    return out


def fitted(rows: DataFrame, n: int, size: int, norm: float, top: int) -> tuple[Index, int]:
    """rows (vec_id, vector). An index for n rows, and how many lists a query is to probe."""
    taken = rows.groupBy("vec_id").agg(F.min("vector").alias("vector")) if n <= FIT else rows
    taken = taken.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT).collect()
    x = np.array([r.vector for r in taken], dtype=np.float64)
    ids, at = np.unique(np.array([r.vec_id for r in taken], dtype=np.int64), return_index=True)
    at = np.sort(at)  # one row of an id, in hash order
    ids, x = np.array([taken[k].vec_id for k in at], dtype=np.int64), x[at]
    q, r = np.linalg.qr(np.random.default_rng(7).normal(size=(size + 1, size + 1)))
    nothing = np.zeros((0, size + 1), np.float32)
    index = Index(norm, q * np.sign(np.diag(r)), nothing, np.zeros(0, np.int32), nothing, ids[1::2], x[1::2])
    turned = index.rows(x)
    fit, index.known = turned[::2], turned[1::2]
    index.centres = kmeans(fit, int(np.clip(n // LIST, 1, min(CENTRES, len(fit)))))
    index.bundle = bundles(index.centres, max(1, BUNDLE * len(index.centres) // n))
    return index, probes_for(index, index.queries(x[1::2][:TUNED]), n, top) if len(index.known) > 1 else len(index.centres)


def probes_for(index: Index, ask: np.ndarray, n: int, top: int) -> int:
    """How many nearest lists hold REACHED of the neighbours of ask, the first rows of index.known.

    Of m known rows the nearest top * m / n are as near as the nearest top of n.
    """
    most = max(1, min(-(-top * len(index.known) // n), len(index.known) - 1))
    d = squares(ask, index.known)
    d[np.arange(len(ask)), np.arange(len(ask))] = np.inf
    near = np.argpartition(d, most - 1, axis=1)[:, :most]
    own = squares(index.known, index.centres).argmin(1)
    order = squares(ask, index.centres).argsort(1).argsort(1)
    return int(np.quantile(np.take_along_axis(order, own[near], 1), REACHED)) + 1


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def listed(rows: DataFrame, shared) -> DataFrame:
    """(list, bundle, far, vec_id, vector): each row once; far is its distance to the centre."""

    def run(batches):
        index = shared.value
        for batch in batches:
            if batch.num_rows:
                d = squares(index.rows(matrix(batch.column(1))), index.centres)
                own = d.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(index.bundle[own]), pa.array(np.sqrt(d.min(1))), *batch.columns], names=["list", "bundle", "far", "vec_id", "vector"])

    return rows.mapInArrow(run, "list int, bundle int, far float, vec_id long, vector array<double>")


def probed(queries: DataFrame, shared, probes: int, sizes: np.ndarray, far: np.ndarray, top: int) -> DataFrame:
    """(bundle, lists, radius, vec_id, vector, seeds, scores): each query once for each bundle where it probes lists.

    seeds: ids of the known rows nearest to the query, with their scores, in its first row alone. sizes: ids in each list; far: distance of the centre's farthest vector. A query probes more
    lists than probes if those hold fewer than top + 1 ids.
    """

    def run(batches):
        index = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = matrix(batch.column(1)), batch.column(0).to_numpy()
            aim = index.queries(x)
            near, radius = index.seeds(aim, ids, top)
            d = squares(aim, index.centres)
            order = d.argsort(axis=1, kind="stable")
            few = (np.cumsum(sizes[order], axis=1) < top + 1).sum(1) + 1
            wanted = order.argsort(1) < np.maximum(probes, few)[:, None]
            wanted &= np.sqrt(d) - far[None, :] <= np.sqrt(radius)[:, None] + ROUNDING
            wanted[np.arange(len(d)), order[:, 0]] = True  # a query has one row at least
            q, at = np.nonzero(wanted)
            key = q * (int(index.bundle.max()) + 1) + index.bundle[at]
            by = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.concatenate(([True], key[by][1:] != key[by][:-1]))) if len(by) else np.zeros(0, int)
            offsets = np.concatenate((first, [len(by)]))
            rows = pa.array(q[by][first])
            opens = np.concatenate(([True], q[by][first][1:] != q[by][first][:-1]))
            score = np.einsum("ijk,ik->ij", index.vectors[near], x)
            other = index.ids[near] != ids[:, None]
            seeds = [index.ids[near[k]][other[k]].tolist() if new else None for k, new in zip(q[by][first].tolist(), opens.tolist(), strict=True)]
            scores = [score[k][other[k]].tolist() if new else None for k, new in zip(q[by][first].tolist(), opens.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(index.bundle[at[by][first]]), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(at[by].astype(np.int32))), pa.array(radius[q[by][first]]), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(seeds, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64()))],
                names=["bundle", "lists", "radius", "vec_id", "vector", "seeds", "scores"],
            )

    return queries.mapInArrow(run, "bundle int, lists array<int>, radius float, vec_id long, vector array<double>, seeds array<long>, scores array<double>")


def share_bound(seen: int, d: int) -> float:
    """The share of a squared distance that `seen` of d columns hold, Z standard deviations above its mean."""
    mean = seen / d
    return 1.0 if seen >= d else min(1.0, mean + Z * (2 * mean * (1 - mean) / (d + 2)) ** 0.5)


def scan(x: np.ndarray, q: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, squared distance) of the pairs of q and x that no test abandons."""
    n, d = len(x), x.shape[1]
    dense, at, row, far = np.zeros((len(q), n), dtype=np.float32), None, None, None
    for a in range(0, d, COLUMNS):
        b = min(d, a + COLUMNS)
        bound = radius * share_bound(b, d) + ROUNDING
        if at is None:
            dense += squares(q[:, a:b], x[:, a:b])
            keep = dense <= bound[:, None]
            if b == d or np.count_nonzero(keep) <= DENSE * keep.size:
                at, row = np.nonzero(keep)
                far = dense[at, row]
        else:
            far = far + ((x[row, a:b] - q[at, a:b]) ** 2).sum(1)
            keep = far <= bound[at]
            at, row, far = at[keep], row[keep], far[keep]
    return at, row, far


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of the distinct rows of x, and which of them each row equals."""
    whole = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * x.itemsize)))[:, 0]
    _, first, place = np.unique(whole, return_index=True, return_inverse=True)
    return first, place


def ranked(q: np.ndarray, value: np.ndarray, ids: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the pairs by (query, value, id) without repeated ids of a query, and ranks within the query from 0."""
    by = np.lexsort((value, ids, q))
    by = by[np.concatenate(([True], (q[by][1:] != q[by][:-1]) | (ids[by][1:] != ids[by][:-1])))] if len(by) else by
    by = by[np.lexsort((ids[by], value[by], q[by]))]
    begins = np.flatnonzero(np.concatenate(([True], q[by][1:] != q[by][:-1]))) if len(by) else by
    return by, np.arange(len(by)) - np.repeat(begins, np.diff(np.append(begins, len(by))))


def searcher(shared, top: int):
    """For a bundle's queries (lists, radius, vec_id, vector) and rows (list, vec_id, vector): query_id, vec_id, score."""

    def least_ids(ids: np.ndarray, place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The top + 1 least distinct ids at each of n places, and where they begin and how many they are."""
        by, rank = ranked(place, ids, ids, top)
        by = by[rank <= top]
        count = np.bincount(place[by], minlength=n)
        return ids[by], np.cumsum(count) - count, count

    def search(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if queries.num_rows and rows.num_rows:
            out = found(queries, rows)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    def found(queries: pa.Table, rows: pa.Table) -> list[np.ndarray]:
        index = shared.value
        raw, list_of = matrix(rows["vector"]), rows["list"].to_numpy()
        first, place = distinct(raw)
        ids, start, count = least_ids(rows["vec_id"].to_numpy(), place, len(first))
        raw, list_of = raw[first], list_of[first]
        by = np.argsort(list_of, kind="stable")
        turned = index.rows(raw)
        asked, names = matrix(queries["vector"]), queries["vec_id"].to_numpy()
        q_first, q_place = distinct(asked)
        aim = index.queries(asked[q_first])
        radius = np.full(len(q_first), -np.inf, dtype=np.float32)
        np.maximum.at(radius, q_place, queries["radius"].to_numpy())
        lists = queries["lists"].combine_chunks()
        wants = np.zeros((len(q_first), int(index.bundle.size)), dtype=bool)
        wants[np.repeat(q_place, lists.value_lengths().to_numpy()), lists.flatten().to_numpy()] = True
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, np.int64))  # query, row, distance, id
        begins = np.flatnonzero(np.concatenate(([True], list_of[by][1:] != list_of[by][:-1])))
        held: list[tuple[np.ndarray, ...]] = []
        n_held = 0
        for lo, hi in zip(begins, np.append(begins[1:], len(by)), strict=True):
            asking = np.flatnonzero(wants[:, list_of[by[lo]]])
            for a in range(lo, hi, CHUNK):
                at = by[a : min(hi, a + CHUNK)]
                q, row, far = scan(turned[at], aim[asking], radius[asking])
                held.append((asking[q], at[row], far))
                n_held += len(q)
                if n_held > 8 * top * len(aim):
                    best, held, n_held = merged(best, held, radius, ids, start, count), [], 0
        q, row, _, name = merged(best, held, radius, ids, start, count)
        # To the queries that ask with this vector, each without its own id.
        order = np.argsort(q, kind="stable")
        q, row, name = q[order], row[order], name[order]
        score = np.einsum("ij,ij->i", raw[row], asked[q_first][q])
        low, high = np.searchsorted(q, q_place, "left"), np.searchsorted(q, q_place, "right")
        n = high - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        who = np.repeat(np.arange(len(names)), n)
        other = name[at] != names[who]
        who, at = who[other], at[other]
        by, rank = ranked(who, -score[at], name[at], top)
        by = by[rank < top]
        return [names[who[by]], name[at[by]], score[at[by]]]

    def merged(best: tuple[np.ndarray, ...], held: list[tuple[np.ndarray, ...]], radius: np.ndarray, ids: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
        """The pairs that may still be among the top, by id; radius shrinks to the top-th other id."""
        q, row, far = (np.concatenate(x) for x in zip(*held, strict=True)) if held else best[:3]
        if held:
            n = count[row]
            at = np.repeat(start[row] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            q, row, far, name = (np.concatenate(x) for x in zip(best, (np.repeat(q, n), np.repeat(row, n), np.repeat(far, n), ids[at]), strict=True))
        else:
            name = best[3]
        by, rank = ranked(q, far, name, top)
        last = by[rank == top]  # one more than top, since a query may find itself
        radius[q[last]] = np.minimum(radius[q[last]], far[last] * (1 + ROUNDING) + ROUNDING)
        by = by[far[by] <= radius[q[by]]]
        return q[by], row[by], far[by], name[by]

    return search


def nearest(vectors: DataFrame, is_query: Column, top: int = TOP, probes: int | None = None) -> DataFrame:
    """vectors (vec_id, embedding). Per query: query_id, rank from 1, vec_id, score, nearest first."""
    spark = vectors.sparkSession
    path = scratch(spark, "ann")
    all_ = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query")).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    lengths = all_.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("k"), F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)).alias("square")).orderBy(F.desc("k"), "size").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size, n, square = lengths[0]
    all_ = all_.where(F.size("vector") == size)
    index, enough = fitted(all_.select("vec_id", "vector"), n, size, float(square) ** 0.5, top)
    shared = spark.sparkContext.broadcast(index)
    rows = saved(listed(all_.select("vec_id", "vector"), shared), f"{path}/rows")
    sizes, far = np.zeros(len(index.centres), dtype=np.int64), np.zeros(len(index.centres))
    for r in rows.groupBy("list").agg(F.countDistinct("vec_id").alias("k"), F.max("far").alias("far")).collect():  # CENTRES rows at most
        sizes[r.list], far[r.list] = r.k, r.far
    asking = all_.where("is_query").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    queries = saved(probed(asking, shared, probes or enough, sizes, far, top), f"{path}/queries")
    pieces = lambda df, most, name: df.groupBy("bundle").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    deal = F.broadcast(pieces(rows, SEGMENT, "segments").join(pieces(queries, QUERIES, "parts"), "bundle"))  # CENTRES rows at most
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    first = queries.where("seeds is not null").select(F.col("vec_id").alias("query_id"), F.explode(F.arrays_zip("seeds", "scores")).alias("s")).select("query_id", F.col("s.seeds").alias("vec_id"), F.col("s.scores").alias("score"))
    rows = rows.join(deal, "bundle").select("bundle", own("segments").alias("segment"), every("parts").alias("part"), "list", "vec_id", "vector")
    queries = queries.join(deal, "bundle").select("bundle", every("segments").alias("segment"), own("parts").alias("part"), "lists", "radius", "vec_id", "vector")
    keys = ("bundle", "segment", "part")
    found = queries.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(searcher(shared, top), "query_id long, vec_id long, score double")
    # Dealt by query once, for both steps.
    found = found.unionByName(first).repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
