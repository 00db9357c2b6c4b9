"""Centroid clustering in exact integers, each vector's nearest centroid found by the threshold algorithm.

For every dimension the centroids are sorted by their component. From a vector's value
the list is walked outward, nearest components first, one step a dimension and round.
A centroid met in any dimension gets its exact squared distance. A centroid not yet met
lies, in each dimension, at least as far as the next step; once the sum of the squared
next steps strictly exceeds the best exact distance, no other centroid can be nearer or
tie, and the walk ends. Vectors are walked in blocks, and those that ended leave the block.

Spark deals the vectors, each round's assignment runs where they lie, and only sums by
centroid and dimension are shuffled. Sums are exact at any size: they travel as limbs of
``LIMB`` bits.

Defined results: only vectors of ``dims`` components that are neither null nor non-finite
take part; repeated rows are vectors of their own; rows with a null id take part, and come
last as starts; equal ids are told apart by their components when starts are chosen; fewer
vectors than ``k`` give fewer centroids; an empty table gives an empty result; a
squared distance or a sum of them beyond a long is null; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteroster.session import materialize

LIMB = 40
#: Components up to which squared distances of 64 dimensions fit a long, and array cells of a block.
SAFE, CELLS = 1 << 27, 1 << 20
LONG = (1 << 63) - 1


def kept_vectors(table: DataFrame, dims: int) -> DataFrame:
    """``vec_id, v`` (doubles) of the whole vectors."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    whole = F.col("embedding").isNotNull() & (F.size("embedding") == dims) & ~F.exists("embedding", bad)
    return table.where(whole).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


def scaled(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): longs where distances of them fit a long, else Python's integers."""
    # the product with a power of two is exact up to overflow
    with np.errstate(over="ignore"):
        product = np.floor(values * scale)
    if not product.size or np.abs(product).max() <= SAFE:
        return product.astype(np.int64)
    exact = [math.floor(v * scale) if abs(v) < 2 ** 52 else int(v) * scale for v in values.ravel().tolist()]
    out = np.empty(len(exact), object)
    out[:] = exact
    return out.reshape(values.shape)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Per vector the nearest centroid (ties: the smaller number) and the squared distance; and the distances computed."""
    if vectors.dtype == object or centroids.dtype == object:
        vectors, centroids = vectors.astype(object), centroids.astype(object)
    k, dims = centroids.shape
    best = np.zeros(len(vectors), np.int64)
    least = np.zeros(len(vectors), vectors.dtype)
    computed = 0
    # sorted list of each dimension
    order = np.argsort(centroids, axis=0, kind="stable")
    lists = np.take_along_axis(centroids, order, axis=0)
    block = max(1, CELLS // (dims * max(1, k)))
    for at in range(0, len(vectors), block):
        x = vectors[at:at + block]
        live = np.arange(len(x))
        # places of the next smaller and the next larger component
        high = np.stack([np.searchsorted(lists[:, d], x[:, d]) for d in range(dims)], axis=1)
        low = high - 1
        met = np.zeros((len(x), k), bool)
        score = np.full(len(x), None, object) if x.dtype == object else np.full(len(x), LONG, np.int64)
        number = np.full(len(x), k, np.int64)
        for _ in range(k):
            y, lo, hi = x[live], low[live], high[live]
            down, up = _gaps(y, lists, lo, hi)
            take_low = _less(down, up)
            place = np.where(take_low, lo, hi)
            found = np.take_along_axis(order, np.clip(place, 0, k - 1), axis=0)
            new = np.zeros((len(live), k), bool)
            new[np.arange(len(live))[:, None], found] = True
            new &= ~met[live]
            met[live] |= new
            rows, cols = np.nonzero(new)
            computed += len(rows)
            apart = y[rows] - centroids[cols]
            exact = (apart * apart).sum(axis=1)
            for c in range(k):
                some = cols == c
                who = live[rows[some]]
                d = exact[some]
                better = np.array([s is None or v < s or (v == s and c < n) for v, s, n in zip(d, score[who], number[who])], bool) \
                    if x.dtype == object else (d < score[who]) | ((d == score[who]) & (c < number[who]))
                score[who[better]], number[who[better]] = d[better], c
            lo, hi = np.where(take_low, lo - 1, lo), np.where(take_low, hi, hi + 1)
            low[live], high[live] = lo, hi
            down, up = _gaps(y, lists, lo, hi)
            step = np.where(_less(down, up), down, up)
            # a dimension whose list is used up has met every centroid
            done = met[live].all(axis=1)
            frontier = (step * step).sum(axis=1)
            done |= np.array(frontier > score[live], bool)
            live = live[~done]
            if not len(live):
                break
        best[at:at + block], least[at:at + block] = number, score
    return best, least, computed


def _gaps(y: np.ndarray, lists: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance to the next component below and above; -1 where the list has ended."""
    k = len(lists)
    down = np.where(lo >= 0, y - np.take_along_axis(lists, np.clip(lo, 0, k - 1), axis=0), -1)
    up = np.where(hi < k, np.take_along_axis(lists, np.clip(hi, 0, k - 1), axis=0) - y, -1)
    return down, up


def _less(down: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Whether the step below is the next one."""
    return np.array((down >= 0) & ((up < 0) | (down <= up)), bool)


def limbs(value: int) -> list[int]:
    """Digits to base 2^LIMB, least first; the last one carries the sign."""
    out = []
    while not -(1 << LIMB) < value < 1 << LIMB:
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def _rows(batch: pa.RecordBatch, dims: int, scale: int) -> np.ndarray:
    return scaled(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), scale)


def _sums(centroids: np.ndarray, scale: int):
    k, dims = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = [[0] * dims for _ in range(k)], [0] * k
        for batch in batches:
            x = _rows(batch, dims, scale)
            cluster = nearest(x, centroids)[0]
            for c in np.unique(cluster).tolist():
                some = x[cluster == c]
                count[c] += len(some)
                total[c] = [a + int(b) for a, b in zip(total[c], some.sum(axis=0))]
        rows = [(c, d, i, part) for c in range(k) if count[c] for d, value in enumerate([*total[c], count[c]])
                for i, part in enumerate(limbs(value))]
        columns = list(zip(*rows)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(column), t) for column, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
            ["cluster", "dim", "limb", "part"])

    return sums


def improved(vectors: DataFrame, centroids: np.ndarray, scale: int) -> np.ndarray:
    """One round: the floors of the means of each centroid's vectors; empty centroids stay."""
    k, dims = centroids.shape
    parts = vectors.select("v").mapInArrow(_sums(centroids, scale), "cluster int, dim int, limb int, part long").groupBy(
        "cluster", "dim", "limb").agg(F.sum("part").alias("part")).collect()
    total: dict[tuple[int, int], int] = {}
    for r in parts:
        key = (r["cluster"], r["dim"])
        total[key] = total.get(key, 0) + (r["part"] << (LIMB * r["limb"]))
    return _integers([[total[c, d] // total[c, dims] if (c, dims) in total else int(centroids[c, d]) for d in range(dims)]
                      for c in range(k)], dims)


def _integers(rows: list[list[int]], dims: int) -> np.ndarray:
    small = all(abs(v) <= SAFE for row in rows for v in row)
    out = np.empty((len(rows), dims), np.int64 if small else object)
    for i, row in enumerate(rows):
        out[i] = row
    return out


def starts(vectors: DataFrame, k: int, dims: int, scale: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the least hash of seed and id, in that order."""
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(place.asc_nulls_last(), "v").limit(k).collect()
    return _integers([scaled(np.array(r["v"], np.float64), scale).tolist() for r in rows], dims)


def _assign(centroids: np.ndarray, scale: int):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance, _ = nearest(_rows(batch, centroids.shape[1], scale), centroids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(cluster.astype(np.int32)),
                 pa.array([d if d <= LONG else None for d in distance.tolist()], pa.int64())],
                ["vec_id", "cluster", "distance"])

    return assign


def fit(vectors: DataFrame, k: int, dims: int, rounds: int, scale: int, seed: int) -> np.ndarray:
    """The final centroids, numbered rows of integers."""
    centroids = starts(vectors, k, dims, scale, seed)
    for _ in range(rounds if len(centroids) else 0):
        after = improved(vectors, centroids, scale)
        if np.array_equal(after, centroids):
            break
        centroids = after
    return centroids


def _by_cluster(values: dict, kind: str) -> Column:
    """The value of the row's centroid; there are at most ``k``."""
    out = F.lit(None).cast(kind)
    for c, value in values.items():
        out = F.when(F.col("cluster") == c, F.lit(value).cast(kind)).otherwise(out)
    return out


def cluster_vectors(
    table: DataFrame, k: int = 8, dims: int = 64, rounds: int = 10, scale: int = 1024, seed: int = 3,
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every whole vector of ``vec_id, embedding``.

    A round that changes no centroid ends the fit, as all later ones would repeat it.
    """
    vectors = materialize(kept_vectors(table, dims), "vectors")
    centroids = fit(vectors, k, dims, rounds, scale, seed)
    if not len(centroids):
        centroids = np.zeros((1, dims), np.int64)
    placed = materialize(vectors.mapInArrow(_assign(centroids, scale), "vec_id long, cluster int, distance long"), "placed")
    sums = {r["cluster"]: None if r["beyond"] or r["s"] > LONG else int(r["s"]) for r in placed.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"),
        F.max(F.col("distance").isNull()).alias("beyond")).select("cluster", "beyond", F.coalesce("s", F.lit(0)).alias("s")).collect()}
    whole = None if None in sums.values() or sum(sums.values()) > LONG else sum(sums.values())
    digests = {c: hashlib.sha256(",".join(str(int(v)) for v in row).encode()).hexdigest() for c, row in enumerate(centroids)}
    return placed.select(
        "vec_id", "cluster", "distance", _by_cluster(sums, "long").alias("cluster_inertia"),
        F.lit(whole).cast("long").alias("inertia"), _by_cluster(digests, "string").alias("centroid_sha256"))
