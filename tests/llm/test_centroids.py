"""Centroid clustering against a plain version and its SQL."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import Row

from siteroster.llm.centroids import LIMB, cluster_vectors, limbs, nearest
from siteroster.llm.queries_centroids import ENTRIES
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


def brute(rows, k=8, dims=64, rounds=10):
    kept = [(i, [math.floor(1024 * x) if abs(x) < 2 ** 52 else 1024 * int(x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    hashed = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1])
    centres = [list(v) for _, v in sorted(kept, key=hashed)[:k]]

    def place(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(place(v)[1], []).append(v)
        for c, members in groups.items():
            centres[c] = [sum(column) // len(members) for column in zip(*members)]
    placed = [(i, *place(v)) for i, v in kept]
    sums = {}
    for _, d, c in placed:
        sums[c] = sums.get(c, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    small = lambda n: n if n < 1 << 63 else None
    return sorted(((i, c, small(d), small(sums[c]), small(sum(sums.values())), digest[c]) for i, d, c in placed), key=repr)


def report(spark, rows, kind="array<double>", **how):
    table = spark.createDataFrame(rows, f"vec_id long, embedding {kind}")
    return sorted((tuple(r) for r in cluster_vectors(table, **how).collect()), key=repr)


def test_against_plain(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(i % 5 / 3, 0.3) for _ in range(64)]) for i in range(120)]
    rows += [(3, rows[3][1]), (None, rows[7][1]), (None, [0.5] * 64), (200, None), (201, [1.0] * 63), (202, [1.0] * 63 + [None]),
             (203, [1.0] * 63 + [float("nan")]), (204, [1.0] * 63 + [float("inf")]), (205, []), (206, [-0.0004] * 64)]
    assert report(spark, rows) == brute(rows)


def test_large_components_stay_exact(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([1.0, -1.0]) * rng.random() * 10.0 ** rng.randint(-3, 30) for _ in range(4)]) for i in range(40)]
    got = report(spark, rows, dims=4, k=3, rounds=4)
    assert got == brute(rows, 3, 4, 4) and any(r[2] is None for r in got) and any(r[2] is not None for r in got)


def test_ties_go_to_the_smaller_number():
    centroids = np.array([[4, 0], [0, 4], [0, 0], [4, 4]])
    best, least, _ = nearest(np.array([[2, 2], [0, 2], [4, 4], [2, 0]]), centroids)
    assert best.tolist() == [0, 1, 3, 0] and least.tolist() == [8, 4, 0, 4]


@pytest.mark.parametrize("dims,k", [(1, 9), (2, 40), (5, 17), (64, 8)])
def test_walk_equals_all_distances_and_ends_early(dims, k):
    rng = np.random.default_rng(dims)
    centroids = rng.integers(-300, 300, (k, dims))
    near = centroids[rng.integers(0, k, 3000)] + rng.integers(-9, 9, (3000, dims))
    for x in (rng.integers(-400, 400, (3000, dims)), near):
        distance = ((x[:, None] - centroids[None]) ** 2).sum(axis=2)
        best, least, _ = nearest(x, centroids)
        assert (best == distance.argmin(axis=1)).all() and (least == distance.min(axis=1)).all()
        big, far, _ = nearest(x[:50].astype(object), centroids)
        assert (big == best[:50]).all() and (far == least[:50]).all()
    if dims <= 2:
        assert nearest(near, centroids)[2] < 0.5 * near.shape[0] * k


def test_limbs():
    for value in (0, 1, -1, 2 ** 40, -2 ** 40, 3 ** 90, -3 ** 90, 2 ** 80 - 1):
        assert sum(part << (LIMB * i) for i, part in enumerate(limbs(value))) == value


def test_few_vectors_an_empty_table_and_extra_columns(spark):
    rows = [(i, [float(i)] * 64) for i in range(3)]
    assert report(spark, rows, "array<float>") == brute(rows)
    table = spark.createDataFrame([Row(vec_id=1, embedding=[0.25] * 64, v=1, cluster=2, distance=3, label=4)])
    assert [tuple(r)[:5] for r in cluster_vectors(table).collect()] == [(1, 0, 0, 0, 0)]
    assert cluster_vectors(table.limit(0)).collect() == []


@pytest.mark.parametrize("name", ENTRIES)
def test_query_equals_sql(spark, name):
    query, sql = ENTRIES[name]
    assert compare(spark, connect(SF), name, query, sql, SF) == ""
