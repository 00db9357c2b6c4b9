"""Similar-name operators against a plain quadratic loop."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from siteroster.operators import similar
from siteroster.operators.similar import (
    dedup_similar_names,
    deduplicate,
    kept_names,
    similar_name_pairs,
)


def alike(a, b, t):
    return SequenceMatcher(None, a, b).ratio() >= t


def greedy(names, t=0.85):
    kept = []
    for name in names:
        low = name.lower().strip()
        if not any(alike(k.lower().strip(), low, t) for k in kept):
            kept.append(name)
    return kept


def make_names(seed, n):
    rng = random.Random(seed)
    stems = ["acme", "steril", "medi", "gown", "pack", "afri", "care", "supply", "hold"]
    names = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.5 and names:
            text = list(rng.choice(names))
            for _ in range(rng.randint(1, 3)):
                at = rng.randrange(len(text) + 1)
                if rng.random() < 0.5:
                    text.insert(at, rng.choice("abcxyz "))
                elif text and at < len(text):
                    text.pop(at)
            names.append("".join(text))
        elif kind < 0.6:
            names.append("".join(rng.choice("ab") for _ in range(rng.randint(0, 7))))
        else:
            names.append(" ".join(rng.choice(stems) for _ in range(rng.randint(1, 4))))
    return names


def frame(spark, names):
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "ord int, name string")


def plain_bigrams(text):
    grams = [text[i:i + 2] for i in range(len(text) - 1)]
    return [g + str(grams[:i + 1].count(g)) for i, g in enumerate(grams)]


def test_bigrams_are_numbered_and_keys_grow_with_the_length(spark):
    rng = random.Random(3)
    names = ["", "a", "aa", "aaaa", "abab", "aabbaab", "a😀a😀a", *("".join(rng.choice("ab c") for _ in range(n)) for n in (32, 60, 100))]
    names += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)) for n in (32, 60, 100) for _ in range(20)]
    table = spark.createDataFrame([(n, (i,)) for i, n in enumerate(dict.fromkeys(names))], "key string, ord struct<i:int>")
    for r in table.select("key", similar._bigrams(F.col("key")).alias("g")).collect():
        assert r.g == plain_bigrams(r.key)
    for threshold in (0.7, 0.85, 0.95):
        for r in similar.blocking_keys(table, threshold).groupBy("key").count().collect():
            assert len(r.key) < 32 or r["count"] <= len(r.key)


def test_names_of_few_letters_share_few_keys(spark):
    """Digests have 256 bigrams: names that are not alike met under nearly each other's keys."""
    rng = random.Random(5)
    names = ["".join(rng.choice("0123456789abcdef") for _ in range(32)) for _ in range(300)]
    table = spark.createDataFrame([(n, (i,)) for i, n in enumerate(names)], "key string, ord struct<i:int>")
    keys = similar.blocking_keys(table, 0.85)
    sizes = [r["count"] for r in keys.groupBy("sig").count().collect()]
    assert sum(n * (n - 1) // 2 for n in sizes) < 0.25 * len(names) * (len(names) - 1) / 2
    plain = [n[i:i + 3] for n in ["aaaaa", "ababab", "abcabc"] for i in range(len(n) - 2)]
    table = spark.createDataFrame([("aaaaa",), ("ababab",), ("abcabc",)], "key string")
    got = [g for r in table.select(similar._grams(F.col("key"), 3).alias("g")).collect() for g in r.g]
    assert [g[:3] for g in got] == plain
    assert [g[3:] for g in got] == ["1", "2", "3", "1", "1", "2", "2", "1", "1", "1", "2"]


@pytest.mark.parametrize("seed,t", [(31, 0.84), (32, 0.85), (33, 0.9), (34, 0.97)])
def test_short_and_long_names_of_two_letters_equal_brute_force(spark, seed, t):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 26))) for _ in range(60)]
    names = stems + [s[:i] + rng.choice(["", "a", "bc"]) + s[i + 1:] for s in stems for i in [rng.randrange(len(s))]]
    keys = list(dict.fromkeys(n.lower().strip() for n in names))
    want = {(a, b) for i, a in enumerate(keys) for b in keys[i + 1:] if alike(a, b, t)}
    for key_size in (1, 2):
        got = similar_name_pairs(frame(spark, names), ["ord"], threshold=t, key_size=key_size)
        assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize("seed,t", [(21, 0.67), (22, 0.7), (23, 0.75), (24, 0.8)])
def test_low_thresholds_equal_brute_force(spark, seed, t):
    names = make_names(seed, 120) + ["ab", "axb", "ba", "abc", "a", "b", "cab", "xyzab", "zyxba"]
    keys = list(dict.fromkeys(n.lower().strip() for n in names))
    want = {(a, b) for i, a in enumerate(keys) for b in keys[i + 1:] if alike(a, b, t)}
    got = similar_name_pairs(frame(spark, names), ["ord"], threshold=t)
    assert {tuple(r) for r in got.collect()} == want
    rows = dedup_similar_names(frame(spark, names), ["ord"], "name", threshold=t)
    assert [r.name for r in rows.orderBy("ord").collect()] == greedy(names, t)


@pytest.mark.parametrize("seed,key_size", [(1, 1), (2, 2), (3, 3), (4, 2)])
def test_greedy_equals_the_loop(spark, seed, key_size):
    names = make_names(seed, 150)
    rows = dedup_similar_names(frame(spark, names), ["ord"], "name", key_size=key_size)
    got = [r.name for r in rows.orderBy("ord").collect()]
    assert got == greedy(names)


@pytest.mark.parametrize("seed,key_size,t", [(5, 1, 0.85), (6, 2, 0.9), (7, 3, 0.85)])
def test_pairs_equal_brute_force(spark, seed, key_size, t):
    names = make_names(seed, 160)
    keys = list(dict.fromkeys(n.lower().strip() for n in names))
    want = {(a, b) for i, a in enumerate(keys) for b in keys[i + 1:] if alike(a, b, t)}
    got = similar_name_pairs(frame(spark, names), ["ord"], threshold=t, key_size=key_size)
    assert {tuple(r) for r in got.collect()} == want


def test_many_rounds_and_hot_groups_change_nothing(spark):
    """One head per group and round, and every group treated as hot."""
    names = make_names(8, 60) + [f"common supplies group international {i:03d}" for i in range(60)]
    random.Random(9).shuffle(names)
    unique = list(dict.fromkeys(n.lower().strip() for n in names))
    table = spark.createDataFrame([(n, (i,)) for i, n in enumerate(unique)], "key string, ord struct<i:int>")
    kept = kept_names(table, head_size=1, group_limit=2)
    assert {r.key for r in kept.collect()} == set(greedy(unique))


def test_similarity_is_not_transitive(spark):
    # b resembles a and goes; c resembles only b and stays
    names = ["abcdefghij", "abcdefghijkl", "abcdefghijklmn"]
    assert greedy(names) == ["abcdefghij", "abcdefghijklmn"]
    rows = dedup_similar_names(frame(spark, names), ["ord"], "name")
    assert sorted(r.name for r in rows.collect()) == ["abcdefghij", "abcdefghijklmn"]


def test_direction_of_the_ratio(spark):
    # ratio() is not symmetric: the earlier name must be the first argument
    rng = random.Random(11)
    found = None
    while found is None:
        a = "".join(rng.choice("abcd") for _ in range(13))
        b = list(a)
        for _ in range(4):
            b.insert(rng.randrange(len(b)), rng.choice("abcd"))
            b.pop(rng.randrange(len(b)))
        b = "".join(b)
        if alike(a, b, 0.85) != alike(b, a, 0.85):
            found = a, b
    for names in (found, found[::-1]):
        rows = dedup_similar_names(frame(spark, list(names)), ["ord"], "name")
        assert [r.name for r in rows.orderBy("ord").collect()] == greedy(list(names))


def test_threshold_range(spark):
    with pytest.raises(ValueError):
        similar_name_pairs(frame(spark, ["a"]), ["ord"], threshold=0.5)
    assert similar_name_pairs(frame(spark, ["abc", "ABC ", "abd"]), ["ord"], threshold=1.0).count() == 0


def test_null_names_and_urls(spark):
    rows = spark.createDataFrame(
        [(0, None, None), (1, "other", None), (2, None, "https://a.org"), (3, "third", "https://www.a.org/x"),
         (4, "fourth", "https://b.org")], "ord int, name string, url string")
    got = deduplicate(rows, ["ord"], "name").orderBy("ord").collect()
    assert [r.ord for r in got] == [0, 4]


def test_no_cross_join_in_the_plan(spark):
    pairs = similar_name_pairs(frame(spark, make_names(12, 50)), ["ord"])
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_hot_groups_are_salted(spark):
    keys = similar.blocking_keys(
        frame(spark, ["aa bb cc dd", "aa bb cc ee", "aa bb cc ff"]).select(
            F.col("name").alias("key"), F.struct("ord").alias("ord")), 0.85, 2)
    heads, members = similar._spread(keys, keys, 1)
    assert members.select("salt").distinct().count() > 1
    assert heads.count() > members.count()
