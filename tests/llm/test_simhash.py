from __future__ import annotations

import random

import numpy as np
import xxhash

from siteroster.llm.components import components
from siteroster.llm.simhash import anchor_links, anchors, fingerprint, keep_one, near_duplicates, near_links


def plain_print(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, pairs):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_fingerprint():
    long = " ".join(f"w{i % 700}" for i in range(3000))
    for text in (None, "", " \t", "One", "One two", "a b c", "É a É b\x0bc", "a b c d " * 40, long):
        assert fingerprint(text) == plain_print(text)


def test_anchors_lie_within_two_bits_and_miss_none():
    rng = np.random.default_rng(1)
    halves = rng.integers(0, 1 << 32, 300, dtype=np.uint64).astype(np.uint32)
    home, others = anchors(halves)
    words = halves & np.uint32(0x7FFFFFFF)
    assert (np.bitwise_count(home ^ words) <= 1).all()
    for rows, code in others:
        assert (np.bitwise_count(code ^ words[rows]) == 2).all()
    for bit in range(32):  # a neighbour at one bit visits this one's home
        near_home, near = anchors(halves ^ np.uint32(1 << bit))
        for i in range(len(halves)):
            assert home[i] == near_home[i] or any(home[i] in code[rows == i] for rows, code in near)


def clustered(seed, n, centres):
    rng = random.Random(seed)
    middle = [rng.getrandbits(64) for _ in range(centres)]
    return sorted({rng.choice(middle) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(n)})


def test_links_connect_all_close_pairs(spark):
    prints = clustered(3, 500, 12)
    table = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    place = {int(np.uint64(p).view(np.int64)): i for i, p in enumerate(prints)}
    found = near_links(table).collect()
    assert all(bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= 3 for r in found)
    every = [(i, j) for i in range(len(prints)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 3]
    assert roots(len(prints), [(place[r.a], place[r.b]) for r in found]) == roots(len(prints), every)


def test_large_anchor_is_compared_by_bytes(monkeypatch):
    import siteroster.llm.simhash as simhash

    rng = random.Random(5)
    fps = np.array(sorted({rng.getrandbits(8) << 33 | rng.getrandbits(4) << 60 for _ in range(600)}), np.uint64)
    every = anchor_links(fps, np.ones(len(fps), bool), 0, 3)
    monkeypatch.setattr(simhash, "WHOLE", 16)
    assert roots(len(fps), anchor_links(fps, np.ones(len(fps), bool), 0, 3)) == roots(len(fps), every)


def test_components(spark):
    rng = random.Random(9)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5)]
    found = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = roots(500, pairs)
    assert all(found.get(i, i) == want[i] for i in range(500))
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_classes_and_one_row_each(documents):
    base = " ".join(f"word{i}" for i in range(300))
    rows = [(5, base), (3, base), (9, base + " tail"), (7, "other words entirely here"), (8, None), (6, ""), (7, "other words entirely here"),
            (None, base), (None, "lonely text without id"), (None, "lonely text without id")]
    docs = documents(rows)
    found = {(r.doc_id, r.component_id) for r in near_duplicates(docs).collect()}
    assert {(5, 3), (3, 3), (7, 7), (8, 6), (6, 6), (None, 3), (None, None)} <= found
    kept = sorted((r.doc_id or -1, r.text or "") for r in keep_one(docs).collect())
    want = [(-1, "lonely text without id"), (3, base), (6, ""), (7, "other words entirely here")]
    if (9, 9) in found:
        want.append((9, base + " tail"))
    assert kept == want and keep_one(docs).columns == docs.columns
    assert keep_one(documents([])).collect() == []
