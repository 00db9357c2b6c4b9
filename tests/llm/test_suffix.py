from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from siteroster.llm.bwt_merge import build, merge, repeated
from siteroster.llm.suffix_dedup import anchors, remove_repeats

rng = random.Random(6)


def text(n, letters="abcdefgh é"):
    return "".join(rng.choice(letters) for _ in range(n))


def brute(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[p:p + length] for b in data for p in range(len(b) - length + 1))
    out = []
    for b in data:
        mark = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p:p + length]] > 1:
                mark[p:p + length] = True
        kept = np.frombuffer(b, np.uint8)[~mark].tobytes()
        spans = int((np.diff(np.r_[0, mark.astype(int)]) == 1).sum())
        out.append((len(b), int(mark.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


PASSAGES = [text(n) for n in (199, 200, 201, 230, 900)]
TEXTS = [None, "", text(150), "z" * 700, "yx" * 150, text(300), *[text(rng.randint(0, 300)) + p + text(rng.randint(0, 300)) for p in PASSAGES * 3],
         PASSAGES[4], PASSAGES[4], PASSAGES[4][300:], text(5000) + PASSAGES[2] + PASSAGES[2][100:] + PASSAGES[4][:450]]


@pytest.mark.parametrize("limits", [(1_000_000, 400_000, 1 << 22, 1 << 26), (3000, 500, 1024, 64)])
def test_equals_brute_force(documents, limits):
    together, in_shard, size, bits = limits
    rows = [*enumerate(TEXTS), (3, TEXTS[3]), (None, PASSAGES[3])]
    found = remove_repeats(documents(rows), bits=bits, size=size, together=together, in_shard=in_shard).collect()
    want = [(i, *w) for (i, _), w in zip(rows, brute([t for _, t in rows]))]
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)


def test_anchors_cover_all_windows_and_depend_on_them_alone():
    data = text(3000).encode()
    places, first, last = anchors(data, 200)
    assert first[0] == 0 and last[-1] == len(data) - 200 and (first[1:] == last[:-1] + 1).all()
    where = dict((p, a) for a, f, e in zip(places, first, last) for p in range(f, e + 1))
    for p in range(0, len(data) - 200, 97):
        alone, _, _ = anchors(data[p:p + 200], 200)
        assert alone[0] + p == where[p]


def test_merge_equals_one_shard():
    data = np.frombuffer(b"\0" * 8 + ("".join(rng.choice("ab") for _ in range(3000)) * 2).encode() + b"\0" * 64, np.uint8)
    start = np.arange(8, 8 + 5900)
    bucket = np.zeros(len(start), int)
    one = build(data, start, bucket, 8)
    cut = [0, 700, 3100, 3200, 5900]
    many = merge(data, [build(data, start[a:b], bucket[a:b], 8) for a, b in zip(cut, cut[1:])], 8)
    assert (one.lcp == many.lcp).all() and set(one.start[repeated(one, 8)]) == set(many.start[repeated(many, 8)])
    key = lambda p: bytes(data[p:p + 64])
    assert [key(p) for p in many.start] == sorted(key(p) for p in start)


def test_empty_table(documents):
    assert remove_repeats(documents([])).collect() == []
