from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteroster.llm import recurrent_lm
from siteroster.llm.lm_scoring import encode, fit_all, held_out, lm_scores, tokens
from siteroster.llm.recurrent_lm import Model, Vocabulary, score_documents, train
from siteroster.llm.resampling import gumbel, kth_largest, ordered_bits, resample

rng = random.Random(2)


def chain(n):
    """Words whose order can be learnt: each is mostly followed by its successor."""
    word, out = rng.randrange(40), []
    for _ in range(n):
        word = (word + 1) % 40 if rng.random() < 0.8 else rng.randrange(40)
        out.append(f"w{word}")
    return " ".join(out)


@pytest.mark.parametrize("known", [10, 200_000])
def test_base_counts_and_learning(documents, known):
    rows = [(i, chain(60)) for i in range(120)] + [(500, None), (501, ""), (502, "Rare one RARE two"), (503, " ".join(["w1"] * 3000)),
            (None, "w1 w2"), (502, "Rare one RARE two")]
    held = {i for i, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 7 == 2}
    tokens = {k: (t or "").lower().split() + [""] for k, (_, t) in enumerate(rows)}
    counts = Counter(w for k, (i, _) in enumerate(rows) if i not in held for w in tokens[k])
    n, v = sum(counts.values()), len(counts)
    want = sorted((i if i is not None else -1, i in held, len(tokens[k]), sum(counts[w] > 0 for w in tokens[k]), n,
                   round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens[k]), 5)) for k, (i, _) in enumerate(rows))
    found = lm_scores(documents(rows), known=known, train_tokens=20_000).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5))
                  for r in found) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)
    if known > 10:
        unseen = [r for r in found if r.held_out and r.doc_id < 200]
        assert unseen and sum(r.score for r in unseen) > 0.9 * sum(r.base_score for r in unseen)


def test_weights_learn_from_rows_beyond_the_sample(documents):
    rows = [(i, chain(120)) for i in range(400)]
    words = [f"w{i}".encode() for i in range(40)]
    vocabulary = Vocabulary(words, np.full(40, 1000), 400, 0, 0)
    coded = [encode(vocabulary, tokens(t)) for _, t in rows]
    inside = [c for (i, _), c in zip(rows, coded) if not held_out(i)]
    outside = [c for (i, _), c in zip(rows, coded) if held_out(i)]
    model = train(vocabulary, inside[:2])
    before = score_documents(model, vocabulary, outside).sum()
    assert fit_all(documents(rows).coalesce(2), vocabulary, model) == sum(map(len, inside))
    assert score_documents(model, vocabulary, outside).sum() > 0.9 * before  # logs are negative


def test_probabilities_sum_to_one_and_state_is_carried():
    words = [f"w{i}".encode() for i in range(1500)]
    vocabulary = Vocabulary(words, np.arange(1500, 0, -1), 50, 300, 100)
    model = train(vocabulary, [np.array([3, 4, 5, 0] * 20, np.int32)], epochs=1)
    total = 10 ** score_documents(model, vocabulary, [np.array([i], np.int32) for i in range(1501)])
    rest = 10 ** score_documents(model, vocabulary, [np.array([1501], np.int32)])  # the last bin as a whole
    assert total.sum() + rest[0] == pytest.approx(1, abs=1e-4)
    long = np.array([(7 * i) % 900 for i in range(500)] + [0], np.int32)
    whole = score_documents(model, vocabulary, [long, long[:3]])
    size, rows = recurrent_lm.WINDOW, recurrent_lm.ROWS
    try:
        recurrent_lm.WINDOW, recurrent_lm.ROWS = 11, 1
        assert score_documents(model, vocabulary, [long[:3], long], most=1)[::-1] == pytest.approx(whole, rel=1e-5)
    finally:
        recurrent_lm.WINDOW, recurrent_lm.ROWS = size, rows


def test_gradients():
    vocabulary = Vocabulary([f"w{i}".encode() for i in range(1200)], np.ones(1200), 5, 1, 1)
    model = Model(vocabulary)
    states = np.random.default_rng(0).standard_normal((6, recurrent_lm.HIDDEN)).astype(np.float32)
    cls, slot = vocabulary.cls[[0, 3, 40, 1100, 1201, 3]], vocabulary.slot[[0, 3, 40, 1100, 1201, 3]]
    g = {k: np.zeros_like(v) for k, v in model.p.items()}
    _, back = model.outputs(states, cls, slot, g)
    moved = states.copy()
    moved[1, 2] += 1e-2
    change = -(model.outputs(moved, cls, slot)[0].sum() - model.outputs(states, cls, slot)[0].sum()) / 1e-2
    assert change == pytest.approx(back[1, 2], abs=2e-3)


def small_window(rng, vocabulary, live=3, steps=5):
    """A window of three lanes: documents start inside it, one lane ends early."""
    docs = [rng.integers(1, 1200, n).astype(np.int32) for n in (4, 3, 2, 6)]
    docs = [np.append(d, 0).astype(np.int32) for d in docs]
    stream = recurrent_lm.Stream(vocabulary, docs, live)
    n, time = next(iter(stream.windows(steps)))
    owner = stream.owner[:n, time].T.ravel()
    return (stream.tokens[:n, time].T, stream.resets[:n, time].T, stream.targets[:n, time].T.ravel(), np.flatnonzero(owner >= 0))


def test_gradients_of_all_weights():
    """Backpropagation through a window against differences of its log likelihood, for some cells of every array."""
    rng = np.random.default_rng(3)
    vocabulary = Vocabulary([f"w{i}".encode() for i in range(1200)], np.arange(1300, 100, -1), 5, 1, 1)
    model = Model(vocabulary)
    tokens, resets, target, real = small_window(rng, vocabulary)
    h = rng.standard_normal((tokens.shape[1], recurrent_lm.HIDDEN)).astype(np.float32) * 0.3
    resets = resets.copy()
    resets[0, 0] = False  # one lane goes on from the window before
    g, _, _ = recurrent_lm.window_gradients(model, vocabulary, tokens, resets, target, real, h)

    def loss():
        states, _, _ = model.run(tokens, resets, h)
        logs, _ = model.outputs(states.reshape(-1, recurrent_lm.HIDDEN)[real], vocabulary.cls[target[real]], vocabulary.slot[target[real]])
        return -float(logs.astype(np.float64).sum())

    for name, array in model.p.items():
        places = np.argsort(-np.abs(g[name]).ravel())[:6]
        assert np.abs(g[name]).max() > 0, name
        for place in places:
            cell, step = np.unravel_index(place, array.shape), 1e-2
            kept = array[cell]
            array[cell] = kept + step
            up = loss()
            array[cell] = kept - step
            change = (up - loss()) / (2 * step)
            array[cell] = kept
            assert change == pytest.approx(float(g[name][cell]), rel=0.03, abs=2e-3), name


def plain_score(model, vocabulary, doc):
    """log10 P of a document by the formulas of the gated unit and both softmaxes, step by step."""
    p = {k: v.astype(np.float64) for k, v in model.p.items()}
    n, h, total, given = recurrent_lm.HIDDEN, np.zeros(recurrent_lm.HIDDEN), 0.0, recurrent_lm.START
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for word in doc:
        x, u = p["inputs"][given], h @ p["state"]
        z, r = sigmoid(x[:n] + u[:n]), sigmoid(x[n:2 * n] + u[n:2 * n])
        new = np.tanh(x[2 * n:] + r * u[2 * n:])
        h = (1 - z) * new + z * h
        scores = h @ p["cls"] + p["cls_bias"]
        c = vocabulary.cls[word]
        total += (scores[c] - np.log(np.exp(scores).sum())) / np.log(10) + vocabulary.within[word]
        if vocabulary.slot[word] >= 0:
            inner = h @ p["word"][c] + p["word_bias"][c]
            total += (inner[vocabulary.slot[word]] - np.log(np.exp(inner).sum())) / np.log(10)
        given = vocabulary.token_in[word]
    return total


def test_scores_equal_a_plain_forward_pass():
    rng = np.random.default_rng(4)
    vocabulary = Vocabulary([f"w{i}".encode() for i in range(1400)], np.arange(1500, 100, -1), 60, 30, 10)
    docs = [np.append(rng.integers(1, 1402, n), 0).astype(np.int32) for n in (0, 1, 40, 200, 700)]
    model = train(vocabulary, docs[2:], epochs=1, most=2)
    want = [plain_score(model, vocabulary, d) for d in docs]
    assert score_documents(model, vocabulary, docs) == pytest.approx(want, rel=1e-5)


def test_resampling(spark, documents):
    good = [(i, chain(80)) for i in range(160)]
    bad = [(1000 + i, " | ".join(f"junk{rng.randrange(50)}" for _ in range(60))) for i in range(40)]
    rows = [*good, *bad, (2000, None), (2001, ""), (None, chain(50)), (5, good[5][1])]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 160, 2)] + [(1000 + i, 0, 0) for i in range(20)] + [(None, 1, 0), (7, None, 0)],
                                   "doc_id long, quality int, toxic int")
    found = resample(documents(rows), labels).collect()
    assert len(found) == len(rows)
    kept = [r.doc_id for r in found if r.kept]
    assert {i for i, _ in good} <= set(kept) and sum(i is not None and 1000 <= i < 2000 for i in kept) <= 12
    assert abs(len(kept) - round((80 / 100 + 0.05) * len(rows))) <= 1
    assert all(r.log_weight == 0 for r in found if r.doc_id in (2000, 2001))
    nothing = resample(documents([(1, "a b"), (2, None)]), labels.limit(0)).collect()
    assert [r.kept for r in nothing] == [True, True]
    assert resample(documents([]), labels).collect() == []


def test_kth_largest_is_exact(spark):
    keys = np.array([rng.gauss(0, 1e3) for _ in range(500)] + [0.0, -0.0, 5.0, 5.0])
    places = ordered_bits(keys)
    assert (np.argsort(places, kind="stable") == np.argsort(np.where(keys == 0, np.copysign(1e-300, keys), keys), kind="stable")).all()
    table = spark.createDataFrame([(int(p),) for p in places], "place long").withColumn("x", F.lit(1))
    for k in (1, 2, 250, 503, 504):
        assert kth_largest(table, "place", k) == sorted(places.tolist(), reverse=True)[k - 1]
    noise = gumbel(np.arange(20000), 17)
    assert abs(noise.mean() - 0.5772) < 0.03 and abs(noise.std() - 1.2825) < 0.03
