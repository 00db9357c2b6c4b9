from __future__ import annotations

import random

import numpy as np

from siteroster.llm.licenses import CLASSES, TEMPLATES, Classifier, grams, scan_licenses

rng = random.Random(8)
SYLLABLES = "ther an ing ou ble tion ed ha in on er st of the and to is a".split()
ORDINARY = [" ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(rng.randint(2, 25))) for _ in range(400)]


def test_families_and_ordinary_text(documents):
    known = [(f, t) for f, ts in TEMPLATES.items() for t in ts]
    rows = [(i, f"{ORDINARY[i]}\n\n{text}\n{ORDINARY[i + 50]}") for i, (_, text) in enumerate(known)]
    rows += [(100 + i, text) for i, text in enumerate(ORDINARY)] + [(600, None), (601, ""), (None, "Released under the MIT License.")]
    rows += [(602, "Licensed under the Zubrowka License."), (603, "x " * 30000 + "\nAll rights reserved."), (603, "All rights reserved.")]
    found = [(r.doc_id, r.paragraph, r.family) for r in scan_licenses(documents(rows)).collect()]
    assert {(i, 2, f) for i, (f, _) in enumerate(known)} <= set(found)
    assert (None, 0, "mit") in found and (602, 0, "unknown") in found
    assert (603, 1, "all-rights-reserved") in found and (603, 0, "all-rights-reserved") in found
    assert not [i for i, _, _ in found if i is not None and 100 <= i < 602]
    assert scan_licenses(documents([])).collect() == []


def test_paragraphs_without_heavy_words_are_ordinary():
    model = Classifier(ORDINARY)
    assert model.accuracy > 0.97
    heavy = set(model.heavy_words())
    light = [w for w in model.vocabulary if " " not in w and w not in heavy]
    for _ in range(300):
        found = grams(" ".join(rng.choices(light, k=rng.randint(1, 40))))
        scores = model.bias + sum((model.weights[i] for i, g in enumerate(model.vocabulary) if g in found), np.zeros(len(CLASSES)))
        assert scores.argmax() == len(CLASSES) - 1
