"""How often the language-model query reads texts, and what the table that it reads instead holds."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from siteroster.llm.lm_scoring import Groups, code_documents, encode, fit_all, held_out, lm_scores, split_words, tokens
from siteroster.llm.recurrent_lm import Model, Vocabulary, score_documents

ODD = ["", None, "  ", "One two", "\tA\x0bb\x0c c\r\n", "x\x1cy    z", "É É é", "a " * 3000, "rare Rare b", " end"]


def vocabulary_of(n=1300):
    return Vocabulary([b"a", b"b", b"one", "é".encode(), *(f"w{i}".encode() for i in range(n))], np.arange(n + 4, 0, -1) + 3, 9, 7, 4)


def test_texts_are_taken_apart_once_for_all_rounds(spark, documents):
    rng = random.Random(7)
    rows = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(40))) for i in range(60)]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    docs = documents(rows).select("doc_id", "text")
    assert lm_scores(docs.mapInArrow(counted, docs.schema), train_tokens=500).count() == len(rows)
    # once for the counts, at most twice for the first sample, once for the table of inputs; it was once more for every round
    assert read.value <= 4 * len(rows)


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_words_equal_those_of_a_plain_split(kind):
    found, places = split_words(pa.array(ODD, kind))
    found = [w.encode() for w in found.to_pylist()]
    assert [found[a:b] for a, b in zip(places, places[1:])] == [[*tokens(t), b""] for t in ODD]


def test_groups_keep_all_rows_in_order():
    rng = random.Random(3)
    texts = [None if rng.random() < 0.1 else "x" * rng.choice([0, 1, 5, 30, 200]) for _ in range(300)]
    for size, most in ((1, 40), (7, 40), (300, 40), (300, 1), (50, 10**6)):
        batches = [pa.RecordBatch.from_pydict({"text": pa.array(texts[i:i + size], pa.string())}) for i in range(0, 300, size)]
        groups = Groups("text", most)
        found = [g for b in [*batches[:3], batches[0].slice(0, 0), *batches[3:]] for g in groups.add(b)] + list(groups.rest())
        assert [t for g in found for t in g.column("text").to_pylist()] == texts
        sizes = [[len(t or "") for t in g.column("text").to_pylist()] for g in found]
        assert all(sum(s) <= most or len(s) == 1 for s in sizes)
        assert most < 10**6 or len(sizes) == 1


@pytest.mark.parametrize("partitions", [1, 3])
def test_coded_documents(documents, partitions):
    vocabulary = vocabulary_of()
    rng = random.Random(5)
    rows = [*enumerate(ODD), (None, "a b"), (3, "One two"), *((i, " ".join(f"w{rng.randrange(1500)}" for _ in range(50))) for i in range(20, 60))]
    found = code_documents(documents(rows).repartition(partitions), vocabulary).collect()
    assert len(found) == len({r.row for r in found}) == len(rows)

    def plain(doc, text):
        words = tokens(text)
        ids = encode(vocabulary, words)
        known = ids[ids != vocabulary.other]
        rare = Counter(w for w, i in zip(words, ids) if i == vocabulary.other)
        return (str(doc), held_out(doc), len(ids), int((vocabulary.counts[known] > 0).sum()), round(float(vocabulary.log_count[known].sum()), 6),
                round(float(vocabulary.within[ids].sum()), 6), sum(rare.values()), vocabulary.token_in[ids].tolist(), sorted(rare.items()))

    assert sorted(plain(*r) for r in rows) == sorted(
        (str(r.doc_id), r["round"] is None, r.n_tokens, r.n_known, round(r.log_counts, 6), round(r.log_words, 6), r.n_rare,
         np.frombuffer(r.codes, np.uint16).tolist(), sorted(zip(map(bytes, r.rare), r.rare_n))) for r in found)


def test_inputs_score_and_fit_like_words(documents):
    vocabulary = vocabulary_of()
    rng = np.random.default_rng(2)
    docs = [np.append(rng.integers(1, vocabulary.other + 1, n), 0).astype(np.int32) for n in (0, 3, 90, 400)]
    model = Model(vocabulary)
    small = score_documents(model, vocabulary.of_inputs(), [vocabulary.token_in[d] for d in docs])
    assert small + [vocabulary.within[d].sum() for d in docs] == pytest.approx(score_documents(model, vocabulary, docs), rel=1e-9)
    table = documents([(i, " ".join(f"w{k}" for k in range(i, i + 30))) for i in range(40)]).coalesce(1)
    fitted = []
    for given in (table, code_documents(table, vocabulary)):
        model = Model(vocabulary)
        read = fit_all(given, vocabulary, model)
        fitted.append((read, model.flat().tobytes()))
    assert fitted[0] == fitted[1]
    assert fitted[0][0] == sum(31 for i in range(40) if not held_out(i))
