from __future__ import annotations

import random

from siteroster.llm.decontamination import Index, drop_leaked, find_leaks, shingles, terms

rng = random.Random(4)
VOCABULARY = [f"{a}{b}" for a in "ka lo mi ne pu ra so ti".split() for b in "ba de fi go hu".split()]


def prose(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


ITEMS = [(i, f"{prose(20).capitalize()}. {prose(8).capitalize()}.") for i in range(60)]


def benchmark(spark, rows=ITEMS):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_leaks_are_found_and_clean_texts_are_not(spark, documents):
    changed = ITEMS[3][1].split()
    changed[0] = "altered"
    rows = [(0, ITEMS[0][1]), (1, prose(400) + " " + ITEMS[1][1] + " " + prose(700)), (2, ITEMS[2][1].upper() + "!"),
            (3, prose(90) + " " + " ".join(changed) + " " + prose(30)), (4, " ".join(ITEMS[4][1].split()[:9])), (5, None), (6, ""),
            *[(10 + i, prose(rng.choice((3, 50, 3000)))) for i in range(60)], (None, ITEMS[7][1]), (0, ITEMS[0][1])]
    docs = documents(rows)
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.item_id) for r in find_leaks(docs, benchmark(spark)).collect())
    assert found == [(-1, 7), (0, 0), (0, 0), (1, 1), (2, 2), (3, 3)]
    assert sorted(r.doc_id for r in drop_leaked(docs, benchmark(spark)).collect()) == [4, 5, 6, *range(10, 70)]
    several = find_leaks(docs, benchmark(spark), block_items=17)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.item_id) for r in several.collect()) == found
    assert drop_leaked(docs, benchmark(spark), block_items=17).count() == 63


def test_pruned_search_equals_all_scores():
    texts = [(i, prose(rng.randint(3, 30))) for i in range(150)]
    index = Index(texts, 1.2, 0.75, 4, 5, 0.3)
    for _ in range(40):
        passage = prose(40) + " " + rng.choice(texts)[1]
        found = terms(passage)
        import numpy as np

        numbers = np.array(sorted({index.term_no[t] for t in found if t in index.term_no}))
        scores = np.zeros(len(texts))
        for t in numbers:
            part = slice(index.first[t], index.first[t + 1])
            scores[index.item[part]] += index.weight[part]
        assert [i for i, _ in index.above(numbers, 0.3)] == np.flatnonzero(scores >= 0.3).tolist()
        # the bound of a passage is never below what it keeps back for the frequent terms
        assert scores.max() <= index.top[numbers].sum(axis=0).max() + index.rest + 1e-5


def test_empty_tables_and_short_items(spark, documents):
    assert find_leaks(documents([(1, "text")]), benchmark(spark, [])).collect() == []
    assert drop_leaked(documents([(1, "text")]), benchmark(spark, [(1, None), (2, " ")])).count() == 1
    assert find_leaks(documents([]), benchmark(spark)).collect() == []
    assert shingles(["a", "b"], 5) == [("a", "b")] and shingles([], 5) == []
