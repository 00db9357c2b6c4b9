"""Benchmark decontamination: BM25 over the test items with block-max pruning, then overlap of question and answer.

The index holds the test items: postings by term, their weights, and for every
term its largest weight in each block of items. Weights are BM25 impacts divided
by the item's score for itself, so one threshold serves all items. Every passage
of every document is a query. Passages are windows of twice the longest item, set
forward by its length, so an item that stands in a text lies whole in one of them.

The most frequent terms, as long as they make up at most half of the threshold
in every item, are not essential: a passage is skipped if that share and the
largest weights of its other terms, in each of a few groups of items, do not reach
the threshold. A block of items
is skipped if the sum of its block maxima does not; the items of the rest are
scored exactly, and all above the threshold are verified:
five-word shingles of the question (all but the last sentence) and of the answer
(the last sentence) found in the passage. An item counts as leaked where both
parts, or the whole, overlap by ``overlap`` or more.

The index is sent to the tasks; it holds at most ``block_items`` items, and more
items take further passes over the documents, one block each.

Defined results: null and empty texts match nothing, as do items without words;
an item shorter than a shingle is one shingle; texts of any length are searched
whole; repeated rows give the same rows again; ids may be null; other columns
are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siteroster.session import materialize

WORD = re.compile(r"\w+")
SENTENCE_END = re.compile(r"(?<=[.?!\n])\s+(?=\S)")
#: Groups of items whose bounds are summed for all passages of a text at once.
WIDE = 32
LEAKS = "doc_id long, item_id long, at_word long, bm25 double, question_overlap double, answer_overlap double"


def terms(text: str) -> list[str]:
    return WORD.findall(text.lower())


def shingles(found: list[str], size: int) -> list[tuple[str, ...]]:
    """Distinct shingles; a shorter text is one shingle."""
    return list(dict.fromkeys(tuple(found[i:i + size]) for i in range(max(1, len(found) - size + 1)))) if found else []


class Index:
    """Inverted index of a bounded block of test items, as flat arrays."""

    def __init__(self, items: list[tuple[int | None, str | None]], k1: float, b: float, block: int, size: int,
                 threshold: float):
        kept = [(item, text) for item, text in items if text and terms(text)]
        self.ids = [item for item, _ in kept]
        self.parts = []
        for _, text in kept:
            sentences = SENTENCE_END.split(text.strip())
            cut = [terms(" ".join(sentences[:-1])), terms(sentences[-1])] if len(sentences) > 1 else [terms(text), []]
            self.parts.append([shingles(part, size) for part in cut])
        counts = [Counter(terms(text)) for _, text in kept]
        lengths = [sum(c.values()) for c in counts]
        self.longest = max(lengths, default=0)
        mean = sum(lengths) / max(1, len(lengths))
        frequency = Counter(t for c in counts for t in c)
        self.term_no = {t: i for i, t in enumerate(frequency)}
        idf = {t: np.log(1 + (len(kept) - n + 0.5) / (n + 0.5)) for t, n in frequency.items()}
        postings: list[list[tuple[int, float]]] = [[] for _ in frequency]
        for item, (count, length) in enumerate(zip(counts, lengths)):
            weight = {t: idf[t] * n * (k1 + 1) / (n + k1 * (1 - b + b * length / mean)) for t, n in count.items()}
            own = sum(weight.values())
            for t, w in weight.items():
                postings[self.term_no[t]].append((item, w / own))
        self.first = np.cumsum([0] + [len(p) for p in postings])
        self.item = np.array([i for p in postings for i, _ in p], np.int64)
        self.weight = np.array([w for p in postings for _, w in p])
        tops = []
        for p in postings:
            best: dict[int, float] = {}
            for item, w in p:
                best[item // block] = max(w, best.get(item // block, 0.0))
            tops.append(list(best.items()))
        self.block, self.n_blocks = block, -(-len(kept) // block)
        self.block_first = np.cumsum([0] + [len(t) for t in tops])
        self.block_no = np.array([i for t in tops for i, _ in t], np.int64)
        self.block_top = np.array([w for t in tops for _, w in t])
        # largest weights in each of at most WIDE groups of items, side by side;
        # one more term, without weight, stands for all words outside the index
        wide = -(-len(kept) // WIDE) or 1
        self.top = np.zeros((len(postings) + 1, -(-len(kept) // wide) or 1), np.float32)
        for number, p in enumerate(postings):
            for item, w in p:
                self.top[number, item // wide] = max(w, self.top[number, item // wide])
        share, self.rest = np.zeros(len(kept)), 0.0
        for p, number in sorted(((p, i) for i, p in enumerate(postings)), key=lambda x: -len(x[0])):
            for item, w in p:
                share[item] += w
            if max(share[item] for item, _ in p) > threshold / 2:
                break
            self.rest = float(share.max())
            self.top[number] = 0.0
        self.heavy = self.top.any(axis=1)

    @staticmethod
    def _entries(first: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """Places in the flat arrays of all entries of some terms."""
        lengths = first[chosen + 1] - first[chosen]
        return np.repeat(first[chosen] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())

    def above(self, found: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """Items that a passage's distinct terms score at the threshold or higher."""
        places = self._entries(self.block_first, found)
        blocks = np.bincount(self.block_no[places], self.block_top[places], self.n_blocks) >= threshold
        if not blocks.any():
            return []
        places = self._entries(self.first, found)
        places = places[blocks[self.item[places] // self.block]]
        scores = np.bincount(self.item[places], self.weight[places], len(self.ids))
        return [(int(i), float(scores[i])) for i in np.flatnonzero(scores >= threshold)]

    def leaks(self, text: str, threshold: float, overlap: float, size: int) -> list[tuple]:
        found = terms(text)
        other = len(self.term_no)
        numbers = np.fromiter((self.term_no.get(w, other) for w in found), np.int64, len(found))
        heavy = np.flatnonzero(self.heavy[numbers])
        bound = np.zeros((len(heavy) + 1, self.top.shape[1]))
        np.cumsum(self.top[numbers[heavy]], axis=0, out=bound[1:])
        starts = np.arange(0, max(1, len(found) - self.longest), self.longest)
        ends = np.minimum(starts + 2 * self.longest, len(found))
        best: dict[int, tuple] = {}
        least = threshold - self.rest - 1e-6
        for passage in np.flatnonzero((bound[np.searchsorted(heavy, ends)]
                                       - bound[np.searchsorted(heavy, starts)]).max(axis=1) >= least):
            at, end = int(starts[passage]), int(ends[passage])
            here = np.unique(numbers[at:end])
            here = here[here < other]
            if self.top[here].sum(axis=0).max() < least:
                continue
            for item, score in self.above(here, threshold):
                question, answer = self.parts[item]
                words_here = found[at:end]
                near = {n: set(zip(*[words_here[i:] for i in range(n)]))
                        for n in {len(s) for part in (question, answer) for s in part}}
                hits = [sum(s in near[len(s)] for s in part) for part in (question, answer)]
                shares = [n / len(part) if part else 1.0 for n, part in zip(hits, (question, answer))]
                whole = sum(hits) / (len(question) + len(answer))
                if min(shares) >= overlap or whole >= overlap:
                    row = (at, score, *shares)
                    if item not in best or (sum(shares), score) > (sum(best[item][2:]), best[item][1]):
                        best[item] = row
        return [(item, *row) for item, row in sorted(best.items())]


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.8, size: int = 5,
    k1: float = 1.2, b: float = 0.75, block: int = 16, block_items: int = 20_000,
) -> DataFrame:
    """A row per document and leaked item, with its best passage."""
    docs, found = docs.select("doc_id", "text"), None
    items = benchmark.select("item_id", "text").toLocalIterator()
    while chunk := [(r[0], r[1]) for r in islice(items, block_items)] or ([] if found is not None else [(None, None)]):
        part = docs.mapInArrow(_searcher(Index(chunk, k1, b, block, size, threshold), threshold, overlap, size), LEAKS)
        if found is None and len(chunk) < block_items:
            return part
        part = materialize(part, "leaks")
        found = part if found is None else found.union(part)
    return found


def _searcher(index: Index, threshold: float, overlap: float, size: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc, index.ids[item], at, score, q, a)
                    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)) if index.ids and text.is_valid
                    for item, at, score, q, a in index.leaks(text.as_py(), threshold, overlap, size)]
            columns = zip(*rows) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.float64()] * 3)],
                ["doc_id", "item_id", "at_word", "bm25", "question_overlap", "answer_overlap"])

    return search


def drop_leaked(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.8, size: int = 5,
                k1: float = 1.2, b: float = 0.75, block: int = 16, block_items: int = 20_000) -> DataFrame:
    """The rows of ``docs`` without a leaked item, with all their columns; one narrow pass for each block of items."""

    def keeper(index: Index, text_at: int):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([
                    not (index.ids and text.is_valid and index.leaks(text.as_py(), threshold, overlap, size))
                    for text in batch.column(text_at)], pa.bool_()))

        return keep

    items = benchmark.select("item_id", "text").toLocalIterator()
    while chunk := [(r[0], r[1]) for r in islice(items, block_items)]:
        index = Index(chunk, k1, b, block, size, threshold)
        docs = docs.mapInArrow(keeper(index, docs.columns.index("text")), docs.schema)
        if len(chunk) == block_items:
            docs = materialize(docs, "clean")
    return docs
