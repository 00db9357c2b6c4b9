"""Quality selection by importance resampling over hashed n-grams (Xie et al., 2023).

Two generative models are bags of hashed words and word pairs: the target's from
labelled good documents, the raw one from all documents. A document's log weight
is the sum of log(target / raw) over its n-grams. Its key is the log weight plus
Gumbel noise drawn from a hash of its id; the k largest keys are a sample without
replacement in proportion to the weights.

The raw counts cover every document. The target is fitted on a bounded sample of
labelled rows (about ``max_labels``, those with the lowest hashes of the id). k is ``share`` of all
rows; by default the share of good labels raised by ``margin``, so that the
sample has room for all documents of the target's kind.

The k-th key is found exactly without sorting: keys are mapped to 64-bit numbers
of the same order, and four counts of 16-bit digits narrow the place down.

Defined results: null and empty texts have log weight zero; keys equal to the
k-th are all kept; repeated rows have equal keys and are kept or left together;
a null id has noise like any other; without good labels all log weights are zero;
other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteroster.llm.sampling import chosen_by_hash
from siteroster.session import materialize

WORD = re.compile(r"\w+|[^\w\s]+")
REMEMBERED = 300_000


class Grams:
    """Buckets of a text's words and word pairs."""

    def __init__(self, buckets: int):
        self.buckets, self.known = buckets, {}

    def of(self, text: str | None) -> np.ndarray:
        found = WORD.findall(text.lower()) if text else []
        if not found:
            return np.zeros(0, np.int64)
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        hashes = np.fromiter(
            (known.get(w) or known.setdefault(w, zlib.crc32(w.encode("utf-8", "surrogatepass")) + 1) for w in found),
            np.uint64, len(found))
        pairs = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ hashes[1:]
        mixed = np.concatenate([hashes, pairs]) * np.uint64(0xBF58476D1CE4E5B9)
        return ((mixed >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)


def gram_counts(docs: DataFrame, good: list[int], buckets: int) -> DataFrame:
    """``bucket, raw, target``: counts over all documents and over those with a good label."""
    chosen = frozenset(good)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, total = Grams(buckets), np.zeros((2, buckets), np.int64)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = np.bincount(grams.of(text.as_py()), minlength=buckets)
                total[0] += found
                if doc in chosen:
                    total[1] += found
        some = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array(total[0, some]), pa.array(total[1, some])], ["bucket", "raw", "target"])

    found = docs.select("doc_id", "text").mapInArrow(count, "bucket long, raw long, target long")
    return found.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def gumbel(ids: np.ndarray, seed: int) -> np.ndarray:
    """Gumbel noise from a 64-bit mix of each id."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.int64).view(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    uniform = ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0 ** 53
    return -np.log(-np.log(uniform))


def ordered_bits(keys: np.ndarray) -> np.ndarray:
    """Signed 64-bit numbers in the order of the keys."""
    bits = np.ascontiguousarray(keys, np.float64).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def score(docs: DataFrame, ratio: np.ndarray, seed: int) -> DataFrame:
    """``doc_id, n_grams, log_weight, key, place`` for every row."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(len(ratio))
        for batch in batches:
            found = [grams.of(t.as_py()) for t in batch.column(1)]
            weights = np.array([ratio[f].sum() for f in found], np.float64)
            keys = weights + gumbel(batch.column(0).fill_null(-1).to_numpy(), seed)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array(weights),
                 pa.array(keys), pa.array(ordered_bits(keys))],
                ["doc_id", "n_grams", "log_weight", "key", "place"])

    return docs.select("doc_id", "text").mapInArrow(
        weigh, "doc_id long, n_grams long, log_weight double, key double, place long")


def kth_largest(table: DataFrame, column: str, k: int) -> int:
    """The k-th largest 64-bit number: four counts by 16-bit digit, each over what the last one left."""
    prefix, rest = None, k
    for shift in (48, 32, 16, 0):
        part = table if prefix is None else table.where(F.shiftright(column, shift + 16) == prefix)
        counts = part.groupBy(F.shiftright(column, shift).alias("digit")).count().collect()
        for digit, n in sorted(((r["digit"], r["count"]) for r in counts), reverse=True):
            if rest <= n:
                prefix = digit
                break
            rest -= n
    return prefix


def resample(
    docs: DataFrame, labels: DataFrame, share: float | None = None, margin: float = 0.05,
    buckets: int = 16_384, max_labels: int = 20_000, smoothing: float = 1.0, seed: int = 17,
) -> DataFrame:
    """``doc_id, n_grams, log_weight, key, kept`` for every document."""
    labels = labels.where("doc_id is not null and quality is not null").select("doc_id", "quality")
    sample = labels.where(chosen_by_hash(labels, "doc_id", max_labels)).collect()
    good = [r["doc_id"] for r in sample if r["quality"] == 1]
    if share is None:
        share = min(1.0, len(good) / len(sample) + margin) if sample else 1.0
    counts = np.zeros((2, buckets))
    for row in gram_counts(docs, good, buckets).collect():
        counts[:, row["bucket"]] = row["raw"], row["target"]
    raw, target = [np.log((c + smoothing) / (c.sum() + smoothing * buckets)) for c in counts]
    ratio = target - raw if counts[1].any() else np.zeros(buckets)
    scored = materialize(score(docs, ratio, seed), "scored")
    n = scored.count()
    k = round(share * n)
    least = kth_largest(scored, "place", k) if 0 < k <= n else None
    kept = F.lit(False) if least is None else F.col("place") >= least
    return scored.select("doc_id", "n_grams", "log_weight", "key", kept.alias("kept"))
