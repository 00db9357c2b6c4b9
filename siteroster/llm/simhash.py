"""SimHash near-duplicates through the anchors of a covering code.

Fingerprints that differ in at most three bits differ in at most one bit of one
of their halves. The first 31 bits of a half are covered by the perfect Hamming
code of that length: every 31-bit word lies within radius one of exactly one code
word, its home anchor. A fingerprint goes to every anchor within the covering
radius plus the half's threshold, that is within two bits: its home and at most
fifteen others. Of two halves one bit apart, the second lies within two bits of
the first one's home, so both meet there and are compared over all 64 bits.

Only different fingerprints take part, so copies cost nothing here. An anchor
returns a spanning forest of its links instead of all pairs, and large anchors
compare within the equal bytes of the other half. The links' components are found
by repeated joins on tables.

Defined results: a null text or one without words has fingerprint zero and links
like any other; texts of any length are read whole; repeated rows are linked as
copies; rows with a null id take part and get the component of their text, null
where no linked row has an id; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteroster.llm.components import components
from siteroster.session import materialize

SEED = 42
#: Members up to which an anchor is compared as one block of pairs, and the side of the blocks that are compared at a time.
WHOLE, SIDE = 2048, 1024


def fingerprint(text: str | None, size: int = 3) -> int:
    """Bits set in over half of the XXH64 hashes of all word shingles."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined, hashed = b" ".join(found), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in found])
    n = max(1, len(found) - size + 1)
    starts = [0, *ends[:n - 1].tolist()]
    stops = (ends[size - 1:] - 1).tolist() if len(found) >= size else [len(joined)]
    hashes = np.array([hashed(joined[a:b], SEED) for a, b in zip(starts, stops)], "<u8").view(np.uint8).reshape(n, 8)
    bits = np.empty(64, bool)
    for byte in range(8):
        if n < 512:
            ones = np.unpackbits(hashes[:, byte:byte + 1], axis=1, bitorder="little").sum(axis=0)
        else:
            ones = np.bincount(hashes[:, byte], minlength=256) @ BYTE_BITS
        bits[8 * byte:8 * byte + 8] = 2 * ones > n
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """``doc_id, text_key, fp``: a hash of the text, and the fingerprint's bits as a signed long."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), size) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(found.view(np.int64))], ["doc_id", "text_key", "fp"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(
        read, "doc_id long, text_key long, fp long")


def _parity(words: np.ndarray) -> np.ndarray:
    """Syndrome of 31-bit words: the exclusive or of the (one-based) places of their set bits."""
    syndrome = np.zeros(len(words), np.uint32)
    for place in range(31):
        syndrome ^= np.where((words >> np.uint32(place)) & np.uint32(1), np.uint32(place + 1), np.uint32(0))
    return syndrome


def _flipped(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Words with the bit at a one-based place turned; place zero turns none."""
    return np.where(places > 0, words ^ (np.uint32(1) << (np.maximum(places, 1) - np.uint32(1)).astype(np.uint32)), words)


def anchors(halves: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Home anchors of 32-bit halves, and ``(rows, anchors)`` of all others within two bits of their 31 bits."""
    words = halves & np.uint32(0x7FFFFFFF)
    syndrome = _parity(words)
    home = _flipped(words, syndrome)
    others = []
    for first in range(1, 32):
        # a code word two bits away turns two places whose exclusive or is the syndrome
        second = syndrome ^ np.uint32(first)
        rows = np.flatnonzero((syndrome > 0) & (second > first))
        others.append((rows, _flipped(_flipped(words[rows], np.uint32(first) + np.zeros(len(rows), np.uint32)), second[rows])))
    return home, others


def _to_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy().view(np.uint64)
        for at in range(0, len(fp), 20_000):
            part = fp[at:at + 20_000]
            for half in (0, 1):
                home, others = anchors(((part >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.uint32))
                keys = np.concatenate([home, *[a for _, a in others]]).astype(np.int64) * 2 + half
                rows = np.concatenate([np.arange(len(part)), *[r for r, _ in others]])
                at_home = np.arange(len(rows)) < len(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(at_home), pa.array(part[rows].view(np.int64))], ["anchor", "home", "fp"])


def _close(a: np.ndarray, b: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows at most ``limit`` bits apart, in blocks of rows."""
    left, right = [], []
    for at in range(0, len(a), SIDE):
        for to in range(0, len(b), SIDE):
            near = np.bitwise_count(a[at:at + SIDE, None] ^ b[None, to:to + SIDE]) <= limit
            i, j = np.nonzero(near)
            left.append(i + at)
            right.append(j + to)
    return np.concatenate(left), np.concatenate(right)


class Forest:
    """Union-find over one anchor's members; returns only the links that joined two trees."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
        links = []
        for i, j in zip(left.tolist(), right.tolist()):
            a, b = self.root(i), self.root(j)
            if a != b:
                self.parent[max(a, b)] = min(a, b)
                links.append((i, j))
        return links


def anchor_links(fps: np.ndarray, home: np.ndarray, half: int, limit: int) -> list[tuple[int, int]]:
    """Links (as rows) between an anchor's home members and all of its members."""
    forest, links = Forest(len(fps)), []
    if len(fps) <= WHOLE:
        groups = [np.arange(len(fps))]
    else:
        # one byte of the other half is equal, as at most three of its bits differ
        other = ((fps >> np.uint64(32 * (1 - half))) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        groups = []
        for byte in range(4):
            value = (other >> np.uint32(8 * byte)) & np.uint32(255)
            order = np.argsort(value, kind="stable")
            groups += [g for g in np.split(order, np.flatnonzero(np.diff(value[order])) + 1) if len(g) > 1]
    for group in groups:
        mine = group[home[group]]
        for at in range(0, len(mine), SIDE):
            i, j = _close(fps[mine[at:at + SIDE]], fps[group], limit)
            links += forest.join(mine[at:at + SIDE][i], group[j])
    return links


def _compare(limit: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)]

        def links(anchor: np.ndarray, home: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
            last = np.r_[first[1:], len(anchor)]
            homes = np.add.reduceat(home.astype(np.int64), first)
            rows = []
            for g in np.flatnonzero((homes > 0) & (last - first > 1)):
                a, b = first[g], last[g]
                members = fp[a:b].view(np.uint64)
                if b - a == 2:
                    if int(members[0] ^ members[1]).bit_count() <= limit:
                        rows.append((fp[a], fp[a + 1]))
                else:
                    rows += [(fp[a + i], fp[a + j]) for i, j in
                             anchor_links(members, home[a:b], int(anchor[a] & 1), limit)]
            found = np.array(rows, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], ["a", "b"])

        for batch in batches:
            new = [batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()]
            held = [np.concatenate(pair) for pair in zip(held, new)]
            if len(held[0]) and held[0][0] != held[0][-1]:
                cut = int(np.searchsorted(held[0], held[0][-1]))
                yield links(*[x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if len(held[0]):
            yield links(*held)

    return compare


def near_links(distinct: DataFrame, limit: int = 3) -> DataFrame:
    """Links ``a, b`` between different fingerprints of ``distinct`` (column ``fp``) that connect all within ``limit``."""
    if not 0 <= limit <= 3:
        raise ValueError("halves and radius-one anchors serve limits of at most 3 bits")
    placed = distinct.select("fp").mapInArrow(_to_anchors, "anchor long, home boolean, fp long")
    grouped = placed.repartition("anchor").sortWithinPartitions("anchor")
    return grouped.mapInArrow(_compare(limit), "a long, b long")


def near_duplicates(docs: DataFrame, limit: int = 3, size: int = 3) -> DataFrame:
    """``doc_id, text_key, fp, root, component_id`` for every row.

    The component is the smallest id that links reach; the root is one of its fingerprints.
    """
    prints = materialize(fingerprints(docs, size), "prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-prints")
    roots = components(materialize(near_links(distinct, limit), "links"))
    classes = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.select("fp", "root").join(least, "root").select("fp", "root", "component_id")
    return prints.join(named, "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def keep_one(docs: DataFrame, limit: int = 3, size: int = 3) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest id, then text hash; rows without id last."""
    return first_rows(docs, near_duplicates(docs, limit, size))


def first_rows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The first row of ``docs`` of each ``root``; ``found`` has ``doc_id, text_key, root`` of every row."""
    # least of a struct would put null first
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    keepers = materialize(found.groupBy("root").agg(F.min(order).alias("k")).select(
        F.col("k.doc_id").alias("k_doc"), F.col("k.text_key").alias("k_text")), "keepers")
    # an id may stand in components of different texts; each keeps its own row
    kept = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.xxhash64("text").alias("text_key")).join(
        keepers.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("k_doc")) & (F.col("text_key") == F.col("k_text")), "left_semi")
    if found.count() > found.select("doc_id", "text_key").distinct().count():
        # repeated rows, alike in id and text: the first of them stays
        kept = kept.groupBy("doc_id", "text_key").agg(F.first("row").alias("row"))
    return kept.select("row.*")
