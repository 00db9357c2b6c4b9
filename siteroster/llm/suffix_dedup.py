"""Exact removal of repeated byte strings of 200 bytes across all documents.

A window is a string of ``length`` bytes. Its anchor is the place, among its first
``REACH`` places, whose 16 bytes have the least hash: equal windows have equal
anchors at equal distance. Three steps:

1. The anchors' contexts (the bytes from the anchor that lie in all its windows)
   are hashed and counted over all documents. Those found twice or more set bits of
   a fixed-size bitmap, which is the only thing sent to all tasks. It may pass too
   much, never too little.
2. The windows of a passing anchor overlap and travel as one segment, the bytes
   from the first window's start to the last one's end. Segments meet by context.
   Equal segments are counted and their bytes sent once a task.
3. Within a partition, shards of segments get their sorted windows and
   Burrows-Wheeler transforms, and are merged by interleave refinement
   (``bwt_merge``); windows that share all bytes with a neighbour are repeated.

A document's repeated windows, as runs, are joined to its text and cut out.

Defined results: null texts are empty; texts below ``length`` bytes lose nothing;
long texts are read whole, in overlapping parts; repeated rows are documents of
their own, so all their windows are repeated; ids may be null; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteroster.llm.bwt_merge import build, merge, repeated
from siteroster.session import materialize

GRAM, REACH, PART = 16, 128, 1 << 22
#: Bytes of a text read at a time are ``PART``; windows that a task orders at a time, and in a shard:
TOGETHER, IN_SHARD = 1_000_000, 400_000


def _least(values: np.ndarray, reach: int) -> np.ndarray:
    """Least value of each run of ``reach`` (a power of two) neighbours."""
    width = 1
    while width < reach:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    return values


def anchors(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor places, and first and last window start of each; windows are those of the whole string."""
    n = len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    raw = np.frombuffer(data, np.uint8)
    words = np.lib.stride_tricks.sliding_window_view(raw, 8)[:n + REACH - 1 + 8]
    words = np.ascontiguousarray(words).view("<u8").ravel()
    mixed = words[:-8] * np.uint64(0x9E3779B97F4A7C15) ^ (words[8:] + np.uint64(0x7F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    places = np.arange(len(mixed), dtype=np.uint64)
    least = _least((mixed & ~np.uint64(PART * 2 - 1)) | places, REACH)[:n]
    chosen = (least & np.uint64(PART * 2 - 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
    return chosen[first], first, np.r_[first[1:], n] - 1


def _parts(data: bytes, length: int, size: int) -> Iterator[tuple[int, bytes]]:
    for at in range(0, max(1, len(data) - length + 1), size):
        yield at, data[at:at + size + length - 1]


def _contexts(data: bytes, places: np.ndarray, size: int) -> np.ndarray:
    hashed = xxhash.xxh64_intdigest
    return np.array([hashed(data[a:a + size]) for a in places.tolist()], np.uint64).view(np.int64)


def _bytes(text: pa.Scalar) -> bytes:
    return (text.as_py() or "").encode("utf-8", "surrogatepass")


def repeated_contexts(docs: DataFrame, length: int, size: int = PART) -> DataFrame:
    """``context`` hashes that are found at two or more anchors."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_contexts(part, anchors(part, length)[0], length - REACH + 1)
                     for text in batch.column(0) for _, part in _parts(_bytes(text), length, size)]
            values, counts = np.unique(np.concatenate(found or [np.zeros(0, np.int64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts)], ["context", "n"])

    counted = docs.select("text").mapInArrow(count, "context long, n long")
    return counted.groupBy("context").agg(F.sum("n").alias("n")).where("n > 1").select("context")


def bitmap(contexts: DataFrame, bits: int) -> np.ndarray:
    """Bits set at the contexts' numbers modulo a fixed size."""
    place = F.pmod("context", F.lit(bits))
    rows = contexts.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("set")).collect()
    found = np.zeros(bits + 2 * 32768, bool)
    for row in rows:
        part = np.unpackbits(np.frombuffer(bytes(row["set"]), np.uint8), bitorder="little")
        at = (row["bucket"] - 1) * 32768 + 1  # buckets count from one, and a bucket's first number is one past a multiple
        if row["bucket"] == 0:
            at = 0
        found[at:at + len(part)] |= part[:len(found) - at].astype(bool)
    return np.packbits(found)


SEGMENTS = "context long, segment binary, row long, at long, anchor int, windows int, bytes binary"


def segments(docs: DataFrame, passing: np.ndarray, bits: int, length: int, size: int = PART) -> DataFrame:
    """A row per anchor whose context may be repeated; the bytes once per segment and task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch in batches:
            rows = []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for offset, part in _parts(_bytes(text), length, size):
                    places, first, last = anchors(part, length)
                    contexts = _contexts(part, places, length - REACH + 1)
                    where = contexts % bits
                    some = np.flatnonzero((passing[where >> 3] >> (7 - (where & 7)).astype(np.uint8)) & 1)
                    for i in some.tolist():
                        own = part[first[i]:last[i] + length]
                        # the anchor's place is part of a segment's name: equal bytes may have it elsewhere at a part's edge
                        name = xxhash.xxh128_digest(own, seed=int(places[i] - first[i]))
                        new = name not in sent
                        if new:
                            sent.add(name)
                        rows.append((int(contexts[i]), name, row, offset + int(first[i]), int(places[i] - first[i]),
                                     int(last[i] - first[i] + 1), own if new else None))
                if len(sent) > 500_000:
                    sent.clear()
            columns = list(zip(*rows)) if rows else [[]] * 7
            types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)],
                                             ["context", "segment", "row", "at", "anchor", "windows", "bytes"])

    return docs.select("row", "text").mapInArrow(cut, SEGMENTS)


RUNS = "segment binary, first int, last int"


def _marked(rows: list[tuple[int, bytes, int, int, bytes]], depth: int, in_shard: int) -> pa.RecordBatch:
    """Runs of repeated windows in the different segments of some contexts."""
    data = np.frombuffer(b"\0" * 8 + b"".join(r[4] for r in rows), np.uint8)
    sizes = np.array([len(r[4]) for r in rows])
    windows = np.array([r[3] for r in rows])
    begin = 8 + np.cumsum(sizes) - sizes
    offset = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    start = np.repeat(begin, windows) + offset
    context = np.cumsum([i > 0 and rows[i][0] != rows[i - 1][0] for i in range(len(rows))])
    distance = np.repeat([r[2] for r in rows], windows) - offset
    bucket = np.repeat(context, windows) * REACH + distance
    shards = [build(data, start[i:i + in_shard], bucket[i:i + in_shard], depth)
              for i in range(0, len(start), in_shard)]
    whole = merge(data, shards, depth) if len(shards) > 1 else shards[0]
    found = np.sort(whole.start[repeated(whole, depth)])
    segment = np.searchsorted(begin, found, side="right") - 1
    offset = found - begin[segment]
    new = np.flatnonzero(np.r_[True, (segment[1:] != segment[:-1]) | (offset[1:] != offset[:-1] + 1)]) if len(found) else []
    ends = np.r_[new[1:], len(found)] - 1 if len(found) else []
    return pa.RecordBatch.from_arrays([
        pa.array([rows[segment[i]][1] for i in new], pa.binary()),
        pa.array([int(offset[i]) for i in new], pa.int32()), pa.array([int(offset[i]) for i in ends], pa.int32())],
        ["segment", "first", "last"])


def repeated_runs(found: DataFrame, length: int, together: int = TOGETHER, in_shard: int = IN_SHARD) -> DataFrame:
    """Runs of repeated windows by segment, among different segments."""
    if length % 8:
        raise ValueError("the merge reads symbols of eight bytes")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        waiting, last = 0, None
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if last is not None and row[:2] == last[:2]:
                    continue
                if waiting >= together and row[0] != last[0]:
                    yield _marked(held, length // 8, in_shard)
                    held, waiting = [], 0
                held.append(row)
                waiting, last = waiting + row[3], row
        if held:
            yield _marked(held, length // 8, in_shard)

    different = found.where("bytes is not null").select("context", "segment", "anchor", "windows", "bytes")
    return different.repartition("context").sortWithinPartitions("context", "segment").mapInArrow(mark, RUNS)


def _cut(length: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                data, kept, at, removed, spans = _bytes(text), hashlib.sha256(), 0, 0, []
                for run in sorted((r["a"], r["b"]) for r in runs or ()):
                    if spans and run[0] <= spans[-1][1]:
                        spans[-1] = (spans[-1][0], max(spans[-1][1], run[1]))
                    else:
                        spans.append(run)
                for a, b in spans:
                    kept.update(data[at:a])
                    removed += b - a
                    at = b
                kept.update(data[at:])
                rows.append((doc, len(data), removed, len(spans), kept.hexdigest()))
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.string()])],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return cut


def remove_repeats(
    docs: DataFrame, length: int = 200, bits: int = 1 << 26, size: int = PART, together: int = TOGETHER,
    in_shard: int = IN_SHARD,
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row."""
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    passing = bitmap(repeated_contexts(docs, length, size), bits)
    found = materialize(segments(docs, passing, bits, length, size), "segments")
    runs = repeated_runs(found, length, together, in_shard)
    twice = found.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.max("windows").alias("windows")).where(
        "n > 1").select("segment", F.lit(0).alias("first"), (F.col("windows") - 1).alias("last"))
    places = found.select("segment", "row", "at").join(materialize(runs.union(twice), "runs"), "segment")
    spans = places.groupBy("row").agg(F.collect_set(F.struct(
        (F.col("at") + F.col("first")).alias("a"), (F.col("at") + F.col("last") + length).alias("b"))).alias("runs"))
    joined = docs.join(spans, "row", "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(
        _cut(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
