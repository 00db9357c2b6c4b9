"""Best-fit packing of tokenised documents into sequences of a fixed length.

A document's ids are cut into pieces of ``capacity`` tokens; whole pieces are a
sequence each. The rest is packed in a tree: every task packs its items best-fit,
longest first, emits bins that are nearly full, and passes the others on as items
of fewer tasks, until one task is left or a round no longer empties bins. A task
holds ``block`` items at a time, so memory does not depend on the input.

Each level is a table in the checkpoint folder: a lost executor repeats a task of
one level and cannot change bins that other tasks have already read.

Defined results: a null or empty text is its end token alone; texts of any length
are tokenised whole; repeated rows are packed each; a null id stays null; other
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteroster.session import materialize

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
BINS = "bin long, used int, done boolean, members binary"
MEMBER = np.dtype([("doc", "<i8"), ("no_doc", "?"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i4"),
                   ("crc", "<u4"), ("offset", "<i4")])
#: Words whose ids a worker remembers, and texts that it reads at a time.
REMEMBERED, TOGETHER = 1_000_000, 256


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: A full stop and the like behind a letter or digit is a token of its own, as after white space.
MARKS = re.compile(rb"(?<=[a-z0-9])([.,;:!?]+)(?=\s|$)")


PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


class WordIds:
    """Ids of texts, word by word: this vocabulary's tokens never cross white space, and are those of lower case.

    A worker keeps the ids of the first ``REMEMBERED`` words it meets, which has the frequent ones among them.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        vocabulary = self.tokenizer.get_vocab()
        self.word_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.word_end[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _coded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, missing: set[bytes]) -> dict[bytes, bytes]:
        # words of Latin letters have one word end each, so many can be coded as one text
        plain = [w for w in missing if PLAIN.fullmatch(w)]
        rest = list(missing.difference(plain))
        found = {w: ids.tobytes() for w, ids in zip(
            rest, self._coded([w.decode("utf-8", "replace") for w in rest]))}
        if plain:
            ids = self._coded([b" ".join(plain).decode()])[0]
            ends = ((np.flatnonzero(self.word_end[ids]) + 1) * 4).tolist()
            if len(ends) != len(plain):
                raise ValueError("the tokenizer does not end every word with a word-end token")
            coded = ids.tobytes()
            found.update(zip(plain, [coded[i:j] for i, j in zip([0, *ends], ends)]))
        return found

    def of(self, texts: list[str]) -> list[bytes]:
        """The ids of texts as little-endian unsigned 32-bit numbers."""
        raw = [text.encode("utf-8", "surrogatepass") for text in texts]
        lower = [r.lower() for r in raw]
        odd = [any(token in r for token in self.special) for r in lower]
        found = [[] if o else MARKS.sub(rb" \1", r).split() for r, o in zip(lower, odd)]
        known = self.known
        missing = {w for words in found for w in words if w not in known}
        full = len(known) >= REMEMBERED
        if missing:
            known.update(self._new(missing))
        coded = [self._coded([text])[0].tobytes() if o else b"".join(map(known.__getitem__, words))
                 for text, words, o in zip(texts, found, odd)]
        if full:
            for word in missing:
                del known[word]
        return coded


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One per worker process: its memory serves all tasks that the worker runs."""
    return WordIds(path)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                rows: list[tuple] = []
                texts = [text or "" for text in part.column(1).to_pylist()]
                for doc, coded in zip(part.column(0).to_pylist(), ids.of(texts)):
                    coded += end
                    for piece, first in enumerate(range(0, len(coded), 4 * capacity)):
                        cut_ids = coded[first:first + 4 * capacity]
                        rows.append((doc, piece, first // 4, len(cut_ids) // 4, zlib.crc32(cut_ids)))
                yield _batch(rows, [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()],
                             ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def _batch(rows: list[tuple], types: list, names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing; bins as lists of item numbers.

    Bins lie in stacks by their free space; the bits of one integer tell which
    stacks are not empty, so the fullest bin with room is its lowest set bit.
    """
    bins: list[list[int]] = []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[item]
        room = some >> need
        if room:
            free = need + (room & -room).bit_length() - 1
            at = stacks[free].pop()
            if not stacks[free]:
                some ^= 1 << free
            bins[at].append(item)
            free -= need
        else:
            at, free = len(bins), capacity - need
            bins.append([item])
        if free:
            stacks[free].append(at)
            some |= 1 << free
    return bins


def _packed(members: list[np.ndarray], used: list[int], capacity: int, nearly: int, ids: Iterator[int]) -> pa.RecordBatch:
    rows = []
    for chosen in best_fit(used, capacity):
        total, parts = 0, []
        for item in chosen:
            part = members[item].copy()
            part["offset"] += total
            parts.append(part)
            total += used[item]
        rows.append((next(ids), total, total >= nearly, np.concatenate(parts).tobytes()))
    return _batch(rows, [pa.int64(), pa.int32(), pa.bool_(), pa.binary()], ["bin", "used", "done", "members"])


def _numbers(level: int) -> Iterator[int]:
    first = (level << 56) + (TaskContext.get().partitionId() << 32)
    return iter(range(first, first + (1 << 32)))


def pack_pieces(pieces: DataFrame, capacity: int, nearly: int, block: int) -> DataFrame:
    """Level 0: pieces below ``capacity`` packed within their task."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held = _numbers(0), []
        for batch in batches:
            rows = np.zeros(batch.num_rows, MEMBER)
            rows["doc"] = batch.column(0).fill_null(0).to_numpy()
            rows["no_doc"] = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for name, i in (("piece", 1), ("start", 2), ("length", 3), ("crc", 4)):
                rows[name] = batch.column(i).to_numpy()
            held += [rows[i:i + 1] for i in range(len(rows))]
            if len(held) >= block:
                yield _packed(held, [int(m["length"][0]) for m in held], capacity, nearly, ids)
                held = []
        if held:
            yield _packed(held, [int(m["length"][0]) for m in held], capacity, nearly, ids)

    return pieces.where(F.col("length") < capacity).mapInArrow(pack, BINS)


def pack_bins(bins: DataFrame, level: int, capacity: int, nearly: int, block: int) -> DataFrame:
    """A higher level: underfull bins are the items."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, used, members = _numbers(level), [], []
        for batch in batches:
            used += batch.column("used").to_pylist()
            members += [np.frombuffer(m.as_py(), MEMBER) for m in batch.column("members")]
            if len(used) >= block:
                yield _packed(members, used, capacity, nearly, ids)
                used, members = [], []
        if used:
            yield _packed(members, used, capacity, nearly, ids)

    return bins.mapInArrow(pack, BINS)


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [np.frombuffer(m.as_py(), MEMBER) for m in batch.column("members")]
        rows = np.concatenate(parts) if parts else np.zeros(0, MEMBER)
        sequence = np.repeat(batch.column("bin").to_numpy(), [len(p) for p in parts])
        yield pa.RecordBatch.from_arrays([
            pa.array(rows["doc"], pa.int64(), mask=rows["no_doc"]), pa.array(rows["piece"], pa.int32()),
            *[pa.array(rows[n].astype("i8")) for n in ("start", "length", "crc")],
            pa.array(sequence.astype("i8")), pa.array(rows["offset"].astype("i8"))],
            ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack_documents(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = 4096, end_id: int = 1,
    slack: int = 4, block: int = 50_000, fan_in: int = 8, least_gain: float = 0.02,
) -> DataFrame:
    """A row per piece: its document, place in the document, and place in its sequence.

    ``slack`` free tokens make a bin nearly full. A level runs with an eighth
    (``fan_in``) of the tasks of the one below, and never with more than
    ``block`` items a task.
    """
    pieces = materialize(token_pieces(docs, tokenizer or default_tokenizer(), capacity, end_id), "pieces")
    nearly = capacity - slack
    levels = [materialize(pack_pieces(pieces, capacity, nearly, block), "bins")]
    waiting = levels[0].where(~F.col("done")).count()
    tasks = fan_in * max(1, -(-waiting // block))
    while waiting > 1 and tasks > 1:
        tasks = max(-(-tasks // fan_in), -(-waiting // block))
        level = materialize(pack_bins(
            levels[-1].where(~F.col("done")).repartition(tasks), len(levels), capacity, nearly, block), "bins")
        before, waiting = waiting, level.where(~F.col("done")).count()
        levels.append(level)
        if tasks > 1 and level.count() > (1 - least_gain) * before:
            break
    placed = levels[-1]
    for level in levels[:-1]:
        placed = placed.union(level.where("done"))
    whole = pieces.where(F.col("length") == capacity).select(
        "*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.mapInArrow(
        _placed, PIECES + ", sequence_id long, offset long").union(whole)
