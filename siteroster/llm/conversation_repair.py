"""Conversation structure repair: the cheapest edits that give every conversation a legal order of roles.

A conversation's rows, in order, become a signature of one symbol a row: its role's
initial and whether it must go (blank, duplicate) or is cut off (truncated). Different
signatures are shared by very many conversations, and their ends by still more. They are
range-partitioned and sorted by the reversed signature, and each task builds an automaton
from the end: a node is a symbol and the node behind it, so equal ends are one node, and
in sorted order the nodes still in use are the stack of the current signature. Cost-to-go
and the best audit suffix are worked out once per node and grammar state; a suffix is an
edit chunk and a link into the next node. Chunks are inserts followed by one edit that
consumes the row, so no chunk begins another one and the ASCII-least audit among equal
costs is settled by the chunk alone. The signatures' audits are joined to the
conversations, and the rows stream past their audit once more to be repaired.

A legal order is empty, or an optional system row and one or more pairs of user and
assistant. Keep costs 0, Rerole to user or assistant 3, Delete 4, Insert of an empty user
or assistant row 3; a blank or duplicate row must be deleted; a truncated row that stays
adds 3.

Only ids, flags and 128-bit text hashes are shuffled to find signatures; texts are shuffled
once, beside their audit. A conversation is read as a sorted stream, of any length: its
digest and order are sequential, so its rows meet in one task, which holds its symbols
(a byte a row) and never its texts.

Defined results: a null role or text is one space; rows are ordered by turn (nulls first),
then role, then the MD5 of the text; a null conversation id is a conversation of its own;
repeated rows are duplicates; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteroster.llm.words import SPACE_CHARS
from siteroster.session import materialize

REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
#: Grammar states: nothing yet, after the system row, after a user row, after a pair; what each takes next, and where that leads.
WANTED, AFTER = "uuau", (2, 2, 3, 2)
ROLES = {"u": b"user", "a": b"assistant"}
#: Symbol of a row that must go; others are the initial (``o`` for any other), upper-case if the row is truncated.
GOES = "d"
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
ORDER = ["turn", "role", "text_key"]


def _options(symbol: str, state: int) -> list[tuple[int, str, int]]:
    """Cost, edit chunk and next state of all ways to consume a row; more than two inserts only come back to a state."""
    found = []
    for inserts in range(3):
        cost, chunk = INSERT * inserts, "I" * inserts
        found.append((cost + DELETE, chunk + "D", state))
        if symbol != GOES:
            cost += CUT if symbol.isupper() else 0
            initial = symbol.lower()
            if initial == WANTED[state]:
                found.append((cost, chunk + "K", AFTER[state]))
            if initial == "s" and state == 0:
                found.append((cost, chunk + "K", 1))
            found.append((cost + REROLE, chunk + "R", AFTER[state]))
        state = AFTER[state]
    return found


OPTIONS = {symbol: [_options(symbol, state) for state in range(4)] for symbol in "dsuaoSUAO"}
#: At the end: cost, last chunk, and no next state.
LAST = ((0, "", -1), (2 * INSERT, "II", -1), (INSERT, "I", -1), (0, "", -1))

Node = tuple[tuple[int, str, int], ...]


def node(symbol: str, behind: Node) -> Node:
    """For each grammar state the least ``(cost-to-go, chunk, next state)``."""
    return tuple(min((cost + behind[to][0], chunk, to) for cost, chunk, to in options) for options in OPTIONS[symbol])


class Automaton:
    """Nodes of the signatures' ends; signatures come sorted by their reversed form, so only one path is held."""

    def __init__(self) -> None:
        self.path, self.symbols, self.nodes = [LAST], "", 0

    def solve(self, reversed_signature: str) -> tuple[int, str]:
        """Cost and audit of a signature."""
        shared, most = 0, min(len(self.symbols), len(reversed_signature))
        if self.symbols[:most] == reversed_signature[:most]:
            shared = most
        else:
            while self.symbols[shared] == reversed_signature[shared]:
                shared += 1
        del self.path[shared + 1:]
        for symbol in reversed_signature[shared:]:
            self.path.append(node(symbol, self.path[-1]))
        self.nodes += len(reversed_signature) - shared
        self.symbols = reversed_signature
        chunks, state = [], 0
        for at in reversed(self.path):
            _, chunk, state = at[state]
            chunks.append(chunk)
        return self.path[-1][0][0], "".join(chunks)


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = Automaton()
    for batch in batches:
        turned = batch.column(0).to_pylist()
        solved = [automaton.solve(signature) for signature in turned]
        yield pa.RecordBatch.from_arrays(
            [pa.array([s[::-1] for s in turned], pa.string()), pa.array([c for c, _ in solved], pa.int64()),
             pa.array([a for _, a in solved], pa.string())], ["signature", "cost", "audit"])


def audits(signatures: DataFrame) -> DataFrame:
    """``signature, cost, audit`` of every different ``signature``."""
    turned = signatures.select(F.reverse("signature").alias("turned")).distinct()
    return turned.repartitionByRange("turned").sortWithinPartitions("turned").mapInArrow(
        _audits, "signature string, cost long, audit string")


def _plain(rows: DataFrame) -> DataFrame:
    space = lambda name: F.coalesce(F.col(name), F.lit(" ")).alias(name)
    return rows.select("conv_id", "turn", space("role"), space("text")).withColumn("text_key", F.unhex(F.md5("text")))


def _in_order() -> list[Column]:
    return [F.col(name).asc_nulls_first() for name in ORDER]


def faults(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text_key, seen, initial, fault`` of every row: the first of blank, duplicate, truncated."""
    end = F.substring(F.rtrim(F.col("text"), F.lit(SPACE_CHARS)), -1, 1)
    flagged = _plain(rows).select("conv_id", *ORDER, F.substring("role", 1, 1).alias("initial"), end.alias("end"))
    same = Window.partitionBy("conv_id", "role", "text_key").orderBy(F.col("turn").asc_nulls_first())
    return flagged.withColumn("seen", F.row_number().over(same)).select(
        "conv_id", *ORDER, "seen", "initial", F.when(F.col("end") == "", BLANK).when(F.col("seen") > 1, DUPLICATE)
        .when(F.col("end").isin(".", "!", "?"), FINE).otherwise(TRUNCATED).alias("fault"))


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]
LEGAL = {"su", "ua", "au"}


class _Conversation:
    """What is gathered while the sorted rows of one conversation pass."""

    def __init__(self, conv: int | None):
        self.conv, self.symbols, self.last = conv, bytearray(), None
        self.counts, self.illegal = [0] * 4, 0
        self.first = self.turn = None
        self.turns = 0

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        if turn is not None and turn != self.turn:
            self.first = turn if self.first is None else self.first
            self.turn, self.turns = turn, self.turns + 1
        self.counts[fault] += 1
        if self.last is not None and self.last + initial not in LEGAL:
            self.illegal += 1
        self.last = initial
        symbol = GOES if fault in (BLANK, DUPLICATE) else initial if initial in ("s", "u", "a") else "o"
        self.symbols += (symbol.upper() if fault == TRUNCATED else symbol).encode()

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.turn - self.first + 1 - self.turns
        return (self.conv, self.symbols.decode(), gaps, *self.counts[1:], self.illegal)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Conversation | None = None
    names = ["conv_id", "signature", *COUNTS]
    types = [pa.int64(), pa.string(), *[pa.int64()] * len(COUNTS)]

    def out(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

    for batch in batches:
        done = []
        for conv, turn, initial, fault in zip(*[column.to_pylist() for column in batch.columns]):
            if now is None or conv != now.conv:
                if now is not None:
                    done.append(now.row())
                now = _Conversation(conv)
            now.add(turn, initial, fault)
        yield out(done)
    if now is not None:
        yield out([now.row()])


def signatures(rows: DataFrame) -> DataFrame:
    """``conv_id, signature`` and the counts of every conversation."""
    sorted_rows = faults(rows).repartition("conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), *_in_order(), "seen")
    return sorted_rows.select("conv_id", "turn", "initial", F.col("fault").cast("int")).mapInArrow(
        _signatures, "conv_id long, signature string, " + ", ".join(f"{name} long" for name in COUNTS))


def reports(rows: DataFrame) -> DataFrame:
    """``conv_id``, the counts, ``cost`` and ``audit`` of every conversation of ``conv_id, turn, role, text``."""
    found = materialize(signatures(rows), "signatures")
    solved = materialize(audits(found.select("signature")), "audits")
    return materialize(found.join(solved, "signature").select("conv_id", *COUNTS, "cost", "audit"), "reports")


def _beside_audits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows in order."""
    audit = found.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.col("audit").alias("role"),
                         F.lit(None).cast("binary").alias("text_key"), F.lit(None).cast("binary").alias("body"))
    both = _plain(rows).select("conv_id", F.lit(1).alias("kind"), *ORDER, F.col("text").cast("binary").alias("body")).unionByName(audit)
    return both.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "kind", *_in_order()).select(
        "conv_id", "kind", "turn", F.col("role").cast("binary").alias("role"), "body")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``(conv_id, edit, turn, role, body)`` of every repaired row; a conversation opens with edit ``""`` and ends each batch with ``None``."""
    audit, at, state, conv = b"", 0, 0, None

    def inserted() -> Iterator[tuple]:
        nonlocal at, state
        while audit[at:at + 1] == b"I":
            yield conv, "I", None, ROLES[WANTED[state]], b""
            at, state = at + 1, AFTER[state]

    for batch in batches:
        for conv_id, kind, turn, role, body in zip(*[column.to_pylist() for column in batch.columns]):
            if kind == 0:
                yield from inserted()
                conv, audit, at, state = conv_id, role, 0, 0
                yield conv, "", None, b"", b""
                continue
            yield from inserted()
            edit = audit[at:at + 1].decode()
            at += 1
            if edit == "D":
                continue
            if edit == "R":
                role = ROLES[WANTED[state]]
            state = 1 if edit == "K" and state == 0 and role[:1] == b"s" else AFTER[state]
            yield conv, edit, turn, role, body
        yield None
    yield from inserted()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, held = 0, []

    def out() -> pa.RecordBatch:
        columns = list(zip(*held)) or [()] * 6
        held.clear()
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)],
                                          ["conv_id", "place", "edit", "turn", "role", "text"])

    for row in _walk(batches):
        if row is None:
            yield out()
        elif row[1] == "":
            place = 0
        else:
            held.append((row[0], place, *row[1:]))
            place += 1
    yield out()


def repaired_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``conv_id, place, edit, turn, role, text`` of the repaired conversations; ``found`` are their reports."""
    out = _beside_audits(rows, found).mapInArrow(
        _rows, "conv_id long, place long, edit string, turn long, role binary, text binary")
    return out.withColumn("role", F.decode("role", "utf-8")).withColumn("text", F.decode("text", "utf-8"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done: list[tuple] = []
    conv, digest, empty = None, None, True

    def out() -> pa.RecordBatch:
        ids, hexes = list(zip(*done)) or [(), ()]
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(ids), pa.int64()), pa.array(list(hexes), pa.string())],
                                          ["conv_id", "repaired_sha256"])

    for row in _walk(batches):
        if row is None:
            yield out()
        elif row[1] == "":
            if digest is not None:
                done.append((conv, digest.hexdigest()))
            conv, digest, empty = row[0], hashlib.sha256(), True
        else:
            digest.update((b"" if empty else b"\n") + row[3] + b":")
            digest.update(row[4])
            empty = False
    if digest is not None:
        done.append((conv, digest.hexdigest()))
    yield out()


def repaired_digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: the digest of the repaired rows as lines of ``role:text``."""
    return _beside_audits(rows, found).mapInArrow(_digests, "conv_id long, repaired_sha256 string")
