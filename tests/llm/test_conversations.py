"""Conversation repair against a plain version that tries all edits, and its SQL."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from siteroster.llm.conversation_repair import Automaton, repaired_rows, reports
from siteroster.llm.queries_conversations import ENTRIES, repair_report
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0D]")
NAMES = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """Least (cost, audit) of rows ``(initial, must go, truncated)`` by a search over whole edit sequences."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, roles = heapq.heappop(heap)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit
        shape = (at, roles[-1:] if roles else "")
        # the first to leave a shape is the least: edits that consume rows are a prefix-free code
        if (shape, audit[-1:] == "I") in seen:
            continue
        seen.add((shape, audit[-1:] == "I"))
        wanted = {"": "u", "s": "u", "u": "a", "a": "u"}[roles[-1:]]
        heapq.heappush(heap, (cost + 3, audit + "I", at, roles + wanted))
        if at < len(rows):
            initial, goes, cut = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, roles))
            if not goes:
                heapq.heappush(heap, (cost + 3 + 3 * cut, audit + "R", at + 1, roles + wanted))
                if initial == wanted or (initial == "s" and not roles):
                    heapq.heappush(heap, (cost + 3 * cut, audit + "K", at + 1, roles + initial))
    raise AssertionError


def damage(rows):
    for conv, turn, role, text in rows:
        role, text = [" " if x is None else x for x in (role, text)]
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)


def brute(table):
    found, kept = [], list(damage(table))
    for conv in {r[0] for r in table}:
        rows = [r[1:] for r in kept if r[0] == conv]
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        counts, marks, seen = {"b": 0, "d": 0, "t": 0}, [], set()
        for _, role, text in rows:
            chars = WORD.findall(text)
            fault = "b" if not chars else "d" if (role, text) in seen else "" if chars[-1] in ".!?" else "t"
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            marks.append((role[:1], fault in ("b", "d"), fault == "t"))
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(marks))
        cost, audit = cheapest(marks)
        lines, at, pairs = [], 0, 0
        for edit in audit:
            if edit == "D":
                at += 1
                continue
            role = NAMES["ua"[pairs % 2]] if edit in "IR" else rows[at][1]
            lines.append(f"{role}:{'' if edit == 'I' else rows[at][2]}")
            pairs += not (edit == "K" and role[:1] == "s")
            at += edit != "I"
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        found.append((conv, gaps, counts["b"], counts["d"], counts["t"], illegal, cost, audit, digest))
    return sorted(found, key=repr)


def table_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_automaton_equals_a_search():
    symbols = "dsuaoSUAO"
    marks = {c: (c.lower(), c == "d", c.isupper()) for c in symbols}
    # every search state of an insert also leads on, so short sequences are tried without the shortcut of the search
    every = ["".join(p) for n in range(5) for p in itertools.product(symbols, repeat=n)]
    rng = random.Random(1)
    every += ["".join(rng.choice(symbols) for _ in range(rng.randint(5, 14))) for _ in range(2000)]
    automaton = Automaton()
    for turned in sorted({s[::-1] for s in every}):
        assert automaton.solve(turned) == cheapest([marks[c] for c in reversed(turned)]), turned[::-1]
    suffixes = {s[i:] for s in every for i in range(len(s))}
    assert automaton.nodes == len(suffixes)


def test_against_plain(spark):
    rng = random.Random(3)
    texts = ["Fine.", "Well?\n", "cut off", " ", "", None, "Dup!", "a.b.c", "é! ", ".", "ends.\t\x0b"]
    rows = []
    for conv in [*range(150), None]:
        for turn in range(rng.randint(1, 9)):
            place = rng.choice([turn, turn, turn, 2 * turn, None])
            rows.append((conv, place, rng.choice(["user", "assistant", "system", "tool", "", None, "umpire", "user", "assistant"]), rng.choice(texts)))
    rows += rows[:7]
    table = table_of(spark, rows)
    assert sorted((tuple(r) for r in repair_report(table).collect()), key=repr) == brute(rows)


def test_conversations_without_rows_extra_columns_and_an_empty_table(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    table = table_of(spark, [(dropped, 0, "user", "Gone.")]).selectExpr("*", "1 as kind", "2 as audit", "'x' as signature", "3 as state")
    row = repair_report(table).collect()[0]
    assert tuple(row) == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair_report(table.limit(0)).collect() == []


def test_repaired_rows_follow_the_grammar(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "tool", "Hello."), (1, 2, "assistant", "Yes"), (1, 3, "user", "Yes."), (2, 0, "assistant", "Hi.")]
    table = table_of(spark, rows)
    found = reports(table)
    assert {r.conv_id: (r.cost, r.audit) for r in found.collect()} == {1: (9, "KRKKI"), 2: (3, "IK")}
    got = [tuple(r) for r in repaired_rows(table, found).orderBy("conv_id", "place").collect()]
    assert got == [
        (1, 0, "K", 0, "system", "Be kind."), (1, 1, "R", 1, "user", "Hello."), (1, 2, "K", 2, "assistant", "Yes"),
        (1, 3, "K", 3, "user", "Yes."), (1, 4, "I", None, "assistant", ""), (2, 0, "I", None, "user", ""), (2, 1, "K", 0, "assistant", "Hi.")]


def test_a_long_conversation(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"Turn {i}.") for i in range(60_000)]
    row = reports(table_of(spark, rows)).collect()[0]
    assert (row.cost, row.audit) == (0, "K" * 60_000)


@pytest.mark.parametrize("name", ENTRIES)
def test_query_equals_sql(spark, name):
    query, sql = ENTRIES[name]
    assert compare(spark, connect(SF), name, query, sql, SF) == ""
