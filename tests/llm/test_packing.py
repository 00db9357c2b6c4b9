from __future__ import annotations

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from siteroster.llm.packing import WordIds, best_fit, default_tokenizer, pack_documents

ODD = ["", None, "one", "It's we'LL don't. 'tis x's.", "é. Éx, 12.5, 3.", "x-. y'. z.'", "a\x1cb c\xa0d.", "Σας ΣΑΣ.",
       "<|ENDOFTEXT|> a", "<|endoftext|>x. y", "ŉ … a…. b.…"]


def expected(text):
    ids = Tokenizer.from_file(default_tokenizer()).encode(text or "", add_special_tokens=False).ids + [1]
    return [(i, at, len(ids[at:at + 64]), zlib.crc32(np.array(ids[at:at + 64], "<u4").tobytes()))
            for i, at in enumerate(range(0, len(ids), 64))]


def test_word_ids_equal_the_tokenizer():
    coder, plain = WordIds(default_tokenizer()), Tokenizer.from_file(default_tokenizer())
    texts = [t or "" for t in ODD]
    for text, found in zip(texts, coder.of(texts)):
        assert np.frombuffer(found, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("block", [3, 50_000])
def test_pieces_and_gapless_sequences(documents, block):
    texts = [*ODD, *["word " * n for n in range(1, 150, 3)], "same text", "same text"]
    docs = documents([*enumerate(texts), (None, "no id")])
    rows = pack_documents(docs, capacity=64, block=block).collect()
    want = sorted((i, *p) for i, t in [*enumerate(texts), (-1, "no id")] for p in expected(t))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    if block > 3:
        assert len(by_sequence) <= 1 + sum(p[3] for p in want) / 64 * 1.05


def test_best_fit_takes_the_fullest_bin_with_room():
    assert sorted(sorted(b) for b in best_fit([60, 50, 40, 30, 10], 100)) == [[0, 2], [1, 3, 4]]


def test_empty_table(documents):
    assert pack_documents(documents([])).collect() == []
