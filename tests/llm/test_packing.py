"""Packing: every piece once, gapless, near the lower bound."""
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public = pytest.importorskip("public_tokenizers")
from llm_fixtures import documents, empty, rows  # noqa: E402

from veiltab.llm.packing import best_two_fit, cut, place, sequences  # noqa: E402
from veiltab.llm.tokens import UnitEncoder  # noqa: E402

FILE = public.path("byte_bpe_50k.json")


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plan_uses_every_piece(counts):
    plan = best_two_fit(counts, 64)
    used = Counter()
    for held, times in plan:
        assert sum(held) <= 64 and times > 0
        for x in held:
            used[x] += times
    assert dict(used) == counts
    n, total = sum(t for _, t in plan), sum(x * c for x, c in counts.items())
    assert n <= max(2 * -(-total // 64), 1 if counts else 0)


def test_two_fit_beats_greedy():
    # greedy: 60 + 30, gap 10; two pieces of 20 fill the 40 beside 60
    assert best_two_fit({60: 1, 30: 1, 20: 2}, 100)[0] == ((60, 20, 20), 1)


def test_round_trip(spark):
    docs = documents(spark)
    placed = place(cut(docs, FILE, 2, with_ids=True))
    enc, want = UnitEncoder(FILE, "prefix"), Counter()
    for r, ids in zip(rows(), enc.encode([r[1] or "" for r in rows()])):
        want[r[0], ids + np.asarray([2], "<u4").tobytes()] += 1
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    found = placed.collect()
    for r in found:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and r.length == len(r.ids) // 4 <= 1024
        by_sequence[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    for (doc_id, ids), n in want.items():
        total = len(ids) // 4
        for piece in range(-(-total // 1024)):
            start = 0 if piece == 0 else (total - 1) % 1024 + 1 + 1024 * (piece - 1)
            stop = (total - 1) % 1024 + 1 + 1024 * piece
            same = [r for r in by_doc[doc_id] if r.piece == piece and r.start == start and bytes(r.ids) == ids[4 * start:4 * stop]]
            assert len(same) >= n
    tokens = sum(r.length for r in found)
    assert len(by_sequence) <= 1.1 * tokens / 1024 + 2
    packed = {r.sequence_id: bytes(r.ids) for r in sequences(placed).collect()}
    assert packed == {s: b"".join(bytes(r.ids) for r in sorted(p, key=lambda r: r.offset)) for s, p in by_sequence.items()}


def test_empty(spark):
    assert place(cut(empty(spark), FILE, 2)).count() == 0
