"""Bit-packed files: round trips and random access."""
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public = pytest.importorskip("public_tokenizers")
from llm_fixtures import documents, empty, rows  # noqa: E402

from veiltab.llm import packed  # noqa: E402
from veiltab.llm.tokens import UnitEncoder  # noqa: E402

FILE = public.path("word_bpe_49k.json")


@settings(max_examples=200, deadline=None)
@given(bits=st.integers(1, 32), n=st.integers(0, 400), data=st.data())
def test_bits(bits, n, data):
    ids = np.random.default_rng(n).integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
    payload = packed.pack(ids, bits)
    assert len(payload) == -(-n // 64) * bits * 8
    a = data.draw(st.integers(0, n))
    b = data.draw(st.integers(a, n))
    assert (packed.unpack(payload, bits, a, b) == ids[a:b]).all()


def test_files(spark, monkeypatch):
    monkeypatch.setattr(packed, "BLOCK_IDS", 500)
    path = packed.write_ids(documents(spark), FILE, 49_408, 1)
    enc = UnitEncoder(FILE, "drop")
    got = packed.read_documents(spark, path, lambda ids: (ids.astype("<u4").tobytes(),), "ids binary").orderBy("start").collect()
    data = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [r[0] for r in data]
    at = 0
    for r in got:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    want = sorted((r[0] if r[0] is not None else -1, enc.encode([r[1] or ""])[0] + b"\1\0\0\0") for r in data)
    assert sorted((r.doc_id if r.doc_id is not None else -1, bytes(r.ids)) for r in got) == want
    whole = np.frombuffer(b"".join(bytes(r.ids) for r in got), "<u4")
    for a, b in ((0, at), (3, 3), (490, 1700), (at - 5, at)):
        assert (packed.read_span(spark, path, a, b) == whole[a:b]).all()


def test_empty(spark):
    path = packed.write_ids(empty(spark), FILE, 49_408, 1)
    assert packed.read_documents(spark, path, lambda ids: (0,), "x long").count() == 0
    assert len(packed.read_span(spark, path, 0, 10)) == 0
