"""Ids by units equal the library's ids of whole texts."""
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public = pytest.importorskip("public_tokenizers")
from veiltab.llm.tokens import UnitEncoder  # noqa: E402

FILES = [("word_bpe_49k.json", "drop"), ("byte_bpe_50k.json", "prefix")]
ENCODERS = {f: UnitEncoder(public.path(f), s) for f, s in FILES}
PIECE = st.sampled_from(["a", "The", "word", "été", "don't", "'s", "'", "x's", " ", "  ", "\n", "\n\n", "\t", ".", ",", "!!", "42", "<|endoftext|>", "<|", "́", "H̱", "İ",
                         "Σ", " ", " ", "\x1c", "\x1f", "漢字", "🙂", "&&&", "-", "_", "ﬁ", "é", "3.14", "ᾳ", "ʰ", "²", "\u0958", "\u0344", "\xa0", "\u2003", "\r\n"])


@pytest.mark.parametrize("file", [f for f, _ in FILES])
@settings(max_examples=2500, deadline=None)
@given(texts=st.lists(st.lists(PIECE, max_size=12).map("".join), min_size=1, max_size=4))
def test_units_equal_whole(file, texts):
    enc = ENCODERS[file]
    want = [list(enc.library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in enc.encode(texts)] == want


@pytest.mark.parametrize("file", [f for f, _ in FILES])
def test_documents(file, spark, sf):
    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    enc = ENCODERS[file]
    want = [list(x.ids) for x in enc.library.encode_batch(texts, add_special_tokens=False)]
    assert [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in enc.encode(texts)] == want


@pytest.mark.parametrize("file", [f for f, _ in FILES])
def test_long_texts_are_worked_on_in_slices(file, monkeypatch):
    from veiltab.llm import tokens

    monkeypatch.setattr(tokens, "SLICE", 40)
    enc = UnitEncoder(public.path(file), dict(FILES)[file])
    texts = ["some plain words and\nmore of them, don't 3.14 'tis  two   spaces été " * 9, "x" * 300, "one two " * 30, "", "<|endoftext|> a b " * 8, "漢字 word other " * 20]
    want = [list(x.ids) for x in enc.library.encode_batch(texts, add_special_tokens=False)]
    assert [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in enc.encode(texts)] == want


def test_memory_of_the_dictionary_is_bounded():
    import hashlib
    import tracemalloc

    enc = UnitEncoder(public.path(FILES[0][0]), "drop")
    enc.kept = 1 << 20
    digests = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(12_000)]
    short, long = [d[:12] for d in digests], [(digests[i] * 47)[:3000] for i in range(300)]
    enc.encode(["warm up"])
    tracemalloc.start()
    for held in (digests, short, long):
        for at in range(0, len(held), 100):
            enc.encode([" ".join(held[at:at + 100])])
    size, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert size < 2.5 * enc.kept and enc.held <= enc.kept
    assert all(len(k) <= 32 for k in enc.known | enc.older) and len(enc.known) > 1000
