"""Exact copies against a dictionary, with tables so small that records spill over several levels."""
import hashlib
from collections import Counter, defaultdict

import pytest
from llm_fixtures import documents, empty, rows

from veiltab.llm.grace import ContentTable, keep_one, mark_copies


def brute():
    groups = defaultdict(list)
    for r in rows():
        groups[r[1] or ""].append(r[0])
    out = Counter()
    for text, ids in groups.items():
        keep = max(ids, key=lambda i: (i is not None, i))
        first = True
        for i in ids:
            kept = i == keep and first
            first = first and not kept
            out[i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("bounds", [{}, {"table_bytes": 3000, "bucket_bytes": 40_000}, {"table_bytes": 1, "bucket_bytes": 1 << 20}])
def test_copies(spark, bounds):
    got = Counter(tuple(r) for r in mark_copies(documents(spark), **bounds).collect())
    assert got == brute()


def test_keep_one(spark):
    docs = documents(spark)
    kept = keep_one(docs)
    texts = [r.text or "" for r in kept.collect()]
    assert kept.columns == docs.columns and len(texts) == len(set(texts)) == len({r[1] or "" for r in rows()})
    assert mark_copies(empty(spark)).count() == 0 and keep_one(empty(spark)).count() == 0


def test_table_compares_contents():
    table = ContentTable(1 << 20)
    for k in range(3000):  # one hash for all: only the contents tell them apart
        assert table.add(7, str(k % 1500).encode(), k, 1, 1)
    assert len(table.contents) == 1500 and set(table.counts) == {2}
