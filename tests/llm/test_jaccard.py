"""Near-duplicates against all pairs."""
from collections import Counter

import numpy as np
import pytest
from llm_fixtures import documents, empty, rows, words

from veiltab.llm import jaccard
from veiltab.llm.jaccard import common, keep_one, least_matches, minhash, near_duplicates, shingles, surviving


def shingle_set(text):
    parts = (text or "").split()
    return {tuple(parts[k:k + 5]) for k in range(len(parts) - 4)} if len(parts) >= 5 else ({tuple(parts)} if parts else set())


def brute(texts, threshold=0.8):
    sets = [shingle_set(t) for t in texts]
    links = [set() for _ in sets]
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i].add(j)
                links[j].add(i)
    return links


def group_of(links):
    found = list(range(len(links)))
    for i in range(len(links)):
        stack, low = [i], set()
        while stack:
            x = stack.pop()
            if x not in low:
                low.add(x)
                stack += links[x]
        found[i] = low
    return found


def test_against_pairs(spark):
    data = rows()
    links = brute([r[1] for r in data])
    groups = group_of(links)
    want = Counter((r[0], min((data[k][0] for k in g if data[k][0] is not None), default=None) if links[n] else r[0], len(links[n])) for n, (r, g) in enumerate(zip(data, groups)))
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in near_duplicates(documents(spark)).collect())
    assert got == want


def chain(n):
    base = words(200, 5).split()
    out = []
    for k in range(n):
        base = base[:]
        base[(k * 37) % 200] = f"edit{k}"
        out.append(" ".join(base))
    return out


@pytest.mark.parametrize("block", [1024, 7])
def test_large_group_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard.in_block_pairs, "__defaults__", (block,))
    texts = chain(60) + [words(80, 1000 + k) for k in range(20)]
    links = brute(texts)
    got = {r.doc_id: r.n_links for r in near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: len(x) for i, x in enumerate(links)} and max(got.values()) > 5


def test_empty_and_keep(spark):
    assert near_duplicates(empty(spark)).count() == 0
    docs = documents(spark)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {0, 3, 63, 64, 65} <= ids and not {60, 61, 62} & ids


def test_one_of_each_group_stays_whatever_the_ids(spark):
    a, b, c = words(80, 1), words(80, 2), words(80, 3)
    rows = [(1, a), (5, a + " tail"), (5, b), (None, a + " end"), (None, c), (7, c), (None, words(80, 4)), (9, words(80, 5)), (9, words(80, 5) + " more"), (3, ""), (3, None)]
    kept = keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted(((r.doc_id, r.text) for r in kept), key=str)
    nine = [g for g in got if g[0] == 9]
    assert len(nine) == 1 and sorted([g for g in got if g[0] != 9], key=str) == sorted([(1, a), (5, b), (7, c), (None, words(80, 4)), (3, ""), (3, None)], key=str)


def test_low_thresholds_are_refused(spark):
    with pytest.raises(ValueError):
        near_duplicates(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 0.6)


def test_common_counts():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 120)).astype(np.uint64)) for _ in range(50)]
    left, right = np.triu_indices(50, 1)
    want = [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(left, right)]
    assert common(sets, left, right).tolist() == want and common(sets, right, left).tolist() == want
    assert common(sets, left[:9], right[:9]).tolist() == want[:9]


def test_pruning_keeps_similar_pairs():
    table = least_matches()
    kept = total = 0
    for k in range(150):
        a = words(300, k).split()
        b = a[:]
        for x in range(6):
            b[(x * 47 + k) % 300] = "new"
        sa, sb = shingles(" ".join(a)), shingles(" ".join(b))
        if len(np.intersect1d(sa, sb)) >= 0.8 * len(np.union1d(sa, sb)):
            total += 1
            ma, mb = (np.frombuffer(minhash(s), np.uint8)[None, :] for s in (sa, sb))
            kept += len(surviving(ma, mb, table, False)[0])
    assert total > 100 and kept == total
    far = [np.frombuffer(minhash(shingles(words(300, k))), np.uint8) for k in range(40)]
    assert len(surviving(np.array(far), np.array(far), table, True)[0]) == 0
