"""The whole pipeline on a small folder with awkward rows: every written stage against a plain version on that stage's input."""
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_fixtures import words

pytest.importorskip("public_tokenizers")
import corpus_pipeline as P  # noqa: E402


def shingle_set(text):
    parts = text.split()
    return {tuple(parts[k:k + 5]) for k in range(len(parts) - 4)} if len(parts) >= 5 else ({tuple(parts)} if parts else set())


def groups_of(rows):
    """Root of every row under links of similarity 0.8 or more."""
    sets, root = [shingle_set(r.text or "") for r in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j, both in Counter(j for x in s for j in holders[x] if j < i).items():
            if both >= 0.8 * (len(s) + len(sets[j]) - both):
                root[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(rows))]


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    some = docs.first().asDict()
    text = [words(90, 500 + k) for k in range(6)]
    awkward = [(10_000_001, text[0]), (10_000_002, text[0]), (10_000_003, text[0] + " tail"), (10_000_004, None), (10_000_005, ""), (10_000_006, words(4000, 77)),
               (10_000_007, text[1]), (10_000_007, text[2]), (10_000_008, text[1] + " more"), (10_000_009, "one"), (10_000_009, "one")]
    added = spark.createDataFrame([tuple({**some, "doc_id": i, "text": t, "source": None if i % 2 else "s0"}[c] for c in docs.columns) for i, t in awkward], docs.schema)
    docs.unionByName(added).coalesce(4).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    held, real = [spark.read.parquet(f"{folder}/documents.parquet")], P.written

    def keep(df, name):
        held.append(real(df, name))
        return held[-1]

    P.written = keep
    try:
        last = P.run(spark, folder)
    finally:
        P.written = real
    assert last is held[-1] and len(held) == 6
    assert all(d.columns == held[0].columns for d in held[:-1])
    return folder, [d.collect() for d in held]


def test_quality_drops_only_rows_below_the_threshold(spark, stages):
    folder, (docs, kept, *_) = stages
    before, after = Counter(docs), Counter(kept)
    assert not after - before and 0.3 * len(docs) < len(kept) < len(docs)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    gone = {r.doc_id for r in (before - after)}
    known = [r.doc_id for r in docs if r.doc_id in labels]
    right = sum((labels[i] == 1) == (i not in gone) for i in known)
    assert right >= 0.9 * len(known)


def test_one_of_equal_texts_stays(stages):
    _, (_, docs, kept, *_) = stages
    best = {}
    for r in docs:
        best[r.text or ""] = max(best.get(r.text or "", r.doc_id), r.doc_id)
    assert Counter((r.doc_id, r.text or "") for r in kept) == Counter((i, t) for t, i in best.items())


def test_one_of_each_near_group_stays(stages):
    _, (_, _, docs, kept, *_) = stages
    least = {}
    for r, g in zip(docs, groups_of(docs)):
        least.setdefault(g, []).append(r)
    want = Counter(min(rows, key=lambda r: r.doc_id) if (rows[0].text or "").split() else rows[0] for rows in least.values())
    assert Counter(kept) == want and len(kept) < len(docs)


def test_mix_takes_whole_documents_of_its_input(stages):
    _, (_, _, _, docs, mixed, _) = stages
    times = Counter(mixed)
    assert set(times) <= set(docs) and max(times.values()) <= 3
    size = lambda rows: sum(len((r.text or "").split()) for r in rows)
    longest = max(len((r.text or "").split()) for r in docs)
    sources = sorted({r.source for r in docs}, key=lambda s: (s is None, s or ""))
    sizes = {s: size(r for r in docs if r.source == s) for s in sources}
    weight = {s: k % 3 + 1 for k, s in enumerate(sources)}
    target, free = {}, set(sources)
    while True:
        left = sum(sizes.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            target.update(share)
            break
        target.update({s: 3 * sizes[s] for s in over})
        free -= over
    for s in sources:
        assert abs(size(r for r in mixed if r.source == s) - target[s]) <= 2 * longest


def test_all_drawn_documents_are_packed(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    _, (*_, mixed, packed) = stages
    library, want = Tokenizer.from_file(public_tokenizers.path(P.TOKENIZER)), Counter()
    for r in mixed:
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, P.END_ID]
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[r.doc_id, piece, a, b - a, zlib.crc32(np.asarray(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    places = {}
    for r in packed:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in places.values():
        held.sort()
        assert held[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(held, held[1:])) and sum(held[-1]) <= 1024
    assert len(places) <= 1.05 * -(-sum(r.length for r in packed) // 1024) + 1
