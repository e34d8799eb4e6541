import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from llm_fixtures import documents, empty, rows, words
from veiltab.llm import radix, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, target, longest=1, buckets=10_000, least=20, percent=10, seed="2024"):
    def feats(t):
        found = WORD.findall((t or "").translate(LOWER))
        return len(found), [crc32(" ".join(found[i:i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(found) - n + 1)]

    held = [(i, *feats(t)) for i, t in docs]
    s, t = Counter(b for *_, f in held for b in f), Counter(b for x in target for b in feats(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for i, n, f in held:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    inside = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = percent * len(inside) // 100
    return out, inside, drawn


def check(got, docs, target, **options):
    out, inside, drawn = brute(docs, target, **options)
    assert sorted((r[:4] for r in got), key=repr) == sorted(((r[0], *r[2:]) for r in out), key=repr)
    ranked = sorted((r for r in got if r[4] is not None), key=lambda r: r[4])
    assert [r[4] for r in ranked] == list(range(1, drawn + 1))
    assert [(r[0], r[3]) for r in ranked] == [(r[0], r[4]) for r in inside[:drawn]]


def test_against_brute_force(spark):
    target = [words(50, 3), words(60, 4) + " One TWO", None, ""]
    docs = [(r[0], r[1]) for r in rows()]
    frame = spark.createDataFrame([(t, "clash") for t in target], "text string, doc_id string")
    for options in ({}, {"longest": 3, "buckets": 97, "percent": 55, "least_words": 1, "seed": "x"}):
        got = [tuple(r) for r in resample.resample(documents(spark), frame, **options).select("doc_id", "n_features", "weight", "score", "rank").collect()]
        check(got, docs, target, **{("least" if k == "least_words" else k): v for k, v in options.items()})


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], "text string")
    assert resample.resample(empty(spark), nothing).collect() == []
    got = [tuple(r) for r in resample.resample(documents(spark), nothing).collect()]
    check(got, [(r[0], r[1]) for r in rows()], [])
    only_short = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert [r.rank for r in resample.resample(only_short, only_short).collect()] == [None, None]


def test_words_match_the_pattern():
    texts = ["Ünï çödé 漢字🙂 A_b-C9\x7f\x00x", "a" * 100_000, "\u0085  é", "İK ß"]
    for t in texts:
        assert [w.decode() for w in resample.words_of(t)] == WORD.findall(t.translate(LOWER))


def test_radix_ranks(spark, monkeypatch):
    monkeypatch.setattr(radix, "BLOCK_BITS", (3, 4))  # many small blocks
    rnd = random.Random(5)
    cases = {
        "hot": [(7 if i % 3 == 0 else rnd.randrange(-1000, 1000), rnd.randrange(50) if i % 7 else None) for i in range(700)],
        "wide": [(rnd.choice([-2**63, 2**63 - 1, 0, rnd.getrandbits(62)]), rnd.getrandbits(40)) for _ in range(300)],
        "alike": [(1, 1)] * 100,
        "nulls": [(None, None)] * 20 + [(3, None), (None, 3)],
        "one": [(5, 6)],
    }
    for name, held in cases.items():
        df = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(held)], "a long, b long, _pos int").repartition(5)
        got = [(r.row.a, r.row.b, r["rank"], r.row._pos) for r in radix.radix_rank(df, [F.col("a"), F.col("b")]).collect()]
        assert sorted(r[2] for r in got) == list(range(1, len(held) + 1)), name
        key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0)
        assert [r[:2] for r in sorted(got, key=lambda r: r[2])] == sorted(held, key=key), name
        assert sorted(r[3] for r in got) == list(range(len(held))), name
    assert radix.radix_rank(spark.createDataFrame([], "a long"), [F.col("a")]).collect() == []


def test_passes_and_destinations():
    assert radix.passes_for([0, 0]) == [] and radix.passes_for([1, 2047]) == [(1, 0, 11), (0, 0, 1)]
    assert radix.passes_for([1 << 20, 5]) == [(1, 0, 3), (0, 0, 11), (0, 11, 11)]
    assert radix.destinations(np.array([2, 0, 2, 1], np.int32), {0: 10, 1: 20, 2: 30}).tolist() == [30, 10, 31, 20]
