"""Held-out accuracy, fold discipline and awkward rows."""
import random
import zlib

from llm_fixtures import documents, empty

from veiltab.llm.quality import _rising, fit


def corpus(spark):
    rng = random.Random(2)
    vocab = ["".join(rng.choice("aeioulrstn") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(700):
        n, bad = rng.randrange(40, 200), i % 4 == 0
        ws = [rng.choice(vocab) for _ in range(n)]
        text = " ".join(w.upper() + "!!" for w in ws) if bad and i % 8 else (" ".join([ws[0]] * n) if bad else " ".join(ws).capitalize() + ".")
        docs.append((i, text))
        labels.append((i, int(not bad)))
    return spark.createDataFrame([*docs, (9000, None), (9001, ""), (9002, "x" * 300_000)], "doc_id long, text string"), spark.createDataFrame(
        [*labels, (None, 1), (9000, None), (3, 0), (5, 7)], "doc_id long, quality int"), dict(labels)


def test_held_out(spark):
    docs, labels, truth = corpus(spark)
    scored = {r.doc_id: r.score for r in fit(docs, labels).score(docs).collect()}
    assert len(scored) == 703 and all(0 <= s <= 1 for s in scored.values())
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    right = [(scored[i] >= 0.3) == bool(truth[i]) for i in held]
    assert len(held) > 100 and sum(right) >= 0.8 * len(held)
    plain = [r for i, r in zip(held, right) if i % 8]  # without the documents of one repeated word, of which there are few to learn from
    assert sum(plain) >= 0.95 * len(plain)
    # labels of held-out rows teach nothing
    flipped = spark.createDataFrame([(i, 1 - y if i in set(held) else y) for i, y in truth.items()], "doc_id long, quality int")
    clean = spark.createDataFrame(list(truth.items()), "doc_id long, quality int")
    assert fit(docs, flipped) == fit(docs, clean)


def test_awkward(spark):
    docs = documents(spark)
    none = fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in none.score(docs).collect()} == {0.5}
    one = fit(docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int"))
    assert {round(r.score, 6) for r in one.score(docs).collect()} <= {0.5, round(1.5 / 2, 6), round(2.5 / 3, 6)}
    few = fit(docs, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int"))
    out = few.score(docs, name="other")
    assert out.columns == [*docs.columns, "other"] and out.count() == docs.count()
    assert few.score(empty(spark)).count() == 0


def test_rising_curve():
    at, value = _rising([0.1, 0.2, 0.3, 0.4, 0.5], [0, 1, 0, 1, 1])
    assert list(at) == sorted(at) and list(value) == sorted(value) and 0 < value[0] < value[-1] < 1
