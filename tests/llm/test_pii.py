"""Base spans against Python's regular expressions; what the trees add and never remove."""
import hashlib
import random
import re
from collections import Counter

from llm_fixtures import documents, empty
from pyspark.sql import functions as F

from veiltab.llm.pii import FEATURES, KINDS, _proposals, examples, find_spans, joined_text, redact, redactions, thresholds_of
from veiltab.llm.q_pii import op5_pii_boosting

#: The contract's base patterns as they are stated.
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
            "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(text):
    out = []
    for kind in KINDS:
        for m in re.finditer(PATTERNS[kind], text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 16 <= len(digits) <= 19 and luhn(digits),
                    "phone": lambda: 8 <= len(digits) <= 15}[kind]()
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def texts():
    rng = random.Random(4)
    parts = ["a.b@c-d.org", "x@y", "@", "a@b.c_d@e.f", "1.2.3.4", "10.0.0.1", "00.000.0.255", "256.1.1.1", "0001.02.3.4.5.6.7.8", "4111 1111 1111 1111", "4111111111111111", "4111111111111112", "+1 (988) 555-2485",
             "+12", "+123-4567-8", "é", "🙂", " ", "\n", ".", "-", "7", "word", "tel", "1" * 25, "(at)", "bob [at] mail dot com", "bob (at) mail.com", "555-123-4567", "%", "+"]
    made = ["".join(rng.choice(parts) + rng.choice(["", " ", ","]) for _ in range(rng.randrange(1, 14))) for _ in range(200)]
    return [*made, "a" * 100_000, "1" * 50_000, "a@" + "b." * 5_000 + "c", "+" + "(" * 20_000, "x@y.zz " * 1500, None, ""]


def test_base_spans(spark):
    rows = list(enumerate(texts()))
    found = redactions(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: (r.base, r.spans) for r in found.select("doc_id", joined_text(F.col("base")).alias("base"), joined_text(F.col("spans")).alias("spans")).collect()}
    for i, text in rows:
        base, spans = got[i]
        assert base == brute(text or ""), repr((text or "")[:200])
        every = spans.split(",")
        assert not base or set(base.split(",")) <= set(every)
        order = [(KINDS.index(k), int(a)) for k, a, _ in (s.split(":") for s in every if s)]
        assert order == sorted(order)


def test_trees_add_what_the_rules_miss(spark):
    rng, rows = random.Random(9), []
    for i in range(300):
        n = [rng.randrange(10) for _ in range(15)]
        check = next(c for c in "0123456789" if luhn("".join(map(str, n)) + c))
        card = "".join(map(str, n)) + check
        broken = "".join(map(str, n)) + str((int(check) + 3) % 10)
        rows.append((i, f"she paid with {card if i % 3 else broken} from {'10.0.%d.7' % (i % 200) if i % 2 else '300.%d.0.7' % (i % 200)} on monday"))
    rows.append((1000, "order 77 4111111111111111 88 again"))  # the base pattern swallows the neighbours and drops it
    got = {r.doc_id: r.s for r in redactions(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", joined_text(F.col("spans")).alias("s")).collect()}
    assert got[1000] == "card:9:25"
    assert [(got[i], t) for i, t in rows[:-1] if got[i] != brute(t)] == []


def test_rows_and_redaction(spark):
    docs = documents(spark)
    assert Counter(r.doc_id for r in redactions(docs).collect()) == Counter(r.doc_id for r in docs.collect())
    assert redactions(empty(spark)).count() == 0 and find_spans(empty(spark)).count() == 0
    one = spark.createDataFrame([(1, "é 🙂 a.b@c.de and +1 (988) 555-2485.")], "doc_id long, text string")
    spans = redactions(one).join(one, "doc_id")
    assert spans.select(redact(F.col("spans"), F.col("text")).alias("t")).first().t == "é 🙂 [email] and [phone]."


def spans_of(spark, rows):
    found = redactions(spark.createDataFrame(rows, "doc_id long, text string"))
    return {r.doc_id: r.s for r in found.select("doc_id", joined_text(F.col("spans")).alias("s")).collect()}


def number(rng, n):
    return "".join(str(rng.randrange(10)) for _ in range(n))


def broken_card(rng):
    while True:
        card = number(rng, 16)
        if not luhn(card):
            return card


def hex_run(rng):
    """A digest with a run of ten digits that the generous telephone pattern takes."""
    return "ede43f42c939b" + number(rng, 10) + "e" + "".join(rng.choice("abcdef0123456789") for _ in range(9)) + "f"


def test_digests_give_no_phone_and_bare_numbers_do(spark):
    rng, rows = random.Random(3), []
    for i in range(400):
        rows.append((i, f"please call +1 ({number(rng, 3)}) {number(rng, 3)}-{number(rng, 4)} before noon"))
        rows.append((1000 + i, f"the file {hex_run(rng)} was checked"))
        rows.append((2000 + i, f"order {number(rng, 10)} was shipped"))
    rows += [(5000, "the file ede43f42c939b6405768150e041159052 was checked"), (5001, "please call 555-123-4567 before noon"), (5002, "order 5551234567 was shipped")]
    got = spans_of(spark, rows)
    assert got[5000] == "" and got[5002] == ""
    assert got[5001] == "phone:12:24"
    assert [i for i, t in rows if i < 3000 and got[i] != brute(t)] == []


def test_no_feature_gives_the_label_away(spark):
    rng, rows = random.Random(5), []
    for i in range(200):
        rows.append((i, f"call +1 ({number(rng, 3)}) {number(rng, 3)}-{number(rng, 4)} or use card {broken_card(rng)}"))
        rows.append((1000 + i, f"the file {hex_run(rng)} has {number(rng, 24)} bytes, see 300.{i % 200}.0.7.1 and mail @ noon. bye"))
    labelled = _proposals(find_spans(spark.createDataFrame(rows, "doc_id long, text string"))).where("label = 0")
    passing = {KINDS[r.kind] for r in labelled.where("ok").select("kind").distinct().collect()}
    assert passing == set(KINDS)
    assert "f_checks" not in FEATURES and "f_plus" not in FEATURES


def test_rare_kind_beside_many_failing_cards(spark):
    rng = random.Random(6)
    rows = [(i, " ; ".join(broken_card(rng) for _ in range(50))) for i in range(1000)]
    rows += [(2000 + i, f"please write to ann{i}@mail{i % 7}.org today") for i in range(60)]
    rows.append((5000, "please write to bob (at) mail.com today"))
    assert spans_of(spark, rows)[5000] == "email:16:33"


def test_thresholds_are_defined_for_few_examples():
    many = [(0, 0.9, 1.0, 1.0)] * 200 + [(0, 0.7, 0.0, 1.0)] * 200
    assert thresholds_of([]) == {k: 0.5 for k in range(4)}
    assert abs(thresholds_of([*many, (3, 0.8, 1.0, 1.0)])[3] - 0.75) < 1e-9  # all kinds together
    assert thresholds_of([*many, (3, 0.95, 0.0, 1.0)])[3] > 0.95  # above its own counter-example
    assert abs(thresholds_of([(1, 0.9, 1.0, 1.0)] * 60 + [(1, 0.8, 0.0, 50.0)] + [(1, 0.7, 1.0, 1.0)] * 60)[1] - 0.85) < 1e-9  # weights count


def test_counts_are_those_of_base_spans(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, " ; ".join(broken_card(rng) for _ in range(20))) for i in range(300)]
    rows += [(2000 + i, f"please write to ann{i}@mail{i % 7}.org today") for i in range(60)]
    rows.append((5000, "please write to bob (at) mail.com today, or to eve@mail.com, or call +1 (988) 555-2485"))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op5_pii_boosting(spark, str(tmp_path)).collect()}
    one = got[5000]
    assert len(one.spans.split(",")) == 3 and one.spans.startswith("email:16:33,")  # one more than the rules find
    assert (one.n_email, one.n_ip, one.n_card, one.n_phone) == (1, 0, 0, 1) and one.base_sha256 == hashlib.sha256(brute(rows[-1][1]).encode()).hexdigest()
    for i, text in rows:
        kinds = [s.split(":")[0] for s in brute(text).split(",") if s]
        assert [got[i][f"n_{kind}"] for kind in KINDS] == [kinds.count(kind) for kind in KINDS]


def test_every_labelled_proposal_is_an_example(spark):
    rng = random.Random(8)
    rows = [(i, " ; ".join(broken_card(rng) for _ in range(50))) for i in range(80)]
    proposals = _proposals(find_spans(spark.createDataFrame(rows, "doc_id long, text string")))
    table = examples(proposals)
    n = proposals.where("label is not null").count()
    assert n > 2_500 and table.count() == n
    assert table.where("kind = 2 and label = 0").agg(F.sum("weight")).first()[0] <= 2_500.001
