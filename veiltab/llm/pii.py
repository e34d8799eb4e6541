"""Personal data in whole texts: rules, and boosted trees over what generous patterns propose. DataFrame functions only.

Four rules give the base spans. Four more generous patterns (spaced or spelled-out e-mail addresses, dotted quads, digits in
fours, telephone numbers without a plus) propose spans that may overlap these. Gradient-boosted trees (MLlib) learn from format
and context which proposals look like base spans. No feature says whether the check holds or which pattern matched. A proposal
equal to a base span is an example, two in three of them respelled as the generous patterns allow. Counter-examples overlap no base span; most pass their kind's check as well: matches inside a
longer run of letters and digits, after an id word, across the end of a sentence, windows of longer numbers (``DECOYS``), and cards
and quads of the right shape whose check fails. Per kind, the lowest score at which held-out examples that pass the check reach
``PRECISION`` becomes the threshold (see ``thresholds_of`` for kinds with few); proposals above it that pass their kind's
check, are no counter-example and overlap nothing chosen are added.

Positions are code points. They come from the lengths of the matches and of what lies between them, summed in pieces, so a text with very
many matches takes linear time; the patterns can't backtrack over a long run.

The trees are fitted on every labelled proposal outside the held-out ones (a hash tells which), the thresholds come from every
held-out one. Examples of a kind and label share a weight of at most ``SHARE``, so a frequent kind doesn't drown a rare one. Scores
are compared in ten-thousandths: the held-out examples are counted per kind, score and label by Spark, and only these counts, whose
number does not grow with the table, are read by the driver. Without any counter-example there is nothing to learn and the base
spans stay alone. Defined results: a null text is an empty text, which
has no span; each row is judged on its own, so repeated rows give repeated results; an empty table gives no rows.
"""
from __future__ import annotations

import math
from functools import partial, reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veiltab.llm.common import text_of, written

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, written so that a run is entered at its start (or where the last match ended) and never left halfway.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENEROUS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20.-]?[0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+])(?:00|\+)?(?:[0-9]{1,3}[\x20.-])?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])",
}
#: Parts of longer numbers: never candidates, only counter-examples where they pass the check.
DECOYS = {
    "email": None,
    "ip": r"(?<=[0-9]\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{16}(?=[0-9]{4})",
    "phone": r"(?<![0-9+])[0-9]{10}(?=[0-9])",
}
#: Words just before a match.
WORDS = {
    "phone": r"(?i)(?:phone|tel|call|fax|mobile|cell|dial|text|sms|whatsapp|contact)[^\p{L}]*(?:\p{L}{1,3}[^\p{L}]*)?$",
    "card": r"(?i)(?:card|visa|master|amex|paid|pay|charge|credit|debit)[^\p{L}]*(?:\p{L}{1,4}[^\p{L}]*)?$",
    "email": r"(?i)(?:mail|write|contact|reach)[^\p{L}]*(?:\p{L}{1,3}[^\p{L}]*)?$",
    "ip": r"(?i)(?:ip|host|server|addr|address|login|from)[^\p{L}]*$",
    "id": r"(?i)(?:(?<!\p{L})(?:id|ref|order|invoice|sku|isbn|issn|serial|hash|sha[0-9-]*|md5|uuid|guid|commit|build|version|ticket|tracking)[\s:=#-]*|#)$",
}
#: Fixed value: a decimal number up to 255.
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
CONTEXT = 12
CHUNK = 256
SHARE = 2_500  # most weight of all training examples of a kind and label
SCORE_DIGITS = 4
PRECISION = 0.99
FEW = 50  # fewer held-out examples can't show the precision by themselves
FEATURES = ["f_kind", "f_digits", "f_groups", "f_other", "f_dots", "f_spaces", "f_parens", "f_before_alnum", "f_after_alnum", "f_before_joined", "f_after_joined",
            "f_before_space", "f_after_space", "f_before_letters", "f_after_letters", "f_before_digits", "f_after_digits", *[f"f_word_{w}" for w in WORDS]]


def _scan(values: Column, start: Column) -> Column:
    """Sums of all values before each, from ``start``."""
    zero = F.struct(start.cast("long").alias("sum"), F.array().cast("array<long>").alias("out"))
    return F.aggregate(values, zero, lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out")), lambda acc: acc["out"])


def _before(values: Column) -> Column:
    """Exclusive running sums in chunks: appending copies an array, so one chunk after the other keeps it linear."""
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(values) - 1) / CHUNK), F.lit(0)).cast("int")), lambda c: F.slice(values, c * CHUNK + 1, CHUNK))
    bound = lambda cs: F.flatten(F.zip_with(cs, _before_small(F.transform(cs, lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x))), _scan))
    return F.element_at(F.transform(F.array(chunks), bound), 1)


def _before_small(values: Column) -> Column:
    return _scan(values, F.lit(0))


def _matches(text: Column, pattern: str) -> Column:
    """``start, end, piece, before, after`` of each match of a pattern."""
    pair = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))

    def placed(p: Column) -> Column:
        pieces, gaps = p["m"], p["g"]
        steps = F.zip_with(pieces, F.slice(gaps, 1, F.size(pieces)), lambda m, g: (F.length(m) + F.length(g)).cast("long"))
        rows = F.transform(F.arrays_zip(_before(steps).alias("at"), pieces.alias("m"), F.slice(gaps, 1, F.size(pieces)).alias("g"), F.slice(gaps, 2, F.size(pieces)).alias("h")), lambda x: F.struct(
            (x["at"] + F.length(x["g"])).alias("start"), (x["at"] + F.length(x["g"]) + F.length(x["m"])).alias("end"), x["m"].alias("piece"),
            F.substring(x["g"], -CONTEXT, CONTEXT).alias("before"), F.substring(x["h"], 1, CONTEXT).alias("after")))
        return F.when(F.size(pieces) > 0, rows).otherwise(F.slice(F.transform(pieces, _nothing), 1, 0))

    return F.element_at(F.transform(F.array(pair), placed), 1)


def _nothing(piece: Column) -> Column:
    return F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), piece.alias("piece"), piece.alias("before"), piece.alias("after"))


def _digits(piece: Column) -> Column:
    return F.regexp_replace(piece, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    doubled = F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])
    places = F.sequence(F.lit(1), F.length(digits))
    value = lambda i: F.substr(F.reverse(digits), i, F.lit(1)).cast("int")
    return F.aggregate(places, F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, F.element_at(doubled, value(i) + 1)).otherwise(value(i))) % 10 == 0


def _passes(kind: str, piece: Column) -> Column:
    """The kind's check of a match."""
    if kind == "email":
        return piece.isNotNull()
    if kind == "ip":
        return piece.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    count = F.length(_digits(piece))
    if kind == "phone":
        return count.between(8, 15)
    return F.when(count.between(16, 19), _luhn(_digits(piece))).otherwise(False)


def _passing(kind: str, x: Column) -> Column:
    return _passes(kind, x["piece"])


def _span(k: int, x: Column) -> Column:
    return F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))


def _proposal(k: int, decoy: bool, x: Column) -> Column:
    return F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["piece"].alias("piece"), x["before"].alias("before"), x["after"].alias("after"),
                    _passes(KINDS[k], x["piece"]).alias("ok"), F.lit(decoy).alias("decoy"))


def find_spans(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Written table: ``row, doc_id, base`` (array of ``kind, start, end``) and ``proposed`` (with piece, contexts, check and whether it is a decoy)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text).alias("text")).withColumn("_some", F.col("text").rlike("[0-9@]|[(\\[]at[)\\]]"))
    base, proposed = [], []
    for k, kind in enumerate(KINDS):
        rows = rows.withColumn(f"b{k}", F.when(F.col("_some"), _matches(F.col("text"), BASE[kind]))).withColumn(f"g{k}", F.when(F.col("_some"), _matches(F.col("text"), GENEROUS[kind])))
        base.append(F.transform(F.filter(F.col(f"b{k}"), partial(_passing, kind)), partial(_span, k)))
        proposed += [F.transform(F.col(f"b{k}"), partial(_proposal, k, False)), F.transform(F.col(f"g{k}"), partial(_proposal, k, False))]
        if DECOYS[kind]:
            rows = rows.withColumn(f"d{k}", F.when(F.col("_some"), _matches(F.col("text"), DECOYS[kind])))
            proposed.append(F.transform(F.col(f"d{k}"), partial(_proposal, k, True)))
    none_base, none_more = "array<struct<kind:int,start:long,end:long>>", "array<struct<kind:int,start:long,end:long,piece:string,before:string,after:string,ok:boolean,decoy:boolean>>"
    return written(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(F.concat(*base), F.array().cast(none_base)).alias("base"),
                               F.coalesce(F.array_distinct(F.concat(*proposed)), F.array().cast(none_more)).alias("proposed")), "spans")


def _respelled(kind: Column, piece: Column, form: Column) -> Column:
    """Two examples in three in a spelling of the generous patterns: else the spelling alone would tell base spans from all others."""
    d = _digits(piece)
    last = F.right(d, F.lit(10))
    local = lambda sep: F.concat_ws(sep, F.substring(last, 1, 3), F.substring(last, 4, 3), F.substring(last, 7, 4))
    fours = F.concat_ws(".", *[F.substring(d, i, 4) for i in (1, 5, 9, 13)])
    spelled = [
        (kind == KINDS.index("email"), F.regexp_replace(piece, "@", " (at) "), F.regexp_replace(F.regexp_replace(piece, "@", " @ "), r"(?<=\x20.{0,255})\.", " . ")),
        ((kind == KINDS.index("card")) & (F.length(d) == 16), d, fours),
        ((kind == KINDS.index("phone")) & (F.length(d) >= 10), last, local("-"))]
    out = piece
    for which, one, two in spelled:
        out = F.when(which & (form == 1), one).when(which & (form == 2), two).otherwise(out)
    return out


def _proposals(found: DataFrame) -> DataFrame:
    """One row per proposal with features and, where the rules say so, a label."""
    p, count = F.col("p"), lambda c, what: F.regexp_count(c, F.lit(what)).cast("double")
    flag = lambda c: c.cast("double")
    each = found.where(F.size("proposed") > 0).select("row", "doc_id", "base", F.explode("proposed").alias("p"))
    equal = F.exists("base", lambda b: (b["kind"] == p["kind"]) & (b["start"] == p["start"]) & (b["end"] == p["end"]))
    touching = F.exists("base", lambda b: (b["start"] < p["end"]) & (p["start"] < b["end"]))
    piece, before, after = p["piece"], p["before"], p["after"]
    before_alnum, after_alnum = before.rlike("[A-Za-z0-9_]$"), after.rlike("^[A-Za-z0-9_]")
    before_joined, after_joined = before.rlike("[A-Za-z0-9][-./:=_]$"), after.rlike("^[-./:=_@][A-Za-z0-9]")
    worded = {w: before.rlike(x) for w, x in WORDS.items()}
    email, digits = p["kind"] == KINDS.index("email"), F.length(_digits(piece))
    inside = F.when(email, piece.rlike(r"[A-Za-z0-9]\.\x20") | before_joined | after.rlike("^[/@:]")).otherwise(
        before_alnum | after_alnum | before_joined | after_joined | (worded["id"] & ~worded["phone"] & ~worded["card"]))
    # The check of a number's length says nothing that the features don't, so only matches of the right shape count as failing.
    shaped = ((p["kind"] == KINDS.index("card")) & digits.between(16, 19)) | ((p["kind"] == KINDS.index("ip")) & piece.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"))
    label = F.when(equal & ~p["decoy"], 1.0).when(~touching & F.when(p["ok"], p["decoy"] | inside).otherwise(shaped & ~p["decoy"]), 0.0)
    spelled = F.when(equal & ~p["decoy"], _respelled(p["kind"], piece, F.pmod(F.xxhash64("row", p["start"]), F.lit(3)))).otherwise(piece)
    core = F.regexp_replace(spelled, r"^(?:\+|00)", "")  # base numbers have a plus, others may not
    features = [flag(p["kind"]), count(core, "[0-9]"), count(core, "[0-9]+"), count(core, "[^A-Za-z0-9]"), count(core, r"\."), count(core, " "), count(core, r"[()\[\]]"),
                *[flag(x) for x in (before_alnum, after_alnum, before_joined, after_joined)], flag(before.rlike(r"(^|\s)$")), flag(after.rlike(r"^(\s|$)")),
                count(before, r"\p{L}"), count(after, r"\p{L}"), count(before, "[0-9]"), count(after, "[0-9]"), *[flag(x) for x in worded.values()]]
    return each.select("row", "doc_id", p["kind"].alias("kind"), p["start"].alias("start"), p["end"].alias("end"), p["ok"].alias("ok"), p["decoy"].alias("decoy"), touching.alias("touching"), label.alias("label"),
                       *[f.cast("double").alias(n) for f, n in zip(features, FEATURES)])


def examples(proposals: DataFrame) -> DataFrame:
    """Written table of every labelled proposal; ``_h`` tells which are held out, ``weight`` shares out ``SHARE`` among a kind and label."""
    hashed = written(proposals.where("label is not null").withColumn("_h", F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), "start", *[F.col(f).cast("string") for f in FEATURES]))), "pii-train")
    found = hashed.groupBy("kind", "label").agg(F.count("*").alias("n")).collect()  # eight rows at most
    weights = [F.when((F.col("kind") == r.kind) & (F.col("label") == r.label), min(SHARE / r.n, 1.0)) for r in found]
    return hashed.withColumn("weight", F.coalesce(*weights, F.lit(1.0)))


def thresholds_of(held: list[tuple]) -> dict[int, float]:
    """Threshold of every kind from held-out ``(kind, score, label, weight)`` that pass the check; the weight is how many there are.

    Half-way between the lowest score at which the share of examples at or above it reaches ``PRECISION`` and the next one below. A kind of fewer than ``FEW`` takes the
    threshold of all kinds together, and more if one of its own counter-examples scores higher. No threshold is below 0.5.
    """
    def lowest(rows: list[tuple], doubt: float) -> float | None:
        good = every = 0.0
        best, rows = None, sorted(rows, key=lambda r: -r[1])
        for i, (_, score, label, weight) in enumerate(rows):
            good, every = good + label * weight, every + weight
            if (i + 1 == len(rows) or rows[i + 1][1] < score) and good / (every + doubt) >= PRECISION:
                best = (score + (rows[i + 1][1] if i + 1 < len(rows) else 0.0)) / 2
        return best

    def over(rows: list[tuple]) -> float:
        return max([math.nextafter(r[1], 2.0) for r in rows if not r[2]], default=0.5)

    pooled = lowest(held, 0.0)
    pooled = over(held) if pooled is None else pooled
    out = {}
    for k in range(len(KINDS)):
        own = [r for r in held if r[0] == k]
        t = lowest(own, 0.5) if sum(r[3] for r in own) >= FEW else max(pooled, over(own))
        out[k] = 2.0 if t is None else max(t, 0.5)
    return out


def fit_trees(proposals: DataFrame):
    """(model, thresholds by kind), or None if the examples are all of one kind of label."""
    every = examples(proposals)
    train, held = every.where(F.substring("_h", 1, 1) < "b"), every.where((F.substring("_h", 1, 1) >= "b") & F.col("ok"))
    if train.select("label").distinct().count() < 2:
        return None
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    model = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=12, maxDepth=4, maxBins=32, seed=5).fit(assembler.transform(train))
    counts = _scored(held, model).groupBy("kind", "score", "label").agg(F.count("*").cast("double").alias("n"))
    return model, thresholds_of([(r.kind, r.score, r.label, r.n) for r in counts.collect()])  # at most 4 kinds x 10,001 scores x 2 labels


def _scored(proposals: DataFrame, model) -> DataFrame:
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(proposals)
    return model.transform(ready).withColumn("score", F.round(vector_to_array("probability")[1], SCORE_DIGITS)).drop("features", "rawPrediction", "probability", "prediction")


def _apart(spans: Column) -> Column:
    """Greedy choice, best first, of spans that don't overlap a chosen one."""
    kind = "array<struct<away:double,kind:int,start:long,end:long>>"
    step = lambda acc, x: F.when(F.exists(acc, lambda a: (a["start"] < x["end"]) & (x["start"] < a["end"])), acc).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(spans, F.array().cast(kind), step)


def redactions(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, base, spans``, arrays of ``kind, start, end`` in order of kind and start."""
    found = find_spans(docs, text, id_col)
    proposals = _proposals(found)
    fitted = fit_trees(proposals)
    order = lambda c: F.array_sort(F.transform(c, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    if not fitted:
        return found.select("doc_id", order(F.col("base")).alias("base"), order(F.col("base")).alias("spans"))
    model, thresholds = fitted
    threshold = F.coalesce(*[F.when(F.col("kind") == k, F.lit(t)) for k, t in thresholds.items()])
    more = _scored(proposals.where("ok and label is null and not touching and not decoy"), model).where(F.col("score") >= threshold)
    added = more.groupBy("row").agg(_apart(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("away"), "kind", "start", "end")))).alias("added"))
    joined = found.select("row", "doc_id", "base").join(added, "row", "left")
    extra = F.coalesce(order(F.col("added")), F.array().cast("array<struct<kind:int,start:long,end:long>>"))
    return joined.select("doc_id", order(F.col("base")).alias("base"), order(F.concat("base", extra)).alias("spans"))


def joined_text(spans: Column) -> Column:
    """``kind:start:end`` with commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(spans: Column, text: Column) -> Column:
    """The text with every span replaced by its kind in brackets; spans inside an earlier one are covered by it."""
    names = F.array(*[F.lit(k) for k in KINDS])
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    between = lambda a, b: F.substr(text, a + 1, b - a)
    step = lambda acc, s: F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(
        F.struct(s["end"].alias("at"), F.concat(acc["out"], between(acc["at"], s["start"]), F.lit("["), F.element_at(names, s["kind"] + 1), F.lit("]")).alias("out")))
    return F.aggregate(by_start, zero, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
