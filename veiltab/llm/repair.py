"""Conversation structure repair: cheapest edits that give every conversation the form ``(system? (user assistant)+)?``.

Messages are put in order of conversation and turn by a range partitioning, so a conversation that holds a third of
all rows lies in many partitions. A *piece* is what one partition holds of one conversation. The auction of
:mod:`lattice` runs on pieces. Only the first and the last conversation of a partition can go on elsewhere: for those pieces
the cost of every pair of entry and exit state is found first, and chained backwards into the prices at which a piece is
left and forwards into the state in which it is entered. That chain has at most two rows per partition.

Equal rows (conversation, turn, role and text) are counted before anything is ordered: all but the first of them are
duplicates, which must go, and going is the least letter, so they follow the first one's letter as that many D.

Defined results: a null role or text counts as one space; a null conversation id is a conversation; null turns stand
first; messages of one turn stand in order of role and text; an empty table gives no rows. A row's faults count in the
order blank, duplicate, truncated. Other columns are not read. The digest of a conversation hashes its text in order, which
no two tasks can share: pieces of one conversation pass one task, one piece in memory at a time.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veiltab.llm import lattice
from veiltab.llm.common import small_batches, written
from veiltab.llm.lattice import DELETE_COST, MUST_GO, OPEN_END, SOUND, STATES, TRUNCATED, initial

PIECE_ROWS = 50_000        # aimed messages of a partition
PIECE_BYTES = 32 << 20     # aimed text bytes of a partition
BATCH_BYTES = 4 << 20
BLANKS = " \t\n\x0b\x0c\r"
ENDINGS = (".", "!", "?")
LEGAL = {"su", "ua", "au"}
_COUNTS = "blank long, duplicate long, truncated long, illegal long, extra long"
PIECES = f"conv_id long, part int, turns array<long>, roles array<string>, texts array<string>, copies array<long>, initials string, kinds binary, {_COUNTS}"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def flagged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Distinct messages with ``copies`` and the flags ``is_blank, is_dup, is_cut`` of their first copy."""
    held = rows.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))])
    counted = held.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    core = F.rtrim(F.col("text"), F.lit(BLANKS))
    counted = counted.withColumn("is_blank", core == "").withColumn("is_cut", ~F.right(core, F.lit(1)).isin(*ENDINGS))
    # blank messages are not compared, so they are dealt out by turn
    alike = Window.partitionBy("conv_id", "role", "text", F.when(F.col("is_blank"), F.xxhash64("turn"))).orderBy(F.col("turn").asc_nulls_first())
    return counted.withColumn("is_dup", F.row_number().over(alike) > 1)


def pieces(rows: DataFrame, **columns: str) -> DataFrame:
    """Written table with one row per conversation and partition, see ``PIECES``."""
    spark = rows.sparkSession
    messages = written(flagged(rows, **columns), "messages")
    n, size = messages.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    parts = max(spark.sparkContext.defaultParallelism, n // PIECE_ROWS, (size or 0) // PIECE_BYTES)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    ordered = small_batches(messages).repartitionByRange(int(parts), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv, open_rows, out, held = TaskContext.get().partitionId(), None, [], [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if open_rows and row["conv_id"] != conv:
                    out.append(_piece(conv, part, open_rows))
                    open_rows = []
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, held = [], 0
                conv = row["conv_id"]
                open_rows.append(row)
                held += len(row["text"]) + 100
        if open_rows:
            out.append(_piece(conv, part, open_rows))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    longs, texts = pa.list_(pa.int64()), pa.list_(pa.string())
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("turns", longs), ("roles", texts), ("texts", texts), ("copies", longs), ("initials", pa.string()), ("kinds", pa.binary()),
                        *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "extra")]])
    return written(ordered.mapInArrow(run, PIECES), "pieces")


def _piece(conv: int | None, part: int, rows: list[dict]) -> dict:
    initials = "".join(initial(r["role"]) for r in rows)
    kinds = bytes(MUST_GO if r["is_blank"] or r["is_dup"] else TRUNCATED if r["is_cut"] else SOUND for r in rows)
    extra = sum(r["copies"] - 1 for r in rows)
    return {"conv_id": conv, "part": part, **{c: [r[n] for r in rows] for c, n in (("turns", "turn"), ("roles", "role"), ("texts", "text"), ("copies", "copies"))}, "initials": initials, "kinds": kinds,
            "blank": sum(r["copies"] for r in rows if r["is_blank"]), "truncated": sum(k == TRUNCATED for k in kinds),
            "duplicate": sum(r["copies"] - (not r["is_dup"]) for r in rows if not r["is_blank"]),
            "illegal": extra + sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), "extra": extra}


def _backwards(held: pd.DataFrame) -> pd.DataFrame:
    """Prices at which each piece of one conversation is left, from the entry-exit costs of the later ones."""
    ordered, rows, end = held.sort_values("part", ascending=False), [], list(OPEN_END)
    for k, (conv, part, costs) in enumerate(zip(ordered["conv_id"], ordered["part"], ordered["costs"])):
        rows.append((conv, part, end, k == 0, k == len(ordered) - 1))
        ways = [costs[STATES * s: STATES * (s + 1)] for s in range(STATES)]
        end = [int(w[0]) if k == 0 else min(int(c) + e for c, e in zip(w, end)) for w in ways]
    out = pd.DataFrame(rows, columns=["conv_id", "part", "end", "final", "first"])
    return out.assign(conv_id=out["conv_id"].astype("Int64"))


def _forwards(held: pd.DataFrame) -> pd.DataFrame:
    """State in which each piece of one conversation is entered."""
    rows, state = [], 0
    for conv, part, leaves in sorted(zip(held["conv_id"], held["part"], held["leaves"]), key=lambda r: r[1]):
        rows.append((conv, part, state))
        state = int(leaves[state if len(leaves) > 1 else 0])
    out = pd.DataFrame(rows, columns=["conv_id", "part", "entry"])
    return out.assign(conv_id=out["conv_id"].astype("Int64"))


def _entry_costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cost of every pair of entry and exit state; of the last piece, of ending (first of each four)."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            costs = [lattice.FAR] * STATES ** 2
            for leave in range(1 if row["last"] else STATES):
                end = OPEN_END if row["last"] else tuple(0 if s == leave else lattice.FAR for s in range(STATES))
                price = lattice.prices(row["initials"], row["kinds"], end, row["last"])
                costs[leave::STATES] = price[:STATES]
            out.append(min_far(costs))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("part"), pa.array(out, pa.list_(pa.int64()))], names=["conv_id", "part", "costs"])


def min_far(costs: list[int]) -> list[int]:
    return [min(c, lattice.FAR) for c in costs]


def _traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cost, letters, leaves = [], [], []
        for row in batch.select(["initials", "kinds", "end", "final", "first"]).to_pylist():
            end, final = tuple(row["end"]), row["final"]
            price = lattice.prices(row["initials"], row["kinds"], end, final)
            found = [lattice.trace(row["initials"], row["kinds"], price, s, end, final) for s in range(1 if row["first"] else STATES)]
            cost.append(price[0])
            letters.append([f[0] for f in found])
            leaves.append([f[1] for f in found])
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("part"), pa.array(cost, pa.int64()), pa.array(letters, pa.list_(pa.string())), pa.array(leaves, pa.list_(pa.int32()))],
                                         names=["conv_id", "part", "cost", "letters", "leaves"])


def edits(found: DataFrame) -> DataFrame:
    """``conv_id, part, cost, letters, entry`` of a written table of pieces: letters of its distinct messages."""
    alone = Window.partitionBy("conv_id")
    compact = found.select("conv_id", "part", "initials", "kinds", F.count("*").over(alone).alias("n"), F.max("part").over(alone).alias("_last"))
    split = compact.where("n > 1").withColumn("last", F.col("part") == F.col("_last")).select("conv_id", "part", "initials", "kinds", "last")
    costs = split.mapInArrow(_entry_costs, "conv_id long, part int, costs array<long>")
    ends = written(costs.groupBy("conv_id").applyInPandas(_backwards, "conv_id long, part int, end array<long>, final boolean, first boolean"), "piece-ends")
    joined = _with_piece(found.select("conv_id", "part", "initials", "kinds"), ends)
    whole = joined.select("conv_id", "part", "initials", "kinds", F.coalesce("end", F.array(*[F.lit(v).cast("long") for v in OPEN_END])).alias("end"),
                          F.coalesce("final", F.lit(True)).alias("final"), F.coalesce("first", F.lit(True)).alias("first"))
    traced = written(whole.mapInArrow(_traces, "conv_id long, part int, cost long, letters array<string>, leaves array<int>"), "piece-letters")
    several = _with_piece(ends.select("conv_id", "part"), traced, "inner", False)
    entries = written(several.groupBy("conv_id").applyInPandas(_forwards, "conv_id long, part int, entry int"), "piece-entries")
    chosen = _with_piece(traced, entries).withColumn("entry", F.coalesce("entry", F.lit(0)))
    return chosen.select("conv_id", "part", "cost", F.get("letters", F.when(F.size("letters") > 1, F.col("entry")).otherwise(0)).alias("letters"), "entry")


def _with_piece(left: DataFrame, right: DataFrame, how: str = "left", small: bool = True) -> DataFrame:
    """Join on conversation (nulls alike) and partition; a ``small`` right side has at most two rows per partition."""
    other = right.withColumnsRenamed({"conv_id": "_c", "part": "_p"})
    return left.join(F.broadcast(other) if small else other, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p")), how).drop("_c", "_p")


def repair(rows: DataFrame, **columns: str) -> DataFrame:
    """Pieces with their edits: ``PIECES`` and ``cost, letters, entry``."""
    found = pieces(rows, **columns)
    return _with_piece(found, edits(found), "inner", False)


def messages(repaired: DataFrame) -> DataFrame:
    """The repaired messages: ``conv_id, part, place`` (inside the piece), ``role, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out = [(row["conv_id"], row["part"], k, *m) for k, m in enumerate(lattice.apply(row["letters"], row["entry"], row["roles"], row["texts"]))]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()))],
                                                     names=["conv_id", "part", "place", "role", "text"])

    return small_batches(repaired).select("conv_id", "part", "letters", "entry", "roles", "texts").mapInArrow(run, "conv_id long, part int, place int, role string, text string")


def digest(repaired: DataFrame) -> DataFrame:
    """One row per conversation: ``gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``."""
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    schema = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in names[:6]], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if now is None or now.conv_id != row["conv_id"]:
                    if now:
                        done.append(now.row())
                    now = _Digest(row["conv_id"])
                now.add(row)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if now:
            yield pa.RecordBatch.from_pylist([now.row()], schema)

    ordered = small_batches(repaired).repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return ordered.mapInArrow(run, "conv_id long, " + ", ".join(f"{c} long" for c in names[:6]) + ", audit string, repaired_sha256 string")


class _Digest:
    """Running digest of one conversation, fed piece by piece."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.sums, self.cost, self.audit, self.sha, self.started = conv_id, [0, 0, 0, 0], None, [], hashlib.sha256(), False
        self.low = self.high = self.before = None
        self.distinct = 0

    def add(self, row: dict) -> None:
        for k, c in enumerate(("blank", "duplicate", "truncated", "illegal")):
            self.sums[k] += row[c]
        if self.before is not None:
            self.sums[3] += self.before + row["initials"][0] not in LEGAL
        self.before = row["initials"][-1]
        for t in row["turns"]:
            if t is not None and t != self.high:
                self.low, self.high, self.distinct = t if self.low is None else self.low, t, self.distinct + 1
        self.cost = (row["cost"] if self.cost is None else self.cost) + DELETE_COST * row["extra"]
        copies = iter(row["copies"])
        self.audit += [x if x == "I" else x + "D" * (next(copies) - 1) for x in row["letters"]]
        for role, text in lattice.apply(row["letters"], row["entry"], row["roles"], row["texts"]):
            self.sha.update(("\n" * self.started + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            self.started = True

    def row(self) -> dict:
        blank, duplicate, truncated, illegal = self.sums
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return {"conv_id": self.conv_id, "gaps": gaps, "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": illegal, "cost": self.cost, "audit": "".join(self.audit),
                "repaired_sha256": self.sha.hexdigest()}
