"""Ranks of all rows under a composite integer key, by a distributed least-significant-digit radix sort.

Rows lie in blocks of bounded size. A pass takes one digit of the key: every block counts its digits, prefix sums over
(digit, block) give each block the first destination of each of its digits, and each block deals its rows to their
destinations by a stable counting sort. Destinations are dense, so the next pass' blocks are equal stretches of them,
whatever the keys: a value that a third of all rows share fills blocks like any other. After the pass over the highest
digit a row's destination is its place in the order. Only key ranges and the row count reach the driver; each pass is
written, so a lost executor costs one pass at most.

Digits are as wide as a block's counts allow (``DIGIT_BITS``), and a key has as many as its range needs.

Defined results: null keys stand after all others; rows equal in all keys take consecutive ranks in no defined order;
an empty table gives no rows. The caller's columns, whatever they are called, pass through in the struct ``row``.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veiltab.llm.common import written

DIGIT_BITS = 11               # at most 2,048 digits: the table of digit totals that one window sums
BLOCK_BITS = (10, 16)         # fewest and most bits of a block's size
BLOCKS_AIMED = 64             # smaller tables are cut into so many blocks


def block_bits(rows: int) -> int:
    return min(max((rows // BLOCKS_AIMED).bit_length(), BLOCK_BITS[0]), BLOCK_BITS[1])


def passes_for(spans: list[int]) -> list[tuple[int, int, int]]:
    """``(key, shift, bits)`` of each pass, least significant digit of the last key first."""
    found = []
    for key in reversed(range(len(spans))):
        bits = spans[key].bit_length()
        digits = -(-bits // DIGIT_BITS)
        width = -(-bits // digits) if digits else 0
        found += [(key, d * width, width) for d in range(digits)]
    return found


def digit_of(values: np.ndarray, shift: int, bits: int) -> np.ndarray:
    return ((values >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int32)


def destinations(digits: np.ndarray, first: dict[int, int]) -> np.ndarray:
    """Counting sort: place of each of a block's rows, in row order, from the first place of each digit."""
    order = np.argsort(digits, kind="stable")
    ordered = digits[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.empty(0, np.int64)
    sizes = np.diff(np.r_[starts, len(ordered)])
    bases = np.asarray([first[int(d)] for d in ordered[starts]], np.int64)
    out = np.empty(len(digits), np.int64)
    out[order] = np.repeat(bases - starts, sizes) + np.arange(len(ordered))
    return out


def radix_rank(rows: DataFrame, keys: list[Column], out: str = "rank") -> DataFrame:
    """``row`` (the caller's columns) and its 1-based rank by ``keys`` (long, ascending, nulls last; most significant first)."""
    names = [f"_k{i}" for i in range(len(keys))]
    raw = written(rows.select(F.struct("*").alias("row"), *[k.cast("long").alias(n) for k, n in zip(keys, names)], F.monotonically_increasing_id().alias("_pos")), "radix")
    seen = raw.agg(F.count("*").alias("n"), *[f(F.col(c)).alias(f"{p}{c}") for c in names for p, f in (("lo", F.min), ("hi", F.max), ("nn", F.count))]).first()
    if not seen["n"]:
        return raw.select("row", F.lit(0).cast("long").alias(out))
    lows, spans = [seen[f"lo{c}"] or 0 for c in names], []
    for c in names:  # a null counts as one above the largest
        spans.append((seen[f"hi{c}"] or 0) - (seen[f"lo{c}"] or 0) + (seen[f"nn{c}"] < seen["n"]))
    size = block_bits(seen["n"])
    placed = raw
    for key, shift, bits in passes_for(spans):
        placed = _one_pass(placed, names[key], lows[key], spans[key], shift, bits, size)
    return _dense(placed, out) if placed is raw else placed.select("row", (F.col("_pos") + 1).alias(out))


def _dense(raw: DataFrame, out: str) -> DataFrame:
    """All keys alike: places in any order, by counts of the written partitions."""
    return _one_pass(raw, "_k0", 0, 0, 0, 0, BLOCK_BITS[1]).select("row", (F.col("_pos") + 1).alias(out))


def _one_pass(placed: DataFrame, key: str, low: int, span: int, shift: int, bits: int, size: int) -> DataFrame:
    block = F.shiftright(F.col("_pos"), size).alias("_block")

    def digits(values: pa.ChunkedArray) -> np.ndarray:
        nulls = values.is_null().to_numpy(zero_copy_only=False)
        taken = values.fill_null(low).to_numpy().astype(np.int64).view(np.uint64) - np.array(low, np.int64).view(np.uint64)
        taken[nulls] = span
        return digit_of(taken, shift, bits) if bits else np.zeros(len(taken), np.int32)

    def counted(batches):
        for batch in batches:
            blocks = batch.column("_block").to_numpy()
            pairs, n = np.unique(np.stack([blocks, digits(pa.chunked_array([batch.column(key)]))]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1].astype(np.int32)), pa.array(n)], names=["_block", "_digit", "_n"])

    counts = placed.select(block, key).mapInArrow(counted, "_block long, _digit int, _n long").groupBy("_block", "_digit").agg(F.sum("_n").alias("_n"))
    counts = written(counts, "radix-counts")
    totals = counts.groupBy("_digit").agg(F.sum("_n").alias("_t"))  # one row a digit: at most 2 ** DIGIT_BITS
    bases = totals.select("_digit", (F.sum("_t").over(Window.orderBy("_digit")) - F.col("_t")).alias("_base"))
    before = F.sum("_n").over(Window.partitionBy("_digit").orderBy("_block")) - F.col("_n")
    firsts = counts.withColumn("_before", before).join(F.broadcast(bases), "_digit").select("_block", "_digit", (F.col("_base") + F.col("_before")).alias("_first"))

    def deal(held: pa.Table, first: pa.Table) -> pa.Table:
        held = held.take(pa.array(np.argsort(held.column("_pos").to_numpy(), kind="stable")))
        start = dict(zip(first.column("_digit").to_pylist(), first.column("_first").to_pylist()))
        to = destinations(digits(held.column(key)), start)
        return held.drop_columns(["_block"]).set_column(held.column_names.index("_pos"), "_pos", pa.array(to))

    with_block = placed.withColumn("_block", block)
    dealt = with_block.groupBy("_block").cogroup(firsts.groupBy("_block")).applyInArrow(deal, placed.schema)
    return written(dealt, "radix")
