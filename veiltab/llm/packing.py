"""Best-two-fit packing of documents into sequences of bounded length.

A piece's length is all that packing looks at, so the corpus is packed as a count of pieces per length: at most ``limit``
numbers, however many documents there are. The plan over these counts fills a sequence greedily with the longest
piece that fits, then replaces its shortest piece by two unpacked pieces that fit the widened gap more tightly, and
repeats that sequence as often as the counts allow. Pieces of a length are numbered (a count per task and length gives each
task its first number), and a piece finds its sequence and offset from its number alone. No text or id is shuffled for it.

Defined results: a null text is an empty text; an empty text is one piece holding the end id; a text longer than the limit is
cut from its end, so its first piece may be shorter; repeated rows are packed as often as they come; an empty table gives no
rows. Columns other than id and text are not read.
"""
from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veiltab.llm.common import sliced, small_batches, text_of, written
from veiltab.llm.tokens import KEPT_BYTES, encoder

LIMIT = 1024


def cut(docs: DataFrame, tokenizer: str, end_id: int, spaces: str = "prefix", limit: int = LIMIT, with_ids: bool = False, text: str = "text", id_col: str = "doc_id",
        kept_bytes: int = KEPT_BYTES) -> DataFrame:
    """Written table of pieces: ``part, nth`` (number among its task's pieces of that length), ``doc_id, piece, start, length, ids_crc32`` and, if asked, ``ids``."""
    extra = ", ids binary" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # a reused worker may hold what earlier stages read
        enc, end, part, seen = encoder(tokenizer, spaces, kept_bytes), np.asarray([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), Counter()
        for batch in sliced(batches, "text", 1 << 20):
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text").to_pylist())):
                ids += end
                total, at = len(ids) // 4, 0
                for piece in range(-(-total // limit)):
                    to = (total - 1) % limit + 1 if piece == 0 else at + limit
                    held = ids[4 * at: 4 * to]
                    rows.append((part, seen[to - at], doc_id, piece, at, to - at, zlib.crc32(held), *([held] if with_ids else [])))
                    seen[to - at] += 1
                    at = to
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    schema = pa.schema([("part", pa.int32()), ("nth", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()),
                        *([("ids", pa.binary())] if with_ids else [])])
    source = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), text_of(text).alias("text"))
    return written(source.mapInArrow(run, "part int, nth long, doc_id long, piece int, start long, length int, ids_crc32 long" + extra), "pieces")


def best_two_fit(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths of their pieces, how many such sequences)."""
    left, sizes, plan = dict(counts), sorted(x for x, n in counts.items() if n > 0), []
    while sizes:
        used, held, gap = Counter([sizes[-1]]), [sizes[-1]], limit - sizes[-1]
        while gap:
            k = bisect_right(sizes, gap) - 1
            while k >= 0 and left[sizes[k]] <= used[sizes[k]]:
                k -= 1
            if k < 0:
                break
            again = min(left[sizes[k]] - used[sizes[k]], gap // sizes[k])
            used[sizes[k]] += again
            held += [sizes[k]] * again
            gap -= again * sizes[k]
        if gap and len(held) > 1:
            pair = _tighter_pair(sizes, left, used, held[-1], gap + held[-1])
            if pair:
                used[held.pop()] -= 1
                used.update(pair)
                held += pair
        times = min(left[x] // n for x, n in used.items() if n)
        plan.append((tuple(held), times))
        for x, n in used.items():
            if n:
                left[x] -= n * times
                if not left[x]:
                    sizes.remove(x)
    return plan


def _tighter_pair(sizes: list[int], left: dict[int, int], used: Counter, smallest: int, room: int) -> list[int] | None:
    free = [x for x in sizes if x < room and left[x] > used[x]]
    best, found = smallest, None
    for i in range(len(free) - 1, -1, -1):
        a = free[i]
        if 2 * a <= best:
            break
        k = min(bisect_right(free, room - a) - 1, i)
        if k == i and left[a] - used[a] < 2:
            k -= 1
        if k >= 0 and a + free[k] > best:
            best, found = a + free[k], [a, free[k]]
            if best == room:
                break
    return found


def _slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: first numbers, first sequences, slots per sequence, where their offsets start, and the offsets."""
    taken, sequence, table = Counter(), 0, {}
    for held, times in plan:
        offsets: dict[int, list[int]] = {}
        at = 0
        for x in held:
            offsets.setdefault(x, []).append(at)
            at += x
        for x, places in offsets.items():
            rows = table.setdefault(x, ([], [], [], [], []))
            for column, value in zip(rows, (taken[x], sequence, len(places), len(rows[4]))):
                column.append(value)
            rows[4].extend(places)
            taken[x] += len(places) * times
        sequence += times
    return {x: tuple(np.asarray(c, np.int64) for c in rows) for x, rows in table.items()}


def place(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Add ``sequence_id, offset`` to a written table of pieces (:func:`cut`)."""
    spark = pieces.sparkSession
    per_part = written(pieces.groupBy("part", "length").agg(F.count("*").alias("_n")), "piece-counts")
    counts = {r.length: r.n for r in per_part.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `limit` rows
    slots = spark.sparkContext.broadcast(_slots(best_two_fit(counts, limit)))

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        lengths, numbers = length.to_numpy(), number.to_numpy()
        sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for x in np.unique(lengths):
            here = lengths == x
            first, first_sequence, each, where, offsets = slots.value[x]
            row = np.searchsorted(first, numbers[here], side="right") - 1
            inside = numbers[here] - first[row]
            sequence[here] = first_sequence[row] + inside // each[row]
            offset[here] = offsets[where[row] + inside % each[row]]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    before = F.sum("_n").over(Window.partitionBy("length").orderBy("part")) - F.col("_n")
    numbered = pieces.join(per_part.select("part", "length", before.alias("_before")), ["part", "length"])
    placed = numbered.withColumn("_slot", slot("length", F.col("_before") + F.col("nth")))
    return placed.select(*[c for c in pieces.columns if c not in ("part", "nth")], "_slot.sequence_id", "_slot.offset")


def sequences(placed: DataFrame) -> DataFrame:
    """``sequence_id, ids`` (little-endian unsigned 32-bit) of placed pieces that carry their ids; a group holds at most ``limit`` ids."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.aggregate(ordered, F.lit(b""), lambda held, p: F.concat(held, p["ids"])).alias("ids"))
