"""Token-id files: fixed-width bit packing in blocks with offsets.

An id takes the fewest bits that hold the vocabulary. Sixty-four ids make a group of ``bits`` 64-bit little-endian
words, so every group starts at a word and a block unpacks with 64 vector operations, or any stretch of it alone.

A data set is a folder of Parquet files, written by Spark's own committer: a task lost half-way leaves nothing behind.
A row is a block of whole documents:

    shard int         range of the document order that one task wrote
    block int         number inside the shard
    first long        ids of the shard before the block
    n_ids long        ids in the block
    bits int          width
    doc_ids, ends     id of every document and the ids of the block up to its end
    payload binary    the packed ids

The index (``shard, first, n_ids``) is read without the payload; ``starts`` turns it into global offsets.

Defined results: a null text is an empty text (its end id only); documents stand in ascending id, nulls first, rows of
equal id in order of text hash and text; a text longer than a block makes a block of its own; an empty table gives an
empty data set. Columns other than id and text are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veiltab.llm.common import scratch_path, sliced, small_batches, text_of
from veiltab.llm.tokens import encoder

BLOCK_IDS = 1 << 17
SHARD_BYTES = 48 << 20  # aimed text bytes of a shard
BLOCKS = "shard int, block int, first long, n_ids long, bits int, doc_ids array<long>, ends array<int>, payload binary"


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Pack unsigned ids below 2 ** bits (bits <= 32); a wider id is an error, as it would spoil its neighbours."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} takes more than {bits} bits")
    return b"".join(_pack_groups(ids[at: at + BLOCK_IDS], bits) for at in range(0, len(ids), BLOCK_IDS))  # whole groups, so a long text needs no more room


def _pack_groups(ids: np.ndarray, bits: int) -> bytes:
    groups = -(-len(ids) // 64)
    padded = np.zeros(groups * 64, np.uint64)
    padded[: len(ids)] = ids
    table, words = padded.reshape(groups, 64), np.zeros((groups, bits), "<u8")
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        words[:, word] |= table[:, j] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= table[:, j] >> np.uint64(64 - shift)
    return words.tobytes()


def unpack(payload: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a payload; only their groups are read."""
    if stop <= start:
        return np.empty(0, np.uint32)
    g0, g1 = start // 64, -(-stop // 64)
    words = np.frombuffer(payload, "<u8", (g1 - g0) * bits, g0 * bits * 8).reshape(-1, bits)
    out, mask = np.empty((g1 - g0, 64), np.uint64), np.uint64((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | (words[:, word + 1] << np.uint64(64 - shift))
        out[:, j] = value & mask
    return out.reshape(-1)[start - g0 * 64: stop - g0 * 64].astype(np.uint32)


def write_ids(docs: DataFrame, tokenizer: str, vocabulary: int, end_id: int, spaces: str = "drop", path: str | None = None, text: str = "text", id_col: str = "doc_id") -> str:
    """Encode every text, add ``end_id``, write the packed data set and return its folder."""
    path = path or scratch_path(docs.sparkSession, "ids")
    bits, docs = bits_for(vocabulary), small_batches(docs)
    size = docs.agg(F.sum(F.octet_length(text_of(text)))).first()[0] or 0
    shards = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // SHARD_BYTES))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text).alias("text")).withColumn("_h", F.xxhash64("text"))
    ordered = rows.repartitionByRange(shards, "doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text").select("doc_id", "text")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # a reused worker may hold what earlier tasks read
        enc, end = encoder(tokenizer, spaces), np.asarray([end_id], "<u4").tobytes()
        shard, block, first, held, names, ends = TaskContext.get().partitionId(), 0, 0, bytearray(), [], []
        n = 0

        def closed() -> pa.RecordBatch:
            payload = pack(np.frombuffer(held, "<u4"), bits)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()), pa.array([n], pa.int64()), pa.array([bits], pa.int32()),
                 pa.array([names], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int32())), pa.array([payload], pa.binary())],
                names=["shard", "block", "first", "n_ids", "bits", "doc_ids", "ends", "payload"])

        for batch in sliced(batches, "text", 1 << 20):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text").to_pylist())):
                more = len(ids) // 4 + 1
                if n and n + more > BLOCK_IDS:
                    yield closed()
                    block, first, n, held, names, ends = block + 1, first + n, 0, bytearray(), [], []
                held += ids
                held += end
                n += more
                names.append(doc_id)
                ends.append(n)
        if n:
            yield closed()

    ordered.mapInArrow(blocks, BLOCKS).write.parquet(path)
    return path


def read_blocks(spark, path: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(path)


def shard_starts(spark, path: str) -> DataFrame:
    """``shard, start``: ids of all shards before; one row per shard, so one window over them is small."""
    totals = read_blocks(spark, path).groupBy("shard").agg(F.sum("n_ids").alias("_n"))
    return totals.select("shard", (F.sum("_n").over(Window.orderBy("shard")) - F.col("_n")).alias("start"))


def read_documents(spark, path: str, each, schema: str) -> DataFrame:
    """Unpack every block and give ``each(ids)`` of every document's ids, a tuple of values per document.

    Returns ``doc_id, start, n_tokens`` and the columns of ``schema``.
    """
    from pyspark.sql.types import StructType

    names = [f.name for f in StructType.fromDDL(schema).fields]

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["payload"], row["bits"], 0, row["n_ids"])
                starts = [0, *row["ends"][:-1]]
                values = [each(ids[a:b]) for a, b in zip(starts, row["ends"])]
                columns = {"shard": [row["shard"]] * len(starts), "doc_id": pa.array(row["doc_ids"], pa.int64()), "_at": [row["first"] + a for a in starts],
                           "n_tokens": [b - a for a, b in zip(starts, row["ends"])]}
                yield pa.RecordBatch.from_pydict(columns | {n: [v[k] for v in values] for k, n in enumerate(names)},
                                                 schema=pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("_at", pa.int64()), ("n_tokens", pa.int64()), *fields]))

    from pyspark.sql.pandas.types import to_arrow_schema

    fields = list(to_arrow_schema(StructType.fromDDL(schema)))
    stored = read_blocks(spark, path).mapInArrow(unpacked, f"shard int, doc_id long, _at long, n_tokens long, {schema}")
    return stored.join(F.broadcast(shard_starts(spark, path)), "shard").select("doc_id", (F.col("start") + F.col("_at")).alias("start"), "n_tokens", *names)


def read_span(spark, path: str, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of the whole data set: the index picks the blocks, only their groups are unpacked."""
    blocks = read_blocks(spark, path).join(F.broadcast(shard_starts(spark, path)), "shard").withColumn("at", F.col("start") + F.col("first"))
    hit = blocks.where((F.col("at") < stop) & (F.col("at") + F.col("n_ids") > start)).orderBy("at").select("at", "n_ids", "bits", "payload")
    parts = [unpack(r.payload, r.bits, max(0, start - r.at), min(r.n_ids, stop - r.at)) for r in hit.toLocalIterator()]
    return np.concatenate(parts) if parts else np.empty(0, np.uint32)
