"""Exact deduplication of whole texts by Grace hashing.

Records are dealt to buckets by a hash of their content; each bucket is loaded into an open-addressing table that
compares complete contents. A bucket whose distinct contents pass the table's bound keeps what it holds, and all records
of other contents go to spill files in the shared folder, which the next level deals again with another hash. Before the
first dealing every task combines the copies it has itself, so a content that a third of all rows share arrives as
one record per task.

Defined results: a null text is an empty text; equal means byte-for-byte equal; a null id is smaller than any id; rows
that repeat both id and text are one document given several times, of which exactly one is kept. An empty table gives
no rows. The caller's other columns, whatever their names, are not read by :func:`content_classes` and pass through
:func:`keep_one` unchanged.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veiltab.llm.common import BATCH_BYTES, attach, small_batches, text_of, written

TABLE_BYTES = 48 << 20   # distinct content one task's table may hold
BUCKET_BYTES = 24 << 20  # aimed size of a bucket
RECORD = "hash long, content binary, keep long, n long, n_keep long"
OUT = "sha256 string, content binary, hash long, keep long, n long, n_keep long"
_OUT = pa.schema([("sha256", pa.string()), ("content", pa.binary()), ("hash", pa.int64()), ("keep", pa.int64()), ("n", pa.int64()), ("n_keep", pa.int64())])


class ContentTable:
    """Open addressing with linear probing; a slot holds the number of an entry."""

    def __init__(self, limit: int):
        self.limit, self.held = limit, 0
        self.mask, self.slots = 1023, [-1] * 1024
        self.hashes, self.contents, self.keeps, self.counts, self.ties = [], [], [], [], []

    def add(self, h: int, content: bytes, keep: int | None, n: int, n_keep: int) -> bool:
        """Merge or insert a record; False if its content is new and the table is full."""
        at = h & self.mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == h and self.contents[entry] == content:
                self._merge(entry, keep, n, n_keep)
                return True
            at = (at + 1) & self.mask
        if self.contents and self.held + len(content) > self.limit:
            return False
        self.slots[at] = len(self.contents)
        self.held += len(content) + 200  # a record's own overhead counts, so short texts are bounded too
        for column, value in zip((self.hashes, self.contents, self.keeps, self.counts, self.ties), (h, content, keep, n, n_keep)):
            column.append(value)
        if 2 * len(self.contents) > self.mask:
            self._grow()
        return True

    def _merge(self, entry: int, keep: int | None, n: int, n_keep: int) -> None:
        old = self.keeps[entry]
        if keep == old:
            self.ties[entry] += n_keep
        elif old is None or (keep is not None and keep > old):
            self.keeps[entry], self.ties[entry] = keep, n_keep
        self.counts[entry] += n

    def _grow(self) -> None:
        self.mask = 4 * (self.mask + 1) - 1
        self.slots = [-1] * (self.mask + 1)
        for entry, h in enumerate(self.hashes):
            at = h & self.mask
            while self.slots[at] >= 0:
                at = (at + 1) & self.mask
            self.slots[at] = entry


def _table_pass(final: bool, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ContentTable(limit)
        out, size = [], 0

        def flush():
            nonlocal out, size
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), _OUT)], schema=_OUT)
            out, size = [], 0
            return batch

        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in ("hash", "content", "keep", "n", "n_keep")]
            for h, content, keep, n, n_keep in zip(*columns):
                if not table.add(h, content, keep, n, n_keep):
                    out.append((None, content, h, keep, n, n_keep))
                    size += len(content) + 64
                    if size > BATCH_BYTES:
                        yield flush()
        for h, content, keep, n, n_keep in zip(table.hashes, table.contents, table.keeps, table.counts, table.ties):
            out.append((hashlib.sha256(content).hexdigest(), None, h, keep, n, n_keep) if final else (None, content, h, keep, n, n_keep))
            size += 64 + (0 if final else len(content))
            if size > BATCH_BYTES:
                yield flush()
        if out:
            yield flush()

    return run


def content_classes(docs: DataFrame, text: str = "text", id_col: str = "doc_id", table_bytes: int = TABLE_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per distinct content: ``sha256, keep, n, n_keep`` (``n_keep``: rows with the id ``keep``)."""
    records = small_batches(docs).select(F.xxhash64(text_of(text)).alias("hash"), text_of(text).cast("binary").alias("content"), F.col(id_col).cast("long").alias("keep"),
                          F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("n_keep"))
    held = docs.agg(F.sum(F.octet_length(text_of(text)) + 64)).first()[0] or 0
    records = records.mapInArrow(_table_pass(False, table_bytes // 2), OUT).drop("sha256")
    done, level = [], 0
    while True:
        parts = max(1, math.ceil(held / bucket_bytes))
        dealt = records.repartition(parts, F.xxhash64(F.lit(level), F.col("hash")))
        spilled = written(dealt.mapInArrow(_table_pass(True, table_bytes), OUT), f"grace-{level}")
        done.append(spilled.where("sha256 is not null").select("sha256", "keep", "n", "n_keep"))
        held = spilled.where("sha256 is null").agg(F.sum(F.octet_length("content") + 64)).first()[0]
        if not held:
            break
        records, level = spilled.where("sha256 is null").drop("sha256"), level + 1
    classes = done[0]
    for more in done[1:]:
        classes = classes.unionByName(more)
    return classes


def mark_copies(docs: DataFrame, text: str = "text", id_col: str = "doc_id", **bounds) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    groups = _groups(docs, text, id_col, **bounds)
    rows = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(text_of(text).cast("binary"), 256).alias("text_sha256"))
            .groupBy("doc_id", "text_sha256").agg(F.count("*").alias("_same")))
    found = attach(rows, groups, ["text_sha256"], salt_by=F.col("doc_id"))
    in_group = F.col("group_size").isNotNull()
    return (found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_same")))).select(
        "doc_id", F.when(in_group, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        ((F.col("_copy") == 1) & (~in_group | F.col("doc_id").eqNullSafe(F.col("keep_id")))).alias("kept"), "text_sha256"))


def _groups(docs: DataFrame, text: str, id_col: str, **bounds) -> DataFrame:
    classes = content_classes(docs, text, id_col, **bounds).where("n > 1")
    if classes.groupBy("sha256").count().where("count > 1").limit(1).count():
        raise ValueError("two different texts share a SHA-256 digest; rows cannot be told apart by digest")
    return classes.select(F.col("sha256").alias("text_sha256"), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"))


def keep_one(docs: DataFrame, text: str = "text", id_col: str = "doc_id", **bounds) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns: of equal texts the one with the largest id."""
    digest, names = "_veiltab_digest", docs.columns
    groups = _groups(docs, text, id_col, **bounds).select(F.col("text_sha256").alias(digest), F.col("keep_id").alias("_veiltab_keep"), F.col("group_size").alias("_veiltab_n"))
    found = attach(docs.withColumn(digest, F.sha2(text_of(text).cast("binary"), 256)), groups, [digest], salt_by=F.col(id_col))
    stay = found.where(F.col("_veiltab_n").isNull() | F.col(id_col).cast("long").eqNullSafe(F.col("_veiltab_keep")))
    single = stay.where("_veiltab_n is null").select(*[F.col(f"`{c}`") for c in names])
    chosen = stay.where("_veiltab_n is not null").dropDuplicates([digest]).select(*[F.col(f"`{c}`") for c in names])
    return single.unionByName(chosen)
