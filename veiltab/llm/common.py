"""What the operators share: shared scratch tables, null-safe text, small-table joins."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veiltab.session import materialize as written, scratch_path  # noqa: F401

#: A side is broadcast only below this many rows of a few fixed-width or short columns.
BROADCAST_ROWS = 200_000
#: Bytes of text one in-memory table or Arrow batch list may hold.
BATCH_BYTES = 4 << 20
#: Rows Spark hands to Python at a time: a batch of texts has no byte bound of its own.
BATCH_ROWS = 500


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after lowering the session's Arrow batch to at most ``BATCH_ROWS`` rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df


def text_of(column: str = "text") -> Column:
    """The text; a null text counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def draw(salt: str, *cols: Column) -> Column:
    """Uniform number in [0, 1) hashed from ``salt`` and the given columns; any engine with md5 repeats it."""
    hashed = F.md5(F.concat_ws("|", F.lit(salt), *[F.coalesce(c.cast("string"), F.lit("<null>")) for c in cols]))
    return F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def attach(df: DataFrame, small: DataFrame, on: list[str], how: str = "left", salts: int = 16, salt_by: Column | None = None) -> DataFrame:
    """Join a pre-aggregated table to rows whose keys may be hot.

    ``small`` must be cheap to count (written or a few rows). Below ``BROADCAST_ROWS`` it is broadcast; beyond, every
    row of it is repeated ``salts`` times and the hot keys of ``df`` are dealt over that many tasks.
    """
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(small), on, how)
    salt = F.pmod(F.xxhash64(salt_by if salt_by is not None else F.struct(*[F.col(f"`{c}`") for c in df.columns])), F.lit(salts))
    spread = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return df.withColumn("_salt", salt).join(spread, [*on, "_salt"], how).drop("_salt")


def sliced(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of each hold about ``limit`` bytes; one long text stays whole."""

    for batch in batches:
        lengths = batch.column(column).fill_null("" if pa.types.is_string(batch.column(column).type) else b"")
        ends = np.cumsum(pc.binary_length(lengths).to_numpy(zero_copy_only=False).astype("int64"))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
