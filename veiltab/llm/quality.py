"""Quality score by compression with two zstandard dictionaries.

One dictionary is trained on text labelled good, one on text labelled bad. A text is cut into blocks, every block
is compressed with either dictionary, and the difference of the two sizes, summed over the whole text and divided by
its bytes, says which it is more like. A rising curve fitted on labelled rows that trained no dictionary (isotonic
calibration) makes it a score.

What is fitted on is bounded: ``DICT_DOCS`` documents and ``DICT_BLOCKS`` blocks of each label for the dictionaries, and
``CALIBRATE_DOCS`` documents for the calibration, chosen by a hash of the id. The score reads nothing but the text.

Defined results: a null or empty text has no difference and gets the calibrated score of 0; a label other than 0 or 1, a null id
and an id with both labels teach nothing; without labelled rows of both kinds every score is the share of label 1
(0.5 without any). Rows, repeated ones too, keep their other columns, whatever these are called.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veiltab.llm.common import sliced, small_batches, text_of

BLOCK = 1024            # bytes compressed at a time: beyond a few times that, a text is its own dictionary
LEVEL = 3
DICT_BYTES = 250_000
DICT_DOCS = 1_500       # of each label
DICT_BLOCKS = 8_000     # of each label
CALIBRATE_DOCS = 6_000
SMOOTHING = 64          # bytes added to a text's length, so that a few bytes don't make a strong case


def fold(id_col: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds


@dataclass(frozen=True)
class QualityModel:
    """Dictionaries and the calibration curve: differences ``at`` and their scores ``value``, joined by straight lines."""

    good: bytes
    bad: bytes
    at: tuple[float, ...]
    value: tuple[float, ...]

    def score(self, docs: DataFrame, text: str = "text", name: str = "score") -> DataFrame:
        """``docs`` with the score in column ``name``."""
        if not self.good:
            return docs.withColumn(name, F.lit(self.value[0]))
        return small_batches(docs).withColumn(name, difference(self.good, self.bad, (self.at, self.value))(text_of(text)))


def blocks(text: str) -> list[bytes]:
    data = text.encode()
    return [data[i:i + BLOCK] for i in range(0, len(data), BLOCK)]


def difference(good: bytes, bad: bytes, curve: tuple | None = None):
    """Arrow function: bytes that the good dictionary saves against the bad one, per byte of text; through ``curve`` if given."""
    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        small = []
        for content in (good, bad):
            held = zstandard.ZstdCompressionDict(content)
            held.precompute_compress(level=LEVEL)
            small.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        with_good, with_bad = small
        for texts in batches:
            out = []
            for text in texts:
                parts = blocks(text.as_py())
                saved = sum(len(with_bad(p)) - len(with_good(p)) for p in parts)
                out.append(saved / (sum(map(len, parts)) + SMOOTHING))
            yield pa.array(np.interp(out, *curve) if curve else out, pa.float64())

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", id_col: str = "doc_id", folds: int = 5) -> QualityModel:
    """Learn from labelled rows outside fold 0."""
    known = (labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & (fold(F.col(id_col), folds) != 0))
             .groupBy(F.col(id_col).alias("_id")).agg(F.min(label).alias("_label"), F.max(label).alias("_most")).where("_label = _most").drop("_most"))
    hashed = known.withColumn("_h", F.md5(F.concat(F.lit("quality|"), F.col("_id").cast("string"))))
    counts = {int(r["_label"]): r["n"] for r in known.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        share = (counts.get(1, 0) + 0.5) / (total + 1)
        return QualityModel(b"", b"", (0.0,), (share,))
    # the first digit of the hash says what a row is for: two parts in three train dictionaries
    trains = F.substring("_h", 1, 1).isin(*"0123456789")
    chosen = [hashed.where(trains & (F.col("_label") == q)).orderBy("_h").limit(DICT_DOCS) for q in (0, 1)]
    sample = chosen[0].unionByName(chosen[1])
    rows = small_batches(docs).select(F.col(id_col).alias("_id"), text_of(text).alias("_text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "_text"):
            found = [(q, f"{h}{k:08d}", part) for q, h, t in zip(*(batch.column(c).to_pylist() for c in ("_label", "_h", "_text"))) for k, part in enumerate(blocks(t))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*found), (pa.int32(), pa.string(), pa.binary()))], names=["q", "h", "part"])

    parts = (rows.join(F.broadcast(sample.withColumn("_label", F.col("_label").cast("int"))), "_id").select("_label", "_h", "_text")
             .mapInArrow(cut, "q int, h string, part binary").withColumn("o", F.md5("h")))
    dictionaries = []
    for q in (1, 0):
        held = [bytes(r.part) for r in parts.where(F.col("q") == q).orderBy("o", "part").limit(DICT_BLOCKS).select("part").collect()]
        dictionaries.append(_dictionary(held))
    good, bad = dictionaries
    calibrate = hashed.where(~trains).orderBy("_h").limit(CALIBRATE_DOCS)
    seen = (rows.join(F.broadcast(calibrate), "_id").select(F.col("_h"), F.col("_label").cast("int").alias("q"), difference(good, bad)(F.col("_text")).alias("x"))
            .groupBy("_h").agg(F.min("q").alias("q"), F.min("x").alias("x")).orderBy("_h").collect())
    return QualityModel(good, bad, *_rising([r.x for r in seen], [r.q for r in seen]))


def _dictionary(parts: list[bytes]) -> bytes:
    """A trained dictionary; with too little text to train on, the text itself."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, parts).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(parts) or b"\n" * 8).ljust(8, b"\n")[-DICT_BYTES:]


def _rising(x: list[float], y: list[int]) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Isotonic regression by pooling neighbours that fall; each pool counts half a row more of either label."""
    pools: list[list[float]] = []  # rows, label sum, x sum
    for at, label in sorted(zip(x, y)):
        pools.append([1.0, float(label), at])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            n, total, where = pools.pop()
            pools[-1] = [pools[-1][0] + n, pools[-1][1] + total, pools[-1][2] + where]
    if not pools:
        return (-0.1, 0.1), (0.0, 1.0)
    curve = [(where / n, (total + 0.5) / (n + 1)) for n, total, where in pools]
    ats, values = zip(*curve)
    return tuple(map(float, ats)), tuple(map(float, np.maximum.accumulate(values)))
