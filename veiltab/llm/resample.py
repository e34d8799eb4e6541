"""Importance resampling towards a target distribution, drawn without replacement by Gumbel noise.

Features are all runs of 1 to ``n`` consecutive words, hashed into buckets. Every text is read once and stored as an
array of its buckets. From the arrays come the bucket counts of the corpus (counted per task, then summed: as many rows
as buckets), a bucket's gain ``floor(1000 ln(...))`` of the target's smoothed share over the corpus' one, and each
document's weight, a sum over its array. The weight plus noise from a hash of the id is its score. Documents are
ranked by (score down, id up) with the radix sort of :mod:`radix`, and the first ``percent`` of the eligible are drawn.

Defined results: a null text has no words; an id that is null is hashed as an empty one and stands after all others in
ties; rows of one id share their noise and are drawn by themselves; weights are whole numbers, so they do not depend
on the order of sums; an empty corpus gives no rows; an empty target counts no feature. Other columns are not read.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veiltab.llm.common import sliced, small_batches, text_of, written
from veiltab.llm.radix import radix_rank

BUCKETS = 10_000   # at most 65,536: a stored feature takes two bytes
LONGEST_RUN = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"
#: A-Z become a-z; other ASCII but letters and digits becomes a space; every byte above stays.
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32) for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-cased words as UTF-8: a space of the folded text is a separator, and no separator lies inside a character."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def buckets_of(words: list[bytes], longest: int, buckets: int) -> np.ndarray:
    hashes = list(map(crc32, words))
    for n in range(2, longest + 1):
        hashes += [crc32(b" ".join(words[i:i + n])) for i in range(len(words) - n + 1)]
    return (np.asarray(hashes, np.uint32) % buckets).astype("<u2")


def features(docs: DataFrame, text: str = "text", id_col: str | None = "doc_id", longest: int = LONGEST_RUN, buckets: int = BUCKETS) -> DataFrame:
    """Written table ``doc_id, n_words, n_features, buckets`` (two bytes each) with one row per row of ``docs``."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must be 1 to 65,536")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced([batch], "text"):
                found = [(len(w), buckets_of(w, longest, buckets)) for w in map(words_of, part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([n for n, _ in found], pa.int64()), pa.array([len(b) for _, b in found], pa.int64()), pa.array([b.tobytes() for _, b in found], pa.binary())],
                    names=["doc_id", "n_words", "n_features", "buckets"])

    source = small_batches(docs).select((F.col(id_col) if id_col else F.lit(None)).cast("long").alias("doc_id"), text_of(text).alias("text"))
    return written(source.mapInArrow(run, "doc_id long, n_words long, n_features long, buckets binary"), "features")


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in a table of :func:`features`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for held in batch.column("buckets"):
                counts += np.bincount(np.frombuffer(held.as_py(), "<u2"), minlength=buckets)
        hit = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(counts[hit])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in found.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of target share over corpus share, one added to every bucket."""
    s_all, t_all, m = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.asarray([math.floor(1000 * math.log(((t + 1) * (s_all + m)) / ((s + 1) * (t_all + m)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None, seed: str) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(found: DataFrame, gain: np.ndarray, seed: str = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of a table of :func:`features`."""
    names = ["doc_id", "n_words", "n_features", "weight", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = np.asarray([gain[np.frombuffer(b.as_py(), "<u2")].sum() for b in batch.column("buckets")], np.int64)
            drawn = np.asarray([noise(i, seed) for i in batch.column("doc_id").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names[:3]], pa.array(weight), pa.array(weight + drawn)], names=names)

    return found.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def resample(docs: DataFrame, target: DataFrame, text: str = "text", id_col: str = "doc_id", longest: int = LONGEST_RUN, buckets: int = BUCKETS, least_words: int = LEAST_WORDS,
             percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row; ``rank`` is null where the row is not drawn."""
    found = features(docs, text, id_col, longest, buckets)
    wanted = bucket_counts(features(target, text, None, longest, buckets), buckets)
    rows = written(scored(found, gains(bucket_counts(found, buckets), wanted), seed), "scores")
    eligible = rows.where(F.col("n_words") >= least_words)
    drawn = percent * eligible.count() // 100
    ranked = radix_rank(eligible, [-F.col("score"), F.col("doc_id")])
    columns = ["doc_id", "n_features", "weight", "score"]
    inside = ranked.select(*[F.col(f"row.{c}") for c in columns], F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return inside.unionByName(rows.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank")))
