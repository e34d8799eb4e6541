"""Nearest neighbours by cosine with cross-polytope hashing and exact reranking.

A hash turns a unit vector by three sign flips and Hadamard transforms and names the nearest signed axis; ``hashes`` of
them, one after the other, name a bucket of a table. Every vector is indexed in all tables. A query visits in each
table the buckets whose axes its turned copies lean to most (multiprobe), and everything there is ranked by exact cosine in double
precision. How many hashes name a bucket follows from the number of vectors, so that a bucket keeps some hundred
of them; tables and probes grow along.

Equal vectors are one class, of which the ``k + 1`` smallest ids are kept: a vector that a third of all rows share is
indexed once. Buckets are cut into blocks; a unit of work is a block of queries against a block of vectors and leaves its
best classes per query only, all ties at the last place compared by id. Queries whose buckets hold fewer than ``k`` others are
ranked against all vectors, in the same blocks.

Defined results: vectors that are null, zero, of another length than most, or hold a null or non-finite component take no part,
nor do rows with a null id; rows that repeat an id count once, with the smallest vector; scores that tie rank by id; a table of
``k`` or fewer others gives all of them; an empty table gives no rows. Other columns are not read.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veiltab.llm.common import attach, written
from veiltab.llm.jaccard import in_groups

BUCKET = 256        # vectors a bucket should keep at least, on average
TABLES, PROBES = 10, 14   # with one hash; per further hash 2.5 and 14 times as many
VECTOR_BLOCK, QUERY_BLOCK = 4096, 1024
ROUNDING = 1e-9     # two ways of adding up a cosine differ by less
SEED = 11


class Rotations:
    """Pseudo-random rotations of ``tables`` x ``hashes``; same for a given seed and dimension."""

    def __init__(self, dim: int, tables: int, hashes: int, seed: int = SEED):
        self.dim, self.wide = dim, 1 << max(0, dim - 1).bit_length()
        self.tables, self.hashes = tables, hashes
        self.signs = np.random.default_rng(seed).choice(np.array([-1.0, 1.0], np.float32), (tables, hashes, 3, self.wide))

    def turned(self, x: np.ndarray, table: int, which: int) -> np.ndarray:
        out = np.zeros((len(x), self.wide), np.float32)
        out[:, : self.dim] = x
        for flips in self.signs[table, which]:
            out = hadamard(out * flips)
        return out

    def buckets(self, x: np.ndarray, table: int, probes: int) -> np.ndarray:
        """The ``probes`` likeliest buckets of each row, best first."""
        codes, gains = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1), np.float32)
        axes = 2 * self.wide
        for h in range(self.hashes):
            y = self.turned(x, table, h)
            lean = np.concatenate([y, -y], axis=1)
            best = np.argsort(-lean, axis=1, kind="stable")[:, : min(probes, axes)]
            gain = (gains[:, :, None] + np.take_along_axis(lean, best, 1)[:, None, :]).reshape(len(x), -1)
            code = (codes[:, :, None] * axes + best[:, None, :]).reshape(len(x), -1)
            keep = np.argsort(-gain, axis=1, kind="stable")[:, :probes]
            codes, gains = np.take_along_axis(code, keep, 1), np.take_along_axis(gain, keep, 1)
        return codes + table * axes ** self.hashes


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of every row, scaled to keep lengths."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.float32(math.sqrt(n))


def usable(vector: str) -> F.Column:
    c = F.col(vector)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(c.isNotNull() & finite & F.exists(c, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def best_of(x: np.ndarray, cids: np.ndarray, split: int, k: int) -> tuple[np.ndarray, ...]:
    """Positions and cosine of the ``k`` nearest of ``x[split:]`` for each of ``x[:split]``; ties go to smaller ``cids``."""
    length = np.sqrt((x * x).sum(axis=1))
    scores = (x[:split] @ x[split:].T) / (length[:split, None] * length[None, split:])
    take = min(k, len(x) - split)
    last = -np.partition(-scores, take - 1, axis=1)[:, take - 1]
    q, c = np.nonzero(scores >= last[:, None] - ROUNDING)
    c += split
    exact = (x[q] * x[c]).sum(axis=1) / (length[q] * length[c])  # the same for a pair in every bucket
    order = np.lexsort((cids[c], -exact, q))
    q, c, exact = q[order], c[order], exact[order]
    starts = np.searchsorted(q, np.arange(split))
    first = np.arange(len(q)) - starts[q] < take
    return q[first], c[first], exact[first]


def nearest(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest found of every row for which ``is_query`` (a condition on ``id``) holds."""
    valid = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v")).where(F.col("id").isNotNull() & usable("v"))
    lengths = valid.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    dim = lengths.dim if lengths else 1
    rows = written(valid.where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v")).withColumn("q", is_query), "vectors")

    some = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("_nth") <= k + 1)
    kept = some.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    asked = rows.where("q").select("v").distinct().withColumn("q", F.lit(True))
    classes = written(kept.join(asked, "v", "left").select(F.element_at("ids", 1).alias("cid"), "ids", "v", F.coalesce("q", F.lit(False)).alias("q")), "vector-classes")

    n = classes.count()
    hashes = max(1, int(math.log(max(1, n / BUCKET), 2 * (1 << max(0, dim - 1).bit_length()))))
    turns = Rotations(dim, math.ceil(TABLES * 2.5 ** (hashes - 1)), hashes)
    probes = PROBES ** hashes

    def hashed(each: int, count: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals: dict[int, int] = {}
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    part = batch.slice(at, 1000)
                    x = _matrix(part.column("v"), dim)
                    x = (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)
                    for t in range(turns.tables):
                        found = turns.buckets(x, t, each)
                        if count:
                            for b, m in zip(*(c.tolist() for c in np.unique(found, return_counts=True))):
                                totals[b] = totals.get(b, 0) + m
                            if len(totals) > 500_000:
                                yield pa.RecordBatch.from_arrays([pa.array(totals.keys(), pa.int64()), pa.array(totals.values(), pa.int64())], names=["bucket", "n"])
                                totals = {}
                        else:
                            rows = pa.array(np.repeat(np.arange(len(x)), found.shape[1]))
                            yield pa.RecordBatch.from_arrays([pa.array(found.reshape(-1)), part.column("cid").take(rows), part.column("v").take(rows)], names=["bucket", "cid", "v"])
            if count and totals:
                yield pa.RecordBatch.from_arrays([pa.array(totals.keys(), pa.int64()), pa.array(totals.values(), pa.int64())], names=["bucket", "n"])

        return run

    kind = classes.schema["v"].dataType.simpleString()
    source, queries = classes.select("cid", "v"), classes.where("q").select("cid", "v")
    sizes = (source.mapInArrow(hashed(1, True), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n_vectors")).join(
        queries.mapInArrow(hashed(probes, True), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n_queries")), "bucket"))
    sizes = written(sizes.select("bucket", F.ceil(F.col("n_vectors") / VECTOR_BLOCK).cast("int").alias("_vb"), F.ceil(F.col("n_queries") / QUERY_BLOCK).cast("int").alias("_qb")), "bucket-sizes")
    block = lambda blocks: F.pmod(F.xxhash64("cid"), F.col(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    schema = f"bucket long, cid long, v {kind}"
    indexed = attach(source.mapInArrow(hashed(1, False), schema), sizes, ["bucket"], "inner", salt_by=F.col("cid"))
    probing = attach(queries.mapInArrow(hashed(probes, False), schema), sizes, ["bucket"], "inner", salt_by=F.col("cid"))

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in in_groups(batches, ["bucket", "_i", "_j"]):
            group = group.combine_chunks()
            cids, x = group.column("cid").to_numpy(), _matrix(group.column("v").combine_chunks(), dim)
            split = int((group.column("_side").to_numpy() == 0).sum())
            if not 0 < split < len(cids):
                continue
            q, c, exact = best_of(x, cids, split, k + 1)
            yield pa.RecordBatch.from_arrays([pa.array(cids[q]), pa.array(cids[c]), pa.array(exact)], names=["qcid", "cid", "score"])

    def found_in(indexed: DataFrame, probing: DataFrame) -> DataFrame:
        """``qcid, found``: the best of all blocks in which a query meets vectors of its bucket."""
        pairs = indexed.withColumn("_i", block("_vb")).withColumn("_j", every("_qb")), probing.withColumn("_j", block("_qb")).withColumn("_i", every("_vb"))
        sides = [p.select("bucket", "_i", "_j", F.lit(side).alias("_side"), "cid", "v") for side, p in zip((1, 0), pairs)]
        meeting = sides[0].unionByName(sides[1]).repartition("bucket", "_i", "_j").sortWithinPartitions("bucket", "_i", "_j", "_side", "cid")
        best = meeting.mapInArrow(ranked, "qcid long, cid long, score double").dropDuplicates(["qcid", "cid"])
        order = Window.partitionBy("qcid").orderBy(F.desc("score"), "cid")
        best = best.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= k + 1)
        return (best.join(classes.select("cid", "ids"), "cid").withColumn("id", F.explode("ids")).groupBy("qcid")
                .agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("away"), "id"))).alias("found")))

    lists = written(found_in(indexed, probing), "neighbours-found")
    enough = lists.where(F.size("found") >= min(k + 1, rows.count()))
    short = written(queries.join(enough.select(F.col("qcid").alias("cid")), "cid", "left_anti"), "short-queries")
    if n_short := short.count():
        all_of = [t.withColumns({"bucket": F.lit(-1).cast("long"), "_vb": F.lit(-(-n // VECTOR_BLOCK)), "_qb": F.lit(-(-n_short // QUERY_BLOCK))}) for t in (source, short)]
        lists = enough.unionByName(found_in(*all_of))
    results = written(lists.join(classes.where("q").select(F.col("cid").alias("qcid"), "v"), "qcid").select("v", "found"), "neighbours")
    answers = attach(rows.where("q").select("id", "v"), results, ["v"], "inner", salt_by=F.col("id"))
    own = F.expr(f"slice(filter(found, f -> f.id != id), 1, {k})")
    return answers.select(F.col("id").alias("query_id"), F.posexplode(own).alias("rank", "hit")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.away")).alias("score"))
