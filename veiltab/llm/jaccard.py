"""Jaccard join of documents on word shingles, candidates pruned by Bayes' rule on MinHash values.

1. Every text becomes its set of five-word shingles (64-bit hashes) and 120 MinHash values of one byte. Texts with the same set are
   one class from here on; the set's 128-bit digest names it.
2. Classes that agree in all five values of one of 24 bands are candidates. A pair of similarity 0.8 is missed by all bands
   with probability 7e-5.
3. Inside a bucket, pairs are compared on more and more MinHash values, 24 at a time. After each step a pair is dropped if the
   posterior probability that its similarity reaches the threshold, given the values that agree and a uniform prior, is
   below ``TOLERANCE``. Only what connects the rest leaves the task, never a list of pairs.
4. Classes so connected meet with their whole sets; pairs that share a band and pass step 3 are verified exactly.

Buckets and connected groups beyond ``BLOCK`` members are cut into blocks by a hash, and each pair of blocks is a task's unit
of work with at most two blocks in memory; the sets of most documents, which share no bucket, are never moved.

Defined results: words are what white space separates; a text of one to four words is one shingle; a null text and a text
without words link to nothing; copies of a set are links of each other; rows that repeat an id count as documents of their own; an
empty table gives no rows; a threshold below 0.8 is refused. Columns other than id and text are not read, and pass through
:func:`keep_one` unchanged.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veiltab.llm.common import BROADCAST_ROWS, attach, sliced, small_batches, text_of, written
from veiltab.llm.components import components

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 5
HASHES = BANDS * ROWS
STEP = 24
TOLERANCE = 1e-6
BLOCK = 1024
_RNG = np.random.default_rng(20_240_229)
_A = (_RNG.integers(0, 1 << 31, HASHES, dtype=np.uint32) << np.uint32(1) | np.uint32(1))[:, None]
_B = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)[:, None]
_POWERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_EMPTY = np.empty(0, np.uint64)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    parts = text.split()
    if not parts:
        return _EMPTY
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    if len(parts) < words:
        return np.array([xxhash.xxh3_64_intdigest(" ".join(parts), seed=1)], np.uint64)
    total = np.zeros(len(parts) - words + 1, np.uint64)
    for k in range(words):
        total += (hashed[k:k + len(total)] ^ (hashed[k:k + len(total)] >> np.uint64(29))) * _POWERS[k % 5] + np.uint64(k)
        total ^= total >> np.uint64(31)
        total *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique(total ^ (total >> np.uint64(32)))


def digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def minhash(found: np.ndarray) -> bytes:
    """One byte of each MinHash value."""
    low = np.full((HASHES, 1), 0xFFFFFFFF, np.uint32)
    x = (found >> np.uint64(16)).astype(np.uint32)
    for k in range(0, len(x), 4096):
        low = np.minimum(low, ((x[None, k:k + 4096] * _A) ^ _B).min(axis=1, keepdims=True))
    return ((low[:, 0] * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, agreeing values below which a pair is dropped); a byte agrees by chance once in 256."""
    s = (np.arange(4000) + 0.5) / 4000
    p = s + (1 - s) / 256
    table = []
    for n in range(STEP, HASHES + 1, STEP):
        low = 0
        for m in range(n + 1):
            logs = m * np.log(p) + (n - m) * np.log1p(-p)
            like = np.exp(logs - logs.max())
            if like[s >= threshold].sum() / like.sum() >= tolerance:
                low = m
                break
        table.append((n, low))
    return table


def surviving(a: np.ndarray, b: np.ndarray, table: list[tuple[int, int]], same: bool, band: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the byte matrices ``a`` and ``b`` whose pair shares a band and isn't dropped; of one matrix, i < j.

    With ``band``, only pairs whose first shared band it is: each candidate pair is compared in one bucket.
    """
    seen = np.zeros((len(a), len(b)), np.int16)
    bands = np.ones((len(a), len(b)), bool)
    first = np.full((len(a), len(b)), BANDS, np.int8)
    done, left = 0, np.triu(np.ones((len(a), len(b)), bool), 1) if same else np.ones((len(a), len(b)), bool)
    for k in range(BANDS):
        bands[:] = True
        for h in range(k * ROWS, (k + 1) * ROWS):
            equal = a[:, h][:, None] == b[None, :, h]
            seen += equal
            bands &= equal
            done += 1
            if done % STEP == 0:
                left &= seen >= table[done // STEP - 1][1]
        first[bands & (first == BANDS)] = k
        if done % STEP < ROWS and not left.any():
            break
    left &= first < BANDS if band is None else first == band
    return np.nonzero(left)


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join_all(self, left: np.ndarray, right: np.ndarray) -> None:
        for i, j in zip(left.tolist(), right.tolist()):
            i, j = self.root(i), self.root(j)
            if i != j:
                self.up[max(i, j)] = min(i, j)

    def edges(self, names: list) -> list[tuple]:
        return [(names[i], names[self.root(i)]) for i in range(len(self.up)) if self.root(i) != i]


def spanning(n: int, left: np.ndarray, right: np.ndarray) -> Forest:
    """Forest over pairs; rows joined to the same first partner at once before the rest, so dense pairs cost little."""
    forest = Forest(n)
    if len(left):
        firsts, at = np.unique(right, return_index=True)
        forest.join_all(left[at], firsts)
        roots = np.array([forest.root(i) for i in range(n)])
        apart = roots[left] != roots[right]
        forest.join_all(left[apart], right[apart])
    return forest


def in_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal integer keys, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys])
        cuts = [0, *(np.flatnonzero((table[1:] != table[:-1]).any(axis=1)) + 1).tolist(), len(table)]
        for start, stop in zip(cuts, cuts[1:]):
            key = tuple(table[start].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, stop - start))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def in_block_pairs(df: DataFrame, group: str, size: str, member: str, block: int = BLOCK) -> DataFrame:
    """Deal the members of each group to pairs of blocks ``_i <= _j``; ``_mine`` is the member's own block.

    ``group`` is a long. A group of one block is one pair; rows come sorted by ``group, _i, _j``.
    """
    blocks = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64(member, F.lit(5)), blocks).cast("int")
    others = F.when(blocks == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), blocks - 1))
    dealt = df.withColumn("_mine", own).withColumn("_other", F.explode(others))
    dealt = dealt.withColumn("_i", F.least("_mine", "_other")).withColumn("_j", F.greatest("_mine", "_other")).drop("_other")
    return dealt.repartition(group, "_i", "_j").sortWithinPartitions(group, "_i", "_j", member)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        sets = [shingles(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array([digest(s) for s in sets], pa.binary()), pa.array(list(map(len, sets)), pa.int64()),
                                          pa.array([minhash(s) if len(s) else None for s in sets], pa.binary())], names=["doc_id", "key", "cid", "n_shingles", "sig"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        sets = [shingles(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cid", "shingles"])


def _bayes_edges(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, edges = least_matches(threshold), []
        for group in in_groups(batches, ["bucket", "_i", "_j"]):
            names = group.column("cid").to_pylist()
            sigs = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint8).reshape(len(names), HASHES)
            band = int(group.column("bucket")[0].as_py()) >> 40
            left, right = _pairs_of(group, sigs, table, band)
            edges += spanning(len(names), left, right).edges(names)
            if len(edges) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*edges)], names=["a", "b"])
                edges = []
        if edges:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*edges)], names=["a", "b"])

    return run


def _pairs_of(group: pa.Table, sigs: np.ndarray, table: list, band: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Surviving pairs as positions: inside one block, or of one block with another."""
    i, j = group.column("_i")[0].as_py(), group.column("_j")[0].as_py()
    if i == j:
        return surviving(sigs, sigs, table, True, band)
    mine = group.column("_mine").to_numpy()
    first, second = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
    left, right = surviving(sigs[first], sigs[second], table, False, band)
    return first[left], second[right]


def common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Shared shingles of each pair of sets (positions ``left``, ``right``).

    Few pairs are intersected one by one. Many pairs of one group go by shingle: those in few sets add to the pairs of
    these sets, those in many are columns of a 0/1 matrix whose product with itself counts them.
    """
    n = len(sets)
    if len(left) <= 8 * n:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left.tolist(), right.tolist())], np.int64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, where, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(where, kind="stable")
    owner, starts = owner[order], np.concatenate([[0], np.cumsum(times)[:-1]])
    counts = np.zeros((n, n), np.float32)
    for d in range(2, 12):
        rows = starts[times == d]
        for x in range(d):
            for y in range(x + 1, d):
                flat = owner[rows + x] * n + owner[rows + y]
                for k in range(0, len(flat), 1 << 20):
                    counts += np.bincount(flat[k:k + (1 << 20)], minlength=n * n).reshape(n, n) if len(flat) else 0
    hot = np.flatnonzero(times >= 12)
    for k in range(0, len(hot), 2048):
        part = hot[k:k + 2048]
        matrix = np.zeros((n, len(part)), np.float32)
        for c, f in enumerate(part):
            matrix[owner[starts[f]:starts[f] + times[f]], c] = 1
        counts += matrix @ matrix.T
    return counts[np.minimum(left, right), np.maximum(left, right)].astype(np.int64)


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, out = least_matches(threshold), []
        for group in in_groups(batches, ["grp", "_i", "_j"]):
            names, weights = group.column("cid").to_pylist(), group.column("n").to_numpy()
            sigs = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint8).reshape(len(names), HASHES)
            left, right = _pairs_of(group, sigs, table, None)
            if len(left):
                sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
                sizes = np.array([len(s) for s in sets])
                both = common(sets, left, right)
                true = both >= threshold * (sizes[left] + sizes[right] - both) - 1e-9
                left, right = left[true], right[true]
                links = np.bincount(left, weights[right], len(names)) + np.bincount(right, weights[left], len(names))
                forest = spanning(len(names), left, right)
                out += [(names[i], names[forest.root(i)], int(links[i])) for i in np.flatnonzero(links)]
            if len(out) > 20_000:
                yield _links(out)
                out = []
        if out:
            yield _links(out)

    return run


def _links(rows: list[tuple]) -> pa.RecordBatch:
    a, b, n = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())], names=["a", "b", "links"])


def _first(doc_id, key):
    """What comes first of some rows: the smallest id, null ids last, then the smallest text key."""
    return F.min(F.struct(doc_id.isNull().alias("none"), doc_id.alias("id"), key.alias("key")))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``class_id`` (smallest id of its group of linked documents), ``set_id`` (smallest id with
    its very shingle set), ``n_links`` (other documents of similarity ``threshold`` or more)."""
    return _linked(docs, threshold, text, id_col).select("doc_id", "class_id", "set_id", "n_links")


def _linked(docs: DataFrame, threshold: float, text: str, id_col: str) -> DataFrame:
    """:func:`near_duplicates` with ``key`` (hash of the row's text) and ``class_key`` (that of its group's first row)."""
    if threshold < THRESHOLD:
        raise ValueError(f"the bands find pairs of similarity {THRESHOLD} or more; a lower threshold would lose links")
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), text_of(text).alias("text")).withColumn("key", F.xxhash64("text"))
    signed = written(rows.mapInArrow(_signed, "doc_id long, key long, cid binary, n_shingles long, sig binary"), "signatures")
    classes = written(signed.where("n_shingles > 0").groupBy("cid").agg(_first(F.col("doc_id"), F.col("key")).alias("first"), F.count("*").alias("n"), F.min("sig").alias("sig"))
                      .withColumn("rep", F.col("first.id")), "classes")

    byte = lambda k: F.conv(F.hex(F.substring("sig", k * ROWS + 1, ROWS)), 16, 10).cast("long")
    bands = classes.select("cid", F.explode(F.array(*[byte(k) + F.lit(k << 40) for k in range(BANDS)])).alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    meeting = written(bands.join(shared, "bucket"), "buckets")
    in_bucket = meeting.join(classes.select("cid", "sig"), "cid")
    edges = written(in_block_pairs(in_bucket, "bucket", "members", "cid").mapInArrow(_bayes_edges(threshold), "a binary, b binary"), "candidates")

    grouped = components(edges)
    sizes = grouped.groupBy("root").agg(F.count("*").alias("members"))
    named = written(grouped.join(sizes, "root").select(F.col("node").alias("cid"), F.xxhash64("root").alias("grp"), "members"), "groups")
    wanted = written(classes.join(named, "cid"), "wanted")
    reps = wanted.select(F.col("rep").alias("doc_id")).distinct()
    small = reps.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    matching = rows.join(F.broadcast(reps) if small else reps, rows["doc_id"].eqNullSafe(reps["doc_id"]), "left_semi")
    sets = matching.select("text").mapInArrow(_sets, "cid binary, shingles binary")
    whole = wanted.join(sets, "cid").dropDuplicates(["cid"])
    verified = written(in_block_pairs(whole, "grp", "members", "cid").mapInArrow(_verify(threshold), "a binary, b binary, links long"), "links")

    linked = components(verified.select("a", "b"))
    found = (verified.groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links")).join(linked.withColumnRenamed("node", "cid"), "cid", "left")
             .withColumn("root", F.coalesce("root", "cid")))
    least = classes.join(found, "cid").groupBy("root").agg(F.min("first").alias("least"))
    head = F.coalesce("least", "first")
    known = written(classes.join(found, "cid", "left").join(least, "root", "left").select(
        "cid", F.col("rep").alias("set_id"), head["id"].alias("class_id"), head["key"].alias("class_key"),
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")).where("n_links > 0"), "known")
    result = attach(signed.select("doc_id", "key", "cid"), known, ["cid"], salt_by=F.col("doc_id"))
    return result.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("set_id", "doc_id").alias("set_id"),
                         F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "key", F.coalesce("class_key", "key").alias("class_key"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns: of each group of linked documents the one with the smallest id.

    A null id comes after all others; of texts that share the smallest id, the one of the smallest hash stays. Rows that
    repeat both the id and the text of the one that stays are that document and stay with it.
    """
    gone = ~(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("key") == F.col("class_key")))
    drop = written(_linked(docs, threshold, text, id_col).where(F.col("n_links") > 0).where(gone)
                   .select(F.col("doc_id").alias("_veiltab_id"), F.col("key").alias("_veiltab_key")).distinct(), "near")
    small = drop.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    same = F.xxhash64(text_of(f"`{text}`")).eqNullSafe(F.col("_veiltab_key")) & F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("_veiltab_id"))
    return docs.join(F.broadcast(drop) if small else drop, same, "left_anti")
