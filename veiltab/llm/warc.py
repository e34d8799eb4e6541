"""WARC files of pages, and fixity audits of replicas by Merkle trees.

:func:`write_warc` writes one WARC file per range of page ids with Spark's text writer: a record is header, payload and the blank
lines that end it, which serve as the writer's line separator; files are gzip streams. :func:`index` reads them back: byte range
(in the unpacked file), page id and digest of every record.

:func:`tree` hashes the record ranges of every file, in order, into nodes of ``FANOUT`` children up to a root per file, and the
files into one root; each level is a written table. A file's last leaf stands for its length, so bytes added behind its last
record change its root, and a file that only the replica has is a leaf of its own. :func:`audit` compares two trees from the root
down: only the children of nodes that differ are read on the next level, so equal replicas cost one comparison and a few damaged
records a few branches.

Defined results: a null page is an empty payload; a null url gives no target line; line breaks in a url become spaces; records stand in
order of id (nulls first), then of content; repeated rows are records of their own; a range or file that a replica lacks differs;
a replica's gzip stream is read up to its first unreadable byte, and what lies behind is lacking; an empty table gives no record
and one root that is equal to itself. Columns other than id, url and html are not read.
"""
from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veiltab.llm.common import scratch_path, written

FANOUT = 16
FILE_BYTES = 24 << 20  # aimed unpacked bytes of a file
END = "\r\n\r\n"
PIECE = 1 << 14        # packed bytes unpacked at a time: a damaged byte takes no more before it along
LEAVES = "file int, node long, hash binary"
INDEX = "file int, seq long, page_id long, start long, length long, sha256 string"
_LENGTH = re.compile(rb"\r\nContent-Length: (\d+)\r\n")
_ID = re.compile(rb"\r\nWARC-Record-ID: <urn:page:(-?\d+|null)>\r\n")


def record_text(page_id: Column, url: Column, html: Column) -> Column:
    """A record without the blank lines at its end."""
    payload = F.coalesce(html.cast("string"), F.lit(""))
    target = F.when(url.isNotNull(), F.concat(F.lit("WARC-Target-URI: "), F.translate(url.cast("string"), "\r\n", "  "), F.lit("\r\n"))).otherwise("")
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">\r\n"), target,
                    F.lit("Content-Type: text/html\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit(END), payload)


def write_warc(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url: str = "url", html: str = "html") -> str:
    """Write the files and return their folder."""
    path = path or scratch_path(pages.sparkSession, "warc")
    size = pages.agg(F.sum(F.octet_length(F.coalesce(F.col(html).cast("string"), F.lit(""))) + 200)).first()[0] or 0
    files = max(1, -(-size // FILE_BYTES))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url).alias("url"), F.col(html).alias("html")).withColumn("_h", F.xxhash64("url", "html"))
    ordered = rows.repartitionByRange(files, "id", "_h").sortWithinPartitions("id", "_h", "url", "html")
    ordered.select(record_text(F.col("id"), F.col("url"), F.col("html")).alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)
    return path


def files_of(spark, path: str) -> DataFrame:
    """``file, content``: the packed bytes of every file, numbered in order."""
    number = F.regexp_extract(F.col("path"), r"part-(\d+)", 1).cast("int")
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(number.alias("file"), "content")


def records(data: bytes) -> Iterator[tuple[int, int]]:
    """Start and stop of each record of an unpacked file, by its headers' lengths."""
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        stop = head + 4 + int(_LENGTH.search(data, at, head + 2)[1]) + 4
        yield at, stop
        at = stop


def unpacked(content: bytes) -> tuple[bytes, bool]:
    """What can be read of a gzip file of any number of members, and whether it ends as it should."""
    parts, rest = [], content
    while rest:
        member, at = zlib.decompressobj(31), 0
        while at < len(rest) and not member.eof:
            try:
                parts.append(member.decompress(rest[at: at + PIECE]))
            except zlib.error:
                return b"".join(parts), False
            at += PIECE
        if not member.eof:
            return b"".join(parts), False
        rest = member.unused_data + rest[at:]
    return b"".join(parts), bool(content)


def index(files: DataFrame) -> DataFrame:
    """Written table ``file, seq, page_id, start, length, sha256`` of every record."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, content in zip(batch.column("file").to_pylist(), batch.column("content")):
                data, rows = zlib.decompress(content.as_py(), 31), []
                for seq, (a, b) in enumerate(records(data)):
                    name = _ID.search(data, a, b)[1]
                    rows.append((number, seq, None if name == b"null" else int(name), a, b - a, hashlib.sha256(data[a:b]).hexdigest()))
                if rows:
                    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["file", "seq", "page_id", "start", "length", "sha256"])

    return written(files.mapInArrow(run, INDEX), "warc-index")


def range_hashes(files: DataFrame, ranges: DataFrame, damage: Callable[[bytes, int | None], bytes] | None = None, named: DataFrame | None = None) -> DataFrame:
    """Leaves of a replica, ``file, node, hash``: its bytes at every range of an index (null where it has no such bytes), then its length.

    ``named`` lists the ``file`` numbers to look for, those of ``files`` by default. A file's ranges travel with its one row;
    their number is bounded by the file's size. ``damage`` stands in for a failing disk in drills: it is given a record's bytes and
    page id and returns what would be read.
    """
    grouped = ranges.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("seq", "start", "length", "page_id"))).alias("ranges"))
    listed = (files if named is None else named).select("file").join(grouped, "file", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                number, content = batch.column("file")[i].as_py(), batch.column("content")[i].as_py()
                data, whole = unpacked(content) if content is not None else (b"", False)
                rows = []
                for r in batch.column("ranges")[i].as_py() or ():
                    part = data[r["start"]: r["start"] + r["length"]]
                    part = damage(part, r["page_id"]) if damage else part
                    rows.append((number, r["seq"], hashlib.sha256(b"\0" + part).digest() if len(part) == r["length"] else None))
                rows.append((number, len(rows), None if content is None else hashlib.sha256(b"\2%d %d" % (len(data), whole)).digest()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary()))], names=["file", "node", "hash"])

    return listed.join(files, "file", "left").select("file", "content", "ranges").mapInArrow(run, LEAVES)


def tree(leaves: DataFrame, name: str) -> list[DataFrame]:
    """Levels ``file, node, hash`` from the leaves up; the last has one row. Above the files' roots, ``file`` is -1 and a node is a range of files."""
    level = written(leaves, f"{name}-0")
    levels = [level]
    while True:
        top = level.agg(F.max("node"), F.max("file"), F.count("*")).first()
        if top[2] <= 1 and (top[1] is None or top[1] < 0):
            return levels
        inside = (top[0] or 0) > 0
        file, node = (F.col("file"), F.col("node")) if inside or top[1] < 0 else (F.lit(-1), F.col("file").cast("long"))
        joined = F.aggregate(F.array_sort(F.collect_list(F.struct("_at", F.coalesce("hash", F.lit(b"")).alias("h")))), F.lit(b"\1"), lambda acc, c: F.concat(acc, c["h"]))
        up = (level.select(file.cast("int").alias("file"), F.floor(node / FANOUT).alias("node"), node.alias("_at"), "hash")
              .groupBy("file", "node").agg(F.unhex(F.sha2(joined, 256)).alias("hash")))
        level = written(up, f"{name}-{len(levels)}")
        levels.append(level)


def audit(ours: list[DataFrame], theirs: list[DataFrame]) -> DataFrame:
    """``file, node`` of the leaves whose hashes differ, found from the root down."""
    suspects = None
    for height in range(len(ours) - 1, -1, -1):
        a, b = ours[height], theirs[height].withColumnRenamed("hash", "_theirs")
        if suspects is not None:
            above = ours[height + 1].where("file >= 0").limit(1).count() > 0  # parents inside files, or over files
            leaf_of_file = not above and ours[height].where("file >= 0").limit(1).count() > 0
            parent = [F.col("file"), F.floor(F.col("node") / FANOUT)] if not leaf_of_file else [F.lit(-1), F.floor(F.col("file") / FANOUT).cast("long")]
            a = a.withColumns({"_pf": parent[0].cast("int"), "_pn": parent[1].cast("long")}).join(suspects, ["_pf", "_pn"], "left_semi").drop("_pf", "_pn")
        differ = a.join(b, ["file", "node"], "left").where(~F.col("hash").eqNullSafe(F.col("_theirs")))
        suspects = written(differ.select(F.col("file").alias("_pf"), F.col("node").alias("_pn")), f"audit-{height}")
        if not suspects.limit(1).count():
            break
    return suspects.select(F.col("_pf").alias("file"), F.col("_pn").alias("node")) if height == 0 else suspects.limit(0).select(F.col("_pf").alias("file"), F.col("_pn").alias("node"))


def differing(files: DataFrame, ranges: DataFrame, replica: DataFrame, damage=None) -> DataFrame:
    """``file, node`` of all leaves in which a replica differs from ``files``; files that only the replica has count as one leaf."""
    extra = replica.join(files.select("file"), "file", "left_anti").select("file", F.lit(0).cast("long").alias("node"), F.unhex(F.sha2("content", 256)).alias("hash"))
    ours = range_hashes(files, ranges).unionByName(extra.withColumn("hash", F.lit(None).cast("binary")))
    theirs = range_hashes(replica, ranges, damage, files).unionByName(extra)
    return audit(tree(ours, "ours"), tree(theirs, "theirs"))


def fixity(spark, path: str, replica: DataFrame, damage=None) -> DataFrame:
    """One row per record of the files at ``path``: ``page_id, start`` (over all files), ``length, sha256, intact`` in the replica."""
    files = files_of(spark, path)
    ranges = index(files)
    bad = differing(files, ranges, replica, damage)
    sizes = ranges.groupBy("file").agg(F.sum("length").alias("_bytes"))
    before = sizes.select("file", (F.sum("_bytes").over(Window.orderBy("file")) - F.col("_bytes")).alias("_before"))  # one row per file
    marked = ranges.join(before, "file").join(bad.select("file", F.col("node").alias("seq"), F.lit(False).alias("_ok")), ["file", "seq"], "left")
    return marked.select("page_id", (F.col("_before") + F.col("start")).alias("start"), "length", "sha256", F.coalesce("_ok", F.lit(True)).alias("intact"))


def findings(spark, path: str, replica: DataFrame) -> DataFrame:
    """Everything in which a replica differs: ``file, kind, page_id, start, length``.

    ``kind`` is ``record`` (with its id and byte range), ``length`` (the unpacked file is shorter or longer, or its stream is
    broken), ``missing file`` or ``extra file``.
    """
    files = files_of(spark, path)
    ranges = index(files)
    held = replica.select("file", F.lit(True).alias("_theirs"))
    known = files.select("file", F.lit(True).alias("_ours"))
    bad = differing(files, ranges, replica).join(known, "file", "left").join(held, "file", "left").withColumnRenamed("node", "seq")
    kind = (F.when(F.col("_ours").isNull(), "extra file").when(F.col("sha256").isNotNull(), "record").when(F.col("_theirs").isNull(), "missing file").otherwise("length"))
    return bad.join(ranges, ["file", "seq"], "left").select("file", kind.alias("kind"), "page_id", "start", "length")
