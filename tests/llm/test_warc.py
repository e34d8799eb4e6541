"""Merkle audits find every damaged record and nothing else."""
import gzip
import hashlib
import pathlib
import urllib.parse

import pytest
from pyspark.sql import functions as F

from veiltab.llm import warc
from veiltab.llm.warc import audit, files_of, findings, fixity, index, tree, unpacked, write_warc


def pages(spark):
    rows = [(i, f"http://x{i}.org/a", "<p>" + "text é " * (i % 50) + "</p>\r\n\r\n") for i in range(700)]
    rows += [(3, "http://x3.org/a", "<p></p>"), (None, None, None), (800, "a\r\nb", ""), (801, None, "WARC/1.1\r\nContent-Length: 7\r\n\r\n"), (5, rows[5][1], rows[5][2])]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.mark.parametrize("file_bytes", [1 << 30, 20_000])
def test_audit(spark, monkeypatch, file_bytes):
    monkeypatch.setattr(warc, "FILE_BYTES", file_bytes)
    path = write_warc(pages(spark))
    whole = index(files_of(spark, path))
    assert whole.count() == 705 and whole.select("file").distinct().count() >= (1 if file_bytes > 1e6 else 3)
    good = fixity(spark, path, files_of(spark, path))
    assert good.where("not intact").count() == 0 and good.count() == 705
    ends = sorted((r.start, r.length) for r in good.collect())
    assert ends[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:]))

    def damage(data: bytes, page_id):
        return data[:-1] + b"?" if page_id in (0, 17, 333) else data[:-3] if page_id == 600 else data

    bad = fixity(spark, path, files_of(spark, path), damage).where("not intact")
    assert sorted(r.page_id for r in bad.collect()) == [0, 17, 333, 600]


def test_missing_file(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    path = write_warc(pages(spark))
    files = files_of(spark, path)
    lost = files.agg({"file": "max"}).first()[0]
    got = fixity(spark, path, files.where(files.file != lost)).where("not intact")
    assert got.count() == index(files).where(f"file = {lost}").count() > 0


def test_replica_damaged_on_disk(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "FILE_BYTES", 8_000)
    df = pages(spark).withColumns({"file": F.lit("x"), "seq": F.lit(1), "node": F.lit(None)})  # names the audit uses itself
    path, copy = write_warc(df), tmp_path / "replica"
    copy.mkdir()
    parts = sorted(p for p in pathlib.Path(urllib.parse.urlparse(path).path).iterdir() if p.name.startswith("part-"))
    assert len(parts) >= 5
    for i, p in enumerate(parts):
        data = p.read_bytes()
        if i == 0:  # a flipped byte inside the packed stream
            at = len(data) // 2
            data = data[:at] + bytes([data[at] ^ 0xFF]) + data[at + 1:]
        elif i == 1:  # cut off
            data = data[: len(data) // 2]
        elif i == 2:  # a record appended as a member of its own
            data += gzip.compress(b"WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n")
        elif i == 3:  # not a gzip file at all
            data = b"rubbish"
        if i != 4:  # lost
            (copy / p.name).write_bytes(data)
    (copy / "part-09999-extra.txt.gz").write_bytes(gzip.compress(b"more"))
    got = findings(spark, path, files_of(spark, str(copy))).collect()
    kinds = {}
    for r in got:
        kinds.setdefault(r.file, set()).add(r.kind)
    assert kinds == {0: {"record", "length"} if "length" in kinds[0] else {"record"}, 1: {"record", "length"}, 2: {"length"}, 3: {"record", "length"}, 4: {"record", "missing file"}, 9999: {"extra file"}}
    counts = {r.file: r["count"] for r in index(files_of(spark, path)).groupBy("file").count().collect()}
    for f in (3, 4):
        assert sum(r.file == f and r.kind == "record" for r in got) == counts[f]
    for f in (0, 1):  # every record whose bytes cannot be read as they were, and no other
        ours, theirs = gzip.decompress(parts[f].read_bytes()), unpacked((copy / parts[f].name).read_bytes())[0]
        rows = index(files_of(spark, path)).where(f"file = {f}").collect()
        want = {r.start for r in rows if ours[r.start: r.start + r.length] != theirs[r.start: r.start + r.length]}
        assert {r.start for r in got if r.file == f and r.kind == "record"} == want and want
    marked = fixity(spark, path, files_of(spark, str(copy)))
    assert marked.where("not intact").count() == sum(r.kind == "record" for r in got)


def test_equal_replica_has_no_findings(spark):
    path = write_warc(pages(spark))
    assert findings(spark, path, files_of(spark, path)).count() == 0


def test_tree_hashes(spark):
    leaves = spark.createDataFrame([(0, i, hashlib.sha256(bytes([i])).digest()) for i in range(40)], "file int, node long, hash binary")
    levels = tree(leaves, "t")
    assert [x.count() for x in levels] == [40, 3, 1, 1]
    hashes = [hashlib.sha256(bytes([i])).digest() for i in range(40)]
    up = [hashlib.sha256(b"\1" + b"".join(hashes[k:k + 16])).digest() for k in range(0, 40, 16)]
    assert [bytes(r.hash) for r in levels[1].orderBy("node").collect()] == up
    assert audit(levels, levels).count() == 0


def test_empty(spark):
    path = write_warc(spark.createDataFrame([], "page_id long, url string, html string"))
    assert fixity(spark, path, files_of(spark, path)).count() == 0
