"""Query on WARC fixity: pages are written as WARC files and audited against a replica in which one record in 256 has a flipped bit."""
import hashlib

from veiltab.llm.warc import files_of, fixity, write_warc


def bit_rot(data: bytes, page_id: int | None) -> bytes:
    """Flip a bit in the middle of records whose id hashes to 5a."""
    if hashlib.md5(str(page_id).encode()).hexdigest()[:2] != "5a" or not data:
        return data
    at = len(data) // 2
    return data[:at] + bytes([data[at] ^ 1]) + data[at + 1:]


def op2_warc_fixity(spark, sf_dir):
    path = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return fixity(spark, path, files_of(spark, path), bit_rot)


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, CASE WHEN url IS NULL THEN '' ELSE 'WARC-Target-URI: ' || translate(url, chr(13) || chr(10), '  ') || chr(13) || chr(10) END AS target FROM pages),
r AS (SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || target
      || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(body) || chr(13) || chr(10) || chr(13) || chr(10) || body
      || chr(13) || chr(10) || chr(13) || chr(10) AS rec FROM p)
SELECT page_id, CAST(sum(strlen(rec)) OVER (ORDER BY page_id) - strlen(rec) AS BIGINT) AS start, CAST(strlen(rec) AS BIGINT) AS length, sha256(rec) AS sha256,
       substr(md5(CAST(page_id AS VARCHAR)), 1, 2) <> '5a' AS intact FROM r
"""
QUERIES = {"op2_warc_fixity": (op2_warc_fixity, OP2_SQL)}
