"""Query on mixing sources to target weights."""
from pyspark.sql import functions as F

from veiltab.llm.mixing import with_copies


def op9_mix_systematic(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return with_copies(docs).select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def _draw(salt: str, *cols: str) -> str:
    parts = " || '|' || ".join([f"'{salt}'", *[f"coalesce(CAST({c} AS VARCHAR), '<null>')" for c in cols]])
    return f"(CAST('0x' || substr(md5({parts}), 1, 8) AS BIGINT) / 4294967296.0)"


OP9_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, count(*) AS n, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY source),
w AS (SELECT *, 1.0::DOUBLE + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) AS weight,
      row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s),
c AS (SELECT *, 3 * words AS cap, 3 * words / weight AS ratio FROM w),
l AS (SELECT *, (CAST(sum(words) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (SELECT *, least(CAST(cap AS DOUBLE), weight * coalesce(max(CASE WHEN level <= ratio THEN level END) OVER (), ratio)) AS target FROM l),
e AS (SELECT *, CASE WHEN words > 0 THEN least(3.0::DOUBLE, target / words) ELSE 0.0::DOUBLE END AS each FROM t),
p AS (SELECT d.doc_id, d.source, d.size, e.words, e.target, e.each,
      CAST(floor({_draw("mix/slot", "d.doc_id", "d.size")} * ceil(e.n / 4096)) AS BIGINT) AS slot FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY slot, CASE WHEN slot % 2 = 0 THEN size ELSE -size END, doc_id) AS pos FROM p)
SELECT doc_id, size, words AS source_size, target,
       CAST(floor(pos * each + {_draw("mix/offset", "source")}) - floor((pos - 1) * each + {_draw("mix/offset", "source")}) AS BIGINT) * size AS taken FROM r
"""
QUERIES = {"op9_mix_systematic": (op9_mix_systematic, OP9_SQL)}
