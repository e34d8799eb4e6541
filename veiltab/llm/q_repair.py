"""Query on conversation repair: conversations are damaged by a hash of conversation and turn, and repaired."""
from pyspark.sql import functions as F

from veiltab.llm.repair import EMPTY_SHA, digest, repair


def damaged(rows):
    """Of 20 equally likely draws: 0 drops a row, 1 empties it, 2 takes its sentence ends, 3 repeats it, 4 gives it to the user."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    drawn = rows.withColumn("_draw", F.crc32(key.cast("binary")) % 20).where("_draw <> 0")
    hurt = drawn.select("conv_id", "turn", F.when(F.col("_draw") == 4, "user").otherwise(role).alias("role"),
                        F.when(F.col("_draw") == 1, "").when(F.col("_draw") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), "_draw")
    return hurt.withColumn("_again", F.explode(F.when(F.col("_draw") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("_draw", "_again")


def op11_auction_repair(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = digest(repair(damaged(rows))).withColumnRenamed("conv_id", "_c")
    every = rows.groupBy("conv_id").agg(F.lit(1).alias("_one")).join(found, F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    return every.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY_SHA)).alias("repaired_sha256"))


OP11_SQL = r"""
WITH RECURSIVE z AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')) AS h FROM conversations),
c AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(h), 2), lambda i: CAST('0x' || substr(h, i + 1, 2) AS BIGINT))),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS d FROM k, z),
h AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
      unnest(CASE WHEN d = 3 THEN [1, 2] ELSE [1] END) AS again FROM c WHERE d <> 0),
o AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS core FROM h),
f AS (SELECT conv_id, turn, role, text, i, left(role, 1) AS ini, CASE WHEN core = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
      WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM o),
nxt(s, t, name) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
del(ini, s, t) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
clo(s, t, cost, let, body) AS (SELECT unnest([0, 1, 2, 3]), unnest([0, 1, 2, 3]), 0, '', '' UNION ALL SELECT s, t, 3, 'I', chr(10) || name || ':' FROM nxt
      UNION ALL SELECT s, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:' FROM nxt WHERE s < 2),
step AS (SELECT conv_id, i, s, t, 4 AS cost, 'D' AS let, '' AS body FROM f, (SELECT unnest([0, 1, 2, 3]) AS s, unnest([0, 1, 2, 3]) AS t)
      UNION ALL SELECT conv_id, i, s, t, CASE fault WHEN 't' THEN 3 ELSE 0 END, 'K', chr(10) || role || ':' || text FROM f JOIN del ON f.ini = del.ini WHERE fault IN ('', 't')
      UNION ALL SELECT conv_id, i, s, t, CASE fault WHEN 't' THEN 6 ELSE 3 END, 'R', chr(10) || name || ':' || text FROM f, nxt WHERE fault IN ('', 't')),
p AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, t AS s, {'c': clo.cost, 'a': let, 'b': body} AS v FROM (SELECT DISTINCT conv_id FROM f), clo WHERE s = 0
      UNION ALL SELECT p.conv_id, step.i, clo.t, min({'c': p.v.c + step.cost + clo.cost, 'a': p.v.a || step.let || clo.let, 'b': p.v.b || step.body || clo.body})
      FROM p JOIN step ON p.conv_id IS NOT DISTINCT FROM step.conv_id AND step.i = p.i + 1 AND step.s = p.s JOIN clo ON clo.s = step.t GROUP BY p.conv_id, step.i, clo.t),
g AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
      count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE i > 1 AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
e AS (SELECT g.conv_id, gaps, blank, duplicate, truncated, illegal, min(v) AS v FROM g JOIN p ON g.conv_id IS NOT DISTINCT FROM p.conv_id AND g.n = p.i AND p.s IN (0, 3) GROUP BY ALL)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(v.c, 0) AS BIGINT) AS cost, coalesce(v.a, '') AS audit, sha256(coalesce(substr(v.b, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN e ON a.conv_id IS NOT DISTINCT FROM e.conv_id
"""
QUERIES = {"op11_auction_repair": (op11_auction_repair, OP11_SQL)}
