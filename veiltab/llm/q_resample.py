"""Query on importance resampling."""
from veiltab.llm.resample import resample


def op12_importance_radix(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return resample(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))


OP12_SQL = r"""
WITH z AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
w AS (SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
      UNION ALL SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
x AS (SELECT side, id, unnest(ws) AS word FROM w),
n AS (SELECT side, id, word, count(*) AS n FROM x GROUP BY ALL),
u AS (SELECT DISTINCT word, hex(word) AS h FROM n),
k AS (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(h), 2), lambda i: CAST('0x' || substr(h, i + 1, 2) AS BIGINT))),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM u, z),
c AS (SELECT bucket, sum(n) FILTER (WHERE side = 'd') AS s, sum(n) FILTER (WHERE side = 'b') AS t FROM n JOIN k USING (word) GROUP BY bucket),
a AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM c),
g AS (SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * (s_all + 10000) AS DOUBLE) / CAST((coalesce(s, 0) + 1) * (t_all + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM c, a),
p AS (SELECT id, CAST(sum(n.n * gain) AS BIGINT) AS weight FROM n JOIN k USING (word) JOIN g USING (bucket) WHERE side = 'd' GROUP BY id),
f AS (SELECT w.id AS doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
      coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || w.id), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score FROM w LEFT JOIN p ON w.id = p.id WHERE side = 'd'),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS eligible FROM f)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * eligible // 100 THEN place END AS rank FROM r
"""
QUERIES = {"op12_importance_radix": (op12_importance_radix, OP12_SQL)}
