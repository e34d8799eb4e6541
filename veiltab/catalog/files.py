"""Sources and sinks: written from the given tables and read back."""
from __future__ import annotations

from pyspark.sql import functions as F

from veiltab.catalog.registry import query
from veiltab.functions.hashing import uniform
from veiltab.plans.views import subject, table, u_sql, with_sql
from veiltab.sources import files as S


@query("read_string_csv", """
SELECT c_custkey::VARCHAR AS c_custkey, CASE WHEN c_custkey%5=0 THEN '' ELSE c_mktsegment END AS segment, c_nationkey::VARCHAR AS nation FROM customer""")
def _(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("segment"),
                                            F.col("c_nationkey").alias("nation"))
    path = S.scratch_folder(spark)
    S.write_csv(c, path)
    return S.read_string_csv(spark, path)


@query("read_typed_csv", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def _(spark, sf):
    path = S.scratch_folder(spark)
    S.write_csv(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path)
    return S.read_typed_csv(spark, path, "o_orderkey bigint, o_orderstatus string, o_totalprice double")


@query("write_csv", "SELECT vec_id::VARCHAR AS vec_id, printf('%.2f', round(embedding[1]::DOUBLE*100,2)) AS first FROM embeddings")
def _(spark, sf):
    path = S.scratch_folder(spark)
    S.write_csv(table(spark, sf, "embeddings").select("vec_id", (F.col("embedding")[0].cast("double") * 100).alias("first")), path, decimals=2)
    return S.read_string_csv(spark, path)


@query("membership_round_trip", """
SELECT row_number() OVER (ORDER BY c_custkey)-1 AS row_id, CAST(c_nationkey%4=0 AS INT) AS member FROM customer""")
def _(spark, sf):
    path = S.scratch_folder(spark)
    marks = table(spark, sf, "customer").select(F.col("c_custkey").alias("row_id"), (F.col("c_nationkey") % 4 == 0).cast("int").alias("mark"))
    S.write_membership(marks, path)
    n = table(spark, sf, "customer").count()
    return S.read_membership(spark, [path + "-absent", path], expected=n)


RELEASES = ["r1", "r2", "r3", "r4"]


@query("release_matrix", with_sql(f"""
SELECT row_id, CAST({u_sql('mem/r1')}<0.1 AS INT) AS r1, NULL::INT AS r2, 0 AS r3, 0 AS r4 FROM subject"""))
def _(spark, sf):
    ids = subject(spark, sf).select("row_id")
    long = ids.select("row_id", F.explode(F.array(*[F.lit(r) for r in RELEASES[:3]])).alias("release_id")).withColumn(
        "member", (uniform(F.concat(F.lit("mem/"), F.col("release_id")), "row_id") < 0.1).cast("int")).filter("member = 1")
    return S.release_matrix(long, ids, RELEASES, own="r2", zero=["r3"])


@query("pick_vector", with_sql(f"""
SELECT row_id, CASE WHEN row_id%3=0 THEN CAST({u_sql('pv/a')}<0.3 AS INT) WHEN row_id%3=1 THEN CAST({u_sql('pv/b')}<0.3 AS INT) ELSE 0 END AS member FROM subject"""))
def _(spark, sf):
    ids = subject(spark, sf).select("row_id")
    mix = ids.filter("row_id % 3 = 0").withColumn("member", (uniform("pv/a") < 0.3).cast("int"))
    only = ids.filter("row_id % 3 < 2").withColumn("member", (uniform("pv/b") < 0.3).cast("int"))
    return S.pick_vector({"mix": mix, "distance": only}, ids)


DOCS = "CASE WHEN event_id%10=3 THEN '{' WHEN event_id%10=4 THEN '{\"k\": \"5\", \"n\": [1]}' WHEN event_id%10=5 THEN '{\"k\": 0}' ELSE props END"
RULES_SQL = f"""d0 AS (SELECT event_id, {DOCS} AS doc FROM events), d AS (SELECT event_id, CASE WHEN json_valid(doc) THEN doc END AS doc FROM d0),
v AS (SELECT event_id, 'document' AS rule, 'error' AS level, doc IS NOT NULL AS ok FROM d
 UNION ALL SELECT event_id, 'required $.k', 'error', json_type(doc,'$.k') IS NOT NULL FROM d
 UNION ALL SELECT event_id, 'bigint $.k', 'warning', json_type(doc,'$.k') IN ('UBIGINT','BIGINT') FROM d
 UNION ALL SELECT event_id, 'positive integer $.k', 'error', TRY_CAST(json_extract_string(doc,'$.k') AS BIGINT)>0 FROM d
 UNION ALL SELECT event_id, 'non-empty list $.n', 'warning', json_array_length(doc,'$.n')>=1 FROM d)"""


def documents(spark, sf):
    k = F.col("event_id") % 10
    return table(spark, sf, "events").select("event_id", F.when(k == 3, "{").when(k == 4, '{"k": "5", "n": [1]}').when(
        k == 5, '{"k": 0}').otherwise(F.col("props")).alias("doc"))


def rules():
    j = S.Json("doc")
    n = j.filled_list("$.n")
    return [j.parses(), j.required("$.k"), j.is_type("$.k", "BIGINT", "warning"), j.positive_int("$.k"),
            S.rule("non-empty list $.n", n.getField("ok"), "warning")]


@query("json_document_check", f"WITH {RULES_SQL} SELECT event_id, rule, level FROM v WHERE NOT coalesce(ok,false)")
def _(spark, sf):
    return S.json_document_check(documents(spark, sf), "event_id", rules())


@query("json_document_ok", f"""WITH {RULES_SQL} SELECT event_id, count(CASE WHEN level='error' AND NOT coalesce(ok,false) THEN 1 END)::INT AS n_errors,
 count(CASE WHEN level='warning' AND NOT coalesce(ok,false) THEN 1 END)::INT AS n_warnings,
 CAST(count(CASE WHEN level='error' AND NOT coalesce(ok,false) THEN 1 END)=0 AS INT) AS ok FROM v GROUP BY 1""")
def _(spark, sf):
    return S.json_document_ok(documents(spark, sf), "event_id", rules())
