"""Marks, quotas, splits."""
from __future__ import annotations

from pyspark.sql import functions as F

from veiltab.catalog.registry import query
from veiltab.functions.hashing import uniform
from veiltab.operators import select as S
from veiltab.operators.metrics import neg_log_lik
from veiltab.plans.views import RELEASE_SQL, SCORES_SQL, release, scores, subject, u_sql, with_sql
from veiltab.session import materialize

NLL = "round(-(y*ln(p)+(1-y)*ln(1-p)),9)"
LOSS = f"loss AS (SELECT row_id, y, p, {NLL} AS loss, {u_sql('split')} AS u FROM scores)"


def losses(spark, sf):
    return scores(spark, sf).withColumn("loss", F.round(neg_log_lik(), 9))


TENTH = "(SELECT count(*)//10 FROM loss)"


def marked(rank: str, n: str, where: str = "true") -> str:
    return (f"(SELECT row_id FROM (SELECT row_id, row_number() OVER (ORDER BY {rank}, row_id) AS rn FROM loss "
            f"WHERE {where}) z WHERE rn<={n})")


@query("top_k_mark", with_sql(f"SELECT row_id, CAST(row_id IN {marked('loss', TENTH)} AS INT) AS mark FROM loss", SCORES_SQL, LOSS))
def _(spark, sf):
    return S.top_k_mark(losses(spark, sf), F.col("loss"), scores(spark, sf).count() // 10, largest=False).select("row_id", "mark")


@query("top_k_mark_largest", with_sql(f"SELECT row_id, CAST(row_id IN {marked('-y', 333)} AS INT) AS mark FROM loss", SCORES_SQL, LOSS))
def _(spark, sf):
    return S.top_k_mark(scores(spark, sf), F.col("y"), 333).select("row_id", "mark")


@query("nth_line_by_price", """
SELECT l_orderkey*10+l_linenumber AS line_id FROM lineitem
QUALIFY row_number() OVER (ORDER BY -l_extendedprice, l_orderkey*10+l_linenumber) <= (SELECT count(*)//3 FROM lineitem)""")
def _(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_id"), "l_extendedprice")
    return S.top_k_mark(li, F.col("l_extendedprice"), li.count() // 3, row_id="line_id").filter("mark = 1").select("line_id")


@query("nth_row_per_supplier", """
SELECT l_suppkey, l_orderkey*10+l_linenumber AS line_id FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY round(l_extendedprice,9), l_orderkey*10+l_linenumber) <= count(*) OVER (PARTITION BY l_suppkey)//3""")
def _(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        "l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_id"), "l_extendedprice")
    third = li.groupBy("l_suppkey").agg(F.floor(F.count("*") / 3).alias("n"))
    return S.top_k_mark(li, F.col("l_extendedprice"), third, False, "line_id", keys=["l_suppkey"]).filter("mark = 1").select("l_suppkey", "line_id")


@query("nth_row_by_text_id", """
SELECT l_returnflag, l_orderkey||'-'||l_linenumber AS line FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity, l_orderkey||'-'||l_linenumber) <= count(*) OVER (PARTITION BY l_returnflag)//4""")
def _(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_returnflag", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line"), "l_quantity")
    quarter = li.groupBy("l_returnflag").agg(F.floor(F.count("*") / 4).alias("n"))
    return S.top_k_mark(li, F.col("l_quantity"), quarter, False, "line", keys=["l_returnflag"]).filter("mark = 1").select("l_returnflag", "line")


@query("random_mark", with_sql(f"SELECT row_id, CAST(row_id IN {marked(u_sql('mark'), 100)} AS INT) AS mark FROM loss", SCORES_SQL, LOSS))
def _(spark, sf):
    return S.random_mark(scores(spark, sf).select("row_id"), 100)


Q1 = f"(SELECT least(round_even({TENTH}*avg(CASE WHEN p>=0.5 THEN 1.0 ELSE 0 END),0),sum(y)) FROM loss)"
Q0 = f"(SELECT least({TENTH}-round_even({TENTH}*avg(CASE WHEN p>=0.5 THEN 1.0 ELSE 0 END),0),sum(1-y)) FROM loss)"


QUOTA = (f"qt AS (SELECT row_id FROM loss WHERE row_id IN {marked('loss', Q1, 'y=1')} OR row_id IN {marked('loss', Q0, 'y=0')})")


@query("class_quota_top_k", with_sql(f"""
SELECT row_id, CAST(row_id IN (SELECT row_id FROM qt)
  OR row_id IN {marked('loss', f'(SELECT {TENTH}-count(*) FROM qt)', 'row_id NOT IN (SELECT row_id FROM qt)')} AS INT) AS mark FROM loss""",
    SCORES_SQL, LOSS, QUOTA))
def _(spark, sf):
    df = materialize(losses(spark, sf))
    return S.class_quota_top_k(df, "loss", df.count() // 10).select("row_id", "mark")


@query("force_count", with_sql(f"""
SELECT row_id, CAST(row_id IN {marked(u_sql('force'), 200, 'y=1')} AS INT) AS y FROM loss""", SCORES_SQL, LOSS))
def _(spark, sf):
    return S.force_count(scores(spark, sf).select("row_id", "y"), "y", 200)


@query("class_quota_per_release", with_sql("""
SELECT release_id, row_id, CAST(hit OR row_number() OVER (PARTITION BY release_id, hit ORDER BY loss, row_id) <= 40-t1-t0 AS INT) AS mark FROM f""", SCORES_SQL, LOSS,
    "rl AS (SELECT row_id, y, p, loss, row_id%24 AS release_id FROM loss)",
    "g AS (SELECT release_id, least(round_even(40*avg(CASE WHEN p>=0.5 THEN 1.0 ELSE 0 END),0),40) AS q1, sum(y) AS n1, sum(1-y) AS n0 FROM rl GROUP BY 1)",
    "t AS (SELECT release_id, least(q1,n1) AS t1, least(40-q1,n0) AS t0 FROM g)",
    """f AS (SELECT rl.*, t1, t0, row_number() OVER (PARTITION BY release_id, y ORDER BY loss, row_id) <= CASE WHEN y=1 THEN t1 ELSE t0 END AS hit
FROM rl JOIN t USING (release_id))"""))
def _(spark, sf):
    df = losses(spark, sf).withColumn("release_id", F.col("row_id") % 24)
    return S.class_quota_top_k(df, "loss", 40, keys=["release_id"]).select("release_id", "row_id", "mark")


@query("force_count_add", with_sql(f"""
SELECT row_id, CAST(y=1 OR row_id IN {marked(u_sql('force'), '(SELECT 700-sum(y) FROM loss)', 'y=0')} AS INT) AS y FROM loss""", SCORES_SQL, LOSS))
def _(spark, sf):
    return S.force_count(scores(spark, sf).select("row_id", "y"), "y", 700)


@query("priority_fill", with_sql(f"""
SELECT row_id, CAST(row_id IN {marked(f"CASE WHEN u<0.05 THEN 0 WHEN y=1 AND u>0.95 THEN 1 ELSE 2+{u_sql('fill')} END", 160)} AS INT) AS mark
FROM loss""", SCORES_SQL, LOSS))
def _(spark, sf):
    u = uniform("split")
    df = scores(spark, sf).withColumns({"first": (u < 0.05).cast("int"), "second": ((F.col("y") == 1) & (u > 0.95)).cast("int")})
    return S.priority_fill(df, ["first", "second"], 160).select("row_id", "mark")


@query("majority_vote", with_sql("""
SELECT row_id, CAST(y+CAST(p>=0.35 AS INT)+CAST(u<0.5 AS INT)>=2 AS INT) AS mark FROM loss""", SCORES_SQL, LOSS))
def _(spark, sf):
    df = scores(spark, sf).withColumns({"b": (F.col("p") >= 0.35).cast("int"), "c": (uniform("split") < 0.5).cast("int")})
    return S.majority_vote(df, ["y", "b", "c"]).select("row_id", "mark")


@query("stratified_split", with_sql(f"""
SELECT row_id, y, CAST(row_number() OVER (PARTITION BY y ORDER BY {u_sql('split')}, row_id)
  <= ceil(0.2*count(*) OVER (PARTITION BY y)) AS INT) AS is_test FROM loss""", SCORES_SQL, LOSS))
def _(spark, sf):
    return S.stratified_split(scores(spark, sf).select("row_id", "y"), "y", 0.2)


@query("sample_and_split", with_sql(f"""
SELECT row_id, CAST({u_sql('s/train')}<0.9 AS INT) AS is_train FROM loss WHERE {u_sql('s/keep')}<0.5""", SCORES_SQL, LOSS))
def _(spark, sf):
    return S.sample_and_split(scores(spark, sf).select("row_id"))


@query("exact_key_sample", with_sql(f"""
SELECT row_id, 'segment' AS key_column, CAST(rn<=least(50,n_a,n_c) AS INT) AS mark FROM
(SELECT row_id, segment, count(*) OVER (PARTITION BY segment) AS n_a,
 row_number() OVER (PARTITION BY segment ORDER BY {u_sql('key')}, row_id) AS rn FROM subject) a
LEFT JOIN (SELECT segment, count(*) AS n_c FROM release GROUP BY 1) c USING (segment)""", RELEASE_SQL))
def _(spark, sf):
    best, out = S.exact_key_sample(subject(spark, sf), release(spark, sf), ["segment", "region"])
    return out.select("row_id", F.lit(best).alias("key_column"), "mark")


@query("shuffle_rows", with_sql(f"""
SELECT row_number() OVER (ORDER BY {u_sql('shuffle')}, row_id) AS row_id, age, segment FROM subject"""))
def _(spark, sf):
    return S.shuffle_rows(subject(spark, sf).select("row_id", "age", "segment"))
