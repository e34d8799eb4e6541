"""Person-level views over the driver tables, in DataFrame form and as SQL text.

``subject`` plays the population, ``release`` a noised sample of it, ``scores`` the output
of a fixed-coefficient model. The SQL text is what the correctness gate runs elsewhere.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veiltab.functions.hashing import SEED, integer_between, uniform
from veiltab.session import materialize

NUMERIC = ["age", "n_orders", "n_items", "n_returns", "n_suppliers",
           "avg_price", "avg_qty", "avg_disc", "balance"]
COUNTS = ["n_orders", "n_items", "n_returns", "n_suppliers"]
FLAGS = ["urgent_flag", "pending_flag", "big_flag", "return_flag"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
AGE_EDGES = [0, 18, 45, 65, 75]
AGE_LABELS = ["0-17", "18-44", "45-64", "65-74", "75+"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem")
    o = orders.groupBy(F.col("o_custkey").alias("o_cust")).agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.avg("o_totalprice").alias("avg_price"),
        F.max("o_totalprice").alias("max_price"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n_urgent"),
        F.count_if(F.col("o_orderstatus") == "P").alias("n_pending"),
    )
    l = (
        lines.join(orders.select("o_orderkey", "o_custkey"),
                   F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_custkey").alias("l_cust"))
        .agg(
            F.count(F.lit(1)).alias("n_items"),
            F.avg("l_quantity").alias("avg_qty"),
            F.avg("l_discount").alias("avg_disc"),
            F.count_if(F.col("l_returnflag") == "R").alias("n_returns"),
            F.count_distinct("l_suppkey").alias("n_suppliers"),
        )
    )
    places = (
        table(spark, sf_dir, "nation")
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_nationkey", "n_name", "r_name")
    )

    def whole(c: str):
        return F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c)

    def flag(cond, name):
        return F.when(cond, 1).otherwise(0).alias(name)

    people = (
        table(spark, sf_dir, "customer")
        .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(o, F.col("c_custkey") == F.col("o_cust"), "left")
        .join(l, F.col("c_custkey") == F.col("l_cust"), "left")
    )
    return people.select(
        F.col("c_custkey").alias("row_id"),
        F.floor((F.col("c_acctbal") + 1000) / 100).cast("int").alias("age"),
        F.col("c_mktsegment").alias("segment"), F.col("r_name").alias("region"),
        F.col("n_name").alias("nation"),
        whole("n_orders"), whole("n_items"), whole("n_returns"), whole("n_suppliers"),
        "avg_price", "avg_qty", "avg_disc", F.col("c_acctbal").alias("balance"),
        flag(F.coalesce("n_urgent", F.lit(0)) >= 3, "urgent_flag"),
        flag(F.coalesce("n_pending", F.lit(0)) >= 4, "pending_flag"),
        flag(F.coalesce("max_price", F.lit(0.0)) > 490000, "big_flag"),
        flag(F.coalesce("n_returns", F.lit(0)) >= 17, "return_flag"),
    )


def release(spark: SparkSession, sf_dir: str, share: float = 0.3, people: DataFrame | None = None) -> DataFrame:
    """A hash sample of ``subject`` (``people``, where it is written already) with small noise; ``src_id`` is the hidden truth."""
    s = (subject(spark, sf_dir) if people is None else people).filter(uniform("member") < share)
    return s.select(
        F.col("row_id").alias("src_id"),
        F.least(F.greatest(F.col("age") + integer_between(-2, 2, "age"), F.lit(2)),
                F.lit(110)).alias("age"),
        "segment", "region",
        F.greatest(F.col("n_orders") + integer_between(-1, 1, "ord"), F.lit(0)).alias("n_orders"),
        F.greatest(F.col("n_items") + integer_between(-5, 5, "itm"), F.lit(0)).alias("n_items"),
        (F.col("avg_price") * (1 + (uniform("prc") - 0.5) * 0.02)).alias("avg_price"),
        "avg_qty",
        F.when(uniform("urg") < 0.03, 1 - F.col("urgent_flag"))
        .otherwise(F.col("urgent_flag")).alias("urgent_flag"),
        "pending_flag",
    )


def subject_and_release(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Both views written once, for queries that go over them many times."""
    people = materialize(subject(spark, sf_dir), "subject")
    return people, materialize(release(spark, sf_dir, people=people), "release")


def scores(spark: SparkSession, sf_dir: str, people: DataFrame | None = None) -> DataFrame:
    """Label and probability of a fixed logistic formula."""
    z = (-1.1 + 0.004 * F.col("age") + 0.06 * F.col("n_orders")
         + 0.01 * F.col("n_returns") - 0.02 * F.col("n_suppliers"))
    return (subject(spark, sf_dir) if people is None else people).select(
        "row_id", F.col("urgent_flag").alias("y"), F.round(1 / (1 + F.exp(-z)), 12).alias("p"))


def blanked(df: DataFrame, cols: list[str], share: float = 0.05) -> DataFrame:
    """Remove values at hashed places, to exercise missing-value handling."""
    return df.withColumns({
        c: F.when(uniform("blank/" + c) >= share, F.col(c)) for c in cols})


# ---------------------------------------------------------------- SQL text

def u_sql(salt: str, row_id: str = "row_id", seed: int = SEED) -> str:
    return (f"(('0x'||substr(md5(concat_ws('|','{seed}','{salt}',({row_id})::varchar)),1,8))"
            f"::bigint/4294967296.0::double)")


def gauss_sql(salt: str, row_id: str = "row_id") -> str:
    return (f"(sqrt(-2.0*ln(greatest({u_sql(salt + '/r', row_id)},1.0/4294967296)))"
            f"*cos(2*pi()*{u_sql(salt + '/t', row_id)}))")


def int_sql(lo: int, hi: int, salt: str, row_id: str = "row_id") -> str:
    return f"({lo}+CAST(floor({u_sql(salt, row_id)}*{hi - lo + 1}) AS INT))"


SUBJECT_SQL = """_o AS (SELECT o_custkey, count(*) AS n_orders, avg(o_totalprice) AS avg_price,
    max(o_totalprice) AS max_price,
    sum(CASE WHEN o_orderpriority='1-URGENT' THEN 1 ELSE 0 END) AS n_urgent,
    sum(CASE WHEN o_orderstatus='P' THEN 1 ELSE 0 END) AS n_pending
  FROM orders GROUP BY o_custkey),
_l AS (SELECT o_custkey, count(*) AS n_items, avg(l_quantity) AS avg_qty, avg(l_discount) AS avg_disc,
    sum(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END) AS n_returns,
    count(DISTINCT l_suppkey) AS n_suppliers
  FROM lineitem JOIN orders ON l_orderkey=o_orderkey GROUP BY o_custkey),
subject AS (SELECT c_custkey AS row_id, CAST(floor((c_acctbal+1000)/100) AS INT) AS age,
  c_mktsegment AS segment, r_name AS region, n_name AS nation,
  CAST(coalesce(n_orders,0) AS INT) AS n_orders, CAST(coalesce(n_items,0) AS INT) AS n_items,
  CAST(coalesce(n_returns,0) AS INT) AS n_returns, CAST(coalesce(n_suppliers,0) AS INT) AS n_suppliers,
  avg_price, avg_qty, avg_disc, c_acctbal AS balance,
  CASE WHEN coalesce(n_urgent,0)>=3 THEN 1 ELSE 0 END AS urgent_flag,
  CASE WHEN coalesce(n_pending,0)>=4 THEN 1 ELSE 0 END AS pending_flag,
  CASE WHEN coalesce(max_price,0)>490000 THEN 1 ELSE 0 END AS big_flag,
  CASE WHEN coalesce(n_returns,0)>=17 THEN 1 ELSE 0 END AS return_flag
FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey
LEFT JOIN _o ON c_custkey=_o.o_custkey LEFT JOIN _l ON c_custkey=_l.o_custkey)"""

RELEASE_SQL = f"""release AS (SELECT row_id AS src_id,
  least(greatest(age + {int_sql(-2, 2, 'age')}, 2), 110) AS age, segment, region,
  greatest(n_orders + {int_sql(-1, 1, 'ord')}, 0) AS n_orders,
  greatest(n_items + {int_sql(-5, 5, 'itm')}, 0) AS n_items,
  avg_price*(1 + ({u_sql('prc')}-0.5)*0.02) AS avg_price, avg_qty,
  CASE WHEN {u_sql('urg')} < 0.03 THEN 1-urgent_flag ELSE urgent_flag END AS urgent_flag, pending_flag
FROM subject WHERE {u_sql('member')} < 0.3)"""

SCORES_SQL = """scores AS (SELECT row_id, urgent_flag AS y,
  round(1/(1+exp(-(-1.1 + 0.004*age + 0.06*n_orders + 0.01*n_returns - 0.02*n_suppliers))),12) AS p
FROM subject)"""

AGE_GROUP_SQL = ("CASE WHEN age<0 THEN NULL WHEN age<18 THEN '0-17' WHEN age<45 THEN '18-44' "
                 "WHEN age<65 THEN '45-64' WHEN age<75 THEN '65-74' ELSE '75+' END")


def blank_sql(cols: list[str], keep: list[str], share: float = 0.05, source="subject") -> str:
    parts = [f"CASE WHEN {u_sql('blank/' + c)} >= {share} THEN {c} END AS {c}" for c in cols]
    return f"blanked AS (SELECT {', '.join(keep + parts)} FROM {source})"


def with_sql(body: str, *ctes: str) -> str:
    """``WITH`` chain; ``subject`` always comes first."""
    return "WITH " + ",\n".join([SUBJECT_SQL, *ctes]) + "\n" + body


# ---------------------------------------------------------------- person view

PERSON_EXPRS = {
    "row_id": "row_id", "AGE": "age",
    "GENDER": "CASE WHEN row_id%40=0 THEN 'O' WHEN row_id%40=1 THEN 'U' WHEN row_id%2=0 THEN 'M' ELSE 'F' END",
    "RACE": "CASE WHEN row_id%97=0 THEN 'hawaiian' WHEN row_id%53=0 THEN 'native' WHEN region='AFRICA' THEN 'black' "
            "WHEN region='ASIA' THEN 'asian' WHEN region='MIDDLE EAST' THEN 'other' ELSE 'white' END",
    "ETHNICITY": "CASE WHEN row_id%15=0 THEN 'hispanic' WHEN row_id%40=7 THEN 'unknown' ELSE 'nonhispanic' END",
    "encounter_count": "4+n_orders*3", "num_procedures": "CASE WHEN row_id%31<>0 THEN n_items END",
    "num_medications": "n_returns*2", "num_immunizations": "n_suppliers", "num_allergies": "n_orders%4",
    "num_devices": "n_items%3", "mean_systolic_bp": "round(CAST(90+n_items*1.1+age*0.2 AS DOUBLE),1)",
    "mean_diastolic_bp": "round(CAST(50+n_items*0.6 AS DOUBLE),1)", "mean_weight": "round(CAST(40+n_suppliers*1.7 AS DOUBLE),1)",
    "mean_bmi": "CASE WHEN row_id%20<>3 THEN round(CAST(15+n_returns*0.9 AS DOUBLE),1) END",
    "asthma_flag": "urgent_flag", "stroke_flag": "return_flag", "obesity_flag": "big_flag",
    "depression_flag": "CASE WHEN row_id%120=0 THEN 1 ELSE 0 END",
}
PERSON_SQL = "person AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in PERSON_EXPRS.items()) + " FROM subject)"


def person(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subject view in the person-table columns that the recipes expect."""
    return subject(spark, sf_dir).selectExpr(*[f"{e} AS {c}" for c, e in PERSON_EXPRS.items()])
