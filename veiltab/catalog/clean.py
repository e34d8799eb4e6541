"""Casts, normalisers, bins, scaling and imputing."""
from __future__ import annotations

from pyspark.sql import functions as F

from veiltab import schema
from veiltab.catalog.profile import GROUPED_SQL, grouped
from veiltab.catalog.registry import query, rounded
from veiltab.functions import clean
from veiltab.functions.hashing import uniform
from veiltab.operators import scale as S
from veiltab.plans.views import (AGE_GROUP_SQL, RELEASE_SQL, SCORES_SQL, blank_sql, blanked, release,
                                 scores, subject, table, u_sql, with_sql)

KEYWORDS = [("cust", "customer"), ("supp", "supplier"), ("a", "has_a"), ("null", "unknown")]


@query("to_number", """
SELECT event_id, TRY_CAST(trim(CASE WHEN event_id%7=0 THEN '' WHEN event_id%11=0 THEN 'n/a' ELSE ' '||event_type||'' END) AS DOUBLE) AS bad,
  TRY_CAST(trim(' '||(event_id%50)::VARCHAR||' ') AS DOUBLE) AS good FROM events""")
def _(spark, sf):
    e = table(spark, sf, "events")
    text = F.when(F.col("event_id") % 7 == 0, "").when(F.col("event_id") % 11 == 0, "n/a").otherwise(
        F.concat(F.lit(" "), "event_type"))
    return e.select("event_id", clean.to_number(text).alias("bad"),
                    clean.to_number(F.concat(F.lit(" "), (F.col("event_id") % 50).cast("string"), F.lit(" "))).alias("good"))


@query("norm_flag", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber IN (0,1) THEN l_linenumber END AS flag FROM lineitem")
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", clean.norm_flag("l_linenumber").alias("flag"))


@query("norm_gender", """
SELECT c_custkey, CASE WHEN starts_with(t,'m') THEN 'M' WHEN starts_with(t,'f') THEN 'F'
  WHEN t='o' OR starts_with(t,'oth') THEN 'O' ELSE 'U' END AS gender
FROM (SELECT c_custkey, lower(trim(c_mktsegment)) AS t FROM customer) z""")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", clean.norm_gender("c_mktsegment").alias("gender"))


@query("norm_keyword_map", "SELECT n_nationkey, CASE " + " ".join(
    f"WHEN contains(lower(trim(n_name)),'{w}') THEN '{v}'" for w, v in
    [("an", "an"), ("i", "i"), ("u", "u")]) + " ELSE 'unknown' END AS level FROM nation")
def _(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", clean.norm_keyword_map(
        "n_name", [("an", "an"), ("i", "i"), ("u", "u")]).alias("level"))


# One race description per nation key modulo 8, for the default keyword table.
RACE_TEXT = ["Asian", " black or african ", "White", "Native Hawaiian", "native american", "OTHER", "null", "?"]


@query("norm_race", "SELECT c_custkey, CASE c_nationkey%8 WHEN 0 THEN 'asian' WHEN 1 THEN 'black' WHEN 2 THEN 'white' "
       "WHEN 3 THEN 'hawaiian' WHEN 4 THEN 'native' WHEN 5 THEN 'other' ELSE 'unknown' END AS race FROM customer")
def _(spark, sf):
    text = F.element_at(F.array(*[F.lit(t) for t in RACE_TEXT]), (F.col("c_nationkey") % 8 + 1).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", clean.norm_keyword_map(text).alias("race"))


@query("norm_ethnicity", """
SELECT c_custkey, CASE WHEN t LIKE '%non%' OR t LIKE '%not%' THEN 'nonhispanic' WHEN t LIKE '%hisp%' THEN 'hispanic'
  ELSE 'unknown' END AS ethnicity FROM (SELECT c_custkey, CASE c_nationkey%4 WHEN 0 THEN 'hispanic or latino'
  WHEN 1 THEN 'not hispanic' WHEN 2 THEN 'nonhispanic' ELSE c_mktsegment END AS t FROM customer) z""")
def _(spark, sf):
    k = F.col("c_nationkey") % 4
    t = (F.when(k == 0, "Hispanic or Latino").when(k == 1, " Not Hispanic").when(k == 2, "nonhispanic")
         .otherwise(F.col("c_mktsegment")))
    return table(spark, sf, "customer").select("c_custkey", clean.norm_ethnicity(t).alias("ethnicity"))


@query("clean_category", with_sql(
    "SELECT row_id, coalesce(nullif(lower(trim(segment)),''),'___missing___') AS segment FROM blanked",
    blank_sql(["segment"], ["row_id"])))
def _(spark, sf):
    return blanked(subject(spark, sf), ["segment"]).select("row_id", clean.clean_category("segment").alias("segment"))


@query("column_lookup_ci", "SELECT c_custkey AS id, c_acctbal AS balance, 1::BIGINT AS n_not_found FROM customer")
def _(spark, sf):
    c = table(spark, sf, "customer")
    found, missing = schema.resolve_columns(c, ["C_CUSTKEY", " c_AcctBal ", "absent"])
    return c.select(F.col(found["C_CUSTKEY"]).alias("id"), F.col(found[" c_AcctBal "]).alias("balance"),
                    F.lit(len(missing)).cast("long").alias("n_not_found"))


@query("add_missing_columns", "SELECT r_regionkey, r_name, NULL::DOUBLE AS mean_bmi FROM region")
def _(spark, sf):
    return schema.add_missing_columns(table(spark, sf, "region"), {"mean_bmi": "double", "R_NAME": "string"})


@query("range_clip", "SELECT c_custkey, least(greatest(c_acctbal,0.0),5000.0) AS balance FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", clean.range_clip("c_acctbal", 0.0, 5000.0).alias("balance"))


@query("age_bin", with_sql(f"""
SELECT row_id, {AGE_GROUP_SQL} AS left_closed,
  CASE WHEN age>=0 AND age<=10 THEN '0-10' WHEN age<=20 THEN '11-20' WHEN age<=30 THEN '21-30' WHEN age<=200 THEN '31+' END AS right_closed,
  CAST(floor(age/5) AS INT) AS five_year FROM subject"""))
def _(spark, sf):
    edges, labels = clean.open_bins([0, 18, 45, 65, 75, 200])
    return subject(spark, sf).select(
        "row_id", clean.bin_label("age", edges, labels).alias("left_closed"),
        clean.bin_label("age", [0, 10, 20, 30, 200], ["0-10", "11-20", "21-30", "31+"],
                        right=True, include_lowest=True).alias("right_closed"),
        clean.bin_index("age", list(range(0, 125, 5))).alias("five_year"))


@query("group_rare_named", with_sql(
    "SELECT row_id, CASE WHEN region IN ('AFRICA','MIDDLE EAST') THEN 'OTHER' ELSE region END AS region FROM subject"))
def _(spark, sf):
    return subject(spark, sf).select("row_id", clean.group_named("region", ["AFRICA", "MIDDLE EAST"], "OTHER").alias("region"))


@query("coarsen_rare_levels", with_sql("""
SELECT row_id, CASE WHEN n>=60 THEN nation ELSE 'other' END AS nation FROM subject
JOIN (SELECT nation, count(*) AS n FROM subject GROUP BY 1) z USING (nation)"""))
def _(spark, sf):
    return S.coarsen_rare_levels(subject(spark, sf).select("row_id", "nation"), "nation", 60)


@query("bmi_category", with_sql("""
SELECT row_id, CASE WHEN avg_qty IS NULL THEN NULL WHEN age<18 THEN 'child' WHEN avg_qty<18.5 THEN 'underweight'
 WHEN avg_qty<25 THEN 'normal' WHEN avg_qty<30 THEN 'overweight' ELSE 'obese' END AS category FROM subject"""))
def _(spark, sf):
    return subject(spark, sf).select("row_id", clean.bmi_category("avg_qty", "age").alias("category"))


def _sel(names, expr):
    return ", ".join(f"round({expr.format(c=c)},6) AS {c}" for c in names)


PAIR = ["age", "n_orders", "n_items", "avg_price"]


@query("minmax_scale", with_sql("SELECT row_id, " + _sel(
    PAIR, "({c}-(SELECT min({c}) FROM subject))/((SELECT max({c}) FROM subject)-(SELECT min({c}) FROM subject))::DOUBLE") + " FROM subject"))
def _(spark, sf):
    return rounded(S.minmax_scale(subject(spark, sf), PAIR).select("row_id", *PAIR))


def _pair(fn, spark, sf, cols=PAIR):
    a, c = blanked(subject(spark, sf), ["avg_price"]), release(spark, sf)
    got = fn(a, c, cols)
    a2, c2 = got[0], got[1]
    return rounded(a2.select(F.lit("A").alias("side"), "row_id", *cols).unionByName(
        c2.select(F.lit("C").alias("side"), F.col("src_id").alias("row_id"), *cols)))


PAIR_BASE = [blank_sql(["avg_price"], ["row_id", "age", "n_orders", "n_items"]), RELEASE_SQL]


def _pair_sql(expr_a: str, expr_c: str, *ctes: str) -> str:
    return with_sql(f"SELECT 'A' AS side, row_id, {_sel(PAIR, expr_a)} FROM blanked\n"
                    f"UNION ALL SELECT 'C', src_id, {_sel(PAIR, expr_c)} FROM release", *PAIR_BASE, *ctes)


MM = ("coalesce(({c}-(SELECT min({c}) FROM blanked))/((SELECT max({c}) FROM blanked)-(SELECT min({c}) FROM blanked))::DOUBLE,"
      "((SELECT median({c}) FROM blanked)-(SELECT min({c}) FROM blanked))/((SELECT max({c}) FROM blanked)-(SELECT min({c}) FROM blanked))::DOUBLE)")


@query("minmax_scale_pair", _pair_sql(MM, MM))
def _(spark, sf):
    return _pair(S.minmax_scale_pair, spark, sf)


WINS = ("wins AS (SELECT row_id, " + ", ".join(
    f"coalesce(CASE WHEN {c} IS NOT NULL THEN least(greatest({c},(SELECT quantile_cont({c},0.01) FROM blanked)),(SELECT quantile_cont({c},0.99) FROM blanked)) END,"
    f"(SELECT median({c}) FROM blanked)) AS {c}" for c in PAIR) + " FROM blanked)")


@query("zscore_winsor_pair", _pair_sql(
    "((SELECT {c} FROM wins w WHERE w.row_id=blanked.row_id)-(SELECT avg({c}) FROM wins))/(SELECT stddev_pop({c}) FROM wins)",
    "(coalesce({c},(SELECT median({c}) FROM blanked))-(SELECT avg({c}) FROM wins))/(SELECT stddev_pop({c}) FROM wins)", WINS))
def _(spark, sf):
    return _pair(S.zscore_winsor_pair, spark, sf)


BOTH = "both_ AS (SELECT age,n_orders,n_items,avg_price FROM blanked UNION ALL SELECT age,n_orders,n_items,avg_price FROM release)"
ROB = ("(coalesce({c},(SELECT median({c}) FROM both_))-(SELECT median({c}) FROM both_))"
       "/(SELECT quantile_cont({c},0.75)-quantile_cont({c},0.25) FROM both_)")


@query("robust_scale_pair", _pair_sql(ROB, ROB, BOTH))
def _(spark, sf):
    return _pair(S.robust_scale_pair, spark, sf)


STD = "(coalesce({c},0)-(SELECT avg(coalesce({c},0)) FROM blanked))/((SELECT stddev_pop(coalesce({c},0)) FROM blanked)+1e-8)"


@query("standardise_fallback", _pair_sql(STD, STD))
def _(spark, sf):
    return _pair(S.standardise_pair, spark, sf)


ROLE_COLS = ["age", "segment", "nation", "avg_price", "urgent_flag"]


@query("infer_roles", with_sql("\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(TRY_CAST({c}::VARCHAR AS DOUBLE)) AS n_parsed, count({c}) AS n_base, "
    f"round(count(TRY_CAST({c}::VARCHAR AS DOUBLE))/count({c})::DOUBLE,6) AS share, "
    f"CASE WHEN count(TRY_CAST({c}::VARCHAR AS DOUBLE))>=0.95*count({c}) THEN 'numeric' ELSE 'categorical' END AS role FROM subject"
    for c in ROLE_COLS)))
def _(spark, sf):
    return rounded(schema.infer_roles(subject(spark, sf), ROLE_COLS))


@query("quantile_bucket", with_sql("""
SELECT row_id, CASE WHEN avg_price IS NULL THEN '__miss__' WHEN avg_price<=e1 THEN 'q0' WHEN avg_price<=e2 THEN 'q1'
 WHEN avg_price<=e3 THEN 'q2' WHEN avg_price<=e4 THEN 'q3' ELSE 'q4' END AS bucket FROM blanked,
(SELECT quantile_cont(avg_price,0.2) AS e1, quantile_cont(avg_price,0.4) AS e2, quantile_cont(avg_price,0.6) AS e3,
 quantile_cont(avg_price,0.8) AS e4 FROM blanked) e""", blank_sql(["avg_price"], ["row_id"])))
def _(spark, sf):
    b = blanked(subject(spark, sf), ["avg_price"]).select("row_id", "avg_price")
    return b.select("row_id", S.quantile_bucket("avg_price", S.quantile_edges(b, "avg_price", 5)).alias("bucket"))


@query("unit_rescale", with_sql("""
SELECT row_id, round((p-(SELECT min(p) FROM scores))/((SELECT max(p) FROM scores)-(SELECT min(p) FROM scores)+1e-12),6) AS p
FROM scores""", SCORES_SQL))
def _(spark, sf):
    return rounded(S.unit_rescale(scores(spark, sf).select("row_id", "p"), "p"))


@query("odds_vif_to_unit", with_sql("""
SELECT row_id, round(avg_qty/(1+avg_qty),6) AS odds_unit, round(CASE WHEN avg_disc IS NULL THEN 0 ELSE 1-1/greatest(avg_disc*30,1) END,6) AS vif_unit
FROM subject"""))
def _(spark, sf):
    return rounded(subject(spark, sf).select("row_id", clean.odds_to_unit("avg_qty").alias("odds_unit"),
                                             clean.vif_to_unit(F.col("avg_disc") * 30).alias("vif_unit")))


@query("l2_normalise", """
SELECT vec_id, round(list_sum(u),6) AS total, round(list_sum(list_transform(u, lambda x: x*x)),6) AS squared FROM
(SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE/(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE*y::DOUBLE)))+1e-12)) AS u
 FROM embeddings) z""")
def _(spark, sf):
    u = table(spark, sf, "embeddings").select("vec_id", clean.unit_l2("embedding").alias("u"))
    return rounded(u.select("vec_id", F.aggregate("u", F.lit(0.0), lambda s, x: s + x).alias("total"),
                            F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x).alias("squared")))


BL = ["age", "avg_price", "segment", "n_items"]
BLANKED = blank_sql(BL, ["row_id", "region", "urgent_flag", "pending_flag"]).replace(
    "THEN avg_price END", "THEN round(avg_price,7) END")


def _bl(spark, sf):
    s = subject(spark, sf).withColumn("avg_price", F.round("avg_price", 7))
    return blanked(s, BL).select("row_id", "region", "urgent_flag", "pending_flag", *BL)


@query("format_release", with_sql("""
SELECT row_id, round_even(least(greatest(coalesce(age::DOUBLE,(SELECT median(age) FROM blanked)),2),110),0)::INT AS age,
 round_even(coalesce(n_items::DOUBLE,(SELECT median(n_items) FROM blanked)),0)::INT AS n_items,
 round(round_even(coalesce(avg_price,(SELECT median(avg_price) FROM blanked)),1),1) AS avg_price,
 coalesce(segment,(SELECT segment FROM blanked WHERE segment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, segment LIMIT 1)) AS segment,
 urgent_flag, CASE WHEN pending_flag IN (0,1) THEN pending_flag ELSE 0 END AS pending_flag FROM blanked""", BLANKED))
def _(spark, sf):
    out = S.format_release(_bl(spark, sf), ["age", "n_items"], {"avg_price": 1}, ["segment"],
                           ["urgent_flag", "pending_flag"], {"age": (2, 110)})
    return out.drop("region")


@query("clip_to_range_by_bin_mean", with_sql("""
SELECT row_id, coalesce(CASE WHEN age BETWEEN 5 AND 100 THEN age::DOUBLE END,
  round_even(coalesce(m,(SELECT median(age) FROM blanked WHERE age BETWEEN 5 AND 100)),0)) AS age
FROM blanked LEFT JOIN (SELECT region, avg(age) AS m FROM blanked WHERE age BETWEEN 5 AND 100 GROUP BY 1) z USING (region)""", BLANKED))
def _(spark, sf):
    return S.clip_to_range_by_bin_mean(_bl(spark, sf), "age", F.col("region"), 5, 100).select("row_id", "age")


@query("ensure_categoricals_flags", with_sql("""
SELECT row_id, coalesce(nullif(trim(segment),''),'Unknown') AS segment,
 CASE WHEN coalesce(n_items,-1) IN (0,1) THEN n_items ELSE 0 END AS flag FROM blanked""", BLANKED))
def _(spark, sf):
    return _bl(spark, sf).select("row_id", clean.ensure_category("segment").alias("segment"),
                                 clean.ensure_flag("n_items").alias("flag"))


@query("top_code", with_sql("""
SELECT row_id, coalesce(CASE WHEN age<90 THEN age::DOUBLE WHEN age>=90 THEN 90 END, (SELECT median(age) FROM blanked)) AS age FROM blanked""", BLANKED))
def _(spark, sf):
    from veiltab.operators import fit
    b = _bl(spark, sf)
    mid = fit.medians(b, ["age"])["age"]
    return b.select("row_id", clean.top_code(F.col("age").cast("double"), 90.0, F.lit(mid)).alias("age"))


@query("group_median_impute", with_sql("""
SELECT row_id, least(greatest(round_even(coalesce(CASE WHEN n_items BETWEEN 5 AND 60 THEN n_items END, m, g, 5),0),5),60)::DOUBLE AS n_items
FROM blanked LEFT JOIN (SELECT region, segment, median(n_items) AS m FROM blanked WHERE n_items BETWEEN 5 AND 60 GROUP BY 1,2) z
 ON blanked.region=z.region AND blanked.segment=z.segment,
(SELECT median(n_items) AS g FROM blanked WHERE n_items BETWEEN 5 AND 60) q""", BLANKED))
def _(spark, sf):
    return S.group_median_impute(_bl(spark, sf), {"n_items": (5, 60)}, ["region", "segment"]).select("row_id", "n_items")


@query("hierarchical_impute", with_sql("""
SELECT row_id, round(coalesce(avg_price, a.m, b.m, g),6) AS avg_price FROM filled
LEFT JOIN (SELECT region, segment, pending_flag, median(avg_price) AS m FROM filled GROUP BY 1,2,3 HAVING count(*)>=30) a
 USING (region, segment, pending_flag)
LEFT JOIN (SELECT region, pending_flag, median(avg_price) AS m FROM filled GROUP BY 1,2 HAVING count(*)>=30) b USING (region, pending_flag),
(SELECT median(avg_price) AS g FROM filled) q""", BLANKED,
    "filled AS (SELECT row_id, region, pending_flag, coalesce(segment,'Unknown') AS segment, avg_price FROM blanked)"))
def _(spark, sf):
    b = _bl(spark, sf).withColumn("segment", clean.ensure_category("segment"))
    out = S.hierarchical_impute(b, ["avg_price"], [["region", "segment", "pending_flag"], ["region", "pending_flag"]], 30)
    return rounded(out.select("row_id", "avg_price"))
