"""Cell-level perturbation with hashed draws."""
from __future__ import annotations

from pyspark.sql import functions as F

from veiltab.catalog.registry import query, rounded
from veiltab.functions import clean
from veiltab.operators import perturb as N
from veiltab.plans.views import (AGE_GROUP_SQL, REGIONS, blank_sql, blanked, gauss_sql, int_sql, subject,
                                 u_sql, with_sql)

COLS = ["row_id", "age", "segment", "region", "n_orders", "n_items", "n_returns", "avg_price", "balance",
        "urgent_flag", "pending_flag", "big_flag"]


def base(spark, sf):
    """Subjects with holes in a few columns; avg_price at fixed precision."""
    s = subject(spark, sf).withColumn("avg_price", F.round("avg_price", 7)).select(*COLS)
    return blanked(s, ["n_items", "avg_price", "segment"])


BASE = ("b AS (SELECT row_id, age, region, n_orders, n_returns, balance, urgent_flag, pending_flag, big_flag, "
        + ", ".join(f"CASE WHEN {u_sql('blank/' + c)} >= 0.05 THEN {e} END AS {c}" for c, e in
                    [("n_items", "n_items"), ("avg_price", "round(avg_price,7)"), ("segment", "segment")])
        + f", {AGE_GROUP_SQL} AS age_group FROM subject)")


def age_bin():
    return clean.bin_label("age", [0, 18, 45, 65, 75, float("inf")], ["0-17", "18-44", "45-64", "65-74", "75+"])


def q(body: str, *ctes: str) -> str:
    return with_sql(body, BASE, *ctes)


def mn(c, t="b"):
    return f"(SELECT min({c}) FROM {t})"


def mx(c, t="b"):
    return f"(SELECT max({c}) FROM {t})"


def top(salt: str, n: str, where: str = "true", t: str = "b") -> str:
    """Ids of the first n rows by hashed draw."""
    return (f"(SELECT row_id FROM (SELECT row_id, row_number() OVER (ORDER BY {u_sql(salt)}, row_id) AS rn "
            f"FROM {t} WHERE {where}) z WHERE rn <= {n})")


def one(name: str, c: str, expr: str, *ctes: str, digits: int | None = None):
    """Register an operator that rewrites one column."""
    shown = f"round({expr},{digits})" if digits else expr

    def add(fn):
        @query(name, q(f"SELECT row_id, {shown} AS {c} FROM b", *ctes))
        def _(spark, sf):
            out = fn(base(spark, sf)).select("row_id", c)
            return rounded(out, digits) if digits else out
        return fn
    return add


LV = "lv AS (SELECT segment AS v, count(*) AS n FROM b WHERE segment IS NOT NULL GROUP BY 1), " \
     "cum AS (SELECT v, n, sum(n) OVER (ORDER BY v)-n AS at, sum(n) OVER () AS total FROM lv), " \
     "ls AS (SELECT list_sort(list(v)) AS l FROM lv)"

one("replace_category_uniform", "segment",
    f"CASE WHEN segment IS NOT NULL AND {u_sql('segment/p')}<0.04 THEN (SELECT list_filter(l, lambda x: x<>segment)"
    f"[1+floor({u_sql('segment/v')}*(len(l)-1))::INT] FROM ls) ELSE segment END", LV)(
    lambda d: N.replace_category_uniform(d, "segment", 0.04))

one("replace_category_weighted", "segment",
    f"CASE WHEN segment IS NOT NULL AND {u_sql('segment/p')}<0.1 THEN (SELECT c.v FROM cum c, cum o, "
    f"(SELECT floor({u_sql('segment/v')}*((SELECT max(total) FROM cum)-(SELECT n FROM cum WHERE v=b.segment))) AS t0) z "
    f"WHERE o.v=b.segment AND t0+CASE WHEN t0>=o.at THEN o.n ELSE 0 END >= c.at "
    f"AND t0+CASE WHEN t0>=o.at THEN o.n ELSE 0 END < c.at+c.n) ELSE segment END", LV)(
    lambda d: N.replace_category_weighted(d, "segment", 0.1))

one("replace_value_fixed", "region",
    f"CASE WHEN region='ASIA' AND {u_sql('region/move')}<0.05 THEN 'EUROPE' WHEN region='EUROPE' AND {u_sql('region/move')}<0.03 THEN 'ASIA' ELSE region END")(
    lambda d: N.replace_value_fixed(d, "region", [("ASIA", "EUROPE", 0.05), ("EUROPE", "ASIA", 0.03)]))

one("randomise_level", "region",
    f"CASE WHEN region='ASIA' AND {u_sql('region/rnd')}<0.15 THEN CASE floor({u_sql('region/to')}*2)::INT WHEN 0 THEN 'AFRICA' ELSE 'EUROPE' END ELSE region END")(
    lambda d: N.randomise_level(d, "region", "ASIA", 0.15, ["AFRICA", "EUROPE"]))

one("merge_levels_probabilistic", "region",
    f"CASE WHEN region IN ('AFRICA','ASIA','EUROPE') AND (SELECT count(*) FROM b b2 WHERE b2.region=b.region)<=0.2*(SELECT count(*) FROM b) "
    f"THEN 'OTHER' WHEN region IN ('AFRICA','ASIA','EUROPE') AND {u_sql('region/merge')}<0.7 THEN 'OTHER' ELSE region END")(
    lambda d: N.merge_levels_probabilistic(d, "region", "OTHER", 0.2, ["AFRICA", "ASIA", "EUROPE"]))

one("remap_levels_in_order", "region",
    f"CASE WHEN r1='AMERICA' THEN CASE WHEN {u_sql('region/remap/AMERICA')}<0.8 THEN 'EUROPE' ELSE 'AMERICA' END ELSE r1 END".replace(
        "r1", f"(CASE WHEN region='ASIA' THEN CASE WHEN {u_sql('region/remap/ASIA')}<0.8 THEN 'EUROPE' ELSE 'AMERICA' END ELSE region END)"))(
    lambda d: N.remap_levels_in_order(d, "region", ["ASIA", "AMERICA"], [("EUROPE", 0.8), ("AMERICA", 0.2)]))

GAP = "gap AS (SELECT floor(count(*)*0.3)::INT - count(CASE WHEN region='ASIA' THEN 1 END) AS g FROM b)"
one("match_share", "region",
    f"CASE WHEN (SELECT g FROM gap)>0 AND row_id IN {top('region/share', '(SELECT g FROM gap)', chr(39).join(['region=', 'EUROPE', '']))} THEN 'ASIA' ELSE region END", GAP)(
    lambda d: N.match_share(d, "region", "ASIA", "EUROPE", 0.3))

one("match_share_capped", "region",
    f"CASE WHEN row_id IN {top('region/share', '(SELECT floor(count(*)*0.005) FROM b)', chr(39).join(['region=', 'EUROPE', '']))} THEN 'ASIA' ELSE region END", GAP)(
    lambda d: N.match_share(d, "region", "ASIA", "EUROPE", 0.3, cap=0.005))

NI = f"round_even(least(greatest(n_items+{int_sql(-10, 10, 'n_items/d')},{mn('n_items')}),{mx('n_items')}),0)::INT"
one("noise_int_uniform", "n_items",
    f"CASE WHEN row_id NOT IN {top('n_items/hole', '(SELECT count(*)-count(n_items) FROM b)')} THEN "
    f"CASE WHEN n_items IS NOT NULL THEN {NI} ELSE {mn('n_items')}+floor({u_sql('n_items/fill')}*({mx('n_items')}-{mn('n_items')}+1))::INT END END")(
    lambda d: N.noise_int_uniform(d, "n_items", -10, 10))
one("noise_int_keep_blanks", "n_items",
    f"CASE WHEN n_items IS NOT NULL THEN greatest(n_items+{int_sql(-3, 3, 'n_items/d')},{mn('n_items')})::INT END")(
    lambda d: N.noise_int_uniform(d, "n_items", -3, 3, blanks="keep", upper=False))
one("noise_int_positive_only", "n_returns",
    f"CASE WHEN n_returns>=1 THEN greatest(n_returns+{int_sql(-1, 1, 'n_returns/d')},1) ELSE n_returns END")(
    lambda d: N.noise_int_positive_only(d, "n_returns", -1, 1))
one("noise_age", "age", f"least(greatest(age+{int_sql(-2, 2, 'age/d')},2),110)::INT")(
    lambda d: N.noise_age(d, "age", 2))
one("noise_age_by_segment", "age",
    f"least(greatest(age+CASE WHEN age<=30 THEN {int_sql(-3, 3, 'age/d')} WHEN age<=60 THEN {int_sql(-5, 5, 'age/d')} ELSE {int_sql(-2, 2, 'age/d')} END,2),110)::INT")(
    lambda d: N.noise_age_by_segment(d, "age", [(30, 3), (60, 5), (1000, 2)]))
one("noise_age_by_bin", "age",
    f"CASE WHEN (SELECT count(*) FROM b b2 WHERE b2.age_group=b.age_group)>150 THEN least(greatest(age+{int_sql(-2, 2, 'age/d')},2),110) ELSE age END::INT")(
    lambda d: N.noise_age_by_bin(d, "age", age_bin(), 2, 2, 110, min_rows=150))
one("noise_age_sparse", "age",
    f"CASE WHEN {u_sql('age/p')}<0.02 THEN least(greatest(age+CASE WHEN {u_sql('age/v')}<0.45 THEN -1 WHEN {u_sql('age/v')}<0.55 THEN 0 ELSE 1 END,2),110) ELSE age END::INT")(
    lambda d: N.noise_sparse_choice(d, "age", 0.02, [-1, 0, 1], 2, 110, weights=[.45, .1, .45]))

FU = f"round(least(greatest(avg_price+(-5000+{u_sql('avg_price/d')}*10000),{mn('avg_price')}),{mx('avg_price')}),2)"
one("noise_float_uniform", "avg_price", f"CASE WHEN avg_price IS NOT NULL THEN {FU} END")(
    lambda d: N.noise_float_uniform(d, "avg_price", -5000, 5000))
one("noise_float_blanks_replaced", "avg_price",
    f"CASE WHEN row_id NOT IN {top('avg_price/hole', '(SELECT count(*)-count(avg_price) FROM b)')} THEN "
    f"CASE WHEN avg_price IS NOT NULL THEN {FU} ELSE round({mn('avg_price')}+{u_sql('avg_price/fill')}*({mx('avg_price')}-{mn('avg_price')}),2) END END")(
    lambda d: N.noise_float_uniform(d, "avg_price", -5000, 5000, blanks="replace"))
one("noise_proportional", "avg_price",
    f"CASE WHEN avg_price IS NOT NULL THEN round(least(greatest(avg_price*(1+{gauss_sql('avg_price/g')}*0.01),{mn('avg_price')}),{mx('avg_price')}),2) END")(
    lambda d: N.noise_proportional(d, "avg_price", 0.01))
one("noise_proportional_int", "n_items",
    f"CASE WHEN n_items IS NOT NULL THEN round_even(least(greatest(n_items*(1+{gauss_sql('n_items/g')}*0.05),{mn('n_items')}),{mx('n_items')}),0)::INT END")(
    lambda d: N.noise_proportional(d, "n_items", 0.05, digits=None))

GS = """gs AS (SELECT age_group, CASE WHEN coalesce(stddev_samp(n_items),0)=0 THEN greatest(1,avg(n_items)*0.1) ELSE stddev_samp(n_items) END AS s
 FROM b GROUP BY 1), nz AS (SELECT row_id, CASE WHEN n_items IS NOT NULL THEN round_even(least(greatest(n_items+%s*s*%s,4),70),0) END AS x
 FROM b JOIN gs USING (age_group))"""
one("noise_by_group_std", "n_items",
    "coalesce((SELECT x FROM nz WHERE nz.row_id=b.row_id), least(greatest((SELECT median(x) FROM nz),4),70)::INT)::INT",
    GS % (gauss_sql("n_items/g"), "0.05"))(
    lambda d: N.noise_by_group_std(d, {"n_items": (4, 70)}, age_bin(), 0.05))
one("noise_by_group_std_wide", "n_items",
    "coalesce((SELECT x FROM nz WHERE nz.row_id=b.row_id), least(greatest((SELECT median(x) FROM nz),4),70)::INT)::INT",
    GS % (gauss_sql("n_items/g"), f"(CASE WHEN {u_sql('n_items/wide')}<0.1 THEN 0.2 ELSE 0.08 END)"))(
    lambda d: N.noise_by_group_std(d, {"n_items": (4, 70)}, age_bin(), 0.08, wide=(0.1, 0.2)))
one("shrink_to_group_mean", "avg_price",
    "avg_price+0.1*((SELECT avg(avg_price) FROM b b2 WHERE b2.age_group=b.age_group)-avg_price)", digits=4)(
    lambda d: N.shrink_to_group_mean(d, "avg_price", age_bin()))
one("noise_sparse_choice", "n_items",
    f"CASE WHEN n_items IS NOT NULL AND {u_sql('n_items/p')}<0.03 THEN least(greatest(n_items+CASE floor({u_sql('n_items/v')}*4)::INT WHEN 0 THEN -2 WHEN 1 THEN -1 WHEN 2 THEN 1 ELSE 2 END,0),70) ELSE n_items END::INT")(
    lambda d: N.noise_sparse_choice(d, "n_items", 0.03, [-2, -1, 1, 2], 0, 70))
one("noise_relative_step", "n_items",
    f"CASE WHEN n_items IS NOT NULL AND {u_sql('n_items/p')}<0.2 THEN least(greatest(n_items+greatest(abs(round_even(n_items*0.05*({u_sql('n_items/v')}*2-1),0)),1)"
    f"*CASE WHEN {u_sql('n_items/v')}*2-1<0 THEN -1 ELSE 1 END,0),70) ELSE n_items END::INT")(
    lambda d: N.noise_relative_step(d, "n_items", 0.2, 0.05, 0, 70))
MV = f"abs(3+{gauss_sql('avg_price/g')}*2)"
one("noise_normal_range_aware", "avg_price",
    f"""CASE WHEN avg_price IS NULL THEN NULL ELSE round(least(greatest(CASE
 WHEN avg_price BETWEEN 200000 AND 300000 THEN least(greatest(avg_price+{gauss_sql('avg_price/g')}*1.5,200000),300000)
 WHEN avg_price>300000 THEN greatest(avg_price-{MV},300000) ELSE least(avg_price+{MV},200000) END,50000),500000),1) END""")(
    lambda d: N.noise_normal_range_aware(d, "avg_price", (200000, 300000), (50000, 500000), 1.5, (3, 2)))

one("flip_flag", "urgent_flag", f"CASE WHEN {u_sql('urgent_flag/flip')}<0.03 THEN 1-urgent_flag ELSE urgent_flag END")(
    lambda d: N.flip_flag(d, "urgent_flag", 0.03))
one("flip_flag_where", "urgent_flag",
    f"CASE WHEN age>40 AND {u_sql('urgent_flag/flip')}<0.05 THEN 1-urgent_flag ELSE urgent_flag END")(
    lambda d: N.flip_flag(d, "urgent_flag", 0.05, F.col("age") > 40))
one("flip_cohort_fraction", "urgent_flag",
    f"CASE WHEN row_id IN {top('urgent_flag/cohort1', '(SELECT floor(count(*)*0.1) FROM b WHERE age>60 AND urgent_flag=0)', 'age>60 AND urgent_flag=0')} THEN 1 ELSE urgent_flag END")(
    lambda d: N.flip_cohort_fraction(d, "urgent_flag", 1, 0.1, F.col("age") > 60))
one("flip_cohort_bernoulli", "urgent_flag",
    f"CASE WHEN age<30 AND {u_sql('urgent_flag/cohort0')}<0.3 THEN 0 ELSE urgent_flag END")(
    lambda d: N.flip_cohort_bernoulli(d, "urgent_flag", 0, 0.3, F.col("age") < 30))
one("raise_prevalence_priority", "big_flag", f"""CASE WHEN row_id IN (SELECT row_id FROM (SELECT row_id, row_number() OVER (ORDER BY
 CASE WHEN age BETWEEN 18 AND 40 AND region='ASIA' THEN 0 WHEN age BETWEEN 18 AND 40 OR region='ASIA' THEN 1 ELSE 2 END+{u_sql('big_flag/raise')}, row_id) AS rn
 FROM b WHERE big_flag=0) z WHERE rn<=(SELECT floor(count(*)*0.4)-sum(big_flag) FROM b)) THEN 1 ELSE big_flag END""")(
    lambda d: N.raise_prevalence_priority(d, "big_flag", 0.4, [
        F.col("age").between(18, 40) & (F.col("region") == "ASIA"),
        F.col("age").between(18, 40) | (F.col("region") == "ASIA")]))
one("adjust_by_flag", "avg_price",
    f"CASE WHEN avg_price IS NOT NULL THEN round(least(greatest(avg_price+CASE WHEN urgent_flag=1 THEN 1.0+{u_sql('avg_price/adj')}*2.0 "
    f"WHEN urgent_flag=0 THEN -2.0+{u_sql('avg_price/adj')}*1.5 ELSE 0 END,10),500000),2) END")(
    lambda d: N.adjust_by_flag(d, "avg_price", "urgent_flag", (1.0, 3.0), (-2.0, -0.5), 10, 500000))
one("preserve_correlation_nudge", "n_orders",
    f"CASE WHEN (SELECT abs(corr(age,n_orders)) FROM b)<0.1 AND age>60 AND n_orders<(SELECT median(age) FROM b) "
    f"THEN least(greatest(n_orders+{int_sql(1, 2, 'n_orders/nudge')},4),1211) ELSE n_orders END::INT")(
    lambda d: N.preserve_correlation_nudge(d, "age", "n_orders", 0.1, 60, 4, 1211))
