"""Exchanging values between rows."""
from __future__ import annotations

from pyspark.sql import functions as F

from veiltab.catalog.perturb import age_bin, base, q
from veiltab.catalog.registry import query, rounded
from veiltab.functions.hashing import uniform
from veiltab.operators import cohort as C
from veiltab.plans.views import gauss_sql, u_sql
from veiltab.session import materialize

COHORT = f"""coh AS (SELECT row_id, age, side, row_number() OVER (PARTITION BY side ORDER BY {u_sql('swap')}, row_id) AS rn
 FROM (SELECT row_id, age, CASE WHEN age BETWEEN 21 AND 30 THEN 'a' WHEN age BETWEEN 31 AND 40 THEN 'b' END AS side FROM b) z WHERE side IS NOT NULL),
m AS (SELECT least(floor(count(CASE WHEN side='a' THEN 1 END)*0.1),floor(count(CASE WHEN side='b' THEN 1 END)*0.1)) AS m FROM coh)"""


@query("swap_between_cohorts", q("""
SELECT b.row_id, coalesce(o.age, b.age) AS age FROM b LEFT JOIN coh c ON c.row_id=b.row_id AND c.rn<=(SELECT m FROM m)
LEFT JOIN coh o ON o.rn=c.rn AND o.side<>c.side""", COHORT))
def _(spark, sf):
    return C.swap_between_cohorts(base(spark, sf).select("row_id", "age"), "age", F.col("age").between(21, 30), F.col("age").between(31, 40), 0.1)


def pairs_sql(share, part):
    return f"""pr AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {u_sql('pairs')}, row_id) AS rn
 FROM (SELECT *, row_number() OVER (ORDER BY {u_sql('pairs/in')}, row_id) AS pl, count(*) OVER () AS al FROM b) z WHERE pl<=2*floor(al*{share}))"""


@query("swap_records", q("""
SELECT b.row_id, CASE WHEN o.row_id IS NOT NULL THEN o.n_orders ELSE b.n_orders END AS n_orders,
 CASE WHEN o.row_id IS NOT NULL THEN o.n_items ELSE b.n_items END AS n_items
FROM b LEFT JOIN pr ON pr.row_id=b.row_id LEFT JOIN pr o ON o.rn=CASE WHEN pr.rn%2=1 THEN pr.rn+1 ELSE pr.rn-1 END""", pairs_sql(0.03, "1")))
def _(spark, sf):
    return C.swap_records(base(spark, sf).select("row_id", "n_orders", "n_items"), ["n_orders", "n_items"], 0.03)


@query("swap_records_similar", q("""
SELECT b.row_id, CASE WHEN o.row_id IS NOT NULL THEN o.n_orders ELSE b.n_orders END AS n_orders
FROM b LEFT JOIN pr ON pr.row_id=b.row_id LEFT JOIN pr o ON o.region=pr.region AND floor(o.age/5)=floor(pr.age/5)
 AND o.rn=CASE WHEN pr.rn%2=1 THEN pr.rn+1 ELSE pr.rn-1 END""", pairs_sql(0.15, "region, floor(age/5)")))
def _(spark, sf):
    df = base(spark, sf).select("row_id", "region", "age", "n_orders")
    return C.swap_records(df, ["n_orders"], 0.15, [F.col("region"), F.floor(F.col("age") / 5)]).select("row_id", "n_orders")


def wide_sql(salt, row_id, n):
    return f"least(floor(({u_sql(salt, row_id)}+{u_sql(salt + '/low', row_id)}/4294967296.0::DOUBLE)*({n})),({n})-1)::BIGINT"


SEQUENCE = f"""st AS (SELECT row_id, region, row_number() OVER (PARTITION BY region ORDER BY age, {u_sql('swap/seat')}, row_id)-1 AS place,
  coalesce(sum(1) OVER (PARTITION BY region ORDER BY age RANGE BETWEEN UNBOUNDED PRECEDING AND 6 PRECEDING),0) AS lo,
  sum(1) OVER (PARTITION BY region ORDER BY age RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS many FROM b WHERE age IS NOT NULL AND region IS NOT NULL),
al AS (SELECT row_id, row_number() OVER (ORDER BY {u_sql('swap/row')}, row_id) AS rn, count(*) OVER () AS n FROM b),
tu AS (SELECT i AS swap, 1+{wide_sql('swap/first', 'i', '(SELECT count(*) FROM b)')} AS rn FROM range(1,1+(SELECT floor(count(*)*0.4)::BIGINT FROM b)) t(i)),
dr AS (SELECT swap, st.*, {wide_sql('swap/second', 'swap', 'many-1')} AS t FROM tu JOIN al USING (rn) JOIN st USING (row_id) WHERE many>1),
sw AS (SELECT swap, d.row_id AS a, o.row_id AS z FROM dr d JOIN st o ON o.region=d.region AND o.place=d.lo+d.t+CASE WHEN d.t>=d.place-d.lo THEN 1 ELSE 0 END),
en AS (SELECT swap, a AS r, z AS o FROM sw UNION ALL SELECT swap, z, a FROM sw),
ev AS (SELECT *, lag(swap) OVER w AS ps, lag(o) OVER w AS po, lead(swap) OVER w IS NULL AS fin FROM en WINDOW w AS (PARTITION BY r ORDER BY swap)),
walk AS (SELECT r, swap AS s, o AS cur FROM ev WHERE fin UNION ALL
  SELECT walk.r, ev.ps, coalesce(ev.po, ev.r) FROM walk JOIN ev ON ev.swap=walk.s AND ev.r=walk.cur)"""


@query("swap_similar_records", q("""
SELECT b.row_id, CASE WHEN w.r IS NOT NULL THEN o.n_orders ELSE b.n_orders END AS n_orders,
 CASE WHEN w.r IS NOT NULL THEN o.n_items ELSE b.n_items END AS n_items
FROM b LEFT JOIN (SELECT r, cur FROM walk WHERE s IS NULL) w ON w.r=b.row_id LEFT JOIN b o ON o.row_id=w.cur""", SEQUENCE).replace("WITH ", "WITH RECURSIVE ", 1))
def _(spark, sf):
    df = materialize(base(spark, sf).select("row_id", "region", "age", "n_orders", "n_items"))
    swaps = C.similar_swaps(df, int(df.count() * 0.4), "region", "age")
    return C.swap_sequence(df, swaps, ["n_orders", "n_items"]).select("row_id", "n_orders", "n_items")


@query("record_pair_join", q(f"""
SELECT row_id, partner_id FROM (
 SELECT a.row_id, o.row_id AS partner_id, row_number() OVER (PARTITION BY a.row_id ORDER BY o.age, {u_sql('partner/seat', 'o.row_id')}, o.row_id)-1 AS place,
  floor({u_sql('partner', 'a.row_id')}*count(*) OVER (PARTITION BY a.row_id)) AS t
 FROM b a JOIN b o ON a.region=o.region AND abs(a.age-o.age)<=5 WHERE {u_sql('chosen', 'a.row_id')}<0.2) z
WHERE place=t AND partner_id<>row_id"""))
def _(spark, sf):
    df = base(spark, sf).select("row_id", "region", "age")
    return C.record_pair_join(df, uniform("chosen") < 0.2, "region", "age")


def perm_sql(part, salt):
    return (f"row_number() OVER (PARTITION BY {part} ORDER BY {u_sql(salt)}, row_id)")


FIVE = "coalesce(floor(age/5)::INT,-1)"


@query("permute_within_group_columns", q(f"""
SELECT p.row_id, p.band, x.n_orders, y.segment
FROM (SELECT row_id, {FIVE} AS band, {perm_sql(FIVE, 'perm/base')} AS rn FROM b) p
JOIN (SELECT n_orders, {FIVE} AS band, {perm_sql(FIVE, 'perm/n_orders')} AS rn FROM b) x ON p.band=x.band AND p.rn=x.rn
JOIN (SELECT segment, {FIVE} AS band, {perm_sql(FIVE, 'perm/segment')} AS rn FROM b) y ON p.band=y.band AND p.rn=y.rn"""))
def _(spark, sf):
    df = base(spark, sf).select("row_id", F.floor(F.col("age") / 5).cast("int").alias("band"), "n_orders", "segment")
    return C.permute_within_group_columns(df, ["band"], ["n_orders", "segment"])


T = [["region", "age_group", "urgent_flag"], ["region", "urgent_flag"], ["urgent_flag"]]
CELL = "cell AS (SELECT region, age_group, urgent_flag, count(*) AS n FROM b GROUP BY 1,2,3)"


def tier_sql(k, p):
    out, prev = [], "cell"
    for i, t in enumerate(T):
        name = "concat_ws('|','%d',%s)" % (i, ",".join(f"{c}::VARCHAR" for c in t))
        grp = "NULL::VARCHAR" if i == 0 else "grp"
        out.append(f"t{i} AS (SELECT region, age_group, urgent_flag, n, CASE WHEN {grp} IS NULL AND "
                   f"sum(CASE WHEN {grp} IS NULL THEN n ELSE 0 END) OVER (PARTITION BY {', '.join(t)})>={k} "
                   f"AND {u_sql('block', name)}<{p} THEN {name} ELSE {grp} END AS grp FROM {prev})")
        prev = f"t{i}"
    return ", ".join(out)


@query("permute_within_group_block", q(f"""
SELECT b.row_id, coalesce(v.age,b.age) AS age, CASE WHEN v.rn IS NOT NULL THEN v.n_items ELSE b.n_items END AS n_items
FROM b LEFT JOIN (SELECT row_id, grp, {perm_sql('grp', 'block/base')} AS rn FROM g) p ON p.row_id=b.row_id
LEFT JOIN (SELECT age, n_items, grp, {perm_sql('grp', 'block/value')} AS rn FROM g) v ON v.grp=p.grp AND v.rn=p.rn""",
    CELL, tier_sql(25, 0.8), "g AS (SELECT b.*, grp FROM b JOIN t2 USING (region, age_group, urgent_flag) WHERE grp IS NOT NULL)"))
def _(spark, sf):
    df = base(spark, sf).select("row_id", "region", "age", "n_items", "urgent_flag", age_bin().alias("age_group"))
    return C.permute_within_group_block(df, T, ["age", "n_items"], 25, 0.8).select("row_id", "age", "n_items")


@query("permute_local", q(f"""
SELECT p.row_id, v.n_orders, v.n_items FROM
(SELECT row_id, region, (rn-1-CASE WHEN w>1 THEN 1+floor({u_sql('local/shift', 'region')}*(w-1)) ELSE 0 END+size)%size+1 AS place FROM r) p
JOIN (SELECT region, n_orders, n_items, row_number() OVER (PARTITION BY region ORDER BY
  rn+CASE WHEN {u_sql('local/move')}<0.2 THEN round(({u_sql('local/by')}*2-1)*w,6) ELSE 0 END, row_id) AS place FROM r) v
 ON p.region=v.region AND p.place=v.place""",
    "r0 AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY row_id) AS rn, count(*) OVER (PARTITION BY region) AS size FROM b), "
    "r AS (SELECT *, least(greatest(3,floor(size*0.12)),size) AS w FROM r0)"))
def _(spark, sf):
    df = base(spark, sf).select("row_id", "region", "n_orders", "n_items")
    return C.permute_local(df, ["region"], ["n_orders", "n_items"], 0.12).select("row_id", "n_orders", "n_items")


@query("convex_mix", q(f"""
SELECT row_id, round(any_value(mixed),4) AS n_orders FROM (
 SELECT a.row_id, sum(o.n_orders*w)/sum(w)+{gauss_sql('mix/n_orders', 'a.row_id')}*0.08*any_value(sd) AS mixed FROM
 (SELECT row_id, region, j, (floor({u_sql('mix/start')}*size)+j)%size+1 AS rn,
   (CASE j WHEN 0 THEN {u_sql('mix/w/0')} WHEN 1 THEN {u_sql('mix/w/1')} ELSE {u_sql('mix/w/2')} END) AS w, sd
  FROM (SELECT row_id, region, count(*) OVER (PARTITION BY region) AS size, stddev_pop(n_orders) OVER (PARTITION BY region) AS sd FROM b) z, range(3) t(j)) a
 JOIN (SELECT region, n_orders, {perm_sql('region', 'mix/order')} AS rn FROM b) o ON a.region=o.region AND a.rn=o.rn
 GROUP BY a.row_id) z GROUP BY 1"""))
def _(spark, sf):
    df = base(spark, sf).select("row_id", "region", "n_orders")
    return rounded(C.convex_mix(df, ["region"], ["n_orders"]).select("row_id", "n_orders"), 4)
