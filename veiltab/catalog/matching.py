"""Encodings, exact neighbours, blocks and votes between subject and release."""
from __future__ import annotations

from pyspark.sql import functions as F

from veiltab.catalog.registry import query, rounded
from veiltab.operators import encode as E
from veiltab.operators import matching as M
from veiltab.operators.neighbours import knn, per_query
from veiltab.plans.views import RELEASE_SQL, release, subject, subject_and_release, table, u_sql, with_sql

NUM = ["age", "n_orders", "n_items", "avg_price", "avg_qty", "urgent_flag", "pending_flag"]
CATS = ["segment", "region"]
N_MARK = "(SELECT count(*)//10 FROM subject)"  # a tenth of the population


def n_mark(spark, sf) -> int:
    """The same number in Spark."""
    return subject(spark, sf).count() // 10


def encoded(spark, sf, kind="l1", both=None):
    a, c = both or subject_and_release(spark, sf)
    return E.encode_pair(a, c, NUM, CATS, "row_id", "src_id", kind)


# ---------------------------------------------------------------- SQL pieces

def scaled_sql(c: str, t: str) -> str:
    lo, hi = f"(SELECT min({c}) FROM subject)", f"(SELECT max({c}) FROM subject)"
    return (f"coalesce(({t}.{c}-{lo})/({hi}-{lo})::DOUBLE, ((SELECT median({c}) FROM subject)-{lo})/({hi}-{lo})::DOUBLE)")


def enc_sql(num=scaled_sql, w=lambda k, t: "1.0", extra="") -> str:
    def side(t, key):
        cols = [f"{num(c, t)} AS n{i}" for i, c in enumerate(NUM)]
        cols += [f"{t}.{k} AS c{j}, {w(k, t)}::DOUBLE AS w{j}" for j, k in enumerate(CATS)]
        return f"SELECT {t}.{key} AS id, {', '.join(cols)}{extra.format(t=t)} FROM {t}"
    return f"ea AS ({side('subject', 'row_id')}), ec AS ({side('release', 'src_id')})"


def l1_terms(view=None):
    num = [f"abs(a.n{i}-c.n{i})" for i in range(len(NUM)) if view is None or i in view.num]
    cat = [f"CASE WHEN a.c{j}=c.c{j} THEN abs(a.w{j}-c.w{j}) ELSE a.w{j}+c.w{j} END"
           for j in range(len(CATS)) if view is None or j in view.cat]
    return "+".join(num + cat)


def l2_terms(view=None):
    num = [f"(a.n{i}-c.n{i})*(a.n{i}-c.n{i})" for i in range(len(NUM)) if view is None or i in view.num]
    cat = [f"CASE WHEN a.c{j}=c.c{j} THEN (a.w{j}-c.w{j})*(a.w{j}-c.w{j}) ELSE a.w{j}*a.w{j}+c.w{j}*c.w{j} END"
           for j in range(len(CATS)) if view is None or j in view.cat]
    return "sqrt(" + "+".join(num + cat) + ")"


def nn_sql(k: int, terms: str, on: str = "true", name: str = "nn", a: str = "ea", c: str = "ec", by: str = "cid") -> str:
    other = "aid" if by == "cid" else "cid"
    return (f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY dist, {other}) AS rk FROM "
            f"(SELECT a.id AS aid, c.id AS cid, round({terms},9) AS dist FROM {a} a JOIN {c} c ON {on}) p) z WHERE rk<={k})")


def q(body, *ctes):
    return with_sql(body, RELEASE_SQL, *ctes)


# ---------------------------------------------------------------- encodings

def _flat(enc_pair):
    dfs = [enc.select(F.lit(s).alias("side"), "id", *[F.col("num")[i].alias(f"n{i}") for i in range(len(NUM))],
                      *[F.col("w")[j].alias(f"w{j}") for j in range(len(CATS))]) for s, enc in zip("AC", enc_pair)]
    return rounded(dfs[0].unionByName(dfs[1]))


FLAT = ", ".join([f"round(n{i},6) AS n{i}" for i in range(len(NUM))] + [f"round(w{j},6) AS w{j}" for j in range(len(CATS))])
FLAT_SQL = f"SELECT 'A' AS side, id, {FLAT} FROM ea UNION ALL SELECT 'C', id, {FLAT} FROM ec"


@query("encode_pair_l1", q(FLAT_SQL, enc_sql()))
def _(spark, sf):
    return _flat(encoded(spark, sf))


WIN = "win AS (SELECT row_id, " + ", ".join(
    f"CASE WHEN {c} IS NULL THEN (SELECT median({c}) FROM subject) ELSE least(greatest({c},(SELECT quantile_cont({c},0.01) FROM subject)),"
    f"(SELECT quantile_cont({c},0.99) FROM subject)) END AS {c}" for c in NUM) + " FROM subject)"


def zscore_sql(c, t):
    x = f"(SELECT {c} FROM win WHERE win.row_id=subject.row_id)" if t == "subject" else \
        f"coalesce(release.{c},(SELECT median({c}) FROM subject))"
    return f"({x}-(SELECT avg({c}) FROM win))/(SELECT CASE WHEN stddev_pop({c})=0 THEN 1 ELSE stddev_pop({c}) END FROM win)"


IDF = ("lvl AS (" + " UNION ALL ".join(
    f"SELECT '{k}' AS col, v, pow(ln(1/(count(*)/(SELECT (SELECT count(*) FROM subject)+(SELECT count(*) FROM release))::DOUBLE+1e-6)),1.2) AS w "
    f"FROM (SELECT {k} AS v FROM subject UNION ALL SELECT {k} FROM release) z GROUP BY 2" for k in CATS) + ")")


@query("encode_pair_zidf", q(FLAT_SQL, WIN, IDF, enc_sql(
    zscore_sql, lambda k, t: f"(SELECT w FROM lvl WHERE col='{k}' AND v={t}.{k})")))
def _(spark, sf):
    return _flat(encoded(spark, sf, "zidf"))


def clip_idf(share):
    return f"least(greatest(pow(greatest(ln(1/({share}+1e-6)),0),1.2),0.5),3.0)"


CLIPPED = "fct AS (SELECT " + ", ".join(
    f"{clip_idf(f'avg(n{i})')} AS f{i}" for i in range(len(NUM))) + " FROM ea)"


@query("encode_pair_idf_clip", q(
    "SELECT 'A' AS side, id, " + ", ".join([f"round(n{i}*f{i},6) AS n{i}" for i in range(len(NUM))] + [f"round(w{j},6) AS w{j}" for j in range(len(CATS))])
    + " FROM ea, fct UNION ALL SELECT 'C', id, "
    + ", ".join([f"round(n{i}*f{i},6)" for i in range(len(NUM))] + [f"round(w{j},6)" for j in range(len(CATS))]) + " FROM ec, fct",
    enc_sql(w=lambda k, t: f"(SELECT {clip_idf('count(*)/(SELECT count(*) FROM subject)::DOUBLE')} FROM subject s WHERE s.{k}={t}.{k})"),
    CLIPPED))
def _(spark, sf):
    return _flat(encoded(spark, sf, "idf_clip"))


def robust_sql(c, t):
    b = f"(SELECT {c} FROM subject UNION ALL SELECT {c} FROM release)"
    return (f"(SELECT (coalesce({t}.{c},m)-m)/CASE WHEN iqr>1e-6 THEN iqr ELSE CASE WHEN sd+1e-6>1e-6 THEN sd+1e-6 ELSE 1 END END FROM "
            f"(SELECT median({c}) AS m, quantile_cont({c},0.75)-quantile_cont({c},0.25) AS iqr, stddev_pop({c}) AS sd FROM {b} u) z)")


@query("encode_pair_robust", q(FLAT_SQL, enc_sql(robust_sql)))
def _(spark, sf):
    return _flat(encoded(spark, sf, "robust"))


SUP = ["age", "segment", "n_orders", "pending_flag"]


@query("encode_supervised", with_sql("""
SELECT row_id, age::DOUBLE AS age, n_orders::DOUBLE AS n_orders, pending_flag::DOUBLE AS pending_flag,
 """ + ", ".join(f"CASE WHEN segment='{s}' THEN 1.0 ELSE 0.0 END::DOUBLE AS \"segment_{s}\"" for s in
                 ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]) + " FROM subject"))
def _(spark, sf):
    df = subject(spark, sf).withColumn("fixed", F.lit(3))
    return E.encode_supervised(df, [*SUP, "fixed"], ["row_id"])


@query("encode_glm", with_sql(f"""
SELECT row_id, coalesce(n_items::DOUBLE,(SELECT median(n_items) FROM g)) AS n_items,
 """ + ", ".join(f"CASE WHEN segment='{s}' THEN 1.0 ELSE 0.0 END::DOUBLE AS \"segment_{s}\"" for s in
                 ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]) + " FROM g",
    f"g AS (SELECT row_id, CASE WHEN {u_sql('blank/n_items')}>=0.05 THEN n_items END AS n_items, "
    f"CASE WHEN {u_sql('blank/segment')}>=0.05 THEN segment END AS segment FROM subject)"))
def _(spark, sf):
    from veiltab.plans.views import blanked
    df = blanked(subject(spark, sf), ["n_items", "segment"])
    return E.encode_glm(df, ["n_items", "segment"], ["row_id"])


@query("align_features", with_sql("SELECT row_id, n_orders::DOUBLE AS n_orders, 0.0::DOUBLE AS absent, coalesce(avg_price,0) AS avg_price FROM subject"))
def _(spark, sf):
    df = subject(spark, sf).withColumns({c: F.col(c).cast("double") for c in ("n_orders", "avg_price")})
    return E.align_features(df, ["n_orders", "absent", "avg_price"], ["row_id"])


# ---------------------------------------------------------------- neighbours

@query("nearest_neighbour_mark", q(
    "SELECT id, CAST(id IN (SELECT aid FROM nn) AS INT) AS mark FROM ea", enc_sql(), nn_sql(1, l1_terms())))
def _(spark, sf):
    return M.nearest_neighbour_mark(*encoded(spark, sf))


KNN = "SELECT cid AS query_id, rk AS rank, aid AS id, round(dist,6) AS dist FROM nn"


@query("knn_pairs_l1", q(KNN, enc_sql(), nn_sql(5, l1_terms())))
def _(spark, sf):
    a, c = encoded(spark, sf)
    return rounded(per_query(c, knn(a, c, 5)))


LEN = "sqrt(" + "+".join([f"n{i}*n{i}" for i in range(len(NUM))] + [f"w{j}*w{j}" for j in range(len(CATS))]) + ")+1e-12"


def unit_sql(src, dst):
    return (f"{dst} AS (SELECT id, {', '.join(f'n{i}/({LEN}) AS n{i}' for i in range(len(NUM)))}, "
            f"{', '.join(f'c{j}, w{j}/({LEN}) AS w{j}' for j in range(len(CATS)))} FROM {src})")


@query("knn_pairs_cosine", q(KNN, enc_sql(), unit_sql("ea", "ua"), unit_sql("ec", "uc"),
                             nn_sql(5, l2_terms(), a="ua", c="uc")))
def _(spark, sf):
    a, c = encoded(spark, sf)
    return rounded(per_query(c, knn(a, c, 5, "cosine"), "cosine"))


@query("knn_pairs_many_cells", q(KNN, enc_sql(), nn_sql(3, l1_terms())))
def _(spark, sf):
    a, c = encoded(spark, sf)
    return rounded(per_query(c, knn(a, c, 3, block_rows=64, cell_rows=64)))


@query("knn_vectors_l2", """
WITH d AS (SELECT q.vec_id AS query_id, b.vec_id AS id,
  round(sqrt(list_sum(list_transform(list_zip(q.embedding, b.embedding), lambda z: (z[1]::DOUBLE-z[2]::DOUBLE)*(z[1]::DOUBLE-z[2]::DOUBLE)))),9) AS dist
 FROM embeddings q JOIN embeddings b ON q.label%2=0 AND b.label%2=1)
SELECT query_id, rank, id, round(dist,6) AS dist FROM
 (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank FROM d) z WHERE rank<=3""")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    base = E.encode_vectors(e.filter("label % 2 = 1"), "embedding", "vec_id")
    ask = E.encode_vectors(e.filter("label % 2 = 0"), "embedding", "vec_id")
    return rounded(per_query(ask, knn(base, ask, 3, "l2")))


HITS = "h AS (SELECT aid AS id, min(round(dist*1e3+rk*1e-8,8)) AS o FROM nn GROUP BY 1)"
FILL = """m1 AS (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY o, id) AS rn FROM h) z WHERE rn<={n}),
f AS (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY d, id) AS rn FROM (
  SELECT a.id, min(round({terms},9)) AS d FROM ea a, ec c WHERE a.id NOT IN (SELECT id FROM m1) GROUP BY 1) z) z
  WHERE rn<={n}-(SELECT count(*) FROM m1))"""
MARKED = "SELECT id, CAST(id IN (SELECT id FROM m1) OR id IN (SELECT id FROM f) AS INT) AS mark FROM ea"


@query("ranked_assign", q(MARKED, enc_sql(), nn_sql(7, l1_terms()), HITS, FILL.format(n=N_MARK, terms=l1_terms())))
def _(spark, sf):
    a, c = encoded(spark, sf)
    return M.ranked_assign(a, c, n_mark(spark, sf), 7)


@query("ranked_assign_fill", q(MARKED, enc_sql(), nn_sql(1, l1_terms()), HITS, FILL.format(n=900, terms=l1_terms())))
def _(spark, sf):
    a, c = encoded(spark, sf)
    return M.ranked_assign(a, c, 900, 1)


@query("semi_join_keys", q("SELECT row_id, segment, age FROM subject s WHERE EXISTS (SELECT 1 FROM release r WHERE r.segment=s.segment AND r.age=s.age)"))
def _(spark, sf):
    return subject(spark, sf).select("row_id", "segment", "age").join(
        release(spark, sf).select("segment", "age"), ["segment", "age"], "left_semi")


@query("equi_join_terms", q("""
SELECT term, round(a,6) AS before, round(b,6) AS after FROM
 (SELECT nation AS term, avg(balance) AS a FROM subject GROUP BY 1) x
 FULL OUTER JOIN (SELECT region AS term, avg(age) AS b FROM release GROUP BY 1 UNION ALL SELECT nation, avg(age) FROM subject GROUP BY 1) y USING (term)"""))
def _(spark, sf):
    s, c = subject(spark, sf), release(spark, sf)
    x = s.groupBy(F.col("nation").alias("term")).agg(F.avg("balance").alias("before"))
    y = c.groupBy(F.col("region").alias("term")).agg(F.avg("age").alias("after")).unionByName(
        s.groupBy(F.col("nation").alias("term")).agg(F.avg("age").alias("after")))
    return rounded(x.join(y, "term", "full_outer"))


@query("intersect_keys", q("SELECT segment, region, age FROM subject INTERSECT SELECT segment, region, age FROM release"))
def _(spark, sf):
    keys = ["segment", "region", "age"]
    return subject(spark, sf).select(*keys).intersect(release(spark, sf).select(*keys))


@query("union_all", q("SELECT 'A' AS side, segment, count(*) AS n FROM subject GROUP BY 2 UNION ALL SELECT 'C', segment, count(*) FROM release GROUP BY 2"))
def _(spark, sf):
    both = subject(spark, sf).select(F.lit("A").alias("side"), "segment").unionByName(
        release(spark, sf).select(F.lit("C").alias("side"), "segment"))
    return both.groupBy("side", "segment").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- blocks

AGE_BUCKET = ("CASE WHEN {t}.age IS NULL OR {t}.age<(SELECT min(age) FROM subject) THEN '__miss__' " + " ".join(
    f"WHEN {{t}}.age<=(SELECT quantile_cont(age,{i}/5.0) FROM subject) THEN 'q{i - 1}'" for i in range(1, 6)) + " ELSE '__miss__' END")
BLOCK = "lower({t}.segment)||'|'||" + AGE_BUCKET


@query("block_key", q(f"SELECT 'A' AS side, row_id AS id, {BLOCK.format(t='subject')} AS block FROM subject "
                      f"UNION ALL SELECT 'C', src_id, {BLOCK.format(t='release')} FROM release"))
def _(spark, sf):
    a, c = subject(spark, sf), release(spark, sf)
    key, _, _ = M.block_key(a, c, CATS, NUM)
    return a.select(F.lit("A").alias("side"), F.col("row_id").alias("id"), key.alias("block")).unionByName(
        c.select(F.lit("C").alias("side"), F.col("src_id").alias("id"), key.alias("block")))


def blocked(spark, sf, key_of):
    a, c = subject_and_release(spark, sf)
    key = key_of(a, c)
    return E.encode_pair(a.withColumn("part", key), c.withColumn("part", key), NUM, CATS, "row_id", "src_id",
                         extra=["part"])


QUOTA = """sz AS (SELECT part, least(na,nc) AS m FROM (SELECT part, count(*) AS na FROM ea GROUP BY 1) x
 JOIN (SELECT part, count(*) AS nc FROM ec GROUP BY 1) y USING (part)),
qt AS (SELECT part, round_even({n}*m/(SELECT sum(m) FROM sz)::DOUBLE,0) AS qn FROM sz),
h AS (SELECT aid AS id, any_value(part) AS part, min(round(dist*1e3+rk*1e-8,8)) AS o FROM nn JOIN (SELECT id AS aid, part FROM ea) USING (aid) GROUP BY 1),
m0 AS (SELECT id, o FROM (SELECT h.*, row_number() OVER (PARTITION BY part ORDER BY o, id) AS rn FROM h) z JOIN qt USING (part) WHERE rn<=qn),
"""


@query("block_knn_assign", q(MARKED, enc_sql(extra=", " + BLOCK + " AS part"), nn_sql(5, l1_terms(), "a.part=c.part"),
                             QUOTA.format(n=N_MARK) + FILL.format(n=N_MARK, terms=l1_terms()).replace("FROM h)", "FROM m0)")))
def _(spark, sf):
    a, c = blocked(spark, sf, lambda a, c: M.block_key(a, c, CATS, NUM)[0])
    return M.block_knn_assign(a, c, n_mark(spark, sf), 5)


VOTE_BLOCK = ", {t}.region||chr(31)||{t}.segment AS part"


@query("block_vote", q("""
SELECT id, round(coalesce(v,0)+CASE WHEN part IN (SELECT part FROM ec) THEN (SELECT avg(coalesce(v,0))+stddev_pop(coalesce(v,0)) FROM ea LEFT JOIN vt USING (id)) ELSE 0 END,4) AS score
FROM ea LEFT JOIN vt USING (id)""", enc_sql(extra=VOTE_BLOCK), nn_sql(7, l1_terms(), "a.part=c.part"),
    "vt AS (SELECT aid AS id, sum(CAST(1/(dist+1e-8)/rk AS DECIMAL(28,9)))::DOUBLE AS v FROM nn GROUP BY 1)"))
def _(spark, sf):
    a, c = blocked(spark, sf, lambda a, c: M.exact_block(M.stable_categories(a, c, CATS)))
    return rounded(M.block_vote(a, c, 7), 4)


# ---------------------------------------------------------------- votes over subspaces

# rounds, share of features: the settings of audits v6, v5 and v7 (which asks the whole release)
VIEWS = M.subspaces(len(NUM), len(CATS), 8, 0.6, 3, 15)
VIEWS_HEAT = M.subspaces(len(NUM), len(CATS), 30, 0.7, 3, salt="heat")
VIEWS_SAMPLED = M.subspaces(len(NUM), len(CATS), 12, 0.6, 3, salt="sampled")


def unit_view_sql(t, v):
    parts = [f"{t}.n{i}*{t}.n{i}" for i in v.num] + [f"{t}.w{j}*{t}.w{j}" for j in v.cat]
    return f"(sqrt({'+'.join(parts)})+1e-12)"


def view_table(src, v, dst):
    cols = [f"n{i}/{unit_view_sql(src, v)} AS n{i}" for i in v.num] + [f"c{j}, w{j}/{unit_view_sql(src, v)} AS w{j}" for j in v.cat]
    return f"{dst} AS (SELECT id, {', '.join(cols)} FROM {src})"


def votes_sql(views, k, metrics, eps, c="ec"):
    ctes, unions = [], []
    for i, v in enumerate(views):
        if "l1" in metrics:
            ctes.append(nn_sql(k, l1_terms(v), name=f"nl{i}", c=c))
            unions.append(f"SELECT {i} AS r, * FROM nl{i}")
        if "cosine" in metrics:
            ctes += [view_table("ea", v, f"va{i}"), view_table(c, v, f"vc{i}"),
                     nn_sql(k, l2_terms(v), name=f"nc{i}", a=f"va{i}", c=f"vc{i}")]
            unions.append(f"SELECT {i} AS r, * FROM nc{i}")
    return ", ".join(ctes) + ", al AS (" + " UNION ALL ".join(unions) + ")" + f""",
vt AS (SELECT aid AS id, sum(CAST(1.0/(dist+{eps}) AS DECIMAL(28,9)))::DOUBLE AS v, count(CASE WHEN rk=1 AND r<5 THEN 1 END) AS h FROM al GROUP BY 1)"""


def final_sql(expr):
    return f""", sc AS (SELECT ea.id, coalesce({expr},0) AS s FROM ea LEFT JOIN vt USING (id))
SELECT id, round((s-(SELECT min(s) FROM sc))/((SELECT max(s) FROM sc)-(SELECT min(s) FROM sc)+1e-12),6) AS score FROM sc"""


def voted(ctes, expr, *enc):
    return with_sql("", RELEASE_SQL, *enc, ctes).rstrip() + final_sql(expr)


@query("stability_vote_l1", voted(votes_sql(VIEWS, 3, ("l1",), 1e-8), "v", enc_sql()))
def _(spark, sf):
    a, c = encoded(spark, sf)
    return rounded(M.stability_vote(a, c, VIEWS, 3))


@query("stability_vote_heat", voted(votes_sql(VIEWS_HEAT, 5, ("l1", "cosine"), 1e-6), "v/(1.0+0.1*h)", enc_sql()))
def _(spark, sf):
    a, c = encoded(spark, sf)
    return rounded(M.stability_vote(a, c, VIEWS_HEAT, 5, ("l1", "cosine"), eps=1e-6, heat_rounds=5))


@query("stability_vote_sampled", voted(votes_sql(VIEWS_SAMPLED, 5, ("cosine",), 1e-6, c="ek"),
    "v*(SELECT count(*) FROM ec)/(SELECT count(*) FROM ek)", enc_sql(), f"ek AS (SELECT * FROM ec WHERE {u_sql('vote/keep', 'id')}<0.3)"))
def _(spark, sf):
    a, c = encoded(spark, sf)
    return rounded(M.stability_vote(a, c, VIEWS_SAMPLED, 5, ("cosine",), eps=1e-6, c_share=0.3))


@query("record_linkage_truth", q("""
SELECT count(*) AS n_queries, count(CASE WHEN aid=cid THEN 1 END) AS n_found,
 round(count(CASE WHEN aid=cid THEN 1 END)/count(*)::DOUBLE,6) AS recall FROM nn""", enc_sql(), nn_sql(1, l1_terms())))
def _(spark, sf):
    a, c = encoded(spark, sf)
    got = per_query(c, knn(a, c, 1))
    return rounded(got.agg(F.count(F.lit(1)).alias("n_queries"), F.count_if(F.col("id") == F.col("query_id")).alias("n_found"))
                   .withColumn("recall", F.col("n_found") / F.col("n_queries")))

