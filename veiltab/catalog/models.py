"""Training-set shaping, models and calibration on the subject view."""
from __future__ import annotations

from pyspark.sql import functions as F

from veiltab.catalog.registry import query, rounded
from veiltab.functions.hashing import uniform
from veiltab.operators import model as M
from veiltab.operators import risk as R
from veiltab.operators.metrics import classification_metrics
from veiltab.plans.views import RELEASE_SQL, SCORES_SQL, release, scores, subject, u_sql, with_sql
from veiltab.session import materialize
from veiltab.sources.files import scratch_folder

FEATURES = ["age", "n_orders", "n_items", "n_returns", "avg_price"]


def q(body):
    return with_sql(body, SCORES_SQL)


@query("class_weight", q("""
SELECT row_id, y, round(CASE WHEN y=1 THEN (SELECT sum(1-y)/sum(y)::DOUBLE FROM scores) ELSE 1 END,6)::DOUBLE AS weight FROM scores"""))
def _(spark, sf):
    return rounded(M.class_weight(scores(spark, sf).select("row_id", "y")))


@query("soft_labels", q("""
SELECT row_id, 1 AS y, round(y*0.9+0.05,6)::DOUBLE AS weight FROM scores UNION ALL SELECT row_id, 0, round(1-(y*0.9+0.05),6)::DOUBLE FROM scores"""))
def _(spark, sf):
    return rounded(M.soft_labels(scores(spark, sf).select("row_id", "y"), 0.05))


@query("label_noise", q(f"SELECT row_id, CASE WHEN {u_sql('label')}<0.1 THEN 1-y ELSE y END AS y FROM scores"))
def _(spark, sf):
    return M.label_noise(scores(spark, sf).select("row_id", "y"), 0.1)


MIXED = FEATURES[:3] + ["urgent_flag"]
LAMBDA = (f"0.5+cos({u_sql('mixup/l/v', 'i.row_id')}*2*pi())/(2*sqrt(1/greatest(pow(greatest({u_sql('mixup/l/u', 'i.row_id')},"
          f"1/4294967296.0::DOUBLE),-1/0.4::DOUBLE)-1,1e-300)+pow(cos({u_sql('mixup/l/v', 'i.row_id')}*2*pi()),2)))")


@query("mixup", with_sql(
    "SELECT rn, round(lam,6) AS lam, " + ", ".join(f"round(lam*{c}+(1-lam)*o_{c},6) AS {c}" for c in MIXED) + " FROM pr",
    *[f"{t} AS (SELECT *, row_number() OVER (ORDER BY {u_sql('mixup/' + t)}, row_id) AS rn FROM subject)" for t in "ij"],
    f"pr AS (SELECT i.*, {LAMBDA} AS lam, {', '.join(f'j.{c} AS o_{c}' for c in MIXED)} FROM i JOIN j ON i.rn=j.rn "
    "WHERE i.rn<=(SELECT floor(count(*)*0.5) FROM subject))"))
def _(spark, sf):
    df = subject(spark, sf).select("row_id", *FEATURES[:3], "urgent_flag")
    return rounded(M.mixup(df, FEATURES[:3], "urgent_flag", 0.5, 0.4))


@query("clip_probability", q("SELECT row_id, round(least(greatest(p,0.3),0.7),6) AS p, CAST(p>=0.4 AS INT) AS label FROM scores".replace("0.3", "0.2").replace("0.7", "0.8")))
def _(spark, sf):
    return rounded(scores(spark, sf).select("row_id", M.clip_probability(F.col("p"), 0.2).alias("p"),
                                            M.predict_threshold(F.col("p"), 0.4).alias("label")))


TEMP = ("tm AS (SELECT t AS temperature, avg(-(y*ln(q)+(1-y)*ln(1-q))) AS l FROM (SELECT y, t, 1/(1+exp(-ln(p/(1-p))/t)) AS q "
        "FROM scores, (VALUES (1.0::DOUBLE),(1.2),(1.5),(1.8),(2.0),(2.5)) v(t)) z GROUP BY 1)")


@query("temperature_scale", with_sql("""
SELECT temperature, round(l,6) AS logloss, CAST(temperature=(SELECT temperature FROM tm ORDER BY round(l,12), temperature LIMIT 1) AS INT) AS best FROM tm""",
    SCORES_SQL, TEMP))
def _(spark, sf):
    return rounded(M.temperature_scale(scores(spark, sf)))


@query("platt_scale")
def _(spark, sf):
    a, b = M.platt_scale(scores(spark, sf))
    s = scores(spark, sf)
    return rounded(s.select("row_id", "y", (1 / (1 + F.exp(-(a * M.margin(F.col("p")) + b)))).alias("p")))


GLM = ["age", "n_orders", "n_returns", "n_suppliers", "avg_disc", "segment"]


@query("logistic_table")
def _(spark, sf):
    out, auc = M.logistic_table(materialize(subject(spark, sf)), "urgent_flag", GLM, ensure_terms=["segment_NONE"])
    return rounded(out.withColumn("auc", F.lit(auc)))


@query("fixed_term_table", with_sql("""
SELECT term, round(coalesce(m,0),6) AS coef FROM (SELECT segment AS term FROM subject UNION SELECT 'ZZ_absent') t
LEFT JOIN (SELECT segment AS term, avg(balance) AS m FROM subject GROUP BY 1) z USING (term)"""))
def _(spark, sf):
    s = subject(spark, sf)
    t = s.groupBy(F.col("segment").alias("term")).agg(F.avg("balance").alias("coef"))
    return rounded(M.fixed_term_table(t, ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"], ["ZZ_absent"]))


@query("vif")
def _(spark, sf):
    got = M.vif(subject(spark, sf).select(*GLM[:4]), GLM[:4])
    return rounded(spark.createDataFrame(list(got.items()), "term string, vif double"))


def training(spark, sf):
    return subject(spark, sf).select("row_id", *FEATURES, F.col("urgent_flag").alias("y"),
                                     (uniform("valid") < 0.2).alias("is_valid"))


def fitted(spark, sf):
    df = M.class_weight(training(spark, sf))
    return df, M.boosted_fit(df, FEATURES, "y", "is_valid", "weight")


@query("boosted_fit")
def _(spark, sf):
    df, model = fitted(spark, sf)
    return rounded(classification_metrics(M.predict(model, df.filter("is_valid"), ["y"])))


@query("boosted_leaf_rarity")
def _(spark, sf):
    df, model = fitted(spark, sf)
    out = M.predict(model, df, ["row_id", "y"])
    return rounded(R.four_part_score(out).select("row_id", "s_loss", "s_leaf", "s_conf", "s_correct", "s_model"))


@query("multi_seed_select")
def _(spark, sf):
    return rounded(M.multi_seed_select(training(spark, sf), FEATURES, "y", "is_valid", [7, 13, 29, 41], trees=2000, depth=4)[1])


@query("model_save_load")
def _(spark, sf):
    df, model = fitted(spark, sf)
    path = scratch_folder(spark)
    M.model_save(model, path, FEATURES, "y")
    again, features, target = M.model_load(path)
    out = M.predict(again, df, ["row_id"])
    return rounded(out.select("row_id", "p", F.lit(len(features)).alias("n_features"), F.lit(target).alias("target")))


@query("union_training", with_sql(
    f"SELECT count(*) AS n, count(CASE WHEN {u_sql('s/train', 'id')}<0.9 THEN 1 END) AS n_train FROM "
    f"(SELECT row_id AS id FROM subject UNION ALL SELECT src_id+1000000000 FROM release) z WHERE {u_sql('s/keep', 'id')}<0.5", RELEASE_SQL))
def _(spark, sf):
    from veiltab.operators.select import sample_and_split
    both = subject(spark, sf).select(F.col("row_id").alias("id")).unionByName(
        release(spark, sf).select((F.col("src_id") + 1000000000).alias("id")))
    return sample_and_split(both, row_id="id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_train") == 1).alias("n_train"))
