"""Membership scores, fusions and whole-table marks."""
from __future__ import annotations

from pyspark.sql import functions as F

from veiltab.catalog.matching import N_MARK, VIEWS, enc_sql, encoded, final_sql, n_mark, votes_sql
from veiltab.catalog.order import LOSS, marked
from veiltab.catalog.registry import query, rounded
from veiltab.operators import matching as M
from veiltab.operators import risk as R
from veiltab.plans.views import RELEASE_SQL, SCORES_SQL, release, scores, subject, subject_and_release, with_sql
from veiltab.session import materialize

TREES = 4
LEAF = {0: "floor(age/10)", 1: "n_orders%7", 2: "floor(n_items/8)", 3: "urgent_flag*2+pending_flag"}
LEAF_SQL = "leafs AS (" + " UNION ALL ".join(
    f"SELECT row_id, {t} AS tree, CAST({e} AS INT) AS leaf FROM subject" for t, e in LEAF.items()) + ")"


def with_leaves(spark, sf, people=None):
    """Scores with a literal leaf table of four trees."""
    leaf = F.array(*[F.expr(f"CAST({LEAF[t]} AS INT)") for t in range(TREES)])
    people = subject(spark, sf) if people is None else people
    return scores(spark, sf, people).join(people.select("row_id", leaf.alias("leaf")), "row_id")


def release_leaves(spark, sf, released=None):
    """Leaves of the released rows in the same trees."""
    return (release(spark, sf) if released is None else released).select(F.array(*[F.expr(f"CAST({LEAF[t]} AS INT)") for t in range(TREES)]).alias("leaf"))


def unit(c, t="loss"):
    return f"(({c}-(SELECT min({c}) FROM {t}))/((SELECT max({c}) FROM {t})-(SELECT min({c}) FROM {t})+1e-12))"


def q(body, *ctes):
    return with_sql(body, SCORES_SQL, LOSS, *ctes)


@query("score_correct", q("SELECT row_id, CAST((p>=0.5)=(y=1) AS INT) AS mark FROM loss"))
def _(spark, sf):
    return scores(spark, sf).select("row_id", R.score_correct().alias("mark"))


@query("score_confident", q("SELECT row_id, CAST(abs(p-y)<=0.25 AS INT) AS mark FROM loss"))
def _(spark, sf):
    return scores(spark, sf).select("row_id", R.score_confident(within=0.25).alias("mark"))


@query("score_top_conf", q(f"SELECT row_id, CAST(row_id IN {marked('round(abs(p-y),9)', N_MARK)} AS INT) AS mark FROM loss"))
def _(spark, sf):
    return R.score_top_conf(scores(spark, sf), n_mark(spark, sf)).select("row_id", "mark")


@query("score_nll", q(f"SELECT row_id, round(1-{unit('loss')},6) AS s_loss FROM loss"))
def _(spark, sf):
    return rounded(R.score_loss(scores(spark, sf)).select("row_id", "s_loss"))


CONF = "cf AS (SELECT row_id, y, p, loss, CASE WHEN y=1 THEN p ELSE 1-p END AS conf FROM loss)"


@query("score_conf_true", q(f"SELECT row_id, round({unit('conf', 'cf')},6) AS s_conf FROM cf", CONF))
def _(spark, sf):
    return rounded(R.score_conf_true(scores(spark, sf)).select("row_id", "s_conf"))


def rarity_sql(base: str) -> str:
    return (LEAF_SQL + f", shr AS (SELECT tree, leaf, count(*)/(SELECT count(DISTINCT row_id) FROM leafs WHERE {base})::DOUBLE AS s "
            f"FROM leafs WHERE {base} GROUP BY 1,2), rar AS (SELECT row_id, sum(CAST(ln(1/(coalesce(s,0)+1e-6)) AS DECIMAL(28,9)))::DOUBLE AS r "
            f"FROM leafs LEFT JOIN shr USING (tree, leaf) GROUP BY 1)")


@query("score_leaf_rarity", q(f"SELECT row_id, round({unit('r', 'rar')},6) AS s_leaf FROM rar", rarity_sql("true")))
def _(spark, sf):
    return rounded(R.score_leaf_rarity(with_leaves(spark, sf)).select("row_id", "s_leaf"))


@query("score_leaf_rarity_on_release", q(f"SELECT row_id, round({unit('r', 'rar')},6) AS s_leaf FROM rar", RELEASE_SQL,
    LEAF_SQL.replace("leafs AS", "leafc AS").replace("SELECT row_id, ", "SELECT ").replace("FROM subject", "FROM release"),
    rarity_sql("true").replace("FROM leafs WHERE true", "FROM leafc").replace("count(DISTINCT row_id) FROM leafc", "count(*) FROM release")))
def _(spark, sf):
    return rounded(R.score_leaf_rarity(with_leaves(spark, sf), release_leaves(spark, sf)).select("row_id", "s_leaf"))


FOUR = (f"four AS (SELECT row_id, 0.35*(1-{unit('loss', 'cf')})+0.30*{unit('r', 'rar')}+0.25*{unit('conf', 'cf')}"
        f"+0.10*CAST((p>=0.5)=(y=1) AS INT) AS s FROM cf JOIN rar USING (row_id))")


@query("fuse_weighted", q("SELECT row_id, round(s,6) AS s_model FROM four", CONF, rarity_sql("true"), FOUR))
def _(spark, sf):
    return rounded(R.four_part_score(with_leaves(spark, sf)).select("row_id", "s_model"))


DIST = "dst AS (SELECT row_id, (age+n_items)/200.0::DOUBLE AS d FROM subject)"
ADAPT = ("wt AS (SELECT 0.7*0.6+0.3*sp/(sp+iqr+1e-8) AS w FROM (SELECT stddev_pop(d)/(avg(d)+1e-8) AS sp FROM dst) a, "
         "(SELECT quantile_cont(s,0.75)-quantile_cont(s,0.25) AS iqr FROM four) b)")


def two_scores(spark, sf):
    d = subject(spark, sf).select("row_id", ((F.col("age") + F.col("n_items")) / 200.0).alias("s_distance"))
    return d, R.four_part_score(with_leaves(spark, sf)).select("row_id", "s_model")


@query("fuse_adaptive", q("SELECT row_id, round(w*d+(1-w)*s,6) AS score FROM dst JOIN four USING (row_id), wt",
                          CONF, rarity_sql("true"), FOUR, DIST, ADAPT))
def _(spark, sf):
    d, m = two_scores(spark, sf)
    both = materialize(d.join(m, "row_id"))
    return rounded(R.fuse_adaptive(both, "s_distance", "s_model").select("row_id", "score"))


def top_score(expr, n=N_MARK):
    return (f"SELECT row_id, CAST(row_number() OVER (ORDER BY -round({expr},9), row_id)<={n} AS INT) AS mark "
            f"FROM dst JOIN four USING (row_id), wt")


@query("hybrid_risk", q(top_score("0.6*d+0.4*s"), CONF, rarity_sql("true"), FOUR, DIST, ADAPT))
def _(spark, sf):
    d, m = two_scores(spark, sf)
    return R.hybrid_risk(d, n_mark(spark, sf), d, m)


@query("hybrid_risk_adaptive", q(top_score("w*d+(1-w)*s"), CONF, rarity_sql("true"), FOUR, DIST, ADAPT))
def _(spark, sf):
    d, m = two_scores(spark, sf)
    return R.hybrid_risk(d, n_mark(spark, sf), d, m, adaptive=True)


@query("hybrid_risk_model_only", q(top_score("s"), CONF, rarity_sql("true"), FOUR, DIST, ADAPT))
def _(spark, sf):
    d, m = two_scores(spark, sf)
    return R.hybrid_risk(d, n_mark(spark, sf), model=m)


VOTE_MARK = with_sql("", RELEASE_SQL, SCORES_SQL, LOSS, CONF, rarity_sql("true"), FOUR, enc_sql(),
                     votes_sql(VIEWS, 3, ("l1",), 1e-8)).rstrip() + final_sql("v").replace(
    "SELECT id, round(", ", fin AS (SELECT id AS row_id, (").replace(",6) AS score FROM sc", ") AS d FROM sc)") + """
SELECT row_id, CAST(row_number() OVER (ORDER BY -round(0.6*d+0.4*s,9), row_id)<=""" + N_MARK + """ AS INT) AS mark FROM fin JOIN four USING (row_id)"""


@query("hybrid_risk_votes", VOTE_MARK)
def _(spark, sf):
    people, released = subject_and_release(spark, sf)
    a, c = encoded(spark, sf, both=(people, released))
    d = M.stability_vote(a, c, VIEWS, 3).select(F.col("id").alias("row_id"), F.col("score").alias("s_distance"))
    m = R.four_part_score(with_leaves(spark, sf, people)).select("row_id", "s_model")
    return R.hybrid_risk(d, people.count() // 10, d, m)


