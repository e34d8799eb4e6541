"""Training-set shaping, MLlib models and calibration."""
from __future__ import annotations

import json
import math
import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veiltab.functions.clean import odds_to_unit, to_number, vif_to_unit
from veiltab.functions.hashing import uniform
from veiltab.operators import fit
from veiltab.operators.encode import encode_glm
from veiltab.operators.metrics import confidence_gap, confidence_metrics, neg_log_lik
from veiltab.operators.ranks import hash_rank
from veiltab.operators.ranktest import area_under_curve
from veiltab.operators.select import stratified_split
from veiltab.session import materialize

ROW = "row_id"
# Columns of the logistic table, in order.
LOGISTIC_COLUMNS = ["coef", "p_value", "OR_norm", "CI_low_norm", "CI_high_norm", "VIF_norm"]
# What trees get for infinite and missing numbers, and the prefix of the columns that hold it.
LARGEST, MISSING, FILLED = 1e300, -1e305, "__filled_"
FITS_AT_ONCE = 4  # fits of one selection that run side by side
# Temperatures tried when calibrating.
TEMPERATURES = [1.0, 1.2, 1.5, 1.8, 2.0, 2.5]


# ---------------------------------------------------------------- training set

def class_weight(df: DataFrame, y: str = "y") -> DataFrame:
    """``weight`` = negatives / positives on positives, 1 on negatives."""
    got = fit.row(df, p=F.count_if(F.col(y) == 1), n=F.count_if(F.col(y) == 0))
    ratio = got["n"] / max(got["p"], 1)
    return df.withColumn("weight", F.when(F.col(y) == 1, float(ratio)).otherwise(1.0))


def soft_labels(df: DataFrame, eps: float, y: str = "y") -> DataFrame:
    """Smoothed target s = y (1 - 2 eps) + eps as two weighted hard-label rows, which gives the
    same loss to a learner that needs hard labels."""
    if not 0 <= eps <= 0.1:
        raise ValueError("eps must lie in [0, 0.1]")
    s = F.col(y) * (1 - 2 * eps) + eps
    rows = F.array(F.struct(F.lit(1).alias(y), s.alias("weight")),
                   F.struct(F.lit(0).alias(y), (1 - s).alias("weight")))
    return df.select(*[c for c in df.columns if c != y], F.inline(rows))


def label_noise(df: DataFrame, p: float, y: str = "y", salt: str = "label", row_id: str = ROW) -> DataFrame:
    """Flip labels with probability p (at most a quarter)."""
    if not 0 <= p <= 0.25:
        raise ValueError("p must lie in [0, 0.25]")
    return df.withColumn(y, F.when(uniform(salt, row_id) < p, 1 - F.col(y)).otherwise(F.col(y)))


def symmetric_beta(alpha: float, salt: str, row_id: str | Column = ROW) -> Column:
    """A Beta(alpha, alpha) draw for a row, exact for every alpha > 0, from two hashed uniforms.

    With T = sqrt(w) cos(2 pi v) and w = u^(-1/alpha) - 1, T is a scaled t variable with 2 alpha degrees of freedom, and
    (1 + T / sqrt(1 + T^2)) / 2 is the draw. It needs no rejection, hence no loop and no limit of trials.
    """
    if alpha <= 0:
        raise ValueError("alpha must be positive")
    u = F.greatest(uniform(salt + "/u", row_id), F.lit(2.0 ** -32))
    w = F.greatest(F.pow(u, F.lit(-1.0 / alpha)) - 1.0, F.lit(1e-300))
    turn = F.cos(uniform(salt + "/v", row_id) * (2.0 * math.pi))
    return 0.5 + turn / (2.0 * F.sqrt(1.0 / w + turn * turn))


def mixup(df: DataFrame, cols: list[str], y: str, ratio: float, alpha: float, salt: str = "mixup",
          row_id: str = ROW) -> DataFrame:
    """ratio * n new rows lambda x_i + (1 - lambda) x_j with lambda ~ Beta(alpha, alpha), the
    target mixed alike; pairs are equal places in two hashed orders of the table."""
    n = int(df.count() * ratio)
    base = df.select(row_id, *[F.col(c).cast("double").alias(c) for c in [*cols, y]])
    left = hash_rank(base, [], f"{salt}/i", row_id).filter(F.col("rn") <= n)
    right = hash_rank(base, [], f"{salt}/j", row_id).filter(F.col("rn") <= n).select(
        "rn", *[F.col(c).alias(f"__{c}") for c in [*cols, y]])
    lam = F.col("lam")
    return left.join(right, "rn").withColumn("lam", symmetric_beta(alpha, f"{salt}/l", row_id)).select(
        "rn", "lam", *[(lam * F.col(c) + (1 - lam) * F.col(f"__{c}")).alias(c) for c in [*cols, y]])


# ---------------------------------------------------------------- logistic table

def vif(df: DataFrame, cols: list[str]) -> dict[str, float]:
    """Variance inflation factors 1 / (1 - R^2) of each column on the others.

    Infinite for a constant column and for one that the others determine.
    """
    vec = VectorAssembler(inputCols=cols, outputCol="v").transform(df).select("v")
    m = Correlation.corr(vec, "v").first()[0].toArray()
    out = {}
    for i, c in enumerate(cols):
        rest = [j for j in range(len(cols)) if j != i and np.isfinite(m[i, j])]
        if not np.isfinite(m[i]).any() or (len(cols) > 1 and not rest):
            out[c] = float("inf")
            continue
        r, sub = m[i, rest], m[np.ix_(rest, rest)]
        fit = float(r @ np.linalg.pinv(np.nan_to_num(sub), rcond=1e-10, hermitian=True) @ r) if rest else 0.0
        out[c] = float("inf") if 1.0 - fit < 1e-9 else 1.0 / (1.0 - fit)
    return out


def fit_glm(df: DataFrame, cols: list[str], y: str):
    """Binomial GLM with logit link on named columns."""
    vec = VectorAssembler(inputCols=cols, outputCol="features").transform(df)
    glm = GeneralizedLinearRegression(family="binomial", link="logit", labelCol=y, featuresCol="features",
                                      maxIter=50, tol=1e-8)
    return glm.fit(vec), vec


@dataclass(frozen=True)
class LogitTerms:
    """A fitted logit on raw columns. Levels and fill values are those of the table it was fitted on, so that another
    table is scored by the same terms: a level it alone has counts as the base level, a missing number as the fill."""

    intercept: float
    numbers: dict[str, float]
    levels: dict[str, dict[str, float]]
    fills: dict[str, float]

    def logit(self) -> Column:
        z = F.lit(self.intercept)
        for c, b in self.numbers.items():
            z = z + F.coalesce(to_number(c), F.lit(self.fills[c])) * b
        for c, coef in self.levels.items():
            text = F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("(NA)"))
            z = z + fit.lookup(text, coef, 0.0)
        return z


def fit_logit(df: DataFrame, target: str, cols: list[str]) -> LogitTerms:
    """Binomial GLM of ``target`` on numbers and one-hot categories, as terms that score any table with these columns."""
    rows = materialize(df.filter(F.col(target).isin(0, 1)).select(target, *cols))
    enc = materialize(encode_glm(rows, cols, [target]))
    terms = [c for c in enc.columns if c != target]
    plain = {t: f"x{i}" for i, t in enumerate(terms)}
    model, _ = fit_glm(enc.withColumnsRenamed(plain), list(plain.values()), target)
    numbers, levels = {}, {}
    for t, b in zip(terms, model.coefficients):
        if t in cols:
            numbers[t] = float(b)
        else:
            c = max((c for c in cols if t.startswith(f"{c}_")), key=len)
            levels.setdefault(c, {})[t[len(c) + 1:]] = float(b)
    fills = fit.medians(rows.select(*[to_number(c).alias(c) for c in numbers]), list(numbers)) if numbers else {}
    return LogitTerms(float(model.intercept), numbers, levels, fills)


def logistic_table(df: DataFrame, target: str, cols: list[str], row_id: str = ROW, test_share: float = 0.2,
                   ensure_terms: list[str] | None = None, keep_missing: bool = False, salt: str = "glm"
                   ) -> tuple[DataFrame, float]:
    """Coefficients, p-values and odds ratios (Wald 95 %) mapped to [0, 1], VIF, and the test AUC.

    Terms are the union of the fitted ones and ``ensure_terms``; absent entries are 0 (or null).
    """
    rows = df.filter(F.col(target).isin(0, 1))
    enc = materialize(encode_glm(rows, cols, [row_id, target]))
    terms = [c for c in enc.columns if c not in (row_id, target)]
    parts = stratified_split(enc, target, test_share, salt, row_id)
    train, test = parts.filter("is_test = 0"), parts.filter("is_test = 1")
    plain = {t: f"x{i}" for i, t in enumerate(terms)}
    rename = {t: x for t, x in plain.items()}
    train, test = train.withColumnsRenamed(rename), test.withColumnsRenamed(rename)
    model, _ = fit_glm(train, list(plain.values()), target)
    summ = model.summary
    inflation = vif(train, list(plain.values()))
    rec = [(t, float(model.coefficients[i]), float(summ.pValues[i]), float(summ.coefficientStandardErrors[i]),
            inflation[plain[t]]) for i, t in enumerate(terms)]
    fitted = df.sparkSession.createDataFrame(rec, "term string, coef double, p_value double, se double, vif double")
    z = 1.959963984540054
    table = fitted.select(
        "term", "coef", "p_value", odds_to_unit(F.exp("coef")).alias("OR_norm"),
        odds_to_unit(F.exp(F.col("coef") - z * F.col("se"))).alias("CI_low_norm"),
        odds_to_unit(F.exp(F.col("coef") + z * F.col("se"))).alias("CI_high_norm"), vif_to_unit("vif").alias("VIF_norm"))
    out = fixed_term_table(table, terms, ensure_terms or [], keep_missing)
    pred = model.transform(VectorAssembler(inputCols=list(plain.values()), outputCol="features").transform(test))
    return out, area_under_curve(pred.select(F.col(target).alias("y"), "prediction"), "y", "prediction").first()[0]


def fixed_term_table(table: DataFrame, base: list[str], ensure: list[str], keep_missing: bool = False) -> DataFrame:
    """The union of both term lists in order; absent statistics are 0 or stay null."""
    terms = sorted(set(base) | set(ensure))
    grid = table.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    out = grid.join(table, "term", "left")
    cols = [c for c in table.columns if c != "term"]
    return out if keep_missing else out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in cols})


# ---------------------------------------------------------------- boosted trees

def boosted_fit(df: DataFrame, features: list[str], target: str, valid: str | None = None, weight: str | None = None,
                trees: int = 600, depth: int = 6, step: float = 0.05, subsample: float = 0.9, columns: str = "all",
                seed: int = 7) -> PipelineModel:
    """Gradient-boosted trees with early stopping on rows where ``valid`` is true.

    A missing number goes below all others (``MISSING``), infinite ones to the ends, by a stage of the pipeline: MLlib's
    trees refuse vectors that are not finite.
    """
    gbt = GBTClassifier(labelCol=target, featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=step,
                        subsamplingRate=subsample, featureSubsetStrategy=columns, seed=seed, leafCol="leaf_id")
    if valid:
        gbt = gbt.setValidationIndicatorCol(valid)
    if weight:
        gbt = gbt.setWeightCol(weight)
    number = {c: "double(`{}`)".format(c.replace("`", "``")) for c in features}
    filled = ", ".join(f"CASE WHEN isnotnull({x}) AND NOT isnan({x}) THEN greatest(least({x}, {LARGEST}D), -{LARGEST}D) ELSE {MISSING}D END AS `{FILLED}{i}`"
                       for i, x in enumerate(number.values()))
    complete = SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__")
    assembler = VectorAssembler(inputCols=[f"{FILLED}{i}" for i in range(len(features))], outputCol="features")
    return Pipeline(stages=[complete, assembler, gbt]).fit(df)


def predict(model: PipelineModel, df: DataFrame, keep: list[str]) -> DataFrame:
    """Kept columns plus ``p`` (probability of 1) and ``leaf`` (leaf index per tree)."""
    out = model.transform(df)
    return out.select(*keep, vector_to_array("probability")[1].alias("p"),
                      F.transform(vector_to_array("leaf_id"), lambda x: x.cast("int")).alias("leaf"))


def predict_threshold(p: Column, threshold: float = 0.5) -> Column:
    return (p >= threshold).cast("int")


def clip_probability(p: Column, eps: float = 0.02) -> Column:
    if not 0 <= eps <= 0.2:
        raise ValueError("eps must lie in [0, 0.2]")
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))


def multi_seed_select(df: DataFrame, features: list[str], target: str, valid: str, seeds: list[int],
                      alpha: float = 0.1, tol: float = 1e-6, **params) -> tuple[PipelineModel, DataFrame]:
    """Fit once per seed and keep the lowest validation penalised loss; within ``tol`` the lower
    over-confidence, then the smaller train-validation confidence gap decides. The fits read one
    written table and run side by side, as a fit of many small jobs leaves most executors idle."""
    data = materialize(df)

    def one(seed: int) -> tuple[PipelineModel, dict]:
        model = boosted_fit(data, features, target, valid, seed=seed, **params)
        out = materialize(predict(model, data, [F.col(target).alias("y"), F.col(valid).cast("string").alias("split")]))
        m = {r["split"]: r for r in confidence_metrics(out, "split", alpha=alpha).collect()}["true"]
        gap = confidence_gap(out, "split", "false", "true").first()[0]
        return model, {"seed": seed, "nll": m["nll"], "penalised": m["penalised_loss"], "over": m["extreme_share"], "gap": gap}

    with ThreadPoolExecutor(max_workers=min(len(seeds), FITS_AT_ONCE)) as pool:
        done = list(pool.map(inheritable_thread_target(df.sparkSession)(one), seeds))
    best = done[0]
    for fitted in done[1:]:
        if _better(fitted[1], best[1], tol):
            best = fitted
    table = [rec for _, rec in done]
    rows = [(r["seed"], r["nll"], r["penalised"], r["over"], r["gap"], int(r is best[1])) for r in table]
    return best[0], df.sparkSession.createDataFrame(
        rows, "seed int, nll double, penalised double, over double, gap double, chosen int")


def _better(a: dict, b: dict, tol: float) -> bool:
    if abs(a["penalised"] - b["penalised"]) >= tol:
        return a["penalised"] < b["penalised"]
    if abs(a["over"] - b["over"]) >= tol:
        return a["over"] < b["over"]
    return a["gap"] < b["gap"]


# ---------------------------------------------------------------- calibration

def margin(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    return F.log(q / (1 - q))


def temperature_scale(df: DataFrame, y: str = "y", p: str = "p", grid: list[float] | None = None) -> DataFrame:
    """Log-loss per temperature, and which temperature is best (the smallest wins ties)."""
    temps = F.array(*[F.lit(float(t)) for t in (grid or TEMPERATURES)])
    scored = df.select(y, margin(F.col(p)).alias("m"), F.explode(temps).alias("temperature")).withColumn(
        "q", 1.0 / (1.0 + F.exp(-F.col("m") / F.col("temperature"))))
    loss = scored.groupBy("temperature").agg(F.avg(neg_log_lik(y, "q", 1e-15)).alias("logloss"))
    best = loss.agg(F.min(F.struct(F.round("logloss", 12), "temperature")).alias("b")).select(
        F.col("b.temperature")).scalar()
    return loss.withColumn("best", (F.col("temperature") == best).cast("int"))


def platt_scale(df: DataFrame, y: str = "y", p: str = "p") -> tuple[float, float]:
    """Slope and intercept of a logistic fit on the margin with unit L2 penalty on the slope."""
    data = materialize(df.select(F.col(y).cast("double").alias("label"), margin(F.col(p)).alias("m")))
    vec = VectorAssembler(inputCols=["m"], outputCol="features").transform(data)
    lr = LogisticRegression(regParam=1.0 / max(data.count(), 1), elasticNetParam=0.0, standardization=False,
                            maxIter=200, tol=1e-10).fit(vec)
    return float(lr.coefficients[0]), float(lr.intercept)


# ---------------------------------------------------------------- persistence

def model_save(model: PipelineModel, path: str, features: list[str], target: str) -> None:
    """The pipeline plus a one-row JSON note of the feature list and the target."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(features), target)], "feature_names string, target string").write.mode(
        "overwrite").json(f"{path}/note")


def model_load(path: str, default_target: str | None = None) -> tuple[PipelineModel, list[str], str | None]:
    """(model, features, target): from the note, else from the model's stages and the default."""
    model = PipelineModel.load(f"{path}/model")
    spark = SparkSession.getActiveSession()
    features, target = None, default_target
    try:
        note = spark.read.schema("feature_names string, target string").json(f"{path}/note").first()
    except AnalysisException as e:  # a model saved without its note is still usable
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        note = None
    if note:
        features, target = json.loads(note["feature_names"]), note["target"]
    if features is None:
        features = _feature_names(model)
    return model, features, target


def _feature_names(model: PipelineModel) -> list[str]:
    """Feature columns of a fitted pipeline: those its first stage fills, or its assembler's in models saved without that stage."""
    first = model.stages[0]
    if not isinstance(first, SQLTransformer):
        return list(first.getInputCols())
    return [c.replace("``", "`") for c in re.findall(r"isnotnull\(double\(`((?:[^`]|``)+)`\)\)", first.getStatement())]
