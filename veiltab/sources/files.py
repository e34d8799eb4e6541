"""CSV tables, membership vectors, the release matrix and JSON document checks."""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veiltab.session import scratch_path


def read_string_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Header CSV with every column as text; an empty field is the empty string, not null."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def read_typed_csv(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Header CSV under a given schema (no inference pass)."""
    return spark.read.csv(path, header=True, schema=schema)


def write_csv(df: DataFrame, path: str, decimals: int | None = None) -> None:
    """Header CSV; doubles optionally fixed to ``decimals`` places, blanks for null."""
    cols = [F.format_string(f"%.{decimals}f", F.round(c, decimals)).alias(c)
            if decimals is not None and t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    if decimals is not None:
        cols = [F.when(F.col(c).isNotNull(), e).alias(c) if t in ("double", "float") else e
                for (c, t), e in zip(df.dtypes, cols)]
    df.select(*cols).write.mode("overwrite").csv(path, header=True, emptyValue="", nullValue="")


def write_membership(df: DataFrame, path: str, mark: str = "mark", row_id: str = "row_id") -> None:
    """One headerless 0/1 column in row order (range-partitioned sort, one file per range)."""
    df.orderBy(row_id).select(F.col(mark).cast("int")).write.mode("overwrite").csv(path, header=False)


def read_membership(spark: SparkSession, candidates: list[str], expected: int | None = None) -> DataFrame:
    """(row_id, member) from the first readable candidate; values above 0.5 are 1, unparsable 0.

    Row ids are positions in the file set: places inside each file split plus the sizes of the
    earlier splits, so no split is read by more than one task. Part files come in order of their
    number (``part-100000`` after ``part-99999``), others in order of their path.
    """
    df = None
    for path in candidates:
        try:
            df = spark.read.schema("value string").csv(path, header=False)
            break
        except AnalysisException as e:  # a missing candidate only means: try the next one
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    if df is None:
        raise FileNotFoundError(f"none of {candidates} can be read")
    split = df.select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"),
                      F.monotonically_increasing_id().alias("m"))
    sizes = split.groupBy("f", "b").agg(F.count(F.lit(1)).alias("n"))
    number = F.regexp_extract("f", r"part-(\d+)[^/]*$", 1).try_cast("long")
    earlier = Window.orderBy(number, "f", "b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("f", "b", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("off"))
    place = F.row_number().over(Window.partitionBy("f", "b").orderBy("m"))
    out = split.withColumn("place", place).join(offsets, ["f", "b"]).select(
        (F.col("off") + F.col("place") - 1).alias("row_id"),
        F.coalesce((F.trim("value").try_cast("double") > 0.5).cast("int"), F.lit(0)).alias("member"))
    if expected is not None:
        n = out.count()
        if n != expected:
            raise ValueError(f"expected {expected} rows, found {n}")
    return out


def release_matrix(long: DataFrame, ids: DataFrame, releases: list[str], own: str | None = None,
                   zero: list[str] | None = None, row_id: str = "row_id") -> DataFrame:
    """One 0/1 column per release from (release_id, row_id, member); releases without rows are 0,
    the own release is blank, listed releases are forced to 0."""
    member = F.when(F.col("release_id").isin(zero or []), 0).otherwise(F.col("member"))
    wide = long.withColumn("member", member).groupBy(row_id).pivot("release_id", releases).agg(F.max("member"))
    out = ids.select(row_id).join(wide, row_id, "left")
    return out.select(row_id, *[
        (F.lit(None).cast("int") if r == own else F.coalesce(F.col(f"`{r}`"), F.lit(0))).alias(r) for r in releases])


def pick_vector(vectors: dict[str, DataFrame], ids: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Member flag from the first vector that has the row (in the given order), else 0."""
    out = ids.select(row_id)
    for name, v in vectors.items():
        out = out.join(v.select(row_id, F.col("member").alias(f"__{name}")), row_id, "left")
    return out.select(row_id, F.coalesce(*[F.col(f"__{n}") for n in vectors], F.lit(0)).alias("member"))


def pick_vectors(vectors: DataFrame, kinds: list[str], ids: DataFrame, releases: list[str], row_id: str = "row_id") -> DataFrame:
    """:func:`pick_vector` for many releases at once: ``release_id, row_id, member`` of every row from ``(release_id, kind, row_id, member)``."""
    place = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    first = (vectors.filter(F.col("member").isNotNull() & (place > 0)).groupBy("release_id", row_id)
             .agg(F.min(F.struct(place.alias("place"), F.col("member").cast("int").alias("member"))).alias("__first")))
    every = ids.select(row_id, F.explode(F.array(*[F.lit(r) for r in releases])).alias("release_id"))
    return every.join(first, ["release_id", row_id], "left").select("release_id", row_id, F.coalesce("__first.member", F.lit(0)).alias("member"))


# ---------------------------------------------------------------- JSON documents

def rule(name: str, ok: Column, level: str = "error") -> Column:
    """One check; a null outcome counts as a violation."""
    return F.struct(F.lit(name).alias("rule"), F.lit(level).alias("level"), F.coalesce(ok, F.lit(False)).alias("ok"))


class Json:
    """Checks on paths of a parsed document column."""

    def __init__(self, text: str):
        self.doc = F.try_parse_json(text)

    def get(self, path: str, kind: str) -> Column:
        return F.try_variant_get(self.doc, path, kind)

    def kind(self, path: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(self.doc, path, "variant"))

    def parses(self) -> Column:
        return rule("document", self.doc.isNotNull())

    def required(self, path: str, level: str = "error") -> Column:
        return rule(f"required {path}", F.try_variant_get(self.doc, path, "variant").isNotNull(), level)

    def is_type(self, path: str, prefix: str, level: str = "error") -> Column:
        return rule(f"{prefix.lower()} {path}", F.startswith(self.kind(path), F.lit(prefix)), level)

    def text(self, path: str) -> Column:
        return rule(f"text {path}", (self.kind(path) == "STRING") & (self.get(path, "string") != ""))

    def positive_int(self, path: str) -> Column:
        return rule(f"positive integer {path}", F.trim(self.get(path, "string")).try_cast("bigint") > 0)

    def constant(self, path: str, value: str) -> Column:
        return rule(f"constant {path}", self.get(path, "string") == value)

    def matches(self, path: str, pattern: str, level: str = "warning") -> Column:
        return rule(f"pattern {path}", self.get(path, "string").rlike(pattern), level)

    def filled_list(self, path: str) -> Column:
        return rule(f"non-empty list {path}", F.size(self.get(path, "array<variant>")) >= 1)

    def names(self, path: str) -> Column:
        """A JSON text that holds a list of strings."""
        return F.from_json(self.get(path, "string"), "array<string>")

    def unique_names(self, path: str) -> Column:
        n = self.names(path)
        return rule(f"unique names {path}", (F.size(n) > 0) & F.forall(n, lambda x: x.isNotNull() & (x != ""))
                    & (F.size(F.array_distinct(n)) == F.size(n)))

    def same(self, name: str, a: Column, b: Column) -> Column:
        """Equality that only binds when both sides exist."""
        return rule(name, a.isNull() | b.isNull() | (a == b))


def model_document_rules(text: str) -> list[Column]:
    """The checks of a stored boosted-tree document."""
    j = Json(text)
    both = "$.attributes"
    return [
        j.parses(), j.required(both), j.unique_names("$.attributes.feature_names"), j.text("$.attributes.target"),
        j.text("$.attributes.xgboost_version"), j.matches("$.attributes.xgboost_version", r"^\d+\.\d+\.\d+([.-].+)?$"),
        j.required("$.learner.learner_model_param"), j.positive_int("$.learner.learner_model_param.num_feature"),
        j.constant("$.learner.objective.name", "binary:logistic"),
        j.filled_list("$.learner.gradient_booster.model.trees"),
        j.same("feature count", F.size(j.names("$.attributes.feature_names")),
               F.trim(j.get("$.learner.learner_model_param.num_feature", "string")).try_cast("int")),
        j.same("feature order", j.names("$.attributes.feature_names"), j.get("$.learner.feature_names", "array<string>")),
    ]


def json_document_check(df: DataFrame, row_id: str, rules: list[Column]) -> DataFrame:
    """One row per violated rule: (id, rule, level)."""
    return df.select(row_id, F.inline(F.array(*rules))).filter(~F.col("ok")).select(row_id, "rule", "level")


def json_document_ok(df: DataFrame, row_id: str, rules: list[Column]) -> DataFrame:
    """Per document: number of errors and warnings, and whether it has no error."""
    checks = F.array(*rules)

    def count(level):
        return F.size(F.filter(checks, lambda x: ~x.getField("ok") & (x.getField("level") == level)))

    return df.select(row_id, count("error").alias("n_errors"), count("warning").alias("n_warnings")).withColumn(
        "ok", (F.col("n_errors") == 0).cast("int"))


def scratch_folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, shared by all executors."""
    return scratch_path(spark, "files")
