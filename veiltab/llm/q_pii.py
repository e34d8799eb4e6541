"""Query on personal data."""
from pyspark.sql import functions as F

from veiltab.llm.pii import KINDS, joined_text, redactions


def op5_pii_boosting(spark, sf_dir):
    found = redactions(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    kinds = F.transform("base", lambda s: s["kind"])  # spans that the method adds are in ``spans`` only
    counts = [F.size(F.array_remove(kinds, k)).alias(f"_{kind}") for k, kind in enumerate(KINDS)]
    counts = [(F.size("base") - c).cast("long").alias(f"n_{kind}") for c, kind in zip(counts, KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined_text(F.col("spans")).alias("spans"))


QUERIES = {"op5_pii_boosting": (op5_pii_boosting, None)}
