"""Query on quality scores."""
from pyspark.sql import functions as F

from veiltab.llm.quality import fit, fold

THRESHOLD = 0.3


def op3_quality_compression(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    scored = fit(docs, labels).score(docs)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op3_quality_compression": (op3_quality_compression, None)}
