"""Query on near-duplicate documents."""
from veiltab.llm.jaccard import near_duplicates


def op8_jaccard_bayes(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op8_jaccard_bayes": (op8_jaccard_bayes, None)}
