"""Query on nearest neighbours."""
from pyspark.sql import functions as F

from veiltab.llm.crosspolytope import nearest


def op7_cross_polytope(spark, sf_dir):
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("id") % 50 == 0, k=5)


QUERIES = {"op7_cross_polytope": (op7_cross_polytope, None)}
