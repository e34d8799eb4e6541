"""Query on URL filtering."""
from veiltab.llm.urls import judge


def op4_url_segments(spark, sf_dir):
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


QUERIES = {"op4_url_segments": (op4_url_segments, None)}
