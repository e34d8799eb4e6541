"""Query on packing."""
import public_tokenizers

from veiltab.llm.packing import cut, place


def op6_best_two_fit(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    pieces = cut(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, spaces="prefix")
    return place(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {"op6_best_two_fit": (op6_best_two_fit, None)}
