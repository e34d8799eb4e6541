"""Queries on token ids."""
import zlib

import public_tokenizers

from veiltab.llm.packed import read_documents, write_ids


def op1_token_ids(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = write_ids(docs, public_tokenizers.path("word_bpe_49k.json"), vocabulary=49_408, end_id=1, spaces="drop")
    return read_documents(spark, path, lambda ids: (zlib.crc32(ids.astype("<u4").tobytes()),), "ids_crc32 long")


QUERIES = {"op1_token_ids": (op1_token_ids, None)}
