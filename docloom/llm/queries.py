"""Queries of this subpackage over the test tables: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark, folder):
    from docloom.llm import pieces

    path = vocabulary("piece_bpe_32k.model")
    docs = table(spark, folder, "documents")
    decoded = pieces.round_trip(docs, path)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"), "ids")


def op2_html_text(spark, folder):
    from docloom.llm.htmltext import extract

    return extract(table(spark, folder, "pages")).select("page_id", F.length("text").cast("long").alias("n_chars"), "text")


def op3_embedding_near_dedup(spark, folder):
    from docloom.llm.embeddings import near_vectors

    return near_vectors(table(spark, folder, "embeddings"))


def op4_fingerprints(spark, folder):
    from docloom.llm.fingerprints import fingerprints

    return fingerprints(table(spark, folder, "documents"))


def op5_minhash_near_dedup(spark, folder):
    from docloom.llm.neardup import near_documents

    return near_documents(table(spark, folder, "documents"))


def op6_line_dedup(spark, folder):
    from docloom.llm.linededup import clean_lines

    out = clean_lines(table(spark, folder, "documents"))
    return out.select("doc_id", "n_lines", F.col("n_dropped").cast("long").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_sharding(spark, folder):
    from docloom.llm.sharding import assign_shards

    return assign_shards(table(spark, folder, "documents"))


def op8_packing(spark, folder):
    from docloom.llm.packing import pack

    return pack(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_language_id(spark, folder):
    from docloom.llm.langid import fit, held_out, predict

    docs = table(spark, folder, "documents")
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), fit(docs)).drop("text")


def op10_token_files(spark, folder):
    from docloom.llm.tokenfile import read_digests, write_token_files

    return read_digests(spark, write_token_files(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"), end_id=2))


def op11_nearest_vectors(spark, folder):
    from docloom.llm.nearest import nearest_vectors

    vectors = table(spark, folder, "embeddings")
    return nearest_vectors(vectors, vectors.filter("vec_id % 100 = 0"))


def op12_prefix_trie(spark, folder):
    from docloom.llm.trie import prefix_trie

    return prefix_trie(table(spark, folder, "conversations"))


def op13_conversation_repair(spark, folder):
    from docloom.llm.repair import repaired

    return repaired(table(spark, folder, "conversations"))


QUERIES = {
    f.__name__: f for f in (
        op1_sentencepiece, op2_html_text, op3_embedding_near_dedup, op4_fingerprints, op5_minhash_near_dedup, op6_line_dedup, op7_sharding,
        op8_packing, op9_language_id, op10_token_files, op11_nearest_vectors, op12_prefix_trie, op13_conversation_repair
    )
}
