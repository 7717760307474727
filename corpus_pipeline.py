"""The training-data pipeline: language ID, line dedup, near-dedup, packing.

Each stage takes (spark, docs, folder of the tables) and returns a DataFrame, which is written as Parquet
and read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import langid, linededup, neardup, packing, storage
from docloom.llm.queries import table, vocabulary

#: Words that a Python worker remembers while packing.
WORDS = 200_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language: null texts and those without any letter."""
    model = langid.fit(docs)
    if not model.langs or any(langid.UNKNOWN in members for members in model.langs.values()):
        # Nothing was learned, or a label is named like no language: the prediction does not tell who has no letter.
        return docs.filter(langid.has_letter(F.col("text"))).select(*COLUMNS)
    return langid.predict(docs, model).filter(F.col("lang_pred") != langid.UNKNOWN).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that ten documents share; ``n_chars`` is that of what is left."""
    out = linededup.clean_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates the document with the smallest ``doc_id``.

    Rows that share that ``doc_id``, and rows without one, stay together.
    """
    kept = neardup.near_documents(docs).filter("kept").select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__kept"]), "left_semi").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens. The workers are those of the stages before: they remember fewer words."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), keep=WORDS)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("pack", pack)]

#: The language model and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = storage.materialise(stage(spark, docs, sf_dir), name)
    return docs
