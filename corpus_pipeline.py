"""Training-corpus pipeline: five stages over the documents table, each written and read again.

``run`` gives the rows of the last stage.  SQL can express neither the models
nor the encoders, so there is no oracle; tests hold the stages, and all of them
in a row, against brute-force versions.

Defined results
    null or empty text   shows no language, so it leaves in the first stage
    very long text       whole in every stage
    repeated rows, ties  equal rows share their fate: of near copies those with the
                         least doc_id stay
    null doc_id          has no id to be rejected by, so it stays in the first two stages
                         and isn't cut in the third; decontaminated and encoded as any row
    all repeats          a text that an earlier one repeats whole leaves in the third stage
    empty table          empty result
    clashing columns     all but the last stage return the columns of their input, whatever
                         they are named; the last one returns its own
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import decontamination, language, pieces, shingle_join, suffix_dedup
from siftline.llm.registry import vocabulary
from siftline.llm.shared import Scratch, drop_path, new_path
from siftline.session import ship, table

# Near copies share this part of their runs of so many words.  The narrower ones of op9_ngram_jaccard are its own.
NEAR_COPIES = {"n": 5, "num": 80, "den": 100}


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known well enough."""
    ship(spark)
    return language.keep(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    ship(spark)
    return shingle_join.representatives(docs, **NEAR_COPIES)


def dedup_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without byte strings that occur earlier; texts that are nothing else leave."""
    ship(spark)
    return suffix_dedup.dedup(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs."""
    return decontamination.remove(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the texts, as packed unsigned 32-bit integers, with digests of ids and decoded text.

    Workers keep fewer units and encode less at once than by default: the stages before leave executors with less room.
    """
    ship(spark)
    encoded = pieces.encode(docs.select("doc_id", "lang", "source", "text"), vocabulary("piece_bpe_32k.model"), cache_units=150_000, slice_bytes=1 << 20)
    return encoded.select(
        "doc_id",
        "lang",
        "source",
        "n_tokens",
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("suffix_dedup", dedup_substrings),
    ("decontamination", decontaminate),
    ("sentencepiece", sentencepiece),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what stages write on the way goes as soon as the next table is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_path(spark, name)
        with Scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
