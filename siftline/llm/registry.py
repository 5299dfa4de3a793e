"""Queries of this package and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import chat, decontamination, filter_audit, language, mixing, oracles, pieces, quality, shingle_join, suffix_dedup, token_counts, token_files, url_filter
from siftline.llm.shared import Scratch
from siftline.session import table


# The production rules of the URL filter.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def llm_page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of raw pages: visible text, declared markup, address; models from the documents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text", F.col("lang").alias("label"))
    pages = table(spark, sf_dir, "pages").select("page_id", "html", "url")
    return language.identify(pages, "page_id", "html", None, "url", model=language.fit(docs))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chat(table(spark, sf_dir, "conversations"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id",
        *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")],
    )


def vocabulary(name: str) -> str:
    """Place of a public tokenizer file; the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = pieces.encode(docs, vocabulary("piece_bpe_32k.model"))
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
        "agrees",
    )


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.SuffixDedup(table(spark, sf_dir, "documents")).digests()


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.ShingleJoin(table(spark, sf_dir, "documents"), n=3, num=90, den=100).component_ids()


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.with_token_counts(docs, vocabulary("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.scan(docs, table(spark, sf_dir, "benchmark"))
    hits = F.aggregate("contamination.hits", F.lit(0).cast("long"), lambda a, x: a + x["last"] - x["first"] + 1)
    return found.select(
        "doc_id",
        F.col("contamination.n_words").alias("n_words"),
        hits.alias("n_hit"),
        F.size("contamination.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("contamination.items"), ","), 256).alias("items_sha256"),
        (F.size("contamination.items") > 0).alias("contaminated"),
    )


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    files = token_files.write(docs, vocabulary("byte_bpe_50k.json"), end_id=2)
    ids = token_files.digest(files.read(files.entries.select("key", "occurrence")), files.dtype)
    return ids.join(F.broadcast(files.starts()), "shard").select(
        F.col("key").alias("doc_id"),
        (F.col("before") + F.col("offset")).alias("start"),
        "n_tokens",
        "ids_crc32",
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as block:
        mix = mixing.Mix(table(spark, sf_dir, "documents"))
        return block.keep(mix.taken().withColumnRenamed("key", "doc_id"))


def queries() -> dict:
    return {
        "op11_filter_audit": op11_filter_audit,
        "op12_mixing": op12_mixing,
        "op1_decontamination": op1_decontamination,
        "op7_token_files": op7_token_files,
        "op2_language_id": op2_language_id,
        "llm_page_languages": llm_page_languages,
        "op5_chat_format": op5_chat_format,
        "op6_url_filter": op6_url_filter,
        "op3_quality_rules": op3_quality_rules,
        "op4_sentencepiece": op4_sentencepiece,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_ngram_jaccard": op9_ngram_jaccard,
        "op10_token_counts": op10_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql(URL_RULES)
