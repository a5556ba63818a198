"""The queries of this subpackage by name: thin ones, which derive the digest columns from the operators' outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import render
from .decontaminate import contained
from .jaccard_join import linked
from .lang_crf import predict
from .license_scan import scanned
from .line_dedup import dedup_lines
from .lm_score import scored
from .packing import pack
from .quality import judged
from .shared import public_tokenizer, table
from .suffix_dedup import repeated_spans


def op1_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    out = predict(docs, learn=~held_out & F.col("doc_id").isNotNull())
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scanned(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op4_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(table(spark, sf_dir, "conversations")).withColumn("n_turns", F.col("n_turns").cast("long"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scored(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_backoff", F.round("mean_score", 6).alias("mean_score"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"), size=3, num=90, den=100)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizer("word_bpe_49k.json"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = repeated_spans(table(spark, sf_dir, "documents"))
    length = F.sum(F.col("end_word") - F.col("start_word")).alias("n_repeated")
    return spans.groupBy("doc_id").agg(F.count("*").alias("n_spans"), length, F.min("start_word").alias("first_start"), F.max("end_word").alias("last_end"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_crf,
        op2_quality_divergence,
        op3_license_scan,
        op4_chat_collapse,
        op5_decontaminate,
        op6_stupid_backoff,
        op7_line_dedup,
        op8_jaccard_join,
        op9_best_fit_packing,
        op10_suffix_dedup,
    )
}
