"""The registered queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.llm import chat, cpsjoin, cws, langid, linededup, mixing, phrases, pii, quality, repair, repeats, secrets, spm

#: Public vocabulary files; the operators take their paths as parameters.
SPM_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHAT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality.quality(documents(spark, sf_dir))
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("doc_id", "text")
    return spm.round_trip(d, SPM_MODEL, verify=True).select("doc_id", "n_tokens", "ids", "decoded_sha256", "round_trip", "same_ids", "same_text")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cpsjoin.near_duplicates(documents(spark, sf_dir), k=2, percent=80)


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    turns = turns.unionByName(spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema))
    return chat.read_back(chat.format_chats(turns, CHAT_TOKENIZER), CHAT_TOKENIZER).drop("n_tokens")


def op5_cws_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws.fingerprints(documents(spark, sf_dir))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return secrets.scan(d, secrets.train(d))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    model = langid.train(d.where(~langid.held_out(F.col("doc_id"))))
    p = langid.predict(d, model)
    return p.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = linededup.dedup_lines(documents(spark, sf_dir), min_docs=10, min_key_chars=1)
    return d.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = repeats.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"), window=50)
    return d.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repair.audit_all(turns, repair.damage(turns))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir), max_words=5, min_count=100, top=2000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_sentencepiece,
        op3_minhash_near_dedup,
        op4_chat_formatting,
        op5_cws_fingerprints,
        op6_secret_scan,
        op7_language_id,
        op8_source_mixing,
        op9_line_dedup,
        op10_personal_data,
        op11_substring_dedup,
        op12_conversation_repair,
        op13_phrase_collocations,
    )
}
