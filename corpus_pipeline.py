"""A corpus from raw documents to token ids: each stage is one operator of helixmill.llm.

Stages hand over Parquet: each result is written to the shared folder and read again.

Defined results: a null text counts as empty, so quality rules reject it; a null doc_id, lang
or source is a value like others (near-dedup links no row without doc_id); of rows that repeat
a doc_id, near-dedup keeps one; very long texts are worked on whole; an empty table gives an
empty result; further columns pass all stages but the last unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from helixmill.llm import cpsjoin, linededup, mixing, quality, spm
from helixmill.llm.common import fresh, materialize

#: A public SentencePiece model; the operator takes its path as a parameter.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie within the fences of their language and source."""
    return quality.filter_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten or more documents share."""
    d = linededup.dedup_lines(docs, min_docs=10, n_lines=fresh("n_lines", docs), n_dropped=fresh("n_dropped", docs))
    return d.select(*(d[c] for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more of five-word shingles."""
    return cpsjoin.keep_one(docs, k=5, percent=80)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each time that a document is taken."""
    return mixing.mix(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text of the mix, and whether they decode to it."""
    return spm.round_trip(docs, TOKENIZER).select("doc_id", "source", "lang", "n_tokens", "ids", "decoded_sha256", "round_trip")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("sentencepiece", sentencepiece),
]

#: Tokens of a SentencePiece model can't be made in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
