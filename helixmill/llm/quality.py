"""Quality rules with adaptive thresholds (operator 1).

Every text is measured once; the measures of all documents of a language and source go
into mergeable quantile sketches (DDSketch: counts of logarithmic buckets with a fixed
relative error, merged by adding counts); fences derived from the sketched quartiles take
the place of fixed cutoffs and are joined back to the measures.

Defined results: a null text counts as empty (no words, hence base_failed); null lang or
source form groups of their own; equal rows are measured and judged alike, each on its
own; a measure just on a fence passes; texts of any length are measured whole, a row in one
task; an empty table gives an empty result; further columns of the input are ignored by
`measure` and kept by `filter_documents`, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.llm.common import bounded_broadcast, chunks, codes, fresh, materialize, per_row, small_batches, split_lines, split_words, text_or_empty

SYMBOLS_RE = r"[#*$%&|<>]"
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long"
WINDOW_WORDS = 5

#: measure: (expression over the columns of MEASURES, least spread, whether too low is also bad)
RULES = {
    "symbols_per_word": ("try_divide(n_symbols, n_words)", 0.05, False),
    "dup_line_share": ("try_divide(n_dup_lines, n_lines)", 0.1, False),
    "repeat_share": ("try_divide(n_repeat_words, n_words)", 0.05, False),
    "mean_word_chars": ("try_divide(word_chars, n_words)", 0.5, True),
}
RELATIVE_ERROR = 0.01
_LN_GAMMA = math.log((1 + RELATIVE_ERROR) / (1 - RELATIVE_ERROR))
#: Values up to this share the lowest bucket and are read back as 0.
LEAST = 1e-6
_LOWEST = math.ceil(math.log(LEAST) / _LN_GAMMA)


def _repeat_words(word: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Words covered by windows of five that occur again in the same text; exact, in linear memory."""
    if len(word) < WINDOW_WORDS:
        return np.zeros(n, np.int64)

    def number(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return pd.factorize(a * (int(b.max()) + 1) + b)[0].astype(np.int64)

    pair = number(word[:-1], word[1:])
    four = number(pair[:-2], pair[2:])
    start = np.flatnonzero(row[: -WINDOW_WORDS + 1] == row[WINDOW_WORDS - 1 :])
    if not len(start):
        return np.zeros(n, np.int64)
    window = number(number(four[start], word[start + WINDOW_WORDS - 1]), row[start])
    again = start[np.bincount(window)[window] > 1]
    edge = np.zeros(len(word) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + WINDOW_WORDS, -1)
    return per_row((np.cumsum(edge[:-1]) > 0).astype(float), row, n)


def _dup_lines(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word that equal an earlier line of their text, and all lines with a word."""
    lines, row = split_lines(texts)
    real = pc.match_substring_regex(lines, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    code, _ = codes(lines.filter(pa.array(real)))
    row = row[real]
    if not len(code):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    first = ~pd.Series(row * (int(code.max()) + 1) + code).duplicated().to_numpy()
    every = np.bincount(row, minlength=n)
    return every - np.bincount(row[first], minlength=n), every


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in chunks(whole, "text"):
            texts, n = text_or_empty(b.column("text")), b.num_rows
            words, row = split_words(texts)
            code, _ = codes(words)
            dup, lines = _dup_lines(texts, n)
            out = {
                "n_words": np.bincount(row, minlength=n).astype(np.int64),
                "word_chars": per_row(pc.utf8_length(words).to_numpy(zero_copy_only=False), row, n),
                "n_symbols": pc.count_substring_regex(texts, SYMBOLS_RE).cast(pa.int64()),
                "n_dup_lines": dup,
                "n_lines": lines.astype(np.int64),
                "n_repeat_words": _repeat_words(code, row, n),
            }
            yield pa.RecordBatch.from_pydict({c: b.column(c) for c in b.schema.names if c != "text"} | {k: pa.array(v) for k, v in out.items()})


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the measures of each row's whole text."""
    return docs.select("doc_id", "lang", "source", "text").mapInArrow(_measure, f"doc_id {dict(docs.dtypes)['doc_id']}, lang string, source string, {MEASURES}")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _bucket(x: Column) -> Column:
    return F.when(x <= LEAST, F.lit(_LOWEST)).otherwise(F.ceil(F.log(x) / _LN_GAMMA)).cast("int")


def _value(bucket: Column) -> Column:
    return F.when(bucket <= _LOWEST, F.lit(0.0)).otherwise(2 * F.exp(bucket * _LN_GAMMA) / (math.exp(_LN_GAMMA) + 1))


def sketches(measures: DataFrame) -> DataFrame:
    """lang, source, rule, bucket, n: one sketch for each language, source and rule; merge by summing n."""
    rules = F.array(*(F.struct(F.lit(k).alias("rule"), F.expr(e).cast("double").alias("x")) for k, (e, *_) in RULES.items()))
    return (
        measures.select("lang", "source", F.explode(rules).alias("r"))
        .where("r.x is not null")
        .groupBy("lang", "source", "r.rule", _bucket(F.col("r.x")).alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


def quantiles(sketch: DataFrame, keys: list[str], at: dict[str, float]) -> DataFrame:
    """keys, total and a column for each named quantile, of sketches merged by `keys`."""
    merged = sketch.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys)
    return (
        merged.withColumn("upto", F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("total", F.sum("n").over(w))
        .groupBy(*keys)
        .agg(F.max("total").alias("total"), *(_value(F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("bucket")))).alias(k) for k, q in at.items()))
    )


def fences(sketch: DataFrame, reach: float = 4.0, prior_rows: float = 100.0) -> DataFrame:
    """lang, source and low/high fences of each rule: quartile -/+ reach * spread.

    A group's quartiles are drawn towards its language's as if it had `prior_rows` more documents like that, and a language's
    towards those of all documents; both come from the same sketches, merged. So no number of documents is a step.
    """
    at = {"q1": 0.25, "q3": 0.75}
    of = quantiles(sketch, ["lang", "source", "rule"], at).select("lang", "source", "rule", F.struct("total", "q1", "q3").alias("own"))
    lang = quantiles(sketch, ["lang", "rule"], at).select(F.col("lang").alias("l_lang"), F.col("rule").alias("l_rule"), F.struct("total", "q1", "q3").alias("by_lang"))
    every = quantiles(sketch, ["rule"], at).select(F.col("rule").alias("a_rule"), F.struct("total", "q1", "q3").alias("by_all"))

    def drawn(c: str, k: str, to: Column) -> Column:
        n = F.col(f"{c}.total")
        return (n * F.col(f"{c}.{k}") + prior_rows * to) / (n + prior_rows)

    d = of.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("rule") == F.col("l_rule"))).join(every, F.col("rule") == F.col("a_rule"))
    d = d.withColumn("q", F.struct(*(drawn("own", k, drawn("by_lang", k, F.col(f"by_all.{k}"))).alias(k) for k in at)))
    least = F.create_map(*(F.lit(x) for k, (_, s, _) in RULES.items() for x in (k, s)))
    d = d.withColumn("spread", reach * F.greatest(F.col("q.q3") - F.col("q.q1"), least[F.col("rule")]))
    pick = lambda rule, e: F.max(F.when(F.col("rule") == rule, e))
    return d.groupBy("lang", "source").agg(
        *(pick(k, F.col("q.q3") + F.col("spread")).alias(f"{k}_high") for k in RULES),
        *(pick(k, F.col("q.q1") - F.col("spread")).alias(f"{k}_low") for k, (*_, both) in RULES.items() if both),
    )


def judge(measures: DataFrame, reach: float = 4.0, prior_rows: float = 100.0) -> DataFrame:
    """The measures with base_failed, the fences of each row's group and kept.

    Fences come from the documents that pass the base rules; a value on a fence passes.
    """
    f = fences(sketches(measures.where(~base_failed())), reach, prior_rows).withColumnsRenamed({"lang": "f_lang", "source": "f_source"})
    inside = F.lit(True)
    for k, (e, _, both) in RULES.items():
        inside &= F.coalesce(F.expr(e) <= F.col(f"{k}_high"), F.lit(True))
        if both:
            inside &= F.coalesce(F.expr(e) >= F.col(f"{k}_low"), F.lit(True))
    return (
        measures.join(f, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left")
        .drop("f_lang", "f_source")
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & inside)
    )


def quality(docs: DataFrame, reach: float = 4.0, prior_rows: float = 100.0) -> DataFrame:
    """A row of measures, fences and verdict for each row of `docs`."""
    with small_batches(docs.sparkSession):
        measures = materialize(measure(docs), "quality")
    return judge(measures, reach, prior_rows)


def filter_documents(docs: DataFrame, reach: float = 4.0, prior_rows: float = 100.0) -> DataFrame:
    """The rows of `docs` that pass, with all their columns.

    Verdicts meet their rows by doc_id (null is one, too); a doc_id that repeats stays if any
    of its rows passes. Texts are shuffled only if the rejected ids are too many to broadcast.
    """
    by_id = quality(docs, reach, prior_rows).groupBy("doc_id").agg(F.bool_or("kept").alias("kept"))
    out = fresh("out_id", docs)
    rejected = materialize(by_id.where(~F.col("kept")).select(F.col("doc_id").alias(out)), "rejected")
    return docs.join(bounded_broadcast(rejected, rejected.count()), docs["doc_id"].eqNullSafe(rejected[out]), "left_anti")
