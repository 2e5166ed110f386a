"""Line dedup (operator 9), in DataFrame functions only.

Lines are exploded, normalised and hashed; documents are counted for each hash; the
positions of lines that too many documents share are gathered by document, and each text
is put together again from the positions that are left.

Defined results: a null or empty text is one empty line; empty keys are never dropped
(min_key_chars is 1 or more); a text that loses all lines becomes empty; each row counts
as a document of its own, also where a doc_id repeats; texts and lines of any length are worked on
whole; a line in exactly min_docs documents is dropped; an empty table gives an empty
result; further columns are kept as they are, but those that go by the names given for
`n_lines` and `n_dropped` are replaced.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.llm.common import bounded_broadcast, fresh, materialize

SPACES = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACES)), string.ascii_uppercase, string.ascii_lowercase)


def _hashed(docs: DataFrame, min_key_chars: int) -> DataFrame:
    """drop_id and drop_text (doc_id and a hash of the text), pos and a 128-bit hash of the key of each line that may be dropped."""
    lines = docs.select(F.col("doc_id").alias("drop_id"), F.xxhash64("text").alias("drop_text"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line")).withColumn("key", line_key(F.col("line")))
    return lines.where(F.char_length("key") >= max(1, min_key_chars)).select("drop_id", "drop_text", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


def shared_lines(docs: DataFrame, min_docs: int = 10, min_key_chars: int = 1) -> DataFrame:
    """h1, h2, n_docs: the hashes of keys found in at least `min_docs` documents."""
    per_doc = F.array_distinct(
        F.transform(
            F.filter(F.transform(lines_of(F.col("text")), line_key), lambda k: F.char_length(k) >= max(1, min_key_chars)),
            lambda k: F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit("second"), k).alias("h2")),
        )
    )
    keys = docs.select(F.explode(per_doc).alias("k")).select("k.h1", "k.h2")
    return keys.groupBy("h1", "h2").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_docs)


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_key_chars: int = 1, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """`docs` with the shared lines taken out of text, and the columns `n_lines` and `n_dropped`."""
    docs = docs.drop(n_lines, n_dropped)
    shared = materialize(shared_lines(docs, min_docs, min_key_chars).select("h1", "h2"), "shared-lines")
    shared = bounded_broadcast(shared, shared.count())
    drop = _hashed(docs, min_key_chars).join(shared, ["h1", "h2"]).groupBy("drop_id", "drop_text").agg(F.collect_set("pos").alias("drop"))
    drop = drop.withColumnsRenamed({c: fresh(c, docs) for c in drop.columns})
    drop_id, drop_text, gone = (drop[c] for c in drop.columns)
    lines = lines_of(docs["text"])
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    rest = F.get(F.transform(F.array(lines), lambda x: F.array_join(F.transform(left, lambda i: F.get(x, i)), "\n")), 0)
    text = F.when(gone.isNull(), F.coalesce(docs["text"], F.lit(""))).otherwise(rest)
    return docs.join(drop, docs["doc_id"].eqNullSafe(drop_id) & (F.xxhash64(docs["text"]) == drop_text), "left").select(
        *(text.alias(c) if c == "text" else docs[c] for c in docs.columns),
        F.size(lines).cast("long").alias(n_lines),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(n_dropped),
    )
