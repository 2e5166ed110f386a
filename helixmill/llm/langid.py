"""Language ID by multinomial naive Bayes over hashed character n-grams (operator 7).

Training counts n-grams of labelled texts by language and hash bucket; the log-probability
matrix (buckets x languages, so bounded) goes to every task by broadcast, and batches of
texts are scored with numpy from their sparse n-gram counts.

Defined results: a null text, or one without a letter, is `und` with score 0; so is every
text if nothing could be learned; rows without language or text are not learned from; equal
scores go to the language that comes first by name; texts of any length are read whole; equal rows
are predicted alike; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.llm.common import chunks, text_or_empty

SIZES = (1, 2, 3)
BITS = 16
UNKNOWN = "und"
#: Languages times buckets; more languages share fewer buckets, so that the broadcast matrix is bounded.
MOST_CELLS = 1 << 24
_MUL = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _letters() -> np.ndarray:
    """For each code point: itself if it is a letter, else a space."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(0x110000)], np.uint32)


def ngrams(texts: pa.Array, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the n-grams of all texts and their text numbers, one n at a time.

    Texts are lower-cased; each run of other characters than letters is one space.
    """
    lower = pc.utf8_lower(text_or_empty(texts))
    length = pc.utf8_length(lower).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    points = np.frombuffer("".join(f"{x} " for x in lower.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts)), length)
    points = _letters()[points]
    keep = points != 32
    keep[1:] |= points[:-1] != 32
    points, row = points[keep].astype(np.uint64), row[keep]
    h = np.zeros(len(points), np.uint64)
    for n in range(1, max(SIZES) + 1):
        if len(points) < n:
            return
        h = (h[: len(points) - n + 1] + points[n - 1 :] + np.uint64(n)) * _MUL
        h ^= h >> np.uint64(29)
        if n in SIZES:
            inside = row[: len(h)] == row[n - 1 :]
            yield (h[inside] * _MUL >> np.uint64(64 - bits)).astype(np.int64), row[: len(h)][inside]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    logp: np.ndarray


def train(labelled: DataFrame, docs_a_language: int = 4000, bits: int = BITS, smoothing: float = 0.5) -> Model:
    """A model of the rows of `labelled` (doc_id, text, lang).

    About `docs_a_language` rows of each language, chosen by a hash of doc_id, are learned
    from (all, if there are fewer); the prior counts all rows.
    """
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = known.groupBy("lang").agg(F.count("*").alias("docs"))
    per = {r["lang"]: r["docs"] for r in sizes.collect()}  # one row a language
    languages = sorted(per)
    while bits > 4 and len(languages) << bits > MOST_CELLS:
        bits -= 1
    if not languages:
        return Model([], np.zeros(0), np.zeros((1 << bits, 0)))
    share = F.create_map(*(F.lit(v) for k in languages for v in (k, min(1.0, docs_a_language / per[k]))))
    chosen = known.where(F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(languages) << bits, np.int64)
        number = {k: i for i, k in enumerate(languages)}
        for whole in batches:
            for b in chunks(whole, "text"):
                lang = np.array([number[x] for x in b.column("lang").to_pylist()], np.int64)
                for bucket, row in ngrams(b.column("text"), bits):
                    total += np.bincount((lang[row] << bits) + bucket, minlength=len(total))
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(cell), "n": pa.array(total[cell])})

    cells = chosen.select("text", "lang").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(len(languages) << bits)
    n[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    n = n.reshape(len(languages), 1 << bits) + smoothing
    docs = np.array([per[k] for k in languages], float)
    return Model(languages, np.log(docs / docs.sum()), np.log(n / n.sum(1, keepdims=True)).T.copy())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score, the posterior probability, of each row of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for b in chunks(whole, "text"):
                texts, n = b.column("text"), b.num_rows
                score = np.tile(m.prior, (n, 1))
                for bucket, row in ngrams(texts, int(np.log2(len(m.logp)))):
                    for j in range(len(m.languages)):
                        score[:, j] += np.bincount(row, weights=m.logp[bucket, j], minlength=n)
                told = pc.match_substring_regex(text_or_empty(texts), r"\pL").to_numpy(zero_copy_only=False) & bool(m.languages)
                best, sure = np.zeros(n, np.int64), np.zeros(n)
                if m.languages:
                    best = score.argmax(1)
                    sure = 1 / np.exp(score - score.max(1, keepdims=True)).sum(1)
                names = [m.languages[j] if t else UNKNOWN for j, t in zip(best, told)]
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "lang_pred": pa.array(names, pa.string()), "score": pa.array(np.where(told, sure, 0.0))})

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
