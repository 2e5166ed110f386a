"""Document fingerprints by consistent weighted sampling (operator 5), in DataFrame functions only.

Terms are words, weighted by how often they occur. For each sample, a term of weight S has
gamma-distributed r and c and a uniform b, all independent and functions of term and sample alone, and

    t = floor(ln S / r + b),  a = c * exp(-r * (t - b + 1))

The term of least a is the sample (Ioffe 2010). As r b and r (1 - b) are independent standard exponentials,
so is c exp(-r (1 - b)), which is a at weight one. That one is drawn first, and 1 - exp(-a), which orders terms
like a, is then a plain uniform number; the rest of r, c and b is drawn for greater weights only. Two texts share a sample with a chance of
their generalised Jaccard similarity, sum of least weights over sum of greatest. As a is a
function of term and t, its least value alone says which (term, t) was sampled, so a
sample is the minimum of one column, which Spark aggregates in place.

A text and its edited text share most terms, so both are counted at once: a term that
occurs as often in both is drawn and weighed once for both.

Defined results: null text is empty; texts without words share one fingerprint, which is
like no other but itself; the order of documents is doc_id (null first), then a hash of the
text, so rows that repeat a doc_id are documents of their own; equal rows are one document
in this order and get equal results, a row each; a single document is its own next one; texts of
any length are fingerprinted whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.llm.common import SPACE_RE, discard, materialize, mix64

SAMPLES = 64
DIGITS = 4
TEXT, EDITED, BOTH = 0, 1, 2
#: What names a different row: whether it has a doc_id, the doc_id (else 0), and a hash of its text.
KEY = ("known", "id", "hash")


def _seed(i: int) -> Column:
    """The i-th of a fixed sequence of 64-bit numbers without pattern."""
    return F.lit(int(mix64(np.array([i + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)[0])).cast("long")


def lowest(term: Column, j: int) -> Column:
    """1 - exp(-a) of a term (a 64-bit hash) at weight one for sample j: a uniform number of 53 bits."""
    return (F.shiftrightunsigned(F.xxhash64(term.bitwiseXOR(_seed(2 * j + 1))), 11) + F.lit(0.5)) * F.lit(2.0**-53)


def _rest(term: Column, j: int) -> tuple[Column, Column, Column]:
    """-a at weight one, exp(r (1 - b)) and exp(-r b).

    With e and a independent standard exponentials, c = a + e is Gamma(2, 1) and a / c an independent
    uniform number: exp(-r (1 - b)).
    """
    bits = F.xxhash64(term.bitwiseXOR(_seed(2 * j)))
    u, v = ((x + F.lit(0.5)) * F.lit(2.0**-32) for x in (F.shiftrightunsigned(bits, 32), bits.bitwiseAND(F.lit(0xFFFFFFFF))))
    minus_a = F.log1p(-lowest(term, j))
    return minus_a, 1 + F.log(u) / minus_a, v


def variates(term: Column, j: int) -> tuple[Column, Column, Column]:
    """r, c and b of a term (a 64-bit hash) for sample j: r and c are Gamma(2, 1), b is uniform, all are independent."""
    minus_a, up, down = _rest(term, j)
    r = F.log(up / down)
    return r, -minus_a * up, -F.log(down) / r


def value(term: Column, weight: Column, j: int) -> Column:
    """1 - exp(-a) of a term for sample j; a weight of one, and any other at t = 0, has the `lowest` draw itself.

    x % r is exact, so x - x % r is r t to the last digit, whatever weight gives that t.
    """
    minus_a, up, down = _rest(term, j)
    x, r = F.log(weight / down), F.log(up / down)
    return F.when((weight == 1) | (weight < up), lowest(term, j)).otherwise(-F.expm1(minus_a * F.exp(x % r - x)))


def ordered(rows: DataFrame) -> DataFrame:
    """KEY, copies, n_chars and the KEY of the next one (next_known and so on) of each different row; after the last comes the first.

    Rows are dealt by ranges of KEY, and each range is ordered by itself; the only table in
    one task has a row for each range.
    """
    rows = rows.groupBy(*KEY).agg(F.count("*").alias("copies"), F.max("n_chars").alias("n_chars"))
    rows = materialize(rows.repartitionByRange(*KEY).withColumn("range", F.spark_partition_id()), "ranges")
    firsts = rows.groupBy("range").agg(F.min(F.struct(*KEY)).alias("first"))
    by_range = Window.orderBy("range")
    ring = F.coalesce(F.lead("first").over(by_range), F.first("first").over(by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    firsts = firsts.select("range", ring.alias("follows"))
    following = F.lead(F.struct(*KEY)).over(Window.partitionBy("range").orderBy(*KEY))
    d = rows.withColumn("following", following).join(F.broadcast(firsts), "range").withColumn("following", F.coalesce("following", "follows"))
    d = materialize(d.select(*KEY, "copies", "n_chars", *(F.col(f"following.{k}").alias(f"next_{k}") for k in KEY)), "order")
    discard(rows)
    return d


def _renamed(df: DataFrame, prefix: str) -> DataFrame:
    return df.withColumnsRenamed({k: f"{prefix}_{k}" for k in KEY})


def _on(prefix: str, other: str = "") -> list[Column]:
    return [F.col(f"{other}{k}") == F.col(f"{prefix}_{k}") for k in KEY]


def edited_pairs(texts: DataFrame, order: DataFrame) -> DataFrame:
    """KEY, text and changed: the last half of `text` (rounded down) replaced by as many of the first code points of the next one."""
    half = F.floor(F.col("n_chars") / 2).cast("int")
    before = _renamed(order, "to").select(*(f"to_{k}" for k in KEY), *(f"next_{k}" for k in KEY), half.alias("half"), (F.col("n_chars") - half).cast("int").alias("rest"))
    # only as much of a text as the document before it takes is shuffled to there
    heads = texts.join(before, _on("next")).select(*(f"to_{k}" for k in KEY), "rest", F.substring("text", F.lit(1), F.col("half")).alias("head"))
    return texts.join(heads, _on("to")).select(*KEY, "text", F.concat(F.substring("text", F.lit(1), F.col("rest")), F.col("head")).alias("changed"))


def states(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, term, which and n: how often each word occurs in text, in changed, or in BOTH where that is as often.

    Needs no shuffle if `pairs` are dealt out by keys. What splitting leaves at a text's ends is
    no word, but keeps texts without any: its null n makes null values, which no minimum takes.
    """
    each = pairs.select(*keys, F.posexplode(F.array("text", "changed")).alias("which", "t"))
    words = each.select(*keys, "which", F.explode(F.split(F.col("t"), SPACE_RE)).alias("word"))
    terms = words.groupBy(*keys, F.xxhash64("word").alias("term"), (F.col("word") == "").alias("none")).agg(F.count_if(F.col("which") == TEXT).alias("n"), F.count_if(F.col("which") == EDITED).alias("m"))
    state = lambda which, n: F.struct(F.lit(which).alias("which"), n.alias("n"))
    one = F.array(state(BOTH, F.when(~F.col("none"), F.col("n"))))
    two = F.filter(F.array(state(TEXT, F.col("n")), state(EDITED, F.col("m"))), lambda x: x["n"] > 0)
    d = terms.select(*keys, "term", F.explode(F.when(F.col("none") | (F.col("n") == F.col("m")), one).otherwise(two)).alias("s"))
    return d.select(*keys, "term", "s.which", "s.n")


def signatures(pairs: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """keys, fingerprint and edited_fingerprint (binary, DIGITS hex digits a sample) of text and changed.

    Needs no shuffle if `pairs` are dealt out by keys.
    """
    d = states(pairs, keys).withColumn("weight", F.col("n").cast("double"))
    a = d.groupBy(*keys, "which").agg(*(F.min(value(F.col("term"), F.col("weight"), j)).alias(f"a{j}") for j in range(samples)))
    both = lambda which: [F.min(F.when(F.col("which").isin(which, BOTH), F.col(f"a{j}"))).alias(f"a{which}_{j}") for j in range(samples)]
    a = a.groupBy(*keys).agg(*both(TEXT), *both(EDITED))
    digits = lambda x: F.lpad(F.hex(F.xxhash64(x).bitwiseAND(F.lit(16**DIGITS - 1))), DIGITS, "0")
    # a text without words has no sample: zeros, which `likeness` takes like any other
    print_of = lambda which: F.unhex(F.concat(*(F.coalesce(F.when(F.col(f"a{which}_{j}").isNotNull(), digits(F.col(f"a{which}_{j}"))), F.lit("0" * DIGITS)) for j in range(samples))))
    return a.select(*keys, print_of(TEXT).alias("fingerprint"), print_of(EDITED).alias("edited_fingerprint"))


def likeness(x: Column, y: Column, samples: int = SAMPLES) -> Column:
    """Share of samples in which two fingerprints agree: estimates generalised Jaccard similarity."""
    same, width = F.lit(0), DIGITS // 2
    for j in range(samples):
        same = same + (F.substring(x, width * j + 1, width) == F.substring(y, width * j + 1, width)).cast("int")
    return same / F.lit(float(samples))


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next for each row."""
    i = F.col("doc_id").cast("long")
    texts = docs.select(i.isNotNull().alias("known"), F.coalesce(i, F.lit(0)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.select("known", "id", F.xxhash64("text").alias("hash"), "text")
    order = ordered(texts.select(*KEY, F.char_length("text").cast("long").alias("n_chars")))
    if not order.where("copies > 1").isEmpty():
        texts = texts.dropDuplicates(list(KEY))
    pairs = edited_pairs(texts, order)
    prints = signatures(pairs, list(KEY), samples)
    digests = pairs.select(*KEY, F.unhex(F.sha2("changed", 256)).alias("edited_sha256"))
    own = materialize(digests.join(_renamed(prints, "p"), _on("p")).select(*KEY, "edited_sha256", "fingerprint", "edited_fingerprint"), "fingerprints")
    following = _renamed(own, "f").select(*(f"f_{k}" for k in KEY), F.col("fingerprint").alias("next_fingerprint"))
    d = own.join(_renamed(order, "o"), _on("o")).join(following, _on("f", "next_"))
    return d.select(
        F.when(F.col("known"), F.col("id")).alias("doc_id"),
        "n_chars",
        F.lower(F.hex("edited_sha256")).alias("edited_sha256"),
        F.lower(F.hex("fingerprint")).alias("fingerprint"),
        F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint"), samples).alias("near_next"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")
