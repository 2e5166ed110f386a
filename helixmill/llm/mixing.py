"""Mixing sources to target weights (operator 8), in DataFrame functions only.

Each source gets a target number of words; a source with a target above its size first
gives whole epochs of all its documents, and the rest comes from an Efraimidis-Spirakis
sample: documents are ordered by exponential keys divided by their quality weights, and
sizes are summed in that order up to what is left of the target. Keys are functions of the
seed and doc_id, so reruns agree.

The prefix sums never sort a whole source: keys fall into equal-probability buckets, whose
summed sizes say which documents are surely in or out; only the one bucket of each source
in which the target is reached is sorted.

Defined results: null text has size 0; a null source is a source of its own, the last in
order; rows that repeat a doc_id are documents of their own (rows of equal doc_id, source
and text are interchangeable, of which some may be taken); documents of size 0 follow their
key; of equal keys the lesser doc_id is taken first; a text of any length is one document; an empty table gives an empty result; further columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.llm.common import WORD_RE, bounded_broadcast, fresh, materialize

CYCLE = (5, 2, 1)
BUCKETS = 4096


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """From 0.1 to 1: falls with the symbols a word."""
    symbols = F.coalesce(F.char_length(text) - F.char_length(F.translate(text, "#*$%&|<>!", "")), F.lit(0))
    return F.greatest(F.lit(0.1), 1 - F.coalesce(F.try_divide(symbols, size), F.lit(0.0)))


def uniform(seed: int, key: Column) -> Column:
    """In (0, 1), from the first 52 bits of an MD5 of seed and key."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string"))), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """source, source_size, target: `share` times all words dealt by weight, at most `most` times a source's size.

    What sources cannot take is dealt again by weight to the others until none is above its
    cap: in order of cap a unit of weight, that is one level for all sources not capped,
    found with prefix sums. The windows run over one row a source.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, cycle)), (F.row_number().over(by_name) - 1) % len(cycle) + 1))
    s = s.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("level", (share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    s = s.withColumn("level", F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(every))
    return s.select("source", "source_size", F.when(F.col("level").isNull() | (F.col("ratio") <= F.col("level")), F.col("cap")).otherwise(F.col("w") * F.col("level")).alias("target"))


def plan(docs: DataFrame, seed: int = 17, share: float = 1.5, most: float = 2.0, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """A row for each row of `docs`: doc_id, source, size, source_size, target, epochs, copies, taken.

    copies is how often the mix takes the document: `epochs` times, and once more if the
    sample takes it. A document at the edge of the budget is taken if at least half of it
    fits, so a source misses its target by half a document at most.
    """
    size = size_of(F.col("text"))
    rows = docs.select("doc_id", "source", size.alias("size"), quality_weight(F.col("text"), size).alias("weight"), F.xxhash64("text").alias("text_hash"))
    rows = materialize(rows.withColumn("key", -F.log(uniform(seed, F.col("doc_id"))) / F.col("weight")), "mix-keys")
    t = targets(rows, share, most, cycle)
    t = t.withColumn("epochs", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long"))
    t = materialize(t.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-targets")
    n = BUCKETS
    rows = rows.withColumn("bucket", F.least(F.lit(n - 1), F.floor((1 - F.exp(-F.col("key"))) * n)).cast("int"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")).withColumn("end", F.sum("words").over(upto))
    # the first bucket of each source whose end goes beyond the rest, and what comes before it
    t = bounded_broadcast(t, t.count())
    cut = sums.join(t, same(sums, t)).where(F.col("end") > F.col("rest")).groupBy(t["source"].alias("source")).agg(F.min("bucket").alias("cut"), F.min_by(F.col("end") - F.col("words"), "bucket").alias("before"))
    t = t.join(cut, same(t, cut), "left").select(t["source"].alias("t_source"), "source_size", "target", "epochs", "rest", F.coalesce("cut", F.lit(n)).alias("cut"), "before")
    t = materialize(t, "mix-cuts")
    t = bounded_broadcast(t, t.count())
    d = rows.join(t, rows["source"].eqNullSafe(t["t_source"]), "left").drop("t_source")
    sure = d.where(F.col("bucket") != F.col("cut")).withColumn("extra", (F.col("bucket") < F.col("cut")).cast("int"))
    w = Window.partitionBy("source").orderBy("key", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    edge = d.where(F.col("bucket") == F.col("cut")).withColumn("end", F.col("before") + F.sum("size").over(w))
    edge = edge.withColumn("extra", (F.col("end") - F.col("size") / 2 <= F.col("rest")).cast("int")).drop("end")
    copies = F.col("epochs") + F.col("extra")
    return sure.unionByName(edge).select("doc_id", "source", "text_hash", "size", "source_size", "target", "epochs", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix(docs: DataFrame, seed: int = 17, share: float = 1.5, most: float = 2.0, cycle: tuple[int, ...] = CYCLE, slices: int = 64) -> DataFrame:
    """The mixed rows of `docs`, each as often as the plan takes it, with the columns of `docs`.

    Rows of equal doc_id, source and text share their copies evenly; a remainder goes to the
    first of them. Those are numbered in `slices`, so that one group is never in one task.
    """
    p = plan(docs, seed, share, most, cycle).groupBy("doc_id", "source", "text_hash").agg(F.sum("copies").alias("copies"), F.count("*").alias("n"))
    p = p.where("copies > 0").select("doc_id", "source", "text_hash", F.floor(F.col("copies") / F.col("n")).alias("each"), (F.col("copies") % F.col("n")).alias("more"))
    p = materialize(p, "mix-copies")
    p = p.withColumnsRenamed({c: fresh(c, docs) for c in p.columns})
    mix_id, source, text_hash, each, more = p.columns
    on = docs["doc_id"].eqNullSafe(p[mix_id]) & docs["source"].eqNullSafe(p[source]) & (F.xxhash64(docs["text"]) == p[text_hash])
    copies = lambda d, n: d.select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(F.sequence(F.lit(1), n.cast("int"))).alias(each)).drop(each)
    even, uneven = p.where(F.col(more) == 0), p.where(F.col(more) > 0)
    out = copies(docs.join(even, on), F.col(each))
    if uneven.isEmpty():
        return out
    rows = materialize(docs.join(uneven, on).withColumn(fresh("slice", docs, p), F.pmod(F.monotonically_increasing_id(), F.lit(slices))), "mix-repeated")
    part = fresh("slice", docs, p)
    key = [mix_id, source, text_hash]
    sizes = rows.groupBy(*key, part).agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy(*key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = fresh("at", docs, p)
    sizes = sizes.select(*(F.col(c).alias(fresh(f"s_{c}", docs, p)) for c in (*key, part)), before.alias(at))
    same = [rows[c].eqNullSafe(sizes[s]) for c, s in zip((*key, part), sizes.columns)]
    # numbers within a slice of a group; which of equal rows comes first does not matter
    number = F.row_number().over(Window.partitionBy(*key, part).orderBy(F.lit(0)))
    d = rows.withColumn(fresh("number", docs, p), number).join(sizes, same)
    n = F.col(each) + (F.col(at) + F.col(fresh("number", docs, p)) <= F.col(more)).cast("int")
    return out.unionByName(copies(d.where(n > 0), n))
