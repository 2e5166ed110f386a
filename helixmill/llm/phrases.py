"""Phrase collocation mining by hierarchical pair naming (operator 13).

Texts are cut into pieces at punctuation and line ends, and pieces into words. A block of texts is one row: its words as
small codes in order, -1 between pieces, beside the distinct words and their counts.

Level 1 counts words over all blocks and names the frequent ones. Level k looks at each place where two frequent
(k-1)-grams begin next to each other: they overlap in all but a word each, so the pair is a k-gram. Pairs are counted
within blocks, then over all, and frequent pairs get names that go back to the blocks that hold them. A k-gram is
frequent only if both of its (k-1)-grams are, so nothing is lost.

Pairs and names travel by buckets of pairs as compressed columns: a block asks each bucket for the names of its pairs,
and the answers reach its task one after another. No task holds more than a block, or a bucket, and no table of names
above MOST_SENT rows goes to every task.

The two halves of a pair are its parents: its first and its last k-1 words. Following them gives the counts of all
leading and trailing parts, so each cut of a phrase is looked up, and says which shorter phrases a longer one
of equal count contains. (If any longer candidate contains a phrase and is as frequent, so is the one with
one word more, as counts never rise with length.)

Counts are exact; scores are computed in whole numbers of up to 38 digits.

Defined results: null text is empty; null lang is `und`, like that value itself; words are runs of characters other than U+0020 and U+0009 within
a piece, A-Z in lower case; equal scores are ordered by count, then by phrase in UTF-8; a piece of any length is
worked on whole; repeated rows count each; a language without candidates has no rows; an empty table gives an
empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.llm import words as W
from helixmill.llm.common import Scratch, bounded_broadcast, chunks, mix64, small_batches, text_or_empty, wide_rows

Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

SPACE = W.byte_table(0x20, 0x09)
BREAK = W.byte_table(*b".,;:!?", *range(0x0A, 0x0E))
#: A block holds about so many bytes of text.
BLOCK_BYTES = 6_000_000
BLOCK = "block long, lang string, codes binary, base int, "
#: A row holds so many entries of its block.
PART = 1 << 15
#: Pairs that a task adds up before it sends them on, and about half of which a bucket of pairs holds.
GATHERED = 1 << 21
#: Names that go to every task at most; more are joined by a shuffle.
MOST_SENT = 100_000
#: Parts in which the first phrases of a language are found before they meet.
PARTS = 64


def _block() -> int:
    """A name for a block; what is written under it stays, so it need not be the same in a second try."""
    return uuid.uuid4().int >> 65


def pieces(texts: pa.Array) -> tuple[W.Words, np.ndarray]:
    """The words of all pieces, and whether each is the first of its piece."""
    w = W.words(pc.ascii_lower(texts), SPACE | BREAK)
    at = np.flatnonzero(BREAK[w.data])
    before = np.searchsorted(at, w.start) - 1
    first = np.ones(len(w.start), bool)
    first[1:] = (w.row[1:] != w.row[:-1]) | ((before[1:] >= 0) & (at[np.maximum(before[1:], 0)] >= w.end[:-1]) if len(at) else False)
    return w, first


def _squeezed(codes: np.ndarray) -> bytes:
    """Codes as planes of bytes, compressed: the more frequent a code the smaller it is, so the upper planes are nearly empty."""
    planes = codes.astype("<i4").view(np.uint8).reshape(-1, 4).T
    return len(codes).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(planes).tobytes(), "zstd", asbytes=True)


def _codes(squeezed: bytes) -> np.ndarray:
    n = int.from_bytes(squeezed[:8], "little")
    planes = np.frombuffer(pa.decompress(squeezed[8:], 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def _shut(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers as planes of bytes, compressed: runs and small numbers take little room."""
    return pa.compress(np.concatenate([c.astype("<i8").view(np.uint8).reshape(-1, 8).T.ravel() for c in columns]).tobytes(), "zstd", asbytes=True)


def _opened(shut: bytes, columns: int, n: int) -> tuple[np.ndarray, ...]:
    planes = np.frombuffer(pa.decompress(shut, 8 * columns * n, "zstd", asbytes=True), np.uint8).reshape(columns, 8, n)
    return tuple(np.ascontiguousarray(x.T).view("<i8").ravel() for x in planes)


def _key(l: np.ndarray, r: np.ndarray) -> np.ndarray:
    return mix64(l.view(np.uint64) + mix64(r.view(np.uint64) + np.uint64(1)))


def _by_bucket(l: np.ndarray, r: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """The buckets of pairs that occur, and the places of their pairs in ascending order."""
    to = (_key(l, r) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    order = np.argsort(to, kind="stable")
    ends = np.searchsorted(to[order], np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(ends)):
        yield int(k), order[ends[k] : ends[k + 1]]


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values from the most frequent on, with the place of a first one, and their counts; and the number of each value among them."""
    _, at, code, count = np.unique(values, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    number = np.empty(len(order), np.int32)
    number[order] = np.arange(len(order), dtype=np.int32)
    return at[order], count[order], number[code]


def _rows(lang: str, codes: np.ndarray, **columns: pa.Array) -> Iterator[pa.RecordBatch]:
    """A block as rows of PART entries of its columns, the first of which are number `base`; the first row has the codes."""
    block = _block()
    n = len(next(iter(columns.values())))
    for base in range(0, max(1, n), PART):
        parts = {k: v.slice(base, PART) for k, v in columns.items()}
        lists = {k: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for k, v in parts.items()}
        held = pa.array([None if base else _squeezed(codes)], pa.binary())
        yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "lang": pa.array([lang], pa.string()), "codes": held, "base": pa.array([base], pa.int32()), **lists})


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of words: block, lang, codes, base, words and counts. Texts of a language are gathered until they fill a block."""
    held: dict[str, list[pa.Array]] = {}
    size: dict[str, int] = {}

    def coded(lang: str) -> Iterator[pa.RecordBatch]:
        size.pop(lang)
        w, first = pieces(pa.concat_arrays(held.pop(lang)))
        if len(w.start):
            at, count, code = _numbered(W.hashes(w))
            # a break before each piece but the first
            out = np.full(len(code) + first.sum() - 1, -1, np.int32)
            out[np.arange(len(code)) + np.cumsum(first) - 1] = code
            texts = [w.data[s:e].tobytes().decode() for s, e in zip(w.start[at], w.end[at])]
            yield from _rows(lang, out, words=pa.array(texts, pa.string()), counts=pa.array(count, pa.int64()))

    for whole in batches:
        for lang in pc.unique(whole.column("lang")).to_pylist():
            for b in chunks(whole.filter(pc.equal(whole.column("lang"), lang)), "text", BLOCK_BYTES):
                held.setdefault(lang, []).append(text_or_empty(b.column("text")))
                size[lang] = size.get(lang, 0) + held[lang][-1].nbytes
                if size[lang] >= BLOCK_BYTES:
                    yield from coded(lang)
        while sum(size.values()) > 4 * BLOCK_BYTES:
            yield from coded(max(size, key=size.__getitem__))
    for lang in list(size):
        yield from coded(lang)


def _paired(last: bool) -> Kernel:
    """The next level of blocks: pairs of neighbouring codes that both have names, with l and r, the names of the halves.

    A block comes as a row of its codes, and rows of the names of some of them after it.
    """

    def ended(lang: str, code: np.ndarray, id_of: np.ndarray) -> Iterator[pa.RecordBatch]:
        # -1 takes the last place, which has no name
        there = id_of[code] >= 0
        at = np.flatnonzero(there[:-1] & there[1:])
        if not len(at):
            return
        one, count, pair_code = _numbered(code[at].astype(np.int64) << 32 | code[at + 1])
        # places in a row stay neighbours; anything between is one break
        gap = np.concatenate([[False], np.diff(at) > 1])
        out = np.full(len(at) + gap.sum(), -1, np.int32)
        out[np.arange(len(at)) + np.cumsum(gap)] = pair_code
        halves = {"l": pa.array(id_of[code[at[one]]]), "r": pa.array(id_of[code[at[one] + 1]])}
        yield from _rows(lang, out[:0] if last else out, **halves, counts=pa.array(count, pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, code, id_of = None, None, None
        for b in batches:
            for i in range(b.num_rows):
                if b.column("codes")[i].is_valid:
                    if code is not None:
                        yield from ended(lang, code, id_of)
                    lang, code = b.column("lang")[i].as_py(), _codes(b.column("codes")[i].as_py())
                    id_of = np.full(code.max(initial=0) + 2, -1, np.int64)
                else:
                    known, name = _opened(b.column("named")[i].as_py(), 2, b.column("n")[i].as_py())
                    id_of[known] = name
        if code is not None:
            yield from ended(lang, code, id_of)

    return run


def _exploded(blocks: DataFrame, *columns: str) -> DataFrame:
    """block, lang, code, and an element of each array column."""
    d = blocks.select("block", "lang", "base", F.posexplode(F.arrays_zip(*columns)).alias("at", "x"))
    return d.select("block", "lang", (F.col("base") + F.col("at")).alias("code"), *(F.col(f"x.{c}").alias(c) for c in columns))


def _summed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """l, r and count of pairs in ascending order, each once."""
    l, r, count = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((r, l))
    l, r = l[order], r[order]
    new = np.flatnonzero(np.concatenate([[True], (l[1:] != l[:-1]) | (r[1:] != r[:-1])])) if len(l) else np.zeros(0, np.int64)
    return l[new], r[new], np.add.reduceat(count[order], new) if len(l) else count


def _sent(buckets: int) -> Kernel:
    """bucket, n and pairs: what a task counts, as compressed columns for each bucket of pairs."""

    def flush(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        # ascending pairs: the planes of l are runs, and those of counts nearly empty
        columns = _summed(parts)
        for k, mine in _by_bucket(columns[0], columns[1], buckets):
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([k], pa.int64()), "n": pa.array([len(mine)], pa.int64()), "pairs": pa.array([_shut(*(c[mine] for c in columns))], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(tuple(b.column(c).flatten().to_numpy() for c in ("l", "r", "counts")))
            size += len(held[-1][0])
            if size >= GATHERED:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _frequent(min_count: int) -> Kernel:
    """l, r and a of pairs with counts of at least `min_count`, from rows in order of their buckets."""

    def ended(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        l, r, count = _summed(held)
        good = count >= min_count
        return pa.RecordBatch.from_pydict({"l": pa.array(l[good]), "r": pa.array(r[good]), "a": pa.array(count[good])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, size = None, [], 0
        for b in batches:
            for k, n, pairs in zip(*(b.column(c).to_pylist() for c in ("bucket", "n", "pairs"))):
                if held and k != bucket:
                    yield ended(held)
                    held, size = [], 0
                held.append(_opened(pairs, 3, n))
                bucket, size = k, size + n
                if size >= 2 * GATHERED:
                    held = [_summed(held)]
                    size = len(held[0][0])
        if held:
            yield ended(held)

    return run


def frequent_pairs(blocks: DataFrame, min_count: int) -> DataFrame:
    """l, r and a, the count over all blocks, of the pairs that are frequent.

    Most pairs are rare and occur in a block or two, so they travel as compressed columns rather than as rows.
    """
    buckets = max(1, 2 * blocks.count() * PART // GATHERED)
    sent = blocks.select("l", "r", "counts").mapInArrow(_sent(buckets), "bucket long, n long, pairs binary")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_frequent(min_count), "l long, r long, a long")


MESSAGE = "bucket long, block long, n long, pairs binary"
NAMED = "block long, n long, named binary"


def _asked(buckets: int) -> Kernel:
    """For each block and bucket a row of its pairs with their codes."""

    def flush(block: int, parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        columns = tuple(np.concatenate(x) for x in zip(*parts))
        for k, mine in _by_bucket(columns[0], columns[1], buckets):
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([k], pa.int64()), "block": pa.array([block], pa.int64()), "n": pa.array([len(mine)], pa.int64()), "pairs": pa.array([_shut(*(c[mine] for c in columns))], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = None, [], 0
        for b in batches:
            for i, (k, base) in enumerate(zip(b.column("block").to_pylist(), b.column("base").to_pylist())):
                if held and (k != block or size >= GATHERED):
                    yield from flush(block, held)
                    held, size = [], 0
                l, r = (b.column(c)[i].values.to_numpy() for c in ("l", "r"))
                held.append((l, r, np.arange(base, base + len(l))))
                block, size = k, size + len(l)
        if held:
            yield from flush(block, held)

    return run


def _told(buckets: int) -> Kernel:
    """The names of pairs as rows for each bucket, of block -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = tuple(b.column(c).to_numpy() for c in ("l", "r", "id"))
            for k, mine in _by_bucket(columns[0], columns[1], buckets):
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([k], pa.int64()), "block": pa.array([-1], pa.int64()), "n": pa.array([len(mine)], pa.int64()), "pairs": pa.array([_shut(*(c[mine] for c in columns))], pa.binary())})

    return run


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row of a block's pairs the codes of those that have names, with these; the names of a bucket come before its blocks."""
    bucket, held, table = None, [], None
    for b in batches:
        for k, block, n, pairs in zip(*(b.column(c).to_pylist() for c in ("bucket", "block", "n", "pairs"))):
            if k != bucket:
                bucket, held, table = k, [], None
            if block < 0:
                held.append(_opened(pairs, 3, n))
                continue
            if not held:
                continue
            if table is None:
                l, r, name = (np.concatenate(x) for x in zip(*held))
                key = _key(l, r)
                order = np.argsort(key)
                key, l, r, name = key[order], l[order], r[order], name[order]
                # pairs with one key stand side by side, and are told apart by themselves
                same = int(np.unique(key, return_counts=True)[1].max())
                table = key, l, r, name, same
            key, l, r, name, same = table
            ask_l, ask_r, code = _opened(pairs, 3, n)
            first = np.searchsorted(key, _key(ask_l, ask_r))
            at = np.full(n, -1)
            for step in range(same):
                here = np.minimum(first + step, len(key) - 1)
                at = np.where((l[here] == ask_l) & (r[here] == ask_r), here, at)
            good = at >= 0
            if good.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "n": pa.array([good.sum()], pa.int64()), "named": pa.array([_shut(code[good], name[at[good]])], pa.binary())})


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block, a code and its name (null: none), as rows of many of a block."""

    def flush(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        block, code, name = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(block, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], np.diff(block[order]) != 0]))
        for x, y in zip(starts, [*starts[1:], len(order)]):
            mine = order[x:y]
            yield pa.RecordBatch.from_pydict({"block": pa.array([block[mine[0]]], pa.int64()), "n": pa.array([len(mine)], pa.int64()), "named": pa.array([_shut(code[mine], name[mine])], pa.binary())})

    held, size = [], 0
    for whole in batches:
        b = whole.filter(whole.column("id").is_valid())
        if b.num_rows:
            held.append(tuple(b.column(c).to_numpy() for c in ("block", "code", "id")))
            size += b.num_rows
        if size >= GATHERED // 2:
            yield from flush(held)
            held, size = [], 0
    if held:
        yield from flush(held)


def names_of_words(blocks: DataFrame, names: DataFrame, n: int) -> DataFrame:
    """NAMED rows of the blocks' words that are among the `n` names."""
    seen = _exploded(blocks, "words").withColumnRenamed("words", "phrase")
    found = seen.join(bounded_broadcast(names.select("lang", "phrase", "id"), n, MOST_SENT), ["lang", "phrase"], "left")
    return found.select("block", "code", "id").mapInArrow(_gathered, NAMED)


def names_of_pairs(blocks: DataFrame, names: DataFrame, n: int) -> DataFrame:
    """NAMED rows of the blocks' pairs that are among the `n` names, by buckets of pairs."""
    buckets = max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // MOST_SENT)
    asked = blocks.select("block", "base", "l", "r").mapInArrow(_asked(buckets), MESSAGE)
    both = names.select("l", "r", "id").mapInArrow(_told(buckets), MESSAGE).unionByName(asked)
    return both.repartition("bucket").sortWithinPartitions("bucket", "block").mapInArrow(_answered, NAMED)


def next_level(blocks: DataFrame, named: DataFrame, last: bool) -> DataFrame:
    """Blocks of pairs of neighbours with names; what belongs to a block reaches a task in order, and is not gathered in a row."""
    none = lambda kind: F.lit(None).cast(kind)
    codes = blocks.where("codes is not null").select("block", "lang", "codes", none("long").alias("n"), none("binary").alias("named"))
    names = named.select("block", none("string").alias("lang"), none("binary").alias("codes"), "n", "named")
    both = codes.unionByName(names).repartition("block").sortWithinPartitions("block", F.col("codes").isNull())
    return both.mapInArrow(_paired(last), BLOCK + "l array<long>, r array<long>, counts array<long>")


def levels(docs: DataFrame, keep: Scratch, max_words: int, min_count: int) -> tuple[DataFrame, list[DataFrame]]:
    """n of each lang, and for each number of words the frequent phrases: lang, id, l, r (parents), phrase, a (count),
    and heads and tails, the counts of its first and last 1, 2, .. words.
    """
    with small_batches(docs.sparkSession), wide_rows(docs.sparkSession):
        d = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
        blocks = keep(d.mapInArrow(_coded, BLOCK + "words array<string>, counts array<long>"), "phrase-words")
        total = blocks.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n"))
        total = keep(total, "phrase-totals")
        none = F.array().cast("array<long>")
        first = _exploded(blocks, "words", "counts").groupBy("lang", F.col("words").alias("phrase")).agg(F.sum("counts").alias("a")).where(F.col("a") >= min_count)
        found = [keep(first.select("lang", F.monotonically_increasing_id().alias("id"), F.lit(None).cast("long").alias("l"), F.lit(None).cast("long").alias("r"), "phrase", "a", none.alias("heads"), none.alias("tails")), "phrases-1")]
        for k in range(2, max_words + 1):
            before = found[-1]
            n = before.count()
            named = (names_of_words if k == 2 else names_of_pairs)(blocks, before, n)
            above, blocks = blocks, keep(next_level(blocks, named, k == max_words), f"phrase-pairs-{k}")
            keep.drop(above)
            pairs = frequent_pairs(blocks, min_count)
            left = before.select(F.col("id").alias("l"), "lang", F.col("phrase").alias("start"), F.concat("heads", F.array("a")).alias("heads"))
            right = before.select(F.col("id").alias("r"), F.element_at(F.split("phrase", " "), -1).alias("word"), F.concat("tails", F.array("a")).alias("tails"))
            pairs = pairs.join(bounded_broadcast(left, n, MOST_SENT), "l").join(bounded_broadcast(right, n, MOST_SENT), "r")
            found.append(keep(pairs.select("lang", F.monotonically_increasing_id().alias("id"), "l", "r", F.concat_ws(" ", "start", "word").alias("phrase"), "a", "heads", "tails"), f"phrases-{k}"))
    return total, found


def scored(phrases: DataFrame, total: DataFrame) -> DataFrame:
    """lang, id, phrase, a, l, r, n and score of phrases by their worst cut."""
    # cut after k words: the count of the first k, and of all but the first k
    cuts = F.transform(F.sequence(F.lit(1), F.size("heads")), lambda k: F.struct(k.alias("k"), F.element_at("heads", k).alias("l"), F.element_at("tails", F.size("heads") + 1 - k).alias("r")))
    d = phrases.join(F.broadcast(total), "lang").select("lang", "id", "phrase", "a", "n", F.explode(cuts).alias("cut")).select("*", "cut.k", "cut.l", "cut.r").drop("cut")
    d = d.withColumn("score", F.expr("cast((1000 * cast(a as decimal(19,0)) * cast(n as decimal(16,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) as long)"))
    worst = F.min(F.struct("score", "k", "l", "r")).alias("w")
    return d.groupBy("lang", "id", "phrase", "a", "n").agg(worst).select("lang", "id", "phrase", "a", "w.l", "w.r", "n", "w.score")


def collocations(docs: DataFrame, max_words: int = 5, min_count: int = 100, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the `top` phrases of each language."""
    keep = Scratch()
    total, found = levels(docs, keep, max_words, min_count)
    parts = []
    for k in range(1, max_words):
        candidates = scored(found[k], total)
        if k + 1 < max_words:
            longer = found[k + 1]
            held = longer.select(F.explode(F.array("l", "r")).alias("id"), F.col("a").alias("longer")).groupBy("id").agg(F.max("longer").alias("longer"))
            candidates = candidates.join(held, "id", "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a"))).drop("longer")
        parts.append(candidates.drop("id"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    some = every.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    best = keep(best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "phrases-best")
    keep.clear(best)
    return best
