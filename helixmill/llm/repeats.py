"""Substring dedup by repeated-phrase automata (operator 11).

A window is `window` consecutive words of one document; a repeat is a window that a document
with a smaller doc_id also holds. All words that repeats cover are removed.

1. Each window names its seed: the least hash of the runs of `seed` words within it. Equal
   windows name equal seeds, and neighbouring windows mostly the same one, so a document has
   about a seed for every eighteen words. Only documents with a seed that two documents name go on.
2. The windows of those documents with such seeds are counted by two 64-bit hashes; those of
   two documents or more are confirmed, and belong to the first of them.
3. Each document's confirmed windows that it is the first to hold, next to each other, make
   up a recurring passage: every recurring text is in passages once.
4. Documents are dealt to blocks. To a block go the passages with a seed that its documents
   name; cut into phrases of window / 2 words, of which every window holds a whole one,
   they are compiled into the block's Aho-Corasick automaton. All documents of the block stream
   through it; each occurrence of a phrase opens the windows around it, which are
   repeats if they are windows of a passage whose document is smaller.

An automaton holds only phrases that occur in its block, so it is no larger than the block, and
a passage that a third of all documents hold goes to each block once.

Defined results: null, empty and wordless texts have no words; a document without repeats keeps
all its words, joined by one space like the others; a text of any length is worked on whole, in one
block; rows that repeat a doc_id are documents of equal rank, of which none removes words of another;
a row without doc_id ranks after all others, and removes nothing; windows that differ in white space
alone are equal; an empty table gives an empty result; further columns are kept as they are, but
those that go by the names given for `n_words` and `n_removed` are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.llm import words as W
from helixmill.llm.common import CHUNK_BYTES, Scratch, bounded_broadcast, chunks, fresh, mix64

Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

#: Rank of rows without doc_id.
LAST = 2**63 - 1
#: Text that a block holds, unless one text alone is larger.
BLOCK_BYTES = 6_000_000
_SECOND = 0x6A09E667F3BCC909
#: A word is DIGITS characters of BASE kinds: automata look through the children of a node one by one.
BASE, DIGITS = 64, 3


def _seeds(word: np.ndarray, window: int, seed: int) -> np.ndarray:
    """The seed of the window from each word on."""
    return W.sliding_least(W.run_hashes(word, seed), window - seed + 1)


def _windows(word: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    return W.run_hashes(word, window, 1), W.run_hashes(word, window, _SECOND)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _named(window: int, seed: int) -> Kernel:
    """id, h and seed: the seeds that each document's windows name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, "text"):
                w = W.words(b.column("text"))
                real = np.flatnonzero(W.in_one_text(w, window))
                key, row = _seeds(W.hashes(w), window, seed)[real], w.row[real]
                order = np.lexsort((key, row))
                key, row = key[order], row[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
                at = pa.array(row[new])
                yield pa.RecordBatch.from_pydict({"id": b.column("id").take(at), "h": b.column("h").take(at), "seed": _signed(key[new])})

    return run


def _within(b: pa.RecordBatch, column: str, key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which keys are in the list of their row."""
    lists = b.column(column)
    if not len(key) or not len(lists.flatten()):
        return np.zeros(len(key), bool)
    values = lists.flatten().to_numpy().view(np.uint64)
    of = np.repeat(np.arange(b.num_rows, dtype=np.uint64), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
    # pairs of row and key, as one number each
    return np.isin(mix64(key ^ mix64(row.astype(np.uint64) + np.uint64(1))), mix64(values ^ mix64(of + np.uint64(1))))


def _candidates(window: int, seed: int) -> Kernel:
    """h1, h2 and id of each document's windows whose seed is in its list `seeds`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, "text"):
                w = W.words(b.column("text"))
                word, real = W.hashes(w), np.flatnonzero(W.in_one_text(w, window))
                real = real[_within(b, "seeds", _seeds(word, window, seed)[real], w.row[real])]
                h1, h2 = (h[real] for h in _windows(word, window))
                doc = b.column("id").to_numpy()[w.row[real]]
                order = np.lexsort((doc, h2, h1))
                h1, h2, doc = h1[order], h2[order], doc[order]
                new = np.ones(len(h1), bool)
                new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (doc[1:] != doc[:-1])
                yield pa.RecordBatch.from_pydict({"h1": _signed(h1[new]), "h2": _signed(h2[new]), "id": pa.array(doc[new])})

    return run


def _passages(window: int, seed: int) -> Kernel:
    """passage, owner, text and seeds of each run of windows that are in the document's list `own`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, "text"):
                w = W.words(b.column("text"))
                word, one = W.hashes(w), W.in_one_text(w, window)
                real = np.flatnonzero(one)
                mine = np.zeros(len(one) + 2, bool)
                mine[real + 1] = _within(b, "own", W.run_hashes(word, window, 1)[real], w.row[real])
                # a run of windows ends with its text
                edge = np.diff(mine.astype(np.int8))
                first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                key = _seeds(word, window, seed)
                out: dict[str, list] = {"passage": [], "owner": [], "text": [], "seeds": []}
                ids = b.column("id").to_numpy()
                for x, y in zip(first, last):
                    many = np.split(np.arange(x, y), np.flatnonzero(np.diff(w.row[x:y])) + 1)
                    for part in many:
                        i, j = part[0], part[-1]
                        text = b" ".join(w.data[s:e].tobytes() for s, e in zip(w.start[i : j + window], w.end[i : j + window]))
                        out["passage"].append(int(mix64(W.run_hashes(word[i : j + window], j + window - i, 3)).view(np.int64)[0]))
                        out["owner"].append(int(ids[w.row[i]]))
                        out["text"].append(text.decode())
                        out["seeds"].append(np.unique(key[i : j + 1]).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(out["passage"], pa.int64()), pa.array(out["owner"], pa.int64()), pa.array(out["text"], pa.string()), pa.array(out["seeds"], pa.list_(pa.int64()))], list(out))

    return run


def _characters(code: np.ndarray) -> str:
    """A string with DIGITS characters for each code; codes beyond all of them share some, which confirmation tells apart."""
    digits = (code[:, None] // BASE ** np.arange(DIGITS)) % BASE + ord("0")
    return digits.astype(np.uint8).tobytes().decode("ascii")


class Automaton:
    """The phrases of passages compiled, and their windows beside them."""

    def __init__(self, texts: pa.Array, owner: np.ndarray, window: int) -> None:
        self.window, self.phrase = window, window // 2
        w = W.words(texts)
        word, real = W.hashes(w), np.flatnonzero(W.in_one_text(w, window))
        self.words = np.unique(word)
        h1, h2 = (h[real] for h in _windows(word, window))
        order = np.lexsort((owner[w.row[real]], h2, h1))
        self.h1, self.h2, self.owner = h1[order], h2[order], owner[w.row[real]][order]
        self.found = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        text = _characters(self.codes(word))
        count = np.bincount(w.row, minlength=len(texts))
        for start, n in zip(np.cumsum(count) - count, count):
            for x in range(start, start + n - self.phrase + 1, self.phrase):
                self.found.add_word(text[DIGITS * x : DIGITS * (x + self.phrase)])
        self.found.make_automaton()

    def codes(self, word: np.ndarray) -> np.ndarray:
        """The number of each word among the words of passages, from 1 on; 0 for others."""
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        return np.where(self.words[at] == word, at + 1, 0)

    def repeats(self, w: W.Words, rank: np.ndarray) -> np.ndarray:
        """The first words of windows that a passage of a document of lower rank has."""
        word = W.hashes(w)
        text = _characters(self.codes(word))
        ends = np.fromiter((end for end, _ in self.found.iter(text)), np.int64) + 1
        # what is found between two words is none
        ends = ends[ends % DIGITS == 0] // DIGITS - 1
        # a phrase lies in the windows from window - phrase words before it up to its own first word
        edge = np.zeros(len(word) + self.window + 1, np.int64)
        begin = ends - self.phrase + 1
        edge += np.bincount(np.maximum(begin - (self.window - self.phrase), 0), minlength=len(edge))
        edge -= np.bincount(begin + 1, minlength=len(edge))
        opened = np.flatnonzero(np.cumsum(edge)[: max(0, len(word) - self.window + 1)])
        opened = opened[w.row[opened] == w.row[opened + self.window - 1]]
        h1, h2 = (h[opened] for h in _windows(word, self.window))
        at = np.minimum(np.searchsorted(self.h1, h1), len(self.h1) - 1)
        same = (self.h1[at] == h1) & (self.h2[at] == h2) & (self.owner[at] < rank[w.row[opened]])
        return opened[same]


def _spans(first: np.ndarray, w: W.Words, rows: int, window: int) -> pa.Array:
    """For each text the covered words, as lists of [start, end) by word number, first words of windows given."""
    count = np.bincount(w.row, minlength=rows)
    begin = np.cumsum(count) - count
    new = np.ones(len(first), bool)
    new[1:] = (np.diff(first) > window) | (np.diff(w.row[first]) > 0)
    start = first[new]
    end = first[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(first) - 1]])] + window if len(first) else first
    row = w.row[start]
    flat = np.stack([start - begin[row], end - begin[row]], 1).ravel() if len(start) else np.zeros(0, np.int64)
    at = np.concatenate([[0], np.cumsum(2 * np.bincount(row, minlength=rows))])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.astype(np.int64)))


def _stream(window: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """id, h and spans of a block's documents, which stream through the automaton of its passages."""

    def run(docs: pa.Table, passages: pa.Table) -> pa.Table:
        out = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("spans", pa.list_(pa.int64()))])
        if not docs.num_rows or not passages.num_rows:
            return out.empty_table()
        a = Automaton(passages.column("text").combine_chunks(), passages.column("owner").to_numpy(), window)
        parts = []
        for batch in docs.combine_chunks().to_batches():
            for b in chunks(batch, "text", CHUNK_BYTES):
                w = W.words(b.column("text"))
                spans = _spans(a.repeats(w, b.column("id").to_numpy()), w, b.num_rows, window)
                parts.append(pa.RecordBatch.from_arrays([b.column("id"), b.column("h"), spans], schema=out).filter(pc.greater(pc.list_value_length(spans), 0)))
        return pa.Table.from_batches(parts, out)

    return run


def _rank(docs: DataFrame) -> Column:
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST))


def find_repeats(docs: DataFrame, window: int = 50, seed: int = 16) -> DataFrame:
    """id, h and spans: of each document with repeats, by rank and hash of text, the words that they cover, as
    starts and ends (exclusive) by turns, counted from 0.
    """
    keep = Scratch()
    keyed = docs.select(_rank(docs).alias("id"), F.xxhash64(docs["text"]).alias("h"), docs["text"].alias("text"))
    named = keyed.mapInArrow(_named(window, seed), "id long, h long, seed long")
    shared = named.groupBy("seed").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("seed")
    hits = keep(named.join(shared, "seed").dropDuplicates(["id", "h", "seed"]).groupBy("id", "h").agg(F.collect_list("seed").alias("seeds")), "repeat-seeds")
    ids = hits.select("id", "h")
    held = bounded_broadcast(ids, ids.count())
    some = keep(keyed.join(held, ["id", "h"], "semi").join(hits, ["id", "h"]), "repeat-documents")

    found = some.select("id", "text", "seeds").mapInArrow(_candidates(window, seed), "h1 long, h2 long, id long")
    own = found.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.max("id").alias("hi")).where("id < hi").groupBy("id").agg(F.collect_list("h1").alias("own"))
    passages = some.select("id", "text").join(own, "id").mapInArrow(_passages(window, seed), "passage long, owner long, text string, seeds array<long>")
    passages = keep(passages.dropDuplicates(["passage", "owner"]), "repeat-passages")

    size = some.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    block = F.pmod(F.xxhash64("id", "h", F.lit("block")), F.lit(max(1, -(-size // BLOCK_BYTES)))).alias("block")
    wanted = hits.select(block, F.explode("seeds").alias("seed")).distinct()
    sent = passages.select("passage", "owner", F.explode("seeds").alias("seed")).join(wanted, "seed").select("block", "passage", "owner").distinct()
    sent = sent.join(passages.select("passage", "owner", "text"), ["passage", "owner"]).select("block", "owner", "text")
    dealt = some.select(block, "id", "h", "text")
    spans = dealt.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(_stream(window), "id long, h long, spans array<long>")
    spans = keep(spans.dropDuplicates(["id", "h"]), "repeat-spans")
    keep.clear(spans)
    return spans


def _kept(columns: list[str]) -> Kernel:
    """All columns, `text` without the words in `_spans`, and the counts of words and of removed ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, "_text"):
                w = W.words(b.column("_text"))
                n = np.bincount(w.row, minlength=b.num_rows)
                spans = b.column("_spans")
                flat = spans.flatten().to_numpy()
                of = np.repeat(np.arange(b.num_rows), pc.fill_null(pc.list_value_length(spans), 0).to_numpy())
                edge = np.zeros(len(w.row) + 1, np.int64)
                np.add.at(edge, flat + (np.cumsum(n) - n)[of], np.tile([1, -1], len(flat) // 2))
                kept = np.cumsum(edge[:-1]) == 0
                left = np.bincount(w.row[kept], minlength=b.num_rows)
                texts = W.joined(w, kept, b.num_rows)
                yield pa.RecordBatch.from_arrays([texts, pa.array(n), pa.array(n - left), *(b.column(c) for c in columns)], ["_text", "_n", "_removed", *columns])

    return run


def remove_repeats(docs: DataFrame, window: int = 50, seed: int = 16, n_words: str = "n_words", n_removed: str = "n_removed") -> DataFrame:
    """`docs` with the words of repeats taken out of text, the others joined by one space, and the columns `n_words` and `n_removed`."""
    docs = docs.drop(n_words, n_removed)
    spans = find_repeats(docs, window, seed)
    spans = bounded_broadcast(spans, spans.count())
    rest = [c for c in docs.columns if c != "text"]
    # other columns go through under numbers, so that no name can clash
    d = docs.join(spans, (_rank(docs) == spans["id"]) & (F.xxhash64(docs["text"]) == spans["h"]), "left")
    d = d.select(docs["text"].alias("_text"), spans["spans"].alias("_spans"), *(docs[c].alias(f"c{i}") for i, c in enumerate(rest)))
    kinds = dict(zip(docs.columns, (f.dataType.simpleString() for f in docs.schema.fields)))
    columns = [f"c{i}" for i in range(len(rest))]
    out = d.mapInArrow(_kept(columns), ", ".join(["_text string, _n long, _removed long", *(f"c{i} {kinds[c]}" for i, c in enumerate(rest))]))
    name = dict(zip(rest, columns)) | {"text": "_text"}
    return out.select(*(out[name[c]].alias(c) for c in docs.columns), out["_n"].alias(n_words), out["_removed"].alias(n_removed))
