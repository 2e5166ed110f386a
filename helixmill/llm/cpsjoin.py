"""MinHash near-dedup by a chosen-path set similarity join (operator 3; Christiani, Pagh and Sivertsen 2018).

Documents are sets of word shingles, embedded once as minwise tokens. Equal sets are one
class, of which one representative goes on. In each of several independent trees a node
holds the representatives that share all tokens chosen on the way to it; a node chooses about
1/similarity further positions and branches by the tokens there, so that similar pairs meet
in about as many nodes as on the level above, and others part. The first levels are walked
without looking at the nodes; from there on, nodes of a few members are compared exhaustively
and larger ones branch on.

Pairs that look similar by their tokens are candidates, and links are confirmed on full sets,
in three passes, so that a group of many copies costs a few confirmations a member:

1. Each member offers its most similar partner among those before it in a fixed random order;
   in large nodes, among a few leaders. Confirmed links form components.
2. Each member offers its most similar partner in any other component.
3. The members that still have a candidate in another component are held against each other
   on their full sets, node by node, in blocks where nodes are large. Only links that join
   components leave a node, so no pass writes more than a row or two for each member of a node.

A large node mostly within one component would stay together on every level, so it is
compared at once instead: the members outside the component with all of the node. So is any
node left on the last level. After the third pass no candidate of any node is unconfirmed,
but for those within one component, which can change nothing.

Defined results: null and wordless texts are empty sets, alone in their components; a text
of fewer words than a shingle is one shingle; equal rows are in one class; a doc_id names
one document, so rows that repeat it are linked; a row without doc_id is linked with nothing,
has a null component_id and is kept; a pair just at the limit is linked; a text of any length is
one full set, which two tasks at most hold at a time; an empty table gives an empty result; further columns
are kept by `keep_one`, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.llm.common import Scratch, bounded_broadcast, chunks, discard, fresh, hash_words, materialize, mix64, small_batches, split_words
from helixmill.llm.components import components

TOKENS = 64
#: Entries of a matrix of sets by shingles, at most.
CELLS = 4_000_000
_RNG = np.random.Generator(np.random.PCG64(20180611))
_XOR = _RNG.integers(0, 2**64, TOKENS, dtype=np.uint64)
_MUL = _RNG.integers(0, 2**64, TOKENS, dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of each text, ascending within it, and their text numbers."""
    words, row = split_words(pc.ascii_lower(texts))
    h = hash_words(words)
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    count = np.bincount(row, minlength=len(texts))
    start = np.cumsum(count) - count
    # word i begins a shingle if k words from it lie in its text, or if it begins a shorter text
    at = np.arange(len(h)) - start[row]
    begins = np.flatnonzero((at + k <= count[row]) | (at == 0))
    s = np.zeros(len(begins), np.uint64)
    for j in range(k):
        there = np.minimum(begins + j, len(h) - 1)
        inside = (at[begins] + j) < count[row[begins]]
        s = np.where(inside, mix64(s * np.uint64(0x9E3779B97F4A7C15) + h[there] + np.uint64(j + 1)), s)
    r = row[begins].astype(np.int64)
    order = np.lexsort((s, r))
    s, r = s[order], r[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
    return s[new], r[new]


def _ends(row: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int64)


def _embed(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, "text"):
                s, row = shingle_sets(b.column("text"), k)
                end = _ends(row, b.num_rows)
                real = np.flatnonzero(np.diff(end))
                sig = np.zeros((b.num_rows, TOKENS), np.uint32)
                for j in range(TOKENS if len(real) else 0):
                    sig[real, j] = np.minimum.reduceat(((s ^ _XOR[j]) * _MUL[j]) >> np.uint64(32), end[real])
                digest = np.frombuffer(b"".join(hashlib.blake2b(s[x:y].tobytes(), digest_size=16).digest() for x, y in zip(end, end[1:])), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": b.column("doc_id").cast(pa.int64()), "n_shingles": pa.array(np.diff(end)), "h1": pa.array(digest[:, 0]), "h2": pa.array(digest[:, 1]), "sig": pa.array([x.tobytes() for x in sig], pa.binary())}
                )

    return run


def embed(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, h1 and h2 (a hash of the set) and sig (the minwise tokens) of each row."""
    return docs.select("doc_id", "text").mapInArrow(_embed(k), "doc_id long, n_shingles long, h1 long, h2 long, sig binary")


def _tokens(column: pa.Array | pa.ChunkedArray, kind: type = np.uint32) -> np.ndarray:
    """The rows of a column of TOKENS numbers each."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    if not len(column):
        return np.zeros((0, TOKENS), kind)
    end = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[end[0] : end[-1]].view(kind).reshape(-1, TOKENS)


def _short(sig: np.ndarray) -> list[bytes]:
    """Eight bits of each token: enough to judge a pair by."""
    return [x.tobytes() for x in (sig ^ (sig >> np.uint32(8)) ^ (sig >> np.uint32(16))).astype(np.uint8)]


def _choices(node: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of `node` and the positions that each chooses: 1/similarity on average, one at least."""
    h = mix64(node)
    first = (h % np.uint64(TOKENS)).astype(np.int64)
    h2 = mix64(h + np.uint64(1))
    more = np.flatnonzero((h2 >> np.uint64(11)).astype(float) / 2**53 < 1 / similarity - 1)
    second = (first[more] + 1 + (mix64(h2[more]) % np.uint64(TOKENS - 1)).astype(np.int64)) % TOKENS
    return np.concatenate([np.arange(len(node)), more]), np.concatenate([first, second])


def _children(node: np.ndarray, of: np.ndarray, sig: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The child nodes of nodes, and the rows of `sig` in them; `of` has the row in each node."""
    which, place = _choices(node, similarity)
    row = of[which]
    return mix64(mix64(node[which] + place.astype(np.uint64) + np.uint64(1)) ^ sig[row, place].astype(np.uint64)), row


def _paths(trees: int, depth: int, similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """node and rep for all nodes that a row's paths reach after `depth` levels, or from its `node` one level further."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sig = _tokens(b.column("sig"))
            if "node" in b.schema.names:
                node, of = _children(b.column("node").to_numpy().view(np.uint64), np.arange(b.num_rows), sig, similarity)
            else:
                of, node = np.repeat(np.arange(b.num_rows), trees), mix64(np.tile(np.arange(1, trees + 1, dtype=np.uint64), b.num_rows))
                for _ in range(depth):
                    node, of = _children(node, of, sig, similarity)
            yield pa.RecordBatch.from_pydict({"node": pa.array(node.view(np.int64)), "rep": b.column("rep").take(pa.array(of))})

    return run


def _pairs_within(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat places of all pairs (first before second) within lists of the given sizes."""
    end = np.cumsum(size)
    later = np.repeat(end, size) - np.arange(size.sum()) - 1
    first = np.repeat(np.arange(len(later)), later)
    return first, first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(later) - later, later)


class _Members:
    """The members of nodes as arrays, and how alike two of them are."""

    def __init__(self, t: pa.Table | pa.RecordBatch | pa.StructArray) -> None:
        column = t.field if isinstance(t, pa.StructArray) else t.column
        names = [f.name for f in t.type] if isinstance(t, pa.StructArray) else t.schema.names
        self.rep, self.n = column("rep").to_numpy(), column("n").to_numpy()
        self.node = column("node").to_numpy() if "node" in names else self.rep
        self.label = column("label").to_numpy() if "label" in names else self.rep
        self.short = _tokens(column("short"), np.uint8)

    def alike(self, i: np.ndarray, other: _Members, j: np.ndarray, similarity: float, margin: float) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs may be similar (by set sizes for sure, by tokens within the margin), and the shares of equal tokens of those."""
        at = np.flatnonzero(np.minimum(self.n[i], other.n[j]) >= similarity * np.maximum(self.n[i], other.n[j]) - 1e-9)
        near = np.zeros(len(at), np.float32)
        for x in range(0, len(at), 1 << 17):
            y = at[x : x + (1 << 17)]
            near[x : x + (1 << 17)] = (self.short[i[y]] == other.short[j[y]]).mean(-1, dtype=np.float32)
        ok = near >= similarity - margin
        return at[ok], near[ok]


def _best(keys: list[np.ndarray], near: np.ndarray, partner: np.ndarray) -> np.ndarray:
    """Places of the most similar pair of each key (the lesser partner, of equals)."""
    order = np.lexsort((partner, -near, *keys[::-1]))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order[new]


def _slices(b: pa.RecordBatch, column: str, most: int = 400) -> Iterator[pa.RecordBatch]:
    for x in range(0, b.num_rows, most):
        yield b.slice(x, most)


def _before(rep: np.ndarray) -> np.ndarray:
    """The fixed random order of representatives."""
    return mix64(rep.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))


def _offer_before(similarity: float, margin: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """rep, partner and near: each member's most similar partner before it, in nodes whose members come as lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole, "members"):
                m = _Members(b.column("members").flatten())
                i, j = _pairs_within(pc.list_value_length(b.column("members")).to_numpy())
                turn = _before(m.rep)
                i, j = np.where(turn[i] > turn[j], i, j), np.where(turn[i] > turn[j], j, i)
                ok, near = m.alike(i, m, j, similarity, margin)
                i, j = i[ok], j[ok]
                best = _best([m.rep[i]], near, m.rep[j])
                yield pa.RecordBatch.from_pydict({"rep": pa.array(m.rep[i[best]]), "partner": pa.array(m.rep[j[best]]), "near": pa.array(near[best])})

    return run


def _offer_leaders(similarity: float, margin: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """rep, partner and near: each row's most similar leader before it; its node's leaders come as a list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole, "leaders", 4000):
                lists = b.column("leaders")
                m, leader = _Members(b), _Members(lists.flatten())
                i, j = np.repeat(np.arange(b.num_rows), pc.list_value_length(lists).to_numpy()), np.arange(len(leader.rep))
                earlier = _before(leader.rep)[j] < _before(m.rep)[i]
                i, j = i[earlier], j[earlier]
                ok, near = m.alike(i, leader, j, similarity, margin)
                i, j = i[ok], j[ok]
                best = _best([m.rep[i]], near, leader.rep[j])
                yield pa.RecordBatch.from_pydict({"rep": pa.array(m.rep[i[best]]), "partner": pa.array(leader.rep[j[best]]), "near": pa.array(near[best])})

    return run


OFFER = "rep long, partner long, near float"
FLAG = "node long, rep long, n long"
Report = Callable[["_Members", np.ndarray, "_Members", np.ndarray, np.ndarray], dict[str, pa.Array]]


def _offer(x: _Members, i: np.ndarray, y: _Members, j: np.ndarray, near: np.ndarray) -> dict[str, pa.Array]:
    """OFFER: each member's most similar partner of another component, for pairs seen from both ends."""
    rep, partner, near = np.concatenate([x.rep[i], y.rep[j]]), np.concatenate([y.rep[j], x.rep[i]]), np.concatenate([near, near])
    best = _best([rep], near, partner)
    return {"rep": pa.array(rep[best]), "partner": pa.array(partner[best]), "near": pa.array(near[best])}


def _flag(x: _Members, i: np.ndarray, y: _Members, j: np.ndarray, near: np.ndarray) -> dict[str, pa.Array]:
    """FLAG: the members of each node that have a candidate of another component in it."""
    a, b = np.unique(i), np.unique(j)
    return {c: pa.array(np.concatenate([getattr(x, c)[a], getattr(y, c)[b]])) for c in ("node", "rep", "n")}


def _across_small(similarity: float, margin: float, report: Report) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What `report` says of the candidates of different components in nodes whose members come as lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole, "members"):
                m = _Members(b.column("members").flatten())
                i, j = _pairs_within(pc.list_value_length(b.column("members")).to_numpy())
                differ = m.label[i] != m.label[j]
                i, j = i[differ], j[differ]
                ok, near = m.alike(i, m, j, similarity, margin)
                yield pa.RecordBatch.from_pydict(report(m, i[ok], m, j[ok], near))

    return run


def _across_blocks(similarity: float, margin: float, report: Report) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """As `_across_small`, for a block of a node's members and some members outside its largest component."""

    def run(block: pa.Table, outside: pa.Table) -> pa.Table:
        x, y = (_Members(t.combine_chunks()) for t in (block, outside.rename_columns([c.removeprefix("x_") for c in outside.column_names])))
        i, j, near = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
        for at in range(len(y.rep)):
            a = np.flatnonzero(x.label != y.label[at])
            ok, share = x.alike(a, y, np.full(len(a), at), similarity, margin)
            i.append(a[ok]), j.append(np.full(len(ok), at)), near.append(share)
        return pa.table(report(x, np.concatenate(i), y, np.concatenate(j), np.concatenate(near)))

    return run


def _sets(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """rep, its full set and each partner that wants it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, "text"):
                s, row = shingle_sets(b.column("text"), k)
                end = _ends(row, b.num_rows)
                full = pa.array([s[x:y].tobytes() for x, y in zip(end, end[1:])], pa.binary())
                yield pa.RecordBatch.from_pydict({"rep": b.column("doc_id"), "full": full})

    return run


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [_linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(b.column("x"), b.column("y"))]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _shared(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets x with all sets y: a product of incidence matrices."""
    shingles = np.unique(np.concatenate(y)) if y else np.zeros(0)
    if not len(shingles) or not x:
        return np.zeros((len(x), len(y)), np.float32)

    def flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(v) for v in sets])

    def incidence(n: int, values: np.ndarray, row: np.ndarray, some: np.ndarray) -> np.ndarray:
        within = np.flatnonzero((values >= some[0]) & (values <= some[-1]))
        at = np.searchsorted(some, values[within])
        here = some[at] == values[within]
        m = np.zeros((n, len(some)), np.float32)
        m[row[within[here]], at[here]] = 1
        return m

    # as many shingles at a time as make matrices of a bounded size, however long the texts
    step = max(1, CELLS // max(len(x), len(y)))
    parts = [shingles[a : a + step] for a in range(0, len(shingles), step)]
    left, right = flat(x), flat(y)
    return sum((incidence(len(x), *left, p) @ incidence(len(y), *right, p).T).astype(np.float64) for p in parts)


class _State:
    """The full sets gathered so far, the pairs tested, and the component of each representative that has a link."""

    def __init__(self, docs: DataFrame, k: int, percent: int) -> None:
        spark = docs.sparkSession
        self.docs, self.k, self.percent = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), k, percent
        self.scratch = Scratch()
        self.sets: list[DataFrame] = []
        self.have = spark.createDataFrame([], "rep long")
        self.tested = spark.createDataFrame([], "a long, b long")
        self.labels = spark.createDataFrame([], "node long, component long")

    def labelled(self, p: DataFrame, of: str = "rep", label: str = "label") -> DataFrame:
        """`p` with the component of the representative in column `of`."""
        named = self.labels.withColumnsRenamed({"node": "l_node", "component": "l_component"})
        return p.join(named, p[of] == named["l_node"], "left").withColumn(label, F.coalesce("l_component", of)).drop("l_node", "l_component")

    def full(self, reps: DataFrame) -> DataFrame:
        """rep and full (its shingle set) for at least the doc_ids in `reps` (rep)."""
        new = self.scratch(reps.select("rep").distinct().join(self.have, "rep", "left_anti"), "wanted")
        if not new.isEmpty():
            self.have = self.have.unionByName(new)
            want = bounded_broadcast(new, new.count()).withColumnRenamed("rep", "want")
            texts = self.docs.join(want, F.col("doc_id") == F.col("want"), "left_semi")
            self.sets.append(self.scratch(texts.mapInArrow(_sets(self.k), "rep long, full binary"), "sets"))
        return functools.reduce(DataFrame.unionByName, self.sets) if self.sets else self.docs.sparkSession.createDataFrame([], "rep long, full binary")

    def test(self, pairs: DataFrame) -> None:
        """Confirm those of the pairs (a, b) that are new on full sets, and merge what they link."""
        new = self.scratch(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(self.tested, ["a", "b"], "left_anti"), "candidates")
        if not new.isEmpty():
            self.tested = self.tested.unionByName(new)
            sets = self.full(new.select(F.explode(F.array("a", "b")).alias("rep")))
            x, y = sets.select(F.col("rep").alias("a"), F.col("full").alias("x")), sets.select(F.col("rep").alias("b"), F.col("full").alias("y"))
            self.link(new.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_confirm(self.percent), "a long, b long"))

    def test_best(self, offers: DataFrame) -> None:
        """`test` the most similar partner that each rep was offered."""
        best = offers.groupBy("rep").agg(F.max_by("partner", F.struct("near", "partner")).alias("partner"))
        self.test(best.select(F.col("rep").alias("a"), F.col("partner").alias("b")))

    def link(self, links: DataFrame) -> None:
        """Merge components by confirmed links (a, b)."""
        ends = self.labelled(self.labelled(links, "a", "x"), "b", "y").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
        moved = components(ends)
        if moved is not None:
            moved = moved.withColumnsRenamed({"node": "m_node", "component": "moved"})
            known = self.labels.unionByName(moved.select(F.col("m_node").alias("node"), F.col("m_node").alias("component")).join(self.labels.select("node"), "node", "left_anti"))
            d = known.join(moved, known["component"] == moved["m_node"], "left")
            self.labels = self.scratch(d.select("node", F.coalesce("moved", "component").alias("component")), "labels")


def _leaders(p: DataFrame, most: int) -> DataFrame:
    """node and leaders, a list of members of each node: in up to `most` slices of it, the first in the order of a hash."""
    item = F.struct(F.xxhash64(F.lit("leader"), "rep").alias("h"), "rep", "n", "short")
    sliced = p.groupBy("node", F.pmod(F.xxhash64("rep"), F.lit(most)).alias("part")).agg(F.min(item).alias("one"))
    return sliced.groupBy("node").agg(F.collect_list(F.struct("one.rep", "one.n", "one.short")).alias("leaders"))


def _mixed(p: DataFrame) -> DataFrame:
    """node, size, shingles, main and outside of the nodes of several components: the largest one, and the members out of it."""
    sizes = p.groupBy("node", "label").agg(F.count("*").alias("c"), F.sum("n").alias("s")).groupBy("node")
    d = sizes.agg(F.sum("c").alias("size"), F.sum("s").alias("shingles"), F.max_by("label", F.struct("c", "label")).alias("main"), (F.sum("c") - F.max("c")).alias("outside"))
    return d.where("outside > 0")


def _listed(p: DataFrame, *columns: str) -> DataFrame:
    return p.groupBy("node").agg(F.collect_list(F.struct(*columns)).alias("members")).select("members")


def _parts(n: str, block: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col(n) / block)).cast("int")


def _part(n: str, block: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("part"), "rep"), _parts(n, block)).cast("int")


def _every(n: str, block: int) -> Column:
    return F.explode(F.sequence(F.lit(0), _parts(n, block) - 1))


def _blocks(p: DataFrame, how: Callable[[pa.Table, pa.Table], pa.Table], cols: tuple[str, ...], schema: str, block: int = 1024) -> DataFrame:
    """What `how` gives for mixed nodes of any size: the members outside the largest component against all.

    Both are dealt in blocks of about `block` members, and each pair of blocks is a group of its own.
    """
    keys = ["node", "one", "two"]
    members = p.withColumn("one", _part("size", block)).withColumn("two", _every("outside", block)).select(*keys, *cols)
    outside = p.where("label <> main").withColumn("two", _part("outside", block)).withColumn("one", _every("size", block))
    outside = outside.select(*(F.col(c).alias(f"x_{c}") for c in (*keys, *cols)))
    return members.groupBy(*keys).cogroup(outside.groupBy(*(f"x_{c}" for c in keys))).applyInArrow(how, schema)


class _Merged:
    """Components of a node as links join them."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def top(self, label: int) -> int:
        while label in self.up:
            label = self.up[label]
        return label

    def join(self, a: int, b: int) -> bool:
        """Whether that is news."""
        a, b = self.top(a), self.top(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


class _Sets:
    """The full sets of members of a node, and which nodes before it each of them is in."""

    columns = ("node", "nodes", "rep", "label", "full")

    def __init__(self, node: pa.Array, nodes: pa.Array, rep: pa.Array, label: pa.Array, full: pa.Array) -> None:
        self.rep, self.label, self.sets = rep.to_numpy(), label.to_numpy(), [np.frombuffer(v.as_buffer(), np.uint64) for v in full]
        self.size = np.array([len(v) for v in self.sets])
        self.before = [(lambda a: a[a < v])(n.values.to_numpy()) for v, n in zip(node.to_numpy(), nodes)]


def _links(x: _Sets, y: _Sets, percent: int, chunk: int = 16, cells: int = 8_000_000) -> Iterator[tuple[int, int]]:
    """Links between members of `x` and `y` of different components, and of these only such as join components that no earlier one did.

    A pair that meets in several nodes is held against each other in the first of them alone.
    """
    merged = _Merged()
    for lo in range(0, len(y.sets), chunk):
        part, size, label = y.sets[lo : lo + chunk], y.size[lo : lo + chunk], y.label[lo : lo + chunk]
        step = max(1, cells // max(1, int(size.sum())))
        new = (x.label[:, None] != label) & (_shared(x.before, y.before[lo : lo + chunk]) == 0)
        rows = np.flatnonzero(new.any(1))
        for at in range(0, len(rows), step):
            i = rows[at : at + step]
            both = _shared([x.sets[k] for k in i], part)
            ok = (100 * both >= percent * (x.size[i, None] + size - both)) & new[i]
            for k, j in np.argwhere(ok):
                if merged.join(int(x.label[i[k]]), int(label[j])):
                    yield int(x.rep[i[k]]), int(y.rep[lo + j])


LINK = "a long, b long"


def _link_table(found: list[tuple[int, int]]) -> dict[str, pa.Array]:
    return {c: pa.array([link[k] for link in found], pa.int64()) for k, c in enumerate("ab")}


def _exact_small(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The links of nodes whose members come as lists with their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[tuple[int, int]] = []
            for members in b.column("members"):
                m = _Sets(*(members.values.field(c) for c in _Sets.columns))
                found += _links(m, m, percent)
            yield pa.RecordBatch.from_pydict(_link_table(found))

    return run


def _exact_block(percent: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The links between a block of a node's members and some members outside its largest component."""

    def run(block: pa.Table, outside: pa.Table) -> pa.Table:
        x, y = (_Sets(*(t.column(f"{p}{c}").combine_chunks() for c in _Sets.columns)) for p, t in (("", block), ("x_", outside)))
        return pa.table(_link_table(list(_links(x, y, percent))))

    return run


def _confirm_within(state: _State, flagged: DataFrame, small: int) -> None:
    """Hold all flagged members (node, rep, n) of a node that are of different components against each other on full sets, and link."""
    p = state.scratch(state.labelled(flagged.distinct()), "flagged")
    own = _mixed(p).withColumnRenamed("node", "m_node")
    p = state.scratch(p.join(own, p["node"] == own["m_node"]).drop("m_node"), "flagged")
    if p.isEmpty():
        return
    nodes = p.groupBy("rep").agg(F.collect_list("node").alias("nodes"))
    p = p.join(state.full(p).join(nodes, "rep"), "rep")
    few = _listed(p.where(F.col("size") <= small), *_Sets.columns).mapInArrow(_exact_small(state.percent), LINK)
    # blocks are bounded by their members and by their shingles
    by = lambda c: F.greatest(F.col(c), F.ceil(F.col("shingles") / 4000))
    many = p.where(F.col("size") > small).withColumns({"size": by("size"), "outside": by("outside")})
    state.link(few.unionByName(_blocks(many, _exact_block(state.percent), ("nodes", "rep", "label", "full"), LINK, 512)))


def _across(p: DataFrame, similarity: float, margin: float, small: int, report: Report, schema: str) -> DataFrame:
    """What `report` says of the candidates between components in mixed nodes (node, size, main, outside, rep, n, short, label)."""
    few, large = p.where(F.col("size") <= small), p.where(F.col("size") > small)
    found = _listed(few, "node", "rep", "n", "short", "label").mapInArrow(_across_small(similarity, margin, report), schema)
    return found.unionByName(_blocks(large, _across_blocks(similarity, margin, report), ("rep", "n", "short", "label"), schema))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, trees: int = 10, depth: int = 3, most_depth: int = 8, small: int = 64, few_enough: int = 4096, leaders: int = 8, margin: float = 0.18) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of `docs`.

    Links are pairs with 100 * intersection >= percent * union of their sets of k-word
    shingles; component_id is the least doc_id reachable by links. A pair at the limit still
    shares a node of a tree after three levels with a chance of 0.58, and ten trees miss
    it with one of 0.0002; nodes of more than `small` members go one level deeper, and those of
    more than `few_enough` on, down to `most_depth` levels, where ten trees miss it with a
    chance of 0.005. `margin` is 3.5 standard
    deviations of the estimate from 64 tokens.
    """
    with small_batches(docs.sparkSession):
        rows, classes, labels = _join(docs, k, percent, trees, depth, most_depth, small, few_enough, leaders, margin)
    # a set that only one unlinked document has says nothing new
    named = labels.withColumnsRenamed({"node": "l_node"})
    known = classes.join(named, classes["rep"] == named["l_node"], "left").select("h1", "h2", "copies", "rep", F.coalesce("component", "rep").alias("component"))
    known = materialize(known.where("copies > 1 or component <> rep").select(F.col("h1").alias("c_h1"), F.col("h2").alias("c_h2"), "component"), "components")
    d = rows.join(bounded_broadcast(known, known.count()), (rows["h1"] == known["c_h1"]) & (rows["h2"] == known["c_h2"]) & rows["doc_id"].isNotNull() & (rows["n_shingles"] > 0), "left")
    d = d.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return d.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _join(docs: DataFrame, k: int, percent: int, trees: int, depth: int, most_depth: int, small: int, few_enough: int, leaders: int, margin: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The embedded rows (without tokens), the classes (h1, h2, rep, copies) and the component of each linked representative."""
    similarity = percent / 100
    state = _State(docs, k, percent)
    rows = state.scratch(embed(docs, k), "embedded")
    known = rows.where("n_shingles > 0 and doc_id is not null")
    classes = state.scratch(known.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.any_value("n_shingles").alias("n"), F.any_value("sig").alias("sig")), "classes")
    reps = classes.select("rep", "n", "sig")
    short = reps.mapInArrow(_sketch, "rep long, n long, short binary")
    _link_repeated_ids(state, known, classes)
    offers, kept = [], []
    paths = state.scratch(reps.mapInArrow(_paths(trees, depth, similarity), "node long, rep long"), "paths")
    for level in range(depth, most_depth + 1):
        sizes = paths.groupBy("node").agg(F.count("*").alias("size")).where("size > 1").withColumnRenamed("node", "s_node")
        met = paths.join(sizes, paths["node"] == sizes["s_node"]).drop("s_node")
        met = state.scratch(met.join(short, "rep").select("node", "size", "rep", "n", "short", *(["label"] if level > depth else [])), "met")
        discard(paths)
        if level == depth:
            few = _listed(met.where(F.col("size") <= small), "rep", "n", "short").mapInArrow(_offer_before(similarity, margin), OFFER)
            large = met.where(F.col("size") > small)
            many = large.join(_leaders(large, leaders), "node").select("rep", "n", "short", "leaders").mapInArrow(_offer_leaders(similarity, margin), OFFER)
            state.test_best(few.unionByName(many))
            short = state.scratch(state.labelled(short), "tagged")
            bare, met = met, state.scratch(state.labelled(met), "met")
            discard(bare)
        own = _mixed(met).select(F.col("node").alias("m_node"), "main", "outside")
        # every node has a chance to part; one that then has few enough members is compared
        dense = F.col("outside") <= F.greatest(F.lit(small), F.col("size") / 4)
        dense = dense if level == depth else dense | (F.col("size") <= few_enough) if level < most_depth else F.lit(True)
        mixed = met.join(own, met["node"] == own["m_node"]).drop("m_node").withColumn("done", dense | (F.col("size") <= small))
        mixed = state.scratch(mixed, "mixed")
        discard(met)
        kept.append(mixed.where("done"))
        offers.append(_across(kept[-1], similarity, margin, small, _offer, OFFER))
        rest = mixed.where("not done").select("node", "rep")
        if rest.isEmpty():
            break
        paths = state.scratch(rest.join(reps.select("rep", "sig"), "rep").select("node", "rep", "sig").mapInArrow(_paths(trees, 1, similarity), "node long, rep long"), "paths")
    state.test_best(functools.reduce(DataFrame.unionByName, offers))
    members = functools.reduce(DataFrame.unionByName, kept).select("node", "rep", "n", "short")
    members = state.labelled(members)
    own = _mixed(members).withColumnRenamed("node", "m_node").drop("shingles")
    mixed = state.scratch(members.join(own, members["node"] == own["m_node"]).drop("m_node"), "mixed")
    _confirm_within(state, _across(mixed, similarity, margin, small, _flag, FLAG), small)
    state.scratch.clear(rows, classes, state.labels)
    return rows.drop("sig"), classes, state.labels


def _link_repeated_ids(state: _State, rows: DataFrame, classes: DataFrame) -> None:
    """Link the classes in which one doc_id occurs with different sets."""
    twice = rows.groupBy("doc_id").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo < hi")
    twice = state.scratch(twice.select(F.col("doc_id").alias("t_id")), "repeated-ids")
    if not twice.isEmpty():
        found = rows.join(twice, F.col("doc_id") == F.col("t_id"), "left_semi").select("doc_id", "h1", "h2").join(classes.select("h1", "h2", "rep"), ["h1", "h2"])
        state.link(found.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b"))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rep, n and short, eight bits of each token, of each representative."""
    for b in batches:
        if b.num_rows:
            yield pa.RecordBatch.from_pydict({"rep": b.column("rep"), "n": b.column("n"), "short": pa.array(_short(_tokens(b.column("sig"))), pa.binary())})


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, **how: float) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: that of the least doc_id.

    Of rows that repeat a doc_id one stays; rows without doc_id all stay. Texts are shuffled
    only if the ids to be left out are too many to broadcast.
    """
    found = materialize(near_duplicates(docs, k, percent, **how).select("doc_id", "kept"), "verdicts")
    ids = found.where("doc_id is not null").groupBy("doc_id").agg(F.bool_and("kept").alias("kept"), F.count("*").alias("n"))
    odd = materialize(ids.where("not kept or n > 1").select(F.col("doc_id").alias("o_id"), F.when(F.col("kept"), 1).otherwise(0).alias("stays")), "odd-ids")
    odd_id, stays = fresh("o_id", docs), fresh("stays", docs)
    odd = bounded_broadcast(odd, odd.count()).withColumnsRenamed({"o_id": odd_id, "stays": stays})
    alone = docs.join(odd, docs["doc_id"] == odd[odd_id], "left_anti")
    repeated = docs.join(odd.where(F.col(stays) == 1), docs["doc_id"] == odd[odd_id], "left_semi")
    return alone.unionByName(repeated.dropDuplicates(["doc_id"]))
