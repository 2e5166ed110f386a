"""SentencePiece encoding and decoding with the tokenizers library (operator 2).

The model file is a protobuf; its pieces, scores, normaliser and byte fallback are read
from the wire format and rebuilt as a tokenizers backend: unigram models from their scores,
BPE models from merges in order of the scores of their results. White space becomes the
marker U+2581. Where no piece reaches over the start of a run of spaces, different words of many
texts are merged once, and texts get their words' ids (`Encoder`). Ids are decoded by joining the bytes of their pieces in Arrow; where that is
no text, or there are control pieces, by the backend. `parity`, and `round_trip`
on request, hold ids and decoded texts against the sentencepiece library itself.

Defined results: null text is empty and has no ids; a text of any length is encoded whole, in
one task; of equal segmentations the one counts that the library takes; null ids stand for an empty text; equal
rows give equal results; an empty table gives an empty result; further columns are kept, but
a column that goes by the name of a new one (in any case) is replaced.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from helixmill.llm.common import chunks, text_or_empty
from helixmill.llm.tokens import ENCODE_BYTES, once, shared_file, use_threads

MARKER = "▁"
#: A code point that is no character, and is set before pieces that stand for no text.
UNMATCHED = "\ufdd0"
#: Fixed values of the model format: model types, and types of pieces.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Equal words are found in texts of about so many bytes at once.
WORDS_BYTES = 32_000_000
#: Different words are merged side by side in strings of about so many bytes.
SIDE_BY_SIDE = 1000


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra_spaces: bool = True
    escape_spaces: bool = True


def _varint(data: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[i]
        value |= (byte & 127) << shift
        i, shift = i + 1, shift + 7
        if byte < 128:
            return value, i


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a protobuf message."""
    i = 0
    while i < len(data):
        key, i = _varint(data, i)
        if key & 7 == 0:
            value, i = _varint(data, i)
        else:
            size, i = _varint(data, i) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], i)
            value, i = data[i : i + size], i + size
        yield key >> 3, value


def parse(data: bytes) -> Model:
    m = Model()
    for number, value in _fields(data):
        if number == 1:
            p = dict(_fields(value))
            m.pieces.append((p.get(1, b"").decode(), struct.unpack("<f", p.get(2, bytes(4)))[0], p.get(3, NORMAL)))
        elif number == 2:
            t = dict(_fields(value))
            m.kind, m.byte_fallback = t.get(3, UNIGRAM), bool(t.get(35, 0))
        elif number == 3:
            t = dict(_fields(value))
            m.charsmap = t.get(2, b"")
            m.dummy_prefix, m.remove_extra_spaces, m.escape_spaces = (bool(t.get(k, 1)) for k in (3, 4, 5))
    return m


def _merges(m: Model, vocab: dict[str, int]) -> list[tuple[str, str]]:
    """All splits of pieces into two pieces, best results first, then by their halves' order."""
    ranked = sorted((i for i, (_, _, t) in enumerate(m.pieces) if t == NORMAL and len(m.pieces[i][0]) > 1), key=lambda i: -m.pieces[i][1])
    out = []
    for i in ranked:
        p = m.pieces[i][0]
        out += sorted(((p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in vocab and p[k:] in vocab), key=lambda x: (vocab[x[0]], vocab[x[1]]))
    return out


def _stand_ins(m: Model) -> dict[str, str]:
    """A private character for each user-defined piece, longest pieces first: such pieces are cut out of a text before it is merged.

    Characters are taken from the end of the last private plane; a text that has them itself is read as having the pieces.
    """
    own = sorted((p for p, _, t in m.pieces if t == USER_DEFINED), key=lambda p: (-len(p), p))
    return {p: chr(0x10FFFD - i) for i, p in enumerate(own)}


def build(data: bytes) -> Tokenizer:
    """The tokenizers backend of a SentencePiece model file."""
    m = parse(data)
    unknown = next((i for i, (_, _, t) in enumerate(m.pieces) if t == UNKNOWN), 0)
    usable = {p: i for i, (p, _, t) in enumerate(m.pieces) if t in (NORMAL, USER_DEFINED, BYTE)}
    if m.kind == BPE:
        every = {p: i for i, (p, *_) in enumerate(m.pieces)}
        # texts must not match control pieces, so those are not in any merge
        every |= {c: every[p] for p, c in _stand_ins(m).items()}
        model = models.BPE(vocab=every, merges=_merges(m, usable), unk_token=m.pieces[unknown][0], fuse_unk=True, byte_fallback=m.byte_fallback, cache_capacity=0)
    elif m.kind == UNIGRAM:
        # the library takes the cost of unknown characters from the least score of normal pieces; pieces
        # that no text may match go by names that no text has, and byte pieces are kept from it below
        low = min((s for _, s, t in m.pieces if t == NORMAL), default=0.0)
        scored = [(p, s) if t in (NORMAL, USER_DEFINED) else (p if t == BYTE else f"{UNMATCHED}{p}", low) for p, s, t in m.pieces]
        model = models.Unigram(scored, unk_id=unknown, byte_fallback=m.byte_fallback)
    else:
        raise ValueError(f"model type {m.kind} is neither unigram nor BPE")
    t = Tokenizer(model)
    steps: list[normalizers.Normalizer] = [normalizers.Replace(p.replace(MARKER, " ") if m.escape_spaces else p, c) for p, c in _stand_ins(m).items()] if m.kind == BPE else []
    steps += [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.remove_extra_spaces:  # U+0020 alone: tabs and line ends stay, unless the charsmap made spaces of them
        steps += [normalizers.Replace(Regex(" +"), " "), normalizers.Replace(Regex(r"\A | \z"), "")]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(MARKER if m.escape_spaces else " "))
    if m.escape_spaces:
        steps.append(normalizers.Replace(" ", MARKER))
    if steps:
        t.normalizer = normalizers.Sequence(steps)
    if m.kind == UNIGRAM and m.byte_fallback:
        t.pre_tokenizer = pre_tokenizers.Split(Regex("<(?=0x[0-9A-F]{2}>)"), "isolated")
    undo: list = [decoders.Replace(MARKER, " ")] if m.escape_spaces else []
    undo += [decoders.ByteFallback(), decoders.Fuse()]
    if m.dummy_prefix:
        undo.append(decoders.Strip(" ", 1, 0))
    t.decoder = decoders.Sequence(undo)
    return t


@dataclass
class Decoder:
    """The bytes of each piece, by id; which ids need the backend; whether a first space is dropped; and the number of those bytes."""

    pieces: pa.Array
    special: np.ndarray
    strip: bool
    sizes: np.ndarray

    @classmethod
    def of(cls, data: bytes) -> Decoder:
        m = parse(data)
        plain = [bytes([int(p[3:5], 16)]) if t == BYTE else (p.replace(MARKER, " ") if m.escape_spaces else p).encode() for p, _, t in m.pieces]
        return cls(pa.array(plain, pa.large_binary()), np.array([t in (UNKNOWN, CONTROL, UNUSED) for *_, t in m.pieces]), m.dummy_prefix, np.array([len(p) for p in plain]))

    def __call__(self, ids: pa.ListArray, backend: Tokenizer) -> pa.Array:
        flat, ends = ids.flatten(), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))])
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), self.pieces.take(flat)), pa.scalar(b"", pa.large_binary()))
        odd = np.concatenate([[0], np.cumsum(self.special[flat.to_numpy(zero_copy_only=False)])])
        odd = np.diff(odd[ends]) > 0
        try:
            texts = joined.cast(pa.large_string())
        except pa.ArrowInvalid:  # byte pieces that are no text
            odd |= np.array([not _is_text(x.as_py()) for x in joined])
            texts = pc.if_else(pa.array(odd), b"", joined).cast(pa.large_string())
        if self.strip:
            texts = pc.replace_substring_regex(texts, r"\A ", "", max_replacements=1)
        if odd.any():
            mask = pa.array(odd)
            texts = pc.replace_with_mask(texts, mask, pa.array(backend.decode_batch(ids.filter(mask).to_pylist(), skip_special_tokens=False), pa.large_string()))
        return texts.cast(pa.string())


def splits_at_spaces(m: Model) -> bool:
    """Whether ids of a text are those of its words, each with the spaces before it: no merge reaches over the start of a run of markers."""
    own = {p for p, _, t in m.pieces if t == NORMAL}
    as_is = m.escape_spaces and not m.remove_extra_spaces and not m.charsmap and all(t != USER_DEFINED for *_, t in m.pieces)
    return m.kind == BPE and as_is and MARKER in own and not any(MARKER in p.lstrip(MARKER) for p in own)


def _laid_out(texts: pa.Array) -> tuple[np.ndarray, pa.Buffer]:
    """Where each text ends (0 first) in the bytes of all of them, and those."""
    texts = texts.cast(pa.string())
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)])
    if not ends[-1]:
        return ends, pa.py_buffer(b"")
    first = int(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset])
    return ends, texts.buffers()[2].slice(first, int(ends[-1]))


def _cut(ends: np.ndarray, data: pa.Buffer) -> pa.StringArray:
    return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int32)), data)


@dataclass
class Encoder:
    """Ids of whole texts; by_words is the backend without a normaliser, if words can be merged by themselves."""

    backend: Tokenizer
    by_words: Tokenizer | None
    decoder: Decoder

    @classmethod
    def of(cls, data: bytes) -> Encoder:
        by_words = None
        if splits_at_spaces(parse(data)):
            by_words = build(data)
            by_words.normalizer = None
        return cls(once("spm", data, build), by_words, once("spm-decoder", data, Decoder.of))

    @property
    def most(self) -> int:
        """Bytes of text to take at once."""
        return ENCODE_BYTES if self.by_words is None else WORDS_BYTES

    def __call__(self, texts: pa.Array) -> pa.ListArray:
        if self.by_words is None:
            return pa.array([e.ids for e in self.backend.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)], pa.list_(pa.int32()))
        spaced = pc.replace_substring(texts, MARKER, " ")  # both stand for the marker
        if self.decoder.strip:
            spaced = pc.binary_join_element_wise(pc.if_else(pc.equal(pc.binary_length(texts), 0), "", " "), spaced, "")
        ends, data = _laid_out(spaced)
        starts, space = np.zeros(ends[-1] + 1, bool), np.frombuffer(data, np.uint8) == ord(" ")
        starts[1:-1] = space[1:] & ~space[:-1]
        starts[ends] = True
        cuts = np.flatnonzero(starts)
        words = _cut(cuts, data).dictionary_encode()
        found = self.merged(words.dictionary).take(words.indices)
        upto = np.concatenate([[0], np.cumsum(pc.list_value_length(found).to_numpy(zero_copy_only=False))])
        return pa.ListArray.from_arrays(pa.array(upto[np.searchsorted(cuts, ends)], pa.int32()), found.flatten())

    def merged(self, words: pa.StringArray) -> pa.ListArray:
        """Ids of each word: many are merged as one string, and its ids are cut where the bytes of their pieces reach a word's end."""
        ends, data = _laid_out(words)
        last = np.append(np.diff(ends[1:] // SIDE_BY_SIDE) > 0, True)[: len(words)]
        ids = self._plain(_cut(np.concatenate([[0], ends[1:][last]]), data)).flatten()
        at, flat = np.cumsum(self.decoder.sizes[ids.to_numpy()]), ids.to_numpy()
        upto = np.searchsorted(at, ends[1:]) + 1
        if self.decoder.special[flat].any() or (len(at) and at[-1] != ends[-1]) or not np.array_equal(at[upto - 1], ends[1:]):
            return self._plain(words)  # pieces that don't say how much text they stand for
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], upto]), pa.int32()), ids)

    def _plain(self, texts: pa.StringArray) -> pa.ListArray:
        marked = pa.RecordBatch.from_arrays([pc.replace_substring(texts, " ", MARKER)], ["text"])
        found = (pa.array([e.ids for e in self.by_words.encode_batch_fast(b.column(0).to_pylist(), add_special_tokens=False)], pa.list_(pa.int32())) for b in chunks(marked, "text", ENCODE_BYTES))
        return pa.concat_arrays([pa.array([], pa.list_(pa.int32())), *found])


def _same_lists(a: pa.ListArray, b: pa.ListArray) -> np.ndarray:
    """In which rows both have the same values."""
    n, m = (pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in (a, b))
    same = n == m
    mask = pa.array(same)
    x, y = (i.filter(mask).flatten().to_numpy() for i in (a, b))
    off = np.concatenate([[0], np.cumsum(x != y)])
    same[same] = np.diff(off[np.concatenate([[0], np.cumsum(n[same])])]) == 0
    return same


def encode(docs: DataFrame, model_path: str, threads: int = 2, ids: str = "ids") -> DataFrame:
    """`docs` with a column of token ids of each whole text."""
    docs, data = docs.drop(ids), shared_file(docs.sparkSession, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_threads(threads)
        encoder = once("spm-encoder", data.value, Encoder.of)
        for whole in batches:
            for b in chunks(whole, "text", encoder.most):
                yield pa.RecordBatch.from_arrays([*b.columns, encoder(text_or_empty(b.column("text")))], [*b.schema.names, ids])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def _is_text(data: bytes) -> bool:
    try:
        return bool(data.decode()) or not data
    except UnicodeDecodeError:
        return False


def _parts(b: pa.RecordBatch, column: str, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of about `most` list values each (one row at least)."""
    part = np.cumsum(pc.fill_null(pc.list_value_length(b.column(column)), 0).to_numpy(zero_copy_only=False)) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
    for lo, hi in itertools.pairwise(cuts):
        if hi > lo:
            yield b.slice(lo, hi - lo)


def decode(encoded: DataFrame, model_path: str, threads: int = 2, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """`encoded` with the text that each row's ids stand for."""
    encoded, data = encoded.drop(text), shared_file(encoded.sparkSession, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_threads(threads)
        backend, decoder = once("spm", data.value, build), once("spm-decoder", data.value, Decoder.of)
        for whole in batches:
            for b in _parts(whole, ids):
                yield pa.RecordBatch.from_arrays([*b.columns, decoder(b.column(ids), backend)], [*b.schema.names, text])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(text, T.StringType())]))


def _library(data: bytes) -> Any:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=data)


def round_trip(docs: DataFrame, model_path: str, threads: int = 2, verify: bool = False) -> DataFrame:
    """`docs` with ids, n_tokens, decoded_sha256 and round_trip, which says if decoding gives the text again.

    Encodes and decodes in one pass, so that decoded texts never leave the task. With `verify`,
    same_ids and same_text say whether the sentencepiece library finds the same ids and reads them alike.
    """
    verdicts = ", same_ids boolean, same_text boolean" if verify else ""
    more = T.StructType.fromDDL(f"ids array<int>, n_tokens long, decoded_sha256 string, round_trip boolean{verdicts}")
    docs, data = docs.drop(*more.names), shared_file(docs.sparkSession, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_threads(threads)
        encoder = once("spm-encoder", data.value, Encoder.of)
        backend, decoder = encoder.backend, encoder.decoder
        for whole in batches:
            for large in chunks(whole, "text", encoder.most):
                large = pa.RecordBatch.from_arrays([*large.columns, encoder(text_or_empty(large.column("text")))], [*large.schema.names, "ids"])
                for b in chunks(large, "text", ENCODE_BYTES):
                    texts, ids = text_or_empty(b.column("text")), b.column("ids")
                    decoded = decoder(ids, backend)
                    digest = pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in decoded], pa.string())
                    new = [pc.list_value_length(ids).cast(pa.int64()), digest, pc.equal(decoded, texts)]
                    if verify:
                        library = once("spm-library", data.value, _library)
                        theirs = library.encode(texts.to_pylist(), num_threads=threads)
                        same_ids = _same_lists(ids, pa.array(theirs, pa.list_(pa.int32())))
                        for i in np.flatnonzero(~same_ids):
                            theirs[i] = ids[i].as_py()  # our ids are read, theirs are only held against them
                        same_text = pc.equal(decoded, pa.array(library.decode(theirs, num_threads=threads), pa.string()))
                        new += [pa.array(same_ids), same_text]
                    yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, *more.names[1:]])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *more.fields]))


def parity(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, same_ids and same_text: whether the backend agrees with the sentencepiece library."""
    data = shared_file(docs.sparkSession, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, other = once("spm-encoder", data.value, Encoder.of), once("spm-library", data.value, _library)
        for b in batches:
            texts = text_or_empty(b.column("text"))
            a, c = own(texts).to_pylist(), other.encode(texts.to_pylist(), num_threads=1)
            d, e = own.decoder(pa.array(c, pa.list_(pa.int32())), own.backend).to_pylist(), other.decode(c)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "same_ids": pa.array([x == y for x, y in zip(a, c)]), "same_text": pa.array([x == y for x, y in zip(d, e)])})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, same_ids boolean, same_text boolean")
