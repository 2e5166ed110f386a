"""Secret scans by character Markov models (operator 6).

Fixed patterns find the base spans. Beside them, all tokens of 12 characters or more are judged
by two first-order character Markov models, of random strings and of ordinary identifiers: a
token whose log-likelihood ratio is high enough is a span of kind `random`. The models are trained from
labelled samples: base matches of a bounded sample of documents and seeded random strings
against the other tokens of those documents.

Defined results: a null text is empty; spans of the models that touch base spans are left
out; a token whose ratio lies just on a threshold is taken; texts and tokens of any length are
scanned whole; equal rows give equal results; an empty table gives an empty result (the models are
then trained from random strings alone); further columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm.common import chunks, text_or_empty

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{4,}")
LEAST_TOKEN = 12
LONG = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_TOKEN},}}")
#: RE2 patterns that every text with a match of the kind has.
HINTS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]""",
    "access": r"AKIA[A-Z0-9]{14}",
    "hex": r"[0-9a-f]{16}",
    "random": rf"[A-Za-z0-9+/_=-]{{{LEAST_TOKEN}}}",
}
SYMBOLS = string.ascii_letters + string.digits + "+/_=-"
EDGE = len(SYMBOLS)
_CODE = np.full(128, EDGE, np.int64)
_CODE[[ord(c) for c in SYMBOLS]] = np.arange(len(SYMBOLS))

Span = tuple[int, int, str]


def base_spans(text: str, kinds: set[str] = frozenset(KINDS)) -> list[Span]:
    """start, end, kind of the base matches, by start and then as kinds are listed."""
    found: list[Span] = []
    if "assign" in kinds:
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "access" in kinds:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if "hex" in kinds:
        found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def _free(spans: list[Span], taken: list[Span]) -> list[Span]:
    """Those of `spans` that touch none of `taken`; both ascending by start."""
    out, i, reach, n = [], 0, 0, len(taken)
    for s in spans:
        while i < n and taken[i][0] < s[1]:
            reach = max(reach, taken[i][1])
            i += 1
        if reach <= s[0]:
            out.append(s)
    return out


def _steps(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all steps (previous, next) within the tokens, edges included, and their token numbers."""
    joined_up = "\n".join(["", *tokens, ""])
    c = _CODE[np.frombuffer(joined_up.encode("ascii"), np.uint8)]
    token = np.cumsum(c == EDGE) - 1
    return c[:-1] * (EDGE + 1) + c[1:], token[:-1]


def random_strings(n: int = 3000, seed: int = 6) -> list[str]:
    """Labelled samples of random strings over the usual alphabets."""
    r = random.Random(seed)
    alphabets = (string.digits + "abcdef", string.ascii_uppercase + string.digits, string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "_-")
    return ["".join(r.choices(alphabets[i % len(alphabets)], k=r.randint(LEAST_TOKEN, 48))) for i in range(n)]


def train(docs: DataFrame, sample_docs: int = 5000, smoothing: float = 0.5, backoff: float = 5.0) -> np.ndarray:
    """Log-likelihood ratio (random over ordinary) of each step, from about `sample_docs` documents chosen by a hash."""
    total = max(1, docs.count())
    share = min(1.0, sample_docs / total)
    sample = docs.where(F.pmod(F.xxhash64(F.lit("secrets"), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, (EDGE + 1) ** 2), np.int64)
        for whole in batches:
            for b in chunks(whole, "text"):
                for text in text_or_empty(b.column("text")).to_pylist():
                    base = base_spans(text)
                    tokens = [(m.start(), m.end(), m[0]) for m in TOKEN.finditer(text)]
                    ordinary = _free(tokens, base)
                    inside = set(tokens) - set(ordinary)
                    for i, group in enumerate(([t for _, _, t in ordinary], [t for _, _, t in inside if len(t) >= 12])):
                        if group:
                            n[i] += np.bincount(_steps(group)[0], minlength=n.shape[1])
        cell = np.flatnonzero(n.ravel())
        yield pa.RecordBatch.from_pydict({"cell": pa.array(cell), "n": pa.array(n.ravel()[cell])})

    cells = sample.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(2 * (EDGE + 1) ** 2)
    n[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    n = n.reshape(2, EDGE + 1, EDGE + 1)
    n[1] += np.bincount(_steps(random_strings())[0], minlength=(EDGE + 1) ** 2).reshape(EDGE + 1, EDGE + 1)
    # steps from rare characters fall back on how often the next character occurs at all
    one = n.sum(1, keepdims=True) + smoothing
    one /= one.sum(2, keepdims=True)
    p = np.log((n + backoff * one) / (n.sum(2, keepdims=True) + backoff))
    return (p[1] - p[0]).ravel()


def scores(tokens: list[str], ratio: np.ndarray) -> np.ndarray:
    """The log-likelihood ratio of each token, in nats."""
    if not tokens:
        return np.zeros(0)
    step, token = _steps(tokens)
    return np.bincount(token, weights=ratio[step], minlength=len(tokens) + 1)[: len(tokens)]


def scan(docs: DataFrame, ratio: np.ndarray, least: float = 12.0, least_a_char: float = 0.4) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256 and spans of each row of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, "text"):
                texts = text_or_empty(b.column("text"))
                hints = {k: pc.match_substring_regex(texts, p).to_numpy(zero_copy_only=False) for k, p in HINTS.items()}
                n = {k: np.zeros(b.num_rows, np.int64) for k in (*KINDS, "random")}
                digest, spans = [hashlib.sha256(b"").hexdigest()] * b.num_rows, [""] * b.num_rows
                for i in np.flatnonzero(np.any(list(hints.values()), axis=0)):
                    text = texts[int(i)].as_py()
                    base = base_spans(text, {k for k in KINDS if hints[k][i]})
                    more: list[Span] = []
                    if hints["random"][i]:
                        more = _free([(*m.span(), "random") for m in LONG.finditer(text)], base)
                        value = scores([text[x:y] for x, y, _ in more], shared.value)
                        more = [s for s, v in zip(more, value) if v >= max(least, least_a_char * (s[1] - s[0]))]
                    for s in (*base, *more):
                        n[s[2]][i] += 1
                    digest[i] = hashlib.sha256(joined(base).encode()).hexdigest()
                    spans[i] = joined(sorted([*base, *more], key=lambda s: (s[0], (*KINDS, "random").index(s[2]))))
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), **{f"n_{k}": pa.array(v) for k, v in n.items()}, "base_sha256": pa.array(digest, pa.string()), "spans": pa.array(spans, pa.string())})

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")
