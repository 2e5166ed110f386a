"""Personal data by weak supervision (operator 10).

Fixed patterns find the base spans. Wider patterns propose further candidates, and every
candidate gets the votes of labelers: patterns, gazetteers and context words, each for,
against or silent. Expectation-maximisation over the counts of vote patterns estimates how
reliable each labeler is and how likely each pattern is personal data; these likelihoods
train a logistic classifier on features of the spans, which decides on the candidates
outside the base. Vote and feature patterns are counted by Spark; what reaches the driver
are their counts, bounded by 3**labelers * 2**features rows whatever the input.

Defined results: a null text is empty; base spans always stay; candidates that touch base
spans are left out; equal rows give equal results; a span whose likelihood lies just on the threshold is
taken; texts and runs of any length are worked on whole; without candidates nothing is added; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm.common import chunks, materialize, small_batches, text_or_empty

KINDS = ("email", "ip", "card", "phone")
MORE = ("contact", "number")

EMAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match can only begin where its first run of digits does, which keeps long runs linear
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: RE2 patterns that every text with a match of the kind has.
HINTS = {
    "email": r"@[A-Za-z0-9-]+\.[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]",
    "card": r"[0-9](?:[ -]?[0-9]){11}",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "contact": r"(?i)[a-z0-9] ?[\[(] ?at ?[\])] ?[a-z0-9]",
    "number": r"[0-9](?:[ ().-]{0,2}[0-9]){8}",
}
# whole runs, which only begin where nothing of them stands before, so that long ones stay linear
CONTACT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[A-Za-z0-9-]++)++", re.IGNORECASE | re.ASCII)
NUMBER = re.compile(r"\(?(?<![0-9])[0-9](?:[\x20().-]{0,2}[0-9])++")

#: Words near a span that speak for or against personal data.
CONTEXT_FOR = frozenset("call phone tel telephone mobile cell fax contact email mail e-mail address reach whatsapp ssn social card credit visa iban account passport dob born".split())
CONTEXT_AGAINST = frozenset("version order invoice isbn doi page figure table total sum price eur usd id number no nr ref sku build".split())
#: Last labels of domain names, and first names.
ENDINGS = frozenset("com org net edu gov de fr es uk it nl eu io co info".split())
NAMES = frozenset("anna james john mary robert patricia michael linda david maria jose juan carlos ana luis hans peter klaus sabine jean pierre marie claire sophie paul laura".split())
NEAR = 40
WORD = re.compile(r"[A-Za-z-]+")

#: Rows that the candidates count as, together, against the ridge on the classifier's weights: the same at every size.
STRENGTH = 10_000

LABELERS = ("shape", "checksum", "ending", "name", "context_for", "context_against")
FEATURES = ("has_plus", "has_at", "separators", "digits_9_11", "digits_12_19", "luhn", "grouped", "near_word", "known_ending", "near_name", "near_against")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> list[Span]:
    """Leftmost matches of the email pattern: the run before each @ that a domain follows."""
    out, end = [], 0
    for m in EMAIL_DOMAIN.finditer(text):
        a = at = m.start()
        while a > end and text[a - 1] in LOCAL:
            a -= 1
        if a < at and at >= end:
            out.append((a, m.end(), "email"))
            end = m.end()
    return out


def base_spans(text: str, kinds: set[str] = frozenset(KINDS)) -> list[Span]:
    """start, end, kind of the base matches, by start and then as kinds are listed."""
    found: list[Span] = []
    if "email" in kinds:
        found += _emails(text)
    if "ip" in kinds:
        found += [(*m.span(), "ip") for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    if "card" in kinds:
        for m in CARD.finditer(text):
            d = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(d) <= 19 and luhn(d):
                found.append((*m.span(), "card"))
    if "phone" in kinds:
        found += [(*m.span(), "phone") for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def more_spans(text: str, kinds: set[str]) -> list[Span]:
    """Candidates outside the base patterns, by start."""
    found: list[Span] = []
    if "contact" in kinds:
        found += [(*m.span(), "contact") for m in CONTACT.finditer(text)]
    if "number" in kinds:
        found += [(*m.span(), "number") for m in NUMBER.finditer(text) if 9 <= len(_digits(m[0])) <= 19]
    return sorted(found)


def votes_and_features(text: str, span: Span) -> tuple[int, int]:
    """The labelers' votes (base 3: 0 silent, 1 against, 2 for) and the features (bits) of a span."""
    a, b, kind = span
    s, before, after = text[a:b], text[max(0, a - NEAR) : a], text[b : b + NEAR]
    digits, near = _digits(s), [w.lower() for w in WORD.findall(f"{before} | {after}")]
    grouped = bool(re.fullmatch(r"\+?[0-9]{0,3} ?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}|(?:[0-9]{4}[ -]){3}[0-9]{4}", s))
    mail = kind in ("email", "contact")
    checked = len(digits) >= 12 and luhn(digits)
    shape = 2 if mail or kind in ("ip", "phone") or grouped else 1 if kind == "number" else 0
    checksum = 0 if mail or not 12 <= len(digits) <= 19 else 2 if checked else 1
    last = re.split(r"[^A-Za-z]+", s)[-1].lower() if mail else ""
    ending = 0 if not mail else 2 if last in ENDINGS else 1
    name = 2 if any(w in NAMES for w in near) else 0
    context_for = 2 if any(w in CONTEXT_FOR for w in near) else 0
    context_against = 1 if any(w in CONTEXT_AGAINST for w in near) else 0
    vote = 0
    for v in (shape, checksum, ending, name, context_for, context_against):
        vote = 3 * vote + v
    feature = 0
    for f in (s.startswith("+"), mail, any(c in " ().-" for c in s), 9 <= len(digits) <= 11, 12 <= len(digits) <= 19, checked, grouped, context_for == 2, ending == 2, name == 2, context_against == 1):
        feature = 2 * feature + f
    return vote, feature


def _free(spans: list[Span], taken: list[Span]) -> list[Span]:
    """Those of `spans` that touch neither `taken` nor an earlier one of their own."""
    out, i, reach = [], 0, 0
    for s in spans:
        while i < len(taken) and taken[i][0] < s[1]:
            reach = max(reach, taken[i][1])
            i += 1
        if reach <= s[0]:
            out.append(s)
            reach = s[1]
    return out


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and spans (kind, start, stop, base, vote, feature) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, "text"):
                texts = text_or_empty(b.column("text"))
                hints = {k: pc.match_substring_regex(texts, p).to_numpy(zero_copy_only=False) for k, p in HINTS.items()}
                n = {k: np.zeros(b.num_rows, np.int64) for k in KINDS}
                spans: list[list[dict]] = [[] for _ in range(b.num_rows)]
                for i in np.flatnonzero(np.any(list(hints.values()), axis=0)):
                    text, have = texts[int(i)].as_py(), {k for k in HINTS if hints[k][i]}
                    base = base_spans(text, have)
                    for s in base:
                        n[s[2]][i] += 1
                    for own, part in ((True, base), (False, _free(more_spans(text, have), base))):
                        for s in part:
                            vote, feature = votes_and_features(text, s)
                            spans[i].append({"kind": s[2], "start": s[0], "stop": s[1], "base": own, "vote": vote, "feature": feature})
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), **{f"n_{k}": pa.array(v) for k, v in n.items()}, "spans": pa.array(spans, SPANS)})

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, spans array<struct<kind:string,start:long,stop:long,base:boolean,vote:int,feature:int>>")


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("base", pa.bool_()), ("vote", pa.int32()), ("feature", pa.int32())]))


@dataclass
class Model:
    reliability: dict[str, float]
    weights: np.ndarray

    def probability(self, feature: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_design(feature) @ self.weights, -60, 60)))


def _design(feature: np.ndarray) -> np.ndarray:
    bits = (np.asarray(feature)[:, None] >> np.arange(len(FEATURES))) & 1
    return np.hstack([np.ones((len(bits), 1)), bits]).astype(float)


def fit(counts: list[tuple[int, int, int]], rounds: int = 100) -> Model:
    """A model from (vote, feature, n): labelers' reliabilities by expectation-maximisation, then the classifier.

    Each labeler that votes is right with its own chance, which starts at 0.8 and is kept
    within 0.55 and 0.99, so that labelers stay on the side that they were written for.
    """
    m = len(LABELERS)
    if not counts:
        return Model(dict.fromkeys(LABELERS, 0.8), np.array([-20.0] + [0.0] * len(FEATURES)))
    vote, feature, n = (np.array(x) for x in zip(*sorted(counts)))
    cast = (vote[:, None] // 3 ** np.arange(m)[::-1]) % 3
    yes, no = cast == 2, cast == 1
    right, prior = np.full(m, 0.8), 0.5
    for _ in range(rounds):
        lr = np.log(right / (1 - right))
        true = 1 / (1 + np.exp(-(np.log(prior / (1 - prior)) + yes @ lr - no @ lr)))
        agrees = (n[:, None] * (yes * true[:, None] + no * (1 - true[:, None]))).sum(0)
        right = np.clip((agrees + 8) / ((n[:, None] * (yes | no)).sum(0) + 10), 0.55, 0.99)
        prior = float(np.clip((n * true).sum() / n.sum(), 0.01, 0.99))
    x, w = _design(feature), np.zeros(1 + len(FEATURES))
    weight = n / n.sum() * STRENGTH
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (weight * (true - p)) - w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return Model(dict(zip(LABELERS, right)), w)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def find(docs: DataFrame, least: float = 0.9) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of each row of `docs`."""
    with small_batches(docs.sparkSession):
        found = materialize(candidates(docs), "pii-candidates")
    patterns = found.select(F.explode("spans").alias("s")).groupBy("s.vote", "s.feature").agg(F.count("*").alias("n"))
    model = fit([tuple(r) for r in patterns.collect()])
    sure = model.probability(np.arange(1 << len(FEATURES))) >= least
    order = (*KINDS, *MORE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digest, spans = [], []
            for row in b.column("spans").to_pylist():
                all_of = [(s["start"], s["stop"], s["kind"]) for s in row if s["base"] or sure[s["feature"]]]
                all_of.sort(key=lambda s: (s[0], order.index(s[2])))
                digest.append(hashlib.sha256(joined([s for s in all_of if s[2] in KINDS]).encode()).hexdigest())
                spans.append(joined(all_of))
            yield pa.RecordBatch.from_pydict({**{c: b.column(c) for c in b.schema.names if c != "spans"}, "base_sha256": pa.array(digest, pa.string()), "spans": pa.array(spans, pa.string())})

    kind = dict(docs.dtypes)["doc_id"]
    return found.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
