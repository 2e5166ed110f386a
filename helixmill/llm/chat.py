"""Chat formatting by token-level assembly (operator 4).

Each turn is encoded by itself, with control strings in its text escaped; reserved ids,
which no text can produce, are spliced around it. Where turns lie in their conversation,
and which tokens bear loss (the texts of assistant turns), follows from prefix sums of
segment lengths. `read_back` recovers turns and loss text from ids and mask alone.

Template, with one reserved id for each control string:
user `[INST]`text`[/INST]`, system `<<SYS>>`text`<</SYS>>`, assistant `<s>`text`</s>`,
others `<|role|>`role`<|text|>`text`<|end|>`. In texts and roles, a control string and the
backslashes before it get one more backslash in front.

Defined results: null text and null role are empty strings; turns follow by turn (null
first), and repeated turns by their tokens, all kept; a null conv_id is a conversation of
its own; a text of any length is encoded whole, a turn in one task; an empty table gives an empty result; further columns are ignored. Turns are
encoded row by row wherever they are; only finished ids meet in their conversation's row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from helixmill.llm.common import chunks, text_or_empty
from helixmill.llm.tokens import ENCODE_BYTES, once, shared_file, use_threads

CONTROL = ("[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>", "<|role|>", "<|text|>", "<|end|>")
TEMPLATE = {"user": ("[INST]", "[/INST]"), "system": ("<<SYS>>", "<</SYS>>"), "assistant": ("<s>", "</s>")}
LOSS_ROLE = "assistant"
_ANY = "|".join(map(re.escape, CONTROL))
_ESCAPE, _UNESCAPE = re.compile(rf"(\\*(?:{_ANY}))"), re.compile(rf"\\(\\*(?:{_ANY}))")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def _tokenizer(data: bytes) -> Tokenizer:
    t = Tokenizer.from_str(data.decode())
    t.encode_special_tokens = True
    t.no_padding()
    t.no_truncation()
    return t


def _reserved(t: Tokenizer) -> dict[str, int]:
    first = t.get_vocab_size(with_added_tokens=True)
    return {c: first + i for i, c in enumerate(CONTROL)}


def encode_turns(turns: DataFrame, tokenizer_path: str, threads: int = 2) -> DataFrame:
    """conv_id, turn, ids, and the place (lo, hi) within ids of the text that bears loss, of each row."""
    data = shared_file(turns.sparkSession, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_threads(threads)
        t = once("chat", data.value, _tokenizer)
        reserved = _reserved(t)
        for whole in batches:
            for b in chunks(whole, "text", ENCODE_BYTES):
                roles, texts = (text_or_empty(b.column(c)).to_pylist() for c in ("role", "text"))
                segments = t.encode_batch_fast([escape(x) for x in (*roles, *texts)], add_special_tokens=False)
                ids, lo, hi = [], [], []
                for i, role in enumerate(roles):
                    text = segments[len(roles) + i].ids
                    if role in TEMPLATE:
                        before, after = TEMPLATE[role]
                        head = [reserved[before]]
                    else:
                        head, after = [reserved["<|role|>"], *segments[i].ids, reserved["<|text|>"]], "<|end|>"
                    ids.append([*head, *text, reserved[after]])
                    lo.append(len(head))
                    hi.append(len(head) + (len(text) if role == LOSS_ROLE else 0))
                yield pa.RecordBatch.from_pydict({"conv_id": b.column("conv_id"), "turn": b.column("turn"), "ids": pa.array(ids, pa.list_(pa.int32())), "lo": pa.array(lo, pa.int64()), "hi": pa.array(hi, pa.int64())})

    kind = dict(turns.dtypes)
    return turns.select("conv_id", "turn", "role", "text").mapInArrow(run, f"conv_id {kind['conv_id']}, turn {kind['turn']}, ids array<int>, lo long, hi long")


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Loss masks: running sums of +1 where loss begins and -1 where it ends."""
    for b in batches:
        masks = []
        for size, spans in zip(pc.list_value_length(b.column("ids")).to_pylist(), b.column("loss")):
            edge = np.zeros(size + 1, np.int8)
            v = spans.values
            np.add.at(edge, v.field("lo").to_numpy(), 1)
            np.add.at(edge, v.field("hi").to_numpy(), -1)
            masks.append(pa.array(np.cumsum(edge[:-1], dtype=np.int8)))
        yield pa.RecordBatch.from_pydict({"conv_id": b.column("conv_id"), "ids": b.column("ids"), "loss_mask": pa.array(masks, pa.list_(pa.int8()))})


def format_chats(turns: DataFrame, tokenizer_path: str, threads: int = 2) -> DataFrame:
    """conv_id, ids and loss_mask of each conversation."""
    encoded = encode_turns(turns, tokenizer_path, threads)
    order = Window.partitionBy("conv_id").orderBy("turn", "ids").rowsBetween(Window.unboundedPreceding, -1)
    placed = encoded.withColumn("at", F.coalesce(F.sum(F.size("ids")).over(order), F.lit(0)))
    part = F.struct("at", "ids", (F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi")).alias("hi"))
    chats = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    chats = chats.select("conv_id", F.flatten("parts.ids").alias("ids"), F.transform("parts", lambda p: F.struct(p["lo"].alias("lo"), p["hi"].alias("hi"))).alias("loss"))
    return chats.mapInArrow(_masks, f"conv_id {dict(turns.dtypes)['conv_id']}, ids array<int>, loss_mask array<tinyint>")


def _turns(ids: np.ndarray, reserved: dict[str, int]) -> Iterator[tuple[str | None, slice | None, slice]]:
    """Role, or the place of the role's tokens, and the place of the text's tokens, of each turn."""
    role_of = {reserved[a]: r for r, (a, _) in TEMPLATE.items()}
    marks = np.flatnonzero(ids >= min(reserved.values()))
    i = 0
    while i < len(marks):
        role = role_of.get(int(ids[marks[i]]))
        if role is None:
            yield None, slice(marks[i] + 1, marks[i + 1]), slice(marks[i + 1] + 1, marks[i + 2])
            i += 3
        else:
            yield role, None, slice(marks[i] + 1, marks[i + 1])
            i += 2


def read_back(chats: DataFrame, tokenizer_path: str, threads: int = 2) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars and n_tokens, from ids and masks alone."""
    data = shared_file(chats.sparkSession, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_threads(threads)
        t = once("chat", data.value, _tokenizer)
        reserved = _reserved(t)
        text_of = {v: k for k, v in reserved.items()}
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens")}
            for i in range(b.num_rows):
                ids, mask = b.column("ids")[i].values.to_numpy(), b.column("loss_mask")[i].values.to_numpy()
                turns = list(_turns(ids, reserved))
                texts = t.decode_batch([ids[x].tolist() for _, _, x in turns], skip_special_tokens=False)
                roles = iter(t.decode_batch([ids[r].tolist() for _, r, _ in turns if r is not None], skip_special_tokens=False))
                digest, chars = hashlib.sha256(), sum(len(text_of[int(x)]) for x in ids[ids >= min(text_of)])
                for (role, _, _), text in zip(turns, texts):
                    chars += len(text)
                    if role is None:
                        role = next(roles)
                        chars += len(role)
                        role = unescape(role)
                    digest.update(f"{role}\n{unescape(text)}\n".encode())
                change = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]])))
                loss = "".join(map(unescape, t.decode_batch([ids[x:y].tolist() for x, y in change.reshape(-1, 2)], skip_special_tokens=False)))
                row = (len(turns), digest.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars, len(ids))
                for k, v in zip(out, row):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict({"conv_id": b.column("conv_id"), **{k: pa.array(v, pa.string() if "sha" in k else pa.int64()) for k, v in out.items()}})

    return chats.mapInArrow(run, f"conv_id {dict(chats.dtypes)['conv_id']}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long")
