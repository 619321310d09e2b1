"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with character offsets, and the
sorted spans of its assistant texts are intersected with the sorted spans of its
tokens by binary search. Rows are dealt by conversation and sorted by turn within
the partition; a task holds one conversation at a time.

Rendering of a turn: ``<|im_start|>role NEWLINE text<|im_end|> NEWLINE``. Inside
roles and texts a "<" and a "|" that only backslashes part get one backslash
more, so no text holds a control string and the change can be undone; a role's
newlines and backslashes are written as escapes, so a role is one line.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slantscan.llm.common import text_batches

TOKENIZER = "byte_bpe_50k.json"
START, END = "<|im_start|>", "<|im_end|>\n"
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n").replace("\r", "\\r"))


def _unrole(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "r": "\r"}.get(m[1], m[1]), unescape(role))


def render(turns: list[tuple[str, str]], loss_role: str = LOSS_ROLE) -> tuple[str, np.ndarray]:
    """The formatted text and the spans (start, end) of the texts under the loss."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{_role(role)}\n", escape(text)
        parts += [head, body, END]
        if role == loss_role:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Undo ``render``."""
    turns = []
    for part in formatted.split(START)[1:]:
        role, _, rest = part.partition("\n")
        if not rest.endswith(END):
            raise ValueError("a turn doesn't end")
        turns.append((_unrole(role), unescape(rest.removesuffix(END))))
    return turns


def mask(tokens: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """tokens, spans: sorted (start, end). Which tokens lie in a span at least in
    part, and each span cut to what its tokens cover."""
    under = np.zeros(len(tokens), bool)
    covered = []
    for start, end in spans:
        first = np.searchsorted(tokens[:, 1], start, side="right")
        last = np.searchsorted(tokens[:, 0], end, side="left")
        under[first:last] = True
        pieces = np.clip(tokens[first:last], start, end)
        covered.append(pieces)
    return under, covered


@lru_cache(maxsize=2)
def tokenizer(name: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name) if "/" not in name else name)
    t.encode_special_tokens = True  # a control string in a text is ordinary text
    return t


def _covered_text(formatted: str, covered: list[np.ndarray]) -> list[str]:
    """Each span's text as its tokens cover it: tokens may share a character
    (parts of its bytes), none is taken twice."""
    out = []
    for pieces in covered:
        text, at = [], -1
        for s, e in pieces.tolist():
            s = max(s, at)
            if e > s:
                text.append(formatted[s:e])
                at = e
        out.append("".join(text))
    return out


def _conversation(name: str, turns: list[tuple[str, str]]) -> tuple:
    formatted, spans = render(turns)
    enc = tokenizer(name).encode(formatted, add_special_tokens=False)
    tokens = np.array(enc.offsets, np.int64).reshape(-1, 2)
    under, covered = mask(tokens, spans)
    back = parse(formatted)
    turns_sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in back).encode("utf-8", "surrogatepass")).hexdigest()
    loss = "".join(unescape(t) for t in _covered_text(formatted, covered))
    loss_sha = hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest()
    return (len(back), turns_sha, len(loss), loss_sha, len(formatted), len(tokens), int(under.sum()), formatted, enc.ids, under.tolist())


SCHEMA = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
    "n_tokens long, n_loss_tokens long, formatted string, ids array<int>, loss array<boolean>"
)
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.bool_())]


def _format(name: str):
    def run(batches):
        key, turns, done = None, [], []
        names = [c.split()[0] for c in SCHEMA.split(", ")]

        def flush():
            cols = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), _TYPES, strict=True)]
            return pa.RecordBatch.from_arrays(cols, names=names)

        for b in batches:
            for conv, role, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if turns and conv != key:
                    done.append((key, *_conversation(name, turns)))
                    turns = []
                key = conv
                turns.append((role, text))
                if len(done) >= 256:
                    yield flush()
                    done = []
        if turns:
            done.append((key, *_conversation(name, turns)))
        if done:
            yield flush()

    return run


def format_chats(turns: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, text): digests
    read back from the output, the formatted text, its ids and the loss mask.

    Rows go by turn (null last; ties by role, then text, both as bytes order).
    Null texts and roles are empty. Rows with a null conv_id form one
    conversation of that id. Repeated rows are turns of their own. An empty
    table gives no rows. Other columns are not looked at.
    """
    text_batches(turns.sparkSession)
    t = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.col("turn").alias("turn"),
    )
    t = t.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")
    return t.select("conv_id", "role", "text").mapInArrow(_format(tokenizer), SCHEMA)
