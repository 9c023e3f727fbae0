"""Chat formatting with offset-aligned loss masks.

Whole conversations are rendered, encoded once with offsets, and the token spans are intersected with the sorted text
spans of the assistant's turns by binary search. A turn is rendered as

    <turn>ROLE<says>TEXT</turn>

with role and text escaped: `\\` becomes `\\\\` and `<` becomes `\\l`, so no marker can occur inside them, and undoing
it gives the text back. The markers are added to the tokenizer as special tokens, so no other token spans a border.

Rows are sorted by conversation and turn and streamed: a task holds one segment of a conversation at a time (at most
MAX_SEGMENT_TURNS turns and about MAX_SEGMENT_CHARS characters), so a conversation of any length needs bounded memory.

Defined results: null text or role is empty; rows with equal turns follow by role, then text; null turns come first;
null conversation ids form one conversation; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import AddedToken, Tokenizer

from . import tokens  # noqa: F401  (threads of the tokenizer)

TURN, SAYS, END = "<turn>", "<says>", "</turn>"
MAX_SEGMENT_TURNS, MAX_SEGMENT_CHARS = 512, 1 << 20
_BACK = {"\\": "\\", "l": "<"}


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\l")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text)


def render(turns: list[tuple[str, str]], loss_role: str = "assistant") -> tuple[str, np.ndarray]:
    """The text of the turns, and start and end of each text that counts for the loss (ascending)."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{SAYS}", escape(text)
        if role == loss_role:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += head, body, END
        at += len(head) + len(body) + len(END)
    return "".join(parts), np.array(spans, dtype=np.int64).reshape(-1, 2)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered text."""
    out = []
    for part in formatted.split(TURN)[1:]:
        role, _, text = part.removesuffix(END).partition(SAYS)
        out.append((unescape(role), unescape(text)))
    return out


def loss_mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens lie inside a span; both are sorted, and each token is looked up by binary search."""
    if not len(spans) or not len(offsets):
        return np.zeros(len(offsets), dtype=bool)
    at = np.searchsorted(spans[:, 0], offsets[:, 0], "right") - 1
    inside = spans[np.maximum(at, 0)]
    return (at >= 0) & (offsets[:, 1] <= inside[:, 1]) & (offsets[:, 1] > offsets[:, 0])


_loaded: dict[str, Tokenizer] = {}


def marked_tokenizer(path: str) -> Tokenizer:
    if path not in _loaded:
        _loaded[path] = Tokenizer.from_file(path)
        _loaded[path].add_special_tokens([AddedToken(x, normalized=False, special=True) for x in (TURN, SAYS, END)])
    return _loaded[path]


FORMATTED = "segment int, n_turns int, formatted string, ids array<int>, token_start array<int>, token_end array<int>, loss array<boolean>"


def format_conversations(conversations: DataFrame, tokenizer: str, *, loss_role: str = "assistant", max_turns: int = MAX_SEGMENT_TURNS, max_chars: int = MAX_SEGMENT_CHARS) -> DataFrame:
    """Per segment, in order: conv_id, segment, n_turns, formatted, and for each token its id, span and loss flag."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), *T.StructType.fromDDL(FORMATTED).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = marked_tokenizer(tokenizer).encode
        out: list[tuple] = []
        chars = 0

        def emit(conv, segment: int, turns: list[tuple[str, str]]) -> None:
            nonlocal chars
            formatted, spans = render(turns, loss_role)
            e = encode(formatted, add_special_tokens=False)
            offsets = np.array(e.offsets, dtype=np.int64).reshape(-1, 2)
            out.append((conv, segment, len(turns), formatted, e.ids, offsets[:, 0], offsets[:, 1], loss_mask(offsets, spans)))
            chars += len(formatted)

        def ready() -> pa.RecordBatch:
            nonlocal out, chars
            types = [id_type, pa.int32(), pa.int32(), pa.string(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.bool_())]
            columns = [pa.array(list(c), t) for c, t in zip(zip(*out), types)]
            out, chars = [], 0
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        conv, segment, turns, size, begun = None, 0, [], 0, False
        for batch in batches:
            id_type = batch.column("conv_id").type
            for c, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text"))):
                if turns and (c != conv or len(turns) >= max_turns or size >= max_chars):
                    emit(conv, segment, turns)
                    segment, turns, size = segment + 1, [], 0
                    if chars >= max_chars:
                        yield ready()
                if c != conv or not begun:
                    conv, segment, begun = c, 0, True
                turns.append((role, text))
                size += len(text)
        if turns:
            emit(conv, segment, turns)
        if out:
            yield ready()

    return rows.mapInArrow(run, schema)


def conversation_digests(formatted: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Read back from the rendered text and the mask: one row per conversation. Takes segments in the order they came in."""
    schema = T.StructType([formatted.schema["conv_id"], *T.StructType.fromDDL("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None

        def done() -> pa.RecordBatch:
            n, turns, chars, loss, length, tokens, masked = state
            values = [conv, n, turns.hexdigest(), chars, loss.hexdigest(), length, tokens, masked]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()])], names=schema.names)

        for batch in batches:
            id_type = batch.column("conv_id").type
            for i in range(batch.num_rows):
                c, segment, text = (batch.column(x)[i].as_py() for x in ("conv_id", "segment", "formatted"))
                if segment == 0:
                    if state:
                        yield done()
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                for role, said in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                start, end = (np.asarray(batch.column(x)[i].values) for x in ("token_start", "token_end"))
                mask = np.asarray(batch.column("loss")[i].values.to_numpy(zero_copy_only=False))
                # runs of masked tokens are the texts
                edges = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
                for a, b in zip(edges[0::2], edges[1::2]):
                    said = unescape(text[start[a] : end[b - 1]])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
                state[5] += len(mask)
                state[6] += int(mask.sum())
        if state:
            yield done()

    return formatted.mapInArrow(run, schema)
