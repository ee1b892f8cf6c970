"""Operator 1: conversations as training text, with a mask of what the model learns from."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from lograft.llm.common import buffers

# The template. A turn is head + text + tail; these strings mark it.
HEADS = {"system": "<s><<SYS>>", "user": "<s>[INST]", "assistant": "<s>"}
TAILS = {"system": "<</SYS>></s>", "user": "[/INST]</s>", "assistant": "</s>"}
OTHER_HEAD, ROLE_END, OTHER_TAIL = "<s>[ROLE]", "[/ROLE]", "</s>"
# What stands after the first character of a control string.
CONTROL_RESTS = r"s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|ROLE\]|/ROLE\]"

ESCAPE = rf"([<\[])(\\*)({CONTROL_RESTS})"
UNESCAPE = re.compile(rf"([<\[])\\(\\*)({CONTROL_RESTS})")
PIECE_BYTES = 16 << 20
LARGE_TEXT = 1 << 20


def escape(texts: pa.Array) -> pa.Array:
    r"""One more backslash after the first character of every control string: ``</s>`` → ``<\/s>``."""
    return pc.replace_substring_regex(texts, ESCAPE, r"\1\2\\\3")


def unescape(text: str) -> str:
    """The inverse of :func:`escape`: one backslash less."""
    return UNESCAPE.sub(r"\1\2\3", text)


def _place(out: np.ndarray, at: np.ndarray, body: np.ndarray, offsets: np.ndarray) -> None:
    """Copy segment i of ``body`` to ``out[at[i]:]``, short ones by scatter indices, long ones whole."""
    sizes = np.diff(offsets)
    long = np.flatnonzero(sizes > LARGE_TEXT)
    for i in long:
        out[at[i] : at[i] + sizes[i]] = body[offsets[i] : offsets[i + 1]]
    short = np.flatnonzero((sizes <= LARGE_TEXT) & (sizes > 0))
    for part in np.array_split(short, max(1, int(sizes[short].sum()) // (4 << 20))):
        n = sizes[part]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(at[part], n) + within] = body[np.repeat(offsets[part], n) + within]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of turns as one buffer: bytes, offset of each turn, start and size of each text in it."""
    roles, texts = pc.fill_null(roles, ""), escape(pc.fill_null(texts, ""))
    coded = roles.dictionary_encode()
    heads, tails = [], []
    for role in coded.dictionary.to_pylist():
        other = OTHER_HEAD + escape(pa.array([role]))[0].as_py() + ROLE_END
        heads.append(HEADS.get(role, other).encode())
        tails.append(TAILS.get(role, OTHER_TAIL).encode())
    index = coded.indices.to_numpy(zero_copy_only=False)
    head_size, tail_size = (np.array([len(x) for x in xs], np.int64)[index] for xs in (heads, tails))
    body, offsets = buffers(texts)
    sizes = np.diff(offsets)
    starts = np.concatenate([[0], np.cumsum(head_size + sizes + tail_size)])
    out = np.empty(int(starts[-1]), np.uint8)
    text_at = starts[:-1] + head_size
    _place(out, text_at, body, offsets)
    for pieces, at in ((heads, starts[:-1]), (tails, text_at + sizes)):
        for k, piece in enumerate(pieces):
            rows = at[index == k]
            out[rows[:, None] + np.arange(len(piece))] = np.frombuffer(piece, np.uint8)
    return out, starts, text_at, sizes


PIECES = "n_turns long, piece int, formatted string, loss_spans array<struct<start:int,length:int>>"


def format_conversations(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", piece_bytes: int = PIECE_BYTES
) -> DataFrame:
    """One row per conversation (or per piece of a huge one): its text and the spans to learn from.

    Takes the conversation, turn, ``role`` and ``text`` columns; others are left
    out. Turns stand in the order of (turn, role, text), NULLs first; repeated rows stay
    repeated turns. A NULL text or role is empty; a NULL conversation id is a
    conversation of its own. Roles without a mark of their own are spelt out.
    Control strings inside texts are escaped reversibly (:func:`unescape`).
    ``loss_spans`` are byte ranges in ``formatted``: the texts of the assistant.

    Each task gets whole conversations, sorted, and streams through them. One of
    more than ``piece_bytes`` comes as several rows with rising ``piece``, in order, cut
    between turns; so memory is bounded by that and the longest single text.
    """
    spark = turns.sparkSession
    schema = StructType([turns.select(turns[conv].alias("conv_id")).schema[0]])
    for field in spark.createDataFrame([], PIECES).schema:
        schema = schema.add(field)
    ordered = (
        turns.select(turns[conv].alias("conv_id"), turns[turn].alias("turn"), turns["role"], turns["text"])
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )
    conv_type = {}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, np.ndarray, int]] = []  # bytes, spans, turns of the open conversation
        current, piece, held_bytes = None, 0, 0

        def emit() -> pa.RecordBatch:
            nonlocal held, held_bytes, piece
            shift, spans = 0, []
            for data, own, _ in held:
                spans += [{"start": int(s) + shift, "length": int(n)} for s, n in own]
                shift += len(data)
            row = {
                "conv_id": current,
                "n_turns": sum(n for *_, n in held),
                "piece": piece,
                "formatted": b"".join(data for data, *_ in held).decode(),
                "loss_spans": spans,
            }
            held, held_bytes, piece = [], 0, piece + 1
            return pa.RecordBatch.from_pylist([row], schema=conv_type["schema"])

        for batch in batches:
            if not conv_type:
                span = pa.struct([pa.field("start", pa.int32()), pa.field("length", pa.int32())])
                conv_type["schema"] = pa.schema(
                    [
                        ("conv_id", batch.schema.field("conv_id").type),
                        ("n_turns", pa.int64()),
                        ("piece", pa.int32()),
                        ("formatted", pa.string()),
                        ("loss_spans", pa.list_(span)),
                    ]
                )
            ids = batch.column("conv_id").to_pylist()
            learn = pc.fill_null(pc.equal(batch.column("role"), "assistant"), False).to_numpy(zero_copy_only=False)
            out, starts, text_at, sizes = assemble(batch.column("role"), batch.column("text"))
            first = 0
            while first < len(ids):
                end = first
                while end < len(ids) and ids[end] == ids[first] and starts[end] - starts[first] < piece_bytes:
                    end += 1
                if held and ids[first] != current or held_bytes >= piece_bytes:
                    yield emit()
                if ids[first] != current:
                    piece = 0
                current = ids[first]
                rows = first + np.flatnonzero(learn[first:end])
                own = np.stack([text_at[rows] - starts[first], sizes[rows]], axis=1)
                held.append((out[starts[first] : starts[end]].tobytes(), own, end - first))
                held_bytes += int(starts[end] - starts[first])
                first = end
        if held:
            yield emit()

    return ordered.mapInArrow(run, schema)


TURN = re.compile(
    r"<s>(?:(?P<system><<SYS>>)|(?P<user>\[INST\])|\[ROLE\](?P<role>.*?)\[/ROLE\])?"
    r"(?P<text>.*?)(?P<end><</SYS>></s>|\[/INST\]</s>|</s>)",
    re.DOTALL,
)


def parse_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn, read back from the formatted text."""
    for m in TURN.finditer(formatted):
        role = "system" if m["system"] else "user" if m["user"] else "assistant" if m["role"] is None else m["role"]
        yield unescape(role), unescape(m["text"])


DIGESTS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests per conversation, from the formatted text and its spans alone.

    Expects the rows as :func:`format_conversations` leaves them: all pieces of a
    conversation in one partition, in order. Nothing is shuffled.
    """
    schema = StructType([formatted.schema["conv_id"]])
    for field in formatted.sparkSession.createDataFrame([], DIGESTS).schema:
        schema = schema.add(field)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[dict] = []
        state = None
        for batch in batches:
            target = pa.schema(
                [
                    ("conv_id", batch.schema.field("conv_id").type),
                    ("n_turns", pa.int64()),
                    ("turns_sha256", pa.string()),
                    ("loss_chars", pa.int64()),
                    ("loss_sha256", pa.string()),
                    ("formatted_chars", pa.int64()),
                ]
            )
            for row in batch.to_pylist():
                if row["piece"] == 0:
                    if state:
                        done.append(_finished(state))
                    state = {"conv_id": row["conv_id"], "n_turns": 0, "loss_chars": 0, "formatted_chars": 0}
                    state |= {"turns": hashlib.sha256(), "loss": hashlib.sha256()}
                for role, text in parse_turns(row["formatted"]):
                    state["n_turns"] += 1
                    state["turns"].update(f"{role}\n{text}\n".encode())
                data = row["formatted"].encode()
                for span in row["loss_spans"]:
                    learnt = unescape(data[span["start"] : span["start"] + span["length"]].decode())
                    state["loss_chars"] += len(learnt)
                    state["loss"].update(learnt.encode())
                state["formatted_chars"] += len(row["formatted"])
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=target)
                done = []
        if state:
            yield pa.RecordBatch.from_pylist([_finished(state)], schema=target)

    return formatted.mapInArrow(run, schema)


def _finished(state: dict) -> dict:
    state["turns_sha256"] = state.pop("turns").hexdigest()
    state["loss_sha256"] = state.pop("loss").hexdigest()
    return state


def planted_conversation(turns: DataFrame) -> DataFrame:
    """Conversation -1: a user and an assistant who both say the control strings."""
    said = "</s>[INST] ok [/INST]"
    rows = [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    return turns.sparkSession.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def all_turns(turns: DataFrame) -> DataFrame:
    columns = ("conv_id", "turn", "role", "text")
    return turns.select(*columns).unionByName(planted_conversation(turns).select(*(F.col(c) for c in columns)))
