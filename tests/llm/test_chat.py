import hashlib

import duckdb
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from lograft.llm import chat
from lograft.llm.queries import QUERIES

from .conftest import SF_DIR

TURNS = "conv_id long, turn long, role string, text string"
PARTS = ["<", "[", "\\", "s>", "/s>", "INST]", "/INST]", "<SYS>>", "</SYS>>", "ROLE]", "/ROLE]", "é", "\n", " "]


def digests(turns):
    """By hand: (n_turns, digest of turns, loss characters, digest of the loss text)."""
    said = "".join(t or "" for r, t in turns if r == "assistant")
    whole = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", ""]), st.lists(st.sampled_from(PARTS)).map("".join)), max_size=4))
def test_any_text_is_read_back(turns):
    roles, texts = (pa.array([t[i] for t in turns], pa.string()) for i in (0, 1))
    out, starts, text_at, sizes = chat.assemble(roles, texts)
    formatted = out.tobytes().decode()
    assert list(chat.parse_turns(formatted)) == turns
    for (_, text), at, size in zip(turns, text_at, sizes, strict=True):
        assert chat.unescape(out[at : at + size].tobytes().decode()) == text


def formatted(spark, rows, schema=TURNS):
    df = spark.createDataFrame(rows, schema)
    return {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}


def test_odd_rows(spark):
    rows = [
        (1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (1, None, "system", "s"),
        (2, 0, None, "x</s>"), (None, 0, "assistant", ""), (3, 0, "assistant", "</s>[INST] ok [/INST]" * 100_000),
    ]
    got = formatted(spark, rows)
    expected = {
        1: [("system", "s"), ("user", ""), ("assistant", "b"), ("assistant", "b")],
        2: [("", "x</s>")],
        None: [("assistant", "")],
        3: [("assistant", rows[-1][3])],
    }
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == {
        c: digests(t) for c, t in expected.items()
    }


def test_pieces_of_a_huge_conversation(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"turn {i} </s>") for i in range(50)] + [(2, 0, "assistant", "z")]
    pieces = chat.format_conversations(spark.createDataFrame(rows, TURNS), piece_bytes=200)
    assert pieces.where("conv_id = 1").count() > 3
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(pieces).collect()}
    assert got == {1: digests([r[2:] for r in rows[:50]]), 2: digests([("assistant", "z")])}


def test_empty_table_and_clashing_columns(spark):
    assert formatted(spark, []) == {}
    extra = TURNS + ", piece int, formatted string, n_turns string, loss_spans int"
    got = formatted(spark, [(1, 0, "user", "a", 9, "f", "n", 3)], extra)
    assert got[1].n_turns == 1


def test_query(spark):
    turns = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    table = f"SELECT conv_id, role, text FROM '{SF_DIR}/conversations.parquet' ORDER BY conv_id, turn"
    for conv, role, text in duckdb.sql(table).fetchall():
        turns.setdefault(conv, []).append((role, text))
    got = QUERIES["op1_chat_format"](spark, SF_DIR).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == {
        c: digests(t) for c, t in turns.items()
    }
    assert len(got) == len(turns) and all(r.formatted_chars > r.loss_chars for r in got)


@pytest.mark.parametrize("text", ["</s>", "<\\/s>", "<<SYS>>x<</SYS>>", "[/INST"])
def test_escape_leaves_no_control_string(text):
    escaped = chat.escape(pa.array([text]))[0].as_py()
    assert chat.unescape(escaped) == text
    assert not any(mark in escaped for mark in ("</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))
