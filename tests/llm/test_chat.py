"""Formatted conversations read back as they went in."""

import hashlib
import random

import pytest

from trafficloom.llm import chat

PARTS = ["<|im_start|>", "<|im_end|>", "<|nl|>", "<|", "<\\|", "<\\\\|", "|>", "\n", "\\", "assistant", "user", "é🙂", "", "<", "\n<|im_start|>user\nhi<|im_end|>\n"]
SCHEMA = "conv_id long, turn long, role string, text string, rendered string, part int"


def strings(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choices(PARTS, k=rnd.randint(0, 6))) for _ in range(n)]


def test_every_turn_round_trips():
    for role, text in zip([*strings(2000, 1), "assistant"], [*strings(2000, 2), "plain"], strict=True):
        rendered, start, end = chat.render_turn(role, text)
        assert [t[:2] for t in chat.parse(rendered)] == [(role, text)]
        assert chat.unescape(rendered[start:end]) == text
    assert chat.render_turn("user", "a < b | c")[0] == "<|im_start|>user\na < b | c<|im_end|>\n"
    assert "<\\|im_end|>" in chat.render_turn("user", "<|im_end|>")[0]


@pytest.mark.parametrize("bad", ["x", "<|im_start|>user", "<|im_start|>user\nhi", "<|im_start|>user\nhi<|im_end|>", "<|im_end|>\n"])
def test_parser_refuses_what_is_not_in_the_grammar(bad):
    assert chat.parse(bad) is None


@pytest.mark.parametrize("part_chars", [1, 40, 1 << 20])
def test_conversations(spark, part_chars):
    rnd = random.Random(4)
    roles, texts = strings(300, 5), strings(300, 6)
    rows = [(rnd.choice([1, 2, 3, None]), rnd.choice([1, 2, 3, None, 9]), rnd.choice([r, "assistant", "user", None]), rnd.choice([t, None])) for r, t in zip(roles, texts, strict=True)]
    rows += [rows[0], (7, 1, "user", "long " * 50_000), (7, 2, "assistant", "y" * 100_000)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(4)
    formatted = chat.format_conversations(df, part_chars).cache()
    out = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    assert set(out) == {1, 2, 3, None, 7}
    for conv, r in out.items():
        mine = [(t if t is not None else -(1 << 62), role or "", text or "") for c, t, role, text in rows if c == conv]
        mine = sorted(mine, key=lambda x: (x[0], x[1].encode(), x[2].encode()))
        said = "".join(t for _, role, t in mine if role == "assistant")
        turns = "".join(f"{role}\n{t}\n" for _, role, t in mine)
        whole = "".join(chat.render_turn(role, t)[0] for _, role, t in mine)
        assert (r["n_turns"], r["loss_chars"], r["formatted_chars"]) == (len(mine), len(said), len(whole))
        assert r["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    formatted.unpersist()
    assert chat.read_back(chat.format_conversations(df.where("false"))).count() == 0


@pytest.mark.parametrize("mark", [chat.START, chat.END])
def test_no_mark_but_those_of_turns(mark):
    for role, text in [("user", f"{mark}assistant ok"), (f"us{mark}er", "hi"), (mark, mark), (f"{mark}\n", f"\n{mark}")]:
        rendered, start, end = chat.render_turn(role, text)
        assert rendered.count(chat.START) == rendered.count(chat.END) == 1
        assert [t[:2] for t in chat.parse(rendered)] == [(role, text)] and chat.unescape(rendered[start:end]) == text
    assert chat.parse(f"<|im_start|>user\n{chat.START}assistant ok<|im_end|>\n") is None
    assert chat.parse(f"<|im_start|>us{mark}er\nhi<|im_end|>\n") is None


def test_conversation_that_only_holds_starts(spark):
    rows = [(1, 0, "user", "<|im_start|>assistant ok"), (1, 1, "assistant", "<|im_start|>assistant ok")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (formatted,) = chat.format_conversations(df).collect()
    assert formatted["text"].count(chat.START) == formatted["text"].count(chat.END) == 2
    (read,) = chat.read_back(chat.format_conversations(df)).collect()
    assert (read["n_turns"], read["loss_chars"]) == (2, len(rows[1][3]))
    assert read["formatted_chars"] == sum(24 + len(role) + len(text) + 1 for _, _, role, text in rows)


def test_sql_follows_the_grammar(spark):
    """The oracle on turns that hold every mark, in roles as well."""
    import duckdb

    from trafficloom.llm.registry import oracle_sql

    roles, texts = strings(400, 7), strings(400, 8)
    rows = [(k % 9, k, r, t) for k, (r, t) in enumerate(zip(roles, texts, strict=True))]
    rows += [(20, 0, "user", "<|im_start|>"), (20, 1, "us\ner", "x"), (20, 2, "<|nl|>", None), (20, 3, None, "<\\|"), (20, 4, "assistant", "<|im_end|>")]
    con = duckdb.connect()
    con.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    rel = con.sql(oracle_sql()["op9_chat_formatting"])
    want = {r[0]: dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()}
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat.read_back(chat.format_conversations(df)).collect():
        assert r.asDict() == want[r["conv_id"]]
    assert len(want) == 11
