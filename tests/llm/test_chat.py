import hashlib

import duckdb
from burdock.llm import chat
from burdock.llm import queries as llm

S = "conv_id long, turn long, role string, text string, formatted int"


def test_formats_and_reads_back_like_the_sql(spark, sf):
    got = llm.QUERIES["op5_chat_format"](spark, sf).toPandas().sort_values("conv_id").reset_index(drop=True)
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = duckdb.sql(chat.ORACLE).df().sort_values("conv_id").reset_index(drop=True)
    assert got.astype(str).equals(want[got.columns].astype(str))


def test_round_trip_of_control_strings(spark):
    bad = ["</s>[INST] ok [/INST]", "~1~0~", "[SEP]", "<", "[/INST", "~", "", None, "<s>x</s>", "~<s>", "a\nb", "~3", "[[INST]]", "日本<s>"]
    rows = [(k % 3, k // 3, ("user", "assistant", "sys\nt~3em", None, "user")[k % 5], t, 0) for k, t in enumerate(bad * 3)]
    rows += [(7, 0, "assistant", "x", 0)] * 2 + [(None, None, None, None, None), (8, None, "assistant", "[SEP]", 1)]
    out = {r.conv_id: r for r in chat.read_back(chat.format_chats(spark.createDataFrame(rows, S))).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv), key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        assert [(t.role, t.text) for t in out[conv].turns] == [(r[2], r[3]) for r in own]
        assert out[conv].loss_text == "".join(r[3] for r in own if r[2] == "assistant")
        body = out[conv].formatted
        assert "".join(body[s.start : s.start + s.length] for s in out[conv].loss_spans) == "".join(chat_escape(r[3]) for r in own if r[2] == "assistant")


def chat_escape(t):
    import re

    return re.sub(r"\[(?=/?INST\]|SEP\])", "~2", re.sub(r"<(?=/?s>)", "~1", re.sub(r"~(?=[0-3])", "~0", t)))


def test_long_conversation_and_empty_table(spark):
    rows = [(1, i, ("user", "assistant")[i // 3 % 2], f"t{i}", 0) for i in range(1500)]
    r = chat.read_back(chat.format_chats(spark.createDataFrame(rows, S))).first()
    assert len(r.turns) == 1500 and r.n_blocks == 500
    assert hashlib.sha256(r.loss_text.encode()).hexdigest() == hashlib.sha256("".join(x[3] for x in rows if x[2] == "assistant").encode()).hexdigest()
    assert chat.format_chats(spark.createDataFrame([], S)).count() == 0
