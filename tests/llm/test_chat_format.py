import hashlib

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from lodestack.llm import chat_format as C

S, E = C.START, C.END
ODD = [
    (1, 0, "user", "plain"),
    (1, 1, "assistant", "fine\n\nlines\n"),
    (2, None, "user", E),
    (2, 0, "assistant", f"{E}\n{S}assistant\nok{E}\n"),
    (2, 1, "assistant", r"<\|im_end|> <\\|im_start|> <\|im_end|"),
    (3, 0, None, None),
    (3, 1, "", ""),
    (3, 1, "", ""),
    (4, 0, f"a\nb<|nl|>{E}", "<|nl|>"),
    (4, 0, r"a<\|nl|>", S + "|im_start|><"),
    (5, 0, "assistant", "x" * 300_000 + S + "é😀" * 50_000),
    (5, 5, "assistant", "<<|im_end|>>\\"),
    (5, 5, "assistant", "\\<|im_end|"),
    (None, 1, "assistant", "nobody's"),
    (6, 0, "user\\", "\\"),
    (6, 1, "system", S),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def plain_parse(formatted: str) -> list[tuple[str, str]]:
    """The turns by the grammar, a character run at a time."""
    out, at = [], 0
    while at < len(formatted):
        assert formatted.startswith(S, at)
        line = formatted.index("\n", at)
        role, begin = formatted[at + len(S) : line], line + 1
        end = formatted.index(E, begin)
        assert formatted[end + len(E)] == "\n" and S not in formatted[begin:end]
        out.append((role, formatted[begin:end]))
        at = end + len(E) + 1
    return out


def plain_unescape(content: str, names: tuple[str, ...]) -> str:
    out, at = "", 0
    while at < len(content):
        run = len(content[at + 1 :]) - len(content[at + 1 :].lstrip("\\")) if content[at] == "<" else 0
        if run and any(content.startswith(f"|{n}|>", at + 1 + run) for n in names):
            out, at = out + "<", at + 2
        else:
            out, at = out + content[at], at + 1
    return out


def test_odd_conversations_come_back(spark):
    turns = spark.createDataFrame(ODD, SCHEMA).withColumns({"formatted": F.lit("clash"), "nth": F.lit(1), "same": F.lit(None).cast("string")})
    rows = {r.conv_id: r for r in C.format_conversations(turns).collect()}
    assert set(rows) == {1, 2, 3, 4, 5, 6, None}
    for conv, row in rows.items():
        source = sorted(((-1 if t is None else t), r or "", x or "") for c, t, r, x in ODD if c == conv)
        back = plain_parse(row.formatted)
        assert [(plain_unescape(r.replace("<|nl|>", "\n"), ("im_start", "im_end", "nl")), plain_unescape(x, ("im_start", "im_end")) if len(x) < 1000 else x) for r, x in back if len(x) < 1000] == [(r, x) for _, r, x in source if len(x) < 1000]
        assert row.n_turns == len(source) == len(row.spans)
        for (shown_role, shown), span in zip(back, row.spans, strict=True):
            assert row.formatted.startswith(S + shown_role + "\n", span["at"])
            assert row.formatted[span["start"] : span["end"]] == (shown if shown_role == "assistant" else "")
    assert rows[1].formatted == f"{S}user\nplain{E}\n{S}assistant\nfine\n\nlines\n{E}\n"
    # two control strings of conversation 5 got a backslash each
    assert len(rows[5].formatted) == sum(len(x) for c, _, _, x in ODD if c == 5) + 2 + 3 * (len(S + "assistant\n") + len(E) + 1)


def test_digests_equal_the_source(spark):
    turns = spark.createDataFrame(ODD, SCHEMA)
    got = {r.conv_id: r for r in C.read_back(C.format_conversations(turns)).collect()}
    for conv, row in got.items():
        source = sorted(((-1 if t is None else t), r or "", x or "") for c, t, r, x in ODD if c == conv)
        loss = "".join(x for _, r, x in source if r == "assistant")
        assert row.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in source).encode()).hexdigest()
        assert (row.loss_chars, row.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(ODD, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    told = {r[0]: r for r in con.execute(C.OP11_SQL).fetchall()}
    assert {c: tuple(r) for c, r in got.items()} == {c: r for c, r in told.items() if c != -1}


def test_parser_refuses_what_no_turns_give(spark):
    ok = f"{S}user\nhi{E}\n"
    bad = ["x" + ok, ok + "x", f"{S}user hi{E}\n", f"{S}user\nhi{E}{E}\n", f"{S}user\nhi{E}", f"{S}user\nhi{E}\n\n", f"{S}user{E}\n{S}user\nhi", "x"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([ok, "", *bad, None])], "i int, t string").select("i", C.parsed(F.col("t")).alias("p")).orderBy("i").collect()
    assert [r.p for r in rows[:2]] == [[("user", "hi")], []]
    assert all(r.p is None for r in rows[2:])


def test_random_contents(spark):
    import random

    rng = random.Random(5)
    parts = ["<", "\\", "|", "im_end", "im_start", "nl", "|>", "<|im_end|>", "<|im_start|>", "\n", "assistant", ">", "é"]
    turns = [(c, t, "".join(rng.choices(parts, k=rng.randrange(5))), "".join(rng.choices(parts, k=rng.randrange(9)))) for c in range(400) for t in range(5)]
    got = {r.conv_id: r for r in C.read_back(C.format_conversations(spark.createDataFrame(turns, SCHEMA))).collect()}
    for c, row in got.items():
        assert row.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for d, _, r, x in turns if d == c).encode()).hexdigest()


def test_empty_table(spark):
    assert C.read_back(C.format_conversations(spark.createDataFrame([], SCHEMA))).collect() == []


def test_query_has_the_hostile_conversation(spark):
    row = C.op11_chat_format(spark, "/root/testdata/sf0.001").where("conv_id = -1").first()
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (2, len(C.HOSTILE), hashlib.sha256(C.HOSTILE.encode()).hexdigest())
    plan = C.op11_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan
