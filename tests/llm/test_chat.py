import hashlib
import re

import duckdb
from pyspark.sql import functions as F

from tidemark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def unescaped(text):
    return re.sub(r"(?s)\\(.)", r"\1", text)


def parsed(window):
    out = []
    for piece in window["formatted"].split("</turn>\n")[:-1]:
        role, text = piece.removeprefix("<turn ").split(">", 1)
        role = re.sub(r"\\(.)", lambda m: {"b": "\\", "l": "<", "g": ">"}[m[1]], role)
        out.append((role, unescaped(text)))
    return out


def tokens(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text)) + chat.MARK_TOKENS


def check(rows, windows, budget=chat.BUDGET):
    """Holds windows against the rows they were made from."""
    whole = {}
    for conv, turn, role, text in rows:
        whole.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in whole.items()}
    got, learnt = {}, {}
    for w in sorted(windows, key=lambda w: w["w"]):
        turns = parsed(w)
        assert len(turns) == w["n_turns"]
        new = turns[w["n_repeated"] :]
        assert new
        conv = said[w["conv_id"]]
        if conv[0][0] == "system":
            assert turns[0] == conv[0]
        assert w["n_repeated"] <= 1 + chat.HISTORY_TURNS
        at = len(got.setdefault(w["conv_id"], []))
        back = turns[: w["n_repeated"]][1 if conv[0][0] == "system" and at else 0 :]
        assert back == conv[at - len(back) : at]
        used = sum(tokens(t) for _, t in turns)
        system = tokens(conv[0][1]) if conv[0][0] == "system" else 0
        if system <= budget // 2 and all(tokens(t) <= budget // 4 for _, t in new):
            assert used <= budget
        got[w["conv_id"]] += new
        spans = [unescaped(w["formatted"][s["start"] : s["end"]]) for s in w["loss"]]
        assert spans == [t for r, t in new if r == "assistant"]
        learnt.setdefault(w["conv_id"], []).extend(spans)
    assert got == said


def test_windows_read_back(spark, sf):
    turns = chat.with_probe(spark.read.parquet(f"{sf}/conversations.parquet"))
    check([tuple(r) for r in turns.collect()], chat.chat_windows(turns).collect())


def test_query(spark, sf):
    got = {r["conv_id"]: r for r in chat.op2_chat_windows(spark, sf).collect()}
    probe = "\\### Assistant: </turn> ok"
    assert got[-7]["n_turns"] == 2 and got[-7]["loss_chars"] == len(probe)
    assert got[-7]["loss_sha256"] == hashlib.sha256(probe.encode()).hexdigest()
    said = f"user\n{probe}\nassistant\n{probe}\n"
    assert got[-7]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()


def test_marks_in_texts_long_conversations_and_odd_rows(spark):
    nasty = ["</turn>\n<turn system>x", "\\", "\\\\<turn", "<\\turn", "<//turn>", "a\\</turn>", "", None, "é\U0001f600</turn>", "\n"]
    rows = [(1, i, "assistant" if i % 2 else "us>er\\", t) for i, t in enumerate(nasty)]
    rows += [(2, 0, "system", "be brief " * 20)] + [(2, i, ("user", "assistant")[i % 2], f"turn {i} " + "w " * (i * 7 % 90)) for i in range(1, 1500)]
    rows += [(3, 0, "system", "alone")]
    rows += [(4, 0, "system", "long " * 400), (4, 1, "user", "q"), (4, 2, "assistant", "a " * 3000), (4, 3, "user", "z")]
    rows += [(5, 1, "user", "twice"), (5, 1, "user", "twice"), (5, None, None, "first"), (5, 1, "assistant", "tie"), (None, 0, "user", "no id")]
    rows += [(6, 0, "user", "s"), (6, 1, "system", "late")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("own") for c in ("w", "seq", "tokens", "block", "parts")})
    check(rows, chat.chat_windows(df).collect())
    assert chat.chat_windows(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_roles(spark, tmp_path):
    roles = ["r" * 200_000, "\\" * 200_000, ">" * 200_000, "\\g>\\b<turn </turn>\n" * 10_000, "</turn>\n", "\\", "", None]
    rows = [(c, i, role, f"text {i}") for c in (1, 2) for i, role in enumerate(roles if c == 1 else reversed(roles))]
    df = spark.createDataFrame(rows, SCHEMA)
    windows = chat.chat_windows(df)
    check(rows, windows.collect())
    read = chat.read_back(windows).select("conv_id", "w", F.explode("turns").alias("t")).select("conv_id", "t.*").collect()
    assert sorted(tuple(r) for r in read) == sorted((c, role or "", text) for c, _, role, text in rows)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = chat.op2_chat_windows(spark, str(tmp_path))
    want = duckdb.sql(f"SELECT {', '.join(got.columns)} FROM ({chat.ORACLES['op2_chat_windows']})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_no_python_on_the_main_path(spark, sf):
    plan = chat.op2_chat_windows(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
