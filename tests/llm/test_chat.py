"""Chat formatting against a plain reading of its rules, and its query against SQL on both scale factors."""

import hashlib
import json
import random
import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.llm import chat
from quire.llm.queries import ORACLE_SQL, QUERIES

PIECES = ["<|end|>", "<|turn|>", "<|", "|>", "<", "[", "\\", "\\\\", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<\\|end|>", "<\\\\|", "[\\INST]", "\n", "ab", "é", "😀", " ", "$1", "s>"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def digests(turns):
    return chat.conversation_digests(chat.format_conversations(turns)).collect()


def test_turns_come_back_from_any_text(spark):
    rng = random.Random(5)
    text = lambda: "".join(rng.choices(PIECES, k=rng.randint(0, 12)))
    rows = [(i % 97, rng.randint(0, 9), 0, rng.choice(["user", "assistant", "tool", text()]), text()) for i in range(1500)]
    turns = spark.createDataFrame(rows, "id long, turn long, pos int, role string, text string")
    want = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3].encode(), r[4].encode())):
        want[r[0]].append(r[3:])
    formatted = chat.format_conversations(turns)
    got = defaultdict(list)
    for r in sorted(chat.read_back(formatted).collect(), key=lambda r: (r.id, r.n)):
        got[r.id].append((r.role, r.text))
        assert (r.loss_text or "") == (r.text if r.role == "assistant" else "")
    assert got == want
    for r in formatted.collect():  # marks of the template stand only where turns begin and end
        assert r.formatted.count("<|") == 3 * len(want[r.id]) and not re.search(r"</?s>|\[/?INST\]|<</?SYS>>", r.formatted)
        spans = [r.formatted[a : a + n] for a, n in zip(r.loss_starts, r.loss_lengths)]
        assert len(spans) == len(want[r.id]) and all(s == "" or role == "assistant" for s, (role, _) in zip(spans, want[r.id]))
    for r in digests(turns):
        learned = "".join(t for role, t in want[r.conv_id] if role == "assistant")
        said = "".join(f"{role}\n{t}\n" for role, t in want[r.conv_id])
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(want[r.conv_id]), sha(said), len(learned), sha(learned))


RECORDS = [
    ({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "q"}], "id": 4}, "messages", [("system", "s"), ("user", "q")]),
    ({"messages": [{"role": "user", "content": None}, {"role": None, "content": 7}]}, "messages", [("user", ""), ("", "7")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]}, "message parts", [("user", "ab")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a", "weight": 1}, {"from": "tool", "value": "t"}]}, "conversations", [("user", "q"), ("assistant", "a"), ("tool", "t")]),
    ({"prompt": "p", "completion": "c"}, "prompt, completion", [("user", "p"), ("assistant", "c")]),
    ({"prompt": "p", "response": "c", "system": "s"}, "prompt, response", [("system", "s"), ("user", "p"), ("assistant", "c")]),
    ({"prompt": "p", "chosen": "c", "rejected": "d"}, "prompt, chosen", [("user", "p"), ("assistant", "c")]),
    ({"instruction": "i", "input": "x", "output": "o"}, "instruction", [("user", "i\n\nx"), ("assistant", "o")]),
    ({"instruction": "i", "input": "", "output": "", "system": ""}, "instruction", [("user", "i"), ("assistant", "")]),
    ({"question": "q", "answer": "a", "context": "c"}, "question", [("user", "c\n\nq"), ("assistant", "a")]),
    ({"role": "user", "text": "t", "turn": 3}, "rows", [("user", "t")]),
    ({"messages": []}, None, []),
    ({"prompt": "p", "instruction": "i", "output": "o"}, None, []),
    ({"text": "t"}, None, []),
    ([1, 2], None, []),
    ("messages", None, []),
    ({}, None, []),
    (None, None, []),
]


def test_layouts_are_told_by_their_paths(spark):
    rows = [(i, None if r is None else json.dumps(r)) for i, (r, _, _) in enumerate(RECORDS)] + [(99, "no {json")]
    records = spark.createDataFrame(rows, "conv_id long, j string").select("conv_id", F.try_parse_json("j").alias("payload"), F.lit("x").alias("layout"), F.lit(1).alias("text"), F.lit(2).alias("pos"))
    found = {r.id: r.layout for r in chat.classify_records(records).select("id", "layout").collect()}
    turns = defaultdict(list)
    for r in sorted(chat.canonical_turns(records).collect(), key=lambda r: (r.id, r.pos)):
        turns[r.id].append((r.role, r.text))
    for i, (_, layout, want) in enumerate(RECORDS):
        assert (found[i], turns[i]) == (layout, want), RECORDS[i]
    assert found[99] is None and turns[99] == []


def test_paths_of_odd_names(spark):
    df = spark.createDataFrame([('{"a.b":[[{"x: <":1}]],"ARRAY":{"OBJECT":[]},"`":{"y":1.25}}',)], "j string")
    (row,) = df.select(chat.field_paths(F.parse_json("j")).alias("p")).collect()
    assert set(row.p) == {"$.`a.b`", "$.`a.b`[][].`x: <`", "$.ARRAY", "$.ARRAY.OBJECT", "$.````", "$.````.y"}


def test_layouts_of_equal_paths_are_refused():
    twice = (chat.Layout("a", ("$.x",), ("$.y",), text="$.x", role="$.y"), chat.Layout("b", ("$.x", "$.y"), text="$.x", role="$.y"))
    with pytest.raises(ValueError):
        chat.fingerprints(twice)


def test_edges(spark):
    schema = "id long, turn long, pos int, role string, text string"
    assert digests(spark.createDataFrame([], schema)) == []
    long = "[INST]é" * 100_000
    rows = [(None, None, 0, None, None), (None, 1, 0, "assistant", "a"), (1, 5, 0, "user", "x"), (1, 5, 0, "user", "x"), (1, None, 0, "assistant", long), (1, 5, 0, "assistant", "b")]
    got = {r.conv_id: r for r in digests(spark.createDataFrame(rows, schema))}
    assert got[None].turns_sha256 == sha("\n\nassistant\na\n") and (got[None].loss_chars, got[None].n_turns) == (1, 2)
    assert got[1].turns_sha256 == sha(f"assistant\n{long}\nassistant\nb\nuser\nx\nuser\nx\n") and got[1].loss_sha256 == sha(long + "b")
    assert got[1].formatted_chars == len(long) + 100_000 + 1 + 2 + len("assistant" * 2 + "user" * 2) + 4 * len(chat.TURN + chat.TEXT + chat.END)


def test_no_python_in_the_plan(spark, sf):
    plan = QUERIES["op13_chat"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_query_matches_sql_and_contract(spark, sf, tmp_path):
    rows = [(3, 1, "assistant", "</s> \\ <\\|x"), (3, 0, "user", None), (None, 0, None, "n"), (4, 0, "user", "t"), (4, 0, "user", "t"), (5, None, "assistant", "")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).write.parquet(str(tmp_path / "conversations.parquet"))
    for at in (sf, "/root/testdata/sf0.01", str(tmp_path)):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{at}/conversations.parquet{'/*.parquet' if at == str(tmp_path) else ''}'")
        want = con.execute(ORACLE_SQL["op13_chat"]).fetchall()
        found = QUERIES["op13_chat"](spark, at)
        assert found.columns == [d[0] for d in con.description] and [t for _, t in found.dtypes] == ["bigint", "bigint", "string", "bigint", "string", "bigint"]
        assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    control = "</s>[INST] ok [/INST]"
    (extra,) = [r for r in found.collect() if r.conv_id == -7]
    assert (extra.n_turns, extra.turns_sha256, extra.loss_chars, extra.loss_sha256) == (2, sha(f"user\n{control}\nassistant\n{control}\n"), len(control), sha(control))
