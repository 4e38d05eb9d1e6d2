from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from lodeflow.llm import chat

ODD = ["", None, "a:b", "### user: </turn>\n", "\\", "\\\\</turn>", "####", "#" * 7, "<", "</turn", "</turn>\n### assistant: x</turn>\n", "\n\n", "é\r\n\t😀", "<\\/turn>", "#\\#", "x" * 200_000]


def test_round_trip(spark):
    rows = [(i, t, r, x) for i, x in enumerate(ODD) for t, r in enumerate(["user", "assistant", None, "a: b\\", "assistant"])]
    df = spark.createDataFrame([(*r, 1, "extra") for r in rows], "conv_id long, turn long, role string, text string, turns int, formatted string")
    turns = chat.typed_turns(df)
    back = {r.conv_id: r for r in turns.withColumn("back", chat.read_back(chat.formatted(F.col("turns")))).collect()}
    for i, x in enumerate(ODD):
        assert [(t.role, t.text) for t in back[i].back] == [(r or "", x or "") for r in ["user", "assistant", None, "a: b\\", "assistant"]]
    for r in chat.digests(turns).collect():
        x = ODD[r.conv_id] or ""
        assert r.n_turns == 5 and r.loss_chars == 2 * len(x) and r.loss_sha256 == hashlib.sha256((x + x).encode()).hexdigest()


def test_order_ties_and_empty(spark):
    df = spark.createDataFrame([(1, 1, "b", "x"), (1, 0, "a", "y"), (1, 1, "a", "z"), (1, 1, "a", "z"), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.typed_turns(df).collect()}
    assert got == {1: [("a", "y"), ("a", "z"), ("a", "z"), ("b", "x")], None: [("", "")]}
    assert chat.digests(chat.typed_turns(df.limit(0))).count() == 0


def test_json_layouts(spark):
    records = [
        '{"prompt":"p","response":"r"}', '{"response":"r","prompt":null}', '{"instruction":"i","input":"","output":"o"}', '{"instruction":"i","input":"n","output":"o"}',
        '{"messages":[{"role":"system","content":"s"},{"role":"user","content":"u"}]}', '{"conversations":[{"from":"human","value":"h"},{"from":"gpt","value":"g"}]}', '{"other":1}', "broken", None,
    ]
    got = [[(t.role, t.text) for t in r.turns] if r.turns is not None else None for r in chat.json_turns(spark.createDataFrame([(i, x) for i, x in enumerate(records)], "i int, rec string"), "rec").orderBy("i").collect()]
    assert got == [
        [("user", "p"), ("assistant", "r")], [("user", None), ("assistant", "r")], [("user", "i"), ("assistant", "o")], [("user", "i\n\nn"), ("assistant", "o")],
        [("system", "s"), ("user", "u")], [("user", "h"), ("assistant", "g")], None, None, None,
    ]


def test_typed_layouts(spark):
    df = spark.createDataFrame([(1, "i", "n", "o")], "id int, instruction string, input string, output string")
    assert [(t.role, t.text) for t in chat.typed_turns(df).first().turns] == [("user", "i\n\nn"), ("assistant", "o")]
    df = spark.createDataFrame([(1, [("user", "u")])], "id int, messages array<struct<role:string,content:string>>")
    assert [(t.role, t.text) for t in chat.typed_turns(df).first().turns] == [("user", "u")]
    assert chat.typed_turns(spark.createDataFrame([(1,)], "id int")).first().turns is None
    assert chat.MAPPINGS[0].fingerprint != chat.MAPPINGS[1].fingerprint


def test_the_fingerprint_of_the_records_own_paths_selects_the_mapping(spark):
    records = [
        '{"id":7,"prompt":"p","response":"r","source":{"name":"x","tags":[1,"a"]}}', '{"prompt":"p","completion":"r"}', '{"prompt":"p","answer":"r"}', '{"prompt":"p","response":"r","messages":[{"role":"user","content":"u"}]}',
        '{"messages":[{"content":"u","role":"user","name":null},{"role":"assistant","content":"a","odd`key: <x>":[[{"q":1}]]}]}', '{"messages":[]}', '[{"prompt":"p","response":"r"}]', '{"prompt":{"text":"p"},"response":"r"}', '{"a":{"prompt":"p","response":"r"}}',
    ]
    df = spark.createDataFrame([(i, x, "mine") for i, x in enumerate(records)], "i int, rec string, layout string")
    rows = chat.json_turns(df, "rec").orderBy("i").collect()
    by = chat.layouts()
    assert [by[r.fingerprint].fields if r.fingerprint in by else None for r in rows] == [("prompt", "response"), ("prompt", "completion"), None, None, ("messages[].role", "messages[].content"), None, None, None, None]
    assert [r.turns is not None for r in rows] == [r.fingerprint in by for r in rows] and {r.layout for r in rows} == {"mine"}
    assert rows[2].fingerprint == chat.fingerprint(["prompt", "answer"]) and rows[5].fingerprint == chat.fingerprint([])
    found = df.select(chat.json_paths(F.col("rec")).alias("p")).collect()
    assert sorted(found[0].p) == ["id", "prompt", "response", "source.name", "source.tags[]"] and sorted(found[4].p) == ["messages[].content", "messages[].name", "messages[].odd`key: <x>[][].q", "messages[].role"]
    own = (chat.Mapping((("user", "prompt"), ("assistant", "answer"))),)
    assert [t.text for t in chat.json_turns(df, "rec", own).where("i = 2").first().turns] == ["p", "r"]
    for fields, want in ((("prompt", "response"), True), (("prompt", "answer"), False), (("prompt", "completion"), True)):
        typed = spark.createDataFrame([("p", "r", 1)], f"{fields[0]} string, {fields[1]} string, id int")
        assert (chat.typed_turns(typed).first().turns is not None) == want
