"""Mixed tables of conversation layouts: every record is a conversation, whatever its layout."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from recordloom.llm import chat

RECORDS = [
    {"conv_id": 1, "turn": 1, "role": "assistant", "text": "b"},
    {"conv_id": 1, "turn": 0, "role": "user", "text": "a"},
    {"conv_id": None, "turn": 0, "role": "user", "text": None},
    {"messages": [{"role": "user", "content": "q", "name": "me"}, {"role": "assistant", "content": "r", "weight": 1}], "id": "x1"},
    {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "r"}]},
    {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "r"}]},
    {"conversations": [{"from": "human", "value": "</s>[INST]"}, {"from": "gpt", "value": "ok"}], "source": "s", "id": 3},
    {"prompt": "p", "response": "s", "model": "m"},
    {"instruction": "i", "input": "", "output": "o", "lang": "en"},
    {"messages": []},
    {"unknown": {"a": 1}},
    {"unknown": {"a": 1}},
]


def test_mixed_layouts_stay_apart(spark):
    rows = [(i, json.dumps(r)) for i, r in enumerate(RECORDS)]
    records = spark.createDataFrame(rows, "n long, line string").select("n", F.parse_json("line").alias("record"))
    turns = chat.canonical_turns(records)
    got = chat.by_conversation(turns, "conv", own=F.col("n") + 100).collect()
    said = {r.conv: None if r.turns is None else [(t.role, t.text) for t in r.turns] for r in got}
    qa = [("user", "q"), ("assistant", "r")]
    assert said == {
        1: [("user", "a"), ("assistant", "b")], None: [("user", "")], 103: qa, 104: qa, 105: qa,
        106: [("user", "</s>[INST]"), ("assistant", "ok")], 107: [("user", "p"), ("assistant", "s")],
        108: [("system", "i"), ("user", ""), ("assistant", "o")], 109: said[109], 110: None, 111: None,
    }
    assert len(got) == 11 and not said[109]
    unnamed = chat.by_conversation(turns, "conv")
    assert unnamed.count() == 11 and unnamed.filter("conv is null").count() == 10
    back = chat.read_back(chat.format_turns(chat.by_conversation(turns, "conv", own=F.col("n") + 100), "conv"), "conv")
    read = {r.conv: (r.n_turns, r.turns_text, r.loss_text, r.loss_chars) for r in back.collect()}
    for conv, turn in said.items():
        if turn is None:
            assert read[conv] == (0, None, None, None)
        else:
            trained = "".join(x for r, x in turn if r == "assistant")
            assert read[conv] == (len(turn), "".join(f"{r}\n{x}\n" for r, x in turn), trained, len(trained))


def test_an_empty_table_and_unmapped_rows_only(spark):
    none = spark.createDataFrame([], "line string").select(F.parse_json("line").alias("record"))
    whole = chat.read_back(chat.format_turns(chat.by_conversation(chat.canonical_turns(none), "conv"), "conv"), "conv")
    assert whole.collect() == []
    odd = spark.createDataFrame([("[1]",), ("3",), (None,)], "line string").select(F.parse_json("line").alias("record"))
    rows = chat.by_conversation(chat.canonical_turns(odd), "conv").collect()
    assert len(rows) == 3 and all(r.turns is None for r in rows)
