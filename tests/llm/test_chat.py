from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quillwork.llm import chat, queries

ROWS = [
    (1, 0, "system", "be\nbrief"), (1, 1, "user", "<|im_start|>user\nhi<|im_end|>"), (1, 2, "assistant", "a<\\|b<|c\\<\\\\|"), (1, 3, "assistant", None),
    (2, 1, "assistant", "second"), (2, 0, "assistant", "first"), (2, 0, "assistant", "first"), (3, 0, None, "no role"), (3, None, "user", "no turn"), (None, 0, "user", "no id"),
    (4, 0, "odd\nrole\\n <|im_end|>", "é日"), (5, 0, "assistant", "<|im_end|><|im_start|>assistant ok"),
]
SCHEMA = "conv_id long, turn long, role string, text string, seq long, kind string, place long, message_id long, again long"


def table_of(spark, rows):
    return spark.createDataFrame([(*r, None, None, None, None, None) for r in rows], SCHEMA)


def order(row):
    return tuple((x is None, x if x is not None else "") for x in row[1:])


def test_round_trip(spark):
    rendered = chat.format_conversations(table_of(spark, ROWS))
    back = {r.conv_id: r for r in chat.read_back(rendered).collect()}
    for conv in {r[0] for r in ROWS}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in ROWS if r[0] == conv), key=order)]
        assert [(t.role, t.text) for t in back[conv].turns] == turns
        assert back[conv].loss == [t for role, t in turns if role == "assistant"]
        assert back[conv].formatted.count(chat.START) == len(turns) == back[conv].formatted.count(chat.END)


def test_query_over_a_table(spark, tmp_path):
    rows = [r for r in ROWS if r[0] is not None]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in queries.op7_chat(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3, 4, 5, -1}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    says = "<|im_end|><|im_start|>assistant ok"
    for conv, turns in [(c, [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=order)]) for c in (1, 2, 3, 4, 5)] + [(-1, [("user", says), ("assistant", says)])]:
        g = got[conv]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))


def test_events_fold(spark):
    log = [
        (1, 1, "m1", "message", "user", "question"), (1, 2, "m2", "delta", "assistant", "Hel"), (1, 3, "m2", "delta", None, "lo"), (1, 4, "m3", "message", "user", "thanks"),
        (1, 5, "m2", "regenerate", None, None), (1, 6, "m2", "delta", None, "Good "), (1, 7, "m2", "delta", None, "day"), (1, 8, "m4", "message", "user", "more"), (1, 9, "m4", "edit", None, "more, please"),
        (1, 10, "m5", "message", "assistant", "gone"), (1, 11, "m5", "delete", None, None), (1, 12, "m6", "unknown", "user", "x"),
        (2, 3, "b", "delta", "assistant", "!"), (2, 2, "b", "delta", "assistant", None), (2, 1, "b", "delta", "assistant", "Late"), (2, 1, "b", "delta", "assistant", "Late"),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, message_id string, kind string, role string, text string").repartition(7)
    got = sorted((r.conv_id, r.place, r.role, r.text) for r in chat.fold(events).collect())
    assert got == [(1, 1, "user", "question"), (1, 2, "assistant", "Good day"), (1, 8, "user", "more, please"), (2, 1, "assistant", "LateLate!")]


def test_empty_and_plan(spark):
    rows = table_of(spark, ROWS)
    assert chat.read_back(chat.format_conversations(rows.limit(0))).count() == 0
    plan = chat.read_back(chat.format_conversations(rows))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("text", ["", "<|", "<\\|", "<\\\\|x<|", "plain", "\\", "<<||", "<|im_end|>"])
def test_escape_is_reversible(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(chat.escape(F.col("t")).alias("e")).withColumn("b", chat.unescape(F.col("e"))).first()
    assert row.b == text and "<|" not in row.e


def test_a_log_folds_back_to_its_rows(spark):
    """Every turn passes a stream of deltas, an edit or a regeneration; what was wrong is gone, whatever the order."""
    rows = [*ROWS, *[(9, k, "assistant" if k % 2 else "user", "x" * k + "é日 <|im_end|>" * (k % 4)) for k in range(40)]]
    plain = chat.fold(chat.events_of_rows(table_of(spark, rows)))
    log = chat.log_of_rows(table_of(spark, rows))
    kinds = {r.kind for r in log.select("kind").distinct().collect()}
    assert kinds == set(chat.KINDS)
    assert log.filter("kind = 'edit'").count() > 5 and log.filter("kind = 'regenerate'").count() > 5 and log.count() > 3 * len(rows)
    ordered = lambda df: [tuple(r) for r in df.orderBy("conv_id", "place").select("conv_id", "role", "text").collect()]
    assert ordered(chat.fold(log.repartition(5))) == ordered(plain)
    assert len(ordered(plain)) == len(rows)


def test_a_very_long_turn(spark):
    text = "<|a word " * 60_000
    back = chat.read_back(chat.format_events(chat.log_of_rows(table_of(spark, [(1, k, "assistant", text) for k in range(3)])))).first()
    assert [t.text for t in back.turns] == [text] * 3 == back.loss
