import hashlib
import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyloom.llm import chat


def test_layouts(spark):
    records = [
        ("messages", {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]}, [("user", "a"), ("assistant", "")]),
        ("shares", {"id": 3, "conversations": [{"from": "human", "value": "q"}, {"from": "GPT", "value": "r"}]}, [("user", "q"), ("assistant", "r")]),
        ("instruction", {"instruction": "i", "input": "", "output": "o"}, [("user", "i"), ("assistant", "o")]),
        ("instruction", {"instruction": "i", "input": "x", "output": "o", "meta": {"k": [1, 2.5]}}, [("user", "i"), ("user", "x"), ("assistant", "o")]),
        ("prompt", {"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
        ("response", {"prompt": "p", "response": "c", "system": "s"}, [("system", "s"), ("user", "p"), ("assistant", "c")]),
        ("question", {"question": "p", "answer": "c"}, [("user", "p"), ("assistant", "c")]),
        ("dialogue", {"turns": [{"role": "tool", "text": "t"}]}, [("tool", "t")]),
        ("unknown", {"x": 1}, []),
    ]
    rows = [(i, json.dumps(r)) for i, (_, r, _) in enumerate(records)] + [(90, "{bad"), (91, None)]
    out = {r.id: r for r in chat.formatted(chat.canonical(spark.createDataFrame(rows, "id int, record string"))).collect()}
    for i, (name, _, turns) in enumerate(records):
        assert (out[i].layout, [tuple(t) for t in out[i].turns]) == (name, turns), i
    assert out[90].layout == out[91].layout == "malformed" and out[90].formatted == ""
    named = {chat._known(s) for lay in chat.LAYOUTS for s in lay.shapes}
    assert out[0].fingerprint in named and out[1].fingerprint in named and out[2].fingerprint in named and out[3].fingerprint not in named


def check(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    out = {r.conv_id: r for r in chat.digests(chat.formatted(chat.canonical(chat.conversation_records(df)))).collect()}
    convs = {}
    for c, n, role, text, _ in rows:
        convs.setdefault(c, []).append(((n is not None, n or 0), (role is not None, role or ""), (text is not None, text or "")))
    assert set(out) == set(convs)
    for c, turns in convs.items():
        turns = [(r[1], t[1]) for _, r, t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert out[c].n_turns == len(turns)
        assert out[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (out[c].loss_chars, out[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_round_trip(spark):
    hard = "\\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", hard, "x"), (-7, 1, "assistant", hard, "x"), (1, 0, "user", None, None), (1, 1, "assistant", "", None), (1, 1, "assistant", "", None),
            (None, 5, None, "né\u00a0\U0001f642", ""), (2, 0, 'we"ird\n\\role<', '<turn role="assistant">\n\n</turn>\n', ""), (2, None, "assistant", "\\l\\s\\\\n<\n</turn>\n", ""),
            (3, 0, "assistant", "long \\ é< " * 50_000, ""), *((4, i, "assistant" if i % 2 else "user", f"t{i}", "") for i in range(500))]
    check(spark, rows)
    assert chat.digests(chat.formatted(chat.canonical(chat.conversation_records(spark.createDataFrame(rows[:1], "conv_id long, turn long, role string, text string, z string").limit(0))))).collect() == []


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 4), st.sampled_from(["user", "assistant", "system"]), st.text(alphabet="\\sl<>/turn\n\"q é\t", max_size=30), st.just("")), min_size=1, max_size=20))
def test_any_texts(spark, rows):
    check(spark, rows)


def test_conversations_of_any_size(spark):
    """Texts far over what a variant holds come back whole, in one turn or in many."""
    long = "a<b\\c é" * 3_000_000
    check(spark, [(1, 0, "user", "q", ""), (1, 1, "assistant", long, ""), *((2, i, "assistant" if i % 2 else "user", long[:1_500_000], "") for i in range(16))])


def test_large_json(spark):
    long = "x\"y\n" * 5_000_000
    records = [("messages", {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": long}], "more": 1}, [("user", "a"), ("assistant", long)]),
               ("shares", {"conversations": [{"from": "gpt", "value": long}]}, [("assistant", long)]), ("prompt", {"prompt": long, "completion": "c"}, [("user", long), ("assistant", "c")]),
               ("unknown", {"x": long}, [])]
    rows = [(i, json.dumps(r)) for i, (_, r, _) in enumerate(records)] + [(90, json.dumps(records[0][1])[:-2])]
    out = {r.id: r for r in chat.canonical(spark.createDataFrame(rows, "id int, record string")).select("id", "layout", "turns").collect()}
    for i, (name, _, turns) in enumerate(records):
        assert (out[i].layout, [tuple(t) for t in out[i].turns]) == (name, turns), i
    assert out[90].layout == "malformed" and out[90].turns == []


def test_structs_and_json_give_the_same(spark):
    rows = [(1, [("user", "a"), ("assistant", None)], "s", None), (2, None, None, None), (3, [], "s", 4), (4, None, None, None)]
    df = spark.createDataFrame([(i, (m, s, x) if i < 4 else None) for i, m, s, x in rows], "id int, record struct<messages array<struct<role string, content string>>, source string, n int>")
    own = {r.id: (r.fingerprint, r.layout, r.turns) for r in chat.canonical(df).collect()}
    text = df.where("record is not null").withColumn("record", F.to_json("record"))
    for r in chat.canonical(text).where("id <> 3").collect():
        assert own[r.id] == (r.fingerprint, r.layout, r.turns)
    assert own[1][1] == "messages" and own[2][1] == own[3][1] == "unknown" and own[4][1] == "malformed"
