import hashlib
import json
import random

from hypothesis import given
from hypothesis import strategies as st

from purselight.llm import chat_schema as cs

said = st.lists(st.sampled_from([*"<[\\]>|/n\nsé🙂 INST", "<|im_end|>", "</s>", "<|im_start|>"]), max_size=12).map("".join)


def esc(text):
    return text.replace("\\", "\\\\").replace("<", "<\\").replace("[", "[\\")


@given(said, said)
def test_escape_is_reversible(role, text):
    formatted = cs.OPEN + esc(role).replace("\n", "\\n") + "\n" + esc(text) + cs.CLOSE
    assert list(cs.parse(formatted * 2)) == [(role, text)] * 2
    assert not any(x in esc(text) for x in (cs.OPEN, cs.CLOSE, "</s>", "[INST]", "[/INST]", "<|"))


def digest(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_rows_by_turn(spark):
    rng = random.Random(6)
    bits = ["</s>", "[INST]", "\\", "\\n", "\n", "<|im_end|>\n", "é", "🙂", " ok ", "<\\"]
    convs = {}
    for c in range(60):
        convs[c] = [(rng.choice(["user", "assistant", "system", "a\nb", "<|im_start|>"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))) for _ in range(rng.randint(1, 9))]
    convs[None] = [("user", "x"), ("assistant", "y")]
    convs[99] = [("assistant", "z" * 300)] * 500
    rows = [(c, i, r, t if t or i % 2 else None, "extra") for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    df = spark.createDataFrame([*rows, (77, 1, None, None, None), (77, 0, "assistant", "a", "b")], "conv_id long, turn long, role string, text string, record string")
    convs[77] = [("assistant", "a"), ("", "")]
    formatted = cs.format_turns(cs.canonical_turns(cs.turn_records(df)))
    got = {r.conv_id: r for r in cs.read_back(formatted).collect()}
    assert set(got) == set(convs)
    chars = {}
    for r in formatted.collect():
        chars[r.conv_id] = chars.get(r.conv_id, 0) + len(r.formatted)
    for c, turns in convs.items():
        assert tuple(got[c])[1:5] == digest(turns)
        assert got[c].formatted_chars == chars[c]
    assert cs.read_back(cs.format_turns(cs.canonical_turns(cs.turn_records(df.limit(0))))).collect() == []


def test_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]}, {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}], "system": "s"},
        {"prompt": "p", "completion": "c"}, {"prompt": "p", "response": "c", "system": ""}, {"instruction": "i", "input": "j", "output": "o"}, {"instruction": "i", "output": "o"},
        {"question": "q", "answer": "a", "context": "c"}, {"data": {"prompt": "p", "completion": "c"}}, {"from": "bot", "value": "v"}, {"role": "tool", "content": "t"}, {"role": "r"}, {},
        {"prompt": "p", "completion": "c", "id": 7, "meta": {"x": [1]}}, {"other": 1}, {"messages": []},
    ]
    want = [
        [("user", "a"), ("assistant", "")], [("system", "s"), ("user", "a"), ("assistant", "b")], [("user", "p"), ("assistant", "c")], [("user", "p"), ("assistant", "c")],
        [("user", "i\n\nj"), ("assistant", "o")], [("user", "i"), ("assistant", "o")], [("user", "c\n\nq"), ("assistant", "a")], [("user", "p"), ("assistant", "c")],
        [("assistant", "v")], [("tool", "t")], [("r", "")], [("", "")], [("user", "p"), ("assistant", "c")], [], [],
    ]
    mapper = cs.Mapper()
    assert [mapper.turns(r)[2] for r in records] == want
    rows = [(i, 0, json.dumps(r)) for i, r in enumerate(records)] + [(50, 0, "no json"), (51, 0, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, record string")
    got = {}
    for r in sorted(cs.canonical_turns(df).collect(), key=lambda r: r.pos):
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {i: w for i, w in enumerate(want) if w}
    assert {(r.layout, r.records) for r in cs.layouts(df).collect()} >= {("messages", 1), ("instruction", 1), (None, 2)} - {(None, 2)}
    assert cs.fingerprint({"b", "a"}) == cs.fingerprint(("a", "b")) != cs.fingerprint(("a",))


def test_deep_and_broken_records(spark):
    deep = '{"prompt": "p", "completion": "c", "more": ' + '{"a": [' * 400 + "1" + "]}" * 400 + "}"
    deeper = "[" * 200_000 + "]" * 200_000
    rows = [(1, 0, deep), (2, 0, deeper), (3, 0, "{"), (4, 0, None), (5, 0, '{"messages": []}'), (6, 0, '{"role": "user", "text": ' + "[" * 5000 + "]" * 5000 + "}")]
    got = cs.canonical_turns(spark.createDataFrame(rows, "conv_id long, turn long, record string")).collect()
    assert [(r.role, r.text) for r in got if r.conv_id == 1] == [("user", "p"), ("assistant", "c")]
    assert not [r for r in got if r.conv_id in (2, 3, 4)]
    assert cs.paths({"a": [], "b": [[{}], [1]], "c": {"d": [{"e": 1}, 2]}}) == {"a[]", "b[][]", "c.d[].e", "c.d[]"}
