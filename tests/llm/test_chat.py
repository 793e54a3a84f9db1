import json
import random

import pytest

from pagelift.llm import chat

SCHEMAS = {
    "add": {"type": "object", "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": ["number", "null"]}, "tags": {"type": "array", "items": {"enum": ["x", "y"]}, "maxItems": 2}}, "required": ["a"], "additionalProperties": False},
    "say": {"type": "object", "properties": {"text": {"type": "string", "minLength": 1, "maxLength": 3}}, "additionalProperties": {"type": "boolean"}},
}


def rows(spark, found):
    return spark.createDataFrame(found, "conv_id long, turn long, role string, text string")


def formatted(spark, found, schemas=SCHEMAS):
    return {r["conv_id"]: r for r in chat.format_conversations(rows(spark, found), schemas).collect()}


def call(id_, name="add", arguments=None):
    return {"id": id_, "name": name, "arguments": {"a": 1} if arguments is None else arguments}


def said(calls, content=None):
    return json.dumps({"tool_calls": calls, "content": content})


def result(id_, content="ok"):
    return json.dumps({"tool_call_id": id_, "content": content})


def test_links_and_order(spark):
    """Results that stand before their calls follow them; parallel calls keep the turns of their results."""
    found = [(1, 0, "user", "hi"), (1, 1, "tool", result("c2")), (1, 2, "assistant", said([call("c1"), call("c2")])), (1, 4, "tool", result("c1")), (1, 3, "assistant", "wait"), (2, 0, "tool", result("c1")), (2, 1, "user", "other conversation")]
    got = formatted(spark, found)
    messages = json.loads(got[1]["conversation"])["messages"]
    assert [m.get("tool_call_id", m["role"]) for m in messages] == ["user", "assistant", "c2", "assistant", "c1"]
    assert (got[1]["calls"], got[1]["results"], got[1]["unlinked"], got[1]["invalid"]) == (2, 2, 0, 0)
    assert (got[2]["results"], got[2]["unlinked"]) == (1, 1)
    for m in messages:
        if "tool_call_id" in m:
            at = messages.index(m)
            assert any(c["id"] == m["tool_call_id"] for x in messages[:at] for c in x.get("tool_calls", []))


@pytest.mark.parametrize(
    "name, arguments, bad",
    [("add", {"a": 1}, 0), ("add", {"a": 1.0, "b": None, "tags": ["x", "y"]}, 0), ("add", {}, 1), ("add", {"a": -1}, 1), ("add", {"a": True}, 1), ("add", {"a": 1, "z": 2}, 1), ("add", {"a": 1, "tags": ["q"]}, 1), ("add", {"a": 1, "tags": ["x"] * 3}, 1), ("add", [], 1), ("say", {"text": ""}, 1), ("say", {"text": "abcd"}, 1), ("say", {"text": "abc", "more": True}, 0), ("say", {"more": 1}, 1), ("none", {}, 1)],
)
def test_arguments(name, arguments, bad):
    for given in (arguments, json.dumps(arguments)):
        _, errors = chat._call({"id": "1", "function": {"name": name, "arguments": given}}, SCHEMAS)
        assert len(errors) == bad, errors


def test_calls_within_text():
    text = 'Let me see. <tool_call>{"name": "add", "id": "7", "arguments": {"b": 2, "a": 1}}</tool_call>'
    message, ids, answers, errors = chat.parse("assistant", text, SCHEMAS)
    assert message["content"] == "Let me see." and ids == ["7"] and answers is None and errors == []
    assert chat.canonical(message["tool_calls"]) == '[{"arguments":{"a":1,"b":2},"id":"7","name":"add"}]'
    message, ids, _, errors = chat.parse("assistant", "<tool_call>{bad</tool_call>", SCHEMAS)
    assert message["content"] == "<tool_call>{bad</tool_call>" and errors == ["call: not JSON"] and ids == []


@pytest.mark.parametrize("text", ['{"a": NaN}', '{"a": 1, "a": 2}', "{", "{}", "[1]", '{"tool_calls": 3}', "{" * 5000])
def test_other_json_is_content(text):
    assert chat.parse("assistant", text, SCHEMAS)[0] == {"content": text, "role": "assistant"}


def test_canonical():
    assert chat.canonical({"b": "é\n\"", "a": [1, 2.5, None, True]}) == '{"a":[1,2.5,null,true],"b":"é\\n\\""}'
    assert chat.canonical("a\ud800\ud83d\ude00") == '"a\ufffd\U0001f600"'


def test_odd_rows(spark):
    found = [(None, 1, "user", "a"), (None, 0, None, None), (1, None, "assistant", "first"), (1, 0, "user", "same"), (1, 0, "user", "same"), (1, 0, "system", "z"), (1, 5, "robot", "x" * 200_000), (1, 6, "assistant", said([{"name": 3}, "no", call("d"), call("d")]))]
    got = formatted(spark, found)
    assert [(m["role"], m["content"][:5]) for m in json.loads(got[1]["conversation"])["messages"][:5]] == [("assistant", "first"), ("system", "z"), ("user", "same"), ("user", "same"), ("robot", "xxxxx")]
    assert [m["content"] for m in json.loads(got[None]["conversation"])["messages"]] == ["", "a"]
    assert got[1]["invalid"] == 1 and got[1]["calls"] == 2 and got[1]["duplicate"] == 1
    assert all(e.startswith("5: ") for e in got[1]["errors"]) and len(got[1]["errors"]) >= 3
    assert chat.format_conversations(rows(spark, found).limit(0)).count() == 0


def test_a_long_conversation_is_in_parts(spark):
    found = [(1, i, "user" if i % 2 else "assistant", f"m{i}") for i in range(1700)] + [(c, 0, "user", "x") for c in range(2, 40)]
    got = chat.format_conversations(rows(spark, found)).collect()
    parts = sorted((r["part"], r) for r in got if r["conv_id"] == 1)
    assert [r["messages"] for _, r in parts] == [500, 500, 500, 200]
    assert [m["content"] for _, r in parts for m in json.loads(r["conversation"])["messages"]] == [f"m{i}" for i in range(1700)]


def brute_links(found, schemas):
    """Order, counts and errors of one conversation, by the definition: each result after the first call of its identifier."""
    def key(r):
        role = r[2] or "user"
        return (r[1], chat.ROLES.index(role) if role in chat.ROLES else len(chat.ROLES))

    parsed = [(r, *chat.parse(r[2], r[3], schemas)) for r in sorted(found, key=key)]
    first, seen = {}, 0
    for r, _, ids, _, _ in parsed:
        for i in ids:
            seen += 1
            first.setdefault(i, r[1])
    place = lambda r, answers: (max(r[1], first[answers]), 1) if answers in first else (r[1], 0)
    order = sorted(parsed, key=lambda x: (*place(x[0], x[3]), x[0][1]))
    return {"messages": [m for _, m, *_ in order], "unlinked": sum(a is not None and a not in first for *_, a, _ in parsed), "duplicate": seen - len(first), "errors": [f"{k}: {e}" for k, (*_, es) in enumerate(order) for e in sorted(es)]}


def test_linking_against_brute_force(spark):
    """Generated conversations with parallel, repeated, missing and early results, and arguments that break the schemas."""
    draw = random.Random(5)
    found = []
    for conv in range(25):
        turn = 0
        for _ in range(draw.randint(2, 14)):
            kind, turn = draw.randrange(4), turn + 1
            names = [f"c{draw.randrange(5)}" for _ in range(draw.randint(1, 3))]
            if kind == 0:
                found.append((conv, turn, "user", f"text {turn}"))
            elif kind == 1:
                found.append((conv, turn, "assistant", said([call(n, draw.choice(["add", "say", "none"]), draw.choice([{"a": 1}, {"text": "abcd"}, {}])) for n in names])))
            else:
                found.append((conv, turn, "tool", result(names[0], turn)))
    got = formatted(spark, draw.sample(found, len(found)))
    for conv in range(25):
        want = brute_links([r for r in found if r[0] == conv], SCHEMAS)
        r = got[conv]
        assert json.loads(r["conversation"])["messages"] == want["messages"], conv
        assert (r["unlinked"], r["duplicate"], list(r["errors"])) == (want["unlinked"], want["duplicate"], want["errors"])


def test_against_brute_force(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    want: dict = {}
    for r in sorted(table.collect(), key=lambda r: (r["conv_id"], r["turn"])):
        want.setdefault(r["conv_id"], []).append({"content": r["text"], "role": r["role"]})
    got = {r["conv_id"]: r["conversation"] for r in chat.format_conversations(table).collect()}
    assert got == {c: json.dumps({"messages": m}, ensure_ascii=False, sort_keys=True, separators=(",", ":")) for c, m in want.items()}
