"""Tool calls: canonical JSON, schemas, and links and order against a plain version."""

import json
import random

import pytest
from hypothesis import given, settings, strategies as st

from docketry.llm import toolcalls as T
from docketry.llm.queries import op5_chat_formatting

SF = "/root/testdata/sf0.001"
VALUES = st.recursive(
    st.none() | st.booleans() | st.integers(-(10**20), 10**20) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=5),
    lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=8,
)


@settings(max_examples=150, deadline=None)
@given(VALUES)
def test_canonical_keeps_values(value):
    text = T.canonical(value)
    assert json.loads(text) == value and T.canonical(json.loads(text)) == text


@pytest.mark.parametrize("value,text", [
    (1.0, "1"), (1e21, "1e+21"), (1e-7, "1e-7"), (0.000001, "0.000001"), (1.5e-6, "0.0000015"), (-0.0, "0"), (123456789.5, "123456789.5"),
    ({"b": 1, "a": [True, None]}, '{"a":[true,null],"b":1}'), ({"דּ": 1, "\U0001f600": 2}, '{"\U0001f600":2,"דּ":1}'), ("é\n", '"é\\n"'),
])
def test_canonical_texts(value, text):
    assert T.canonical(value) == text


def test_schema_rules():
    tool = T.TOOLS["search"]
    assert list(T.faults({"query": "x", "limit": 50}, tool)) == []
    assert list(T.faults({"limit": 0, "more": 1}, tool)) == ["$.query required", "$.more unknown", "$.limit minimum"]
    assert list(T.faults({"query": "", "limit": True}, tool)) == ["$.limit type", "$.query length"]
    assert list(T.faults([1], tool)) == ["$ type"]
    assert list(T.faults({"pages": [1, -1, "a"]}, T.TOOLS["fetch"])) == ["$.pages[1] minimum", "$.pages[2] type"]
    for bad in ('{"a":1,"a":2}', "NaN", "{", "", None, "1e999"):
        with pytest.raises(ValueError):
            T.parse(bad)


def plain_order(calls):
    """Of the calls of one conversation, {id: (phase, level)}."""
    key = {i: (t, i) for i, t, _ in calls}
    deps = {i: {d for d in a if d in key and d != i} for i, _, a in calls}
    open_ids = {i for i in key if any(key[d] > key[i] for d in deps[i])}
    while more := {i for i in key if i not in open_ids and deps[i] & open_ids}:
        open_ids |= more
    out, left, level = {i: (0, 0) for i in key if i not in open_ids}, set(open_ids), 0
    while ready := {i for i in left if not deps[i] & left}:
        out |= {i: (1, level) for i in ready}
        left -= ready
        level += 1
    return out | {i: (2, 0) for i in left}


def test_whole_table(spark):
    conversations = spark.read.parquet(f"{SF}/conversations.parquet")
    calls, results = (df.collect() for df in T.calls_of(conversations))
    rows = op5_chat_formatting(spark, SF).collect()
    content = {(r.conv, r.call_id): r.content for r in results}
    place = {}
    for conv in {c.conv for c in calls}:
        for i, p in plain_order([(c.call_id, c.turn, c.after) for c in calls if c.conv == conv]).items():
            place[conv, i] = p
    others = [r for r in rows if r.call_id is None]
    assert len(others) == conversations.where("role not in ('user', 'assistant')").count()
    assert {r.call_status for r in others} <= {"orphan_result"}
    rows = [r for r in rows if r.call_id is not None]
    content = {k: v for k, v in content.items() if k[1] is not None}
    by_id = {(r.conv_id, r.call_id): r for r in rows}
    assert len(by_id) == len(rows) == len({(c.conv, c.call_id) for c in calls} | set(content))
    for c in calls:
        r = by_id[c.conv, c.call_id]
        assert r.call_status == ("linked" if (c.conv, c.call_id) in content else "missing_result")
        assert (r.phase, r.level) == place[c.conv, c.call_id] and (r.turn, r.name) == (c.turn, c.name)
        message = {"id": c.call_id, "name": c.name, "role": "assistant"}
        if (c.conv, c.call_id) in content:
            message["result"] = content[c.conv, c.call_id]
        try:
            message["arguments"] = json.loads(c.arguments)
            found = ";".join(T.faults(message["arguments"], T.TOOLS[c.name])) if c.name in T.TOOLS else ""
            assert (r.arguments_status, r.faults) == ("unknown_tool" if c.name not in T.TOOLS else "invalid" if found else "valid", found)
        except json.JSONDecodeError:
            message["arguments"] = c.arguments
            assert r.arguments_status == "invalid_json"
        assert json.loads(r.message) == message and r.message == T.canonical(message)
    assert {r.phase for r in rows if r.phase is not None} == {0, 1, 2}
    # sorted by the order columns, no call of phases 0 and 1 comes before what it waits for
    for conv in {c.conv for c in calls}:
        own = sorted((r.phase, r.level, r.turn, r.call_id) for r in rows if r.conv_id == conv and r.phase is not None)
        at = {x[3]: k for k, x in enumerate(own)}
        for c in calls:
            if c.conv == conv and place[conv, c.call_id][0] < 2:
                assert all(at[d] < at[c.call_id] for d in c.after if d in at and d != c.call_id)


def test_order_of_random_waits(spark):
    rng, rows = random.Random(7), []
    for conv in range(40):
        n = rng.randrange(1, 30)
        for i in range(n):
            # sparse waits give long chains, dense ones calls with several waits and cycles
            later = [f"c{j}" for j in range(i + 1, n) if rng.random() < (conv % 4) / n]
            rows.append((conv, f"c{i}", i, ([f"c{i + 1}"] if conv % 2 and i + 1 < n else later) + [f"c{rng.randrange(n)}"] * (rng.random() < 0.1)))
    calls = spark.createDataFrame(rows, "conv long, call_id string, turn long, after array<string>")
    got = {(r.conv, r.call_id): (r.phase, r.level) for r in T.order_calls(calls).collect()}
    want = {(c, i): p for c in range(40) for i, p in plain_order([r[1:2] + r[2:] for r in rows if r[0] == c]).items()}
    assert got == want and {p for p, _ in want.values()} == {0, 1, 2}
    assert max(level for _, level in want.values()) > 15


def test_edges(spark):
    calls = spark.createDataFrame(
        [
            (1, 0, "a", "search", '{"query":"x"}', ["a", "zz", None]), (1, 3, "a", "search", "{}", []), (1, 1, None, "search", None, None),
            (None, 1, "b", None, "[]", ["a"]), (2, 0, "p", "fetch", '{"pages":[]}', ["q"]), (2, 1, "q", "fetch", '{"pages":[]}', ["p"]),
            (2, 2, "r", "fetch", '{"pages":[]}', ["q"]), (2, 2, "s", "fetch", '{"pages":[]}', None),
        ],
        "conv long, turn int, call_id string, name string, arguments string, after array<string>",
    )
    results = spark.createDataFrame(
        [(1, 1, "a", "one"), (1, 2, "a", "two"), (1, 1, "none", None), (None, 1, "b", "x"), (2, 5, "s", None)],
        "conv long, turn int, call_id string, content string",
    )
    rows = T.link_calls(calls, results, T.TOOLS).collect()
    got = sorted([(r.conv, r.call_id, r.call_status, r.phase, r.unknown_waits, r.arguments_status) for r in rows], key=str)
    assert got == sorted([
        (1, "a", "linked", 0, 3, "valid"), (1, "a", "duplicate_call", None, None, "invalid"), (1, None, "missing_id", None, None, "invalid_json"),
        (None, "b", "missing_id", None, None, "unknown_tool"), (2, "p", "missing_result", 2, 0, "valid"), (2, "q", "missing_result", 2, 0, "valid"),
        (2, "r", "missing_result", 2, 0, "valid"), (2, "s", "linked", 0, 0, "valid"), (1, "a", "duplicate_result", None, None, None),
        (1, "none", "orphan_result", None, None, None), (None, "b", "orphan_result", None, None, None),
    ], key=str)
    assert next(r.message for r in rows if r.call_status == "linked" and r.conv == 1) == '{"arguments":{"query":"x"},"id":"a","name":"search","result":"one","role":"assistant"}'
    assert T.link_calls(calls.where("false"), results.where("false"), T.TOOLS).count() == 0
    assert T.link_calls(calls.where("false"), results, T.TOOLS).where("call_status = 'orphan_result'").count() == 4


def test_untrusted_arguments(spark):
    """Lone surrogates in a value or a key, and every depth, come out as rows."""
    nested = lambda n: '{"a":' * (n - 1) + "{}" + "}" * (n - 1)
    lists = lambda n: '{"a":' + "[" * (n - 1) + "]" * (n - 1) + "}"
    texts = ['{"query":"\\ud800"}', '{"\\ud800":1}', '{"query":"\\ud83d\\ude00"}', '{"query":["a",{"b":"\\udfff x"}]}', "1" * 5000, "[" * 100_000]
    texts += [f(n) for n in range(2, 2001) for f in (nested, lists)]
    calls = spark.createDataFrame([(i, i, f"c{i}", "search", t, None, "x", 1) for i, t in enumerate(texts)],
        "conv long, turn long, call_id string, name string, arguments string, after array<string>, taken string, rank int")
    results = spark.createDataFrame([], "conv long, turn long, call_id string, content string, phase int, number int")
    status = {r.conv: r for r in T.link_calls(calls, results, T.TOOLS).collect()}
    assert [status[i].arguments_status for i in range(6)] == ["invalid_json", "invalid_json", "valid", "invalid_json", "invalid_json", "invalid_json"]
    assert json.loads(status[0].message)["arguments"] == texts[0]
    for i, t in enumerate(texts[6:], 6):
        deep = t.count("{") + t.count("[") > T.MAX_DEPTH
        assert (status[i].arguments_status == "invalid_json") == deep
        assert json.loads(status[i].message)["arguments"] == (t if deep else json.loads(t))


def test_turns_of_other_roles_have_a_row(spark):
    turns = [(1, 0, "system", "rules"), (1, 1, None, "?"), (1, 2, "assistant", "hello"), (1, 3, "user", "thanks"), (1, 4, "tool", None)]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    calls, results = T.calls_of(table)
    rows = T.link_calls(calls, results, T.TOOLS).collect()
    assert sorted((r.call_status, r.result_turn) for r in rows) == [("linked", 3), ("orphan_result", 0), ("orphan_result", 1), ("orphan_result", 4)]


def test_hot_ids(spark):
    """Rows without ids, and many rows of one id, are told apart by aggregation."""
    calls = spark.range(3000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN NULL ELSE 7 END AS conv", "id AS turn", "CASE WHEN id % 3 = 1 THEN 'a' END AS call_id",
        "'search' AS name", "'{}' AS arguments", "CAST(NULL AS ARRAY<STRING>) AS after",
    )
    results = calls.selectExpr("conv", "turn", "call_id", "'x' AS content")
    got = {(r.call_status): r["count"] for r in T.link_calls(calls, results, T.TOOLS).groupBy("call_status").count().collect()}
    assert got == {"linked": 1, "duplicate_call": 999, "missing_id": 2000, "duplicate_result": 999, "orphan_result": 2000}
