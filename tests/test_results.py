"""Result contract, bounds and response envelopes at their limits."""

import json

import pytest
from pyspark.sql import functions as F

from docketry.functions import variants as V
from docketry.operators import extract


def nested(depth):
    value = {"x": 1}
    for _ in range(depth - 1):
        value = {"n": value}
    return value


def lists(depth):
    value = [1]
    for _ in range(depth - 2):
        value = [value]
    return {"l": value}


BOUNDS = {
    "depth 5": (nested(5), True),
    "depth 6": (nested(6), False),
    "list depth 5": (lists(5), True),
    "list depth 6": (lists(6), False),
    "50 entries": ({str(i): i for i in range(50)}, True),
    "51 entries": ({str(i): i for i in range(51)}, False),
    "51 nested entries": ({"a": {str(i): i for i in range(51)}}, False),
    "50 items": ({"a": list(range(50))}, True),
    "51 items": ({"a": list(range(51))}, False),
    "key 100": ({"k" * 100: 1}, True),
    "key 101": ({"k" * 101: 1}, False),
    "blank key": ({"a": [{" ": 1}]}, False),
    "empty": ({}, True),
    "empty parts": ({"a": {}, "b": []}, True),
    "scalars": ({"a": None, "b": True, "c": "x", "d": 1.5, "e": 10**30}, True),
    "not an object": ([1], False),
}


def test_bounds(spark):
    rows = [(k, json.dumps(v)) for k, (v, _) in BOUNDS.items()]
    rows.append(("infinite", '{"a":[1e400]}'))
    df = spark.createDataFrame(rows, "k string, j string").withColumn("v", F.parse_json("j"))
    got = {r[0]: r[1] for r in df.select("k", V.within_bounds(F.col("v"))).collect()}
    assert got == {**{k: ok for k, (_, ok) in BOUNDS.items()}, "infinite": False}


def test_strict_json(spark):
    texts = {
        '{"a":1}': True, ' {"a":1}\n': True, "[1]": True, '"x"': True, "{} x": False, "{},{}": False,
        "{}]": False, "{}}": False, '{"a":1,"a":2}': False, '{"a":NaN}': False, "": False, "{": False,
        '{},"x"]': False,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r[0]: r[1] for r in df.select("t", V.parse_strict(F.col("t")).isNotNull()).collect()}
    assert got == texts


def result(**changes):
    base = {
        "document_type": "report", "summary": "s", "key_fields": {}, "confidence": 0.5,
        "requires_human_review": False,
    }
    base.update(changes)
    return {k: v for k, v in base.items() if v is not ...}


CONTRACT = [
    (result(), None),
    (result(summary="x" * 2000), None),
    (result(summary="  x  "), None),
    (result(summary="x" * 2001), "summary"),
    (result(summary=" " * 3), "summary"),
    (result(summary=""), "summary"),
    (result(summary=5), "summary"),
    (result(confidence=0.0), None),
    (result(confidence=1), None),
    (result(confidence=-0.01), "confidence"),
    (result(confidence=1.01), "confidence"),
    (result(confidence="0.9"), "confidence"),
    (result(confidence=True), "confidence"),
    (result(requires_human_review="true"), "requires_human_review"),
    (result(requires_human_review=1), "requires_human_review"),
    (result(document_type="letter"), "document_type"),
    (result(extra=1), "fields"),
    (result(confidence=...), "fields"),
    (result(key_fields=[]), "key_fields"),
    (result(key_fields={"a": nested(5)}), "key_fields"),
    (result(key_fields={str(i): "y" * 700 for i in range(50)}), "serialized_size"),
]


def test_contract(spark):
    rows = [(i, json.dumps(v)) for i, (v, _) in enumerate(CONTRACT)]
    df = spark.createDataFrame(rows, "i int, j string").withColumn("p", V.parse_strict(F.col("j")))
    got = extract.with_contract(df, "p").orderBy("i").select("contract_error", "result_json").collect()
    assert [r[0] for r in got] == [error for _, error in CONTRACT]
    assert json.loads(got[2][1])["summary"] == "x"


def test_serialized_size_limit(spark):
    def sized(total):
        # fifty values share the padding
        empty = result(key_fields={f"k{i:02d}": "" for i in range(50)})
        missing = total - len(json.dumps(empty, separators=(",", ":")))
        fields = {f"k{i:02d}": "y" * (missing // 50 + (i < missing % 50)) for i in range(50)}
        return json.dumps(result(key_fields=fields), separators=(",", ":"))

    rows = [(0, sized(32_768)), (1, sized(32_769))]
    df = spark.createDataFrame(rows, "i int, j string").withColumn("p", V.parse_strict(F.col("j")))
    got = extract.with_contract(df, "p").orderBy("i").select("contract_error").collect()
    assert [r[0] for r in got] == [None, "serialized_size"]


def envelope(text=None, stop="end_turn", role="assistant", blocks=None, **extra):
    blocks = [{"text": text if text is not None else json.dumps(result())}] if blocks is None else blocks
    return json.dumps({"stopReason": stop, "output": {"message": {"role": role, "content": blocks}}, **extra})


def test_envelopes(spark):
    good = json.dumps(result())
    cases = [
        (envelope(), None, "succeeded"),
        (envelope(stop="max_tokens"), None, "invalid_response"),
        (envelope(role="user"), None, "invalid_response"),
        (envelope(blocks=[]), None, "invalid_response"),
        (envelope(blocks=[{"text": good}, {"text": good}]), None, "invalid_response"),
        (envelope(blocks=[{"text": good, "type": "x"}]), None, "invalid_response"),
        (envelope(text="  "), None, "invalid_response"),
        (envelope(text="[]"), None, "invalid_response"),
        (envelope(text=good + " x"), None, "invalid_response"),
        ("not json", None, "invalid_response"),
        (None, "ModelTimeoutException", "timed_out"),
        (None, "ThrottlingException", "throttled"),
        (None, "AccessDeniedException", "configuration_error"),
        (None, "Whatever", "unavailable"),
    ]
    df = spark.createDataFrame(
        [(f"a{i:02d}", j, e) for i, (j, e, _) in enumerate(cases)],
        "attempt_id string, response_json string, error_code string",
    )
    got = extract.validate_responses(df).orderBy("attempt_id").select("verdict", "retryable", "severity").collect()
    assert [r[0] for r in got] == [want for _, _, want in cases]
    assert [r[1] for r in got] == [e is not None for _, e, _ in cases]
    assert got[11][2] == "warning" and got[10][2] == "error" and got[0][2] == "info"


def test_tolerant_metadata(spark):
    rows = [
        (0, envelope(usage={"inputTokens": 5, "outputTokens": True, "totalTokens": -1},
                     metrics={"latencyMs": 1.5}, ResponseMetadata={"RequestId": " r1 "})),
        (1, envelope(usage=[], metrics={"latencyMs": "9"}, ResponseMetadata={"RequestId": 7})),
    ]
    df = spark.createDataFrame(rows, "i int, j string").withColumn("v", F.try_parse_json("j"))
    meta = extract.response_metadata(F.col("v"))
    got = df.orderBy("i").select(*[c.alias(n) for n, c in meta.items()]).collect()
    assert got[0].asDict() == {
        "provider_request_id": "r1", "stop_reason": "end_turn", "input_tokens": 5, "output_tokens": None,
        "total_tokens": None, "provider_latency_ms": 1.5,
    }
    assert got[1]["provider_request_id"] is None and got[1]["provider_latency_ms"] is None


def test_rule_extractor_outcomes(spark):
    df = spark.createDataFrame(
        [(" Invoice 1 ", "c", "a", None), ("x", "c", "a", "timeout")],
        "document_text string, correlation_id string, attempt_id string, planned_outcome string",
    )
    ran = {r["provider_outcome"]: r["result_json"] for r in extract.rule_extractor(df).collect()}
    assert ran["timeout"] is None
    value = json.loads(ran["success"])
    assert value["document_type"] == "invoice" and value["summary"] == "Invoice 1"
    assert value["key_fields"] == {
        "character_count": 9, "word_count": 2, "correlation_id": "c", "processing_attempt_id": "a"
    }


def test_no_success_without_a_valid_result(spark):
    good = '{"document_type":"report","summary":" s ","key_fields":{"a":1},"confidence":0.5,"requires_human_review":true}'
    cases = [
        ("success", good, "success"), ("succeeded", good, "success"), ("success", '{"nonsense":1}', "invalid_response"),
        ("success", None, "invalid_response"), ("success", "{", "invalid_response"), ("timed_out", None, "timeout"),
        ("throttled", good, "throttled"), ("no such word", good, "unexpected"), (None, good, "unexpected"),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, provider_outcome string, result_json string, want string")
    rows = extract.checked(df).orderBy("i").collect()
    assert [r.provider_outcome for r in rows] == [c[2] for c in cases]
    assert [r.result_json is not None for r in rows] == [c[2] == "success" for c in cases]
    assert json.loads(rows[0].result_json)["summary"] == "s"


def test_a_bounded_extractor_runs_in_so_many_tasks(spark):
    rows = spark.range(500).selectExpr("concat('j', id) AS job_id").repartition(11)
    seen = lambda df: df.withColumn("task", F.spark_partition_id())
    assert seen(rows).select("task").distinct().count() == 11
    out = extract.bounded(seen, 5)(rows)
    assert out.select("task").distinct().count() == 5 and out.count() == 500
    with pytest.raises(ValueError):
        extract.bounded(seen, 0)


def test_only_the_responses_of_attempts_made_are_validated(spark):
    """Captured responses of other attempts are left before they are grouped."""
    captured = spark.createDataFrame(
        [("a", None, "ThrottlingException"), ("a", "{}", None), ("b", "{}", None), ("z", "{}", None)],
        "attempt_id string, response_json string, error_code string",
    )
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("c", 4)], "attempt_id string, i int")
    answered = extract.captured_extractor(captured)(rows)
    assert {(r.i, r.provider_outcome) for r in answered.collect()} == {
        (1, "throttled"), (2, "invalid_response"), (3, "invalid_response"), (4, None)
    }
    plan = answered._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_captured_responses_parse_the_messages_once(spark, monkeypatch):
    from docketry.plans import catalog, pipeline

    calls, parse = [], pipeline.parse_once
    monkeypatch.setattr(pipeline, "parse_once", lambda *a: calls.append(a) or parse(*a))
    assert catalog.all_queries()["process_captured_responses"](spark, "/root/testdata/sf0.001").count() > 0
    assert len(calls) == 1
