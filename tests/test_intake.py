import json

from pyspark.sql import functions as F

from docketry.config import IntakeConfig
from docketry.operators import intake


def record(**changes):
    obj = {"key": "documents%2Fjob-1%2Fsource.txt", "size": 128, "eTag": "e"}
    obj.update(changes.pop("object", {}))
    base = {"eventName": "ObjectCreated:Put", "s3": {"bucket": {"name": "docs"}, "object": obj}}
    base.update(changes)
    return base


def body(*records):
    return json.dumps({"Records": list(records)})


Q, N, U, B, K = (
    intake.MALFORMED_MESSAGE, intake.MALFORMED_NOTIFICATION, intake.UNSUPPORTED_EVENT,
    intake.UNEXPECTED_BUCKET, intake.INVALID_KEY,
)

CASES = [
    ("m", body(record()), None),
    ("m", body(record(eventName="ObjectCreated:Post")), None),
    ("m", body(record(eventName=" ObjectCreated:Copy ")), None),
    ("m", body(record(object={"size": 0})), None),
    ("m", body(record(object={"eTag": None})), None),
    ("m", body(record(), record()), None),
    ("m", " " + body(record()) + "\n", None),
    (None, body(record()), Q),
    (" ", body(record()), Q),
    ("m", None, Q),
    ("m", "  ", Q),
    ("m", "{broken", Q),
    ("m", body(record()) + "x", Q),
    ("m", "[]", N),
    ("m", "{}", N),
    ("m", '{"Records":{}}', N),
    ("m", body(), N),
    ("m", body(5), N),
    ("m", body(None), N),
    ("m", body(record(eventName=None)), N),
    ("m", body(record(eventName=5)), N),
    ("m", body(record(eventName="ObjectRemoved:Delete")), U),
    ("m", body(record(eventName="ReducedRedundancyLostObject")), U),
    ("m", body(record(eventName="ObjectCreated:")), N),
    ("m", body(record(s3=None)), N),
    ("m", body(record(s3={"bucket": {"name": "docs"}})), N),
    ("m", body(record(s3={"bucket": 5, "object": {}})), N),
    ("m", body(record(s3={"bucket": {"name": 7}, "object": {}})), N),
    ("m", body(record(s3={"bucket": {"name": "other"}, "object": {}})), B),
    ("m", body(record(object={"key": 12})), N),
    ("m", body(record(object={"key": "documents%2Fjob-1%2Fother.txt"})), K),
    ("m", body(record(object={"key": "documents%2Fjob+1%2Fsource.txt"})), K),
    ("m", body(record(object={"key": "documents%2F%2Fsource.txt"})), K),
    ("m", body(record(object={"size": -1})), N),
    ("m", body(record(object={"size": True})), N),
    ("m", body(record(object={"size": "128"})), N),
    ("m", body(record(object={"size": 1.0})), N),
    ("m", body(record(object={"size": None})), N),
    ("m", body(record(object={"eTag": " "})), N),
    ("m", body(record(object={"eTag": 5})), N),
    ("m", body(record(object={"sequencer": ""})), N),
    ("m", body(record(object={"versionId": {}})), N),
    # the first bad record decides, whatever comes later
    ("m", body(record(), record(eventName="ObjectRemoved:Delete"), record(s3=None)), U),
    ("m", body(record(eventName="ObjectRemoved:Delete", s3=None)), U),
]


def test_first_error_classes(spark):
    df = spark.createDataFrame(
        [(i, m, b) for i, (m, b, _) in enumerate(CASES)], "i int, message_id string, body string"
    )
    parsed = intake.parse_messages(df, IntakeConfig(expected_bucket=" docs "))
    got = parsed.orderBy("i").select("error_class", F.size("events").alias("n")).collect()
    assert [r[0] for r in got] == [want for _, _, want in CASES]
    assert all((r[1] is None or r[1] == -1) == (w is not None) for r, (_, _, w) in zip(got, CASES))


def test_flatten_keeps_order_and_values(spark):
    first = record(object={"eTag": " t ", "sequencer": "0A", "versionId": "v1"})
    second = record(object={"key": "documents%2Fjob-2%2Fsource.txt"})
    df = spark.createDataFrame([("m", body(first, second))], "message_id string, body string")
    rows = intake.flatten_events(intake.parse_messages(df, IntakeConfig())).orderBy("rec_pos").collect()
    assert [(r.rec_pos, r.job_id, r.object_key, r.object_size) for r in rows] == [
        (0, "job-1", "documents/job-1/source.txt", 128), (1, "job-2", "documents/job-2/source.txt", 128)
    ]
    assert (rows[0].etag, rows[0].sequencer, rows[0].version_id) == ("t", "0A", "v1")
    assert rows[1].version_id is None


def test_latest_by_sequencer_compares_padded(spark):
    df = spark.createDataFrame(
        [("k", "a", 0, "FF"), ("k", "b", 0, "100"), ("k", "c", 0, None)],
        "object_key string, message_id string, rec_pos int, sequencer string",
    )
    assert [r.message_id for r in intake.latest_by_sequencer(df).collect()] == ["b"]


def test_sequencers_of_any_length(spark):
    rows = [("k", "m1", 0, "F" * 65), ("k", "m2", 0, "1" + "0" * 65), ("z", "m3", 0, "00b"), ("z", "m4", 0, "A"), ("n", "m5", 0, None)]
    df = spark.createDataFrame(rows, "object_key string, message_id string, rec_pos int, sequencer string")
    assert sorted(r.message_id for r in intake.latest_by_sequencer(df).collect()) == ["m2", "m3", "m5"]


def test_second_documents_spread_the_events_without_one(spark):
    """The join to second documents has a key that differs among the events that have none."""
    from docketry.plans.fixtures import Tables

    messages = Tables(spark, "/root/testdata/sf0.001").messages(two_records=True)
    plan = messages._jdf.queryExecution().optimizedPlan().toString()
    left = [line for line in plan.splitlines() if "Join LeftOuter" in line]
    assert len(left) == 1 and "spread" in left[0]
    assert messages.where("body LIKE '%},{%'").count() > 0


def test_every_place_of_a_message_judges_a_record_alike(spark):
    """The first record goes through plain columns, the others through array functions."""
    single = [r for _, b, _ in CASES if b and b.startswith('{"Records": [') and b.endswith("}") for r in json.loads(b)["Records"]]
    rows = [(i, place, body(*([record()] * place), r)) for i, r in enumerate(single) for place in (0, 1, 2)]
    df = spark.createDataFrame(rows, "i int, place int, body string").selectExpr("*", "'m' AS message_id")
    parsed = intake.parse_messages(df, IntakeConfig())
    got = {(r.i, r.place): (r.error_class, r.last) for r in parsed.select("i", "place", "error_class", F.get("events", F.col("place")).alias("last")).collect()}
    assert len(got) == 3 * len(single) > 90
    assert all(got[i, place] == got[i, 0] for i, place in got)


def test_a_body_is_parsed_once(spark):
    df = spark.createDataFrame([("m", body(record()))], "message_id string, body string")
    plan = intake.parse_messages(df, IntakeConfig())._jdf.queryExecution().executedPlan().toString()
    assert "from_json" not in plan.lower() and "jsontostructs" not in plan.lower()
