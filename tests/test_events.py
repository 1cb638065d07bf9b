"""Object-created events."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tripflow import operators as op


def ref(bucket=None, key=None):
    named = {}
    if bucket is not None:
        named["bucket"] = {"name": bucket}
    if key is not None:
        named["object"] = {"key": key}
    return named


def event(detail=None, *records):
    body = {"detail": detail} if detail is not None else {}
    if records:
        body["Records"] = [{"s3": r} for r in records]
    return json.dumps(body)


def frame(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, json string")


def normalized(spark, text):
    row = op.normalize_object_events(frame(spark, text), "json").first()
    return row.bucket, row.key


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        (event(ref("b1", "k1.csv")), ("b1", "k1.csv")),
        (event(None, ref("b2", "k2.CSV"), ref("b2", "k3.txt")), ("b2", "k2.CSV")),
        (event(ref("b1"), ref("b3", "k4.csv")), ("b3", "k4.csv")),
        (event(ref(None, "k"), ref("b3", "k4.csv")), ("b3", "k4.csv")),
        (event(ref("", "k"), ref("b3", "k4.csv")), ("b3", "k4.csv")),
        (event(ref("b1", "k1.csv"), ref("b3", "k4.csv")), ("b1", "k1.csv")),
        (event(ref("b1", "k1.csv"), {}), ("b1", "k1.csv")),
    ],
)
def test_normalize(spark, text, expected):
    assert normalized(spark, text) == expected


def test_normalize_ignores_later_records_of_another_type(spark):
    text = '{"Records":[{"s3":{"bucket":{"name":"b"},"object":{"key":"k"}}}, {"s3": 5}]}'
    assert normalized(spark, text) == ("b", "k")


REJECTED = [
    "{}",
    "notjson",
    "",
    None,
    "[]",
    "5",
    event(ref("b1")),
    event(ref("b1", "")),
    event(None, {}, ref("b", "second.csv")),
    event(None, ref("", "k")),
    '{"Records": []}',
    '{"Records": {}}',
    '{"Records": [{}]}',
    '{"detail": null}',
    '{"detail": {"bucket": null, "object": {"key": "k"}}}',
]


def test_split_is_a_partition_of_the_events(spark):
    good = [event(ref("b1", "k1.csv")), event(None, ref("b2", "k.txt"))]
    events = op.normalize_object_events(frame(spark, *good, *REJECTED), "json")
    valid, rejected = op.split_valid_events(events)
    assert sorted(r.id for r in valid.collect()) == [0, 1]
    assert sorted(r.id for r in rejected.collect()) == list(range(2, 2 + len(REJECTED)))


names = st.sampled_from([None, "", "a", "b.csv"])
part = st.one_of(st.none(), st.fixed_dictionaries({}, optional={"name": names, "key": names}))
refs = st.one_of(st.none(), st.fixed_dictionaries({}, optional={"bucket": part, "object": part}))
records = st.lists(st.one_of(st.none(), st.fixed_dictionaries({}, optional={"s3": refs})), max_size=3)
shapes = st.fixed_dictionaries({}, optional={"detail": refs, "Records": st.one_of(st.none(), records)})


def both(named):
    """The pair a reference names, or None unless it names both parts."""
    at = lambda field, name: ((named or {}).get(field) or {}).get(name)
    pair = at("bucket", "name"), at("object", "key")
    return pair if all(pair) else None


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(shapes, min_size=30, max_size=60))
def test_against_python(spark, events):
    df = frame(spark, *map(json.dumps, events))
    valid, rejected = op.split_valid_events(op.normalize_object_events(df, "json"))
    found = {r.id: (r.bucket, r.key) for r in valid.collect()}
    missing = {r.id for r in rejected.collect()}
    records_of = [[(r or {}).get("s3") for r in e.get("Records") or []] for e in events]
    expected = [both(e.get("detail")) or both(next(iter(rs), None)) for e, rs in zip(events, records_of, strict=True)]
    assert found == {i: pair for i, pair in enumerate(expected) if pair}
    assert missing == {i for i, pair in enumerate(expected) if not pair}
    csv = op.only_csv_objects(op.explode_object_records(df, "json"))
    listed = sorted((r.id, r.bucket, r.key) for r in csv.where("bucket != ''").collect())
    pairs = ((i, both(r)) for i, rs in enumerate(records_of) for r in rs)
    assert listed == sorted((i, *pair) for i, pair in pairs if pair and pair[1].endswith(".csv"))


def test_other_columns_stay(spark):
    assert op.normalize_object_events(frame(spark, "{}"), "json").columns == ["id", "json", "bucket", "key"]
    assert op.explode_object_records(frame(spark, "{}"), "json").columns == ["id", "bucket", "key"]


def exploded(spark, *texts):
    rows = op.explode_object_records(frame(spark, *texts), "json").collect()
    return sorted((r.id, r.bucket, r.key) for r in rows)


def test_explode_takes_every_record(spark):
    texts = [
        event(ref("b1", "k1.csv")),
        event(None, ref("b2", "k2.CSV"), ref("b2", "k3.txt")),
        event(ref("b1"), ref("b3", "k4.csv")),
        "{}",
        "notjson",
        None,
        '{"Records": []}',
        '{"Records": null}',
    ]
    assert exploded(spark, *texts) == [(1, "b2", "k2.CSV"), (1, "b2", "k3.txt"), (2, "b3", "k4.csv")]


def test_a_malformed_record_drops_out_alone(spark):
    assert exploded(spark, event(None, {}, ref("b"), ref("b", "k.csv"))) == [(0, "b", "k.csv")]


def test_many_records_in_one_event(spark):
    records = [ref("b", f"{i}.csv") for i in range(5000)]
    assert len(exploded(spark, event(None, *records))) == 5000


def test_csv_filter(spark):
    keys = ["a.csv", "b.CSV", "c.CsV", "d.csv.part", "e.txt", "csv", ".csv", "", None, "x/y.csv"]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    kept = [r.key for r in op.only_csv_objects(df).collect()]
    assert sorted(kept) == sorted(["a.csv", "b.CSV", "c.CsV", ".csv", "x/y.csv"])


def test_object_uri(spark):
    df = spark.createDataFrame([("b", "incoming/a b.csv"), ("b", None)], "bucket string, key string")
    assert [r.uri for r in op.with_object_uri(df).collect()] == ["s3a://b/incoming/a b.csv", None]


@pytest.mark.parametrize(
    ("key", "path"),
    [
        ("a.csv", "/mnt/efs/incoming/a.csv"),
        ("incoming/a.csv", "/mnt/efs/incoming/incoming/a.csv"),
        ("x//y.csv", "/mnt/efs/incoming/x/y.csv"),
        ("x/././y.csv", "/mnt/efs/incoming/x/y.csv"),
        ("x/.hidden/y.csv", "/mnt/efs/incoming/x/.hidden/y.csv"),
        ("a%20b+c.csv", "/mnt/efs/incoming/a%20b+c.csv"),
        ("/x.csv", "/mnt/efs/incoming/x.csv"),
        ("./x.csv", "/mnt/efs/incoming/x.csv"),
        (".x./y.csv", "/mnt/efs/incoming/.x./y.csv"),
        ("a..b/..c/d...csv", "/mnt/efs/incoming/a..b/..c/d...csv"),
        ("../x.csv", None),
        ("x/../../y.csv", None),
        ("x/..", None),
        ("..", None),
    ],
)
def test_landing_path(spark, key, path):
    df = spark.createDataFrame([(key,)], "key string")
    for mount in ("/mnt/efs", "/mnt/efs/"):
        row = op.with_landing_path(df, mount, "incoming").first()
        assert (row.path, row.partial_path) == (path, path and f"{path}.part")


def test_operators_work_on_a_stream_of_events(spark, tmp_path):
    texts = [event(ref("b1", "k1.csv")), event(None, ref("b2", "k2.CSV"), ref("b2", "k3.txt")), "{}", "notjson"]
    (tmp_path / "events").mkdir()
    (tmp_path / "events" / "1.json").write_text("\n".join(texts))
    stream = spark.readStream.text(str(tmp_path / "events"))

    def run(df, name):
        query = df.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"{name}-checkpoint"))
        query.trigger(availableNow=True).start(str(tmp_path / name)).awaitTermination()
        return sorted(tuple(row) for row in spark.read.parquet(str(tmp_path / name)).collect())

    valid, rejected = op.split_valid_events(op.normalize_object_events(stream, "value"))
    assert run(op.with_object_uri(valid).select("uri"), "valid") == [("s3a://b1/k1.csv",), ("s3a://b2/k2.CSV",)]
    assert run(rejected.select("value"), "rejected") == [("notjson",), ("{}",)]
    csv = op.only_csv_objects(op.explode_object_records(stream, "value"))
    assert run(csv, "csv") == [("b2", "k2.CSV")]


def test_landing_path_below_a_uri(spark):
    df = spark.createDataFrame([("x//y.csv",)], "key string")
    assert op.with_landing_path(df, "s3a://bucket", "incoming/").first().path == "s3a://bucket/incoming/x/y.csv"
    assert op.with_landing_path(df, "s3a://bucket/", "").first().path == "s3a://bucket/x/y.csv"


def test_filters_do_not_parse_again(spark):
    events = op.normalize_object_events(frame(spark, "{}"), "json")
    for side in op.split_valid_events(events):
        plan = side._jdf.queryExecution().executedPlan().toString()
        assert plan.count("from_json") == 1
