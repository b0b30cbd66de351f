import datetime as dt
import hashlib
import json

from pyspark.sql import functions as F

from flowgauge.operators import asof, catalog


def test_types_of_any_depth_and_repeated_field_names(spark):
    texts = {
        "array<" * 40 + "INT" + ">" * 40: "array<" * 40 + "int" + ">" * 40,
        "struct<a int, b string>": "struct<a:int,b:string>",
        "struct<a:int,a:int>": None,
        "struct<a:int,b:struct<a:int,c:int>>": "struct<a:int,b:struct<a:int,c:int>>",
        "array<struct<x:int,y:int,x:date>>": None,
        "struct<a:int,ba:int>": "struct<a:int,ba:int>",
        "struct<ab:int,b:int,b:int>": None,
        "array<a int>": None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("type", catalog.canonical_type(F.col("text")))
    assert {r.text: r.type for r in df.collect()} == texts


def test_fingerprint_is_that_of_canonical_json(spark):
    pairs = [('a"b', "h1"), ("back\\slash", "h2"), ("é\n", "h3")]
    df = spark.createDataFrame([(1, t, h) for t, h in pairs], "version long, task_id string, text_hash string")
    want = json.dumps(sorted(map(list, pairs)), separators=(",", ":"), ensure_ascii=False)
    assert catalog.fingerprint(df).first().fingerprint == hashlib.sha256(want.encode()).hexdigest()


def test_parts_of_an_hour_count(spark):
    now = dt.datetime(2024, 1, 2, 12)
    facts = spark.createDataFrame([("a", dt.date(2024, 1, 2), now - dt.timedelta(minutes=20), "daily"), ("b", dt.date(2024, 1, 2), now - dt.timedelta(minutes=80), "daily")],
                                  "asset_name string, partition_date date, event_time timestamp_ntz, granularity string")
    targets = spark.createDataFrame([(a, dt.date(2024, 1, 2), now, h) for a in "ab" for h in (0.25, 0.5, 1.0, 1.5)],
                                    "asset_name string, target_date date, now timestamp_ntz, hours double")
    got = {(r.asset_name, r.hours): r.ready for r in asof.within(targets, facts).collect()}
    assert got == {(a, h): h * 60 >= m for a, m in (("a", 20), ("b", 80)) for h in (0.25, 0.5, 1.0, 1.5)}
    probes = targets.withColumnRenamed("now", "cutoff")
    assert {(r.asset_name, r.hours): r.ready for r in asof.within_as_of(probes, facts).collect()} == got


def test_pointers_find_documents_by_bucket_and_whole_key(spark, tmp_path):
    from flowgauge.operators import outputs

    for name, body in (("one/x/1.json", "first"), ("two/x/1.json", "second"), ("one/y.json", "third")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    documents = outputs.documents_below(spark, f"file://{tmp_path}")
    assert {(r.path, r.document) for r in documents.collect()} == {("one/x/1.json", "first"), ("two/x/1.json", "second"), ("one/y.json", "third")}
    stored = spark.createDataFrame([(1, '{"_s3_ref":"store://one/x/1.json"}'), (2, '{"_s3_ref":"store://three/x/1.json"}')], "task_no long, result string")
    assert {(r.task_no, r.document) for r in outputs.dereference(stored, documents).collect()} == {(1, "first"), (2, None)}


def test_lengths_and_logical_types_are_no_drift(spark):
    declared = spark.createDataFrame(
        [("a", "p", "id", "uuid", False), ("a", "p", "name", "varchar(20)", True), ("a", "p", "at", "timestamp_ntz", True), ("a", "p", "gone", "int", True)],
        "asset string, pipeline string, column_name string, type string, nullable boolean")
    actual = spark.createDataFrame([], "id string, name string, at bigint, new int")
    got = {(r.column_name, r.drift) for r in catalog.schema_drift(declared, actual).collect()}
    assert got == {("id", "nullability changed"), ("at", "type changed"), ("gone", "missing"), ("new", "extra")}
