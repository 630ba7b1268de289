"""The key index: exact answers, few buckets read, replays; constraints over batches; intake of repeated requests."""

from datetime import datetime

from pyspark.sql import functions as F

from millwatch.operators import constraints, ingest
from millwatch.session import scratch_dir, subfolders
from millwatch.sources import key_index

KEYS = "key string, n bigint"


def _keys(spark, numbers, n=1):
    return spark.createDataFrame([(f"K{i}", n) for i in numbers], KEYS)


def test_held_is_exact_and_asks_earlier_batches_only(spark):
    path = scratch_dir(spark, "index")
    assert key_index.held(_keys(spark, range(5)), path, 0).count() == 0
    key_index.add(_keys(spark, range(0, 3000)), path, 0)
    key_index.add(_keys(spark, range(1000, 4000), n=2), path, 1)
    asked = _keys(spark, range(500, 6000, 7))
    for _ in range(2):  # a replayed batch leaves the answers as they were
        got = {r["key"]: r["n"] for r in key_index.held(asked, path, 2).collect()}
        assert got == {f"K{i}": 3 if 1000 <= i < 3000 else 1 if i < 1000 else 2 for i in range(500, 4000, 7)}
        assert {r["n"] for r in key_index.held(asked, path, 1).collect()} == {1}
        key_index.add(_keys(spark, range(1000, 4000), n=2), path, 1)
    key_index.add(_keys(spark, []), path, 2)
    assert key_index.held(asked, path, 3).count() == 500


def test_new_keys_read_next_to_no_bucket(spark):
    path = scratch_dir(spark, "index")
    key_index.add(_keys(spark, range(20_000)), path, 0)
    new = _keys(spark, range(50_000, 50_400))
    maybe = key_index.may_hold(new, path, 1)
    assert maybe.count() <= 4
    assert key_index.may_hold(_keys(spark, range(400)), path, 1).count() == 400
    assert len(subfolders(spark, f"{path}/keys/batch=0")) == key_index.BUCKETS


def test_constraints_by_batch_equal_those_of_all_rows(spark):
    root, rules = scratch_dir(spark, "constraints"), constraints.EMPLOYEE_RULES
    schema = "id int, first_name string, last_name string, email string, department string, active boolean"
    rows = [(1, "A", "B", "x@e", None, True), (2, None, "B", "y@e", None, True), (None, "A", "B", None, None, True),
            (1, "A", None, "x@e", None, True), (3, "A", "B", "x@e", None, True), (4, "A" * 101, "B", None, None, True),
            (2, "A", "B", "z@e", None, True), (5, "A", "B", "q@e", None, True)]
    whole = spark.createDataFrame(rows, schema)
    for batch_id, part in enumerate((rows[:3], rows[3:6], rows[6:])):
        for _ in range(2 if batch_id == 1 else 1):
            constraints.check_batch(spark.createDataFrame(part, schema), rules, root, batch_id)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(constraints.violations_so_far(spark, rules, root)) == key(constraints.check_constraints(whole, rules))


def test_a_request_sent_a_million_times(spark):
    good = '{"machine_id":"V","issue_description":"leak","reporter_name":"Ann"}'
    rows = spark.range(10 ** 6).select(F.lit(7).cast("bigint").alias("request_key"), F.lit(good).alias("raw"))
    accepted, rejected = ingest.ingest_work_orders(rows, datetime(2024, 1, 30))
    assert accepted.count() == 1
    counts = rejected.groupBy("request_key", "error").count().collect()
    assert [tuple(r) for r in counts] == [(7, "id already exists", 10 ** 6 - 1)]
    blocks = rejected.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert blocks < 500_000


def test_many_texts_of_one_key(spark):
    """The first by its text is taken; finding it is an aggregate, not a window over the key."""
    text = F.concat(F.lit('{"machine_id":"V","issue_description":"leak '), F.col("id").cast("string"), F.lit('","reporter_name":"Ann"}'))
    rows = spark.range(3000).select(F.lit(7).cast("bigint").alias("request_key"), text.alias("raw"))
    accepted, rejected = ingest.ingest_work_orders(rows, datetime(2024, 1, 30))
    assert [r["issue_description"] for r in accepted.collect()] == ["leak 0"]
    assert rejected.count() == 2999
    assert "Window" not in accepted._jdf.queryExecution().executedPlan().toString()
