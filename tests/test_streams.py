"""Envelopes and streaming jobs: order of arrival, replays, restarts, deletes and junk."""

import json
import random
from datetime import date, datetime, timedelta

import pytest

from millwatch import schemas
from millwatch.functions.times import since
from millwatch.operators import changes
from millwatch.operators.latest import folded_variants, latest_readings
from millwatch.plans.machine import changes_from_transitions, machine_status_changes
from millwatch.session import scratch_dir, subfolders
from millwatch.sources import changelog, tables
from millwatch.sources.change_feed import read_change_stream
from millwatch.streaming import jobs, stateful

START = datetime(2024, 1, 30)
CHANGE = "seq bigint, changed_at timestamp_ntz, machine_id int, machine_name string, status string, type string, " \
         "datetime timestamp_ntz, deleted boolean"


def _change(seq, name, status, deleted=False):
    at = START + timedelta(minutes=seq)
    return (seq, at, 1, name, status, "valve", at, deleted)


def _published(df):
    return {r["seq"]: json.loads(r["value"]) for r in df.select("seq", "value").collect()}


def _rows(df):
    return sorted(map(tuple, df.select(*schemas.FEED.fieldNames()).collect()), key=str)


SOME = [_change(1, "A", "operational"), _change(2, "A", "down"), _change(3, "B", "down"), _change(4, "A", "down"),
        _change(5, "A", None, deleted=True), _change(6, "A", "warning"), _change(7, "Ghost", None, deleted=True)]


def test_envelopes(spark):
    got = _published(changes.envelope_json(changes.change_envelopes(spark.createDataFrame(SOME, CHANGE))))
    assert [got[s]["operation"] for s in sorted(got)] == ["INSERT", "UPDATE", "INSERT", "UPDATE", "DELETE", "INSERT"]
    assert got[1]["old_data"] is None and got[1]["table"] == "machine_feed_stream"
    assert got[1]["timestamp"] == (START + timedelta(minutes=1) - datetime(1970, 1, 1)).total_seconds()
    assert got[2]["old_data"] == {**got[1]["new_data"]} and got[2]["new_data"]["datetime"] == "2024-01-30T00:02:00"
    # an update that changes nothing but the time still counts, a delete has no new image
    assert got[4]["old_data"]["status"] == got[4]["new_data"]["status"] == "down"
    assert "new_data" not in got[5] and got[5]["old_data"]["status"] == "down"


def test_envelopes_with_known_rows(spark, feed_of):
    known = feed_of((9, "A", "warning", "valve", "2024-01-01 00:00"), (8, None, "warning", "valve", "2024-01-01 00:00"))
    changed = spark.createDataFrame([_change(1, "A", "down"), _change(2, "A", None, True), _change(3, "A", "down"), _change(4, None, "down")], CHANGE)
    got = _published(changes.envelope_json(changes.change_envelopes(changed, known)))
    assert [got[s]["operation"] for s in sorted(got)] == ["UPDATE", "DELETE", "INSERT", "UPDATE"]
    assert got[1]["old_data"]["machine_id"] == 9 and got[3]["old_data"] is None and got[4]["old_data"]["machine_id"] == 8


def test_parsing_tells_readings_from_junk(spark):
    new = '{"machine_id":1,"machine_name":"A","status":"down","type":"valve","datetime":"2024-01-30T00:00:00.25"}'
    messages = spark.createDataFrame([(m,) for m in [
        '{"operation":"INSERT","table":"t","timestamp":1.5,"new_data":%s,"old_data":null}' % new,
        '{"operation":"DELETE","table":"t","timestamp":1.5,"old_data":%s}' % new,
        '{"operation":"UPDATE","table":"t","timestamp":1.5,"new_data":{"machine_name":null}}',
        '{"operation":"UPDATE","table":"t","timestamp":1.5,"new_data":{"machine_name":""}}',
        '{"operation":"UPDATE","table":"t","timestamp":1.5,"new_data":%s}' % new.replace("2024-01-30T00:00:00.25", "garbage"),
        '{"new_data":%s}' % new, '{"operation":"INS', "", "42", "{}", None]], "value string")
    parsed = changes.parse_envelopes(messages)
    readings = changes.readings_of(parsed).collect()
    assert [(r["machine_name"], r["datetime"]) for r in readings] == [("A", datetime(2024, 1, 30, 0, 0, 0, 250000))] * 2
    dead = sorted(map(str, (r["value"] for r in changes.dead_letters(parsed).collect())))
    assert [d for d in dead if "garbage" not in d] == ["", "42", "None", '{"operation":"INS', "{}"] and len(dead) == 6


def test_a_reading_without_a_time_does_not_pin_its_machine(spark, feed_of):
    snapshot = feed_of((1, "A", "down", "valve", None), (2, "B", "down", "valve", None))
    later = feed_of((1, "A", "operational", "valve", "2024-01-30 00:00"))
    got = changes.fold_latest(snapshot, later).collect()
    assert {r["machine_name"]: r["status"] for r in got} == {"A": "operational", "B": "down"}
    # the batch report keeps counting a missing time as newest
    assert {r["machine_name"]: r["status"] for r in latest_readings(snapshot.unionByName(later)).collect()} == {"A": "down", "B": "down"}


def test_diff(spark, feed_of):
    old = feed_of((1, "A", "down", "valve", "2024-01-01 00:00"), (2, "B", "down", "valve", "2024-01-01 00:00"), (3, "C", None, "valve", None))
    new = feed_of((1, "A", "operational", "valve", "2024-01-01 00:00"), (3, "C", None, "valve", None), (4, "D", "down", "valve", "2024-01-01 00:00"))
    diff = changes.diff_snapshots(old, new, START)
    got = {r["machine_name"]: json.loads(r["value"]) for r in changes.envelope_json(diff).collect()}
    assert {k: v["operation"] for k, v in got.items()} == {"A": "UPDATE", "B": "DELETE", "D": "INSERT"}
    # folding the diff into the old snapshot gives the new one, but for deletes, which carry no reading
    folded = changes.fold_latest(old, changes.readings_of(changes.parse_envelopes(changes.envelope_json(diff))))
    assert {r["machine_name"]: r["status"] for r in folded.collect()} == {"A": "operational", "B": "down", "C": None, "D": "down"}


def test_set_status(spark, feed_of):
    snapshot = feed_of((1, "A", "operational", "valve", "2024-01-01 00:00"))
    updates = spark.createDataFrame([("A", "down", START), ("Nobody", "down", START)], "machine_name string, status string, datetime timestamp_ntz")
    assert _rows(changes.set_status(snapshot, updates)) == [(1, "A", "down", "valve", START)]


def _messages(n=60, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        image = {"machine_id": i % 4, "machine_name": f"M{i % 4}", "status": rng.choice(["operational", "down", "warning"]),
                 "type": "valve", "datetime": (START + timedelta(hours=i)).isoformat()}
        out.append(json.dumps({"operation": "UPDATE", "table": "t", "timestamp": float(i), "new_data": image, "old_data": image}))
    return out


def _send(spark, inbox, texts):
    spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1).write.mode("append").text(inbox)


def _follow(spark, inbox, root):
    jobs.follow_changes(read_change_stream(spark, inbox), root, once=True).awaitTermination()


def _keep(spark, inbox, root, **more):
    jobs.follow_state(read_change_stream(spark, inbox), root, once=True, **more).awaitTermination()


def test_shuffled_arrival_gives_the_same_tables(spark):
    texts = _messages()
    random.Random(3).shuffle(texts)
    root, inbox = scratch_dir(spark, "follow"), scratch_dir(spark, "inbox")
    for part in (texts[:10], texts[10:45], texts[45:]):
        _send(spark, inbox, part)
        _follow(spark, inbox, root)
        _keep(spark, inbox, root)
    whole = changes.readings_of(changes.parse_envelopes(spark.createDataFrame([(t,) for t in texts], "value string")))
    history = tables.read_history(spark, f"{root}/history")
    assert _rows(history) == _rows(whole)
    assert _rows(jobs.current_snapshot(spark, root)) == _rows(latest_readings(whole))
    assert history.select("batch_id").distinct().count() == 3


def test_replayed_batch_changes_nothing(spark):
    """A batch that runs twice, as after a crash before its commit, leaves the tables as they were."""
    root, inbox = scratch_dir(spark, "follow"), scratch_dir(spark, "inbox")
    texts = _messages()
    handled = {}

    def run_twice(stream):
        real = jobs._start

        def start(stream, root, handle, once, **more):
            def twice(batch, batch_id):
                handle(batch, batch_id)
                handle(batch, batch_id)
                handled[batch_id] = True
            return real(stream, root, twice, once, **more)

        jobs._start = start
        try:
            jobs.follow_changes(stream, root, once=True).awaitTermination()
            jobs.follow_state(stream, root, once=True).awaitTermination()
        finally:
            jobs._start = real

    for part in (texts[:30], texts[30:] + ["junk"]):
        _send(spark, inbox, part)
        run_twice(read_change_stream(spark, inbox))
    assert len(handled) == 2
    assert tables.read_history(spark, f"{root}/history").count() == 60
    assert tables.read_table(spark, f"{root}/messages", schemas.MESSAGE).count() == 61
    assert [r["value"] for r in tables.read_dead_letters(spark, f"{root}/messages").collect()] == ["junk"]
    assert jobs.current_snapshot(spark, root).count() == 4


def test_batches_write_only_what_they_change(spark, monkeypatch):
    root, inbox = scratch_dir(spark, "follow"), scratch_dir(spark, "inbox")
    texts = _messages(24)
    for i in range(6):
        _send(spark, inbox, texts[4 * i:4 * i + 4] if i < 3 else texts[4 * i:4 * i + 1])  # from the fourth on, M0 only
        _keep(spark, inbox, root)
        if i == 2:
            early = jobs.current_variants(spark, root)
            before = _sorted(early)
    sent = texts[:12] + [texts[i] for i in (12, 16, 20)]
    whole = changes.readings_of(changes.parse_envelopes(spark.createDataFrame([(t,) for t in sent], "value string")))
    assert _rows(jobs.current_snapshot(spark, root)) == _rows(latest_readings(whole))
    names = [{r[0] for r in spark.read.parquet(f"{root}/state/batch={b}").select("machine_name").collect()} for b in range(6)]
    assert names == [{"M0", "M1", "M2", "M3"}] * 3 + [{"M0"}] * 3
    # a reader that began three batches ago still reads the same rows, and folding changes none
    assert _sorted(early) == before
    now = _sorted(jobs.current_variants(spark, root))
    changelog.fold(spark, f"{root}/state", schemas.VARIANTS, folded_variants)
    assert _sorted(jobs.current_variants(spark, root)) == now
    changelog.clean(spark, f"{root}/state")
    assert subfolders(spark, f"{root}/state") == ["fold=5"]
    monkeypatch.setattr(jobs, "FOLD_EVERY", 1)  # the job folds as well, and goes on from its own state
    _send(spark, inbox, texts[23:])
    _keep(spark, inbox, root)
    assert "fold=6" in subfolders(spark, f"{root}/state")
    late = whole.unionByName(changes.readings_of(changes.parse_envelopes(spark.createDataFrame([(texts[23],)], "value string"))))
    assert _rows(jobs.current_snapshot(spark, root)) == _rows(latest_readings(late))


def _sorted(df):
    return sorted(map(str, df.collect()))


def test_state_starts_from_initial_readings(spark, feed_of):
    root, inbox = scratch_dir(spark, "follow"), scratch_dir(spark, "inbox")
    initial = feed_of((1, "M1", "down", "valve", "2023-01-01 00:00"), (9, "Quiet_01", "warning", "valve", "2023-01-01 00:00"))
    floor = spark.createDataFrame([(0, "L", 0, "M1"), (0, "L", 1, "Quiet_01"), (0, "L", 2, "Never")], "line_order int, line string, position int, name string")
    _send(spark, inbox, [t for t in _messages() if '"M1"' in t])
    _keep(spark, inbox, root, initial=initial)
    shown = {r["name"]: r["status"] for r in jobs.current_floor(spark, root, floor).collect()}
    last = json.loads([t for t in _messages() if '"M1"' in t][-1])["new_data"]["status"]
    assert shown == {"M1": last, "Quiet_01": "warning", "Never": "unknown"}


def test_compaction_keeps_every_row(spark):
    root, inbox = scratch_dir(spark, "follow"), scratch_dir(spark, "inbox")
    path, texts = f"{root}/history", _messages()
    undated = json.dumps({"operation": "UPDATE", "table": "t", "timestamp": 1.0, "new_data": {"machine_name": "M1", "status": "down"}})

    def feed(part):
        _send(spark, inbox, part)
        _follow(spark, inbox, root)

    def rows():
        return _sorted(tables.read_history(spark, path))

    feed(texts[:40])
    feed(texts[40:] + [undated])
    want = rows()
    tables.compact(spark, path, schemas.HISTORY, "event_date", date(2024, 1, 31), batch=1)
    assert rows() == want
    tables.clean(spark, path, "event_date")
    assert rows() == want and "event_date=2024-01-30" in subfolders(spark, path)
    feed([texts[0], texts[30]])  # late for the closed day
    want = rows()
    assert len(want) == 63
    tables.compact(spark, path, schemas.HISTORY, "event_date", date(2024, 2, 1), batch=2)
    tables.clean(spark, path, "event_date")
    assert rows() == want
    recent = since(tables.read_history(spark, path), "datetime", datetime(2024, 2, 2), 1)
    assert recent.count() == 60 - 48


def test_look_back_prunes_history_partitions(spark):
    root, inbox = scratch_dir(spark, "follow"), scratch_dir(spark, "inbox")
    _send(spark, inbox, _messages())
    _follow(spark, inbox, root)
    recent = since(tables.read_history(spark, f"{root}/history"), "datetime", datetime(2024, 2, 2), 1)
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "GreaterThanOrEqual(datetime" in plan
    assert recent.count() == 60 - 48


def test_publish_joins_batches_by_arrival(spark):
    root, inbox = scratch_dir(spark, "publish"), scratch_dir(spark, "inbox")
    for part in (SOME[:2], SOME[2:4], SOME[4:]):
        spark.createDataFrame(part, CHANGE).coalesce(1).write.mode("append").parquet(inbox)
        jobs.publish_changes(spark.readStream.schema(CHANGE).parquet(inbox), root, once=True).awaitTermination()
    got = _published(tables.read_table(spark, f"{root}/envelopes", schemas.PUBLISHED))
    assert got == _published(changes.envelope_json(changes.change_envelopes(spark.createDataFrame(SOME, CHANGE))))


def test_streams_leave_no_scratch(spark):
    """Ten batches of changes with a hot machine; the images are in the checkpoint, so a deleted machine's is gone as well."""
    root, inbox = scratch_dir(spark, "publish"), scratch_dir(spark, "inbox")
    rows, seq = [], 0
    rng, before = random.Random(8), None
    for batch in range(10):
        part = []
        for _ in range(30):
            seq += 1
            part.append(_change(seq, rng.choice(["Hot", "Hot", "Hot", None, f"M{seq % 5}"]), rng.choice(["down", "operational", None]), rng.random() < .2))
        rng.shuffle(part)
        rows += part
        spark.createDataFrame(part, CHANGE).coalesce(1).write.mode("append").parquet(inbox)
        before = before or subfolders(spark, spark.conf.get("spark.checkpoint.dir"))
        jobs.publish_changes(spark.readStream.schema(CHANGE).parquet(inbox), root, once=True).awaitTermination()
    assert subfolders(spark, spark.conf.get("spark.checkpoint.dir")) in (before, sorted({*before, root.rsplit("/", 1)[1]}))
    got = _published(tables.read_table(spark, f"{root}/envelopes", schemas.PUBLISHED))
    assert got == _published(changes.envelope_json(changes.change_envelopes(spark.createDataFrame(rows, CHANGE))))


CLOCK = json.dumps({"operation": "INSERT", "table": "t", "timestamp": 0.0, "new_data": {"machine_name": "Clock", "datetime": "2025-01-01T00:00:00"}})


def _state_rows(query):
    query.awaitTermination()
    return max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"])


def test_published_machines_share_calls_and_state(spark, monkeypatch):
    """A call and a state for each bucket that has rows, however many machines; each machine keeps its own image."""
    monkeypatch.setattr(stateful, "BUCKETS", 3, raising=False)
    root, inbox, rng = scratch_dir(spark, "publish"), scratch_dir(spark, "inbox"), random.Random(5)
    rows = [_change(i, rng.choice([None, *(f"M{m}" for m in range(12))]), rng.choice(["down", None]), rng.random() < .2) for i in range(120)]
    rows += [_change(200 + m, f"M{m}", "down") for m in range(12)]
    for part in (rows[:60], rows[60:]):
        spark.createDataFrame(rng.sample(part, len(part)), CHANGE).coalesce(1).write.mode("append").parquet(inbox)
        assert _state_rows(jobs.publish_changes(spark.readStream.schema(CHANGE).parquet(inbox), root, once=True)) <= 3
    got = _published(tables.read_table(spark, f"{root}/envelopes", schemas.PUBLISHED))
    assert got == _published(changes.envelope_json(changes.change_envelopes(spark.createDataFrame(rows, CHANGE))))


def test_machines_in_order_share_calls_and_state(spark, monkeypatch):
    monkeypatch.setattr(stateful, "BUCKETS", 2, raising=False)
    root, inbox = scratch_dir(spark, "follow"), scratch_dir(spark, "inbox")
    texts = [t.replace('"M', f'"{line}') for t in _messages(40) for line in "XYZ"]
    random.Random(6).shuffle(texts)
    for part in (texts, [CLOCK]):
        _send(spark, inbox, part)
        assert _state_rows(jobs.follow_transitions(read_change_stream(spark, inbox), root, "40 hours", once=True)) <= 2
    whole = changes.readings_of(changes.parse_envelopes(spark.createDataFrame([(t,) for t in texts], "value string")))
    streamed, now = tables.read_table(spark, f"{root}/transitions", schemas.TRANSITIONS), datetime(2024, 2, 4)
    assert streamed.count() == 120
    assert _sorted(changes_from_transitions(streamed, now, 5)) == _sorted(machine_status_changes(whole, now, 5))


def test_transitions_come_in_order_within_the_delay(spark):
    """Each arrival is shuffled and reaches two hours into the one before it; a restart lies between all of them."""
    rng, root, inbox = random.Random(4), scratch_dir(spark, "follow"), scratch_dir(spark, "inbox")
    texts = _messages(80, seed=9) + _messages(8, seed=10)  # the second ones share times with the first
    texts.sort(key=lambda t: json.loads(t)["new_data"]["datetime"])
    undated = json.dumps({"operation": "UPDATE", "table": "t", "timestamp": 1.0, "new_data": {"machine_name": "M1", "status": "down"}})
    parts = [texts[:31] + [undated], texts[31:60], texts[60:]]
    for i in (0, 1):
        parts[i][-1], parts[i + 1][0] = parts[i + 1][0], parts[i][-1]
    for part in (*parts, [CLOCK]):
        rng.shuffle(part)
        _send(spark, inbox, part)
        jobs.follow_transitions(read_change_stream(spark, inbox), root, "2 hours", once=True).awaitTermination()
    whole = changes.readings_of(changes.parse_envelopes(spark.createDataFrame([(t,) for t in texts], "value string")))
    streamed = tables.read_table(spark, f"{root}/transitions", schemas.TRANSITIONS)
    assert streamed.count() == 88
    now = datetime(2024, 2, 4)
    assert _sorted(changes_from_transitions(streamed, now, 4)) == _sorted(machine_status_changes(whole, now, 4))


def test_hours_close_with_the_watermark_and_late_readings_are_counted_apart(spark):
    root, inbox = scratch_dir(spark, "follow"), scratch_dir(spark, "inbox")
    texts = _messages(30)
    parts = (texts[:20], texts[20:], texts[3:5] + [texts[29]], [CLOCK])  # two of the third part are late, one is not
    for part in parts:
        _send(spark, inbox, part)
        jobs.follow_hours(read_change_stream(spark, inbox), root, "1 hour", once=True).awaitTermination()
    sent = [(t,) for part in parts[:3] for t in part]
    history = changes.readings_of(changes.parse_envelopes(spark.createDataFrame(sent, "value string")))
    hours = tables.read_table(spark, f"{root}/hours", schemas.HOURS)
    got = {r["hour"]: (r["total_readings"], r["late_readings"]) for r in stateful.late_readings(history, hours).collect()}
    want = {START + timedelta(hours=i): (1, 0) for i in range(30)}
    want |= {START + timedelta(hours=i): (1, 1) for i in (3, 4)} | {START + timedelta(hours=29): (2, 0)}
    assert got == want
    assert sum(r["operational_count"] + r["down_count"] + r["warning_count"] for r in hours.collect()) == 31


def test_request_stream(spark):
    root, inbox = scratch_dir(spark, "orders"), scratch_dir(spark, "inbox")
    good = '{"machine_id":"V","issue_description":"leak","reporter_name":"Ann"}'
    for i, raw in enumerate([good, "junk"]):
        spark.createDataFrame([(i, raw)], "request_key bigint, raw string").write.mode("append").json(inbox)
        stream = spark.readStream.schema("request_key bigint, raw string").json(inbox)
        jobs.follow_requests(stream, root, as_of=START, once=True).awaitTermination()
    stored = tables.read_stored_work_orders(spark, f"{root}/work_orders")
    assert [r["priority"] for r in stored.collect()] == ["medium"]
    recent = since(stored, "created_at", START, 7)
    assert recent.count() == 1 and "PartitionFilters: [isnotnull(created_date" in recent._jdf.queryExecution().executedPlan().toString()
    rejected = spark.read.schema("request_key bigint, raw string, error string").parquet(f"{root}/rejected").collect()
    assert [r["raw"] for r in rejected] == ["junk"]


def test_requests_sent_again_are_rejected(spark):
    root, inbox = scratch_dir(spark, "orders"), scratch_dir(spark, "inbox")
    good = '{"machine_id":"V","issue_description":"leak","reporter_name":"Ann"}'
    for keys in ([1, 2], [2, 3], [1]):
        spark.createDataFrame([(k, good) for k in keys], "request_key bigint, raw string").write.mode("append").json(inbox)
        stream = spark.readStream.schema("request_key bigint, raw string").json(inbox)
        jobs.follow_requests(stream, root, as_of=START, once=True).awaitTermination()
    stored = tables.read_stored_work_orders(spark, f"{root}/work_orders")
    assert stored.count() == stored.select("id").distinct().count() == 3
    rejected = spark.read.schema("request_key bigint, raw string, error string").parquet(f"{root}/rejected").collect()
    assert sorted((r["request_key"], r["error"]) for r in rejected) == [(1, "id already exists"), (2, "id already exists")]


def test_scratch_lies_below_the_shared_folder(spark, monkeypatch):
    from millwatch import session

    class Unset:
        class conf:
            get = staticmethod(lambda name, *default: default[0] if default else "/warehouse")

    assert session.scratch_dir(Unset, "x").startswith("/warehouse/_scratch/x-")
    assert scratch_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
