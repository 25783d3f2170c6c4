"""Streaming jobs over several files equal their batch form."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plainledger.operators import ops
from plainledger.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    """The event log in time order as four files, so there are four micro-batches."""
    folder = str(tmp_path_factory.mktemp("log"))
    events = spark.read.parquet(f"{SF}/events.parquet")
    kind = F.col("event_type")
    rows = events.select(
        F.col("user_id").alias("entity"), F.when(kind == "view", "explore").when(kind == "click", "fetch").otherwise("check").alias("kind"),
        F.lit("ok").alias("status"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), kind.alias("provider"))
    for i in range(4):
        rows.filter((F.dayofmonth("at") > i * 8) & (F.dayofmonth("at") <= (i + 1) * 8)).coalesce(1).write.mode("append").parquet(folder)
    return folder, spark.read.parquet(folder)


def rows_of(df):
    return sorted(str(tuple(r)) for r in df.collect())


def stream(spark, log):
    folder, batch = log
    return jobs.read_stream(spark, folder, "*.parquet", batch.schema, files_per_batch=1)


def test_state_equals_batch(spark, log, tmp_path):
    path = str(tmp_path)
    jobs.run_batches(jobs.entity_state(stream(spark, log)), path, "update")
    want = ops.latest_status(log[1])
    assert jobs.read_rows(spark, path).select(jobs.BATCH).distinct().count() > 1
    assert rows_of(jobs.latest_rows(spark, path, ["entity"]).select(want.columns)) == rows_of(want)


def test_quota_equals_batch(spark, log, tmp_path):
    path = str(tmp_path)
    caps = spark.createDataFrame([("click", 100), ("view", 1000)], "provider string, cap long")
    jobs.run_batches(jobs.monthly_quota(stream(spark, log), caps), path, "update")
    got = {r["provider"]: (r["asked"], r["exhausted"]) for r in jobs.latest_rows(spark, path, ["provider", "month"]).collect()}
    want = {r["provider"]: (r["asked"], r["asked"] >= r["cap"]) for r in ops.quota_meter(log[1], caps).collect()}
    assert got == want


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_a_key_lives_again_after_its_expiry(spark, tmp_path):
    folder, path, schema = str(tmp_path / "in"), str(tmp_path / "out"), "key string, at timestamp, seq int"
    day = dt.datetime(2024, 1, 1)
    seen = [[("a", 0, 1), ("b", 3, 2)], [("a", 19, 3), ("b", 10, 4), ("b", 40, 5)], [("a", 20, 6), ("a", 25, 7), ("a", 152, 8)]]
    for part in seen:
        put(spark, folder, [(k, day + dt.timedelta(days=d), n) for k, d, n in part], schema)
    jobs.retention(jobs.read_stream(spark, folder, "*.parquet", schema, 1), path, "key", "at", 20)
    got = sorted((r["key"], r["seq"], (r["expires_at"] - day).days) for r in jobs.read_rows(spark, path).collect())
    assert got == [("a", 1, 20), ("a", 6, 40), ("a", 8, 172), ("b", 2, 23), ("b", 5, 60)]
    batch = ops.first_seen_retention(spark.read.schema(schema).parquet(folder), "key", "at", 20)
    assert sorted((r["key"], r["seq"], (r["expires_at"] - day).days) for r in batch.collect()) == got


def test_first_event_of_a_key_comes_once(spark, tmp_path):
    folder, path, schema = str(tmp_path / "in"), str(tmp_path / "out"), "key string, at timestamp, seq int"
    day = dt.datetime(2024, 1, 1)
    for part in ([("a", 5, 1), ("a", 2, 2)], [("b", 400, 3)], [("a", 900, 4), ("b", 1, 5), ("c", 1, 6)]):
        put(spark, folder, [(k, day + dt.timedelta(days=d), n) for k, d, n in part], schema)
    for _ in range(2):
        jobs.first_events(jobs.read_stream(spark, folder, "*.parquet", schema, 1), path, ["key"], "at")
    assert sorted((r["key"], r["seq"]) for r in jobs.read_rows(spark, path).collect()) == [("a", 2), ("b", 3), ("c", 6)]


def test_late_rows_are_dropped(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "out")
    day = dt.datetime(2026, 1, 1)

    def put(*days):
        spark.createDataFrame([(day + dt.timedelta(days=d), "a") for d in days], "at timestamp, bucket string").coalesce(1).write.mode("append").parquet(folder)

    put(0, 0, 1)
    schema = spark.read.parquet(folder).schema

    def run():
        jobs.run_batches(jobs.daily_counts(jobs.read_stream(spark, folder, "*.parquet", schema, 1), "at", "bucket", "1 day"), path, "append")

    run()
    put(5)
    run()
    put(0, 9)
    run()
    got = {r["day"].day: r["n"] for r in jobs.read_rows(spark, path).collect()}
    assert got == {1: 2, 2: 1, 6: 1}


# --- state per key ---------------------------------------------------------------------

DAY = dt.datetime(2024, 1, 1)


def parts_of(spark, folder, parts, schema):
    for part in parts:
        put(spark, folder, part, schema)
    return lambda: jobs.read_stream(spark, folder, "*.parquet", schema, 1)


def test_first_events_read_the_buckets_of_their_keys_only(spark, tmp_path, monkeypatch):
    """Twelve files; a batch of one key reads a bounded number of files, and null keys are kept once."""
    from plainledger.streaming.state import KeyTable

    folder, path, schema = str(tmp_path / "in"), str(tmp_path / "out"), "key string, at timestamp, seq int"
    parts = [[(f"k{i}-{j}", DAY + dt.timedelta(days=i), i) for j in range(40)] + [(None, DAY + dt.timedelta(days=9 - i), i)] for i in range(11)]
    parts.append([("k0-0", DAY, 99), ("k3-7", DAY, 99)])
    read, seen = [], KeyTable.before

    def before(self, batch, touched=None):
        out = seen(self, batch, touched)
        if touched is not None:
            read.append((batch, len(touched), len(out.inputFiles())))
        return out

    monkeypatch.setattr(KeyTable, "before", before)
    jobs.first_events(parts_of(spark, folder, parts, schema)(), path, ["key"], "at", buckets=8, merge_every=3)
    got = {r["key"]: r["seq"] for r in jobs.read_rows(spark, path).collect()}
    assert len(got) == 441 and got[None] == 0 and all(n == int(k[1:].split("-")[0]) for k, n in got.items() if k)
    assert jobs.read_rows(spark, path).count() == 441 and len(read) == 12
    # At most the last three or four batches and the merged table before them, for each bucket touched.
    assert all(files <= buckets * 5 for _, buckets, files in read) and read[-1][1] <= 2


def test_a_replayed_batch_leaves_the_same_state(spark, tmp_path):
    from pyspark.sql import types as T

    from plainledger.streaming.state import KeyTable

    schema = T.StructType.fromDDL("key string, n int")
    table = KeyTable(spark, str(tmp_path / "t"), schema, ["key"], buckets=4, merge_every=2)
    for batch in range(9):
        rows = spark.createDataFrame([("a", batch), (f"b{batch}", batch), (None, -batch)], schema)
        for _ in range(2):
            assert {r["key"]: r["n"] for r in table.before(batch).collect()} == (
                {"a": batch - 1, None: 1 - batch, **{f"b{i}": i for i in range(batch)}} if batch else {})
            table.save(batch, rows)


def test_quota_state_ends_with_its_month(spark, tmp_path):
    """Counters of past months go; a charge that comes after that changes nothing."""
    folder, path, schema = str(tmp_path / "in"), str(tmp_path / "out"), "provider string, at timestamp"
    caps = spark.createDataFrame([("p", 3)], "provider string, cap long")
    days = [[(1, 5), (1, 20)], [(1, 31), (2, 1)], [(1, 30), (3, 2)], [(4, 2)], [(1, 7), (4, 3)], [(6, 1)], [(7, 1)]]
    stream = parts_of(spark, folder, [[("p", dt.datetime(2024, m, d)) for m, d in part] for part in days], schema)
    progress = jobs.run_batches(jobs.monthly_quota(stream(), caps), path, "update")
    got = {r["month"]: (r["asked"], r["exhausted"]) for r in jobs.latest_rows(spark, path, ["provider", "month"]).collect()}
    assert got == {"2024-01": (4, True), "2024-02": (1, False), "2024-03": (1, False), "2024-04": (2, False),
                   "2024-06": (1, False), "2024-07": (1, False)}
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert max(kept) <= 3 and kept[-1] <= 2
    assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in progress if p["stateOperators"]) == 1


def test_ten_years_of_lives_take_few_tables(spark, tmp_path, monkeypatch):
    """A sighting every third day: 41 lives of 90 days, batch and stream alike, few written tables."""
    written, schema = [], "key string, at timestamp, seq int"
    plain = ops.cut
    monkeypatch.setattr(ops, "cut", lambda df: written.append(1) or plain(df))
    rows = [(k, DAY + dt.timedelta(days=3 * i + shift), i) for k, shift in (("a", 0), (None, 1)) for i in range(1217)]
    rows += [("b", DAY + dt.timedelta(days=400), 1), ("b", DAY + dt.timedelta(days=490), 2), ("b", DAY + dt.timedelta(days=489), 3)]

    def lives(key):
        out, end = [], None
        for _, at, seq in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            if end is None or at >= end:
                end = at + dt.timedelta(days=90)
                out.append((key, seq, end))
        return out

    want = sorted((x for k in ("a", "b", None) for x in lives(k)), key=str)
    df = spark.createDataFrame(rows, schema)
    got = [(r["key"], r["seq"], r["expires_at"]) for r in ops.first_seen_retention(df, "key", "at", 90).collect()]
    assert sorted(got, key=str) == want and len(lives("a")) == 41 and len(written) < 12
    assert ops.first_seen_retention(df.limit(0), "key", "at", 90).count() == 0
    folder, path = str(tmp_path / "in"), str(tmp_path / "out")
    ordered = sorted(rows, key=lambda r: r[1])
    stream = parts_of(spark, folder, [ordered[i:i + 500] for i in range(0, len(ordered), 500)], schema)
    jobs.retention(stream(), path, "key", "at", 90)
    assert sorted(((r["key"], r["seq"], r["expires_at"]) for r in jobs.read_rows(spark, path).collect()), key=str) == want


def plain_changes(rows):
    """Stages by a plain walk over every entity's events."""
    out = []
    for entity in {r[0] for r in rows if r[0] is not None}:
        had, stage = set(), "untouched"
        for _, kind, status, at, seq in sorted((r for r in rows if r[0] == entity), key=lambda r: (r[3], r[4])):
            had.add(kind)
            now = "untouched"
            if had & {"explore", "fetch"}:
                bad = "fetch" not in had and status in ("dead", "not_plan", "ssi")
                now = "no_plan_found" if bad else "explored"
            elif "discovery" in had:
                now = "searched"
            if now != stage:
                out.append((entity, at, seq, stage, now))
            stage = now
    return sorted(out)


def test_a_stage_is_emitted_when_it_changes(spark, log, tmp_path):
    import random

    rnd = random.Random(4)
    kinds, states = ["explore", "fetch", "discovery", "vet", "check"], ["ok", "dead", "ssi", None]
    rows = [(rnd.choice([1, 1, 1, 2, 3, 4, None]), rnd.choice(kinds[:1] + kinds[2:]) if i < 200 else rnd.choice(kinds),
             rnd.choice(states), DAY + dt.timedelta(hours=5 * (i // 2)), i) for i in range(300)]
    schema = "entity long, kind string, status string, at timestamp, seq int"
    got = ops.stage_changes(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, got.collect())) == plain_changes(rows)
    stream = parts_of(spark, str(tmp_path / "in"), [rows[i:i + 60] for i in range(0, 300, 60)], schema)
    path = str(tmp_path / "out")
    jobs.stage_changes(stream(), path, buckets=4, merge_every=2)
    assert sorted(tuple(r)[:5] for r in jobs.read_rows(spark, path).collect()) == plain_changes(rows)


def parted(spark, folder, name):
    """A folder of tables in which one table is a folder of parts itself."""
    rows = spark.read.parquet(f"{SF}/{name}.parquet")
    rows.repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_document_changes_of_a_table_in_parts(spark, tmp_path):
    from plainledger.plans import streams

    got = streams.stream_document_changes(spark, parted(spark, str(tmp_path), "conversations"))
    assert rows_of(got) == rows_of(streams.stream_document_changes(spark, SF).select(got.columns)) != []


def test_page_candidates_of_a_table_in_parts(spark, tmp_path):
    from plainledger.plans import streams, web

    got = streams.stream_page_candidates(spark, parted(spark, str(tmp_path), "pages"))
    assert rows_of(got) == rows_of(web.page_link_roles(spark, SF).select(got.columns)) != []
