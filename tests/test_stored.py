"""Stored tables, the feed's state that forgets, contracts in the plan, packing at size, zones, pages, clocks, lengths."""

import os
import random
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from dayloom.functions import dates, text
from dayloom.operators import analytics as A
from dayloom.operators import calendar as C
from dayloom.operators import dml, validate
from dayloom.sources import tables as T
from dayloom.sources.keyed import BUCKET, KeyedTable
from dayloom.streaming import cdc, ticks

SCHEMA = "id long, v string"


def _rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: [(x is None, x) for x in r])


def _files(path):
    return {os.path.relpath(os.path.join(d, f), path): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


# --- stored tables -------------------------------------------------------------------------------


def test_a_change_rewrites_only_its_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    table = KeyedTable.create(spark.range(200).select("id", F.lit("a").alias("v")), path, buckets=8)
    before, parts = _files(path), dict(table.latest().parts)
    table.upsert(spark.createDataFrame([(5, "b"), (1000, "new")], SCHEMA))
    after, now = _files(path), table.latest().parts
    touched = table.touched(spark.createDataFrame([(5, ""), (1000, "")], SCHEMA))
    assert before.items() <= after.items()  # nothing old was written to
    assert {int(b) for b in now if now[b] != parts.get(b)} == touched and len(touched) <= 2
    assert _rows(table.read().filter("v <> 'a'")) == [(5, "b"), (1000, "new")] and table.read().count() == 201
    assert table.read(0).count() == 200 and table.read(0).filter("v <> 'a'").count() == 0
    assert _rows(table.lookup(spark.createDataFrame([(5, ""), (7, ""), (-1, "")], SCHEMA))) == [(5, "b"), (7, "a")]


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_against_a_dict(spark, tmp_path, seed):
    rng, model = random.Random(seed), {i: f"v{i}" for i in range(40)}
    table = KeyedTable.create(spark.createDataFrame(list(model.items()), SCHEMA), str(tmp_path / "t"), buckets=4, rows_per_bucket=8)
    for step in range(8):
        some = {rng.randrange(80): f"s{step}" for _ in range(rng.randrange(1, 12))}
        rows, kind = spark.createDataFrame(list(some.items()), SCHEMA), rng.choice(["upsert", "update", "delete", "insert_absent"])
        getattr(table, kind)(rows)
        if kind == "upsert":
            model |= some
        elif kind == "update":
            model |= {k: v for k, v in some.items() if k in model}
        elif kind == "delete":
            model = {k: v for k, v in model.items() if k not in some}
        else:
            model |= {k: v for k, v in some.items() if k not in model}
        assert _rows(table.read()) == sorted(model.items()), (step, kind)
        assert table.latest().rows == len(model)
    table.vacuum(1)
    assert len(table.versions()) == 1 and _rows(table.read()) == sorted(model.items())


def test_a_failed_change_leaves_the_table(spark, tmp_path):
    table = KeyedTable.create(spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA), str(tmp_path / "t"), buckets=2)
    with pytest.raises(Exception, match="a row to update is not there: 3"):
        table.update(spark.createDataFrame([(1, "x"), (3, "y")], SCHEMA), strict=True)
    assert table.versions() == [0] and _rows(table.read()) == [(1, "a"), (2, "b")]
    table.update(spark.createDataFrame([(1, "x")], SCHEMA), strict=True)  # the number of the failed one
    assert table.versions() == [0, 1] and _rows(table.read()) == [(1, "x"), (2, "b")]
    with pytest.raises(FileExistsError):
        KeyedTable.create(table.read(), table.path)


def test_two_writers_and_vacuum(spark, tmp_path):
    table = KeyedTable.create(spark.createDataFrame([(1, "a")], SCHEMA), str(tmp_path / "t"))
    late = table.latest()
    table.upsert(spark.createDataFrame([(2, "b")], SCHEMA))
    late.number += 1
    with pytest.raises(RuntimeError):
        table._publish(late)
    for k in range(3):
        table.upsert(spark.createDataFrame([(k, "c")], SCHEMA))
    table.vacuum()
    assert table.versions() == [3, 4] and len(os.listdir(tmp_path / "t" / "data")) == 2
    assert _rows(table.read(3)) == [(0, "c"), (1, "c"), (2, "b")] and _rows(table.read()) == [(0, "c"), (1, "c"), (2, "c")]


def test_odd_stored_tables(spark, tmp_path):
    table = KeyedTable.create(spark.createDataFrame([], SCHEMA), str(tmp_path / "t"), buckets=4)
    assert table.read().count() == 0 and table.read().columns == ["id", "v"]
    table.upsert(spark.createDataFrame([(None, "n"), (1, None)], SCHEMA))
    table.upsert(spark.createDataFrame([(None, "m")], SCHEMA))  # null never equals null
    table.delete(spark.createDataFrame([(None, "")], SCHEMA))
    assert _rows(table.read()) == [(1, None), (None, "m"), (None, "n")]
    table.delete(spark.createDataFrame([(1, "x"), (7, "")], SCHEMA), on=("v",))
    assert table.read().count() == 3
    table.delete(spark.createDataFrame([(1, "")], SCHEMA))
    assert _rows(table.read()) == [(None, "m"), (None, "n")]
    table.upsert(spark.createDataFrame([], SCHEMA))
    assert table.read().count() == 2
    with pytest.raises(ValueError):
        KeyedTable.create(spark.range(1).withColumn(BUCKET, F.lit(1)), str(tmp_path / "u"))


def test_buckets_grow_with_the_table(spark, tmp_path):
    table = KeyedTable.create(spark.range(10).select("id", F.lit("a").alias("v")), str(tmp_path / "t"), rows_per_bucket=10)
    for k in range(1, 5):
        table.upsert(spark.range(k * 100, k * 100 + 100).select("id", F.lit("a").alias("v")))
    table.upsert(spark.createDataFrame([(0, "b")], SCHEMA))
    assert table.latest().buckets >= 16 and table.read().count() == 410 and len(table.latest().parts) > 8


# --- a state that forgets ----------------------------------------------------------------------


def _stream(spark, tmp_path, rows, schema, sizes, **options):
    feed, state = str(tmp_path / "feed"), str(tmp_path / "state")
    at = 0
    for k, n in enumerate(sizes):
        spark.createDataFrame(rows[at : at + n], schema).coalesce(1).write.mode("append").parquet(feed)
        at += n
        cdc.start(cdc.read_changes(spark, feed, schema, 1), state, str(tmp_path / "cp"), **options).awaitTermination()
    return state


@pytest.mark.parametrize("seed", [3, 4])
def test_forgetting_keeps_the_fold(spark, tmp_path, seed):
    rng, schema = random.Random(seed), "id long, seq long, op string, value double"
    rows = [(rng.randrange(9), s, rng.choice(["INSERT", "UPDATE", "UPDATE", "DELETE"]), float(s)) for s in range(240)]
    want = _rows(cdc.fold(spark.createDataFrame(rows, schema)))
    rows.sort(key=lambda r: r[1] + rng.randrange(25))  # at most 24 numbers out of order
    state = _stream(spark, tmp_path, rows, schema, [40] * 6, lag=50, rows_per_bucket=20)
    assert _rows(cdc.rows(spark, state)) == want
    notes = KeyedTable(spark, state).latest().notes
    assert notes["late"] == 0 and notes["final"] == 239 - 50


def test_the_state_stays_small(spark, tmp_path):
    """Two changes a live key whatever its history, and none of removed keys once the lag has passed, even in buckets that no later batch touches."""
    schema = "id long, seq long, op string, value double"
    rows = [(0, s, "INSERT" if s % 3 else "UPDATE", float(s)) for s in range(100)]
    rows += [(k, 100 + 2 * k, "INSERT", 1.0) for k in range(1, 40)] + [(k, 101 + 2 * k, "DELETE", 1.0) for k in range(1, 40)]
    rows += [(1000, 1000 + s, "UPDATE", float(s)) for s in range(20)] + [(0, 2000, "UPDATE", 7.0), (2000, 2001, "INSERT", 1.0)]
    state = _stream(spark, tmp_path, rows, schema, [100, 78, 20, 2], lag=100, rows_per_bucket=1)
    left = cdc.state(spark, state)
    assert left.count() <= 5 and left.filter("id between 1 and 39").count() == 0 and left.filter("id = 0").count() == 2
    assert _rows(cdc.rows(spark, state)) == [(0, 2000, 7.0), (2000, 2001, 1.0)]


def test_what_comes_too_late_is_counted(spark, tmp_path):
    schema = "id long, seq long, op string, value double"
    rows = [(1, 10, "INSERT", 1.0), (2, 500, "INSERT", 2.0), (3, 20, "INSERT", 3.0), (2, 450, "DELETE", 0.0)]
    state = _stream(spark, tmp_path, rows, schema, [2, 2], lag=100)
    assert _rows(cdc.rows(spark, state)) == [(1, 10, 1.0), (2, 500, 2.0)] and KeyedTable(spark, state).latest().notes["late"] == 1


def test_a_batch_again_changes_nothing(spark, tmp_path):
    schema = "id long, seq long, op string, value double"
    state = _stream(spark, tmp_path, [(1, 1, "INSERT", 1.0)], schema, [1], lag=10)
    before = KeyedTable(spark, state).versions()
    cdc.start(cdc.read_changes(spark, str(tmp_path / "feed"), schema, 1), state, str(tmp_path / "other")).awaitTermination()  # its batch 0 is known
    assert KeyedTable(spark, state).versions() == before and _rows(cdc.rows(spark, state)) == [(1, 1, 1.0)]


# --- contracts -----------------------------------------------------------------------------------


def test_one_row_contracts(spark):
    df = spark.range(3).withColumn("v", F.lit("x"))
    assert _rows(T.exactly_one(df.filter("id = 1"))) == [(1, "x")] and _rows(T.at_most_one(df.filter("id = 9"))) == []
    for bad in (T.exactly_one(df), T.exactly_one(df.filter("id = 9")), T.at_most_one(df)):  # planned without a job
        with pytest.raises(Exception, match="row"):
            bad.collect()
        with pytest.raises(Exception, match="row"):
            bad.agg(F.count("*")).collect()  # no column of it is read


def test_contracts_scan_once(spark):
    d = "/root/testdata/sf0.001"
    r = T.reminders(spark, d).select("id", "user_id")
    for df, scans in ((T.exactly_one(r.filter("id = 1")), 1), (dml.update_strict(r, r.filter("id < 5").withColumn("user_id", F.lit(1).cast("long"))), 2)):
        assert df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == scans
    with pytest.raises(Exception, match="a row to update is not there: 77777"):
        dml.update_strict(r, spark.createDataFrame([(77777, 1)], "id long, user_id long")).agg(F.count("*")).collect()


# --- packing -------------------------------------------------------------------------------------


def test_many_events_that_overlap(spark):
    rng = random.Random(1)
    rows = [(i, 1, datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(600)), datetime(2024, 1, 1, 12) + timedelta(minutes=rng.randrange(600)), False) for i in range(5000)]
    df = spark.createDataFrame(rows, "id long, user_id long, start timestamp_ntz, end timestamp_ntz, all_day boolean")
    slots = C.packed(df).collect()
    assert sorted(r.col for r in slots) == list(range(5000))  # at noon all of them are open
    order = sorted(slots, key=lambda r: r.col)
    assert [r.s for r in order] == sorted(r.s for r in order)


def test_packing_of_odd_events(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        s = datetime(2024, 1, 1) + timedelta(minutes=15 * rng.randrange(40))
        rows.append((i, i % 2, s, s + timedelta(minutes=rng.choice([0, 0, 15, 30, 90, -15, -60])), False))
    df = spark.createDataFrame(rows, "id long, user_id long, start timestamp_ntz, end timestamp_ntz, all_day boolean")
    got = {(r.user_id, r.day, r.id): r.col for r in C.packed(df).collect()}
    timed = C.clipped(C.touched_days(df.filter(~C.is_multi_day()))).withColumn("len", dates.minutes_between(F.col("start"), F.col("end"))).collect()
    for key in {(r.user_id, r.day) for r in timed}:
        placed = []
        for r in sorted((r for r in timed if (r.user_id, r.day) == key), key=lambda r: (r.s, -r.len, r.id)):
            col = 0
            while any(c == col and r.s < e and s < r.e for s, e, c in placed):
                col += 1
            placed.append((r.s, r.e, col))
            assert got[(*key, r.id)] == col


# --- zones ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("zone", ["America/New_York", "Europe/Berlin", "Australia/Lord_Howe", "America/Sao_Paulo", "Asia/Kathmandu"])
def test_local_times(spark, zone):
    z, utc = ZoneInfo(zone), timezone.utc
    moments = [datetime(2018, 1, 1) + timedelta(minutes=m) for m in range(0, 365 * 1440, 97)]
    for m in (datetime(2018, 3, 11, 6), datetime(2018, 11, 4, 5), datetime(2018, 3, 25), datetime(2018, 10, 28), datetime(2018, 4, 1) - timedelta(hours=10), datetime(2018, 11, 4, 2)):
        moments += [m + timedelta(minutes=5 * k) for k in range(40)]
    df = spark.createDataFrame([(m,) for m in moments], "x timestamp_ntz")
    x = F.col("x")
    got = df.select("x", dates.to_local(x, zone), dates.is_second_hour(x, zone), dates.local_day(x, zone), dates.local_day_hours(dates.local_day(x, zone), zone)).collect()
    for m, local, again, day, hours in got:
        there = m.replace(tzinfo=utc).astimezone(z)
        assert local == there.replace(tzinfo=None) and again == bool(there.fold) and day == there.date()
        ends = []
        for d in (day, day + timedelta(days=1)):  # a skipped midnight moves on by the gap
            first = datetime(d.year, d.month, d.day, tzinfo=z)
            ends.append(first.astimezone(utc))
        assert hours == pytest.approx((ends[1] - ends[0]).total_seconds() / 3600), (m, zone)


def test_days_of_a_zone(spark):
    zone = "America/New_York"
    rows = [(1, 1, datetime(2024, 3, 10, 4), datetime(2024, 3, 11, 5), False), (2, 1, datetime(2024, 11, 3, 3, 30), datetime(2024, 11, 3, 5, 30), False), (3, 1, datetime(2024, 6, 1, 12), datetime(2024, 6, 1, 12), False)]
    df = spark.createDataFrame(rows, "id long, user_id long, start timestamp_ntz, end timestamp_ntz, all_day boolean")
    got = {(r.id, str(r.day)): r.minutes for r in C.touched_local_days(df, zone).collect()}
    assert got == {(1, "2024-03-09"): 60, (1, "2024-03-10"): 23 * 60, (1, "2024-03-11"): 60, (2, "2024-11-02"): 30, (2, "2024-11-03"): 90, (3, "2024-06-01"): 0}
    assert one_value(spark, dates.local_day_hours(F.lit(date(2024, 11, 3)), zone)) == 25.0


def one_value(spark, col):
    return spark.range(1).select(col).first()[0]


# --- pages, links, files, probes -----------------------------------------------------------------


def test_answered_pages(spark, tmp_path):
    lines = ['{"token": "a", "meta": {"next_token": "b"}, "data": [{"id": "1"}]}', '{"token": "b", "data": [{"id": "2"}', "", '{"status": 401, "detail": "no"}', '{"token": "c"}', "[1]", '{"data": 5, "token": "d"}', "nonsense"]
    (tmp_path / "pages.json").write_text("\n".join(lines))
    good, bad = T.answered_pages(spark, str(tmp_path))
    assert {r.token for r in good.collect()} == {"a", "c"} and good.filter("token = 'a'").first().data[0].id == "1"
    assert sorted(r.reason for r in bad.collect()) == ["malformed"] * 4 + ["status 401"]
    assert {r.raw for r in bad.filter("reason = 'malformed'").collect()} == {lines[1], lines[5], lines[6], lines[7]}
    (tmp_path / "whole").mkdir()
    (tmp_path / "whole" / "p.json").write_text('{\n "token": "w",\n "data": [\n{"id": "7"}, {"id": "8"}]\n}\n')
    (tmp_path / "whole" / "q.json").write_text('{\n "token": "w2",\n "data": [')
    good, bad = T.answered_pages(spark, str(tmp_path / "whole"), whole_files=True)
    assert [(r.token, len(r.data)) for r in good.collect()] == [("w", 2)] and [r.reason for r in bad.collect()] == ["malformed"]


def test_linked_order(spark):
    rng = random.Random(5)
    names = [f"t{i}" for i in range(70)]
    rng.shuffle(names)
    rows = [(a, b) for a, b in zip(names[:50], [*names[1:50], None], strict=True)] + [(a, b) for a, b in zip(names[50:53], [*names[51:53], "gone"], strict=True)]
    rows += [("x", "x"), ("y", "z"), ("z", "y"), (None, "t1"), ("alone", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "token string, next_token string")
    got = {r.token: (r.chain, r.nth) for r in A.linked_order(df).collect() if r.token[0] == "t" or r.token == "alone"}
    lost = dict(rows)
    want = {"alone": ("alone", 1)}
    for start, run in ((names[0], names[:50]), (names[50], names[50:53])):
        want |= {t: (start, k + 1) for k, t in enumerate(run)}
    assert lost and {k: v for k, v in got.items() if k != "t1"} == {k: v for k, v in want.items() if k != "t1"}
    assert A.linked_order(spark.createDataFrame([], "token string, next_token string")).count() == 0
    rings = A.linked_order(df).filter("token in ('x', 'y', 'z')").count()
    assert rings == 0


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "c+d é.txt").write_text("123")
    (tmp_path / "e.txt").write_text("x")
    got = sorted(tuple(r) for r in T.listing(spark, str(tmp_path), "https://f.example/x/").select("name", "url", "size").collect())
    assert got == [("a b/c+d é.txt", "https://f.example/x/a%20b/c%2Bd%20%C3%A9.txt", 3), ("e.txt", "https://f.example/x/e.txt", 1)]


def test_probes_run_together(spark, monkeypatch):
    import threading

    inside, most, lock = [0], [0], threading.Lock()
    real = T.exists
    gate = threading.Barrier(3, timeout=30)

    def exists(df):
        with lock:
            inside[0] += 1
            most[0] = max(most[0], inside[0])
        gate.wait()
        out = real(df)
        with lock:
            inside[0] -= 1
        return out

    monkeypatch.setattr(T, "exists", exists)
    got = [tuple(r) for r in T.probe(spark, "/root/testdata/sf0.001", ["orders", "missing", "events", "region"]).collect()]
    assert [(n, ok) for n, ok, _ in got] == [("orders", True), ("missing", False), ("events", True), ("region", True)] and got[1][2]
    assert most[0] == 3


# --- clocks --------------------------------------------------------------------------------------


def test_ticks_recompute_the_view(spark, tmp_path):
    events = spark.createDataFrame([(1, datetime(2024, 1, 1, 9, 0), datetime(2024, 1, 1, 9, 2)), (2, datetime(2024, 1, 1, 9, 2), datetime(2024, 1, 1, 9, 30))], "id long, start timestamp_ntz, end timestamp_ntz")
    view = lambda at: events.filter(F.lit(at).cast("timestamp_ntz").between(F.col("start"), F.col("end"))).select("id")
    clock = ticks.ticks(spark, datetime(2024, 1, 1, 8, 59), timedelta(minutes=1))
    ticks.recompute(clock, view, str(tmp_path / "out"), str(tmp_path / "cp"), times=5)
    got = sorted((r.tick, str(r["at"])[11:16], r.id) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, "09:00", 1), (2, "09:01", 1), (3, "09:02", 1), (3, "09:02", 2), (4, "09:03", 2)]


def test_a_failing_view_is_raised(spark, tmp_path):
    def view(at):
        raise ValueError("no view")

    with pytest.raises(Exception, match="no view"):
        ticks.recompute(ticks.ticks(spark, datetime(2024, 1, 1), timedelta(minutes=1)), view, str(tmp_path / "out"), str(tmp_path / "cp"), times=2)


# --- lengths -------------------------------------------------------------------------------------


def test_utf16(spark):
    texts = ["", "abc", "a\U0001f600b", "\U0001f600" * 3, "é日\U0001f600", None, "\U0001f600a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    units = lambda t: len(t.encode("utf-16-be")) // 2
    for most in range(6):
        for i, n, cut, left in df.select("i", text.utf16_length(F.col("t")), text.utf16_left(F.col("t"), most), text.utf16_remaining(F.col("t"), most)).collect():
            t = texts[i]
            if t is None:
                assert n is None and cut is None and left == most
                continue
            want = max((t[:k] for k in range(len(t) + 1) if units(t[:k]) <= most), key=len)
            assert n == units(t) and cut == want and left == most - units(t), (t, most)


# --- owners, names, settings, lists --------------------------------------------------------------


def test_an_owner_reads_own_rows_only(spark):
    d = "/root/testdata/sf0.001"
    me = T.Owner(spark, d, 7)
    for name in ("reminders", "calendar_events", "prompts", "transactions", "diagnostics", "owner_changes", "visits"):
        df = getattr(me, name)
        assert {r[0] for r in df.select("user_id").distinct().collect()} <= {7}
        assert "PushedFilters: [" in (plan := df._jdf.queryExecution().executedPlan().toString()) and ",7)" in plan
    with pytest.raises(ValueError):
        T.Owner(spark, d, None)
    with pytest.raises(AttributeError):
        _ = me.customers


def test_null_names_are_created_once(spark):
    schema = "id long, name string, user_id long"
    held = spark.createDataFrame([(5, "a", 1)], schema)
    asked = spark.createDataFrame([(0, "a", 1), (0, None, 1), (0, None, 1), (0, "b", None)], schema)
    first = dml.get_or_create(held, asked)
    assert sorted((r.name or "", r.user_id or 0) for r in first.collect()) == [("", 1), ("a", 1), ("b", 0)] and first.select("id").distinct().count() == 3
    assert _rows(dml.get_or_create(first, asked)) == _rows(first)


def test_unset_settings(spark):
    df = spark.createDataFrame([({"a": "x", "b": " ", "c": None},), ({},), (None,)], "m map<string,string>")
    assert [r[0] for r in df.select(validate.unset(F.col("m"), ["c", "a", "b", "d"])).collect()] == [["c", "b", "d"], ["c", "a", "b", "d"], ["c", "a", "b", "d"]]


@pytest.mark.parametrize("seed", [5, 6])
def test_the_list_of_a_client(spark, seed):
    rng, shown = random.Random(seed), []
    rows = [(rng.randrange(8), s, rng.choice(["INSERT", "UPDATE", "DELETE"]), float(s)) for s in range(120)]
    for i, s, op, v in rows:
        at = next((k for k, x in enumerate(shown) if x[0] == i), None)
        if op == "INSERT" and at is None:
            shown.insert(0, (i, s, v))
        elif op == "UPDATE" and at is not None:
            shown[at] = (i, s, v)
        elif op == "DELETE" and at is not None:
            shown.pop(at)
    rng.shuffle(rows)
    got = cdc.newest(spark.createDataFrame(rows, "id long, seq long, op string, value double"), 4).orderBy("nth").collect()
    assert [(r.id, r.seq, r.value) for r in got] == shown[:4] and [r.nth for r in got] == list(range(1, len(shown[:4]) + 1))


def test_what_follows_the_feed(spark, tmp_path):
    """A derived view is worked out from the rows after each batch, again for a batch that is repeated."""
    schema, seen = "id long, seq long, op string, value double", []
    rows = [(1, 1, "INSERT", 1.0), (2, 2, "INSERT", 2.0), (1, 3, "DELETE", 0.0), (2, 4, "UPDATE", 5.0)]
    _stream(spark, tmp_path, rows, schema, [2, 2], after=lambda df, n: seen.append((n, sorted(r.value for r in df.collect()))))
    assert seen == [(0, [1.0, 2.0]), (1, [5.0])]
