"""Operators and functions on small fixtures, against plain Python where there is an algorithm to check."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from dayloom.functions import arrays, dates, numbers, text
from dayloom.operators import analytics as A
from dayloom.operators import calendar as C
from dayloom.operators import dml, validate
from dayloom.sources import tables as T
from dayloom.sources.keyed import KeyedTable
from dayloom.streaming import cdc


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_links_and_segments(spark):
    f = lambda c, t: one(spark, text.first_link(F.lit(c), F.lit(t)))[0]
    assert f("see https://a.b/c d", "x") == "https://a.b/c"
    assert f("none", "www.a.b") == "www.a.b"
    assert f(None, None) is None
    got = one(spark, text.segments(F.lit("https://a b https://c")))[0]
    assert [tuple(x) for x in got] == [("url", "https://a"), ("text", " b "), ("url", "https://c")]
    assert [tuple(x) for x in one(spark, text.segments(F.lit("plain")))[0]] == [("text", "plain")]


def test_html(spark):
    html = '<html><head><title>T</title><meta property="og:title" content="OG"></head><body>a<script>if (a<b) {}</script> <style>p{}</style><p>b\xa0 c</p></body></html>'
    assert one(spark, text.page_title(F.lit(html)))[0] == "OG"
    assert one(spark, text.page_text(F.lit(html)))[0] == "a b c"
    assert one(spark, text.page_title(F.lit("<title>a\nb</title>")))[0] == "Untitled"
    assert one(spark, text.page_text(F.lit("no body")))[0] == ""


def test_text_forms(spark):
    assert one(spark, text.slug(F.lit("  Hello, World! \xc9 ")))[0] == "hello-world"
    assert one(spark, text.title_case(F.lit("mail-API-keys")))[0] == "Mail API Keys"
    assert one(spark, text.first_underscore(F.lit("need_to_do")))[0] == "need to_do"
    for seed, want in (("", None), (" 12 ", 12.0), ("1e3", 1000.0), ("NaN", None), ("12abc", None), ("word", None)):
        assert one(spark, text.numeric_seed(F.lit(seed)))[0] == want
    assert one(spark, text.leading_int(F.lit(" 12abc")))[0] == 12


def test_fixed_rounds_the_binary_value(spark):
    assert one(spark, numbers.fixed(F.lit(1.45), 1))[0] == "1.4"
    assert one(spark, numbers.fixed(F.lit(2.5), 0))[0] == "3"
    assert one(spark, numbers.fixed(F.lit(-0.25), 1))[0] == "-0.3"
    assert one(spark, numbers.fixed(F.lit(9.96), 1))[0] == "10.0"
    assert one(spark, numbers.fixed(F.lit(3.0), 2))[0] == "3.00"


def test_dates(spark):
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    assert str(one(spark, dates.week_start(F.lit("2024-01-17").cast("date")))[0]) == "2024-01-14"
    assert one(spark, dates.minutes_between(ts("2024-01-01 10:29:30"), ts("2024-01-01 10:20:00")))[0] == -9
    assert str(one(spark, dates.snap_15(ts("2024-01-01 23:53:20")))[0]) == "2024-01-02 00:00:00"
    assert one(spark, dates.snap_quarter(F.lit(9.9)))[0] == 45
    assert one(spark, dates.ago(ts("2024-01-01 00:00:00"), ts("2024-01-04 01:00:00")))[0] == "3 days ago"


def test_averages_count_nulls_as_zero(spark):
    df = spark.createDataFrame([(1, "need_to_do", 4), (1, "need_to_do", None), (2, "want_to_do", None)], "user_id long, category string, energy_scale int")
    got = {r.user_id: (r.need_avg, r.want_avg, r.label) for r in A.needs_vs_wants(df).collect()}
    assert got == {1: (2.0, 0.0, "Needs First"), 2: (0.0, 0.0, "Wants First")}


def test_quote_falls_back_to_the_latest(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", None)], "id long, quote_text string, scheduled_date date")
    assert A.scheduled_or_latest(df, "2024-01-01").first().id == 2
    assert A.scheduled_or_latest(df.filter("false"), "2024-01-01").count() == 0


def test_unique_slugs_skip_natural_ones(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a-1"), (4, "a"), (5, "b")], "id long, base string")
    assert {r.id: r.slug for r in A.unique_slugs(df).collect()} == {1: "a", 2: "a-2", 3: "a-1", 4: "a-3", 5: "b"}


def test_arg_max_of_nothing(spark):
    df = spark.createDataFrame([], "k string, n long")
    assert tuple(A.arg_max(df, "k").first()) == ("None", None)


def test_bookmarks_without_parts(spark):
    schema = "id long, text string, created_at string, author_id long, attachments struct<media_keys:array<string>>, entities struct<urls:array<struct<expanded_url:string>>,hashtags:array<struct<text:string>>>, context_annotations array<struct<domain:struct<name:string>>>"
    b = spark.createDataFrame([(1, "x", None, None, None, None, None), (2, "y", None, 7, (["m"],), ([("u",)], [("h",)]), [(("d",),)])], schema)
    authors = spark.createDataFrame([(7, "n"), (7, "z")], "id long, name string")
    media = spark.createDataFrame([("m", "", "p")], "media_key string, url string, preview_image_url string")
    got = {r.id: (r.author_name, r.media_url, r.urls, r.hashtags, r.context_domain) for r in A.enriched_bookmarks(b, authors, media).collect()}
    assert got == {1: ("Unknown", None, [], [], None), 2: ("n", "p", ["u"], ["h"], "d")}


def test_arrays(spark):
    t = F.array(F.lit("a"), F.lit("b"))
    assert one(spark, arrays.add_if_absent(t, F.lit(" a ")))[0] == ["a", "b"]
    assert one(spark, arrays.add_if_absent(t, F.lit("c")))[0] == ["a", "b", "c"]
    assert one(spark, arrays.without_at(t, 0))[0] == ["b"]
    assert one(spark, arrays.lookup({"x": 1}, F.lit("y"), 2))[0] == 2


def test_dml(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    as_dict = lambda df: {r.id: r.v for r in df.collect()}
    assert as_dict(dml.upsert(t, new)) == {1: "a", 2: "c", 3: "d"}
    assert as_dict(dml.update(t, new)) == {1: "a", 2: "c"}
    assert as_dict(dml.insert_absent(t, new)) == {1: "a", 2: "b", 3: "d"}
    assert as_dict(dml.delete(t, new)) == {1: "a"}
    with pytest.raises(Exception, match="a row to update is not there: 3"):
        dml.update_strict(t, new).count()
    with pytest.raises(Exception, match="the one row that is due"):
        T.exactly_one(t).count()
    assert T.at_most_one(t.filter("id = 1")).count() == 1


def test_violations(spark):
    df = spark.createDataFrame([("", 11, "x"), ("t", 3, None)], "title string, energy_scale int, category string")
    good, bad = validate.split_valid(df, validate.reminder_rules())
    assert good.count() == 1 and len(bad.first().violations) == 3


def _events(spark, n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = datetime(2024, 1, rng.randint(1, 3), rng.randint(0, 23), rng.choice([0, 15, 30, 45]))
        rows.append((i, 1, s, s + timedelta(minutes=rng.choice([0, 15, 30, 60, 120, 600, -30])), rng.random() < 0.1))
    return spark.createDataFrame(rows, "id long, user_id long, start timestamp_ntz, end timestamp_ntz, all_day boolean"), rows


def test_touched_days_is_the_predicate(spark):
    df, rows = _events(spark, 200, 3)
    got = {(r.id, str(r.day)) for r in C.touched_days(df).select("id", "day").collect()}
    want = set()
    for i, _, s, e, _ in rows:
        for k in range(-2, 8):
            d = datetime(2024, 1, 1) + timedelta(days=k)
            if s.date() == d.date() or e.date() == d.date() or s < d < e:
                want.add((i, str(d.date())))
    assert got == want


def test_columns_are_first_fit(spark):
    df, _ = _events(spark, 120, 5)
    slots = [r.asDict() for r in C.packed(df).collect()]
    timed = C.clipped(C.touched_days(df.filter(~C.is_multi_day()))).withColumn("len", dates.minutes_between(F.col("start"), F.col("end")))
    by_day = {}
    for r in timed.collect():
        by_day.setdefault(r.day, []).append((r.s, -r.len, r.id, r.e))
    for day, events in by_day.items():
        placed = []
        for s, _, i, e in sorted(events):
            col = 0
            while any(c == col and s < e2 and s2 < e for _, s2, e2, c in placed):
                col += 1
            placed.append((i, s, e, col))
        assert sorted(placed) == sorted((x["id"], x["s"], x["e"], x["col"]) for x in slots if x["day"] == day)


def _fold(rows):
    state = {}
    for i, seq, op, v in sorted(rows, key=lambda r: r[1]):
        if op == "INSERT" and i not in state or op == "UPDATE" and i in state:
            state[i] = (seq, v)
        elif op == "DELETE":
            state.pop(i, None)
    return state


def test_change_feed_batch_and_stream_agree(spark, tmp_path):
    rng = random.Random(7)
    rows = [(rng.randint(0, 12), s, rng.choice(["INSERT", "UPDATE", "UPDATE", "DELETE"]), s * 1.5) for s in range(150)]
    schema = "id long, seq long, op string, value double"
    want = _fold(rows)
    as_dict = lambda df: {r.id: (r.seq, r.value) for r in df.collect()}
    assert as_dict(cdc.fold(spark.createDataFrame(rows[::-1], schema))) == want
    feed, state = str(tmp_path / "feed"), str(tmp_path / "state")
    for k in range(3):
        spark.createDataFrame(rows[k * 50 : k * 50 + 50], schema).coalesce(1).write.mode("append").parquet(feed)
        q = cdc.start(cdc.read_changes(spark, feed, schema, 1), state, str(tmp_path / "cp"))
        q.awaitTermination()
    assert as_dict(cdc.rows(spark, state)) == want


def test_changes_in_any_order_over_batches(spark, tmp_path):
    import random

    rng, schema = random.Random(5), "id long, seq long, op string, user_id long, value double"
    rows = [(rng.randrange(12), s, rng.choice(["INSERT", "UPDATE", "UPDATE", "DELETE"]), s % 2, float(s)) for s in range(160)]
    rows += [(100, 10, "DELETE", 0, 0.0), (100, 7, "UPDATE", 0, 7.0), (101, 5, "INSERT", 0, 5.0), (101, 7, "UPDATE", 0, 7.0)]
    want = sorted(map(tuple, cdc.fold(spark.createDataFrame([r for r in rows if r[3] == 0], schema)).collect()))
    assert any(w[0] == 101 and w[1] == 7 for w in want) and len(want) > 3
    rng.shuffle(rows)
    rows = [r for r in rows if r[0] == 100 or r[2] == "UPDATE"][:20] + rows  # some come twice, and early
    feed, state = str(tmp_path / "feed"), str(tmp_path / "state")
    for k in range(0, len(rows), 40):
        spark.createDataFrame(rows[k : k + 40], schema).coalesce(1).write.mode("append").parquet(feed)
    cdc.start(cdc.read_changes(spark, feed, schema, 1, user_id=0), state, str(tmp_path / "cp")).awaitTermination()
    assert sorted(map(tuple, cdc.rows(spark, state).collect())) == want
    assert len(KeyedTable(spark, state).versions()) == 2


def test_autosave_keeps_the_last_draft(spark, tmp_path):
    feed, state, schema = str(tmp_path / "feed"), str(tmp_path / "state"), "id long, seq long, body string"
    for rows in ([(1, 3, "new"), (2, 1, "only")], [(1, 1, "old")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(feed)
    drafts = cdc.read_changes(spark, feed, schema, 1)
    cdc.autosave(drafts, state, str(tmp_path / "cp"), availableNow=True).awaitTermination()
    assert sorted((r.id, r.body) for r in cdc.rows(spark, state).collect()) == [(1, "new"), (2, "only")]


def test_bookmark_pages_and_file_list(spark, tmp_path):
    page = tmp_path / "pages" / "a.json"
    page.parent.mkdir()
    page.write_text('{"data": [{"id": "1", "text": "t", "author_id": "u", "attachments": {"media_keys": ["m"]}}, {"id": "2"}], "includes": {"users": [{"id": "u", "name": "n"}]}}')
    marks, users, media = T.bookmark_pages(spark, str(page.parent))
    assert marks.count() == 2 and users.first().name == "n" and media.count() == 0
    got = A.enriched_bookmarks(marks, users, media)
    assert {r.id: r.author_name for r in got.collect()} == {"1": "n", "2": "Unknown"}
    assert [tuple(r) for r in T.files(spark, str(page.parent), "https://files.example").collect()] == [("a.json", "https://files.example/a.json")]


def test_random_pick_is_seeded(spark):
    df = spark.range(300).select("id", arrays.random_pick(F.array(F.lit("a"), F.lit("b")), F.lit(1), F.col("id")).alias("x"))
    first = [r.x for r in df.orderBy("id").collect()]
    assert first == [r.x for r in df.orderBy("id").collect()] and set(first) == {"a", "b"}
    assert one(spark, arrays.random_pick(F.array().cast("array<string>"), F.lit(1)))[0] is None


def test_rows_with_null_keys_and_repeated_ids_stay(spark):
    posts = spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, None), (5, "a-1")], "id long, base string")
    assert {r.id: r.slug for r in A.unique_slugs(posts).collect()} == {1: "a", 2: None, 3: "a-2", 4: None, 5: "a-1"}
    t = spark.createDataFrame([(1, "a", 1)], "id long, v string, n int")
    new = spark.createDataFrame([(1, "x", 1), (2, "late", 5), (2, "early", 3)], t.schema)
    assert sorted(map(tuple, dml.insert_absent(t, new, order="n").collect())) == [(1, "a", 1), (2, "early", 3)]
    counts = spark.createDataFrame([("b", 3), ("a", 3), ("c", 1)], "tag string, n long")
    assert tuple(A.arg_max(counts, "tag").first()) == ("a", 3) and tuple(A.arg_max(counts.limit(0), "tag").first()) == ("None", None)
    assert sorted(map(tuple, dml.insert(t, new).collect())) == [(1, "a", 1), (1, "x", 1), (2, "early", 3), (2, "late", 5)]


def test_post_and_event_rules(spark):
    post = ("t", "s", "e", "m", "2024-01-01", "u", ["x"], "f")
    df = spark.createDataFrame([post, ("t", "s", " ", None, None, "u", [], "")], "title string, slug string, excerpt string, meta_description string, published_at string, author_id string, tags array<string>, featured_image string")
    good, bad = validate.split_valid(df, validate.post_rules())
    assert good.count() == 1 and set(bad.first().violations) == {"excerpt is required", "meta_description is required", "published_at is required", "at least one tag is required", "featured_image is required"}
    with pytest.raises(ValueError):
        T.owned(spark, "/root/testdata/sf0.001", "reminders", None)


def test_small_functions(spark):
    from dayloom.functions import arrays, dates, text

    assert one(spark, dates.clock(F.lit("07:45")))[0] == (7, 45) and one(spark, dates.clock(F.lit("9")))[0] == (9, 0)
    assert str(one(spark, dates.from_iso(F.lit("2024-01-02T03:04:05+02:00")))[0]) == "2024-01-02 01:04:05"
    assert str(one(spark, dates.from_iso(F.lit("2024-01-02T03:04:05.500Z")))[0]) == "2024-01-02 03:04:05.500000" and one(spark, dates.from_iso(F.lit("no")))[0] is None
    ids = {r[0] for r in spark.range(500).select(text.short_id(F.lit("x"), F.col("id"))).collect()}
    assert len(ids) == 500 and all(len(i) == 9 and i.isalnum() and i == i.lower() for i in ids)
    assert one(spark, text.pretty_json(F.struct(F.lit(1).alias("a"))))[0].split() == ["{", '"a"', ":", "1", "}"]
    got = one(spark, arrays.entries(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2))))[0]
    assert [tuple(x) for x in got] == [("a", 2), ("b", 1)]
    assert T.sample_events(spark, "2024-03-10").filter("all_day").count() == 1
