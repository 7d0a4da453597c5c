"""Queries that write, stream or ask: stored tables, the live change feed, contracts, pages as they come, zones, clocks."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from dayloom.functions import dates, text
from dayloom.operators import analytics as A
from dayloom.operators import calendar as C
from dayloom.operators import dml
from dayloom.session import scratch
from dayloom.sources import tables as T
from dayloom.sources.keyed import KeyedTable
from dayloom.sources.tables import DAY, STAMP, with_views
from dayloom.streaming import cdc, ticks

OWNER = 7
ZONE = "America/New_York"
FIRST_TICK, TICKS = "2024-01-17 09:58:00", 5
PAGE = 100



# --- the change feed, live ---------------------------------------------------------------------


def _streamed(spark, changes, user_id=None, slices: int = 8, slack: int = 200):
    """The rows of a feed that comes in slices of two files, two slices a batch, in which changes stand up to ``slack`` numbers too late."""
    feed, state, checkpoint = (scratch(spark, name) for name in ("feed", "state", "stream"))
    top = changes.agg(F.max("seq")).first()[0] or 0  # one row
    place = F.floor((F.col("seq") + F.pmod(F.xxhash64("seq"), F.lit(slack))) * slices / (top + slack + 1)).cast("int")
    for k in range(slices):  # one after the other: a stream takes files by their time
        changes.filter(place == k).repartition(2, "seq").write.mode("append").parquet(feed)
    cdc.start(cdc.read_changes(spark, feed, changes.schema, 4, user_id), state, checkpoint, lag=3 * top // slices + 2 * slack).awaitTermination()
    return cdc.rows(spark, state)


def feed_stream(spark, d):
    return _streamed(spark, T.owner_changes(spark, d)).select("id", "seq", "value")


def owner_feed(spark, d):
    return _streamed(spark, T.owner_changes(spark, d), OWNER).select("id", "seq", "value", "user_id")


def feed_list(spark, d):
    """The head of each client's list, newest insert first, as the feed leaves it."""
    return cdc.newest(T.owner_changes(spark, d), 50).select(F.col("nth").cast("int").alias("nth"), "id", "seq", "value")


def live_totals(spark, d):
    """What a live page shows after each batch of an owner's feed: rows, their values' sum and the last change, worked out again from the state."""
    changes = T.owner_changes(spark, d).filter(F.col("user_id") == OWNER).withColumn("cents", F.round(F.col("value") * 100).cast("long")).drop("value")
    feed, state, checkpoint, out = (scratch(spark, name) for name in ("feed", "state", "stream", "totals"))
    place = F.floor(F.col("seq") * 4 / (changes.agg(F.max("seq")).first()[0] + 1)).cast("int")  # one row
    for k in range(4):
        changes.filter(place == k).coalesce(1).write.mode("append").parquet(feed)

    def total(rows, n):
        sums = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("cents"), F.lit(0)).alias("cents"), F.max("seq").alias("last"))
        sums.withColumn("batch", F.lit(n)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    cdc.start(cdc.read_changes(spark, feed, changes.schema, 1, OWNER), state, checkpoint, after=total).awaitTermination()
    return spark.read.parquet(out).select(F.col("batch").cast("int").alias("batch"), "n", "cents", "last")


def autosave_stream(spark, d):
    """Drafts as the editor saves them, periodically and by a stream: half of them twice, and the newer text comes first."""
    c = T.table(spark, d, "customer", "c_custkey", "c_name", "c_acctbal").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("body"), F.col("c_acctbal").alias("balance"))
    first = c.withColumn("seq", F.lit(1).cast("long"))
    again = first.filter("id % 2 = 0").withColumns({"seq": F.lit(2).cast("long"), "body": F.concat("body", F.lit(" saved"))})
    feed, state, checkpoint = (scratch(spark, name) for name in ("drafts", "saved", "stream"))
    for drafts in (again, first):
        drafts.write.mode("append").parquet(feed)
    cdc.autosave(cdc.read_changes(spark, feed, first.schema, 1), state, checkpoint, availableNow=True).awaitTermination()
    return cdc.rows(spark, state).select("id", "body", "balance")


# --- stored tables -----------------------------------------------------------------------------


def stored_changes(spark, d):
    """A table that is stored, upserted into, updated, cut down by key and by key and owner, and read back."""
    r = T.reminders(spark, d).select("id", "user_id", "title", "energy_scale", "is_done")
    table = KeyedTable.create(r.filter("id % 10 <> 9"), scratch(spark, "reminders"), buckets=16)
    i = F.col("id")
    table.upsert(r.filter("id % 10 = 9 or id % 50 = 0").withColumn("title", F.concat(F.lit("saved "), "title")))
    table.update(r.filter("id % 7 = 3").withColumn("energy_scale", F.lit(10)), strict=True)
    table.update(r.filter("id % 11 = 5").withColumns({"id": F.when(i % 2 == 0, i).otherwise(-i), "is_done": ~F.col("is_done")}))
    table.delete(r.filter("id % 13 = 4"))
    table.delete(r.filter("id % 17 = 6").withColumn("user_id", F.when(i % 2 == 0, F.col("user_id")).otherwise(-1)), on=("user_id",))
    table.insert_absent(r.filter("id % 13 = 4 or id % 50 = 1").withColumn("title", F.lit("again")))
    return table.read()


def stored_versions(spark, d):
    """How many rows each version of a stored table has, and how many of its buckets a change of one row rewrites."""
    r = T.reminders(spark, d).select("id", "user_id", "title")
    table = KeyedTable.create(r, scratch(spark, "versions"), buckets=8)
    one = r.agg(F.min("id").alias("id")).withColumns({"user_id": F.lit(0).cast("long"), "title": F.lit("one")})
    table.upsert(one)
    table.delete(one)
    kept = [table.version(n) for n in table.versions()]
    fresh = [0, *(sum(x not in before.parts.values() for x in now.parts.values()) for before, now in zip(kept, kept[1:], strict=False))]
    counts = [table.read(v.number).agg(F.count("*").alias("n"), F.count_if(F.col("title") == "one").alias("changed")).select(F.lit(v.number).alias("version"), "n", "changed", (F.lit(n) <= 1).alias("one_bucket")) for v, n in zip(kept, fresh, strict=True)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


# --- contracts -----------------------------------------------------------------------------------


def one_post(spark, d):
    """The post with the smallest id, which must be there once, and its author's settings, which may be."""
    posts = T.posts(spark, d).select("id", "title")
    first = T.exactly_one(A.top(posts, ["id"], 1))
    setting = T.at_most_one(T.table(spark, d, "customer", "c_custkey", "c_mktsegment").filter("c_custkey = -1"))
    return first.join(setting, F.col("id") == F.col("c_custkey"), "left").select("id", "title", F.coalesce("c_mktsegment", F.lit("default")).alias("setting"))


def strict_updates(spark, d):
    r = T.reminders(spark, d).select("id", "user_id", "energy_scale")
    return dml.update_strict(r, r.filter("id % 3 = 1").withColumn("energy_scale", F.lit(0)))


# --- zones -----------------------------------------------------------------------------------------


def zone_days(spark, d):
    """Days of a zone with summer time: how long they are, and what their visits take of them."""
    v = C.touched_local_days(T.visits(spark, d), ZONE)
    n = v.groupBy("day").agg(F.count("*").alias("n"), F.sum("minutes").alias("minutes"), F.count_if(F.col("day") == dates.local_day(F.col("start"), ZONE)).alias("starting"))
    return n.select(F.date_format("day", DAY).alias("day"), F.date_format(dates.local_day_start("day", ZONE), STAMP).alias("begins"), dates.local_day_hours("day", ZONE).alias("hours"), "n", "minutes", "starting")


def zone_hours(spark, d):
    """Visits by the hour that a zone's clocks show, apart for times that they show twice."""
    v = T.visits(spark, d).select(dates.local_hour(F.col("start"), ZONE).alias("hour"), dates.is_second_hour(F.col("start"), ZONE).alias("again"), dates.to_local(F.col("start"), ZONE).alias("local"))
    return v.groupBy("hour", "again").agg(F.count("*").alias("n"), F.date_format(F.min("local"), STAMP).alias("first"))


# --- pages -----------------------------------------------------------------------------------------


def _pages(spark, d):
    """Orders as JSON pages of ``PAGE`` bookmarks in a folder: some cut off, some an error's answer, in no order."""
    o = T.table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    page = F.floor(F.col("o_orderkey") / PAGE)
    mark = F.struct(F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit('say "'), "o_orderpriority", F.lit('"\n')).alias("text"), F.col("o_custkey").cast("string").alias("author_id"))
    p = o.groupBy(page.alias("p")).agg(F.array_sort(F.collect_list(mark)).alias("data"))  # PAGE at most
    token = lambda x: F.substring(F.md5(x.cast("string")), 1, 12)
    last = p.agg(F.max("p").alias("last"))
    answer = F.struct(token(F.col("p")).alias("token"), F.struct(F.size("data").alias("result_count"), F.when(F.col("p") < F.col("last"), token(F.col("p") + 1)).alias("next_token")).alias("meta"), "data")
    wrong = F.struct(token(F.col("p")).alias("token"), F.lit(429).alias("status"), F.lit("Too Many Requests").alias("detail"))
    line = F.when(F.col("p") % 17 == 3, F.substring(F.to_json(answer), 1, 150)).when(F.col("p") % 23 == 5, F.to_json(wrong)).otherwise(F.to_json(answer))
    path = scratch(spark, "pages")
    p.join(F.broadcast(last)).select(line.alias("value")).repartition(4, F.xxhash64("value")).write.text(path)  # last: one row
    return T.answered_pages(spark, path)


def page_marks(spark, d):
    """Bookmarks in the order of the pages that lead to each other; a lost page begins a new chain behind it."""
    good, _ = _pages(spark, d)
    ordered = A.linked_order(good.select("token", F.col("meta.next_token").alias("next_token"), "data"))
    return ordered.select("chain", "nth", F.posexplode("data").alias("at", "x")).select("chain", "nth", F.col("at").cast("int").alias("at"), "x.id", "x.text", "x.author_id")


def page_rejects(spark, d):
    _, bad = _pages(spark, d)
    return bad.groupBy("reason", F.coalesce("detail", F.lit("")).alias("detail")).agg(F.count("*").alias("n"), F.max(F.length("raw")).cast("int").alias("longest"))


# --- clocks ----------------------------------------------------------------------------------------


def now_marks(spark, d):
    """What the time indicator shows at every minute: the place on the day, and how many events run, are over, and begin within the hour."""
    events = T.calendar_events(spark, d).select("start", "end")

    def view(at):
        now = F.lit(at).cast("timestamp_ntz")
        soon = (F.col("start") > now) & (F.col("start") <= dates.add_minutes(now, 60))
        n = events.agg(F.count_if(now.between(F.col("start"), F.col("end"))).alias("running"), F.count_if(F.col("end") < now).alias("over"), F.count_if(soon).alias("soon"))
        return n.withColumn("percent", dates.day_fraction(now))

    path, checkpoint = scratch(spark, "now"), scratch(spark, "clock")
    first = datetime.fromisoformat(FIRST_TICK)
    ticks.recompute(ticks.ticks(spark, first, timedelta(minutes=1)), view, path, checkpoint, times=TICKS)
    return spark.read.parquet(path).select(F.col("tick").cast("int").alias("tick"), F.date_format("at", STAMP).alias("at"), "running", "over", "soon", "percent")


# --- listing and lengths ---------------------------------------------------------------------------


def table_files(spark, d):
    """The folder's tables, by their files' names."""
    names = T.listing(spark, d, "https://files.example/data").filter("name like '%.parquet'")
    top = F.split_part("name", F.lit("/"), F.lit(1))
    return names.groupBy(top.alias("name")).agg((F.sum("size") > 0).alias("filled"), F.min(F.concat(F.lit("https://files.example/data/"), top)).alias("url"))


def utf16_lengths(spark, d):
    """Lengths and cuts in UTF-16 units, of texts with characters beyond the basic plane."""
    t = F.replace(F.replace(F.col("text"), F.lit("e"), F.lit("\U0001f600")), F.lit("t"), F.lit("é"))
    p = T.table(spark, d, "documents", "doc_id", "text").withColumn("t", t)
    cut = text.utf16_left(F.col("t"), 1000)
    return p.select("doc_id", text.utf16_length(F.col("t")).alias("units"), F.length("t").cast("int").alias("points"), F.md5(cut).alias("cut"), text.utf16_length(cut).alias("cut_units"), text.utf16_remaining(F.col("t"), 160).alias("left"))


_FOLD = """
        , a AS (SELECT *, max(seq) FILTER (op = 'DELETE') OVER (PARTITION BY id) AS deleted FROM owner_changes),
        b AS (SELECT *, min(seq) FILTER (op = 'INSERT') OVER (PARTITION BY id) AS made FROM a WHERE deleted IS NULL OR seq > deleted)
        SELECT id, max(seq) AS seq, arg_max(value, seq) AS value{more} FROM b WHERE (seq = made OR (op = 'UPDATE' AND seq > made)){where} GROUP BY id"""
_LOCAL = lambda c: f"(({c} AT TIME ZONE 'UTC') AT TIME ZONE '{ZONE}')"
_UTC = lambda c: f"((({c})::TIMESTAMP AT TIME ZONE '{ZONE}') AT TIME ZONE 'UTC')"
_S = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
_PAGES = f"""
        WITH o AS (SELECT o_orderkey // {PAGE} AS p, o_orderkey, o_custkey, o_orderpriority FROM orders),
        p AS (SELECT p, lead(p) OVER (ORDER BY p) AS next, max(p) OVER () AS last, substr(md5(p::VARCHAR), 1, 12) AS token, p % 17 = 3 AS torn, p % 17 <> 3 AND p % 23 = 5 AS wrong FROM (SELECT DISTINCT p FROM o))"""

QUERIES = {
    "feed_stream": (feed_stream, with_views(_FOLD.format(more="", where=""), "owner_changes")),
    "owner_feed": (owner_feed, with_views(_FOLD.format(more=", any_value(user_id) AS user_id", where=f" AND user_id = {OWNER}"), "owner_changes")),
    "feed_list": (feed_list, with_views("""
        , a AS (SELECT *, max(seq) FILTER (op = 'DELETE') OVER (PARTITION BY id) AS deleted FROM owner_changes),
        b AS (SELECT *, min(seq) FILTER (op = 'INSERT') OVER (PARTITION BY id) AS made FROM a WHERE deleted IS NULL OR seq > deleted),
        l AS (SELECT id, max(seq) AS seq, arg_max(value, seq) AS value, any_value(made) AS made FROM b WHERE seq = made OR (op = 'UPDATE' AND seq > made) GROUP BY id)
        SELECT row_number() OVER (ORDER BY made DESC, id)::INTEGER AS nth, id, seq, value FROM l ORDER BY nth LIMIT 50""", "owner_changes")),
    "live_totals": (live_totals, with_views(f"""
        , m AS (SELECT id, seq, op, CAST(round(value * 100) AS BIGINT) AS cents, floor(seq * 4 / (max(seq) OVER () + 1))::INTEGER AS place FROM owner_changes WHERE user_id = {OWNER}),
        k AS (SELECT m.*, batch FROM m JOIN range(4) b(batch) ON place <= batch),
        a AS (SELECT *, max(seq) FILTER (op = 'DELETE') OVER (PARTITION BY batch, id) AS deleted FROM k),
        b AS (SELECT *, min(seq) FILTER (op = 'INSERT') OVER (PARTITION BY batch, id) AS made FROM a WHERE deleted IS NULL OR seq > deleted),
        l AS (SELECT batch, id, max(seq) AS seq, arg_max(cents, seq) AS cents FROM b WHERE seq = made OR (op = 'UPDATE' AND seq > made) GROUP BY batch, id)
        SELECT k.batch::INTEGER AS batch, count(l.id) AS n, coalesce(sum(l.cents), 0)::BIGINT AS cents, max(l.seq) AS last FROM range(4) k(batch) LEFT JOIN l USING (batch) GROUP BY k.batch""", "owner_changes")),
    "autosave_stream": (autosave_stream, "SELECT c_custkey AS id, c_name || CASE WHEN c_custkey % 2 = 0 THEN ' saved' ELSE '' END AS body, c_acctbal AS balance FROM customer"),
    "stored_changes": (stored_changes, with_views("""
        , a AS (SELECT id, user_id, CASE WHEN id % 7 <> 3 AND (id % 10 = 9 OR id % 50 = 0) THEN 'saved ' || title ELSE title END AS title, CASE WHEN id % 7 = 3 THEN 10 ELSE energy_scale END AS energy_scale, is_done FROM reminders),
        b AS (SELECT a.id, a.user_id, CASE WHEN a.id % 11 = 5 AND a.id % 2 = 0 THEN r.title ELSE a.title END AS title,
              CASE WHEN a.id % 11 = 5 AND a.id % 2 = 0 THEN r.energy_scale ELSE a.energy_scale END AS energy_scale, CASE WHEN a.id % 11 = 5 AND a.id % 2 = 0 THEN NOT r.is_done ELSE a.is_done END AS is_done FROM a JOIN reminders r USING (id)),
        c AS (SELECT * FROM b WHERE id % 13 <> 4 AND NOT (id % 17 = 6 AND id % 2 = 0))
        SELECT * FROM c UNION ALL SELECT id, user_id, 'again', energy_scale, is_done FROM reminders WHERE (id % 13 = 4 OR id % 50 = 1) AND id NOT IN (SELECT id FROM c)""", "reminders")),
    "stored_versions": (stored_versions, """
        SELECT v.version, count(*) - CASE v.version WHEN 2 THEN 1 ELSE 0 END AS n, CASE v.version WHEN 1 THEN 1 ELSE 0 END AS changed, true AS one_bucket
        FROM events, (VALUES (0), (1), (2)) v(version) GROUP BY v.version"""),
    "one_post": (one_post, with_views("SELECT id, title, 'default' AS setting FROM posts ORDER BY id LIMIT 1", "posts")),
    "strict_updates": (strict_updates, with_views("SELECT id, user_id, CASE WHEN id % 3 = 1 THEN 0 ELSE energy_scale END AS energy_scale FROM reminders", "reminders")),
    "zone_days": (zone_days, with_views(f"""
        , l AS (SELECT *, {_LOCAL('start')} AS ls, {_LOCAL('"end"')} AS le FROM visits),
        t AS (SELECT *, unnest(generate_series(ls::DATE, le::DATE, INTERVAL 1 DAY))::DATE AS day FROM l),
        b AS (SELECT *, {_UTC('day')} AS begins, {_UTC('day + 1')} AS ends FROM t)
        SELECT strftime(day, '%Y-%m-%d') AS day, {_S('begins')} AS begins, (date_sub('minute', begins, ends) / 60)::DOUBLE AS hours, count(*) AS n,
          sum(greatest(0, date_sub('minute', greatest(start, begins), least("end", ends))))::BIGINT AS minutes, count(*) FILTER (day = ls::DATE) AS starting FROM b GROUP BY day, begins, ends""", "visits")),
    "zone_hours": (zone_hours, with_views(f"""
        , l AS (SELECT {_LOCAL('start')} AS local, {_LOCAL('(start - INTERVAL 1 HOUR)')} AS before FROM visits)
        SELECT hour(local)::INTEGER AS hour, local = before AS again, count(*) AS n, {_S('min(local)')} AS first FROM l GROUP BY 1, 2""", "visits")),
    "page_marks": (page_marks, f"""{_PAGES},
        g AS (SELECT *, p - row_number() OVER (ORDER BY p) AS island FROM p WHERE NOT torn AND NOT wrong),
        c AS (SELECT p, first_value(token) OVER (PARTITION BY island ORDER BY p) AS chain, row_number() OVER (PARTITION BY island ORDER BY p) AS nth FROM g)
        SELECT chain, nth, (row_number() OVER (PARTITION BY p ORDER BY o_orderkey::VARCHAR) - 1)::INTEGER AS at, o_orderkey::VARCHAR AS id, 'say "' || o_orderpriority || '"' || chr(10) AS text, o_custkey::VARCHAR AS author_id FROM c JOIN o USING (p)"""),
    "page_rejects": (page_rejects, f"""{_PAGES}
        SELECT CASE WHEN torn THEN 'malformed' ELSE 'status 429' END AS reason, CASE WHEN torn THEN '' ELSE 'Too Many Requests' END AS detail, count(*) AS n, CASE WHEN torn THEN 150 ELSE 66 END AS longest FROM p WHERE torn OR wrong GROUP BY torn"""),
    "now_marks": (now_marks, with_views(f"""
        , t AS (SELECT i::INTEGER AS tick, TIMESTAMP '{FIRST_TICK}' + to_minutes(i) AS now FROM range({TICKS}) r(i))
        SELECT tick, {_S('now')} AS "at", count(*) FILTER (now BETWEEN start AND "end") AS running, count(*) FILTER ("end" < now) AS over, count(*) FILTER (start > now AND start <= now + INTERVAL 1 HOUR) AS soon,
          (hour(now) * 60 + minute(now)) / 1440.0::DOUBLE * 100 AS percent FROM calendar_events, t GROUP BY tick, now""", "calendar_events")),
    "table_files": (table_files, "SELECT name || '.parquet' AS name, true AS filled, 'https://files.example/data/' || name || '.parquet' AS url FROM (VALUES " + ", ".join(f"('{n}')" for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")) + ") t(name)"),
    "utf16_lengths": (utf16_lengths, """
        WITH t AS (SELECT doc_id, replace(replace(text, 'e', chr(128512)), 't', 'é') AS t FROM documents),
        w AS (SELECT doc_id, t, length(t) AS points, length(t) + length(regexp_replace(t, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS units FROM t),
        s AS (SELECT *, list_transform(string_split(t[:1000], ''), lambda c: CASE WHEN ord(c) > 65535 THEN 2 ELSE 1 END) AS each FROM w),
        k AS (SELECT *, CASE WHEN units <= 1000 THEN points ELSE len(list_filter(range(1, len(each) + 1), lambda i: list_sum(each[1:i]) <= 1000)) END AS keep FROM s)
        SELECT doc_id, units::INTEGER AS units, points::INTEGER AS points, md5(t[:keep]) AS cut,
          CASE WHEN units <= 1000 THEN units ELSE list_sum(each[1:keep]) END::INTEGER AS cut_units, (160 - units)::INTEGER AS left FROM k"""),
}
