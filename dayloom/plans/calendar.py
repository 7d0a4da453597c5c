"""Calendar queries: grids, agenda, lanes, columns, snapping, moves and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayloom.functions import arrays, dates, text
from dayloom.operators import calendar as C
from dayloom.operators import validate
from dayloom.sources import tables as T
from dayloom.sources.tables import DAY, STAMP, with_views
from dayloom.streaming import cdc

TODAY, NOW = "2024-01-17", "2024-01-17 10:07:00"
DEFAULT_HEX = {"blue": "#3b82f6", "orange": "#f97316", "violet": "#8b5cf6"}


def _day(c="day"):
    return F.date_format(c, DAY)


def _stamp(c):
    return F.date_format(c, STAMP)


def agenda_30d(spark, d):
    days = spark.sql(f"select explode(sequence(date'{TODAY}', date_add(date'{TODAY}', 29))) as day")
    return C.touched_days(T.calendar_events(spark, d)).join(F.broadcast(days), "day").select(_day().alias("day"), "id", _stamp("start").alias("start"), dates.short_time(F.col("start")).alias("at"))  # 30 rows


def agenda_days(spark, d):
    e = C.touched_days(T.calendar_events(spark, d))
    days = spark.sql(f"select explode(sequence(date'{TODAY}', date_add(date'{TODAY}', 29))) as day")
    n = e.groupBy("day").agg(F.count("*").alias("n"))
    return days.join(n, "day", "left").select(_day().alias("day"), F.date_format("day", "d MMM, EEEE").alias("title"), F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) > 0).alias("any"))


def month_grid_overflow(spark, d):
    grid = C.month_grid(spark, TODAY)
    spanning, starting = C.spanning(T.calendar_events(spark, d)), C.starting(T.calendar_events(spark, d))
    cells = spanning.unionByName(starting).join(F.broadcast(grid), "day")  # six weeks at most
    shown = C.visible_split(cells, 100)
    return shown.filter("nth <= shown").select("user_id", _day().alias("day"), "week", "in_month", F.col("nth").cast("int").alias("nth"), "id", F.col("more").cast("long").alias("more"))


def week_spanning(spark, d):
    e = C.spanning(C.in_week(T.calendar_events(spark, d), TODAY))
    first = dates.week_start(F.lit(TODAY).cast("date"))
    e = C.position_flags(e, first).filter(F.col("day").between(first, F.date_add(first, 6)))
    return e.select("user_id", _day().alias("day"), "id", "is_first", "is_last", "shows_title")


def week_events(spark, d):
    return C.in_week(T.calendar_events(spark, d), TODAY).select("id", "user_id")


def week_slots(spark, d):
    return C.week_grid(spark, TODAY).select(_day().alias("day"), "hour", "quarter")


def day_split(spark, d):
    e = C.touched_days(T.calendar_events(spark, d)).withColumn("lane", F.when(C.is_multi_day(), "all-day").otherwise("timed"))
    return e.groupBy("day", "lane").agg(F.count("*").alias("n")).select(_day().alias("day"), "lane", "n")


def starting_order(spark, d):
    from pyspark.sql import Window

    e = C.starting(T.calendar_events(spark, d))
    nth = F.row_number().over(Window.partitionBy("user_id", "day").orderBy(*C.event_order()))
    return e.select("user_id", _day().alias("day"), "id", nth.cast("int").alias("nth"), C.is_multi_day().alias("multi"))


def column_packing(spark, d):
    g = C.geometry(C.packed(T.calendar_events(spark, d)))
    return g.select("user_id", _day().alias("day"), "id", "s", "e", "col", "top", "height", "left", "width", "z")


def day_overlaps(spark, d):
    return C.overlaps(T.calendar_events(spark, d)).select("user_id", _day().alias("day"), "a", "b")


def snap_15min(spark, d):
    e = T.calendar_events(spark, d)
    return e.select("id", _stamp(dates.snap_15(F.col("start"))).alias("snapped"), dates.snap_quarter(dates.fractional_hour(F.col("start"))).cast("int").alias("quarter"), dates.floor_15(F.col("start")).alias("floored"))


def move_interval(spark, d):
    e = T.calendar_events(spark, d).withColumn("new_start", dates.add_minutes(F.col("start"), (F.col("id") % 3 * 45).cast("int")))
    return e.select("id", _stamp("new_start").alias("new_start"), _stamp(dates.moved(F.col("start"), F.col("end"), F.col("new_start"))).alias("new_end"), dates.minute_changed(F.col("start"), F.col("new_start")).alias("changed"))


def day_position(spark, d):
    e = T.calendar_events(spark, d)
    now = F.lit(NOW).cast("timestamp_ntz")
    return e.select("id", dates.day_fraction(F.col("start")).alias("percent"), dates.fractional_hour(F.col("start")).alias("hour"), (F.col("end") < now).alias("past"), now.between(F.col("start"), F.col("end")).alias("running"), dates.minutes_between(F.col("start"), F.col("end")).alias("minutes"), (F.timestamp_diff("DAY", F.col("start"), F.col("end")) >= 1).alias("long"))


def date_labels(spark, d):
    e = T.calendar_events(spark, d)
    s, t = F.col("start"), F.col("end")
    return e.select("id", F.date_format(s, "MMM d, yyyy").alias("day"), F.date_format(s, "EEE d").alias("short"), F.date_format(s, "h a").alias("hour"), dates.short_time(s).alias("at"), dates.period_title(s, t).alias("period"), dates.same_day(s, t).alias("same_day"))


def navigation(spark, d):
    days = C.days(spark, "2024-01-28", "2024-03-02")
    cols = [_day(dates.navigate(F.col("day"), v, k)).alias(f"{v}_{'next' if k > 0 else 'back'}") for v in ("month", "week", "day", "agenda") for k in (1, -1)]
    return days.select(_day().alias("day"), _day(dates.week_start(F.col("day"))).alias("week_first"), _day(dates.week_end(F.col("day"))).alias("week_last"), *cols)


def week_load(spark, d):
    """The quarters of an hour of a week, each with the timed events that begin in it."""
    grid = C.week_grid(spark, TODAY)
    e = T.calendar_events(spark, d).filter(~C.is_multi_day())
    n = e.groupBy(F.to_date("start").alias("day"), F.hour("start").alias("hour"), F.floor(F.minute("start") / 15).cast("int").alias("quarter")).agg(F.count("*").alias("n"))
    return grid.join(n, ["day", "hour", "quarter"], "left").select(_day().alias("day"), "hour", "quarter", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def day_navigation(spark, d):
    """From each day with events to the next and the last period of each view."""
    days = C.starting(T.calendar_events(spark, d)).groupBy("day").agg(F.count("*").alias("n"))
    cols = [_day(dates.navigate(F.col("day"), v, k)).alias(f"{v}_{'next' if k > 0 else 'back'}") for v in ("month", "week", "day", "agenda") for k in (1, -1)]
    return days.select(_day().alias("day"), "n", _day(dates.week_start(F.col("day"))).alias("week_first"), _day(dates.week_end(F.col("day"))).alias("week_last"), *cols)


def quarter_load(spark, d):
    """The 96 quarters of an hour of a day, each with the events that begin in it on any day."""
    n = T.calendar_events(spark, d).groupBy(F.hour("start").alias("hour"), dates.floor_15(F.col("start")).alias("minute")).agg(F.count("*").alias("n"))
    return T.quarters(spark).join(n, ["hour", "minute"], "left").select("hour", "minute", "label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def validate_events(spark, d):
    e = T.calendar_events(spark, d)
    bad = e.withColumn("end", F.when(F.col("id") % 19 == 0, F.expr("start - interval '1' hour")).when(F.col("id") % 23 != 0, F.col("end"))).withColumn("title", F.when(F.col("id") % 29 == 0, "  ").otherwise(F.col("title")))
    owner = F.concat(F.lit("0a1b2c3d-0000-4000-8000-0000000"), F.lpad(F.col("user_id").cast("string"), 5, "0"))
    bad = bad.withColumn("owner", F.when(F.col("id") % 31 == 0, F.lit("nobody")).otherwise(owner))
    rules = {**validate.event_rules(owner="owner"), **validate.within_hours(6, 22)}
    return validate.check(bad, rules).select("id", F.array_join("violations", "; ").alias("violations"))


def event_colors(spark, d):
    e = T.calendar_events(spark, d)
    return e.groupBy("color").agg(F.count("*").alias("n")).select("color", arrays.lookup(DEFAULT_HEX, F.col("color")).alias("hex"), "n")


def all_day_bounds(spark, d):
    e = C.all_day_bounds(T.calendar_events(spark, d))
    return e.select("id", F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSS").alias("start"), F.date_format("end", "yyyy-MM-dd HH:mm:ss.SSS").alias("end"))


def cdc_fold(spark, d):
    return cdc.fold(T.changes(spark, d))


def times(spark, d):
    """Clock text, ISO text and back, default ends and short ids of events."""
    e = T.calendar_events(spark, d)
    s = F.col("start")
    at = dates.clock(F.date_format(s, "HH:mm"))
    back = dates.from_iso(F.concat(F.date_format(s, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
    return e.select(
        "id", at["hour"].alias("hour"), at["minute"].alias("minute"), dates.to_iso(s).alias("iso"), _stamp(back).alias("utc"),
        _stamp(dates.default_end(s, F.when(F.col("id") % 2 == 0, F.col("end")))).alias("end"), text.short_id(F.lit("event"), F.col("id")).alias("short_id"),
    )


_E = lambda sql: with_views(sql, "calendar_events")
_MULTI = "(all_day OR day(start) <> day(\"end\"))"
_TOUCHED = """, t AS (SELECT *, CAST(unnest(generate_series(CAST(start AS DATE), CAST("end" AS DATE), INTERVAL 1 DAY)) AS DATE) AS day FROM calendar_events)"""
_D = lambda c: f"strftime({c}, '%Y-%m-%d')"
_S = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
_AT = lambda c: f"lower(CASE WHEN minute({c}) = 0 THEN strftime({c}, '%-I%p') ELSE strftime({c}, '%-I:%M%p') END)"
_WEEK = "DATE '2024-01-14' AND DATE '2024-01-20'"

QUERIES = {
    "agenda_30d": (agenda_30d, _E(f"{_TOUCHED} SELECT {_D('day')} AS day, id, {_S('start')} AS start, {_AT('start')} AS at FROM t WHERE day BETWEEN DATE '{TODAY}' AND DATE '{TODAY}' + 29")),
    "agenda_days": (agenda_days, _E(f"""{_TOUCHED}, g AS (SELECT CAST(unnest(generate_series(DATE '{TODAY}', DATE '{TODAY}' + 29, INTERVAL 1 DAY)) AS DATE) AS day)
        SELECT {_D('g.day')} AS day, strftime(g.day, '%-d %b, %A') AS title, count(t.id) AS n, count(t.id) > 0 AS any FROM g LEFT JOIN t ON t.day = g.day GROUP BY g.day""")),
    "month_grid_overflow": (month_grid_overflow, _E(f"""{_TOUCHED},
        g AS (SELECT CAST(unnest(generate_series(DATE '2023-12-31', DATE '2024-02-03', INTERVAL 1 DAY)) AS DATE) AS day),
        c AS (SELECT t.*, {_MULTI} AS multi FROM t JOIN g ON t.day = g.day WHERE CAST(start AS DATE) = t.day OR ({_MULTI} AND t.day > CAST(start AS DATE))),
        r AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY multi DESC, start, id) AS nth, count(*) OVER (PARTITION BY user_id, day) AS n FROM c)
        SELECT user_id, {_D('day')} AS day, ((day - DATE '2023-12-31') // 7)::INTEGER AS week, month(day) = 1 AND year(day) = 2024 AS in_month, nth::INTEGER AS nth, id,
          n - CASE WHEN n > 3 THEN 2 ELSE n END AS more FROM r WHERE nth <= CASE WHEN n > 3 THEN 2 ELSE n END""")),
    "week_spanning": (week_spanning, _E(f"""{_TOUCHED} SELECT user_id, {_D('day')} AS day, id, day = CAST(start AS DATE) AS is_first, day = CAST("end" AS DATE) AS is_last,
          day = CAST(start AS DATE) OR day = DATE '2024-01-14' AS shows_title FROM t WHERE {_MULTI} AND day > CAST(start AS DATE) AND day BETWEEN {_WEEK}""")),
    "week_events": (week_events, _E(f"{_TOUCHED} SELECT DISTINCT id, user_id FROM t WHERE day BETWEEN {_WEEK}")),
    "week_slots": (week_slots, f"""SELECT {_D('day')} AS day, h::INTEGER AS hour, q::INTEGER AS quarter FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-14', DATE '2024-01-20', INTERVAL 1 DAY)) AS DATE) AS day), range(24) a(h), range(4) b(q)"""),
    "day_split": (day_split, _E(f"{_TOUCHED} SELECT {_D('day')} AS day, CASE WHEN {_MULTI} THEN 'all-day' ELSE 'timed' END AS lane, count(*) AS n FROM t GROUP BY 1, 2")),
    "starting_order": (starting_order, _E(f"""SELECT user_id, {_D('start')} AS day, id, row_number() OVER (PARTITION BY user_id, CAST(start AS DATE) ORDER BY {_MULTI} DESC, start, id)::INTEGER AS nth, {_MULTI} AS multi FROM calendar_events""")),
    "column_packing": (column_packing, _E(f"""{_TOUCHED}, x AS (SELECT user_id, day, id, CASE WHEN CAST(start AS DATE) = day THEN hour(start) * 60 + minute(start) ELSE 0 END::INTEGER AS s,
          CASE WHEN CAST("end" AS DATE) = day THEN hour("end") * 60 + minute("end") ELSE 1440 END::INTEGER AS e, date_sub('minute', start, "end") AS length FROM t WHERE NOT {_MULTI}),
        q AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY s, length DESC, id) AS nth FROM x),
        p AS (SELECT user_id, day, nth, id, s, e, 0 AS col, [{{'s': s, 'e': e, 'col': 0}}] AS placed FROM q WHERE nth = 1
          UNION ALL
          SELECT q.user_id, q.day, q.nth, q.id, q.s, q.e, f.col, list_append(placed, {{'s': q.s, 'e': q.e, 'col': f.col}}) FROM p JOIN q ON q.user_id = p.user_id AND q.day = p.day AND q.nth = p.nth + 1,
            LATERAL (SELECT list_min(list_filter(range(0, len(placed) + 1), lambda k: len(list_filter(placed, lambda y: y.col = k AND q.s < y.e AND y.s < q.e)) = 0))::INTEGER AS col) f)
        SELECT user_id, {_D('day')} AS day, id, s, e, col, s / 60.0::DOUBLE * 64 AS top, (e - s) / 60.0::DOUBLE * 64 AS height, CASE WHEN col = 0 THEN 0 ELSE col * 0.1::DOUBLE END AS "left",
          CASE WHEN col = 0 THEN 1 ELSE 0.9 END::DOUBLE AS width, col + 10 AS z FROM p""").replace("WITH ", "WITH RECURSIVE ", 1)),
    "day_overlaps": (day_overlaps, _E(f"""{_TOUCHED}, x AS (SELECT user_id, day, id, CASE WHEN CAST(start AS DATE) = day THEN hour(start) * 60 + minute(start) ELSE 0 END AS s,
          CASE WHEN CAST("end" AS DATE) = day THEN hour("end") * 60 + minute("end") ELSE 1440 END AS e FROM t WHERE NOT {_MULTI})
        SELECT a.user_id, {_D('a.day')} AS day, a.id AS a, b.id AS b FROM x a JOIN x b ON a.user_id = b.user_id AND a.day = b.day AND a.id < b.id AND a.s < b.e AND b.s < a.e""")),
    "snap_15min": (snap_15min, _E(f"""
        , m AS (SELECT id, start, minute(start) % 15 AS o, date_trunc('minute', start) AS m, (minute(start) / 60.0)::DOUBLE AS part FROM calendar_events)
        SELECT id, {_S("CASE WHEN o = 0 THEN start WHEN o < 7.5 THEN m - to_minutes(o) ELSE m + to_minutes(15 - o) END")} AS snapped,
          CASE WHEN part < 0.125 THEN 0 WHEN part < 0.375 THEN 15 WHEN part < 0.625 THEN 30 ELSE 45 END AS quarter, (minute(start) // 15 * 15)::INTEGER AS floored FROM m""")),
    "move_interval": (move_interval, _E(f"""
        , m AS (SELECT *, start + to_minutes(id % 3 * 45) AS new_start FROM calendar_events)
        SELECT id, {_S('new_start')} AS new_start, {_S("new_start + to_minutes(date_sub('minute', start, \"end\"))")} AS new_end, id % 3 <> 0 AS changed FROM m""")),
    "day_position": (day_position, _E(f"""SELECT id, (hour(start) * 60 + minute(start)) / 1440.0::DOUBLE * 100 AS percent, hour(start) + minute(start) / 60.0::DOUBLE AS hour, "end" < TIMESTAMP '{NOW}' AS past,
          TIMESTAMP '{NOW}' BETWEEN start AND "end" AS running, date_sub('minute', start, "end") AS minutes, date_sub('day', start, "end") >= 1 AS long FROM calendar_events""")),
    "date_labels": (date_labels, _E(f"""SELECT id, strftime(start, '%b %-d, %Y') AS day, strftime(start, '%a %-d') AS short, strftime(start, '%-I %p') AS hour, {_AT('start')} AS at,
          CASE WHEN date_trunc('month', start) = date_trunc('month', "end") THEN strftime(start, '%B %Y') ELSE strftime(start, '%b') || ' - ' || strftime("end", '%b %Y') END AS period,
          CAST(start AS DATE) = CAST("end" AS DATE) AS same_day FROM calendar_events""")),
    "navigation": (navigation, f"""
        WITH g AS (SELECT CAST(unnest(generate_series(DATE '2024-01-28', DATE '2024-03-02', INTERVAL 1 DAY)) AS DATE) AS d)
        SELECT {_D('d')} AS day, {_D("d - CAST(dayofweek(d) AS INTEGER)")} AS week_first, {_D("d - CAST(dayofweek(d) AS INTEGER) + 6")} AS week_last,
          {_D("d + INTERVAL 1 MONTH")} AS month_next, {_D("d - INTERVAL 1 MONTH")} AS month_back, {_D("d + 7")} AS week_next, {_D("d - 7")} AS week_back,
          {_D("d + 1")} AS day_next, {_D("d - 1")} AS day_back, {_D("d + 30")} AS agenda_next, {_D("d - 30")} AS agenda_back FROM g"""),
    "week_load": (week_load, _E(f"""
        , g AS (SELECT CAST(unnest(generate_series(DATE '2024-01-14', DATE '2024-01-20', INTERVAL 1 DAY)) AS DATE) AS day), h AS (SELECT day, h::INTEGER AS hour, q::INTEGER AS quarter FROM g, range(24) a(h), range(4) b(q))
        SELECT {_D('day')} AS day, hour, quarter, (SELECT count(*) FROM calendar_events WHERE NOT {_MULTI} AND CAST(start AS DATE) = day AND hour(start) = hour AND minute(start) // 15 = quarter) AS n FROM h""")),
    "day_navigation": (day_navigation, _E(f"""
        , g AS (SELECT CAST(start AS DATE) AS d, count(*) AS n FROM calendar_events GROUP BY 1)
        SELECT {_D('d')} AS day, n, {_D("d - CAST(dayofweek(d) AS INTEGER)")} AS week_first, {_D("d - CAST(dayofweek(d) AS INTEGER) + 6")} AS week_last,
          {_D("d + INTERVAL 1 MONTH")} AS month_next, {_D("d - INTERVAL 1 MONTH")} AS month_back, {_D("d + 7")} AS week_next, {_D("d - 7")} AS week_back,
          {_D("d + 1")} AS day_next, {_D("d - 1")} AS day_back, {_D("d + 30")} AS agenda_next, {_D("d - 30")} AS agenda_back FROM g""")),
    "quarter_load": (quarter_load, _E("""
        , n AS (SELECT hour(start) AS h, minute(start) // 15 * 15 AS m, count(*) AS n FROM calendar_events GROUP BY 1, 2)
        SELECT (i // 4)::INTEGER AS hour, (i % 4 * 15)::INTEGER AS minute, printf('%02d:%02d', i // 4, i % 4 * 15) AS label, coalesce(n, 0)::BIGINT AS n FROM range(96) t(i) LEFT JOIN n ON h = i // 4 AND m = i % 4 * 15""")),
    "validate_events": (validate_events, _E("""
        SELECT id, array_to_string([x FOR x IN [CASE WHEN id % 29 = 0 THEN 'title is required' END, CASE WHEN id % 23 = 0 AND id % 19 <> 0 THEN 'end is a time' END,
          CASE WHEN id % 19 = 0 OR id % 23 = 0 THEN 'end is not before start' END, CASE WHEN color = 'none' THEN 'color is known' END, CASE WHEN id % 31 = 0 THEN 'owner is a UUID' END,
          CASE WHEN coalesce(hour(start) BETWEEN 6 AND 22 AND hour(CASE WHEN id % 19 = 0 THEN start - INTERVAL 1 HOUR WHEN id % 23 <> 0 THEN "end" END) BETWEEN 6 AND 22, false) THEN NULL ELSE 'hours are from 6 to 22' END] IF x IS NOT NULL], '; ') AS violations FROM calendar_events""")),
    "times": (times, _E("""
        SELECT id, hour(start)::INTEGER AS hour, minute(start)::INTEGER AS minute, strftime(start, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso, strftime(start - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS utc,
          strftime(CASE WHEN id % 2 = 0 THEN "end" ELSE start + INTERVAL 30 MINUTE END, '%Y-%m-%d %H:%M:%S') AS "end",
          lower(to_base(('0x' || substr(md5('event:' || id), 1, 11))::BIGINT, 36, 9)) AS short_id FROM calendar_events""")),
    "event_colors": (event_colors, _E("SELECT color, CASE color WHEN 'blue' THEN '#3b82f6' WHEN 'orange' THEN '#f97316' WHEN 'violet' THEN '#8b5cf6' END AS hex, count(*) AS n FROM calendar_events GROUP BY color")),
    "all_day_bounds": (all_day_bounds, _E("""SELECT id, strftime(CASE WHEN all_day THEN date_trunc('day', start) ELSE start END, '%Y-%m-%d %H:%M:%S.%g') AS start,
          strftime(CASE WHEN all_day THEN date_trunc('day', "end") + INTERVAL 1 DAY - INTERVAL 1 MILLISECOND ELSE "end" END, '%Y-%m-%d %H:%M:%S.%g') AS "end" FROM calendar_events""")),
    "cdc_fold": (cdc_fold, with_views("""
        , a AS (SELECT *, max(seq) FILTER (op = 'DELETE') OVER (PARTITION BY id) AS deleted FROM changes),
        b AS (SELECT *, min(seq) FILTER (op = 'INSERT') OVER (PARTITION BY id) AS made FROM a WHERE deleted IS NULL OR seq > deleted)
        SELECT id, max(seq) AS seq, arg_max(value, seq) AS value FROM b WHERE seq = made OR (op = 'UPDATE' AND seq > made) GROUP BY id""", "changes")),
}
