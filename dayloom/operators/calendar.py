"""Calendar operators: days that intervals touch, grids, lanes and columns.

An interval touches the days from its start's to its end's: intervals are exploded to days and joined by
equality, never by a range condition. An end before its start touches the two days only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayloom.functions import dates

HOUR_HEIGHT = 64
EVENT_HEIGHT, EVENT_GAP = 24, 4


def is_multi_day(strict: bool = False) -> Column:
    """All-day, or ending on another day of the month (``strict``: on another day)."""
    apart = F.to_date("start") != F.to_date("end") if strict else F.dayofmonth("start") != F.dayofmonth("end")
    return F.coalesce(F.col("all_day"), F.lit(False)) | apart


def touched_days(events: DataFrame) -> DataFrame:
    """Adds ``day``: a row per day that an event touches."""
    a, b = F.to_date("start"), F.to_date("end")
    return events.withColumn("day", F.explode(F.when(F.col("start") <= F.col("end"), F.sequence(F.least(a, b), F.greatest(a, b))).otherwise(F.array_distinct(F.array(a, b)))))


def starting(events: DataFrame) -> DataFrame:
    """Adds ``day``: the day an event starts."""
    return events.withColumn("day", F.to_date("start"))


def spanning(events: DataFrame) -> DataFrame:
    """Adds ``day``: the later days of multi-day events."""
    return touched_days(events.filter(is_multi_day())).filter(F.col("day") > F.to_date("start"))


def days(spark, first: str, last: str) -> DataFrame:
    return spark.sql(f"select explode(sequence(date'{first}', date'{last}')) as day")


def month_grid(spark, day: str) -> DataFrame:
    """``day``, ``week``, ``in_month``: whole weeks from Sunday that cover a month."""
    one = spark.sql(f"select date'{day}' as d")
    grid = one.select("d", F.explode(F.sequence(dates.week_start(F.trunc("d", "MM")), dates.week_end(F.last_day("d")))).alias("day"))
    first = dates.week_start(F.trunc("d", "MM"))
    return grid.select("day", F.floor(F.date_diff("day", first) / 7).cast("int").alias("week"), (F.trunc("day", "MM") == F.trunc("d", "MM")).alias("in_month"))


def week_grid(spark, day: str) -> DataFrame:
    """The 672 quarters of an hour of a week: ``day``, ``hour``, ``quarter``."""
    first = dates.week_start(F.lit(day).cast("date"))
    out = spark.range(1).select(F.explode(F.sequence(first, F.date_add(first, 6))).alias("day"))
    return out.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23)))).withColumn("quarter", F.explode(F.sequence(F.lit(0), F.lit(3))))


def in_week(events: DataFrame, day: str) -> DataFrame:
    """Events that touch any day of the week, once each."""
    first = dates.week_start(F.lit(day).cast("date"))
    a, b = F.to_date("start"), F.to_date("end")
    within = lambda d: d.between(first, F.date_add(first, 6))
    return events.filter(within(a) | within(b) | ((a <= first) & (b >= first)))


def event_order() -> list[Column]:
    """Multi-day events first, then by start, then by id."""
    return [is_multi_day().desc(), F.col("start"), F.col("id")]


def position_flags(events: DataFrame, week_first: Column) -> DataFrame:
    """On touched days: is it the event's first or last, and does its title show there."""
    first, last = F.col("day") == F.to_date("start"), F.col("day") == F.to_date("end")
    return events.withColumns({"is_first": first, "is_last": last, "shows_title": first | (F.col("day") == week_first)})


def visible_split(events: DataFrame, height: int) -> DataFrame:
    """Per day and owner, the events that fit a cell (``nth`` <= ``shown``), and how many more there are."""
    fit = height // (EVENT_HEIGHT + EVENT_GAP)
    w = Window.partitionBy("user_id", "day")
    n = F.count("*").over(w)
    shown = F.when(n > fit, F.lit(max(0, fit - 1))).otherwise(n)
    return events.withColumn("nth", F.row_number().over(w.orderBy(*event_order()))).withColumn("shown", shown).withColumn("more", n - F.col("shown"))


def clipped(events: DataFrame) -> DataFrame:
    """Adds ``s`` and ``e``: the minutes of the day between which an event stands on ``day``."""
    on = lambda c: F.to_date(c) == F.col("day")
    return events.withColumns({"s": F.when(on("start"), dates.minute_of_day(F.col("start"))).otherwise(0), "e": F.when(on("end"), dates.minute_of_day(F.col("end"))).otherwise(1440)})


def clusters(timed: DataFrame) -> DataFrame:
    """Adds ``cluster``: a new one begins where all earlier events of the owner's day have ended, so events of different ones never overlap."""
    day = Window.partitionBy("user_id", "day").orderBy("s", "e", "id")
    busy = F.max("e").over(day.rowsBetween(Window.unboundedPreceding, -1))
    fresh = timed.withColumn("_new", F.when(busy.isNull() | (F.col("s") >= busy), 1).otherwise(0))
    return fresh.withColumn("cluster", F.sum("_new").over(day.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def packed(events: DataFrame) -> DataFrame:
    """Columns for the timed events of each owner's day: the first column in which an event overlaps none.

    Events are taken by start, the longer first, then by id. The fold sweeps one cluster of an owner's day at a time (each starts
    again at the first column) and remembers each column's last event with a length: starts never fall, so no other event of the column can be
    open then. An event without length (or with its end before its start) closes nothing and leaves its column as it was.
    """
    timed = clusters(clipped(touched_days(events.filter(~is_multi_day()))))
    length = dates.minutes_between(F.col("start"), F.col("end"))
    queue = F.array_sort(F.collect_list(F.struct("s", (-length).alias("neg"), "id", "e")))
    begin = F.struct(F.array().cast("array<struct<s:int,e:int>>").alias("last"), F.array().cast("array<int>").alias("cols"))

    def place(acc, x):
        s, e, last = x["s"].cast("int"), x["e"].cast("int"), acc["last"]
        own = F.struct(s.alias("s"), e.alias("e"))

        def put(free):  # the first free column, from 1; 0: none
            col = F.when(free > 0, free - 1).otherwise(F.size(last)).cast("int")
            changed = F.concat(F.slice(last, F.lit(1), free - 1), F.array(own), F.slice(last, free + 1, F.size(last)))
            return F.struct(F.when(free == 0, F.array_append(last, own)).when(e > s, changed).otherwise(last).alias("last"), F.array_append(acc["cols"], col).alias("cols"))

        return _let(F.array_position(F.transform(last, lambda y: (y["e"] <= s) | (y["s"] >= e)), F.lit(True)).cast("int"), put)

    groups = timed.groupBy("user_id", "day", "cluster").agg(queue.alias("queue"))
    placed = groups.select("user_id", "day", F.explode(F.arrays_zip("queue", F.aggregate("queue", begin, place, lambda acc: acc["cols"]).alias("col"))).alias("x"))
    return placed.select("user_id", "day", F.col("x.queue.id").alias("id"), F.col("x.queue.s").cast("int").alias("s"), F.col("x.queue.e").cast("int").alias("e"), F.col("x.col").alias("col"))


def geometry(slots: DataFrame) -> DataFrame:
    """Where a packed event is drawn."""
    col = F.col("col")
    return slots.withColumns({
        "top": F.col("s") / 60.0 * HOUR_HEIGHT, "height": (F.col("e") - F.col("s")) / 60.0 * HOUR_HEIGHT,
        "left": F.when(col == 0, 0.0).otherwise(col * 0.1), "width": F.when(col == 0, 1.0).otherwise(0.9), "z": col + 10,
    })


def overlaps(events: DataFrame) -> DataFrame:
    """Pairs of one owner's timed events that overlap on a day (half-open): ``day``, ``a``, ``b``."""
    x = clusters(clipped(touched_days(events.filter(~is_multi_day())))).select("user_id", "day", "cluster", "id", "s", "e")
    y = x.select("user_id", "day", "cluster", F.col("id").alias("b"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    return x.join(y, ["user_id", "day", "cluster"]).filter("id < b and s < e2 and s2 < e").select("user_id", "day", F.col("id").alias("a"), "b")


def all_day_bounds(events: DataFrame) -> DataFrame:
    """All-day events from the first to the last millisecond of their days."""
    whole = F.coalesce(F.col("all_day"), F.lit(False))
    last = F.to_date("end").cast("timestamp_ntz") + F.expr("interval '1' day - interval '0.001' second")
    return events.withColumns({"start": F.when(whole, F.to_date("start").cast("timestamp_ntz")).otherwise(F.col("start")), "end": F.when(whole, last).otherwise(F.col("end"))})


def touched_local_days(events: DataFrame, zone: str) -> DataFrame:
    """Adds ``day`` and ``minutes``: a row per day of a zone that an event (moments in UTC) touches, with the minutes that it takes of it.

    A day is from its first moment to the next day's, 23 or 25 hours where the clocks change.
    """
    local = touched_days(events.withColumns({"_start": F.col("start"), "_end": F.col("end"), "start": dates.to_local(F.col("start"), zone), "end": dates.to_local(F.col("end"), zone)}))
    a, b = F.greatest("_start", dates.local_day_start(F.col("day"), zone)), F.least("_end", dates.local_day_start(F.date_add("day", 1), zone))
    minutes = F.greatest(F.lit(0).cast("long"), dates.minutes_between(a, b))
    return local.withColumns({"minutes": minutes, "start": F.col("_start"), "end": F.col("_end")}).drop("_start", "_end")
