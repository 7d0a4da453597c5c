"""Task, tag, mood and service analytics: DataFrame in, DataFrame out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayloom.functions import dates
from dayloom.functions.numbers import mean_or_zero
from dayloom.session import scratch

GOOD, BAD = ("great", "good", "happy"), ("bad", "sad", "tired")


def open_items(reminders: DataFrame, completed: bool = False) -> DataFrame:
    return reminders.filter("is_done" if completed else "is_open and not is_done")


def _mean_of(cond) -> Column:
    """The mean energy of the rows that meet a condition: nulls count as 0, no rows give 0."""
    return mean_or_zero(F.sum(F.when(cond, F.coalesce("energy_scale", F.lit(0)))), F.count_if(cond)).cast("double")


def needs_vs_wants(reminders: DataFrame, by=("user_id",)) -> DataFrame:
    """Mean energy of needs and of wants, and which comes first (wants, on a tie)."""
    need, want = F.col("category") == "need_to_do", F.col("category") == "want_to_do"
    out = reminders.filter(F.col("category").isin("need_to_do", "want_to_do")).groupBy(*by).agg(_mean_of(need).alias("need_avg"), _mean_of(want).alias("want_avg"))
    return out.withColumn("label", F.when(F.col("need_avg") > F.col("want_avg"), "Needs First").otherwise("Wants First"))


def tag_counts(df: DataFrame, by=(), tags: str = "tags") -> DataFrame:
    one = df.select(*by, F.explode(F.coalesce(F.col(tags), F.array().cast("array<string>"))).alias("tag"))
    return one.groupBy(*by, "tag").agg(F.count("*").alias("n"))


def top(df: DataFrame, order, n: int, by=()) -> DataFrame:
    """The first n rows of each group, numbered as ``nth``; without groups a plain top-n."""
    if by:
        return df.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("nth") <= n)
    return df.orderBy(*order).limit(n)


def todo_snapshot(reminders: DataFrame, as_of: str) -> DataFrame:
    """Per owner, of the open items: mean energy, high-energy and overdue counts, the part of the day to focus in, the most used tag."""
    items = open_items(reminders)
    start = F.date_trunc("day", F.lit(as_of).cast("timestamp_ntz")).cast("timestamp_ntz")
    high, overdue = F.col("energy_scale") >= 7, F.coalesce(F.col("due_date") < start, F.lit(False))
    out = items.groupBy("user_id").agg(F.count("*").alias("n"), _mean_of(F.lit(True)).alias("energy_avg"), F.count_if(high).alias("n_high"), F.count_if(overdue).alias("n_overdue"))
    best = top(tag_counts(items, ("user_id",)), [F.col("n").desc(), "tag"], 1, ("user_id",)).select("user_id", F.col("tag").alias("top_tag"))
    label = F.when((F.col("n_high") > 0) | (F.col("n_overdue") > 0), "Morning").otherwise("Afternoon")
    return out.join(best, "user_id", "left").withColumn("top_tag", F.coalesce("top_tag", F.lit("None"))).withColumn("label", label)


def due_order() -> list[Column]:
    """Pinned first, then by due date, those without one last; then by id."""
    return [F.col("is_pinned").desc_nulls_first(), F.col("due_date").asc_nulls_last(), F.col("id")]


def scheduled_or_latest(quotes: DataFrame, day: str) -> DataFrame:
    """The quote scheduled for a day, else the latest."""
    today = F.col("scheduled_date").eqNullSafe(F.lit(day).cast("date"))
    return quotes.orderBy(today.desc(), F.col("id").desc()).limit(1)


def energy_by_day(reminders: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    now = F.lit(as_of).cast("timestamp_ntz")
    recent = reminders.filter((F.col("created_at") >= now - F.expr(f"interval {days} days")) & F.col("energy_scale").isNotNull())
    return recent.groupBy(F.to_date("created_at").alias("d")).agg(F.avg("energy_scale").alias("energy_avg")).select(F.date_format("d", "yyyy-MM-dd").alias("day"), F.date_format("d", "dd MMM").alias("label"), "energy_avg")


def hour_histogram(df: DataFrame, column: str = "created_at", zone: str | None = None) -> DataFrame:
    """Rows per hour of the day (of a time zone, for moments in UTC), all 24 hours."""
    hour = dates.local_hour(F.col(column), zone) if zone else F.hour(column)
    counts = df.groupBy(hour.alias("hour")).agg(F.count("*").alias("n"))
    spine = df.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return spine.join(counts, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def mood_by_energy(notes: DataFrame, text: str = "text", good=GOOD, bad=BAD) -> DataFrame:
    """Notes that hold a good, a bad word (as substrings; a note may hold both), by energy."""
    low = F.lower(F.col(text))
    holds = lambda words: F.coalesce(F.expr("false") if not words else _any([F.contains(low, F.lit(w)) for w in words]), F.lit(False))
    return notes.groupBy("energy_scale").agg(F.count_if(holds(good)).alias("n_good"), F.count_if(holds(bad)).alias("n_bad"))


def _any(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def status_summary(results: DataFrame, positive_latency: bool = False, by=()) -> DataFrame:
    """Counts by status, mean latency (of all, or of those above 0), those not configured, share of successes, and the gravest status."""
    says = F.coalesce("message", F.lit(""))
    unset = (F.col("status") == "error") & _any([F.contains(says, F.lit(w)) for w in UNSET])
    latency = F.when(F.col("latency") > 0, F.col("latency")) if positive_latency else F.col("latency")
    rank = F.max(F.when(F.col("status") == "error", 3).when(F.col("status") == "warning", 2).otherwise(1))
    count = lambda s: F.count_if(F.col("status") == s)
    return results.groupBy(*by).agg(
        F.count("*").alias("total"), count("success").alias("n_success"), count("warning").alias("n_warning"), count("error").alias("n_error"),
        F.coalesce(F.avg(latency), F.lit(0.0)).alias("latency_avg"), F.count_if(unset).alias("n_unset"),
        F.try_divide(100 * count("success"), F.count("*")).cast("double").alias("success_pct"),
        F.when(rank == 3, "error").when(rank == 2, "warning").otherwise("success").alias("overall"),
    )


# fixed values: groups of services, the words that their names hold, and the phrases of a service that isn't set up
BUCKETS = (("Database", ("Supabase", "Database")), ("OpenAI", ("OpenAI",)), ("Social Media", ("Twitter",)))
OTHER = "External"
UNSET = ("not configured", "credentials are not")


def bucket_of(name: Column, buckets=BUCKETS, other: str = OTHER) -> Column:
    """The first bucket with a word that the name holds, in the same case."""
    out = F.lit(other)
    for title, words in reversed(buckets):
        out = F.when(_any([F.contains(name, F.lit(w)) for w in words]), title).otherwise(out)
    return out


def bucketed(results: DataFrame) -> DataFrame:
    """Adds ``bucket`` and ``place``, its position among the buckets; sort by place and the rows' own order to list them."""
    order = F.array(*[F.lit(t) for t, _ in BUCKETS], F.lit(OTHER))
    return results.withColumn("bucket", bucket_of(F.col("name"))).withColumn("place", F.array_position(order, F.col("bucket")).cast("int"))


def bucket_counts(results: DataFrame) -> DataFrame:
    """Rows and different names of each bucket; empty ones don't appear."""
    return bucketed(results).groupBy("bucket", "place").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("name")).alias("names"))


def severity_message(total: Column, n_warning: Column, n_error: Column) -> Column:
    """One line on a summary's gravest status."""
    of = lambda n, what: F.concat(n.cast("string"), F.lit(" of "), total.cast("string"), F.lit(f" {what}"))
    return F.when(n_error > 0, of(n_error, "failed")).when(n_warning > 0, of(n_warning, "with warnings")).otherwise("all working")


def arg_max(counts: DataFrame, key: str) -> DataFrame:
    """The key with the largest ``n`` (the first, on a tie): one row; ``None`` and null for an empty input."""
    best = counts.agg(F.min(F.struct((-F.col("n")).alias("order"), key, "n")).alias("x"))
    return best.select(F.coalesce(f"x.{key}", F.lit("None")).alias(key), F.col("x.n").alias("n"))


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the first by an order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_n = 1").drop("_n")


def nested_tags(prompts: DataFrame, bridge: DataFrame, tags: DataFrame) -> DataFrame:
    """Every prompt with its tags as an array of structs, empty where it has none."""
    linked = bridge.join(tags.withColumnRenamed("id", "tag_id"), "tag_id").groupBy("prompt_id").agg(F.array_sort(F.collect_list(F.struct("name", F.col("tag_id").alias("id")))).alias("tags"))
    out = prompts.join(linked, F.col("id") == F.col("prompt_id"), "left").drop("prompt_id")
    return out.withColumn("tags", F.coalesce("tags", F.array().cast("array<struct<name:string,id:bigint>>")))


def find_or_first(df: DataFrame, key: Column, order: str = "id") -> DataFrame:
    """The row of a key, else the first row."""
    return df.orderBy(F.coalesce(key, F.lit(False)).desc(), order).limit(1)


def enriched_bookmarks(bookmarks: DataFrame, authors: DataFrame, media: DataFrame) -> DataFrame:
    """Bookmarks flattened: author by id (or ``Unknown``), the first medium, links, hashtags, the first context."""
    who = first_per_key(authors.select(F.col("id").alias("_a"), F.col("name").alias("_name")), "_a", "_name")
    pic = first_per_key(media.select(F.col("media_key").alias("_m"), F.coalesce(F.nullif("url", F.lit("")), "preview_image_url").alias("_url")), "_m", "_url")
    urls = F.coalesce(F.transform("entities.urls", lambda x: x["expanded_url"]), F.array().cast("array<string>"))
    hashtags = F.coalesce(F.transform("entities.hashtags", lambda x: x["text"]), F.array().cast("array<string>"))
    b = bookmarks.withColumn("_key", F.get("attachments.media_keys", F.lit(0)))
    out = b.join(who, F.col("author_id") == F.col("_a"), "left").join(pic, F.col("_key") == F.col("_m"), "left")
    return out.select(
        "id", "text", "created_at", F.coalesce("_name", F.lit("Unknown")).alias("author_name"), F.col("_url").alias("media_url"), urls.alias("urls"), hashtags.alias("hashtags"),
        F.get("context_annotations", F.lit(0))["domain"]["name"].alias("context_domain"),
    )


def numbered(df: DataFrame, key: str, order: str, name: str, chunk: int = 100_000) -> DataFrame:
    """Adds the row's number (from 0) among those of its key, by a whole-number order.

    A key's rows are numbered in chunks of the order's range, and the chunks' counts are summed: a key with
    very many rows is spread over tasks.
    """
    c = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    sizes = c.groupBy(key, "_chunk").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy(key, "_chunk").orderBy(order)) - 1
    sizes = sizes.withColumnsRenamed({key: "_key", "_chunk": "_at"})
    both = c.withColumn(name, own).join(sizes, F.col(key).eqNullSafe(F.col("_key")) & F.col("_chunk").eqNullSafe(F.col("_at")))
    return both.withColumn(name, (F.col(name) + F.col("_before")).cast("int")).drop("_chunk", "_before", "_key", "_at")


def unique_slugs(posts: DataFrame, base: str = "base", order: str = "id") -> DataFrame:
    """Adds ``slug``: the base for the first post that has it, then base-1, base-2 and so on.

    A suffix that would meet another post's natural base is skipped: a base's free suffixes are its numbers without the taken
    ones. Posts whose base is null stay, with a null slug.
    """
    n = numbered(posts, base, order, "_nth")
    stem = F.regexp_extract(base, r"^(.*)-(\d+)$", 1)
    number = F.regexp_extract(base, r"^(.*)-(\d+)$", 2)
    taken = posts.filter(F.col(base).rlike(r"^.*-[1-9]\d{0,8}$")).select(stem.alias("_stem"), number.cast("int").alias("_k")).distinct()
    taken = taken.groupBy("_stem").agg(F.array_sort(F.collect_list("_k")).alias("_taken"))
    out = n.join(taken, F.col(base) == F.col("_stem"), "left")
    step = lambda k, t: F.when(t <= k, k + 1).otherwise(k)
    k = F.when(F.col("_nth") == 0, 0).otherwise(F.aggregate(F.coalesce("_taken", F.array().cast("array<int>")), F.col("_nth"), step))
    return out.withColumn("slug", F.when(k == 0, F.col(base)).otherwise(F.concat(base, F.lit("-"), k.cast("string")))).drop("_nth", "_stem", "_taken")


def linked_order(links: DataFrame, key: str = "token", after: str = "next_token") -> DataFrame:
    """Rows that name the next one's key: adds ``chain``, the key of the first row that leads to a row, and ``nth`` from 1.

    A row that no other names begins a chain; so does each row whose predecessor is missing. Pointers are doubled: a round joins what each row
    knows of those before it, and a chain of n rows takes log2(n) rounds, each a written table. Keys are unique, null keys and rings of rows are left out.
    """
    spark = links.sparkSession
    rows = links.filter(F.col(key).isNotNull())
    named = rows.select(F.col(after).alias("_to"), F.col(key).alias("_from")).filter("_to is not null")
    # of each row the farthest known one before it, how far that is, and whether it is a chain's first
    known = rows.select(F.col(key).alias("_key")).join(named, F.col("_key") == F.col("_to"), "left")
    known = known.select("_key", F.coalesce("_from", "_key").alias("_far"), F.when(F.col("_from").isNull(), 0).otherwise(1).cast("long").alias("_steps"), F.col("_from").isNull().alias("_first"))
    total = None
    while True:
        path = scratch(spark, "links")
        known.write.parquet(path)
        known = spark.read.schema(known.schema).parquet(path)
        done, reach = known.agg(F.count_if("_first"), F.max("_steps")).first()  # one row
        if done == total or reach is None:  # no row came to its first one in this round: what is left are rings
            break
        total = done
        back = known.select(F.col("_key").alias("_k"), F.col("_far").alias("_f"), F.col("_steps").alias("_s"), F.col("_first").alias("_b"))
        known = known.join(back, F.col("_far") == F.col("_k"), "left").select("_key", F.coalesce("_f", "_far").alias("_far"), (F.col("_steps") + F.coalesce("_s", F.lit(0))).alias("_steps"), F.coalesce(F.col("_first") | F.col("_b"), F.col("_first")).alias("_first"))
    placed = known.filter("_first").select(F.col("_key").alias(key), F.col("_far").alias("chain"), (F.col("_steps") + 1).alias("nth"))
    return rows.join(placed, key)
