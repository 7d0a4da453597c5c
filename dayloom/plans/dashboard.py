"""Task, tag, mood, quote and service queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayloom.functions import arrays, dates, numbers, text
from dayloom.operators import analytics as A
from dayloom.operators import validate
from dayloom.sources import tables as T
from dayloom.sources.tables import STAMP, with_views

AS_OF = "2024-01-20 12:00:00"
QUOTE_DAY = "1995-03-15"
OWNER = 7
#: Old color names.
PALETTE = {"c0": "blue", "c1": "orange", "c2": "violet"}
HEX = {"blue": "#3b82f6", "orange": "#f97316", "violet": "#8b5cf6"}


def stamp(c: str):
    return F.date_format(c, STAMP)


def needs_vs_wants(spark, d):
    return A.needs_vs_wants(T.reminders(spark, d))


def todo_snapshot(spark, d):
    return A.todo_snapshot(T.reminders(spark, d), AS_OF)


def top_tags(spark, d):
    return A.top(A.tag_counts(T.reminders(spark, d)), [F.col("n").desc(), "tag"], 5)


def upcoming_reminders(spark, d):
    r = A.top(A.open_items(T.reminders(spark, d)), A.due_order(), 5, ("user_id",))
    label = text.or_default(text.first_underscore(F.col("category")), "N/A")
    return r.select("user_id", F.col("nth").cast("int").alias("nth"), "id", "is_pinned", F.coalesce(stamp("due_date"), F.lit("--")).alias("due"), label.alias("category"))


def reading_list_topn(spark, d):
    r = A.open_items(T.reminders(spark, d)).filter("category is not null")
    most = arrays.lookup({"reading_list": 5, "need_to_do": 2, "want_to_do": 2}, F.col("category"))
    return A.top(r, A.due_order(), 5, ("user_id", "category")).filter(F.col("nth") <= most).select("user_id", "category", F.col("nth").cast("int").alias("nth"), "id")


def quote_fallback(spark, d):
    q = T.quotes(spark, d)
    found = [A.scheduled_or_latest(q, day).withColumn("day", F.lit(day)) for day in (QUOTE_DAY, "2030-01-01")]
    return found[0].unionByName(found[1]).select("day", "id", "quote_text", F.date_format("scheduled_date", "yyyy-MM-dd").alias("scheduled"))


def energy_daily(spark, d):
    return A.energy_by_day(T.reminders(spark, d), AS_OF)


def hour_histogram(spark, d):
    return A.hour_histogram(T.reminders(spark, d))


def mood_by_energy(spark, d):
    notes = T.table(spark, d, "documents", "doc_id", "text").withColumn("energy_scale", (1 + F.col("doc_id") % 10).cast("int"))
    return A.mood_by_energy(notes)


def completed_list(spark, d):
    r = A.open_items(T.reminders(spark, d), completed=True)
    order = [F.col("created_at").desc_nulls_first(), "id"]
    return A.top(r, order, 3, ("user_id",)).select("user_id", F.col("nth").cast("int").alias("nth"), "id", stamp("created_at").alias("created"))


def palette(spark, d):
    r = T.reminders(spark, d)
    color = F.when(F.col("id") % 5 == 0, "violet").when(F.col("id") % 7 == 0, "orange").otherwise(F.col("color"))
    name = arrays.known_or_mapped(F.col("color"), list(HEX), PALETTE, "blue")
    n = r.groupBy(color.alias("color")).agg(F.count("*").alias("n"))
    return n.select("color", name.alias("name"), arrays.lookup(HEX, F.col("color")).alias("hex"), "n")


def tag_arrays(spark, d):
    r = T.reminders(spark, d)
    t = F.col("tags")
    return r.select(
        "id", F.array_join(arrays.add_if_absent(t, F.lit(" click ")), "|").alias("added"), F.array_join(arrays.add(t, F.lit("click")), "|").alias("appended"),
        F.array_join(arrays.without(t, F.lit("click")), "|").alias("removed"), F.array_join(arrays.without_at(t, 0), "|").alias("removed_at"),
        arrays.any_contains(t, "K3").alias("has_k3"), F.array_position(t, "k1").cast("int").alias("at_k1"), arrays.first_or(t, "none").alias("first_tag"),
    )


def distinct_tags(spark, d):
    tags = T.reminders(spark, d).select("id", F.posexplode("tags").alias("pos", "tag"))
    return tags.groupBy("tag").agg(F.min(F.struct("id", "pos")).alias("seen")).select("tag", F.col("seen.id").alias("first_id"), F.col("seen.pos").cast("int").alias("first_pos"))


def reminder_violations(spark, d):
    r = T.reminders(spark, d).withColumn("energy_scale", F.col("energy_scale") + F.when(F.col("id") % 9 == 0, 5).otherwise(0)).withColumn("title", F.when(F.col("id") % 10 == 0, " ").otherwise(F.col("title")))
    return validate.check(r, validate.reminder_rules()).select("id", F.array_join("violations", "; ").alias("violations"), F.size("violations").cast("int").alias("n"))


def status_summary(spark, d):
    s = A.status_summary(T.diagnostics(spark, d), by=("user_id",))
    return s.withColumn("says", A.severity_message(F.col("total"), F.col("n_warning"), F.col("n_error")))


def latency_positive_only(spark, d):
    return A.status_summary(T.diagnostics(spark, d), positive_latency=True, by=("name",)).select("name", "total", "latency_avg", "overall")


def service_buckets(spark, d):
    return A.bucket_counts(T.diagnostics(spark, d)).select("bucket", "place", "n", F.array_join("names", ", ").alias("names"))


def table_probe(spark, d):
    return T.probe(spark, d, ["events", "orders", "no_such_table"]).select("name", "ok")


def missing_settings(spark, d):
    missing = validate.missing_settings({"url": "x", "mail_key": "", "search_key": None})
    masked = text.mask_secret(F.lit("mail_key"), F.lit("abcdefghij"))
    redacted = text.redact(F.create_map(F.lit("user"), F.lit("u"), F.lit("token"), F.lit("t")), ["token"])
    return spark.range(1).select(F.array_join(missing, ",").alias("missing"), masked.alias("masked"), F.try_element_at(redacted, F.lit("token")).alias("token"), F.try_element_at(redacted, F.lit("user")).alias("user"))


def energy_bars(spark, d):
    r = T.reminders(spark, d).groupBy("energy_scale").agg(F.count("*").alias("n"))
    return r.select("energy_scale", numbers.bar_percent(F.col("energy_scale")).cast("int").alias("bar"), numbers.clamp(F.col("energy_scale"), F.lit(2), F.lit(8)).cast("int").alias("clamped"), "n")


def relative_time(spark, d):
    now = F.lit(AS_OF).cast("timestamp_ntz")
    return T.reminders(spark, d).filter(F.col("created_at") <= now).select("id", dates.ago(F.col("created_at"), now).alias("ago"))


def service_rows(spark, d):
    """The first rows of the list by bucket."""
    r = A.bucketed(T.diagnostics(spark, d)).orderBy("place", "id").limit(200)
    from pyspark.sql import Window

    return r.withColumn("nth", F.row_number().over(Window.orderBy("place", "id"))).select("nth", "bucket", "id", "name")  # 200 rows


def owner_reminders(spark, d):
    r = A.open_items(T.owned(spark, d, "reminders", OWNER))
    return r.select("id", "is_pinned", F.coalesce(stamp("due_date"), F.lit("--")).alias("due"))


def local_hours(spark, d):
    return A.hour_histogram(T.reminders(spark, d), zone="+05:30")


def tag_names(spark, d):
    return T.tags(spark, d).groupBy("name").agg(F.min("id").alias("id")).orderBy("name").limit(50)


def revenue_total(spark, d):
    r = T.monthly_revenue(spark).agg(F.sum("total").alias("total"), F.max("total").alias("best"), F.count("*").alias("months"))
    return r.withColumn("active", F.lit(T.users(spark).filter("status = 'active'").count()))


# --- an owner's pages, and relations of fixed values beside the tables ----------------------------


def owner_dashboard(spark, d):
    """An owner's dashboard in one row: every relation is read for that owner only."""
    me = T.Owner(spark, d, OWNER)
    r = me.reminders
    todo = A.todo_snapshot(r, AS_OF).drop("user_id").withColumnRenamed("label", "focus")
    first = A.top(A.open_items(r), A.due_order(), 1).select(F.col("id").alias("first_due"))
    balance = F.sum(F.round(numbers.signed_amount(F.col("type"), F.col("amount")) * 100).cast("long")).alias("cents")
    parts = [A.needs_vs_wants(r).drop("user_id"), first, me.prompts.agg(F.count("*").alias("prompts")), me.calendar_events.agg(F.count("*").alias("events")), me.transactions.agg(balance)]
    row = lambda df: df.withColumn("_one", F.lit(1))
    out = row(todo)
    for part in parts:  # a row each
        out = out.join(row(part), "_one", "left")
    return out.drop("_one")


def fixed_amounts(spark, d):
    """Line totals in fixed decimals, as text."""
    li = T.table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax")
    total = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return li.select("l_orderkey", "l_linenumber", numbers.fixed(total, 2).alias("total"), numbers.fixed(-total / 7, 1).alias("part"))


def type_maps(spark, d):
    """Counts by type of each user as a map, its entries by key, and back from JSON."""
    n = T.table(spark, d, "events", "user_id", "event_type").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    m = n.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("m"))  # a row a type
    each = F.array_join(F.transform(arrays.entries(F.col("m")), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ",")
    back = F.from_json(F.to_json("m"), "map<string,long>")
    return m.select("user_id", each.alias("entries"), F.aggregate(F.map_values(back), F.lit(0).cast("long"), lambda a, b: a + b).alias("total"), F.array_max(F.map_values("m")).alias("most"))


def json_forms(spark, d):
    """Properties parsed with a declared schema, printed again, short and indented; what is no JSON gives nulls."""
    e = T.table(spark, d, "events", "event_id", "props").withColumn("raw", F.when(F.col("event_id") % 9 == 0, F.substring("props", 1, 4)).otherwise(F.col("props")))
    x = F.from_json("raw", "k long")
    return e.select("event_id", x["k"].alias("k"), F.when(x["k"].isNotNull(), F.to_json(x)).alias("short"), F.when(x["k"].isNotNull(), text.pretty_json(x)).alias("long"))


def account_users(spark, d):
    """The listed users with what their accounts hold: fixed rows joined to the table, for the owners asked only."""
    users = T.users(spark).filter(F.col("id").isin(1, 3))
    t = T.transactions(spark, d).join(F.broadcast(users.select("id").withColumnRenamed("id", "user_id")), "user_id", "left_semi")  # two rows
    n = t.groupBy("user_id").agg(F.count("*").alias("n"))
    return users.join(n, F.col("id") == F.col("user_id"), "left").select("id", F.concat_ws(" ", "name", "surname").alias("name"), "status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def revenue_months(spark, d):
    """The planned revenue of each month beside the orders' of all years."""
    plan = T.monthly_revenue(spark)
    o = T.table(spark, d, "orders", "o_orderdate", "o_totalprice").groupBy(F.date_format("o_orderdate", "MMM").alias("name"))
    got = o.agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"), F.count("*").alias("orders"))
    return plan.join(got, "name", "left").select("name", "total", F.coalesce("cents", F.lit(0)).cast("long").alias("cents"), F.coalesce("orders", F.lit(0)).cast("long").alias("orders"))


def service_settings(spark, d):
    """Settings of services from the suppliers' rows: which are unset, and how they may be shown."""
    s = T.table(spark, d, "supplier", "s_suppkey", "s_name", "s_acctbal")
    k = F.col("s_suppkey")
    key = F.when(k % 3 != 0, F.concat(F.lit("key-"), F.col("s_name")))
    both = s.withColumn("m", F.create_map(F.lit("url"), F.when(k % 4 == 0, F.lit("  ")).otherwise(F.lit("https://mail.example")), F.lit("mail_key"), key, F.lit("token"), F.md5("s_name")))
    shown = text.redact(F.col("m"), ["token"])
    return both.select(k.alias("id"), F.array_join(validate.unset(F.col("m"), ["mail_key", "url", "search_key"]), ",").alias("unset"), text.mask_secret(F.lit("mail_key"), key).alias("masked"), text.mask_secret(F.lit("url"), F.col("s_name")).alias("plain"), F.try_element_at(shown, F.lit("token")).alias("token"))


_R = lambda sql: with_views(sql, "reminders")
_DUE = "is_pinned DESC NULLS FIRST, due_date ASC NULLS LAST, id"
_SUMMARY = """count(*) AS total, count(*) FILTER (WHERE status = 'success') AS n_success, count(*) FILTER (WHERE status = 'warning') AS n_warning, count(*) FILTER (WHERE status = 'error') AS n_error"""
_BUCKET = "CASE WHEN name LIKE '%Supabase%' OR name LIKE '%Database%' THEN 'Database' WHEN name LIKE '%OpenAI%' THEN 'OpenAI' WHEN name LIKE '%Twitter%' THEN 'Social Media' ELSE 'External' END"
_OVERALL = "CASE max(CASE status WHEN 'error' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END) WHEN 3 THEN 'error' WHEN 2 THEN 'warning' ELSE 'success' END AS overall"

QUERIES = {
    "needs_vs_wants": (needs_vs_wants, _R("""
        , a AS (SELECT user_id, coalesce(sum(energy_scale) FILTER (category = 'need_to_do') / count(*) FILTER (category = 'need_to_do'), 0)::DOUBLE AS need_avg,
          coalesce(sum(energy_scale) FILTER (category = 'want_to_do') / count(*) FILTER (category = 'want_to_do'), 0)::DOUBLE AS want_avg
          FROM reminders WHERE category IN ('need_to_do', 'want_to_do') GROUP BY user_id)
        SELECT user_id, need_avg, want_avg, CASE WHEN need_avg > want_avg THEN 'Needs First' ELSE 'Wants First' END AS label FROM a""")),
    "todo_snapshot": (todo_snapshot, _R(f"""
        , o AS (SELECT * FROM reminders WHERE is_open AND NOT is_done),
        a AS (SELECT user_id, count(*) AS n, (sum(energy_scale) / count(*))::DOUBLE AS energy_avg, count(*) FILTER (WHERE energy_scale >= 7) AS n_high,
              count(*) FILTER (WHERE due_date < date_trunc('day', TIMESTAMP '{AS_OF}')) AS n_overdue FROM o GROUP BY user_id),
        t AS (SELECT user_id, tag, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, tag) AS k FROM (SELECT user_id, unnest(tags) AS tag FROM o) GROUP BY user_id, tag)
        SELECT a.*, coalesce(tag, 'None') AS top_tag, CASE WHEN n_high > 0 OR n_overdue > 0 THEN 'Morning' ELSE 'Afternoon' END AS label
        FROM a LEFT JOIN t ON a.user_id = t.user_id AND k = 1""")),
    "top_tags": (top_tags, _R("SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM reminders) GROUP BY tag ORDER BY n DESC, tag LIMIT 5")),
    "upcoming_reminders": (upcoming_reminders, _R(f"""
        SELECT user_id, nth::INTEGER AS nth, id, is_pinned, coalesce(strftime(due_date, '%Y-%m-%d %H:%M:%S'), '--') AS due,
          coalesce(regexp_replace(category, '^([^_]*)_', '\\1 '), 'N/A') AS category
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {_DUE}) AS nth FROM reminders WHERE is_open AND NOT is_done) WHERE nth <= 5""")),
    "reading_list_topn": (reading_list_topn, _R(f"""
        SELECT user_id, category, nth::INTEGER AS nth, id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, category ORDER BY {_DUE}) AS nth
          FROM reminders WHERE is_open AND NOT is_done AND category IS NOT NULL) WHERE nth <= CASE category WHEN 'reading_list' THEN 5 ELSE 2 END""")),
    "quote_fallback": (quote_fallback, with_views(f"""
        , days AS (SELECT unnest(['{QUOTE_DAY}', '2030-01-01']) AS day),
        r AS (SELECT day, id, quote_text, scheduled_date, row_number() OVER (PARTITION BY day ORDER BY coalesce(scheduled_date = day::DATE, false) DESC, id DESC) AS k FROM quotes, days)
        SELECT day, id, quote_text, strftime(scheduled_date, '%Y-%m-%d') AS scheduled FROM r WHERE k = 1""", "quotes")),
    "energy_daily": (energy_daily, _R(f"""
        SELECT strftime(d, '%Y-%m-%d') AS day, strftime(d, '%d %b') AS label, energy_avg FROM (SELECT created_at::DATE AS d, avg(energy_scale) AS energy_avg
          FROM reminders WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS AND energy_scale IS NOT NULL GROUP BY 1)""")),
    "hour_histogram": (hour_histogram, _R("""
        , h AS (SELECT hour(created_at) AS hour, count(*) AS n FROM reminders GROUP BY 1)
        SELECT s.hour::INTEGER AS hour, coalesce(n, 0)::BIGINT AS n FROM range(24) s(hour) LEFT JOIN h ON h.hour = s.hour""")),
    "mood_by_energy": (mood_by_energy, """
        SELECT (1 + doc_id % 10)::INTEGER AS energy_scale, count(*) FILTER (WHERE lower(text) LIKE '%great%' OR lower(text) LIKE '%good%' OR lower(text) LIKE '%happy%') AS n_good,
          count(*) FILTER (WHERE lower(text) LIKE '%bad%' OR lower(text) LIKE '%sad%' OR lower(text) LIKE '%tired%') AS n_bad FROM documents GROUP BY 1"""),
    "completed_list": (completed_list, _R("""
        SELECT user_id, nth::INTEGER AS nth, id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC NULLS FIRST, id) AS nth
          FROM reminders WHERE is_done) WHERE nth <= 3""")),
    "palette": (palette, _R("""
        , c AS (SELECT CASE WHEN id % 5 = 0 THEN 'violet' WHEN id % 7 = 0 THEN 'orange' ELSE color END AS color FROM reminders)
        SELECT color, CASE WHEN color IN ('blue', 'orange', 'violet') THEN color WHEN color = 'c1' THEN 'orange' WHEN color = 'c2' THEN 'violet' ELSE 'blue' END AS name,
          CASE color WHEN 'blue' THEN '#3b82f6' WHEN 'orange' THEN '#f97316' WHEN 'violet' THEN '#8b5cf6' END AS hex, count(*) AS n FROM c GROUP BY color""")),
    "tag_arrays": (tag_arrays, _R("""
        SELECT id, array_to_string(CASE WHEN list_contains(tags, 'click') THEN tags ELSE list_append(tags, 'click') END, '|') AS added,
          array_to_string(list_append(tags, 'click'), '|') AS appended, array_to_string([x FOR x IN tags IF x <> 'click'], '|') AS removed,
          array_to_string(tags[2:], '|') AS removed_at, len([x FOR x IN tags IF contains(lower(x), 'k3')]) > 0 AS has_k3,
          coalesce(list_position(tags, 'k1'), 0)::INTEGER AS at_k1, coalesce(tags[1], 'none') AS first_tag FROM reminders""")),
    "distinct_tags": (distinct_tags, _R("""
        SELECT tag, first_id, first_pos::INTEGER AS first_pos FROM (SELECT tag, id AS first_id, pos - 1 AS first_pos, row_number() OVER (PARTITION BY tag ORDER BY id, pos) AS k
          FROM (SELECT id, unnest(tags) AS tag, generate_subscripts(tags, 1) AS pos FROM reminders)) WHERE k = 1""")),
    "reminder_violations": (reminder_violations, _R("""
        , v AS (SELECT id, [x FOR x IN [CASE WHEN id % 10 = 0 OR title IS NULL THEN 'title is required' END,
              CASE WHEN energy_scale + CASE WHEN id % 9 = 0 THEN 5 ELSE 0 END NOT BETWEEN 1 AND 10 THEN 'energy_scale is from 1 to 10' END] IF x IS NOT NULL] AS v FROM reminders)
        SELECT id, array_to_string(v, '; ') AS violations, len(v)::INTEGER AS n FROM v""")),
    "status_summary": (status_summary, with_views(f"""
        SELECT user_id, {_SUMMARY}, coalesce(avg(latency), 0) AS latency_avg,
          count(*) FILTER (WHERE status = 'error' AND (message LIKE '%not configured%' OR message LIKE '%credentials are not%')) AS n_unset,
          (100 * count(*) FILTER (WHERE status = 'success') / count(*))::DOUBLE AS success_pct, {_OVERALL},
          CASE WHEN count(*) FILTER (WHERE status = 'error') > 0 THEN count(*) FILTER (WHERE status = 'error') || ' of ' || count(*) || ' failed'
            WHEN count(*) FILTER (WHERE status = 'warning') > 0 THEN count(*) FILTER (WHERE status = 'warning') || ' of ' || count(*) || ' with warnings' ELSE 'all working' END AS says FROM diagnostics GROUP BY user_id""", "diagnostics")),
    "latency_positive_only": (latency_positive_only, with_views(f"""
        SELECT name, count(*) AS total, coalesce(avg(latency) FILTER (latency > 0), 0) AS latency_avg, {_OVERALL} FROM diagnostics GROUP BY name""", "diagnostics")),
    "service_buckets": (service_buckets, with_views(f"""
        , b AS (SELECT name, {_BUCKET} AS bucket FROM diagnostics)
        SELECT bucket, list_position(['Database', 'OpenAI', 'Social Media', 'External'], bucket)::INTEGER AS place, count(*) AS n, string_agg(DISTINCT name, ', ' ORDER BY name) AS names FROM b GROUP BY bucket""", "diagnostics")),
    "service_rows": (service_rows, with_views(f"""
        , b AS (SELECT id, name, {_BUCKET} AS bucket FROM diagnostics)
        SELECT (row_number() OVER (ORDER BY list_position(['Database', 'OpenAI', 'Social Media', 'External'], bucket), id))::INTEGER AS nth, bucket, id, name FROM b ORDER BY nth LIMIT 200""", "diagnostics")),
    "owner_reminders": (owner_reminders, _R(f"""
        SELECT id, is_pinned, coalesce(strftime(due_date, '%Y-%m-%d %H:%M:%S'), '--') AS due FROM reminders WHERE user_id = {OWNER} AND is_open AND NOT is_done""")),
    "local_hours": (local_hours, _R("""
        , h AS (SELECT hour(created_at + INTERVAL 330 MINUTE) AS hour, count(*) AS n FROM reminders GROUP BY 1)
        SELECT s.hour::INTEGER AS hour, coalesce(n, 0)::BIGINT AS n FROM range(24) s(hour) LEFT JOIN h ON h.hour = s.hour""")),
    "tag_names": (tag_names, with_views("SELECT name, min(id) AS id FROM tags GROUP BY name ORDER BY name LIMIT 50", "tags")),
    "revenue_total": (revenue_total, f"SELECT {sum(n for _, n in T.REVENUE)}::BIGINT AS total, {max(n for _, n in T.REVENUE)}::BIGINT AS best, {len(T.REVENUE)}::BIGINT AS months, 2::BIGINT AS active"),
    "table_probe": (table_probe, "SELECT * FROM (VALUES ('events', true), ('orders', true), ('no_such_table', false)) t(name, ok)"),
    "missing_settings": (missing_settings, "SELECT 'mail_key,search_key' AS missing, 'abc...hij' AS masked, '[redacted]' AS token, 'u' AS user"),
    "owner_dashboard": (owner_dashboard, with_views(f"""
        , r AS (SELECT * FROM reminders WHERE user_id = {OWNER}), o AS (SELECT * FROM r WHERE is_open AND NOT is_done),
        a AS (SELECT count(*) AS n, (sum(energy_scale) / count(*))::DOUBLE AS energy_avg, count(*) FILTER (WHERE energy_scale >= 7) AS n_high, count(*) FILTER (WHERE due_date < date_trunc('day', TIMESTAMP '{AS_OF}')) AS n_overdue FROM o),
        w AS (SELECT coalesce(sum(energy_scale) FILTER (category = 'need_to_do') / count(*) FILTER (category = 'need_to_do'), 0)::DOUBLE AS need_avg,
          coalesce(sum(energy_scale) FILTER (category = 'want_to_do') / count(*) FILTER (category = 'want_to_do'), 0)::DOUBLE AS want_avg FROM r)
        SELECT a.*, (SELECT tag FROM (SELECT unnest(tags) AS tag FROM o) GROUP BY tag ORDER BY count(*) DESC, tag LIMIT 1) AS top_tag, CASE WHEN n_high > 0 OR n_overdue > 0 THEN 'Morning' ELSE 'Afternoon' END AS focus,
          w.*, CASE WHEN need_avg > want_avg THEN 'Needs First' ELSE 'Wants First' END AS label, (SELECT id FROM o ORDER BY {_DUE} LIMIT 1) AS first_due,
          (SELECT count(*) FROM orders WHERE o_custkey = {OWNER}) AS prompts, (SELECT count(*) FROM events WHERE user_id = {OWNER}) AS events,
          (SELECT CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END * CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) FROM orders WHERE o_custkey = {OWNER}) AS cents FROM a, w""", "reminders")),
    "fixed_amounts": (fixed_amounts, """
        WITH t AS (SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS x FROM lineitem),
        d AS (SELECT l_orderkey, l_linenumber, CAST(printf('%.20f', x) AS DECIMAL(38, 20)) AS x, CAST(printf('%.20f', -x / 7) AS DECIMAL(38, 20)) AS y FROM t)
        SELECT l_orderkey, l_linenumber, CAST(round(x, 2) AS DECIMAL(38, 2))::VARCHAR AS total, CAST(round(y, 1) AS DECIMAL(38, 1))::VARCHAR AS part FROM d"""),
    "type_maps": (type_maps, """
        SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS entries, sum(n)::BIGINT AS total, max(n) AS most FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id"""),
    "json_forms": (json_forms, """
        WITH e AS (SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) END AS k FROM events)
        SELECT event_id, k, '{"k":' || k || '}' AS short, '{' || chr(10) || '  "k" : ' || k || chr(10) || '}' AS long FROM e"""),
    "account_users": (account_users, f"""
        SELECT id, name, status, (SELECT count(*) FROM orders WHERE o_custkey = id) AS n FROM (VALUES {", ".join(f"({u[0]}::BIGINT, '{u[1]} {u[2]}', '{u[5]}')" for u in T.USERS if u[0] in (1, 3))}) u(id, name, status)"""),
    "revenue_months": (revenue_months, f"""
        SELECT name, total::BIGINT AS total, coalesce(sum(CAST(round(o_totalprice * 100) AS BIGINT)), 0)::BIGINT AS cents, count(o_orderkey) AS orders
        FROM (VALUES {", ".join(f"('{n}', {v})" for n, v in T.REVENUE)}) p(name, total) LEFT JOIN orders ON strftime(o_orderdate, '%b') = name GROUP BY name, total"""),
    "service_settings": (service_settings, """
        SELECT s_suppkey AS id, concat_ws(',', CASE WHEN s_suppkey % 3 = 0 THEN 'mail_key' END, CASE WHEN s_suppkey % 4 = 0 THEN 'url' END, 'search_key') AS unset,
          CASE WHEN s_suppkey % 3 <> 0 THEN 'key...' || right(s_name, 3) END AS masked, s_name AS plain, '[redacted]' AS token FROM supplier"""),
    "energy_bars": (energy_bars, _R("SELECT energy_scale, (energy_scale * 10)::INTEGER AS bar, greatest(least(energy_scale, 8), 2)::INTEGER AS clamped, count(*) AS n FROM reminders GROUP BY energy_scale")),
    "relative_time": (relative_time, _R(f"""
        , m AS (SELECT id, date_sub('minute', created_at, TIMESTAMP '{AS_OF}') AS mi, date_sub('hour', created_at, TIMESTAMP '{AS_OF}') AS h,
              date_sub('day', created_at, TIMESTAMP '{AS_OF}') AS d FROM reminders WHERE created_at <= TIMESTAMP '{AS_OF}')
        SELECT id, CASE WHEN d >= 1 THEN d || ' day' || CASE WHEN d > 1 THEN 's' ELSE '' END || ' ago' WHEN h >= 1 THEN h || ' hour' || CASE WHEN h > 1 THEN 's' ELSE '' END || ' ago'
          WHEN mi >= 1 THEN mi || ' minute' || CASE WHEN mi > 1 THEN 's' ELSE '' END || ' ago' ELSE 'just now' END AS ago FROM m""")),
}
