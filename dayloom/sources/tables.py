"""Readers: the driver's tables, and the library's relations as views over them.

Every view has its SQL beside it (``SQL``), for checks against another engine. Timestamps stay without a
time zone, so that no result depends on the session's.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayloom.sources.schemas import ANSWERED_PAGE, BOOKMARK_PAGE

DAY = "yyyy-MM-dd"
STAMP = "yyyy-MM-dd HH:mm:ss"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table, with the columns asked for only."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def user_rows(df: DataFrame, user_id) -> DataFrame:
    """The rows of one owner. There is no way to read without one: a missing owner is an error."""
    if user_id is None:
        raise ValueError("an owner is required")
    return df.filter(F.col("user_id") == user_id)


def owned(spark: SparkSession, sf_dir: str, name: str, user_id) -> DataFrame:
    """A relation of this module (by its function's name), read for one owner; the filter reaches the scan."""
    return user_rows(globals()[name](spark, sf_dir), user_id)


class Owner:
    """All reads of one owner: a relation of this module by name, never another owner's rows; the filter reaches the scan."""

    def __init__(self, spark: SparkSession, sf_dir: str, user_id):
        if user_id is None:
            raise ValueError("an owner is required")
        self.spark, self.sf_dir, self.user_id = spark, sf_dir, user_id

    def __getattr__(self, name: str) -> DataFrame:
        if name not in ("reminders", "calendar_events", "prompts", "transactions", "diagnostics", "owner_changes", "visits"):
            raise AttributeError(name)
        return owned(self.spark, self.sf_dir, name, self.user_id)


def listing(spark: SparkSession, path: str, base_url: str, pattern: str = "*") -> DataFrame:
    """``name``, public ``url``, ``size`` and time of change of the files below a path, from the store's listing: their content is not read.

    ``name`` is the path below the given one; its parts are escaped in the url. Files without content aren't listed.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    root = path.rstrip("/").rsplit("/", 1)[-1]
    name = F.substring_index(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), f"/{root}/", -1)
    named = listed.select(name.alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("changed"))
    safe = F.array_join(F.transform(F.split("name", "/"), lambda x: F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))), "/")
    return named.select("name", F.concat(F.lit(base_url.rstrip("/") + "/"), safe).alias("url"), "size", "changed")


def files(spark: SparkSession, path: str, base_url: str, pattern: str = "*") -> DataFrame:
    """``name`` and public ``url`` of the files below a path."""
    return listing(spark, path, base_url, pattern).select("name", "url")


def exists(df: DataFrame) -> bool:
    """Whether there is any row; one is fetched at most."""
    return not df.limit(1).isEmpty()


def _counted(df: DataFrame, least: int, most: int, message: str) -> DataFrame:
    """``df``, failing when the query runs unless it has from ``least`` to ``most`` rows: two rows at most come together, and the input is read once."""
    row = F.struct(*[F.col(c) for c in df.columns])
    both = df.limit(most + 1).agg(F.collect_list(row).alias("rows"))
    n = F.size("rows")
    return both.select(F.inline(F.when(n.between(least, most), F.col("rows")).otherwise(F.raise_error(F.concat(F.lit(message + ": "), n.cast("string"), F.lit(" rows or more"))))))


def exactly_one(df: DataFrame) -> DataFrame:
    """``df`` if it has one row; otherwise the query fails."""
    return _counted(df, 1, 1, "not the one row that is due")


def at_most_one(df: DataFrame) -> DataFrame:
    """``df`` if it has no more than one row; otherwise the query fails."""
    return _counted(df, 0, 1, "more than the one row that may be there")


def probe(spark: SparkSession, sf_dir: str, names, at_once: int = 8) -> DataFrame:
    """``name``, ``ok``, ``message``: whether each table can be read; errors are collected, not raised.

    The probes' jobs run at the same time, ``at_once`` of them; the rows are in the order of ``names``.
    """

    def one(name):
        try:
            exists(table(spark, sf_dir, name))
            return name, True, None
        except Exception as e:  # an unreadable table is a result here
            return name, False, type(e).__name__

    with ThreadPoolExecutor(at_once) as pool:
        rows = list(pool.map(inheritable_thread_target(spark)(one), names))
    return spark.createDataFrame(rows, "name string, ok boolean, message string")


def bookmark_pages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bookmarks, authors and media of JSON pages: the schema is declared, never inferred; each table is its own scan of the columns it needs."""
    pages = spark.read.schema(BOOKMARK_PAGE).option("multiLine", "true").json(path)
    part = lambda c: pages.select(F.explode(c).alias("x")).select("x.*")
    return part("data"), part("includes.users"), part("includes.media")


def answered_pages(spark: SparkSession, path: str, whole_files: bool = False) -> tuple[DataFrame, DataFrame]:
    """JSON pages (one a line, or one a file) as they were answered, and the rejects with their ``reason`` and the ``raw`` text.

    A page is rejected if it is no JSON of the declared schema (``malformed``) or an error's answer (``status`` and its number). One without data is a page.
    """
    raw = spark.read.text(path, wholetext=whole_files).withColumnRenamed("value", "raw").filter(F.trim("raw") != "")
    page = F.from_json("raw", ANSWERED_PAGE + ", _malformed string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed"})
    read = raw.select("raw", page.alias("page")).select("raw", "page.*")
    failed = F.coalesce(F.col("status") >= 400, F.lit(False))
    reason = F.when(F.col("_malformed").isNotNull(), "malformed").when(failed, F.concat(F.lit("status "), F.col("status").cast("string")))
    judged = read.withColumn("reason", reason)
    return judged.filter("reason is null").drop("raw", "reason", "_malformed"), judged.filter("reason is not null").select("reason", "detail", "raw")


#: Literal relations, with invented values.
USERS = [(1, "Ada", "Example", "ada@users.example", "passport", "active"), (2, "Bo", "Sample", "bo@users.example", "license", "inactive"), (3, "Cy", "Instance", "cy@users.example", "passport", "active")]
REVENUE = [("Jan", 1200), ("Feb", 1500), ("Mar", 900), ("Apr", 2100), ("May", 1750), ("Jun", 1980), ("Jul", 2250), ("Aug", 2040), ("Sep", 1830), ("Oct", 1960), ("Nov", 2310), ("Dec", 2600)]


def users(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(USERS, "id long, name string, surname string, email string, id_type string, status string")


def monthly_revenue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REVENUE, "name string, total long")


def sample_events(spark: SparkSession, first: str) -> DataFrame:
    """Three events around a day, as a new calendar shows them."""
    days = spark.createDataFrame([(1, "Planning", -1, 9, 60), (2, "Review", 0, 14, 30), (3, "Trip", 2, 0, 2880)], "id long, title string, day int, hour int, minutes int")
    start = f"timestamp_ntz'{first} 00:00:00' + make_dt_interval(day, hour)"
    return days.selectExpr("id", "title", f"{start} as start", f"{start} + make_dt_interval(0, 0, minutes) as end", "minutes >= 1440 as all_day")


def quarters(spark: SparkSession) -> DataFrame:
    """The 96 starts of a quarter of an hour: ``hour``, ``minute``, ``label``."""
    q = spark.range(96).select((F.col("id") / 4).cast("int").alias("hour"), (F.col("id") % 4 * 15).cast("int").alias("minute"))
    return q.withColumn("label", F.format_string("%02d:%02d", "hour", "minute"))


# --- views over the driver's tables ---------------------------------------------------------


def reminders(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    i = F.col("event_id")
    kind = F.col("event_type")
    return e.select(
        i.alias("id"),
        "user_id",
        kind.alias("title"),
        F.col("props").alias("content"),
        F.array(kind, F.concat(F.lit("k"), (k % 5).cast("string"))).alias("tags"),
        F.col("ts").alias("created_at"),
        F.concat(F.lit("c"), (i % 4).cast("string")).alias("color"),
        (1 + i % 10).cast("int").alias("energy_scale"),
        (i % 3 == 0).alias("is_done"),
        F.when(i % 7 != 0, F.expr("ts + make_dt_interval(cast(event_id % 20 - 10 as int))")).alias("due_date"),
        (i % 3 != 0).alias("is_open"),
        (i % 11 == 0).alias("is_pinned"),
        F.when(kind == "click", "need_to_do").when(kind == "view", "want_to_do").when(kind == "purchase", "reading_list").alias("category"),
    )


def calendar_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes = "make_dt_interval(cast(case when event_id % 13 = 0 then 2 else 0 end as int), 0, cast(15 + event_id % 240 as int))"
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("title"),
        F.lit(None).cast("string").alias("description"),
        F.col("ts").alias("start"),
        F.expr(f"ts + {minutes}").alias("end"),
        (F.col("event_id") % 17 == 0).alias("all_day"),
        F.element_at(F.array(*map(F.lit, ("blue", "orange", "violet", "none"))), (F.col("event_id") % 4 + 1).cast("int")).alias("color"),
        F.lit(None).cast("string").alias("location"),
        "user_id",
    )


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.concat(F.lit("prompt "), F.col("o_orderkey").cast("string")).alias("prompt_text"), F.col("o_orderdate").alias("created_at"))


def prompt_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey").filter("l_orderkey % 3 <> 0").select(F.col("l_orderkey").alias("prompt_id"), F.col("l_partkey").alias("tag_id")).distinct()


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_brand", F.col("p_size").cast("string")).alias("name"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("quote "), F.col("o_orderkey").cast("string")).alias("quote_text"),
        F.col("o_orderpriority").alias("theme"),
        F.when(F.col("o_orderkey") % 5 != 0, F.to_date("o_orderdate")).alias("scheduled_date"),
    )


SERVICES = ("Database", "OpenAI API", "Twitter API", "mail database", "Supabase Storage", "Search API")


def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "error", "error").when(kind == "signup", "warning").otherwise("success")
    message = F.when((kind == "error") & (F.col("event_id") % 3 == 0), "Service Not Configured").when((kind == "error") & (F.col("event_id") % 3 == 1), "service not configured").when(kind.isin("error", "signup"), "API credentials are not set")
    latency = F.when(F.col("event_id") % 6 == 0, F.lit(0.0)).when(F.col("event_id") % 5 == 0, F.lit(None)).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "user_id", F.concat_ws(" ", kind, F.element_at(F.array(*map(F.lit, SERVICES)), (F.col("event_id") % len(SERVICES) + 1).cast("int"))).alias("name"), status.alias("status"), message.alias("message"), latency.alias("latency")
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_totalprice").alias("amount"), F.when(F.col("o_orderstatus") == "F", "credit").otherwise("debit").alias("type"), F.date_format("o_orderdate", DAY).alias("day"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    return d.select(F.col("doc_id").alias("id"), F.array_join(F.slice(F.split("text", r"\s+", 3), 1, 2), " ").alias("title"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("excerpt"), F.array("lang", "source").alias("tags"), F.col("text").alias("content"))


def bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookmarks as nested documents: an order with its lines, its customer as author."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_returnflag", "l_linestatus")
    arrays = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag", "l_linestatus"))).alias("lines"))
    o = table(spark, sf_dir, "orders").join(arrays, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    media = F.when(F.col("o_orderkey") % 4 != 0, F.transform("lines", lambda x: x["l_partkey"].cast("string")))
    urls = F.when(F.col("o_orderkey") % 3 != 0, F.transform("lines", lambda x: F.struct(F.concat(F.lit("https://example.com/p/"), x["l_partkey"].cast("string")).alias("expanded_url"))))
    hashtags = F.transform("lines", lambda x: F.struct(F.concat(x["l_returnflag"], x["l_linestatus"]).alias("text")))
    context = F.when(F.col("o_orderpriority") != "3-MEDIUM", F.array(F.struct(F.struct(F.col("o_orderpriority").alias("name")).alias("domain"))))
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("bookmark "), F.col("o_orderkey").cast("string")).alias("text"),
        F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderkey") % 6 != 0, F.col("o_custkey")).alias("author_id"),
        F.struct(media.alias("media_keys")).alias("attachments"),
        F.struct(urls.alias("urls"), hashtags.alias("hashtags")).alias("entities"),
        context.alias("context_annotations"),
    )


def owner_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change feed with its owners: events as inserts, updates and deletes of rows keyed by user and type."""
    op = F.element_at(F.array(*map(F.lit, ("INSERT", "UPDATE", "UPDATE", "INSERT", "DELETE"))), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("id"), F.col("event_id").alias("seq"), op.alias("op"), "user_id", "value")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return owner_changes(spark, sf_dir).drop("user_id")


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals all through the years, in UTC: an order's day at some minute, up to three hours long."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    start = F.expr("o_orderdate + make_dt_interval(0, 0, cast(o_orderkey * 37 % 1440 as int))")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), start.alias("start"), F.expr("o_orderdate + make_dt_interval(0, 0, cast(o_orderkey * 37 % 1440 + o_orderkey % 181 as int))").alias("end"), F.lit(False).alias("all_day"))


#: The views in SQL.
SQL = {
    "reminders": """SELECT event_id AS id, user_id, event_type AS title, props AS content,
      [event_type, 'k' || (CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) % 5)] AS tags, ts AS created_at, 'c' || (event_id % 4) AS color,
      CAST(1 + event_id % 10 AS INTEGER) AS energy_scale, event_id % 3 = 0 AS is_done, event_id % 3 <> 0 AS is_open, event_id % 11 = 0 AS is_pinned,
      CASE WHEN event_id % 7 <> 0 THEN ts + to_days(CAST(event_id % 20 - 10 AS INTEGER)) END AS due_date,
      CASE event_type WHEN 'click' THEN 'need_to_do' WHEN 'view' THEN 'want_to_do' WHEN 'purchase' THEN 'reading_list' END AS category FROM events""",
    "calendar_events": """SELECT event_id AS id, event_type AS title, ts AS start,
      ts + to_minutes(15 + event_id % 240) + CASE WHEN event_id % 13 = 0 THEN to_days(2) ELSE to_days(0) END AS "end", event_id % 17 = 0 AS all_day,
      ['blue', 'orange', 'violet', 'none'][event_id % 4 + 1] AS color, user_id FROM events""",
    "prompts": "SELECT o_orderkey AS id, o_custkey AS user_id, 'prompt ' || o_orderkey AS prompt_text, o_orderdate AS created_at FROM orders",
    "prompt_tags": "SELECT DISTINCT l_orderkey AS prompt_id, l_partkey AS tag_id FROM lineitem WHERE l_orderkey % 3 <> 0",
    "tags": "SELECT p_partkey AS id, p_brand || ' ' || p_size AS name FROM part",
    "quotes": "SELECT o_orderkey AS id, 'quote ' || o_orderkey AS quote_text, o_orderpriority AS theme, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) END AS scheduled_date FROM orders",
    "diagnostics": """SELECT event_id AS id, user_id, event_type || ' ' || ['Database', 'OpenAI API', 'Twitter API', 'mail database', 'Supabase Storage', 'Search API'][event_id % 6 + 1] AS name,
      CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning' ELSE 'success' END AS status,
      CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'Service Not Configured' WHEN event_type = 'error' AND event_id % 3 = 1 THEN 'service not configured'
        WHEN event_type IN ('error', 'signup') THEN 'API credentials are not set' END AS message,
      CASE WHEN event_id % 6 = 0 THEN 0.0 WHEN event_id % 5 = 0 THEN NULL ELSE value END AS latency FROM events""",
    "transactions": "SELECT o_orderkey AS id, o_custkey AS user_id, o_totalprice AS amount, CASE WHEN o_orderstatus = 'F' THEN 'credit' ELSE 'debit' END AS type, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders",
    "posts": r"SELECT doc_id AS id, array_to_string(string_split_regex(text, '\s+')[1:2], ' ') AS title, split_part(text, chr(10), 1) AS excerpt, [lang, source] AS tags, text AS content FROM documents",
    "lines": "SELECT l_orderkey, list({'n': l_linenumber, 'p': l_partkey, 'h': l_returnflag || l_linestatus} ORDER BY l_linenumber, l_partkey, l_returnflag, l_linestatus) AS lines FROM lineitem GROUP BY 1",
    "bookmarks": """SELECT o_orderkey AS id, 'bookmark ' || o_orderkey AS text, o_orderdate AS created_at, CASE WHEN o_orderkey % 6 <> 0 THEN o_custkey END AS author_id,
      CASE WHEN o_orderkey % 4 <> 0 THEN [CAST(x.p AS VARCHAR) FOR x IN lines] END AS media_keys,
      CASE WHEN o_orderkey % 3 <> 0 THEN ['https://example.com/p/' || x.p FOR x IN lines] END AS urls, [x.h FOR x IN lines] AS hashtags,
      CASE WHEN o_orderpriority <> '3-MEDIUM' THEN o_orderpriority END AS domain FROM orders LEFT JOIN lines ON o_orderkey = l_orderkey""",
    "visits": "SELECT o_orderkey AS id, o_custkey AS user_id, o_orderdate + to_minutes(o_orderkey * 37 % 1440) AS start, o_orderdate + to_minutes(o_orderkey * 37 % 1440 + o_orderkey % 181) AS \"end\" FROM orders",
    "owner_changes": "SELECT user_id || '-' || event_type AS id, event_id AS seq, ['INSERT', 'UPDATE', 'UPDATE', 'INSERT', 'DELETE'][event_id % 5 + 1] AS op, user_id, value FROM events",
    "changes": "SELECT user_id || '-' || event_type AS id, event_id AS seq, ['INSERT', 'UPDATE', 'UPDATE', 'INSERT', 'DELETE'][event_id % 5 + 1] AS op, value FROM events",
}


def with_views(sql: str, *names: str) -> str:
    """``sql`` with the named views before it; ``sql`` may go on with views of its own after a comma."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + " " + sql.strip()
