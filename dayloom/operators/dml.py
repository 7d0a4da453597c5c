"""Changes to keyed tables, each a new DataFrame from the old one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def insert(target: DataFrame, rows: DataFrame) -> DataFrame:
    return target.unionByName(rows)


def insert_absent(target: DataFrame, rows: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """Only rows whose key is new; of several with one key the first by ``order`` (without it, by all columns)."""
    by = [order] if order else [F.struct(*[F.col(c) for c in target.columns])]
    new = rows.join(target.select(key), key, "left_anti")
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*by))).filter("_n = 1")
    return target.unionByName(first.select(*target.columns))


def upsert(target: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Rows replace those of equal key; new keys are added. ``rows`` has each key once."""
    return target.join(rows.select(key), key, "left_anti").select(*target.columns).unionByName(rows)


def update(target: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Rows replace those of equal key; rows without a partner do nothing."""
    r = rows.select(F.col(key).alias("_k"), F.struct(*[c for c in target.columns]).alias("_new"))
    both = target.join(r, F.col(key) == F.col("_k"), "left")
    return both.select(*[F.when(F.col("_k").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in target.columns])


def update_strict(target: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """``update``, failing where a row has no partner: when the query runs, in its one join, and whatever columns of it are read."""
    r = rows.select(F.col(key).alias("_k"), F.struct(*[c for c in target.columns]).alias("_new"), F.lit(True).alias("_asked"))
    both = target.withColumn("_held", F.lit(True)).join(r, F.col(key) == F.col("_k"), "full")
    now = F.struct(*[F.when(F.col("_asked"), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in target.columns])
    missing = F.raise_error(F.concat(F.lit("a row to update is not there: "), F.coalesce(F.col("_k").cast("string"), F.lit("null"))))
    return both.select(F.inline(F.when(F.col("_held").isNull(), missing).otherwise(F.array(now))))


def toggle_done(reminders: DataFrame, ids: DataFrame) -> DataFrame:
    """Flips ``is_done``; ``is_open`` takes the old ``is_done``. Both read the values before the change."""
    hit = F.col("_hit").isNotNull()
    both = reminders.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    changed = both.withColumns({"is_done": F.when(hit, ~F.col("is_done")).otherwise(F.col("is_done")), "is_open": F.when(hit, F.col("is_done")).otherwise(F.col("is_open"))})
    return changed.select(*reminders.columns)


def delete(target: DataFrame, keys: DataFrame, on=("id",)) -> DataFrame:
    """Removes the rows whose key (or key and owner) is listed."""
    return target.join(keys.select(*on).distinct(), list(on), "left_anti").select(*target.columns)


def get_or_create(members: DataFrame, names: DataFrame, on=("name", "user_id")) -> DataFrame:
    """The dimension with the missing members added, all at once; ids go on from the largest, in the order of a hash.

    A null is a name like any other: it is created once. The new members are numbered in 256 chunks of the hash's range, whose counts are summed: no task sees them all.
    """
    hashed = F.md5(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in on]))
    held = members.select(*[F.col(c).alias(f"_{c}") for c in on])
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    new = names.select(*on).distinct().join(held, same, "left_anti").withColumn("_h", hashed).withColumn("_chunk", F.substring("_h", 1, 2))
    before = F.sum("_n").over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))  # 256 rows at most
    chunks = new.groupBy("_chunk").agg(F.count("*").alias("_n")).select("_chunk", F.coalesce(before, F.lit(0)).alias("_before"))
    top = members.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    nth = F.row_number().over(Window.partitionBy("_chunk").orderBy("_h", *on))
    numbered = new.withColumn("_nth", nth).join(F.broadcast(chunks.crossJoin(top)), "_chunk")  # one row: top
    return members.select("id", *on).unionByName(numbered.select((F.col("_top") + F.col("_before") + F.col("_nth")).alias("id"), *on))
