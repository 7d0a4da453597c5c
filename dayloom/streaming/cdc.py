"""A change feed folded into table state, in batch and as a stream.

Per key, in the order of ``seq``: INSERT makes a row only where there is none; UPDATE replaces a row only where
there is one; DELETE removes it. So what remains of a key is decided after its last DELETE: its first
INSERT there makes the row, and the last UPDATE after that gives its values. This needs one shuffle
by key and no per-key lists.

Changes may come in any order over batches. The state is therefore not the rows but the changes that may
still matter (``compact``): a key's last DELETE, the INSERTs after it (a late DELETE between two makes the
second one count) and the last UPDATE after it (its INSERT may come late). Folding the state gives
the rows that one fold over all changes would.

With a ``lag`` the state forgets: once a change of number s has been seen, changes up to s - lag count as all known. What comes later than that is
left out, and the state drops the tombstones up to there, the updates that no insert came before, and all inserts but the first. So a live row
takes two changes at most, a removed one none, whatever its history; and the rows stay those of one fold as long as nothing
comes later than the lag. The state is a stored table by key (``sources.keyed``): a batch rewrites the buckets of its keys, and those in which something is due
to be forgotten; the number of buckets follows the state's size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dayloom.sources.keyed import ROWS_PER_BUCKET, KeyedTable


def _after_delete(changes: DataFrame) -> DataFrame:
    deleted = F.max(F.when(F.col("op") == "DELETE", F.col("seq"))).over(Window.partitionBy("id"))
    return changes.withColumn("_deleted", deleted)


def fold(changes: DataFrame, made: bool = False) -> DataFrame:
    """The rows that remain: ``id``, ``seq`` (of the change that gave the values), and the value columns; with ``made`` also the number of the insert."""
    values = [c for c in changes.columns if c not in ("id", "seq", "op", "_due")]
    c = _after_delete(changes).filter(F.col("_deleted").isNull() | (F.col("seq") > F.col("_deleted")))
    c = c.withColumn("_made", F.min(F.when(F.col("op") == "INSERT", F.col("seq"))).over(Window.partitionBy("id")))
    c = c.filter((F.col("seq") == F.col("_made")) | ((F.col("op") == "UPDATE") & (F.col("seq") > F.col("_made"))))
    last = c.groupBy("id").agg(F.max_by(F.struct("seq", *values), "seq").alias("row"), F.min("_made").alias("made"))
    return last.select("id", "row.*", *(["made"] if made else []))


def newest(changes: DataFrame, n: int) -> DataFrame:
    """The head of the list that a client shows, ``nth`` from 1: an insert goes before all rows that are there, an update leaves a row where it is."""
    head = fold(changes, made=True).orderBy(F.col("made").desc(), "id").limit(n)
    nth = F.row_number().over(Window.orderBy(F.col("made").desc(), "id"))  # n rows
    return head.withColumn("nth", nth).drop("made")


def compact(changes: DataFrame, final: int | None = None) -> DataFrame:
    """The changes that may still matter; ``fold`` gives the same for them as for all.

    ``final``: no more changes come up to this number. Adds ``_due``, the number that ``final`` must reach for the change to go, null if it stays
    anyway.
    """
    columns = [c for c in changes.columns if c != "_due"]
    by = Window.partitionBy("id")
    op, seq = F.col("op"), F.col("seq")
    last = lambda kind: F.max(F.when(op == kind, seq)).over(by)
    c = changes.select(*columns).withColumns({"_deleted": last("DELETE"), "_updated": last("UPDATE")})
    c = c.filter(F.col("_deleted").isNull() | (seq >= F.col("_deleted")))
    c = c.withColumn("_made", F.min(F.when((op == "INSERT") & (F.col("_deleted").isNull() | (seq > F.col("_deleted"))), seq)).over(by))
    dead = (op != "DELETE") & (seq == F.col("_deleted"))
    c = c.filter(~F.coalesce(dead, F.lit(False)) & ((op != "UPDATE") | (seq == F.col("_updated"))))
    stays = ((op == "INSERT") & (seq == F.col("_made"))) | ((op == "UPDATE") & (seq > F.col("_made")))
    c = c.withColumn("_due", F.when(~F.coalesce(stays, F.lit(False)), seq))
    if final is not None:
        c = c.filter(F.col("_due").isNull() | (F.col("_due") > final))
    return c.select(*columns, "_due").dropDuplicates(["id", "seq", "op"])


def apply(state: DataFrame, changes: DataFrame, final: int | None = None) -> DataFrame:
    """The state after more changes; ``fold`` of it gives the rows."""
    return compact(state.drop("_due").unionByName(changes), final)


def read_changes(spark: SparkSession, path: str, schema, files_per_trigger: int = 10, user_id=None) -> DataFrame:
    """A stream of change files; the rate is capped by files, and an owner's rows are filtered before any state."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return stream if user_id is None else stream.filter(F.col("user_id") == user_id)


def state(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The changes that may still matter, after all batches or as of a version of the table."""
    return KeyedTable(spark, path).read(number)


def rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a state."""
    return fold(state(spark, path).drop("_due"))


def start(changes: DataFrame, path: str, checkpoint: str, lag: int | None = None, rows_per_bucket: int = ROWS_PER_BUCKET, after: Callable[[DataFrame, int], None] | None = None, **trigger):
    """Folds a stream into a state at ``path``; each batch is a version of it.

    ``after`` is called with the rows as they are then, and the batch's number: what is derived from them is worked out again. A version notes the batch that made it, so a batch that is retried after it was written does nothing. The last two versions stay.
    """
    empty = changes.schema

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        table = KeyedTable(spark, path, rows_per_bucket=rows_per_bucket)
        if table.latest() is None:
            KeyedTable.create(compact(spark.createDataFrame([], empty)), path, rows_per_bucket=rows_per_bucket)
        notes = table.latest().notes
        if notes.get("batch", -1) < n and take(table, notes, batch, n):
            table.vacuum()
        if after is not None:
            after(rows(spark, path), n)

    def take(table: KeyedTable, notes: dict, batch: DataFrame, n: int) -> bool:
        batch = batch.persist()
        try:
            final = notes.get("final")
            seen, late = batch.agg(F.max("seq"), F.count_if(F.col("seq") <= F.lit(final))).first()  # one row
            if seen is None:
                return False
            on_time = batch if final is None else batch.filter(F.col("seq") > final)
            if lag is not None:
                final = max(seen - lag, seen - lag if final is None else final)
            due = [int(b) for b, (_, _, mark) in table.latest().parts.items() if final is not None and mark is not None and mark <= final]
            table.rewrite(on_time, lambda old: apply(old, on_time, final), due, F.min("_due"), batch=n, final=final, late=notes.get("late", 0) + late)
            return True
        finally:
            batch.unpersist()

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def autosave(drafts: DataFrame, path: str, checkpoint: str, every: str = "30 seconds", **trigger):
    """Upserts a stream of drafts (``id``, ``seq``, values) periodically: the last one of each id stays.

    A draft is an INSERT and an UPDATE (with ``seq`` doubled, and doubled plus one), so it makes the row or replaces it.
    """
    made = drafts.withColumn("op", F.lit("INSERT")).withColumn("seq", F.col("seq") * 2)
    saved = made.unionByName(made.withColumn("op", F.lit("UPDATE")).withColumn("seq", F.col("seq") + 1))
    return start(saved, path, checkpoint, **(trigger or {"processingTime": every}))
