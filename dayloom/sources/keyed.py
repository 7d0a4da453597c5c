"""Stored tables with a key: Parquet in buckets by the key's hash, changed bucket by bucket.

A change reads and rewrites only the buckets that its keys fall in, as new files beside the old ones, and then writes a small list of the
buckets' files: the new version. A reader takes the newest list, so it sees all of a change or nothing; a change that fails leaves
files that no list names, which ``vacuum`` removes. Older versions can be read until then. One writer at a time.

The number of buckets doubles when the table has outgrown it (then one change rewrites all of it), so a bucket stays at about
``rows_per_bucket`` rows, and the cost of a change follows what it touches. Rows of a null key lie in one bucket; no change ever
matches them.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from dayloom.operators import dml

ROWS_PER_BUCKET = 1_000_000
BUCKET = "_bucket"


@dataclass
class Version:
    """A version's list: of each bucket that has rows the folder, the number of rows and the mark (see ``rewrite``)."""

    number: int
    buckets: int
    schema: dict
    notes: dict = field(default_factory=dict)
    parts: dict[str, list] = field(default_factory=dict)

    @property
    def rows(self) -> int:
        return sum(n for _, n, _ in self.parts.values())


class KeyedTable:
    """``KeyedTable.create(df, path, "id")`` stores a frame; ``KeyedTable(spark, path)`` opens it."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id", rows_per_bucket: int = ROWS_PER_BUCKET):
        self.spark, self.path, self.key, self.rows_per_bucket = spark, path.rstrip("/"), key, rows_per_bucket

    @classmethod
    def create(cls, df: DataFrame, path: str, key: str = "id", rows_per_bucket: int = ROWS_PER_BUCKET, buckets: int = 1) -> KeyedTable:
        """A new table of a frame's rows; an error if there is one at the path."""
        table = cls(df.sparkSession, path, key, rows_per_bucket)
        if table.latest() is not None:
            raise FileExistsError(path)
        if BUCKET in df.columns:
            raise ValueError(f"{BUCKET} is a name of the store's own")
        table._commit(Version(0, buckets, json.loads(df.schema.json())), df, [])
        return table

    # --- versions ---------------------------------------------------------------------------

    def _at(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder, fs = self._at("versions")
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def latest(self) -> Version | None:
        numbers = self.versions()
        return self.version(numbers[-1]) if numbers else None

    def version(self, number: int) -> Version:
        p, fs = self._at(f"versions/{number}.json")
        stream = fs.open(p)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Version(**json.loads(text))

    def _publish(self, version: Version) -> None:
        """The list is written under another name first, so that no half of it is ever read."""
        to, fs = self._at(f"versions/{version.number}.json")
        draft, _ = self._at(f"versions/{version.number}.draft")
        if fs.exists(to):
            raise RuntimeError(f"version {version.number} is there already: another writer was at work")
        stream = fs.create(draft, True)
        try:
            stream.write(bytearray(json.dumps(vars(version)).encode()))
        finally:
            stream.close()
        if not fs.rename(draft, to):
            raise RuntimeError(f"version {version.number} can't be published")

    def vacuum(self, keep: int = 2) -> None:
        """Removes all but the last versions, and the files that none of those names."""
        numbers = self.versions()
        named = {where for n in numbers[-keep:] for where, _, _ in self.version(n).parts.values()}
        for n in numbers[:-keep]:
            p, fs = self._at(f"versions/{n}.json")
            fs.delete(p, False)
        data, fs = self._at("data")
        for folder in fs.listStatus(data) if fs.exists(data) else ():
            inside = [b.getPath() for b in fs.listStatus(folder.getPath()) if b.isDirectory()]
            old = [b for b in inside if f"{folder.getPath().getName()}/{b.getName()}" not in named]
            for b in old if len(old) < len(inside) else [folder.getPath()]:
                fs.delete(b, True)

    # --- rows -------------------------------------------------------------------------------

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")

    def read(self, number: int | None = None, buckets=None) -> DataFrame:
        """The rows of a version (the newest one), or of some of its buckets."""
        version = self.latest() if number is None else self.version(number)
        schema = StructType.fromJson(version.schema)
        where = [f"{self.path}/data/{x[0]}" for b, x in sorted(version.parts.items()) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*where) if where else self.spark.createDataFrame([], schema)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys, from their buckets only."""
        return self.read(buckets=self.touched(keys)).join(keys.select(self.key).distinct(), self.key, "left_semi")

    def touched(self, keys: DataFrame) -> set[int]:
        return {r[BUCKET] for r in keys.select(self._bucket(self.latest().buckets).alias(BUCKET)).distinct().collect()}  # a row a bucket at most

    def _commit(self, version: Version, rows: DataFrame, replaced, mark: Column | None = None) -> Version:
        """Writes ``rows`` as the buckets that take the place of ``replaced``, then the list."""
        folder = f"{self.path}/data/{version.number}"
        parted = rows.withColumn(BUCKET, self._bucket(version.buckets))
        tasks = max(1, min(version.buckets, len(replaced) or version.buckets))
        parted.repartition(tasks, BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(folder)
        version.parts = {b: x for b, x in version.parts.items() if int(b) not in replaced}
        p, fs = self._at(f"data/{version.number}")
        if any(f.isDirectory() for f in fs.listStatus(p)):
            fields = StructType.fromJson(version.schema).add(BUCKET, IntegerType())
            told = self.spark.read.schema(fields).parquet(folder).groupBy(BUCKET).agg(F.count("*").alias("n"), (F.lit(None) if mark is None else mark).cast("long").alias("mark"))
            for r in told.collect():  # a row a bucket
                version.parts[str(r[BUCKET])] = [f"{version.number}/{BUCKET}={r[BUCKET]}", r.n, r.mark]
        self._publish(version)
        return version

    def rewrite(self, keys: DataFrame | None, change: Callable[[DataFrame], DataFrame], also=(), mark: Column | None = None, **notes) -> Version:
        """A new version in which the buckets of ``keys`` (and the buckets ``also``; None: all) hold what ``change`` makes of their rows.

        ``mark``, an aggregate, is kept in the list for each bucket, and ``notes`` for the version.
        """
        old = self.latest()
        buckets = old.buckets
        while old.rows > 2 * self.rows_per_bucket * buckets:
            buckets *= 2
        if keys is None or buckets > old.buckets:
            touched = {int(b) for b in old.parts}
        else:
            touched = self.touched(keys) | set(also)
        new = Version(old.number + 1, buckets, old.schema, {**old.notes, **notes}, old.parts)
        columns = StructType.fromJson(old.schema).fieldNames()
        return self._commit(new, change(self.read(old.number, touched)).select(*columns), touched, mark)

    # --- changes ----------------------------------------------------------------------------

    def insert_absent(self, rows: DataFrame, order: str | None = None) -> Version:
        """Adds rows whose key is new."""
        return self.rewrite(rows, lambda old: dml.insert_absent(old, rows, self.key, order))

    def upsert(self, rows: DataFrame) -> Version:
        """Rows replace those of equal key; new keys are added. ``rows`` has each key once."""
        return self.rewrite(rows, lambda old: dml.upsert(old, rows, self.key))

    def update(self, rows: DataFrame, strict: bool = False) -> Version:
        """Rows replace those of equal key. A row without a partner does nothing, or (``strict``) fails the change, which leaves the table as it was."""
        return self.rewrite(rows, lambda old: (dml.update_strict if strict else dml.update)(old, rows, self.key))

    def delete(self, keys: DataFrame, on=()) -> Version:
        """Removes the rows whose key (and the other columns of ``on``) is listed."""
        return self.rewrite(keys, lambda old: dml.delete(old, keys, (self.key, *on)))
