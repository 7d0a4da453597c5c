"""What the corpus operators share: tables, the shared folder, and vectorised work on Arrow text."""

from __future__ import annotations

import ctypes
import gc
import math
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules: space and \x09-\x0D.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD_RE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- the shared folder -------------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where that is unset, a folder of this machine, if Spark runs on it alone."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file:///tmp/checkpoints/dayloom"
        os.makedirs(where[7:], exist_ok=True)
    return where.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/dayloom-{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends in files that outlive an executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a stashed frame that is no longer read."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let the context cleaner drop shuffle files of frames that are out of use."""
    gc.collect()
    spark._jvm.System.gc()


def give_back() -> None:
    """Gives freed memory of this process back to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def frugal(run):
    """A function over batches that gives freed memory back at its end: workers stay, and an executor's memory holds them beside its heap."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


# --- Arrow text --------------------------------------------------------------------------


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array, and its offsets (null: empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 21):
    """Slices of a batch with about ``most`` bytes of text each; a longer document stands alone."""
    _, off = flat(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


_RNG = np.random.Generator(np.random.PCG64(20240229))
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE2 = np.uint64(0xC2B2AE3D27D4EB4F | 1)
BYTE_A = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_B = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHINGLE_C = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) <= n:
        n = max(n, 1 << 16)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        out = []
        for b in (base, inverse):
            p = np.full(n + 1, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _powers[int(base)] = (out[0], out[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Rolling:
    """Hashes of any byte range of a buffer from prefix sums, the same wherever the range stands."""

    def __init__(self, buf: np.ndarray, table: np.ndarray = BYTE_A, base: np.uint64 = _BASE):
        power, self.inverse = powers(base, len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(table[buf] * power[: len(buf)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]


def second(buf: np.ndarray) -> Rolling:
    """An independent second hash of the same buffer."""
    return Rolling(buf, BYTE_B, _BASE2)


_SPACE = np.zeros(256, bool)
_SPACE[list(SPACE_BYTES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of True that stays within one document."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = off[:-1][off[:-1] < len(inside)]
    first[at] = inside[at]
    at = off[1:][off[1:] > 0] - 1
    last[at] = inside[at]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of each document, and where each document's words begin."""
    start, end = spans(~_SPACE[buf], off)
    h = mix(Rolling(LOWER[buf])(start, end)) if len(start) else np.zeros(0, np.uint64)
    return h, np.searchsorted(start, off)


def signed(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def spread(many: DataFrame, few: DataFrame, keys: list[str], split: int) -> DataFrame:
    """An equi-join in which the rows of a frequent key of ``many`` meet copies of ``few`` in ``split`` tasks."""
    dealt = many.withColumn("salt", F.pmod(F.xxhash64(*many.columns), F.lit(split)))
    copies = few.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(split - 1).cast("long"))))
    return dealt.join(copies.hint("merge"), [*keys, "salt"]).drop("salt")


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join on ``keys`` in which null equals null; the left side's keys stay."""
    renamed = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(c) for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(renamed, on, how).drop(*[f"__{k}" for k in keys])


#: Bits of a bitmap of keys, at most (8 MB).
MOST_BITS = 1 << 26


def sifted(many: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``many`` whose keys ``few`` may hold: all those that it holds, and about one in 32 of the others; so that a join with ``few`` moves little else.

    By a bitmap of the keys' hashes, null like any value. It is broadcast, and bounded: with more than ``MOST_BITS / 32`` keys it lets more through, in the end all.
    """
    bits = min(MOST_BITS, 1 << max(15, math.ceil(math.log2(32 * max(1, few.count())))))
    place = F.pmod(F.xxhash64(*keys), F.lit(bits))
    marks = few.select(place.alias("_place")).groupBy(F.shiftright("_place", 15).alias("_part")).agg(F.bitmap_construct_agg(F.col("_place").bitwiseAND(32767)).alias("_bits"))
    both = many.withColumn("_place", place).join(F.broadcast(marks), F.shiftright("_place", 15) == F.col("_part"))
    at = F.col("_place").bitwiseAND(32767).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    hit = both.withColumns({"_byte": byte, "_bit": at.bitwiseAND(7)}).filter("shiftright(_byte, _bit) % 2 = 1")
    return hit.select(*many.columns)
