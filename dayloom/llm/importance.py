"""Importance resampling: draw the documents whose n-grams are likely under a target text.

A document's features are its words and pairs of neighbouring words, hashed into ``BUCKETS`` buckets by CRC. A bucket's gain
is the log ratio of its smoothed share in the target to that in the corpus, in thousandths; a document's weight is the
mean gain of its features, and Gumbel noise from a seeded hash of its id makes the highest scores a weighted
draw without replacement.

In each Spark partition DuckDB splits the texts, unnests the words, pairs them by a window and calls zlib's CRC, which is
registered with it. What it counts is spilled as Parquet in the shared folder: for each document the buckets of its features (two
bytes each), for each partition the counts of all buckets. Spark sums the counts, scores the spilled documents without reading their texts
again, and ranks them by one distributed sort: a row's rank is its place in its sorted partition after the rows of those before.

Texts are cut into pieces of about ``PIECE`` bytes between words; a piece of a longer text begins with the last word before it,
so that no pair is lost. So DuckDB's memory is bounded whatever a text's length.

Null and empty texts have no words and no features: weight 0, never drawn while ``least_words`` is above 0. Rows that repeat
are rows of their own. Null ids hash as the empty string and come last among ties; rows equal in score and id have any order. An empty
target, or an empty corpus, has no counts, and the formula holds with zeros. Extra columns are not read.
"""

from __future__ import annotations

import zlib

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayloom.llm.common import discard, flat, pieces, stash, table

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
PIECE = 1 << 20

_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words of each piece with their places; a piece that goes on with a text repeats the last word before it.
_WORDS = f"""
CREATE OR REPLACE TEMP TABLE words AS
SELECT doc, piece, word, row_number() OVER (PARTITION BY doc, piece ORDER BY pos) AS pos, goes_on
FROM (SELECT doc, piece, goes_on, unnest(list) AS word, generate_subscripts(list, 1) AS pos
      FROM (SELECT doc, piece, goes_on, string_split_regex(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '{_NOT_WORD}') AS list FROM texts))
WHERE word <> ''
"""
#: The bucket of each feature: of single words once a different word, of pairs as they come.
_FEATURES = """
CREATE OR REPLACE TEMP TABLE features AS
WITH known AS (SELECT word, bucket(word) AS bucket FROM (SELECT DISTINCT word FROM words))
SELECT doc, bucket, true AS single FROM words JOIN known USING (word) WHERE NOT (goes_on AND pos = 1)
"""
_PAIRS = """
INSERT INTO features
SELECT doc, bucket(pair), false
FROM (SELECT doc, word || ' ' || lead(word) OVER (PARTITION BY doc, piece ORDER BY pos) AS pair FROM words)
WHERE pair IS NOT NULL
"""


def _bucket(col) -> pa.Array:
    """CRC of UTF-8 bytes, modulo the number of buckets: the function registered with DuckDB."""
    buf, off = flat(col)
    raw, off = buf.tobytes(), off.tolist()
    crc = list(map(zlib.crc32, [raw[i:j] for i, j in zip(off, off[1:], strict=False)]))
    return pa.array((np.array(crc, np.int64) % BUCKETS).astype(np.uint16))


def _engine():
    con = duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
    con.create_function("bucket", _bucket, ["VARCHAR"], "USMALLINT", type="arrow")
    return con


def _cut(raw: bytes) -> list[tuple[bytes, bool]]:
    """A long text in pieces that end between words; one that isn't the first begins with the last word before it, if there is any (then True)."""
    b = np.frombuffer(raw, np.uint8)
    low = b | 0x20
    word = ((b >= 48) & (b <= 57)) | ((low >= 97) & (low <= 122)) | (b >= 128)
    gaps = np.flatnonzero(~word)
    ends = np.flatnonzero(word[:-1] & ~word[1:]) + 1
    starts = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
    out, at = [], 0
    while at < len(b):
        k = np.searchsorted(gaps, at + PIECE)
        end = int(gaps[k]) if k < len(gaps) else len(b)
        last = np.searchsorted(ends, at, side="right") - 1
        carry = raw[starts[last] : ends[last]] + b" " if at and last >= 0 else b""
        out.append((carry + raw[at:end], bool(carry)))
        at = end
    return out


def _texts(part: pa.RecordBatch) -> pa.Table:
    """The pieces of a batch's texts; ``goes_on`` where a piece begins with a repeated word."""
    col = part.column("text")
    buf, off = flat(col)
    size = np.diff(off)
    if len(size) > 1 or not len(size) or size[0] <= 2 * PIECE:
        docs, cut = np.arange(len(size)), np.zeros(len(size), np.int32)
        return pa.table({"doc": docs, "piece": cut, "text": col.cast(pa.string()).fill_null(""), "goes_on": np.zeros(len(size), bool)})
    found = _cut(buf.tobytes())
    raw, goes_on = zip(*found, strict=True)
    return pa.table({"doc": np.zeros(len(found), np.int64), "piece": np.arange(len(found), dtype=np.int32), "text": pa.array(raw, pa.binary()).cast(pa.string()), "goes_on": goes_on})


_SPILLED = "doc_id long, n_words long, n_features long, buckets binary, counts array<long>"


def _count(batches):
    """Rows of documents, then one row with the partition's counts."""
    con, counts = _engine(), np.zeros(BUCKETS, np.int64)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.binary()), ("counts", pa.list_(pa.int64()))])
    for batch in batches:
        for part in pieces(batch, "text", PIECE):
            n = part.num_rows
            texts = _texts(part)
            buckets, words = [[] for _ in range(n)], np.zeros(n, np.int64)
            for at in range(0, texts.num_rows, 1 if n == 1 else texts.num_rows):  # the pieces of a long text, one at a time
                con.register("texts", texts.slice(at, 1 if n == 1 else texts.num_rows))
                con.execute(_WORDS)
                con.execute(_FEATURES)
                con.execute(_PAIRS)
                some = con.execute("SELECT bucket, count(*) AS n FROM features GROUP BY bucket").fetchnumpy()
                counts[some["bucket"]] += some["n"]
                each = con.sql("SELECT doc, count(*) FILTER (single) AS n, list(bucket) AS buckets FROM features GROUP BY doc").to_arrow_table().combine_chunks()
                for chunk in each.to_batches():
                    doc = chunk.column("doc").to_numpy()
                    words[doc] += chunk.column("n").to_numpy()
                    lists = chunk.column("buckets")
                    flat_, off = lists.values.to_numpy(zero_copy_only=False).astype("<u2"), lists.offsets.to_numpy()
                    for d, i, j in zip(doc.tolist(), off.tolist(), off[1:].tolist(), strict=False):
                        buckets[d].append(flat_[i:j].tobytes())
                con.unregister("texts")
            held = [b"".join(x) for x in buckets]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words), pa.array([len(x) // 2 for x in held], pa.int64()), pa.array(held, pa.binary()), pa.nulls(n, pa.list_(pa.int64()))], schema=schema)
    con.close()
    none = pa.nulls(1, pa.int64())
    yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(1, pa.binary()), pa.array([counts])], schema=schema)


def spilled(texts: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """A written table: each text's id, ``n_words``, ``n_features`` and ``buckets``, and rows with only ``counts``, those of a partition."""
    rows = texts.select((F.col(doc_id).cast("long") if doc_id else F.lit(None).cast("long")).alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stash(rows.mapInArrow(_count, _SPILLED), "buckets")


def _counted(found: DataFrame, name: str) -> DataFrame:
    return found.filter("counts is not null").select(F.posexplode("counts").alias("bucket", "n")).groupBy("bucket").agg(F.sum("n").alias(name))


def gains(corpus: DataFrame, target: DataFrame) -> DataFrame:
    """``bucket``, ``s``, ``t`` and ``gain`` of every bucket, from two spilled tables."""
    both = corpus.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    both = both.join(_counted(corpus, "s"), "bucket", "left").join(_counted(target, "t"), "bucket", "left").na.fill(0, ["s", "t"])
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t")).first()  # one row
    ratio = (F.col("t") + 1) * F.lit(float(sums.all_s + BUCKETS)) / ((F.col("s") + 1) * F.lit(float(sums.all_t + BUCKETS)))
    return both.withColumn("gain", F.floor(1000 * F.log(ratio)))


def weights(corpus: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features`` and ``weight`` of the documents of a spilled table."""

    def score(batches):
        for b in batches:
            data, _ = flat(b.column("buckets"))
            n = b.column("n_features").to_numpy()
            sums = np.concatenate([[0], np.cumsum(gain[np.frombuffer(data.tobytes(), "<u2")])])
            ends = np.cumsum(n)
            weight = (sums[ends] - sums[ends - n]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), b.column("n_features"), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    rows = corpus.filter("counts is null").select("doc_id", "n_words", "n_features", "buckets")
    return rows.mapInArrow(score, "doc_id long, n_words long, n_features long, weight long")


def ranked(scored: DataFrame, least_words: int, percent: int) -> DataFrame:
    """``scored`` with ``rank``: 1 for the highest score among documents of ``least_words``, null for those not drawn."""
    able = F.col("n_words") >= least_words
    sort = scored.withColumn("able", able).orderBy(F.col("able").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    placed = stash(sort.withColumn("place", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("place", 33)
    parts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("rows"), F.count(F.when(F.col("able"), 1)).alias("able")).orderBy("part").collect()  # a row a partition
    draw, before = sum(p.able for p in parts) * percent // 100, [0]
    for p in parts:
        before.append(before[-1] + p.rows)
    offsets = scored.sparkSession.createDataFrame([(p.part, n) for p, n in zip(parts, before, strict=False)], "part long, before long")
    place = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    out = placed.withColumn("part", part).join(F.broadcast(offsets), "part")
    return out.withColumn("rank", F.when(place <= draw, place)).drop("part", "before", "place", "able")


def resample(docs: DataFrame, target: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` (null: not drawn) of every document."""
    corpus, wanted = spilled(docs), spilled(target, "")
    gain = np.zeros(BUCKETS, np.int64)
    for row in gains(corpus, wanted).select("bucket", "gain").collect():  # a row a bucket
        gain[row.bucket] = row.gain
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = stash(weights(corpus, gain).withColumn("score", F.col("weight") + noise), "scored")
    discard(corpus)
    discard(wanted)
    out = ranked(scored, least_words, percent)
    discard(scored)
    return out


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC by bits: a byte is eight steps, the first of which takes it in.
ORACLE = rf"""
WITH texts AS (
  SELECT 'd' AS side, doc_id, row_number() OVER () AS row, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 'b', NULL, -row_number() OVER (), coalesce(text, '') FROM benchmark),
lists AS (
  SELECT side, row, list_filter(string_split_regex(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '{_NOT_WORD}'), lambda x: x <> '') AS words FROM texts),
features AS (
  SELECT side, row, unnest(words) AS feature FROM lists
  UNION ALL
  SELECT side, row, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) FROM lists),
steps AS (
  SELECT feature, flatten(list_transform(range(0, octet_length(encode(feature))), lambda i:
    [('0x' || substr(hex(encode(feature)), 2 * i + 1, 2))::BIGINT, 0, 0, 0, 0, 0, 0, 0])) AS bits
  FROM (SELECT DISTINCT feature FROM features)),
hashed AS (
  SELECT feature, xor(list_reduce(list_prepend(4294967295::BIGINT, bits), lambda crc, b:
    xor(xor(crc, b) >> 1, 3988292384 * (xor(crc, b) & 1))), 4294967295) % 10000 AS bucket FROM steps),
buckets AS (SELECT side, row, bucket FROM features JOIN hashed USING (feature)),
counts AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM buckets GROUP BY bucket),
sums AS (SELECT sum(s)::DOUBLE AS all_s, sum(t)::DOUBLE AS all_t FROM counts),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000))))::BIGINT AS gain FROM counts, sums),
weighed AS (SELECT row, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM buckets JOIN gain USING (bucket) WHERE side = 'd' GROUP BY row),
scored AS (
  SELECT doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM texts JOIN lists USING (side, row) LEFT JOIN weighed USING (row) WHERE side = 'd'),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_words >= 20) OVER () * 25 // 100 AS draw FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= draw THEN place END AS rank FROM ranked
"""
