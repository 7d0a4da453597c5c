"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Each source gets a target number of words by its weight, never above ``most`` times its size (what
is over goes to the others by weight). Documents are dealt to shards by a hash of their id and text; in each
shard a source's documents form one line of words, in a seeded order, cut into blocks of equal
length. The shard's number of blocks is dealt to its sources by the highest quotients
``weight / (2 k + 1)``; a source takes whole passes over its blocks and, for the rest of its quota,
blocks in a seeded order. No document is taken more than ``most`` (2) times.

DataFrame operations only. Windows run within a shard (about ``shard_words`` words), so a source
with a third of all rows is spread over all shards; the one global window has a row per source.

Null or empty text: size 0, taken 0. Null source: one source, the last in order. Repeated rows are
documents of their own. A null ``doc_id`` counts as an empty string for the seeded order. Extra columns are kept by
``mixed_documents``, whatever their names.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dayloom.llm.common import WORD_RE, join_on, stash, table

#: Words of a block and of a shard, about.
BLOCK_WORDS, SHARD_WORDS = 64, 200_000


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long"),
        F.col("source").cast("string"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD_RE)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
        F.concat_ws(":", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("name"),
    )


def targets(sized: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """``source``, ``source_size``, ``weight``, ``target``: one row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), F.col("nth"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("nth", F.row_number().over(by_name))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("nth") - 1) % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumn("cap", (most * F.col("source_size")).cast("double"))
    before = F.coalesce(F.sum("cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    here = F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("total", share * F.sum("source_size").over(everything))
    s = s.withColumn("level", (F.col("total") - before) / here)
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "nth", "level")))
    s = s.withColumn("level", F.coalesce(first.over(everything)["level"], F.lit(float("inf"))))
    return s.select("source", "source_size", "weight", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def _hex(n: int, *cols) -> F.Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", *cols)), 1, n), 16, 10).cast("long")


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: int = 2, seed: str = "7", block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """What is taken of each document, and of which words.

    The first frame has a row per document: ``doc_id``, ``source``, ``size``, ``text_hash``,
    ``source_size``, ``target``, ``passes`` (whole copies) and ``taken`` (words). The second has the
    stretches of the partial pass: ``doc_id``, ``text_hash``, ``copy`` (among equal rows), ``lo``, ``hi``.
    """
    sized = stash(sizes(docs), "sizes")
    # a row a source; Spark broadcasts the table if its files are small
    goals = stash(targets(sized, weights, share, most), "goals")
    shards = max(1, -(-sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] // shard_words))
    lines = join_on(sized, goals, ["source"])
    lines = lines.withColumn("shard", _hex(8, F.lit(seed), F.col("name")) % shards).withColumn("order", F.md5(F.concat_ws(":", F.lit(seed), F.lit("line"), F.col("name")))).drop("name")
    line = Window.partitionBy("shard", "source").orderBy("order", "doc_id", "size", "text_hash")
    lines = lines.withColumn("pos", F.row_number().over(line)).withColumn("end", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    # the blocks of each shard's sources, and their weights in blocks
    cells = lines.groupBy("shard", "source").agg(F.sum("size").alias("words"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))
    cells = cells.filter("words > 0").withColumn("blocks", F.ceil(F.col("words") / block_words))
    cells = cells.withColumn("share", F.col("target") / F.col("source_size") * F.col("blocks"))
    shard = Window.partitionBy("shard")
    cells = stash(cells.withColumn("due", F.round(F.sum("share").over(shard.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))), "cells")
    # highest quotients
    k = cells.select("shard", "source", "share", "due", F.explode(F.sequence(F.lit(0), (F.ceil(2 * F.col("share")) + 2).cast("int"))).alias("k"))
    k = k.withColumn("nth", F.row_number().over(shard.orderBy((F.col("share") / (2 * F.col("k") + 1)).desc(), F.col("source").asc_nulls_last(), "k")))
    quota = k.filter("nth <= due").groupBy("shard", "source").agg(F.count("*").alias("quota"))
    cell = ["shard", "source"]
    cells = join_on(cells, quota, cell, "left").select(*cell, "words", "blocks", F.least(F.coalesce("quota", F.lit(0)), most * F.col("blocks")).alias("quota"))
    cells = cells.withColumn("passes", F.floor(F.col("quota") / F.col("blocks"))).withColumn("rest", F.col("quota") % F.col("blocks"))
    # seeded choice of the blocks of the partial pass
    b = cells.select("shard", "source", "rest", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    chance = F.md5(F.concat_ws(":", F.lit(seed), F.lit("block"), F.col("shard").cast("string"), F.coalesce("source", F.lit("")), F.col("block").cast("string")))
    b = b.withColumn("nth", F.row_number().over(Window.partitionBy("shard", "source").orderBy(chance, "block"))).filter("nth <= rest").select("shard", "source", "block")
    docs_in = join_on(lines, cells.select(*cell, "words", "blocks", "passes"), cell, "left")
    docs_in = stash(docs_in.withColumn("start", F.col("end") - F.col("size")), "lines")
    at = lambda x: F.floor(((x + 1) * F.col("blocks") - 1) / F.col("words"))  # noqa: E731  the block of a word
    parts = docs_in.filter("size > 0").select("shard", "source", "pos", "doc_id", "text_hash", "start", "end", "words", "blocks", F.explode(F.sequence(at(F.col("start")), at(F.col("end") - 1))).alias("block"))
    parts = join_on(parts, b, [*cell, "block"], "left_semi")
    edge = lambda x: F.floor(x * F.col("words") / F.col("blocks"))
    parts = parts.select("shard", "source", "pos", "doc_id", "text_hash", (F.greatest("start", edge(F.col("block"))) - F.col("start")).alias("lo"), (F.least("end", edge(F.col("block") + 1)) - F.col("start")).alias("hi"))
    some = parts.groupBy("shard", "source", "pos").agg(F.sum(F.col("hi") - F.col("lo")).alias("some"))
    out = join_on(docs_in, some, [*cell, "pos"], "left")
    passes = F.coalesce(F.col("passes"), F.lit(0)).cast("long")
    out = out.select(
        "doc_id", "source", "size", "text_hash", "source_size", "target", passes.alias("passes"), (passes * F.col("size") + F.coalesce("some", F.lit(0))).cast("long").alias("taken")
    )
    return out, parts.select("doc_id", "text_hash", F.col("pos").alias("copy"), "lo", "hi")


def _keyed(df: DataFrame, *more) -> DataFrame:
    """A document's key in columns that are never null, so that joins and groups deal rows alike."""
    doc_id = F.col("doc_id").cast("long")
    return df.select(F.coalesce(doc_id, F.lit(0)).alias("id"), doc_id.isNull().alias("no_id"), *more)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: whole copies of a document, and one of its partly taken words.

    Texts are dealt by their key once: all that follows reads this one exchange, as its joins and groups have just these keys.
    """
    taken, parts = mix(docs, **options)
    key = ["id", "no_id", "text_hash"]
    # the row is nested, so that its columns may have any names
    keyed = _keyed(docs, F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    # equal rows lie side by side in a line and take alike in whole passes
    whole = _keyed(taken, "text_hash", "passes").groupBy(*key).agg(F.max("passes").alias("passes"))
    full = keyed.join(whole, key).filter("passes > 0").withColumn("n", F.explode(F.sequence(F.lit(1), F.col("passes").cast("int")))).select("row.*")
    cut = _keyed(parts, "text_hash", "copy", "lo", "hi").groupBy(*key, "copy").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("cuts"))
    words = F.regexp_extract_all(F.col("row.text"), F.lit(WORD_RE), F.lit(0))
    # the words stand in an array of one element, so that they are found once, not once a cut
    text = F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform("cuts", lambda c: F.slice(w, (c["lo"] + 1).cast("int"), (c["hi"] - c["lo"]).cast("int")))), " "))[0]
    one = keyed.join(cut.select(*key).distinct(), key, "left_semi").groupBy(*key).agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    some = one.join(cut, key).withColumn("cut_text", text)
    put = {"text": F.col("cut_text"), "n_chars": F.length("cut_text").cast("long")}
    return full.unionByName(some.select(*[put[c].alias(c) if c in put else F.col("row").getField(c).alias(c) for c in docs.columns]))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))[0].select("doc_id", "size", "source_size", "target", "taken")


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD_RE}')), 0) AS BIGINT) AS size,
         concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', md5(coalesce(text, ''))) AS name FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS nth FROM s0),
s2 AS (SELECT *, CAST([5, 2, 1][(nth - 1) % 3 + 1] AS DOUBLE) AS weight, CAST(2 * source_size AS DOUBLE) AS cap,
         1.5::DOUBLE * sum(source_size) OVER () AS total FROM s1),
s3 AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2),
lv AS (SELECT coalesce((SELECT level FROM s3 WHERE level * weight <= cap ORDER BY cap / weight, nth LIMIT 1), 'infinity'::DOUBLE) AS lv),
goals AS (SELECT source, source_size, least(cap, lv * weight) AS target FROM s3, lv),
n AS (SELECT greatest(1, CAST(ceil(sum(size) / {SHARD_WORDS}.0) AS BIGINT)) AS shards FROM sized),
l0 AS (SELECT d.*, g.source_size, g.target,
         CAST('0x' || substr(md5('7:' || name), 1, 8) AS BIGINT) % (SELECT shards FROM n) AS shard,
         md5('7:line:' || name) AS ord
       FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source),
l1 AS (SELECT *, sum(size) OVER (PARTITION BY shard, source ORDER BY ord, doc_id, size ROWS UNBOUNDED PRECEDING) AS e FROM l0),
c0 AS (SELECT shard, source, CAST(sum(size) AS BIGINT) AS words, any_value(target) AS target, any_value(source_size) AS source_size
       FROM l1 GROUP BY ALL HAVING sum(size) > 0),
c1 AS (SELECT *, CAST(ceil(words / {BLOCK_WORDS}.0) AS BIGINT) AS blocks FROM c0),
c2 AS (SELECT *, target / source_size * blocks AS share FROM c1),
c3 AS (SELECT *, round(sum(share) OVER (PARTITION BY shard ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS due FROM c2),
q0 AS (SELECT shard, source, share, due, unnest(range(0, CAST(ceil(2 * share) AS BIGINT) + 3)) AS k FROM c3),
q1 AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY share / (2 * k + 1) DESC, source ASC NULLS LAST, k) AS nth FROM q0),
q2 AS (SELECT shard, source, count(*) AS quota FROM q1 WHERE nth <= due GROUP BY ALL),
c4 AS (SELECT c.shard, c.source, c.words, c.blocks, least(coalesce(q.quota, 0), 2 * c.blocks) AS quota
       FROM c3 c LEFT JOIN q2 q ON c.shard = q.shard AND c.source IS NOT DISTINCT FROM q.source),
b0 AS (SELECT shard, source, quota % blocks AS rest, unnest(range(0, blocks)) AS block FROM c4),
b1 AS (SELECT *, row_number() OVER (PARTITION BY shard, source ORDER BY
         md5('7:block:' || shard || ':' || coalesce(source, '') || ':' || block), block) AS nth FROM b0),
b2 AS (SELECT shard, source, block FROM b1 WHERE nth <= rest),
d AS (SELECT l1.*, c4.words, c4.blocks, c4.quota // c4.blocks AS passes, e - size AS s
      FROM l1 LEFT JOIN c4 ON l1.shard = c4.shard AND l1.source IS NOT DISTINCT FROM c4.source),
p AS (SELECT doc_id, shard, source, s, e, words, blocks,
        unnest(range(CAST(((s + 1) * blocks - 1) // words AS BIGINT), CAST((e * blocks - 1) // words AS BIGINT) + 1)) AS block FROM d WHERE size > 0),
t AS (SELECT p.doc_id, sum(least(e, (p.block + 1) * words // blocks) - greatest(s, p.block * words // blocks)) AS some
      FROM p JOIN b2 ON p.shard = b2.shard AND p.source IS NOT DISTINCT FROM b2.source AND p.block = b2.block GROUP BY 1)
SELECT d.doc_id, d.size, d.source_size, d.target, CAST(coalesce(d.passes, 0) * d.size + coalesce(t.some, 0) AS BIGINT) AS taken
FROM d LEFT JOIN t ON d.doc_id = t.doc_id
"""
