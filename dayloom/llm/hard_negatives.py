"""Hard-negative mining over k-means inverted lists, exact by Cauchy-Schwarz bounds.

A vector's components are floored to integers in units of 1 / ``UNIT``, and scores are integer inner products. For each anchor and each of
its best rows of the same label (positives), the best rows of other labels are wanted whose score lies in a window below the positive's.

Lists. K-means (Spark's own, fitted on at most ``SAMPLE`` different vectors, those with the smallest hashes) gives centres; every vector joins
the list of its nearest centre, and a list's radius r is the largest distance of its vectors to the centre c. So for an anchor q

    q.c - |q| r  <=  q.x  <=  q.c + |q| r        for every x of the list.

The index, of at most ``NUMBERS`` numbers whatever the table's size, goes to the tasks. Lists are packed into shards of a bounded number of rows; a longer list is
spread over shards of its own.

Search. An anchor first visits the shard of the list with the highest bound, which gives it a k-th score. It then goes to every other
shard that holds a list whose bound reaches that score and whose interval meets a window, and to no other. Within a shard lists are visited by falling
bound; lists outside all windows are skipped, and the visit stops when the bound falls strictly below the k-th score (ties go on, for smaller
ids). What shards return is merged. The result doesn't depend on the centres: they decide what is visited. In data without clusters
bounds are loose and most lists are visited; that costs time only.

Rows equal in label and vector are one entry, with their smallest ids (as many as can be in an answer), and equal anchors search once, so a vector that a
third of all rows hold costs no more than any other. The anchors of a shard are dealt to chunks of at most about ``CHUNK``.

Rows with a null id, label or vector, or a null or non-finite component, take no part; nor do vectors whose integer norm reaches 2**28, as scores
of those need not fit a long. Rows that repeat an id are one row, the smallest by label and vector. Vectors of different lengths are not compared. A
positive of negative score has no negatives. Fewer rows than asked for: all of them. Extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dayloom.llm.common import discard, stash, table

UNIT = 256
#: Numbers of the index and of a shard, at most; different vectors that fit the centres; anchors of a chunk.
NUMBERS, SAMPLE, CHUNK = 1 << 20, 20_000, 2048
LEAST, MOST = -(1 << 62), 1 << 62


def usable(vectors: DataFrame, label: F.Column | None = None, column: str = "embedding") -> DataFrame:
    """``vec_id``, ``label`` and ``v`` (integers) of the rows that take part, one an id."""
    x = F.col(column).cast("array<double>")
    bad = F.exists(x, lambda y: y.isNull() | F.isnan(y) | (F.abs(y) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), (F.col("label") if label is None else label).cast("long").alias("label"), x.alias("x"), bad.alias("bad"))
    rows = rows.filter("vec_id is not null and label is not null and x is not null and not bad").withColumn("v", F.transform("x", lambda y: F.floor(F.lit(float(UNIT)) * y)))
    norm = F.aggregate("v", F.lit(0.0), lambda s, y: s + y.cast("double") * y.cast("double"))
    rows = rows.filter(norm < float(1 << 56))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row")).select("vec_id", "row.*")


@dataclass
class Lists:
    """Centres, radii and shards (the first one, and how many) of the inverted lists."""

    centres: np.ndarray
    radii: np.ndarray
    first: np.ndarray
    shards: np.ndarray

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and largest score that each list can hold, a little widened against rounding."""
        size, mid = math.sqrt(float(q @ q)), self.centres @ q
        wide = size * self.radii + 1e-9 * size * (self.radii + np.sqrt((self.centres * self.centres).sum(axis=1))) + 1e-3
        return mid - wide, mid + wide


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), dim)


def _centres(classes: DataFrame, dim: int, n: int) -> np.ndarray:
    k = max(1, min(round(math.sqrt(n)), NUMBERS // max(1, dim), SAMPLE // 8))
    if k == 1 or not dim:
        return np.zeros((1, dim))
    sample = classes.orderBy(F.xxhash64("v"), "vid").limit(SAMPLE).select(array_to_vector(F.col("v").cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=13, maxIter=8, initMode="random").fit(sample)
    return np.array(model.clusterCenters(), np.float64)


def inverted(classes: DataFrame, dim: int) -> tuple[DataFrame, Lists]:
    """The classes with their ``list`` and ``shard``, and the index."""
    n = classes.count()
    centres = _centres(classes, dim, n)

    def nearest(batches):
        half = (centres * centres).sum(axis=1) / 2
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                x = _matrix(b.column("v"), dim).astype(np.float64)
                near = (x @ centres.T - half).argmax(axis=1)
                far = np.sqrt(((x - centres[near]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([b.column("vid"), b.column("label"), b.column("v"), pa.array(near.astype(np.int32)), pa.array(far)], ["vid", "label", "v", "list", "far"])

    placed = stash(classes.select("vid", "label", "v").mapInArrow(nearest, "vid long, label long, v array<long>, list int, far double"), "placed")
    most = max(1, min(max(n // 64, 256), NUMBERS // max(1, dim)))
    filled = placed.groupBy("list").agg(F.max("far").alias("far"), F.count("*").alias("n")).orderBy("list").collect()  # a row a list
    first, shards, shard, room = [], [], -1, 0
    for row in filled:
        pieces = math.ceil(row.n / most)
        if row.n > room:
            shard, room = shard + 1, most
        first.append(shard)
        shards.append(pieces)
        shard, room = shard + pieces - 1, room - row.n
    where = classes.sparkSession.createDataFrame([(row.list, i, f, s) for i, (row, f, s) in enumerate(zip(filled, first, shards, strict=True))], "list int, at int, first long, shards long")
    items = placed.join(F.broadcast(where), "list").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("vid"), F.col("shards")))
    index = Lists(centres[np.array([row.list for row in filled], np.int64)], np.array([row.far for row in filled]), np.array(first, np.int64), np.array(shards, np.int64))
    return items.select("shard", F.col("at").alias("list"), "vid", "label", "v"), index


@dataclass
class Held:
    """A list's part in a shard."""

    x: np.ndarray
    label: np.ndarray
    vid: np.ndarray

    def __post_init__(self):
        self.real = self.x.astype(np.float64)
        self.size = math.sqrt(float((self.real * self.real).sum(axis=1).max(initial=0)))

    def scores(self, q: np.ndarray, real: np.ndarray, size: float) -> np.ndarray:
        """Exact integer products; in doubles while no sum can leave their exact range."""
        return (self.real @ real).astype(np.int64) if size * self.size < 1 << 52 else self.x @ q


def _visits(asks: DataFrame, lists: Lists, home: bool) -> DataFrame:
    """``vid`` and ``shard``: the home shard of each ask, or all others that its bounds can't rule out."""

    def run(batches):
        for b in batches:
            out = []
            for ask in b.to_pandas().itertuples():
                least, largest = lists.bounds(np.asarray(ask.v, np.float64))
                reach = np.zeros(len(largest), bool)
                for lo, hi, kth in zip(ask.lo, ask.hi, ask.kth, strict=True):
                    reach |= (largest >= max(lo, kth)) & (least <= hi)
                if not home:
                    to = np.unique(np.concatenate([np.arange(f, f + s) for f, s in zip(lists.first[reach], lists.shards[reach], strict=True)] or [np.zeros(0, np.int64)]))
                    out += [(ask.vid, s) for s in to.tolist() if s != ask.home]
                elif reach.any():
                    out.append((ask.vid, int(lists.first[np.argmax(np.where(reach, largest, -np.inf))])))
            vid, shard = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(vid, pa.int64()), pa.array(shard, pa.int64())], ["vid", "shard"])

    columns = ["vid", "v", "lo", "hi", "kth"] + ([] if home else ["home"])
    return asks.select(*columns).mapInArrow(run, "vid long, shard long")


def _visit(lists: Lists, own: bool, k: int):
    """What a shard has for its asks: a row an ask, with the best of each window and the k-th scores so far."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            groups = list(left.groupby("list"))
            here = [int(c) for c, _ in groups]
            held = [Held(np.stack(g["v"].to_list()).astype(np.int64), g["label"].to_numpy(np.int64), g["vid"].to_numpy(np.int64)) for _, g in groups]
            mine = Lists(lists.centres[here], lists.radii[here], lists.first[here], lists.shards[here])
            for ask in right.itertuples():
                q, kth = np.asarray(ask.v, np.int64), [int(x) for x in ask.kth]
                real = q.astype(np.float64)
                size = math.sqrt(float(real @ real))
                least, largest = mine.bounds(real)
                lo, hi = [int(x) for x in ask.lo], [int(x) for x in ask.hi]
                best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(lo)
                for j in np.argsort(-largest, kind="stable").tolist():
                    reached = [w for w in range(len(lo)) if largest[j] >= max(lo[w], kth[w])]
                    if not reached:
                        break
                    inside = [w for w in reached if least[j] <= hi[w]]
                    if not inside:
                        continue
                    score = held[j].scores(q, real, size)
                    fit, vid = (held[j].label == ask.label) == own, held[j].vid
                    for w in inside:
                        some = np.flatnonzero(fit & (score >= max(lo[w], kth[w])) & (score <= hi[w]))
                        if len(some):
                            s, i = np.concatenate([best[w][0], score[some]]), np.concatenate([best[w][1], vid[some]])
                            order = np.lexsort((i, -s))[:k]
                            best[w] = s[order], i[order]
                            if len(order) == k:
                                kth[w] = max(kth[w], int(s[order[-1]]))
                win = np.repeat(np.arange(len(lo)), [len(s) for s, _ in best])
                rows.append((ask.vid, ask.shard, kth, win, np.concatenate([i for _, i in best]), np.concatenate([s for s, _ in best])))
        return pd.DataFrame(rows, columns=["vid", "home", "kth", "win", "other", "score"])

    return run


def _meet(items: DataFrame, asks: DataFrame, visits: DataFrame, lists: Lists, own: bool, k: int) -> DataFrame:
    """The visits, done: shards meet chunks of their asks."""
    visits = stash(visits, "visits")
    chunks = visits.groupBy("shard").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    left = items.join(chunks, "shard").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    right = asks.drop("home").join(visits, "vid").join(chunks, "shard").withColumn("chunk", F.pmod(F.xxhash64("vid"), F.col("chunks")).cast("int")).drop("chunks")
    met = left.groupBy("shard", "chunk").cogroup(right.groupBy("shard", "chunk"))
    return met.applyInPandas(_visit(lists, own, k), "vid long, home long, kth array<long>, win array<int>, other array<long>, score array<long>")


def search(items: DataFrame, asks: DataFrame, lists: Lists, own: bool, k: int) -> DataFrame:
    """``vid``, ``win``, ``other``, ``score``: the k best entries of each ask and window, of its own label or of the others.

    ``asks`` holds ``vid``, ``label``, ``v`` and the windows' ends ``lo`` and ``hi``.
    """
    open_ = asks.withColumn("kth", F.transform("lo", lambda _: F.lit(LEAST)))
    near = stash(_meet(items, open_, _visits(open_, lists, True), lists, own, k), "near")
    known = asks.join(near.select("vid", "kth", "home"), "vid")
    rest = _meet(items, known, _visits(known, lists, False), lists, own, k)
    each = near.unionByName(rest).select("vid", F.explode(F.arrays_zip("win", "other", "score")).alias("x")).select("vid", "x.*")
    by = Window.partitionBy("vid", "win").orderBy(F.col("score").desc(), "other")
    return each.withColumn("nth", F.row_number().over(by)).filter(F.col("nth") <= k).drop("nth")


def _rows(found: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """Entries back to rows: ``vid``, ``win`` and ``best``, the k best rows as (-score, id)."""
    ids = found.join(classes.select(F.col("vid").alias("other"), "ids"), "other")
    each = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("order"), i.alias("id")))
    return ids.groupBy("vid", "win").agg(F.slice(F.array_sort(F.flatten(F.collect_list(each))), 1, k).alias("best"))  # k entries of k ids at most


def _mine(base: DataFrame, dim: int, is_anchor, negatives: int, positives: int, low: int, high: int) -> DataFrame:
    k = max(negatives, positives + 1)
    base = base.filter(F.size("v") == dim)
    nth = F.row_number().over(Window.partitionBy("label", "v").orderBy("vec_id"))
    classes = base.withColumn("nth", nth).filter(F.col("nth") <= k).groupBy("label", "v").agg(F.min("vec_id").alias("vid"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    classes = stash(classes, "classes")
    anchors = stash(base.filter(is_anchor).join(classes.select("label", "v", "vid"), ["label", "v"]).select(F.col("vec_id").alias("anchor_id"), "vid"), "anchors")
    items, lists = inverted(classes, dim)
    asks = classes.join(anchors.select("vid").distinct(), "vid", "left_semi").select("vid", "label", "v")
    every = asks.select("*", F.array(F.lit(LEAST)).alias("lo"), F.array(F.lit(MOST)).alias("hi"))
    near = stash(_rows(search(items, every, lists, True, positives + 1), classes, positives + 1).select("vid", F.col("best").alias("near")), "positives")
    # a window for each different score of a positive
    scores = F.array_distinct(F.transform(F.filter("near", lambda x: x["order"] <= 0), lambda x: -x["order"]))
    windows = asks.join(near, "vid").withColumn("scores", scores).filter(F.size("scores") > 0)
    ends = [F.expr(f"transform(scores, p -> ({c} * p + {up}) div 100)").alias(name) for name, c, up in (("lo", low, 99), ("hi", high, 0))]
    wanted = stash(windows.select("vid", "label", "v", "scores", *ends), "windows")
    far = _rows(search(items, wanted.drop("scores"), lists, False, negatives), classes, negatives)
    far = far.join(wanted.select("vid", "scores"), "vid").select("vid", F.struct((-F.get("scores", F.col("win"))).alias("order"), "best").alias("x"))
    answers = near.join(far.groupBy("vid").agg(F.collect_list("x").alias("far")), "vid")  # a window a positive at most
    mine = F.slice(F.filter("near", lambda x: x["id"] != F.col("anchor_id")), 1, positives)
    out = anchors.join(answers, "vid").select("anchor_id", F.explode(mine).alias("p"), "far")
    out = out.select("anchor_id", "p", F.explode("far").alias("f")).filter(F.col("f.order") == F.col("p.order")).select("anchor_id", "p", F.posexplode("f.best").alias("place", "n"))
    return out.select("anchor_id", F.col("p.id").alias("positive_id"), (F.col("place") + 1).cast("int").alias("rank"), F.col("n.id").alias("negative_id"), (-F.col("p.order")).alias("positive_score"), (-F.col("n.order")).alias("negative_score"))


def mine(vectors: DataFrame, is_anchor, label: F.Column | None = None, negatives: int = 5, positives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """For each anchor and positive the ``negatives`` best rows of other labels whose score is from ``low`` to ``high`` percent of the positive's.

    ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.
    """
    base = stash(usable(vectors, label), "vectors")
    sizes = sorted(r.dim for r in base.select(F.size("v").alias("dim")).distinct().collect())  # a row a length
    out = None
    for dim in sizes or [0]:
        found = _mine(base, dim, is_anchor, negatives, positives, low, high)
        out = found if out is None else out.unionByName(found)
    out = stash(out, "negatives")
    discard(base)
    return out


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, moved)


ORACLE = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other_id, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
negatives AS (
  SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
  FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT * FROM negatives WHERE rank <= 5
"""
