"""Approximate nearest neighbours with a hash-prefix forest.

Each of ``TREES`` trees gives a vector a string of ``BITS`` signs of random projections. A tree is the
sorted array of these strings: the vectors that share a prefix with a query lie side by side in it, so
descending to the longest match is a binary search. All trees ascend together, a bit at a time, until the
stretches that share the query's prefix hold enough vectors in all trees together (a vector counts once
a tree). Only these candidates are scored.

How many are enough is measured: for ``PROBES`` queries the true nearest are found by a scan, and how deep they lie with the query in any tree tells
what share of them an ascent would reach. The number begins at ``want(n)`` and grows until that share is ``RECALL``; so high dimensions and vectors without structure get more
candidates than clustered ones.

As Spark jobs: a tree is cut by its strings' first bits into groups of about ``GROUP`` strings, and a group is
the sorted array of one task. In the first pass the queries meet their group of each tree and count the
matches at each depth; the counts are summed over the trees, and a query takes the deepest level that holds
enough (above the groups, the groups' own counts are summed). In the second pass the queries go to the groups below
their prefixes and are scored against the stretch, by 8-bit codes of the unit vectors; the ``ROUGH`` best of all trees are
scored again from the original vectors. So a vector moves once a tree, as a code, however many
queries there are, and scores are worked out for the forest's candidates only. Groups that stay large because their vectors
share the first bits are cut into blocks of a bounded size, which each of their queries visits.

Equal vectors are one entry of the forest, with their ``k + 1`` smallest ids (no more can be in an answer, as ties
go to the smaller id), and equal queries are asked once; so a vector that a third of all rows hold costs no more than any other.

``want`` grows as the number of vectors to the power of 0.8, so the share of the table that is scored falls as the table grows. The queries that visit one block are dealt to
chunks of about ``CHUNK``, each with a copy of the block.

Vectors that are null, zero, or hold nulls or non-finite components take no part. Vectors of different
lengths are not compared. Rows that repeat an id are one vector, the smallest of them. Rows with a null id are
left out. Fewer than k candidates: all of them. An empty table gives an empty result, and extra columns are not read.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dayloom.llm.common import discard, stash, table

TREES, BITS = 48, 32
#: Strings of a group, about; and numbers that a block of a group holds.
GROUP, BLOCK_NUMBERS = 4096, 1 << 20
#: Candidates that a tree's group hands on, and those that are scored from the original vectors.
KEEP, ROUGH = 12, 24
#: Queries whose true nearest are looked for, the share of those that an ascent must reach, and queries of a block in one task.
PROBES, RECALL, CHUNK = 64, 0.95, 4096


def want(n: int) -> int:
    """How many candidates (counted once a tree) a query ascends for, among n vectors."""
    return max(512, math.ceil(3.4 * n**0.8))


@functools.lru_cache(4)
def projections(dim: int) -> np.ndarray:
    """The trees' projections: (dim, TREES * BITS); those of a tree are orthogonal where there is room."""
    rng = np.random.Generator(np.random.PCG64(5))
    planes = rng.standard_normal((TREES, dim, BITS))
    if dim >= BITS:
        for t in range(TREES):
            q, r = np.linalg.qr(planes[t])
            planes[t] = q * np.sign(np.diag(r))
    return planes.transpose(1, 0, 2).reshape(dim, TREES * BITS).astype(np.float32)


def strings(unit: np.ndarray) -> np.ndarray:
    """The hash string of each vector in each tree, as an integer: (vectors, TREES)."""
    signs = np.packbits(((unit @ projections(unit.shape[1])) > 0).reshape(len(unit), TREES, BITS), axis=2)
    return np.ascontiguousarray(signs).view(">u4")[:, :, 0].astype(np.int64)


def units(v: pa.Array) -> np.ndarray:
    x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """``vec_id`` and ``v`` (doubles) of the vectors that take part, one an id."""
    v = F.col(column).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = vectors.select(F.col("vec_id").cast("long"), v.alias("v"), bad.alias("bad"), F.exists(v, lambda x: x != 0).alias("some"))
    return some.filter("vec_id is not null and v is not null and not bad and some").groupBy("vec_id").agg(F.min("v").alias("v"))


def _by_length(b: pa.RecordBatch):
    """Parts of a batch whose vectors are of one length, of at most 2048 rows."""
    size = b.column("v").value_lengths().to_numpy()
    for dim in np.unique(size).tolist():
        rows = np.flatnonzero(size == dim)
        for at in range(0, len(rows), 2048):
            yield dim, b.take(pa.array(rows[at : at + 2048]))


def _packed(classes: DataFrame, bits: int, codes: bool) -> DataFrame:
    """Each tree's strings in bundles by group: ``dim``, ``tree``, ``prefix``, ``mix``, ``n``, ``keys`` and, if asked for, ``ids`` and ``codes``."""

    def run(batches):
        for whole in batches:
            for dim, b in _by_length(whole):
                unit, ids = units(b.column("v")), b.column("vid").to_numpy()
                key = strings(unit)
                top = np.abs(unit).max(axis=1, keepdims=True)
                row = np.concatenate([np.rint(unit / top * 127).astype(np.int8), (top / 127).view(np.int8)], axis=1)
                for tree in range(TREES):
                    order = np.argsort(key[:, tree], kind="stable")
                    sort = key[order, tree]
                    cut = np.flatnonzero(np.diff(sort >> (BITS - bits), prepend=-1))
                    ends = np.append(cut[1:], len(sort))
                    parts = list(zip(cut.tolist(), ends.tolist(), strict=True))
                    cols = [
                        pa.array(np.full(len(cut), dim), pa.int32()), pa.array(np.full(len(cut), tree), pa.int32()), pa.array(sort[cut] >> (BITS - bits)), pa.array(ids[order[cut]]),
                        pa.array(ends - cut, pa.int64()), pa.array([sort[i:j].astype("<u4").tobytes() for i, j in parts], pa.binary()),
                    ]
                    if codes:
                        cols += [pa.array([ids[order[i:j]].astype("<i8").tobytes() for i, j in parts], pa.binary()), pa.array([row[order[i:j]].tobytes() for i, j in parts], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, _PACKED[: len(cols)])

    form = "dim int, tree int, prefix long, mix long, n long, keys binary" + (", ids binary, codes binary" if codes else "")
    return classes.select("vid", "v").mapInArrow(run, form)


_PACKED = ["dim", "tree", "prefix", "mix", "n", "keys", "ids", "codes"]
_GROUP = ["dim", "tree", "prefix"]


def _asked(queries: DataFrame) -> DataFrame:
    """``vid``, ``dim``, ``tree``, ``key`` and ``unit`` of each query in each tree."""

    def run(batches):
        for whole in batches:
            for dim, b in _by_length(whole):
                unit = units(b.column("v"))
                raw = [u.tobytes() for u in unit]
                n = b.num_rows
                yield pa.RecordBatch.from_arrays(
                    [b.column("vid").take(pa.array(np.repeat(np.arange(n), TREES))), pa.array(np.full(n * TREES, dim), pa.int32()), pa.array(np.tile(np.arange(TREES), n), pa.int32()), pa.array(strings(unit).reshape(-1)), pa.array(raw, pa.binary()).take(pa.array(np.repeat(np.arange(n), TREES)))],
                    ["vid", "dim", "tree", "key", "unit"],
                )

    return queries.select("vid", "v").mapInArrow(run, "vid long, dim int, tree int, key long, unit binary")


def _totals(classes: DataFrame, asked: DataFrame, groups: DataFrame, bits: int) -> DataFrame:
    """``vid`` and ``total``: a query's matches in all trees at each level from ``bits`` on."""
    levels = list(range(bits, BITS + 1))

    def count(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        keys = np.sort(np.frombuffer(b"".join(left["keys"]), "<u4")).astype(np.int64)
        q = right["key"].to_numpy(np.int64)
        found = np.zeros((len(q), len(levels)), np.int64)
        for i, depth in enumerate(levels if len(keys) else ()):
            low = q >> (BITS - depth) << (BITS - depth)
            found[:, i] = np.searchsorted(keys, low + (1 << (BITS - depth))) - np.searchsorted(keys, low)
        return pd.DataFrame({"vid": right["vid"], "found": pd.Series(list(found), index=right.index, dtype=object)})

    own = asked.select("vid", "dim", "tree", "key", F.shiftright("key", BITS - bits).alias("prefix"))
    met = _met(_packed(classes, bits, False), own, groups, count, "vid long, found array<long>")
    return stash(met.groupBy("vid").agg(F.array(*[F.sum(F.get("found", F.lit(i))) for i in range(len(levels))]).alias("total")), "total")


def _depths(total: DataFrame, asked: DataFrame, groups: DataFrame, bits: int, enough: int) -> DataFrame:
    """``vid`` and ``depth``: the deepest level at which the trees hold enough matches of a query."""
    deep = F.array_max(F.transform("total", lambda t, i: F.when(t >= enough, i + bits)))
    found = total.select("vid", deep.alias("depth"))
    if not bits:
        return found.select("vid", F.coalesce("depth", F.lit(0)).alias("depth"))
    # queries whose groups hold too little ascend above them: there the groups' counts are summed
    above = F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("depth")
    up = lambda c, width: F.expr(f"shiftright({c}, {width} - depth)").alias("top")
    held = groups.select("dim", "tree", "prefix", "n", above).groupBy("dim", "tree", "depth", up("prefix", bits)).agg(F.sum("n").alias("n"))
    few = found.filter("depth is null").select("vid")
    high = asked.join(few, "vid", "left_semi").select("vid", "dim", "tree", "key", above).select("vid", "dim", "tree", "depth", up("key", BITS))
    high = high.join(held, ["dim", "tree", "depth", "top"], "left").groupBy("vid", "depth").agg(F.sum("n").alias("n"))
    high = high.groupBy("vid").agg(F.coalesce(F.max(F.when(F.col("n") >= enough, F.col("depth"))), F.lit(0)).alias("depth"))
    return found.filter("depth is not null").unionByName(high)


def _met(packed: DataFrame, asked: DataFrame, groups: DataFrame, work, form: str) -> DataFrame:
    """``work`` on each block of a group (large groups have several) and each chunk of the queries that visit it; queries of groups without vectors go."""
    visits = asked.groupBy(*_GROUP).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    deal = groups.select(*_GROUP, "blocks").join(visits, _GROUP, "left").na.fill(1, ["chunks"])
    every = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
    large = deal.filter("blocks > 1 or chunks > 1")
    left = packed.join(large, _GROUP, "left").na.fill(1, ["blocks", "chunks"])
    left = left.withColumn("sub", F.pmod(F.xxhash64("mix"), F.col("blocks")).cast("int")).withColumn("chunk", every("chunks")).drop("blocks", "chunks", "mix")
    right = asked.join(deal, _GROUP).withColumn("sub", every("blocks")).withColumn("chunk", F.pmod(F.xxhash64("vid"), F.col("chunks")).cast("int")).drop("blocks", "chunks")
    return left.groupBy(*_GROUP, "sub", "chunk").cogroup(right.groupBy(*_GROUP, "sub", "chunk")).applyInPandas(work, form)


def _truly_nearest(classes: DataFrame, probes: list, k: int) -> DataFrame:
    """``vid``, ``other`` and the other's ``v``: by a scan, the nearest of a few queries (rows of ``vid`` and ``v``)."""
    by: dict[int, list] = {}
    for p in probes:
        by.setdefault(len(p.v), []).append(p)
    asked = {dim: (np.array([p.vid for p in ps]), units(pa.array([p.v for p in ps], pa.list_(pa.float64())))) for dim, ps in by.items()}

    def run(batches):
        for whole in batches:
            for dim, b in _by_length(whole):
                if dim in asked:
                    vid, unit = asked[dim]
                    ids, score = b.column("vid").to_numpy(), unit @ units(b.column("v")).T
                    score[vid[:, None] == ids[None, :]] = -2
                    best = np.argsort(-score, axis=1, kind="stable")[:, :k]
                    at, rows = pa.array(best.reshape(-1)), np.repeat(np.arange(len(vid)), best.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(vid[rows]), b.column("vid").take(at), b.column("v").take(at), pa.array(np.take_along_axis(score, best, 1).reshape(-1).astype(np.float64))], ["vid", "other", "v", "score"])

    found = classes.select("vid", "v").mapInArrow(run, "vid long, other long, v array<double>, score double").filter("score > -2")
    nth = F.row_number().over(Window.partitionBy("vid").orderBy(F.col("score").desc(), "other"))
    return found.withColumn("nth", nth).filter(F.col("nth") <= k).select("vid", "other", "v")


def enough_for(classes: DataFrame, asks: DataFrame, total: DataFrame, bits: int, n: int, k: int) -> int:
    """How many candidates (counted once a tree) let ``RECALL`` of the probes' nearest be reached: ``want(n)``, or more."""
    probes = classes.join(asks.select("vid").distinct(), "vid", "left_semi").select("vid", "v").orderBy(F.xxhash64("vid", F.lit("probe")), "vid").limit(PROBES).collect()  # PROBES rows
    near = _truly_nearest(classes, probes, k).collect() if probes else []  # k rows each
    own = {p.vid: strings(units(pa.array([p.v], pa.list_(pa.float64()))))[0] for p in probes}
    asked = [r.vid for r in near]
    counts = {r.vid: np.array(r.total) for r in total.filter(F.col("vid").isin(list(own))).collect()} if probes else {}
    reach = []  # the matches at the deepest level at which a tree holds both: fewer than that, and the ascent goes on to there
    for r, vid in zip(near, asked, strict=True):
        other = strings(units(pa.array([r.v], pa.list_(pa.float64()))))[0]
        depth = max(BITS - int(x).bit_length() for x in own[vid] ^ other)
        held = counts.get(vid)
        below = held[depth + 1 - bits] if held is not None and bits <= depth + 1 <= BITS else 0
        reach.append(n * TREES if depth + 1 < bits else int(below) + 1)
    if not reach:
        return want(n)
    reach.sort()
    return max(want(n), min(n * TREES, reach[min(len(reach) - 1, math.ceil(RECALL * len(reach)) - 1)]))


def _scored(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """The best of a block for each query: ``vid``, ``other``, ``rough``."""
    out = []
    if len(left) and len(right):
        dim = len(right["unit"].iloc[0]) // 4
        keys = np.frombuffer(b"".join(left["keys"]), "<u4").astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, ids = keys[order], np.frombuffer(b"".join(left["ids"]), "<i8")[order]
        rows = np.frombuffer(b"".join(left["codes"]), np.int8).reshape(len(keys), dim + 4)[order]
        code = rows[:, :dim].astype(np.float32) * np.ascontiguousarray(rows[:, dim:]).view(np.float32)
        depth, q = right["depth"].to_numpy(np.int64), right["key"].to_numpy(np.int64)
        low = q >> (BITS - depth) << (BITS - depth)
        lo, hi = np.searchsorted(keys, low), np.searchsorted(keys, low + (1 << (BITS - depth)))
        unit = np.frombuffer(b"".join(right["unit"]), np.float32).reshape(-1, dim)
        asks = right["vid"].to_numpy(np.int64)
        for i, j in sorted(set(zip(lo.tolist(), hi.tolist(), strict=True))):
            same = np.flatnonzero((lo == i) & (hi == j)) if j > i else ()
            for at in range(0, len(same), 256):
                some = same[at : at + 256]
                score = unit[some] @ code[i:j].T
                best = np.argpartition(-score, KEEP, axis=1)[:, :KEEP] if j - i > KEEP else np.broadcast_to(np.arange(j - i), (len(some), j - i))
                out.append((np.repeat(asks[some], best.shape[1]), ids[i:j][best].reshape(-1), np.take_along_axis(score, best, 1).reshape(-1)))
    vid, other, rough = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
    return pd.DataFrame({"vid": vid, "other": other, "rough": rough})


def candidates(vectors: DataFrame, is_query, k: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The classes of equal vectors (``vid``, ``v``, ``ids``), the queries (``query_id``, ``vid``), and their rough best (``vid``, ``other``)."""
    base = stash(usable(vectors), "vectors")
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    classes = base.withColumn("nth", nth).filter(F.col("nth") <= k + 1).groupBy("v").agg(F.min("vec_id").alias("vid"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    classes = stash(classes, "classes")
    asks = stash(base.filter(is_query).join(classes.select("v", "vid"), "v").select(F.col("vec_id").alias("query_id"), "vid"), "asks")
    n = classes.count()
    bits = max(0, min(BITS // 2, int(math.log2(max(1, n) / max(GROUP, want(n) / TREES)))))
    asked = _asked(classes.join(asks.select("vid").distinct(), "vid", "left_semi"))
    most = F.greatest(F.lit(1024), F.lit(BLOCK_NUMBERS) / F.col("dim"))
    groups = _packed(classes, bits, False).groupBy(*_GROUP).agg(F.sum("n").alias("n")).withColumn("blocks", F.ceil(F.col("n") / most).cast("int"))
    groups = stash(groups, "groups")
    total = _totals(classes, asked, groups, bits)
    depths = stash(_depths(total, asked, groups, bits, enough_for(classes, asks, total, bits, n, k)), "depths")
    placed = asked.join(depths, "vid")
    low = F.expr(f"shiftright(key, {BITS - bits})")
    first = F.when(F.col("depth") >= bits, low).otherwise(F.expr(f"shiftleft(shiftright(key, {BITS} - depth), {bits} - depth)"))
    last = F.when(F.col("depth") >= bits, low).otherwise(first + F.expr(f"shiftleft(1L, {bits} - depth)") - 1)
    placed = placed.withColumn("prefix", F.explode(F.sequence(first, last)))
    met = _met(_packed(classes, bits, True), placed, groups, _scored, "vid long, other long, rough float")
    found = met.groupBy("vid", "other").agg(F.max("rough").alias("rough"))
    found = found.withColumn("nth", F.row_number().over(Window.partitionBy("vid").orderBy(F.col("rough").desc(), "other"))).filter(F.col("nth") <= ROUGH)
    out = stash(found.select("vid", "other"), "rough")
    for df in (base, groups, total, depths):
        discard(df)
    return classes, asks, out


def _moderate(v) -> F.Column:
    """A vector whose squares neither overflow nor vanish: as it is, or (exactly) times a power of two where its largest component is far from 1."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x)))
    power = F.pow(F.lit(2.0), F.least(F.lit(1000.0), F.greatest(F.lit(-1000.0), -F.floor(F.log2(top)).cast("double"))))
    return F.when(top.between(1e-100, 1e100), v).otherwise(F.zip_with(v, F.array_repeat(power, F.size(v)), lambda x, p: x * p))


def search(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: each query's nearest found by cosine."""
    classes, asks, found = candidates(vectors, is_query, k)
    classes = classes.withColumn("v", _moderate(F.col("v")))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    pairs = found.join(classes.select(F.col("vid").alias("other"), F.col("v").alias("w"), "ids"), "other").join(classes.select("vid", "v"), "vid")
    pairs = pairs.select("vid", "ids", (dot("v", "w") / (F.sqrt(dot("v", "v")) * F.sqrt(dot("w", "w")))).alias("score"))
    each = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("order"), i.alias("id")))
    best = pairs.groupBy("vid").agg(F.array_sort(F.flatten(F.collect_list(each))).alias("best"))  # ROUGH classes of k + 1 ids
    mine = F.slice(F.filter("best", lambda x: x["id"] != F.col("query_id")), 1, k)
    out = asks.join(best, "vid").select("query_id", F.posexplode(mine).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.order")).alias("score"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
