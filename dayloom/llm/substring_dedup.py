"""Exact removal of repeated 100-byte strings, by bucket-pointer refinement over sampled suffixes.

Every string of ``LENGTH`` bytes is filed under one of its suffixes: the one whose first ``GRAM`` bytes hash
lowest (the leftmost, on a tie). Equal strings choose the same place, so neighbouring strings that share
their suffix form a block, and only one suffix in about thirty positions is kept. Then:

1. Blocks are bucketed by the gram and the whole block's hash (128 bits together). All but the first occurrence
   of a block, by (document, start), repeat. A task first drops its own repeats, so that a text copied any
   number of times sends each reducer at most one row a task.
2. First occurrences whose gram's bucket holds several different blocks need refining: their bytes are
   brought together by gram, and buckets of 8-byte strings are refined to 16, 32, 64 and ``LENGTH`` bytes by
   sorting on the pair of a position's bucket and the bucket at a later offset; positions alone in their
   bucket leave, and each round's buckets serve the next. This compares real bytes.
3. Buckets of more than ``MOST_GROUP`` blocks are not brought together: their strings are sent one by one under
   128-bit hashes, with the same reduction as in step 1.

The repeats' bytes, merged, are what goes. Null text is empty. Rows of equal ``doc_id`` are ordered by
a hash of their text; rows equal in both are one document and get the same result. A null ``doc_id`` comes
first. Extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayloom.llm.common import SHINGLE_C, Rolling, discard, flat, join_on, mix, pieces, release, second, signed, stash, table

LENGTH, GRAM = 100, 32
#: Blocks of one gram that are brought together, and rows that a task refines at a time.
MOST_GROUP, REFINE_ROWS = 8192, 4096
#: A longer document is read in overlapping segments of this many bytes.
SEGMENT = 1 << 22
#: Bytes of text that are worked on at a time.
PIECE = 1 << 20
#: Blocks among which a task drops its own repeats at a time.
LOCAL_ROWS = 1 << 19
_PLACE = np.uint64((1 << 24) - 1)


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id``, its order ``id``, the text's hash ``th`` and the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def blocks(buf: np.ndarray, off: np.ndarray):
    """Document, first start, starts, the suffix's offset from the first start, gram hash and block hash of each block."""
    n = len(buf)
    m = n - LENGTH + 1
    if m <= 0:
        return None
    gram = mix(Rolling(buf)(np.arange(n - GRAM + 1), np.arange(GRAM, n + 1)))
    low = (gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64)
    width, have = LENGTH - GRAM + 1, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    suffix = (low & _PLACE).astype(np.int64)
    start = np.arange(m)
    doc = np.searchsorted(off, start, side="right") - 1
    suffix[start + LENGTH > off[doc + 1]] = -1
    cut = np.flatnonzero((np.diff(suffix, prepend=-2) != 0) | (np.diff(doc, prepend=-1) != 0))
    lo, hi = cut, np.append(cut[1:], m)
    real = suffix[lo] >= 0
    lo, hi = lo[real], hi[real]
    at = suffix[lo]
    h = mix(second(buf)(lo, hi - 1 + LENGTH) + (at - lo).astype(np.uint64) * SHINGLE_C[3] + (hi - lo).astype(np.uint64) * SHINGLE_C[4])
    return doc[lo], lo, hi - lo, gram[at], h


def _segments(batches):
    """(ids, hashes, bytes, offsets, where the bytes begin in the document) of some documents, or of a part of a long one."""
    for whole in batches:
        for b in pieces(whole, "text", PIECE):
            buf, off = flat(b.column("text"))
            ids, th = b.column("id").to_numpy(), b.column("th").to_numpy()
            if len(buf) <= SEGMENT:
                yield ids, th, buf, off, 0
            else:
                for at in range(0, len(buf) - LENGTH + 1, SEGMENT):
                    part = buf[at : at + SEGMENT + LENGTH - 1]
                    yield ids, th, part, np.array([0, len(part)], np.int64), at


_ROW = "k1 long, k2 long, id long, th long, lo int, n int, again boolean"


def _first_in_task(parts):
    """Rows of (k1, k2, id, th, lo, n), in batches; repeats within the task are told and sent elsewhere."""

    def out(rows):
        k1, k2, ids, th, lo, n = (np.concatenate(c) for c in zip(*rows, strict=True))
        order = np.lexsort((lo, th, ids, k2, k1))
        k1, k2, ids, th, lo, n = (c[order] for c in (k1, k2, ids, th, lo, n))
        new = np.ones(len(k1), bool)
        new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        again = (ids != ids[lead]) | (th != th[lead]) | (lo != lo[lead])
        spread = mix(ids.view(np.uint64) * SHINGLE_C[5] + lo.astype(np.uint64)).view(np.int64)
        k1, k2 = np.where(again, spread, k1), np.where(again, spread, k2)
        for at in range(0, len(k1), 65536):
            s = slice(at, at + 65536)
            yield pa.RecordBatch.from_arrays(
                [pa.array(k1[s]), pa.array(k2[s]), pa.array(ids[s]), pa.array(th[s]), pa.array(lo[s].astype(np.int32)), pa.array(n[s].astype(np.int32)), pa.array(again[s])],
                ["k1", "k2", "id", "th", "lo", "n", "again"],
            )

    rows, have = [], 0
    for r in parts:
        rows.append(r)
        have += len(r[0])
        if have >= LOCAL_ROWS:
            yield from out(rows)
            rows, have = [], 0
    if have:
        yield from out(rows)


def _all_blocks(batches):
    def parts():
        for ids, th, buf, off, base in _segments(batches):
            got = blocks(buf, off)
            if got is not None:
                doc, lo, n, g, h = got
                yield signed(g), signed(h), ids[doc], th[doc], lo - off[doc] + base, n

    yield from _first_in_task(parts())


def _mark_first(rows: DataFrame) -> DataFrame:
    """``rows`` (of ``_ROW``) with ``again`` set on all but the first occurrence of each key."""

    def run(batches):
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            c = {k: b.column(k).to_numpy(zero_copy_only=False) for k in ("k1", "k2", "id", "th", "lo", "again")}
            new = np.ones(b.num_rows, bool)
            new[1:] = (c["k1"][1:] != c["k1"][:-1]) | (c["k2"][1:] != c["k2"][:-1])
            if last is not None and (c["k1"][0], c["k2"][0]) == last[:2]:
                new[0] = False
            lead = np.cumsum(new) - 1
            at = np.flatnonzero(new)
            head = [np.concatenate([[last[2 + i] if last is not None else 0], c[k][at]]) for i, k in enumerate(("id", "th", "lo"))]
            again = c["again"] | (c["id"] != head[0][lead + 1]) | (c["th"] != head[1][lead + 1]) | (c["lo"] != head[2][lead + 1])
            last = (c["k1"][-1], c["k2"][-1], *(h[lead[-1] + 1] for h in head))
            yield b.set_column(b.schema.get_field_index("again"), "again", pa.array(again))

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "k1", "k2").sortWithinPartitions("k1", "k2", "id", "th", "lo").mapInArrow(run, _ROW)


def refine(text: np.ndarray, end: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which of ``starts`` begin a string of LENGTH bytes that some earlier start begins too.

    ``end`` gives each position's end of text. Buckets of 8 bytes are refined by later buckets.
    """
    room = end - np.arange(len(text))
    at = np.flatnonzero(room >= 8)
    value = np.zeros(len(at), np.uint64)
    for i in range(8):
        value |= text[at + i].astype(np.uint64) << np.uint64(8 * i)
    bucket = np.full(len(text), -1, np.int64)
    _, name, many = np.unique(value, return_inverse=True, return_counts=True)
    bucket[at] = np.where(many[name] > 1, name, -1)
    have = 8
    while have < LENGTH:
        step = min(have, LENGTH - have)
        at = starts if have + step == LENGTH else np.flatnonzero(room >= have + step)
        at = at[(bucket[at] >= 0) & (bucket[at + step] >= 0)]
        key = bucket[at] * np.int64(len(text) + 1) + bucket[at + step]
        _, lead, name, many = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        bucket = np.full(len(text), -1, np.int64)
        bucket[at] = np.where(many[name] > 1, name, -1)
        have += step
    later = np.zeros(len(text), bool)
    later[at] = at > at[lead[name]] if len(at) else False
    return later[starts]


_SPAN = "id long, th long, lo int, n int"


def _refined(batches):
    """Repeated starts among blocks that come sorted by (k1, id, th, lo), whole groups of k1 at a time."""

    def out(t: pa.Table):
        buf, off = flat(t.column("bytes").combine_chunks())
        n = t.column("n").to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(len(n)), n)
        starts = off[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        dup = refine(buf, np.repeat(off[1:], np.diff(off)), starts)
        run = np.concatenate([[False], dup[:-1]]) & (np.diff(owner, prepend=-1) == 0)
        first, last = np.flatnonzero(dup & ~run), np.flatnonzero(dup & ~np.concatenate([(dup[1:] & (owner[1:] == owner[:-1])), [False]]))
        own = owner[first]
        lo = t.column("lo").to_numpy()[own] + (starts[first] - off[own])
        return pa.RecordBatch.from_arrays(
            [pa.array(t.column("id").to_numpy()[own]), pa.array(t.column("th").to_numpy()[own]), pa.array(lo.astype(np.int32)), pa.array((last - first + 1).astype(np.int32))], ["id", "th", "lo", "n"]
        )

    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        if held.num_rows >= REFINE_ROWS:
            k = held.column("k1").to_numpy()
            cut = int(np.flatnonzero(k != k[-1]).max(initial=-1)) + 1
            if cut:
                yield out(held.slice(0, cut))
                held = held.slice(cut)
    if held is not None and held.num_rows:
        yield out(held)


def repeated(docs: DataFrame) -> DataFrame:
    """``id``, ``th``, ``lo``, ``n``: runs of starts whose strings also start earlier."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = keyed(docs).select("id", "th", "text")
    marked = _mark_first(source.mapInArrow(_all_blocks, _ROW))
    marked = stash(marked.select(F.when(~F.col("again"), F.col("k1")).alias("k1"), "id", "th", "lo", "n", "again"), "blocks")
    release(spark)
    runs = stash(marked.filter("again").select("id", "th", "lo", "n"), "runs")
    firsts = marked.filter("not again").select("k1", "id", "th", "lo", "n")
    many = stash(firsts.groupBy("k1").agg(F.count("*").alias("members")).filter("members > 1"), "grams")
    release(spark)
    open_ = stash(firsts.join(many, "k1"), "open")
    discard(marked)
    release(spark)

    def cut(batches):
        for b in batches:
            for part in pieces(b, "text", PIECE):
                buf, off = flat(part.column("text"))
                lists = part.column("blocks")
                rows = pa.Table.from_struct_array(lists.flatten())
                owner = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                lo, many_ = rows.column("lo").to_numpy(), rows.column("n").to_numpy()
                raw = buf.tobytes()
                at = off[owner] + lo
                yield pa.RecordBatch.from_arrays(
                    [rows.column("k1").combine_chunks(), part.column("id").take(pa.array(owner)), part.column("th").take(pa.array(owner)), pa.array(lo), pa.array(many_), pa.array([raw[i:j] for i, j in zip(at.tolist(), (at + many_ - 1 + LENGTH).tolist(), strict=True)], pa.binary())],
                    ["k1", "id", "th", "lo", "n", "bytes"],
                )

    def brought(some: DataFrame) -> DataFrame:
        by_doc = some.groupBy("id", "th").agg(F.collect_list(F.struct("k1", "lo", "n")).alias("blocks"))
        return source.join(by_doc, ["id", "th"]).dropDuplicates(["id", "th"]).mapInArrow(cut, "k1 long, id long, th long, lo int, n int, bytes binary")

    near = brought(open_.filter(F.col("members") <= MOST_GROUP)).repartition(n, "k1").sortWithinPartitions("k1", "id", "th", "lo")
    runs = runs.union(stash(near.mapInArrow(_refined, _SPAN), "refined"))
    hot = open_.filter(F.col("members") > MOST_GROUP)
    if not hot.isEmpty():

        def strings(batches):
            def parts():
                for b in batches:
                    for part in pieces(b, "bytes", 1 << 19):
                        buf, off = flat(part.column("bytes"))
                        many_ = part.column("n").to_numpy().astype(np.int64)
                        owner = np.repeat(np.arange(len(many_)), many_)
                        step = np.arange(len(owner)) - np.repeat(np.cumsum(many_) - many_, many_)
                        at = off[owner] + step
                        k1, k2 = mix(Rolling(buf)(at, at + LENGTH)), mix(second(buf)(at, at + LENGTH))
                        yield signed(k1), signed(k2), part.column("id").to_numpy()[owner], part.column("th").to_numpy()[owner], part.column("lo").to_numpy()[owner] + step, np.ones(len(owner), np.int64)

            yield from _first_in_task(parts())

        single = _mark_first(brought(hot).mapInArrow(strings, _ROW)).filter("again").select("id", "th", "lo", "n")
        runs = runs.union(stash(single, "single"))
    release(spark)
    return runs


def dedupe(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (binary): each row without its repeated strings."""
    runs = repeated(docs).groupBy("id", "th").agg(F.collect_list(F.struct("lo", "n")).alias("runs"))
    rows = join_on(keyed(docs), runs, ["id", "th"], "left")

    def run(batches):
        for whole in batches:
            for b in pieces(whole, "text", PIECE):
                buf, off = flat(b.column("text"))
                lists = b.column("runs")
                gone = np.zeros(len(buf) + 1, np.int32)
                flat_runs = lists.flatten()
                if len(flat_runs):
                    owner = np.repeat(np.arange(b.num_rows), np.asarray(lists.value_lengths().fill_null(0)))
                    lo, n = (flat_runs.field(k).to_numpy().astype(np.int64) for k in (0, 1))
                    np.add.at(gone, off[owner] + lo, 1)
                    np.add.at(gone, off[owner] + lo + n - 1 + LENGTH, -1)
                covered = np.cumsum(gone[:-1]) > 0
                first = covered.copy()
                first[1:] &= ~covered[:-1]
                edge = off[:-1][off[:-1] < len(buf)]
                first[edge] = covered[edge]
                total = [np.concatenate([[0], np.cumsum(x)]) for x in (covered, first)]
                removed, n_spans = (t[off[1:]] - t[off[:-1]] for t in total)
                kept_off = np.concatenate([[0], np.cumsum(np.diff(off) - removed)]).astype(np.int64)
                raw = buf[~covered].tobytes()
                kept = [raw[i:j] for i, j in zip(kept_off[:-1].tolist(), kept_off[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(off)), pa.array(removed.astype(np.int64)), pa.array(n_spans.astype(np.int64)), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.select(F.col("doc_id").cast("long"), "text", "runs").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
