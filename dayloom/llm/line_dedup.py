"""Removal of repeated runs of lines, found as content-defined chunks.

A text is a sequence of lines (separated by ``\\n``). A rolling hash over the hashes of ``ROLL`` lines ends a
chunk where it is 0 modulo ``MODULUS``, so that boundaries depend on the lines around them alone and
survive insertions before them. A chunk of at least ``LEAST_LINES`` lines that stands earlier in the corpus
too, by (document, place), is removed, after its bytes are compared with the first one's. What stays of a
document are its other lines, joined by ``\\n``.

A repeat that holds no two boundaries is no chunk, so with ``whole_runs`` every two lines in a row are looked up too,
by a 128-bit BLAKE2b digest of their bytes: those that stand earlier in the corpus are removed. A run of
``LEAST_LINES`` lines or more is repeated just if each two of its lines in a row are, so all of it goes, wherever
it begins and ends. A chunk counts as removed if all its lines are.

A task first drops its own repeats, so that a chunk repeated any number of times sends a reducer at
most a few rows a task. Chunks whose hashes agree and whose bytes differ are kept apart.

Null text is empty: one empty line, nothing removed. Rows of equal ``doc_id`` are ordered by a hash of
their text; rows equal in both are one document and get the same result. A null ``doc_id`` comes
first. Extra columns pass through ``dedupe``; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayloom.llm.common import SHINGLE_C, Rolling, flat, mix, pieces, second, signed, table

ROLL, MODULUS, LEAST_LINES = 2, 4, 2
#: Bytes of chunks that a task remembers in order to drop its own repeats.
LOCAL_BYTES = 1 << 26
#: The same for pairs of lines: how many.
LOCAL_PAIRS = 300_000


def closed(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts, each with a separator at its end, and their offsets."""
    return flat(pc.binary_join_element_wise(text.fill_null(""), pa.scalar("", text.type), pa.scalar("\n", text.type)))


def chunks(buf: np.ndarray, off: np.ndarray):
    """Per chunk of ``closed`` texts: document, number within it, lines, first and end byte, two hashes."""
    end = np.flatnonzero(buf == 10)
    start = np.concatenate([[0], end[:-1] + 1])[: len(end)]
    doc = np.searchsorted(off, end, side="right") - 1
    h = mix(Rolling(buf)(start, end))
    roll = np.zeros(len(h), np.uint64)
    for k in range(min(ROLL, len(h))):
        roll[k:] += np.where(doc[k:] == doc[: len(doc) - k], h[: len(h) - k], np.uint64(0)) * SHINGLE_C[30 + k]
    cut = (mix(roll) % np.uint64(MODULUS) == 0) | (np.diff(doc, append=-1) != 0)
    last = np.flatnonzero(cut)
    first = np.concatenate([[0], last[:-1] + 1])[: len(last)]
    a, z, d = start[first], end[last], doc[first]
    lines = last - first + 1
    return d, np.arange(len(d)) - np.searchsorted(d, d), lines, a, z, mix(Rolling(buf)(a, z) + lines.astype(np.uint64)), mix(second(buf)(a, z))


_ROW = "k1 long, k2 long, id long, th long, number int, bytes binary"


def _chunk_rows(batches):
    """Chunks of several lines; of those a task has seen already, only their place, under a key of their own."""
    seen: dict[bytes, tuple] = {}
    held = 0
    for whole in batches:
        for b in pieces(whole, "text"):
            buf, off = closed(b.column("text"))
            ids, th = b.column("id").to_numpy(), b.column("th").to_numpy()
            doc, number, lines, a, z, k1, k2 = chunks(buf, off)
            some = np.flatnonzero(lines >= LEAST_LINES)
            order = some[np.lexsort((number[some], th[doc[some]], ids[doc[some]]))]
            k1, k2 = signed(k1).copy(), signed(k2).copy()
            raw, out = buf.tobytes(), []
            for i in order.tolist():
                chunk = raw[a[i] : z[i]]
                place = (ids[doc[i]], th[doc[i]], number[i])
                if seen.get(chunk, place) < place:  # an earlier one of this task will stand for it
                    k1[i] = signed(mix(np.array([hash(place)], np.int64).view(np.uint64)))[0]
                    out.append(None)
                else:
                    seen[chunk] = place
                    held += len(chunk)
                    out.append(chunk)
            if held > LOCAL_BYTES:
                seen.clear()
                held = 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(k1[order]), pa.array(k2[order]), pa.array(ids[doc[order]]), pa.array(th[doc[order]]), pa.array(number[order].astype(np.int32)), pa.array(out, pa.binary())],
                ["k1", "k2", "id", "th", "number", "bytes"],
            )


def _later(batches):
    """The places of all chunks but the first of each content; rows come sorted by key and place."""
    key, firsts = None, {}
    for b in batches:
        k1, k2, ids, th, number, chunk = (b.column(c).to_pylist() for c in ("k1", "k2", "id", "th", "number", "bytes"))
        keep = []
        for i in range(b.num_rows):
            if chunk[i] is None:
                keep.append(i)
                continue
            if (k1[i], k2[i]) != key:
                key, firsts = (k1[i], k2[i]), {}
            place = (ids[i], th[i], number[i])
            if firsts.setdefault(chunk[i], place) != place:
                keep.append(i)
        yield b.select(["id", "th", "number"]).take(pa.array(keep, pa.int64()))


_PAIR = "k1 long, k2 long, id long, th long, number int"


def _pair_rows(batches):
    """Digests and places of two lines in a row; of those a task has seen already, only the place, under a key of its own."""
    seen: dict[bytes, tuple] = {}
    for whole in batches:
        for b in pieces(whole, "text"):
            buf, off = closed(b.column("text"))
            ids, th = b.column("id").to_pylist(), b.column("th").to_pylist()
            end = np.flatnonzero(buf == 10)
            doc = np.searchsorted(off, end, side="right") - 1
            start = np.concatenate([[0], end[:-1] + 1])[: len(end)]
            line = np.arange(len(doc)) - np.searchsorted(doc, doc)
            pair = np.flatnonzero(doc[1:] == doc[:-1])
            raw, keys, places = buf.tobytes(), [], []
            for a, z, d, n in zip(start[pair].tolist(), end[pair + 1].tolist(), doc[pair].tolist(), line[pair].tolist(), strict=True):
                key, place = hashlib.blake2b(raw[a:z], digest_size=16).digest(), (ids[d], th[d], n)
                if seen.setdefault(key, place) < place:  # an earlier one of this task will stand for it
                    key = b"".join(x.to_bytes(8, "little", signed=True) for x in (ids[d], th[d])) + b"%d" % n
                    key, place = hashlib.blake2b(key, digest_size=16, person=b"place").digest(), (ids[d], th[d], -1 - n)
                else:
                    seen[key] = place
                keys.append(key)
                places.append(place)
            if len(seen) > LOCAL_PAIRS:
                seen.clear()
            k = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            i, t, n = (list(x) for x in zip(*places, strict=True)) if places else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy()), pa.array(i, pa.int64()), pa.array(t, pa.int64()), pa.array(n, pa.int32())], ["k1", "k2", "id", "th", "number"])


def _later_pairs(batches):
    """The places of all pairs of lines but the first of each digest, numbered -1 and down; rows come sorted by key and place."""
    first = np.zeros((0, 5), np.int64)  # key and place of the last key's first row
    for b in batches:
        if not b.num_rows:
            continue
        rows = np.concatenate([first, np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("k1", "k2", "id", "th", "number")], axis=1)])
        new = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
        head = rows[np.flatnonzero(new)[np.cumsum(new) - 1]]
        # rows that repeat id and text are one document
        again = (rows[:, 2:] != head[:, 2:]).any(axis=1)[len(first) :]
        ids, th, n = rows[len(first) :, 2:].T
        first = head[-1:]
        at = np.flatnonzero(again | (n < 0))
        number = np.where(n < 0, n, -1 - n)[at].astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(th[at]), pa.array(number)], ["id", "th", "number"])


COUNTS = ("n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines")


def dedupe(docs: DataFrame, whole_runs: bool = False) -> DataFrame:
    """``docs`` with ``text`` reduced, and ``n_lines``, ``n_chunks``, ``n_removed_chunks``, ``n_removed_lines`` (which replace columns of these names)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.drop(*COUNTS)
    # the row is nested, so that its columns may have any names
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"), F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = keyed.select("id", "th", "text").mapInArrow(_chunk_rows, _ROW)
    gone = rows.repartition(n, "k1", "k2").sortWithinPartitions("k1", "k2", "id", "th", "number").mapInArrow(_later, "id long, th long, number int")
    if whole_runs:
        pairs = keyed.select("id", "th", "text").mapInArrow(_pair_rows, _PAIR).repartition(n, "k1", "k2")
        gone = gone.union(pairs.sortWithinPartitions("k1", "k2", "id", "th", "number").mapInArrow(_later_pairs, "id long, th long, number int"))
    gone = gone.groupBy("id", "th").agg(F.collect_set("number").alias("gone"))
    own = docs.columns
    both = keyed.join(gone, ["id", "th"], "left").select("text", "row", "gone")

    def run(batches):
        for whole in batches:
            for b in pieces(whole, "text"):
                buf, off = closed(b.column("text"))
                doc, _, lines, *_ = chunks(buf, off)
                raw = buf.tobytes()
                begin = np.searchsorted(doc, np.arange(b.num_rows + 1))
                texts, table_ = [], []
                for i, gone_ in enumerate(b.column("gone").to_pylist()):
                    s = slice(begin[i], begin[i + 1])
                    out = {k for k in gone_ or () if k >= 0}
                    size = lines[s]
                    total = int(size.sum())
                    stays = np.repeat([k not in out for k in range(len(size))], size)
                    for k in gone_ or ():
                        if k < 0:
                            stays[-1 - k : 1 - k] = False
                    text = raw[off[i] : off[i + 1] - 1]
                    if not stays.all():
                        text = b"\n".join(x for x, y in zip(text.split(b"\n"), stays.tolist(), strict=True) if y)
                    kept = np.add.reduceat(stays.astype(np.int64), np.cumsum(size) - size)
                    texts.append(text.decode())
                    table_.append((total, len(size), int((kept == 0).sum()), total - int(stays.sum())))
                cols = [pa.array(texts, b.schema.field("text").type) if c == "text" else x for c, x in zip(own, b.column("row").flatten(), strict=True)]
                cols += [pa.array([r[k] for r in table_], pa.int64()) for k in range(4)]
                yield pa.RecordBatch.from_arrays(cols, [*own, *COUNTS])

    schema = docs.withColumn("text", text).select(*own, *[F.lit(0).cast("long").alias(c) for c in COUNTS]).schema
    return both.mapInArrow(run, schema)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedupe(table(spark, sf_dir, "documents").select("doc_id", "text"), whole_runs=True)
    return out.select("doc_id", "n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines", F.sha2("text", 256).alias("kept_sha256"))
