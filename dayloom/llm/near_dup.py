"""Near-duplicate documents by HyperMinHash, with every link confirmed on full shingle sets.

A document's set holds the hashes of its different 5-word shingles. The top bits of a hash choose one of
``BUCKETS`` buckets; the smallest hash of a bucket is kept as its count of leading zeros and ten mantissa
bits (HyperMinHash), 2 bytes a bucket. Empty buckets borrow the register of another by a fixed probing order,
so that small sets can be banded too. Documents that agree on all registers of a band are candidates; the
Jaccard similarity estimated from the registers, less the agreements that chance collisions of the compressed
registers make, drops hopeless pairs; the rest is verified on the full sets.

Documents with equal sets form a class, and only its smallest id goes on. In a band's bucket each
member is first paired with one centre only, and in each of a few rounds a document verifies the most similar
of its centres that is not in its component yet. Then only buckets that still hold members of
different components are compared further, in blocks within a task: the pairs between components that the
estimate leaves are verified one by one where they are few; where they are many, the block's full sets are
brought together and only links that join components leave the task. So the pairs that are written or
moved grow with a group's size, not with its square, and no link that joins components is left out.

Null text, and text without words: an empty set, linked with nothing. Fewer than five words: one shingle
of all of them. Rows that repeat a ``doc_id`` are one document: their links unite. Rows with a null ``doc_id`` are documents
of their own; one is kept if its component has no id, and then ``component_id`` is null. Extra columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayloom.llm.common import SHINGLE_C, discard, flat, frugal, join_on, mix, pieces, release, sifted, signed, stash, table, word_hashes

WORDS, BUCKETS, BAND_ROWS = 5, 128, 4
#: Similarity in hundredths.
SIMILARITY = 75
#: Bits of a hash below the bucket's, and mantissa bits of a register.
REST_BITS, MANTISSA_BITS = 57, 10
#: Pairs whose estimate is this many standard errors below the threshold are dropped.
SIGMAS = 5.0
#: Members of a bucket that are compared with each other in one task; rows and pairs that a task works on at once.
BLOCK, GATHER, PAIRS = 256, 4096, 1 << 18
#: Rounds in which each document verifies one more of its centres.
ROUNDS = 2
#: Hopeful pairs a member up to which a block's pairs are verified one by one.
DENSE = 4

_rng = np.random.Generator(np.random.PCG64(11))
PROBES = np.argsort(_rng.random((BUCKETS, BUCKETS)), axis=1)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted different shingle hashes of each text."""
    buf, off = flat(texts)
    words, first = word_hashes(buf, off)
    n = np.diff(first)
    if not len(words):
        return [np.zeros(0, np.uint64)] * len(texts)
    padded = np.concatenate([words, np.zeros(WORDS, np.uint64)])
    full = np.zeros(len(words), np.uint64)
    for k in range(WORDS):
        full += padded[k : k + len(words)] * SHINGLE_C[k]
    full = mix(full)
    out = []
    for i, (a, m) in enumerate(zip(first[:-1].tolist(), n.tolist(), strict=True)):
        if m >= WORDS:
            out.append(np.unique(full[a : a + m - WORDS + 1]))
        elif m:
            out.append(mix((words[a : a + m] * SHINGLE_C[:m]).sum(keepdims=True) + SHINGLE_C[8 + m : 9 + m]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(shingles: np.ndarray) -> np.ndarray:
    """The HyperMinHash of a set: 0 for an empty bucket, else leading zeros (plus one) and mantissa."""
    out = np.zeros(BUCKETS, np.uint16)
    bucket = (shingles >> np.uint64(REST_BITS)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))  # sorted, so a bucket's first is its smallest
    rest = (shingles[first] & np.uint64((1 << REST_BITS) - 1)).astype(np.float64) + 0.5
    bits = rest.view(np.uint64)
    zeros = REST_BITS - ((bits >> np.uint64(52)).astype(np.int64) - 1023)
    mantissa = ((bits >> np.uint64(52 - MANTISSA_BITS)) & np.uint64((1 << MANTISSA_BITS) - 1)).astype(np.int64)
    out[bucket[first]] = (np.clip(zeros, 1, 63) << MANTISSA_BITS) | mantissa
    return out


def densified(reg: np.ndarray) -> np.ndarray:
    empty = np.flatnonzero(reg == 0)
    if len(empty) and len(empty) < BUCKETS:
        order = PROBES[empty]
        reg = reg.copy()
        reg[empty] = reg[order[np.arange(len(empty)), (reg[order] > 0).argmax(axis=1)]]
    return reg


@functools.lru_cache(4096)
def chance_collisions(n: float, m: float) -> float:
    """Expected number of buckets in which two disjoint sets of n and m hashes get equal registers."""
    total, step = 0.0, 1 << MANTISSA_BITS
    for z in range(1, 40):
        lo = 2.0 ** -z
        width = lo / step
        for part in (0.25, 0.75):  # two points a level; the density is smooth within it
            x = lo * (1 + part)
            pn, pm = (math.exp(-k / BUCKETS * x) * (1 - math.exp(-k / BUCKETS * width)) for k in (n, m))
            total += step / 2 * pn * pm
    return BUCKETS * total


def estimates(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard similarity by the registers, corrected for chance collisions, and the buckets it rests on."""
    agree = ((a == b) & (a > 0)).sum(axis=1)
    used = ((a > 0) | (b > 0)).sum(axis=1)
    size = np.exp2(np.round(np.log2(np.maximum(1, np.minimum(na, nb)))))
    by_size = {s: chance_collisions(s, s) for s in np.unique(size)}
    chance = np.array([by_size[s] for s in size.tolist()])
    return (agree - chance) / np.maximum(1.0, used - chance), used


def hopeful(a, b, na, nb, similarity: int = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that may reach the similarity, by their sizes (exact) and by the estimate with a wide margin; and the estimate."""
    est, used = estimates(a, b, na, nb)
    t = similarity / 100
    sized = 100 * np.minimum(na, nb) >= similarity * np.maximum(na, nb)
    return sized & (est >= t - SIGMAS * np.sqrt(t * (1 - t) / np.maximum(1, used)) - 0.02), est


def _sketch(docs: DataFrame) -> DataFrame:
    """``id``, ``th``, ``n_shingles``, a 128-bit fingerprint of the set, and the registers."""

    def run(batches):
        for whole in batches:
            for b in pieces(whole, "text"):
                sets = shingle_sets(b.column("text"))
                f1 = [int(s.sum(dtype=np.uint64)) for s in sets]
                f2 = [int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), b.column("th"), pa.array([len(s) for s in sets], pa.int64()), pa.array(signed(f1)), pa.array(signed(f2)), pa.array([registers(s).tobytes() for s in sets], pa.binary())],
                    ["id", "th", "n_shingles", "f1", "f2", "sig"],
                )

    return docs.mapInArrow(frugal(run), "id long, th long, n_shingles long, f1 long, f2 long, sig binary")


def _band_keys(parts: np.ndarray) -> np.ndarray:
    """The keys of the bands' buckets, from the bands' registers (four in 64 bits) in their order."""
    return mix(mix(parts) + np.arange(1, parts.shape[-1] + 1, dtype=np.uint64) * SHINGLE_C[20])


def _bands(nodes: DataFrame) -> DataFrame:
    """``band`` (a hash of the band's number and registers) and ``doc_id``."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            regs = np.stack([densified(r) for r in np.frombuffer(flat(b.column("sig"))[0].tobytes(), np.uint16).reshape(-1, BUCKETS)])
            n_bands = BUCKETS // BAND_ROWS
            parts = np.ascontiguousarray(regs).view(np.uint64).reshape(-1, n_bands)
            keys = _band_keys(parts)
            ids = np.repeat(b.column("doc_id").to_numpy(), n_bands)
            yield pa.RecordBatch.from_arrays([pa.array(signed(keys.reshape(-1))), pa.array(ids, pa.int64())], ["band", "doc_id"])

    return nodes.select("doc_id", "sig").mapInArrow(frugal(run), "band long, doc_id long")


def _survivors(pairs: DataFrame, nodes: DataFrame, similarity: int) -> DataFrame:
    """The pairs (``a``, ``b``) whose registers leave hope."""
    side = lambda k: nodes.select(F.col("doc_id").alias(k), F.col("sig").alias(f"sig_{k}"), F.col("n_shingles").alias(f"n_{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches):
        for b in batches:
            if b.num_rows:
                sa, sb = (np.frombuffer(flat(b.column(c))[0].tobytes(), np.uint16).reshape(-1, BUCKETS) for c in ("sig_a", "sig_b"))
                ok, est = hopeful(sa, sb, b.column("n_a").to_numpy(), b.column("n_b").to_numpy(), similarity)
                yield b.select(["a", "b"]).append_column("est", pa.array(est)).filter(pa.array(ok))

    return both.select("a", "b", "sig_a", "sig_b", "n_a", "n_b").mapInArrow(frugal(run), "a long, b long, est double")


def _verified(pairs: DataFrame, texts: DataFrame, similarity: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    both = pairs.join(texts.withColumnsRenamed({"doc_id": "a", "text": "ta"}), "a").join(texts.withColumnsRenamed({"doc_id": "b", "text": "tb"}), "b")

    def run(batches):
        for whole in batches:
            for b in pieces(whole, "tb"):
                keep = []
                last, sa = None, None
                ids = b.column("a").to_pylist()
                ta = b.column("ta")
                for i, sb in enumerate(shingle_sets(b.column("tb"))):
                    if ids[i] != last:
                        last, sa = ids[i], shingle_sets(ta.slice(i, 1))[0]
                    both_in = len(np.intersect1d(sa, sb, assume_unique=True))
                    keep.append(100 * both_in >= similarity * (len(sa) + len(sb) - both_in))
                yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(frugal(run), "a long, b long")


def _settled(cur: DataFrame) -> bool:
    """Whether the edges (from larger to smaller nodes) are stars: one parent a node, and none for a parent."""
    ends = cur.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(cur.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """``node`` and ``root`` (the smallest node it is connected with) of every node of ``edges`` (``a``, ``b``) that isn't a root.

    Alternating large and small stars, until only stars are left; each step is a written table.
    """
    cur = stash(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(most):
        if _settled(cur):
            break
        for large in (True, False):
            sym = cur.union(cur.select("b", "a")) if large else cur
            low = sym.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
            hung = sym.join(low, "a").filter("b > a" if large else "b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            if not large:
                hung = hung.union(low.filter("m < a").select("a", F.col("m").alias("b")))
            nxt = stash(hung.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
            discard(cur)
            cur = nxt
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _sides(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """``pairs`` (``a``, ``b``) of different components, with ``root_a`` and ``root_b``."""
    side = lambda k: labels.withColumnsRenamed({"doc_id": k, "root": f"root_{k}"})
    return pairs.join(side("a"), "a").join(side("b"), "b").filter("root_a <> root_b")


def _hung(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` with the components joined that ``edges`` (of roots) connect; a frequent root is left to AQE's skew join."""
    return labels.join(components(edges).withColumnsRenamed({"root": "low", "node": "root"}), "root", "left").withColumn("root", F.coalesce("low", "root")).drop("low")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after ``links``: only the graph of the components so far is walked."""
    return stash(_hung(labels, _sides(links, labels).select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))).select("doc_id", "root"), "roots")


def _blocks(members: DataFrame) -> DataFrame:
    """Members of buckets with several components, once for every pair of blocks of their bucket."""
    mixed = members.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).filter("lo <> hi")
    m = members.select("band", "doc_id", "root").join(mixed.select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "band")
    m = m.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return m.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc_id", "root")


def _rest_of(key: tuple, x: int, ids, own, root) -> np.ndarray:
    """The members that a block pair compares with member x: of another component, each pair once."""
    y = np.flatnonzero((own == key[2]) & (root != root[x]))
    return y[ids[y] > ids[x]] if key[1] == key[2] else y


def _pairs_of(begin: int, end: int, own: np.ndarray, i: int, j: int):
    """Row numbers of the pairs that a block pair compares, a bounded number at a time."""
    if i == j:
        x = np.arange(begin, end)
        step = max(1, PAIRS // len(x))
        for at in range(0, len(x), step):
            some = x[at : at + step]
            left, right = np.repeat(some, end - begin), np.tile(x, len(some))
            yield left[right > left], right[right > left]
    else:
        left, right = begin + np.flatnonzero(own[begin:end] == i), begin + np.flatnonzero(own[begin:end] == j)
        step = max(1, PAIRS // max(1, len(right)))
        for at in range(0, len(left), step):
            some = left[at : at + step]
            yield np.repeat(some, len(right)), np.tile(right, len(some))


def _compared(t: pa.Table, similarity: int) -> pa.RecordBatch:
    """The hopeful pairs of some whole block pairs, all worked on together."""
    ids, root, n, own, band, i, j = (t.column(c).to_numpy() for c in ("doc_id", "root", "n_shingles", "own", "band", "i", "j"))
    regs = np.frombuffer(flat(t.column("sig"))[0].tobytes(), np.uint16).reshape(-1, BUCKETS)
    full = regs.copy()
    for k in np.flatnonzero((regs == 0).any(axis=1)):
        full[k] = densified(regs[k])
    shared = full.view(np.uint64)
    keys = signed(_band_keys(shared))
    begin = np.flatnonzero((np.diff(band, prepend=~band[:1]) != 0) | (np.diff(i, prepend=-1) != 0) | (np.diff(j, prepend=-1) != 0))
    ends = np.append(begin[1:], len(band))
    group = np.repeat(np.arange(len(begin)), ends - begin)
    xs, ys, held, found = [], [], 0, []

    def flush():
        x, y = np.concatenate(xs), np.concatenate(ys)
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
        for at in range(0, len(x), 1 << 16):
            u, v = x[at : at + (1 << 16)], y[at : at + (1 << 16)]
            # a pair is looked at in its first common band only
            first = (shared[u] == shared[v]).argmax(axis=1)
            here = keys[u, first] == band[u]
            u, v = u[here], v[here]
            ok = hopeful(regs[u], regs[v], n[u], n[v], similarity)[0]
            found.append((u[ok], v[ok]))

    for g0, g1 in zip(begin.tolist(), ends.tolist(), strict=True):
        for x, y in _pairs_of(g0, g1, own, int(i[g0]), int(j[g0])):
            xs.append(x)
            ys.append(y)
            held += len(x)
            if held >= PAIRS:
                flush()
                xs, ys, held = [], [], 0
    if xs:
        flush()
    x, y = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    many = np.bincount(group[x], minlength=len(begin))
    dense = (many > DENSE * (ends - begin))[group[x]]
    members = np.unique(np.concatenate([x[dense], y[dense]]))
    x, y = x[~dense], y[~dense]
    rows = np.concatenate([x, members])
    b = pa.array(np.concatenate([ids[y], np.zeros(len(members), np.int64)]), pa.int64(), mask=np.arange(len(rows)) >= len(x))
    return pa.RecordBatch.from_arrays([pa.array(band[rows]), pa.array(i[rows]), pa.array(j[rows]), pa.array(ids[rows]), b], ["band", "i", "j", "a", "b"])


def _across(blocks: DataFrame, nodes: DataFrame, similarity: int) -> DataFrame:
    """Hopeful pairs (``a``, ``b``) of different components in a block pair.

    A block pair with more than ``DENSE`` of them a member gives instead, with ``b`` null, the members that
    have any: their sets are brought together. A task streams its block pairs, and works on some thousand rows at once.
    """

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows >= GATHER:
                k = [held.column(c).to_numpy() for c in ("band", "i", "j")]
                cut = int(np.flatnonzero(np.any([c != c[-1] for c in k], axis=0)).max(initial=-1)) + 1
                if cut:
                    yield _compared(held.slice(0, cut), similarity)
                    held = held.slice(cut)
        if held is not None and held.num_rows:
            yield _compared(held, similarity)

    m = blocks.join(nodes.select("doc_id", "sig", "n_shingles"), "doc_id").select("band", "i", "j", "own", "doc_id", "root", "sig", "n_shingles")
    parts = int(m.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a number of partitions that stays: the work grows with pairs, not with bytes
    dealt = m.repartition(parts, "band", "i", "j").sortWithinPartitions("band", "i", "j")
    return dealt.mapInArrow(frugal(run), "band long, i int, j int, a long, b long")


def _dense_links(dense: DataFrame, blocks: DataFrame, texts: DataFrame, similarity: int) -> DataFrame:
    """Links between components in dense block pairs, from full sets, as many as it takes to join the components."""

    def sets(batches):
        for whole in batches:
            for b in pieces(whole, "text"):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x.tobytes() for x in shingle_sets(b.column("text"))], pa.binary())], ["doc_id", "shingles"])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, root, own = (pdf[c].to_numpy() for c in ("doc_id", "root", "own"))
        each = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
        size = np.array([len(x) for x in each])
        names, code = np.unique(np.concatenate(each), return_inverse=True)
        begin = np.cumsum(size) - size
        mark, group = np.zeros(len(names), np.int64), root.copy()
        a_out, b_out = [], []
        for x in np.flatnonzero(own == key[1]):
            mark[code[begin[x] : begin[x] + size[x]]] = 1
            both = np.add.reduceat(mark[code], begin)
            mark[code[begin[x] : begin[x] + size[x]]] = 0
            y = _rest_of(key, x, ids, own, root)
            y = y[100 * both[y] >= similarity * (size[x] + size[y] - both[y])]
            for k in y:
                if group[k] != group[x]:
                    a_out.append(ids[x])
                    b_out.append(ids[k])
                    group[group == group[k]] = group[x]
        return pd.DataFrame({"a": np.array(a_out, np.int64), "b": np.array(b_out, np.int64)})

    own = blocks.join(dense.select("band", "i", "j", F.col("a").alias("doc_id")), ["band", "i", "j", "doc_id"])
    some = texts.join(own.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "text")
    m = own.join(some.mapInArrow(frugal(sets), "doc_id long, shingles binary"), "doc_id")
    return m.groupBy("band", "i", "j").applyInPandas(run, "a long, b long")


def _placed(docs: DataFrame, similarity: int) -> DataFrame:
    """``node``, ``id``, ``th`` (the text's hash), ``n_shingles`` and ``root`` (a node of the row's component) of each row."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    # a node a row: the number is written with the row, so it stays
    rows = stash(_sketch(docs).withColumn("doc_id", F.monotonically_increasing_id()), "sketches")
    classes = stash(rows.filter("n_shingles > 0").groupBy("f1", "f2", "n_shingles").agg(F.min(F.struct("doc_id", "id", "th", "sig")).alias("x")).select("f1", "f2", "n_shingles", "x.*"), "classes")
    nodes = classes.select("doc_id", "n_shingles", "sig")
    bands = stash(_bands(nodes), "bands")
    sizes = bands.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    shared = stash(bands.join(sizes, "band"), "shared")
    discard(bands)
    # only texts that share a bucket may be read again
    named = stash(classes.join(shared.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "id", "th"), "named")
    texts = stash(join_on(sifted(docs, named, ["id", "th"]), named, ["id", "th"]).dropDuplicates(["doc_id"]).select("doc_id", "text"), "texts")
    release(spark)
    # a bucket's centre is the member with most company in all its buckets
    company = shared.groupBy("doc_id").agg(F.sum("n").alias("company"))
    centres = shared.join(company, "doc_id").groupBy("band").agg(F.max(F.struct("company", -F.col("doc_id"))).alias("x")).select("band", (-F.col("x")["col2"]).alias("a"))
    stars = shared.join(centres, "band").filter("a <> doc_id").select("a", F.col("doc_id").alias("b")).distinct()
    hope = stash(_survivors(stars, nodes, similarity), "hope")
    release(spark)
    labels = nodes.select("doc_id", F.col("doc_id").alias("root"))
    for _ in range(ROUNDS):
        # of its centres in other components each document verifies the most similar one
        one = stash(_sides(hope, labels).groupBy("b").agg(F.max_by("a", F.struct("est", -F.col("a"))).alias("a")).select("a", "b"), "one")
        if one.isEmpty():
            break
        labels = _merged(labels, stash(_verified(one, texts, similarity), "links"))
        hope = hope.join(one, ["a", "b"], "left_anti")
        release(spark)
    blocks = stash(_blocks(shared.join(labels, "doc_id")), "blocks")
    found = stash(_across(blocks, nodes, similarity), "across")
    release(spark)
    links = _verified(found.filter("b is not null").select("a", "b"), texts, similarity)
    dense = found.filter("b is null")
    if not dense.isEmpty():
        links = links.union(_dense_links(dense, blocks, texts, similarity))
    labels = _merged(labels, stash(links, "links"))
    release(spark)
    # equal sets hang on their class; a row without shingles stays alone
    rooted = classes.select("f1", "f2", "n_shingles", "doc_id").join(labels, "doc_id").drop("doc_id")
    placed = rows.join(rooted, ["f1", "f2", "n_shingles"], "left")
    return stash(placed.select(F.col("doc_id").alias("node"), "id", "th", "n_shingles", F.coalesce("root", "doc_id").alias("root")), "placed")


def near_duplicates(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``."""
    rows = _placed(docs, similarity)
    # rows that repeat an id are one document
    first = rows.filter("id is not null").groupBy("id").agg(F.min("root").alias("b"), F.max("root").alias("last")).filter("b <> last").drop("last")
    again = rows.join(first, "id").select(F.col("root").alias("a"), "b")
    placed = stash(_hung(rows, again), "joined")
    least = placed.groupBy("root").agg(F.min("id").alias("component_id"))
    out = placed.join(least, "root")
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def kept_documents(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """``doc_id`` and ``text_hash`` of one text of each group: of the smallest id, a null one last.

    Here different texts under one id are documents of their own, and so are those without an id.
    """
    order = F.struct(F.col("id").isNull().alias("last"), "id", "node", "th")
    best = _placed(docs, similarity).groupBy("root").agg(F.min(order).alias("x"))
    return best.select(F.col("x.id").alias("doc_id"), F.col("x.th").alias("text_hash")).distinct()


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
