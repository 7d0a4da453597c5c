"""Secret scans: fixed patterns, and a linear-chain conditional random field that tags tokens as secret begin, inside or outside.

Patterns (see ``base``) give base spans. The field learns from them what a secret looks like and where it stands, and adds spans of kind ``crf`` that no
pattern has: secrets of other forms, or after other words.

Tokens are runs of ASCII letters, digits, ``_`` and characters beyond ASCII, and single other characters. Features of a token: its shape (length, kinds of
characters, whether all are hexadecimal, how often letters and digits change), which character it is if it isn't a word, the three tokens before
and the one after (of the ``VOCABULARY`` most frequent ones near secrets), whether it touches its neighbours, and two of the file: the shares of digits and of
assignment signs. Inside follows begin or inside only, and no secret holds white space.

Fitting. At most ``WINDOWS`` windows of ``AROUND`` tokens on either side of a base value, of different texts with the smallest hashes, and as many of
texts without base values, half of them around the longest token. A window with values is learned a second time with values of another form in their place (seeded
random letters and digits, joined or not), as corpora often hold secrets of one form only; and both once more without their neighbouring words, so that shape
alone must do, too. A corpus without base values gives no field, and no added spans. The likelihood (forward-backward) is climbed on the driver: the sample is bounded.

Decoding is Viterbi's, exact: a chunk (no white space) whose tokens all lose more by being in a secret than any transitions can give is outside on the best
path, so the search runs over the rest only, all of them a step at a time.

Null texts are empty. Rows are tagged one by one: they may repeat, and ids may be null. Extra columns are not read. A text is held whole in its task. Empty
tables give empty results.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayloom.llm.common import LOWER, Rolling, SPACE_BYTES, flat, mix, pieces, signed, spans, stash, table

#: Kinds in the order of the results.
KINDS = ["assign", "access", "hex", "crf"]
_ASSIGN = re.compile(rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_NEEDS = (b"passw", b"secret", b"token", b"key")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
WINDOWS, AROUND, VOCABULARY = 400, 24, 255
#: Bytes of text that a task works on at a time, unless one text is longer.
PIECE = 1 << 20


def _class(*ranges: str) -> np.ndarray:
    out = np.zeros(256, bool)
    for r in ranges:
        out[ord(r[0]) : ord(r[-1]) + 1] = True
    return out


_SMALL, _BIG, _DIGIT, _HEX = _class("a-z"), _class("A-Z"), _class("0-9"), _class("a-f", "0-9")
_WORD = _SMALL | _BIG | _DIGIT | _class("_")
_WORD[128:] = True
_GAP = np.zeros(256, bool)
_GAP[list(SPACE_BYTES)] = True


# --- base spans -----------------------------------------------------------------------------


def base(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Base spans of a batch: (kind, start, end) in bytes of the buffer, and the values' (start, end) alone."""
    start, end = spans(_HEX[buf], off)
    long = end - start >= LEAST_HEX
    found = [np.stack([np.full(long.sum(), 2), start[long], end[long]], 1)]
    values = [found[0][:, 1:]]
    raw, low = buf.tobytes(), LOWER[buf].tobytes()
    for i, j in zip(off.tolist(), off[1:].tolist(), strict=False):
        rows = []
        if any(low.find(x, i, j) >= 0 for x in _NEEDS):
            for m in _ASSIGN.finditer(raw, i, j):
                if m.end() - m.start(1) >= LEAST_ASSIGN:
                    rows.append((0, m.start(), m.end(), m.start(1)))
        if raw.find(b"AKIA", i, j) >= 0:
            rows += [(1, m.start(), m.end(), m.start()) for m in _ACCESS.finditer(raw, i, j) if m.end() - m.start() >= LEAST_ACCESS]
        if rows:
            rows = np.array(rows)
            found.append(rows[:, :3])
            values.append(rows[:, [3, 2]])
    return np.concatenate(found), np.concatenate(values)


def _united(values: np.ndarray) -> np.ndarray:
    """Overlapping spans made one, in order."""
    if not len(values):
        return values.reshape(0, 2)
    values = values[np.lexsort((values[:, 1], values[:, 0]))]
    far = np.maximum.accumulate(values[:, 1])
    new = np.concatenate([[True], values[1:, 0] >= far[:-1]])
    return np.stack([values[new, 0], np.maximum.reduceat(values[:, 1], np.flatnonzero(new))], 1)


# --- tokens and features --------------------------------------------------------------------


@dataclass
class Tokens:
    start: np.ndarray
    end: np.ndarray
    #: Whether a token touches the one before it, in the same text.
    glued: np.ndarray
    #: Lower-cased tokens as hashes, and the place of each text's first token.
    word: np.ndarray
    first: np.ndarray


def tokens(buf: np.ndarray, off: np.ndarray) -> Tokens:
    word = _WORD[buf]
    start, end = spans(word, off)
    single = np.flatnonzero(~word & ~_GAP[buf])
    start = np.concatenate([start, single])
    end = np.concatenate([end, single + 1])
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    first = np.searchsorted(start, off)
    glued = np.zeros(len(start), bool)
    glued[1:] = start[1:] == end[:-1]
    glued[first[:-1][first[:-1] < len(start)]] = False
    return Tokens(start, end, glued, mix(Rolling(LOWER[buf])(start, end)) if len(start) else np.zeros(0, np.uint64), first)


#: Sizes of the feature tables: length, kinds of characters, hexadecimal by length, changes, other character, three before, one after, touching, file.
_SIZES = (9, 16, 18, 5, 129, VOCABULARY + 1, VOCABULARY + 1, VOCABULARY + 1, VOCABULARY + 1, 4, 16)
_AT = np.concatenate([[0], np.cumsum(_SIZES)])
_NEAR = range(5, 9)
_LENGTHS = np.array([2, 3, 5, 7, 10, 16, 24, 40])
_SHARES = (np.array([0.01, 0.05, 0.2]), np.array([0.0005, 0.005, 0.02]))


def file_bucket(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The file features of each text: 4 * share of digits + share of assignment signs."""
    size = np.maximum(np.diff(off), 1)
    out = []
    for hit, steps in zip((_DIGIT[buf], (buf == ord("=")) | (buf == ord(":"))), _SHARES, strict=True):
        sums = np.concatenate([[0], np.cumsum(hit)])
        out.append(np.searchsorted(steps, (sums[off[1:]] - sums[off[:-1]]) / size, side="right"))
    return 4 * out[0] + out[1]


def features(buf: np.ndarray, t: Tokens, bucket: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """(tables, tokens): places in the joined feature tables. ``bucket``: of each text; ``vocabulary``: sorted hashes."""
    n = len(t.start)
    out = np.zeros((len(_SIZES), n), np.int32)
    if not n:
        return out
    size = t.end - t.start

    def count(hit: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(hit, dtype=np.int32)])
        return sums[t.end] - sums[t.start]

    other = ~_WORD[buf[t.start]]
    digits, small, big, hexed = (count(c[buf]) for c in (_DIGIT, _SMALL, _BIG, _HEX))
    digit = _DIGIT[buf]
    change = np.concatenate([[False], digit[1:] != digit[:-1]])
    changes = count(change) - change[t.start]
    length = np.searchsorted(_LENGTHS, size, side="right")
    out[0] = np.where(other, 0, length)
    out[1] = (digits > 0) + 2 * (small > 0) + 4 * (big > 0) + 8 * (digits + small + big < size)
    out[2] = np.where(hexed == size, 9, 0) + np.where(other, 0, length)
    out[3] = np.where(other, 0, 1 + np.searchsorted([1, 3, 6], changes, side="right"))
    out[4] = np.where(other, buf[t.start], 128)
    at = np.searchsorted(vocabulary, t.word)
    known = np.where(vocabulary[np.minimum(at, len(vocabulary) - 1)] == t.word, at + 1, 0) if len(vocabulary) else np.zeros(n, np.int64)
    doc = np.repeat(np.arange(len(t.first) - 1), np.diff(t.first))
    for k in (1, 2, 3):
        out[4 + k, k:] = np.where(doc[k:] == doc[:-k], known[:-k], 0)
    out[8, :-1] = np.where(doc[1:] == doc[:-1], known[1:], 0)
    out[9] = t.glued
    out[9, :-1] += 2 * t.glued[1:]
    out[10] = bucket[doc]
    return out + _AT[:-1, None].astype(np.int32)


# --- the field ------------------------------------------------------------------------------


@dataclass
class Field:
    """Weights of begin and inside (outside has none), transitions [from, to] of outside, begin and inside, and the vocabulary."""

    weights: np.ndarray
    moves: np.ndarray
    vocabulary: np.ndarray

    def scores(self, feature: np.ndarray, glued: np.ndarray) -> np.ndarray:
        """(tokens, 2): of begin and inside."""
        out = np.zeros((feature.shape[1], 2))
        for row in feature:
            out += self.weights[row]
        out[~glued, 1] = -np.inf
        return out


def _likelihood(weights, moves, feature, glued, gold, mask):
    """Log-likelihood of padded windows, and its gradients. feature: (tables, windows, length); gold: labels 0 to 2."""
    n, length = gold.shape
    score = weights[feature].sum(axis=0)
    e = np.ones((n, length, 3))
    e[..., 1:] = np.where(mask[..., None], np.exp(np.clip(score, -30, 30)), 0)
    e[..., 2] *= glued
    a = np.exp(moves)
    a[0, 2] = 0
    ahead, scale = np.zeros((n, length, 3)), np.zeros((n, length))
    now = np.tile([1.0, 0, 0], (n, 1))
    for k in range(length):
        now = (now @ a) * e[:, k]
        scale[:, k] = now.sum(axis=1)
        now = now / scale[:, k, None]
        ahead[:, k] = now
    back, pairs, held = np.ones((n, 3)), np.zeros((3, 3)), np.zeros((n, length, 3))
    for k in range(length - 1, -1, -1):
        held[:, k] = ahead[:, k] * back
        into = e[:, k] * back / scale[:, k, None]
        before = ahead[:, k - 1] if k else np.tile([1.0, 0, 0], (n, 1))
        pairs += (before.T @ into) * a
        back = into @ a.T
    true = np.eye(3)[gold]
    prev = np.concatenate([np.zeros((n, 1), np.int64), gold[:, :-1]], axis=1)
    gained = np.zeros((3, 3))
    np.add.at(gained, (prev.ravel(), gold.ravel()), 1)
    value = (np.clip(score, -30, 30) * true[..., 1:] * mask[..., None]).sum() + (gained * np.where(gained > 0, moves, 0)).sum() - np.log(scale).sum()
    off = ((true - held)[..., 1:] * mask[..., None]).reshape(-1, 2)
    grad = np.zeros_like(weights)
    for row in feature.reshape(len(feature), -1):
        for c in (0, 1):
            grad[:, c] += np.bincount(row, off[:, c], len(weights))
    return value, grad, gained - pairs


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Alphabets of the values put in place of others.
_FORMS = [_LETTERS + "0123456789", _LETTERS.upper() + "0123456789", *[_LETTERS + _LETTERS.upper() + "0123456789"] * 4]


def _disguised(window: bytes, bucket: int, values: np.ndarray, rng: np.random.Generator) -> tuple[bytes, int, np.ndarray]:
    """The window with other values: of 12 to 56 letters and digits, half of them in parts joined by one of ``-_./+``."""
    out, spans_, at = b"", [], 0
    for i, j in values.tolist():
        size, form = int(rng.integers(12, 57)), _FORMS[rng.integers(len(_FORMS))]
        value = "".join(form[k] for k in rng.integers(len(form), size=size))
        if rng.random() < 0.5:
            part = int(rng.integers(4, 20))
            value = "-_./+"[rng.integers(5)].join(value[k : k + part] for k in range(0, size, part))
        out += window[at:i]
        spans_.append((len(out), len(out) + len(value)))
        out, at = out + value.encode(), j
    return out + window[at:], bucket, np.array(spans_, np.int64).reshape(-1, 2)


def fit(windows: list[tuple[bytes, int, np.ndarray]], steps: int = 80, rate: float = 0.25, ridge: float = 0.02) -> Field | None:
    """A field from windows (text, file bucket, value spans), by Adam on all of them; None where no window holds a value."""
    if not any(len(v) for _, _, v in windows):
        return None
    rng = np.random.Generator(np.random.PCG64(17))
    windows = windows + [_disguised(*w, rng) for w in windows if len(w[2])]
    off = np.concatenate([[0], np.cumsum([len(w) for w, _, _ in windows])]).astype(np.int64)
    buf = np.frombuffer(b"".join(w for w, _, _ in windows), np.uint8)
    t = tokens(buf, off)
    gold = np.zeros(len(t.start), np.int64)
    for (_, _, values), at in zip(windows, off.tolist(), strict=False):
        for i, j in (values + at).tolist():
            low, high = np.searchsorted(t.start, i), np.searchsorted(t.start, j)
            gold[low:high] = 2
            gold[low : low + 1] = 1
    near = np.zeros(len(gold), bool)
    begin = np.flatnonzero(gold == 1)
    for k in (-3, -2, -1):
        near[np.maximum(begin + k, 0)] = True
    near[np.minimum(begin + 1, len(gold) - 1)] = True
    hashes, n = np.unique(t.word[near & (gold == 0)], return_counts=True)
    vocabulary = np.sort(hashes[np.lexsort((hashes, -n))][:VOCABULARY])
    feature = features(buf, t, np.array([b for _, b, _ in windows]), vocabulary)
    length = int(np.diff(t.first).max())
    rows, place = np.repeat(np.arange(len(windows)), np.diff(t.first)), np.arange(len(gold)) - np.repeat(t.first[:-1], np.diff(t.first))

    def padded(x, fill):
        out = np.full((len(windows), length), fill, x.dtype)
        out[rows, place] = x
        return out

    wide = np.stack([padded(f, 0) for f in feature])
    labels, glued, mask = padded(gold, 0), padded(t.glued, False), padded(np.ones(len(gold), bool), False)
    bare = wide.copy()
    for k in _NEAR:
        bare[k] = _AT[k]
    some = np.flatnonzero(labels.any(axis=1))
    wide = np.concatenate([wide, bare[:, some]], axis=1)
    labels, glued, mask = (np.concatenate([x, x[some]]) for x in (labels, glued, mask))
    theta = [np.zeros((int(_AT[-1]), 2)), np.zeros((3, 3))]
    first, second = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
    for k in range(1, steps + 1):
        _, *grads = _likelihood(*theta, wide, glued, labels, mask)
        for x, g, m, v in zip(theta, grads, first, second, strict=True):
            g = g - ridge * x
            m[:] = 0.9 * m + 0.1 * g
            v[:] = 0.99 * v + 0.01 * g * g
            x += rate * (1 - k / (steps + 1)) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    theta[1][0, 2] = 0
    return Field(theta[0], theta[1], vocabulary)


def viterbi(score: np.ndarray, glued: np.ndarray, first: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best labels (0 outside, 1 begin, 2 inside) of all tokens; ``first``: each text's first token."""
    n, label = len(score), np.zeros(len(score), np.int8)
    if not n:
        return label
    moves = moves.copy()
    moves[0, 2] = -np.inf
    swing = max(0.0, float(moves[np.isfinite(moves)].max() - min(moves[:, 0].min(), moves[0, :2].min())))
    open_ = score.max(axis=1) + 2 * swing >= 0
    heads = np.flatnonzero(~glued)  # chunks, none of which spans two texts
    chunk = np.logical_or.reduceat(open_, heads)
    if not chunk.any():
        return label
    new = np.concatenate([[True], ~chunk[:-1]]) | np.isin(heads, first)
    begin = heads[chunk & new]
    ends = np.append(heads[1:], n)
    stop = ends[chunk & np.append(new[1:] | ~chunk[1:], True)]
    order = np.argsort(begin - stop, kind="stable")  # the longest first
    begin, size = begin[order], (stop - begin)[order]
    best = np.full((len(begin), 3), -np.inf)
    best[:, 0] = 0
    came = np.zeros((n, 3), np.int8)
    live = np.searchsorted(-size, -np.arange(size[0]), side="left")  # stretches longer than k
    for k in range(size[0]):
        m = live[k]
        at = begin[:m] + k
        paths = best[:m, :, None] + moves
        came[at] = paths.argmax(axis=1)
        top = paths.max(axis=1)
        top[:, 1:] += score[at]
        best[:m] = top
    state = (best + moves[:, 0]).argmax(axis=1).astype(np.int8)
    for k in range(size[0] - 1, -1, -1):
        m = live[k]
        at = begin[:m] + k
        label[at] = state[:m]
        state[:m] = came[at, state[:m]]
    return label


def tagged(buf: np.ndarray, off: np.ndarray, field: Field) -> np.ndarray:
    """The field's secrets, (start, end) in bytes of the buffer."""
    t = tokens(buf, off)
    score = field.scores(features(buf, t, file_bucket(buf, off), field.vocabulary), t.glued)
    label = viterbi(score, t.glued, t.first[:-1], field.moves)
    begin = np.flatnonzero(label == 1)
    last = np.append(label[1:] != 2, True)
    ends = np.flatnonzero((label > 0) & last)
    return np.stack([t.start[begin], t.end[ends]], 1)


# --- Spark ----------------------------------------------------------------------------------


def _window(buf: np.ndarray, t: Tokens, low: int, high: int, centre: int) -> tuple[int, int]:
    """Bytes of the window around a token, within the tokens low to high of a text."""
    i, j = max(low, centre - AROUND), min(high, centre + AROUND + 1)
    return int(t.start[i]), int(t.end[j - 1])


def _sample(batches):
    """Windows of a partition's texts, the ``WINDOWS`` with the smallest hashes of each kind."""
    kept: tuple[dict, dict] = ({}, {})
    for batch in batches:
        for part in pieces(batch, "text", PIECE):
            buf, off = flat(part.column("text"))
            if not len(buf):
                continue
            t, bucket = tokens(buf, off), file_bucket(buf, off)
            values = _united(base(buf, off)[1])
            doc = np.searchsorted(off, values[:, 0], side="right") - 1
            h = mix(Rolling(buf)(off[:-1], off[1:]))
            for d in range(part.num_rows):
                low, high, key = int(t.first[d]), int(t.first[d + 1]), int(h[d])
                mine = values[doc == d] if len(values) else values
                side = kept[0 if len(mine) else 1]
                if low == high or key in side or (len(side) >= WINDOWS and key > max(side)):
                    continue
                if len(mine):
                    i, j = mine[key % len(mine)]
                    centre = int(np.searchsorted(t.start, i))
                    a, b = _window(buf, t, low, high, centre)
                    b = max(b, int(j))
                else:
                    centre = low + (int(np.argmax((t.end - t.start)[low:high])) if key % 2 else key // 2 % (high - low))
                    a, b = _window(buf, t, low, high, centre)
                inside = mine[(mine[:, 0] < b) & (mine[:, 1] > a)]
                inside = np.stack([np.maximum(inside[:, 0], a), np.minimum(inside[:, 1], b)], 1) - a
                side[key] = (buf[a:b].tobytes(), int(bucket[d]), inside.ravel().tolist())
                if len(side) > WINDOWS:
                    del side[max(side)]
    rows = [(bool(k), int(signed(np.array([key], np.uint64))[0]), *x) for k, side in enumerate((kept[0], kept[1])) for key, x in side.items()]
    cols = list(zip(*rows, strict=True)) or [(), (), (), (), ()]
    kinds = (pa.bool_(), pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64()))
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["plain", "hash", "window", "bucket", "values"])


def learn(docs: DataFrame) -> Field | None:
    """The field of a corpus, or None where no text holds a base value."""
    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_sample, "plain boolean, hash long, window binary, bucket int, values array<long>")
    found = stash(found.dropDuplicates(["plain", "hash"]), "windows")
    windows = []
    for plain in (False, True):
        best = found.filter(F.col("plain") == plain).orderBy("hash").limit(WINDOWS).collect()  # WINDOWS rows
        windows += [(bytes(r.window), r.bucket, np.array(r["values"], np.int64).reshape(-1, 2)) for r in best]
    return fit(windows)


def scan(docs: DataFrame, field: Field | None) -> DataFrame:
    """``doc_id`` and ``spans``: kind, start, end (code points, end exclusive) and value, by start, then kind as listed."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                buf, off = flat(part.column("text"))
                found, _ = base(buf, off)
                if field is not None and len(buf):
                    more = tagged(buf, off, field)
                    covered = _united(found[:, 1:])
                    at = np.searchsorted(covered[:, 1], more[:, 0], side="right")  # the first base span that ends later
                    clear = np.append(covered[:, 0], len(buf) + 1)[at] >= more[:, 1]
                    more = more[clear]
                    found = np.concatenate([found, np.column_stack([np.full(len(more), 3), more])])
                found = found[np.lexsort((found[:, 0], found[:, 1]))].astype(np.int64)
                doc = np.searchsorted(off, found[:, 1], side="right") - 1
                chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
                zero = chars[off[doc]]
                values = [buf[i:j].tobytes().decode("utf-8", "replace") for _, i, j in found.tolist()]
                struct = pa.StructArray.from_arrays([pa.array(np.array(KINDS, object)[found[:, 0]], pa.string()), pa.array((chars[found[:, 1]] - zero).astype(np.int32)), pa.array((chars[found[:, 2]] - zero).astype(np.int32)), pa.array(values, pa.string())], ["kind", "start", "end", "value"])
                each = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=part.num_rows))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(each), struct)], ["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int,value:string>>")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, learn(docs))
    named = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda kind: F.filter("spans", lambda x: x["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(named(F.filter("spans", lambda x: x["kind"] != "crf")), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))
