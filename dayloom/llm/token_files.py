"""Token ids in compressed files: canonical length-limited Huffman codes, decoded by table.

``tokenise`` turns texts into ids, ``write_files`` codes them and ``read_files`` gives them back.

File format (a Parquet folder with two tables, so that any store Spark can write to will hold it):

* ``codebook``: ``id``, ``length`` -- the lengths of the canonical code, from the counts of all ids.
  Codes are handed out in the order of (length, id).
* ``blocks``: one independently decodable block per document, in ascending ``doc_id`` order over the
  files: ``doc_id``, ``part`` and ``local_start`` (its place), ``n_tokens``, ``bits`` (the codes, most
  significant bit first, padded to a byte) and ``checkpoints`` (the bit offset of every
  ``CHECKPOINT_EVERY``-th id, so that the parts of a long block decode side by side).

Null or empty text: only the end id. Repeated rows: each is a document of its own; rows of equal
``doc_id`` stand in the order of their coded bytes. Rows whose ``doc_id`` is null come first.
An empty table makes empty files. Other columns are not read.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayloom.llm.common import discard, flat, pieces, release, scratch, stash, table

#: The longest code, in bits; the decoding table has 2**MAX_BITS entries.
MAX_BITS = 20
#: Ids between two checkpoints of a block.
CHECKPOINT_EVERY = 256
#: Words whose ids a worker remembers.
CACHE_WORDS = 300_000

#: White space on which Python and the tokenizer may disagree, and a capital whose lower case depends on its place.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\u0130", "\u03a3")
#: A comma or full stop beside another mark: they are one pre-token.
_RUN = re.compile(r"[.,](?=[^\s\w]|_)|(?<=[^\s\w])[.,]|_[.,]")
#: The same for ASCII: white space, letters and digits, comma and full stop, other marks.
_KIND = bytes(32 if c in b" \t\n\r\x0b\x0c" else 97 if chr(c).isalnum() else 112 if c in b".," else 113 for c in range(128)) + bytes(128)
_tokenizers: dict = {}


def _lone(text: str) -> bool:
    """No comma or full stop stands beside another mark."""
    if not text.isascii():
        return not _RUN.search(text)
    kinds = text.encode().translate(_KIND)
    return b"pp" not in kinds and b"pq" not in kinds and b"qp" not in kinds


# fixed values: the settings of a tokenizer for which the short way of ``_ids_of`` holds
_SETTINGS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None,
}


class _Words(dict):
    """The ids of words, as bytes; up to ``CACHE_WORDS`` stay, which the frequent words reach first."""

    def __init__(self, path: str, code: str):
        from tokenizers import Tokenizer

        self.tok, self.code = Tokenizer.from_file(path), code
        self.tokenize = self.tok.model.tokenize
        settings = json.loads(self.tok.to_str())
        self.short = all(settings.get(k) == v for k, v in _SETTINGS.items())
        self.added = tuple(t.content.lower() for t in self.tok.get_added_tokens_decoder().values())
        # the characters that stand for the bytes of a text in byte-level vocabularies
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.table = {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in set(shown))}

    def ids(self, text: str) -> bytes:
        return array(self.code, self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        if word.isalpha() and max(word) < "\u0250":  # one pre-token, which the library's model takes as bytes
            plain = word if word.isascii() else word.encode().decode("latin-1").translate(self.table)
            got = array(self.code, [t.id for t in self.tokenize(plain)]).tobytes()
        else:
            got = self.ids(word)
        if len(self) < CACHE_WORDS:
            self[word] = got
        return got


def _ids_of(path: str, end_id: int, code: str = "I"):
    """texts -> bytes of their ids, the end id last.

    A pre-token of this tokenizer never crosses white space, nor the place between a letter and a lone
    comma or full stop, so texts are lower-cased and split there, and a worker remembers the ids of words.
    A text in which these steps might not agree with the tokenizer's is encoded as it stands, and so are all texts for
    a tokenizer with other settings.
    """
    if (path, code) not in _tokenizers:
        _tokenizers[path, code] = _Words(path, code)
    words = _tokenizers[path, code]
    end, get = array(code, [end_id]).tobytes(), words.__getitem__

    def one(text: str) -> bytes:
        if not words.short or any(c in text for c in _ODD) or not unicodedata.is_normalized("NFC", text):
            return words.ids(text)
        raw, text = text, text.lower()
        if any(a in text for a in words.added):  # the library looks for added tokens before it lower-cases
            return words.ids(raw)
        return b"".join(map(get, (text.replace(",", " , ").replace(".", " . ") if _lone(text) else text).split()))

    return lambda texts: [one(t) + end for t in texts]


def tokenise(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """``doc_id`` and ``ids`` (binary: little-endian, 2 bytes an id where the vocabulary allows, else 4)."""
    from tokenizers import Tokenizer

    width = "<u2" if max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"

    def run(batches):
        ids_of = _ids_of(tokenizer_path, end_id, "H" if width == "<u2" else "I")
        for b in batches:
            for part in pieces(b, "text", 1 << 22):
                ids = ids_of([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids binary")
    return out.withMetadata("ids", {"width": int(width[2])})


def _width(df: DataFrame) -> str:
    return f"<u{df.schema['ids'].metadata.get('width', 4)}"


def count_ids(tokens: DataFrame) -> dict[int, int]:
    """How often each id occurs; as many rows as the vocabulary has reach the driver."""
    width = _width(tokens)

    def run(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            got = np.bincount(np.frombuffer(flat(b.column("ids"))[0].tobytes(), width))
            if len(got) > len(total):
                got, total = total, got
            total[: len(got)] += got
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    got = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return {r["id"]: r["n"] for r in got}


def code_lengths(counts: dict[int, int], most: int = MAX_BITS) -> dict[int, int]:
    """Optimal code lengths of at most ``most`` bits (package-merge)."""
    ids = sorted(counts, key=lambda i: (counts[i], i))
    n = len(ids)
    if n <= 1:
        return {i: 1 for i in ids}
    if n > 1 << most:
        raise ValueError(f"{n} ids need codes of more than {most} bits")
    weight = np.array([counts[i] for i in ids], np.int64)
    items, leaves = weight, [np.ones(n, bool)]
    for _ in range(most - 1):
        pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
        order = np.argsort(both := np.concatenate([weight, pairs]), kind="stable")
        items = both[order]
        leaves.append(order < n)
    length, need = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(leaves):
        taken = int(leaf[:need].sum())
        length[:taken] += 1
        need = 2 * (need - taken)
    return dict(zip(ids, length.tolist(), strict=True))


def canonical(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, lengths and codes in the order of the canonical code."""
    ids = np.array(sorted(lengths, key=lambda i: (lengths[i], i)), np.int64)
    length = np.array([lengths[int(i)] for i in ids], np.int64)
    step = np.uint64(1) << (np.uint64(MAX_BITS) - length.astype(np.uint64))
    code = (np.cumsum(step) - step) >> (np.uint64(MAX_BITS) - length.astype(np.uint64)) if len(ids) else step
    return ids, length, code


def _encode(ids: np.ndarray, ends: np.ndarray, code: np.ndarray, length: np.ndarray) -> tuple[list[bytes], list[np.ndarray]]:
    """Bits and checkpoints of each document; its ids end at ``ends``."""
    starts = np.concatenate([[0], ends[:-1]])
    bits = length[ids]
    run = np.concatenate([[0], np.cumsum(bits)])
    n_bytes = (run[ends] - run[starts] + 7) // 8
    at_byte = np.concatenate([[0], np.cumsum(n_bytes)])
    pos = run[:-1] + np.repeat(at_byte[:-1] * 8 - run[starts], ends - starts)
    word = pos >> 5
    value = code[ids] << (np.uint64(64) - (pos & 31).astype(np.uint64) - bits.astype(np.uint64))
    first = np.flatnonzero(np.diff(word, prepend=-1))
    buf = np.zeros(int(at_byte[-1]) // 4 + 3, np.uint64)
    buf[word[first]] += np.add.reduceat(value >> np.uint64(32), first)
    buf[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    raw = buf.astype(">u4").tobytes()
    payload = [raw[a:b] for a, b in zip(at_byte[:-1].tolist(), at_byte[1:].tolist(), strict=True)]
    checks = [(run[a:b:CHECKPOINT_EVERY] - run[a]).astype(np.int64) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return payload, checks


def _decode(payload: list[bytes], counts: np.ndarray, checks: list[np.ndarray], symbol: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The ids of some blocks, one after the other; all checkpoints' stretches advance together."""
    sizes = np.array([len(p) for p in payload], np.int64)
    buf = np.frombuffer(b"".join(payload) + b"\0" * 8, np.uint8).astype(np.uint32)
    window = (buf[:-3] << 24) | (buf[1:-2] << 16) | (buf[2:-1] << 8) | buf[3:]
    lanes = np.array([len(c) for c in checks], np.int64)
    base = (np.cumsum(sizes) - sizes) * 8
    pos = np.concatenate(checks) + np.repeat(base, lanes)
    nth = np.arange(len(pos)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    left = np.minimum(CHECKPOINT_EVERY, np.repeat(counts, lanes) - nth * CHECKPOINT_EVERY)
    to = np.repeat(np.cumsum(counts) - counts, lanes) + nth * CHECKPOINT_EVERY
    order = np.argsort(-left, kind="stable")
    pos, left, to = pos[order], left[order], to[order]
    out = np.zeros(int(counts.sum()), np.uint32)
    active = np.searchsorted(-left, -np.arange(1, int(left.max(initial=0)) + 1), side="right")
    for step, k in enumerate(active.tolist()):
        at = pos[:k]
        look = (window[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(32 - MAX_BITS)
        out[to[:k] + step] = symbol[look]
        at += length[look]
    return out


def write_files(tokens: DataFrame, path: str) -> None:
    """Write ``tokens`` (of ``tokenise``, stashed) to ``path`` in the format above."""
    spark, width = tokens.sparkSession, _width(tokens)
    lengths = code_lengths(count_ids(tokens))
    ids, length, code = canonical(lengths)
    spark.createDataFrame([(int(i), int(n)) for i, n in zip(ids, length, strict=True)], "id long, length int").coalesce(1).write.parquet(f"{path}/codebook")
    top = int(ids.max(initial=0)) + 1
    book = np.zeros(top, np.uint64), np.zeros(top, np.int64)
    book[0][ids], book[1][ids] = code, length
    shared = spark.sparkContext.broadcast(book)  # at most the vocabulary

    def encode(batches):
        codes, lens = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                buf, off = flat(b.column("ids"))
                ends = off[1:] // int(width[2])
                payload, checks = _encode(np.frombuffer(buf.tobytes(), width).astype(np.int64), ends, codes, lens)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(ends, prepend=0), pa.int64()), pa.array(payload, pa.binary()), pa.array(checks, pa.list_(pa.int64()))], ["doc_id", "n_tokens", "bits", "checkpoints"])

    def place(batches):
        start = 0
        for b in batches:
            n = b.column("n_tokens").to_numpy()
            local = start + np.cumsum(n) - n
            start += int(n.sum())
            yield b.append_column("local_start", pa.array(local, pa.int64()))

    form = "doc_id long, n_tokens long, bits binary, checkpoints array<long>"
    coded = stash(tokens.select("doc_id", "ids").mapInArrow(encode, form), "coded")
    discard(tokens)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = coded.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "bits").withColumn("part", F.spark_partition_id())
    placed.mapInArrow(place, form + ", part int, local_start long").write.parquet(f"{path}/blocks")
    discard(coded)


def read_files(spark: SparkSession, path: str, name: str = "ids", kind: str = "binary", take=bytes) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids`` (binary, little-endian unsigned 32-bit), decoded from the files.

    ``take`` may turn a document's id bytes into something smaller where only that is wanted.
    """
    lengths = {r["id"]: r["length"] for r in spark.read.schema("id long, length int").parquet(f"{path}/codebook").collect()}
    ids, length, _ = canonical(lengths)
    span = np.left_shift(1, MAX_BITS - length)
    tables = [np.zeros(1 << MAX_BITS, np.uint32), np.zeros(1 << MAX_BITS, np.int64)]
    for t, v in zip(tables, (ids, length), strict=True):
        t[: int(span.sum())] = np.repeat(v, span)
    shared = spark.sparkContext.broadcast(tables)

    def decode(batches):
        symbol, lens = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                counts = b.column("n_tokens").to_numpy()
                off = np.concatenate([b.column("checkpoints").offsets.to_numpy() - b.column("checkpoints").offsets[0].as_py()])
                flat_checks = b.column("checkpoints").flatten().to_numpy()
                checks = [flat_checks[i:j] for i, j in zip(off[:-1], off[1:], strict=True)]
                out = _decode(b.column("bits").to_pylist(), counts, checks, symbol, lens).astype("<u4")
                ends = np.cumsum(counts)
                docs = [take(out[e - n : e].data) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(docs, pa.binary() if kind == "binary" else pa.int64())], ["doc_id", "start", "n_tokens", name])

    blocks = spark.read.schema("doc_id long, n_tokens long, bits binary, checkpoints array<long>, part int, local_start long").parquet(f"{path}/blocks")
    # one row per output partition, summed over those before it
    totals = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    before, rows = 0, []
    for part in sorted(totals):
        rows.append((part, before))
        before += totals[part]
    offsets = F.broadcast(spark.createDataFrame(rows, "part int, before long"))
    placed = blocks.join(offsets, "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "bits", "checkpoints")
    return placed.mapInArrow(decode, f"doc_id long, start long, n_tokens long, {name} {kind}")


def read_digest(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32``, the CRC-32 of the ids decoded from the files."""
    return read_files(spark, path, "ids_crc32", "long", zlib.crc32)


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> str:
    """Tokenise ``docs`` and write the files below a new path in the shared folder, which is returned."""
    spark, path = docs.sparkSession, scratch(docs.sparkSession, "tokens")
    tokens = tokenise(docs, tokenizer_path, end_id)
    meta = {"width": int(_width(tokens)[2])}
    kept = stash(tokens, "ids").withMetadata("ids", meta)
    write_files(kept, path)
    release(spark)
    return path


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_digest(spark, encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
