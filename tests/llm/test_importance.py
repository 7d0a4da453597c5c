"""Importance resampling against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

from dayloom.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _features(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def _buckets(text):
    return [zlib.crc32(f.encode()) % 10000 for f in _features(text)[1]]


def _plain(docs, target, least=20, percent=25):
    s = Counter(b for _, text in docs for b in _buckets(text))
    t = Counter(b for text in target for b in _buckets(text))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)}
    rows = []
    for i, text in docs:
        buckets = _buckets(text)
        weight = sum(gain[b] for b in buckets) // len(buckets) if buckets else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(_features(text)[0]) >= least])
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = len(able) * percent // 100
    rank = {id(r): k + 1 for k, r in enumerate(able) if k < drawn}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=repr)


def _run(spark, docs, target, **options):
    d = spark.createDataFrame([(i, text, "x") for i, text in docs], "doc_id long, text string, score string")
    t = spark.createDataFrame([(text,) for text in target], "text string")
    return sorted((tuple(r) for r in importance.resample(d, t, **options).select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_odd_rows(spark):
    docs = [(i, f"The CAT number {i} sat on Été ſtreet {'w ' * (i % 30)}") for i in range(60)]
    docs += [(100, None), (101, ""), (102, " .,;"), (103, "one"), (None, "null id " * 30), (7, docs[7][1]), (104, "B. b B " * 50), (105, "日本 語\x00x" * 40)]
    target = ["the cat sat", None, "b b b w w", ""]
    assert _run(spark, docs, target) == _plain(docs, target)
    assert _run(spark, docs, target, least_words=0, percent=100) == _plain(docs, target, 0, 100)


def test_empty_tables(spark):
    docs = [(1, "a b " * 20), (2, "c d " * 20)]
    assert _run(spark, docs, []) == _plain(docs, [])
    assert _run(spark, [], ["a"]) == []


def test_pieces_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(importance, "PIECE", 64)
    text = "..." * 60 + "alpha beta  gamma-delta " * 30 + "x" * 500 + " omega" + "é" * 90 + " " * 200 + "end"
    found = [(raw, goes_on) for raw, goes_on in importance._cut(text.encode())]
    words = []
    for raw, goes_on in found:
        words += _features(raw.decode())[0][1 if goes_on else 0 :]
    assert words == _features(text)[0] and len(found) > 5
    pairs = [f for raw, _ in found for f in _features(raw.decode())[1] if " " in f]
    assert pairs == [f for f in _features(text)[1] if " " in f]


def test_long_text(spark):
    docs = [(1, "Some words, and more. " * 150_000), (2, "some other words " * 10)]
    assert _run(spark, docs, ["some words"]) == _plain(docs, ["some words"])


def test_ties_and_copies(spark):
    docs = [(i % 40, "same text as all the others " * 4) for i in range(200)]
    target = ["same text"]
    found = _run(spark, docs, target)
    plain = _plain(docs, target)
    assert [r[:4] for r in found] == [r[:4] for r in plain] or sorted(map(repr, found)) == sorted(map(repr, plain))
    assert sorted(r[4] for r in found if r[4]) == list(range(1, 51))
