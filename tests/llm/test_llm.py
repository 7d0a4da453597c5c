"""The corpus operators against brute-force versions, on the small tables and on odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("dayloom.llm.registry")

from dayloom.llm import decontaminate, langid, line_dedup, mixing, near_dup, pii, registry, substring_dedup, token_files, url_filter
from dayloom.llm.common import SHINGLE_C, Rolling, mix

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, th string, number int"
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu " * 30
ODD = [
    (5, None, None, None, None, 1, "x", 2), (6, "", "en", None, 0, 1, "x", 2), (7, "  \n\t ", "en", "a", 3, 1, "x", 2), (8, "one two", "en", "a", 7, 1, "x", 2), (8, "one two", "en", "a", 7, 1, "x", 2),
    (9, LONG, "en", "b", 9, 1, "x", 2), (10, LONG + "tail", None, "b", 9, 1, "x", 2), (11, LONG, "en", None, 9, 1, "x", 2), (12, "Émile \x1c à 😀 " * 40 + "\n\n", "fr", "c", 9, 1, "x", 2),
    (13, "a\nb\nc\nd\ne\nf\ng\nh\n" * 20, "en", "c", 1, 1, "x", 2), (14, "zz\n" + "a\nb\nc\nd\ne\nf\ng\nh\n" * 20, "en", "c", 1, 1, "x", 2), (15, "\x00.,..;' x@y.z 1.2.3.4 <|endoftext|> don't e\u0301t\xe9", "en", "c", 1, 1, "x", 2),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, duck, same, name):
    same(registry.queries()[name](spark, SF), duck.sql(registry.oracle_sql()[name]).df())


# --- repeated substrings


def brute_substrings(rows):
    seen, out = set(), {}
    for i, t in sorted(set(rows)):
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            else:
                seen.add(b[s : s + 100])
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("most", [2, 8192])
def test_substrings(spark, odd, small, monkeypatch, most):
    monkeypatch.setattr(substring_dedup, "MOST_GROUP", most)
    for df in (odd, small) if most > 2 else (odd,):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in substring_dedup.dedupe(df).collect()}
        assert got == brute_substrings(texts(df))
    assert substring_dedup.dedupe(odd.limit(0)).count() == 0


# --- near duplicates


def brute_near(rows, t=75):
    word = re.compile(rb"[^\x20\x09-\x0D]+")
    sets = {}
    for i, x in rows:
        w = word.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in x.encode()))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    posting = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            posting[g].append(i)
    common = Counter((a, b) for p in posting.values() for n, a in enumerate(p) for b in p[n + 1 :])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), c in common.items():
        if 100 * c >= t * (len(sets[a]) + len(sets[b]) - c):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("dense", [4, -1])
def test_near_duplicates(odd, small, monkeypatch, dense):
    monkeypatch.setattr(near_dup, "DENSE", dense)
    monkeypatch.setattr(near_dup, "ROUNDS", 2 if dense > 0 else 0)
    for df in (odd, small) if dense > 0 else (small,):
        got = near_dup.near_duplicates(df).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_near(texts(df))
        assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == df.count()


def test_near_duplicates_without_ids(spark):
    other = "quite another text of more than five words that nobody copies at all"
    rows = [(None, LONG, "x"), (None, LONG + " end", "y"), (3, LONG + " fin", "z"), (4, other, "a"), (4, "some words of a second text under the id of the first one", "b"), (None, other[::-1], "c"), (None, "", "d"), (None, None, "e"), (None, other[::-1], "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, text_hash string")
    got = Counter((r.doc_id, r.n_shingles > 0, r.component_id, r.kept) for r in near_dup.near_duplicates(df).collect())
    assert got == {(None, True, 3, False): 2, (3, True, 3, True): 1, (4, True, 4, True): 2, (None, True, None, True): 2, (None, False, None, True): 2}
    kept = Counter(r.doc_id for r in near_dup.kept_documents(df).collect())
    assert kept == {3: 1, 4: 2, None: 3}


def test_a_bucket_of_many_unlike_documents(spark, monkeypatch):
    # more members than a block holds, which share most registers but not enough shingles
    rng, rows = np.random.default_rng(2), []
    common = [f"common{i}" for i in range(120)]
    for k in range(330):
        own = [f"own{k // 2}x{i}" for i in range(int(rng.integers(20, 60)))]
        rows.append((k, " ".join(common + own + [f"last{k}"])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(near_dup, "BLOCK", 100)
    monkeypatch.setattr(near_dup, "GATHER", 64)
    monkeypatch.setattr(near_dup, "PAIRS", 500)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df).collect()}
    want = brute_near(rows)
    assert got == want and 10 < len({c for _, c in want.values()}) < 330


def test_near_duplicates_of_nothing(odd):
    assert near_dup.near_duplicates(odd.limit(0)).count() == 0


def test_estimate_tells_similarity():
    rng = np.random.default_rng(1)
    pool = mix(np.arange(1, 4001, dtype=np.uint64))
    a, b = np.sort(pool[:2000]), np.sort(np.concatenate([pool[:1500], pool[2000:2500]]))
    ra, rb = near_dup.registers(a)[None], near_dup.registers(b)[None]
    est, used = near_dup.estimates(ra, rb, np.array([2000]), np.array([2000]))
    assert used[0] == near_dup.BUCKETS and abs(est[0] - 0.6) < 0.2
    assert 0 < near_dup.chance_collisions(2000, 2000) < 5 and rng is not None


# --- personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "phone":
        return 8 <= len(d) <= 15
    if kind == "card":
        return 16 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for k, c in enumerate(d[::-1])) % 10 == 0
    return True


PII = [
    "a@b.c_x@y.z 1.2.3.4.5.6.7.8 300.1.2.3.4 +1 (2) 345-6789. +12345678901234567", "4111 1111 1111 1111-4111-1111-1111-1111 4111111111111111 é4111-1111-1111-1111é", "x@y.z@w.q 😀 a@b.cd +1--2 ++1 23456789 ",
    None, "", "1.2.3.256 001.002.003.004 .1.2.3.4. a..b@c.d.e.. @x.y 12 4111111111111111 5", "9" * 3000 + " " + "1 " * 3000, "+123 +45678901 4+5678-9012(34)5 4222222222222 6304000000000000000",
]


def test_base_patterns(spark, small):
    df = spark.createDataFrame(list(enumerate(PII)), "doc_id long, text string")
    for d in (df, small):
        for r in pii.find(d).collect():
            for kind, pattern in PATTERNS.items():
                want = [m.span() for m in re.finditer(pattern, r.text) if valid(kind, m.group())]
                assert [(x.start, x.end) for x in r[kind]] == want, (kind, r.text[:200])


def test_disclosing_terms(spark):
    rows = [(i, f"text number {'abcdef'[i]} says Wintermoon lives with the mail wm@example.com today {'abcdef'[i]}") for i in range(4)]
    rows += [(10 + i, f"other text {i} with the mail and nothing else today lives here says number") for i in range(30)] + [(50, None), (51, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.spans(df).collect()}
    assert len(got) == 36
    for i in range(4):
        assert [x.value for x in got[i].term] == ["Wintermoon"]
    assert all(not got[10 + i].term for i in range(30))
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert clean[0] == "text number a says  lives with the mail [EMAIL] today a" and clean[10] == rows[4][1] and clean[50] is None
    assert pii.spans(df.limit(0)).count() == 0


# --- urls


@pytest.mark.parametrize("part_keys", [100, 1 << 12, 1 << 20])
def test_cascade_is_exact(spark, part_keys):
    rng = np.random.default_rng(part_keys)
    rows = [(f"k{i}", bool(x), "r", i, 1) for i, x in enumerate(rng.random(5000) < 0.2)] + [(None, False, "r", 1, 1)] * 3
    rows += [("k0", rows[0][1], "r", 2, 1)] * 1500  # one key of many rows
    df = spark.createDataFrame(rows, "key string, want boolean, row string, part int, listed int")
    listed = df.filter("want").select("key").union(spark.createDataFrame([("elsewhere",), (None,)], "key string"))
    got = url_filter.mark_listed(df, listed, part_keys)
    assert got.columns == ["key", "want", "row", "part", "listed"]
    assert Counter((r.key, r.want, r.part) for r in got.collect() if r.listed == r.want) == Counter((k, w, p) for k, w, _, p, _ in rows)
    filters, parts = url_filter.build_cascades(df.select("key"), listed, part_keys)
    assert filters.count() == parts if part_keys >= 100 and parts < 40 else parts > 40
    if part_keys == 100:
        assert url_filter.mark_listed(df, listed.limit(0)).filter("listed").count() == 0
        assert url_filter.mark_listed(df.limit(0), listed).count() == 0


def test_url_parts(spark):
    urls = {None: ("", ""), "nothing": ("", ""), "x://A.B?q/z": ("a.b", ""), "http://É.com/p#f?": ("É.com", "/p"), "a://b://c/d": ("b:", "//c/d")}
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r.url: (r.host, r.path) for r in url_filter.split_url(df).collect()} == urls


def test_rules_say_what_the_contract_says(spark, tmp_path):
    want = {
        "http://a.com/en/1": ("com/en/", "block"), "http://example.com/en/1": ("com/en/", "block"), "http://www.example.com/en/71": ("example.com/en/7", "allow"),
        "http://a.net/de/8": ("net/de/", "allow"), "http://Example.NET/de/9": ("net/de/", "allow"), "http://spam.a.net/de/1": ("net/de/", "allow"),
        "http://example.net/de/8": ("example.net/de/8", "block"), "http://m.example.net/de/85?q": ("example.net/de/8", "block"), "http://anexample.net/de/8": ("net/de/", "allow"),
        "http://a.org/es/": ("org/es/", "block"), "http://a.org/en/": (None, "allow"), "http://spam.a.net/en/": (None, "block"), None: (None, "allow"),
    }
    spark.createDataFrame(list(enumerate(want)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    urls = list(want)
    assert {urls[r.page_id]: (r.rule, r.verdict) for r in url_filter.op5(spark, str(tmp_path)).collect()} == want


# --- mixing


def test_mix_meets_targets(spark, small, odd):
    for df in (small, odd):
        got = mixing.mix(df)[0].collect()
        assert len(got) == df.count() and all(0 <= r.taken <= 2 * r.size for r in got)
        by = defaultdict(list)
        for r in got:
            by[r.source].append(r)
        for rows in by.values():
            assert sum(r.size for r in rows) == rows[0].source_size
            assert abs(sum(r.taken for r in rows) - rows[0].target) <= max(64, 0.05 * rows[0].target)
    assert mixing.mix(odd.limit(0))[0].count() == 0
    taken = sum(r.taken for r in mixing.mix(small)[0].collect())
    mixed = mixing.mixed_documents(small)
    assert mixed.columns == small.columns and sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for _, t in texts(mixed)) == taken


def test_mix_keeps_columns_of_any_name(spark, odd):
    names = ("_id", "_hash", "row", "n", "cuts", "passes", "text_hash", "copy", "size", "shard")
    docs = odd.drop("id", "th", "number").withColumns({c: F.lit(c) for c in names})
    more = [(None, f"word{i} " * 50, "en", "a", 7) for i in range(40)] + [(8, f"other{i} " * 60, "en", None, 7) for i in range(40)]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(c) for c in names}))
    mixed = mixing.mixed_documents(docs, shard_words=300, block_words=8)
    assert mixed.columns == docs.columns
    rows = mixed.collect()
    assert all(r[c] == c for r in rows for c in names)
    taken = mixing.mix(docs, shard_words=300, block_words=8)[0].collect()
    assert len(taken) == docs.count() and sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows) == sum(r.taken for r in taken) > 0
    assert sorted(map(str, mixing.mixed_documents(docs, shard_words=300, block_words=8).collect())) == sorted(map(str, rows))


def test_mix_deals_texts_once(spark, small, odd):
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}  # the plan of large tables
    before = {c: spark.conf.get(c) for c in off}
    try:
        for c, v in off.items():
            spark.conf.set(c, v)
        for docs in (small, odd):
            mixed = mixing.mixed_documents(docs)
            plan = mixed._sc._jvm.PythonSQLUtils.explainString(mixed._jdf.queryExecution(), "formatted")
            dealt = re.findall(r"^\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]$", plan, re.M)
            assert len(dealt) > 1 and sum(bool(re.search(r"\brow#", x)) for x in dealt) == 1
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


# --- decontamination


def brute_hits(rows, items, k=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    windows = {}
    for i, t in items:
        w = cut(t)
        for s in range(max(1, len(w) - k + 1)) if w else ():
            windows.setdefault(tuple(w[s : s + k]), set()).add(str(i))
    out = []
    for d, t in rows:
        w, hit, found = cut(t), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[s : s + n]))) is not None:
                    found |= x
                    hit |= set(range(s, s + n))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_decontaminate(spark, odd):
    items = [(1, "Alpha beta GAMMA delta epsilon zeta eta theta iota kappa lambda mu"), (2, "one TWO"), (3, None), (4, "..."), (10, "émile à"), (10, "émile à"), (None, "one"), (11, "a b c d e f g h a b c d missing")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    more = [(None, "one two x", None, None, 0, 1, "x", 2), (70, "the one two " * 70_000, "en", "a", 0, 1, "x", 2), (71, "beta alpha mu gamma", "en", "a", 0, 1, "x", 2)]
    docs = odd.union(spark.createDataFrame(more, odd.schema)).withColumns({c: F.lit("clash") for c in ("text_hash", "words", "term", "start", "item_id")})
    got = sorted((tuple(r) for r in decontaminate.decontaminate(docs, bench).drop("text_hash").collect()), key=str)
    assert got == sorted(brute_hits(texts(docs), [(i, t or "") for i, t in items if i is not None]), key=str)
    assert decontaminate.decontaminate(odd.limit(0), bench).count() == 0
    assert decontaminate.decontaminate(odd, bench.limit(0)).filter("contaminated").count() == 0


def test_proximity(spark):
    rows = [(1, "rare x x x other x x"), (2, "other rare"), (3, "rare x x x x x x other"), (4, "rare only"), (5, "common common common common common common x"), (None, "other x rare"), (6, None)]
    items = [(1, "rare common other x absent"), (2, "only"), (3, "absent"), (4, "x common " * 8)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    counts = Counter(w for _, t in rows for w in (t or "").split())
    want = set()
    for i, t in items:
        words = t.split()
        for s in range(max(1, len(words) - 9)):
            by = sorted((counts[w], k, w) for k, w in enumerate(words[s : s + 10]) if w in counts)
            for d, text in rows if by else ():
                at = lambda w, text=text: [p for p, x in enumerate((text or "").split()) if x == w]
                first, second = by[0][2], by[min(1, len(by) - 1)][2]
                want |= {(d, str(i), p, q) for p in at(first) for q in at(second) if abs(p - q) <= 4 and (p != q or first == second)}
    got = [tuple(r) for r in decontaminate.proximity(docs, bench, within=4).collect()]
    assert len(got) == len(set(got)) and set(got) == want and (1, "1", 4, 0) in want and (4, "2", 1, 1) in want


# --- language


def test_language_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = langid.op8(spark, d).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.filter("lang_pred = lang").count() / got.count() > 0.95


def test_language_odd(spark, odd):
    sample = langid.learn(odd)
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict(odd, sample).collect()]
    assert len(got) == len(ODD) and all(0 <= s <= 1 for _, _, s in got)
    assert {d: p for d, p, _ in got}[5] == "und" and {d: p for d, p, _ in got}[7] == "und" and {d: p for d, p, _ in got}[9] == "en"
    assert langid.learn(odd.limit(0)) == []
    assert langid.predict(odd, []).filter("lang_pred <> 'und'").count() == 0


# --- token files


def test_token_files_round_trip(spark, odd, small):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    for df in (odd, small):
        got = sorted((r.start, r.doc_id, r.n_tokens, r.ids) for r in token_files.read_files(spark, token_files.encode_documents(df, path)).collect())
        want = Counter((d, np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for d, t in texts(df))
        assert Counter((d, bytes(ids)) for _, d, _, ids in got) == want
        assert [d for _, d, _, _ in got] == sorted(d for _, d, _, _ in got)
        assert [s for s, *_ in got] == np.concatenate([[0], np.cumsum([n for _, _, n, _ in got])[:-1]]).tolist()
    where = token_files.encode_documents(odd, path)
    crc = Counter(r.ids_crc32 for r in token_files.read_digest(spark, where).collect())
    assert crc == Counter(zlib.crc32(r.ids) for r in token_files.read_files(spark, where).collect())
    assert token_files.read_files(spark, token_files.encode_documents(odd.limit(0), path)).count() == 0


def test_code_lengths_are_optimal_and_limited():
    counts = {i: 2**i for i in range(30)}
    lengths = token_files.code_lengths(counts, 10)
    assert max(lengths.values()) <= 10 and sum(2.0**-n for n in lengths.values()) <= 1
    assert token_files.code_lengths({1: 1, 2: 1, 3: 2}, 20) == {1: 2, 2: 2, 3: 1}
    assert token_files.code_lengths({7: 3}) == {7: 1} and token_files.code_lengths({}) == {}


# --- lines


def brute_lines(rows):
    def h(b):
        x = np.frombuffer(b, np.uint8)
        return mix(Rolling(x)(np.array([0]), np.array([len(x)])))[0]

    seen, out = {}, {}
    for i, t in sorted(set(rows)):
        lines, chunks, cur, before = t.encode().split(b"\n"), [], [], None
        for line in lines:
            cur.append(line)
            roll = np.array([h(line)]) * SHINGLE_C[30] + (np.array([before]) * SHINGLE_C[31] if before is not None else np.uint64(0))
            before = h(line)
            if mix(roll)[0] % np.uint64(line_dedup.MODULUS) == 0:
                chunks, cur = [*chunks, cur], []
        chunks = [*chunks, cur] if cur else chunks
        kept, gone = [], 0
        for c in chunks:
            key = b"\n".join(c)
            if len(c) >= line_dedup.LEAST_LINES and seen.setdefault(key, (i, len(kept) + gone)) != (i, len(kept) + gone):
                gone += len(c)
            else:
                kept += c
        out[i] = (len(lines), len(chunks), gone, b"\n".join(kept).decode())
    return out


def test_lines(odd, small):
    for df in (odd, small):
        got = line_dedup.dedupe(df)
        assert got.columns[: len(df.columns)] == df.columns
        assert {r.doc_id: (r.n_lines, r.n_chunks, r.n_removed_lines, r.text) for r in got.collect()} == brute_lines(texts(df))
    assert line_dedup.dedupe(odd.limit(0)).count() == 0
