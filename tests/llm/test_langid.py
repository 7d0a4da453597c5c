"""Cross-parsing against a plain parse: many languages, five scripts, long texts, ties."""

import random

import numpy as np
import pytest

pytest.importorskip("dayloom.llm.registry")

from dayloom.llm import langid

SCRIPTS = {"latin": range(97, 123), "cyrillic": range(0x430, 0x450), "greek": range(0x3B1, 0x3C9), "han": range(0x4E00, 0x4F80), "hangul": range(0xAC00, 0xAD40)}


def plain_parse(text, sample):
    """How many phrases of the sample the text needs."""
    at = count = 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in sample:
            n += 1
        at, count = at + n, count + 1
    return count


def brute(text, sample):
    cleaned = langid._letters(text or "")
    if not cleaned:
        return "und", 0.0
    counts = [plain_parse(cleaned + " ", s) for _, s in sample]
    best = counts.index(min(counts))
    least, *more = sorted(counts)
    return sample[best][0], (more[0] / max(1, least + more[0]) if more else 1.0)


def writer(rng, letters):
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(60)]
    return lambda n: " ".join(rng.choice(words) for _ in range(n))


def test_many_languages_of_five_scripts(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_CHARS", 400)
    rng = random.Random(4)
    writers = {}
    for name, points in SCRIPTS.items():
        for k in range(14):
            writers[f"{name}{k}"] = writer(rng, [chr(c) for c in points])
    rows = [(100 * i + j, w(40), lang) for i, (lang, w) in enumerate(writers.items()) for j in range(4)]
    sample = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(sample) == 70
    asked = [(i, writers[lang](rng.choice([3, 30, 700])), lang) for i, lang in enumerate(rng.sample(sorted(writers), 25))]
    asked += [(90, "12 !!", ""), (91, None, ""), (92, "", ""), (93, "ज्ञ ع \x00 ע", ""), (94, "A\x00b Ω ω 丁", "")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(spark.createDataFrame(asked, "doc_id long, text string, lang string").drop("lang"), sample).collect()}
    for i, text, lang in asked:
        want = brute(text, sample)
        assert got[i][0] == want[0] and abs(got[i][1] - want[1]) < 1e-12
        if i < 25 and len(text) > 100:
            assert want[0] == lang


@pytest.mark.parametrize("stretch", [1, 7, 64, 5000])
def test_stretches_make_one_parse(stretch):
    rng = random.Random(stretch)
    samples = ["".join(rng.choice("abc ") for _ in range(300)), "abcab" * 40, "a", "".join(chr(rng.randint(97, 110)) for _ in range(200))]
    texts = ["".join(rng.choice("abcd ") for _ in range(n)) for n in (0, 1, 50, 3000)] + ["abcab" * 500, "a" * 900, samples[0] * 5, "zz" * 40]
    codes = lambda t: [ord(c) - 32 for c in t]
    model = langid.Model(["w", "x", "y", "z"], np.array([95]), [langid.automaton(codes(t)) for t in samples])
    got = model.phrases(np.array([c for t in texts for c in codes(t)]), np.cumsum([len(t) for t in texts]), stretch)
    assert got.tolist() == [[plain_parse(t, s) for s in samples] for t in texts]


def test_whole_rows_are_sampled(spark, monkeypatch):
    for name in ("SAMPLE_CHARS", "LEAST_CHARS"):
        monkeypatch.setattr(langid, name, 50)
    rows = [(1, "kort", "da"), (2, "x" * 60, "da"), (3, "only long rows here " * 10, "de"), (4, "only long rows here, and longer " * 10, "de"), (5, "...", "it"), (6, None, "fr"), (7, "no label", None)]
    got = dict(langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert got == {"da": "kort " + "x" * 60, "de": ("only long rows here " * 10).strip()}


def test_ties_go_to_the_language_with_more_rows(spark):
    rows = [(1, "same words", "b"), (2, "same words", "a"), (3, "same words", "b")]
    sample = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert [r.lang_pred for r in langid.predict(spark.createDataFrame([(9, "same")], "doc_id long, text string"), sample).collect()] == ["b"]


def test_no_language_is_lost(spark):
    """Very many rows of a label without ids, copies of few texts, or under one id: the label still has its sample."""
    rng = random.Random(9)
    words = {name: writer(rng, [chr(c) for c in points]) for name, points in (("xx", range(97, 110)), ("yy", range(110, 123)), ("en", range(0x430, 0x450)))}
    texts = {name: [w(5) for _ in range(3)] for name, w in words.items()}
    many = [(None, texts["xx"][k % 3], "xx") for k in range(60_000)] + [(7, texts["yy"][0], "yy") for _ in range(20_000)]
    rows = many + [(1000 + k, words["en"](30), "en") for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    sample = dict(langid.learn(df))
    assert set(sample) == {"xx", "yy", "en"} and all(t in sample["xx"] for t in texts["xx"])
    asked = spark.createDataFrame([(1, texts["xx"][1]), (2, texts["yy"][0]), (3, words["en"](20))], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.predict(asked, list(sample.items())).collect()} == {1: "xx", 2: "yy", 3: "en"}


def test_letters_that_lower_to_several(spark):
    """A letter is one symbol in samples and in texts, whatever its case gives."""
    text = "İzmir İstanbul ΣΑΣ ŞİŞLİ"
    assert langid._letters(text) == "izmir istanbul σασ şişli"
    sample = [("tr", langid._letters(text)), ("zz", langid._letters("qqq www"))]
    (row,) = langid.predict(spark.createDataFrame([(1, text)], "doc_id long, text string"), sample).collect()
    assert row.lang_pred == "tr" and row.score > 0.9
