"""Benchmark decontamination over a positional inverted index.

Every run of ``WINDOW`` words of a test item is a phrase. Documents are cut into words once. The words of test items are
counted in them, and the index stores the postings (term, document, position) of each phrase's two rarest
terms. A posting list, moved back by its term's offset in the phrase, is a list of starts; the two lists of a phrase are
intersected on document and start, and at the starts that both hold all of the phrase's words are compared.
``proximity`` reads the same postings: the two rarest terms that the corpus has, within some distance, in any order.

DataFrame operations only. The postings of a frequent term, and the phrases that look for it, are dealt to ``SPLIT``
tasks by document. Nothing is broadcast but what Spark itself finds small enough.

Null texts have no words. Items with a null id are left out; repeated items count once. Documents
may repeat: rows of equal ``doc_id`` and text get equal results. Extra columns are not read. Empty tables give
empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dayloom.llm.common import join_on, spread, stash, table

WINDOW = 10
#: Tasks to which the postings of one term are dealt.
SPLIT = 32
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text) -> F.Column:
    """The words of a text, A-Z lower-cased. lower() would change other letters too, so it serves ASCII texts only."""
    text = F.coalesce(F.col(text).cast("string"), F.lit(""))
    low = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.array_remove(F.split(low, NOT_WORD), "")


def phrases(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item_id``, ``phrase`` (array of words): each once."""
    items = benchmark.filter("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), words_of("text").alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    return items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, window))).alias("phrase")).distinct()


def cut_words(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_hash``, ``n_words`` and ``words`` of each row, written once."""
    text = F.col("text").cast("string")
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), words_of("text").alias("words"))
    return stash(cut.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), "words"), "words")


def rarest(words: DataFrame, found: DataFrame, whole: bool = True) -> DataFrame:
    """Adds to each phrase an ``id``, its two rarest terms and their offsets; ``whole``: phrases with a term that the corpus lacks go."""
    placed = stash(found.withColumn("id", F.monotonically_increasing_id()), "phrases")
    terms = stash(placed.select(F.explode("phrase").alias("term")).distinct(), "terms")
    counts = words.select(F.explode("words").alias("term")).join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    each = spread(placed.select("id", F.posexplode("phrase").alias("offset", "term")), counts, ["term"], SPLIT)
    by = each.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "offset", "term"))).alias("by"))
    out = placed.join(by, "id")
    if whole:
        out = out.filter(F.size("by") == F.size("phrase"))
    first, second = F.get("by", F.lit(0)), F.coalesce(F.get("by", F.lit(1)), F.get("by", F.lit(0)))
    return out.select("id", "item_id", "phrase", first["term"].alias("term"), first["offset"].alias("offset"), second["term"].alias("term2"), second["offset"].alias("offset2"))


def postings(words: DataFrame, tests: DataFrame) -> DataFrame:
    """The stored index: ``term``, ``doc_id``, ``text_hash``, ``pos`` of the terms that ``tests`` look up."""
    terms = stash(tests.select(F.explode(F.array("term", "term2")).alias("term")).distinct(), "looked")
    return stash(words.select("doc_id", "text_hash", F.posexplode("words").alias("pos", "term")).join(terms, "term", "left_semi"), "postings")


def lists(index: DataFrame, tests: DataFrame, which: str = "") -> DataFrame:
    """``id``, ``doc_id``, ``text_hash``, ``pos`` and ``start``: the postings of each phrase's rarest (or, with "2", second) term, moved back."""
    looked = tests.select("id", F.col(f"term{which}").alias("term"), F.col(f"offset{which}").alias("offset"))
    return spread(index, looked, ["term"], SPLIT).select("id", "doc_id", "text_hash", "pos", (F.col("pos") - F.col("offset")).alias("start"))


def occurrences(words: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id``, ``text_hash``, ``item_id``, ``start``, ``end`` (word positions) of every phrase in every document of ``cut_words``."""
    tests = stash(rarest(words, phrases(benchmark, window)), "tests")
    index = postings(words, tests)
    at = ["id", "doc_id", "text_hash", "start"]
    first = lists(index, tests).filter("start >= 0").select(*at).distinct()
    both = join_on(first, lists(index, tests, "2").select(*at), at, "left_semi")
    both = stash(spread(both, tests.select("id", "item_id", "phrase"), ["id"], SPLIT), "starts")
    fits = F.slice("words", F.col("start") + 1, F.size("phrase")) == F.col("phrase")
    # only documents with a start are read again; their words move as one string each
    own = ["doc_id", "text_hash"]
    some = join_on(words.select(*own, F.array_join("words", " ").alias("line")), both.select(*own).distinct(), own, "left_semi")
    placed = join_on(both, some.select(*own, F.split("line", " ").alias("words")), own).filter(fits)
    return placed.select("doc_id", "text_hash", "item_id", "start", (F.col("start") + F.size("phrase")).alias("end"))


def proximity(docs: DataFrame, benchmark: DataFrame, within: int = 20, window: int = WINDOW) -> DataFrame:
    """Where a phrase's two rarest terms stand at most ``within`` words apart: ``doc_id``, ``item_id``, ``pos``, ``pos2``.

    Terms that the corpus lacks don't count, so a phrase of which some words were changed is found. The lists meet
    on document and stretch of ``within`` words, the second one in the stretches beside its own too.
    """
    words = cut_words(docs)
    tests = stash(rarest(words, phrases(benchmark, window), whole=False), "tests")
    index = postings(words, tests)
    block = F.floor(F.col("pos") / within)
    first = lists(index, tests).select("id", "doc_id", "text_hash", "pos", block.alias("block"))
    second = lists(index, tests, "2").select("id", "doc_id", "text_hash", F.col("pos").alias("pos2"), F.explode(F.sequence(block - 1, block + 1)).alias("block"))
    near = join_on(first, second, ["id", "doc_id", "text_hash", "block"]).filter(F.abs(F.col("pos") - F.col("pos2")) <= within)
    near = spread(near.select("id", "doc_id", "pos", "pos2").distinct(), tests.select("id", "item_id", (F.col("term") == F.col("term2")).alias("alone")), ["id"], SPLIT)
    return near.filter("pos <> pos2 or alone").select("doc_id", "item_id", "pos", "pos2").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: ``n_words``, ``n_hit`` (words inside any occurrence), ``n_items``, ``items_sha256``, ``contaminated``."""
    words = cut_words(docs)
    found = stash(occurrences(words, benchmark, window), "occurrences")
    own = ["doc_id", "text_hash"]
    before = F.max("end").over(Window.partitionBy(*own).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    hit = found.select(*own, "start", "end").distinct().withColumn("new", F.greatest(F.col("end") - F.greatest("start", F.coalesce(before, F.lit(0))), F.lit(0)))
    hit = hit.groupBy(*own).agg(F.sum("new").alias("n_hit"))
    items = found.select(*own, "item_id").distinct().groupBy(*own).agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    marks = join_on(hit, items, own)
    out = join_on(words.select("doc_id", "text_hash", "n_words"), marks, own, "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    names = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        *own, "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def _words_sql(table: str, key: str) -> str:
    return f"SELECT {key}, [x FOR x IN string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{NOT_WORD}') IF x <> ''] AS w FROM {table}"


ORACLE = f"""
WITH d AS ({_words_sql("documents", "doc_id")}), i AS ({_words_sql("benchmark", "item_id")}),
iw AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, len(w) AS n, least(len(w), {WINDOW}) AS k, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS s
       FROM i WHERE len(w) > 0 AND item_id IS NOT NULL),
p AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS phrase FROM iw),
ks AS (SELECT DISTINCT k FROM p),
dw AS (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS s FROM d, ks WHERE len(w) >= k),
o AS (SELECT doc_id, p.item_id, dw.s AS s, dw.s + dw.k AS e FROM dw JOIN p ON dw.k = p.k AND array_to_string(dw.w[dw.s:dw.s + dw.k - 1], ' ') = p.phrase),
m AS (SELECT doc_id, s, e, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM (SELECT DISTINCT doc_id, s, e FROM o)),
h AS (SELECT doc_id, CAST(sum(greatest(e - greatest(s, coalesce(b, 0)), 0)) AS BIGINT) AS n_hit FROM m GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM o) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
