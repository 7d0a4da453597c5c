"""Personal data: fixed patterns, and terms that the corpus shows to reveal a protected value.

Patterns (see ``KINDS``) give base spans. Each different value found is a protected entity. Every term of a
text that mentions it is measured by corpus co-occurrence: with N different texts, n_e that mention the
entity, n_t that hold the term and n_te that do both,

    PMI(t; e) = log2(N n_te / (n_t n_e))        IC(e) = log2(N / n_e)

and a term with PMI >= ``ALPHA`` IC gives away that share of the entity's information. Such a term counts if
so many common texts are no chance: under independence the probability of n_te or more is at most
C(n_e, n_te) C(n_t, n_te) / C(N, n_te), which must not exceed ``LEVEL``. For an entity of a single text that is n_t / N.
Disclosing terms get spans of kind ``term`` wherever they stand in a text that mentions the entity (outside
base spans). ``sanitise`` generalises base spans to their kind and removes terms.

Entities that the very same texts mention share all counts and are measured once, as a group.

DataFrame operations only. Counts are over different texts, so copies prove nothing. Null text counts as
empty. Rows may repeat and ids may be null: results are by row. Extra columns are not read. Empty
tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dayloom.llm.common import join_on, spread, stash, table

_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
#: Kinds in the order of the results. The patterns find what the plain ones of the contract find, leftmost and
#: without overlap, but never look at a character twice: runs are possessive and begin at their left end.
KINDS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[{_LABEL}]++(?:\.[{_LABEL}]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the kind's pattern to be worth a try.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
ALPHA, LEVEL = 0.9, 0.01
#: Tasks to which the mentions of one entity are dealt.
SPLIT = 16
_NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _luhn(value) -> F.Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    at = lambda i: F.substring(digits, -i, F.lit(1)).cast("int")
    part = lambda i: F.when(i % 2 == 1, at(i)).otherwise(2 * at(i) - F.when(at(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + part(i)) % 10 == 0


def _valid(kind: str, value) -> F.Column:
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def _check(kind: str):
    return lambda x: _valid(kind, x["value"])


_SPAN = "struct<start:int,end:int,value:string>"


def _let(value, body) -> F.Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(x, op, zero) -> F.Column:
    """For each element of an array what ``op`` makes of all before it: along blocks, then within them, so never of a long slice."""
    fold = lambda part: F.aggregate(part, F.lit(zero), op)

    def along(x):
        n = F.size(x)
        width = F.greatest(F.lit(1), F.ceil(F.pow(n.cast("double"), F.lit(1 / 3)))).cast("int")

        def of(width):
            place = lambda i: F.floor(i / width).cast("int")
            blocks = F.transform(F.sequence(F.lit(0), place(F.greatest(n, F.lit(1)) - 1)), lambda j: fold(F.slice(x, j * width + 1, width)))
            heads = _let(blocks, lambda bs: F.transform(bs, lambda _, j: fold(F.slice(bs, F.lit(1), j))))
            one = lambda hs: F.transform(x, lambda _, i: op(F.get(hs, place(i)), fold(F.slice(x, place(i) * width + 1, i % width))))
            return _let(heads, one)

        return _let(width, of)

    return _let(x, along)


def _placed(text, pattern) -> F.Column:
    """Start, end and value of each match, from the pieces between the matches."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("value"))

    def spans(pairs):
        at = _running(F.transform(pairs, lambda x: F.length(x["gap"]) + F.length(x["value"])), lambda a, b: a + b, 0)

        def span(x, at):
            start = at + F.length(x["gap"])
            return F.struct(start.alias("start"), (start + F.length(x["value"])).alias("end"), x["value"].alias("value"))

        return F.zip_with(pairs, at, span)

    return _let(pairs, spans)


def find(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_hash`` and, per kind, an array of its valid spans."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), text.alias("text"))
    for kind, pattern in KINDS.items():
        t = F.col("text")
        there = F.contains(t, F.lit(NEEDS[kind])) if NEEDS[kind] else F.lit(True)
        spans = F.when(there & t.rlike(pattern), _placed(t, F.lit(pattern))).otherwise(F.array().cast(f"array<{_SPAN}>"))
        out = out.withColumn(kind, F.filter(spans, _check(kind)))
    return out


def _with_entities(found: DataFrame) -> DataFrame:
    """Adds ``entities``, the values found; ``text`` stays where there are any."""

    def entity(kind):
        return lambda x: F.struct(F.lit(kind).alias("kind"), x["value"].alias("value"))

    all_ = F.concat(*[F.transform(F.col(k), entity(k)) for k in KINDS])
    return found.withColumn("entities", all_).withColumn("text", F.when(F.size("entities") > 0, F.col("text")))


def _terms(texts: DataFrame) -> DataFrame:
    """``text_hash`` and each different word of ``text``, lower-cased, as ``term``."""
    words = F.transform(F.array_distinct(F.split("text", _NOT_WORD)), F.lower)
    return texts.select("text_hash", F.explode(F.array_distinct(words)).alias("term")).filter("term <> ''")


def _ln_choose(n, k) -> F.Column:
    def ln_factorial(x):  # Ramanujan's
        x = x.cast("double")
        return F.when(x <= 1, 0.0).otherwise(x * F.log(x) - x + F.log(x * (1 + 4 * x * (1 + 2 * x))) / 6 + math.log(math.pi) / 2)

    return ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k)


def _telling(n: int, n_t: str, alpha: float, level: float) -> F.Column:
    """Whether counts disclose; once false, it stays so for any larger ``n_t``."""
    n, n_t, n_e, n_te = F.lit(float(n)), F.col(n_t), F.col("n_e"), F.col("n_te")
    most = n_te * F.pow(n / n_e, F.lit(1 - alpha))
    chance = _ln_choose(n_e, n_te) + _ln_choose(n_t, n_te) - _ln_choose(n, n_te)
    return (n_t <= most + 1e-9 * most) & (n_t * n_e < n * n_te) & (chance <= math.log(level) + 1e-9)


_GROUP = ["n_e", "g1", "g2"]


def disclosing(found: DataFrame, docs: DataFrame, alpha: float = ALPHA, level: float = LEVEL) -> DataFrame:
    """``text_hash`` and ``term`` of the terms that give away an entity of the text, with the largest ``share`` PMI / IC."""
    n = found.select("text_hash").distinct().count()
    mentions = stash(found.select("text_hash", F.explode("entities").alias("x")).select("text_hash", "x.kind", "x.value").distinct(), "mentions")
    marks = [F.bit_xor(F.xxhash64("text_hash", F.lit(k))).alias(f"g{k}") for k in (1, 2)]
    entities = mentions.groupBy("kind", "value").agg(F.count("*").alias("n_e"), *marks)
    groups = stash(spread(mentions, entities, ["kind", "value"], SPLIT).select("text_hash", *_GROUP).distinct(), "groups")
    near = stash(_terms(found.filter("text is not null")).distinct(), "near")
    # a term stands in at least as many texts as it stands in with any entity: what that rules out isn't counted further
    least = near.groupBy("term").agg(F.count("*").alias("least"))
    widest = groups.groupBy("text_hash").agg(F.max("n_e").alias("widest"))
    most = F.pow(F.col("widest"), F.lit(alpha)) * F.pow(F.lit(float(n)), F.lit(1 - alpha))
    some = near.join(widest, "text_hash").join(least, "term").filter(F.col("least") <= most + 1e-9 * most)
    pairs = stash(some.select("text_hash", "term", "least").join(groups, "text_hash").groupBy(*_GROUP, "term", "least").agg(F.count("*").alias("n_te")).filter(_telling(n, "least", alpha, level)).drop("least"), "pairs")
    # texts without copies are counted in the tasks that read them, of the others one row each
    copied = stash(found.groupBy("text_hash").agg(F.count("*").alias("rows")).filter("rows > 1").select("text_hash"), "copied")
    text = F.col("text").cast("string")
    texts = docs.select(F.xxhash64(text).alias("text_hash"), text.alias("text"))
    alone = _terms(texts.join(copied, "text_hash", "left_anti"))
    once = _terms(texts.join(copied, "text_hash", "left_semi").dropDuplicates(["text_hash"]))
    counts = [some.groupBy("term").agg(F.count("*").alias("n")) for some in (alone, once)]
    counted = counts[0].unionByName(counts[1]).groupBy("term").agg(F.sum("n").alias("n_t"))
    telling = pairs.join(counted, "term").filter(_telling(n, "n_t", alpha, level))
    share = F.log2(F.lit(float(n)) * F.col("n_te") / (F.col("n_t") * F.col("n_e"))) / F.log2(F.lit(float(n)) / F.col("n_e"))
    telling = telling.select(*_GROUP, "term", share.alias("share"))
    # the group's texts that hold the term
    return groups.join(telling, _GROUP).join(near, ["text_hash", "term"]).groupBy("text_hash", "term").agg(F.max("share").alias("share"))


def _term_spans(found: DataFrame, told: DataFrame) -> DataFrame:
    """``text_hash`` and ``term``, the spans of a text's disclosing terms that touch no base span."""
    texts = found.filter("text is not null").join(told.select("text_hash").distinct(), "text_hash", "left_semi").dropDuplicates(["text_hash"])
    words = texts.select("text_hash", F.explode(_placed(F.col("text"), F.lit(_WORD))).alias("x")).select("text_hash", "x.*", F.lower("x.value").alias("term"))
    words = words.join(told, ["text_hash", "term"]).select("text_hash", "start", "end", "value", F.lit(False).alias("base"))
    base = texts.select("text_hash", F.explode(F.concat(*KINDS)).alias("x")).select("text_hash", "x.*", F.lit(True).alias("base"))
    by = Window.partitionBy("text_hash").orderBy("start", "end", "base")
    before = F.max(F.when(F.col("base"), F.col("end"))).over(by.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min(F.when(F.col("base"), F.col("start"))).over(by.rowsBetween(1, Window.unboundedFollowing))
    clear = words.unionByName(base).withColumn("before", before).withColumn("after", after)
    clear = clear.filter("not base and (before is null or before <= start) and (after is null or after >= end)")
    return clear.groupBy("text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "end", "value"))).alias("term"))


def spans(docs: DataFrame, alpha: float = ALPHA, level: float = LEVEL) -> DataFrame:
    """``doc_id``, ``text_hash``, an array of spans per kind, and ``term``: the disclosing terms' spans."""
    found = stash(_with_entities(find(docs)), "found")
    told = stash(disclosing(found, docs, alpha, level).select("text_hash", "term"), "told")
    none = F.array().cast(f"array<{_SPAN}>")
    out = found.select("doc_id", "text_hash", *KINDS).join(stash(_term_spans(found, told), "placed"), "text_hash", "left")
    return out.select("doc_id", "text_hash", *KINDS, F.coalesce("term", none).alias("term"))


#: Characters of the blocks in which a text is cut, so that no piece is looked for from the text's start.
_CUT = 4096


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with base spans generalised to ``[KIND]`` and disclosing terms removed; spans that overlap give the first one's kind."""
    kinds = [*KINDS, "term"]

    def change(kind):
        return lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit("" if kind == "term" else f"[{kind.upper()}]").alias("put"))

    all_ = F.array_sort(F.concat(*[F.transform(k, change(k)) for k in kinds]))
    found = spans(docs, **options).select("doc_id", "text_hash", all_.alias("spans")).dropDuplicates(["doc_id", "text_hash"])
    # the row is nested, so that its columns may have any names
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"), F.struct(*[F.col(c) for c in docs.columns]).alias("row"))

    def cut(blocks, start, end):
        first = F.floor(start / _CUT).cast("int")
        part = F.array_join(F.slice(blocks, first + 1, F.floor(end / _CUT).cast("int") - first + 1), "")
        return F.when(end > start, F.substring(part, start % _CUT + 1, end - start)).otherwise("")

    def pieces_of(blocks):
        done = _running(F.transform("spans", lambda x: x["end"]), lambda a, b: F.greatest(a, b), 0)
        pieces = F.zip_with("spans", done, lambda x, at: F.concat(cut(blocks, at, x["start"]), F.when(x["start"] >= at, x["put"]).otherwise("")))
        last = F.array_max(F.transform("spans", lambda x: x["end"]))
        return F.concat(F.array_join(pieces, ""), cut(blocks, last, F.length("text")))

    changed = _let(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{_CUT}}}"), F.lit(0)), pieces_of)
    out = join_on(rows, found, ["doc_id", "text_hash"], "left").withColumn("clean", F.when(F.size("spans") > 0, changed).otherwise(F.col("text")))
    return out.select(*[F.col("clean").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def _joined(kinds) -> F.Column:
    def named(kind):
        return lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string"))

    each = [F.transform(F.array_sort(F.col(k)), named(k)) for k in kinds]
    return F.array_join(F.concat(*each), ",")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(KINDS), 256).alias("base_sha256"), _joined([*KINDS, "term"]).alias("spans"))
