"""Language identification by cross-parsing: how few phrases of a language's sample a text needs.

For each language a suffix automaton of a sample of its labelled text is built. A text is parsed
against it from left to right: the longest match with any substring of the sample is one phrase, and
the next phrase begins after it. The language that needs the fewest phrases per character wins.

Every label is a language, and every letter of any sample a symbol of its own. The samples are bounded:
whole labelled rows, different in text, in the order of a hash of id and text, until a language has ``SAMPLE_CHARS`` characters
(less where there are more languages than ``ALL_CHARS`` allows at that size, ``LEAST_CHARS`` at least); rows
longer than that are taken only where a language has no other. Of a language with very many rows a share of the hashes is looked at, and all
rows if that share gives less than is wanted (many copies, say). So the model grows with the number of
labels only. The samples are broadcast, and a worker builds the automata from them once.

Every text is parsed whole. A long one is parsed in stretches side by side; each stretch's parse goes on into
the next until both begin a phrase at the same place, from where they agree, so the count is that of one
unbroken parse.

Letters are lower-cased one by one (to the first letter, where that gives several); all else becomes one space. Null text, or text without letters: ``und`` with
score 0. The score is ``second / (first + second)`` of the two smallest phrase counts (1 with one
language). Ties go to the language with more labelled documents. Rows with a null label, or without letters, teach
nothing; without any labelled text all is ``und``. Repeated rows are judged alike; an empty table gives an empty
result; only the columns named below are read.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from dayloom.llm.common import frugal, pieces, table

#: Characters of a language's sample, of all samples together, and of a sample at least.
SAMPLE_CHARS, ALL_CHARS, LEAST_CHARS = 30_000, 2_000_000, 200
#: Characters of a text that one lane parses, and bytes of text that a task works on at a time, unless one text is longer.
STRETCH, PIECE = 1024, 1 << 19


def _letters(text: str) -> str:
    return " ".join("".join(c.lower()[0] if c.isalpha() else " " for c in text).split())


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions (symbol to state) of each state of a text's suffix automaton; state 0 is the start."""
    nxt, link, length = [{}], [-1], [0]
    last = 0
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


def overlaid(rows: list[dict[int, int]], symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The transitions as rows laid over each other in one array: ``base`` of each state, ``owner`` and ``to``.

    The transition of state s by symbol c is at ``base[s] + c`` where ``owner`` there is s; elsewhere there is none.
    States with many transitions are placed first, by chance; those with one take the holes that are left.
    """
    degree = np.array([len(r) for r in rows], np.int64)
    state = np.repeat(np.arange(len(rows)), degree)
    symbol = np.fromiter((c for r in rows for c in r), np.int64, len(state))
    to = np.fromiter((t for r in rows for t in r.values()), np.int64, len(state))
    begin = np.cumsum(degree) - degree
    rng = np.random.Generator(np.random.PCG64(3))
    size = 2 * len(state) + 2 * symbols + 64
    base, used = np.zeros(len(rows), np.int64), np.zeros(size, bool)
    level = np.frexp(degree.astype(float))[1]
    for k in range(int(level.max(initial=0)), 1, -1):
        todo = np.flatnonzero((level == k) & (degree > 1))
        rounds = 0
        while len(todo):
            rounds += 1
            if rounds % 100 == 0:  # wide rows find no room: make some
                used = np.concatenate([used, np.zeros(len(used), bool)])
            n = degree[todo]
            first = np.cumsum(n) - n
            at = np.repeat(begin[todo] - first, n) + np.arange(int(n.sum()))
            put = rng.integers(0, len(used) - symbols, len(todo))
            slot = np.repeat(put, n) + symbol[at]
            lead = np.zeros(len(slot), bool)
            lead[np.unique(slot, return_index=True)[1]] = True
            fits = np.logical_and.reduceat(lead & ~used[slot], first)
            used[slot[np.repeat(fits, n)]] = True
            base[todo[fits]] = put[fits]
            todo = todo[~fits]
    alone = np.flatnonzero(degree == 1)
    holes = symbols + np.flatnonzero(~used[symbols:])[: len(alone)]
    if len(holes) < len(alone):
        holes = np.concatenate([holes, len(used) + np.arange(len(alone) - len(holes))])
    base[alone] = holes - symbol[begin[alone]]
    size = max(len(used), int(holes.max(initial=0)) + 1) + symbols
    owner, target = np.full(size, -1, np.int64), np.zeros(size, np.int64)
    owner[base[state] + symbol], target[base[state] + symbol] = state, to
    return base, owner, target


#: Documents of a language that may come to its sample, and how many times as many are let near.
NEED, MARGIN = SAMPLE_CHARS // 100, 50


def _teaching(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))


def samples(docs: DataFrame, counts: dict[str, int], chars: int, shares: bool = True) -> DataFrame:
    """``lang`` and ``sample``: text of each language of ``counts`` (its number of documents), of about ``chars``.

    Documents are taken whole, by a hash of id and text, the lowest first. With ``shares`` only hashes low enough to let about
    ``NEED * MARGIN`` documents of a language through are looked at. A task keeps no more than a language may need.
    """
    chance = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text", F.lit("sample"))
    few = [(lang, NEED * MARGIN / n) for lang, n in counts.items() if shares and n > NEED * MARGIN]
    marked = _teaching(docs).filter(F.col("lang").isin(*counts)).withColumn("chance", chance)
    if few:
        share = F.try_element_at(F.create_map(*[F.lit(x) for pair in few for x in pair]), F.col("lang"))
        marked = marked.filter(F.col("chance").cast("double") / 2.0**64 + 0.5 <= F.coalesce(share, F.lit(2.0)))
    size = F.length("text")
    marked = marked.select("lang", F.when(size > chars, size).otherwise(0).alias("over"), "chance", "text")

    def first(batches):
        kept = None
        for b in batches:
            pdf = b.to_pandas()
            kept = pdf if kept is None else pd.concat([kept, pdf])
            kept = kept.sort_values(["over", "chance", "text"]).drop_duplicates(["lang", "text"]).groupby("lang", sort=False).head(NEED)
            size = kept["text"].str.len()
            kept = kept[size.groupby(kept["lang"]).cumsum() - size < chars]
        if kept is not None:
            yield pa.RecordBatch.from_pandas(kept, preserve_index=False)

    short = marked.mapInArrow(frugal(first), "lang string, over int, chance long, text string")
    short = short.groupBy("lang", "text").agg(F.min(F.struct("over", "chance")).alias("x")).select("lang", "x.*", "text")
    by = Window.partitionBy("lang").orderBy("over", "chance", "text")
    before = F.sum(F.length("text")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    short = short.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < chars)
    return short.groupBy("lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("over", "chance", "text"))), lambda x: x["text"]), " ").alias("sample"))


class Model:
    """Symbols of the code points and, per language, an automaton."""

    def __init__(self, names: list[str], symbol: np.ndarray, automata: list[list[dict[int, int]]]):
        self.names, self.symbol = names, symbol
        symbols = int(max(symbol.max(initial=0), max((max(r, default=0) for a in automata for r in a), default=0))) + 1
        starts, slots, base, owner, to = [], 0, [], [], []
        many = 0
        for a in automata:
            b, o, t = overlaid(a, symbols)
            starts.append(many)
            base.append(b + slots)
            owner.append(np.where(o >= 0, o + many, -1))
            to.append(t + many)
            many, slots = many + len(a), slots + len(o)
        # the last state has no transitions: a text stands there before it begins, and after a letter that the sample lacks
        self.starts, self.outside = starts, many
        self.base = np.concatenate([*base, [0]]).astype(np.int32)
        self.slot = (np.concatenate(owner) << 32) | np.concatenate(to)
        everything = np.arange(symbols)
        self.again = []
        for root in starts:
            at = self.slot[self.base[root] + everything]
            self.again.append(np.where(at >> 32 == root, at & 0xFFFFFFFF, self.outside))

    def _step(self, i: int, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and where a phrase begins."""
        at = self.slot[self.base[state] + c]
        miss = (at >> 32) != state
        return np.where(miss, self.again[i][c], at & 0xFFFFFFFF), miss

    def phrases(self, codes: np.ndarray, ends: np.ndarray, stretch: int = STRETCH) -> np.ndarray:
        """Phrases of each text (ending at ``ends``) against each language."""
        begins = np.concatenate([[0], ends[:-1]])
        many = np.maximum(1, -(-(ends - begins) // stretch))
        owner = np.repeat(np.arange(len(ends)), many)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        start = begins[owner] + nth * stretch
        end = np.minimum(start + stretch, ends[owner])
        order = np.argsort(start - end, kind="stable")
        at, length = start[order], (end - start)[order]
        active = np.searchsorted(-length, -np.arange(1, int(length.max(initial=0)) + 1), side="right")
        total = np.zeros((len(ends), len(self.names)), np.int64)
        for i in range(len(self.names)):
            state = np.full(len(at), self.outside, np.int64)
            begun = np.zeros(len(codes) + 1, bool)  # the places where a phrase begins in its stretch's own parse
            for step, k in enumerate(active.tolist()):
                place = at[:k] + step
                state[:k], miss = self._step(i, state[:k], codes[place])
                begun[place] = miss
            last = np.empty(len(at), np.int64)
            last[order] = state
            total[:, i] = self._joined(i, codes, ends, owner, start, end, last, begun)
        return total

    def _joined(self, i, codes, ends, owner, start, end, state, begun) -> np.ndarray:
        """Counts of whole parses from those of the stretches: each goes on until it meets a later stretch's own parse."""
        sums = np.concatenate([[0], np.cumsum(begun)])
        meet, more = end.copy(), np.zeros(len(start), np.int64)
        lane = np.flatnonzero(end < ends[owner])
        at, state = end[lane], state[lane]
        while len(lane):
            state, miss = self._step(i, state, codes[at])
            met = miss & begun[at]
            more[lane] += miss & ~met
            meet[lane] = np.where(met, at, at + 1)
            at = at + 1
            going = ~met & (at < ends[owner[lane]])
            lane, at, state = lane[going], at[going], state[going]
        out = np.zeros(len(ends), np.int64)
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        now, place = first, start[first]
        while len(now):  # along the stretches of all texts at once
            out[owner[now]] += sums[end[now]] - sums[place] + more[now]
            going = meet[now] < ends[owner[now]]
            text, place = owner[now][going], meet[now][going]
            now = first[text] + (place - start[first[text]]) // (start[1 + first[text]] - start[first[text]])
        return out


def ranks(texts: list[str]) -> dict[str, int]:
    """The symbols of the letters of the samples: 0 is the space, 1 any letter that no sample holds."""
    return {c: i + 2 for i, c in enumerate(sorted(set().union(*texts) - {" "}))}


def learn(docs: DataFrame) -> list[tuple[str, str]]:
    """(language, cleaned sample) of labelled ``docs``, the language with most documents first."""
    every = _teaching(docs).groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row per language
    counts = {r["lang"]: r["n"] for r in sorted(every, key=lambda r: (-r["n"], r["lang"]))}
    if not counts:
        return []
    chars = max(LEAST_CHARS, min(SAMPLE_CHARS, ALL_CHARS // len(counts)))
    got = {r["lang"]: r["sample"] for r in samples(docs, counts, chars).collect()}  # bounded, see above
    short = {n: c for n, c in counts.items() if c > NEED * MARGIN and len(got.get(n, "")) < chars}
    if short:
        got |= {r["lang"]: r["sample"] for r in samples(docs, short, chars, shares=False).collect()}  # as bounded
    got = {n: _letters(text) for n, text in got.items()}
    return [(n, got[n]) for n in counts if got.get(n)]


_models: dict = {}


def built(sample: list[tuple[str, str]]) -> Model:
    """The model of the samples; a worker keeps the last one."""
    key = hash(tuple(sample))
    if key not in _models:
        rank = ranks([t for _, t in sample])
        symbol = np.zeros(0x110000, np.int32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                symbol[i] = rank.get(c.lower()[0], 1)
        automata = [automaton(symbol[np.frombuffer(t.encode("utf-32-le"), "<u4")].tolist()) for _, t in sample]
        _models.clear()
        _models[key] = Model([n for n, _ in sample], symbol, automata)
    return _models[key]


def predict(docs: DataFrame, sample: list[tuple[str, str]]) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (which replace columns of these names)."""
    docs = docs.drop("lang_pred", "score")
    if not sample:
        return docs.withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(sample)  # bounded by the samples' size and number
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches):
        m = built(shared.value)
        names = pa.array([*m.names, "und"])
        for whole in batches:
            for b in pieces(whole, "text", PIECE):
                texts = b.column("text").fill_null("")
                n = len(texts)
                points = np.frombuffer("".join(t + "\0" for t in texts.to_pylist()).encode("utf-32-le"), "<u4")
                code = m.symbol[points]
                doc_end = np.flatnonzero(points == 0)
                if len(doc_end) != n:  # a text holds \0 itself
                    doc_end = np.cumsum([len(t) + 1 for t in texts.to_pylist()]) - 1
                doc = np.repeat(np.arange(n), np.diff(doc_end, prepend=-1))
                space = code == 0
                keep = ~(space & np.concatenate([[True], space[:-1] | (doc[1:] != doc[:-1])])) if len(code) else space
                code, doc = code[keep], doc[keep]
                size = np.bincount(doc, minlength=n)
                letters = np.bincount(doc, weights=code > 0, minlength=n)
                total = m.phrases(code, np.cumsum(size))
                best = total.argmin(axis=1)
                least = total[np.arange(n), best]
                if len(m.names) > 1:
                    second = np.partition(total, 1, axis=1)[:, 1]
                    score = second / np.maximum(1, least + second)
                else:
                    score = np.ones(n)
                none = letters == 0
                best[none], score[none] = len(m.names), 0.0
                yield pa.RecordBatch.from_arrays([*b.columns, names.take(pa.array(best)), pa.array(score, pa.float64())], [*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(frugal(run), schema)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sample = learn(docs.filter(~held_out()).select("doc_id", "lang", "text"))
    return predict(docs.select("doc_id", F.col("text").cast("string").alias("text")), sample).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
