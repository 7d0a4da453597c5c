"""A corpus pipeline of operators in ``dayloom.llm``: from raw documents to coded token files.

Each stage works on all that the stage before it kept; between stages the rows are written and read
again. The stages of language, near duplicates, contamination and mixing return the columns of
``documents``; the last one returns a row per document of the token files, read back from them.

Null texts and texts without letters go in the first stage. A document is a text under an id: different texts under one
id, and texts without an id, are documents of their own in all stages. Extra columns pass through, whatever their names. An
empty table passes through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayloom.llm import decontaminate, langid, mixing, near_dup, token_files
from dayloom.llm.common import stash, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language can be told go."""
    sample = langid.learn(docs.filter(~langid.held_out()).select("doc_id", "lang", "text"))
    return langid.predict(docs, sample).filter("lang_pred <> 'und'").drop("lang_pred", "score")


_KEYS = ["id", "no_id", "hash"]


def _keys(doc_id: str, text_hash) -> list:
    """A document's key in columns that are never null."""
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("id"), F.col(doc_id).isNull().alias("no_id"), text_hash.alias("hash")]


def _keyed(docs: DataFrame) -> DataFrame:
    """The key and the row itself, nested, so that its columns may have any names."""
    return docs.select(*_keys("doc_id", F.xxhash64(F.col("text").cast("string"))), F.struct(*[F.col(c) for c in docs.columns]).alias("row"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id; of rows equal in id and text, one."""
    best = near_dup.kept_documents(docs).select(*_keys("doc_id", F.col("text_hash")))
    kept = _keyed(docs).join(best, _KEYS, "left_semi")
    return kept.groupBy(*_KEYS).agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    marked = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("contaminated").select(*_keys("doc_id", F.col("text_hash"))).distinct()
    return _keyed(docs).join(marked, _KEYS, "left_anti").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in the proportions of their weights: documents repeat, or are taken in part."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix."""
    return token_files.read_digest(spark, token_files.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", contamination),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", tokens),
]

#: Language, near-duplicate and token stages are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stash(docs, f"stage{i}")
    return docs
