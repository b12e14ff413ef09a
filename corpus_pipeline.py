"""The corpus pipeline: language ID, quality, near-duplicates, packing; each stage's rows are written and read again.

Models learn from the stage's own input (and the labels table), so a stage is a function of what its predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meetlens.llm import langid, near, packing, quality
from meetlens.llm.common import materialise, prepare, table
from meetlens.llm.queries import LANGUAGE_FOLD, QUALITY_FOLD, WORD_TOKENIZER, held_out

#: A document scored below MIN_QUALITY goes: the classifier's own decision point. So does one of whose letters the language
#: network gives more than MAX_UNKNOWN to no learned language: on sf0.01, one in a hundred held-out texts of learned languages
#: has over 0.04; with one language left out of training, nineteen in twenty of its texts have over 0.19.
MIN_QUALITY, MAX_UNKNOWN = 0.5, 0.15
#: Before the names of a stage's own columns, so that documents may have columns of any other name.
OWN = "__stage_"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a learned language: not `und`, and MAX_UNKNOWN of the letters in none of them at most."""
    prepare(spark)
    found = langid.label(docs, langid.fit(docs, ~held_out(LANGUAGE_FOLD)), keep=docs.columns, prefix=OWN)
    known = (F.col(f"{OWN}lang_pred") != langid.UND) & (F.col(f"{OWN}unknown") <= MAX_UNKNOWN)
    return found.where(known).select(docs.columns)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose quality scores MIN_QUALITY at least."""
    prepare(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out(QUALITY_FOLD))
    return quality.score(docs, model, keep=docs.columns, prefix=OWN).where(F.col(f"{OWN}score") >= MIN_QUALITY).select(docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies (five-word shingles, similarity 0.8), with the smallest id that is not null."""
    prepare(spark)
    return near.survivors(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lays every document into windows, beside its lexical neighbours."""
    prepare(spark)
    return packing.pack(docs, public_tokenizers.path(WORD_TOKENIZER))


STAGES = [("language_id", language), ("quality_classifier", good), ("simhash_near_dedup", distinct), ("retrieval_packing", packed)]

#: No stage can be expressed in SQL: two learned models, hashes of shingles with components, and a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
