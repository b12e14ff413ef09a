"""The opN_ queries: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meetlens.llm import ann, audit, bpe, chat, chroma, gru_lm, langid, merkle, packing, quality, simhash, substring, toxicity
from meetlens.llm.common import id_remainder, materialise, table
from meetlens.llm.twins import OP1_SQL, OP11_SQL, OP12_SQL, OP13_SQL

RANKS, WORD_TOKENIZER = "byte_bpe_50k.tiktoken", "word_bpe_49k.json"
QUALITY_FOLD, LANGUAGE_FOLD, TOXICITY_FOLD, MODEL_FOLD = (3, 1), (3, 1), (5, 0), (7, 2)


def held_out(fold: tuple[int, int]):
    return id_remainder(F.col("doc_id"), fold[0]) == fold[1]


def op1_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as mail, whose replies quote two levels, are unquoted and linked again."""
    return chat.conversations(chat.as_mail(table(spark, sf_dir, "conversations"))).drop("n_lines")


def op2_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER))


def op3_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.score(table(spark, sf_dir, "documents"), held_out(MODEL_FOLD))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.cluster(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def _judged(scored: DataFrame, fold: tuple[int, int]) -> DataFrame:
    return scored.select("doc_id", held_out(fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out(QUALITY_FOLD))
    return _judged(quality.score(docs, model), QUALITY_FOLD)


def op7_random_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
    return found.select(F.col("query_id").cast("long").alias("query_id"), "rank", F.col("vec_id").cast("long").alias("vec_id"), "score")


def op8_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no recordings, so each embedding is played as one; queries are those whose id is divisible by 50."""
    media = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    prints = materialise(chroma.fingerprints(media, chroma.melody, 4000, "embedding"), "fingerprints")
    return chroma.align(prints, F.coalesce(F.col("id") % 50 == 0, F.lit(False))).withColumnRenamed("id", "vec_id")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.label(docs, langid.fit(docs, ~held_out(LANGUAGE_FOLD)))
    return found.select("doc_id", held_out(LANGUAGE_FOLD).alias("held_out"), "lang_pred", "score")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out(TOXICITY_FOLD))
    return _judged(toxicity.score(docs, model), TOXICITY_FOLD)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("lang"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row in five, by its id's checksum, has been tampered with since the manifest was made."""
    return merkle.manifest(table(spark, sf_dir, "documents"), id_remainder(F.col("doc_id"), 5) == 0)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedupe(table(spark, sf_dir, "documents")).drop("spans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_quotation_linking, op2_retrieval_packing, op3_recurrent_lm, op4_simhash_dedup, op5_byte_bpe, op6_quality_classifier, op7_random_projection_forest, op8_chroma_fingerprints, op9_language_id, op10_toxicity, op11_filter_audit, op12_merkle_manifest, op13_substring_dedup)
    return {f.__name__: f for f in own} | {"pipeline": pipeline}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def oracle_sql() -> dict[str, str]:
    return {"op1_quotation_linking": OP1_SQL, "op11_filter_audit": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_substring_dedup": OP13_SQL}
