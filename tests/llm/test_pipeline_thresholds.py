import corpus_pipeline as P
from pyspark.sql import functions as F

from meetlens.llm import queries
from meetlens.llm.common import table


def test_rejected_quality_goes(spark, sf):
    """No document that the classifier rejects (op6: predicted 0) stays."""
    docs = table(spark, sf, "documents")
    doubtful = queries.op6_quality_classifier(spark, sf).where("predicted = 0")
    assert doubtful.count() and P.good(spark, docs, sf).join(doubtful, "doc_id").count() == 0


def test_unlearned_language_goes(spark, sf):
    """Texts in a language that no row teaches go (nine of ten at least), those of learned ones stay."""
    docs = table(spark, sf, "documents")
    foreign = docs.where("lang = 'de'").withColumns({"lang": F.lit(None).cast("string"), "doc_id": -1 - F.col("doc_id")})
    known = docs.where("lang <> 'de'")
    kept = P.language(spark, known.union(foreign), sf)
    assert kept.where("doc_id < 0").count() <= 0.1 * foreign.count()
    assert kept.where("doc_id >= 0").count() >= 0.97 * known.count()


def test_scores_below_the_decision_point_go(spark, sf, monkeypatch):
    docs = table(spark, sf, "documents").limit(20)
    monkeypatch.setattr(P.quality, "score", lambda d, model, keep, prefix: d.withColumn(f"{prefix}score", F.when(F.col("doc_id") % 2 == 0, 0.45).otherwise(0.5)))
    assert {r.doc_id % 2 for r in P.good(spark, docs, sf).collect()} == {1}
