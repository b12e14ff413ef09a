import corpus_pipeline as P
from test_near import first_of_groups

from meetlens.llm import queries

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_by_brute_force(spark, sf):
    """Each stage against its operator's own rows, and nothing that it should keep is lost."""
    from meetlens.llm import langid, quality

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = P.language(spark, docs, sf)
    model = langid.fit(docs, ~queries.held_out(queries.LANGUAGE_FOLD))
    want = {r.doc_id for r in langid.label(docs, model).collect() if r.lang_pred != "und" and r.unknown <= P.MAX_UNKNOWN}
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == want
    first = P.materialise(first, "test")
    second = P.materialise(P.good(spark, first, sf), "test")
    scored = quality.score(first, quality.fit(first, spark.read.parquet(f"{sf}/labels.parquet"), ~queries.held_out(queries.QUALITY_FOLD))).collect()
    assert {r.doc_id for r in second.collect()} == {r.doc_id for r in scored if r.score >= P.MIN_QUALITY}
    third = P.distinct(spark, second, sf)
    assert {r.doc_id for r in third.collect()} == first_of_groups([(r.doc_id, r.text) for r in second.collect()])
    assert {r.doc_id for r in P.packed(spark, third, sf).collect()} == {r.doc_id for r in third.collect()}


def test_awkward_rows(spark, awkward, tmp_path):
    docs = awkward.withColumnsRenamed({"label": "lang_pred", "block": "kept_id"})  # beside score: names that stages use
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for own in (docs, docs.limit(0)):
        now = own
        for name, stage in P.STAGES:
            assert now.columns == docs.columns
            now = P.materialise(stage(spark, now, str(tmp_path)), name)
        kept = [r.doc_id for r in now.select("doc_id").distinct().collect()]
        assert set(kept) <= {1, None, 6, 7, 9, 10} and (kept or own is not docs)


def test_run_and_names(spark, sf):
    assert P.run(spark, sf).count() > 0
    names = queries.queries()
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in names if k.startswith("op")} and "pipeline" in names
