from __future__ import annotations

import corpus_pipeline


def test_stages_keep_the_columns_and_place_every_piece(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).toPandas(), docs.schema)
        assert docs.columns == columns, name
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now and now <= kept, name
        kept = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).toPandas()
    assert set(packed.doc_id) == kept
    assert packed.groupby("sequence_id").length.sum().max() <= 4096


def test_stages_on_odd_tables(spark, sf):
    """Nulls, empty and repeated rows, ties and columns of any name through all stages; the clean documents stay."""
    good = [" ".join(f"w{i}x{k}" for k in range(70)) for i in range(6)]
    near = " ".join(f"w0x{k}" for k in range(69)) + " other"
    texts = [*good, good[0], near, None, "", "short one", " ".join(["again and again"] * 40)]
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, len(t or ""), 7, "r") for i, t in enumerate(texts)]
    rows += [rows[1], (None, good[2], None, None, None, 7, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, place int, row string")
    empty = docs.limit(0)
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        empty = spark.createDataFrame(stage(spark, empty, sf).collect(), empty.schema)
        assert empty.count() == 0 and docs.where("place = 7 AND row = 'r'").count() == docs.count()
        seen[name] = sorted((r.doc_id for r in docs.select("doc_id").collect()), key=str)
    assert seen["quality_rules"] == sorted([0, 1, 1, 2, 3, 4, 5, 6, 7, None], key=str)
    assert seen["line_dedup"] == seen["quality_rules"]
    assert seen["jaccard_join"] == sorted([0, 1, 2, 3, 4, 5, None], key=str)
    assert set(seen["source_mixing"]) == set(seen["jaccard_join"])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.collect()} == set(seen["source_mixing"])
    assert corpus_pipeline.STAGES[-1][1](spark, empty, sf).count() == 0
