"""The pipeline's stages on a small corpus with planted cases, each judged on its own input."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline


def test_stages_catch_planted_cases_and_keep_clean_rows(spark, tmp_path):
    rng = np.random.default_rng(2)
    text = lambda n=60: " ".join(f"v{x}" for x in rng.integers(0, 400, n))
    clean = {i: text() for i in range(300)}
    item = text(30)
    rows = dict(clean)
    for i in range(300, 400):
        rows[i] = text() + " vileword vileword"
    rows |= {500: clean[7], 501: clean[8] + " tail", 502: "x " + item + " y"}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long")
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 300)) for i in range(0, 400)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    now, kept = spark.read.parquet(f"{d}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, d)
        assert now.columns == docs.columns
        kept.append({r.doc_id for r in now.collect()})
    assert set(clean) <= kept[2] and kept[0] & set(range(300, 400)) == set()
    assert kept[0] - kept[1] == {500, 501} and kept[1] - kept[2] == {502}
    packed = corpus_pipeline.run(spark, d)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == kept[2]
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_stages_of_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id string, __gone int"
    long = " ".join(f"w{i % 977}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, " \t"), (None, "a row without an id of its own"), (None, "a row without an id of its own"), (4, long), (4, long), (5, "x" * 40000), (6, "one two")]
    docs = spark.createDataFrame([(i, t, None, None, None, 0.5, "clash", 1) for i, t in rows], schema)
    spark.createDataFrame([(4, 0, 0), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, None), (7, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (docs, docs.limit(0)):
        now = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, str(tmp_path))
            assert now.columns == table.columns
            assert now.count() == table.count()
        packed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
        assert len({(r.doc_id, r.start, r.ids_crc32) for r in packed}) <= len(packed) and {r.doc_id for r in packed} == {r.doc_id for r in table.collect()}
