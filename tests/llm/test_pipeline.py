import pyarrow.parquet  # noqa: F401
from pyspark.sql import functions as F

import corpus_pipeline


def test_stages(spark, docs, empty, tmp_path):
    for n, start in enumerate((docs, empty)):
        at = start.select("doc_id", "text", "lang", "source", "n_chars")
        columns = at.columns
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            before = at
            path = str(tmp_path / f"{n}-{name}")
            stage(spark, at, str(tmp_path)).write.parquet(path)
            at = spark.read.parquet(path)
            if k < 4:
                assert at.columns == columns
            if n == 1:
                assert at.count() == 0
            elif name == "quality_rules":
                kept = {r.doc_id for r in at.collect()}
                assert set(range(40)) <= kept and not {300, 301, 302, 305} & kept
            elif name == "line_dedup":
                assert at.count() == before.count()
            elif name == "simhash_near_dedup":
                ids = [r.doc_id for r in at.select("doc_id").collect()]
                assert len(ids) == len(set(ids)) and set(range(40)) <= set(ids)
            elif name == "mixing":
                assert {r.doc_id for r in at.collect()} == {r.doc_id for r in before.collect()}
            else:
                assert at.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048
                assert {r.doc_id for r in at.select("doc_id").collect()} == {r.doc_id for r in before.select("doc_id").collect()}


def test_run_is_registered():
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run and len(corpus_pipeline.STAGES) == 5
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in __spark_entry__.queries()}
