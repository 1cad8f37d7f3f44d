"""score_lines: one pass over the documents, detectors only where there is something to find."""

import os

import pytest
from pyspark.sql import functions as F

from veilgauge.operators import detect, score
from veilgauge.plans import documents, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TEXTS = [None, "", "no identifiers", "Иван Рябов", "a@b.ru and +1 (202) 555-0143", "8 907 123 45 67", "10.0.0.1", "4111 1111 1111 1111 4111 1111 1111 1112", 'token = "' + "a1" * 20 + '"', "x@y"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "ru", "web") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_documents_are_read_once(spark):
    plan = queries.QUERIES["score_lines"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1


def test_texts_without_claims_are_known_without_making_them(docs):
    t = F.col("text")
    for patterns in (documents.GOLD, detect.RUSSIAN):
        assert docs.where(F.coalesce(detect.holds(t, patterns), F.lit(False)) != (F.size(detect.claims(t, patterns)) > 0)).count() == 0


def test_one_pass_counts_as_two(docs):
    o = documents.observations(docs)
    want = score.lines(o.where("NOT negative"), o.where("negative").select(F.col("altered").alias("touched")))
    got = score.lines_in_one(o)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.where("line = 'overmask' AND hits < total").count() == 1
    assert sorted(map(tuple, score.lines_in_one(o.where("false")).collect()))[0] == ("coverage", 0, 0)
