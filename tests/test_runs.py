"""Stored runs in pieces: no row or task holds a whole run, and the board is that of run files."""

import os

import pytest
from pyspark.sql import functions as F

from veilgauge.plans import queries, results

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(repr, df.collect()))


def files(pieces):
    """The same runs as files hold them, a row each."""
    whole = [F.first(c).alias(c) for c in ("manifest", "run", "path")]
    return pieces.groupBy(F.col("manifest.system").alias("_s")).agg(*whole, F.flatten(F.collect_list("observations")).alias("observations")).drop("_s")


def test_a_row_is_a_case(spark):
    assert queries._runs(spark, SF).agg(F.max(F.size("observations"))).first()[0] == 1


@pytest.mark.parametrize("part", [1, 2])
def test_the_board_of_pieces_is_that_of_files(spark, part):
    runs, gold = queries._runs(spark, SF), queries._gold_phones(spark, SF)
    old = runs.withColumn("manifest", F.col("manifest").withField("run_at", F.lit(None).cast("string"))).withColumn("path", F.lit("z"))
    both = runs.unionByName(old)
    got = rows(results.board(both, "now", gold)[part])
    assert got and got == rows(results.board(files(runs).unionByName(files(old)), "now", gold)[part])


@pytest.mark.parametrize("name", ["board_lines", "board_pairs", "rejudge_consistency", "rejudge_items"])
def test_no_run_is_gathered(spark, name):
    assert "collect_list(o#" not in plan(queries.QUERIES[name](spark, SF))


def test_gold_is_not_broadcast(spark):
    found = plan(queries.QUERIES["rejudge_items"](spark, SF))
    assert "SortMergeJoin" in found and "BroadcastHashJoin" not in found
