"""Reading and writing cases and run files, and their exploded views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CASE, RUN_FILE


def read_cases(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """One row per JSON file under path, at any depth; a malformed file raises. limit: the first by path."""
    found = spark.read.schema(CASE).option("multiLine", True).option("recursiveFileLookup", True).option("mode", "FAILFAST").json(path)
    if limit is None:
        return found
    return found.withColumn("_p", F.col("_metadata.file_path")).orderBy("_p").limit(limit).drop("_p")


def write_cases(cases: DataFrame, path: str) -> None:
    """Replaces path by the cases as JSON lines, a folder per family."""
    cases.withColumn("_family", F.col("family")).write.mode("overwrite").partitionBy("_family").json(path)


def read_written_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CASE).option("recursiveFileLookup", True).option("mode", "FAILFAST").json(path)


def tree_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side that the other lacks, with their multiplicity: side is 'only_left' or 'only_right'."""
    names = left.columns
    a = left.exceptAll(right.select(*names)).withColumn("side", F.lit("only_left"))
    b = right.select(*names).exceptAll(left).withColumn("side", F.lit("only_right"))
    return a.unionByName(b)


def write_run(run: DataFrame, path: str) -> None:
    run.write.mode("overwrite").json(path)


def read_runs(spark: SparkSession, path: str, archived: bool = False) -> DataFrame:
    """Run files under path, with the path of each; those in an ``_archive`` folder only if asked for."""
    found = spark.read.schema(RUN_FILE).option("multiLine", True).option("recursiveFileLookup", True).option("mode", "FAILFAST").json(path)
    found = found.withColumn("path", F.col("_metadata.file_path"))
    return found if archived else found.where(~F.col("path").contains("/_archive/"))


def _observed(runs: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """A row per observation o, with the keys under their last names."""
    names = [k.rpartition(".")[2] for k in keys]
    return runs.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.explode("observations").alias("o")), names


def item_observations(runs: DataFrame, *keys: str) -> DataFrame:
    found, names = _observed(runs, keys)
    return found.select(*names, F.explode("o.items").alias("i")).select(*names, "i.*")


def negative_observations(runs: DataFrame, *keys: str) -> DataFrame:
    found, names = _observed(runs, keys)
    return found.select(*names, F.explode("o.negatives").alias("n")).select(*names, "n.*")


def case_observations(runs: DataFrame, *keys: str) -> DataFrame:
    found, names = _observed(runs, keys)
    return found.select(*names, "o.*").drop("items", "negatives")


# --- views of cases -------------------------------------------------------------


def messages(cases: DataFrame) -> DataFrame:
    """(case_id, turn, role, content); turns count from 0."""
    return cases.select(F.col("id").alias("case_id"), F.posexplode("messages").alias("turn", "m")).select("case_id", "turn", "m.role", "m.content")


def gold_items(cases: DataFrame) -> DataFrame:
    return cases.select(F.col("id").alias("case_id"), "register", "family", F.posexplode("pii").alias("ord", "p")).select("case_id", "register", "family", "ord", F.col("p.id").alias("item_id"), *[f"p.{c}" for c in ("type", "value", "canonical", "turn", "start", "end", "tool_param", "cue", "tier", "identity", "parts")])


def negatives(cases: DataFrame) -> DataFrame:
    return cases.select(F.col("id").alias("case_id"), "register", "family", F.posexplode("negatives").alias("ord", "n")).select("case_id", "register", "family", "ord", "n.*")


def user_turns(message_array: str | Column) -> Column:
    """Positions of the user's messages."""
    pairs = F.transform(message_array, lambda m, i: F.struct(i.alias("i"), m["role"].alias("role")))
    return F.transform(F.filter(pairs, lambda x: x["role"] == "user"), lambda x: x["i"])


def last_user_turn(message_array: str | Column) -> Column:
    return F.array_max(user_turns(message_array))


def prefixes(cases: DataFrame) -> DataFrame:
    """A row per request: the transcript up to and including each user turn."""
    return cases.withColumn("request_turn", F.explode(user_turns("messages"))).withColumn("prefix", F.slice("messages", F.lit(1), F.col("request_turn") + 1))
