"""Command line: python -m veilgauge build | check | run | board, on the session that spark-submit or a local one gives."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import gates
from .plans import corpus, evaluate, maskers, results
from .schema import POLICIES
from .session import stored
from .sources import cases as src


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="veilgauge", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", help="generate a corpus; with --check compare it with what is there")
    build.add_argument("--seed", type=int, required=True)
    build.add_argument("--out", required=True)
    build.add_argument("--check", action="store_true")
    check = commands.add_parser("check", help="defects and strata of a corpus")
    check.add_argument("--cases", required=True)
    run = commands.add_parser("run", help="measure a masker that needs no engine or transport")
    run.add_argument("--cases", required=True)
    run.add_argument("--masker", default="placeholder_regex")
    run.add_argument("--policy", choices=POLICIES, default="copier")
    run.add_argument("--seed", type=int, default=0)
    run.add_argument("--limit", type=int)
    run.add_argument("--out", required=True)
    board = commands.add_parser("board", help="the leaderboard of stored runs")
    board.add_argument("--cases", required=True)
    board.add_argument("--results", required=True)
    return p


def _build(spark: SparkSession, seed: int, out: str, check: bool) -> int:
    made = corpus.generate(spark, seed)
    if check:
        flat = lambda d: d.select("id", F.to_json(F.struct("messages", "pii", "negatives", "expected_call")).alias("content"))
        differing = src.tree_diff(flat(src.read_written_cases(spark, out)), flat(made)).select("id").distinct().orderBy("id").limit(40).collect()
        print("\n".join(["the corpus does not match the seed:", *[r["id"] for r in differing]]) if differing else "the corpus matches the seed")
        return int(bool(differing))
    made = stored(made, "corpus")
    if wrong := gates.defects(made).limit(40).collect():
        print("\n".join(f"{r['case_id']}: {r['rule']} {r['detail']}" for r in wrong))
        return 1
    src.write_cases(made, out)
    for r in made.groupBy("family").count().orderBy("family").collect():
        print(f"{r['family']} {r['count']}")
    return 0


def _check(cases: DataFrame) -> int:
    wrong = gates.defects(cases).limit(40).collect()
    strata = gates.strata(cases).orderBy("stratum").collect()
    for r in wrong:
        print(f"{r['case_id']}: {r['rule']} {r['detail']}")
    for r in strata:
        print(f"{'ok ' if r['ok'] else 'BAD'} {r['stratum']} {r['value']:.3f}")
    return int(bool(wrong) or not all(r["ok"] for r in strata))


def _run(cases: DataFrame, masker: str, policy: str, seed: int, out: str) -> int:
    found = [stored(d, "observed") for d in evaluate.evaluate(cases, maskers.build(masker), policy, seed=seed)]
    manifest = {"system": masker, "policy": policy, "seed": seed, "corpus_digest": results.corpus_digest(cases).first()["digest"], "corpus_cases": cases.count()}
    src.write_run(results.run_file(*found, manifest), out)
    print(results.report(cases.sparkSession, *found))
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    if a.command == "build":
        return _build(spark, a.seed, a.out, a.check)
    cases = src.read_written_cases(spark, a.cases)
    if a.command == "check":
        return _check(cases)
    if a.command == "run":
        cases = cases if a.limit is None else cases.orderBy("id").limit(a.limit)
        return _run(cases, a.masker, a.policy, a.seed, a.out)
    print(results.leaderboard(src.read_runs(spark, a.results), cases))
    return 0


if __name__ == "__main__":
    sys.exit(main())
