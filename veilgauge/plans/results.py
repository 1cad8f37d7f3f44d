"""Run files, re-judging of stored runs, and the leaderboard."""

from __future__ import annotations

import hashlib
import platform
from collections.abc import Iterator
from datetime import datetime, timezone
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import rewrite, text
from ..operators import judge, score
from ..sources import cases as src

VERSION = "0.1"
POLICY_ORDER = ("copier", "rewriter", "reformat")


def corpus_digest(cases: DataFrame) -> DataFrame:
    """One row (digest): of the ids and user texts of the cases, in the order of their ids; any edit to a case moves it.

    It is one hash over one stream, as other tools compute it too, so a single task reads the sorted texts, and holds none.
    """
    users = F.array_join(F.transform(F.filter("messages", lambda m: m["role"] == "user"), lambda m: m["content"]), "")
    name = F.col("id").cast("string")
    stream = cases.select(name.alias("id"), F.concat(name, users).alias("text")).repartition(1).sortWithinPartitions("id")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = hashlib.sha256()
        for b in batches:
            for text in b.column(1).cast(pa.binary()).to_pylist():
                whole.update(text or b"")
        yield pa.RecordBatch.from_arrays([pa.array([whole.hexdigest()[:16]])], ["digest"])

    return stream.mapInArrow(digest, "digest string")


def content_digest(texts: Column) -> Column:
    """Of a case's user texts, for finding cases drawn twice."""
    return F.substring(F.sha1(F.array_join(texts, "\n").cast("binary")), 1, 10)


def run_file(items: DataFrame, negatives: DataFrame, cases: DataFrame, manifest: dict, rescored_by: str | None = None) -> DataFrame:
    """One row in the format of a run file, rates rounded to six places. For runs that fit a file; larger ones stay tables."""
    spark = items.sparkSession
    found = score.with_intervals(score.lines(items, negatives, cases))

    def six(c: str) -> Column:
        return F.round(F.col(c), 6).alias(c)

    entry = F.struct("hits", "total", six("rate"), F.array(six("low"), six("high")).alias("ci95"), six("certifies"))
    lines = found.agg(F.map_from_entries(F.collect_list(F.struct("line", entry))).alias("lines"))
    run = score.counters(items, cases).select(F.struct(*schema.RUN.fieldNames()).alias("run"))
    by_item = items.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("item_id", F.struct(*schema.ITEM_OBS.fieldNames()).alias("o")))).alias("i")).select("case_id", F.transform("i", lambda x: x["o"]).alias("items"))
    by_neg = negatives.groupBy("case_id").agg(F.collect_list(F.struct(*schema.NEG_OBS.fieldNames())).alias("negatives"))
    full = cases.join(by_item, "case_id", "left").join(by_neg, "case_id", "left")
    none_i, none_n = (F.array().cast(schema.CASE_OBS[c].dataType) for c in ("items", "negatives"))
    full = full.withColumns({"items": F.coalesce("items", none_i), "negatives": F.coalesce("negatives", none_n)})
    obs = full.agg(F.transform(F.sort_array(F.collect_list(F.struct("case_id", F.struct(*schema.CASE_OBS.fieldNames()).alias("o")))), lambda x: x["o"]).alias("observations"))
    meta = {"benchmark_version": VERSION, "run_at": datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"), "python": platform.python_version(), "adapter_config": {}, "submitted_by": "", "notes": ""} | manifest
    head = spark.createDataFrame([(tuple(meta.get(n) for n in schema.MANIFEST.fieldNames()),)], schema.T.StructType([schema.T.StructField("manifest", schema.MANIFEST)]))
    marker = F.struct(F.lit(rescored_by).alias("benchmark_version")) if rescored_by else F.lit(None).cast("struct<benchmark_version: string>")
    return head.join(lines, F.lit(True)).join(run, F.lit(True)).join(obs, F.lit(True)).select("manifest", "lines", "run", "observations", marker.alias("rescored"))


def rejudge(items: DataFrame, gold: DataFrame, policy: str | Column = "copier", pivot: int = 26) -> DataFrame:
    """items with round_trip and normalised by the current judge; what was masked and delivered is the record and stays.

    Items whose gold is unknown, or that were not measured or delivered, keep their verdicts. policy: an agent, or a column
    that names it. What a step needs again is a column first, else its expression would be repeated at each use.
    """
    g = gold.select("case_id", "item_id", F.col("type").alias("_type"), F.col("canonical").alias("_canonical"), F.col("parts").alias("_parts"))
    # the gold grows with the cases, and a compressed table looks small enough to be broadcast long after it is not
    both = items.join(g.hint("merge"), ["case_id", "item_id"], "left")
    agent = F.lit(policy) if isinstance(policy, str) else policy
    owed = F.col("_canonical")
    if not isinstance(policy, str) or policy != "copier":
        owed = F.when(agent == "rewriter", rewrite.rewrite(F.col("_type"), owed, pivot)).otherwise(owed)
    both = both.withColumn("_owed", owed)
    order = F.map_keys("_parts")
    fields = text.let(rewrite.cut_address(F.col("_owed"), F.array_contains(order, "city")), lambda x: F.filter(F.array(*[F.struct(F.lit(k).alias("key"), x[k].alias("value")) for k in ("city", "street", "house", "flat")]), lambda y: y["value"].isNotNull()))
    has_parts = F.coalesce(F.size("_parts") > 0, F.lit(False))
    cut = F.when(F.col("_type") == "NAME", rewrite.cut_name(F.col("_owed"), order)).otherwise(F.map_from_entries(fields))
    both = both.withColumns({"_has": has_parts, "_cut": F.when(has_parts, cut), "_got": F.when(has_parts, F.from_json("delivered", "map<string,string>"))})
    both = both.withColumn("_by", F.when(F.col("_has") & F.col("_got").isNotNull(), judge.parts_verdict(order, F.col("_got"), F.col("_cut"), pivot)))
    again = F.col("round_trip").isNotNull() & F.col("delivered").isNotNull() & F.col("_canonical").isNotNull() & (~F.col("_has") | F.col("_by").isNotNull())
    whole = F.coalesce(text.same_delivered(F.col("delivered"), F.col("_owed")), F.lit(False))
    both = both.withColumns({"_again": again, "_rt": F.when(again & F.col("_has"), F.col("_by.round_trip")).when(again, whole).otherwise(F.col("round_trip"))})
    mended = judge.repaired(F.col("_rt"), F.col("delivered"), F.col("_owed"), pivot)
    both = both.withColumn("_n", F.when(F.col("_again") & F.col("_has"), F.col("_by.normalised")).when(F.col("_again"), mended).otherwise(F.col("normalised")))
    return both.select(*[F.col("_rt").alias(c) if c == "round_trip" else F.col("_n").alias(c) if c == "normalised" else F.col(c) for c in items.columns])


def rejudge_cases(cases: DataFrame, items: DataFrame, *keys: str) -> DataFrame:
    """cases with consistency by the current judge: of the first two mentions of a person by name, if one of them was altered.

    items: the same runs' items; keys tell runs apart. Where nothing can be judged, the recorded verdict stays; of
    several persons the last one's counts.
    """
    on = [*keys, "case_id"]
    mention = F.struct(F.length("item_id").alias("n"), "item_id", "altered", "substitute")
    people = items.where("type = 'NAME' AND family = 'second_mention'").groupBy(*on, "identity").agg(F.sort_array(F.collect_list(mention)).alias("m")).where(F.size("m") > 1)
    a, b = F.col("m")[0], F.col("m")[1]
    judged = people.withColumn("again", judge.consistency(a["altered"], b["altered"], a["substitute"], b["substitute"])).where("again IS NOT NULL")
    last = judged.groupBy(*on).agg(F.max_by("again", F.struct(F.col("m")[1]["n"], F.col("m")[1]["item_id"])).alias("again"))
    out = cases.join(last, on, "left")
    return out.select(*[F.coalesce("again", "consistency").alias(c) if c == "consistency" else F.col(c) for c in cases.columns])


def rescored(run: DataFrame, cases: DataFrame) -> DataFrame:
    """A run file's row anew, its verdicts and lines by the current judge, and marked as such. run: one row; cases: the corpus."""
    meta = run.select("manifest").first()["manifest"].asDict(recursive=True)
    items = rejudge(src.item_observations(run), src.gold_items(cases), meta.get("policy") or "copier")
    return run_file(items, src.negative_observations(run), rejudge_cases(src.case_observations(run), items), meta, rescored_by=VERSION)


def latest(runs: DataFrame, *keys: str) -> DataFrame:
    """The newest row per keys by run_at; of equals the first by path."""
    w = Window.partitionBy(*keys).orderBy(F.desc("run_at"), "path")
    return runs.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def newest_runs(runs: DataFrame) -> DataFrame:
    """The rows of the latest run of each system and agent, its manifest's fields as columns.

    A run is one row, or several with one path: pieces that part its observations and repeat the rest. A run is chosen among
    the heads, so that observations are never exchanged or sorted for it.
    """
    policy = F.coalesce("manifest.policy", F.lit("copier")).alias("policy")
    flat = runs.select("manifest.system", policy, "manifest.run_at", "manifest.corpus_digest", "manifest.notes", F.try_element_at("manifest.adapter_config", F.lit("caveat")).alias("caveat"), "path", "observations", F.col("run.errors").alias("errors"))
    head = ("system", "policy", "run_at", "path")
    newest = latest(flat.select(*head).distinct(), "system", "policy").select(*[F.col(c).alias(f"_{c}") for c in head])
    # as many rows as the board has
    return flat.join(F.broadcast(newest), reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in head]), "leftsemi")


def board(runs: DataFrame, digest: str, gold: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, pairs, stale) of run files: the latest run of each system and agent, re-judged and scored.

    lines: (policy, system, line, hits, total, rate, low, high, certifies). pairs: McNemar between copier runs on leak and
    end_to_end. stale: runs over another corpus.
    """
    current = newest_runs(runs).where(F.col("corpus_digest") == digest)
    keys = ("policy", "system")
    items, negs, cases = src.item_observations(current, *keys), src.negative_observations(current, *keys), src.case_observations(current, *keys)
    if gold is not None:
        cases = rejudge_cases(cases, items, *keys)  # needs what is recorded of items, not their verdicts
        items = rejudge(items, gold, F.col("policy"))
    lines = score.with_intervals(score.lines(items, negs, cases, keys))
    copier = items.where("policy = 'copier'")
    outcome = copier.select("system", "case_id", "item_id", F.explode(F.array(F.struct(F.lit("leak").alias("line"), F.col("altered").alias("ok")), F.struct(F.lit("end_to_end").alias("line"), F.col("round_trip").alias("ok")))).alias("o")).select("system", "case_id", "item_id", "o.line", "o.ok").where("ok IS NOT NULL")
    a, b = outcome.alias("a"), outcome.alias("b")
    same = (F.col("a.case_id") == F.col("b.case_id")) & (F.col("a.item_id") == F.col("b.item_id")) & (F.col("a.line") == F.col("b.line")) & (F.col("a.system") < F.col("b.system"))
    pairs = a.join(b, same).groupBy(F.col("a.system").alias("left"), F.col("b.system").alias("right"), F.col("a.line").alias("line")).agg(F.count_if(F.col("a.ok") & ~F.col("b.ok")).alias("b"), F.count_if(F.col("b.ok") & ~F.col("a.ok")).alias("c"), F.count("*").alias("shared"))
    stale = newest_runs(runs).where(~F.col("corpus_digest").eqNullSafe(digest))
    return lines, score.with_p(pairs), stale.select("system", "policy", "corpus_digest", "run_at").distinct()


def cell(line: str = "") -> Column:
    """rate [low-high] hits/total, or a dash where nothing was measured."""
    shown = F.format_string("%.1f%% [%.0f–%.0f] %d/%d", F.col("rate") * 100, F.col("low") * 100, F.col("high") * 100, F.col("hits"), F.col("total"))
    return F.when(F.col("total") > 0, shown).otherwise("—")


COLUMNS = ("leak", "coverage", "round_trip", "round_trip_repaired", "end_to_end", "overmask", "consistency")
AGENTS = {
    "copier": "The agent passes on what it was shown, letter by letter.",
    "rewriter": "The agent writes each value in its own notation; it is owed the original in that notation.",
    "reformat": "The agent writes phones in another format.",
}


def _table(head: list[str], rows: list[list[str]]) -> list[str]:
    return ["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *["| " + " | ".join(r) + " |" for r in rows], ""]


def markdown(lines: DataFrame, errors: dict[tuple[str, str], int] | None = None) -> str:
    """A table per agent; the driver gets one row per system and agent. errors: by (policy, system), for a last column."""
    wide = lines.withColumn("cell", cell()).groupBy("policy", "system").pivot("line", list(COLUMNS)).agg(F.first("cell"))
    order = F.array_position(F.array(*[F.lit(p) for p in POLICY_ORDER]), F.col("policy"))
    rows = wide.orderBy(F.when(order == 0, 99).otherwise(order), "system").collect()
    out: list[str] = []
    for policy in dict.fromkeys(r["policy"] for r in rows):
        own = [[r["system"], *[r[c] or "—" for c in COLUMNS], *([str(errors.get((policy, r["system"]), 0))] if errors is not None else [])] for r in rows if r["policy"] == policy]
        note = [AGENTS[policy], ""] if errors is not None and policy in AGENTS else []
        out += [f"## {policy}", "", *note, *_table(["system", *COLUMNS, *(["errors"] if errors is not None else [])], own)]
    return "\n".join(out)


def leaderboard(runs: DataFrame, cases: DataFrame) -> str:
    """The whole board as text: tables, pairs, caveats of the runs, and runs over another corpus. Few rows reach the driver."""
    digest, total = corpus_digest(cases).first()["digest"], cases.count()
    lines, pairs, stale = board(runs, digest, src.gold_items(cases))
    newest = newest_runs(runs).select("policy", "system", "corpus_digest", "caveat", "notes", "errors").distinct().orderBy("system", "policy").collect()
    current = [r for r in newest if r["corpus_digest"] == digest]
    out = ["# Leaderboard", "", f"Corpus `{digest}`, {total} cases. In brackets: exact 95 % intervals. Columns do not add up to one score. All lines are judged anew by the present judge.", ""]
    out.append(markdown(lines, {(r["policy"], r["system"]): r["errors"] or 0 for r in current}))
    if found := pairs.where("shared > 0").orderBy("left", "right", "line").collect():
        out += ["## Pairs (exact McNemar test)", "", *_table(["pair", "line", "b", "c", "p"], [[f"{r['left']} / {r['right']}", r["line"], str(r["b"]), str(r["c"]), f"{r['p']:.3f}"] for r in found])]
    if told := [f"- **{r['system']}** ({r['policy']}): {r['caveat'] or r['notes'].strip()}" for r in current if r["caveat"] or (r["notes"] or "").strip()]:
        out += ["## Caveats", "", *told, ""]
    if old := stale.orderBy("system", "policy").collect():
        out += ["## Runs over another corpus", "", *[f"- {r['system']}: corpus `{r['corpus_digest']}`, run at {r['run_at']}" for r in old], ""]
    return "\n".join(out)


def report(spark: SparkSession, items: DataFrame, negatives: DataFrame, cases: DataFrame) -> str:
    """The lines, and each axis with more than one group, as text."""
    out = [f"{r['line']}: {r['c']}" + (f"  certifies {r['certifies']:.1%}" if r["certifies"] is not None else "") for r in score.with_intervals(score.lines(items, negatives, cases)).withColumn("c", cell()).orderBy("line").collect()]
    axes = {"register": "register", "tier": "tier", "cue": F.when(F.col("cue"), "cued").otherwise("no cue"), "family": "family"}
    parts = score.with_intervals(score.by_axis(items, axes)).withColumn("c", cell()).orderBy("axis", "key", "line").collect()
    for axis in axes:
        own = [r for r in parts if r["axis"] == axis]
        if len({r["key"] for r in own}) > 1:
            out += [f"-- {axis}", *[f"{r['key']} {r['line']}: {r['c']}" for r in own]]
    return "\n".join(out)
