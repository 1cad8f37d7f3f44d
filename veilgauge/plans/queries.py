"""Registered queries of the evaluation engine over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import identifiers, persons, rewrite, stats, text
from ..operators import detect, gates, judge, score
from ..session import shared_path, spread
from ..sources import cases as src
from ..sources import pools
from ..sources.pools import SMALL
from . import corpus, documents, evaluate, results, surface

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


# --- SQL of detection ------------------------------------------------------------------


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_N = lambda x: f"trim(regexp_replace(translate(lower({x}), 'ё', 'е'), '\\s+', ' ', 'g'))"
_D = lambda x: f"regexp_replace({x}, '[^0-9]', '', 'g')"
_NUM = lambda x: f"regexp_matches(regexp_replace({x}, '[ \\-()+.,\\t ]', '', 'g'), '^[0-9]+$')"


def sql_claims(name: str, patterns: tuple, table: str = "documents", column: str = "text") -> str:
    """CTEs that end in {name}(doc_id, rank, type, value, start, end): candidates pattern by pattern, those that overlap earlier claims dropped."""
    out = []
    for k, (kind, pattern) in enumerate(patterns):
        p = _quoted(pattern)
        out.append(f"{name}_m{k} AS (SELECT doc_id, regexp_extract_all({column}, {p}) AS m, regexp_split_to_array({column}, {p}) AS g FROM {table} WHERE regexp_matches({column}, {p}))")
        out.append(f"{name}_i{k} AS (SELECT doc_id, m, g, unnest(generate_series(1, len(m))) AS i FROM {name}_m{k})")
        out.append(f"{name}_s{k} AS (SELECT doc_id, m[i] AS value, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::INTEGER AS s FROM {name}_i{k})")
        before = " UNION ALL ".join(f"SELECT * FROM {name}_c{j}" for j in range(k))
        free = f" WHERE NOT EXISTS (SELECT 1 FROM ({before}) c WHERE c.doc_id = x.doc_id AND x.s + length(x.value) > c.start AND x.s < c.\"end\")" if before else ""
        out.append(f"{name}_c{k} AS (SELECT doc_id, {k} AS rank, {_quoted(kind)} AS type, value, s AS start, (s + length(value))::INTEGER AS \"end\" FROM {name}_s{k} x{free})")
    out.append(f"{name} AS (" + " UNION ALL ".join(f"SELECT * FROM {name}_c{k}" for k in range(len(patterns))) + ")")
    return ",\n".join(out)


def sql_vault(name: str, claims: str) -> str:
    """CTE name(doc_id, type, n, token, value, k): k is the place in the order of the claims."""
    return f"""{name}_f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, value ORDER BY rank, start) AS r FROM {claims}) WHERE r = 1),
{name} AS (SELECT doc_id, type, row_number() OVER (PARTITION BY doc_id, type ORDER BY rank, start) AS n,
  '<' || type || '_' || row_number() OVER (PARTITION BY doc_id, type ORDER BY rank, start) || '>' AS token, value,
  row_number() OVER (PARTITION BY doc_id ORDER BY rank, start) AS k FROM {name}_f)"""


def sql_fold(name: str, table: str, column: str, vault: str, old: str, new: str) -> str:
    """CTE name(doc_id, t): column with each vault entry's old replaced by its new, in order."""
    return f"""{name}_r AS (SELECT doc_id, 0::BIGINT AS k, {column} AS t FROM {table}
  UNION ALL SELECT r.doc_id, v.k, replace(r.t, v.{old}, v.{new}) FROM {name}_r r JOIN {vault} v ON v.doc_id = r.doc_id AND v.k = r.k + 1),
{name} AS (SELECT doc_id, arg_max(t, k) AS t FROM {name}_r GROUP BY doc_id)"""


_GOLD = sql_claims("g", documents.GOLD)
_RU = sql_claims("c", detect.RUSSIAN)
_MASKED = f"{_RU},\n{sql_vault('v', 'c')},\n{sql_fold('masked', 'documents', 'text', 'v', 'value', 'token')}"
_LUHN = "list_sum(list_transform(generate_series(1, length(d)), lambda i: CASE WHEN (length(d) - i) % 2 = 1 THEN (substr(d, i, 1)::INT * 2) // 10 + (substr(d, i, 1)::INT * 2) % 10 ELSE substr(d, i, 1)::INT END)) % 10 = 0"
_ITEMS = f"""{_GOLD},
gold AS (SELECT *, regexp_replace(value, '[^0-9]', '', 'g') AS d FROM g),
items AS (SELECT o.doc_id, o.lang, o.source, x.start, x."end", x.type, x.value, x.type = 'IP' OR (x.type = 'CARD' AND NOT ({_LUHN})) AS negative FROM gold x JOIN documents o USING (doc_id))"""


def _observed(name: str, claims: str) -> str:
    return f"""{name} AS (SELECT i.doc_id, i.lang, i.source, i.start, i.type, i.negative, count(c.start) > 0 AS altered,
  coalesce(bool_or(c.start <= i.start AND c."end" >= i."end"), false) AS covered, arg_min(c.type, c.start) AS typed_as
  FROM items i LEFT JOIN {claims} c ON c.doc_id = i.doc_id AND c.start < i."end" AND i.start < c."end" GROUP BY ALL)"""


_OBS = f"{_ITEMS},\n{_RU},\n{_observed('obs', 'c')}"


def _sql_lines(keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    g = f" GROUP BY {keys}" if keys else ""
    part = lambda name, hits, total: f"SELECT {k}'{name}' AS line, {hits}::BIGINT AS hits, {total}::BIGINT AS total FROM pos{g}"
    return " UNION ALL ".join(
        [
            part("leak", "count(*) FILTER (altered)", "count(*)"),
            part("coverage", "count(*) FILTER (covered)", "count(*)"),
            f"SELECT * FROM ({part('typed', 'count(*) FILTER (typed_as = type)', 'count(typed_as)')}) WHERE total > 0",
            part("round_trip", "count(*) FILTER (altered)", "count(*) FILTER (altered)"),
            part("round_trip_repaired", "count(*) FILTER (altered)", "count(*) FILTER (altered)"),
            part("end_to_end", "count(*)", "count(*)"),
        ]
    )


# --- detection and masking ----------------------------------------------------------------


@query(f"WITH {_GOLD} SELECT lang, type, count(*) AS spans, count(DISTINCT doc_id) AS docs FROM g JOIN documents USING (doc_id) GROUP BY lang, type")
def detect_counts_by_lang(spark, sf_dir):
    found = documents.gold(_docs(spark, sf_dir))
    return found.groupBy("lang", "type").agg(F.count("*").alias("spans"), F.countDistinct("doc_id").alias("docs"))


@query(f'WITH {_RU} SELECT doc_id, start, "end", type, value, rank FROM c')
def detect_spans(spark, sf_dir):
    return documents.masker_spans(_docs(spark, sf_dir), detect.RUSSIAN)


@query(f"WITH RECURSIVE {_MASKED} SELECT doc_id, md5(t) AS masked_md5, length(t) AS masked_chars FROM masked")
def mask_documents(spark, sf_dir):
    d = detect.detect(_docs(spark, sf_dir), "text")
    return d.withColumn("t", detect.mask_everywhere(F.col("text"), F.col("vault"))).select("doc_id", F.md5(F.col("t").cast("binary")).alias("masked_md5"), F.length("t").cast("long").alias("masked_chars"))


@query(f"WITH RECURSIVE {_MASKED},\n{sql_claims('a', detect.RUSSIAN, 'masked', 't')}\nSELECT coalesce(c.type, a.type) AS type, coalesce(c.n, 0) AS before, coalesce(a.n, 0) AS after FROM (SELECT type, count(*) AS n FROM c GROUP BY type) c FULL JOIN (SELECT type, count(*) AS n FROM a GROUP BY type) a ON a.type = c.type")
def residual_leak(spark, sf_dir):
    d = detect.detect(_docs(spark, sf_dir), "text").withColumn("t", detect.mask_everywhere(F.col("text"), F.col("vault")))
    # a text without claims is its masked text
    after = F.when(F.size("claims") > 0, detect.claims(F.col("t"))).otherwise(F.col("claims"))
    both = d.select(F.explode(F.concat(F.transform("claims", lambda c: F.struct(c["type"].alias("type"), F.lit(1).alias("b"), F.lit(0).alias("a"))), F.transform(after, lambda c: F.struct(c["type"].alias("type"), F.lit(0).alias("b"), F.lit(1).alias("a"))))).alias("x"))
    return both.groupBy("x.type").agg(F.sum("x.b").alias("before"), F.sum("x.a").alias("after"))


@query(f"WITH {_RU},\n{sql_vault('v', 'c')} SELECT doc_id, type, n, token, value FROM v")
def vault_numbering(spark, sf_dir):
    found = documents.masker_spans(_docs(spark, sf_dir), detect.RUSSIAN)
    out = detect.conversation_vault(found, "doc_id", "rank", "start")
    return out.withColumn("n", F.col("n").cast("long"))


@query(f"WITH RECURSIVE {_MASKED},\n{sql_fold('restored', 'masked', 't', 'v', 'token', 'value')} SELECT lang, count(*) AS docs, count(*) FILTER (r.t = d.text) AS restored FROM restored r JOIN documents d USING (doc_id) GROUP BY lang")
def restore_roundtrip(spark, sf_dir):
    d = detect.detect(_docs(spark, sf_dir), "text")
    d = d.withColumn("r", detect.restore(detect.mask_everywhere(F.col("text"), F.col("vault")), F.col("vault")))
    return d.groupBy("lang").agg(F.count("*").alias("docs"), F.count_if(F.col("r") == F.col("text")).alias("restored"))


@query(f"WITH {_GOLD}, x AS (SELECT value, regexp_replace(value, '[^0-9]', '', 'g') AS d, count(*) AS n FROM g WHERE type = 'CARD' GROUP BY value) SELECT value, n, {_LUHN} AS valid FROM x")
def luhn_of_card_runs(spark, sf_dir):
    found = documents.gold(_docs(spark, sf_dir)).where("type = 'CARD'").groupBy("value").agg(F.count("*").alias("n"))
    return found.withColumn("valid", identifiers.luhn_ok(F.regexp_replace("value", "[^0-9]", "")))


@query(f'WITH {_OBS} SELECT doc_id, start, type, altered, typed_as FROM obs')
def interval_overlap_join(spark, sf_dir):
    """Gold spans met by the masker's: both are of one text, so that the overlap is found in the row."""
    return _obs(spark, sf_dir).select("doc_id", "start", "type", "altered", "typed_as")


_OVERLAP_SQL = ",\n".join(sql_claims(f"z{k}", (p,)) for k, p in enumerate(detect.RUSSIAN))


@query(f'WITH {_OVERLAP_SQL}, every AS ({" UNION ALL ".join(f"SELECT * FROM z{k}" for k in range(len(detect.RUSSIAN)))}), n AS (SELECT doc_id, type AS label, start, "end", lead(start) OVER w AS next_start, lead(type) OVER w AS next_label FROM every WINDOW w AS (PARTITION BY doc_id ORDER BY start, "end", type)) SELECT doc_id, label, start, next_label, next_start FROM n WHERE next_start < "end"')
def overlap_defects(spark, sf_dir):
    raw = F.concat(*[detect.matches(F.col("text"), kind, p, k) for k, (kind, p) in enumerate(detect.RUSSIAN)])
    every = detect.span_rows(_docs(spark, sf_dir).withColumn("spans", raw), "doc_id").withColumnRenamed("type", "label")
    return gates.overlapping(every, "doc_id").select("doc_id", "label", "start", "next_label", "next_start")


# --- scores --------------------------------------------------------------------------------


def _obs(spark, sf_dir, patterns=detect.RUSSIAN):
    return documents.observations(_docs(spark, sf_dir), patterns)


@query(f"WITH {_OBS}, pos AS (SELECT * FROM obs WHERE NOT negative) {_sql_lines()} UNION ALL SELECT 'overmask', count(*) FILTER (NOT altered), count(*) FROM obs WHERE negative")
def score_lines(spark, sf_dir):
    return score.lines_in_one(_obs(spark, sf_dir))


@query(f"WITH {_ITEMS}, pos AS (SELECT *, false AS altered, false AS covered, NULL::VARCHAR AS typed_as FROM items WHERE NOT negative) {_sql_lines()} UNION ALL SELECT 'overmask', count(*), count(*) FROM items WHERE negative")
def score_lines_identity(spark, sf_dir):
    """The identity masker leaks nothing, delivers everything, touches nothing."""
    return score.lines_in_one(_obs(spark, sf_dir, (("NOTHING", r"\x00never"),)))


@query(f"WITH {_OBS}, pos AS (SELECT 'lang' AS axis, lang AS key, * FROM obs WHERE NOT negative UNION ALL SELECT 'source', source, * FROM obs WHERE NOT negative) {_sql_lines('axis, key')}")
def strata_by_axis(spark, sf_dir):
    return score.by_axis(_obs(spark, sf_dir).where("NOT negative"), {"lang": "lang", "source": "source"})


#: Bisection on the binomial tails, 80 steps, as a recursive CTE over t(key, hits, total).
_CP = """b AS (
  SELECT *, 0 AS step, 0.0::DOUBLE AS la, 1.0::DOUBLE AS lb, 0.0::DOUBLE AS ha, 1.0::DOUBLE AS hb FROM t
  UNION ALL
  SELECT key, hits, total, step + 1,
    CASE WHEN up < 0.025 THEN (la + lb) / 2 ELSE la END, CASE WHEN up < 0.025 THEN lb ELSE (la + lb) / 2 END,
    CASE WHEN down < 0.025 THEN ha ELSE (ha + hb) / 2 END, CASE WHEN down < 0.025 THEN (ha + hb) / 2 ELSE hb END
  FROM (SELECT *,
      list_sum(list_transform(generate_series(hits, total), lambda i: exp(lgamma(total + 1) - lgamma(i + 1) - lgamma(total - i + 1) + i * ln((la + lb) / 2) + (total - i) * ln(1 - (la + lb) / 2)))) AS up,
      list_sum(list_transform(generate_series(0, hits), lambda i: exp(lgamma(total + 1) - lgamma(i + 1) - lgamma(total - i + 1) + i * ln((ha + hb) / 2) + (total - i) * ln(1 - (ha + hb) / 2)))) AS down
    FROM b WHERE step < 45)
)
SELECT key, hits, total, round(CASE WHEN hits = 0 THEN 0 ELSE (la + lb) / 2 END, 6) AS low, round(CASE WHEN hits = total THEN 1 ELSE (ha + hb) / 2 END, 6) AS high,
  CASE WHEN hits = total THEN round(pow(0.05, 1.0 / total), 6) END AS certifies FROM b WHERE step = 45"""


@query(f"WITH RECURSIVE {_OBS}, t AS (SELECT source AS key, count(*) FILTER (altered)::BIGINT AS hits, count(*)::BIGINT AS total FROM obs WHERE NOT negative GROUP BY source), {_CP}")
def interval_by_source(spark, sf_dir):
    o = _obs(spark, sf_dir).where("NOT negative")
    found = score.with_intervals(o.groupBy(F.col("source").alias("key")).agg(F.count_if("altered").alias("hits"), F.count("*").alias("total")))
    return found.select("key", "hits", "total", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), F.round("certifies", 6).alias("certifies"))


_BOTH = detect.FOREIGN + detect.RUSSIAN


@query(f"WITH {_OBS}, {sql_claims('e', _BOTH)}, {_observed('obs2', 'e')}, p AS (SELECT x.altered AS l, y.altered AS r FROM obs x JOIN obs2 y USING (doc_id, start) WHERE NOT x.negative) SELECT count(*) FILTER (l AND NOT r) AS b, count(*) FILTER (r AND NOT l) AS c, count(*) AS shared FROM p")
def paired_detectors(spark, sf_dir):
    both = documents.paired(_docs(spark, sf_dir), detect.RUSSIAN, _BOTH)
    return both.agg(F.count_if(F.col("left") & ~F.col("right")).alias("b"), F.count_if(F.col("right") & ~F.col("left")).alias("c"), F.count("*").alias("shared"))


@query("WITH p(b, c) AS (VALUES (0, 0), (5, 5), (10, 0), (3, 9), (1, 14), (40, 22)) SELECT b, c, round(least(1.0, CASE WHEN b + c = 0 THEN 1.0 ELSE 2 * list_sum(list_transform(generate_series(0, least(b, c)), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2)))) END), 9) AS p FROM p")
def mcnemar_values(spark, sf_dir):
    pairs = spark.createDataFrame([(0, 0), (5, 5), (10, 0), (3, 9), (1, 14), (40, 22)], "b int, c int")
    return pairs.withColumn("p", F.round(stats.mcnemar_column(F.col("b"), F.col("c")), 9))


# --- conversations ---------------------------------------------------------------------------


def _transcripts(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return rows.select(F.col("conv_id").alias("id"), F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


@query("SELECT conv_id AS id, max(i)::INTEGER AS last_user, count(*)::INTEGER AS user_turns FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i FROM conversations) WHERE role = 'user' GROUP BY conv_id")
def last_user_turn(spark, sf_dir):
    t = _transcripts(spark, sf_dir)
    return t.select("id", src.last_user_turn("messages").alias("last_user"), F.size(src.user_turns("messages")).alias("user_turns")).where("user_turns > 0")


@query("WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i FROM conversations) SELECT r.conv_id AS id, r.i::INTEGER AS request_turn, count(*)::INTEGER AS shown, sum(length(m.text))::BIGINT AS chars FROM n r JOIN n m ON m.conv_id = r.conv_id AND m.i <= r.i WHERE r.role = 'user' GROUP BY r.conv_id, r.i")
def transcript_prefixes(spark, sf_dir):
    p = src.prefixes(_transcripts(spark, sf_dir))
    chars = F.aggregate("prefix", F.lit(0).cast("long"), lambda a, m: a + F.length(m["content"]))
    return p.select("id", "request_turn", F.size("prefix").alias("shown"), chars.alias("chars"))


@query("WITH u AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM conversations), h AS (SELECT conv_id::VARCHAR AS id, conv_id || coalesce(string_agg(CASE WHEN role = 'user' THEN text END, '' ORDER BY i), '') AS t FROM u GROUP BY conv_id) SELECT substr(sha256(string_agg(t, '' ORDER BY id)), 1, 16) AS digest FROM h")
def corpus_digest(spark, sf_dir):
    return results.corpus_digest(_transcripts(spark, sf_dir))


@query("SELECT substr(sha1(text), 1, 10) AS digest, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_content(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumn("digest", results.content_digest(F.array("text")))
    return d.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@query("WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM conversations), f AS (SELECT conv_id, role, first_value(text) OVER (PARTITION BY conv_id, role ORDER BY i) AS f, text, i, min(i) OVER (PARTITION BY conv_id, role) AS fi FROM n) SELECT conv_id, role, bool_and(f = text) AS stable FROM f WHERE i > fi GROUP BY conv_id, role")
def first_against_later(spark, sf_dir):
    """Whether each role's later texts equal its first; as the stability verdict compares substitutes. Null (no row) where there is no later one."""
    n = _table(spark, sf_dir, "conversations").withColumn("i", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")))
    w = Window.partitionBy("conv_id", "role").orderBy("i")
    f = n.withColumns({"f": F.first("text").over(w), "k": F.row_number().over(w)})
    return f.where("k > 1").groupBy("conv_id", "role").agg(F.bool_and(F.col("f") == F.col("text")).alias("stable"))


# --- stored runs -------------------------------------------------------------------------------


@query("SELECT system, policy, run_at, path FROM (SELECT event_type AS system, (user_id % 3)::BIGINT AS policy, ts AS run_at, event_id AS path, row_number() OVER (PARTITION BY event_type, user_id % 3 ORDER BY ts DESC, event_id) AS r FROM events) WHERE r = 1")
def latest_run_per_system(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select(F.col("event_type").alias("system"), (F.col("user_id") % 3).alias("policy"), F.col("ts").alias("run_at"), F.col("event_id").alias("path"))
    return results.latest(e, "system", "policy")


def _phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.format_string("8-907-%07d", "c_custkey").alias("c_phone"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored runs of four systems over the customers as cases, a NAME and a PHONE each; what came back depends on the key.

    A run comes in pieces of a case each: as one row it would have to fit a task's memory.
    """
    c = spread(_phones(spark, sf_dir))
    k = F.col("c_custkey")
    systems = F.array(*[F.struct(F.lit(n).alias("system"), F.lit(i).alias("s")) for i, n in enumerate("ABCD", 2)])
    c = c.select("*", F.explode(systems).alias("y")).select("*", "y.system", "y.s")
    altered = (k * 7 + F.col("s")) % F.col("s") != 0

    def item(n: int, kind: str, identity: str, hit, substitute, delivered, verdict):
        values = {"case_id": k.cast("string"), "item_id": F.lit(f"p{n}"), "type": F.lit(kind), "register": F.lit("clean"), "family": F.lit("second_mention"), "identity": F.lit(identity), "turn": F.lit(n), "tool_param": F.lit(kind.lower()), "altered": hit, "covered": hit, "substitute": substitute, "delivered": delivered, "round_trip": verdict, "normalised": F.lit(False), "shared_block": F.lit(False)}
        return F.struct(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.ITEM_OBS.fields])

    phone = F.when(k % 4 == 0, F.col("c_phone")).when(k % 4 == 1, F.translate("c_phone", "-", " ")).when(k % 4 == 2, F.concat("c_phone", F.lit("1")))
    again = F.when(k % 3 == 0, F.upper("c_name")).when(k % 3 == 1, F.concat(F.lit("  "), F.col("c_name"))).otherwise(F.lit("<NAME_9>"))
    items = F.array(item(1, "NAME", "person1", altered, F.col("c_name"), F.lit(None), F.lit(None)), item(2, "NAME", "person1", (k + F.col("s")) % 2 == 0, again, F.lit(None), F.lit(None)), item(3, "PHONE", "person1", altered, F.lit("<PHONE_1>"), phone, (k + F.col("s")) % 3 == 0))
    case = {"case_id": k.cast("string"), "family": F.lit("second_mention"), "register": F.lit("clean"), "call_made": F.lit(True), "arguments_parse": F.lit(True), "rewrite_ratio": F.lit(0.0), "hard": F.lit(False), "consistency": k % 5 == 0, "items": items}
    each = c.select("system", F.array(F.struct(*[case.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.CASE_OBS.fields])).alias("observations"))
    head = {"system": F.col("system"), "policy": F.lit("copier"), "run_at": F.lit("2026-01-01"), "corpus_digest": F.when(F.col("system") == "D", "old").otherwise("now")}
    manifest = F.struct(*[head.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.MANIFEST.fields])
    run = F.struct(*[F.lit(0).cast(f.dataType).alias(f.name) for f in schema.RUN.fields])
    return each.select(manifest.alias("manifest"), run.alias("run"), "observations", F.lit("").alias("path"))


def _gold_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("map<string,string>")
    return _phones(spark, sf_dir).select(F.col("c_custkey").cast("string").alias("case_id"), F.lit("p3").alias("item_id"), F.lit("PHONE").alias("type"), F.col("c_phone").alias("canonical"), none.alias("parts"))


_RUN_SQL = """r AS (SELECT c_custkey AS k, c_name, '8-907-' || lpad(c_custkey::VARCHAR, 7, '0') AS c_phone, unnest([2, 3, 4, 5]) AS s FROM customer),
it AS (SELECT *, chr((63 + s)::INTEGER) AS system, (k * 7 + s) % s <> 0 AS altered, (k + s) % 2 = 0 AS second, (k + s) % 3 = 0 AS recorded,
  CASE k % 4 WHEN 0 THEN c_phone WHEN 1 THEN replace(c_phone, '-', ' ') WHEN 2 THEN c_phone || '1' END AS delivered,
  CASE k % 3 WHEN 0 THEN upper(c_name) WHEN 1 THEN '  ' || c_name ELSE '<NAME_9>' END AS again FROM r)"""
_JUDGED = f"CASE WHEN delivered IS NULL THEN recorded ELSE right({_D('delivered')}, 10) = right({_D('c_phone')}, 10) END"


@query(f"WITH {_RUN_SQL} SELECT system, k::VARCHAR AS case_id, {_JUDGED} AS round_trip, false AS normalised FROM it")
def rejudge_items(spark, sf_dir):
    """Stored verdicts on phones, judged anew: what was delivered decides, and where nothing was, the record stays."""
    items = src.item_observations(_runs(spark, sf_dir), "manifest.system").where("type = 'PHONE'")
    return results.rejudge(items, _gold_phones(spark, sf_dir)).select("system", "case_id", "round_trip", "normalised")


@query(f"WITH {_RUN_SQL} SELECT system, k::VARCHAR AS case_id, CASE WHEN altered OR second THEN altered AND second AND lower(trim(again)) = lower(c_name) ELSE k % 5 = 0 END AS consistency FROM it")
def rejudge_consistency(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    cases, items = src.case_observations(runs, "manifest.system"), src.item_observations(runs, "manifest.system")
    return results.rejudge_cases(cases, items, "system").select("system", "case_id", "consistency")


_MCNEMAR = "round(least(1.0, CASE WHEN b + c = 0 THEN 1.0 ELSE 2 * list_sum(list_transform(generate_series(0::BIGINT, least(b, c)), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2)))) END), 6)"


@query(
    f"WITH {_RUN_SQL}, o AS (SELECT system, k, 'leak' AS line, 1 AS n, altered AS ok FROM it UNION ALL SELECT system, k, 'leak', 2, second FROM it UNION ALL SELECT system, k, 'leak', 3, altered FROM it "
    f"UNION ALL SELECT system, k, 'end_to_end', 3, {_JUDGED} FROM it), p AS (SELECT a.system AS \"left\", b.system AS \"right\", a.line, count(*) FILTER (a.ok AND NOT b.ok) AS b, count(*) FILTER (b.ok AND NOT a.ok) AS c, count(*) AS shared "
    f"FROM o a JOIN o b ON a.k = b.k AND a.line = b.line AND a.n = b.n AND a.system < b.system WHERE b.system <> 'D' GROUP BY ALL) SELECT \"left\", \"right\", line, b, c, shared, {_MCNEMAR} AS p FROM p"
)
def board_pairs(spark, sf_dir):
    """McNemar between the systems of a board; the run over another corpus takes no part."""
    _, pairs, _ = results.board(_runs(spark, sf_dir), "now", _gold_phones(spark, sf_dir))
    return pairs.withColumn("p", F.round("p", 6))


_LINES_SQL = f"""i AS (SELECT system, altered AS hit, NULL::BOOLEAN AS ok FROM it UNION ALL SELECT system, second, NULL FROM it UNION ALL SELECT system, altered, {_JUDGED} FROM it),
k AS (SELECT system, CASE WHEN altered OR second THEN altered AND second AND lower(trim(again)) = lower(c_name) ELSE k % 5 = 0 END AS same FROM it)"""


@query(
    f"WITH {_RUN_SQL}, {_LINES_SQL} SELECT * FROM (SELECT system, 'leak' AS line, count(*) FILTER (hit) AS hits, count(*) AS total FROM i GROUP BY 1 UNION ALL SELECT system, 'round_trip', count(*) FILTER (ok), count(*) FROM i WHERE hit AND ok IS NOT NULL GROUP BY 1 "
    "UNION ALL SELECT system, 'end_to_end', count(*) FILTER (ok), count(*) FROM i WHERE ok IS NOT NULL GROUP BY 1 UNION ALL SELECT system, 'consistency', count(*) FILTER (same), count(*) FROM k GROUP BY 1) WHERE system <> 'D'"
)
def board_lines(spark, sf_dir):
    lines, _, _ = results.board(_runs(spark, sf_dir), "now", _gold_phones(spark, sf_dir))
    return lines.where("line IN ('leak', 'round_trip', 'end_to_end', 'consistency')").select("system", "line", "hits", "total")


@query("SELECT doc_id, lang, 'only_left' AS side FROM (SELECT doc_id, lang FROM documents EXCEPT ALL SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'xx' ELSE lang END FROM documents WHERE doc_id % 11 <> 0) UNION ALL SELECT doc_id, lang, 'only_right' FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'xx' ELSE lang END AS lang FROM documents WHERE doc_id % 11 <> 0 EXCEPT ALL SELECT doc_id, lang FROM documents)")
def tree_diff(spark, sf_dir):
    left = _table(spark, sf_dir, "documents").select("doc_id", "lang")
    right = left.where("doc_id % 11 <> 0").withColumn("lang", F.when(F.col("doc_id") % 7 == 0, "xx").otherwise(F.col("lang")))
    return src.tree_diff(left, right)


@query("SELECT event_id, json_extract_string(props, '$.' || k) AS value, k AS key FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def arguments_as_map(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("event_id", F.explode(detect.arguments(F.col("props"))))
    return e.select("event_id", "value", "key")


# --- functions over inline values ------------------------------------------------------------------

_PAIRS = [
    ("+7 907 123-45-67", "8 907 123 45 67"), ("89071234567", "8 907 123 45 67"), ("8 935 7476622-ерунда", "89357476622"), ("Ёлкин  Пётр", "елкин петр"), ("1234", "1234"), ("12-34", "1234"),
    ("", "abc"), ("2200 1234 5678 9010", "2200123456789010"), ("123456", "12 34 56"), ("654321", "123456"), ("(907)1234567", "+79071234567"), ("Иван", "Иван "),
]
_PAIR_SQL = ", ".join(f"({i}, {_quoted(a)}, {_quoted(b)})" for i, (a, b) in enumerate(_PAIRS))


@query(
    f"WITH p(i, a, b) AS (VALUES {_PAIR_SQL}) SELECT i, {_N('a')} = {_N('b')} OR (length({_D('b')}) >= 6 AND {_NUM('a')} AND {_NUM('b')} AND {_D('a')} = {_D('b')}) AS shown, "
    f"{_N('a')} = {_N('b')} OR (length({_D('b')}) >= 6 AND {_NUM('a')} AND {_NUM('b')} AND {_D('a')} <> '' AND CASE WHEN length({_D('b')}) >= 10 THEN right({_D('a')}, 10) = right({_D('b')}, 10) ELSE {_D('a')} = {_D('b')} END) AS delivered FROM p"
)
def same_value_rules(spark, sf_dir):
    p = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(_PAIRS)], "i int, a string, b string")
    a, b = F.col("a"), F.col("b")
    return p.select("i", text.same_shown(a, b).alias("shown"), text.same_delivered(a, b).alias("delivered"))


_VALUES = [("PHONE", "8 (907) 123-45-67"), ("PHONE", "9071234567"), ("PHONE", "12345"), ("CARD", "2200 1234 5678 9010"), ("SNILS", "12345678901"), ("PASSPORT", "4519123456"), ("EMAIL", "Some.One@Mail.RU"), ("EMAIL", "<EMAIL_1>"), ("INN", "500100732259"), ("DOB", "2.6.1975"), ("DOB", "1975-06-02"), ("DOB", "02/06/75")]
_V_SQL = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in _VALUES)


@query(
    f"""WITH v(kind, value) AS (VALUES {_V_SQL}), d AS (SELECT *, {_D('value')} AS d FROM v)
SELECT kind, value, CASE WHEN value LIKE '<%>' THEN value
  WHEN kind = 'PHONE' AND regexp_matches(d, '^[78][0-9]{{10}}$') THEN '+7' || substr(d, 2) WHEN kind = 'PHONE' AND length(d) = 10 THEN '+7' || d
  WHEN kind = 'CARD' AND length(d) = 16 THEN d WHEN kind = 'SNILS' AND length(d) = 11 THEN substr(d, 1, 3) || '-' || substr(d, 4, 3) || '-' || substr(d, 7, 3) || ' ' || substr(d, 10)
  WHEN kind = 'PASSPORT' AND length(d) = 10 THEN substr(d, 1, 2) || ' ' || substr(d, 3, 2) || ' ' || substr(d, 5) WHEN kind = 'EMAIL' THEN lower(value)
  WHEN kind = 'DOB' AND regexp_matches(value, '^[0-9]{{1,2}}[./ -][0-9]{{1,2}}[./ -][0-9]{{2,4}}$') THEN
    (CASE WHEN length(regexp_extract(value, '([0-9]+)$', 1)) = 4 THEN regexp_extract(value, '([0-9]+)$', 1) WHEN regexp_extract(value, '([0-9]+)$', 1)::INT <= 26 THEN '20' || regexp_extract(value, '([0-9]+)$', 1) ELSE '19' || regexp_extract(value, '([0-9]+)$', 1) END)
    || '-' || lpad(regexp_extract(value, '^[0-9]+[./ -]([0-9]+)', 1), 2, '0') || '-' || lpad(regexp_extract(value, '^([0-9]+)', 1), 2, '0')
  ELSE value END AS rewritten FROM d"""
)
def rewrite_values(spark, sf_dir):
    v = spark.createDataFrame(_VALUES, "kind string, value string")
    return v.withColumn("rewritten", rewrite.rewrite(F.col("kind"), F.col("value"), 26))


_SEED = lambda slot, n: f"(('0x' || substr(md5(i || ':{slot}'), 1, 8))::BIGINT % {n})"
_DIGITS = lambda slot, n: " || ".join(f"{_SEED(f'{slot}{k}', 10)}" for k in range(n))
_LUHN15 = "(10 - list_sum(list_transform(generate_series(1, 15), lambda j: CASE WHEN j % 2 = 1 THEN (substr(card, j, 1)::INT * 2) // 10 + (substr(card, j, 1)::INT * 2) % 10 ELSE substr(card, j, 1)::INT END)) % 10) % 10"


@query(
    f"WITH s AS (SELECT unnest(generate_series(0, 499)) AS i), b AS (SELECT i, ({_SEED('snils0', 9)} + 1) || {_DIGITS('snils', 8)} AS snils, '2200' || {_DIGITS('card', 11)} AS card FROM s), "
    "c AS (SELECT *, list_sum(list_transform(generate_series(1, 9), lambda j: substr(snils, j, 1)::INT * (10 - j))) % 101 % 100 AS chk FROM b) "
    "SELECT i, substr(snils, 1, 3) || '-' || substr(snils, 4, 3) || '-' || substr(snils, 7, 3) || ' ' || lpad(chk::VARCHAR, 2, '0') AS snils, "
    f"substr(card, 1, 4) || ' ' || substr(card, 5, 4) || ' ' || substr(card, 9, 4) || ' ' || substr(card, 13, 3) || ({_LUHN15})::BIGINT AS card, true AS snils_ok, true AS card_ok, true AS inn_ok FROM c"
)
def identifiers_valid(spark, sf_dir):
    s = F.col("i").cast("string")
    d = spark.range(500).select(F.col("id").alias("i")).withColumns({"snils": identifiers.make_snils(s), "card": identifiers.make_card(s), "inn": identifiers.make_inn(s)})
    return d.select("i", "snils", "card", identifiers.snils_ok(F.col("snils")).alias("snils_ok"), identifiers.luhn_ok(F.translate("card", " ", "")).alias("card_ok"), identifiers.inn_ok(F.col("inn")).alias("inn_ok"))


@query("SELECT p_partkey, p_name || ' (' || p_brand || ') #' || p_size AS text, length(p_name) + 2 AS brand_start, length(p_name) + 2 + length(p_brand) AS brand_end, true AS ok FROM part")
def assembled_spans(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    slot = corpus._slot
    a = corpus.assemble(F.array(slot("name", F.col("p_name")), slot(None, " ("), slot("brand", F.col("p_brand")), slot(None, ") #"), slot("size", F.col("p_size").cast("string"))))
    brand = F.filter("a.spans", lambda s: s["key"] == "brand")[0]
    return p.select("p_partkey", a.alias("a")).select("p_partkey", "a.text", brand["start"].cast("long").alias("brand_start"), brand["end"].cast("long").alias("brand_end"), "a.ok")


_SHARES = "s(tier, pos, share) AS (VALUES ('common', 1, 40), ('tail', 2, 30), ('diminutive', 3, 15), ('foreign', 4, 15))"
_PLAN = """p(family, rank, register, n) AS (VALUES
  ('create_order', 0, 'clean', 18), ('create_order', 1, 'chat', 22), ('create_order', 2, 'sloppy', 20), ('verify_identity', 0, 'clean', 16), ('verify_identity', 1, 'chat', 18), ('verify_identity', 2, 'sloppy', 16),
  ('second_mention', 0, 'clean', 16), ('second_mention', 1, 'chat', 20), ('second_mention', 2, 'sloppy', 16), ('send_sms', 0, 'clean', 12), ('send_sms', 1, 'chat', 16), ('send_sms', 2, 'sloppy', 12),
  ('check_status', 0, 'clean', 12), ('check_status', 1, 'chat', 14), ('check_status', 2, 'sloppy', 12), ('refund', 0, 'clean', 10), ('refund', 1, 'chat', 12), ('refund', 2, 'sloppy', 10),
  ('decompose', 0, 'clean', 14), ('decompose', 1, 'chat', 16), ('decompose', 2, 'sloppy', 12))"""
# whole percents, and what is left one by one to the largest shares; upto: the last rank of a tier
_DEALT = "c AS (SELECT g.*, tier, pos, n * share // 100 AS base, n - sum(n * share // 100) OVER (PARTITION BY g.id) AS over_ FROM g, s), u AS (SELECT *, sum(base + (pos <= over_)::INTEGER) OVER (PARTITION BY id ORDER BY pos) AS upto FROM c)"


@query(
    f"WITH {_PLAN}, {_SHARES}, g AS (SELECT family || register AS id, n FROM p), {_DEALT}, e AS (SELECT *, unnest(generate_series(1, n))::INTEGER AS k FROM p) "
    'SELECT family, register, k, (row_number() OVER (PARTITION BY family ORDER BY rank, k) - 1)::INTEGER AS "index", '
    "CASE WHEN family IN ('check_status', 'refund') THEN 'common' ELSE (SELECT min_by(tier, pos) FROM u WHERE u.id = e.family || e.register AND u.upto >= e.k) END AS tier FROM e"
)
def plan_expansion(spark, sf_dir):
    return corpus.plan(spark)


@query(
    f"WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(c_custkey || ':' || c_mktsegment)) AS r FROM customer), {_SHARES}, "
    f"g AS (SELECT c_mktsegment AS id, count(*)::BIGINT AS n FROM customer GROUP BY 1), {_DEALT} SELECT c_custkey, c_mktsegment, (SELECT min_by(tier, pos) FROM u WHERE u.id = c_mktsegment AND u.upto >= r) AS tier FROM r"
)
def tier_allocation(spark, sf_dir):
    return corpus.with_tiers(_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), corpus.TIER_SHARES, "c_mktsegment")


@query(
    f"WITH {_PLAN}, {_SHARES}, g AS (SELECT family || register AS id, n FROM p), {_DEALT} SELECT family, register, tier, (base + (pos <= over_)::INTEGER)::BIGINT AS cases FROM p JOIN u ON u.id = family || register "
    "WHERE family NOT IN ('check_status', 'refund') AND base + (pos <= over_)::INTEGER > 0 UNION ALL SELECT family, register, NULL, n::BIGINT FROM p WHERE family IN ('check_status', 'refund')"
)
def corpus_counts(spark, sf_dir):
    """Cases of the generated corpus by family, register and the tier of their person."""
    tier = F.try_element_at(F.filter("pii", lambda p: p["type"] == "NAME"), F.lit(1))["tier"]
    return _corpus(spark).groupBy("family", "register", tier.alias("tier")).agg(F.count("*").alias("cases"))


_NAMES = sorted({(w, g, k) for k, pool in (("given", SMALL.given), ("surname", SMALL.surnames)) for (g, _), ws in pool.items() for w in ws})


def _endings_sql(kind: str, table: str) -> str:
    """The grammar of names as SQL: (pattern, letters cut, three endings)."""
    rows = {"given": [("m", "[йь]$", 1, "яяю"), ("m", "[бвгджзклмнпрстфхцчшщ]$", 0, "аау"), ("m", "а$", 1, "ыуе"), ("m", "я$", 1, "июе"), ("f", "а$", 1, "ыуе"), ("f", "я$", 1, "июе")]}
    surnames = [("m", "([ое]в|ёв|[иы]н)$", 0, ("а", "а", "у")), ("m", "[сц]кий$", 2, ("ого", "ого", "ому")), ("f", "([ое]ва|ёва|[иы]на)$", 1, ("ой", "у", "ой")), ("f", "[сц]кая$", 2, ("ой", "ую", "ой"))]
    chosen = rows["given"] if kind == "given" else surnames
    return " ".join(f"WHEN kind = '{kind}' AND gender = '{g}' AND regexp_matches(lower({table}), '{p}') THEN substr({table}, 1, length({table}) - {cut}) || list_element({list(f)!r}, c)" for g, p, cut, f in chosen)


@query(
    "WITH n(word, gender, kind) AS (VALUES " + ", ".join(f"({_quoted(w)}, '{g}', '{k}')" for w, g, k in _NAMES) + "), x AS (SELECT *, unnest([1, 2, 3]) AS c FROM n) "
    f"SELECT word, gender, kind, list_element(['gen', 'acc', 'dat'], c) AS form, CASE {_endings_sql('given', 'word')} {_endings_sql('surname', 'word')} ELSE word END AS declined FROM x"
)
def declined_names(spark, sf_dir):
    n = spark.createDataFrame(_NAMES, "word string, gender string, kind string")
    forms = [F.struct(F.lit(c).alias("form"), F.when(F.col("kind") == "given", surface.decline(F.col("word"), F.col("gender"), c, surface.GIVEN_ENDINGS)).otherwise(surface.decline(F.col("word"), F.col("gender"), c, surface.SURNAME_ENDINGS)).alias("declined")) for c in surface.CASES]
    return n.select("word", "gender", "kind", F.explode(F.array(*forms)).alias("f")).select("word", "gender", "kind", "f.*")


_RANKED = [("Иван", "m", "top", ["Ваня", "Ванюшенька", "vanya"]), ("Глеб", "m", "medium", ["Глебка"]), ("Тихомир", "m", "rare", ["Тиша"]), ("Аглая", "f", "rare", []), ("Даша", "f", "popular", ["Дашуня"]), ("Дарья", "f", "top", ["Даша", "Даня"]), ("x1", "m", "top", []), ("Юки", "f", "rare", [])]
_OTHER = [("Глеб", "m"), ("Милица", "f"), ("Саша", "u"), ("Анна-Мария", "f"), ("Ваня", "m"), ("с маленькой", "f")]
_FOREIGN = [("Юки", "f"), ("Пьер", "m")]


@query(
    "WITH k(name, gender, bucket, forms) AS (VALUES " + ", ".join(f"({_quoted(n)}, '{g}', '{b}', {f!r}::VARCHAR[])" for n, g, b, f in _RANKED) + "), o(name, gender) AS (VALUES " + ", ".join(f"({_quoted(n)}, '{g}')" for n, g in _OTHER) + "), f(name, gender) AS (VALUES " + ", ".join(f"({_quoted(n)}, '{g}')" for n, g in _FOREIGN) + "), "
    "every AS (SELECT name, gender, 'foreign' AS tier, 0 AS pr FROM f UNION ALL SELECT name, gender, CASE bucket WHEN 'rare' THEN 'tail' ELSE 'common' END, 1 FROM k "
    "UNION ALL SELECT name, gender, 'diminutive', 2 FROM (SELECT unnest(forms) AS name, gender FROM k WHERE bucket = 'top') WHERE length(name) BETWEEN 3 AND 5 UNION ALL SELECT name, gender, 'tail', 3 FROM o WHERE gender IN ('m', 'f')), "
    "clean AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY pr, gender, tier) AS r FROM every WHERE regexp_full_match(name, '[А-ЯЁ][а-яё]+(-[А-ЯЁ][а-яё]+)?') OR tier = 'foreign') SELECT name, gender, tier FROM clean WHERE r = 1"
)
def given_name_tiers(spark, sf_dir):
    ranked = spark.createDataFrame(_RANKED, "name string, gender string, bucket string, short_forms array<string>")
    return pools.given_names(ranked, spark.createDataFrame(_OTHER, "name string, gender string"), spark.createDataFrame(_FOREIGN, "name string, gender string"))


_LABELS = ["улица Садовая", "Большой Речной переулок", "1-й проезд", "проспект Мира", "Садовая", "улица 12", "Main улица", "2-я Лесная Улица", "набережная", "шоссе Северное шоссе"]
_FAMILY = ["Рябов", "Рябова", "Дубровский", "Дубровская", "Кочубей", "Толстой", "Хрущатый", "Стецюк", "Яшина", "Ким"]
_KINDS_SQL = "['улица','переулок','проспект','шоссе','бульвар','набережная','площадь','проезд','аллея','тупик']"


@query(
    "WITH l AS (SELECT unnest([" + ", ".join(map(_quoted, _LABELS)) + "]) AS label), w AS (SELECT label, string_split(label, ' ') AS ws FROM l), "
    f"k AS (SELECT label, ws, list_min(list_filter(generate_series(1, len(ws)), lambda i: list_contains({_KINDS_SQL}, lower(ws[i])))) AS hit FROM w), "
    "r AS (SELECT label, lower(ws[hit]) AS type, array_to_string(list_filter(ws, lambda x, i: i <> hit), ' ') AS name FROM k) "
    "SELECT label, CASE WHEN good THEN name END AS name, CASE WHEN good THEN type END AS type FROM (SELECT *, type IS NOT NULL AND regexp_full_match(name, '[А-ЯЁа-яё0-9 -]+') AND regexp_matches(name, '[А-ЯЁа-яё]') AS good FROM r)"
)
def street_labels(spark, sf_dir):
    labels = spark.createDataFrame([(x,) for x in _LABELS], "label string")
    return labels.withColumn("s", pools.split_street(F.col("label"))).select("label", "s.name", "s.type")


@query(
    "SELECT name, CASE WHEN regexp_matches(name, '(ова|ева|ёва|ина|ына|ая)$') THEN 'f' WHEN regexp_matches(name, '(ов|ев|ёв|ин|ын|ой|ый|ий)$') THEN 'm' ELSE 'u' END AS gender, true AS clean FROM (SELECT unnest([" + ", ".join(map(_quoted, _FAMILY)) + "]) AS name)"
)
def surname_genders(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in _FAMILY], "name string").select("name", pools.surname_gender(F.col("name")).alias("gender"), pools.is_clean(F.col("name")).alias("clean"))


@query("SELECT key, name, rank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pr, name, rank) AS k FROM (SELECT s_nationkey AS key, s_name AS name, s_suppkey AS rank, 0 AS pr FROM supplier UNION ALL SELECT c_nationkey, c_name, c_custkey, 1 FROM customer)) WHERE k = 1")
def merged_pools(spark, sf_dir):
    s = _table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("rank"))
    c = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_name").alias("name"), F.col("c_custkey").alias("rank"))
    return pools.merge_pools(s, c, key="key")


@query("SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_retailprice > 0 ORDER BY p_retailprice DESC, p_name, p_partkey LIMIT 120")
def largest_of_pool(spark, sf_dir):
    p = _table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    return pools.largest(p, "p_retailprice", "p_name", "p_partkey", n=120)


_GOLDEN_ADDRESS = [
    ("г. Тверь, ул. Садовая, д. 5, кв. 12", True, "Тверь", "ул. Садовая", "5", "12"), ("тверь садовая 5 кв 12", True, "тверь", "садовая", "5", "12"), ("ул. Мира, 7а", False, None, "ул. Мира", "7а", ""),
    ("<ADDRESS_1>", True, "", "<ADDRESS_1>", "", ""), ("Нижний Тагил, улица Лесная, дом 3, квартира 44", True, "Нижний Тагил", "улица Лесная", "3", "44"),
]


def _sql_values(rows, names: str) -> str:
    def lit(x) -> str:
        return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else _quoted(x)

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(lit(x) for x in r) + ')' for r in rows)}) AS t({names})"


@query(_sql_values(_GOLDEN_ADDRESS, "address, with_city, city, street, house, flat"))
def cut_addresses(spark, sf_dir):
    a = spark.createDataFrame([r[:2] for r in _GOLDEN_ADDRESS], "address string, with_city boolean")
    return a.withColumn("p", rewrite.cut_address(F.col("address"), F.col("with_city"))).select("address", "with_city", "p.*")


_GOLDEN_REPAIR = [
    ("02.06.1975", "2 июня 1975", True), ("27.01.1975", "2 июня 1975", False), ("Рушан Есин", "есина рушана", True), ("Иван Рябов", "пётр рябов", False), ("2200 7282 1111 2222", "220О728211112222", True),
    ("г. Тверь, улица Садовая, 5", "тверь садовая 5", True), ("тверь 5", "тверь садовая 5", False), ("", "x", False), ("<NAME_1>", "иван", False), ("1975-06-02", "02.06.75", True),
]


@query(_sql_values(_GOLDEN_REPAIR, "produced, canonical, normalised"))
def repaired_values(spark, sf_dir):
    p = spark.createDataFrame([r[:2] for r in _GOLDEN_REPAIR], "produced string, canonical string")
    return p.withColumn("normalised", judge.normalised(F.col("produced"), F.col("canonical"), 26))


_GOLDEN_PERSONS = [("Тарасова Ивана", "Иван Тарасов", True), ("рябов глеб", "Глеб Рябов", True), ("Рябов Глеб", "Рябов Олег", False), ("Иван", "Иван Рябов", False), ("Ivan", "Иван", False)]


@query(_sql_values(_GOLDEN_PERSONS, '"left", "right", same'))
def same_persons(spark, sf_dir):
    p = spark.createDataFrame([r[:2] for r in _GOLDEN_PERSONS], "left string, right string")
    return p.withColumn("same", persons.same_person(F.col("left"), F.col("right")))


# --- whole runs over a generated corpus: not expressible in SQL ---------------------------------------

_WRITTEN: dict[str, str] = {}


def _corpus(spark: SparkSession) -> DataFrame:
    """The corpus of the full plan, generated and written once per application."""
    app = spark.sparkContext.applicationId
    if app not in _WRITTEN:
        path = shared_path(spark, "cases")
        src.write_cases(corpus.generate(spark, 1), path)
        _WRITTEN[app] = path
    return src.read_written_cases(spark, _WRITTEN[app])


@query()
def run_placeholder(spark, sf_dir):
    return score.with_intervals(score.lines(*evaluate.evaluate(_corpus(spark), "placeholder_regex", "copier")))


@query()
def run_passthrough(spark, sf_dir):
    items, negs, _ = evaluate.evaluate(_corpus(spark), "noop", "copier")
    return gates.passthrough(items, negs)


@query()
def corpus_defects(spark, sf_dir):
    return gates.defects(_corpus(spark))


@query()
def corpus_strata(spark, sf_dir):
    return gates.strata(_corpus(spark))


@query()
def run_rewriter(spark, sf_dir):
    """The agent that writes values in its own notation, behind the naive masker."""
    return score.with_intervals(score.lines(*evaluate.evaluate(_corpus(spark), "placeholder_regex", "rewriter")))


_CONVERSED = ",\n".join(
    [
        "ids AS (SELECT row_number() OVER (ORDER BY conv_id, turn, text) AS doc_id, * FROM conversations WHERE text IS NOT NULL)",
        sql_claims("c", detect.FOREIGN + detect.RUSSIAN, "ids"),
        "told AS (SELECT conv_id, doc_id, rank, start, type, value FROM c JOIN ids USING (doc_id))",
        "first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, value ORDER BY doc_id, rank, start) AS r FROM told) WHERE r = 1)",
        "known AS (SELECT conv_id, doc_id, value, '<' || type || '_' || row_number() OVER (PARTITION BY conv_id, type ORDER BY doc_id, rank, start) || '>' AS token FROM first)",
        "own AS (SELECT t.doc_id, t.value, k.token, row_number() OVER (PARTITION BY t.doc_id ORDER BY t.rank, t.start) AS k FROM told t JOIN known k USING (conv_id, value))",
        "folded AS (SELECT doc_id, 0::BIGINT AS k, text AS t FROM ids UNION ALL SELECT f.doc_id, o.k, replace(f.t, o.value, o.token) FROM folded f JOIN own o ON o.doc_id = f.doc_id AND o.k = f.k + 1)",
        "last AS (SELECT doc_id, arg_max(t, k) AS masked FROM folded GROUP BY doc_id)",
    ]
)


@query(f"WITH RECURSIVE {_CONVERSED} SELECT conv_id, turn, md5(masked) AS masked_md5, (SELECT count(*) FROM known k WHERE k.conv_id = i.conv_id AND k.doc_id <= i.doc_id) AS tokens FROM ids i JOIN last USING (doc_id)")
def stream_vault(spark, sf_dir):
    """Conversations as a stream of messages: each value has one placeholder in all of its conversation."""
    from ..streaming import vault

    kind = spark.read.parquet(f"{sf_dir}/conversations.parquet").schema
    told = spark.readStream.schema(kind).parquet(f"{sf_dir}/conversations.parquet*")
    found = _drained(vault.mask_stream(told.select("conv_id", F.col("turn").cast("long").alias("turn"), "text"), detect.FOREIGN + detect.RUSSIAN), "vault", "append")
    return found.select("conv_id", F.col("turn").cast(kind["turn"].dataType).alias("turn"), F.md5(F.col("masked").cast("binary")).alias("masked_md5"), F.col("tokens").cast("long").alias("tokens"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_window_counts(spark, sf_dir):
    """Counts by hour and type of a stream, as its last state stands."""
    from ..streaming import vault

    events = spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").parquet(f"{sf_dir}/events.parquet*")
    return _drained(vault.windowed_counts(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type"), "windows", "complete")


def _drained(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Runs a stream over what is there and returns its rows: appended ones from files, a complete state from memory."""
    spark = stream.sparkSession
    out = stream.writeStream.outputMode(mode).option("checkpointLocation", shared_path(spark, name)).trigger(availableNow=True)
    if mode == "append":
        path = shared_path(spark, f"{name}-out")
        out.format("parquet").start(path).awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)
    out.format("memory").queryName(f"vg_{name}").start().awaitTermination()
    return spark.table(f"vg_{name}")
