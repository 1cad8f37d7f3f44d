"""The evaluation engine: alignment, judging, statistics, identifiers, gates with mutations, whole runs, stored runs."""

import hashlib
import json
from math import comb

import pytest
from pyspark.sql import functions as F

from veilgauge.functions import identifiers, persons, rewrite, stats, text
from veilgauge.operators import align, detect, gates, judge, score
from veilgauge.plans import corpus, evaluate, maskers, results, surface
from veilgauge.sources import cases as src

COUNTS = {"create_order": (4, 2, 2), "verify_identity": (1, 2, 1), "refund": (1, 1, 1), "second_mention": (2, 2, 2), "decompose": (1, 2, 1)}


@pytest.fixture(scope="session")
def cases(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cases") / "c")
    src.write_cases(corpus.generate(spark, 3, COUNTS), path)
    return src.read_written_cases(spark, path).cache()


@pytest.fixture(scope="session")
def naive(spark, cases, tmp_path_factory):
    out = []
    for k, d in enumerate(evaluate.evaluate(cases, "placeholder_regex", "copier")):
        path = str(tmp_path_factory.mktemp("obs") / str(k))
        d.write.parquet(path)  # observations are stored, and scored from there
        out.append(spark.read.parquet(path))
    return out


def one(spark, **values):
    """A row of strings as columns, and a function that evaluates an expression on it."""
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return lambda expr: df.select(expr.alias("x")).first()["x"]


# --- alignment -----------------------------------------------------------------------------


def seen(original, masked, *values):
    spans = [(original.index(v), original.index(v) + len(v)) for v in values]
    return align.Script(original, masked).together(spans)


@pytest.mark.parametrize(
    "original, masked, value, want",
    [
        ("Звоните 8 907 123 45 67 днём", "Звоните <PHONE_1> днём", "8 907 123 45 67", ("<PHONE_1>", True, True, False)),
        ("номер 89071234567 мой", "номер 89071234567 мой", "89071234567", ("89071234567", False, False, False)),
        ("номер 8 907 123 45 67 мой", "номер 89071234567 мой", "8 907 123 45 67", ("89071234567", False, False, False)),
        ("это Пётр Ёлкин", "это Петр Елкин", "Пётр Ёлкин", ("Петр Елкин", False, False, False)),
        ("клиент Беркутов Павел, да", "клиент Беркутов <NAME_1>, да", "Беркутов Павел", ("Беркутов <NAME_1>", True, False, False)),
        ("карта 2200 1111 2222 3333 тут", "карта 2200 9485 7361 4058 тут", "2200 1111 2222 3333", ("2200 9485 7361 4058", True, False, False)),
    ],
)
def test_substitutes(original, masked, value, want):
    assert seen(original, masked, value) == [want]


def test_deleted_and_shared_spans():
    text_, altered, covered, _ = seen("я Павел Рябов из Сочи", "я из Сочи", "Павел Рябов ")[0]
    assert (text_, altered, covered) == ("", True, True)
    both = seen("едет Тверь Лесная 5 Павел Рябов срочно", "едет Омск Дачная 71 Олег Яшин срочно", "Тверь Лесная 5", "Павел Рябов")
    assert all(x[3] for x in both) and both[0][0] != both[1][0]


def test_rewrite_ratio():
    s = align.Script("начало секрет конец", "начало <X_1> конец")
    assert s.rewritten([(7, 13)]) == 0.0 and 0 < s.rewritten([]) < 1
    assert align.Script("совсем другое здесь", "quite unlike it").rewritten([]) > 0.3
    assert align.Script("abc", "xyz").rewritten([(0, 3)]) == 0.0


def test_edit_script_covers_both_texts():
    for a, b in (("", ""), ("abc", ""), ("", "abc"), ("один два три", "два три четыре"), ("aXbXc", "aYbYc")):
        at, bt = 0, 0
        script = align.Script(a, b)
        for changed, a1, a2, b1, b2 in zip(script.changed, script.at, script.at[1:], script.to, script.to[1:]):
            assert (a1, b1) == (at, bt) and (changed or a[a1:a2] == b[b1:b2])
            at, bt = a2, b2
        assert (at, bt) == (len(a), len(b))


def test_address_pieces(spark):
    at = one(spark, v="г. Тверь, улица Садовая, дом 5", city="г. Тверь, улица <ADDRESS_1>", kept="улица Садовая <X>")
    assert at(align.address_survives(F.col("v"), F.col("kept"))) is True
    assert at(align.address_survives(F.col("v"), F.lit("улица <X>"))) is False
    assert at(align.address_survives(F.lit("Тверь, Садовая 5"), F.lit("Тверь <X>"), ("тверь",))) is False
    assert at(align.address_survives(F.lit("Тверь, Садовая 5"), F.lit("Тверь <X>"))) is True


# --- detection, vault, restoration --------------------------------------------------------------


def test_claims_vault_and_masking(spark):
    t = "Почта a.b@c.org, карта 2200 1111 2222 3333, тел +7 907 123-45-67, снова a.b@c.org"
    df = detect.detect(spark.createDataFrame([(t,), (None,), ("пусто",)], "t string"), "t").collect()
    row = df[0]
    assert [s.type for s in row.spans] == ["EMAIL", "CARD", "PHONE", "EMAIL"] and all(t[s.start : s.end] == s.value for s in row.spans)
    assert [(v.token, v.value) for v in row.vault] == [("<EMAIL_1>", "a.b@c.org"), ("<CARD_1>", "2200 1111 2222 3333"), ("<PHONE_1>", "+7 907 123-45-67")]
    assert df[1].claims == [] and df[2].vault == []
    d = detect.detect(spark.createDataFrame([(t,)], "t string"), "t")
    m = d.select(detect.mask_everywhere(F.col("t"), F.col("vault")).alias("a"), detect.mask_spans(F.col("t"), F.col("spans"), F.col("vault")).alias("b"), "vault")
    got = m.select("a", "b", detect.restore(F.col("a"), F.col("vault")).alias("r")).first()
    assert got.a == got.b == "Почта <EMAIL_1>, карта <CARD_1>, тел <PHONE_1>, снова <EMAIL_1>" and got.r == t


def test_restoration_may_break_json(spark):
    known = F.array(F.struct(F.lit("NAME").alias("type"), F.lit(1).alias("n"), F.lit("<NAME_1>").alias("token"), F.lit('ООО "Рога"').alias("value")))
    at = one(spark, a='{"name":"<NAME_1>"}')
    broken = at(detect.restore(F.col("a"), known))
    assert at(detect.arguments(F.lit(broken))) is None and at(detect.arguments(F.col("a"))) == {"name": "<NAME_1>"}
    assert at(detect.arguments(F.lit('{"a": 1, "b": "x"}'))) == {"a": "1", "b": "x"}


# --- judging -----------------------------------------------------------------------------------------


def test_two_rules_of_equality(spark):
    at = one(spark, a="+7 907 123-45-67", b="8 907 123 45 67")
    assert at(text.same_delivered(F.col("a"), F.col("b"))) and not at(text.same_shown(F.col("a"), F.col("b")))
    assert not at(text.same_delivered(F.lit("8 935 7476622-ерунда"), F.lit("89357476622")))


def test_verdicts_are_three_valued(spark):
    def verdict(param, made, shared, got):
        x = judge.round_trip(F.lit(param).cast("string"), F.lit(made), F.lit(shared), F.lit(got).cast("string"), F.lit("abc"))
        return one(spark, a="")(x)

    assert verdict("p", True, False, "ABC") is True and verdict("p", True, False, None) is False
    assert verdict(None, True, False, "abc") is None and verdict("p", False, False, "abc") is None and verdict("p", True, True, "abc") is None


def test_dates_and_repairs(spark):
    at = one(spark, a="")
    day = lambda s: (lambda r: r and (r.day, r.month, r.year))(at(text.as_date(F.lit(s), 26)))
    assert day("2 июня 1975") == (2, 6, 1975) and day("1975-06-02") == (2, 6, 1975) and day("02/06/75") == (2, 6, 1975) and day("1.1.26") == (1, 1, 2026)
    assert day("31.02.1999") is None and day("5 мая 2001") == (5, 5, 2001) and day("слово") is None and day("3 марта 99") == (3, 3, 1999)


def test_parts(spark):
    def verdict(got, owed):
        m = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv]).cast("map<string,string>")
        r = one(spark, a="")(judge.parts_verdict(F.array(F.lit("street"), F.lit("flat")), m(got), m(owed), 26))
        return r.round_trip, r.normalised

    assert verdict({"street": "Лесная", "flat": "5"}, {"street": "лесная", "flat": "5"}) == (True, False)
    assert verdict({"street": "ул. Лесная", "flat": "5"}, {"street": "лесная", "flat": "5"}) == (False, True)
    assert verdict({"street": "Лесная", "flat": "5"}, {"street": "лесная", "flat": ""}) == (False, False)


def test_names_are_cut_by_position(spark):
    order = F.array(F.lit("surname"), F.lit("given"))
    cut = lambda s: one(spark, a=s)(rewrite.cut_name(F.col("a"), order))
    assert cut("Рябов Глеб") == {"surname": "Рябов", "given": "Глеб"} and cut("<NAME_1>") == {"surname": "<NAME_1>", "given": ""}
    assert cut("Рябов Глеб Ильич") == {"surname": "Рябов", "given": "Глеб Ильич"} and cut(" ") == {"surname": "", "given": ""}


def test_persons(spark):
    same = lambda a, b: one(spark, a=a, b=b)(persons.same_person(F.col("a"), F.col("b")))
    assert same("тарасова ивана", "Иван Тарасов") and not same("Олег Лосев", "Иван Лосев") and not same("Иван", "Иван Лосев")
    shape = lambda s: one(spark, a=s)(persons.looks_like_person(F.col("a")))
    assert shape("Анна-Мария Лосева") and not shape("<NAME_1>") and not shape("Ivan") and not shape("Иван 5")


# --- statistics and identifiers ---------------------------------------------------------------------


def test_intervals_against_binomial_sums():
    for n in (1, 10, 37):
        for k in range(n + 1):
            low, high = stats.interval(k, n)
            if k:
                assert abs(sum(comb(n, i) * low**i * (1 - low) ** (n - i) for i in range(k, n + 1)) - 0.025) < 1e-9
            if k < n:
                assert abs(sum(comb(n, i) * high**i * (1 - high) ** (n - i) for i in range(k + 1)) - 0.025) < 1e-9
    assert stats.interval(0, 0) == (0.0, 1.0) and abs(stats.interval(5, 10)[0] - 0.1871) < 1e-3


def test_paired_p_values():
    for b in range(12):
        for c in range(12):
            n, k = b + c, min(b, c)
            want = min(1.0, 2 * sum(comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0
            assert abs(stats.mcnemar(b, c) - want) < 1e-9
    assert stats.items_for(0.994) == 498 and stats.items_for(0.99) == 299
    with pytest.raises(ValueError):
        stats.items_for(1.0)


def test_generated_identifiers_are_valid(spark):
    s = F.col("id").cast("string")
    d = spark.range(300).select(identifiers.make_phone(s).alias("p"), identifiers.make_snils(s).alias("s"), identifiers.make_inn(s).alias("i"), identifiers.make_card(s).alias("c"), identifiers.make_birth_date(s).alias("d"))
    ok = d.where(identifiers.snils_ok(F.col("s")) & identifiers.inn_ok(F.col("i")) & identifiers.luhn_ok(F.translate("c", " ", "")) & F.col("p").rlike("^9[0-9]{9}$") & F.col("d").rlike(r"^\d\d\.\d\d\.\d{4}$"))
    assert ok.count() == 300 and d.distinct().count() == 300


def test_assembly(spark):
    a = corpus.assemble(F.array(corpus._slot("x", "ab"), corpus._slot(None, "-"), corpus._slot("y", "ab")))
    r = spark.range(1).select(a.alias("a")).first()["a"]
    assert r.text == "ab-ab" and [(s.key, s.start, s.end) for s in r.spans] == [("x", 0, 2), ("y", 3, 5)] and r.ok
    assert spark.range(1).select(corpus.assemble(F.array(corpus._slot("x", "a"), corpus._slot("x", "b")))["ok"].alias("o")).first()["o"] is False
    assert corpus.allocate(18) == {"common": 8, "tail": 6, "diminutive": 2, "foreign": 2} and corpus.allocate(10, {"a": 55, "b": 45}) == {"a": 6, "b": 4}


# --- whole runs ------------------------------------------------------------------------------------------


def hits(items, negs, kinds):
    return {r.line: (r.hits, r.total) for r in score.lines(items, negs, kinds).collect()}


def test_passthrough_is_perfect(cases):
    items, negs, kinds = evaluate.evaluate(cases, "noop", "copier")
    assert gates.passthrough(items, negs).first()["ok"]
    lines = hits(items, negs, kinds)
    assert lines["leak"][0] == 0 and "typed" not in lines and lines["end_to_end"][0] == lines["end_to_end"][1] > 0


def test_naive_masker_leaves_a_mark(cases, naive):
    items, negs, kinds = naive
    assert gates.unmarked(items, kinds).count() == 0
    lines = hits(*naive)
    assert 0 < lines["leak"][0] < lines["leak"][1] and items.where("altered AND NOT round_trip AND family <> 'decompose'").count() == 0
    # dates of documents look like dates of birth; nothing else that is no personal value is touched
    assert negs.where("touched").select("kind").distinct().collect() == [("doc_date",)] and lines["overmask"][0] == negs.where("NOT touched").count()
    assert kinds.where("stability IS NOT NULL").count() == 6 and kinds.where("NOT stability OR error IS NOT NULL OR NOT arguments_parse").count() == 0
    rows = {r.axis: r for r in score.by_axis(items, {"register": "register", "tier": "tier"}).collect()}
    assert set(rows) == {"register", "tier"}


def test_an_error_ends_the_replay(cases):
    def failing(c):
        views = maskers.noop(c)
        return views.withColumn("error", F.when((F.col("case_id").startswith("second_mention")) & (F.col("request_turn") == 3), "mask failed"))

    items, _, kinds = evaluate.evaluate(cases, maskers.Masker("failing", failing), "copier")
    bad = kinds.where("error IS NOT NULL")
    assert bad.count() == 6 and bad.where("call_made").count() == 0
    assert items.where("case_id LIKE 'second%' AND round_trip IS NOT NULL").count() == 0


def test_a_call_that_cannot_be_restored_counts(cases):
    def broken(calls):
        return calls.select("case_id", F.lit(None).cast("string").alias("restored"), F.lit("restore failed: x").alias("error"))

    items, _, kinds = evaluate.evaluate(cases, maskers.Masker("broken", maskers.placeholder_regex, broken), "copier")
    assert kinds.where("call_made AND NOT arguments_parse AND error LIKE 'restore failed%'").count() == kinds.count()
    judged = items.where("tool_param IS NOT NULL AND NOT shared_block")
    assert judged.where("round_trip").count() == 0 and judged.where("round_trip IS NULL").count() == 0


def _found(text):
    import re

    shapes = (("PHONE_NUMBER", r"\+7[ \d()-]{10,}\d"), ("CREDIT_CARD", r"\d{4} \d{4} \d{4} \d{4}"))
    return [(m.start(), m.end(), kind) for kind, shape in shapes for m in re.finditer(shape, text)]


def _scanners(pairs):
    def anonymize(text):
        for s, e, _ in sorted(_found(text), reverse=True):
            token = next((t for t, v in pairs if v == text[s:e]), None) or f"[X{len(pairs)}]"
            if (token, text[s:e]) not in pairs:
                pairs.append((token, text[s:e]))
            text = text[:s] + token + text[e:]
        return text

    def deanonymize(text):
        for token, value in pairs:
            text = text.replace(token, value)
        return text

    return anonymize, deanonymize


def _hidden(text):
    """A service without memory: values are shown as their digits in reverse, between marks."""
    for s, e, _ in sorted(_found(text), reverse=True):
        text = text[:s] + "{" + text[s:e][::-1] + "}" + text[e:]
    return text


def _shown(text):
    import re

    return re.sub(r"\{([^{}\"]*)\}", lambda m: m.group(1)[::-1], text)


def _post(path, payload):
    if path == "/mask":
        return {"messages": [m | {"content": _hidden(m["content"])} for m in payload["messages"]]}
    if path == "/unmask_arguments":
        return {"arguments": [payload["arguments"][0][0] + _shown(payload["arguments"][0][1:-1]) + payload["arguments"][0][-1]]}
    raise RuntimeError("no such call")


def _send(payload, model):
    answer = model([m | {"content": _hidden(m["content"])} for m in payload["messages"]])
    for call in answer.get("tool_calls") or []:
        a = call["function"]["arguments"]
        call["function"]["arguments"] = a[0] + _shown(a[1:-1]) + a[-1]
    return {"choices": [{"message": answer}]}


def test_all_ways_to_a_masker_measure_the_same(cases):
    """An engine, scanners, a service and a proxy that find the same values have the same lines."""
    made = [maskers.build("entity_engine", analyze=_found), maskers.build("vault_scanners", scanners=_scanners), maskers.build("service", post=_post), maskers.build("proxy", send=_send)]
    some = cases.where("family IN ('refund', 'create_order', 'second_mention')")
    found = [{k: v for k, v in hits(*evaluate.evaluate(some, m, "copier")).items() if k not in ("typed", "consistency", "stability")} for m in made]
    assert found[0] == found[1] == found[2] == found[3] and 0 < found[0]["leak"][0] < found[0]["leak"][1] and found[0]["round_trip"][0] == found[0]["round_trip"][1] > 0
    views = made[0].views(some)
    assert {s.type for r in views.where("spans IS NOT NULL").collect() for s in r.spans} == {"PHONE", "CARD"} and made[2].views(some).where("spans IS NOT NULL").count() == 0


def test_the_registry_fails_loudly():
    assert maskers.build("noop").name == "noop" and maskers.build("service", post=_post, name="mine", org_id="o").config == {"org_id": "o"}
    for name, options in (("unheard", {}), ("entity_engine", {}), ("proxy", {"post": _post})):
        with pytest.raises(ValueError, match="known are|needs"):
            maskers.build(name, **options)


def test_failures_of_sessions_are_data(cases):
    def post(path, payload):
        raise RuntimeError("503")

    kinds = evaluate.evaluate(cases.where("family = 'refund'"), maskers.build("service", post=post), "copier")[2].collect()
    assert kinds and all(r.error == "mask failed: 503" and not r.call_made for r in kinds)


def test_the_rewriter_is_owed_its_own_notation(cases):
    items, _, _ = evaluate.evaluate(cases, "noop", "rewriter")
    phones = items.where("type = 'PHONE' AND delivered IS NOT NULL").collect()
    assert phones and all(r.round_trip for r in phones) and any(r.delivered.startswith("+7") for r in phones)


@pytest.mark.parametrize(
    "rule, change",
    [
        ("item_offsets", lambda c: c.withColumn("pii", F.transform("pii", lambda p: p.withField("start", p["start"] + 1)))),
        ("item_turn", lambda c: c.withColumn("pii", F.transform("pii", lambda p: p.withField("turn", F.lit(9))))),
        ("item_type", lambda c: c.withColumn("pii", F.transform("pii", lambda p: p.withField("type", F.lit("SHOE"))))),
        ("no_negatives", lambda c: c.withColumn("negatives", F.slice("negatives", 1, 0))),
        ("negative_kind", lambda c: c.withColumn("negatives", F.transform("negatives", lambda p: p.withField("kind", F.lit("shoe"))))),
        ("tool_not_offered", lambda c: c.withColumn("tools", F.slice("tools", 1, 0))),
        ("param_unfed", lambda c: c.withColumn("pii", F.transform("pii", lambda p: p.withField("tool_param", F.lit(None).cast("string"))))),
        ("family", lambda c: c.withColumn("family", F.lit("x"))),
        ("register", lambda c: c.withColumn("register", F.lit("x"))),
        ("overlap", lambda c: c.withColumn("negatives", F.transform("pii", lambda p: F.struct(p["value"].alias("value"), F.lit("city").alias("kind"), p["turn"].alias("turn"), p["start"].alias("start"), p["end"].alias("end"))))),
        ("name_tier", lambda c: c.withColumn("pii", F.transform("pii", lambda p: p.withField("tier", F.lit(None).cast("string"))))),
    ],
)
def test_each_defect_is_found(cases, rule, change):
    assert gates.defects(cases).count() == 0
    assert gates.defects(change(cases)).where(F.col("rule") == rule).count() > 0


def test_stored_runs(spark, cases, naive, tmp_path):
    digest = results.corpus_digest(cases).first()["digest"]
    by_hand = hashlib.sha256()
    for r in sorted(cases.collect(), key=lambda r: r.id):
        by_hand.update("".join([r.id, *(m.content for m in r.messages if m.role == "user")]).encode())
    assert digest == by_hand.hexdigest()[:16]
    assert digest == results.corpus_digest(cases.repartition(5)).first()["digest"] != results.corpus_digest(cases.limit(3)).first()["digest"]
    for system, at, d in (("naive", "2026-01-01T00:00:00Z", digest), ("naive", "2026-01-02T00:00:00Z", digest), ("other", "2026-01-01T00:00:00Z", digest), ("old", "2026-01-01T00:00:00Z", "x")):
        run = results.run_file(*naive, {"system": system, "policy": "copier", "seed": 0, "corpus_digest": d, "corpus_cases": cases.count(), "run_at": at})
        src.write_run(run, str(tmp_path / f"{system}-{at[8:10]}"))
    src.write_run(run, str(tmp_path / "_archive" / "gone"))
    runs = src.read_runs(spark, str(tmp_path))
    assert runs.count() == 4 and src.item_observations(runs).count() == 4 * naive[0].count()
    again = results.rejudge(src.item_observations(runs, "manifest.system"), src.gold_items(cases))
    assert again.where("system = 'other'").select("round_trip").collect().count((True,)) == naive[0].where("round_trip").count()
    lines, pairs, stale = results.board(runs, digest, src.gold_items(cases))
    assert {(r.system, r.policy) for r in lines.collect()} == {("naive", "copier"), ("other", "copier")}
    assert [(r["left"], r["right"], r.b, r.c, r.p) for r in pairs.orderBy("line").collect()] == [("naive", "other", 0, 0, 1.0)] * 2
    assert [r.system for r in stale.collect()] == ["old"]
    table = results.markdown(lines)
    assert table.count("| naive |") == 1 and "leak" in table and "—" not in table.split("consistency")[0]
    assert "leak:" in results.report(spark, *naive)
    text = results.leaderboard(runs, cases)
    assert "| errors |" in text and "naive / other" in text and "- old: corpus `x`" in text and results.AGENTS["copier"] in text
    one_run = runs.where("manifest.system = 'other'")
    worse = one_run.withColumn("observations", F.transform("observations", lambda o: o.withField("consistency", F.lit(False))))
    fresh = results.rescored(worse, cases).first()
    assert fresh["rescored"]["benchmark_version"] == results.VERSION
    told = {o["case_id"]: o["consistency"] for o in fresh["observations"]}
    judged = {r.case_id: r.consistency for r in naive[2].collect()}
    assert all(told[k] == v for k, v in judged.items() if v is not None)
    assert gates.stale(runs.select("manifest.*"), digest).count() == 1


def test_reading_is_strict(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text(json.dumps({"id": "x", "messages": [{"role": "user", "content": "a"}], "hard": None}))
    assert src.read_cases(spark, str(tmp_path), limit=1).first()["id"] == "x"
    (tmp_path / "a" / "y.json").write_text('{"id": 5, "messages": "no"}')
    with pytest.raises(Exception):  # noqa: B017
        src.read_cases(spark, str(tmp_path)).collect()


def test_corpus_is_reproducible(spark, cases):
    again = corpus.generate(spark, 3, COUNTS)
    flat = lambda d: d.select("id", F.to_json("messages").alias("m"))
    assert src.tree_diff(flat(cases), flat(again)).count() == 0
    other = src.tree_diff(flat(cases), flat(corpus.generate(spark, 4, COUNTS)))
    assert other.count() > 0
    strata = {r.stratum: r for r in gates.strata(cases).collect()}
    assert not strata["family:refund"].ok and strata["register:chat"].ok


def test_command_line(spark, cases, tmp_path, capsys):
    from veilgauge.__main__ import main

    at = str(tmp_path / "cases")
    src.write_cases(cases, at)
    assert main(["check", "--cases", at], spark) == 1 and "BAD family:refund" in capsys.readouterr().out  # too few for a stratum
    assert main(["run", "--cases", at, "--limit", "6", "--out", str(tmp_path / "runs" / "a")], spark) == 0 and "leak:" in capsys.readouterr().out
    assert main(["board", "--cases", at, "--results", str(tmp_path / "runs")], spark) == 0
    assert "Runs over another corpus" in capsys.readouterr().out


def test_one_slip_is_one_edit():
    for i in range(300):
        d = surface.Draws(str(i))
        word = surface.slipped("караоке", d, "w")
        swapped = sum(a != b for a, b in zip("караоке", word, strict=False)) <= 2 and sorted(word) == sorted("караоке")
        twin = len(word) == 7 and sum(a != b for a, b in zip("караоке", word, strict=True)) == 1
        assert swapped or twin or len(word) == 6
        out = surface.slipped_digits("8 907 1002003", d, "n")
        assert (len(out.text), out.shaped) in {(13, False), (12, True)}
    assert surface.slipped("Ли", surface.Draws("1"), "w") == "Ли"
    assert surface.declined("Любовь", "f", "acc", surface.GIVEN_ENDINGS) == "Любовь" and surface.declined("Дубровская", "f", "acc", surface.SURNAME_ENDINGS) == "Дубровскую"
