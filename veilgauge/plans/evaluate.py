"""The main query: mask every transcript, let a scripted agent call the tool, judge what it received.

    cases -> views (what each request shows) -> substitutes (aligned) -> arguments -> delivered -> verdicts

Everything is keyed by the case, so that a run is as parallel as its corpus; a case's own rows are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identifiers, rewrite
from ..operators import align, detect, judge
from ..session import stored
from ..sources import cases as src
from . import maskers
from .maskers import Masker


def _merge(maps: Column) -> Column:
    """A list of entries as a map; of one key's entries the last counts."""
    seed = F.array().cast("array<struct<key: string, value: string>>")
    last = F.aggregate(maps, seed, lambda acc, e: F.concat(F.filter(acc, lambda x: x["key"] != e["key"]), F.array(e)))
    return F.map_from_entries(last)


def evaluate(cases: DataFrame, masker: str | Masker = "placeholder_regex", policy: str = "copier", *, pivot: int = 26, seed: int = 0, cities: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, negatives, cases) observations of one masker and agent.

    masker: one that maskers.build() made, or a name of one that needs nothing. pivot: the last two digits of the year up
    to which short years are in this century. cities: words of cities, which do not count when they lead an address.
    A call that could not be restored was made: its items are false, not unmeasured.
    """
    masker = maskers.build(masker) if isinstance(masker, str) else masker
    views = stored(masker.views(cases), "views")
    users = cases.select(F.col("id").alias("case_id"), src.user_turns("messages").alias("u")).select("case_id", F.element_at("u", 1).alias("first_user"), F.element_at("u", -1).alias("last_user"))
    gold = src.gold_items(cases)
    negs = src.negatives(cases)
    at = ["case_id", "turn"]

    # An erring request ends the replay: later requests are not seen.
    bad = views.where("error IS NOT NULL").groupBy("case_id").agg(F.min(F.struct("request_turn", "error")).alias("e"))
    views = views.join(bad, "case_id", "left").where(F.col("e").isNull() | (F.col("request_turn") <= F.col("e.request_turn"))).drop("e")

    # one alignment per message and request
    spans = gold.groupBy(*at).agg(F.sort_array(F.collect_list(F.struct("ord", "item_id", "start", "end"))).alias("item_spans"))
    nspans = negs.groupBy(*at).agg(F.sort_array(F.collect_list(F.struct("ord", "start", "end"))).alias("neg_spans"))
    original = src.messages(cases).select(*at, "role", "content")
    shown = views.join(original, at).join(spans, at, "left").join(nspans, at, "left").where("item_spans IS NOT NULL OR neg_spans IS NOT NULL OR role = 'user'")

    def pairs(c: str) -> Column:
        none = F.array().cast("array<struct<start: int, end: int>>")
        return F.coalesce(F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))), none)

    groups = F.array(pairs("item_spans"), pairs("neg_spans"))
    aligned = shown.withColumn("a", align.align(F.col("content"), F.col("masked"), groups, F.flatten(groups)))
    seen_by = {n: F.col("a.groups")[i][k] for n, i, k in (("together", 0, "together"), ("alone", 0, "alone"), ("neg_together", 1, "together"), ("neg_alone", 1, "alone"))}
    aligned = stored(aligned.select("case_id", "request_turn", "turn", "role", "spans", "item_spans", "neg_spans", *[c.alias(n) for n, c in seen_by.items()], F.col("a.ratio").alias("ratio")), "aligned")

    zipped = aligned.where("item_spans IS NOT NULL AND together IS NOT NULL").select("case_id", "request_turn", "turn", "spans", F.explode(F.arrays_zip("item_spans", "together", "alone")).alias("z"))
    seen = zipped.select("case_id", "request_turn", "turn", "spans", F.col("z.item_spans.item_id").alias("item_id"), F.col("z.item_spans.start").alias("s"), F.col("z.item_spans.end").alias("e"), "z.together", "z.alone")
    last = Window.partitionBy("case_id", "item_id").orderBy(F.desc("request_turn"))
    latest = seen.withColumn("k", F.row_number().over(last)).where("k = 1").drop("k")

    # stability: first-turn items, later requests against the first
    moved = seen.join(users, "case_id").where("turn = first_user")
    first = F.first("together.text").over(Window.partitionBy("case_id", "item_id").orderBy("request_turn"))
    stable = moved.withColumn("f", first).where("request_turn > first_user").groupBy("case_id").agg(F.bool_and(F.col("f") == F.col("together.text")).alias("stability"))

    # what the agent sees and writes
    item = gold.join(latest.select("case_id", "item_id", "spans", "s", "e", "together", "alone"), ["case_id", "item_id"], "left")
    text = F.col("alone.text")
    styled = {"rewriter": rewrite.rewrite(F.col("type"), text, pivot), "reformat": F.when(F.col("tool_param") == "phone", rewrite.reformat_phone(text, identifiers.draw(F.concat_ws(":", F.lit(str(seed)), "case_id"), "phone-format", 3))).otherwise(text)}.get(policy, text)
    order = F.map_keys("parts")
    with_city = F.array_contains(order, "city")

    def cut(kind: Column, c: Column) -> Column:
        address = rewrite.cut_address(c, with_city)
        fields = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), address[k].alias("value")) for k in ("city", "street", "house", "flat")]), lambda x: x["value"].isNotNull())
        return F.when(kind == "NAME", rewrite.cut_name(c, order)).otherwise(F.map_from_entries(fields))

    has_parts = F.col("parts").isNotNull() & (F.size("parts") > 0)
    whole = F.when(F.col("alone").isNotNull() & F.col("tool_param").isNotNull(), F.array(F.struct(F.col("tool_param").alias("key"), styled.alias("value"))))
    part_text = rewrite.rewrite(F.col("type"), text, pivot) if policy == "rewriter" else text
    entries = F.when(has_parts & F.col("alone").isNotNull(), F.map_entries(cut(F.col("type"), part_text))).otherwise(whole)
    # of a part that several items own, the first one's counts; a whole value's last
    first_owner = Window.partitionBy("case_id", "key", "cut").orderBy("ord")
    owned = item.withColumns({"entries": entries, "cut": has_parts}).select("case_id", "ord", "cut", F.explode("entries").alias("e")).select("case_id", "ord", "cut", "e.key", "e.value")
    owned = owned.withColumn("_k", F.row_number().over(first_owner)).where("_k = 1 OR NOT cut")
    said = owned.groupBy("case_id", "ord").agg(F.collect_list(F.struct("key", "value")).alias("entries")).groupBy("case_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("ord", "entries"))), lambda x: F.coalesce(x["entries"], F.array().cast("array<struct<key: string, value: string>>")))).alias("said"))

    request = aligned.join(users, "case_id").where("request_turn = last_user")
    neg_rows = aligned.where("neg_spans IS NOT NULL AND neg_together IS NOT NULL").select("case_id", "request_turn", "turn", F.explode(F.arrays_zip("neg_spans", "neg_together", "neg_alone")).alias("z"))
    neg_last = neg_rows.withColumn("k", F.row_number().over(Window.partitionBy("case_id", "z.neg_spans.ord").orderBy(F.desc("request_turn")))).where("k = 1")
    neg_seen = negs.join(neg_last.select("case_id", F.col("z.neg_spans.ord").alias("ord"), F.col("z.neg_together").alias("nt"), F.col("z.neg_alone").alias("na")), ["case_id", "ord"])
    plain = neg_seen.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("ord", "value", F.col("na.text").alias("text")))).alias("plain"))
    reached = request.select("case_id").distinct().withColumn("call_made", F.lit(True))
    keys = views.groupBy("case_id").agg(F.max_by("vault", "request_turn").alias("vault"))

    base = cases.select(F.col("id").alias("case_id"), "family", "register", "subcase", F.col("hard").isNotNull().alias("hard"), "expected_call").join(bad, "case_id", "left").join(users.select("case_id", "last_user"), "case_id", "left")
    call = base.join(said, "case_id", "left").join(plain, "case_id", "left").join(reached, "case_id", "left").join(keys, "case_id", "left")
    call = call.withColumn("call_made", F.coalesce("call_made", F.lit(False)) & F.col("e").isNull())
    none = F.array().cast("array<struct<key: string, value: string>>")
    wanted = F.filter(F.coalesce("said", none), lambda x: F.array_contains("expected_call.pii_params", x["key"]))

    def as_shown(v: Column) -> Column:
        return F.coalesce(F.try_element_at(F.filter("plain", lambda p: p["value"] == v), F.lit(1))["text"], v)

    others = F.transform(F.coalesce(F.map_entries("expected_call.plain_params"), none), lambda x: F.struct(x["key"].alias("key"), as_shown(x["value"]).alias("value")))
    arguments = F.to_json(_merge(F.concat(wanted, others)))
    call = call.withColumns({"arguments": F.when(F.col("call_made"), arguments), "vault": F.coalesce("vault", F.array().cast(f"array<{detect.TOKEN}>"))})
    if masker.restore is None:
        call = call.withColumn("restored", detect.restore(F.col("arguments"), F.col("vault")))
    else:
        call = stored(call, "calls")
        back = masker.restore(call.where("arguments IS NOT NULL")).select("case_id", "restored", F.col("error").alias("restore_error"))
        call = call.join(back, "case_id", "left")
        call = call.withColumn("e", F.coalesce("e", F.when(F.col("restore_error").isNotNull(), F.struct(F.col("last_user").alias("request_turn"), F.col("restore_error").alias("error"))))).drop("restore_error")
    call = call.withColumn("delivered_map", detect.arguments(F.col("restored"))).withColumn("arguments_parse", F.col("call_made") & F.col("delivered_map").isNotNull())

    # verdicts
    j = item.join(call.select("case_id", "call_made", "delivered_map"), "case_id")
    owed = rewrite.rewrite(F.col("type"), F.col("canonical"), pivot) if policy == "rewriter" else F.col("canonical")
    shared = F.coalesce("together.shared", F.lit(False))
    received = F.try_element_at("delivered_map", F.col("tool_param"))
    got = F.map_from_arrays(order, F.transform(order, lambda k: F.try_element_at("delivered_map", k)))
    j = j.withColumns({"owed": owed, "shared_block": shared, "got": got})
    j = j.withColumns({"owed_parts": F.when(has_parts, cut(F.col("type"), F.col("owed"))), "received": F.when(has_parts, F.to_json("got")).otherwise(received)})
    j = j.withColumn("by_parts", F.when(has_parts, judge.parts_verdict(order, F.col("got"), F.col("owed_parts"), pivot)))
    by_parts = F.col("by_parts")
    measured = F.col("tool_param").isNotNull() & F.col("call_made") & ~F.col("shared_block")
    simple = judge.round_trip(F.col("tool_param"), F.col("call_made"), F.col("shared_block"), F.col("received"), F.col("owed"))
    j = j.withColumn("round_trip", F.when(has_parts & measured, by_parts["round_trip"]).otherwise(simple))
    j = j.withColumn("mended", F.when(has_parts & measured, by_parts["normalised"]).otherwise(judge.repaired(F.col("round_trip"), F.col("received"), F.col("owed"), pivot)))
    mended = F.coalesce("mended", F.lit(False))
    covered = F.when((F.col("type") == "ADDRESS") & F.col("together.altered") & ~F.col("together.covered"), ~align.address_survives(F.col("value"), F.col("together.text"), cities)).otherwise(F.col("together.covered"))
    typed = F.try_element_at(F.filter("spans", lambda s: (s["start"] < F.col("end")) & (F.col("start") < s["end"])), F.lit(1))["type"]
    items = j.select(
        "case_id", "item_id", "type", "register", "family", "tier", "cue", "turn", "tool_param",
        F.coalesce("together.text", F.lit("")).alias("substitute"), F.coalesce("together.altered", F.lit(False)).alias("altered"), F.coalesce(covered, F.lit(False)).alias("covered"),
        typed.alias("typed_as"), F.col("received").alias("delivered"), "round_trip", mended.alias("normalised"), "shared_block", "identity",
    )
    neg_obs = neg_seen.select("case_id", "value", "kind", "register", "family", F.col("nt.altered").alias("touched"))

    # the second mention of a person
    people = items.where("type = 'NAME' AND family = 'second_mention'").join(users, "case_id")
    firsts = people.where("turn = first_user").groupBy("case_id", "identity").agg(F.max_by(F.struct("altered", "substitute"), "item_id").alias("one"))
    seconds = people.where("turn <> first_user").groupBy("case_id", "identity").agg(F.max_by(F.struct("altered", "substitute"), F.struct("turn", "item_id")).alias("two"))
    mention = firsts.join(seconds, ["case_id", "identity"]).select("case_id", judge.consistency(F.col("one.altered"), F.col("two.altered"), F.col("one.substitute"), F.col("two.substitute")).alias("consistency"))
    mention = mention.groupBy("case_id").agg(F.bool_and("consistency").alias("consistency"))

    ratio = aligned.where("role = 'user'").groupBy("case_id", "turn").agg(F.max_by("ratio", "request_turn").alias("r")).groupBy("case_id").agg(F.max("r").alias("rewrite_ratio"))
    out = call.join(mention, "case_id", "left").join(stable, "case_id", "left").join(ratio, "case_id", "left")
    case_obs = out.select(
        "case_id", "family", "register", "subcase", "hard", F.col("e.error").alias("error"), "call_made", F.when(F.col("call_made"), F.col("expected_call.name")).alias("call_name"),
        "arguments_parse", F.coalesce("rewrite_ratio", F.lit(0.0)).alias("rewrite_ratio"), "consistency", "stability",
    )
    return items, neg_obs, case_obs
