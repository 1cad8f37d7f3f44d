"""Synthesis of a corpus: a plan of cases, seeded draws, templates filled with surface forms, and exact spans.

All draws are hashes of (seed, attempt, family, register, index, slot), so the corpus is the same under any partitioning.
A case is made by one function from a row of the plan: its templates, slots and tools are the tables below.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rewrite
from ..functions.identifiers import REGIONS, RESERVE_CODES
from ..schema import CASE, PII
from ..session import ship_package
from ..sources.pools import SMALL, Pools
from . import surface
from .surface import Draws, Written, draw_person

# How many cases of each family in the registers clean, chat, sloppy; tiers with their percent of named cases.
PLAN = {
    "create_order": (18, 22, 20), "verify_identity": (16, 18, 16), "second_mention": (16, 20, 16), "send_sms": (12, 16, 12),
    "check_status": (12, 14, 12), "refund": (10, 12, 10), "decompose": (14, 16, 12),
}
REGISTERS = ("clean", "chat", "sloppy")
TIER_SHARES = {"common": 40, "tail": 30, "diminutive": 15, "foreign": 15}
NAMED = ("create_order", "verify_identity", "second_mention", "send_sms", "decompose")
#: Cities a case may name: the first so many of the pool.
ADDRESS_CITIES, BARE_CITIES = 200, 120


def plan(spark: SparkSession, counts: dict[str, tuple[int, int, int]] = PLAN) -> DataFrame:
    """(family, register, k, index, tier): k from 1 in a register, index from 0 in a family."""
    rows = [(f, r, i, n) for f, ns in counts.items() for i, (r, n) in enumerate(zip(REGISTERS, ns, strict=True)) if n > 0]
    each = spark.createDataFrame(rows, "family string, register string, rank int, n int").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    w = Window.partitionBy("family").orderBy("rank", "k")
    tier = F.when(F.col("family").isin(*NAMED), tier_at(F.col("k"), F.col("n"))).otherwise("common")
    return each.select("family", "register", "k", (F.row_number().over(w) - 1).alias("index"), tier.alias("tier"))


def allocate(total: int, shares: dict[str, int] = TIER_SHARES) -> dict[str, int]:
    """Integers near the percents that add up to total: what rounding leaves is dealt singly, the largest share first."""
    out = {k: total * v // 100 for k, v in shares.items()}
    for k in sorted(shares, key=lambda k: -shares[k])[: total - sum(out.values())]:
        out[k] += 1
    return out


def tier_at(rank: Column, total: Column, shares: dict[str, int] = TIER_SHARES) -> Column:
    """The tier of the rank-th (from 1) of total rows, by allocate(), tiers in the order of shares."""
    falling = sorted(shares, key=lambda k: -shares[k])
    whole = {k: F.floor(total * v / 100) for k, v in shares.items()}
    over = total
    for c in whole.values():
        over = over - c
    out, upto = F.lit(None).cast("string"), F.lit(0)
    bounds = []
    for k in shares:
        upto = upto + whole[k] + F.when(over > falling.index(k), 1).otherwise(0)
        bounds.append((k, upto))
    for k, bound in reversed(bounds):
        out = F.when(rank <= bound, k).otherwise(out)
    return out


def with_tiers(names: DataFrame, shares: dict[str, int], *keys: str) -> DataFrame:
    """names with a tier each: as many as the shares give within keys, dealt by a hash of the row."""
    w = Window.partitionBy(*keys).orderBy(F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in names.columns]).cast("binary")))
    n = F.count("*").over(Window.partitionBy(*keys))
    return names.withColumns({"_r": F.row_number().over(w), "_n": n}).withColumn("tier", tier_at(F.col("_r"), F.col("_n"), shares)).drop("_r", "_n")


SLOTS = "array<struct<key: string, value: string>>"


def assemble(parts: Column) -> Column:
    """struct(text, spans, ok) of literals (key null) and slots: spans has each slot's bounds; ok is false if a slot comes twice."""
    seed = F.struct(F.lit("").alias("text"), F.array().cast("array<struct<key: string, start: int, end: int>>").alias("spans"), F.lit(True).alias("ok"))

    def step(acc: Column, p: Column) -> Column:
        start = F.length(acc["text"])
        span = F.struct(p["key"].alias("key"), start.alias("start"), (start + F.length(p["value"])).alias("end"))
        twice = F.exists(acc["spans"], lambda s: s["key"] == p["key"])
        return F.struct(
            F.concat(acc["text"], p["value"]).alias("text"),
            F.when(p["key"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], F.array(span))).alias("spans"),
            (acc["ok"] & ~F.coalesce(twice, F.lit(False))).alias("ok"),
        )

    return F.aggregate(parts, seed, step)


def _slot(key: str | None, value) -> Column:
    return F.struct(F.lit(key).cast("string").alias("key"), (value if isinstance(value, Column) else F.lit(value)).alias("value"))


# --- tables --------------------------------------------------------------------------------------

#: Texts of the user by family (and variant) and tidiness; a slot with ! stands behind a cue word.
TEXTS = {
    ("create_order", True): (
        "Добрый вечер! Повторите доставку по заказу {order}. Получатель (ФИО): {name!}. Телефон: {phone!}. Адрес: {address!}. Прошлый раз платил {amount}.",
        "Прошу принять новый заказ. Получит его {name}, тел. {phone!}, привезти по адресу {address!}. Заказ {order} на {amount} пришёл целым.",
    ),
    ("create_order", False): (
        "хочу еще раз заказ {order} меня зовут {name!} тел {phone!} адрес {address!} было {amount}",
        "доставьте на {address!} {name} {phone!} а заказ {order} за {amount} уже пришел",
    ),
    ("check_status phone", True): ("Где посылка? Заказывал {date}, трек-номер {track}. Телефон в заказе: {phone!}.",),
    ("check_status phone", False): ("где посылка заказывал {date} трек {track} мой номер {phone!}",),
    ("check_status order", True): ("Здравствуйте. Что с заказом {order} от {date}? Трек {track} не ищется.",),
    ("check_status order", False): ("что с заказом {order} от {date} трек {track} не ищется",),
    ("verify_identity", True): ("Добрый день. Нужен остаток по договору {contract} от {date}. Сообщаю данные: ФИО {name!}, дата рождения {dob!}, {cue} {doc!}.",),
    ("verify_identity", False): ("сколько осталось по договору {contract} от {date} я {name} др {dob!} {cue} {doc!}",),
    ("refund", True): ("Верните, пожалуйста, деньги за заказ {order} от {date}, сумма {amount}. Номер карты: {card!}.",),
    ("refund", False): ("хочу возврат за {order} от {date} сумма {amount} карта {card!}",),
    ("send_sms", True): ("Напишите курьеру СМС на номер {phone!}: заказ {order} оплачен, {amount}, город {city}, жду с 9 до 12. {name}.",),
    ("send_sms", False): ("скинь смс на {phone!} заказ {order} оплачен {amount} город {city} жду с 9 до 12 {name}",),
    ("second_mention first", True): ("Добрый день, меня зовут {name1!}, телефон {phone1!}. Надо исправить контакты в заказе {order}.",),
    ("second_mention first", False): ("привет я {name1!} тел {phone1!} надо исправить контакты в заказе {order}",),
    ("second_mention second", True): ("Верно, запишите на {name2}, номер {phone2!}. К оплате по-прежнему {amount}.",),
    ("second_mention second", False): ("да запиши на {name2} номер {phone2!} к оплате так же {amount}",),
    ("decompose", True): (
        "Здравствуйте! Нужна карточка покупателя к заказу {order}. ФИО: {name!}. Телефон: {phone!}. Адрес: {address!}. Заказ на {amount}.",
        "У нас новый покупатель, это {name}, тел. {phone!}, живёт по адресу {address!}. Внесите его, заказ {order} на {amount}.",
    ),
    ("decompose", False): (
        "заведите карточку к заказу {order} меня зовут {name!} тел {phone!} адрес {address!} на {amount}",
        "внесите в базу {name} {phone!} живу {address!} заказ {order} на {amount}",
    ),
}
#: Slots of personal values: type and parameter of the tool; of names, whose person.
ITEMS = {
    "name": ("NAME", "name"), "name1": ("NAME", None), "name2": ("NAME", "name"), "phone": ("PHONE", "phone"), "phone1": ("PHONE", None), "phone2": ("PHONE", "phone"),
    "address": ("ADDRESS", "address"), "dob": ("DOB", "dob"), "passport": ("PASSPORT", "passport"), "snils": ("SNILS", "snils"), "card": ("CARD", "card"),
}
NEGATIVES = {"order": "order_no", "track": "track_no", "amount": "amount", "date": "doc_date", "city": "city", "contract": "invoice"}
#: Tools: description, parameters with descriptions, those required; parameters that carry negatives.
TOOLS = {
    "create_order": ("Новый заказ с доставкой.", {"name": "ФИО того, кто получит", "phone": "Телефон того, кто получит", "address": "Куда доставить, одной строкой", "comment": "Пожелания"}, ("name", "phone", "address")),
    "check_status": ("Состояние заказа по номеру или по телефону.", {"order_no": "Номер заказа", "phone": "Телефон, если номер не назван"}, ()),
    "verify_identity": ("Проверка личности.", {"name": "ФИО", "dob": "Дата рождения", "passport": "Паспорт", "snils": "СНИЛС"}, ("name",)),
    "refund": ("Возврат денег на карту.", {"order_no": "Номер заказа", "card": "Карта", "amount": "Сколько вернуть"}, ("order_no", "card", "amount")),
    "send_sms": ("Сообщение на телефон.", {"phone": "Кому", "text": "Что написать"}, ("phone", "text")),
    "update_contact": ("Новые контакты клиента.", {"name": "ФИО", "phone": "Телефон", "email": "Почта"}, ("name",)),
    "create_contact": (
        "Карточка клиента, по полям.",
        {"last_name": "Фамилия", "first_name": "Имя", "middle_name": "Отчество", "city": "Город", "street": "Улица", "house": "Дом", "flat": "Квартира", "phone": "Телефон"},
        ("last_name", "first_name", "street", "house", "phone"),
    ),
}
TOOL_OF = {f: f for f in PLAN} | {"second_mention": "update_contact", "decompose": "create_contact"}
PLAIN = {"check_status order": ("order",), "refund": ("order", "amount")}
NOT_FOUND = {"none": "no personal value: only overmasking is measured", "name": "a name in small letters has no capitals to find", "number": "a number that lost its shape"}
_SLOT = re.compile(r"\{(\w+)(!?)\}")


def tool_definition(name: str) -> dict:
    about, params, required = TOOLS[name]
    return {"type": "function", "function": {"name": name, "description": about, "parameters": {"type": "object", "properties": {k: {"type": "string", "description": v} for k, v in params.items()}, "required": list(required)}}}


def tools_for(name: str) -> list[dict]:
    """The tool and two others. The six older tools are a ring, from which the next two come; the newest takes the first two."""
    ring = [t for t in TOOLS if t != "create_contact"]
    at = ring.index(name) + 1 if name in ring else 0
    return [tool_definition(t) for t in (name, *(ring[(at + i) % len(ring)] for i in range(2)))]


# --- one case ---------------------------------------------------------------------------------------


def _values(family: str, register: str, tier: str, pools: Pools, d: Draws) -> tuple[dict[str, Written], dict]:
    """Written values of all slots that a family may use, and what else was decided."""
    tidy = register == "clean"
    person = draw_person(pools, tier, d)
    digits = d.of("code", RESERVE_CODES) + d.digits("phone", 7)
    city, street = d.of("city", pools.cities[:ADDRESS_CITIES]), d.of("street", pools.streets)
    rub = d.between("hundreds", 3, 120) * 100 + d.of("rest", (0, 50, 90))
    order = f"{d.between('order', 1000, 9999)}-{d.between('order-end', 100, 999)}"
    bare = d.of("bare-city", pools.cities[:BARE_CITIES])
    v = {
        "name": person.full(register, d, "name"), "phone": surface.number("PHONE", digits, register, d, "phone"),
        "address": surface.address(city, street, d.between("house", 1, 120), d.between("flat", 1, 240), register, d, "address"),
        "dob": surface.birth_date(d.between("day", 1, 28), d.between("month", 1, 12), d.between("born", 1955, 2004), register, d, "dob"),
        "order": Written(f"№ {order}" if tidy else order), "track": Written(d.digits("track", 14)), "contract": Written(f"{d.between('contract', 100, 999)}/{d.between('contract-end', 10, 99)}"),
        "amount": Written(f"{rub:,}".replace(",", " ") + (" ₽" if tidy else " руб")), "date": Written(f"{d.between('doc-day', 1, 28):02d}.{d.between('doc-month', 1, 12):02d}.2026"),
        "city": Written(bare if tidy else bare.lower()),
    }
    more: dict = {"person": person}
    if family == "send_sms":
        v["name"] = person.alone(register, d, "name")
    elif family == "refund":
        v["card"] = surface.number("CARD", card_digits(d), register, d, "card")
    elif family == "verify_identity":
        kind = d.of("document", ("passport", "snils"))
        own = d.of("region", REGIONS) + str(d.between("issued", 10, 24)) + str(d.between("number", 100000, 999999)) if kind == "passport" else snils_digits(d)
        v["doc"] = surface.number(kind.upper(), own, register, d, "doc")
        more |= {"doc": kind, "cue": "паспорт" if kind == "passport" else ("СНИЛС" if tidy else "снилс")}
    elif family == "second_mention":
        subcase = d.of("subcase", ("lower", "declined", "reformatted"))
        first, phone = v["name"], v["phone"]
        again = Written(first.text.lower(), False) if not tidy or subcase == "lower" else first
        if subcase == "declined":
            text = person.declined(d.of("case", ("acc", "dat")))
            again = Written(text, True) if tidy else Written(text.lower(), False)
        other = surface.number("PHONE", digits, "chat" if tidy else "clean", d, "phone2") if subcase == "reformatted" else phone
        v |= {"name1": first, "phone1": phone, "name2": again, "phone2": other}
        more["subcase"] = subcase
    elif family == "decompose":
        parts = person.parts(register, d, "name")
        text = v["address"].text.lower()
        # a street comes first, if no city does
        more |= {"order": [k for k, _ in parts], "with_city": text.removeprefix("г. ").startswith(city.lower())}
    return v, more


def card_digits(d: Draws) -> str:
    body = "2200" + d.digits("card", 11)
    doubled = [int(c) * 2 if i % 2 == 0 else int(c) for i, c in enumerate(body)]
    return body + str(-sum(x - 9 if x > 9 else x for x in doubled) % 10)


def snils_digits(d: Draws) -> str:
    body = str(d.between("snils-first", 1, 9)) + d.digits("snils", 8)
    return f"{body}{sum(int(c) * (9 - i) for i, c in enumerate(body)) % 101 % 100:02d}"


def make_case(family: str, register: str, index: int, tier: str, seed: int, attempt: int, pools: Pools) -> dict:
    """A case as a dictionary of the case format; for decompose with the order of the name's parts and whether a city is named."""
    d = Draws(":".join(map(str, (seed, attempt, family, register, index))))
    v, more = _values(family, register, tier, pools, d)
    variant = {"check_status": "check_status phone" if d.chance("by-phone", 70) else "check_status order"}.get(family, family)
    case_id = f"{family}-{register}-{index + 1:03d}"
    turns = [f"{family} first", f"{family} second"] if family == "second_mention" else [variant]
    messages = [{"role": "system", "content": f"Ты помогаешь покупателям магазина. Отвечай кратко, для действий вызывай инструменты и передавай значения так, как их назвали. Метка: [case:{case_id}]."}]
    pii, negatives, shaped = [], [], {}
    for n, key in enumerate(turns):
        if n:
            messages.append({"role": "assistant", "content": "Принято."})
        template = d.of(f"text-{n}", TEXTS[key, register == "clean"]).replace("{cue}", more.get("cue", ""))
        text, at = "", 0
        for m in _SLOT.finditer(template):
            text += template[at : m.start()]
            at = m.end()
            slot, value = m.group(1), v[m.group(1)]
            span = {"turn": len(messages), "start": len(text), "end": len(text) + len(value.text), "value": value.text}
            text += value.text
            if slot in NEGATIVES:
                negatives.append({"kind": NEGATIVES[slot]} | span)
                continue
            kind, param = ITEMS[more["doc"] if slot == "doc" else slot]
            if family == "send_sms" and kind == "NAME":
                param = None
            if family == "decompose":
                param = {"NAME": "last_name", "ADDRESS": "street"}.get(kind, param)
            shaped[kind] = shaped.get(kind, False) or value.shaped
            is_name = kind == "NAME"
            pii.append({"id": f"p{len(pii) + 1}", "type": kind, "canonical": value.text, "tool_param": param, "cue": bool(m.group(2)), "tier": more["person"].tier if is_name else None, "identity": "person1", "parts": None} | span)
        messages.append({"role": "user", "content": text + template[at:]})
    why = None if any(shaped.values()) else [NOT_FOUND["none"]] if not shaped else [NOT_FOUND[k] for k, on in (("name", "NAME" in shaped), ("number", set(shaped) - {"NAME"})) if on]
    tool = TOOL_OF[family]
    return {
        "id": case_id, "version": "0.1", "family": family, "register": register, "subcase": more.get("subcase"), "messages": messages, "tools": tools_for(tool),
        "expected_call": {"name": tool, "pii_params": [p["tool_param"] for p in pii if p["tool_param"]], "plain_params": {NEGATIVES[s]: v[s].text for s in PLAIN.get(variant, ())}},
        "pii": pii, "negatives": negatives, "hard": {"why": "; ".join(why)} if why else None, "created_at": "2026-01-01",
        "source": {"generator": "veilgauge", "version": "0.1", "seed": seed}, "canary": "veilgauge-fixture", "license": "CC0-1.0", "order": more.get("order"), "with_city": more.get("with_city"),
    }


# --- the corpus -----------------------------------------------------------------------------------------

ATTEMPTS = 50


def _made(rows: DataFrame, seed: int, pools: Pools) -> DataFrame:
    """Rows of the plan as cases, with the digest of their user texts. Values to be cut are cut by the agent's own rule."""
    from .results import content_digest

    ship_package()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cases = [json.dumps(make_case(r["family"], r["register"], r["index"], r["tier"], seed, r["attempt"], pools), ensure_ascii=False) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("index"), b.column("attempt"), pa.array(cases, pa.string())], ["index", "attempt", "json"])

    kind = T.StructType([*CASE.fields, T.StructField("order", T.ArrayType(T.StringType())), T.StructField("with_city", T.BooleanType())])
    cases = rows.select("family", "register", "index", "tier", "attempt").mapInArrow(make, "index int, attempt int, json string")
    c = cases.select("index", "attempt", F.from_json("json", kind, {"mode": "FAILFAST"}).alias("c")).select("index", "attempt", "c.*")
    address = lambda p: rewrite.cut_address(p["value"], F.col("with_city"))
    fields = lambda p: F.filter(F.array(*[F.struct(F.lit(k).alias("key"), address(p)[k].alias("value")) for k in ("city", "street", "house", "flat")]), lambda x: x["value"].isNotNull())
    parts = lambda p: F.when(p["type"] == "NAME", rewrite.cut_name(p["value"], F.col("order"))).when(p["type"] == "ADDRESS", F.map_from_entries(fields(p)))
    cut = F.col("order").isNotNull()
    whole = F.transform("pii", lambda p: F.struct(*[F.when(cut, parts(p)).alias("parts") if n == "parts" else p[n].alias(n) for n in PII.names]))
    pieces = F.array(*[F.lit(k) for k in ("city", "street", "house", "flat")])
    params = F.when(cut, F.concat("order", F.array(F.lit("phone")), F.filter(pieces, lambda k: F.col("with_city") | (k != "city")))).otherwise(F.col("expected_call.pii_params"))
    call = F.struct("expected_call.name", params.alias("pii_params"), "expected_call.plain_params")
    digest = content_digest(F.transform(F.filter("messages", lambda m: m["role"] == "user"), lambda m: m["content"]))
    return c.withColumns({"pii": whole, "expected_call": call, "digest": digest}).drop("order", "with_city")


def generate(spark: SparkSession, seed: int = 1, counts: dict[str, tuple[int, int, int]] = PLAN, pools: Pools = SMALL) -> DataFrame:
    """Cases in the case format. While cases have equal texts, all but the first of them are drawn again."""
    rows = plan(spark, counts).withColumn("attempt", F.lit(0))
    order = Window.partitionBy("digest").orderBy("family", "register", "index")
    for _ in range(ATTEMPTS):
        made = _made(rows, seed, pools)
        again = made.withColumn("_k", F.row_number().over(order)).where("_k > 1").select("family", "register", "index").collect()
        if not again:
            return made.drop("digest", "index", "attempt")
        redo = spark.createDataFrame([tuple(r) for r in again], "family string, register string, index int").withColumn("more", F.lit(1))
        rows = rows.join(F.broadcast(redo), ["family", "register", "index"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("more", F.lit(0))).drop("more")
    raise ValueError("the pools are too small for so many different cases")
