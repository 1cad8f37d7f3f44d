"""Maskers behind one interface, and the registry that builds them.

A masker gives views, what each request shows, and restores a call's arguments. Those that Spark computes itself are
expressions. All others are sessions, one for each case, opened in the task that holds the case: an entity engine, a pair
of scanners over a vault, a service next to the gateway, a proxy in front of the model. Engines and transports are
passed in, so that a session needs no network of its own. What a session must remember is its vault, which
travels with the rows: restoring needs no task to outlive another.

Failures are data: a request that cannot be masked carries its error, and so does a call that cannot be restored.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import detect
from ..session import ship_package
from ..sources import cases as src

VIEW = f"case_id string, request_turn int, turn int, masked string, spans array<{detect.SPAN}>, vault array<{detect.TOKEN}>, error string"
# What entity engines call the types.
ENTITY_TYPES = {"PERSON": "NAME", "PHONE_NUMBER": "PHONE", "EMAIL_ADDRESS": "EMAIL", "LOCATION": "ADDRESS", "CREDIT_CARD": "CARD", "DATE_TIME": "DOB", "IBAN_CODE": "CARD"}


@dataclass(frozen=True)
class Masker:
    """views: cases -> rows of VIEW. restore: (case_id, arguments, vault) -> (case_id, restored, error); by the vault, if None."""

    name: str
    views: Callable[[DataFrame], DataFrame]
    restore: Callable[[DataFrame], DataFrame] | None = None
    config: dict[str, str] = field(default_factory=dict)


def requests(cases: DataFrame) -> DataFrame:
    """A row per request and message shown in it."""
    p = src.prefixes(cases).select(F.col("id").alias("case_id"), "request_turn", F.posexplode("prefix").alias("turn", "m"))
    return p.select("case_id", "request_turn", "turn", "m.role", "m.content")


def _none(kind: str):
    return F.lit(None).cast(kind)


def noop(cases: DataFrame) -> DataFrame:
    """The identity."""
    shown = requests(cases).select("case_id", "request_turn", "turn", F.col("content").alias("masked"))
    return shown.withColumns({"spans": _none(f"array<{detect.SPAN}>"), "vault": F.array().cast(f"array<{detect.TOKEN}>"), "error": _none("string")})


def placeholder_regex(cases: DataFrame, patterns: tuple = detect.RUSSIAN) -> DataFrame:
    """Placeholders from ordered patterns; one vault for the whole conversation, values numbered as first seen."""
    m = src.messages(cases).withColumn("claims", detect.claims(F.col("content"), patterns))
    whole = m.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("turn", "claims"))).alias("c"))
    known = whole.select("case_id", detect.vault(F.flatten(F.transform("c", lambda x: x["claims"]))).alias("vault"))
    both = m.join(known, "case_id")
    tokens = F.transform("claims", lambda c: F.filter("vault", lambda v: v["value"] == c["value"])[0])
    masked = both.withColumns({"masked": detect.mask_everywhere(F.col("content"), tokens), "spans": detect.spans(F.col("claims"))})
    return masked.select("case_id", "turn", "masked", "spans", "vault").join(requests(cases).select("case_id", "request_turn", "turn"), ["case_id", "turn"]).withColumn("error", _none("string"))


# --- sessions --------------------------------------------------------------------------------------------


class Session:
    """One conversation. vault: (type, n, token, value) tuples, which restore_arguments() of another session may be given."""

    def __init__(self, case_id: str):
        self.case_id = case_id
        self.vault: list[tuple[str, int, str, str]] = []

    def mask(self, messages: list[dict], tools: list[dict]) -> list[str | None]:
        """The contents of all messages, as the model is shown them."""
        raise NotImplementedError

    def restore_arguments(self, arguments: str) -> str:
        for _, _, token, value in self.vault:
            arguments = arguments.replace(token, value)
        return arguments

    def spans(self, text: str) -> list[tuple[int, int, str]] | None:
        """Typed spans, or None where a masker does not show them."""
        return None


class EntitySession(Session):
    """analyze(text) gives (start, end, entity type); each is replaced by a placeholder, from right to left, so that offsets stay true."""

    def __init__(self, case_id: str, analyze: Callable[[str], list[tuple[int, int, str]]]):
        super().__init__(case_id)
        self.analyze = analyze

    def _token(self, kind: str, value: str) -> str:
        known = next((t for _, _, t, v in self.vault if v == value), None)
        if known is None:
            n = 1 + sum(k == kind for k, *_ in self.vault)
            known = f"<{kind}_{n}>"
            self.vault.append((kind, n, known, value))
        return known

    def _masked(self, text: str) -> str:
        out = text
        for start, end, kind in sorted(self.analyze(text), key=lambda s: -s[0]):
            out = out[:start] + self._token(kind, text[start:end]) + out[end:]
        return out

    def mask(self, messages, tools):
        return [self._masked(m["content"]) if isinstance(m["content"], str) else m["content"] for m in messages]

    def spans(self, text):
        return [(s, e, ENTITY_TYPES.get(kind, kind)) for s, e, kind in sorted(self.analyze(text))]


class ScannerSession(Session):
    """scanners(vault) gives two functions, anonymize(text) and deanonymize(text), over a list of (token, value) that they share."""

    def __init__(self, case_id: str, scanners: Callable[[list], tuple[Callable[[str], str], Callable[[str], str]]]):
        super().__init__(case_id)
        self.scanners = scanners
        self.pairs: list[tuple[str, str]] = []
        self.anonymize, _ = scanners(self.pairs)

    def mask(self, messages, tools):
        out = [self.anonymize(m["content"]) if isinstance(m["content"], str) else m["content"] for m in messages]
        self.vault = [("", i + 1, token, value) for i, (token, value) in enumerate(self.pairs)]
        return out

    def restore_arguments(self, arguments):
        return self.scanners([(token, value) for _, _, token, value in self.vault])[1](arguments)


class ServiceSession(Session):
    """A service that keeps the conversation itself: post(path, payload) gives its answer as a dictionary, or raises."""

    def __init__(self, case_id: str, post: Callable[[str, dict], dict], org_id: str):
        super().__init__(case_id)
        self.post, self.head = post, {"org_id": org_id, "conversation_id": case_id}

    def mask(self, messages, tools):
        shown = self.post("/mask", self.head | {"messages": messages, "tools": tools}).get("messages")
        return [m.get("content") for m in (shown if isinstance(shown, list) else messages)]

    def restore_arguments(self, arguments):
        found = self.post("/unmask_arguments", self.head | {"arguments": [arguments]}).get("arguments")
        return str(found[0]) if isinstance(found, list) and found else arguments

    def spans(self, text):
        try:
            found = self.post("/spans", self.head | {"texts": [text]}).get("results")
        except Exception:  # noqa: BLE001 - a service without this call does not show its spans
            return None
        if not (isinstance(found, list) and found and isinstance(found[0], list)):
            return None
        return [(int(s["start"]), int(s["end"]), str(s["type"])) for s in found[0]]


class ProxySession(Session):
    """A proxy between agent and model: send(payload, model) passes a request on, where model(messages) answers with a message.

    A request is sent once to see what the model is shown. The call that the agent then decides on is the model's
    answer when the last request is sent again, and what comes back are the restored arguments.
    """

    def __init__(self, case_id: str, send: Callable[[dict, Callable[[list[dict]], dict]], dict], model: str):
        super().__init__(case_id)
        self.send, self.model = send, model
        self.payload: dict = {}

    def _passed(self, answer: dict) -> tuple[list[dict], dict]:
        shown: list[list[dict]] = []

        def upstream(messages: list[dict]) -> dict:
            shown.append(messages)
            return answer

        body = self.send(self.payload, upstream)
        if not shown:
            raise RuntimeError("the proxy answered without calling the upstream")
        choices = body.get("choices")
        if not isinstance(choices, list) or not choices or not isinstance(choices[0], dict):
            raise RuntimeError("no choices in the proxy answer")
        message = choices[0].get("message")
        if not isinstance(message, dict):
            raise RuntimeError("no message in the proxy answer")
        return shown[-1], message

    def mask(self, messages, tools):
        self.payload = {"model": self.model, "messages": messages, "tools": tools, "temperature": 0, "stream": False}
        shown, _ = self._passed({"role": "assistant", "content": "Принято."})
        self.vault = [("", 0, "", json.dumps(self.payload, ensure_ascii=False))]
        return [m.get("content") for m in shown]

    def restore_arguments(self, arguments):
        self.payload = json.loads(self.vault[-1][3])
        name = self.payload["tools"][0]["function"]["name"] if self.payload["tools"] else ""
        call = {"id": "call", "type": "function", "function": {"name": name, "arguments": arguments}}
        _, message = self._passed({"role": "assistant", "content": None, "tool_calls": [call]})
        calls = message.get("tool_calls")
        if not isinstance(calls, list) or not calls:
            raise RuntimeError("no call in the proxy answer")
        return str(calls[0].get("function", {}).get("arguments", ""))


def sessions(name: str, open_session: Callable[[str], Session], config: dict[str, str] | None = None) -> Masker:
    """A masker of Python sessions. A case's requests are in one task, in order; a failed one ends its conversation."""

    def view(case_id: str, request_turn: int, turn: int, masked: str | None, spans, vault, error: str | None) -> tuple:
        return case_id, request_turn, turn, masked, spans, vault, error

    def conversation(case_id: str, rows: list[dict]) -> Iterator[tuple]:
        session = open_session(case_id)
        for r in rows:
            messages = [{"role": m["role"], "content": m["content"]} for m in r["prefix"]]
            try:
                shown = session.mask(messages, json.loads(r["tools"] or "[]"))
                found = [session.spans(m["content"]) if isinstance(m["content"], str) else None for m in messages]
            except Exception as e:  # noqa: BLE001 - the masker's failure is the measurement
                yield view(case_id, r["request_turn"], 0, None, None, [], f"mask failed: {e}")
                return
            vault = [dict(zip(("type", "n", "token", "value"), v, strict=True)) for v in session.vault]
            for turn, (m, masked, own) in enumerate(zip(messages, shown, found, strict=False)):
                spans = None if own is None else [{"start": s, "end": e, "type": k, "value": m["content"][s:e], "rank": 0} for s, e, k in own]
                yield view(case_id, r["request_turn"], turn, masked if isinstance(masked, str) else None, spans, vault, None)

    def views(cases: DataFrame) -> DataFrame:
        ship_package()
        asked = src.prefixes(cases).select(F.col("id").alias("case_id"), "request_turn", "prefix", F.to_json("tools").alias("tools"))

        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            out = list(conversation(key[0], rows.sort_values("request_turn").to_dict("records")))
            return pd.DataFrame(out, columns=["case_id", "request_turn", "turn", "masked", "spans", "vault", "error"])

        return asked.groupBy("case_id").applyInPandas(run, VIEW)

    def restore(calls: DataFrame) -> DataFrame:
        ship_package()

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                out = []
                for case_id, arguments, vault in zip(f["case_id"], f["arguments"], f["vault"], strict=True):
                    session = open_session(case_id)
                    session.vault = [(v["type"], v["n"], v["token"], v["value"]) for v in (vault if vault is not None else [])]
                    try:
                        out.append((case_id, session.restore_arguments(arguments), None))
                    except Exception as e:  # noqa: BLE001
                        out.append((case_id, None, f"restore failed: {e}"))
                yield pd.DataFrame(out, columns=["case_id", "restored", "error"])

        return calls.select("case_id", "arguments", "vault").mapInPandas(run, "case_id string, restored string, error string")

    return Masker(name, views, restore, config or {})


# --- the registry ----------------------------------------------------------------------------------------------

#: Names, and the options that each must be given.
NEEDS: dict[str, tuple[str, ...]] = {"noop": (), "placeholder_regex": (), "entity_engine": ("analyze",), "vault_scanners": ("scanners",), "service": ("post",), "proxy": ("send",)}


def build(name: str, /, **options) -> Masker:
    """The masker of a name. An unknown name or a missing option is an error that says what is missing: no system is skipped in silence."""
    if name not in NEEDS:
        raise ValueError(f"unknown masker {name!r}; known are {', '.join(NEEDS)}")
    if missing := [o for o in NEEDS[name] if options.get(o) is None]:
        raise ValueError(f"masker {name!r} needs {', '.join(missing)}")
    shown, config = options.pop("name", name), {k: str(v) for k, v in options.items() if not callable(v)}
    if name == "noop":
        return Masker(shown, noop, config=config)
    if name == "placeholder_regex":
        return Masker(shown, placeholder_regex, config=config)
    if name == "entity_engine":
        return sessions(shown, lambda case_id: EntitySession(case_id, options["analyze"]), config)
    if name == "vault_scanners":
        return sessions(shown, lambda case_id: ScannerSession(case_id, options["scanners"]), config)
    if name == "service":
        return sessions(shown, lambda case_id: ServiceSession(case_id, options["post"], options.get("org_id", "")), config)
    return sessions(shown, lambda case_id: ProxySession(case_id, options["send"], options.get("model", "")), config)
