"""The data model: cases with their gold spans and negatives, observations, and run files."""

from __future__ import annotations

from pyspark.sql import types as T

# The vocabularies of the case format.
TYPES = ("NAME", "PHONE", "EMAIL", "SNILS", "INN", "PASSPORT", "CARD", "DOB", "ADDRESS")
REGISTERS = ("clean", "chat", "sloppy")
FAMILIES = ("create_order", "check_status", "verify_identity", "refund", "send_sms", "second_mention", "decompose")
SUBCASES = ("lower", "declined", "reformatted")
TIERS = ("common", "tail", "diminutive", "foreign")
NEGATIVE_KINDS = ("order_no", "track_no", "amount", "doc_date", "city", "invoice")
POLICIES = ("copier", "reformat", "rewriter")
LINES = ("leak", "coverage", "typed", "round_trip", "round_trip_repaired", "end_to_end", "overmask", "consistency", "stability")

S, L, I, B, D = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.DoubleType()


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


MESSAGE = _struct(("role", S), ("content", S))
#: parts are named pieces of a value; their order is the order in which the value is cut
PII = _struct(
    ("id", S), ("type", S), ("value", S), ("canonical", S), ("turn", I), ("start", I), ("end", I),
    ("tool_param", S), ("cue", B), ("tier", S), ("identity", S), ("parts", T.MapType(S, S)),
)
NEGATIVE = _struct(("value", S), ("kind", S), ("turn", I), ("start", I), ("end", I))
CALL = _struct(("name", S), ("pii_params", T.ArrayType(S)), ("plain_params", T.MapType(S, S)))
SOURCE = _struct(("generator", S), ("version", S), ("seed", L))
_PARAMETERS = _struct(("type", S), ("properties", T.MapType(S, _struct(("type", S), ("description", S)))), ("required", T.ArrayType(S)))
TOOL = _struct(("type", S), ("function", _struct(("name", S), ("description", S), ("parameters", _PARAMETERS))))
CASE = _struct(
    ("id", S), ("version", S), ("family", S), ("register", S), ("subcase", S), ("messages", T.ArrayType(MESSAGE)),
    ("tools", T.ArrayType(TOOL)), ("expected_call", CALL), ("pii", T.ArrayType(PII)), ("negatives", T.ArrayType(NEGATIVE)),
    ("hard", T.MapType(S, S)), ("created_at", S), ("source", SOURCE), ("canary", S), ("license", S),
)

SPAN = _struct(("start", I), ("end", I), ("type", S), ("value", S), ("rank", I))
SUBSTITUTE = _struct(("text", S), ("altered", B), ("covered", B), ("shared", B))

ITEM_OBS = _struct(
    ("case_id", S), ("item_id", S), ("type", S), ("register", S), ("family", S), ("tier", S), ("cue", B), ("turn", I),
    ("tool_param", S), ("substitute", S), ("altered", B), ("covered", B), ("typed_as", S), ("delivered", S),
    ("round_trip", B), ("normalised", B), ("shared_block", B), ("identity", S),
)
NEG_OBS = _struct(("case_id", S), ("value", S), ("kind", S), ("register", S), ("family", S), ("touched", B))
CASE_OBS = _struct(
    ("case_id", S), ("family", S), ("register", S), ("subcase", S), ("hard", B), ("error", S), ("call_made", B), ("call_name", S),
    ("arguments_parse", B), ("rewrite_ratio", D), ("consistency", B), ("stability", B), ("items", T.ArrayType(ITEM_OBS)), ("negatives", T.ArrayType(NEG_OBS)),
)
MANIFEST = _struct(
    ("system", S), ("adapter_config", T.MapType(S, S)), ("policy", S), ("seed", L), ("corpus_digest", S), ("corpus_cases", L),
    ("benchmark_version", S), ("run_at", S), ("python", S), ("submitted_by", S), ("notes", S),
)
LINE = _struct(("hits", L), ("total", L), ("rate", D), ("ci95", T.ArrayType(D)), ("certifies", D))
RUN = _struct(("cases", L), ("errors", L), ("calls_made", L), ("calls_parsed", L), ("rewrite_flagged", L), ("unattributable", L), ("normalised", L))
RUN_FILE = _struct(("manifest", MANIFEST), ("lines", T.MapType(S, LINE)), ("run", RUN), ("observations", T.ArrayType(CASE_OBS)), ("rescored", _struct(("benchmark_version", S))))
