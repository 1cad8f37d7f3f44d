"""Masking of a stream of messages: placeholders stay the same through a conversation, across batches."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from ..operators import detect

OUT = "conv_id long, turn long, masked string, tokens int"
STATE = "counts string, tokens string"


def _advance(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """A conversation's new messages by turn, however they were cut into frames: they are few, its vault is the state."""
    counts, tokens = (json.loads(x) for x in state.get) if state.exists else ({}, {})
    batch = pd.concat(list(frames)).sort_values(["turn", "text"], kind="stable")
    masked, known = [], []
    for text, kinds, values in zip(batch["text"], batch["kinds"], batch["values"], strict=True):
        for kind, value in zip(kinds, values, strict=True):
            if value not in tokens:
                counts[kind] = counts.get(kind, 0) + 1
                tokens[value] = f"<{kind}_{counts[kind]}>"
            text = text.replace(value, tokens[value])
        masked.append(text)
        known.append(len(tokens))
    state.update((json.dumps(counts), json.dumps(tokens)))
    yield pd.DataFrame({"conv_id": key[0], "turn": batch["turn"].to_numpy(), "masked": masked, "tokens": known})


def mask_stream(messages: DataFrame, patterns: tuple = detect.RUSSIAN) -> DataFrame:
    """messages: a stream (conv_id long, turn long, text string). Claims are made inside the JVM; only the vault, one state
    per conversation, is kept by the stateful operator. A state is as large as its conversation's distinct values."""
    ship_package()
    found = messages.where("text IS NOT NULL").withColumn("c", detect.claims(F.col("text"), patterns))
    flat = found.select("conv_id", "turn", "text", F.transform("c", lambda x: x["type"]).alias("kinds"), F.transform("c", lambda x: x["value"]).alias("values"))
    return flat.groupBy("conv_id").applyInPandasWithState(_advance, OUT, STATE, "append", "NoTimeout")


def windowed_counts(events: DataFrame, time: str, kind: str, *, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Rows per window and kind of a stream of events; rows later than late are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")
