"""Detection and redaction on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from umbra.functions.spans import exploded
from umbra.operators.detect import Settings, detect, standing_spans
from umbra.operators.redact import TOKEN, token_number


def detect_stream(units: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Detections of a stream of units. Each unit is looked at whole in its own row, so the stream needs no state."""
    return detect(units, settings)


def number_stream(units: DataFrame, settings: Settings = Settings(), forget_after_ms: int | None = None) -> DataFrame:
    """A stream of units -> a stream of (doc_id, value, entity, token): tokens numbered by document across batches, past the tokens that
    its texts hold already (as far as they have come).

    State by document: the last number of each entity, and the tokens of its values. forget_after_ms drops the state of a document
    that long without news; streams that never end need it, while a stream that is to end with its input can't have it.
    Values of a batch are met in order of their unit, then from the last span to the first.
    """
    kind = "array<struct<entity:string,value:string,st:int,seed:bigint>>"
    held = F.transform(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)), lambda t: F.struct(F.regexp_extract(t, TOKEN, 1).alias("entity"), F.lit(None).cast("string").alias("value"), F.lit(0).alias("st"), token_number(t).alias("seed")))
    met = F.transform("_standing", lambda s: F.struct(s["entity"].alias("entity"), s["value"].alias("value"), s["st"].alias("st"), F.lit(None).cast("bigint").alias("seed")))
    both = F.concat(F.coalesce(met, F.array().cast(kind)), F.coalesce(held, F.array().cast(kind)))
    found = exploded(standing_spans(units, settings), both, "s", "doc_id", "ord").select("doc_id", "ord", "s.*")

    def number(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        counters, values = ({}, {}) if not state.exists else (dict(zip(*state.get[:2], strict=True)), dict(zip(*state.get[2:], strict=True)))
        fresh = []
        first: dict[str, tuple] = {}  # a new value's first place in this batch: a row a value is held, not a row a detection
        for rows in batches:
            for place, st, entity, value, seed in zip(rows["ord"], rows["st"], rows["entity"], rows["value"], rows["seed"], strict=True):
                if value is None:
                    if not pd.isna(seed):
                        counters[entity] = max(counters.get(entity, 0), int(seed))
                elif value not in values:
                    met = (-1 if pd.isna(place) else place, -st, entity)
                    first[value] = min(first.get(value, met), met)
        for value, (_, _, entity) in sorted(first.items(), key=lambda x: (x[1], x[0])):
            counters[entity] = counters.get(entity, 0) + 1
            values[value] = f"[{entity}_{counters[entity]}]"
            fresh.append((key[0], value, entity, values[value]))
        state.update((list(counters), list(counters.values()), list(values), list(values.values())))
        if forget_after_ms:
            state.setTimeoutDuration(forget_after_ms)
        yield pd.DataFrame(fresh, columns=["doc_id", "value", "entity", "token"])

    return found.groupBy("doc_id").applyInPandasWithState(
        number, "doc_id long, value string, entity string, token string",
        "entities array<string>, numbers array<long>, known array<string>, tokens array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout if forget_after_ms else GroupStateTimeout.NoTimeout,
    )


def entity_counts(units: DataFrame, time_col: str, settings: Settings = Settings(), late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Detections by entity and window of event time; what comes later than `late` is dropped."""
    found = exploded(standing_spans(units.withWatermark(time_col, late), settings), "_standing", "s", time_col)
    return found.groupBy(F.window(time_col, window), F.col("s.entity").alias("entity")).agg(F.count("*").alias("n"))
