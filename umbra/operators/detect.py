"""From units of text to detections."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions import names as person_names
from umbra.functions.patterns import Detector, detectors
from umbra.functions.spans import FIELDS, exploded, line_number, resolved, with_spans
from umbra.operators.suppress import company_form_is_upper
from umbra.plans.catalog import ENTITIES, selected

#: Columns of a unit of text, and of a detection.
UNIT = ("doc_id", "ctx", "ord", "text")
DETECTION = ("doc_id", "ctx", "ord", "entity", "value", "st", "en", "score", "rule", "redact")


@dataclass(frozen=True)
class Settings:
    """entities: None for all types. custom_terms: a deny list. extra: detectors beyond the built-in ones.
    by_line: spans of one text are told apart by the line they start in, as in plain text files."""

    entities: frozenset[str] | None = None
    custom_terms: tuple[str, ...] = ()
    extra: tuple[Detector, ...] = ()
    by_line: bool = False

    @staticmethod
    def from_profile(profile: dict) -> Settings:
        """A saved profile: entities, a map from type to whether it is ticked, and custom_terms, a list."""
        return Settings(frozenset(e for e, on in profile.get("entities", {}).items() if on), tuple(profile.get("custom_terms", ())))

    def profile(self) -> dict:
        return {"entities": {e: self.entities is None or e in self.entities for e in ENTITIES}, "custom_terms": list(self.custom_terms)}

    def detectors(self) -> tuple[Detector, ...]:
        return detectors(selected(set(self.entities) if self.entities is not None else None, self.custom_terms) + tuple(d.entity for d in self.extra), self.custom_terms, self.extra)


def raw_spans(units: DataFrame, settings: Settings) -> DataFrame:
    """units with _spans: all spans of their text, companies after suppression, before overlaps are resolved."""
    looked_for = settings.detectors()
    found = with_spans(units, "text", looked_for)
    if all(d.entity != "NORWEGIAN_COMPANY" for d in looked_for):
        return found
    return found.withColumn("_spans", F.filter("_spans", lambda s: (s["entity"] != "NORWEGIAN_COMPANY") | company_form_is_upper(s["value"])))


def standing_spans(units: DataFrame, settings: Settings) -> DataFrame:
    """units with _standing: the spans that stand after overlaps are resolved; by line with _ctx, the line that they start in."""
    found = raw_spans(units, settings)
    if not settings.by_line:
        return found.withColumn("_standing", resolved(F.col("_spans"))).drop("_spans")

    def placed(s: Column) -> Column:
        return s.withField("_ctx", F.concat(F.lit("line "), line_number(F.col("text"), s["st"]).cast("string")))

    found = found.withColumn("_spans", F.transform("_spans", placed))
    return found.withColumn("_standing", resolved(F.col("_spans"), FIELDS | {"_ctx": "string"}, "_ctx")).drop("_spans")


def detect(units: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """units(doc_id, ctx, ord, text) -> a row per standing detection.

    One pass over the text: spans are found and resolved within their row, without a shuffle.
    """
    found = exploded(standing_spans(units, settings), "_standing", "s", "doc_id", "ctx", "ord")
    context = F.col("s._ctx") if settings.by_line else F.col("ctx").cast("string")
    return found.select("doc_id", context.alias("ctx"), "ord", *[F.col(f"s.{c}").alias(c) for c in FIELDS], F.lit(True).alias("redact"))


def detect_names(units: DataFrame, dictionary: DataFrame) -> DataFrame:
    """units -> a row per person name by dictionary(name, is_first, is_surname), of every tier, before overlaps are resolved.

    Tokens are looked up by a join, so the dictionary may be of any size; Spark broadcasts it if its size is
    known to be small. A unit's tokens come together again by unit, and are folded in order.
    """
    keyed = units.withColumn("_unit", F.struct("doc_id", "ctx", "ord"))
    each = exploded(person_names.with_tokens(keyed, "text"), "_tokens", "t", "_unit")
    known = each.join(dictionary, F.col("t.value") == F.col("name"), "left")
    flagged = known.groupBy("_unit").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.col("t.st").alias("st"), F.col("t.en").alias("en"), F.col("t.value").alias("value"), F.col("t.joined").alias("joined"),
                    F.coalesce("is_first", F.lit(False)).alias("is_first"), F.coalesce("is_surname", F.lit(False)).alias("is_surname"),
                )
            )
        ).alias("tokens")
    )
    any_known = flagged.where(F.exists("tokens", lambda t: t["is_first"] | t["is_surname"]))
    ordered = F.transform("tokens", lambda t: F.struct(t["value"].alias("value"), t["st"].alias("st"), t["en"].alias("en"), t["joined"].alias("joined"), t["is_first"].alias("is_first"), t["is_surname"].alias("is_surname")))
    spans = any_known.select("_unit", ordered.alias("tokens")).select("_unit", person_names.folded(F.col("tokens")).alias("spans"))
    back = exploded(keyed.join(spans, "_unit"), "spans", "s", "doc_id", "ctx", "ord", "text")
    value = F.expr("substring(text, s.st + 1, s.en - s.st)")
    return back.select("doc_id", "ctx", "ord", "s.entity", value.alias("value"), "s.st", "s.en", "s.score", "s.rule", F.lit(True).alias("redact"))


# Functions that fetch from outside when they begin a formula.
FETCHING = ("=IMAGE(", "=WEBSERVICE(", "=FILTERXML(", "=IMPORTDATA(")


def is_dangerous(value: Column) -> Column:
    """Whether a cell's text is a formula that asks another host."""
    up = F.upper(value)
    begins = up.startswith(FETCHING[0])
    for f in FETCHING[1:]:
        begins = begins | up.startswith(f)
    return F.coalesce(value.startswith("=") & (begins | value.rlike("(?i)=.*https?://")), F.lit(False))


def dangerous_formulas(cells: DataFrame) -> DataFrame:
    """cells(doc_id, ctx, ord, text) -> a detection of the whole cell for each dangerous formula, whatever types are selected."""
    return cells.where(is_dangerous(F.col("text"))).select(
        "doc_id", "ctx", "ord", F.lit("DANGEROUS_FORMULA").alias("entity"), F.col("text").alias("value"), F.lit(0).alias("st"),
        F.length("text").alias("en"), F.lit(1.0).alias("score"), F.lit("formula").alias("rule"), F.lit(True).alias("redact"),
    )


def from_outside(spans: DataFrame, units: DataFrame) -> DataFrame:
    """spans(doc_id, ctx, ord, entity, st, en, score) of a model elsewhere -> detections with their values."""
    joined = spans.join(units, ["doc_id", "ctx", "ord"])
    return joined.select("doc_id", "ctx", "ord", "entity", F.expr("substring(text, st + 1, en - st)").alias("value"), F.col("st").cast("int").alias("st"), F.col("en").cast("int").alias("en"), F.col("score").cast("double").alias("score"), F.lit("outside").alias("rule"), F.lit(True).alias("redact"))




def recognized(units: DataFrame, recognizer: Callable[[list[str]], list[list[tuple[str, int, int, float]]]]) -> DataFrame:
    """Detections of a recognizer of the caller's (a model of names, places and groups): it gets the texts of a batch and returns spans
    (entity, start, end, score) for each. Null texts aren't sent; spans outside a text are an error."""
    kind = "array<struct<entity:string,st:int,en:int,score:double>>"

    @F.pandas_udf(kind)
    def found(texts: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
        some = texts[texts.notna()]
        for i, text, spans in zip(some.index, some, recognizer(some.tolist()), strict=True):
            if any(not 0 <= st < en <= len(text) for _, st, en, _ in spans):
                raise ValueError("a recognizer's span lies outside its text")
            out[i] = [{"entity": e, "st": st, "en": en, "score": score} for e, st, en, score in spans]
        return out

    each = exploded(units, found("text"), "s", "doc_id", "ctx", "ord", "text")
    return each.select("doc_id", "ctx", "ord", "s.entity", F.expr("substring(text, s.st + 1, s.en - s.st)").alias("value"), "s.st", "s.en", "s.score", F.lit("outside").alias("rule"), F.lit(True).alias("redact"))


def raised_by_context(detections: DataFrame, units: DataFrame, words: DataFrame, by: float, within: int, most: float = 1.0) -> DataFrame:
    """detections with scores raised `by`, up to `most`, where one of their type's words(entity, word) stands within so many characters
    before or after. Not part of detect(): how much a word raises a score is the caller's to say."""
    low = F.lower(F.expr(f"substring(text, greatest(st - {within}, 0) + 1, en - st + least(st, {within}) + {within})"))
    near = detections.join(units.select("doc_id", "ord", "text"), ["doc_id", "ord"])
    lists = words.groupBy("entity").agg(F.collect_set(F.lower("word")).alias("_words"))
    joined = near.withColumn("_near", low).join(lists, "entity", "left")
    hit = F.coalesce(F.exists("_words", lambda w: F.contains(F.col("_near"), w)), F.lit(False))
    return joined.withColumn("score", F.when(hit, F.least(F.col("score") + by, F.greatest(F.lit(most), F.col("score")))).otherwise(F.col("score"))).select(*detections.columns)
