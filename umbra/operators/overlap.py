"""Overlap resolution over rows, for detections that come from several places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.functions.spans import FIELDS, exploded, first_standing, resolved

_SPAN = FIELDS | {"redact": "boolean"}


def _grouped(detections: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return detections.groupBy(*by).agg(F.collect_set(F.struct(*_SPAN)).alias("_spans"))


def resolve(detections: DataFrame) -> DataFrame:
    """The detections that stand in their (doc_id, ctx): from the best score on, each that overlaps none of those kept.

    Equal scores go by start, entity, end and rule. Equal detections count once.
    """
    kept = exploded(_grouped(detections, ("doc_id", "ctx", "ord")), resolved(F.col("_spans"), _SPAN), "s", "doc_id", "ctx", "ord")
    return kept.select("doc_id", "ctx", "ord", "s.*")


def resolve_in_order(detections: DataFrame) -> DataFrame:
    """The detections of a document that stand by their order alone, whatever their context (the rule for very large files)."""
    kept = exploded(_grouped(detections, ("doc_id",)), first_standing(F.col("_spans"), _SPAN), "s", "doc_id")
    return kept.select("doc_id", "s.*")


def distinct_spans(detections: DataFrame) -> DataFrame:
    """One detection for each place and entity, the best-scored: what overlapping windows of a text find twice."""
    best = F.max(F.struct("score", "value", "rule", "redact")).alias("b")
    return detections.groupBy("doc_id", "ctx", "ord", "st", "en", "entity").agg(best).select("doc_id", "ctx", "ord", "entity", "b.value", "st", "en", "b.score", "b.rule", "b.redact")
