"""What was found: groups, severities, samples, audit records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbra.plans.catalog import HIGH, MEDIUM

#: Places shown for a group, detections shown for an entity.
PLACES, SAMPLE = 20, 20


def severity(entity: Column) -> Column:
    return F.when(entity.isin(*sorted(HIGH)), "high").when(entity.isin(*sorted(MEDIUM)), "medium").otherwise("low")


def grouped(detections: DataFrame) -> DataFrame:
    """A row per document, entity and value: count, best score, whether the first is to be redacted, severity, the first places by name."""
    places = F.array_sort(F.collect_set("ctx"))
    out = detections.groupBy("doc_id", "entity", "value").agg(F.count("*").alias("n"), F.max("score").alias("score"), F.min_by("redact", F.struct("ord", "st")).alias("redact"), F.slice(places, 1, PLACES).alias("places"))
    return out.withColumn("severity", severity(F.col("entity")))


#: Columns a report is sorted by; n and score as numbers.
SORTABLE = ("doc_id", "entity", "value", "n", "score", "redact")


def sorted_report(groups: DataFrame, by: str, descending: bool = False) -> DataFrame:
    if by not in SORTABLE:
        raise ValueError(f"a report isn't sorted by {by}")
    return groups.orderBy(F.col(by).desc() if descending else F.col(by).asc(), "doc_id", "entity", "value")


def toggled(detections: DataFrame, choices: DataFrame) -> DataFrame:
    """detections with redact as chosen(doc_id, entity, value, redact) for whole groups, else as it was."""
    picked = choices.select(F.col("doc_id").alias("_doc"), F.col("entity").alias("_entity"), F.col("value").alias("_value"), F.col("redact").alias("_redact"))
    joined = detections.join(picked, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("entity") == F.col("_entity")) & (F.col("value") == F.col("_value")), "left")
    return joined.withColumn("redact", F.coalesce("_redact", "redact")).drop("_redact").select(*detections.columns)


def set_all(detections: DataFrame, redact: bool) -> DataFrame:
    return detections.withColumn("redact", F.lit(redact))


def sample(detections: DataFrame, most: int = SAMPLE) -> DataFrame:
    """The first detections of each entity in a document, and whether the document has more of any entity.

    Both windows are answered by one partitioning, by document.
    """
    place = F.row_number().over(Window.partitionBy("doc_id", "entity").orderBy("ord", "st", "en", "value"))
    ranked = detections.repartition(F.col("doc_id")).withColumn("_i", place)
    marked = ranked.withColumn("truncated", F.max("_i").over(Window.partitionBy("doc_id")) > most)
    return marked.where(F.col("_i") <= most).drop("_i")


def audit(detections: DataFrame) -> DataFrame:
    """A record per document: redacted_count and a map of counts by entity, of detections to be redacted."""
    by = detections.where("redact").groupBy("doc_id", "entity").agg(F.count("*").alias("n"))
    some = by.groupBy("doc_id").agg(F.sum("n").alias("redacted_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity", "n")))).alias("entity_types"))
    every = detections.select("doc_id").distinct().withColumnRenamed("doc_id", "id")
    every = every.join(some, F.col("id").eqNullSafe(F.col("doc_id")), "left")
    return every.select(F.col("id").alias("doc_id"), F.coalesce("redacted_count", F.lit(0)).cast("long").alias("redacted_count"), F.coalesce("entity_types", F.create_map().cast("map<string,bigint>")).alias("entity_types"))


def append_audit(records: DataFrame, path: str, source: str = "", output: str = "") -> None:
    """Append audit records as JSON lines, with the time in UTC, source and output."""
    stamped = records.select(
        F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("timestamp"),
        F.concat(F.lit(source), F.col("doc_id").cast("string")).alias("source"), F.concat(F.lit(output), F.col("doc_id").cast("string")).alias("output"), "redacted_count", "entity_types",
    )
    stamped.write.mode("append").json(path)
