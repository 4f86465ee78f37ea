"""Companies by their roots: names without the legal form, wherever else they occur in a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.functions.patterns import ROOT_FORMS
from umbra.functions.spans import exploded

_FORM = f"(?iU)\\s+(?:{'|'.join(ROOT_FORMS)})\\s*$"


def company_roots(detections: DataFrame) -> DataFrame:
    """(doc_id, root): distinct company values without their legal form, of three characters or more."""
    root = F.trim(F.regexp_replace("value", _FORM, ""))
    return detections.where("entity = 'NORWEGIAN_COMPANY'").select("doc_id", root.alias("root")).where("length(root) >= 3").distinct()


def root_hits(units: DataFrame, roots: DataFrame) -> DataFrame:
    """A detection for each place in a document's units where one of its roots occurs, whatever the case, inside words too.

    Roots meet units by document alone. Matches of one root don't overlap each other. Characters are compared one by one, so that
    places are those of the text as it is.
    """
    quoted = F.concat(F.lit("(?iu)\\Q"), F.replace(F.col("root"), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    known = roots.select(F.col("doc_id").alias("_doc"), "root")
    joined = units.join(known, F.col("doc_id").eqNullSafe(F.col("_doc"))).withColumn("_pattern", quoted).where(F.regexp_like("text", F.col("_pattern")))
    gaps = F.split(F.col("text"), F.col("_pattern"), -1)
    starts = F.aggregate(
        F.slice(F.transform(gaps, lambda g: F.length(g)), 1, F.size(gaps) - 1),
        F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("out")),
        lambda acc, g: F.struct((acc["pos"] + g + F.length("root")).alias("pos"), F.concat(acc["out"], F.array(acc["pos"] + g)).alias("out")),
        lambda acc: acc["out"],
    )
    return exploded(joined, starts, "st", "doc_id", "ctx", "ord", "text", "root").select(
        "doc_id", "ctx", "ord", F.lit("NORWEGIAN_COMPANY").alias("entity"), F.expr("substring(text, st + 1, length(root))").alias("value"), "st",
        (F.col("st") + F.length("root")).alias("en"), F.lit(0.7).alias("score"), F.lit("root").alias("rule"), F.lit(True).alias("redact"),
    )
