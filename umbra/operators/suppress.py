"""Detections that are no proper names, and spans cut down to the names in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbra.functions.patterns import LEGAL_FORMS
from umbra.functions.spans import exploded, with_matches

#: A word, for deciding whether a span looks like a name.
WORD = "[A-Za-zÆØÅæøåÀ-ÿ]+"
#: A word that begins with a capital.
CAPITAL = "(?=[A-ZÀ-ÖØ-Þ])(?<![A-Za-zÆØÅæøåÀ-ÿ])[A-Za-zÆØÅæøåÀ-ÿ]+"


def company_form_is_upper(value: Column) -> Column:
    """Whether a company's legal form stands in capitals at its end."""
    return value.rlike(f"(?:{'|'.join(LEGAL_FORMS)})\\s*$")


def _proper(word: Column) -> Column:
    """Capitalised, of three letters or more."""
    first = F.substring(word, 1, 1)
    return (F.length(word) >= 3) & (first == F.upper(first)) & (first != F.lower(first))


def drop_common_text(detections: DataFrame, common_words: DataFrame, entities: tuple[str, ...] = ("LOCATION", "NORWEGIAN_COMPANY")) -> DataFrame:
    """Without detections of these entities that hold no proper word outside common_words(word, lower case).

    Values are looked at once each, and their words by an anti join, so neither table's size matters.
    """
    values = detections.where(F.col("entity").isin(*entities)).select("value").distinct()
    words = values.select("value", F.explode(F.regexp_extract_all("value", F.lit(WORD), F.lit(0))).alias("w"))
    proper = words.where(_proper(F.col("w"))).join(common_words.select(F.col("word").alias("_c")), F.lower("w") == F.col("_c"), "left_anti")
    good = proper.select(F.col("value").alias("_v")).distinct().withColumn("_good", F.lit(True))
    joined = detections.join(good, F.col("value") == F.col("_v"), "left")
    return joined.where(~F.col("entity").isin(*entities) | F.col("_good")).drop("_v", "_good")


def trim_to_names(detections: DataFrame, dictionary: DataFrame, common_words: DataFrame, entities: tuple[str, ...] = ("PERSON", "NRP")) -> DataFrame:
    """Detections of these entities cut down to the names in them; the others as they are.

    Of a span the capitalised words outside common_words count. Words with only white space between them, three characters at most, are a
    run; a run that holds a known name of three letters or more becomes a detection from its first to its last word, with the span's score.
    Runs are gaps and islands: a word begins one where it isn't joined to the word before.
    """
    subject = F.col("entity").isin(*entities)
    keyed = detections.where(subject).withColumn("_key", F.struct("doc_id", "ctx", "ord", "entity", "st", "en", "score", "rule", "redact"))
    capital = exploded(with_matches(keyed, "value", {"_w": CAPITAL}), "_w", "m", "_key", "value")
    uncommon = capital.join(common_words.select(F.col("word").alias("_c")), F.lower("m.value") == F.col("_c"), "left_anti")
    known = uncommon.join(dictionary.select(F.col("name").alias("_n")).distinct().withColumn("_known", F.lit(True)), F.col("m.value") == F.col("_n"), "left")
    order = Window.partitionBy("_key").orderBy("m.st")
    before = F.lag("m.en").over(order)
    between = F.substring(F.col("value"), before + 1, F.col("m.st") - before)
    joined = F.coalesce((F.col("m.st") - before <= 3) & between.rlike("(?U)^\\s*$"), F.lit(False))
    runs = known.withColumn("_new", (~joined).cast("int")).withColumn("_run", F.sum("_new").over(order))
    kept = (
        runs.groupBy("_key", "value", "_run")
        .agg(F.min("m.st").alias("a"), F.max("m.en").alias("b"), F.max(F.coalesce("_known", F.lit(False)) & (F.length("m.value") >= 3)).alias("named"))
        .where("named")
    )
    cut = kept.select(
        "_key.doc_id", "_key.ctx", "_key.ord", "_key.entity", F.expr("substring(value, a + 1, b - a)").alias("value"), (F.col("_key.st") + F.col("a")).alias("st"),
        (F.col("_key.st") + F.col("b")).alias("en"), "_key.score", "_key.rule", "_key.redact",
    )
    return detections.where(~subject).unionByName(cut)
