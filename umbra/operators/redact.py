"""Tokens for values, texts with tokens in place of values, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbra.functions.spans import spliced

#: A token: an entity of capitals, digits and underscores, and a number.
TOKEN = r"\[([A-Z][A-Z0-9_]*)_([0-9]+)\]"
#: Longer numbers in a text don't move the counters on: counting never gets there, so no token can equal them.
DIGITS = 18
# What stands for a value without tokens, how much longer than its value a token may be before a layout
# suffers, and what is said then.
BLANK, LONGER = "[REDACTED]", 10
WARNING = ("Token longer than original in '", "' — table layout may shift.")


def counter_seeds(units: DataFrame) -> DataFrame:
    """(doc_id, entity, seed): the greatest number of each entity's tokens that a document's text holds already, numbers of over DIGITS
    digits (zeros in front apart) left out."""
    found = units.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("t"))
    numbers = found.select("doc_id", F.regexp_extract("t", TOKEN, 1).alias("entity"), token_number(F.col("t")).alias("seed")).where("seed is not null")
    return numbers.groupBy("doc_id", "entity").agg(F.max("seed").alias("seed"))


def token_number(token: Column) -> Column:
    """The number of a token; null if it has over DIGITS digits, zeros in front apart."""
    digits = F.regexp_replace(F.regexp_extract(token, TOKEN, 2), "^0+(?=.)", "")
    return F.when(F.length(digits) <= DIGITS, digits).cast("long")


def _by(left: DataFrame, right: DataFrame, *keys: str, how: str = "left") -> DataFrame:
    """A join by keys that counts nulls as equal, with the left side's keys."""
    named = right.select(*[F.col(k).alias(f"_by_{k}") if k in keys else F.col(k) for k in right.columns])
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_by_{k}"))
        on = same if on is None else on & same
    return left.join(named, on, how).drop(*[f"_by_{k}" for k in keys])


def assign_tokens(detections: DataFrame, units: DataFrame | None = None, in_order: bool = False) -> DataFrame:
    """detections (standing, to be redacted) -> the vault: doc_id, value, entity, token.

    A value has one token in its document, named by the entity it is met with first. Values are met unit by unit in order, in
    a unit from its last span to its first, or (in_order, the rule for very large files) from the first to the last.
    Numbers go up by entity from those that the document's text holds already.
    """
    met = F.struct("ord", F.col("st") if in_order else -F.col("st"), "entity")
    first = detections.groupBy("doc_id", "value").agg(F.min_by("entity", met).alias("entity"), F.min(met).alias("met"))
    numbered = first.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "entity").orderBy("met", "value")))
    seed = F.lit(0)
    if units is not None:
        numbered = _by(numbered, counter_seeds(units), "doc_id", "entity")
        seed = F.coalesce("seed", F.lit(0))
    token = F.concat(F.lit("["), F.col("entity"), F.lit("_"), (F.col("n") + seed).cast("string"), F.lit("]"))
    return numbered.select("doc_id", "value", "entity", token.alias("token"))


def redact(units: DataFrame, detections: DataFrame, vault: DataFrame | None = None) -> DataFrame:
    """units with the values of standing detections (redact only) replaced by their tokens, or by BLANK without a vault or where the vault
    lacks the value: nothing that is to be redacted stays. Null ids and null places are met like any other; units that share both
    lose the spans of all of them. Of several tokens of a value the least is taken.

    A unit's spans come together by unit; overlapping ones are resolved again, so that an unticked winner brings no loser back
    and the text is spliced in one pass.
    """
    from umbra.operators.overlap import resolve

    # Spans of plain text differ by line; here they meet by unit, where they can't overlap either.
    chosen = resolve(detections.where("redact").withColumn("ctx", F.lit("")))
    if vault is None:
        chosen = chosen.withColumn("token", F.lit(BLANK))
    else:
        chosen = _by(chosen, vault.groupBy("doc_id", "value").agg(F.min("token").alias("token")), "doc_id", "value").withColumn("token", F.coalesce("token", F.lit(BLANK)))
    by = chosen.groupBy("doc_id", "ord").agg(F.array_sort(F.collect_list(F.struct("st", "en", "token"))).alias("_spans"))
    joined = _by(units, by, "doc_id", "ord")
    return joined.select("doc_id", "ctx", "ord", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(spliced(F.col("text"), F.col("_spans"), "token")).alias("text"))


def layout_warnings(detections: DataFrame, vault: DataFrame) -> DataFrame:
    """(doc_id, ctx, warning) where a token is more than LONGER characters longer than its value."""
    joined = _by(detections.where("redact"), vault.groupBy("doc_id", "value").agg(F.min("token").alias("token")), "doc_id", "value", how="inner")
    return joined.where(F.length("token") - F.length("value") > LONGER).select("doc_id", "ctx", F.concat(F.lit(WARNING[0]), F.col("ctx"), F.lit(WARNING[1])).alias("warning"))


def restored(text: Column, tokens: Column) -> Column:
    """text with each token that the map tokens knows replaced by its value; others stay."""
    found = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    known = F.transform(found, lambda t: F.coalesce(F.try_element_at(tokens, t), t))
    pieces = F.split(text, TOKEN, -1)
    return F.array_join(F.flatten(F.transform(F.arrays_zip(pieces.alias("p"), known.alias("v")), lambda x: F.array(x["p"], F.coalesce(x["v"], F.lit(""))))), "")


def restore(units: DataFrame, vault: DataFrame) -> DataFrame:
    """units with their documents' tokens replaced by the vault's values; of several values of a token the least."""
    each = vault.where("token is not null").groupBy("doc_id", "token").agg(F.min("value").alias("value"))
    maps = each.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("token", "value"))).alias("_vault"))
    joined = _by(units, maps, "doc_id")
    return joined.select("doc_id", "ctx", "ord", F.when(F.col("_vault").isNull(), F.col("text")).otherwise(restored(F.col("text"), F.col("_vault"))).alias("text"))
