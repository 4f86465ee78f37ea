"""Person names by dictionaries, as a left fold over a text's capitalised words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions.spans import SPAN, with_matches

# What a name token is, and short words that are no names on their own.
TOKEN = "(?U)\\b[A-ZÆØÅ][a-zæøåA-ZÆØÅ'‑-]+\\b"
AMBIGUOUS = ("Av", "Da", "De", "Di", "Ei", "En", "Er", "Et", "Ja", "Li", "Mo", "Og", "Os", "På", "Ut", "Vi")
ENTITY = "NORWEGIAN_PERSON_NAME"
PAIR, HALF, ALONE = 0.85, 0.70, 0.50


def dictionary(first: DataFrame, surname: DataFrame, extra: DataFrame) -> DataFrame:
    """(name, is_first, is_surname) of three tables of one column of names; extra names are first names."""
    rows = None
    for df, is_first, is_surname in ((first, True, False), (surname, False, True), (extra, True, False)):
        part = df.select(F.trim(F.col(df.columns[0])).alias("name"), F.lit(is_first).alias("f"), F.lit(is_surname).alias("s"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.where("name <> ''").groupBy("name").agg(F.max("f").alias("is_first"), F.max("s").alias("is_surname"))


def with_tokens(df: DataFrame, text_col: str, name: str = "_tokens") -> DataFrame:
    """df with a column array<struct<value, st, en, joined>> of a text's name tokens; joined: only white space, three characters at most, since the last one."""
    found = with_matches(df, text_col, {"_t": TOKEN})
    before = F.concat(F.array(F.lit(None).cast("int")), F.transform("_t", lambda t: t["en"]))
    paired = F.slice(F.arrays_zip(F.col("_t").alias("t"), before.alias("b")), 1, F.greatest(F.size("_t"), F.lit(0)))
    text = F.col(text_col)

    def token(x: Column) -> Column:
        t, b = x["t"], x["b"]
        gap = F.substring(text, b + 1, t["st"] - b)
        return F.struct(t["value"].alias("value"), t["st"].alias("st"), t["en"].alias("en"), F.coalesce((t["st"] - b <= 3) & gap.rlike("(?U)^\\s*$"), F.lit(False)).alias("joined"))

    return found.withColumn(name, F.transform(paired, token)).drop("_t")


def folded(flagged: Column) -> Column:
    """array of SPAN of the names in array<struct<value, st, en, joined, is_first, is_surname>>, a column.

    A first name takes the next token if that is joined to it and a surname (PAIR), or neither (HALF). A surname that is no
    first name takes the token before it if that is joined, neither, and not taken already (HALF). Other known names of three letters
    or more that aren't ambiguous stand alone. Taken tokens are passed over, so the fold holds the last token,
    whether it was taken, and whether the next one is. Values are left empty, for the caller to cut out of the text.
    """
    out = f"array<{SPAN}>"
    last = "struct<value:string,st:int,en:int,joined:boolean,is_first:boolean,is_surname:boolean>"
    start = F.struct(F.lit(None).cast(last).alias("last"), F.lit(True).alias("taken"), F.lit(False).alias("takes"), F.array().cast(out).alias("out"))
    pairs = F.slice(F.arrays_zip(flagged.alias("t"), F.slice(flagged, 2, F.greatest(F.size(flagged), F.lit(1))).alias("next")), 1, F.size(flagged))

    def span(st: Column, en: Column, score: float, rule: str) -> Column:
        return F.array(F.struct(F.lit(ENTITY).alias("entity"), F.lit("").alias("value"), st.alias("st"), en.alias("en"), F.lit(score).alias("score"), F.lit(rule).alias("rule")))

    def step(acc: Column, x: Column) -> Column:
        t, after, before = x["t"], x["next"], acc["last"]
        free = ~acc["takes"]
        near = free & t["is_first"] & F.coalesce(after["joined"], F.lit(False))
        pair = near & after["is_surname"]
        half = near & ~after["is_surname"] & ~after["is_first"]
        back = free & t["is_surname"] & ~t["is_first"] & t["joined"] & ~acc["taken"] & ~before["is_first"] & ~before["is_surname"]
        alone = free & (t["is_first"] | t["is_surname"]) & (F.length(t["value"]) >= 3) & ~t["value"].isin(*AMBIGUOUS)
        found = (
            F.when(pair, span(t["st"], after["en"], PAIR, "first and surname"))
            .when(half, span(t["st"], after["en"], HALF, "first and capitalised"))
            .when(back, span(before["st"], t["en"], HALF, "capitalised and surname"))
            .when(alone & t["is_first"], span(t["st"], t["en"], ALONE, "first alone"))
            .when(alone, span(t["st"], t["en"], ALONE, "surname alone"))
            .otherwise(F.array().cast(out))
        )
        return F.struct(t.alias("last"), acc["takes"].alias("taken"), F.coalesce(pair | half, F.lit(False)).alias("takes"), F.concat(acc["out"], found).alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])
