"""Spans of text as columns: where a pattern matches, which of them stand, and what a text becomes without them.

Positions count code points from 0, and ends are exclusive. All are built-in expressions on arrays of a row, so detection,
overlap resolution and redaction of a text need no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions.checks import CHECKS
from umbra.functions.number_spans import number_spans_of
from umbra.functions.patterns import NUMBERS, Detector
from umbra.functions.standing import standing

#: Fields of a span, and of spans that carry more.
FIELDS = {"entity": "string", "value": "string", "st": "int", "en": "int", "score": "double", "rule": "string"}


def kind(fields: dict[str, str]) -> str:
    return "struct<" + ",".join(f"{k}:{v}" for k, v in fields.items()) + ">"


SPAN = kind(FIELDS)


#: Stands around a match while a text is cut at its matches: characters that no text should hold, of ASCII to keep texts in Java's short form,
#: and another. Texts that hold them are looked at with others in their places.
MARK, LAST = "\x01", "\uffff"
INSTEAD = {MARK: "\x02", LAST: "\ufffd"}
#: Elements that are added up in a row, so that running sums of long arrays take no quadratic time.
BLOCK = 256


def running(values: Column) -> Column:
    """Sums of an int array's elements before each one. values: a column, as it is referred to often."""

    def scan(block: Column, base: Column) -> Column:
        start = F.struct(base.alias("sum"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(block, start, lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["out"], F.array(a["sum"])).alias("out")), lambda a: a["out"])

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, BLOCK))
    start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<array<int>>").alias("out"))

    def add(a: Column, block: Column) -> Column:
        return F.struct((a["sum"] + F.aggregate(block, F.lit(0), lambda s, x: s + x)).alias("sum"), F.concat(a["out"], F.array(scan(block, a["sum"]))).alias("out"))

    return F.when(F.size(values) > 0, F.flatten(F.aggregate(blocks, start, add, lambda a: a["out"]))).otherwise(F.array().cast("array<int>"))


def _holds_marks(text: Column) -> Column:
    return F.contains(text, F.lit(MARK)) | F.contains(text, F.lit(LAST))


def _pieces(text: Column, marked: Column, pattern: str) -> Column:
    """A text's gaps and matches in turn."""
    seen = F.when(marked, F.translate(text, "".join(INSTEAD), "".join(INSTEAD.values()))).otherwise(text)
    return F.split(F.regexp_replace(seen, pattern, f"{MARK}$0{MARK}"), MARK, -1)


MATCH = "struct<value:string,st:int,en:int>"


def _match(value: Column, st: Column, en: Column) -> Column:
    return F.struct(value.alias("value"), st.alias("st"), en.alias("en"))


def with_matches(
    df: DataFrame, text_col: str, patterns: dict[str, str], guards: dict[str, Column] | None = None, make: dict[str, tuple[Callable[[Column, Column, Column], Column], str]] | None = None
) -> DataFrame:
    """df with a column array<struct<value, st, en>> of all matches of each pattern, or of what make (with its type) says of these three; null
    where the guard fails or the text is null.

    A text is searched once: matches are set between marks, and cut there into gaps and matches in turn, whose lengths add up to the
    positions. One match and two, the usual numbers, are taken from their places, and more of them by sums.
    What is referred to several times is a column first. Patterns must not match nothing.
    """
    guards, make = guards or {}, make or {}
    out = df.withColumn("_marked", _holds_marks(F.col(text_col)))
    marked = F.col("_marked")
    own = {k: _pieces(F.col(text_col), marked, p) for k, p in patterns.items()}
    out = out.withColumns({f"{k}_p": F.when(guards[k], x) if k in guards else x for k, x in own.items()})
    size = {k: F.size(f"{k}_p") for k in patterns}
    many = {k: (size[k] > 1) & (marked | (size[k] > 5)) for k in patterns}
    out = out.withColumns({f"{k}_s": F.when(many[k], F.transform(f"{k}_p", lambda x: F.length(x))) for k in patterns})
    out = out.withColumns({f"{k}_s": F.when(many[k], running(F.col(f"{k}_s"))) for k in patterns})

    def matches(k: str) -> Column:
        built, made = make.get(k, (_match, MATCH))
        piece = [F.get(f"{k}_p", F.lit(i)) for i in range(4)]
        ends = [F.length(piece[0])]
        for p in piece[1:]:
            ends.append(ends[-1] + F.length(p))
        first = [built(piece[1], ends[0], ends[1]), built(piece[3], ends[2], ends[3])]

        def match(i: Column) -> Column:
            m, st = F.get(f"{k}_p", i), F.get(f"{k}_s", i)
            # as it stands, where the text was looked at with another character in its place
            return _match(F.when(marked, F.substring(F.col(text_col), st + 1, F.length(m))).otherwise(m), st, st + F.length(m))

        each = F.transform(F.sequence(F.lit(1), size[k] - 2, F.lit(2)), match)
        if k in make:
            each = F.transform(each, lambda m: built(m["value"], m["st"], m["en"]))
        return (
            F.when(size[k] == 1, F.array().cast(f"array<{made}>"))
            .when(many[k], each)
            .when(size[k] == 3, F.array(first[0]))
            .when(size[k] == 5, F.array(*first))
        )

    out = out.withColumns({k: matches(k) for k in patterns})
    return out.drop("_marked", *[f"{k}_{x}" for k in patterns for x in "ps"])


def none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def exploded(df: DataFrame, array: str | Column, name: str, *cols: str | Column) -> DataFrame:
    """A row per element of a computed array. The outer form, with empty ones left out afterwards: for the inner
    one the optimizer would add a filter on the array's size, and push it down with the array's whole computation."""
    return df.select(*cols, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def possible(low: Column, odd: Column, detector: Detector) -> Column:
    """Whether a text, low in lower case, holds a literal that any match holds; odd: whether it holds letters that patterns
    take for ASCII ones without regard to case, while lower case doesn't."""
    any_literal = odd
    for literal in detector.needs:
        any_literal = any_literal | F.contains(low, F.lit(literal))
    return any_literal


def span_of(detector: Detector) -> Callable[[Column, Column, Column], Column]:
    """SPAN of a detector's match; the score is null if the check fails and nothing else is said."""

    def span(value: Column, st: Column, en: Column) -> Column:
        score = F.lit(detector.score)
        if detector.check:
            score = F.when(CHECKS[detector.check](value), score).otherwise(F.lit(detector.otherwise))
        return F.struct(F.lit(detector.entity).alias("entity"), value.alias("value"), st.alias("st"), en.alias("en"), score.alias("score"), F.lit(detector.rule).alias("rule"))

    return span


def with_spans(df: DataFrame, text_col: str, detectors: tuple[Detector, ...], name: str = "_spans") -> DataFrame:
    """df with a column of all detectors' spans; null and empty texts have none."""
    numbers = [d for d in detectors if d.lengths]
    named = {f"_d{i}": d for i, d in enumerate(detectors) if not d.lengths or len(numbers) < 2}
    text = F.col(text_col)
    odd = F.contains(text, F.lit("\u0130")) | F.contains(text, F.lit("\u0131")) | F.contains(text, F.lit("\u017f"))
    guards = {k: possible(F.col("_low"), F.col("_odd"), d) for k, d in named.items() if d.needs}
    seen = df.withColumns({"_low": F.lower(text), "_odd": odd}) if guards else df
    matched = with_matches(seen, text_col, {k: d.search for k, d in named.items()}, guards, {k: (span_of(d), SPAN) for k, d in named.items()})

    def kept(k: str, d: Detector) -> Column:
        spans = F.filter(k, lambda s: s["score"].isNotNull()) if d.check and d.otherwise is None else F.col(k)
        return F.coalesce(spans, none())

    spans = [kept(k, d) for k, d in named.items()]
    if len(numbers) > 1:
        told_apart = F.arrow_udf(number_spans_of(tuple(numbers)), f"array<{SPAN}>")
        spans.append(told_apart(_pieces(text, _holds_marks(text), NUMBERS)))
    return matched.withColumn(name, F.concat(*spans) if spans else none()).drop("_low", "_odd", *named)


def line_number(text: Column, st: Column) -> Column:
    """Line of a position, from 1."""
    before = F.substring(text, F.lit(1), st)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"))) + 1


def overlaps(a: Column, b: Column) -> Column:
    return (a["st"] < b["en"]) & (a["en"] > b["st"])


def _ordered(spans: Column, by: tuple[str, ...], fields: dict[str, str]) -> Column:
    """Spans in order of the given fields (neg: the score downwards), as structs that begin with these."""
    rest = [f for f in fields if f not in by]
    return F.sort_array(F.transform(spans, lambda s: F.struct(*[(-s["score"]).alias("neg") if f == "neg" else s[f].alias(f) for f in by], *[s[f].alias(f) for f in rest])))


def _plain(spans: Column, fields: dict[str, str]) -> Column:
    return F.transform(spans, lambda s: F.struct(*[s[f].alias(f) for f in fields]))


def resolved(spans: Column, fields: dict[str, str] = FIELDS, context: str | None = None) -> Column:
    """The spans that stand: from the best score on, each that overlaps none of those kept; in order of start.

    Equal scores go by start, entity, end and rule. context names a field: spans of different contexts never overlap. As arrays of a
    row this takes a fold within a fold, which Spark doesn't compile; so it is done for many rows at once over Arrow batches.
    """
    return F.arrow_udf(standing_in(context), f"array<{kind(fields)}>")(spans)


def standing_in(context: str | None) -> Callable[[pa.Array], pa.Array]:
    def stand(spans: pa.Array) -> pa.Array:
        return standing(spans, context)

    return stand


def first_standing(spans: Column, fields: dict[str, str] = FIELDS) -> Column:
    """The spans that stand by order alone: from the first start on (of equal ones the better score), each that begins where the
    last kept has ended. An early span of a low score beats a later one of a high score."""
    in_order = _plain(_ordered(spans, ("st", "neg", "entity", "en", "rule"), fields), fields)
    start = F.struct(F.lit(-1).alias("end"), F.array().cast(f"array<{kind(fields)}>").alias("kept"))

    def keep(acc: Column, s: Column) -> Column:
        return F.when(s["st"] >= acc["end"], F.struct(s["en"].alias("end"), F.concat(acc["kept"], F.array(s)).alias("kept"))).otherwise(acc)

    return F.aggregate(in_order, start, keep, lambda acc: acc["kept"])


def spliced(text: Column, spans: Column, field: str) -> Column:
    """text with each span replaced by one of its fields. spans: in order of start, without overlap."""
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["pos"] + 1, s["st"] - acc["pos"])
        return F.struct(s["en"].alias("pos"), F.concat(acc["out"], gap, s[field]).alias("out"))

    return F.aggregate(spans, start, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text))))
