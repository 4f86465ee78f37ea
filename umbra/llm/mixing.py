"""Mixing sources to target weights: fixed-length blocks, multinomial shards, index permutations. DataFrames alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbra.llm.common import WORD, materialize

#: Rounds of the swap-or-not shuffle that permutes block indices.
ROUNDS = 32
_KEY = ("id", "h", "k")


@dataclass
class Mix:
    """rows: a row per document with key, source, s (its source's number), size, source_size, target, taken.
    sources: a row per source. slots: a row per slot of an output shard with s, block, and words (of its start) taken.
    pieces: a row per document and block that it has words in: pos, n (words), times (whole), part (further first words).
    """

    rows: DataFrame
    sources: DataFrame
    slots: DataFrame
    pieces: DataFrame


def permuted(i: Column, n: Column, *key: Column) -> Column:
    """Place of index i in a pseudorandom permutation of 0..n-1 that key chooses.

    Swap-or-not: each round pairs x with k - x (mod n) and swaps the pair or not by a hash of the pair, so that
    every round, and with it the whole, is a permutation of any n.
    """

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit("pair"), r, *key), n) - x, n)
        swap = F.xxhash64(F.lit("swap"), r, F.greatest(x, other), *key).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), i.cast("long"), step)


def source_targets(totals: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """totals(source, total) -> with s (place by code point, null last, from 0), w and target.

    Weights repeat over the sources. Targets share the sum of all totals by weight; none exceeds most times its total,
    and the excess is shared again by weight: sources from the lowest most * total / w on are full until the level
    that the rest allow lies below the next one's. One row per source meets in one task.
    """
    placed = totals.withColumn("s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = placed.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("s") % len(weights) + 1).cast("int")))
    full = weighed.withColumn("full", F.lit(float(most)) * F.col("total")).withColumn("r", F.col("full") / F.col("w"))
    by_level = Window.orderBy("r", "s")
    before, everything = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("r", "s").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("total").over(everything) - F.coalesce(F.sum("full").over(before), F.lit(0.0))
    level = left / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    reached = full.withColumn("level", level).withColumn("i", F.row_number().over(by_level))
    first = F.min(F.when(F.col("level") <= F.col("r"), F.struct("i", "level"))).over(everything)["level"]
    return reached.withColumn("target", F.least("full", first * F.col("w"))).select("source", "total", "s", "w", "target")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block_words: int = 256, shard_slots: int = 1 << 16) -> Mix:
    """Mix the sources of docs so that each gives its target's words (rounded) and no document over most times its own.

    Null texts and texts without a word have size 0 and take no part; a null source is a source; rows that repeat
    an id are documents of their own, told apart by k; an empty table gives empty results. The same rows give the same mix however
    they are laid out. Hot sources are split: a source's words are laid out in chunks of documents, whose totals alone
    meet by source. There may be any number of sources: a row of each meets in one task to place it and to share the targets.
    """
    spark = docs.sparkSession
    text = F.coalesce(docs[text_col], F.lit(""))
    read = docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("h"), docs[source_col].alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))
    # Rows without a word take no part, so that many of them with one id (or none) don't meet.
    numbered = read.where("size > 0").withColumn("k", F.row_number().over(Window.partitionBy("id", "h").orderBy("source")))
    keyed = materialize(numbered.unionByName(read.where("size = 0").withColumn("k", F.lit(0))))
    totals = keyed.groupBy("source").agg(F.sum("size").alias("total"))
    length = F.lit(block_words)
    words = F.floor(F.col("target") + 0.5)
    rest = F.when(F.col("total") > 0, words % F.col("total")).otherwise(0)
    whole = F.floor(F.col("total") / length)
    sources = materialize(
        source_targets(totals, weights, most)
        .withColumn("epochs", F.when(F.col("total") > 0, F.floor(words / F.col("total"))).otherwise(0))
        .withColumn("rest", rest)
        .withColumn("whole", whole)
        .withColumn("blocks", F.ceil(F.col("total") / length))
        .withColumn("slots", F.col("epochs") * F.col("blocks") + F.ceil(F.least("rest", F.col("whole") * length) / length) + (F.col("rest") > F.col("whole") * length).cast("long"))
    )

    # Words of a source in a row: chunks of documents by a hash, in a chunk by key.
    chunks = max(64, keyed.where("size > 0").count() // 50_000)
    named = sources.select(F.col("source").alias("name"), "s", F.col("total").alias("source_size"), "target")
    rows = keyed.join(named, F.col("source").eqNullSafe(F.col("name"))).drop("name").withColumn("chunk", F.pmod(F.xxhash64(F.lit("chunk"), *_KEY), F.lit(chunks)))
    in_chunk = Window.partitionBy("s", "chunk").orderBy(*_KEY)
    laid = rows.where("size > 0").withColumn("start", F.sum("size").over(in_chunk) - F.col("size"))
    heads = rows.where("size > 0").groupBy("s", "chunk").agg(F.sum("size").alias("n"))
    heads = heads.select("s", "chunk", (F.sum("n").over(Window.partitionBy("s").orderBy("chunk")) - F.col("n")).alias("first"))
    laid = laid.join(heads, ["s", "chunk"]).withColumn("start", F.col("start") + F.col("first"))

    slots = materialize(_slots(spark, sources, block_words, shard_slots))
    taken = slots.groupBy("s", "block").agg(F.count(F.when(~F.col("cut"), 1)).alias("times"), F.coalesce(F.max(F.when(F.col("cut"), F.col("words"))), F.lit(0)).alias("part"))
    to = F.col("start") + F.col("size")
    spread = (
        laid.select(*_KEY, "s", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / length), F.floor((to - 1) / length))).alias("block"))
        .withColumn("from", F.greatest("start", F.col("block") * length))
        .withColumn("n", F.least(to, (F.col("block") + 1) * length) - F.col("from"))
    )
    pieces = materialize(
        spread.join(taken, ["s", "block"])
        .withColumn("part", F.least("n", F.greatest(F.lit(0), F.col("block") * length + F.col("part") - F.col("from"))))
        .where("times > 0 or part > 0")
        .select(*_KEY, (F.col("from") - F.col("start")).alias("pos"), "n", "times", "part")
    )
    sums = pieces.groupBy(*_KEY).agg(F.sum(F.col("times") * F.col("n") + F.col("part")).alias("taken"))
    same = [rows[c].eqNullSafe(sums[c]) for c in _KEY]
    fields = [rows[c] for c in (*_KEY, "source", "s", "size", "source_size", "target")]
    some = rows.where("size > 0")
    out = some.join(sums, same[0] & same[1] & same[2], "left").select(*fields, F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return Mix(out.unionByName(rows.where("size = 0").select(*fields, F.lit(0).cast("long").alias("taken"))), sources, slots, pieces)


#: Bits of the numbers by which sources are drawn; most groups that these numbers are cut into to find their sources; sources of a
#: table of ranges (a row takes some 40 bytes) that is broadcast; slots that one row stands for before it is spread over tasks.
_DRAW_BITS, _DRAW_GROUPS, _BROADCAST_SOURCES, _RUN = 52, 1 << 20, 1 << 19, 4096


def _draw_ranges(sources: DataFrame, n: int, shares: float) -> tuple[DataFrame, int]:
    """(s, lo, hi, g): the source of the numbers lo..hi-1, as wide as its target's share, and each group g (the numbers' high bits) that
    the range reaches; and how many low bits a group leaves. About n + as many rows as groups."""
    groups = min(_DRAW_GROUPS, 1 << max(0, n - 1).bit_length())
    low = _DRAW_BITS - groups.bit_length() + 1
    in_order = Window.orderBy("s")
    hi = F.floor(F.sum("target").over(in_order) / shares * float(1 << _DRAW_BITS))
    last = F.row_number().over(Window.orderBy(F.col("s").desc())) == 1
    ranged = sources.where("target > 0").select(F.col("s").cast("int").alias("s"), F.when(last, F.lit(1 << _DRAW_BITS)).otherwise(F.least(hi, F.lit(1 << _DRAW_BITS))).alias("hi"))
    ranged = ranged.withColumn("lo", F.coalesce(F.lag("hi").over(in_order), F.lit(0))).where("lo < hi")
    return ranged.select("s", "lo", "hi", F.explode(F.sequence(F.shiftright("lo", low), F.shiftright(F.col("hi") - 1, low))).alias("g")), low


def _slots(spark, sources: DataFrame, block_words: int, shard_slots: int) -> DataFrame:
    """Every slot of every shard: shard, s, block, words, cut.

    Each shard draws its slots' sources at the targets' shares: a multinomial count per source. A source's
    slots, counted over the shards, are numbered; numbers beyond the source's own end are dropped, and a last
    shard has those that were never drawn. A number is an epoch and an index there; the permutation of that epoch maps
    it to a block. Epochs take all blocks, the last one as many whole blocks as its words need, the last of them cut.
    Numbers travel as runs of _RUN and are spread over tasks before they are written out.
    """
    total, shares, n = sources.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.sum("target"), F.count(F.when(F.col("target") > 0, 1))).first()
    ranges_of, low = _draw_ranges(sources, n, shares or 1.0)
    drawn = spark.range(0, total, 1, max(spark.sparkContext.defaultParallelism, -(-total // (1 << 22)))).select(
        F.floor(F.col("id") / F.lit(shard_slots)).alias("shard"), F.pmod(F.xxhash64(F.lit("draw"), "id"), F.lit(1 << _DRAW_BITS)).alias("u")
    )
    ranges_of = materialize(ranges_of)
    met = drawn.join(F.broadcast(ranges_of) if n <= _BROADCAST_SOURCES else ranges_of, (F.shiftright("u", low) == F.col("g")) & (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    counts = materialize(met.groupBy("shard", "s").agg(F.count("*").alias("n")))
    to = F.sum("n").over(Window.partitionBy("s").orderBy("shard"))
    ranges = counts.withColumn("to", to).select("shard", "s", (F.col("to") - F.col("n")).alias("from"), "to")
    got = counts.groupBy("s").agg(F.sum("n").alias("got"))
    last = sources.join(got, "s", "left").select(F.lit(-(-total // shard_slots)).cast("long").alias("shard"), "s", F.coalesce("got", F.lit(0)).alias("from"), F.col("slots").alias("to"))
    runs = (
        ranges.unionByName(last.select("shard", F.col("s").cast("int").alias("s"), "from", "to"))
        .join(sources.select(F.col("s").cast("int").alias("s"), "total", "epochs", "rest", "whole", "blocks", "slots"), "s")
        .withColumn("to", F.least("to", "slots"))
        .where(F.col("from") < F.col("to"))
        .withColumn("at", F.explode(F.sequence(F.col("from"), F.col("to") - 1, F.lit(_RUN).cast("long"))))
        .repartition(max(8, min(100_000, -(-total // (4 * _RUN)))), "s", "at")
    )
    numbered = runs.withColumn("slot", F.explode(F.sequence(F.col("at"), F.least(F.col("at") + _RUN, "to") - 1)))
    length = F.lit(block_words)
    epoch = F.floor(F.col("slot") / F.col("blocks"))
    index = F.col("slot") - epoch * F.col("blocks")
    late = epoch >= F.col("epochs")
    short = late & (index >= F.col("whole"))
    among = F.when(late, F.col("whole")).otherwise(F.col("blocks"))
    block = F.when(short, F.col("whole")).otherwise(permuted(index, F.greatest(among, F.lit(1)), F.col("s"), epoch))
    size = F.least(length, F.col("total") - F.col("block") * length)
    placed = numbered.withColumn("block", block).withColumn("words", F.when(late, F.least(size, F.col("rest") - index * length)).otherwise(size))
    return placed.select("shard", "s", "slot", "block", "words", (F.col("words") < size).alias("cut"))


def mixed_documents(docs: DataFrame, made: Mix, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs as the mix of them takes them: a row per document and time, columns as they are, its text the words taken that time.

    A text that is taken whole stays as it is; of others the words are joined by a space. Words that
    blocks don't take go, and with them documents none of whose words are taken, null and empty texts among them. n_chars, where
    there is one, follows. Rows that repeat an id are taken each by its own share. Columns may have any names but a repeated one.
    """
    names = docs.columns
    by = made.pieces.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("pos", "n", "times", "part"))).alias("pieces"))
    rest = F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(names) if c != text_col], F.lit(0).alias("none"))
    shown = docs.select(docs[id_col].alias("id"), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("h"), docs[source_col].alias("source"), docs[text_col].alias("text"), rest.alias("rest"))
    shown = shown.where(F.coalesce(F.col("text").rlike(WORD), F.lit(False))).withColumn("k", F.row_number().over(Window.partitionBy("id", "h").orderBy("source")))
    joined = shown.join(by, shown["id"].eqNullSafe(by["id"]) & (shown["h"] == by["h"]) & (shown["k"] == by["k"])).select("text", "rest", "pieces")
    most = F.array_max(F.transform("pieces", lambda p: p["times"] + (p["part"] > 0).cast("long")))
    timed = joined.withColumn("time", F.explode(F.sequence(F.lit(0).cast("long"), most - 1)))

    def count(p: Column) -> Column:
        return F.when(p["times"] > F.col("time"), p["n"]).when(p["times"] == F.col("time"), p["part"]).otherwise(F.lit(0))

    own = F.filter(F.transform("pieces", lambda p: F.struct((p["pos"] + 1).cast("int").alias("at"), count(p).cast("int").alias("n"))), lambda p: p["n"] > 0)
    words = F.regexp_extract_all(F.col("text"), F.lit(f"({WORD})"), F.lit(1))
    taken = F.aggregate("own", F.lit(0), lambda a, p: a + p["n"])
    cut = F.array_join(F.flatten(F.transform("own", lambda p: F.slice(F.col("words"), p["at"], p["n"]))), " ")
    timed = timed.withColumn("own", own)
    whole = timed.withColumn("whole", taken == F.regexp_count(F.col("text"), F.lit(WORD)))
    out = whole.withColumn("words", F.when(~F.col("whole"), words)).withColumn("shown", F.when(F.col("whole"), F.col("text")).otherwise(cut))

    def column(i: int, c: str) -> Column:
        if c == text_col:
            return F.col("shown")
        return F.length("shown").cast(docs.schema["n_chars"].dataType) if c == "n_chars" else F.col(f"rest.c{i}")

    return out.select(*[column(i, c).alias(c) for i, c in enumerate(names)])
