"""Repeated passages: content-defined chunks of lines, counted over all documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from umbra.llm.common import enter, materialize, small_batches

#: A line of more words is wrapped: after a word that ends in punctuation, and where there is none for long, after one whose hash is 0 modulo WRAP.
LONG, WRAP = 12, 8
#: A line ends a chunk if the rolling hash over it and the line before is 0 modulo APART.
APART = 2
#: Words that a repeated passage must have to be removed, and words of a chunk that is looked for; shorter ones are met from beside them.
LEAST_WORDS, CHUNK_WORDS = 8, 4
#: Bytes on either side of a chunk that are compared too, once the chunk's own bytes are equal.
CONTEXT = 192
#: Bits of the filter that tells most chunks that occur once before their bytes are shuffled: 8 MB, whatever the table's size.
FILTER_BITS = 1 << 26
#: Bytes of texts that are cut at a time, a longer text by itself: one pass over many short texts costs far less than a pass for each.
TOGETHER = 1 << 18

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


#: Whether a byte ends a clause, and whether it is part of a word.
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?")] = True
_INSIDE = np.ones(256, bool)
_INSIDE[[9, 10, 11, 12, 13, 32]] = False


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, enough for n bytes; only those for up to 1 << 20 are kept."""
    size = 1 << max(16, n.bit_length())
    if size not in _tables:
        made = []
        for base in (_MULTIPLIER, _INVERSE):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            made.append(np.multiply.accumulate(table))
        if size > 1 << 20:
            return made[0], made[1]
        _tables[size] = (made[0], made[1])
    return _tables[size]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _last_words(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, word: np.ndarray, final: np.ndarray | None = None) -> np.ndarray:
    """The last word of each line of texts whose words begin, end and hash so; a text ends at each of the words in final, and at the last."""
    last = np.zeros(len(starts), bool)
    before = np.searchsorted(starts, np.flatnonzero(text == 10))
    last[before[before > 0] - 1] = True
    last[-1] = True
    if final is not None:
        last[final] = True
    for ends_line in (_STOP[text[ends - 1]], word % np.uint64(WRAP) == 0):
        words = np.diff(np.flatnonzero(last), prepend=-1)
        last |= ends_line & np.repeat(words > LONG, words)
    return np.flatnonzero(last)


def _cut(text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What chunks() says of several texts that stand one after another, each from one of bounds to the next: starts and ends (bytes from
    the first text's start), hashes, and the chunk's text and number of words. No text's chunks depend on the others."""
    none = np.zeros(0, np.int64)
    inside = _INSIDE[text]
    heads = bounds[:-1][bounds[:-1] < len(text)]
    begin, finish = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    begin[heads] = inside[heads]
    finish[:-1] &= ~inside[1:]
    tails = heads[heads > 0] - 1
    finish[tails] = inside[tails]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    if not len(starts):
        return none, none, none.astype(np.uint64), none, none
    powers, inverses = _powers(len(text) + 1)
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(powers[: len(text)] * text, out=sums[1:])
    word = _mixed((sums[ends] - sums[starts]) * inverses[starts])
    border = np.searchsorted(starts, bounds)
    size = np.diff(border)
    opening, final = border[:-1][size > 0], border[1:][size > 0] - 1
    last = _last_words(text, starts, ends, word, final)
    first = np.append(0, last[:-1] + 1)
    line = _mixed((sums[ends[last]] - sums[starts[first]]) * inverses[starts[first]])
    above = np.append(np.uint64(0), line[:-1])
    above[np.searchsorted(first, opening)] = 0
    rolling = _mixed(line + above * np.uint64(_MULTIPLIER))
    cut = rolling % np.uint64(APART) == 0
    cut[np.searchsorted(last, final)] = True
    to = np.flatnonzero(cut)
    of = np.append(0, to[:-1] + 1)
    doc = np.searchsorted(border, first[of], "right") - 1
    words = last[to] - first[of] + 1
    long = (words >= CHUNK_WORDS) & (size[doc] >= LEAST_WORDS)
    a, b = starts[first[of[long]]], ends[last[to[long]]]
    return a, b, _mixed((sums[b] - sums[a]) * inverses[a] + (b - a).astype(np.uint64)), doc[long], words[long]


def chunks(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of a text's chunks of CHUNK_WORDS words or more, and their 64-bit hashes; a text of fewer than LEAST_WORDS
    words has none.

    Lines end at line feeds; a line of more than LONG words (a paragraph) is wrapped where its clauses end. A rolling hash covers each line and
    the one before, and where it is 0 modulo APART the line ends a chunk. Whether it does depends on these two lines alone, so a
    passage that is shifted, or stands among other lines, is cut in the same places. White space around a chunk is not part of it.
    """
    return _cut(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[:3]


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow column of texts or binary values without nulls, and where in them each value begins and the last ends."""
    held = column.cast(pa.large_binary())
    if not len(held):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = held.buffers()
    at = np.frombuffer(offsets, np.int64, len(held) + 1, 8 * held.offset)
    size = int(at[-1] - at[0])
    return np.frombuffer(data, np.uint8, size, int(at[0])) if size else np.zeros(0, np.uint8), at - at[0]


def _together(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Texts of a column, about TOGETHER bytes at a time: the first one's number, their bytes, and their bounds."""
    data, at = _bytes(column)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + TOGETHER, "right")) - 1)
        yield i, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def _places(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The filter's two bits for each hash."""
    return (fp & np.uint64(FILTER_BITS - 1)).astype(np.int64), ((fp >> np.uint64(32)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def _filter(twice: DataFrame, slices: int = 64) -> np.ndarray:
    """A filter of FILTER_BITS that holds all of twice(fp). Tasks make one each, which are joined slice by slice; one comes to the driver."""

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            for at in _places(batch["fp"].to_numpy().view(np.uint64)):
                held[at] = True
        for k, part in enumerate(np.array_split(np.packbits(held), slices)):
            if part.any():
                yield pd.DataFrame({"slice": [k], "bits": [part.tobytes()]})

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        joined = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in rows["bits"]])
        return pd.DataFrame({"slice": rows["slice"].iloc[:1], "bits": [joined.tobytes()]})

    out = np.array_split(np.zeros(FILTER_BITS // 8, np.uint8), slices)
    for r in twice.mapInPandas(fill, "slice int, bits binary").groupBy("slice").applyInPandas(join, "slice int, bits binary").collect():
        out[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    return np.concatenate(out)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return small_batches(docs).select(docs[id_col].cast("long").alias("id"), F.xxhash64(docs[text_col]).alias("h"), docs[text_col].alias("text")).where("text is not null")


def _hashes(rows: DataFrame) -> DataFrame:
    """The hash of every chunk of all texts."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("line dedup")
        for batch in batches:
            for _, data, bounds in _together(batch.column("text")):
                yield pa.record_batch({"fp": _cut(data, bounds)[2].view(np.int64)})

    return rows.select("text").mapInArrow(hashes, "fp long")


def _occurrences(rows: DataFrame, held: np.ndarray) -> DataFrame:
    """A row per chunk whose hash the filter holds: document, place, hash, number of words, bytes, and the bytes before and after it."""
    shared = rows.sparkSession.sparkContext.broadcast(held)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("line dedup")
        bits = shared.value
        for batch in batches:
            for i, text, bounds in _together(batch.column("text")):
                a, b, fp, of, words = _cut(text, bounds)
                one, two = _places(fp)
                known = (bits[one >> 3] >> (7 - (one & 7)) & 1 & (bits[two >> 3] >> (7 - (two & 7)))).astype(bool)
                a, b, fp, of, words = a[known], b[known], fp[known], of[known], words[known]
                data, rows_of = text.tobytes(), pa.array(i + of)
                cut = [(a, b), (np.maximum(bounds[of], a - CONTEXT), a), (b, np.minimum(bounds[of + 1], b + CONTEXT))]
                chunk, before, after = (pa.array([data[x:y] for x, y in zip(c.tolist(), d.tolist(), strict=True)], pa.binary()) for c, d in cut)
                yield pa.record_batch(
                    {
                        "id": batch.column("id").take(rows_of),
                        "h": batch.column("h").take(rows_of),
                        "start": a - bounds[of],
                        "end": b - bounds[of],
                        "fp": fp.view(np.int64),
                        "words": words.astype(np.int32),
                        "chunk": chunk,
                        "before": before,
                        "after": after,
                    }
                )

    return rows.mapInArrow(whole, "id long, h long, start long, end long, fp long, words int, chunk binary, before binary, after binary")


def _padded(column: pa.Array, width: int, backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """A row of width bytes per value, spaces where it has none, from its end if backwards; and which bytes are the value's."""
    data, at = _bytes(column)
    size, place = np.diff(at)[:, None], np.arange(width)
    own = place >= width - size if backwards else place < size
    out = np.full(own.shape, 32, np.uint8)
    out[own] = data
    return (out[:, ::-1], own[:, ::-1]) if backwards else (out, own)


def _equal(x: pa.Array, y: pa.Array, backwards: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of values how many bytes both begin with (end with, if backwards), up to the end of a word of both, and their words."""
    width = 1 + max(int(np.diff(_bytes(c)[1]).max(initial=0)) for c in (x, y))
    (a, of_a), (b, of_b) = _padded(x, width, backwards), _padded(y, width, backwards)
    place = np.arange(width, dtype=np.int32)
    inside = _INSIDE[a]
    n = np.argmin((a == b) & of_a & of_b, axis=1)
    n = np.where(~(inside | _INSIDE[b]) & (place <= n[:, None]), place, 0).max(axis=1)
    inside &= place < n[:, None]
    words = inside.copy()
    words[:, 1:] &= ~inside[:, :-1]
    return np.where(inside, place + 1, 0).max(axis=1), words.sum(axis=1)


#: Whether shuffle files of a query go as soon as it has ended. Else they stay until the driver's JVM collects its plan, often after the next shuffle.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _finished(df: DataFrame) -> DataFrame:
    """df, written and read back, without the shuffle files behind it."""
    conf = df.sparkSession.conf
    held = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        return materialize(df)
    finally:
        if held is None:
            conf.unset(_CLEANUP)
        else:
            conf.set(_CLEANUP, held)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per passage that repeats an earlier one: id, h (xxhash64 of the text), start, end (bytes of the UTF-8 text), first_id.

    The occurrence of a chunk with the smallest id, then h, then place is the first, and stays; null ids come first. Hashes only find candidates:
    occurrences are grouped by their bytes. A repeat reaches as many words beyond its chunk as the first's surroundings hold too, up to
    CONTEXT bytes on either side, and is removed if it has LEAST_WORDS words; of overlapping repeats the later one is cut. What goes
    always stands at an earlier place too. Rows that repeat id and text are one document. Hashes are counted before any text
    is shuffled, and bytes of chunks that occur once are hardly shuffled (a filter of bounded size tells them); texts meet by hash in
    aggregates with partial minima and joins, which split a hot chunk.
    """
    rows = _rows(docs, id_col, text_col)
    twice = _finished(_hashes(rows).groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp"))
    occurrences = _occurrences(rows, _filter(twice)).join(twice, "fp")
    found = _finished(occurrences.distinct() if _repeated_rows(docs, id_col) else occurrences)
    place = F.struct("id", "h", "start")
    first = found.groupBy("fp", "chunk").agg(F.min(place).alias("first"), F.min_by(F.struct("before", "after"), place).alias("around"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = found.join(first, ["fp", "chunk"]).where(~place.eqNullSafe(F.col("first")))

    @F.arrow_udf("struct<left int, right int, words int>")
    def reach(before: pa.Array, after: pa.Array, first_before: pa.Array, first_after: pa.Array) -> pa.Array:
        (left, more), (right, and_more) = _equal(before, first_before, backwards=True), _equal(after, first_after)
        return pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in (left, right, more + and_more)], ["left", "right", "words"])

    reached = again.select("id", "h", "start", "end", "words", F.col("first.id").alias("first_id"), reach("before", "after", "around.before", "around.after").alias("r"))
    reached = reached.where(F.col("words") + F.col("r.words") >= LEAST_WORDS)
    spans = reached.select("id", "h", (F.col("start") - F.col("r.left")).alias("start"), (F.col("end") + F.col("r.right")).alias("end"), "first_id")
    done = F.max("end").over(Window.partitionBy("id", "h").orderBy("start", F.col("end").desc(), "first_id").rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("start", F.greatest("start", done)).where("start < end").select("id", "h", "start", "end", "first_id")


def _repeated_rows(docs: DataFrame, id_col: str) -> bool:
    return docs.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").limit(1).count() > 0


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_removed, removed_bytes, removed (start, end, first_id in order). Null and empty texts lose nothing.

    Texts of any length are cut into chunks whole; rows that repeat an id and a text lose the same; an empty table gives no rows.
    """
    gone = repeats(docs, id_col, text_col)
    by = gone.groupBy("id", "h").agg(F.array_sort(F.collect_set(F.struct("start", "end", "first_id"))).alias("removed"))
    keys = docs.select(docs[id_col].alias(id_col), F.xxhash64(docs[text_col]).alias("_h"))
    joined = keys.join(by, keys[id_col].eqNullSafe(by["id"]) & (keys["_h"] == by["h"]), "left")
    removed = F.coalesce("removed", F.array().cast("array<struct<start:long,end:long,first_id:long>>"))
    return joined.select(keys[id_col], F.size(removed).alias("n_removed"), F.aggregate(removed, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]).alias("removed_bytes"), removed.alias("removed"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated passages taken out of their texts, columns and rows as they are; lines left empty go with the passage. Null
    texts stay null."""
    gone = repeats(docs, id_col, text_col)
    by = gone.groupBy(F.col("id").alias("_id"), F.col("h").alias("_gone_h")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_gone"))
    joined = docs.withColumn("_h", F.xxhash64(docs[text_col]))
    joined = joined.join(by, joined[id_col].cast("long").eqNullSafe(by["_id"]) & (joined["_h"] == by["_gone_h"]), "left")
    pieces = F.aggregate(
        "_gone",
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").cast("binary").alias("out")),
        lambda a, x: F.struct(x["end"].alias("at"), F.concat(a["out"], F.substring(F.col("_bytes"), (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int"))).alias("out")),
        lambda a: F.concat(a["out"], F.substring(F.col("_bytes"), (a["at"] + 1).cast("int"), F.octet_length(text_col))),
    )
    cut = F.regexp_replace(F.decode(pieces, "UTF-8"), r"\n\s*\n", "\n")
    done = joined.withColumn("_bytes", F.encode(text_col, "UTF-8")).withColumn(text_col, F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(cut))
    return done.select(*docs.columns)
