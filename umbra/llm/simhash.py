"""Near-duplicates by SimHash fingerprints and meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import enter, local_labels, materialize, small_batches
from umbra.llm.components import connected_components
from umbra.llm.similar import band_keys, shingle_set, similar_links

_CHUNK = 1 << 16  # hashes whose bits are counted at once


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of a text's word shingles, repeats included; texts without a word give zero.

    A-Z are lower-cased and words are runs of anything but ASCII white space, which is what bytes.lower()
    and bytes.split() do on UTF-8. Fewer words than a shingle: the whole sequence is the one shingle.
    """
    return _majority(shingle_hashes(text, words, seed))


def shingle_hashes(text: str | None, words: int = 4, seed: int = 42) -> Iterator[np.ndarray]:
    """Hashes of a text's word shingles, in order, _CHUNK at a time."""
    w = text.encode("utf-8", "replace").lower().split() if text else []
    if not w:
        return
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(w) - words + 1)
    ends = ends[words - 1 :] if len(w) >= words else ends[-1:]
    for k in range(0, n, _CHUNK):
        part = [xxhash.xxh64_intdigest(joined[s:e], seed) for s, e in zip(starts[k : min(n, k + _CHUNK)].tolist(), ends[k : k + _CHUNK].tolist(), strict=True)]
        yield np.array(part, np.uint64)


def _majority(parts: Iterable[np.ndarray]) -> int:
    ones = np.zeros(64, np.int64)
    n = 0
    for part in parts:
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, words: int = 4, seed: int = 42) -> Column:
    """fingerprint() as a signed long column."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        enter("simhash")
        return pd.Series(np.array([fingerprint(x, words, seed) for x in texts], np.uint64).view(np.int64))

    return of(text)


def signature_column(text: Column, words: int) -> Column:
    """fingerprint() as a signed long, and keys and shingles for similar_links()."""

    @F.pandas_udf("fp long, keys array<long>, shingles binary")
    def of(texts: pd.Series) -> pd.DataFrame:
        enter("simhash")
        fps, keys, sets = [], [], []
        for text in texts:
            parts = list(shingle_hashes(text, words))
            hashes = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
            fps.append(_majority(parts))
            keys.append(band_keys(hashes))
            sets.append(shingle_set(hashes))
        return pd.DataFrame({"fp": np.array(fps, np.uint64).view(np.int64), "keys": keys, "shingles": sets})

    return of(text)


def key_bits(n: int, half: int, rows_of_key: int = 8192, least: int = 12, most: int = 32) -> int:
    """So many low bits that n fingerprints give a key about rows_of_key rows."""
    for b in range(least, most):
        if n * sum(comb(b, i) for i in range(half + 1)) <= rows_of_key << b:
            return b
    return most


def _masks(lo: int, hi: int, most: int) -> list[np.ndarray]:
    """For each count up to most: the masks that flip so many bits of lo..hi-1."""
    return [np.array([sum(1 << x for x in c) for c in combinations(range(lo, hi), i)], np.uint64) for i in range(most + 1)]


#: Bits by which a hot key is made longer, and the longest a key gets.
MORE_BITS, MOST_BITS = 8, 60


def _flipped(rows: DataFrame, at: int, bits: int, half: int) -> DataFrame:
    """rows(key, used, fp, rep) for each flip of the fingerprint's bits at..at+bits-1 that the radius leaves: the key with these bits put in."""
    flips = [(i, int(x) - (1 << 64 if x >> np.uint64(63) else 0)) for i, own in enumerate(_masks(at, at + bits, half)) for x in own]
    own = F.lit(((1 << bits) - 1) << at)
    each = rows.select("*", F.explode(F.array(*[F.struct(F.lit(i).alias("n"), F.lit(x).cast("long").alias("x")) for i, x in flips])).alias("flip"))
    return each.where(F.col("used") + F.col("flip.n") <= half).select(
        F.col("key").bitwiseOR(F.col("fp").bitwiseAND(own).bitwiseXOR(F.col("flip.x"))).alias("key"), (F.col("used") + F.col("flip.n")).alias("used"), "fp", "rep"
    )


def ball_links(fps: DataFrame, radius: int = 4, most: int = 1 << 21) -> DataFrame:
    """fps(fp long, rep long), one row per fingerprint -> links (u, v) between reps that join all within radius bits.

    Every fingerprint emits all variants within half the radius. Variants are shuffled by their low bits:
    a row goes out once for each value that its variants take there, and the variants of that value, with the
    flips that are left for the high bits, are written out where they arrive. Equal variants collide. As both
    ends are within radius / 2 of the variant, a collision is a link; the distance of each link is verified
    all the same. Of the k fingerprints at one variant a chain of k - 1 links leaves the task, not all pairs.

    A key of more than most variants is split before the shuffle by its variants' next MORE_BITS bits, and again while that is too
    many, so that no task writes out more at once.
    """
    if radius % 2 or radius < 0:
        raise ValueError("radius must be even: it is met in the middle")
    half = radius // 2
    b = key_bits(fps.count(), half)
    rows = _flipped(fps.select(F.lit(0).cast("long").alias("key"), F.lit(0).alias("used"), "fp", "rep"), 0, b, half)
    dealt, levels = None, []
    while True:
        levels.append(b)
        hot = None
        if b < MOST_BITS:
            made = F.element_at(F.array(*[F.lit(sum(comb(64 - b, i) for i in range(half - u + 1))) for u in range(half + 1)]), F.col("used") + 1)
            hot = materialize(rows.groupBy("key").agg(F.sum(made.cast("long")).alias("n")).where(F.col("n") > most).select("key"))
            if hot.isEmpty():
                hot = None
        cool = (rows.join(hot, "key", "left_anti") if hot is not None else rows).select(F.lit(b).alias("bits"), "key", "used", "fp", "rep")
        dealt = cool if dealt is None else dealt.unionByName(cool)
        if hot is None:
            break
        more = min(MORE_BITS, MOST_BITS - b)
        rows = _flipped(rows.join(hot, "key", "left_semi"), b, more, half)
        b += more
    dealt = dealt.repartition(F.col("bits"), F.col("key")).sortWithinPartitions("bits", "key")
    highs = {bits: _masks(bits, 64, half) for bits in levels}

    def collide(bits: int, fp: np.ndarray, key: np.ndarray, used: np.ndarray, rep: np.ndarray) -> pd.DataFrame:
        low = np.uint64((1 << bits) - 1)
        centre = (fp & ~low) | key
        variants, origins = [], []
        for done in range(half + 1):
            own = np.flatnonzero(used == done)
            if len(own):
                masks = np.concatenate(highs[bits][: half - done + 1])
                variants.append((centre[own][:, None] ^ masks[None, :]).ravel())
                origins.append(np.repeat(own.astype(np.int32), len(masks)))
        v = np.concatenate(variants)
        s = np.sort(v)
        twice = np.unique(s[1:][s[1:] == s[:-1]])
        if not len(twice):
            return pd.DataFrame({"u": np.array([], np.int64), "v": np.array([], np.int64)})
        at = np.minimum(np.searchsorted(twice, v), len(twice) - 1)
        hit = np.flatnonzero(twice[at] == v)
        o = np.concatenate(origins)[hit]
        order = np.lexsort((o, v[hit]))
        o, x = o[order], v[hit][order]
        same = x[1:] == x[:-1]
        a, c = o[:-1][same], o[1:][same]
        near = np.bitwise_count(fp[a] ^ fp[c]) <= radius
        label = local_labels(len(fp), a[near], c[near])
        node = np.flatnonzero(label != np.arange(len(fp)))
        found = np.unique(np.column_stack((rep[label[node]], rep[node])), axis=0)
        return pd.DataFrame({"u": found[:, 0], "v": found[:, 1]})

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whole keys are looked at together, as many as make a quarter of most variants; those of one key are at most so many."""
        held: list[pd.DataFrame] = []
        variants = 0
        for batch in batches:
            enter("simhash")
            if not len(batch):
                continue
            bits, key = batch["bits"].to_numpy(), batch["key"].to_numpy()
            cut = int(((bits == bits[-1]) & (key == key[-1])).argmax())  # the last key may go on
            goes_on = held and cut == 0 and (held[-1]["bits"].iloc[-1], held[-1]["key"].iloc[-1]) == (bits[0], key[0])
            if variants >= most // 4 and not goes_on:
                yield from run(pd.concat([*held, batch.iloc[:cut]]))
                held, variants = [], 0
                batch = batch.iloc[cut:].copy()
            held.append(batch)
            for (own, used), n in batch.groupby(["bits", "used"]).size().items():
                variants += int(n) * sum(len(m) for m in highs[own][: half - used + 1])
        if held:
            yield from run(pd.concat(held))

    def run(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for bits, own in rows.groupby("bits"):
            found = collide(int(bits), own["fp"].to_numpy().view(np.uint64), own["key"].to_numpy().view(np.uint64), own["used"].to_numpy(), own["rep"].to_numpy())
            if len(found):
                yield found

    return dealt.mapInPandas(links, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, radius: int = 4) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits) and component_id, the smallest id reachable over links.

    Null, empty and blank texts have fingerprint zero and link like any other. Rows that repeat an id stay rows, each in the
    component of its own text. Texts of any length count whole.
    Null ids count only as members: they never name a component unless all of its ids are null. An empty
    table gives no rows. Only equal fingerprints are met before links are looked for, so copies cost one row.
    """
    docs = small_batches(docs)
    fp = materialize(docs.select(docs[id_col].alias("id"), fingerprint_column(docs[text_col], words).alias("fp")))
    reps = materialize(fp.groupBy("fp").agg(F.min("id").alias("rep")))
    part = materialize(connected_components(ball_links(reps.select("fp", F.col("fp").alias("rep")), radius)))
    named = reps.join(part, reps["fp"] == part["node"], "left").select("fp", "rep", F.coalesce("component", "fp").alias("c"))
    least = named.groupBy("c").agg(F.min("rep").alias("component_id"))
    return fp.join(named.join(least, "c").select("fp", "component_id"), "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def similar_groups(docs: DataFrame, id_col: str, text_col: str, words: int, radius: int, similarity: float) -> DataFrame:
    """One row per document: id and component_id, over links between texts whose word shingles have that Jaccard similarity or more.

    Within a radius of 4 bits lie few texts of a similarity below 0.95, so fingerprints give only a part of the candidates and bands
    of minima the others; all are verified. Texts of equal sets of shingles are met first, so copies cost one row.
    """
    docs = small_batches(docs)
    rows = docs.select(docs[id_col].alias("id"), signature_column(docs[text_col], words).alias("of"))
    rows = materialize(rows.select("id", "of.*").withColumn("s", F.xxhash64("shingles")))
    classes = materialize(rows.groupBy("s").agg(F.min("id").alias("rep"), F.min("fp").alias("fp")))
    own = rows.join(classes.select("s", F.col("rep").alias("id")), ["s", "id"]).select("s", "keys", "shingles").dropDuplicates(["s"])
    fps = materialize(classes.groupBy("fp").agg(F.min("s").alias("rep")))
    same = classes.select("fp", F.col("s").alias("v")).join(fps.select("fp", F.col("rep").alias("u")), "fp").where("u <> v").select("u", "v")
    part = materialize(connected_components(similar_links(own, ball_links(fps, radius).unionByName(same), similarity)))
    named = classes.join(part, classes["s"] == part["node"], "left").select("s", "rep", F.coalesce("component", "s").alias("c"))
    least = named.groupBy("c").agg(F.min("rep").alias("component_id"))
    return rows.select("id", "s").join(named.join(least, "c").select("s", "component_id"), "s").select(F.col("id").alias(id_col), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, radius: int = 4, similarity: float | None = None) -> DataFrame:
    """docs without the documents whose component has a smaller id; columns as they are.

    Components are those of near_duplicates(), or of similar_groups() if a similarity is given. Of rows that repeat an id all go
    or all stay; rows without an id stay.
    """
    found = near_duplicates(docs, id_col, text_col, words, radius) if similarity is None else similar_groups(docs, id_col, text_col, words, radius, similarity)
    gone = materialize(found.where(F.col(id_col) > F.col("component_id")).select(F.col(id_col).alias("gone")).distinct())
    return docs.join(gone, docs[id_col] == gone["gone"], "left_anti")
