"""Pairs of texts whose shingles have a Jaccard similarity of 0.8 or more: MinHash bands find them, shingle sets verify them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import enter, local_labels, materialize
from umbra.llm.components import connected_components

#: Bands and minima of a band: a pair of similarity s shares a key with probability 1 - (1 - s ** ROWS) ** BANDS, 0.9995 at 0.8.
BANDS, ROWS = 32, 7
#: Members of a key that one task compares with as many others.
BLOCK = 256
_CHUNK = 1024  # hashes that are looked at at once

_rng = np.random.default_rng(8)
_TIMES = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_WEIGHT = _rng.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key per band from a text's 64-bit shingle hashes; no shingle gives no key."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), _CHUNK):
        np.minimum(least, ((hashes[k : k + _CHUNK, None] ^ _FLIP) * _TIMES).min(axis=0), out=least)
    mixed = (least ^ (least >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    key = ((mixed ^ (mixed >> np.uint64(32))).reshape(BANDS, ROWS) * _WEIGHT).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    return key.view(np.int64)


def shingle_set(hashes: np.ndarray) -> bytes:
    """The distinct hashes, 32 bits of each, in order."""
    return np.unique(hashes.astype("<u4")).tobytes()


def _at_least(similarity: float) -> object:
    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        enter("simhash")
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
        return pd.Series(out, dtype=bool)

    return similar


def _common(rows: list[np.ndarray]) -> np.ndarray:
    """How many hashes each two of the rows share."""
    out = np.zeros((len(rows), len(rows)), np.float32)
    values, at, n = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    often = np.flatnonzero(n > 1)
    column = np.full(len(values), -1)
    column[often] = np.arange(len(often))
    column = column[at]
    for k in range(0, len(often), 8192):
        own = (column >= k) & (column < k + 8192)
        held = np.zeros((len(rows), min(8192, len(often) - k)), np.float32)
        held[owner[own], column[own] - k] = 1
        out += held @ held.T
    return out


def similar_links(frame: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """frame(s, keys, shingles), a row per set s, and candidates known(u, v) -> links (u, v) between sets that join all that share a key and are similar.

    Candidates and, of each key, the members with the first and the last are verified. Where that leaves the members of a key
    in several components, all of its members of different components are compared, block by block as long keys are cut; a
    group gives at most a row per member, not its pairs.
    """
    listed = frame.select("s", F.explode("keys").alias("key"))
    ends = listed.groupBy("key").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).where("lo <> hi")
    members = materialize(listed.join(ends, "key"))
    pairs = members.select("s", F.explode(F.array("lo", "hi")).alias("e")).unionByName(known.select(F.col("u").alias("s"), F.col("v").alias("e")))
    pairs = materialize(pairs.select(F.least("s", "e").alias("u"), F.greatest("s", "e").alias("v")).where("u <> v").distinct())
    sets = materialize(frame.select("s", "shingles").join(pairs.select(F.explode(F.array("u", "v")).alias("s")).distinct(), "s"))
    one = sets.select(F.col("s").alias("u"), F.col("shingles").alias("x"))
    other = sets.select(F.col("s").alias("v"), F.col("shingles").alias("y"))
    first = materialize(pairs.join(one, "u").join(other, "v").where(_at_least(similarity)("x", "y")).select("u", "v"))
    part = connected_components(first)
    named = members.select("key", "s").join(part, members["s"] == part["node"], "left").select("key", "s", F.coalesce("component", "s").alias("c"))
    named = materialize(named)
    loose = named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("lo <> hi").select("key", "blocks")
    cut = (
        named.join(loose, "key")
        .withColumn("b", F.pmod(F.xxhash64(F.lit("block"), "s"), F.col("blocks")).cast("int"))
        .join(sets, "s")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("b", "other").alias("lo"), F.greatest("b", "other").alias("hi"), "s", "c", "shingles")
    )

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        enter("simhash")
        c = rows["c"].to_numpy()
        s = rows["s"].to_numpy()
        if (c == c[0]).all():
            return pd.DataFrame({"u": np.zeros(0, np.int64), "v": np.zeros(0, np.int64)})
        held = [np.frombuffer(x, "<u4") for x in rows["shingles"]]
        size = np.array([len(x) for x in held])
        both = _common(held).astype(np.float64)
        i, j = np.nonzero((both >= similarity * (size[:, None] + size[None, :] - both) - 1e-9) & (c[:, None] != c[None, :]))
        root = local_labels(len(rows), i, j)
        node = np.flatnonzero(root != np.arange(len(rows)))
        return pd.DataFrame({"u": s[root[node]], "v": s[node]})

    return first.unionByName(materialize(cut.groupBy("key", "lo", "hi").applyInPandas(compare, "u long, v long")))
