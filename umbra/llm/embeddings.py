"""Near-duplicate vectors by a pivot-permutation index with inverted pivot lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import BROADCAST_BYTES, local_labels, materialize
from umbra.llm.components import connected_components

#: A vector's description: its PREFIX nearest pivots, in order. Candidates share SHARED of them.
PREFIX, SHARED = 8, 2
#: Pivots are drawn from so many vectors at most, and none is closer to another than APART.
SAMPLE, PIVOTS, APART = 32_768, 8192, 0.7
#: Vectors of a pivot's list that one task compares with as many others.
BLOCK = 512


def usable(embedding: Column) -> Column:
    """No null or non-finite component, and not zero. Huge components whose squares overflow are no obstacle: norms are scaled."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(embedding) > 0) & ~bad & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _units(vectors: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, with zeros up to width, and their true lengths."""
    sizes = vectors.map(len).to_numpy()
    x = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        x[i, : len(v)] = v
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)), sizes


def choose_pivots(classes: DataFrame, n: int, width: int) -> np.ndarray:
    """Up to about 2 sqrt(n) vectors of a bounded sample drawn by a hash, thinned so that crowded places get few."""
    want = int(min(PIVOTS, max(16, 2 * n**0.5), max(1, BROADCAST_BYTES // (8 * max(1, width)))))
    sample = classes.select("vector", F.xxhash64(F.lit("pivot"), "label", "vector").alias("o")).orderBy("o").limit(min(SAMPLE, 8 * want)).toPandas()
    if not len(sample):
        return np.zeros((0, width))
    x, _ = _units(sample["vector"], width)
    chosen = np.zeros((want, width))
    k = 0
    for v in x:
        if k < want and (not k or (chosen[:k] @ v).max() < APART):
            chosen[k] = v
            k += 1
    return chosen[:k]


def link_classes(classes: DataFrame, n: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """classes(cid, label, vector, m) -> (cid, n_links) and (u, v): links counted by multiplicity, and a forest of them.

    Lists hold ids alone until it is known what is compared with what. A list (label, pivot) of up to a block is compared as it is. A
    longer one becomes lists of two pivots, the second one after the first, so that lists stay short as the table grows; and one
    that is still longer than a block is cut into blocks by a hash, and each pair of blocks is a group of its own,
    so that no task holds a whole hot list. A group gives at most a row per vector, not its pairs. Two vectors
    are compared in the list of the first pivot (or two) that they share and in no other.
    """
    width = classes.agg(F.max(F.size("vector"))).first()[0] or 0
    shared = classes.sparkSession.sparkContext.broadcast(choose_pivots(classes, n, width))

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivots = shared.value
        k = min(PREFIX, len(pivots))
        for batch in batches:
            for at in range(0, len(batch), 1024):
                rows = batch.iloc[at : at + 1024]
                x, _ = _units(rows["vector"], width)
                s = x @ pivots.T
                near = np.argsort(-s, axis=1, kind="stable")[:, :k] if k == len(pivots) else np.argpartition(-s, k - 1, axis=1)[:, :k]
                near = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, axis=1), axis=1, kind="stable"), axis=1)
                yield rows.assign(nearest=list(near.astype(np.int32)))

    described = materialize(classes.mapInPandas(describe, "cid long, label string, vector array<double>, m long, nearest array<int>"))

    def of_length(lists: DataFrame) -> DataFrame:
        sizes = lists.groupBy("label", "pivot", "second").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("size")).where("size > 1")
        return lists.join(sizes.drop("size"), ["label", "pivot", "second"])

    by_one = described.select("cid", "label", F.explode("nearest").alias("pivot"), "nearest").withColumn("second", F.lit(-1))
    by_one = materialize(of_length(by_one))
    alone = F.size("nearest") < SHARED  # there is no second pivot
    fields = ("label", "pivot", "second", "cid", "blocks")
    long = by_one.where((F.col("blocks") > 1) & ~alone)
    by_two = of_length(long.select("cid", "label", "pivot", F.explode(F.filter("nearest", lambda p: p > F.col("pivot"))).alias("second")))
    lists = by_one.where((F.col("blocks") == 1) | alone).select(*fields).unionByName(by_two.select(*fields))
    cut = (
        lists.withColumn("b", F.pmod(F.xxhash64(F.lit("block"), "cid"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("label", "pivot", "second", F.least("b", "other").alias("lo"), F.greatest("b", "other").alias("hi"), "b", "cid")
        .join(described.drop("label"), "cid")
    )

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, pivot, second, lo, hi = key
        rows = rows.sort_values("cid", ignore_index=True)
        n = len(rows)
        x, sizes = _units(rows["vector"], width)
        held = np.stack(rows["nearest"].to_numpy())
        ids, at = np.unique(held, return_inverse=True)
        member = np.zeros((n, len(ids)), np.float32)
        member[np.repeat(np.arange(n), held.shape[1]), at.ravel()] = 1
        before = member[:, ids < pivot] if second < 0 else member[:, (ids < second) & (ids != pivot)]
        b = rows["b"].to_numpy()
        left, right = np.flatnonzero(b == lo), np.flatnonzero(b == hi)
        least = min(SHARED, held.shape[1])
        linked = (x[left] @ x[right].T >= threshold) & (member[left] @ member[right].T >= least) & (before[left] @ before[right].T == 0) & (sizes[left][:, None] == sizes[right][None, :])
        if lo == hi:
            np.fill_diagonal(linked, False)
        m = rows["m"].to_numpy()
        count = np.zeros(n, np.int64)
        count[left] += linked @ m[right]
        if lo != hi:
            count[right] += linked.T @ m[left]
        i, j = np.nonzero(linked)
        root = local_labels(n, left[i], right[j])
        cid = rows["cid"].to_numpy()
        out = pd.DataFrame({"cid": cid, "n_links": count, "root": cid[root]})
        return out[count > 0]

    found = materialize(cut.groupBy("label", "pivot", "second", "lo", "hi").applyInPandas(compare, "cid long, n_links long, root long"))
    return found.groupBy("cid").agg(F.sum("n_links").alias("n_links")), found.select(F.col("root").alias("u"), F.col("cid").alias("v"))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Only vectors of equal, non-null labels and equal length are compared. Vectors that are null, empty, zero, or hold
    null or non-finite components, and those without a label, link with nothing and are kept. Equal vectors of a label are one class
    with a multiplicity, so copies cost one row. Rows that repeat an id are vectors of their own, and count one another. An empty table gives no rows.
    """
    rows = vectors.select(vectors[id_col].alias("id"), vectors[vector_col].cast("array<double>").alias("vector"), vectors[label_col].cast("string").alias("label"))
    good = usable(F.col("vector")) & F.col("label").isNotNull()
    classes = materialize(rows.where(good).groupBy("label", "vector").agg(F.count("*").alias("m"), F.min("id").alias("rep")).withColumn("cid", F.monotonically_increasing_id()))
    n = classes.count()
    counts, forest = link_classes(classes.select("cid", "label", "vector", "m"), n, threshold)
    part = materialize(connected_components(forest))
    named = classes.select("cid", "label", "vector", "m", "rep").join(part, classes["cid"] == part["node"], "left").withColumn("c", F.coalesce("component", "cid")).drop("node", "component")
    least = named.groupBy("c").agg(F.min("rep").alias("component_id"))
    done = named.join(least, "c").join(counts, "cid", "left").select("label", "vector", "component_id", (F.coalesce("n_links", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    linked = rows.where(good).join(done, ["label", "vector"]).select("id", "n_links", "component_id")
    alone = rows.where(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
