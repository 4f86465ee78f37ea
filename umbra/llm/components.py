"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(u, v) of longs -> (node, component): the smallest node reachable, for nodes that have an edge to another.

    Loops (u = v) and null ends are ignored; repeated edges count once; no edges give no rows.
    Each round is two joins or aggregations on a node with partial minima; a hub's rows meet only in
    a join whose other side has one row a node, which adaptive execution splits. The number of rounds
    is logarithmic in the longest path, and they go on until nothing changes. Each round is written to the shared folder.
    """
    now = materialize(
        edges.select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("u")).where("u <> v").distinct()
    )
    mark = _mark(now)
    while mark[0]:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = now.join(least, "u").select(F.col("v"), F.col("m").alias("u")).where("u <> v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (
            large.join(low, "v")
            .select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct("v", F.col("m").alias("u")))).alias("e"))
            .select("e.v", "e.u")
            .where("u <> v")
            .distinct()
        )
        now = materialize(small)
        last, mark = mark, _mark(now)
        if mark == last:
            break
    return now.select(F.col("v").alias("node"), F.col("u").alias("component"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first())
