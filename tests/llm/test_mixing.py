import re

import pytest
from pyspark.sql import functions as F

from umbra.llm import mixing, queries

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.mark.parametrize("n", [1, 2, 3, 10, 257])
def test_permutations(spark, n):
    df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5)).alias("a"), mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(6)).alias("b"))
    rows = df.collect()
    assert sorted(r["a"] for r in rows) == sorted(r["b"] for r in rows) == list(range(n))
    assert n < 10 or [r["a"] for r in rows] != [r["b"] for r in rows]


def plain_targets(totals):
    order = sorted((s for s in totals if s is not None), key=lambda s: s.encode()) + ([None] if None in totals else [])
    w = {s: 1 + i % 3 for i, s in enumerate(order)}
    full, left = {}, dict.fromkeys(order)
    while True:
        rest = sum(totals.values()) - sum(full.values())
        free = sum(w[s] for s in left)
        over = [s for s in left if rest * w[s] / free > 3 * totals[s] + 1e-9]
        if not over:
            return full | {s: rest * w[s] / free for s in left}
        for s in over:
            full[s] = 3 * totals[s]
            del left[s]


@pytest.mark.parametrize("totals", [{"a": 10, "b": 10, "c": 10}, {"a": 1000, "b": 1, "c": 2, None: 5, "é": 7}, {"x": 5}, {None: 4, "a": 0}, {"a": 0, "b": 0}])
def test_targets(spark, totals):
    df = spark.createDataFrame(list(totals.items()), "source string, total long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(plain_targets(totals)) if sum(totals.values()) else all(v == 0 for v in got.values())


def sizes(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(rows, docs):
    """rows of the query against documents (doc_id, text, source)."""
    totals = {}
    for _, t, s in docs:
        totals[s] = totals.get(s, 0) + sizes(t)
    targets = plain_targets(totals) if sum(totals.values()) else dict.fromkeys(totals, 0.0)
    assert sorted((r["doc_id"], r["size"]) for r in rows) == sorted((d, sizes(t)) for d, t, _ in docs)
    source = {d: s for d, _, s in docs}
    taken = dict.fromkeys(totals, 0)
    for r in rows:
        s = source[r["doc_id"]]
        assert r["source_size"] == totals[s]
        assert r["target"] == pytest.approx(targets[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s, n in taken.items():
        assert abs(n - targets[s]) <= 0.5 + 1e-6


def test_mix_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text", "source").collect()]
    rows = queries.op2_mix_sources(spark, MIDDLE).collect()
    check(rows, docs)
    again = queries.op2_mix_sources(spark, MIDDLE).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def odd(spark):
    docs = [(i, "w " * (i % 7 * 40), "hot" if i % 3 else f"s{i % 5}") for i in range(120)]
    docs += [(200, None, "hot"), (201, "", None), (202, "one two three\x1cfour", None), (203, "x " * 20_000, "big"), (204, "y", "none"), (205, None, "zero")]
    return docs, spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, source string, size int, block string")


def test_mix_of_odd_rows_in_any_layout(spark):
    docs, df = odd(spark)
    made = mixing.mix(df, block_words=16, shard_slots=32).rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
    rows = made.collect()
    check(rows, docs)
    other = mixing.mix(df.repartition(7, "text"), block_words=16, shard_slots=32).rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
    assert sorted(map(tuple, rows)) == sorted(map(tuple, other.collect()))
    assert mixing.mix(df.limit(0)).rows.count() == 0
    assert {r["taken"] for r in mixing.mix(df.where("doc_id in (200, 201)")).rows.collect()} == {0}


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b c", "s")] * 3 + [(None, "d e", "s"), (None, None, "t"), (1, "other", "t")], "doc_id long, text string, source string")
    rows = mixing.mix(df, block_words=2).rows.collect()
    assert len(rows) == 6
    assert sum(r["taken"] for r in rows) == sum(r["size"] for r in rows) == 12


def test_slots_map_onto_blocks(spark):
    _, df = odd(spark)
    made = mixing.mix(df, block_words=16, shard_slots=32)
    want = {r["s"]: r["slots"] for r in made.sources.collect()}
    by = {}
    for r in made.slots.collect():
        by.setdefault(r["s"], []).append(r["slot"])
    assert {s: sorted(v) for s, v in by.items()} == {s: list(range(n)) for s, n in want.items() if n}
    assert made.slots.groupBy("s", "block").count().agg(F.max("count")).first()[0] <= 3


def test_documents_of_a_mix(spark):
    docs, df = odd(spark)
    made = mixing.mix(df, block_words=16)
    out = mixing.mixed_documents(df, made)
    assert out.columns == df.columns
    words = {}
    for r in out.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + sizes(r["text"])
    assert words == {r["id"]: r["taken"] for r in made.rows.collect() if r["taken"]}
