"""Nulls, empty and very long texts, repeated rows, empty tables and clashing names, by operator and by stage of the pipeline."""

import zlib

import duckdb
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from umbra.llm import decontaminate, lmscore, queries, simhash, tokencount, tokenids, toxicity

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
SAME = "one passage of nine words that two documents share"


def documents(spark, *rows):
    return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in rows], DOCUMENTS)


def test_embeddings_sql(spark, tmp_path):
    """The driver's tables of sf0.01 hold no pair that links, so each vector gets neighbours at several distances, in chains too."""
    rng = np.random.default_rng(3)
    rows = [tuple(r) for r in spark.read.parquet(f"{MIDDLE}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    for i, v, label in list(rows):
        for k in range(i % 4):
            v = (np.array(v) + rng.normal(size=len(v)) * np.linalg.norm(v) * 0.35 / len(v) ** 0.5).tolist()
            rows.append((10_000 * (k + 1) + i, v, label))
    rows += [(90_000, None, 1), (90_001, [0.0] * 4, 1), (90_002, [float("nan"), 1.0], 1), (90_003, rows[0][1], None), (90_004, rows[0][1], rows[0][2]), (90_005, [], 1), (90_006, [None, 1.0], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    columns = ["vec_id", "n_links", "component_id", "kept"]
    want = db.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()['op9_embedding_near_dedup']}) AS found").fetchall()
    got = list(map(tuple, queries.op9_embedding_near_dedup(spark, str(tmp_path)).select(*columns).collect()))
    assert len(got) == len(want) == len(rows)
    links = sum(n for _, n, _, _ in want)
    assert 200 < links
    assert 0.9 * links <= sum(n for _, n, _, _ in got) <= links


# Stages


def test_near_dedup_of_odd_rows(spark):
    docs = documents(spark, (1, SAME, "en", "a"), (1, SAME, "en", "a"), (2, SAME.upper(), None, None), (3, None, "en", "a"), (4, "", None, "b"), (5, " \n", "en", None), (None, SAME, "en", "a"), (6, "nothing like it at all anywhere else", "en", "a"))
    kept = corpus_pipeline.near_dedup(spark, docs, MIDDLE)
    assert kept.dtypes == docs.dtypes
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 1, 3, 6]
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), MIDDLE).count() == 0


def test_leaks_of_odd_rows(spark):
    item = next(r["text"] for r in spark.read.parquet(f"{MIDDLE}/benchmark.parquet").orderBy("item_id").collect())
    long = "clean words only " * 60_000
    docs = documents(spark, (1, f"before {item} after", "en", "a"), (1, f"before {item} after", "en", "a"), (2, None, None, None), (3, "", "en", "a"), (4, long, "en", "a"), (5, long + item, "en", "a"), (None, SAME, "en", "a"))
    kept = corpus_pipeline.without_leaks(spark, docs, MIDDLE)
    assert kept.dtypes == docs.dtypes
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 2, 3, 4]
    assert corpus_pipeline.without_leaks(spark, docs.limit(0), MIDDLE).count() == 0


def test_mix_of_odd_rows(spark):
    docs = documents(spark, *[(i, "some words of a text " * 50, "en", "a" if i % 3 else None) for i in range(30)], (1, SAME, "en", "a"), (40, None, "en", "a"), (41, "", None, None), (42, " \n ", "en", "b"), (None, SAME, None, "c"))
    rows = corpus_pipeline.mix(spark, docs, MIDDLE).collect()
    assert not {40, 41, 42} & {r["doc_id"] for r in rows}
    assert all(r["text"].split() and r["n_chars"] == len(r["text"]) for r in rows)
    assert abs(sum(len(r["text"].split()) for r in rows) - sum(len((r["text"] or "").split()) for r in docs.collect())) <= 4
    assert corpus_pipeline.mix(spark, docs.limit(0), MIDDLE).count() == 0


def test_token_ids_of_odd_rows(spark):
    long = "a word and another one " * 100_000
    docs = documents(spark, (3, None, "en", "a"), (1, SAME, None, None), (2, "", "en", "a"), (5, SAME, "en", "a"), (5, SAME, "en", "a"), (9, long, "en", "a"))
    rows = sorted(corpus_pipeline.token_ids(spark, docs, MIDDLE).collect(), key=lambda r: r["start"])
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at = 0
    for r, (i, t) in zip(rows, [(1, SAME), (2, ""), (3, ""), (5, SAME), (5, SAME), (9, long)], strict=True):
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert corpus_pipeline.token_ids(spark, docs.limit(0), MIDDLE).count() == 0


def test_run_on_an_empty_table(spark, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


# Operators


def test_toxicity_of_odd_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = toxicity.fit(docs, labels)
    assert toxicity.classify(docs.limit(0), model).collect() == []
    text = docs.first()["text"]
    twice = documents(spark, (1, text, "en", "a"), (1, text, "en", "a"), (None, None, None, None), (2, (text + " ") * 200, "en", "a"))
    clashing = twice.withColumn("score", F.lit("own")).withColumn("predicted", F.lit("own"))
    rows = toxicity.classify(clashing, model).select("doc_id", "score", "predicted").collect()
    assert len(rows) == 4
    assert len({r["score"] for r in rows if r["doc_id"] == 1}) == 1
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    nothing = toxicity.fit(docs.limit(0), labels)
    assert toxicity.classify(twice, nothing).where("score between 0 and 1").count() == 4


def test_scores_of_odd_tables(spark):
    docs = documents(spark, (1, SAME, "en", "a"), (1, SAME, "en", "a"), (2, None, None, None), (3, "", "en", "a"), (None, SAME, "en", "a"))
    net = lmscore.fit(docs)
    assert lmscore.score(docs.limit(0), net).collect() == []
    rows = lmscore.score(docs.withColumn("n_tokens", F.lit("own")), net).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in rows) == [(0, 9), (1, 9), (1, 9), (2, 0), (3, 0)]
    assert all((r["log_likelihood"] < 0) == (r["n_tokens"] > 0) for r in rows)


def test_leaks_of_repeated_rows_and_clashing_names(spark):
    item = "which of these seven rivers is the longest one? the third"
    docs = documents(spark, (1, f"x {item} y", "en", "a"), (1, f"x {item} y", "en", "a"), (None, item, "en", "a"), (2, SAME, "en", "a"))
    docs = docs.withColumn("score", F.lit("own")).withColumn("at", F.lit("own"))
    bench = spark.createDataFrame([(7, item, "own")], "item_id long, text string, doc_id string")
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()) == [(0, 7), (1, 7), (1, 7)]


def test_counts_of_odd_tables(spark):
    vocabulary = tokencount.zipf_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    docs = documents(spark, (1, SAME, "en", "a"), (1, SAME, "en", "a"), (2, None, None, None), (None, SAME, "en", "a")).withColumn("n_tokens", F.lit("own"))
    rows = tokencount.count_tokens(docs, vocabulary).collect()
    assert sorted(r["doc_id"] or 0 for r in rows) == [0, 1, 1, 2]
    assert {r["n_tokens"] for r in rows if r["doc_id"] == 2} == {0}
    assert len({r["n_tokens"] for r in rows if r["doc_id"] != 2}) == 1
    assert tokencount.count_tokens(docs.limit(0), vocabulary).collect() == []


def test_fingerprints_of_odd_tables(spark):
    docs = documents(spark, (1, SAME, "en", "a"), (1, SAME, "en", "a"), (2, SAME.upper(), "en", "a"), (3, "é" * 300_000, "en", "a"), (4, None, None, None), (5, "", "en", "a"))
    docs = docs.withColumn("fingerprint", F.lit("own")).withColumn("component_id", F.lit("own"))
    rows = sorted(tuple(r) for r in simhash.near_duplicates(docs, words=4).collect())
    assert [(i, c) for i, _, c in rows] == [(1, 1), (1, 1), (2, 1), (3, 3), (4, 4), (5, 4)]
    assert rows[4][1] == "0" * 16
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_token_files_of_clashing_names(spark, tmp_path):
    docs = documents(spark, (1, SAME, "en", "a"), (2, None, None, None)).withColumn("start", F.lit("own")).withColumn("n_tokens", F.lit("own"))
    tokenids.write_tokens(docs, f"file://{tmp_path}/ids", public_tokenizers.path("byte_bpe_50k.json"))
    rows = {r["doc_id"]: r["n_tokens"] for r in tokenids.read_tokens(spark, f"file://{tmp_path}/ids").collect()}
    assert rows[2] == 1
    assert rows[1] > 9
