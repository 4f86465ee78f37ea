import corpus_pipeline
from umbra.llm import decontaminate
from umbra.llm.common import materialize

MIDDLE = "/root/testdata/sf0.01"


def test_stages_pass_on_documents(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    columns, counts = docs.dtypes, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = materialize(stage(spark, docs, MIDDLE))
        assert docs.dtypes == columns, name
        counts.append(docs.count())
        if name != "mix":
            assert docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
    assert counts[0] == counts[1] > counts[2] > counts[3]
    assert decontaminate.find_leaks(docs, spark.read.parquet(f"{MIDDLE}/benchmark.parquet")).count() == 0
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, MIDDLE)
    rows = sorted(tokens.collect(), key=lambda r: r["start"])
    assert len(rows) == counts[4]
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in docs.collect())


def test_documents_without_a_language_go(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    odd = spark.createDataFrame([(-1, "12345 !!!", "en", "s", 9), (-2, None, "en", "s", None), (-3, "", None, None, 0)], docs.schema)
    kept = corpus_pipeline.language(spark, docs.unionByName(odd), MIDDLE)
    assert kept.where("doc_id < 0").count() == 0
    assert kept.count() == docs.count()


def test_run_is_the_stages(spark):
    a, b = (sorted(map(tuple, corpus_pipeline.run(spark, MIDDLE).collect())) for _ in range(2))
    assert a == b
    assert a
