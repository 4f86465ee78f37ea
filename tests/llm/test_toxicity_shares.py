import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from umbra.llm import toxicity


def test_scores_hold_the_share_of_the_table_and_not_of_the_sample():
    rng = random.Random(5)
    plain = ["".join(rng.choice(["an", "er", "the", "on", "ti", "nd"]) for _ in range(rng.randrange(1, 4))) for _ in range(300)]

    def text(toxic):
        w = [rng.choice(plain) for _ in range(80)]
        for _ in range(rng.randrange(1, 4) if toxic else int(rng.random() < 0.1)):
            w[rng.randrange(len(w))] = rng.choice(["grimble", "vexatron", "scorn", "blightful"])
        return " ".join(w)

    y = [int(rng.random() < 0.5) for _ in range(900)]  # drawn from a table of one toxic text in eleven
    texts = [text(t) for t in y]
    rest = np.array(y[::3])
    for shares in ((1.0, 1.0), (0.1, 1.0)):
        model = toxicity.train(texts, y, shares=shares)
        assert model.toxic
        rows = np.where(rest == 1, 1 / shares[1], 1 / shares[0])
        p = model.score(texts[::3])
        assert abs(np.average(p, weights=rows) - np.average(rest, weights=rows)) < 0.01


def plain_score(model, text):
    """The definition by loops: each word a window, alone and four times over, by both dictionaries anew."""
    import re

    import zstandard

    def size(content, window):
        plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        if not content:
            return len(zstandard.ZstdCompressor(level=toxicity.LEVEL, **plain).compress(window))
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=toxicity.LEVEL)
        return len(zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=held, **plain).compress(window))

    low = high = n = 0
    for w in re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower()):
        saved = sum(size(model.ordinary, x) - size(model.ordinary + model.toxic, x) for x in (b" " + w, (b" " + w) * 4))
        low, high, n = low + (saved >= model.thresholds[0]), high + (saved >= model.thresholds[1]), n + 1
    z = model.weights @ [1, *np.log1p([low, high, n])]
    return 1 / (1 + np.exp(-z))


def test_scores_are_those_of_the_definition(spark):
    """Texts of all lengths, nulls, repeated ids and rows, and clashing columns; the text's counted words teach as the text does."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").withColumn("score", F.lit("x")).withColumn("predicted", F.lit(1))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    odd = spark.createDataFrame([(None, "no id"), (-1, None), (-2, ""), (-3, "word " * 30_000), (-3, "idiot"), (-3, "idiot")], "doc_id long, text string").selectExpr("*", "'x' as score", "1 as predicted")
    whole = docs.unionByName(odd)
    model = toxicity.fit(whole, labels.select("doc_id", "toxic").unionByName(spark.createDataFrame([(-3, 0), (None, 1)], "doc_id long, toxic int")))
    assert model.toxic
    rows = toxicity.classify(whole, model).collect()
    assert len(rows) == 1006
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["score"] for r in rows if r["doc_id"] is not None and r["doc_id"] >= 0}
    for d in [d for d in sorted(got) if len(texts[d]) < 2000][:20]:
        assert got[d] == pytest.approx(plain_score(model, texts[d]), rel=1e-6)
    assert toxicity.classify(whole.limit(0), model).collect() == []
    many = whole.unionByName(whole.where("doc_id = 28")).unionByName(whole.where("doc_id = 28"))
    assert 0 < toxicity.fit(many, labels, docs_of_label=5).score(["idiot"])[0] < 1
