"""What changes hands at a limit gives the same on both sides of it."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from umbra.llm import decontaminate, embeddings, langid, mixing, simhash, tokencount, tokenids


def gram_counts(text):
    """N-grams of a text by a loop: letters, and one space for each run of others and for the ends."""
    row = [" "]
    for c in f"{text} ":
        if c.isalpha():
            row.append(c)
        elif row[-1] != " ":
            row.append(" ")
    return Counter("".join(row[i : i + n]) for n in langid.ORDERS for i in range(len(row) - n + 1) if row[i : i + n] != [" "])


@pytest.mark.parametrize("length", [0, 1, 5, 6, 7, 100])
def test_language_counts_of_long_texts_are_those_of_short_ones(length):
    rng = random.Random(length)
    for _ in range(20):
        text = "".join(rng.choice("ab cé.日1\n") for _ in range(length))
        want = np.bincount(langid.buckets([text])[0], minlength=1 << langid.BITS)
        assert want.sum() == sum(gram_counts(text).values())
        for piece in (1, 2, 3, 6, 7, 64):
            assert (langid.long_counts(text, piece) == want).all()


def test_language_of_texts_over_a_piece(monkeypatch):
    model = langid.Model(["a", "b", "c"], np.random.default_rng(1).normal(size=(1 << langid.BITS, 3)).astype(np.float32))
    texts = ["où est le chat? " * 50, "", "日本" * 300, "x"]
    whole = model.log_likelihoods(texts)
    monkeypatch.setattr(langid, "_PIECE", 40)
    np.testing.assert_allclose(model.log_likelihoods(texts), whole, rtol=1e-9, atol=1e-6)


def test_languages_in_blocks(spark):
    rng = random.Random(3)
    docs = [(i, "".join(rng.choice("abcdefgh "[k % 5 : k % 5 + 4]) for _ in range(200)), f"l{k}") for i, k in enumerate(list(range(9)) * 3)]
    df = spark.createDataFrame([*docs, (98, "...", "l1"), (99, None, None)], "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert len(model.langs) == 9
    assert len(model.blocks(2 * (4 << langid.BITS))) == 5
    got = [df.select("doc_id", langid.predict_column(model, df["text"], df, most).alias("p")).orderBy("doc_id").collect() for most in (1 << 30, 2 * (4 << langid.BITS))]
    assert [(a["doc_id"], a["p"]["lang"]) for a in got[0]] == [(b["doc_id"], b["p"]["lang"]) for b in got[1]]
    assert [a["p"]["score"] for a in got[0]] == pytest.approx([b["p"]["score"] for b in got[1]])
    assert got[0][-1]["p"]["lang"] == got[0][-2]["p"]["lang"] == "und"
    assert langid.fit(df, max_languages=2).langs == ["l0", "l1"]


def test_leaks_are_the_same_in_one_index_and_in_many(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(300)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(6, 40)))) for i in range(60)] + [(3, "one more text of the id three")]
    docs = [(i, " ".join(word() for _ in range(50)) + " " + rng.choice(items)[1] + " x " * (i % 3)) for i in range(40)] + [(90, items[3][1] + " one more text of the id three"), (91, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted(map(tuple, decontaminate.find_leaks(df, bench, shard_items=n).collect())) for n in (4096, 7))
    assert len(list(decontaminate.indexes(bench, shard_items=7))) > 5
    assert [r[:3] for r in one] == [r[:3] for r in many]
    assert [r[3:] for r in one] == [pytest.approx(r[3:]) for r in many]
    assert len(one) >= 41


def test_many_sources(spark):
    """More sources than groups of numbers, equal and unequal: every source's words meet its target."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(id % 7 as int))").alias("text"), F.format_string("s%05d", F.pmod("id", F.lit(1500))).alias("source"))
    made = mixing.mix(df, block_words=2, shard_slots=64)
    taken = made.rows.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"))
    assert taken.where("abs(taken - target) > 0.5 + 1e-6").count() == 0
    assert taken.where("taken > 0").count() > 1000


def test_draws_follow_the_targets(spark):
    sources = spark.createDataFrame([(0, 10.0), (1, 0.0), (2, 30.0), (3, 60.0)], "s long, target double")
    ranges, low = mixing._draw_ranges(sources, 3, 100.0)
    rows = {r["s"]: (r["lo"], r["hi"]) for r in ranges.collect()}
    assert sorted(rows) == [0, 2, 3]
    assert rows[0][0] == 0
    assert (rows[0][1], rows[2][1]) == (rows[2][0], rows[3][0])
    assert rows[3][1] == 1 << 52
    assert rows[0][1] / (1 << 52) == pytest.approx(0.1)
    assert all(r["lo"] >> low <= r["g"] <= (r["hi"] - 1) >> low for r in ranges.collect())


def test_mixed_documents_of_clashing_names(spark):
    names = ["doc_id", "text", "source", "_h", "_k", "time", "own", "pieces", "words", "whole", "rest", "id", "h", "k"]
    df = spark.createDataFrame([(i, "a b c " * i, "s", *[f"{n}{i}" for n in names[3:]]) for i in range(6)], ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names))
    out = mixing.mixed_documents(df, mixing.mix(df))
    assert out.dtypes == df.dtypes
    rows = out.collect()
    assert {r["doc_id"] for r in rows} == {1, 2, 3, 4, 5}
    assert all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names[3:])


def test_repeated_ids_keep_fingerprints_apart(spark):
    base = (1 << 40) - 1
    fps = spark.createDataFrame([(5, base), (5, 0), (3, base ^ 1)], "id long, fp long")
    links = simhash.ball_links(fps.select("fp", F.col("fp").alias("rep"))).collect()
    assert {frozenset(r) for r in links} == {frozenset((base, base ^ 1))}
    texts = ["alfa beta gamma delta", "quite other words stand here", "alfa beta gamma delta"]
    df = spark.createDataFrame([(5, texts[0]), (5, texts[1]), (3, texts[2])], "doc_id long, text string")
    assert sorted(tuple(r)[::2] for r in simhash.near_duplicates(df).collect()) == [(3, 3), (5, 3), (5, 5)]


def test_kept_parts_and_words_change_no_result(monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [f"one two {i} three\nfour-{i % 7}, five." for i in range(200)]
    want = [x.tolist() for x in tokenids.Encoder(path).encode(texts)]
    monkeypatch.setattr(tokenids.Encoder, "KEPT_BYTES", 2000)
    encoder = tokenids.Encoder(path)
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode(texts)] == want
    assert len(encoder.slot) <= 2000 // encoder.PART_BYTES
    vocabulary = tokencount.zipf_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    plain = tokencount.Counter(vocabulary)
    monkeypatch.setattr(tokencount.Counter, "KEPT_BYTES", 500)
    assert [tokencount.Counter(vocabulary).text(t) for t in texts] == [plain.text(t) for t in texts]


def test_long_lists_of_vectors_lose_no_candidate(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = []
    for c in range(6):
        centre = rng.normal(size=24)
        rows += [(1000 * c + i, (centre + rng.normal(scale=0.3, size=24)).tolist(), 0) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = []
    for block in (1 << 20, 16):
        monkeypatch.setattr(embeddings, "BLOCK", block)
        got.append(sorted(map(tuple, embeddings.near_duplicates(df).collect())))
    assert got[0] == got[1]
    assert sum(r[1] for r in got[0]) > 100
