import random

from umbra.llm import linededup


def test_copies_lose_their_short_chunks_too_and_short_runs_stay(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(7))
    long = " ".join(word() for _ in range(1000))
    docs = [(1, long), (2, long + " "), (3, "one two three four"), (4, "one two three four\n" + " ".join(word() for _ in range(60)))]
    got = {r["doc_id"]: r for r in linededup.spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[2]["removed_bytes"] > 0.99 * (len(long) - 999)
    assert [got[i]["n_removed"] for i in (1, 3, 4)] == [0, 0, 0]
