import random

import corpus_pipeline
from umbra.llm import similar


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_the_stage_finds_all_copies_of_a_similarity_of_four_fifths(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = []
    for _ in range(40):
        base = [word() for _ in range(rng.randrange(100, 400))]
        for share in (0, 0.004, 0.01, 0.02, 0.03):
            other = [word() if rng.random() < share else w for w in base]
            texts.append(" ".join(other))
    template = [word() for _ in range(60)]
    for _ in range(250):  # most pairs are below the threshold, and many share a key
        other = list(template)
        for k in rng.sample(range(60), rng.randrange(1, 3)):
            other[k] = word()
        texts.append(" ".join(other))
    rng.shuffle(texts)
    sets = [shingles(t) for t in texts]
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] & sets[j] and jaccard(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_tokens int").repartition(5)
    block, similar.BLOCK = similar.BLOCK, 64
    try:
        got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    finally:
        similar.BLOCK = block
    assert got == {i for i in range(len(texts)) if find(i) == i}
