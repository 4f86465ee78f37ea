import zlib
from collections import Counter, defaultdict
from math import exp, log

from umbra.llm import langid, queries

SMALL = "/root/testdata/sf0.001"


def test_language_query_against_counts(spark):
    """Counts of n-grams by language in dictionaries, and each text's sum of smoothed log-shares, one n-gram at a time."""
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang").collect()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows}
    grams = {r["doc_id"]: Counter(langid.buckets([r["text"] or ""])[0].tolist()) for r in rows}
    counts = defaultdict(Counter)
    for r in rows:
        if not held[r["doc_id"]] and r["text"] is not None and r["lang"] is not None:
            counts[r["lang"]].update(grams[r["doc_id"]])
    sums = {lang: sum(c.values()) + 0.5 * (1 << langid.BITS) for lang, c in counts.items()}
    got = {r["doc_id"]: r for r in queries.op1_language_id(spark, SMALL).collect()}
    assert got.keys() == held.keys()
    for r in rows:
        own = grams[r["doc_id"]]
        if not any(map(str.isalpha, r["text"] or "")):
            want, score = "und", 0.0
        else:
            of = {lang: sum(n * log((counts[lang][b] + 0.5) / sums[lang]) for b, n in own.items()) for lang in sorted(counts)}
            want = max(of, key=of.get)
            score = 1 / sum(exp(x - of[want]) for x in of.values())
        found = got[r["doc_id"]]
        assert (found["held_out"], found["lang_pred"]) == (held[r["doc_id"]], want)
        assert abs(found["score"] - score) < 1e-3
