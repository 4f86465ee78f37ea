import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from umbra.llm import embeddings, linededup, queries, simhash
from umbra.llm.components import connected_components

SMALL = "/root/testdata/sf0.001"


class Forest:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components_against_a_forest(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(500, 560)] + [(700, 700 + i) for i in range(50)] + [(3, 3), (None, 4)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    forest = Forest()
    for a, b in edges:
        if a is not None and b is not None:
            forest.join(a, b)
    assert got == {x: forest.find(x) for x in forest.up if forest.find(x) != x}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_fingerprint(text, words):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    runs = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows, words, radius=4):
    """Component by id from all pairs of rows (id, text); null ids take part without naming one."""
    fps = [plain_fingerprint(t, words) for _, t in rows]
    forest = Forest()
    for i in range(len(rows)):
        forest.find(i)
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                forest.join(i, j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = forest.find(i)
            least[r] = min(least.get(r, d), d)
    return sorted((d, f"{fps[i]:016x}", least.get(forest.find(i))) for i, (d, _) in enumerate(rows) if d is not None)


def texts_with_copies(rng):
    words = ["alfa", "beta", "Gamma", "delta", "eta", "Ære", "zeta", "iota"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(40):
        t = rng.choice(base).split()
        if rng.random() < 0.6:
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((100 + i, "  ".join(t)))
    return rows + [(200, None), (201, ""), (202, " \t\n"), (203, "one two"), (204, "ONE two"), (204, "ONE two"), (None, "one two"), (205, "ord " * 3000)]


@pytest.mark.parametrize("words", [4, 5])
def test_simhash_against_all_pairs(spark, words):
    rows = texts_with_copies(random.Random(words))
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, fp string, id int")
    got = simhash.near_duplicates(df, words=words).where("doc_id is not null").collect()
    assert sorted(tuple(r) for r in got) == plain_groups(rows, words)
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def test_simhash_query_against_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in queries.op10_simhash_near_dedup(spark, SMALL).collect()) == plain_groups(rows, 4)


def test_balls_of_close_fingerprints_are_cut_without_loss(spark):
    """Many fingerprints in one ball, and so few variants a task that hot keys are cut by their next bits."""
    rng = random.Random(9)
    fps = {0}
    while len(fps) < 120:
        fps.add(sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 4))))
    far = {rng.getrandbits(64) for _ in range(50)}
    rows = [(int(np.uint64(x).view(np.int64)), i) for i, x in enumerate(sorted(fps | far))]
    df = spark.createDataFrame(rows, "fp long, rep long")
    got = {r["node"]: r["component"] for r in connected_components(simhash.ball_links(df, most=3000)).collect()}
    forest = Forest()
    for a, i in rows:
        forest.find(i)
        for b, j in rows[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
                forest.join(i, j)
    assert got == {i: forest.find(i) for _, i in rows if forest.find(i) != i}
    with pytest.raises(ValueError, match="even"):
        simhash.ball_links(df, radius=3)


def test_one_document_of_each_group_stays(spark):
    rows = [(1, "a b c d e f"), (2, "A b  c d e f"), (3, "entirely other words stand here now"), (None, "a b c d e f")]
    df = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, gone string")
    kept = simhash.keep_one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3]


def brute_vectors(rows, threshold=0.93):
    links, forest = {i: 0 for i in range(len(rows))}, Forest()
    for i, (_, v, label) in enumerate(rows):
        forest.find(i)
        for j in range(i):
            w, other = rows[j][1:]
            if label is None or label != other or not (ok(v) and ok(w)) or len(v) != len(w):
                continue
            a, b = np.array(v, float), np.array(w, float)
            if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                links[i] += 1
                links[j] += 1
                forest.join(i, j)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        least[forest.find(i)] = min(least.get(forest.find(i), d), d)
    return sorted((d, links[i], least[forest.find(i)], least[forest.find(i)] == d) for i, (d, _, _) in enumerate(rows))


def ok(v):
    return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows, k = [], 0
    for c in range(12):
        centre = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 60 if c == 0 else 12))):
            rows.append((k, (centre + rng.normal(scale=0.12, size=16)).astype(np.float32).tolist(), int(c % 2)))
            k += 1
    rows += [(900 + i, rows[0][1], 0) for i in range(5)] + [(905, [2 * x for x in rows[0][1]], 0), (906, rows[0][1], None), (907, rows[0][1], 1)]
    rows += [(910, None, 0), (911, [], 0), (912, [0.0] * 16, 0), (913, [float("nan")] * 16, 0), (914, [float("inf")] + [0.0] * 15, 0), (915, [None] + [1.0] * 15, 0), (916, rows[0][1][:8], 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, cid string")
    assert sorted(tuple(r) for r in embeddings.near_duplicates(df).collect()) == brute_vectors(rows)
    assert embeddings.near_duplicates(df.limit(0)).collect() == []


def test_embedding_recall_on_many_neighbours(spark):
    """A third of all vectors in one place, cut into blocks, and neighbours near the threshold elsewhere."""
    rng = np.random.default_rng(6)
    hot = rng.normal(size=32)
    rows = [(i, (hot + rng.normal(scale=0.05, size=32)).tolist(), 0) for i in range(700)]
    for i in range(700):
        v = rng.normal(size=32)
        rows += [(1000 + 2 * i, v.tolist(), 0), (1001 + 2 * i, (v + rng.normal(scale=0.25, size=32)).tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(df).collect()}
    x = np.array([np.array(r[1], np.float32) for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.93).sum(axis=1) - 1
    assert sum(got.values()) <= want.sum()
    assert sum(got.values()) >= 0.99 * want.sum()
    assert sum(got[r[0]] for r in rows[700:]) >= 0.9 * want[700:].sum()


def passage(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(n))


def test_chunks_slice_and_shift():
    rng = random.Random(8)
    shared = passage(rng, 200)
    sets = []
    for _ in range(2):
        data = f"{passage(rng, rng.randrange(5, 60))}\n{shared}\n{passage(rng, 30)}".encode()
        a, b, fp = linededup.chunks(data)
        assert all(x < y for x, y in zip(a, b, strict=True))
        assert all(x <= y for x, y in zip(b[:-1], a[1:], strict=True))
        sets.append({int(f): data[x:y] for x, y, f in zip(a, b, fp, strict=True)})
    both = sets[0].keys() & sets[1].keys()
    assert all(sets[0][f] == sets[1][f] for f in both)
    assert sum(len(sets[0][f]) for f in both) > 0.5 * len(shared)
    paragraphs = b"One two three.\nFour five, six seven eight nine ten eleven, twelve thirteen. Fourteen fifteen extra\nsixteen"
    text = np.frombuffer(paragraphs, np.uint8)
    at = np.array([(m.start(), m.end()) for m in re.finditer(rb"\S+", paragraphs)])
    assert linededup._last_words(text, at[:, 0], at[:, 1], np.ones(len(at), np.uint64)).tolist() == [2, 4, 10, 12, 15, 16]
    for data in (b"", b" \n ", b"a", b"a b c"):
        assert [len(x) for x in linededup.chunks(data)] == [0, 0, 0]


def plain_repeats(rows):
    """Bytes of each document that a repeat covers, from its chunks by a dictionary and its surroundings word by word."""
    seen, gone = {}, {}
    words = lambda data: [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    for d, t in sorted({r for r in rows if r[1] is not None}, key=lambda r: r[0]):
        data = t.encode()
        for a, b, _ in zip(*(x.tolist() for x in linededup.chunks(data)), strict=True):
            if data[a:b] not in seen:
                seen[data[a:b]] = (data, a, b)
                continue
            other, c, e = seen[data[a:b]]
            n = len(data[a:b].split())
            x, y = a, b
            for p, q in reversed([w for w in words(data) if w[1] <= a]):
                k = a - p
                if k > linededup.CONTEXT or c < k or other[c - k : c] != data[p:a] or (c > k and other[c - k - 1 : c - k].strip()):
                    break
                x, n = p, n + 1
            for p, q in [w for w in words(data) if w[0] >= b]:
                k = q - b
                if k > linededup.CONTEXT or other[e : e + k] != data[b:q] or other[e + k : e + k + 1].strip():
                    break
                y, n = q, n + 1
            if n >= linededup.LEAST_WORDS:
                gone.setdefault(d, set()).update(range(x, y))
    return gone


def test_line_dedup_against_a_dictionary(spark):
    rng = random.Random(3)
    shared = passage(rng, 60)
    rows = [(i, f"{passage(rng, 40)}\n{shared} {passage(rng, 20)}" if i % 3 == 0 else passage(rng, 80)) for i in range(30)]
    rows += [(40, rows[1][1]), (41, None), (42, ""), (43, "short"), (1, rows[1][1]), (44, passage(rng, 5000) + " æøå")]
    df = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], "doc_id long, text string, fp string, start int")
    gone = plain_repeats(rows)
    texts = {d: (t or "").encode() for d, t in rows}
    got = {}
    for r in linededup.spans(df).collect():
        spans = [tuple(x) for x in r["removed"]]
        got[r["doc_id"]] = {i for a, b, _ in spans for i in range(a, b)}
        assert r["n_removed"] == len(spans)
        assert r["removed_bytes"] == sum(b - a for a, b, _ in spans) == len(got[r["doc_id"]])
        assert all(texts[r["doc_id"]][a:b] in texts[first] for a, b, first in spans)
    assert got == {d: gone.get(d, set()) for d, _ in rows}
    assert all(len(got[i]) >= 0.9 * len(shared) for i in range(3, 30, 3))
    assert not any(got[i] for i in range(30) if i % 3)
    cut = linededup.remove_repeats(df)
    assert cut.columns == df.columns
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert texts[0] == rows[0][1]
    assert texts[41] is None
    assert len(texts[3]) < len(rows[3][1])
    assert texts[44].endswith("æøå")
    assert linededup.spans(df.limit(0)).collect() == []


def test_repeated_runs_of_lines_go(spark):
    """Of passages of several lines that stand in two documents, nine tenths of the bytes go, against equal lines by brute force."""
    rng = random.Random(11)
    shares = {}
    for lines, length in ((6, 6), (6, 12), (12, 12)):
        rows, want = [], 0
        for i in range(60):
            own = "\n".join(passage(rng, length) for _ in range(lines))
            want += len(own)
            for k in range(2):
                rows.append((1000 * k + i, "\n".join([*(passage(rng, rng.randrange(4, 20)) for _ in range(6)), own, *(passage(rng, 9) for _ in range(5))])))
        got = linededup.spans(spark.createDataFrame(rows, "doc_id long, text string")).agg(F.sum("removed_bytes")).first()[0]
        shares[lines, length] = got / want
    assert shares[6, 6] >= 0.8
    assert shares[6, 12] >= 0.9
    assert shares[12, 12] >= 0.95


def test_line_dedup_query(spark):
    rows = queries.op5_line_dedup(spark, SMALL).collect()
    assert len(rows) == 200
    texts = {r["doc_id"]: r["text"].encode() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in rows:
        for a, b, first in r["removed"]:
            assert texts[r["doc_id"]][a:b] in texts[first]


def test_hex_of_fingerprints(spark):
    r = simhash.near_duplicates(spark.createDataFrame([(1, "")], "doc_id long, text string")).select(F.col("fingerprint")).first()
    assert r[0] == "0" * 16
