import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from umbra.llm import decontaminate, langid, lmscore, queries, tokencount, tokenids, toxicity

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
ODD = [None, "", " ", "\n\n", "a", " a", "a ", "a  b", "a \nb", " x　y", "x\x1c y", "it's don't 12 34567", "é è ñ", "日本語 テスト", "😀😀 x\n😀", "<|endoftext|> x", "word " * 5000, "a\x00b \x00c", "￿"]


def frame(spark, texts, **more):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang_pred string")


# Language


def test_language_accuracy_on_rows_held_out(spark):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.op1_language_id(spark, MIDDLE).collect()
    assert len(rows) == len(langs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in held]) > 0.98


def test_language_counts_against_a_loop():
    """N-gram buckets of a batch are those of its texts one by one; a text's score is the sum over its n-grams."""
    texts = [t or "" for t in ODD]
    b, owner = langid.buckets(texts)
    for i, t in enumerate(texts):
        assert Counter(b[owner == i].tolist()) == Counter(langid.buckets([t])[0].tolist())
    model = langid.Model(["a", "b"], np.random.default_rng(1).normal(size=(1 << langid.BITS, 2)).astype(np.float32))
    whole = model.log_likelihoods(texts)
    for i, t in enumerate(texts):
        np.testing.assert_allclose(whole[i], model.logp.astype(float)[langid.buckets([t])[0]].sum(axis=0), rtol=1e-9, atol=1e-6)


def test_language_without_letters_or_training(spark):
    df = frame(spark, [None, "", "123 --", "the cat", "é"])
    model = langid.fit(spark.createDataFrame([(1, "the cat sat", "en"), (2, "le chat est né", "fr"), (3, None, "de"), (4, "x", None)], "doc_id long, text string, lang string"))
    assert model.langs == ["en", "fr"]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(df, model).collect()}
    assert [got[i] for i in range(3)] == [("und", 0.0)] * 3
    assert got[3][0] == "en"
    assert got[4][0] == "fr"
    assert sorted(r["doc_id"] for r in langid.keep_identified(df, model).collect()) == [3, 4]
    nothing = langid.fit(df.withColumn("lang", df["text"]).limit(0))
    assert {r["lang_pred"] for r in langid.identify(df, nothing).collect()} == {"und"}


# Token ids


@pytest.mark.parametrize("top", [1, 256, 65536, 2**32])
def test_codes_give_any_id_and_any_run(top):
    rng = np.random.default_rng(top % 97)
    for n in (0, 1, 7, 8, 9, 511, 512, 513, 1500):
        ids = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
        reader = tokenids.DacReader(tokenids.dac_encode(ids))
        assert len(reader) == n
        assert (reader.run(0, n) == ids).all()
        assert [reader[i] for i in range(0, n, 13)] == ids[::13].tolist()
        for i, j in np.sort(rng.integers(0, n + 1, (10, 2)), axis=1):
            assert (reader.run(int(i), int(j)) == ids[i:j]).all()
        with pytest.raises(IndexError):
            reader[n]
    with pytest.raises(ValueError, match="not a directly"):
        tokenids.DacReader(b"else")


def test_parts_encode_as_the_whole():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, whole = tokenids.Encoder(path), Tokenizer.from_file(path)
    rng = random.Random(2)
    texts = [t for t in ODD if t is not None] + ["".join(rng.choice(["ab", "Ång", " ", "\n", ".", ",", "'s", "7", "\t", "é", "x-y", "  "]) for _ in range(40)) for _ in range(300)]
    for _ in range(2):
        ids, sizes = encoder.encode(texts)
        want = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
        assert sizes.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]


def check_files(rows, texts):
    """texts: (doc_id, text) in the order of the files."""
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, want = 0, []
    for d, t in texts:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(rows, key=lambda r: r[1]) == want


def test_token_files_round_trip(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [(i * 7 % 19, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame([(*r, 1) for r in texts], "doc_id long, text string, id int").repartition(3)
    tokenids.write_tokens(df, str(tmp_path / "t"), path, block_ids=64)
    check_files([tuple(r) for r in tokenids.read_tokens(spark, str(tmp_path / "t")).collect()], sorted(texts))
    more = spark.createDataFrame([(None, "null id"), (5, "b"), (5, "b"), (5, "a")], "doc_id long, text string")
    tokenids.write_tokens(more, str(tmp_path / "m"), path)
    rows = sorted((tuple(r) for r in tokenids.read_tokens(spark, str(tmp_path / "m")).collect()), key=lambda r: r[1])
    assert [r[0] for r in rows] == [None, 5, 5, 5]
    tokenids.write_tokens(df.limit(0), str(tmp_path / "e"), path)
    assert tokenids.read_tokens(spark, str(tmp_path / "e")).collect() == []


def test_token_query(spark):
    texts = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    check_files([tuple(r) for r in queries.op3_token_ids(spark, SMALL).collect()], texts)


# Toxicity


def test_toxicity_on_texts_held_out():
    rng = random.Random(5)
    plain = ["".join(rng.choice(["an", "er", "the", "on", "ti", "nd"]) for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    bad = ["grimble", "vexatron", "scorn", "blightful"]

    def text(toxic):
        w = [rng.choice(plain) for _ in range(rng.randrange(20, 200))]
        for _ in range(rng.randrange(2, 5) if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(bad)
        return " ".join(w)

    y = [int(rng.random() < 0.2) for _ in range(1200)]
    texts = [text(t) for t in y]
    model = toxicity.train(texts[:900], y[:900])
    p = model.score(texts[900:])
    held = np.array(y[900:])
    assert ((p >= 0.5) == held).mean() > 0.97
    assert ((p >= 0) & (p <= 1)).all()
    assert (model.score([None, "", "123"]) < 0.5).all()


def test_toxicity_query_and_few_labels(spark):
    rows = queries.op4_toxicity(spark, SMALL).collect()
    assert len(rows) == 200
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    docs = frame(spark, ODD)
    for labels in ([], [(1, 1)], [(1, 0), (2, None), (None, 1)], [(3, 1), (3, 0), (11, 0)]):
        model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert toxicity.classify(docs, model).where("score between 0 and 1").count() == len(ODD)


# Language model


def test_word_buckets_do_not_depend_on_their_place():
    a, b = lmscore.buckets("Alfa beta, gamma-7 Ærlig"), lmscore.buckets("x " * 1000 + "alfa BETA gamma 7 ærlig")
    assert a.tolist() == b[-5:].tolist()
    assert [len(lmscore.buckets(t)) for t in (None, "", " .!", "a")] == [0, 0, 0, 1]
    long = "word " * 200_000
    assert set(lmscore.buckets(long).tolist()) == set(lmscore.buckets("word").tolist())
    assert len(lmscore.buckets("a" * (lmscore._PIECE + 5))) <= 2


def test_an_untrained_network_knows_the_counts():
    counts = np.zeros(1 << lmscore.BITS)
    text = "a a a b b c"
    np.add.at(counts, lmscore.buckets(text), 1)
    net = lmscore.Network.fresh(counts)
    words = lmscore.buckets(text)
    tokens = net.token[words]
    share = np.bincount(net.token, weights=counts, minlength=lmscore.VOCABULARY) + 0.5
    want = np.log(share[tokens] / share.sum()).sum()
    assert net.log_likelihoods([words])[0] == pytest.approx(want, rel=1e-4)


def test_training_learns_order(spark):
    rng = random.Random(1)
    follow = {w: rng.sample("abcdefghijklmnop", 2) for w in "abcdefghijklmnop"}

    def walk(n):
        w = [rng.choice("abcdefghijklmnop")]
        while len(w) < n:
            w.append(rng.choice(follow[w[-1]]))
        return " ".join(w)

    docs = spark.createDataFrame([(i, walk(400), None) for i in range(600)], "doc_id long, text string, n_tokens int").repartition(40)
    net = lmscore.fit(docs, rounds=3)
    ordered = walk(400)
    shuffled = ordered.split()
    rng.shuffle(shuffled)
    tests = spark.createDataFrame([(1, ordered), (2, " ".join(shuffled)), (3, None), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lmscore.score(tests, net).collect()}
    assert got[1]["log_likelihood"] > got[2]["log_likelihood"] + 50
    assert (got[3]["n_tokens"], got[3]["log_likelihood"], got[3]["mean_log_likelihood"]) == (0, 0.0, None)
    assert got[4]["n_tokens"] == 0
    empty = lmscore.fit(docs.limit(0))
    assert lmscore.score(tests, empty).count() == 4


# Benchmark


def plain_leaks(docs, items):
    out = set()
    for d, t in docs:
        w = decontaminate.words(t or "")
        for i, x in items:
            q = decontaminate.words(x)
            n = min(5, len(q))
            own = {tuple(q[k : k + n]) for k in range(len(q) - n + 1)}
            span = max(32, 1 << (len(q) - 1).bit_length()) if q else 1
            for at in range(0, max(1, len(w)), span):
                part = w[at : at + 2 * span]
                if own and len(own & {tuple(part[k : k + n]) for k in range(len(part) - n + 1)}) >= 0.8 * len(own):
                    out.add((d, i))
    return out


def test_leaks_against_all_passages(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = [(r["doc_id"], r["item_id"]) for r in queries.op7_decontaminate(spark, SMALL).collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain_leaks(docs, items)
    assert got


def test_leaks_of_odd_items(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    question = " ".join(word() for _ in range(50)) + "? "
    items = [(1, question + "forty two"), (2, "tiny item"), (3, ""), (4, None), (None, "no id here"), (5, " ".join(word() for _ in range(300))), (1, question + "forty two")]
    changed = question.upper().split()
    changed[10] = "other"
    docs = [(1, "x " * 90 + " ".join(changed) + " Forty two y"), (2, question), (3, "a tiny item is here"), (4, None), (5, ""), (6, "p " * 33 + items[5][1]), (7, " ".join(items[5][1].split()[:150])), (8, "clean " * 500)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(df, bench).collect()}
    assert got == {(1, 1), (3, 2), (6, 5)}
    kept = decontaminate.keep_clean(df, bench)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {2, 4, 5, 7, 8}
    assert decontaminate.find_leaks(df, bench.limit(0)).count() == 0


def test_search_finds_all_above_the_threshold():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 30))), "") for i in range(300)]
    index = decontaminate.build_index(rows)
    items = index.classes[0]
    for _ in range(300):
        terms = rng.sample(range(len(index.terms)), rng.randrange(1, 60))
        sums = np.zeros(len(items.ids))
        for t in terms:
            if t in items.lists:
                sums[items.lists[t][0]] += items.lists[t][1]
        got = dict(items.search(sorted(terms)))
        assert set(got) == set(np.flatnonzero(sums >= 1 - 1e-9).tolist())
        assert all(got[i] == pytest.approx(sums[i]) for i in got)


# Token counts


def test_counts_are_those_of_the_unigram_tokenizer(spark):
    vocabulary = tokencount.zipf_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    library = Tokenizer(models.Unigram(vocabulary.pieces, unk_id=vocabulary.unknown, byte_fallback=True))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement=tokencount.SPACE, prepend_scheme="always", split=True)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["n_tokens"] for r in queries.op8_token_counts(spark, SMALL).collect()}
    assert got == {d: len(library.encode(t, add_special_tokens=False).ids) for d, t in texts.items()}
    odd = [*ODD, "▁", "▁a▁b", "<unk>", "x<unk>y é<unk>", "aaaaaaa", "  two"]
    rows = {r["doc_id"]: r["n_tokens"] for r in tokencount.count_tokens(frame(spark, odd), vocabulary).collect()}
    assert rows == {i: len(library.encode(t, add_special_tokens=False).ids) if t else 0 for i, t in enumerate(odd)}


@pytest.mark.parametrize("bytes_too", [False, True])
def test_ties_and_unknown_runs(bytes_too):
    pieces = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("aa", -2.0), ("ab", -2.0), ("▁a", -2.0), ("ba", -1.5), ("bab", -3.0)]
    if bytes_too:
        pieces += [(f"<0x{b:02X}>", -9.0) for b in range(256)]
    library = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=bytes_too))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    counter = tokencount.Counter(tokencount.Vocabulary(pieces, 0, bytes_too))
    rng = random.Random(4)
    for _ in range(500):
        t = "".join(rng.choice("aabbcé ") for _ in range(rng.randrange(1, 14)))
        assert counter.text(t) == len(library.encode(t, add_special_tokens=False).ids), t


def test_words_are_what_the_contracts_say():
    assert re.findall(r"[^\x20\x09-\x0D]+", "a b c\x1cd\n e") == [w.decode() for w in "a b c\x1cd\n e".encode().split()]
