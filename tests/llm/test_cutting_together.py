import random
import time

import pyarrow as pa

from umbra.llm import linededup


def odd_texts(rng, n):
    parts = ["a", "bc", "æ", " ", " ", "  ", "\n", "\n\n", "\t", ".", ", ", "x. ", "\r\n", "\x0b", "\x85"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 5, 20, 60, 400]))) for _ in range(n)]
    return [*texts, "", "seven words are too few to count", "word " * 2 * linededup.TOGETHER, "", "\n"]


def test_texts_cut_together_give_the_chunks_of_each():
    texts = odd_texts(random.Random(2), 400)
    column = pa.concat_arrays([pa.array(["of another row"]), pa.array(texts)]).slice(1)
    met = 0
    for i, data, bounds in linededup._together(column):
        a, b, fp, of, words = linededup._cut(data, bounds)
        for k in range(len(bounds) - 1):
            assert data[bounds[k] : bounds[k + 1]].tobytes() == texts[i + k].encode()
            own = of == k
            for x, y in zip((a[own] - bounds[k], b[own] - bounds[k], fp[own]), linededup.chunks(texts[i + k].encode()), strict=True):
                assert x.tolist() == y.tolist()
            assert words[own].tolist() == [len(data[x:y].tobytes().split()) for x, y in zip(a[own], b[own], strict=True)]
        met += len(bounds) - 1
    assert met == len(texts)


def test_cutting_short_texts_together_takes_half_the_time_of_each_alone():
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcdef") for _ in range(5)) + rng.choice(["", "", "", ".", "\n"]) for _ in range(80)) for _ in range(2000)]
    column = pa.array(texts)

    def seconds(f):
        taken = []
        for _ in range(3):
            begun = time.process_time()
            f()
            taken.append(time.process_time() - begun)
        return min(taken)

    alone = seconds(lambda: [linededup.chunks(t.encode()) for t in texts])
    assert seconds(lambda: [linededup._cut(data, bounds) for _, data, bounds in linededup._together(column)]) < 0.5 * alone


def test_equal_surroundings_against_words_one_by_one():
    rng = random.Random(5)
    piece = lambda n: bytes(rng.choice(b"ab  \n\t\xc3") for _ in range(n))
    pairs = [(b"", b""), (b"ab", b""), (b"ab cd", b"ab ce"), (b"ab cd", b"ab cde"), (b"ab cd", b"ab cd ")]
    for _ in range(500):
        shared = piece(rng.choice([0, 1, 5, 40, 190]))
        pairs.append(((shared + piece(rng.randrange(30)))[: linededup.CONTEXT], (shared + piece(rng.randrange(30)))[: linededup.CONTEXT]))

    def plain(x, y):
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        while n and not all(n == len(t) or t[n : n + 1].isspace() for t in (x, y)):
            n -= 1
        return len(x[:n].rstrip()), len(x[:n].split())

    for flip, backwards in ((1, False), (-1, True)):
        x, y = ([p[i][::flip] for p in pairs] for i in (0, 1))
        got = linededup._equal(pa.array(x, pa.binary()), pa.array(y, pa.binary()), backwards)
        assert list(zip(*(c.tolist() for c in got), strict=True)) == [plain(*p) for p in pairs]


def test_shuffle_files_of_a_finished_step_go(spark):
    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for name in (found.apply(i).getName() for i in range(found.size())) if name.startswith("shuffle_")}

    before, held = files(), spark.conf.get(linededup._CLEANUP, None)
    done = linededup._finished(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count())
    until = time.monotonic() + 20
    while files() - before and time.monotonic() < until:
        time.sleep(0.2)
    assert not files() - before
    assert spark.conf.get(linededup._CLEANUP, None) == held
    assert sorted(r["k"] for r in done.collect()) == list(range(7))
