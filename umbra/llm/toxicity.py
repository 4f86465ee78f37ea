"""Toxicity by compression distance: which of two zstandard dictionaries makes a text's windows shorter."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import enter, materialize, small_batches

#: ASCII white space, punctuation and controls part words; bytes of other characters belong to them.
_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LEVEL = 9
#: A window is one word. It is compressed once and written four times over: short words show in the one, in the
#: other what a block costs doesn't hide what the dictionary saves.
REPEATS = (1, 4)


def words(text: str | None) -> list[bytes]:
    return _WORDS.findall(text.encode("utf-8", "replace").lower()) if text else []


def counted(text: str | Counter | None) -> Counter:
    """A text's words with their counts; what is counted already stays as it is."""
    return text if isinstance(text, Counter) else Counter(words(text))


def windows(word: bytes) -> list[bytes]:
    return [(b" " + word) * n for n in REPEATS]


@dataclass
class Model:
    """Content of both dictionaries, two thresholds of a window, and weights: of 1, and of log(1 + n) for the
    windows from either threshold and for all windows."""

    ordinary: bytes
    toxic: bytes
    thresholds: tuple[int, int] = (1, 1)
    weights: np.ndarray = field(default_factory=lambda: np.array([-3.0, 0.0, 0.0, 0.0]))
    #: Bytes that words whose saving is known may take, and what one takes beside its bytes.
    KEPT_BYTES, WORD_BYTES = 64 << 20, 150

    def __post_init__(self) -> None:
        self._pair: tuple | None = None
        self._seen: dict[bytes, int] = {}
        self._held = 0

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_pair", "_seen", "_held")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def saved(self, word: bytes) -> int:
        """Bytes by which the toxic dictionary makes a window shorter than the ordinary one does. The toxic one
        also holds the ordinary one's content, so that what both classes share tells nothing."""
        if (known := self._seen.get(word)) is not None:
            return known
        if self._pair is None:
            self._pair = tuple(_compressor(x) for x in (self.ordinary, self.ordinary + self.toxic))
        if self._held >= self.KEPT_BYTES:
            self._seen.clear()
            self._held = 0
        one, other = self._pair
        self._held += self.WORD_BYTES + len(word)
        self._seen[word] = n = sum(len(one.compress(w)) - len(other.compress(w)) for w in windows(word))
        return n

    MOST = 12

    def histogram(self, text: str | Counter | None) -> np.ndarray:
        """How many windows the toxic dictionary shortens by 0 (or less), 1, ... MOST (or more) bytes."""
        out = np.zeros(self.MOST + 1)
        for w, n in counted(text).items():
            out[min(max(self.saved(w), 0), self.MOST) if self.toxic else 0] += n
        return out

    def features(self, histograms: np.ndarray) -> np.ndarray:
        """log(1 + n) of the windows from either threshold on, and of all windows."""
        low, high = self.thresholds
        return np.log1p(np.column_stack((histograms[:, low:].sum(axis=1), histograms[:, high:].sum(axis=1), histograms.sum(axis=1))))

    def score(self, texts: list[str | Counter | None]) -> np.ndarray:
        if not texts:
            return np.array([])
        f = self.features(np.array([self.histogram(t) for t in texts]))
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + f @ self.weights[1:], -30, 30)))


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if not content:
        return zstandard.ZstdCompressor(level=LEVEL, **plain)
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, **plain)


def _occurrences(texts: Iterable[str | Counter | None], size: int = 16) -> tuple[Counter, int]:
    """In how many texts each beginning of a word occurs, and how many texts count: those that share half of their sketch with an
    earlier one don't, lest copies of a text outvote other texts. One text's set is held at a time."""
    counts, owner, n = Counter(), {}, 0
    for text in texts:
        s = _beginnings(text)
        sketch = sorted(xxhash.xxh64_intdigest(w) for w in s)[:size]
        shared = Counter(owner[h] for h in sketch if h in owner)
        if sketch and shared and shared.most_common(1)[0][1] * 2 >= len(sketch):
            continue
        for h in sketch:
            owner.setdefault(h, n)
        counts.update(s)
        n += 1
    return counts, n


#: Fixed value of the format: the three starting offsets (1, 4, 8) that stand before a dictionary's content.
_OFFSETS = b"\x01\x00\x00\x00\x04\x00\x00\x00\x08\x00\x00\x00"


def _dictionary(counts: Counter, own: list[bytes], size: int, segment: int, copies: int) -> bytes:
    samples = [w * copies for w in sorted(own) for _ in range(min(counts[w], 50))]
    random.Random(7).shuffle(samples)
    try:
        held = zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes() if samples else b""
        return held[held.find(_OFFSETS) + len(_OFFSETS) :]  # entropy tables are of no use for so short windows
    except zstandard.ZstdError:  # too few samples to train on: they are the dictionary themselves
        return b"".join(dict.fromkeys(samples))[-size:]


def _completed(trained: bytes, marks: list[bytes], size: int) -> bytes:
    """A trained dictionary with the marks that training left out before it, the commonest nearest."""
    return b"".join([x for x in marks if x not in trained] + [b" ", trained])[-max(size, len(trained)) :] if marks else trained


def _beginnings(text: str | Counter | None) -> frozenset[bytes]:
    """The text's words, each after a space, and what these begin with, from 5 to 12 bytes."""
    return frozenset(x[:n] for w in counted(text) for x in (b" " + w,) for n in {*range(5, min(12, len(x)) + 1), min(len(x), 40)})


def _marks(one: Counter, n1: int, other: Counter, n0: int, least: int, times: float, deviations: float) -> list[bytes]:
    """What texts of one class hold at least so many times, times as often as the other's, and beyond chance."""
    found = []
    for x, c in one.items():
        c0 = other[x]
        p = (c + c0) / (n1 + n0)
        if c >= least and len(x) >= 4 and (c + 0.5) / n1 >= times * (c0 + 0.5) / max(1, n0) and c / n1 - c0 / max(1, n0) >= deviations * (p * (1 - p) * (1 / n1 + 1 / max(1, n0))) ** 0.5:
            found.append(x)
    # A beginning that nearly always goes on in one way is left to the longer one.
    goes_on = Counter()
    for x in found:
        for n in range(5, len(x)):
            goes_on[x[:n]] = max(goes_on[x[:n]], one[x])
    return [x for x in found if goes_on[x] < 0.9 * one[x]]


def train(texts: list[str | Counter | None], toxic: list[int], ordinary_size: int = 4096, toxic_size: int = 8192, least: int = 4, times: float = 4.0, deviations: float = 5.0, shares: tuple[float, float] = (1.0, 1.0)) -> Model:
    """Dictionaries from two thirds of the texts (by place; or their counted words), thresholds and weights from the rest.

    The toxic dictionary is trained on beginnings of words that toxic texts hold far oftener than ordinary ones;
    the ordinary one on words of ordinary texts. shares are those of ordinary and of toxic rows that were drawn; a row counts
    1 / its share when weights are fitted, so that scores don't depend on how many were.
    """
    fit = [i for i in range(len(texts)) if i % 3]
    (ordinary, n0), (bad, n1) = (_occurrences(texts[i] for i in fit if (toxic[i] == 1) == one) for one in (False, True))
    marks = _marks(bad, n1, ordinary, n0, least, times, deviations) if n1 else []
    marked = set(marks)
    model = Model(
        _dictionary(ordinary, [w for w, c in ordinary.items() if c >= least and w not in marked], ordinary_size, 16, 1),
        _completed(_dictionary(bad, marks, toxic_size, 32, 3), sorted(marks, key=lambda x: (bad[x], x)), toxic_size),
    )
    rest = [i for i in range(len(texts)) if not i % 3]
    y = np.array([float(toxic[i] == 1) for i in rest])
    rows = np.where(y == 1, 1 / shares[1], 1 / shares[0])
    rows /= rows.mean() if len(rows) else 1
    if not len(y) or y.min() == y.max() or not model.toxic:
        some = sum(t == 1 for t in toxic) / shares[1]
        rate = (some + 0.5) / (some + sum(t != 1 for t in toxic) / shares[0] + 1)
        model.weights = np.array([min(-0.01, np.log(rate / (1 - rate))), 0.0, 0.0, 0.0])
        return model
    best = None
    histograms = np.array([model.histogram(texts[i]) for i in rest])
    for pair in ((low, high) for low in range(2, 8) for high in range(low + 1, 12)):
        model.thresholds = pair
        x = model.features(histograms)
        w = _logistic(x, y, rows)
        p = 1 / (1 + np.exp(-(w[0] + x @ w[1:])))
        loss = -np.mean(rows * (y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12)))
        if best is None or loss < best[0] - 1e-9:
            best = (loss, pair, w)
    _, model.thresholds, model.weights = best
    return model


def _logistic(x: np.ndarray, y: np.ndarray, rows: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    a = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (rows * (p - y)) + ridge * w
        hess = (a * (rows * p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", docs_of_label: int = 3000) -> Model:
    """Learn from up to about docs_of_label rows of each label, drawn by a hash of the id, and by one of the text too where ids repeat so
    often that this gives over twice as many.

    An id with several labels counts as toxic if any of them is 1. Texts are read whole, where they lie; what comes to the driver
    is the counted words of at most about 4 x docs_of_label texts. Null texts teach nothing, and neither do null ids; without rows of both labels
    the score is their share.
    """
    rows = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    shares = [min(1.0, docs_of_label / max(1, counts.get(y, 0))) for y in (0, 1)]

    def drawn(of: str, by: list[float], *key: str) -> Column:
        share = F.when(F.col("y") == 1, F.lit(by[1])).otherwise(F.lit(by[0]))
        return F.pmod(F.xxhash64(F.lit(of), *key), F.lit(1 << 30)) < share * (1 << 30)

    picked = materialize(rows.where(drawn("toxicity sample", shares, "id")))  # about 2 x docs_of_label rows, so they are broadcast
    found = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).where("text is not null").join(F.broadcast(picked), "id")
    got = {r["y"]: r["n"] for r in found.groupBy("y").agg(F.count("*").alias("n")).collect()}
    again = [1.0 if got.get(y, 0) <= 2 * docs_of_label else docs_of_label / got[y] for y in (0, 1)]
    if min(again) < 1:
        found = found.where(drawn("repeated ids", again, "id", "text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enter("toxicity")
        for batch in batches:
            own = [Counter(words(t)) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"].astype(str), "y": batch["y"], "words": [b" ".join(c) for c in own], "n": [list(c.values()) for c in own]})

    sample = small_batches(found).select("id", "y", "text").mapInPandas(count, "id string, y int, words binary, n array<int>").toPandas()
    sample = sample.assign(o=[zlib.crc32(i.encode()) for i in sample["id"]]).sort_values(["o", "id", "words"])
    one: dict[bytes, bytes] = {}  # texts share their words' objects
    texts = [Counter({one.setdefault(w, w): int(n) for w, n in zip(own.split(b" "), counts, strict=True)}) if len(counts) else Counter() for own, counts in zip(sample["words"], sample["n"], strict=True)]
    return train(texts, sample["y"].tolist(), shares=tuple(a * b for a, b in zip(shares, again, strict=True)))


def score_column(model: Model, text: Column, docs: DataFrame) -> Column:
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        enter("toxicity")
        return pd.Series(shared.value.score(texts.tolist()))

    return of(text)


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score (0 to 1), predicted (1 from 0.5).

    Null and empty texts score as texts of no window; texts of any length by all of their windows. Rows that repeat an id stay rows; an
    empty table gives none.
    """
    scored = docs.select(docs[id_col].alias(id_col), score_column(model, docs[text_col], docs).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
