"""Language of whole texts: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import BROADCAST_BYTES, enter, small_batches

#: N-grams have so many characters; their hashes have so many bits.
ORDERS = (1, 2, 3)
BITS = 16

_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_PIECE = 1 << 18  # characters whose n-grams are held at once
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        table = np.zeros(0x110000, bool)
        table[[i for i in range(0x110000) if chr(i).isalpha()]] = True
        _letters.append(table)
    return _letters[0]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")


def _grams(points: np.ndarray, n: int) -> np.ndarray:
    """Hash buckets of all n-grams of a row of code points."""
    m = len(points) - n + 1
    h = np.full(m, n, np.uint32)
    for j in range(n):
        h ^= h >> np.uint32(15)
        h += points[j : m + j].astype(np.uint32)
        h *= _MULTIPLIERS[j]
    h ^= h >> np.uint32(16)
    h *= _MULTIPLIERS[1]
    return h >> np.uint32(32 - BITS)


def buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all n-grams of the texts, in order, and each one's text.

    Runs of what isn't a letter count as one space, and so do a text's ends; n-grams of a space alone are left out.
    """
    points = _points("".join(f" {t} " for t in texts))
    doc = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    letter = _letter_table()[points]
    starts = np.ones(len(points), bool)
    starts[1:] = doc[1:] != doc[:-1]
    keep = letter | starts
    keep[1:] |= letter[:-1]  # the first of a run that isn't letters stands for it
    points, doc, letter = np.where(letter, points, np.uint32(32))[keep], doc[keep], letter[keep]
    found, owner = [], []
    for n in ORDERS:
        m = len(points) - n + 1
        if m <= 0:
            continue
        ok = doc[:m] == doc[n - 1 :]
        if n == 1:
            ok &= letter
        found.append(_grams(points, n)[ok])
        owner.append(doc[:m][ok])
    if not found:
        return np.array([], np.uint32), np.array([], np.int64)
    owners = np.concatenate(owner)
    order = np.argsort(owners, kind="stable") if len(texts) > 1 else slice(None)
    return np.concatenate(found)[order], owners[order]


def long_counts(text: str, piece: int = _PIECE) -> np.ndarray:
    """How often each bucket occurs in a text of any length: the counts of buckets(), piece characters at a time.

    A piece's n-grams that begin in the one before are counted with it: the last code points are carried over, and so is whether
    the last character was a letter, which says if a run of others has begun.
    """
    total = np.zeros(1 << BITS, np.int64)
    carried, inside = np.zeros(0, np.uint32), True
    for k in range(0, len(text) + 2, piece):
        points = _points(" " * (k == 0) + text[max(0, k - 1) : k - 1 + piece] + " " * (k + piece >= len(text) + 2))
        letter = _letter_table()[points]
        keep = letter.copy()
        keep[0] |= inside
        keep[1:] |= letter[:-1]
        inside = bool(letter[-1])
        points = np.concatenate((carried, np.where(letter, points, np.uint32(32))[keep]))
        for n in ORDERS:
            first = max(0, len(carried) - n + 1)
            if len(points) - n + 1 > first:
                own = _grams(points[first:], n)
                total += np.bincount(own[points[first:] != 32] if n == 1 else own, minlength=1 << BITS)
        carried = points[len(points) - min(len(points), max(ORDERS) - 1) :]
    return total


def _counts(texts: list[str]) -> np.ndarray:
    """How often each bucket occurs in the texts together."""
    total = np.zeros(1 << BITS, np.int64)
    for _, some in _pieces(texts):
        total += long_counts(some[0]) if len(some) == 1 else np.bincount(buckets(some)[0], minlength=1 << BITS)
    return total


def _pieces(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of bounded size, with the first one's number."""
    first = size = 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > _PIECE:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, texts[first:]


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # buckets x languages, float32

    def log_likelihoods(self, texts: list[str]) -> np.ndarray:
        """Texts x languages. Each text's n-grams are the non-zeros of a sparse row; the product adds up their rows of logp."""
        out = np.zeros((len(texts), len(self.langs)))
        for first, some in _pieces(texts):
            if len(some) == 1 and len(some[0]) > _PIECE:
                counts = long_counts(some[0])
                b = np.flatnonzero(counts)
                out[first] = counts[b] @ self.logp[b].astype(np.float64)
                continue
            b, owner = buckets(some)
            if len(b):
                at = np.flatnonzero(np.diff(owner, prepend=-1))
                for lang in range(len(self.langs)):
                    out[first + owner[at], lang] = np.add.reduceat(self.logp[:, lang].astype(np.float64)[b], at)
        return out

    def best(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text the place of its likeliest language (the first of equal ones; -1 without a letter or a language), that
        one's log-likelihood, and the sum of all languages' likelihoods as a multiple of its."""
        known = [t or "" for t in texts]
        has = np.array([any(map(str.isalpha, t)) for t in known], bool) if self.langs else np.zeros(len(known), bool)
        if not has.any():
            return np.full(len(known), -1), np.zeros(len(known)), np.ones(len(known))
        ll = self.log_likelihoods(known)
        top = ll.max(axis=1)
        return np.where(has, ll.argmax(axis=1), -1), top, np.exp(ll - top[:, None]).sum(axis=1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language (the first by name of equal ones) and its posterior at equal priors; und and 0 without a letter."""
        place, _, mass = self.best(texts)
        return [self.langs[k] if k >= 0 else "und" for k in place], np.where(place >= 0, 1 / mass, 0.0)

    def blocks(self, most: int = BROADCAST_BYTES) -> list[Model]:
        """The same languages as models of at most so many bytes each."""
        n = max(1, most // (4 << BITS))
        return [Model(self.langs[k : k + n], self.logp[:, k : k + n]) for k in range(0, max(1, len(self.langs)), n)]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = 2000, smoothing: float = 0.5, max_languages: int = 4096) -> Model:
    """Learn from rows with text and language: all of a language with up to docs_per_language of them, else a
    sample of about so many, drawn by a hash of id and text. A column of more than max_languages values teaches the commonest
    (of equally common ones the first by name). The driver holds a row per language, and 256 KB of model a language. Repeated rows
    count as often as they come; an empty table gives a model without languages, which finds all texts und.
    """
    spark = small_batches(docs).sparkSession
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[lang_col].cast("string").alias("lang")).where("text is not null and lang is not null")
    common = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(max_languages)
    counts = {r["lang"]: r["n"] for r in common.collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((1 << BITS, 0), np.float32))
    shares = spark.createDataFrame([(lang, k, min(1.0, docs_per_language / counts[lang])) for k, lang in enumerate(langs)], "lang string, k int, share double")
    drawn = F.pmod(F.xxhash64(F.lit("language sample"), "id", "text"), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    sample = rows.join(F.broadcast(shares), "lang").where(drawn).select("text", "k")  # at most max_languages rows

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enter("language")
        for batch in batches:
            for k, own in batch.groupby("k")["text"]:
                total = _counts(own.tolist())
                b = np.flatnonzero(total)
                yield pd.DataFrame({"k": np.full(len(b), k), "bucket": b, "n": total[b]})

    found = sample.mapInPandas(count, "k int, bucket int, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toPandas()
    logp = np.full((1 << BITS, len(langs)), smoothing, np.float32)
    logp[found["bucket"], found["k"]] += found["n"]
    for k in range(len(langs)):
        own = logp[:, k].astype(np.float64)
        logp[:, k] = np.log(own / own.sum())
    return Model(langs, logp)


def predict_column(model: Model, text: Column, docs: DataFrame, most: int = BROADCAST_BYTES) -> Column:
    """struct(lang, score) of each text. A model of over `most` bytes is broadcast and scored in blocks of languages, whose
    likeliest ones are compared."""
    spark = small_batches(docs).sparkSession

    def of(block: Model) -> Column:
        shared = spark.sparkContext.broadcast(block)

        @F.pandas_udf("lang string, top double, mass double")
        def best(texts: pd.Series) -> pd.DataFrame:
            enter("language")
            place, top, mass = shared.value.best(texts.tolist())
            return pd.DataFrame({"lang": [shared.value.langs[k] if k >= 0 else None for k in place], "top": top, "mass": mass})

        return best(text)

    def both(a: Column, b: Column) -> Column:
        first = a["top"] >= b["top"]
        high = F.greatest(a["top"], b["top"])
        mass = a["mass"] * F.exp(a["top"] - high) + b["mass"] * F.exp(b["top"] - high)
        return F.struct(F.when(first, a["lang"]).otherwise(b["lang"]).alias("lang"), high.alias("top"), mass.alias("mass"))

    parts = [of(b) for b in model.blocks(most)]
    found = parts[0] if len(parts) == 1 else F.aggregate(F.array(*parts[1:]), parts[0], both)
    return F.transform(F.array(found), lambda x: F.struct(F.coalesce(x["lang"], F.lit("und")).alias("lang"), F.when(x["lang"].isNull(), 0.0).otherwise(1 / x["mass"]).alias("score")))[0]


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, lang_pred, score.

    Null texts and texts without a letter are und with score 0. Texts of any length are scored by all of their n-grams. Rows that
    repeat an id stay rows; an empty table gives none.
    """
    return docs.select(docs[id_col].alias(id_col), predict_column(model, docs[text_col], docs).alias("p")).select(id_col, F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """docs without the rows that are und or whose language has a posterior under least; columns as they are. Null texts go."""
    p = predict_column(model, docs[text_col], docs)
    return docs.where((p["lang"] != "und") & (p["score"] >= least))
