"""Benchmark items in training text: a BM25 index of the items, searched by block-max WAND for every passage."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import enter, materialize, small_batches

_WORDS = re.compile(r"\w+")
_END = re.compile(r"(?<=[.!?])\s+|\n+")
#: BM25's usual constants, words of a shingle, and the share of an item's shingles that a leak holds.
K1, B, SHINGLE, OVERLAP = 1.2, 0.75, 5, 0.8
#: The share of an answer's words that a leak holds; answers are often shorter than a shingle.
ANSWER = 0.5
#: Items of an index; text of its items. A benchmark beyond that is cut into several indexes, each searched for all passages.
SHARD_ITEMS, SHARD_BYTES = 4096, 8 << 20
_PIECE = 1 << 18  # characters of text that are looked at together

LEAK = "array<struct<item_id: long, at: long, score: double, question_overlap: double, answer_overlap: double>>"


def words(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of an item that is one text: its last sentence or line is the answer, if there is another."""
    parts = [p for p in _END.split(text) if _WORDS.search(p)]
    return (text[: text.rindex(parts[-1])], parts[-1]) if len(parts) > 1 else (text, "")


def shingles(ids: np.ndarray) -> set[bytes]:
    """Runs of SHINGLE words; fewer words are one run."""
    ids = np.ascontiguousarray(ids, np.int32)
    n = min(SHINGLE, len(ids))
    return {ids[i : i + n].tobytes() for i in range(len(ids) - n + 1)} if n else set()


@dataclass
class Items:
    """An index over items of at most `longest` words. Impacts are BM25 scores as shares of what an item's leak scores at
    least, so that 1 is every item's threshold: a passage that holds OVERLAP of an item's shingles lacks no more words than
    the other shingles have beginnings, and these at most the words of the greatest impact."""

    longest: int
    ids: list[int]
    texts: list[np.ndarray]
    answers: list[int]  # words of the answer, the item's last
    apart: bool = True  # question and answer were given apart, so the question has a threshold of its own
    lists: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)  # term -> items, impacts
    top: np.ndarray = field(default_factory=lambda: np.zeros(0))  # term -> its greatest impact
    block: int = 8
    block_top: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # term, block of items -> greatest impact there
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))  # item -> score that counts as 1

    def build(self, terms: int, idf: np.ndarray, mean: float) -> None:
        n = len(self.ids)
        self.block = max(8, -(-n // 64))
        self.top = np.zeros(terms)
        self.block_top = np.zeros((terms, -(-n // self.block)), np.float32)
        self.scale = np.zeros(n)
        posting: dict[int, list[tuple[int, float]]] = {}
        for i, text in enumerate(self.texts):
            mass = {t: idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * len(text) / mean)) for t, f in Counter(text.tolist()).items()}
            lost = math.floor((1 - OVERLAP) * len(shingles(text)) + 1e-9)
            self.scale[i] = sum(sorted(mass.values())[: len(mass) - lost]) or sum(mass.values())
            for t, x in mass.items():
                posting.setdefault(t, []).append((i, x / self.scale[i]))
        for t, found in posting.items():
            items, impacts = np.array([i for i, _ in found]), np.array([x for _, x in found])
            self.lists[t] = (items, impacts)
            self.top[t] = impacts.max()
            np.maximum.at(self.block_top[t], items // self.block, np.nextafter(impacts.astype(np.float32), np.float32(2)))

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """All items with a score of 1 or more for the terms, by block-max WAND."""
        lists = [[0, *self.lists[t], t] for t in terms if t in self.lists]
        found = []
        low = 1 - 1e-9
        while True:
            lists = [x for x in lists if x[0] < len(x[1])]
            lists.sort(key=lambda x: x[1][x[0]])
            bound, pivot = 0.0, -1
            for k, x in enumerate(lists):
                bound += self.top[x[3]]
                if bound >= low:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = lists[pivot][1][lists[pivot][0]]
            while pivot + 1 < len(lists) and lists[pivot + 1][1][lists[pivot + 1][0]] == item:
                pivot += 1
            block = item // self.block
            if sum(float(self.block_top[x[3], block]) for x in lists[: pivot + 1]) < low:
                after = (block + 1) * self.block
                if pivot + 1 < len(lists):
                    after = min(after, lists[pivot + 1][1][lists[pivot + 1][0]])
                for x in lists[: pivot + 1]:
                    x[0] = int(np.searchsorted(x[1], after))
            elif lists[0][1][lists[0][0]] == item:
                score = sum(x[2][x[0]] for x in lists[: pivot + 1])
                if score >= low:
                    found.append((int(item), float(score)))
                for x in lists[: pivot + 1]:
                    x[0] += 1
            else:
                for x in lists[:pivot]:
                    x[0] = int(np.searchsorted(x[1], item))


@dataclass
class Index:
    terms: dict[str, int]
    classes: list[Items]

    def leaks(self, texts: list[str | None]) -> list[list[dict]]:
        """For each text the items that it holds, each with its best passage."""
        out: list[list[dict]] = []
        for some in _pieces(texts):
            ids = [np.fromiter((self.terms.get(w, -1) for w in words(t)), np.int32) if t else np.zeros(0, np.int32) for t in some]
            best: list[dict[int, dict]] = [{} for _ in some]
            for items in self.classes:
                for doc, at, passage in _passages(items, ids):
                    self._verify(items, ids[doc], at, passage, best[doc])
            out += [sorted(b.values(), key=lambda x: (x["item_id"], x["at"])) for b in best]
        return out

    def _verify(self, items: Items, ids: np.ndarray, at: int, passage: np.ndarray, best: dict[int, dict]) -> None:
        runs: dict[int, set[bytes]] = {}
        for i, score in items.search(np.unique(passage[passage >= 0]).tolist()):
            text, n = items.texts[i], items.answers[i]

            def held(part: np.ndarray) -> float:
                own = shingles(part)
                size = min(SHINGLE, len(part))
                if size not in runs:
                    runs[size] = {passage[k : k + size].tobytes() for k in range(len(passage) - size + 1)}
                return len(own & runs[size]) / len(own) if own else 1.0

            if held(text) < OVERLAP:
                continue
            question = held(text[: len(text) - n])
            answer = len(np.intersect1d(text[len(text) - n :], passage)) / len(np.unique(text[len(text) - n :])) if n else 1.0
            key = items.ids[i]
            if (question >= OVERLAP or not items.apart) and answer >= ANSWER and (key not in best or score * items.scale[i] > best[key]["score"] * (1 + 1e-9)):  # sums differ in their last digits by order
                best[key] = {"item_id": key, "at": at, "score": score * items.scale[i], "question_overlap": question, "answer_overlap": answer}


def _pieces(texts: list[str | None]) -> Iterator[list[str | None]]:
    some: list[str | None] = []
    size = 0
    for t in texts:
        if some and size + len(t or "") > _PIECE:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t or "")
    if some:
        yield some


def _passages(items: Items, ids: list[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray]]:
    """The passages of all texts in which an item may reach the threshold: document, first word, terms.

    A passage is two chunks of items.longest words in a row, so that each run of an item's length lies in one.
    A passage has no pivot if no block's greatest impacts of its terms add up to 1; those are summed by chunk for all passages at once.
    """
    step = items.longest
    lengths = np.array([len(x) for x in ids])
    chunks = -(-lengths // step)
    if not chunks.sum():
        return
    first = np.cumsum(chunks) - chunks
    terms = np.concatenate(ids).astype(np.int64)
    place = np.concatenate([np.arange(n) for n in lengths]) // step + np.repeat(first, lengths)
    known = (terms >= 0) & (items.top[terms] > 0)
    pairs = np.unique(place[known] * len(items.top) + terms[known])
    sums = np.zeros((chunks.sum() + 1, items.block_top.shape[1]), np.float32)
    if len(pairs):
        own = pairs // len(items.top)
        at = np.flatnonzero(np.diff(own, prepend=-1))
        sums[own[at]] = np.add.reduceat(items.block_top[pairs % len(items.top)], at, axis=0)
    inner = np.ones(len(sums) - 1, bool)
    inner[np.cumsum(chunks)[chunks > 0] - 1] = False  # a text's last chunk has none after it
    bound = sums[:-1] + np.where(inner[:, None], sums[1:], 0)
    doc_of = np.repeat(np.arange(len(ids)), chunks)
    for c in np.flatnonzero((bound >= 0.999).any(axis=1)):
        doc = int(doc_of[c])
        at = int(c - first[doc]) * step
        yield doc, at, ids[doc][at : at + 2 * step]


@dataclass
class Statistics:
    """Of a whole benchmark: its items with a word, the mean of their words, and in how many of them each word occurs (at least
    the words of the items that are to be indexed)."""

    items: int
    mean: float
    seen: dict[str, int]


def _with_words(rows: list[tuple[int, str, str]]) -> list[tuple[int, list[str], list[str]]]:
    found = [(i, words(q), words(a)) for i, q, a in rows]
    return [x for x in found if x[1] or x[2]]


def statistics(rows: list[tuple[int, str, str]]) -> Statistics:
    split = _with_words(rows)
    return Statistics(len(split), sum(len(q) + len(a) for _, q, a in split) / max(1, len(split)), Counter(w for _, q, a in split for w in {*q, *a}))


def build_index(rows: list[tuple[int, str, str]], apart: bool = True, known: Statistics | None = None) -> Index:
    """rows of (id, question, answer), given apart or split by us; items without a word are left out. known: of the whole
    benchmark, if rows are a part of it, so that scores don't depend on how it is cut."""
    split = _with_words(rows)
    known = known or statistics(rows)
    terms = {w: k for k, w in enumerate(sorted({w for _, q, a in split for w in (*q, *a)}))}
    idf = np.array([math.log(1 + (known.items - known.seen[w] + 0.5) / (known.seen[w] + 0.5)) for w in terms])
    by: dict[int, Items] = {}
    for i, q, a in sorted(split):
        longest = max(32, 1 << (len(q) + len(a) - 1).bit_length())
        items = by.setdefault(longest, Items(longest, [], [], [], apart))
        items.ids.append(i)
        items.texts.append(np.array([terms[w] for w in [*q, *a]], np.int32))
        items.answers.append(len(a))
    for items in by.values():
        items.build(len(terms), idf, known.mean)
    return Index(terms, [by[k] for k in sorted(by)])


def indexes(
    benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", question_col: str | None = None, answer_col: str | None = None, shard_items: int = SHARD_ITEMS, shard_bytes: int = SHARD_BYTES
) -> Iterator[Index]:
    """Indexes of all items, each of a bounded part: the parts are told apart by a hash, and one at a time is on the driver.

    Items come as one text, or as question and answer. Items without an id, a text or a word can't be found; equal items count
    once. Frequencies of words and the mean of items' words are those of the whole benchmark, so that scores are the same however many parts there are.
    """
    empty = F.lit("")
    question = benchmark[question_col] if question_col else benchmark[text_col]
    rows = benchmark.select(benchmark[id_col].cast("long").alias("id"), F.coalesce(question, empty).alias("q"), F.coalesce(benchmark[answer_col], empty).alias("a") if answer_col else empty.alias("a")).where("id is not null and (q <> '' or a <> '')").distinct()
    n, size = rows.agg(F.count("*"), F.sum(F.octet_length("q") + F.octet_length("a"))).first()
    parts = max(1, -(-n // shard_items), -(-(size or 0) // shard_bytes))

    def split(found: list) -> list[tuple[int, str, str]]:
        return [(r["id"], *(split_item(r["q"]) if not answer_col else (r["q"], r["a"]))) for r in found]

    if parts == 1:
        index = build_index(split(rows.collect()), bool(answer_col))
        yield from [index] if index.terms else []
        return
    rows = materialize(rows.withColumn("part", F.pmod(F.xxhash64("id", "q", "a"), F.lit(parts))))

    def words_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, q, a in zip(batch["part"], batch["q"], batch["a"], strict=True):
                own = [*words(q), *words(a)]
                yield pd.DataFrame({"part": part, "word": sorted(set(own)), "n": len(own)})

    held = materialize(rows.select("part", "q", "a").mapInPandas(words_of, "part long, word string, n long").groupBy("part", "word").agg(F.count("*").alias("items")))
    lengths = rows.select("part", "q", "a").mapInPandas(lambda batches: (pd.DataFrame({"n": [len(words(q)) + len(words(a)) for q, a in zip(x["q"], x["a"], strict=True)]}) for x in batches), "n long")
    items, mean = lengths.where("n > 0").agg(F.count("*"), F.avg("n")).first()
    seen = materialize(held.groupBy("word").agg(F.sum("items").alias("items")))
    for k in range(parts):
        own = held.where(F.col("part") == k).select("word").join(seen, "word").collect()
        index = build_index(split(rows.where(F.col("part") == k).collect()), bool(answer_col), Statistics(items, mean or 0.0, {r["word"]: r["items"] for r in own}))
        if index.terms:
            yield index


def leaks_column(found: Iterable[Index], text: Column, docs: DataFrame) -> Column:
    """Leaked items of each text. Each index is broadcast as it comes and not kept here; all look at a text in one pass."""

    def of(index: Index) -> Column:
        shared = small_batches(docs).sparkSession.sparkContext.broadcast(index)

        @F.pandas_udf(LEAK)
        def leaks(texts: pd.Series) -> pd.Series:
            enter("benchmark")
            return pd.Series(shared.value.leaks(texts.tolist()), dtype=object)

        return leaks(text)

    columns = [of(x) for x in found]
    if not columns:
        return F.array().cast(LEAK)
    if len(columns) == 1:
        return columns[0]

    def one_an_item(leaks: Column) -> Column:  # items of one id may stand in several indexes
        def better(x: Column) -> Column:
            return F.exists(leaks, lambda y: (y["item_id"] == x["item_id"]) & ((y["score"] > x["score"]) | ((y["score"] == x["score"]) & (y["at"] < x["at"]))))

        return F.array_sort(F.array_distinct(F.filter(leaks, lambda x: ~better(x))))

    return F.transform(F.array(F.concat(*columns)), one_an_item)[0]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns: str) -> DataFrame:
    """One row per document and item that it holds: id, item_id, at, score, question_overlap, answer_overlap.

    Words are runs of letters, digits and underscores in lower case. An item is held if a passage scores its threshold by BM25,
    and holds at least 0.8 of its five-word shingles and half of its answer's words, and of an item that comes as question and answer 0.8 of the question's shingles;
    the answer of an item that is one text is its last sentence or line (split_item()). at is the passage's first word. Null and empty texts
    hold nothing; without items there are no rows. Texts of any length are searched to their end, and rows that repeat an id each
    for themselves. Every document is searched where it lies; only the indexes, of bounded size, are broadcast.
    """
    named = docs.select(docs[id_col].alias(id_col), F.explode(leaks_column(indexes(benchmark, **columns), docs[text_col], docs)).alias("leak"))
    return named.select(id_col, "leak.*")


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **columns: str) -> DataFrame:
    """docs without those that hold an item; columns as they are. Null and empty texts stay; an empty table or benchmark changes nothing."""
    return docs.where(F.size(leaks_column(indexes(benchmark, **columns), docs[text_col], docs)) == 0)
