"""Masked pseudo-likelihood of documents: a window network, trained in numpy, predicts every token from both sides."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import enter, materialize, small_batches

#: Words are hashed to 2**BITS buckets; the VOCABULARY - TAIL commonest are tokens of their own, the others share TAIL tokens.
BITS, VOCABULARY, TAIL = 16, 4096, 256
#: Tokens by frequency are cut into classes of so many.
SIZE = 64
CLASSES = VOCABULARY // SIZE
#: Tokens on either side, width of the hidden layer, tokens per step of the network.
WINDOW, WIDTH, STEP = 3, 16, 4096
#: Words that a copy of the network is trained on, and copies at most; beyond that each gets more words.
SHARD_WORDS, SHARDS = 1 << 21, 8192
_PIECE = 1 << 18  # bytes of text that are hashed at once

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_powers: list[np.ndarray] = []
_word_byte = np.zeros(256, bool)
_word_byte[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def _power_tables() -> list[np.ndarray]:
    if not _powers:
        for base in (_MULTIPLIER, _INVERSE):
            table = np.full(_PIECE + 1, base, np.uint64)
            table[0] = 1
            _powers.append(np.multiply.accumulate(table))
    return _powers


def buckets(text: str | None) -> np.ndarray:
    """Hash bucket of each word, in order. Words are runs of a-z (after lower-casing), digits and characters beyond ASCII."""
    data = text.lower().encode("utf-8", "replace") if text else b""
    found = []
    at = 0
    while at < len(data):
        to = min(len(data), at + _PIECE)
        if to < len(data):  # cut where a word ends, if one does
            k = to
            while k > at and _word_byte[data[k - 1]]:
                k -= 1
            to = k if k > at else to
        found.append(_hash(np.frombuffer(data, np.uint8, to - at, at)))
        at = to
    return np.concatenate(found) if found else np.zeros(0, np.uint16)


def _hash(data: np.ndarray) -> np.ndarray:
    """A word's hash is a difference of prefix sums of its bytes times powers, brought back to power 0."""
    powers, inverses = _power_tables()
    inside = _word_byte[data]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], dtype=np.uint64)))
    h = (sums[ends] - sums[starts]) * inverses[starts]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - BITS)).astype(np.uint16)


@dataclass
class Network:
    """token: bucket -> token; within: bucket -> log of its share of its token, from the counts. Rows of `into` embed the context's
    tokens (the last row, of zeros, stands beyond the text), and `side` weighs each of the 2 * WINDOW places. A word's probability given both
    sides is that of its token's class (`top`, a softmax over CLASSES), times that of the token in the class (`low`, a softmax over SIZE),
    times its share of the token."""

    token: np.ndarray
    within: np.ndarray
    into: np.ndarray
    side: np.ndarray
    top: np.ndarray
    top_bias: np.ndarray
    low: np.ndarray
    low_bias: np.ndarray

    FIELDS = ("into", "side", "top", "top_bias", "low", "low_bias")

    @staticmethod
    def fresh(counts: np.ndarray) -> Network:
        """A network that knows the counts of buckets alone: its probabilities are the tokens' shares. Equal counts go by bucket."""
        order = np.lexsort((np.arange(len(counts)), -counts))
        token = np.empty(len(counts), np.int32)
        own = VOCABULARY - TAIL
        token[order[:own]] = np.arange(own)
        token[order[own:]] = own + np.arange(len(order) - own) % TAIL
        members = np.bincount(token, weights=counts + 0.5, minlength=VOCABULARY)
        within = np.where(token < own, 0.0, np.log((counts + 0.5) / members[token])).astype(np.float32)
        leaves = (np.bincount(token, weights=counts, minlength=VOCABULARY) + 0.5).reshape(CLASSES, SIZE)
        classes = leaves.sum(axis=1)
        into = np.random.default_rng(20).normal(0, 0.3, (VOCABULARY + 1, WIDTH)).astype(np.float32)
        into[-1] = 0
        return Network(
            token, within, into, np.full((2 * WINDOW, WIDTH), 0.5, np.float32), np.zeros((CLASSES, WIDTH), np.float32), np.log(classes / classes.sum()).astype(np.float32),
            np.zeros((CLASSES, SIZE, WIDTH), np.float32), np.log(leaves / classes[:, None]).astype(np.float32),
        )

    def _hidden(self, padded: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For targets (places in a padded row of tokens): contexts, embedded contexts, hidden layer."""
        places = np.array([*range(-WINDOW, 0), *range(1, WINDOW + 1)]) + WINDOW
        context = padded.take(targets[:, None] + places)
        embedded = self.into.take(context, axis=0)
        return context, embedded, np.tanh(np.einsum("nkw,kw->nw", embedded, self.side))

    @staticmethod
    def _softmax(logits: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability of each row's own column, and its slope by the row's logits (which are overwritten)."""
        logits -= logits.max(axis=1, keepdims=True)
        rows = np.arange(len(own))
        chosen = logits[rows, own]
        np.exp(logits, out=logits)
        total = logits.sum(axis=1)
        logits /= -total[:, None]
        logits[rows, own] += 1
        return chosen - np.log(total), logits

    def _low(self, hidden: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]], np.ndarray, np.ndarray]:
        """The targets in order of their classes: that order, the hidden layer, (class, from, to) of each class, the tokens'
        log-probabilities in their classes, and the slopes of these by the logits."""
        own = leaf // SIZE
        order = np.argsort(own.astype(np.uint8), kind="stable")
        ends = np.cumsum(np.bincount(own, minlength=CLASSES)).tolist()
        classes = [(c, a, b) for c, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if a < b]
        hidden, leaf = hidden.take(order, axis=0), leaf.take(order)
        logits = self.low_bias.take(leaf // SIZE, axis=0)
        for c, a, b in classes:
            logits[a:b] += hidden[a:b] @ self.low[c].T
        return order, hidden, classes, *self._softmax(logits, leaf % SIZE)

    @staticmethod
    def pad(tokens: np.ndarray) -> np.ndarray:
        edge = np.full(WINDOW, VOCABULARY, np.int32)
        return np.concatenate((edge, tokens, edge))

    def log_likelihoods(self, texts: list[np.ndarray]) -> np.ndarray:
        """For each text (its buckets) the sum of every word's log-probability given the words on both sides; 0 without a word."""
        out = np.zeros(len(texts))
        sizes = np.array([len(x) for x in texts], np.int64)
        if not sizes.sum():
            return out
        rows = [self.pad(self.token[x]) for x in texts if len(x)]
        padded = np.concatenate(rows)
        some = sizes[sizes > 0]
        starts = np.cumsum(some) - some
        targets = np.arange(int(some.sum())) + np.repeat(np.arange(len(some)) * 2 * WINDOW, some)
        found = self.within[np.concatenate([x for x in texts if len(x)])].astype(np.float64)
        for at in range(0, len(targets), STEP):
            own = targets[at : at + STEP]
            hidden = self._hidden(padded, own)[2]
            leaf = padded[own + WINDOW]
            score = self._softmax(hidden @ self.top.T + self.top_bias, leaf // SIZE)[0]
            order, _, _, low, _ = self._low(hidden, leaf)
            score[order] += low
            found[at : at + STEP] += score
        out[sizes > 0] = np.add.reduceat(found, starts)
        return out

    def train(self, padded: np.ndarray, targets: np.ndarray, squares: dict[str, np.ndarray], rate: float = 0.1) -> None:
        """One step of Adagrad on the mean log-probability of the targets."""
        context, embedded, hidden = self._hidden(padded, targets)
        leaf = padded[targets + WINDOW]
        slope = self._softmax(hidden @ self.top.T + self.top_bias, leaf // SIZE)[1]
        grads = {"top": slope.T @ hidden, "top_bias": slope.sum(axis=0), "low": np.zeros_like(self.low), "low_bias": np.zeros_like(self.low_bias)}
        back = slope @ self.top
        order, own, classes, _, slope = self._low(hidden, leaf)
        below = np.empty_like(own)
        for c, a, b in classes:
            grads["low"][c] = slope[a:b].T @ own[a:b]
            below[a:b] = slope[a:b] @ self.low[c]
        grads["low_bias"][[c for c, _, _ in classes]] = np.add.reduceat(slope, [a for _, a, _ in classes], axis=0)
        back[order] += below
        back *= 1 - hidden * hidden
        grads["side"] = np.einsum("nw,nkw->kw", back, embedded)
        scale = np.float32(1 / len(targets) ** 0.5)
        words = context.ravel().astype(np.uint16)
        by_word = np.argsort(words, kind="stable")
        first = np.flatnonzero(np.diff(words[by_word], prepend=-1))
        ids = words[by_word[first]]
        grad = np.add.reduceat((back[:, None, :] * self.side).reshape(-1, WIDTH).take(by_word, axis=0), first, axis=0) * scale
        grad[ids == VOCABULARY] = 0
        squares["into"][ids] += grad * grad
        self.into[ids] += np.float32(rate) * grad / np.sqrt(squares["into"][ids] + np.float32(1e-6))
        for name, grad in grads.items():
            grad *= scale
            squares[name] += grad * grad
            getattr(self, name)[...] += np.float32(rate) * grad / np.sqrt(squares[name] + np.float32(1e-6))

    def copy(self) -> Network:
        return Network(self.token, self.within, *(getattr(self, f).copy() for f in self.FIELDS))


def count_buckets(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often each bucket occurs in all documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enter("language model")
        total = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            held = [buckets(text) for text in batch["text"]]
            total += np.bincount(np.concatenate(held), minlength=1 << BITS) if held else 0
        own = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": own, "n": total[own]})

    found = docs.select(docs[text_col].alias("text")).mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(1 << BITS)
    counts[found["bucket"]] = found["n"]
    return counts


class _Learner:
    """A copy of the network that is trained on texts in turn, STEP targets at a time."""

    def __init__(self, net: Network) -> None:
        self.net = net.copy()
        self.squares = {f: np.zeros_like(getattr(net, f)) for f in net.FIELDS}
        self.held: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.size = self.wanted = self.seen = 0

    def add(self, tokens: np.ndarray) -> None:
        padded = self.net.pad(tokens)
        at = 0
        while at < len(tokens):
            n = min(len(tokens) - at, STEP - self.wanted)
            self.held.append(padded[at : at + n + 2 * WINDOW])
            self.places.append(np.arange(n) + self.size)
            self.size += n + 2 * WINDOW
            self.wanted += n
            at += n
            if self.wanted == STEP:
                self.step()

    def step(self) -> None:
        if self.wanted:
            self.net.train(np.concatenate(self.held), np.concatenate(self.places), self.squares)
        self.seen += self.wanted
        self.held, self.places, self.size, self.wanted = [], [], 0, 0


def fit(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", rounds: int = 1, slices: int = 16, fan_in: int = 32, shard_words: int = SHARD_WORDS, shards: int = SHARDS) -> Network:
    """Train on all words of all documents.

    Texts are dealt by a hash of text and id (if there is such a column, so that copies of a text spread) into one shard for shard_words words (at most `shards` of them), and in a shard they stand in order of
    another hash, so that the network doesn't depend on how the table is laid out. In a round each shard trains a copy of the
    network on all of its words as targets, and the copies are averaged by their numbers of targets, slice by slice, fan_in copies and
    then groups of copies at a time. Null and empty texts teach nothing; repeated rows count as often as they come; an empty table gives
    a network of equal shares.
    """
    docs = small_batches(docs)
    counts = count_buckets(docs, text_col)
    net = Network.fresh(counts)
    n = int(min(shards, max(1, -(-counts.sum() // shard_words))))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enter("language model")
        for batch in batches:
            yield pd.DataFrame({"shard": batch["shard"], "o": batch["o"], "words": [buckets(t).astype("<u2").tobytes() for t in batch["text"]]})

    text = docs[text_col]
    key = [text, *([docs[id_col]] if id_col in docs.columns else [])]
    dealt = docs.where(text.isNotNull()).select(F.pmod(F.xxhash64(F.lit("shard"), *key), F.lit(n)).cast("int").alias("shard"), F.xxhash64(*key).alias("o"), text.alias("text"))
    dealt = dealt.mapInPandas(hashed, "shard int, o long, words binary").where(F.length("words") > 0)
    dealt = dealt.repartition(n, "shard").sortWithinPartitions("shard", "o", "words")
    for _ in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast(net)

        def learn(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            enter("language model")
            own = shard = None

            def done() -> pd.DataFrame:
                own.step()
                flat = np.concatenate([getattr(own.net, f).ravel() for f in Network.FIELDS])
                pieces = [x.astype("<f4").tobytes() for x in np.array_split(flat, slices)]
                return pd.DataFrame({"slice": range(slices), "part": shard, "weight": float(own.seen), "x": pieces})

            for batch in batches:
                for k, words in zip(batch["shard"], batch["words"], strict=True):
                    if k != shard:
                        if own:
                            yield done()
                        own, shard = _Learner(shared.value), k
                    own.add(shared.value.token[np.frombuffer(words, "<u2")])
            if own:
                yield done()

        def average(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("part")
            weight = rows["weight"].to_numpy()
            mean = sum(w * np.frombuffer(x, "<f4").astype(np.float64) for w, x in zip(weight, rows["x"], strict=True)) / weight.sum()
            return pd.DataFrame({"slice": rows["slice"].iloc[:1], "part": rows["part"].iloc[:1], "weight": weight.sum(), "x": [mean.astype("<f4").tobytes()]})

        kind = "slice int, part int, weight double, x binary"
        copies = materialize(dealt.mapInPandas(learn, kind))
        most = n - 1
        while most >= fan_in:
            copies = copies.withColumn("group", F.floor(F.col("part") / fan_in).cast("int")).groupBy("slice", "group").applyInPandas(average, kind).withColumn("part", F.floor(F.col("part") / fan_in).cast("int"))
            most //= fan_in
        found = copies.groupBy("slice").applyInPandas(average, kind).orderBy("slice").toPandas()
        if len(found):
            net = net.copy()
            flat = np.concatenate([np.frombuffer(x, "<f4") for x in found["x"]])
            for f in net.FIELDS:
                size = getattr(net, f).size
                setattr(net, f, flat[:size].reshape(getattr(net, f).shape).copy())
                flat = flat[size:]
    return net


def score_column(net: Network, text: Column, docs: DataFrame) -> Column:
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("n_tokens long, log_likelihood double")
    def of(texts: pd.Series) -> pd.DataFrame:
        enter("language model")
        found = [buckets(t) for t in texts]
        return pd.DataFrame({"n_tokens": [len(x) for x in found], "log_likelihood": shared.value.log_likelihoods(found)})

    return of(text)


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, log_likelihood (the sum over all tokens) and its mean, null without a token.

    Null and empty texts have no token and a sum of 0. Texts of any length are scored whole. Rows that repeat an id stay rows; an empty
    table gives none. Sums of 32-bit numbers may differ in their last digits by what stands in a batch.
    """
    scored = docs.select(docs[id_col].alias(id_col), score_column(net, docs[text_col], docs).alias("s")).select(id_col, "s.*")
    return scored.withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))
