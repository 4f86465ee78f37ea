"""Numbers of unigram tokens without the tokens: Viterbi that carries a score and a count."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import Kept, enter, small_batches

#: Stands for a space, and begins a word.
SPACE = "▁"
#: What an unknown character scores less than the least likely piece.
UNKNOWN_PENALTY = 10.0


@dataclass
class Vocabulary:
    """Pieces with log-probabilities in the tokenizer's order; the place of the unknown piece; whether unknown characters become bytes."""

    pieces: list[tuple[str, float]]
    unknown: int = 0
    byte_fallback: bool = True


def zipf_vocabulary(path: str) -> Vocabulary:
    """The pieces of a sentencepiece model as a unigram vocabulary.

    Its scores are places in an order of merging, not probabilities, so a piece gets the log-probability that Zipf's law gives its place
    among the pieces of text. Control, byte and unknown pieces, which no text is cut into by choice, score below all of these.
    """
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    special = [sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
    total = math.log(sum(1 / k for k in range(1, n - sum(special) + 1)))
    place, pieces = 0, []
    for i in range(n):
        place += not special[i]
        pieces.append((sp.id_to_piece(i), -math.log(n + 1 if special[i] else place) - total))
    return Vocabulary(pieces, sp.unk_id(), all(f"<0x{b:02X}>" in {sp.id_to_piece(i) for i in range(300)} for b in range(256)))


class Counter:
    """Token counts of texts.

    A space begins a word, and so does the text; words are segmented apart, so a word's count is kept, while all that is kept takes
    at most KEPT_BYTES.
    """

    #: WORD_BYTES: what a kept word takes beside its text.
    KEPT_BYTES, WORD_BYTES = 64 << 20, 150

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.automaton = ahocorasick.Automaton()
        last = {}
        for i, (piece, score) in enumerate(vocabulary.pieces):
            if piece:
                last[piece] = (len(piece), score, i == vocabulary.unknown)
        for piece, value in last.items():
            self.automaton.add_word(piece, value)
        self.automaton.make_automaton()
        self.least = min((s for _, s in vocabulary.pieces), default=0.0) - UNKNOWN_PENALTY
        self.known = set(last)
        self.bytes = vocabulary.byte_fallback and all(f"<0x{b:02X}>" in self.known for b in range(256))
        self.kept: dict[str, int] = {}
        self.held = 0

    def word(self, word: str) -> int:
        """Pieces of the best segmentation of one word.

        The automaton gives all matches by their end, of one end the longest first; a later one must score strictly more,
        so of equal segmentations of a beginning the one whose last piece starts first stands. A character that is no piece
        scores as unknown. Unknown characters in a row are one token, or one per UTF-8 byte if there are byte pieces.
        """
        n = len(word)
        score = [0.0] * (n + 1)
        back = [-1] * (n + 1)
        count = [0] * (n + 1)
        open_run = [-1] * (n + 1)  # start of the unknown characters that end here
        matches = self.automaton.iter(word)
        nxt = next(matches, None)
        least = self.least
        for end in range(1, n + 1):
            best, start, unknown = 0.0, -1, True
            single = False
            while nxt is not None and nxt[0] == end - 1:
                length, piece, is_unknown = nxt[1]
                at = end - length
                total = piece + score[at]
                if start < 0 or total > best:
                    best, start, unknown = total, at, is_unknown
                single = single or length == 1
                nxt = next(matches, None)
            if not single:
                total = least + score[end - 1]
                if start < 0 or total > best:
                    best, start, unknown = total, end - 1, True
            score[end], back[end] = best, start
            if not unknown:
                count[end] = count[start] + 1
                continue
            run = open_run[start] if open_run[start] >= 0 else start
            open_run[end] = run
            text = word[run:end]
            count[end] = count[run] + (1 if text in self.known or not self.bytes else len(text.encode("utf-8", "replace")))
        return count[n]

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        spaced = text.replace(SPACE, " ")
        words = spaced.split(" ")
        if spaced[0] == " ":
            words = words[1:]
        total = 0
        kept = self.kept
        for w in words:
            n = kept.get(w)
            if n is None:
                n = self.word(SPACE + w)
                if len(w) <= 64:
                    if self.held >= self.KEPT_BYTES:
                        kept.clear()
                        self.held = 0
                    kept[w] = n
                    self.held += self.WORD_BYTES + 4 * len(w)
            total += n
        return total


_counters = Kept()


def count_column(vocabulary: Vocabulary, text: Column, docs: DataFrame) -> Column:
    """Tokens of each text. A Python worker keeps one counter, known by a digest of its vocabulary."""
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(vocabulary)
    digest = hashlib.sha256(repr(vocabulary).encode("utf-8", "replace")).hexdigest()

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        enter("token counts")
        counter = _counters.value(digest, lambda: Counter(shared.value))
        return pd.Series([counter.text(t) for t in texts], dtype="int64")

    return of(text)


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens. Null and empty texts have none; an empty table gives no rows. Texts of any length are
    counted whole, and rows that repeat an id each for themselves."""
    return docs.select(docs[id_col].alias(id_col), count_column(vocabulary, docs[text_col], docs).alias("n_tokens"))
