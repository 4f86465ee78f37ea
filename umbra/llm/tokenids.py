"""Token ids in files of directly addressable codes.

A code splits each id into 8-bit chunks. Level 0 holds every id's low chunk, level 1 the next chunk of
the ids that have one, and so on. A bitmap beside each level says which of its entries go on, and a rank
directory counts the set bits before each 512, so that an id's place on the next level is one lookup away:
any id, and any run of ids, is read without decoding what stands before it.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from umbra.llm.common import Kept, enter, materialize, small_batches

_MAGIC = b"DAC1"
_SUPER = 512  # bits that an entry of the rank directory stands for

BLOCKS = "part int, seq int, start long, n_ids long, doc_ids array<long>, lengths array<int>, ids binary"


def dac_encode(ids: np.ndarray) -> bytes:
    """uint32 ids -> bytes; an empty array gives a code of no levels."""
    ids = np.ascontiguousarray(ids, np.uint32)
    out, levels = [], 0
    while len(ids):
        on = ids > 255
        out.append(struct.pack("<Q", len(ids)) + (ids & np.uint32(255)).astype(np.uint8).tobytes())
        bits = np.packbits(on, bitorder="little")
        bits = np.concatenate((bits, np.zeros(-len(bits) % (_SUPER // 8), np.uint8)))
        ones = np.bitwise_count(bits).reshape(-1, _SUPER // 8).sum(axis=1, dtype=np.uint64)
        out.append((np.cumsum(ones) - ones).astype("<u8").tobytes() + bits.tobytes())
        ids = ids[on] >> np.uint32(8)
        levels += 1
    return _MAGIC + struct.pack("<I", levels) + b"".join(out)


class DacReader:
    """Random access to the ids of one code."""

    def __init__(self, code: bytes) -> None:
        if code[:4] != _MAGIC:
            raise ValueError("not a directly addressable code")
        (levels,) = struct.unpack_from("<I", code, 4)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at = 8
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", code, at)
            chunks = np.frombuffer(code, np.uint8, n, at + 8)
            at += 8 + n
            supers = -(-n // _SUPER)
            rank = np.frombuffer(code, "<u8", supers, at)
            bits = np.frombuffer(code, np.uint8, supers * _SUPER // 8, at + 8 * supers)
            at += 8 * supers + len(bits)
            self.levels.append((chunks, rank, bits))

    def __len__(self) -> int:
        return len(self.levels[0][0]) if self.levels else 0

    def _rank(self, level: int, i: int) -> int:
        """Set bits of a level before entry i."""
        chunks, rank, bits = self.levels[level]
        if i >= len(chunks):
            return int(rank[-1]) + int(np.bitwise_count(bits[-(_SUPER // 8) :]).sum()) if len(rank) else 0
        s = i // _SUPER
        first = s * (_SUPER // 8)
        whole = bits[first : i // 8]
        return int(rank[s]) + int(np.bitwise_count(whole).sum()) + int(bits[i // 8] & ((1 << (i % 8)) - 1)).bit_count()

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = shift = 0
        for level, (chunks, _, bits) in enumerate(self.levels):
            value |= int(chunks[i]) << shift
            if not bits[i // 8] >> (i % 8) & 1:
                break
            i, shift = self._rank(level, i), shift + 8
        return value

    def run(self, i: int, j: int) -> np.ndarray:
        """Ids i to j - 1."""
        out = np.zeros(max(0, j - i), np.uint32)
        own = np.arange(len(out))
        for level, (chunks, _, bits) in enumerate(self.levels):
            if not len(own):
                break
            out[own] |= chunks[i:j].astype(np.uint32) << np.uint32(8 * level)
            on = np.unpackbits(bits[i // 8 : -(-j // 8)], bitorder="little")[i % 8 : i % 8 + j - i].astype(bool)
            i = self._rank(level, i)
            own = own[on]
            j = i + len(own)
        return out


#: Fixed value: the pattern by which a byte-level pre-tokenizer cuts text.
_PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_SPACES = re.compile(r"\s[ \n]")
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")


def _byte_characters() -> dict[int, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts by a tokenizer file, add_special_tokens=False.

    With a byte-level tokenizer that has no normalizer, ids of a text are those of its parts when it is cut
    between a character that is no white space and a space or line feed after it: the pre-tokenizer's pattern
    never crosses that place and doesn't look behind it. Parts repeat, so the ids of those met first are kept, in at most
    KEPT_BYTES; of others the tokenizer's model encodes each pre-token. Texts that hold an added token's string or
    white space in a row, and other tokenizers, are encoded whole.
    """

    #: Bytes that kept parts may take, and what one takes beside its text and ids (objects of Python, a place in a table).
    KEPT_BYTES, PART_BYTES = 64 << 20, 180

    def __init__(self, path: str, kept_bytes: int | None = None) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.kept_bytes = self.KEPT_BYTES if kept_bytes is None else kept_bytes
        self.tok = Tokenizer.from_file(path)
        pre = self.tok.pre_tokenizer
        self.by_part = self.tok.normalizer is None and isinstance(pre, ByteLevel) and not pre.add_prefix_space and pre.use_regex
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.model = self.tok.model
        self.characters = _byte_characters()
        self.space = chr(self.characters[32])
        self.slot: dict[str, int] = {}  # of a part: after a space, unless it begins with a line feed
        self.short: dict[str, list[int]] = {}
        self.n = self.used = self.held = 0
        self.start = np.zeros(1 << 12, np.int64)
        self.length = np.zeros(1 << 12, np.int32)
        self.pool = np.zeros(1 << 14, np.uint32)

    def _put(self, ids: list[int], lengths: list[int]) -> None:
        """Ids of parts that get the next slots."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        while self.n + len(lengths) > len(self.start):
            self.start = np.concatenate((self.start, np.zeros_like(self.start)))
            self.length = np.concatenate((self.length, np.zeros_like(self.length)))
        self.pool[self.used : self.used + len(ids)] = ids
        self.start[self.n : self.n + len(lengths)] = self.used + np.cumsum(lengths) - lengths
        self.length[self.n : self.n + len(lengths)] = lengths
        self.used += len(ids)
        self.n += len(lengths)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _pretoken(self, text: str) -> list[int]:
        known = self.short.get(text)
        if known is None:
            shown = self.space + text[1:] if text[0] == " " and text[1:].isascii() and text[1:].isalpha() else text.encode().decode("latin-1").translate(self.characters)
            known = [t.id for t in self.model.tokenize(shown)]
            if len(text) <= 2:
                self.short[text] = known
        return known

    def _part(self, part: str) -> list[int]:
        """Ids of a part."""
        if part.isascii() and part.isalpha():
            return [t.id for t in self.model.tokenize(self.space + part)]
        if part[-1:] in (".", ",") and _LETTERS.fullmatch(part, 0, len(part) - 1):
            return self._pretoken(" " + part[:-1]) + self._pretoken(part[-1])
        if _LETTERS.fullmatch(part):
            return self._pretoken(" " + part)
        return [i for x in _PRETOKEN.findall(part if part[:1] == "\n" else " " + part) for i in self._pretoken(x)]

    def _ids(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts one after another, and each one's number of ids. Parts of a batch repeat, so each distinct one is looked
        up or encoded once; they are kept for later batches while there is room."""
        coded = parts.dictionary_encode()
        distinct, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        slot = np.fromiter(map(self.slot.get, distinct, repeat(-1)), np.int64, len(distinct))
        unknown = np.flatnonzero(slot < 0)
        found = [self._part(distinct[i]) for i in unknown.tolist()]
        fresh = np.fromiter(map(len, found), np.int64, len(found))
        start, length = self.start[slot], self.length[slot].astype(np.int64)
        start[unknown] = self.used + np.cumsum(fresh) - fresh
        length[unknown] = fresh
        pool = np.concatenate((self.pool[: self.used], np.fromiter(chain.from_iterable(found), np.uint32, int(fresh.sum()))))
        if self.held < self.kept_bytes and len(unknown):
            kept = [distinct[i] for i in unknown.tolist()]
            taken = np.cumsum(self.PART_BYTES + np.fromiter(map(len, kept), np.int64, len(kept)) + 4 * fresh)
            n = int(np.searchsorted(taken, self.kept_bytes - self.held, side="right"))
            if n < len(kept):
                self.held = self.kept_bytes
            elif n:
                self.held += int(taken[-1])
            self.slot.update(zip(kept[:n], range(self.n, self.n + n), strict=True))
            self._put(list(chain.from_iterable(found[:n])), fresh[:n].tolist())
        lengths = length[index]
        ends = np.cumsum(lengths)
        return pool[np.repeat(start[index] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)], lengths

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and each text's number of ids."""
        plain = np.array([self.by_part and not any(a in t for a in self.added) and not _SPACES.search(t) for t in texts], bool)
        cut = pc.split_pattern(pc.replace_substring(pa.array([t for t, p in zip(texts, plain, strict=True) if p], pa.large_string()), "\n", " \n"), " ")
        offsets, parts = cut.offsets.to_numpy(), cut.flatten()
        is_head = np.zeros(len(parts), bool)
        is_head[offsets[:-1]] = True  # what stands before a text's first space is encoded apart: no space goes before it
        heads = self._whole(parts.take(pa.array(offsets[:-1])).to_pylist())
        ids, lengths = self._ids(parts.filter(pa.array(~is_head)))
        apart = self._whole([t for t, p in zip(texts, plain, strict=True) if not p])
        ends = np.concatenate(([0], np.cumsum(lengths)))
        bounds = ends[offsets - np.arange(len(offsets))]  # ids before each text, its head and those before left out
        out: list[np.ndarray] = []
        sizes = []
        i = k = 0
        for p in plain:
            if p:
                out += [heads[i], ids[bounds[i] : bounds[i + 1]]]
                sizes.append(len(heads[i]) + int(bounds[i + 1] - bounds[i]))
                i += 1
            else:
                out.append(apart[k])
                sizes.append(len(apart[k]))
                k += 1
        return np.concatenate(out) if out else np.array([], np.uint32), np.array(sizes, np.int64)


_encoders = Kept()


def encoder(path: str, kept_bytes: int | None = None) -> Encoder:
    """One a Python worker, so that what it keeps serves all its tasks."""
    return _encoders.value((path, kept_bytes), lambda: Encoder(path, kept_bytes))


def _groups(batches: Iterator[pd.DataFrame], chars: int) -> Iterator[tuple[list[int | None], list[str]]]:
    """Ids and texts of rows in order, in groups of about so many characters."""
    ids: list[int | None] = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        for i, text in zip(batch["id"], batch["text"], strict=True):
            ids.append(None if pd.isna(i) else int(i))
            texts.append(text)
            size += len(text)
            if size >= chars:
                yield ids, texts
                ids, texts, size = [], [], 0
    if texts:
        yield ids, texts


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, block_ids: int = 1 << 18, chars: int = 1 << 19, kept_bytes: int | None = None) -> None:
    """Write the ids of all texts, each with end_id after it, in ascending order of id to a folder of Parquet files.

    A row is a block of whole documents: its part and place in the part, the ids before it in the part, its
    documents' ids and lengths, and one directly addressable code. Null ids come first; rows that repeat an id are ordered
    by a hash of the text, then the text. Null texts count as empty. An empty table writes no blocks.
    The ids are dealt by ranges, sampled from the ids alone, so that no task holds more than its share. Texts are encoded about chars
    characters at a time, a worker keeps ids of parts in at most kept_bytes (None: KEPT_BYTES), and a block has about block_ids ids, or one longer document.
    """
    docs = small_batches(docs)
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie", "text").select("id", "text")

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enter("token ids")
        part = TaskContext.get().partitionId()
        seq = start = 0
        for doc_ids, texts in _groups(batches, chars):
            ids, sizes = encoder(tokenizer, kept_bytes).encode(texts)
            ids, sizes = np.insert(ids, np.cumsum(sizes), end_id), sizes + 1
            ends = np.cumsum(sizes)
            at = 0
            while at < len(sizes):
                before = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, before + block_ids, side="right")))
                own = ids[before : int(ends[to - 1])]
                yield pd.DataFrame({"part": [part], "seq": [seq], "start": [start], "n_ids": [len(own)], "doc_ids": [doc_ids[at:to]], "lengths": [sizes[at:to].tolist()], "ids": [dac_encode(own)]})
                seq, start, at = seq + 1, start + len(own), to

    dealt.mapInPandas(blocks, BLOCKS).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a folder that write_tokens() wrote: doc_id, start, n_tokens, ids_crc32.

    start counts the ids of all documents before it. Only the totals of the parts, one row a file, meet in one task.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # Written first, so that its size is known when the join is planned and the blocks aren't shuffled for it.
    before = materialize(totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")))
    placed = blocks.join(before, "part").select((F.col("before") + F.col("start")).alias("start"), "doc_ids", "lengths", "ids")

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enter("token ids")
        for batch in batches:
            for first, doc_ids, lengths, code in batch.itertuples(index=False):
                reader = DacReader(code)
                ends = np.cumsum(np.asarray(lengths, np.int64))
                crcs = [zlib.crc32(reader.run(int(e - n), int(e)).astype("<u4").tobytes()) for e, n in zip(ends, lengths, strict=True)]
                yield pd.DataFrame({"doc_id": pd.array([None if x is None or x != x else int(x) for x in doc_ids], "Int64"), "start": first + ends - lengths, "n_tokens": np.asarray(lengths, np.int64), "ids_crc32": crcs})

    return placed.mapInPandas(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")
