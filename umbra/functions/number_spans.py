"""Numbers by detector: what NUMBERS finds in many rows is told apart over Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from umbra.functions.checks import FIRST_WEIGHTS, SECOND_WEIGHTS
from umbra.functions.patterns import ANY_CASE, EXACT, Detector

SPAN = pa.struct([("entity", pa.string()), ("value", pa.string()), ("st", pa.int32()), ("en", pa.int32()), ("score", pa.float64()), ("rule", pa.string())])
#: Values in which both kinds of regular expression see the same; others are looked at one by one.
PLAIN = "^[0-9A-Za-z. ]*$"


def _national(value: str) -> bool:
    d = re.sub(r"\D", "", value)
    if len(d) != 11 or not d.isascii():
        return False
    return all((sum(int(c) * w for c, w in zip(d, (*weights, 1), strict=False)) % 11) == 0 for weights in (FIRST_WEIGHTS, SECOND_WEIGHTS))


def _nationals(values: pa.Array) -> np.ndarray:
    """Whether both check digits are right, of values of eleven ASCII digits and spaces: each sum with its check digit is a multiple of 11."""
    number = pc.replace_substring(values, " ", "").cast(pa.int64()).to_numpy(zero_copy_only=False)
    digit = [number // 10 ** (10 - i) % 10 for i in range(11)]
    right = [sum(d * w for d, w in zip(digit, (*weights, 1), strict=False)) % 11 == 0 for weights in (FIRST_WEIGHTS, SECOND_WEIGHTS)]
    return right[0] & right[1]


#: Checks of values one by one, and of many.
CHECKS = {"national_id": (_national, _nationals)}


def _matching(values: pa.Array, plain: np.ndarray, d: Detector) -> np.ndarray:
    body = d.pattern.removeprefix(ANY_CASE).removeprefix(EXACT)
    any_case = d.pattern.startswith(ANY_CASE)
    out = pc.match_substring_regex(values, f"{'(?i)' if any_case else ''}^(?:{body})$").to_numpy(zero_copy_only=False).astype(bool) & plain
    whole = re.compile(body, re.IGNORECASE if any_case else 0)
    for i in np.flatnonzero(~plain):
        out[i] = whole.fullmatch(values[i].as_py()) is not None
    return out


def number_spans(pieces: pa.Array, detectors: tuple[Detector, ...]) -> pa.Array:
    """Lists of gaps and matches of NUMBERS in turn -> lists of SPAN of the detectors that match the whole of one."""
    if isinstance(pieces, pa.ChunkedArray):
        pieces = pieces.combine_chunks()
    flat = pieces.flatten()
    counts = pc.fill_null(pc.list_value_length(pieces), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(counts)), counts)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    length = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    end = np.cumsum(length)
    start = end - length
    at = np.flatnonzero((np.arange(len(row)) - first[row]) % 2 == 1)
    st, row, length = start[at] - start[first[row[at]]], row[at], length[at]
    values = flat.take(pa.array(at, type=pa.int64()))
    plain = pc.match_substring_regex(values, PLAIN).to_numpy(zero_copy_only=False).astype(bool)

    found, scores = [], []
    for d in detectors:
        some = np.flatnonzero(np.isin(length, d.lengths))
        own = values.take(pa.array(some, type=pa.int64()))
        hit = _matching(own, plain[some], d)
        some, own = some[hit], own.filter(pa.array(hit))
        score = np.full(len(some), d.score)
        if d.check:
            one, many = CHECKS[d.check]
            right = np.zeros(len(some), dtype=bool)
            right[plain[some]] = many(own.filter(pa.array(plain[some])))
            for i in np.flatnonzero(~plain[some]):
                right[i] = one(own[i].as_py())
            score = np.where(right, d.score, np.nan if d.otherwise is None else d.otherwise)
            kept = ~np.isnan(score)
            some, score = some[kept], score[kept]
        found.append(some)
        scores.append(score)

    which, score = np.concatenate(found), np.concatenate(scores)
    kind = np.repeat(np.arange(len(detectors)), [len(x) for x in found])
    order = np.argsort(row[which], kind="stable")
    which, score, kind = which[order], score[order], pa.array(kind[order], type=pa.int32())

    def named(names: list[str]) -> pa.Array:
        return pa.array(names, type=pa.string()).take(kind)

    spans = [
        named([d.entity for d in detectors]), values.take(pa.array(which, type=pa.int64())).cast(pa.string()), pa.array(st[which], type=pa.int32()),
        pa.array(st[which] + length[which], type=pa.int32()), pa.array(score, type=pa.float64()), named([d.rule for d in detectors]),
    ]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row[which], minlength=len(counts)))])
    return pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.StructArray.from_arrays(spans, fields=list(SPAN)))


def number_spans_of(detectors: tuple[Detector, ...]) -> Callable[[pa.Array], pa.Array]:
    def spans(pieces: pa.Array) -> pa.Array:
        return number_spans(pieces, detectors)

    return spans
