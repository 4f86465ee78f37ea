"""Overlap resolution of many rows at once, over Arrow batches."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Spans of a row that are compared with each other at once over all rows; rows of more are looked at one by one.
AT_ONCE = 24


def _ranks(strings: pa.Array) -> np.ndarray:
    """Places of strings in the order of their bytes; null comes first."""
    coded = strings.dictionary_encode()
    names = coded.dictionary.to_pylist()
    places = np.empty(len(names) + 1, dtype=np.int64)
    places[sorted(range(len(names)), key=lambda i: names[i].encode())] = np.arange(len(names))
    places[-1] = -1
    return places[pc.fill_null(coded.indices, len(names)).to_numpy(zero_copy_only=False).astype(np.int64)]


def _clashes(begins: list[int], ends: list[int], st: int, en: int) -> bool:
    for j in range(bisect_left(begins, en) - 1, -1, -1):
        if ends[j] > st:
            return True
        if begins[j] < ends[j]:  # what comes before ends before; one of no length says nothing
            return False
    return False


def _one_row(order: np.ndarray, st: np.ndarray, en: np.ndarray, context: np.ndarray) -> list[int]:
    """The spans that stand, of any number: those kept of a context lie apart, in order of start."""
    kept: dict[int, tuple[list[int], list[int]]] = {}
    out = []
    for i in order:
        begins, ends = kept.setdefault(int(context[i]), ([], []))
        if context[i] >= 0:
            if _clashes(begins, ends, st[i], en[i]):
                continue
            at = bisect_left(begins, st[i])
            begins.insert(at, st[i])
            ends.insert(at, en[i])
        out.append(i)
    return out


def standing(spans: pa.Array, context: str | None = None) -> pa.Array:
    """Of each list of spans those that stand: from the best score on (equal ones by start, entity, end, rule and what else they hold), each
    that overlaps none of those kept; in order of start. context names a field: spans of different contexts never overlap, and those
    without one overlap nothing."""
    if isinstance(spans, pa.ChunkedArray):
        spans = spans.combine_chunks()
    flat = spans.flatten()
    counts = pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = len(counts)
    row = np.repeat(np.arange(rows), counts)
    field = dict(zip((f.name for f in flat.type), flat.flatten(), strict=True))
    if field["st"].null_count or field["en"].null_count:
        raise ValueError("a span lacks its start or end")
    st, en = (field[f].to_numpy(zero_copy_only=False).astype(np.int64) for f in ("st", "en"))
    neg = -pc.fill_null(field["score"], np.inf).to_numpy(zero_copy_only=False)
    by = [_ranks(field["rule"]), en, _ranks(field["entity"]), st, neg, row]
    order = np.lexsort(by)
    if len(order) > 1:  # what the rest decides, which is rare
        a, b = order[:-1], order[1:]
        same = np.logical_and.reduce([k[a] == k[b] for k in by])
        if same.any():
            more = [_ranks(field[f].cast(pa.string())) for f in field if f not in ("entity", "st", "en", "score", "rule")]
            order = np.lexsort([*more[::-1], *by])
    ctx = np.zeros(len(row), dtype=np.int64) if context is None else _ranks(field[context])
    begins = np.concatenate([[0], np.cumsum(counts)])
    keep = np.zeros(len(row), dtype=bool)

    few = np.flatnonzero(counts <= AT_ONCE)
    few = few[np.argsort(-counts[few], kind="stable")]  # rows of more spans first, so that a round's rows are the first ones
    widest = int(counts[few[0]]) if len(few) else 0
    k_st, k_en, k_ctx = (np.full((widest, len(few)), fill, dtype=np.int64) for fill in (np.iinfo(np.int64).max, np.iinfo(np.int64).min, -1))
    for j in range(widest):
        n = int(np.searchsorted(-counts[few], -j, side="left"))
        i = order[begins[few[:n]] + j]
        clash = (k_st[:j, :n] < en[i]) & (k_en[:j, :n] > st[i])
        if context is not None:
            clash &= (k_ctx[:j, :n] == ctx[i]) & (ctx[i] >= 0)
        stands = ~clash.any(axis=0)
        keep[i] = stands
        k_st[j, :n], k_en[j, :n] = np.where(stands, st[i], k_st[j, :n]), np.where(stands, en[i], k_en[j, :n])
        k_ctx[j, :n] = ctx[i]
    for r in np.flatnonzero(counts > AT_ONCE):
        keep[_one_row(order[begins[r] : begins[r + 1]], st, en, ctx)] = True

    chosen = np.flatnonzero(keep)
    chosen = chosen[np.lexsort([st[chosen], row[chosen]])]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row[chosen], minlength=rows))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), flat.take(pa.array(chosen)))
