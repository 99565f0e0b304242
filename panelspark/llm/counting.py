"""Exact corpus-wide counts of 64-bit items, for blocks of documents, without a row for each item.

Each block sends the sorted distinct items it holds, packed by range of the hash; whoever holds a range adds up all
blocks' counts and answers each block with the totals in the order asked. Work and traffic follow the number of
distinct items of the blocks; an item as frequent as one likes is one entry of a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelspark.llm.shared import tidy

ASKED = "block int, bucket int, items binary, counts binary"
TOLD = "block int, bucket int, totals binary, seen_distinct long, seen_total long"
SHARED = "block int, bucket int, size int, places binary, totals binary"
_SHARED = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("size", pa.int32()), ("places", pa.binary()), ("totals", pa.binary())])
_ASKED = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("items", pa.binary()), ("counts", pa.binary())])
_TOLD = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("totals", pa.binary()), ("seen_distinct", pa.int64()), ("seen_total", pa.int64())])


def pack(sorted_items: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as differences, by byte planes, without the planes that hold only zeros."""
    steps = np.diff(sorted_items, prepend=np.uint64(0)).astype("<u8")
    planes = max(1, -(-int(steps.max()).bit_length() // 8)) if len(steps) else 0
    return bytes([planes]) + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes()


def unpack(packed: bytes) -> np.ndarray:
    planes = packed[0]
    if not planes:
        return np.zeros(0, np.uint64)
    body = np.frombuffer(packed, np.uint8, offset=1).reshape(planes, -1)
    out = np.zeros((body.shape[1], 8), np.uint8)
    out[:, :planes] = body.T
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Non-negative counts by byte planes; one value that all share takes its own size only."""
    if len(counts) and (counts == counts[0]).all():
        return b"\0" + int(counts[0]).to_bytes(8, "little") + len(counts).to_bytes(8, "little")
    planes = max(1, -(-int(counts.max()).bit_length() // 8)) if len(counts) else 1
    return bytes([planes]) + np.ascontiguousarray(counts.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes()


def unpack_counts(packed: bytes) -> np.ndarray:
    planes = packed[0]
    if not planes:
        return np.full(int.from_bytes(packed[9:17], "little"), int.from_bytes(packed[1:9], "little"), np.int64)
    body = np.frombuffer(packed, np.uint8, offset=1).reshape(planes, -1)
    out = np.zeros((body.shape[1], 8), np.uint8)
    out[:, :planes] = body.T
    return out.view("<i8").ravel().copy()


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values, ascending."""
    ranked = np.sort(values)
    return ranked[np.r_[True, ranked[1:] != ranked[:-1]]] if len(ranked) else ranked


def among(values: np.ndarray, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``values`` are among ``listed`` (ascending, distinct), and at which place there. A table of 20 bits turns most others away."""
    if not len(listed) or not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = np.uint64((1 << 20) - 1)
    table = np.zeros(1 << 20, bool)
    table[(listed & low).astype(np.int64)] = True
    some = np.flatnonzero(table[(values & low).astype(np.int64)])
    at = np.minimum(np.searchsorted(listed, values[some]), len(listed) - 1)
    hit = listed[at] == values[some]
    return some[hit], at[hit]


def ask(block: int, items: np.ndarray, counts: np.ndarray, buckets: int, bits: int = 64) -> pa.Table:
    """Rows of ASKED for a block's ascending distinct items below 2**bits."""
    edges = np.array([(k << bits) // buckets for k in range(1, buckets)], np.uint64)
    cuts = [0, *np.searchsorted(items, edges).tolist(), len(items)]
    counts = np.asarray(counts, np.int64)
    rows = [(k, pack(items[a:b]), pack_counts(counts[a:b])) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
    return pa.Table.from_arrays([pa.array([block] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], schema=_ASKED)


def _answer(table: pa.Table) -> pa.Table:
    parts = [unpack(x) for x in table.column("items").to_pylist()]
    counts = np.concatenate([unpack_counts(x) for x in table.column("counts").to_pylist()])
    items = np.concatenate(parts)
    order = np.argsort(items, kind="stable")
    ranked = items[order]
    first = np.ones(len(ranked), bool)
    np.not_equal(ranked[1:], ranked[:-1], out=first[1:])
    sums = np.add.reduceat(counts[order], np.flatnonzero(first))
    totals = np.empty(len(items), np.int64)
    totals[order] = sums[np.cumsum(first) - 1]
    ends = np.cumsum([len(p) for p in parts])
    out = [pack_counts(totals[e - len(p) : e]) for p, e in zip(parts, ends)]
    even = sums[(ranked[first] & np.uint64(1)) == 0]
    none = [0] * (len(out) - 1)
    return pa.Table.from_arrays([table.column("block").cast(pa.int32()), table.column("bucket").cast(pa.int32()), pa.array(out, pa.binary()), pa.array([int((even > 0).sum()), *none]), pa.array([int(even.sum()), *none])], schema=_TOLD)


def told(asked: DataFrame) -> DataFrame:
    """Rows of TOLD for rows of ASKED. One row of each range also has, over its even items, how many have a count above 0 and their sum."""
    return asked.groupBy("bucket").applyInArrow(tidy(_answer), TOLD)


def _shared(table: pa.Table) -> pa.Table:
    parts = [unpack(x) for x in table.column("items").to_pylist()]
    counts = np.concatenate([unpack_counts(x) for x in table.column("counts").to_pylist()])
    items = np.concatenate(parts)
    ranked = np.sort(items)
    listed = distinct(np.concatenate([ranked[1:][ranked[1:] == ranked[:-1]], items[counts > 1]]))
    where, at = among(items, listed)
    sums = np.zeros(len(listed), np.int64)
    np.add.at(sums, at, counts[where])
    ends = np.cumsum([len(p) for p in parts])
    cuts = np.searchsorted(where, ends)
    rows = [(where[a:b] - (e - len(p)), sums[at[a:b]]) for a, b, e, p in zip([0, *cuts[:-1].tolist()], cuts.tolist(), ends.tolist(), parts)]
    return pa.Table.from_arrays(
        [table.column("block").cast(pa.int32()), table.column("bucket").cast(pa.int32()), pa.array([len(p) for p in parts], pa.int32())]
        + [pa.array([pack(w.astype(np.uint64)) for w, _ in rows], pa.binary()), pa.array([pack_counts(c) for _, c in rows], pa.binary())],
        schema=_SHARED,
    )


def shared_items(asked: DataFrame) -> DataFrame:
    """For rows of ASKED rows of SHARED: the places, among a block's items of a range, of those counted more than once, and their totals."""
    return asked.groupBy("bucket").applyInArrow(tidy(_shared), SHARED)


def shared_of(side: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places among a block's ascending distinct items of those that are counted more than once, and their totals."""
    places, totals, before = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for _, size, at, total in sorted(zip(*(side.column(c).to_pylist() for c in ("bucket", "size", "places", "totals")))):
        places.append(unpack(at).astype(np.int64) + before), totals.append(unpack_counts(total))
        before += size
    return np.concatenate(places), np.concatenate(totals)


def totals_of(rows: Iterator[tuple[int, bytes]]) -> np.ndarray:
    """The totals of a block's items, in their order, from its (bucket, totals) rows."""
    parts = [unpack_counts(x) for _, x in sorted(rows)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def bits_for(total_bytes: int) -> int:
    """Bits of a hash that tell apart nearly all of the items that so many bytes of text can hold: for counts that may be too high, never too low."""
    return min(64, max(16, int(total_bytes).bit_length() + 8))
