"""Words, word hashes and shingles of many texts at once, in numpy.

A word is a run of bytes outside 0x20 and 0x09-0x0D of the UTF-8 text, with A-Z made lower case.
A null text counts as empty. Everything works on whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
#: Numbers worked on at once, so that a step's arrays stay in a core's cache.
_STEP = 16384


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> _S33
    x *= _M1
    x ^= x >> _S33
    x *= _M2
    x ^= x >> _S33
    return x


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer, in place."""
    for at in range(0, len(x), _STEP):
        _mix(x[at : at + _STEP])
    return x


def text_buffer(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, joined, and the offset at which each text begins (one more at the end)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        kind = np.int32
        texts = texts.cast(pa.string())
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, extra_breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of words before each text (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ((data - np.uint8(9)) >= 5) & (data != 32)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each lower-cased word; eight bytes a step, over the words still unread."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    np.add(data, ((data - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5), out=padded[: len(data)])
    eights = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    whole = np.empty(len(starts), np.uint64)
    for chunk in range(0, len(starts), _STEP):
        begin = starts[chunk : chunk + _STEP]
        left = ends[chunk : chunk + _STEP] - begin
        out = _mix(left.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        out ^= eights[begin] & _MASKS[np.minimum(left, 8)]
        _mix(out)
        live, at = np.flatnonzero(left > 8), 8
        while len(live):
            rest = left[live] - at
            out[live] = _mix(out[live] * np.uint64(0x9E3779B97F4A7C15) ^ (eights[begin[live] + at] & _MASKS[np.minimum(rest, 8)]))
            live, at = live[rest > 8], at + 8
        whole[chunk : chunk + _STEP] = out
    return whole


def follow(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a sequence from the hash of its beginning and of its last item."""
    return mix(left * np.uint64(0xD6E8FEB86659FD93) + right)


def run_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive words, whatever texts they belong to: a linear form of the words' hashes, mixed."""
    factors = _mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    out = np.empty(max(len(words) - width + 1, 0), np.uint64)
    for at in range(0, len(out), _STEP):
        end = min(at + _STEP, len(out))
        part = words[at:end] * factors[0]
        for k in range(1, width):
            part += words[at + k : end + k] * factors[k]
        out[at:end] = _mix(part)
    return out


def shingle_sets(texts: pa.Array | pa.ChunkedArray, width: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``width`` words; a shorter text is one run, one without words has none."""
    data, offsets = text_buffer(texts)
    starts, ends, counts = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    del starts, ends
    runs = run_hashes(words, width)
    for a, b in zip(counts[:-1].tolist(), counts[1:].tolist()):
        if b - a >= width:
            x = np.sort(runs[a : b - width + 1])
            keep = np.empty(len(x), bool)
            keep[0] = True
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            yield x[keep]
        elif b > a:
            h = words[a : a + 1]
            for k in range(a + 1, b):
                h = follow(h, words[k : k + 1])
            yield mix(h + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def pieces(batch: pa.RecordBatch | pa.Table, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch | pa.Table]:
    """Consecutive slices of a batch with about ``most_bytes`` of text each, or one row where a text is longer."""
    texts = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(texts), 0)
    sizes = (sizes.combine_chunks() if isinstance(sizes, pa.ChunkedArray) else sizes).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes)
    at = 0
    while at < len(total):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most_bytes, side="right")))
        yield batch.slice(at, end - at)
        at = end
