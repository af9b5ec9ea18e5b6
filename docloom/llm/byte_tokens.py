"""Words of a text column as slices of its UTF-8 buffer, found and grouped without a Python string for each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from xxhash import xxh64_intdigest

#: Bytes of text that are tokenized at once; a longer text is taken whole.
BYTES = 4 << 20
#: Every byte with A-Z lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_bytes(separators: str) -> np.ndarray:
    """A table of 256 booleans: False for each byte that the ASCII ``separators`` name. A text's other characters consist of bytes
    that are none of them, so that a run of true bytes is a run of characters."""
    table = np.ones(256, dtype=bool)
    table[list(separators.encode("ascii"))] = False
    return table


def buffers(column: pa.Array | pa.ChunkedArray, limit: int = BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of whole rows of about ``limit`` bytes; a null is an empty text, A-Z are lower-cased."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    if column.null_count:  # what lies beneath a null is undefined
        lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
        data = np.concatenate([data[a : a + n] for a, n in zip(offsets[:-1].tolist(), lengths.tolist(), strict=True)])
        offsets = np.concatenate([[0], np.cumsum(lengths)])
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, LOWER[data[offsets[at] : offsets[stop]]], offsets[at : stop + 1] - offsets[at]
        at = stop


def slices(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, rows) of all runs of word bytes; a run ends where its row does."""
    inside = is_word[buf]
    starts, ends = np.zeros(len(buf) + 1, bool), np.zeros(len(buf) + 1, bool)
    starts[1:-1] = inside[1:] & ~inside[:-1]
    ends[1:-1] = inside[:-1] & ~inside[1:]
    first, last = offsets[:-1][offsets[:-1] < len(buf)], offsets[1:][offsets[1:] > 0]
    starts[first] = inside[first]
    ends[last] = inside[last - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends)
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def group(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, digest: Callable[[bytes], int] = xxh64_intdigest) -> tuple[np.ndarray, list[bytes]]:
    """(code of each slice, the distinct slices by code). Slices meet by hash, then every one is compared with the first of its
    group, byte by byte; what differs (two slices of one hash) is grouped by its bytes."""
    if not len(starts):
        return np.zeros(0, np.int64), []
    data = buf.tobytes()
    hashes = np.fromiter(map(digest, map(data.__getitem__, map(slice, starts.tolist(), ends.tolist()))), np.uint64, len(starts))
    _, first, codes = np.unique(hashes, return_index=True, return_inverse=True)
    lengths = ends - starts
    alike = lengths == lengths[first][codes]
    # all bytes of the slices of a group's length, beside those of its first
    n = np.where(alike, lengths, 0)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    differs = buf[np.repeat(starts, n) + within] != buf[np.repeat(starts[first][codes], n) + within]
    odd = ~alike
    odd[np.repeat(np.arange(len(n)), n)[differs]] = True
    found = [data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    more: dict[bytes, int] = {}
    for i in np.flatnonzero(odd).tolist():
        codes[i] = more.setdefault(data[starts[i] : ends[i]], len(found) + len(more))
    return codes, found + list(more)
