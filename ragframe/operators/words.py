"""Tokens of Arrow text batches, found on their bytes: the kernel behind hashed vectors and best chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# The bytes of ``text.TOKEN`` in lower-cased text; other signs are outside ASCII byte by byte.
_INSIDE = np.zeros(256, bool)
_INSIDE[list(b"abcdefghijklmnopqrstuvwxyz0123456789'")] = True
STEP_BYTES = 8 << 20


def _laid_out(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of a text array, null as no bytes."""
    raw = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = raw.buffers()
    at = np.frombuffer(offsets, np.int64, len(raw) + 1, raw.offset * 8) if len(raw) else np.zeros(1, np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], held[at[0] : at[-1]]


def steps(texts: pa.Array, rows: int) -> Iterator[tuple[int, int]]:
    """(start, length) of slices of at most ``rows`` texts and about STEP_BYTES bytes."""
    at, _ = _laid_out(texts)
    start = 0
    while start < len(texts):
        end = int(np.searchsorted(at, at[start] + STEP_BYTES, "right")) - 1
        end = min(len(texts), start + rows, max(end, start + 1))
        yield start, end - start
        start = end


def tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row of each token, token) of lower-cased texts, in order, as ``re.findall(text.TOKEN, ...)`` gives them."""
    at, data = _laid_out(texts)
    inside = _INSIDE[data]
    after = np.zeros(len(data), bool)  # a byte that goes on with the token before it
    after[1:] = inside[:-1]
    after[at[:-1][at[:-1] < len(data)]] = False
    kept = np.flatnonzero(inside)
    heads = np.flatnonzero(~after[kept])
    row = np.searchsorted(at, kept[heads], "right") - 1
    offsets = np.append(heads, len(kept)).astype(np.int64)
    found = pa.LargeStringArray.from_buffers(len(heads), pa.py_buffer(offsets), pa.py_buffer(data[kept]))
    return row, found
