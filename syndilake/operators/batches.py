"""Batches that reach Python, in pieces: what is made of a piece is handed back before the next one is read."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of bodies in a piece; a longer body is a piece of its own. Spark bounds the batch itself, by rows and by bytes.
PIECE = 1 << 20


def pieces(bodies: pa.Array, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Start and end of each piece: as many rows as stay below so many bytes, and so many rows at most as it has KiB."""
    start = size = 0
    for k, n in enumerate(pc.binary_length(bodies).to_pylist()):
        if k > start and (size + (n or 0) > most or k - start >= most >> 10):
            yield start, k
            start, size = k, 0
        size += n or 0
    if start < len(bodies):
        yield start, len(bodies)
