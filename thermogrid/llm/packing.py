"""Compressed texts and number lists as binary columns, which move through shuffles at a fraction of their size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

from thermogrid.llm import textarrays as T

PACKED = "doc_id long, tie long, packed binary"


def pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, tie, text) to (doc_id, tie, packed). A null text has no bytes."""
    press = zstandard.ZstdCompressor(level=1)
    for b in batches:
        packed = []
        for _, data, offsets in T.text_blocks(b.column(2)):
            raw = data.tobytes()
            packed += [press.compress(raw[a:e]) for a, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary())], ["doc_id", "tie", "packed"])


def unpack_texts(column: pa.Array) -> Iterator[bytes]:
    draw = zstandard.ZstdDecompressor()
    for x in column:
        yield draw.decompress(x.as_py())


def pack_numbers(values: np.ndarray, width: int = 8) -> bytes:
    """Unsigned integers byte plane by byte plane, `width` of them, so that the mostly empty planes vanish."""
    planes = np.ascontiguousarray(values, np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_numbers(raw: bytes, width: int = 8) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view(np.uint64)
