"""Helpers shared by the operators of this folder.

Text is handled as UTF-8 bytes in Arrow batches. ``runs`` turns many texts at once into hashed words with numpy, in pieces of
about one megabyte, so that the memory of a task does not follow the length of a document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
PIECE_BYTES = 1 << 20
#: Bytes of short texts that are worked on together, and of texts of an Arrow batch that are Python objects at a time.
GROUP_BYTES, SLICE_BYTES = 1 << 18, 4 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)

#: Byte classes: 1 for bytes of words, 0 for white space.
WORD_BYTES = np.ones(256, np.uint8)
WORD_BYTES[[0x20, *range(0x09, 0x0E)]] = 0
#: A-Z to lower case, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 2 * len(_POWERS), 64)
        _POWERS = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(size - 1, _FACTOR, np.uint64), dtype=np.uint64)))
    return _POWERS


def pieces(text: bytes, size: int = PIECE_BYTES) -> Iterator[bytes]:
    """A text cut at white space into pieces of about ``size`` bytes."""
    at = 0
    while len(text) - at > size:
        cut = _SPACE.search(text, at + size)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def groups(texts: list[bytes], size: int = PIECE_BYTES) -> Iterator[tuple[list[int], list[bytes]]]:
    """Texts gathered into groups of about ``GROUP_BYTES``, cut where they are longer than ``size``: their positions and their (pieces of) texts."""
    at, part, total = [], [], 0
    together = min(size, GROUP_BYTES)
    for i, text in enumerate(texts):
        for piece in pieces(text, size) if len(text) > size else (text,):
            if part and total + len(piece) > together:
                yield at, part
                at, part, total = [], [], 0
            at.append(i)
            part.append(piece)
            total += len(piece)
    if part:
        yield at, part


def runs(texts: list[bytes], classes: np.ndarray = WORD_BYTES, fold: np.ndarray = LOWER) -> tuple[np.ndarray, ...]:
    """Maximal runs of bytes of one class other than 0, over several texts.

    Returns the joined bytes and, per run: 64-bit hash of the folded bytes, number of the text, start and length in the joined bytes.
    """
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    kind = classes[joined]
    edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    starts = np.concatenate((np.zeros(1, np.int64), edge))
    lengths = np.diff(np.concatenate((starts, [len(joined)])))
    place = np.arange(len(joined)) - np.repeat(starts, lengths)
    values = (fold[joined].astype(np.uint64) + np.uint64(1)) * _powers(int(lengths.max()))[place]
    sums = np.add.reduceat(values, starts)
    kept = kind[starts] > 0
    starts, lengths = starts[kept], lengths[kept]
    hashes = mix(sums[kept] ^ (lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return joined, hashes, np.searchsorted(ends, starts, side="right"), starts, lengths


def stretch_hashes(joined: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = LOWER) -> np.ndarray:
    """Hashes of non-empty stretches of the joined bytes, equal to those that ``runs`` gives to the same bytes."""
    lengths = ends - starts
    before = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum()) - np.repeat(before, lengths)
    values = (fold[joined[place + np.repeat(starts, lengths)]].astype(np.uint64) + np.uint64(1)) * _powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(values, before) ^ (lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def slices(batches: Iterator[pa.RecordBatch], text: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """All rows of the batches in slices with about ``size`` bytes in the column at ``text``, or one longer text; nothing is copied.

    A worker then holds the objects, and hands on the results, of one slice and not of thousands of texts.
    """
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def bytes_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def id_column(docs: DataFrame, name: str) -> str:
    """DDL type of a column, to be given back unchanged."""
    return docs.schema[name].dataType.simpleString()
