"""Texts of an Arrow batch as one byte buffer, and blocks of it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from xxhash import xxh64_intdigest

from labelloom.llm.rolling import LONG, PrefixHash, mix

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


# Texts are handled in pieces of about so many bytes, words in segments of so many.
PIECE = 1 << 22
SEGMENT = 1 << 17


def pieces(batch: pa.RecordBatch, size: int = PIECE, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``size`` bytes of text, or of one longer text."""
    lengths = pa.compute.binary_length(batch.column(text)).to_numpy(zero_copy_only=False)
    reach = np.cumsum(lengths)
    at = 0
    while at < len(reach):
        before = reach[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(reach, before + size, side="right")))
        yield batch.slice(at, end - at)
        at = end


_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32


def small_letters(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z as a-z."""
    return _SMALL[data]


@dataclass
class Texts:
    ids: np.ndarray
    starts: np.ndarray  # one more than there are texts
    data: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, text: str = "text") -> Texts:
        """``batch`` with columns doc_id (no nulls) and a text column without nulls."""
        column = batch.column(text)
        wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        _, places, data = column.buffers()
        starts = np.frombuffer(places, dtype=np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
        data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
        first, last = int(starts[0]), int(starts[-1])
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        return cls(ids, starts.astype(np.int64) - first, data[first:last])

    def text_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, side="right") - 1


@dataclass
class WordTexts:
    """The words of ``Texts``: a hash of each, and where each text's words start."""

    ids: np.ndarray
    starts: np.ndarray
    hashes: np.ndarray

    @classmethod
    def of(cls, texts: Texts, seed: int = 0) -> WordTexts:
        """Hashes of two seeds are independent of each other."""
        inside = ~_SPACE[texts.data]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        begin, end = edge[::2], edge[1::2]
        # A word that runs over the border of two texts is two words.
        cuts = texts.starts[1:-1]
        cuts = np.unique(cuts[(cuts > 0) & (cuts < len(texts.data))])
        cuts = cuts[inside[cuts] & inside[cuts - 1]]
        begin, end = np.sort(np.concatenate([begin, cuts])), np.sort(np.concatenate([end, cuts]))
        hashes = np.zeros(len(begin), dtype=np.uint64)
        for k in range(0, len(begin), SEGMENT):
            first, last = begin[k:k + SEGMENT], end[k:k + SEGMENT]
            part = PrefixHash.of_bytes(texts.data[first[0]:last[-1]], seed)
            hashes[k:k + SEGMENT] = mix(part.window(first - first[0], last - first) + (last - first).astype(np.uint64))
        for k in np.flatnonzero(end - begin >= LONG):
            hashes[k] = xxh64_intdigest(texts.data[begin[k]:end[k]].tobytes(), seed)
        return cls(texts.ids, np.searchsorted(begin, texts.starts), hashes)

    def segments(self, overlap: int) -> Iterator[tuple[int, WordTexts]]:
        """Stretches of about ``SEGMENT`` words that share ``overlap`` words with the next, and where each begins."""
        for at in range(0, len(self.hashes), SEGMENT):
            end = min(at + SEGMENT + overlap, len(self.hashes))
            yield at, WordTexts(self.ids, np.clip(self.starts, at, end) - at, self.hashes[at:end])


@dataclass
class Runs:
    """Runs of bytes of many texts, as strings: where each begins in ``data``, and each text's first run."""

    values: pa.Array
    begin: np.ndarray
    first: np.ndarray
    data: np.ndarray


def runs_of(texts: pa.Array, member: np.ndarray, value: Callable[[np.ndarray], np.ndarray] | None = None,
            kind: Callable[[np.ndarray], np.ndarray] | None = None) -> Runs:
    """The longest runs of bytes that ``member`` marks; what ``value`` makes of the bytes stands in them.

    Runs are also cut between bytes to which ``kind`` gives 1 and 2. No cut may be inside a character.
    """
    texts = texts.cast(pa.large_string())
    _, places, data = texts.buffers()
    starts = np.frombuffer(places, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    first, last = int(starts[0]), int(starts[-1])
    data = np.frombuffer(data, dtype=np.uint8)[first:last] if last > first else np.zeros(0, dtype=np.uint8)
    starts = starts - first
    inside = member[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    if kind is not None:
        kinds = kind(data)
        begin[1:] |= (kinds[1:] | kinds[:-1]) == 3
    borders = starts[:-1][starts[:-1] < len(data)]
    begin[borders] = inside[borders]
    begin = np.flatnonzero(begin)
    # Without the other bytes the runs stand side by side in one buffer.
    reach = np.cumsum(inside, dtype=np.int32 if len(data) < 1 << 31 else np.int64)
    kept = data[inside] if value is None else value(data)[inside]
    places = np.append(reach[begin].astype(np.int64) - 1, len(kept))
    found = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(places), pa.py_buffer(kept))
    return Runs(found, begin, np.searchsorted(begin, starts), data)


def hash_strings(values: pa.Array) -> np.ndarray:
    """Hash of each of the large strings ``values``, for uses where equal hashes only cost work."""
    if not len(values):
        return np.zeros(0, dtype=np.uint64)
    _, places, data = values.buffers()
    starts = np.frombuffer(places, dtype=np.int64)[values.offset:values.offset + len(values) + 1]
    size = np.diff(starts)
    data = np.frombuffer(data, dtype=np.uint8)[starts[0]:starts[-1]] if starts[-1] > starts[0] else np.zeros(0, dtype=np.uint8)
    return mix(PrefixHash.of_bytes(data).window(starts[:-1] - starts[0], size) + size.astype(np.uint64))
