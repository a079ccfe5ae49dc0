"""Words as slices of UTF-8 buffers.

The texts of a batch stand one after another in one buffer of bytes.  A lookup
table says of every byte whether it belongs to a word; where that changes, words
begin and end.  Arrow's dictionary gives equal slices one number, so a word is an
exact number, no string is made of its repeats and each value is hashed once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that are looked at together.
CHUNK_BYTES = 1 << 22

#: ASCII capitals to small letters, every other byte to itself.
SMALL = np.arange(256, dtype=np.uint8)
SMALL[65:91] += 32


def table_of(inside: Callable[[int], bool]) -> np.ndarray:
    """A lookup table over bytes."""
    return np.array([inside(byte) for byte in range(256)])


class Words(NamedTuple):
    """The words of some texts in order: the text of each, the number of each among ``distinct``, and where it lies in the buffer."""

    text: np.ndarray
    code: np.ndarray
    start: np.ndarray
    end: np.ndarray
    distinct: list[bytes]
    hashes: np.ndarray


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, A-Z in lower case, and where each text begins and ends among them; null is empty."""
    whole = texts.fill_null("").cast(pa.large_binary())
    _, offsets, data = whole.buffers()
    offsets = np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return SMALL[data[offsets[0] : offsets[-1]]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first text, its place in ``data``, where the chunk's texts begin in it and end) for chunks of about ``most`` bytes.

    A longer text makes several chunks, cut behind a byte of ``breaks``; where it has none, it stays whole.
    """
    text, texts = 0, len(offsets) - 1
    while text < texts:
        begin = int(offsets[text])
        last = max(text + 1, int(np.searchsorted(offsets, begin + most, "right")) - 1)
        if last > text + 1 or offsets[last] - begin <= most:
            yield text, begin, offsets[text : last + 1] - begin
        else:
            stop = int(offsets[last])
            while begin < stop:
                end = min(stop, begin + most)
                while end < stop and not breaks[data[end - 1]]:
                    found = np.flatnonzero(breaks[data[end : end + most]])
                    end = end + int(found[0]) + 1 if len(found) else min(stop, end + most)
                yield text, begin, np.array([0, end - begin])
                begin = end
        text = last


def group_slices(data: np.ndarray, size: np.ndarray, hashed: Callable[[bytes], int] = xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(number of each slice's value, the distinct values, their hashes) of slices of such sizes, one right behind the other."""
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    _, ends, raw = found.dictionary.buffers()
    ends, raw = np.frombuffer(ends, np.int64)[: len(found.dictionary) + 1].tolist(), raw.to_pybytes() if raw else b""
    values = [raw[a:b] for a, b in zip(ends, ends[1:])]
    return found.indices.to_numpy().astype(np.int64), values, np.fromiter(map(hashed, values), np.uint64, len(values))


def words_of(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, **how) -> Words:
    """The words (longest runs of bytes in ``table``) of texts that begin at ``offsets``; no word reaches from one text into the next."""
    inside = table[data]
    begin, last = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    seams = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    begin[seams] = inside[seams]
    last[seams - 1] = inside[seams - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(last) + 1
    code, distinct, hashes = group_slices(data[inside], end - start, **how)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))
    return Words(text, code, start, end, distinct, hashes)
