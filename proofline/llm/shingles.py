"""Word shingles of whole texts as 64-bit hashes, vectorised over Arrow string buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SEED = np.random.Generator(np.random.PCG64(20240607))
#: A random value for each byte; A-Z have those of a-z, white space has none.
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_PLACE = _SEED.integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: dict[str, np.ndarray] = {}
#: Bytes of text hashed at a time; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20


def _power(base: np.uint64, n: int) -> np.ndarray:
    known = _powers.get(str(base))
    if known is None or len(known) < n:
        factors = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        factors[0] = 1
        known = _powers[str(base)] = np.cumprod(factors)
    return known[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all others (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in ``data``, and where each text's words begin among them; ``bounds`` are the texts' offsets."""
    inner = ~_SPACE[data]
    before = np.zeros(len(data), bool)
    before[1:] = inner[:-1]
    first = bounds[:-1][bounds[:-1] < bounds[1:]]
    before[first] = False
    starts = np.flatnonzero(inner & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inner[1:]
    after[first[1:] - 1] = False
    ends = np.flatnonzero(inner & ~after) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=sums[1:])
    words = (sums[ends] - sums[starts]) * _power(_BASE_INVERSE, len(data) + 1)[starts]
    return mixed(words), np.searchsorted(starts, bounds)


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(offsets) - 1:
        end = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1
        end = min(max(end, at + 1), len(offsets) - 1)
        yield at, end
        at = end


def shingle_sets(texts: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``size``-word shingles.

    A-Z count as a-z; words are runs between ASCII white space.  A text of
    fewer words, but at least one, has one shingle, all its words.  Null and
    wordless texts have none.
    """
    texts = pa.concat_arrays([texts]) if isinstance(texts, pa.Array) else texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    nothing = np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        for at, end in _slices(offsets):
            part = data[offsets[at] : offsets[end]]
            if not len(part):
                yield from (nothing for _ in range(end - at))
                continue
            words, begins = _word_hashes(part, offsets[at : end + 1] - offsets[at])
            runs = np.zeros(max(0, len(words) - size + 1), np.uint64)
            for k in range(size):
                runs += words[k : k + len(runs)] * _PLACE[k]
            runs = mixed(runs)
            for k in range(end - at):
                a, b = begins[k], begins[k + 1]
                if b - a >= size:
                    yield np.unique(runs[a : b - size + 1])
                elif b > a:
                    short = np.uint64(b - a)
                    for j in range(b - a):
                        short += words[a + j] * _PLACE[j]
                    yield mixed(np.array([short], np.uint64))
                else:
                    yield nothing
