"""Vectorised text primitives shared by the training-data operators.

Everything here works on UTF-8 bytes of whole texts, a few megabytes at a time.
Separators of all supported word classes are ASCII, so they can be found bytewise.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text handled at once; a longer text forms a slice of its own.
SLICE_BYTES = 1 << 19

WHITE = bytes([0x20, *range(0x09, 0x0E)])


def separators(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


WHITE_SEP = separators(WHITE)
#: Words of digits, lower-case letters and everything beyond ASCII; A-Z count after lower-casing.
ALNUM_SEP = separators(
    bytes(b for b in range(0x80) if not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A))
)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of 64-bit words over all bits."""
    h = h ^ (h >> U64(31))
    h = h * U64(0x7FB5D329728EA185)
    h = h ^ (h >> U64(27))
    h = h * U64(0x81DADEF4BC2DD44D)
    return h ^ (h >> U64(33))


#: Bytes with A-Z in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The lowest n bytes of a 64-bit word.
LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


def key_of(seed: int) -> np.ndarray:
    return np.array([seed * 0x9E3779B97F4A7C15 & (2**64 - 1)], U64)


class Slice:
    """Some whole texts: their bytes, where each begins, and the rows' ids."""

    def __init__(self, ids: pa.Array, data: np.ndarray, offsets: np.ndarray, nulls: np.ndarray):
        self.ids, self.data, self.offsets, self.nulls = ids, data, offsets, nulls

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def tokens(self, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and the number of the first word of each text."""
        keep = ~sep[self.data]
        n = len(keep)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = keep[:-1], keep[1:]
        edges = self.offsets[(self.offsets > 0) & (self.offsets < n)]
        before[edges] = False
        after[edges - 1] = False
        starts, ends = np.flatnonzero(keep & ~before), np.flatnonzero(keep & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False, seed: int = 11) -> np.ndarray:
        """A 64-bit hash of each byte range; those of two seeds are independent.

        Every 8 bytes are mixed with their place in the range and the seed, and the results summed up and mixed.
        """
        raw = (LOWER[self.data] if lower else self.data).tobytes() + bytes(8)
        words = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))  # the 8 bytes from each byte on
        sizes, key = ends - starts, key_of(seed)
        many = (sizes + 7) >> 3
        if many.max(initial=0) <= 1:
            total = mix((words[starts] & LOW_BYTES[sizes]) ^ mix(key))
        else:
            many = np.maximum(many, 1)
            first = np.cumsum(many) - many
            place = np.arange(int(many.sum())) - np.repeat(first, many)
            at, left = np.repeat(starts, many) + 8 * place, np.minimum(np.repeat(sizes, many) - 8 * place, 8)
            total = np.add.reduceat(mix((words[at] & LOW_BYTES[left]) ^ mix(place.astype(U64) + key)), first)
        return mix(total + sizes.astype(U64))


@lru_cache
def lean() -> None:
    """Makes a worker give back the memory of large arrays when they are freed, instead of keeping it for later ones."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
    except (OSError, AttributeError):
        return  # another C library, with habits of its own


def slices(batches: Iterator[pa.RecordBatch], max_bytes: int = SLICE_BYTES, max_rows: int = 4096) -> Iterator[tuple[pa.RecordBatch, Slice]]:
    """Cuts batches whose first two columns are an id and a text into slices, with the rows of each."""
    lean()
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(1)
        nulls = column.is_null().to_numpy(zero_copy_only=False)
        texts = pc.fill_null(column.cast(pa.large_string()), "")
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        first = 0
        while first < len(texts):
            last = int(np.searchsorted(offsets, offsets[first] + max_bytes, side="right")) - 1
            last = min(max(last, first + 1), first + max_rows, len(texts))
            part = data[offsets[first] : offsets[last]]
            yield batch.slice(first, last - first), Slice(batch.column(0).slice(first, last - first), part, offsets[first : last + 1] - offsets[first], nulls[first:last])
            first = last


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in this order."""
    return mix(left * U64(0x9FB21C651E98DF25) + (right ^ U64(0x5851F42D4C957F2D)))


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, by the run's first word; runs over the end of a text are included.

    Hashes of runs of 2, 4, 8 ... words are joined from those of half as many, and a run of k from such runs.
    """
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    of_size, size = {1: words}, 1
    while 2 * size <= k:
        of_size[2 * size] = joined(of_size[size][:-size], of_size[size][size:])
        size *= 2
    out, done = of_size[size][:n], size
    while done < k:
        size = 1 << ((k - done).bit_length() - 1)
        out = joined(out, of_size[size][done : done + n])
        done += size
    return out


def sequence_hashes(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each text's whole sequence of words."""
    total = np.zeros(len(words) + 1, U64)
    count = np.diff(first)
    place = np.arange(len(words)) - np.repeat(first[:-1], count)
    np.cumsum(mix(words ^ mix(place.astype(U64) + U64(0xD1342543DE82EF95))), out=total[1:])
    return mix((total[first[1:]] - total[first[:-1]]) ^ mix(count.astype(U64)))


def same_bytes(a: np.ndarray, starts: np.ndarray, b: np.ndarray, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the byte ranges of these sizes that start at ``starts`` in a and at ``others`` in b are equal."""
    unlike = a[ranges(starts, sizes)] != b[ranges(others, sizes)]
    if not unlike.any():
        return np.ones(len(sizes), bool)
    total = np.concatenate([[0], np.cumsum(unlike)])
    ends = np.cumsum(sizes)
    return total[ends] == total[ends - sizes]


def of_text(first: np.ndarray) -> np.ndarray:
    """The text of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def whole_runs(first: np.ndarray, k: int) -> np.ndarray:
    """The starts of runs of k words that lie within one text."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    return ranges(first[:-1], counts)


def ranges(begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (counts[0] of them), begin[1], ..."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(begin - (ends - counts), counts)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def lines(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of all lines, empty ones included, and the number of the first line of each text."""
    feeds = np.flatnonzero(s.data == 0x0A)
    counts = np.searchsorted(feeds, s.offsets[1:]) - np.searchsorted(feeds, s.offsets[:-1]) + 1
    first = np.concatenate([[0], np.cumsum(counts)])
    is_first, is_last = np.zeros(first[-1], bool), np.zeros(first[-1], bool)
    is_first[first[:-1]] = is_last[first[1:] - 1] = True
    starts, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    starts[is_first], starts[~is_first] = s.offsets[:-1], feeds + 1
    ends[is_last], ends[~is_last] = s.offsets[1:], feeds
    return starts, ends, first


class Bits:
    """A fixed-size set of 64-bit hashes that never misses a member; for a cheap first look."""

    def __init__(self, hashes: np.ndarray, size: int):
        self.table = np.zeros(size, bool)
        self.table[(hashes & U64(size - 1)).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        return self.table[(hashes & U64(len(self.table) - 1)).astype(np.int64)]
