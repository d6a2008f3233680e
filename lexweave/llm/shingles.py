"""Sets of word shingles as 64-bit hashes, for whole Arrow batches of texts at once in numpy.

Words are the runs between ASCII white space, with A-Z in lower case. A text's set holds its distinct ``width``-word
shingles; a text with fewer words has its whole sequence as its one shingle; one without words has none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes that are hashed together; longer texts go in stretches cut at white space.
STRETCH = 1 << 20

_rng = np.random.default_rng(20240229)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES[65:91] = _BYTES[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACES = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _cut(data: np.ndarray, offsets: np.ndarray, at: int, end: int, space: np.ndarray) -> int:
    """The end of the stretch from ``at``: a text's end or the start of white space, if there is one."""
    to = min(at + STRETCH, end)
    if to == end:
        return end
    k = int(np.searchsorted(offsets, to, side="right")) - 1
    if offsets[k] > at:
        return int(offsets[k])
    white = np.flatnonzero(space[data[at:to]])
    if len(white) and white[-1]:
        return at + int(white[-1])
    limit = int(offsets[k + 1])  # one very long word: up to its end
    for start in range(to, limit, STRETCH):
        white = np.flatnonzero(space[data[start : min(start + STRETCH, limit)]])
        if len(white):
            return start + int(white[0])
    return limit


def _word_hashes(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE, first: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word of the texts in ``data``, that of its ``first`` bytes, and how many words each text has."""
    hashes, heads, texts = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        to = _cut(data, offsets, at, end, space)
        part = data[at:to]
        word = ~space[part]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        inner = offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, to, "left")] - at
        begins[inner] = word[inner]  # a text's first byte begins a word, whatever lies before it
        starts = np.flatnonzero(begins)
        if len(starts):
            places = np.flatnonzero(word)
            which = np.cumsum(begins)[places] - 1
            inside = places - starts[which]
            values = _BYTES[part[places]] * _powers(int(inside.max()) + 1)[inside]
            at_word = np.searchsorted(places, starts)
            hashes.append(mix(np.add.reduceat(values, at_word)))
            if first:
                heads.append(mix(np.add.reduceat(np.where(inside < first, values, np.uint64(0)), at_word)))
            texts.append(np.searchsorted(offsets, starts + at, "right") - 1)
        at = to
    counts = np.bincount(np.concatenate(texts), minlength=len(offsets) - 1)
    return np.concatenate(hashes), np.concatenate(heads), counts


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return (np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)), offsets


def shingle_sets(column: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of every text one after the other, and the size of each text's set."""
    if not len(column):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    words, _, counts = _word_hashes(*_buffers(column))
    ends = np.cumsum(counts)
    n = len(words)
    rolled = np.zeros(max(0, n - width + 1), np.uint64)
    for j in range(width):
        rolled += words[j : j + len(rolled)] * _PLACES[j]
    rolled = mix(rolled)
    sets, sizes = [], np.zeros(len(counts), np.int64)
    for i, (count, stop) in enumerate(zip(counts.tolist(), ends.tolist())):
        if count >= width:
            found = np.sort(rolled[stop - count : stop - width + 1])
            found = found[np.r_[True, found[1:] != found[:-1]]]
        elif count:
            # the count takes part, so that a short text's sequence equals no shingle of a longer one
            found = mix(np.sum(words[stop - count : stop] * _PLACES[8 : 8 + count], dtype=np.uint64, keepdims=True) + np.uint64(count))
        else:
            continue
        sets.append(found)
        sizes[i] = len(found)
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), sizes


#: Everything but ASCII letters and the bytes of other letters parts words.
_NOT_LETTERS = np.ones(256, dtype=bool)
_NOT_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def word_hashes(column: pa.Array, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all texts, one after the other: the hash of every word, that of its ``first`` bytes, and each text's count.

    Words are runs of letters here, with A-Z in lower case; signs, digits and white space part them.
    """
    if not len(column):
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)
    return _word_hashes(*_buffers(column), _NOT_LETTERS, first)
