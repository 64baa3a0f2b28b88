"""Word shingles of many texts at once, in numpy."""

import numpy as np
import pyarrow as pa

#: Words per shingle.
SHINGLE = 5

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: Bytes of words: digits, letters (A-Z as a-z) and all that is not ASCII; 0 between words.
_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[65:91] += 32
_BYTES[[b for b in range(128) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123)]] = 0


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX_A
    x ^= x >> np.uint64(27)
    x *= _MIX_B
    x ^= x >> np.uint64(31)
    return x


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and the len + 1 offsets between them; null is empty."""
    texts = pa.array(texts).fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and how many words each text has."""
    # A gap after each text keeps words of neighbours apart.
    owner_gap = np.arange(len(offsets) - 1)
    plain = np.zeros(len(data) + len(owner_gap) + 1, np.uint8)
    shift = np.repeat(owner_gap, np.diff(offsets))
    plain[np.arange(len(data)) + shift] = _BYTES[data]
    inside = plain > 0
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(owner_gap), np.int64)
    lengths = ends - starts
    place = np.arange(len(plain)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(plain)]])))
    powers = np.cumprod(np.full(max(int(lengths.max()), 1), _GOLDEN, np.uint64))
    values = mix(np.arange(256, dtype=np.uint64) + _GOLDEN)[plain] * powers[np.minimum(place, len(powers) - 1)]
    values[~inside] = 0
    hashes = mix(np.add.reduceat(values, starts) + lengths.astype(np.uint64))
    bounds = offsets[1:] + owner_gap
    counts = np.diff(np.searchsorted(starts, np.concatenate([[0], bounds])))
    return hashes, counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled shingles of each text in text order, and their numbers.

    A text of fewer words than ``size``, but not none, has one shingle of all
    its words. The nth occurrence of a shingle in a text is a shingle of its
    own, so a text's shingles are distinct.
    """
    numbers = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    total = int(numbers.sum())
    first = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(counts)), numbers)
    begin = first[owner] + np.arange(total) - np.repeat(np.cumsum(numbers) - numbers, numbers)
    end = (first + counts)[owner]
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    value = np.zeros(total, np.uint64)
    for j in range(size):
        value = mix(value * _GOLDEN + np.where(begin + j < end, padded[np.minimum(begin + j, len(words))], np.uint64(j)))
    # Label repeats within a text.
    keyed = value ^ mix(owner.astype(np.uint64) + _GOLDEN)
    order = np.argsort(keyed, kind="stable")
    same = np.zeros(total, bool)
    same[1:] = keyed[order[1:]] == keyed[order[:-1]]
    run = np.arange(total) - np.maximum.accumulate(np.where(same, 0, np.arange(total)))
    occurrence = np.zeros(total, np.uint64)
    occurrence[order] = run.astype(np.uint64)
    return mix(value + occurrence * _GOLDEN), numbers
