"""Hashes of all words of an Arrow batch at once.

A word is a run of bytes of one class. Its hash is a polynomial in its bytes, taken from one running product over the
segment and divided by the power at its start, so that no Python code runs for single words.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SEGMENT = 1 << 20
BASE = 0x9E3779B97F4A7C15
MIX = np.uint64(0xD6E8FEB86659FD93)
#: Bytes that are no part of a word: ASCII but letters and digits.
SEPARATORS = bytes(c for c in range(128) if not chr(c).isalnum())


def mixed(values: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the whole word."""
    values = values ^ (values >> np.uint64(32))
    values = values * MIX
    values ^= values >> np.uint64(32)
    return values * MIX ^ (values >> np.uint64(29))


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of two neighbours in their order."""
    return mixed(left * np.uint64(3) + np.uint64(0x632BE59BD9B4E019) ^ right)


@lru_cache(maxsize=4)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(size, BASE, np.uint64)
    down = np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


@lru_cache(maxsize=1)
def byte_values() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64))


def byte_class(separators: bytes) -> np.ndarray:
    """Class 0 for the separators, 1 for the other bytes."""
    classes = np.ones(256, np.uint8)
    classes[np.frombuffer(separators, np.uint8)] = 0
    return classes


def ascii_fold() -> np.ndarray:
    """A-Z to a-z, every other byte to itself."""
    fold = np.arange(256, dtype=np.uint8)
    fold[ord("A") : ord("Z") + 1] += 32
    return fold


def segments(data: np.ndarray, starts: np.ndarray, classes: np.ndarray):
    """Parts of about SEGMENT bytes, cut only at a separator or between rows."""
    low, size = 0, len(data)
    while low < size:
        high = low + SEGMENT
        while high < size:
            gaps = np.flatnonzero(classes[data[low:high]] == 0)
            row = starts[max(0, np.searchsorted(starts, high, side="right") - 1)]
            cut = max(low + int(gaps[-1]) + 1 if len(gaps) else low, int(row))
            if cut > low:
                high = cut
                break
            high += SEGMENT
        high = min(high, size)
        yield low, high
        low = high


def hash_words(data: np.ndarray, at: np.ndarray, classes: np.ndarray, fold: np.ndarray | None = None):
    """(hash of each word, first byte of each word, class of each word, first word of each row and the end).

    data, at: as `text_buffer` gives them. classes: by byte; 0 separates, neighbours of unlike class are two words.
    """
    starts, kinds, hashes = [], [], []
    values = byte_values() if fold is None else byte_values()[fold]
    for low, high in segments(data, at[:-1], classes):
        part = data[low:high]
        kind = classes[part]
        edge = np.empty(len(part), bool)
        edge[0] = True
        np.not_equal(kind[1:], kind[:-1], out=edge[1:])
        rows = at[np.searchsorted(at, low) : np.searchsorted(at, high)]
        edge[rows - low] = True
        begin = np.flatnonzero(edge)
        up, down = powers(max(SEGMENT, 1 << (len(part) - 1).bit_length()))
        sums = np.add.reduceat(values[part] * up[: len(part)], begin)
        word = kind[begin] > 0
        begin = begin[word]
        hashes.append(mixed(sums[word] * down[begin]))
        starts.append(begin + low)
        kinds.append(kind[begin])
    if not starts:
        empty = np.empty(0, np.int64)
        return np.empty(0, np.uint64), empty, np.empty(0, np.uint8), np.zeros(len(at), np.int64)
    first = np.concatenate(starts)
    return np.concatenate(hashes), first, np.concatenate(kinds), np.searchsorted(first, at)
