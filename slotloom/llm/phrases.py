"""Phrases: ids that often stand side by side in a chunk become symbols of their own, so that a coder has fewer and likelier ones to code.

The symbols of a chunk are its different ids in order, then its phrases, pairs of symbols before them, found in ``ROUNDS``: each counts
all pairs and takes those that occur most. Nothing is lost: every symbol stands for its ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Most phrases of each round, and how often a phrase occurs at least: it takes 8 bytes of the file.
ROUNDS, LEAST = (8192, 4096), 16
#: Symbols of a chunk, so that a pair of them has 32 bits; and bits of the table of phrases, where the most frequent one keeps its cell.
_MOST, _BITS = 1 << 16, 18
#: Pairs that are looked up together: what they need stays in a core's cache.
_TOGETHER = 1 << 15


def _cells(pairs: np.ndarray) -> np.ndarray:
    return pairs * np.uint32(2654435761) >> np.uint32(32 - _BITS)


def _round(symbols: np.ndarray, known: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols with at most ``most`` new phrases put in from left to right, and these as pairs."""
    pairs = symbols[:-1] << np.uint32(16) | symbols[1:]
    order = np.sort(pairs)
    starts = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]]))
    times = np.diff(starts, append=len(order))
    often = np.flatnonzero(times >= LEAST)
    often = often[np.argsort(-times[often], kind="stable")[:most]]
    phrases = order[starts[often]]
    phrases = phrases[np.sort(np.unique(_cells(phrases), return_index=True)[1])]
    if not len(phrases):
        return symbols, phrases
    del order, starts, times, often
    table, number = np.zeros(1 << _BITS, np.uint32), np.zeros(1 << _BITS, np.uint32)
    table[0] = 1  # whose cell is another one; 0, which all other empty cells hold, has cell 0
    table[_cells(phrases)], number[_cells(phrases)] = phrases, known + np.arange(len(phrases), dtype=np.uint32)
    parts = (pairs[a : a + _TOGETHER] for a in range(0, len(pairs), _TOGETHER))
    at = np.flatnonzero(np.concatenate([table.take(_cells(p)) == p for p in parts]))
    # where they overlap, every other one of a row of them
    first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    at = at[(np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))) & 1 == 0]
    out, stay = symbols.copy(), np.ones(len(symbols), bool)
    out[at], stay[at + 1] = number.take(_cells(pairs[at])), False
    return out[stay], phrases


def shorten(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of a chunk's ids; its different ids; its phrases, a row for each with the two symbols that it stands for."""
    different = np.flatnonzero(np.bincount(ids))
    place = np.zeros(different[-1] + 1 if len(different) else 0, np.uint32)
    place[different] = np.arange(len(different), dtype=np.uint32)
    symbols, found, known = place.take(ids), [np.empty(0, np.uint32)], len(different)
    for most in ROUNDS:
        most = min(most, _MOST - known)
        if most <= 0 or len(symbols) < 2:
            break
        symbols, phrases = _round(symbols, known, most)
        found.append(phrases)
        known += len(phrases)
    phrases = np.concatenate(found)
    return symbols, different.astype(np.uint32), np.stack([phrases >> np.uint32(16), phrases & np.uint32(0xFFFF)], axis=1)


def restore(symbols: np.ndarray, different: np.ndarray, phrases: np.ndarray) -> np.ndarray:
    """The ids that ``symbols`` stand for."""
    stands = [i.tobytes() for i in different.astype("<u4")]
    for a, b in phrases.tolist():
        if max(a, b) >= len(stands):
            raise ValueError("a phrase holds a symbol that is not before it")
        stands.append(stands[a] + stands[b])
    if not len(symbols):
        return np.empty(0, np.uint32)
    if symbols.max() >= len(stands):
        raise ValueError("a symbol is not in the chunk's tables")
    ids = pa.array(stands, pa.large_binary()).take(pa.array(symbols))
    end = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)[-1]
    return np.frombuffer(ids.buffers()[2], "<u4", end // 4)
