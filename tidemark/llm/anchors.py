"""Content-defined anchors of fixed-length windows.

A window is a run of ``length`` consecutive units (words or bytes) of one
document. A chooser names, for every window, one anchor inside it, looking at
the window's content only: equal windows choose alike, so they meet under equal
anchor keys. Consecutive windows that choose the same anchor form a run; runs
are what operators shuffle, about one for several words or dozens of bytes.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import text as tx


@dataclass
class Runs:
    """Runs of windows, in order of document and place."""

    doc: np.ndarray  #: document of each run
    start: np.ndarray  #: first window, as a unit's number in the flat sequence
    count: np.ndarray  #: windows
    key: np.ndarray  #: name of the anchor's fixed surroundings, part of every window of the run
    whole: np.ndarray  #: name of all that the run's windows cover, and of the anchor's place in it


def runs_of(place: np.ndarray, key: np.ndarray, starts: np.ndarray, doc: np.ndarray, length: int, prints: tx.Prints) -> Runs:
    """From each window's chosen anchor (its place in the flat sequence, and its key)."""
    if not len(starts):
        none = np.empty(0, dtype=np.int64)
        return Runs(none, none, none, none.view(tx.U64), none.view(tx.U64))
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    start = starts[first]
    whole = prints.of(start, start + count - 1 + length) + tx.mix((place[first] - start).astype(tx.U64))
    return Runs(doc[first], start, count, key[first], whole)


def window_starts(off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Flat starts of all windows, and their documents."""
    n = np.maximum(np.diff(off) - length + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + off[:-1][doc], doc


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values (block prefixes and suffixes, two passes)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, dtype=values.dtype)
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[: len(values)] = values
    shaped = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(shaped[:, ::-1], axis=1)[:, ::-1].ravel()  # to the end of the block
    behind = np.minimum.accumulate(shaped, axis=1).ravel()  # from the beginning of the block
    return np.minimum(ahead[:n], behind[width - 1: width - 1 + n])


class ByteAnchors:
    """Anchor of a byte window: the q-gram of the least hash (the first such) among the first ``spread`` places."""

    def __init__(self, length: int, spread: int, gram: int) -> None:
        self.length, self.spread, self.gram = length, spread, gram

    def runs(self, buf: np.ndarray, off: np.ndarray) -> tuple[Runs, tx.Prints]:
        prints = tx.Prints(buf)
        starts, doc = window_starts(off, self.length)
        if not len(starts):
            return runs_of(starts, starts, starts, doc, self.length, prints), prints
        grams = tx.Prints(buf, 1).fixed(self.gram)
        bits = len(grams).bit_length()
        ranked = (grams >> tx.U64(bits) << tx.U64(bits)) | np.arange(len(grams), dtype=tx.U64)
        place = (sliding_least(ranked, self.spread)[starts] & tx.U64((1 << bits) - 1)).astype(np.int64)
        fixed = self.length - self.spread + 1
        key = tx.Prints(buf, 2).of(place, place + fixed)
        return runs_of(place, key, starts, doc, self.length, prints), prints


class WordAnchors:
    """Anchor of a word window by recompression.

    Rounds replace runs of one symbol, then pairs of symbols, by new symbols
    whose names are computed from the parts' names, so that equal substrings
    get equal interior symbols everywhere. A pair is formed where the left
    symbol's coin of the round shows 0 and the right one's 1. ``lo`` and ``hi``
    hold the words that a symbol's name and borders depend on: a symbol whose
    span lies inside a window is found wherever the window's words stand. A
    window chooses, among its symbols of the highest level that has any, the
    one of the least hash (the first such).
    """

    def __init__(self, length: int, rounds: int) -> None:
        self.length, self.rounds = length, rounds

    def levels(self, names: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(symbol, lo, hi) after each number of rounds; lo or hi beyond the document if its edge decided."""
        sym = names
        lo = np.arange(len(names))
        hi = lo.copy()
        doc = tx.owner(off)
        begin, end = off[:-1], off[1:] - 1
        out = [(sym, lo, hi)]
        for r in range(self.rounds):
            # runs of one symbol; whether a neighbour joins depends on it
            new = np.ones(len(sym), dtype=bool)
            new[1:] = (sym[1:] != sym[:-1]) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(sym)) - 1
            n = last - first + 1
            lo, hi = beside(lo, hi, doc, first, last, begin, end)
            sym = np.where(n > 1, tx.mix(sym[first] ^ tx.mix(n.astype(tx.U64) + tx.U64(r << 40))), sym[first])
            doc = doc[first]
            # pairs
            coin = (tx.mix(sym + tx.U64(0xA24BAED4963EE407 * (r + 1) & (1 << 64) - 1)) >> tx.U64(63)).astype(bool)
            same = doc[1:] == doc[:-1]
            left = np.zeros(len(sym), dtype=bool)
            left[:-1] = same & ~coin[:-1] & coin[1:]
            right = np.zeros(len(sym), dtype=bool)
            right[1:] = left[:-1]
            alone_lo = np.where(coin, shifted(lo, doc, begin, -1), lo)  # a right-hand symbol depends on the one before
            alone_hi = np.where(coin, hi, shifted(hi, doc, end, 1))
            heads = np.flatnonzero(~right)
            paired = left[heads]
            after = np.minimum(heads + 1, len(sym) - 1) if len(sym) else heads
            lo = np.where(paired, lo[heads], alone_lo[heads])
            hi = np.where(paired, hi[after], alone_hi[heads])
            sym = np.where(paired, tx.mix(sym[heads] * tx.U64(3) + tx.mix(sym[after] + tx.U64(r + 1))), sym[heads])
            doc = doc[heads]
            out.append((sym, lo, hi))
        return out

    def runs(self, names: np.ndarray, off: np.ndarray) -> tuple[Runs, tx.Prints]:
        prints = tx.Prints(names)
        starts, doc = window_starts(off, self.length)
        place = np.full(len(starts), -1)
        key = np.zeros(len(starts), dtype=tx.U64)
        surroundings = tx.Prints(names, 1)
        for level, (sym, lo, hi) in reversed(list(enumerate(self.levels(names, off)))):
            open_ = np.flatnonzero(place < 0)
            if not len(open_):
                break
            inside = (hi - lo < self.length) & (lo >= 0) & (hi < len(names))
            sym, lo, hi = sym[inside], lo[inside], hi[inside]
            named = tx.mix(surroundings.of(lo, hi + 1) + tx.mix(sym + tx.U64(level)))
            s = starts[open_]
            a, b = np.searchsorted(lo, s), np.searchsorted(hi, s + self.length, side="left")  # symbols a..b-1 fit
            best = np.full(len(s), -1)
            value = np.full(len(s), np.iinfo(np.uint64).max, dtype=tx.U64)
            for k in range(int((b - a).max()) if len(s) else 0):
                at = np.minimum(a + k, len(named) - 1)
                better = (a + k < b) & ((named[at] < value) | (best < 0))
                best = np.where(better, at, best)
                value = np.where(better, named[at], value)
            ok = best >= 0
            place[open_[ok]] = lo[best[ok]]
            key[open_[ok]] = value[ok]
        return runs_of(place, key, starts, doc, self.length, prints), prints


def shifted(values: np.ndarray, doc: np.ndarray, edge: np.ndarray, by: int) -> np.ndarray:
    """The neighbour's value, or a place just beyond the document's edge."""
    out = np.empty_like(values)
    if by < 0:
        out[1:] = values[:-1]
        at_edge = np.ones(len(values), dtype=bool)
        at_edge[1:] = doc[1:] != doc[:-1]
    else:
        out[:-1] = values[1:]
        at_edge = np.ones(len(values), dtype=bool)
        at_edge[:-1] = doc[1:] != doc[:-1]
    out[at_edge] = edge[doc[at_edge]] + by
    return out


def beside(lo: np.ndarray, hi: np.ndarray, doc: np.ndarray, first: np.ndarray, last: np.ndarray, begin: np.ndarray,
           end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of runs first..last with their neighbours' spans."""
    return shifted(lo, doc, begin, -1)[first], shifted(hi, doc, end, 1)[last]
