"""Many texts at once as arrays of letters: marks of their letters, keys of their grams, common subsequences."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np

#: counters of grams and of lengths; two that share one make something look more frequent than it is, which changes plans alone
GRAM_SLOTS, LENGTH_SLOTS = 1 << 18, 1 << 16
#: longest prefix whose grams are taken two by two, and three by three
PAIRED, TRIPLED = 12, 4
#: as many texts of two lengths in one block make three grams at a time worth their keys
MANY = 100_000
_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mixed(*parts) -> np.ndarray:
    """One 64-bit hash of several numbers or arrays of them."""
    out = np.zeros(1, np.uint64)
    for part in parts:
        out = (out ^ np.asarray(part, np.uint64)) * _FIRST
        out = (out ^ (out >> np.uint64(29))) * _SECOND
        out = out ^ (out >> np.uint64(32))
    return out


def _letters(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _lengths(texts: list[str]) -> np.ndarray:
    return np.fromiter(map(len, texts), np.int64, len(texts))


def _occurrences(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """How often each value stood before in its row."""
    order = np.lexsort((values, rows))
    starts = np.ones(len(order), bool)
    starts[1:] = (rows[order][1:] != rows[order][:-1]) | (values[order][1:] != values[order][:-1])
    place = np.arange(len(order))
    out = np.empty(len(order), np.int64)
    out[order] = place - np.maximum.accumulate(np.where(starts, place, 0))
    return out


def letter_marks(texts: list[str]) -> np.ndarray:
    """64 bits for the letters of each text, a repeated one counted by its occurrence.

    A bit that only one of two texts has stands for at least one letter that the other lacks, whatever letters share a bit.
    """
    rows, codes = np.repeat(np.arange(len(texts)), _lengths(texts)), _letters(texts)
    out = np.zeros(len(texts), np.uint64)
    np.bitwise_or.at(out, rows, np.uint64(1) << (mixed(codes, _occurrences(rows, codes)) >> np.uint64(58)))
    return out.view(np.int64)


def _common(left: np.ndarray, right: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """``common_subsequences`` of texts with up to 63 letters, one word operation per letter on the right."""
    width, steps = next(w for w in (8, 16, 32, 64) if w >= n.max()), int(m.max())
    a = left.astype(f"U{width}").view(np.uint32).reshape(len(left), width)
    b = right.astype(f"U{max(steps, 1)}").view(np.uint32).reshape(len(right), -1)
    whole = (np.uint64(1) << n.astype(np.uint64)) - np.uint64(1)
    row = whole.copy()
    for j in range(steps):
        where = np.packbits(a == b[:, j:j + 1], axis=1, bitorder="little").view(f"<u{width // 8}")[:, 0]
        hit = np.where(j < m, row & where, 0).astype(np.uint64)  # bits beyond a text's own letters are not in its row
        row = (row + hit | row - hit) & whole
    return n - np.bitwise_count(row)


def common_subsequences(left: list[str], right: list[str], one_by_one) -> np.ndarray:
    """Length of the longest common subsequence of every pair; ``one_by_one`` is asked for pairs with very long texts."""
    out = np.empty(len(left), np.int64)
    n, m = _lengths(left), _lengths(right)
    longest = np.maximum(n, m)
    for i in np.flatnonzero(longest > 63):
        out[i] = one_by_one(left[i], right[i])
    some = np.argsort(longest, kind="stable")[:np.count_nonzero(longest < 64)]
    a, b = np.array(left, object), np.array(right, object)
    for part in (some[i:i + 4096] for i in range(0, len(some), 4096)):
        out[part] = _common(a[part], b[part], n[part], m[part])
    return out


def _shown(texts: list[str], n: int) -> np.ndarray:
    """The grams of texts of one length, a row each: neighbouring letters with their occurrence; one letter or none is its own gram."""
    codes = _letters(texts).reshape(len(texts), n).astype(np.uint64)
    if n < 2:
        return mixed(codes, 1 << 40) if n else np.full((len(texts), 1), 1 << 41, np.uint64)
    raw = codes[:, :-1] << np.uint64(32) | codes[:, 1:]
    times = _occurrences(np.repeat(np.arange(len(texts)), n - 1), raw.ravel())
    return mixed(raw, times.reshape(raw.shape))


def _by_length(texts: list[str], blocks: list[np.ndarray], spaces: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(letters, places, grams, homes)`` for every length: texts repeated for each block they are in, the home of one being its block
    and space."""
    lengths, counts = _lengths(texts), np.fromiter(map(len, blocks), np.int64, len(blocks))
    for n in np.unique(lengths):
        of = np.flatnonzero((lengths == n) & (counts > 0))
        if len(of):
            again = np.repeat(np.arange(len(of)), counts[of])
            homes = mixed(np.concatenate([blocks[i] for i in of]), spaces[of][again])
            yield int(n), of[again], _shown([texts[i] for i in of], int(n))[again], homes


def _slot(homes: np.ndarray, what, slots: int) -> np.ndarray:
    return (mixed(homes, what) & np.uint64(slots - 1)).astype(np.int64)


def frequencies(texts: list[str], blocks: list[np.ndarray], spaces: np.ndarray, grams: np.ndarray, lengths: np.ndarray) -> None:
    """Add to the counters how many texts of its blocks show each gram and have each length."""
    for n, _, shown, homes in _by_length(texts, blocks, spaces):
        grams += np.bincount(_slot(homes[:, None], shown, GRAM_SLOTS).ravel(), minlength=GRAM_SLOTS)
        lengths += np.bincount(_slot(homes, n, LENGTH_SLOTS), minlength=LENGTH_SLOTS)


def gram_keys(texts: list[str], blocks: list[np.ndarray], spaces: np.ndarray, grams: np.ndarray, lengths: np.ndarray,
              alike: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(places, keys, partners)``: on which keys each text meets every text of its blocks that is at least ``alike`` to it, and how many
    letters that one has.

    For partners of each length there are: the rarest grams, two or three at a time where that many are shared. With s grams shared,
    all but s - j of a text's grams hold the j of them that come first in any common order.
    """
    found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for n, places, shown, homes in _by_length(texts, blocks, spaces):
        often = grams[_slot(homes[:, None], shown, GRAM_SLOTS)]
        order = np.lexsort((shown, often), axis=1)
        shown, often = np.take_along_axis(shown, order, 1), np.take_along_axis(often, order, 1)
        own = lengths[_slot(homes, n, LENGTH_SLOTS)]
        for m in range(math.ceil(n * alike / (2 - alike) - 1e-9), math.floor(n * (2 - alike) / alike + 1e-9) + 1):
            letters, (low, high) = math.ceil(alike * (n + m) / 2 - 1e-9), sorted((n, m))
            if letters > low:
                continue
            shared = max(3 * letters - n - m - 1, 1)
            first, longest = max(n - shared, 1), high - shared
            others = lengths[_slot(homes, m, LENGTH_SLOTS)]
            partners = others > (n == m)
            many = (own + others > MANY) & (shared >= 3) & (longest <= TRIPLED)
            two = shared >= 2 and longest < PAIRED
            for here, at_once in ((partners & many, 3), (partners & ~many, 2 if two else 1)):
                here = np.flatnonzero(here)
                if not len(here):
                    continue
                base = mixed(homes[here], low, high, at_once)
                for some in combinations(range(first + at_once - 1), at_once):
                    # a gram that no other text of the block has finds nobody
                    met = often[here, some[0]] > 1
                    found.append((places[here[met]], mixed(base[met], *[shown[here[met], i] for i in some]), np.full(np.count_nonzero(met), m)))
    places, keys, partners = (np.concatenate(x) for x in zip(*found))
    return places, keys.view(np.int64), partners
