"""Classes of equal prefixes by threshold-bounded interval expansion on a Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The suffixes of the strings laid end to end in ``text``, sorted; ``left`` counts the bytes to each string's end.

    A string ends in a mark of its own, below all bytes and in the order of the strings, so no two
    suffixes are equal. By prefix doubling from 8 bytes on; bytes are counted from 1.
    """
    n = len(text)
    x = text.astype(np.uint64) + np.uint64(1)
    rank = np.zeros(n, np.uint64)
    # Seven symbols of 9 bits fit a word; what lies after the end counts as 0.
    for k in range(7):
        part = np.zeros(n, np.uint64)
        part[: n - k] = x[k:]
        part[left <= k] = 0
        rank = rank << np.uint64(9) | part
    order = np.argsort(rank)
    h, most = 7, int(left.max(initial=0))
    while True:
        key = rank[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        number = np.cumsum(new).astype(np.uint64)
        rank = np.empty(n, np.uint64)
        rank[order] = number
        if h >= most or number[-1] == n:
            return np.argsort(rank << np.uint64(32) | np.arange(n, dtype=np.uint64))
        after = np.zeros(n, np.uint64)
        after[: n - h] = rank[h:]
        after[left <= h] = 0
        rank = rank << np.uint64(32) | after
        order = np.argsort(rank)
        h *= 2


def boundaries(text: np.ndarray, left: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """Marks the suffixes, in sorted order, whose common prefix with the one before is shorter than ``least``.

    Breadth-first by the length of the prefix. The intervals of all prefixes of length l are what the
    splits found so far leave; extending them backward by the bytes that the transform holds in them
    gives those of length l + 1: with p the last row before i with the same byte before its suffix,
    the places LF(p) and LF(i) are neighbours, and are split if an interval ends between p and i.
    Extension stops at ``least``, so longer prefixes cost nothing more.
    """
    n = len(text)
    at = np.empty(n, np.int64)
    at[order] = np.arange(n)
    first, split = text[order], np.ones(n, bool)
    split[1:] = first[1:] != first[:-1]
    start = np.ones(n, bool)
    start[1:] = left[:-1] == 1
    # The rows whose suffix has a byte before it in its string, by that byte, then in order.
    rows = np.flatnonzero(~start[order])
    before = text[order[rows] - 1]
    by_byte = np.argsort(before, kind="stable")  # radix sort
    rows, before = rows[by_byte], before[by_byte]
    image = at[order[rows] - 1]
    alone = np.ones(len(rows), bool)
    alone[1:] = before[1:] != before[:-1]
    last = np.concatenate([[0], rows[:-1]]) if len(rows) else rows
    active = np.flatnonzero(~alone & ~split[image])
    i, p, to = (x[active].astype(np.int32) for x in (rows, last, image))
    for length in range(2, least + 1):
        count = np.cumsum(split, dtype=np.int32)
        hit = count[i] > count[p]
        if length == 2:
            # A suffix of one byte, and the first longer one of its byte, share no more than that byte.
            split[left[order] == 1] = True
            split[image[alone]] = True
        if hit.any():
            split[to[hit]] = True
            stay = ~hit
            i, p, to = i[stay], p[stay], to[stay]
    return split
