"""Sorting of suffixes with a difference cover, in memory, one block at a time.

Every pair of positions i, j has a shift below ``PERIOD`` that takes both to sample
positions, those whose remainder is in ``COVER``. So when the sample suffixes are ranked
beforehand, two suffixes that tie for ``PERIOD`` bytes are told apart by the ranks of two
sample suffixes, however long their tie goes on.
"""

from __future__ import annotations

import numpy as np

PERIOD = 7
COVER = (0, 1, 3)
#: For remainders r, s: the least shift that takes both into the cover.
SHIFT = [
    [next(d for d in range(PERIOD) if (r + d) % PERIOD in COVER and (s + d) % PERIOD in COVER) for s in range(PERIOD)]
    for r in range(PERIOD)
]


def _leading(text: np.ndarray) -> np.ndarray:
    """The ``PERIOD`` bytes from each position on as one number; past the end are zeros."""
    padded = np.concatenate([text, np.zeros(PERIOD, np.uint8)]).astype(np.uint64)
    key = np.zeros(len(text), np.uint64)
    for k in range(PERIOD):
        key = key << np.uint64(8) | padded[k : k + len(text)]
    return key


def _names(keys: np.ndarray) -> np.ndarray:
    """The rank of each key among the different ones."""
    order = np.argsort(keys)
    ordered = keys[order]
    names = np.empty(len(keys), np.int64)
    names[order] = np.cumsum(np.append(False, ordered[1:] != ordered[:-1]))
    return names


def sample_ranks(text: np.ndarray) -> np.ndarray:
    """For every sample position, the rank of its suffix among the sample's, by doubling; -1
    at other positions. One entry for each position, and ``PERIOD`` more past the end."""
    n = len(text)
    at = np.flatnonzero(np.isin(np.arange(n) % PERIOD, COVER))
    ranks = np.full(n + PERIOD, -1, np.int64)
    ranks[at] = _names(_leading(text)[at] << np.uint64(3) | np.minimum(n - at, PERIOD).astype(np.uint64))
    reach = PERIOD
    while len(at) and ranks[at].max() + 1 < len(at):
        follow = ranks[np.minimum(at + reach, n)] + 1
        ranks[at] = _names(ranks[at] << 32 | follow)
        reach *= 2
    return ranks


def sort_suffixes(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The order of the suffixes at ``starts``, none of which is shorter than ``PERIOD``.

    They are grouped by their first ``PERIOD`` bytes. Within a remainder, one shift fits all
    pairs, so a sort by (group, rank there) orders them; between two remainders another
    shift does, by which the place of each among the other's suffixes is looked up.
    """
    ranks = sample_ranks(text)
    group = _names(_leading(text)[starts]) << 32
    lists = []
    for r in range(PERIOD):
        own = np.flatnonzero(starts % PERIOD == r)
        lists.append(own[np.argsort(group[own] | ranks[starts[own] + SHIFT[r][r]] + 1, kind="stable")])
    place = np.empty(len(starts), np.int64)
    for r, own in enumerate(lists):
        before = np.arange(len(own))
        for s, other in enumerate(lists):
            if s != r and len(other) and len(own):
                shift = SHIFT[r][s]
                mine = group[own] | ranks[starts[own] + shift] + 1
                theirs = group[other] | ranks[starts[other] + shift] + 1
                before = before + np.searchsorted(theirs, mine, side="right" if s < r else "left")
        place[own] = before
    order = np.empty(len(starts), np.int64)
    order[place] = np.arange(len(starts))
    return order


def equal_neighbours(text: np.ndarray, ordered: np.ndarray, length: int) -> np.ndarray:
    """Of suffixes in order: whether each has the same first ``length`` bytes as the one before."""
    same = np.zeros(len(ordered), bool)
    if len(ordered) < 2:
        return same
    same[1:] = True
    words = np.lib.stride_tricks.sliding_window_view(text, 8) if len(text) >= 8 else None
    left = np.arange(1, len(ordered))
    steps = [*range(0, length - 7, 8), length - 8] if length >= 8 else range(length)
    for k in steps:
        a, b = ordered[left] + k, ordered[left - 1] + k
        if length >= 8:
            equal = (words[a].view(np.uint64) == words[b].view(np.uint64))[:, 0]
        else:
            equal = text[a] == text[b]
        same[left[~equal]] = False
        left = left[equal]
    return same
