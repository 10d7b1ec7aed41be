"""Repeated substrings of a minimum length, by threshold-bounded interval expansion on a Burrows-Wheeler transform.

The suffixes of a text are sorted by their first symbols, at least as many as the minimum length; the transform's
LF mapping extends an interval of suffixes that share a prefix W to those that share cW. Breadth-first extension from the
empty prefix meets the boundaries between intervals in the order of their common prefixes, 0, 1, 2 and so on, and stops
at the minimum length: boundaries not met by then lie between suffixes that share at least that many symbols.
"""

from __future__ import annotations

import numpy as np


def sorted_rotations(data: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all rotations, ordered by their first symbols, `depth` at least; prefix doubling from eight bytes."""
    n = len(data)
    key = np.zeros(n, np.uint64)
    wrapped = np.resize(data, n + 8) if n < 8 else np.concatenate([data, data[:8]])
    for k in range(8):
        key = (key << np.uint64(8)) | wrapped[k : k + n]
    order = np.argsort(key, kind="stable")
    held = key[order]
    fresh = np.ones(n, bool)
    fresh[1:] = held[1:] != held[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))  # a rank is the place of its first
    done = 8
    while done < depth:
        same = np.zeros(n, bool)
        same[:-1] = ~fresh[1:]
        same[1:] |= ~fresh[1:]
        open_ = np.flatnonzero(same)  # only places whose order isn't settled
        if not len(open_):
            break
        starts = order[open_]
        first = rank[starts]
        second = rank[(starts + done) % n]
        place = np.lexsort((second, first)) if n >= 1 << 31 else np.argsort(first << np.int64(32) | second, kind="stable")
        starts, first, second = starts[place], first[place], second[place]
        order[open_] = starts
        apart = np.ones(len(open_), bool)
        apart[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        fresh[open_] = apart
        rank[starts] = np.maximum.accumulate(np.where(apart, open_, 0))
        done *= 2
    return order


def boundaries(data: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """For i from 0 to n: whether rotations i - 1 and i of the order share fewer than `least` symbols (true at both ends)."""
    n = len(data)
    transform = data[order - 1]
    by_symbol = np.argsort(transform, kind="stable")
    forward = np.empty(n, np.int64)
    forward[by_symbol] = np.arange(n)
    symbol_at = transform[by_symbol]
    met = np.zeros(n + 1, bool)
    met[0] = met[n] = True
    changes = np.ones(n, bool)
    changes[:-1] = symbol_at[1:] != symbol_at[:-1]  # last place of its symbol
    low, high = np.array([0]), np.array([n])
    owner = np.full(n + 1, -1, np.int64)
    for _ in range(least):
        if not len(low):
            break
        size = high - low
        total = int(size.sum())
        mine = np.repeat(np.arange(len(low)), size)
        at = np.arange(total) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
        to = forward[at]
        if total * 8 > n:
            owner[to] = mine
            last = (owner[:-1] >= 0) & ((owner[:-1] != owner[1:]) | changes)
            ends = np.flatnonzero(last)
            begin = owner[:-1] >= 0
            begin[1:] &= (owner[1:-1] != owner[:-2]) | changes[:-1]
            starts = np.flatnonzero(begin)
            owner[to] = -1
        else:
            place = np.argsort(to)
            to, mine = to[place], mine[place]
            split = np.ones(total, bool)
            split[:-1] = (to[1:] != to[:-1] + 1) | (mine[1:] != mine[:-1]) | changes[to[:-1]]
            ends = to[split]
            begin = np.ones(total, bool)
            begin[1:] = split[:-1]
            starts = to[begin]
        new = ~met[ends + 1]
        low, high = starts[new], ends[new] + 1
        met[high] = True
    return met


def repeated(texts: list[bytes], weights: list[int], least: int) -> list[np.ndarray]:
    """For each text, whether the string of `least` bytes at each of its starts occurs again, in any text or by weight.

    A text's weight is the number of times that it stands for. Strings never cross from text to text.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    edge = np.concatenate([[0], np.cumsum(lengths)])
    starts = np.maximum(lengths - least + 1, 0)
    if not starts.any():
        return [np.zeros(0, bool) for _ in texts]
    weight = np.repeat(np.array(weights, np.int64), lengths)
    offset = np.arange(len(data)) - np.repeat(edge[:-1], lengths)
    weight[offset >= np.repeat(starts, lengths)] = 0
    order = sorted_rotations(data, least)
    run = np.flatnonzero(boundaries(data, order, least)[:-1])
    times = np.add.reduceat(weight[order], run)
    many = np.repeat(times >= 2, np.diff(np.append(run, len(data))))
    found = np.zeros(len(data), bool)
    found[order[many]] = True
    return [found[a : a + n] for a, n in zip(edge[:-1].tolist(), starts.tolist(), strict=True)]
