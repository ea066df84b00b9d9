"""Blockwise suffix sorting with a difference cover, of a text that fits in a task.

Only the suffixes asked for are sorted, a bucket of them at a time, so beside
the text a task holds the ranks of the cover sample (3 of 7 places) and one
bucket.  A bucket is sorted by its suffixes' first 7 bytes.  Two suffixes
that tie have an offset below 7 at which both stand on sample places (that
is what a difference cover gives), and the ranks there decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

# A perfect difference set: every difference mod 7 is one of two members, once.
PERIOD, COVER = 7, (0, 1, 3)
BUCKET = 1 << 16
PAD = 512
_PLACE = np.full(PERIOD, -1)
_PLACE[list(COVER)] = range(len(COVER))
# OFFSET[r, s]: the least d for which r + d and s + d are both in the cover.
OFFSET = np.array([[min(d for d in range(PERIOD) if (r + d) % PERIOD in COVER and (s + d) % PERIOD in COVER) for s in range(PERIOD)] for r in range(PERIOD)])


def words_at(data: np.ndarray) -> np.ndarray:
    """For each place the 8 bytes from there, as they compare (no copy; unaligned)."""
    return np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))


def _first_bytes(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The first `PERIOD` bytes from each place, as they compare."""
    return words[places].astype(np.uint64) >> np.uint64(64 - 8 * PERIOD)


def _dense(order: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Ranks from 1, equal for equal keys, given the order of the keys."""
    new = np.zeros(len(order), bool)
    key = key[order]
    new[1:] = key[1:] != key[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) + 1
    return out


def cover_ranks(words: np.ndarray, size: int, depth: int) -> np.ndarray:
    """Ranks of the sample places below ``size`` by their next ``depth`` bytes at least, by doubling; 0 behind the last."""
    per = len(COVER)
    place = (np.arange(-(-size // PERIOD))[:, None] * PERIOD + np.array(COVER)).ravel()
    head = _first_bytes(words, place)
    rank = _dense(np.argsort(head, kind="stable"), head)
    seen = PERIOD
    while seen < depth and rank.max(initial=0) < len(rank):
        ahead = np.zeros(len(rank), np.int64)
        step = seen // PERIOD * per
        ahead[:max(0, len(rank) - step)] = rank[step:]
        key = rank * (len(rank) + 1) + ahead
        rank = _dense(np.argsort(key, kind="stable"), key)
        seen *= 2
    return np.concatenate([rank, np.zeros(2 * per, np.int64)])


def sorted_buckets(data: np.ndarray, starts: np.ndarray, depth: int) -> Iterator[np.ndarray]:
    """The suffixes ``starts`` of ``data`` (which ends with `PAD` zeros) by their first ``depth`` bytes, bucket by bucket."""
    words = words_at(data)
    rank = cover_ranks(words, len(data) - PAD + PERIOD, depth)
    head = data[starts].astype(np.uint16) << 8 | data[starts + 1]
    starts = starts[np.argsort(head, kind="stable")]
    edges = np.cumsum(np.bincount(head, minlength=1 << 16))
    first = 0
    while first < len(starts):
        fit = edges[max(np.searchsorted(edges, first + BUCKET, side="right") - 1, 0)]
        last = int(fit) if fit > first else int(edges[np.searchsorted(edges, first, side="right")])
        yield _sorted_bucket(words, rank, starts[first:last])
        first = last


def _sorted_bucket(words: np.ndarray, rank: np.ndarray, places: np.ndarray) -> np.ndarray:
    head = _first_bytes(words, places)
    order = np.argsort(head, kind="stable")
    places, head = places[order], head[order]
    same = head[1:] == head[:-1]
    group = np.concatenate([[0], np.cumsum(~same)])
    tied = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))
    if not len(tied):
        return places
    size = np.int64(len(rank) + 1)
    at, team = places[tied], group[tied]
    kind = at % PERIOD
    members = [np.flatnonzero(kind == r) for r in range(PERIOD)]
    less = np.zeros(len(tied), np.int64)  # how many of its group come before a suffix

    def key(some: np.ndarray, offset: int) -> np.ndarray:
        p = at[some] + offset
        return team[some] * size + rank[p // PERIOD * len(COVER) + _PLACE[p % PERIOD]]

    for r in range(PERIOD):
        if not len(members[r]):
            continue
        begin = np.searchsorted(team[members[r]], np.arange(team[-1] + 2))  # where each group starts among the members
        for s in range(PERIOD):
            if len(members[s]):
                mine = np.sort(key(members[r], OFFSET[r, s]))
                less[members[s]] += np.searchsorted(mine, key(members[s], OFFSET[r, s])) - begin[team[members[s]]]
    places[tied] = at[np.lexsort((less, team))]
    return places


def repeated_windows(parts: list[bytes], counts: list[int], window: int) -> list[np.ndarray]:
    """For each part and each of its windows, whether the window's bytes are met twice; part i stands for counts[i] equal ones."""
    data = np.frombuffer(b"".join(parts) + bytes(PAD), np.uint8)
    size = np.array([len(p) for p in parts], np.int64)
    begin = np.cumsum(size) - size
    n = np.maximum(size - window + 1, 0)
    owner = np.repeat(np.arange(len(parts)), n)
    starts = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + begin[owner]
    weight = np.zeros(len(data), np.int64)
    weight[starts] = np.array(counts, np.int64)[owner]
    hit = np.zeros(len(data), bool)
    words = words_at(data)
    steps = [*range(0, window - 7, 8), window - 8]
    for order in sorted_buckets(data, starts, window):
        equal = np.arange(1, len(order))  # neighbours whose windows are equal
        for k in steps:
            equal = equal[words[order[equal] + k] == words[order[equal - 1] + k]]
        new = np.ones(len(order), np.int64)
        new[equal] = 0
        chain = np.cumsum(new) - 1
        hit[order] = np.bincount(chain, weights=weight[order])[chain] >= 2
    return [hit[b:b + k] for b, k in zip(begin.tolist(), n.tolist())]
