"""A suffix automaton over several word sequences, with the number of occurrences of every substring."""

from __future__ import annotations

import numpy as np


class SuffixAutomaton:
    """States are classes of substrings with the same ends; ``count`` adds up the weights of a class's occurrences."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.weight = [-1], [0], [0]
        self.count: np.ndarray | None = None

    def _new(self, length: int, link: int, to: dict) -> int:
        self.next.append(to)
        self.length.append(length)
        self.link.append(link)
        self.weight.append(0)
        return len(self.next) - 1

    def _split(self, p: int, word, q: int) -> int:
        """The class of q's strings that end at p's strings and the word: q itself, or a new class cut off from it."""
        if self.length[p] + 1 == self.length[q]:
            return q
        part = self._new(self.length[p] + 1, self.link[q], self.next[q].copy())
        self.link[q] = part
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = part
            p = self.link[p]
        return part

    def add(self, words: list, weight: int = 1) -> None:
        """Add a sequence that occurs ``weight`` times."""
        last = 0
        for word in words:
            known = self.next[last].get(word)
            if known is not None:
                last = self._split(last, word, known)
            else:
                new = self._new(self.length[last] + 1, 0, {})
                p = last
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, word, self.next[p][word])
                last = new
            self.weight[last] += weight

    def finish(self) -> None:
        """Sum the weights of every class over all longer strings that end with its strings."""
        count = np.array(self.weight, np.int64)
        link = np.array(self.link)
        length = np.array(self.length)
        order = np.argsort(-length, kind="stable")
        edge = np.flatnonzero(np.diff(length[order])) + 1
        for states in np.split(order, edge):  # longest first; states of a length don't link to each other
            own = states[link[states] >= 0]
            np.add.at(count, link[own], count[own])
        self.count = count

    def repeated(self, words: list, window: int) -> list[bool]:
        """Matching statistics cut at the window: for each window of the sequence, whether it occurs at least twice."""
        out, state, matched = [], 0, 0
        to, link, length, count = self.next, self.link, self.length, self.count
        for i, word in enumerate(words):
            while state and word not in to[state]:
                state = link[state]
                matched = length[state]
            nxt = to[state].get(word)
            if nxt is None:
                matched = 0
            else:
                state, matched = nxt, matched + 1
            while state and length[link[state]] >= window:
                state = link[state]
                matched = length[state]
            if i >= window - 1:
                out.append(matched >= window and count[state] >= 2)
        return out
