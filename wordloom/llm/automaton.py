"""Deterministic automata from byte-level regular expressions: subset construction and minimisation.

The expression language is what the rules need: literals, ``[...]`` classes
with ranges and ``^``, ``\\xHH`` and ``\\`` escapes, ``(...)`` groups, ``|``,
and the repeats ``? * + {n} {n,} {n,m}``.
"""

from __future__ import annotations

import numpy as np

# Syntax trees: ("set", frozenset of bytes), ("cat", items), ("alt", items), ("star", item), ("opt", item).
ANY = ("set", frozenset(range(256)))


def parse(pattern: str) -> tuple:
    tree, at = _alternatives(pattern, 0)
    if at != len(pattern):
        raise ValueError(f"unbalanced ) at {at} in {pattern!r}")
    return tree


def _alternatives(p: str, at: int):
    ways = []
    while True:
        items = []
        while at < len(p) and p[at] not in "|)":
            item, at = _atom(p, at)
            while at < len(p) and p[at] in "?*+{":
                item, at = _repeat(p, at, item)
            items.append(item)
        ways.append(("cat", tuple(items)))
        if at >= len(p) or p[at] == ")":
            return (ways[0] if len(ways) == 1 else ("alt", tuple(ways))), at
        at += 1


def _byte(p: str, at: int):
    """One byte of a literal or class, with its escapes."""
    if p[at] != "\\":
        if ord(p[at]) > 127:
            raise ValueError("patterns are ASCII; write other bytes as \\xHH")
        return ord(p[at]), at + 1
    if p[at + 1] == "x":
        return int(p[at + 2:at + 4], 16), at + 4
    return ord(p[at + 1]), at + 2


def _atom(p: str, at: int):
    if p[at] == "(":
        tree, at = _alternatives(p, at + 1)
        if at >= len(p):
            raise ValueError(f"missing ) in {p!r}")
        return tree, at + 1
    if p[at] == ".":
        return ANY, at + 1
    if p[at] != "[":
        b, at = _byte(p, at)
        return ("set", frozenset([b])), at
    at += 1
    negative = p[at] == "^"
    at += negative
    members, first = set(), True
    while p[at] != "]" or first:
        first = False
        low, at = _byte(p, at)
        high = low
        if p[at] == "-" and p[at + 1] != "]":
            high, at = _byte(p, at + 1)
        members.update(range(low, high + 1))
    return ("set", frozenset(set(range(256)) - members if negative else members)), at + 1


def _repeat(p: str, at: int, item):
    if p[at] == "?":
        return ("opt", item), at + 1
    if p[at] == "*":
        return ("star", item), at + 1
    if p[at] == "+":
        return ("cat", (item, ("star", item))), at + 1
    end = p.index("}", at)
    low, comma, high = p[at + 1:end].partition(",")
    least = int(low)
    tail = () if not comma else (("star", item),) if not high else (("opt", item),) * (int(high) - least)
    return ("cat", (item,) * least + tail), end + 1


def ignore_case(tree):
    """The tree with ASCII letters in either case."""
    kind, x = tree
    if kind == "set":
        both = {b ^ 32 for b in x if 65 <= b <= 90 or 97 <= b <= 122}
        return "set", frozenset(x | both)
    return (kind, tuple(map(ignore_case, x))) if kind in ("cat", "alt") else (kind, ignore_case(x))


def reverse(tree):
    """The tree of the reversed language."""
    kind, x = tree
    if kind == "set":
        return tree
    if kind == "cat":
        return kind, tuple(reverse(y) for y in reversed(x))
    return (kind, tuple(map(reverse, x))) if kind == "alt" else (kind, reverse(x))


class _Nfa:
    def __init__(self):
        self.eps, self.move = [], []

    def state(self) -> int:
        self.eps.append([])
        self.move.append(None)
        return len(self.eps) - 1

    def add(self, tree, start: int) -> int:
        """Build the tree from ``start``; returns its end state."""
        kind, x = tree
        if kind == "set":
            end = self.state()
            mid = self.state()
            self.eps[start].append(mid)
            self.move[mid] = (x, end)
            return end
        if kind == "cat":
            for y in x:
                start = self.add(y, start)
            return start
        end = self.state()
        if kind == "alt":
            for y in x:
                self.eps[self.add(y, start)].append(end)
            return end
        loop = self.state()
        self.eps[start] += [loop, end]
        self.eps[self.add(x, loop)] += [loop, end] if kind == "star" else [end]
        return end


class Dfa:
    """Transition arrays of the minimal automaton of several expressions at once.

    ``next`` is (states, 256) int32, ``accepts`` holds a bit mask of the
    expressions that end in a state.  State 0 is the start; ``dead`` is the
    state without a way on, or -1.
    """

    def __init__(self, trees: list, anywhere: bool = False):
        nfa = _Nfa()
        start = nfa.state()
        finals = {}
        for i, tree in enumerate(trees):
            first = nfa.state()
            nfa.eps[start].append(first)
            finals[nfa.add(tree, first)] = i
        if anywhere:
            nfa.move[start] = (frozenset(range(256)), start)
        table, accepts = self._subsets(nfa, start, finals)
        self.next, self.accepts = self._minimal(table, accepts)
        stuck = np.flatnonzero((self.next == np.arange(len(self.next))[:, None]).all(1) & (self.accepts == 0))
        self.dead = int(stuck[0]) if len(stuck) else -1

    @staticmethod
    def _subsets(nfa, start, finals):
        closures: dict[int, frozenset] = {}

        def closure(s):
            if s not in closures:
                seen, todo = {s}, [s]
                while todo:
                    for t in nfa.eps[todo.pop()]:
                        if t not in seen:
                            seen.add(t)
                            todo.append(t)
                closures[s] = frozenset(x for x in seen if nfa.move[x] or x in finals)
            return closures[s]

        # Bytes that no set tells apart share a column.
        sets = sorted({m[0] for m in nfa.move if m}, key=sorted)
        signature = [tuple(b in s for s in sets) for b in range(256)]
        classes = {sig: i for i, sig in enumerate(dict.fromkeys(signature))}
        column = np.array([classes[sig] for sig in signature])
        example = [signature.index(sig) for sig in classes]
        number, todo, rows, accepts = {closure(start): 0}, [closure(start)], [], []
        for now in todo:
            accepts.append(sum(1 << finals[s] for s in now if s in finals))
            moves = [nfa.move[s] for s in now if nfa.move[s]]
            row = []
            for b in example:
                to = frozenset().union(*(closure(t) for members, t in moves if b in members))
                if to not in number:
                    number[to] = len(todo)
                    todo.append(to)
                row.append(number[to])
            rows.append(row)
        return np.array(rows, np.int32)[:, column], np.array(accepts, np.int64)

    @staticmethod
    def _minimal(table, accepts):
        """Moore's refinement: split blocks of states until successors agree on their blocks."""
        _, block = np.unique(accepts, return_inverse=True)
        used = np.unique(table, axis=1, return_index=True)[1]
        while True:
            _, finer = np.unique(np.column_stack([block, block[table[:, used]]]), axis=0, return_inverse=True)
            finer = finer.reshape(-1)
            if finer.max() == block.max():
                break
            block = finer
        order = {}
        for b in block:
            order.setdefault(int(b), len(order))
        block = np.array([order[int(b)] for b in block])
        one = np.unique(block, return_index=True)[1]
        return block[table[one]].astype(np.int32), accepts[one]

    def rows(self) -> list[list]:
        """States as nested lists: ``state[byte]`` is the next state, ``state[256]`` its mask, ``state[257]`` whether it is dead."""
        out = [[] for _ in self.next]
        for i, to in enumerate(self.next.tolist()):
            out[i].extend(out[t] for t in to)
            out[i] += [int(self.accepts[i]), i == self.dead]
        return out
