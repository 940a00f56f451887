"""Generalised suffix automaton over sequences of hashable symbols."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

ROOT = 0


class SuffixAutomaton:
    """All substrings of the sequences added, each reachable from ``ROOT``.

    ``go[s]`` maps a symbol to the next state, ``link[s]`` leads to the state
    of the longest proper suffix in another class and ``length[s]`` is the
    length of the state's longest string. ``add`` gives the state whose
    longest string is the sequence added, which stays so when more are added.
    """

    def __init__(self, sequences: Iterable[Sequence] = ()):
        self.go: list[dict] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        for x in sequences:
            self.add(x)

    def add(self, sequence: Sequence) -> int:
        state = ROOT
        for symbol in sequence:
            state = self._extend(state, symbol)
        return state

    def _new(self, length: int, link: int, go: dict) -> int:
        self.go.append(go)
        self.link.append(link)
        self.length.append(length)
        return len(self.go) - 1

    def _split(self, p: int, symbol, q: int) -> int:
        """The state of ``p``'s longest string followed by ``symbol``."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.go[q]))
        self.link[q] = clone
        while p != -1 and self.go[p].get(symbol) == q:
            self.go[p][symbol] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, symbol) -> int:
        q = self.go[last].get(symbol)
        if q is not None:
            return self._split(last, symbol, q)
        state = self._new(self.length[last] + 1, ROOT, {})
        p = last
        while p != -1 and symbol not in self.go[p]:
            self.go[p][symbol] = state
            p = self.link[p]
        if p != -1:
            self.link[state] = self._split(p, symbol, self.go[p][symbol])
        return state

    def step(self, state: int, length: int, symbol) -> tuple[int, int]:
        """State and length of the longest match that ends with ``symbol``."""
        go, link = self.go, self.link
        while symbol not in go[state]:
            state = link[state]
            if state == -1:
                return ROOT, 0
            length = self.length[state]
        return go[state][symbol], length + 1

    def nearest(self, marked) -> list[int]:
        """For each state, the first marked state on its suffix path, itself included; ROOT if none."""
        order = sorted(range(1, len(self.go)), key=self.length.__getitem__)
        out = [ROOT] * len(self.go)
        for s in order:
            out[s] = s if s in marked else out[self.link[s]]
        return out
