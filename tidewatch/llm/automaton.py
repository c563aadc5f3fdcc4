"""Suffix automata: every substring of the strings put in is a path from the root."""

from __future__ import annotations

from collections.abc import Hashable, Iterable


class SuffixAutomaton:
    """Of one or several sequences, online; states are numbers, 0 is the root."""

    def __init__(self) -> None:
        self.step: list[dict[Hashable, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]

    def _state(self, step: dict[Hashable, int], link: int, length: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.step) - 1

    def _split(self, before: int, symbol: Hashable) -> int:
        """The state of exactly the longest string of `before` and the symbol; it is cut off from a longer one if need be."""
        target = self.step[before][symbol]
        if self.length[target] == self.length[before] + 1:
            return target
        own = self._state(dict(self.step[target]), self.link[target], self.length[before] + 1)
        self.link[target] = own
        while before >= 0 and self.step[before].get(symbol) == target:
            self.step[before][symbol] = own
            before = self.link[before]
        return own

    def add(self, symbols: Iterable[Hashable]) -> int:
        """Put in one sequence; returns the state where it ends."""
        last = 0
        for symbol in symbols:
            if symbol in self.step[last]:
                last = self._split(last, symbol)
                continue
            new, at = self._state({}, 0, self.length[last] + 1), last
            while at >= 0 and symbol not in self.step[at]:
                self.step[at][symbol] = new
                at = self.link[at]
            if at >= 0:
                self.link[new] = self._split(at, symbol)
            last = new
        return last
