"""Automata over many terms, built once in each worker from a list that is sent there once."""

from __future__ import annotations

import uuid
from collections import OrderedDict

from pyspark.sql import SparkSession

#: Automata that a worker keeps.
KEPT = 4
_BUILT: OrderedDict = OrderedDict()


class Terms:
    """A bounded list of different terms, none empty; a term's value is its place in the list."""

    def __init__(self, spark: SparkSession, terms: list[str]):
        self.name, self.some, self.shared = uuid.uuid4().hex, bool(terms), spark.sparkContext.broadcast(terms)

    def automaton(self):
        """In a task: the Aho-Corasick automaton of the terms."""
        import ahocorasick

        if self.name not in _BUILT:
            own = ahocorasick.Automaton()
            for i, term in enumerate(self.shared.value):
                own.add_word(term, i)
            own.make_automaton()
            _BUILT[self.name] = own
            while len(_BUILT) > KEPT:
                _BUILT.popitem(last=False)
        _BUILT.move_to_end(self.name)
        return _BUILT[self.name]

    def held(self, text: str | None) -> set[int]:
        """All terms that text contains."""
        return {i for _, i in self.automaton().iter(text)} if self.some and text else set()

    def leftmost(self, text: str) -> list[tuple[int, int]]:
        """Where terms begin and end that do not overlap: from the left, of those that begin at one place the longest."""
        if not (self.some and text):
            return []
        terms, longest, out, at = self.shared.value, {}, [], 0
        for end, i in self.automaton().iter(text):
            start = end + 1 - len(terms[i])
            longest[start] = max(end + 1, longest.get(start, 0))
        for start in sorted(longest):
            if start >= at:
                at = longest[start]
                out.append((start, at))
        return out
