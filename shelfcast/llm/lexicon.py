"""Levenshtein automata met with a lexicon trie; nothing here knows of Spark."""

from __future__ import annotations

import re

LETTERS = re.compile(r"[^\W\d_]+")
CACHE = 1 << 17
WORD, STEM = "word", "stem"


def allowed_errors(term: str) -> int:
    """Edits forgiven in a whole word: none in short ones, so that other words stay apart."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class LexiconAutomaton:
    """All words within the allowed edits of a lexicon, as one automaton, made as it is walked.

    A state is a set of (trie node, edits so far): a step reads a letter as a match, a
    substitution or an insertion, and may skip trie letters as deletions. States and steps are
    remembered, so a word costs one look-up per letter, and most words die after a few. Stems
    match without edits, at the start of a word.
    """

    def __init__(self, entries: list[tuple[str, str, float]]):
        self.children: list[dict[str, int]] = [{}]
        self.words: list[tuple[float, int] | None] = [None]
        self.stems: list[float | None] = [None]
        self.limit = [0]
        for term, kind, weight in entries:
            node, errors = 0, allowed_errors(term) if kind == WORD else 0
            self.limit[0] = max(self.limit[0], errors)
            for letter in term:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.words.append(None)
                    self.stems.append(None)
                    self.limit.append(0)
                node = self.children[node][letter]
                self.limit[node] = max(self.limit[node], errors)
            if kind == WORD:
                self.words[node] = (weight, errors)
            else:
                self.stems[node] = weight
        self.alphabet = {letter for child in self.children for letter in child}
        self.states: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.sets: list[frozenset] = []
        # Of each state: the best stem it has reached, and the best word it ends.
        self.begun: list[float | None] = []
        self.ended: list[tuple[bool, float] | None] = []
        self.dead = self._state({})
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """The number of a state, after all deletions; `nodes` has the fewest edits per node."""
        stack = list(nodes.items())
        while stack:
            node, errors = stack.pop()
            for child in self.children[node].values():
                if errors < self.limit[child] and nodes.get(child, 99) > errors + 1:
                    nodes[child] = errors + 1
                    stack.append((child, errors + 1))
        key = frozenset(nodes.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            self.begun.append(max((self.stems[n] for n, e in key if e == 0 and self.stems[n] is not None), default=None))
            ends = [(e, self.words[n]) for n, e in key if self.words[n] is not None]
            self.ended.append(max(((e == 0, weight) for e, (weight, most) in ends if e <= most), default=None))
        return self.states[key]

    def _step(self, state: int, letter: str) -> int:
        after: dict[int, int] = {}

        def reach(node: int, errors: int) -> None:
            if errors <= self.limit[node] and after.get(node, 99) > errors:
                after[node] = errors

        for node, errors in self.sets[state]:
            for read, child in self.children[node].items():
                reach(child, errors + (read != letter))
            if node or errors == 0:
                reach(node, errors + 1)
        return self._state(after)

    def match(self, word: str) -> tuple[float, bool] | None:
        """(weight, exact) of the best entry the word is, begins with, or misspells."""
        state, stem = self.start, None
        for letter in word:
            after = self.steps[state].get(letter)
            if after is None:
                after = self.steps[state][letter] = self._step(state, letter if letter in self.alphabet else "\0")
            state = after
            if state == self.dead:
                return None if stem is None else (stem, True)
            begun = self.begun[state]
            if begun is not None and (stem is None or begun > stem):
                stem = begun
        ended = self.ended[state]
        if stem is not None and (ended is None or (True, stem) >= ended):
            return stem, True
        return None if ended is None else (ended[1], ended[0])


class WordMatches(dict):
    """(letter runs, matches of those that match) of each white-space token met, remembered up to a bound."""

    def __init__(self, automaton: LexiconAutomaton):
        super().__init__()
        self.automaton = automaton
        # Most tokens match nothing: one value for all of so many runs.
        self.unmatched: dict[int, tuple[int, tuple]] = {}

    def __missing__(self, token: str):
        if len(self) >= CACHE:
            self.clear()
        pieces = LETTERS.findall(token.lower())
        found = tuple(m for piece in pieces if (m := self.automaton.match(piece)))
        value = self[token] = (len(pieces), found) if found else self.unmatched.setdefault(len(pieces), (len(pieces), ()))
        return value
