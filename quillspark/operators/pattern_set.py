"""Sets of patterns: a text meets those alone whose longest literal it holds; many literals run over it in one automaton."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from re import _constants, _parser

import ahocorasick


#: Literals that are looked for one by one; more of them run in an automaton.
FEW = 8


def required_literal(pattern: str) -> str:
    """The longest run of characters that every match holds, lower-cased; empty if there is none."""
    runs = [""]

    def walk(items) -> None:  # noqa: ANN001
        for kind, value in items:
            if kind is _constants.LITERAL:
                runs[-1] += chr(value)
                continue
            if kind is _constants.SUBPATTERN and not value[1] and not value[2]:
                walk(value[3])
                continue
            if kind is _constants.MAX_REPEAT and value[0] >= 1:
                runs.append("")
                walk(value[2])
            runs.append("")

    walk(_parser.parse(pattern))
    return max(runs, key=len).lower()


class PatternSet:
    """Compiled patterns, in order. Letter case is ignored and ``\\b`` understood in ASCII, as Spark's expressions do."""

    def __init__(self, patterns: Sequence[str]) -> None:
        self.patterns = [re.compile(p, re.ASCII) for p in patterns]
        literals: dict[str, list[int]] = {}
        for i, p in enumerate(patterns):
            literals.setdefault(required_literal(p), []).append(i)
        self.always, self.few = literals.pop("", []), list(literals.items()) if len(literals) <= FEW else None
        self.automaton = ahocorasick.Automaton()
        for literal, which in literals.items():
            self.automaton.add_word(literal, which)
        if literals:
            self.automaton.make_automaton()

    def candidates(self, text: str) -> list[int]:
        """Patterns that may match, in order."""
        if self.few is not None:
            low = text.lower()
            return sorted([*self.always, *(i for literal, which in self.few if literal in low for i in which)])
        found = set(self.always)
        if len(self.automaton):
            for _, which in self.automaton.iter(text.lower()):
                found.update(which)
        return sorted(found)

    def matches(self, text: str) -> Iterator[tuple[int, re.Match]]:
        """(pattern, match) by pattern, then place."""
        for i in self.candidates(text):
            for m in self.patterns[i].finditer(text):
                yield i, m
