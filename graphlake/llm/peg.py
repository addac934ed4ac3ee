"""A packrat parser for parsing-expression grammars.

An expression is a function (state, position) -> (position, value) or None. Rules are memoised by
(rule, position, indentation), so each is tried once at a place and parsing takes linear time. Values
carry source offsets; what they mean is up to the grammar's actions.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

Result = tuple[int, Any] | None
Parse = Callable[["State", int], Result]


class State:
    """Text under parse, memo table and current indentation."""

    __slots__ = ("memo", "column", "text")

    def __init__(self, text: str):
        self.text, self.memo, self.column = text, {}, -1


def rx(pattern: str, flags: int = 0) -> Parse:
    """A terminal; its value is (start, end)."""
    match = re.compile(pattern, flags).match

    def parse(s: State, at: int) -> Result:
        m = match(s.text, at)
        return (m.end(), (at, m.end())) if m else None

    return parse


def seq(*parts: Parse) -> Parse:
    def parse(s: State, at: int) -> Result:
        values = []
        for p in parts:
            r = p(s, at)
            if r is None:
                return None
            at = r[0]
            values.append(r[1])
        return at, values

    return parse


def alt(*parts: Parse) -> Parse:
    def parse(s: State, at: int) -> Result:
        for p in parts:
            if (r := p(s, at)) is not None:
                return r
        return None

    return parse


def many(part: Parse, least: int = 0) -> Parse:
    def parse(s: State, at: int) -> Result:
        values = []
        while (r := part(s, at)) is not None and r[0] > at:
            at = r[0]
            values.append(r[1])
        return (at, values) if len(values) >= least else None

    return parse


def opt(part: Parse) -> Parse:
    return lambda s, at: part(s, at) or (at, None)


def ahead(part: Parse) -> Parse:
    return lambda s, at: (at, None) if part(s, at) is not None else None


def absent(part: Parse) -> Parse:
    return lambda s, at: (at, None) if part(s, at) is None else None


def act(part: Parse, action: Callable[[State, int, int, Any], Any]) -> Parse:
    """Semantic action: gets the state, start, end and value."""

    def parse(s: State, at: int) -> Result:
        r = part(s, at)
        return None if r is None else (r[0], action(s, at, r[0], r[1]))

    return parse


class Rules:
    """Named, memoised rules that may refer to each other before they are defined."""

    def __init__(self):
        self._of: dict[str, Parse] = {}

    def define(self, name: str, part: Parse) -> None:
        self._of[name] = part

    def __getitem__(self, name: str) -> Parse:
        rules = self._of

        def parse(s: State, at: int) -> Result:
            key = (name, at, s.column)
            memo = s.memo
            if key in memo:
                return memo[key]
            r = memo[key] = rules[name](s, at)
            return r

        return parse
