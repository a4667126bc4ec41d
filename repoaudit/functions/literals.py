"""Which literals a text must hold so that a regular expression can be found in it.

A pattern's syntax tree is read from the inside out. A part whose texts are few is known exactly;
neighbours of that kind are joined to longer literals, and what breaks such a run (a wildcard, a
wide class, a repetition) leaves it as a group: one of its strings must be there. An alternative
needs a string of each branch's best group. Strings are in small letters, for a search without case;
only ASCII counts, since other letters fold in more than one way.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

try:
    from re import _constants as codes, _parser as parser
except ImportError:  # an interpreter with another regex engine: nothing is known
    codes = parser = None

#: Most strings of a group, longest string, most characters of a class that are told apart.
MOST, LONGEST, CLASS = 32, 40, 8


@dataclass(frozen=True)
class _Need:
    """``exact``: all texts a part can match, or None; ``groups``: of each, one string must occur."""

    exact: frozenset[str] | None
    groups: tuple[frozenset[str], ...] = ()

    def every(self) -> tuple[frozenset[str], ...]:
        if self.exact is None or "" in self.exact or not self.exact:
            return self.groups
        return (*self.groups, self.exact)


_ANY = _Need(None)
_EMPTY = _Need(frozenset([""]))


def _worth(group: frozenset[str]) -> tuple[int, int]:
    """Long strings tell more than short ones, then few more than many."""
    return min(map(len, group)), -len(group)


def _row(parts) -> _Need:
    """Parts one after the other."""
    groups: list[frozenset[str]] = []
    run, whole = frozenset([""]), True
    for need in parts:
        groups += need.groups
        joined = None
        if need.exact is not None and len(run) * len(need.exact) <= MOST:
            joined = frozenset(a + b for a in run for b in need.exact)
            if max(map(len, joined), default=0) > LONGEST:
                joined = None
        if joined is None:
            whole = False
            if "" not in run:
                groups.append(run)
            run = need.exact if need.exact is not None and len(need.exact) <= MOST else frozenset([""])
        else:
            run = joined
    if whole:
        return _Need(run, tuple(groups))
    return _Need(None, (*groups, run) if "" not in run else tuple(groups))


def _either(branches: list[_Need]) -> _Need:
    if all(b.exact is not None for b in branches):
        exact = frozenset().union(*(b.exact for b in branches))
        if len(exact) <= MOST:
            return _Need(exact)
    best = [max(b.every(), key=_worth, default=None) for b in branches]
    if any(b is None for b in best):
        return _ANY
    group = frozenset().union(*best)
    return _Need(None, (group,)) if len(group) <= 4 * MOST else _ANY


def _characters(items) -> _Need:
    found: set[str] = set()
    for code, value in items:
        if code is codes.LITERAL:
            low = high = value
        elif code is codes.RANGE:
            low, high = value
        else:  # a category, or all but these
            return _ANY
        if high > 127 or high - low > 2 * CLASS:
            return _ANY
        found |= {chr(c).lower() for c in range(low, high + 1)}
    return _Need(frozenset(found)) if len(found) <= CLASS else _ANY


def _part(code, value) -> _Need:
    if code is codes.LITERAL:
        return _Need(frozenset([chr(value).lower()])) if value < 128 else _ANY
    if code is codes.IN:
        return _characters(value)
    if code is codes.BRANCH:
        return _either([_tree(b) for b in value[1]])
    if code is codes.SUBPATTERN:
        return _tree(value[-1])
    if code is codes.ATOMIC_GROUP:
        return _tree(value)
    if code is codes.AT or code is codes.ASSERT_NOT:
        return _EMPTY
    if code is codes.ASSERT:  # what it looks at is in the text, too, but beside the run
        return _Need(_EMPTY.exact, _tree(value[1]).every())
    if code in (codes.MAX_REPEAT, codes.MIN_REPEAT, codes.POSSESSIVE_REPEAT):
        low, high, body = value
        need = _tree(body)
        if low == 0:
            return _Need(need.exact | {""}) if high == 1 and need.exact is not None and len(need.exact) < MOST else _ANY
        some = _row([need] * min(low, 3))
        if low == high <= 3:
            return some
        return _Need(None, some.every())
    return _ANY  # any character, categories, references to groups


def _tree(parts) -> _Need:
    needs = []
    for code, value in parts:
        if code in (codes.MAX_REPEAT, codes.MIN_REPEAT, codes.POSSESSIVE_REPEAT) and 0 < value[0] < value[1]:
            # Begins with as many as there must be, which go on the run of what is before.
            needs += [_tree(value[2])] * min(value[0], 3) + [_ANY]
        else:
            needs.append(_part(code, value))
    return _row(needs)


def needed_literals(pattern: str) -> tuple[tuple[str, ...], ...]:
    """Groups of strings; a line that the Python pattern is found in, case ignored, holds one string of
    each group once its case is folded. The best group is the last; empty if nothing is known.

    At most two groups of longer strings are given, or one of single characters if there is no other.
    """
    if parser is None:
        return ()
    groups = sorted(set(_tree(parser.parse(pattern, re.IGNORECASE)).every()), key=lambda g: (_worth(g), sorted(g)))
    long = [g for g in groups if _worth(g)[0] > 1]
    return tuple(tuple(sorted(g)) for g in (long[-2:] if long else groups[-1:]))


def minimal(strings) -> dict[str, str]:
    """For each string the shortest of all that it holds, so that none of the values holds another."""
    kept: list[str] = []
    found = {}
    for s in sorted(set(strings), key=lambda s: (len(s), s)):
        found[s] = next((k for k in kept if k in s), s)
        if found[s] == s:
            kept.append(s)
    return found


def _quoted(char: str) -> str:
    return char if char.isalnum() else f"\\x{ord(char):02x}"


def one_of(strings) -> str:
    """A regular expression for one of many ASCII strings; the longest, if one begins with another.

    Shared beginnings are written once, and at each place a few tests of character classes lead to
    the branch in question, so its time hardly grows with the number of strings.
    """
    branches: dict[str, list[str]] = {}
    for s in sorted(set(strings)):
        branches.setdefault(s[0], []).append(s[1:])

    def choose(chars: list[str]) -> str:
        if len(chars) == 1:
            rest = branches[chars[0]]
            longer = [r for r in rest if r]
            if len(longer) < len(rest):  # a string ends here
                return _quoted(chars[0]) + (f"(?:{one_of(longer)})?" if longer else "")
            return _quoted(chars[0]) + one_of(longer)
        half = len(chars) // 2
        low, high = chars[:half], chars[half:]
        return f"(?:(?=[{''.join(map(_quoted, low))}]){choose(low)}|{choose(high)})"

    return choose(sorted(branches))


_CLASS = r"\[\^?\]?(?:\\.|[^\]\\])*\]"
_REFERENCE = re.compile(rf"\\k<(\w+)>|\\([1-9][0-9]?)|\\.|\(\?<([A-Za-z]\w*)>|{_CLASS}", re.DOTALL)
_OPENING = re.compile(rf"\\.|{_CLASS}|(\((?!\?)|\(\?<[A-Za-z])", re.DOTALL)


def grouped(patterns) -> str:
    """Java patterns as one, each an alternative with its own numbers and names of groups."""
    parts, before = [], 0
    for i, pattern in enumerate(patterns):

        def renamed(found: re.Match) -> str:
            if found[1]:
                return rf"\k<p{i}{found[1]}>"
            if found[2]:
                return rf"(?:\{int(found[2]) + before})"
            return f"(?<p{i}{found[3]}>" if found[3] else found[0]

        parts.append(f"(?:{_REFERENCE.sub(renamed, pattern)})")
        before += sum(1 for found in _OPENING.finditer(pattern) if found[1])
    return "|".join(parts)
