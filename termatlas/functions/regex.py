"""Python regular expressions for Spark's regex engine, with Python's Unicode meaning."""

from __future__ import annotations

import re

#: Python's white space beyond Java's, as members of a character class.
SPACE_CLASS = r"\s\x1c-\x1f\x85\p{Z}"
#: Python's word characters; the last member is a letter beyond U+FFFF, which makes a lookbehind step by code points.
WORD_CLASS = "[\\p{L}\\p{N}_\U00010000]"
NOT_AFTER, NOT_BEFORE = f"(?<!{WORD_CLASS})", f"(?!{WORD_CLASS})"
BOUNDARY = f"(?:(?<={WORD_CLASS})(?!{WORD_CLASS})|(?<!{WORD_CLASS})(?={WORD_CLASS}))"
FLAGS = "(?iu)"
UNSUPPORTED = re.compile(r"\(\?P[<=>]|\(\?\(|\\[AZBG]|\(\?#")


def _walk(pattern: str, boundary: bool) -> str:
    out, at, in_class = [], 0, False
    while at < len(pattern):
        c = pattern[at]
        if c == "\\" and at + 1 < len(pattern):
            e = pattern[at + 1]
            at += 2
            if e == "s":
                out.append(SPACE_CLASS if in_class else f"[{SPACE_CLASS}]")
            elif e == "S" and not in_class:
                out.append(f"[^{SPACE_CLASS}]")
            elif e == "w":
                out.append(WORD_CLASS[1:-1] if in_class else WORD_CLASS)
            elif e == "d":
                out.append(r"\p{Nd}")
            elif e == "b" and not in_class:
                out.append(_boundary(pattern, at) if boundary else "")
            elif e in "SWD":
                raise ValueError(f"\\{e} is not supported here: {pattern!r}")
            else:
                out.append("\\" + e)
            continue
        if c == "[" and not in_class:
            in_class = True
        elif c == "[":
            c = "\\["  # Java would open a nested class
        elif c == "]" and in_class:
            in_class = False
        elif c == "&" and in_class:
            c = "\\&"
        out.append(c)
        at += 1
    return "".join(out)


def _boundary(pattern: str, at: int) -> str:
    """The boundary whose escape ends at `at`: one-sided where a literal letter stands next to it."""
    after, before = pattern[at : at + 1], pattern[: at - 2]
    if after.isalnum() and pattern[at + 1 : at + 2] not in ("?", "*", "{") and "|" not in pattern:
        return f"(?={after}){NOT_AFTER}"
    if before[-1:].isalnum() and before[-2:-1] != "\\" and "|" not in pattern:
        return NOT_BEFORE
    return BOUNDARY


def check(pattern: str) -> None:
    if UNSUPPORTED.search(pattern):
        raise ValueError(f"unsupported regex syntax: {pattern!r}")
    compiled = re.compile(pattern, re.I)
    if compiled.match("") or any(m.start() == m.end() for m in compiled.finditer("a b")):
        raise ValueError(f"the pattern can match nothing: {pattern!r}")


def to_java(pattern: str) -> str:
    """The case-insensitive, Unicode-aware Java form of a Python pattern."""
    check(pattern)
    return FLAGS + _walk(pattern, True)


def prefilter(pattern: str) -> str:
    """A cheaper pattern that matches wherever to_java(pattern) does: boundaries are dropped."""
    check(pattern)
    return FLAGS + _walk(pattern, False)
