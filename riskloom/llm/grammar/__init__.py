"""Recursive-descent grammars over token-class strings, one module per language.

Each module offers check(text) -> list of (line, message), empty for a valid text. A text is first written as a string
with one character per token (its class); the parser works on that string. As validity depends on the classes alone,
the outcome of a statement's shape is remembered, and a shape that recurs in any file of the worker is parsed once.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable

#: Remembered shapes and tokens per worker before the memory starts anew.
MEMORY = 200_000


class Refused(Exception):
    """A syntax error at an index of the class string."""

    def __init__(self, at: int, message: str):
        super().__init__(message)
        self.at, self.message = at, message


def line_of(text: str, offset: int) -> int:
    return len(re.findall(r"\r\n|\r|\n", text[:offset])) + 1


class Lines:
    """Line numbers of offsets into a text with `\n` ends; rising offsets cost one pass over the text together."""

    def __init__(self, text: str):
        self.text, self.at, self.line = text, 0, 1

    def of(self, offset: int) -> int:
        if offset < self.at:
            self.at, self.line = 0, 1
        self.line += self.text.count("\n", self.at, offset)
        self.at = offset
        return self.line


def to_any_depth(parse: Callable[[], None], tokens: int) -> None:
    """Runs a parser that calls itself for nested texts with as many calls as the text may need. The calls are of Python
    functions only, which the interpreter keeps on the heap, so nesting is bounded by memory alone."""
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 40 * tokens + 2000))
    try:
        parse()
    finally:
        sys.setrecursionlimit(limit)
