"""Python 3.13 modules.

Statements are parsed per logical line by recursive descent, expressions by precedence climbing; blocks by a stack of
indents. After an error the parser goes on at the next logical line (panic mode), so that all errors are found.
"""

from __future__ import annotations

import re

from riskloom.llm.grammar import MEMORY, Refused, to_any_depth

_PREFIX = r"(?:[rRuUbB]|[rR][bB]|[bB][rR])?"
_FPREFIX = r"(?:[fF][rR]?|[rR][fF])"


def _quoted(q: str) -> str:
    return (
        rf"{q}{q}{q}[^{q}\\]*(?:(?:\\.|{q}(?!{q}{q}))[^{q}\\]*)*{q}{q}{q}"
        rf"|{q}(?!{q}{q})[^{q}\\\n]*(?:\\.[^{q}\\\n]*)*{q}"
    )


_STRING = f"{_quoted(chr(34))}|{_quoted(chr(39))}"
_NUMBER = (
    r"0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+"
    r"|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*|\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?"
)
_TOKEN = re.compile(
    r"[ \t\f]*(?:(?:\\\n|#[^\n]*)[ \t\f]*)*"
    rf"(\n[ \t\f]*|(?:{_FPREFIX}|{_PREFIX})(?:{_STRING})|[^\W\d]\w*|(?:{_NUMBER})\w*"
    r"|\.\.\.|\*\*=?|//=?|>>=?|<<=?|!=|->|:=|[-+*/%&|^@=<>]=?|[~()\[\]{},:.;]|\Z|.)",
    re.DOTALL,
)
_GOOD_NUMBER = re.compile(rf"(?:{_NUMBER})(?:and|else|for|if|in|is|or|not)?\Z")
_ZERO_LED = re.compile(r"0[0_]*[1-9][\d_]*\Z")
_PLAIN_F = re.compile(r"(?:[^{}]|\{\{|\}\}|\{[^\W\d]\w*(?:\.[^\W\d]\w*)*(?:![rsa])?(?::[^{}]*)?\})*\Z", re.DOTALL)
_BAD_ESCAPE = re.compile(r"(?<!\\)(?:\\\\)*\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4})|U(?!000[0-9a-fA-F]{5}|0010[0-9a-fA-F]{4})|N(?!\{[^}]+\}))")

#: Class of each keyword and operator; n name, d other atom, s string, b bytes, f f-string, ! no token.
_CLASSES = {
    "False": "d", "None": "d", "True": "d", "and": "A", "as": "a", "assert": "e", "async": "Y", "await": "w",
    "break": "k", "class": "K", "continue": "k", "def": "D", "del": "x", "elif": "E", "else": "L", "except": "X",
    "finally": "F", "for": "O", "from": "r", "global": "g", "if": "I", "import": "M", "in": "i", "is": "z",
    "lambda": "l", "nonlocal": "G", "not": "t", "or": "o", "pass": "p", "raise": "R", "return": "u", "try": "T",
    "while": "W", "with": "H", "yield": "v", "match": "m", "case": "c", "type": "y",
    "=": "=", ":=": "$", "->": ">", "**": "P", "*": "*", "/": "/", "//": "%", "%": "%", "@": "@", "+": "+", "-": "+",
    "<<": "S", ">>": "S", "&": "&", "^": "6", "|": "|", "~": "~", "...": "3", ".": ".", "(": "(", ")": ")", "[": "[",
    "]": "]", "{": "{", "}": "}", ",": ",", ":": ":", ";": ";", "": "",
    **dict.fromkeys(("==", "!=", "<", ">", "<=", ">="), "<"),
    **dict.fromkeys(("+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", "^=", ">>=", "<<=", "**="), "^"),
}
_NAMES = "nmcy"
_INDENT = 0x1000
#: Binding powers of the binary operators; comparisons chain.
_POWER = {"o": 1, "A": 2, "<": 4, "i": 4, "z": 4, "t": 4, "|": 5, "6": 6, "&": 7, "S": 8, "+": 9, "*": 10, "/": 10, "%": 10, "@": 10}
#: Keywords that cannot stand inside brackets: a line that begins with one shows that a bracket was not closed.
_STATEMENTS = frozenset("DKuMWHTRpxgGekFXE")
RETURN, YIELD, JUMP, AWAIT, ASYNC, NONLOCAL = 1, 2, 4, 8, 16, 32
NAME, PLACE, TARGETS, STARRED, OTHER = 1, 2, 3, 4, 0


class _Classes(dict):
    def __missing__(self, token: str) -> str:
        found = self._of(token)
        if len(token) <= 40:
            if len(self) > MEMORY:
                self.clear()
                self.update(_CLASSES)
            self[token] = found
        return found

    @staticmethod
    def _of(token: str) -> str:
        first = token[0]
        if first == "\n":
            column = 0
            for c in token[1:]:
                column = 0 if c == "\f" else (column // 8 + 1) * 8 if c == "\t" else column + 1
            return "\n" + chr(_INDENT + min(column, 0xC000))
        if token[-1] in "\"'" and len(token) > 1:
            head = token[: min(token.find('"') % 99, token.find("'") % 99)].lower()
            size = 3 if token[len(head) : len(head) + 3] in ('"""', "'''") else 1
            body = token[len(head) + size : -size]
            if "f" in head:
                return "f" if _PLAIN_F.match(body) or replacement_fields(body, "r" in head) else "!"
            if "r" not in head and "\\" in body:
                if any("b" not in head or bad[-1] == "x" for bad in _BAD_ESCAPE.findall(body)):
                    return "!"
            if "b" in head:
                return "b" if body.isascii() else "!"
            return "s"
        if first.isdigit() or first == ".":
            if not token.isascii() or not (m := _GOOD_NUMBER.match(token)) or _ZERO_LED.match(token):
                return "!"
            word = re.search(r"(?:and|else|for|if|in|is|or|not)\Z", token)
            return "d" + _CLASSES[word[0]] if word and not token[:2].lower() == "0x" else "d"
        if token.isidentifier():
            return "n"
        return "!"


_classes = _Classes(_CLASSES)


def replacement_fields(body: str, raw: bool, depth: int = 0) -> bool:
    """Whether the fields of an f-string hold valid expressions."""
    at, n = 0, len(body)
    while at < n:
        c = body[at]
        if c == "\\" and not raw and body.startswith("N{", at + 1):
            at = body.find("}", at) + 1
            if not at:
                return False
            continue
        if c in "{}" and body.startswith(c, at + 1) and not (c == "}" and depth):
            at += 2
            continue
        if c == "}":
            return False
        if c != "{":
            at += 1
            continue
        start, open_, at = at + 1, 0, at + 1
        while at < n:
            m = _STRING_AT.match(body, at)
            if m:
                at = m.end()
                continue
            c = body[at]
            if open_ == 0 and (c in "}:" or c == "!" and not body.startswith("=", at + 1)):
                break
            open_ += (c in "([{") - (c in ")]}")
            at += 1
        if at >= n:
            return False
        inner = body[start:at].rstrip()
        if inner.endswith("=") and not re.search(r"[=!<>]=\Z", inner):
            inner = inner[:-1]
        shape = "".join(map(_classes.__getitem__, _TOKEN.findall(" " + re.sub(r"\s*\n\s*", " ", inner))))
        try:
            p = _Line(shape)
            p.yield_or_exprs()
            p.end()
        except Refused:
            return False
        if body[at] == "!":
            if not re.match(r"![rsa][}:]", body[at:]):
                return False
            at += 2
        if body[at] == ":":
            level, start = 1, at + 1
            while at < n and level:
                at += 1
                level += (body[at : at + 1] == "{") - (body[at : at + 1] == "}")
            if level or depth > 1 or not replacement_fields(body[start:at], raw, depth + 1):
                return False
        at += 1
    return True


_STRING_AT = re.compile(rf"{_PREFIX}(?:{_STRING})", re.DOTALL)


class _Line:
    """Recursive descent over the class string of one logical line."""

    def __init__(self, s: str):
        self.s, self.i, self.flags = s + "\0", 0, 0

    def fail(self, message: str, at: int | None = None):
        raise Refused(self.i if at is None else at, message)

    def take(self, c: str) -> bool:
        if self.s[self.i] == c:
            self.i += 1
            return True
        return False

    def need(self, c: str, message: str) -> None:
        if self.s[self.i] != c:
            self.fail(message)
        self.i += 1

    def name(self) -> None:
        if self.s[self.i] not in _NAMES:
            self.fail("expected a name")
        self.i += 1

    def end(self) -> None:
        if self.s[self.i] != "\0":
            self.fail("invalid syntax")

    # expressions

    def binary(self, least: int = 0) -> int:
        """Precedence climbing."""
        kind = self.unary(least)
        s = self.s
        while True:
            c = s[self.i]
            power = _POWER.get(c)
            if power is None or power <= least:
                return kind
            self.i += 1
            if c == "t":
                self.need("i", "expected 'in' after 'not'")
            elif c == "z":
                self.take("t")
            if power == 4:
                self.binary(4)
                kind = OTHER
                continue
            self.binary(power)
            kind = OTHER

    def unary(self, least: int = 0) -> int:
        c = self.s[self.i]
        if c == "t":
            if least > 3:
                self.fail("'not' needs parentheses here")
            self.i += 1
            self.binary(3)
            return OTHER
        if c == "+" or c == "~":
            self.i += 1
            self.unary(9)
            return OTHER
        if c == "w":
            self.i += 1
            self.flags |= AWAIT
            self.primary()
            kind = OTHER
        else:
            kind = self.primary()
        if self.s[self.i] == "P":
            self.i += 1
            self.unary(9)
            return OTHER
        return kind

    def primary(self) -> int:
        kind = self.atom()
        while True:
            c = self.s[self.i]
            if c == ".":
                self.i += 1
                self.name()
                kind = PLACE
            elif c == "(":
                self.i += 1
                self.arguments()
                kind = OTHER
            elif c == "[":
                self.i += 1
                self.slices()
                kind = PLACE
            else:
                return kind

    def atom(self) -> int:
        c = self.s[self.i]
        if c in _NAMES:
            self.i += 1
            return NAME
        if c == "d" or c == "3":
            self.i += 1
            return OTHER
        if c == "s" or c == "f":
            while self.s[self.i] in "sf":
                self.i += 1
            if self.s[self.i] == "b":
                self.fail("cannot mix bytes and str literals")
            return OTHER
        if c == "b":
            while self.s[self.i] == "b":
                self.i += 1
            if self.s[self.i] in "sf":
                self.fail("cannot mix bytes and str literals")
            return OTHER
        if c == "(":
            return self.parenthesised()
        if c == "[":
            return self.listed()
        if c == "{":
            self.braced()
            return OTHER
        self.fail("unexpected end of line" if c == "\0" else "invalid token" if c == "!" else "invalid syntax")

    def expr(self) -> int:
        if self.s[self.i] == "l":
            self.i += 1
            self.parameters(":", annotated=False)
            self.need(":", "expected ':' in lambda")
            keep = self.flags
            self.expr()
            self.flags = keep
            return OTHER
        kind = self.binary()
        if self.s[self.i] == "I":
            self.i += 1
            self.binary()
            self.need("L", "expected 'else' after 'if' expression")
            self.expr()
            return OTHER
        return kind

    def named(self) -> int:
        if self.s[self.i] in _NAMES and self.s[self.i + 1] == "$":
            self.i += 2
            self.expr()
            return OTHER
        return self.expr()

    def star_or_named(self) -> int:
        if self.take("*"):
            if self.binary(4) in (NAME, PLACE, TARGETS):
                return STARRED
            return 5  # starred, but no target
        return self.named()

    def comprehension(self) -> bool:
        """The for clauses behind an element."""
        if self.s[self.i] not in "OY":
            return False
        while self.s[self.i] in "OY":
            if self.take("Y"):
                self.flags |= AWAIT
            self.need("O", "expected 'for'")
            self.targets()
            self.need("i", "expected 'in'")
            self.binary()
            while self.take("I"):
                if self.s[self.i] in _NAMES and self.s[self.i + 1] == "$":
                    self.i += 2
                self.expr() if self.s[self.i] == "l" else self.binary()
        return True

    def items(self, close: str) -> list[int]:
        """Comma-separated elements up to the closing bracket, which is consumed."""
        kinds = []
        while not self.take(close):
            kinds.append(self.star_or_named())
            if len(kinds) == 1 and self.s[self.i] in "OY":
                if kinds[0] in (STARRED, 5):
                    self.fail("iterable unpacking cannot be used in comprehension")
                self.comprehension()
                self.need(close, "expected a closing bracket")
                return [OTHER, OTHER]
            if not self.take(","):
                self.need(close, "expected a closing bracket or ','")
                break
        return kinds

    @staticmethod
    def as_targets(kinds: list[int]) -> int:
        good = all(k in (NAME, PLACE, TARGETS, STARRED) for k in kinds) and kinds.count(STARRED) <= 1
        return TARGETS if good else OTHER

    def parenthesised(self) -> int:
        start = self.i
        self.i += 1
        if self.s[self.i] == "v":
            self.yield_()
            self.need(")", "expected ')'")
            return OTHER
        kinds = self.items(")")
        if len(kinds) == 1 and self.s[self.i - 2] != ",":
            if kinds[0] in (STARRED, 5):
                self.fail("cannot use starred expression here", start)
            return kinds[0]
        return self.as_targets(kinds)

    def listed(self) -> int:
        self.i += 1
        return self.as_targets(self.items("]"))

    def braced(self) -> None:
        self.i += 1
        first, is_dict = True, None
        while not self.take("}"):
            if self.take("P"):
                if is_dict is False:
                    self.fail("invalid syntax")
                self.binary(4)
                is_dict = True
            else:
                kind = self.star_or_named()
                if self.s[self.i] == ":" and is_dict is not False and kind not in (STARRED, 5):
                    self.i += 1
                    self.expr()
                    is_dict = True
                elif is_dict:
                    self.fail("':' expected after dictionary key")
                else:
                    is_dict = False
                if first and self.s[self.i] in "OY":
                    if kind in (STARRED, 5):
                        self.fail("iterable unpacking cannot be used in comprehension")
                    self.comprehension()
                    self.need("}", "expected '}'")
                    return
            first = False
            if not self.take(","):
                self.need("}", "expected '}' or ','")
                return

    def arguments(self) -> None:
        first, keyword, double = True, False, False
        while not self.take(")"):
            if self.take("P"):
                self.expr()
                double = True
            elif self.take("*"):
                if double:
                    self.fail("iterable argument unpacking follows keyword argument unpacking")
                self.expr()
            elif self.s[self.i] in _NAMES and self.s[self.i + 1] == "=":
                self.i += 2
                self.expr()
                keyword = True
            else:
                if keyword or double:
                    self.fail("positional argument follows keyword argument")
                self.named()
                if self.s[self.i] in "OY":
                    self.comprehension()
                    if not first or self.s[self.i] == "," and self.s[self.i + 1] != ")":
                        self.fail("generator expression must be parenthesized")
            first = False
            if not self.take(","):
                self.need(")", "expected ')' or ','")
                return

    def slices(self) -> None:
        if self.s[self.i] == "]":
            self.fail("expected an index")
        while not self.take("]"):
            if self.take("*"):
                self.binary(4)
            else:
                if self.s[self.i] not in ":,]":
                    self.named()
                for _ in range(2):
                    if self.take(":") and self.s[self.i] not in ":,]":
                        self.expr()
            if not self.take(","):
                self.need("]", "expected ']' or ','")
                return

    def exprs(self) -> int:
        """Star expressions; the kind as a target."""
        kinds = [self.star_or_named()]
        comma = False
        while self.take(","):
            comma = True
            if self.s[self.i] in "\0=;):^" or self.s[self.i] == "]" or self.s[self.i] == "}":
                break
            kinds.append(self.star_or_named())
        if not comma:
            return kinds[0]
        return self.as_targets(kinds)

    def yield_(self) -> None:
        self.i += 1
        self.flags |= YIELD
        if self.take("r"):
            self.expr()
        elif self.s[self.i] not in "\0);=}":
            self.exprs()

    def yield_or_exprs(self) -> int:
        if self.s[self.i] == "v":
            self.yield_()
            return OTHER
        kind = self.exprs()
        if kind == 5:
            self.fail("cannot use starred expression here")
        return kind

    def targets(self) -> None:
        kinds = []
        while True:
            star = self.take("*")
            at = self.i
            kind = self.unary(4) if self.s[self.i] != "t" else self.fail("invalid target")
            if kind not in (NAME, PLACE, TARGETS):
                self.fail("cannot assign to this expression", at)
            kinds.append(STARRED if star else kind)
            if not self.take(",") or self.s[self.i] in "i=\0;":
                break
        if kinds.count(STARRED) > 1 or kinds == [STARRED] and self.s[self.i - 1] != ",":
            self.fail("invalid starred assignment target")

    def parameters(self, close: str, annotated: bool) -> None:
        """Up to, not including, the closing class."""
        default = star = slash = False
        bare = 0
        while self.s[self.i] != close:
            if self.take("/"):
                if slash or star or self.s[self.i - 2] in "(l":
                    self.fail("invalid '/' in parameters")
                slash = True
            elif self.take("P"):
                self.name()
                if annotated and self.take(":"):
                    self.expr()
                if self.s[self.i] == "=":
                    self.fail("var-keyword argument cannot have default value")
                self.take(",")
                if self.s[self.i] != close:
                    self.fail("arguments cannot follow var-keyword argument")
                if bare == 1:
                    self.fail("named arguments must follow bare *")
                return
            elif self.take("*"):
                if star:
                    self.fail("'*' may appear only once")
                star = True
                if self.s[self.i] == ",":
                    bare = 1
                elif self.s[self.i] == close:
                    self.fail("named arguments must follow bare *")
                else:
                    self.name()
                    if annotated and self.take(":"):
                        self.star_or_named()
                    if self.s[self.i] == "=":
                        self.fail("var-positional argument cannot have default value")
            else:
                self.name()
                bare = 0
                if annotated and self.take(":"):
                    self.expr()
                if self.take("="):
                    self.expr()
                    default = True
                elif default and not star:
                    self.fail("parameter without a default follows parameter with a default")
            if not self.take(","):
                break
        if bare == 1:
            self.fail("named arguments must follow bare *")
        if self.s[self.i] != close:
            self.fail("invalid parameter")

    def type_parameters(self) -> None:
        if self.take("["):
            if self.s[self.i] == "]":
                self.fail("type parameter list cannot be empty")
            while not self.take("]"):
                self.take("*") or self.take("P")
                self.name()
                if self.take(":"):
                    self.expr()
                if self.take("="):
                    self.star_or_named()
                if not self.take(","):
                    self.need("]", "expected ']'")
                    return

    # statements; each returns the kind of block clause it heads, or ""

    def statement_line(self) -> tuple[str, bool]:
        """(kind of the clause or "", whether a block must follow)."""
        kind = self.compound()
        if kind is None:
            self.simple_list()
            return "", False
        if kind == "@":
            self.end()
            return "@", False
        self.need(":", "expected ':'")
        if self.s[self.i] == "\0":
            return kind, True
        self.simple_list()
        return kind, False

    def compound(self) -> str | None:
        c = self.s[self.i]
        if c == "Y":
            self.i += 1
            c = self.s[self.i]
            if c not in "DOH":
                self.fail("expected 'def', 'with' or 'for' after 'async'")
            if c != "D":
                self.flags |= ASYNC
            else:
                self.definition()
                return "async def"
        if c == "I" or c == "E" or c == "W":
            self.i += 1
            self.named()
            return {"I": "if", "E": "elif", "W": "while"}[c]
        if c == "L" or c == "T" or c == "F":
            self.i += 1
            return {"L": "else", "T": "try", "F": "finally"}[c]
        if c == "X":
            self.i += 1
            group = self.take("*")
            if self.s[self.i] == ":":
                if group:
                    self.fail("expected one or more exception types")
                return "except any"
            self.expr()
            if self.take("a"):
                self.name()
            return "except"
        if c == "O":
            self.i += 1
            self.targets()
            self.need("i", "expected 'in'")
            self.exprs()
            return "for"
        if c == "H":
            self.i += 1
            self.with_items()
            return "with"
        if c == "D":
            self.definition()
            return "def"
        if c == "K":
            self.i += 1
            self.name()
            self.type_parameters()
            if self.take("("):
                self.arguments()
            return "class"
        if c == "@":
            self.i += 1
            self.named()
            return "@"
        if c == "m" and self.s[-2] == ":":
            start, flags = self.i, self.flags
            try:
                self.i += 1
                self.exprs()
                if self.s[self.i] == ":" and self.s[self.i + 1] == "\0":
                    return "match"
            except Refused:
                pass
            self.i, self.flags = start, flags
        if c == "c" and ":" in self.s:
            start, flags = self.i, self.flags
            try:
                self.i += 1
                self.open_pattern()
                if self.take("I"):
                    self.named()
                if self.s[self.i] == ":":
                    return "case"
            except Refused:
                pass
            self.i, self.flags = start, flags
        return None

    def definition(self) -> None:
        self.i += 1
        self.name()
        self.type_parameters()
        self.need("(", "expected '('")
        keep = self.flags
        self.parameters(")", annotated=True)
        self.i += 1
        if self.take(">"):
            self.expr()
        self.flags = keep

    def with_items(self) -> None:
        start, flags = self.i, self.flags
        if self.take("("):
            try:
                while True:
                    self.expr()
                    if self.take("a"):
                        self.target()
                    if not self.take(",") or self.s[self.i] == ")":
                        break
                if self.take(")") and self.s[self.i] == ":":
                    return
            except Refused:
                pass
            self.i, self.flags = start, flags
        while True:
            self.expr()
            if self.take("a"):
                self.target()
            if not self.take(","):
                return

    def target(self) -> None:
        at = self.i
        if self.unary(4) not in (NAME, PLACE, TARGETS):
            self.fail("cannot assign to this expression", at)

    def simple_list(self) -> None:
        while True:
            self.simple()
            if not self.take(";"):
                self.end()
                return
            if self.s[self.i] == "\0":
                return

    def simple(self) -> None:
        c = self.s[self.i]
        if c == "p":
            self.i += 1
        elif c == "k":
            self.i += 1
            self.flags |= JUMP
        elif c == "u":
            self.i += 1
            self.flags |= RETURN
            if self.s[self.i] not in "\0;":
                if self.exprs() == 5:
                    self.fail("cannot use starred expression here")
        elif c == "M":
            self.i += 1
            while True:
                self.dotted()
                if self.take("a"):
                    self.name()
                if not self.take(","):
                    break
        elif c == "r":
            self.from_import()
        elif c == "g" or c == "G":
            self.i += 1
            self.flags |= NONLOCAL if c == "G" else 0
            self.name()
            while self.take(","):
                self.name()
        elif c == "R":
            self.i += 1
            if self.s[self.i] not in "\0;":
                self.expr()
                if self.take("r"):
                    self.expr()
        elif c == "e":
            self.i += 1
            self.expr()
            if self.take(","):
                self.expr()
        elif c == "x":
            self.i += 1
            at = self.i
            if self.exprs() not in (NAME, PLACE, TARGETS):
                self.fail("cannot delete this expression", at)
        elif c == "y" and self.s[self.i + 1] in _NAMES:
            self.i += 2
            self.type_parameters()
            self.need("=", "expected '='")
            self.expr()
        else:
            self.assignment()

    def assignment(self) -> None:
        at = self.i
        kind = self.yield_or_exprs()
        c = self.s[self.i]
        if c == "=":
            while self.take("="):
                if kind not in (NAME, PLACE, TARGETS):
                    self.fail("cannot assign to this expression", at)
                at = self.i
                kind = self.yield_or_exprs()
        elif c == "^":
            if kind not in (NAME, PLACE):
                self.fail("illegal target for augmented assignment", at)
            self.i += 1
            self.yield_or_exprs()
        elif c == ":":
            if kind not in (NAME, PLACE):
                self.fail("illegal target for annotation", at)
            self.i += 1
            self.expr()
            if self.take("="):
                self.yield_or_exprs()
        if kind == STARRED and self.s[self.i] != "=":
            self.fail("cannot use starred expression here", at)

    def dotted(self) -> None:
        self.name()
        while self.take("."):
            self.name()

    def from_import(self) -> None:
        self.i += 1
        start = self.i
        while self.s[self.i] in ".3":
            self.i += 1
        if self.i == start or self.s[self.i] != "M":
            self.dotted()
        self.need("M", "expected 'import'")
        if self.take("*"):
            return
        paren = self.take("(")
        while True:
            self.name()
            if self.take("a"):
                self.name()
            if not self.take(","):
                break
            if paren and self.s[self.i] == ")":
                break
        if paren:
            self.need(")", "expected ')'")

    # patterns of a case clause

    def open_pattern(self) -> None:
        while True:
            self.star_pattern()
            if not self.take(",") or self.s[self.i] in ":I":
                return

    def star_pattern(self) -> None:
        if self.take("*"):
            self.name()
        else:
            self.pattern()

    def pattern(self) -> None:
        self.closed_pattern()
        while self.take("|"):
            self.closed_pattern()
        if self.take("a"):
            self.name()

    def closed_pattern(self) -> None:
        c = self.s[self.i]
        if c in _NAMES:
            self.dotted()
            if self.take("("):
                while not self.take(")"):
                    if self.s[self.i] in _NAMES and self.s[self.i + 1] == "=":
                        self.i += 2
                    self.pattern()
                    if not self.take(","):
                        self.need(")", "expected ')'")
                        return
        elif c in "([":
            close = ")" if c == "(" else "]"
            self.i += 1
            while not self.take(close):
                self.star_pattern()
                if not self.take(","):
                    self.need(close, "expected a closing bracket")
                    return
        elif c == "{":
            self.i += 1
            while not self.take("}"):
                if self.take("P"):
                    self.name()
                else:
                    if self.s[self.i] in _NAMES:
                        self.dotted()
                    else:
                        self.literal()
                    self.need(":", "expected ':'")
                    self.pattern()
                if not self.take(","):
                    self.need("}", "expected '}'")
                    return
        else:
            self.literal()

    def literal(self) -> None:
        self.take("+")
        if self.s[self.i] in "sb":
            while self.s[self.i] in "sb":
                self.i += 1
            return
        self.need("d", "invalid pattern")
        if self.take("+"):
            self.need("d", "invalid pattern")


#: Outcome of a logical line's shape: (clause kind, block follows, flags, first class), a Refused, or None if a bracket is open.
_lines: dict[str, tuple | Refused | None] = {}


#: Brackets that the language's tokenizer allows to be open at once.
BRACKETS = 200


def _open(shape: str) -> int:
    """Most brackets that are open at once."""
    most = now = 0
    for c in shape:
        if c in "([{":
            now += 1
            most = max(most, now)
        elif c in ")]}":
            now -= 1
    return most


def _outcome(shape: str) -> tuple | Refused | None:
    depth = sum(map(shape.count, "([{")) - sum(map(shape.count, ")]}"))
    if depth > 0:
        found = None
    else:
        line = _Line(shape)
        parsed: list[tuple] = []
        try:
            if len(shape) < 40:
                parsed.append(line.statement_line())
            else:
                to_any_depth(lambda: parsed.append(line.statement_line()), len(shape))
            found = (*parsed[0], line.flags)
        except Refused as e:
            found = e
        if found.__class__ is not Refused and len(shape) > BRACKETS and _open(shape) > BRACKETS:
            found = Refused(0, "too many nested brackets")
    if len(_lines) > MEMORY:
        _lines.clear()
    if len(shape) <= 400:
        _lines[shape] = found
    return found


_FOLLOWS = {
    "elif": ("if", "elif"), "else": ("if", "elif", "for", "while", "except", "except any"), "except": ("try", "except"),
    "except any": ("try", "except"), "finally": ("try", "except", "except any", "try else"),
}


def check(text: str) -> list[tuple[int, str]]:
    """(line, message) of every error; an empty text is valid."""
    if "\0" in text:
        return [(text[: text.index("\0")].count("\n") + 1, "null byte")]
    if text[:1] == "\ufeff":
        text = text[1:]
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    tokens = _TOKEN.findall("\n" + text + "\n")
    lines = "".join(map(_classes.__getitem__, tokens)).split("\n")
    return _blocks(lines, tokens)


def _numbers(tokens: list[str]) -> list[int]:
    """Line number at which each line of classes begins; only needed for messages."""
    out, line = [0], 0
    for t in tokens:
        if t[:1] == "\n":
            line += 1
            out.append(line)
        else:
            line += t.count("\n")
    return out


def _blocks(lines: list[str], tokens: list[str]) -> list[tuple[int, str]]:
    errors: list[tuple[int, str]] = []
    found = _lines
    # a block: [indent, last clause kind, kind of its head, in function (0, 1 def, 2 async), in loop]
    stack = [[0, "", "module", 0, False]]
    pending: tuple | None = None  # (head kind, its line) that needs an indented block
    k, n = 1, len(lines)

    def report(line: int, message: str) -> None:
        errors.append((line, message))

    while k < n:
        line = lines[k]
        at = k
        k += 1
        shape = line[1:]
        if not shape:
            continue
        outcome = found[shape] if shape in found else _outcome(shape)
        if outcome is None:
            depth = sum(map(shape.count, "([{")) - sum(map(shape.count, ")]}"))
            parts = [shape]
            while depth > 0 and k < n:
                more = lines[k][1:]
                if more and more[0] in _STATEMENTS and not (more[0] in "r"):
                    break
                if more:
                    parts.append(more)
                    depth += sum(map(more.count, "([{")) - sum(map(more.count, ")]}"))
                k += 1
            if depth > 0:
                report(at, "a bracket was never closed")
                outcome = Refused(0, "")
            else:
                shape = "".join(parts)
                outcome = found[shape] if shape in found else _outcome(shape)
        indent = ord(line[0]) - _INDENT
        top = stack[-1]
        if pending is not None:
            if indent <= top[0]:
                report(at, f"expected an indented block after {pending[0]}")
            else:
                head = pending[0]
                inside, loop = top[3], top[4]
                if head == "def" or head == "async def":
                    inside, loop = (2 if head == "async def" else 1), False
                elif head == "class":
                    inside, loop = 0, False
                elif head == "for" or head == "while":
                    loop = True
                top = [indent, "", head, inside, loop]
                stack.append(top)
            pending = None
        if indent != top[0]:
            if indent > top[0]:
                report(at, "unexpected indent")
            else:
                while len(stack) > 1 and stack[-1][0] > indent:
                    if stack[-1][1] in ("try", "@"):
                        report(at, "expected 'except' or 'finally' block" if stack[-1][1] == "try" else "nothing to decorate")
                    stack.pop()
                top = stack[-1]
                if top[0] != indent:
                    report(at, "unindent does not match any outer indentation level")
        if type(outcome) is Refused:
            if outcome.message:
                report(at, outcome.message)
            top[1] = "?"  # the clause it was is not known: what may follow it is not judged
            if shape[-1] == ":":
                pending_indent = next((ord(x[0]) - _INDENT for x in lines[k:] if x[1:]), 0)
                if pending_indent > indent:
                    stack.append([pending_indent, "", "?", top[3] or 1, True])
            continue
        kind, block, flags = outcome
        last = top[1]
        if kind in _FOLLOWS:
            if last not in _FOLLOWS[kind] and last != "?":
                report(at, f"'{kind.split()[0]}' has no clause to belong to")
            if kind == "else" and last.startswith("except"):
                kind = "try else"
            elif kind == "else":
                kind = "closed"
        elif last == "try":
            report(at, "expected 'except' or 'finally' block")
        elif last == "@" and kind not in ("@", "def", "async def", "class"):
            report(at, "a decorator needs a function or class")
        if kind == "case":
            if top[2] not in ("match", "?"):
                report(at, "'case' outside match")
        elif top[2] == "match":
            report(at, "expected 'case'")
        if flags and (block or kind not in ("def", "async def")):  # a function's body on its line is its own
            if flags & RETURN and not top[3]:
                report(at, "'return' outside function")
            if flags & YIELD and not top[3]:
                report(at, "'yield' outside function")
            if flags & (AWAIT | ASYNC) and top[3] != 2 and not (kind in ("def", "async def")):
                report(at, "'await' outside async function")
            if flags & NONLOCAL and len(stack) == 1:
                report(at, "nonlocal declaration not allowed at module level")
            if flags & JUMP and not (top[4] or kind in ("for", "while")):
                report(at, "'break' or 'continue' outside loop")
        top[1] = kind
        if block:
            pending = ({"closed": "else", "try else": "else"}.get(kind, kind), at)
            if kind in ("closed", "try else") and top[1] == "closed":
                pending = ("else", at)
    if pending is not None:
        report(pending[1], f"expected an indented block after {pending[0]}")
    for block in stack:
        if block[1] == "try":
            report(n - 1, "expected 'except' or 'finally' block")
        elif block[1] == "@":
            report(n - 1, "nothing to decorate")
    if errors:
        numbers = _numbers(tokens)
        errors = sorted({(numbers[min(x, len(numbers) - 1)], m) for x, m in errors})
    return errors
