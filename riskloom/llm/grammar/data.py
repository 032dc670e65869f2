"""JSON, TOML 1.0 and strict INI texts: descent over tokens with an explicit stack, so that nesting depth is not bounded,
and recovery at the next line (JSON: at the next comma or bracket). The grammars decide alone."""

from __future__ import annotations

import datetime
import re

from riskloom.llm.grammar import Lines, Refused

_JSON = re.compile(
    r'[ \t\n\r]*([{}\[\]:,]|"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"'
    r"|(?:-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)(?![\w.+-])|\Z|.)",
    re.DOTALL | re.ASCII,
)
_SCALAR = frozenset('"-0123456789tfn')


def json_errors(text: str) -> list[tuple[int, str]]:
    """The grammar's stack is explicit, so nesting depth is not bounded. After an error the parser drops tokens up to the
    next `,` or closing bracket."""
    errors: list[tuple[int, str]] = []
    stack: list[str] = []
    want, at, lines = "value", 0, Lines(text)

    def error(message: str) -> None:
        errors.append((lines.of(at), message))

    recovering = False
    while True:
        m = _JSON.match(text, at)
        if not m:
            token = ""
        else:
            token, at = m[1], m.end()
        if not token:
            break
        first = token[0]
        scalar = first in _SCALAR and (len(token) > 1 or first.isdigit())
        if recovering:
            if first not in ",]}":
                continue
            recovering, want = False, "after"
        if want in ("value", "value or ]"):
            if first == "{":
                stack.append("{")
                want = "key or }"
            elif first == "[":
                stack.append("[")
                want = "value or ]"
            elif first == "]" and want == "value or ]":
                stack.pop()
                want = "after"
            elif scalar:
                want = "after"
            else:
                error("expected a value")
                recovering = first not in ",]}"
                want = "after"
        elif want in ("key", "key or }"):
            if first == "}" and want == "key or }":
                stack.pop()
                want = "after"
            elif first == '"' and len(token) > 1:
                want = "colon"
            else:
                error("expected a property name in double quotes")
                recovering = True
        elif want == "colon":
            if first == ":":
                want = "value"
            else:
                error("expected ':'")
                recovering = True
        elif not stack:
            error("text after the value")
            break
        elif first == ",":
            want = "key" if stack[-1] == "{" else "value"
        elif first in "]}":
            if (stack[-1] == "{") != (first == "}"):
                error("closing bracket does not match")
            stack.pop()
        else:
            error("expected ',' or a closing bracket")
            recovering = True
    if not errors and (want != "after" or stack):
        error("unexpected end" if text.strip() else "empty text")
    return errors


_BARE = re.compile(r"[A-Za-z0-9_-]+")
_ESC = r"\\(?:[\"\\bfnrt]|u(?![dD][89a-fA-F])[0-9a-fA-F]{4}|U(?:0000(?![dD][89a-fA-F])|000[1-9a-fA-F]|0010)[0-9a-fA-F]{4})"
_BASIC = re.compile(rf'"(?:[^"\\\x00-\x08\x0a-\x1f\x7f]|{_ESC})*+"')
_LITERAL = re.compile(r"'[^'\x00-\x08\x0a-\x1f\x7f]*'")
_MULTI = re.compile(
    rf'"""(?:[^"\\\x00-\x08\x0b-\x1f\x7f]|{_ESC}|\\[ \t]*\n[ \t\n]*+|"{{1,2}}(?!"))*+"{{3,5}}'
    r"|'''(?:[^'\x00-\x08\x0b-\x1f\x7f]|'{1,2}(?!'))*+'{3,5}"
)
_MOMENT = re.compile(
    r"(?:(\d{4})-(\d\d)-(\d\d)(?:[Tt ](\d\d):(\d\d):(\d\d)(?:\.\d+)?(?:[Zz]|[+-](?:[01]\d|2[0-3]):[0-5]\d)?)?|(\d\d):(\d\d):(\d\d)(?:\.\d+)?)(?![\w.:+-])",
    re.ASCII,
)
_PLAIN = re.compile(
    r"(?:true|false|[+-]?(?:inf|nan)|0x[0-9a-fA-F](?:_?[0-9a-fA-F])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*"
    r"|[+-]?(?:0|[1-9](?:_?\d)*)(?:\.\d(?:_?\d)*)?(?:[eE][+-]?\d(?:_?\d)*)?)(?![\w.:+-])",
    re.ASCII,
)
_COMMENT = r"#[^\n\x00-\x08\x0b-\x1f\x7f]*(?=\n|\Z)"
_TOML_BLANK = re.compile(rf"(?:[ \t\n]|{_COMMENT})*+")
_INLINE = re.compile(r"[ \t]*")
_LINE_END = re.compile(rf"[ \t]*(?:{_COMMENT})?(?:\n|\Z)")
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|(.))")
_SHORT = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}


class _Table:
    """What a key stands for. made: `header` for a table with a header of its own, `above` for one that only headers below
    it have made, `dotted` for one of dotted keys, `array` for an array of tables (its last table holds the keys)."""

    __slots__ = ("made", "keys", "statement")

    def __init__(self, made: str, statement: int = -1):
        self.made, self.keys, self.statement = made, {}, statement


class _Toml:
    def __init__(self, text: str):
        self.t, self.i = text, 0
        self.root = _Table("header")
        self.here, self.number = self.root, 0

    def fail(self, message: str, at: int | None = None):
        raise Refused(self.i if at is None else at, message)

    def skip(self, pattern: re.Pattern) -> None:
        self.i = pattern.match(self.t, self.i).end()

    def sign(self) -> str:
        return self.t[self.i : self.i + 1]

    def match(self, *patterns: re.Pattern) -> str | None:
        for p in patterns:
            if m := p.match(self.t, self.i):
                self.i = m.end()
                return m[0]
        return None

    def key(self) -> list[str]:
        parts = []
        while True:
            self.skip(_INLINE)
            part = self.match(_BARE, _BASIC, _LITERAL)
            if part is None:
                self.fail("expected a key")
            if part[0] == '"':
                part = _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _SHORT.get(m[3], m[3]), part[1:-1])
            elif part[0] == "'":
                part = part[1:-1]
            parts.append(part)
            self.skip(_INLINE)
            if self.sign() != ".":
                return parts
            self.i += 1

    def scalar(self) -> None:
        start = self.i
        if self.match(_MULTI, _BASIC, _LITERAL):
            return
        if m := _MOMENT.match(self.t, self.i):
            self.i = m.end()
            year, month, day, *time = m.groups()
            hour, minute, second = time[:3] if year else time[3:]
            try:
                datetime.datetime(*map(int, (year or 2000, month or 1, day or 1, hour or 0, minute or 0, second or 0)))
            except ValueError:
                self.fail("no such date or time", start)
            return
        if not self.match(_PLAIN):
            self.fail("invalid value")

    def value(self) -> None:
        """A value; arrays and inline tables that it opens lie on a stack, the latter with their keys."""
        stack: list[_Table | None] = []
        while True:
            c = self.sign()
            if c == "[":
                self.i += 1
                stack.append(None)
                self.skip(_TOML_BLANK)
                if self.sign() != "]":
                    continue
            elif c == "{":
                self.i += 1
                stack.append(_Table("inline"))
                self.skip(_INLINE)
                if self.sign() != "}":
                    self.assigned(stack[-1])
                    continue
            else:
                self.scalar()
            # a value, or the begin of an empty container, lies behind: close what ends here
            while stack:
                table = stack[-1]
                self.skip(_TOML_BLANK if table is None else _INLINE)
                c = self.sign()
                if c == ("]" if table is None else "}"):
                    self.i += 1
                    stack.pop()
                elif c == ",":
                    self.i += 1
                    if table is not None:
                        self.assigned(table)
                        break
                    self.skip(_TOML_BLANK)
                    if self.sign() != "]":
                        break
                else:
                    self.fail("expected ',' or ']'" if table is None else "expected ',' or '}'")
            else:
                return

    def assigned(self, table: _Table) -> None:
        """`key =` of a table: the key is entered, dotted parts make tables."""
        start = self.i
        parts = self.key()
        if self.sign() != "=":
            self.fail("expected '='")
        self.i += 1
        self.skip(_INLINE)
        for part in parts[:-1]:
            below = table.keys.setdefault(part, _Table("dotted", self.number))
            if below is None or below.made in ("header", "array"):
                self.fail("a key below what is complete", start)
            below.made = "dotted"
            table = below
        if parts[-1] in table.keys:
            self.fail("duplicate key", start)
        table.keys[parts[-1]] = None

    def header(self, array: bool) -> None:
        start = self.i
        parts = self.key()
        closing = "]]" if array else "]"
        if not self.t.startswith(closing, self.i):
            self.fail(f"expected '{closing}'")
        self.i += len(closing)
        table = self.root
        for part in parts[:-1]:
            below = table.keys.setdefault(part, _Table("above"))
            if below is None:
                self.fail("a table below a value", start)
            table = below
        last = table.keys.get(parts[-1], table)
        if last is table:
            self.here = table.keys[parts[-1]] = _Table("array" if array else "header")
        elif last is None or array and last.made != "array" or not array and last.made != "above":
            self.here = _Table("header")  # its keys are read all the same
            self.fail("duplicate table", start)
        elif array:
            last.keys = {}
            self.here = last
        else:
            last.made = "header"
            self.here = last

    def statement(self) -> None:
        self.number += 1
        if self.t.startswith("[[", self.i):
            self.i += 2
            self.header(True)
        elif self.t[self.i] == "[":
            self.i += 1
            self.header(False)
        else:
            self.assigned(self.here)
            self.value()
        if not self.match(_LINE_END) and self.i < len(self.t):
            self.fail("text after the statement")


def toml_errors(text: str) -> list[tuple[int, str]]:
    text = text.replace("\r\n", "\n")
    parser, errors, lines = _Toml(text), [], Lines(text)
    while True:
        parser.skip(_TOML_BLANK)
        if parser.i >= len(text):
            break
        try:
            parser.statement()
        except Refused as e:
            errors.append((lines.of(e.at), e.message))
            parser.i = text.find("\n", max(e.at, parser.i)) + 1
            if not parser.i:
                break
    return errors


_SECTION = re.compile(r"\[(.+)\]")
_OPTION = re.compile(r"(.*?)\s*[=:]")


def ini_errors(text: str) -> list[tuple[int, str]]:
    """Sections, options with values and continuation lines, the statements of the dialect; a section (but DEFAULT) and an
    option of a section may stand only once."""
    errors: list[tuple[int, str]] = []
    sections: dict[str, set[str]] = {}
    options: set[str] | None = None
    option, indent = False, 0
    for number, line in enumerate(text.split("\n"), 1):
        value = line.strip()
        if not value or value[0] in "#;":
            continue
        level = len(line) - len(line.lstrip())
        if options is not None and option and level > indent:
            continue
        indent = level
        if m := _SECTION.match(value):
            name, option = m[1], False
            if name in sections and name != "DEFAULT":
                errors.append((number, "duplicate section"))
            options = sections.setdefault(name, set())
        elif options is None:
            errors.append((number, "no section header"))
            options = sections.setdefault("", set())
        elif m := _OPTION.match(value):
            name, option = m[1].rstrip().lower(), True
            if not name:
                errors.append((number, "no option name"))
            elif name in options:
                errors.append((number, "duplicate option"))
            options.add(name)
        else:
            errors.append((number, "neither section nor option"))
    return errors
