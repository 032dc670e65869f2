"""Current JavaScript: a text is valid if it is a script or a module.

Statements are parsed by recursive descent, expressions by precedence climbing; patterns are parsed as literals and
judged when `=` or `=>` follows. Line ends stay in the class string, as semicolons may be left out before them. After an
error in a statement the parser goes on behind the next line end or semicolon (panic mode).
"""

from __future__ import annotations

import re

from riskloom.llm.grammar import MEMORY, Lines, Refused, to_any_depth

_WORD = r"(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$\u200c\u200d]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*"
_NUMBER = (
    r"0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[oO][0-7](?:_?[0-7])*n?|0[bB][01](?:_?[01])*n?"
    r"|(?:0|[1-9](?:_?\d)*)n|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?"
)
_STRING = r'"[^"\\\n]*(?:\\.[^"\\\n]*)*"|' + r"'[^'\\\n]*(?:\\.[^'\\\n]*)*'"
_PUNCTUATOR = (
    r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--"
    r"|[-+*/%&|^]=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.]"
)
_COMMENT = r"/\*[^*]*\*+(?:[^/*][^*]*\*+)*/"
_REGEX = r"/(?![*/])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*"
_AHEAD = "".join(f"(?<=[=(,:\\[!&|?{{}};+*%~^<>-]{' ' * k})|" for k in range(3)) + r"(?<=return )|(?<=\n)|(?<=\A)|(?<=typeof )|(?<=case )|"
_SKIP = "[ \t\x0b\x0c\xa0\ufeff]*(?://[^\n\u2028\u2029]*)?"
_NEWLINES = r"[\n\u2028\u2029]\s*"
_TOKEN = re.compile(
    rf"{_SKIP}({_NEWLINES}|{_COMMENT}|#?{_WORD}|(?:{_NUMBER})[\w$]*|{_STRING}"
    r"|`[^`\\$]*(?:(?:\\.|\$(?!\{)|\$\{[^{}`]*\})[^`\\$]*)*`"
    rf"|(?:{_AHEAD}(?!)){_REGEX}|{_PUNCTUATOR}|\Z|.)",
    re.DOTALL,
)
_PLAIN = re.compile(rf"{_SKIP}({_NEWLINES}|{_COMMENT}|#?{_WORD}|(?:{_NUMBER})[\w$]*|{_STRING}|{_PUNCTUATOR}|\Z|.)", re.DOTALL)
_REGEX_AT = re.compile(_REGEX)
_GOOD_NUMBER = re.compile(rf"(?:{_NUMBER})\Z")
_HOLES = re.compile(r"(?:\\.|[^\\$]|\$(?!\{))*?\$\{([^{}`]*)\}", re.DOTALL)
_SIMPLE_HOLE = re.compile(r"\s*[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*\s*\Z")
BAD = "\x02"

#: Class of each keyword and punctuator; n name, d number, s string, t template, r regular expression, # private name.
_CLASSES = {
    "var": "v", "let": "l", "const": "c", "function": "F", "class": "K", "extends": "e", "return": "R", "if": "I",
    "else": "E", "for": "O", "while": "W", "do": "D", "switch": "S", "case": "C", "default": "f", "break": "b",
    "continue": "B", "throw": "T", "try": "Y", "catch": "h", "finally": "y", "new": "N", "delete": "u", "void": "u",
    "typeof": "u", "in": "i", "instanceof": "o", "this": "q", "null": "q", "true": "q", "false": "q", "super": "U",
    "import": "M", "export": "X", "await": "w", "yield": "Z", "async": "a", "of": "p", "get": "g", "set": "g",
    "static": "j", "from": "m", "as": "A", "debugger": "G", "with": "H", "enum": "z",
    "=": "=", "=>": ">", "||": "|", "??": "|", "&&": "&", "|": "V", "^": "V", "&": "V", "+": "+", "-": "+", "*": "*",
    "/": "/", "%": "/", "**": "P", "!": "!", "~": "!", "++": '"', "--": '"', "?": "?", "?.": "`", ".": ".", "...": "3",
    "(": "(", ")": ")", "[": "[", "]": "]", "{": "{", "}": "}", ",": ",", ";": ";", ":": ":", "": "",
    **dict.fromkeys(("==", "!=", "===", "!==", "<", ">", "<=", ">="), "<"),
    **dict.fromkeys(("<<", ">>", ">>>"), "L"),
    **dict.fromkeys(("+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="), "^"),
}
_NAMES = frozenset("nalpgjmAwZ")
_WORDS = frozenset("nvlcFKeRIEOWDSCfbBTYhyNuioqUMXwZapgjmAGHz")
_POWER = {"|": 1, "&": 2, "V": 3, "<": 4, "i": 4, "o": 4, "L": 5, "+": 6, "*": 7, "/": 7}
OTHER, NAME, MEMBER, LITERAL, PATTERN, DEFAULT = 0, 1, 2, 3, 4, 5
FUNCTION, ASYNC, GENERATOR, LOOP, SWITCH, METHOD = 1, 2, 4, 8, 16, 32
_COMPOUND = frozenset("{IEOWDSYFKHXMah")


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
        c = token[0]
        if c in "\n\u2028\u2029":
            return "\n"
        if c in "\"'":
            return "s" if len(token) > 1 and token[-1] == c else BAD
        if c == "`":
            return "t" if len(token) > 1 and _holes_hold(token) else BAD
        if c == "/":
            if token[1:2] == "*":
                return "\n" if re.search("[\n\u2028\u2029]", token) else ""
            return _regex_class(token)
        if c == "#":
            return "#" if len(token) > 1 else BAD
        if c.isdigit() or c == ".":
            return "d" if _GOOD_NUMBER.match(token) else BAD
        return "n" if c.isalpha() or c in "_$\\" or c.isidentifier() else BAD


def _regex_class(token: str) -> str:
    """r for a regular expression whose groups, classes and flags are in order."""
    end = token.rindex("/")
    flags = token[end + 1 :]
    if len(set(flags)) < len(flags) or set(flags) - set("dgimsuvy"):
        return BAD
    body = re.sub(r"\\.|\[(?:[^\]\\]|\\.)*\]", "a", token[1:end])
    depth = 0
    for c in body:
        depth += (c == "(") - (c == ")")
        if depth < 0:
            return BAD
    return BAD if depth or re.search(r"(?:^|[(|])[*+]|^\?|\|\?|\(\?(?![:=!<ims-])", body) else "r"


def _holes_hold(token: str) -> bool:
    at = 1
    while m := _HOLES.match(token, at):
        at = m.end()
        if not _SIMPLE_HOLE.match(m[1]) and not _is_expression(classes(m[1])):
            return False
    return True


def _is_expression(shape: str) -> bool:
    p = Parser(shape)
    p.context = FUNCTION | ASYNC | METHOD
    try:
        p.expression()
        return p.peek() == "\0"
    except Refused:
        return False


_classes = _Classes(_CLASSES)
_LINES = re.compile("\n\n+")


def classes(text: str) -> str:
    return _LINES.sub("\n", "".join(map(_classes.__getitem__, _TOKEN.findall(text))))


def _template(text: str, at: int) -> tuple[int, bool]:
    """(end, whether it is in order) of the template that begins at `at`, its substitutions nested to any depth."""
    at += 1
    while at < len(text):
        c = text[at]
        if c == "\\":
            at += 2
        elif c == "`":
            return at + 1, True
        elif text.startswith("${", at):
            marks, places, at, closed = _scan(text, at + 2, nested=True)
            if not closed or not _is_expression(_LINES.sub("\n", "".join(marks))):
                return at, False
        else:
            at += 1
    return at, False


def _scan(text: str, at: int = 0, nested: bool = False) -> tuple[list[str], list[int], int, bool]:
    """Classes with their offsets by a tokenizer that follows the context: `/` begins a regular expression where an
    operand may begin, and templates are read with their substitutions. Nested: up to the `}` that closes the hole."""
    marks: list[str] = []
    places: list[int] = []
    operand = True
    open_: list[tuple[str, bool]] = []  # brackets: (class, whether an operand may follow the closing one)
    last, before = "", ""
    while True:
        m = _PLAIN.match(text, at)
        token, start = m[1], m.start(1)
        at = m.end()
        if not token:
            return marks, places, at, not nested
        if token[0] == "/" and operand and not token.startswith("/*") and (r := _REGEX_AT.match(text, start)):
            mark, at = _regex_class(r[0]), r.end()
        elif token == "`":
            at, good = _template(text, start)
            mark = "t" if good else BAD
        else:
            mark = _classes[token]
        if mark == "" or mark == "\n":
            if mark:
                marks.append(mark)
                places.append(start)
            continue
        if nested and mark == "}" and not open_:
            return marks, places, at, True
        if mark == "(":
            open_.append(("(", last in "IWOH" and last != "" and before != "."))
            operand = True
        elif mark == "{":
            block = last in ("", ";", "{", "}", ")", ">", "E", "D", "Y", "y") 
            open_.append(("{", block))
            operand = True
        elif mark == "[":
            open_.append(("[", False))
            operand = True
        elif mark in ")]}":
            operand = open_.pop()[1] if open_ else False
        elif mark in "ndstrq#U" or mark in "lapgjmAj":
            operand = False
        elif mark in _WORDS:
            operand = last != "."
        elif mark != '"':
            operand = True
        marks.append(mark)
        places.append(start)
        before, last = last, mark


#: Statement and header shapes that were parsed without an error, by context.
_shapes: dict[str, bool] = {}


class Parser:
    def __init__(self, shape: str):
        self.s, self.i = shape + "\0", 0
        self.context = 0
        self.cover = -1  # index behind a parenthesised list that may head an arrow function
        self.params = False
        self.errors: list[tuple[int, str]] = []
        self.module = False
        self.no_in = False

    def fail(self, message: str, at: int | None = None):
        raise Refused(self.i if at is None else at, message)

    def peek(self) -> str:
        c = self.s[self.i]
        if c == "\n":
            self.i += 1
            c = self.s[self.i]
        return c

    def take(self, c: str) -> bool:
        if self.peek() == c:
            self.i += 1
            return True
        return False

    def need(self, c: str) -> None:
        if self.peek() != c:
            self.fail(f"expected '{c}'" if c not in "\0\x02" else "unexpected end")
        self.i += 1

    def ahead(self, k: int = 1) -> str:
        """The class k tokens behind the current one, line ends left out."""
        i = self.i
        while True:
            if self.s[i] == "\0":
                return "\0"
            i += 1
            if self.s[i] == "\n":
                i += 1
            k -= 1
            if not k:
                return self.s[i]

    def fresh_line(self) -> bool:
        """Whether a line end stands before the current token."""
        return self.s[self.i] == "\n" or self.i > 0 and self.s[self.i - 1] == "\n"

    # statements

    def program(self) -> None:
        self.statements("\0")
        if self.s[self.i] != "\0":
            self.errors.append((self.i, "unexpected '}'"))

    def statements(self, close: str) -> None:
        while True:
            c = self.peek()
            if c == close or c == "\0":
                return
            start = self.i
            if c == "}" and close == "\0":
                self.errors.append((self.i, "unexpected '}'"))
                self.i += 1
                continue
            if c == "C" or c == "f":
                if self.context & SWITCH and close == "}":
                    return
            keep = self.context, self.no_in
            try:
                self.statement(top=close == "\0")
            except Refused as e:
                self.context, self.no_in = keep
                self.errors.append((e.at, e.message))
                self.i = max(start, min(e.at, len(self.s) - 1))
                while self.s[self.i] not in "\n;\0":
                    self.i += 1
                if self.s[self.i] != "\0":
                    self.i += 1

    def block(self) -> None:
        self.need("{")
        self.statements("}")
        self.need("}")

    def end(self) -> None:
        c = self.peek()
        if c == ";":
            self.i += 1
        elif c != "}" and c != "\0" and not self.fresh_line():
            self.fail("unexpected token" if c != BAD else "invalid token")

    def remembered(self, stop: str, tag: str, parse) -> None:
        """Runs `parse`, or skips to the next `stop` where this very shape is known to be parsed up to it."""
        s, i = self.s, self.i
        j = s.find(stop, i, i + 240)
        if j < 0:
            parse()
            return
        j += stop == ";"
        key = chr(0x100 + self.context) + tag + s[i:j]
        if key in _shapes:
            self.i = j
            return
        count, module = len(self.errors), self.module
        parse()
        if self.i == j and len(self.errors) == count and self.module == module:
            if len(_shapes) > MEMORY:
                _shapes.clear()
            _shapes[key] = True

    def statement(self, top: bool = False) -> None:
        c = self.peek()
        if c not in _COMPOUND:
            self.remembered(";", "s", self.plain)
        elif c == "{":
            self.block()
        elif c == "I":
            self.i += 1
            self.remembered("{", "(", self.condition)
            self.statement()
            if self.peek() == "E":
                self.i += 1
                self.statement()
        elif c == "O":
            self.i += 1
            if self.peek() == "w":
                self.i += 1
            self.remembered("{", "o", self.for_head)
            self.body_of_loop()
        elif c == "W":
            self.i += 1
            self.remembered("{", "(", self.condition)
            self.body_of_loop()
        elif c == "D":
            self.i += 1
            self.body_of_loop()
            self.need("W")
            self.condition()
            self.take(";")
        elif c == "S":
            self.i += 1
            self.condition()
            self.need("{")
            keep = self.context
            self.context |= SWITCH
            default = False
            while not self.take("}"):
                if self.take("f"):
                    if default:
                        self.fail("more than one default clause")
                    default = True
                else:
                    self.need("C")
                    self.expression()
                self.need(":")
                self.statements("}")
            self.context = keep
        elif c == "Y":
            self.i += 1
            self.unswitched_block()
            caught = False
            if self.take("h"):
                caught = True
                if self.take("("):
                    self.binding()
                    self.need(")")
                self.unswitched_block()
            if self.take("y"):
                caught = True
                self.unswitched_block()
            if not caught:
                self.fail("expected 'catch' or 'finally'")
        elif c == "F":
            self.i += 1
            self.function(named=True)
        elif c == "a":
            if self.s[self.i + 1] == "F":
                self.i += 2
                self.function(named=True, asynchronous=True)
            else:
                self.remembered(";", "s", self.plain)
        elif c == "K":
            self.i += 1
            self.class_(named=True)
        elif c == "H":
            self.i += 1
            self.condition()
            self.statement()
        elif c == "M":
            if self.ahead() in "(.":
                self.plain()
            elif not top:
                self.fail("import declarations may only appear at top level")
            else:
                self.import_()
        elif c == "X":
            if not top:
                self.fail("export declarations may only appear at top level")
            self.export()
        else:
            self.fail("unexpected token")

    def unswitched_block(self) -> None:
        keep = self.context
        self.block()
        self.context = keep

    def body_of_loop(self) -> None:
        keep = self.context
        self.context |= LOOP
        self.statement()
        self.context = keep

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def plain(self) -> None:
        c = self.peek()
        if c == "v" or c == "c" or c == "l" and (self.ahead() in _NAMES or self.ahead() in "[{"):
            self.i += 1
            self.declarations(c == "c")
            self.end()
        elif c == "R":
            if not self.context & FUNCTION:
                self.fail("'return' outside function")
            self.i += 1
            if self.s[self.i] not in "\n;}\0":
                self.expression()
            self.end()
        elif c == "b" or c == "B":
            self.i += 1
            if self.s[self.i] in _NAMES:
                self.i += 1
            elif not self.context & LOOP and not (c == "b" and self.context & SWITCH):
                self.fail("'break' or 'continue' outside loop", self.i - 1)
            self.end()
        elif c == "T":
            self.i += 1
            if self.s[self.i] == "\n":
                self.fail("line end after 'throw'")
            self.expression()
            self.end()
        elif c == ";":
            self.i += 1
        elif c == "G":
            self.i += 1
            self.end()
        elif c in _NAMES and self.ahead() == ":":
            self.i += 1
            self.need(":")
            self.statement()
        else:
            self.expression()
            self.end()

    def declarations(self, constant: bool, loop: bool = False) -> None:
        while True:
            pattern = self.peek() in "[{"
            self.binding()
            if self.take("="):
                self.checked(self.assignment())
            elif (constant or pattern) and not (loop and self.peek() in "pi"):
                self.fail("a declaration lacks its initializer")
            if not self.take(","):
                return

    def for_head(self) -> None:
        self.need("(")
        c = self.peek()
        keep, self.no_in = self.no_in, True
        if c == "v" or c == "c" or c == "l" and (self.ahead() in _NAMES or self.ahead() in "[{"):
            self.i += 1
            self.declarations(c == "c", loop=True)
            assignable = True
        elif c == ";":
            assignable = False
        else:
            kind = self.comma_list()
            assignable = kind in (NAME, MEMBER, LITERAL, PATTERN)
            if kind == PATTERN and self.peek() not in "pi":
                self.fail("invalid shorthand initializer")
        self.no_in = keep
        c = self.peek()
        if c == "p" or c == "i":
            if not assignable:
                self.fail("invalid left-hand side of for")
            self.i += 1
            self.checked(self.assignment()) if c == "p" else self.expression()
        else:
            self.need(";")
            if self.peek() != ";":
                self.expression()
            self.need(";")
            if self.peek() != ")":
                self.expression()
        self.need(")")

    def binding(self) -> None:
        """A name or pattern that is declared."""
        c = self.peek()
        if c in _NAMES:
            self.i += 1
        elif c == "[":
            self.i += 1
            while not self.take("]"):
                if self.take(","):
                    continue
                rest = self.take("3")
                self.binding()
                if not rest and self.take("="):
                    self.checked(self.assignment())
                if rest or self.peek() != "]":
                    self.need("]" if rest else ",")
                    if rest:
                        return
        elif c == "{":
            self.i += 1
            while not self.take("}"):
                if self.take("3"):
                    self.binding()
                    self.need("}")
                    return
                short = self.peek() in _NAMES
                self.key()
                if self.take(":"):
                    self.binding()
                elif not short:
                    self.fail("expected ':'")
                if self.take("="):
                    self.checked(self.assignment())
                if self.peek() != "}":
                    self.need(",")
        else:
            self.fail("expected a name or pattern")

    def string(self) -> None:
        self.need("s")
        if self.peek() == "H" and self.ahead() == "{":
            self.i += 1
            self.object()

    def import_(self) -> None:
        self.module = True
        self.i += 1
        if self.peek() != "s":
            if self.peek() in _NAMES:
                self.i += 1
                more = self.take(",")
            else:
                more = True
            if more:
                if self.take("*"):
                    self.need("A")
                    self.name()
                else:
                    self.specifiers(local_last=True)
            self.need("m")
        self.string()
        self.end()

    def name(self) -> None:
        if self.peek() not in _NAMES:
            self.fail("expected a name")
        self.i += 1

    def specifiers(self, local_last: bool) -> None:
        self.need("{")
        while not self.take("}"):
            c = self.peek()
            if c not in _WORDS and c != "s":
                self.fail("expected a name")
            self.i += 1
            renamed = self.take("A")
            if renamed:
                if self.peek() not in (_NAMES if local_last else _WORDS) and (local_last or self.peek() != "s"):
                    if self.peek() in ",}" and c == "A":
                        renamed = False
                    else:
                        self.fail("expected a name")
                else:
                    self.i += 1
            if local_last and not renamed and c not in _NAMES:
                self.fail("expected a name")
            if self.peek() != "}":
                self.need(",")

    def export(self) -> None:
        self.module = True
        self.i += 1
        c = self.peek()
        if c == "f":
            self.i += 1
            c = self.peek()
            if c == "F":
                self.i += 1
                self.function(named=False)
            elif c == "a" and self.s[self.i + 1] == "F":
                self.i += 2
                self.function(named=False, asynchronous=True)
            elif c == "K":
                self.i += 1
                self.class_(named=False)
            else:
                self.checked(self.assignment())
                self.end()
        elif c == "*":
            self.i += 1
            if self.take("A"):
                if self.peek() not in _WORDS and self.peek() != "s":
                    self.fail("expected a name")
                self.i += 1
            self.need("m")
            self.string()
            self.end()
        elif c == "{":
            self.specifiers(local_last=False)
            if self.take("m"):
                self.string()
            self.end()
        elif c in "vclFKa":
            if c == "a" and self.s[self.i + 1] != "F":
                self.fail("unexpected token")
            self.statement()
        else:
            self.fail("unexpected token after 'export'")

    # functions and classes

    def function(self, named: bool, asynchronous: bool = False) -> None:
        """Behind the keyword."""
        generator = self.take("*")
        if self.peek() in _NAMES:
            self.i += 1
        elif named:
            self.fail("expected a function name")
        self.callable(asynchronous, generator, 0)

    def callable(self, asynchronous: bool, generator: bool, method: int) -> None:
        """Parameters and body."""
        keep, no_in = self.context, self.no_in
        self.context = FUNCTION | ASYNC * asynchronous | GENERATOR * generator | method
        self.no_in = False
        self.remembered("{", "p", self.parameters)
        self.block()
        self.context, self.no_in = keep, no_in

    def parameters(self) -> None:
        self.need("(")
        while not self.take(")"):
            rest = self.take("3")
            self.binding()
            if rest:
                self.need(")")
                return
            if self.take("="):
                self.checked(self.assignment())
            if self.peek() != ")":
                self.need(",")

    def class_(self, named: bool) -> None:
        if self.peek() in _NAMES:
            self.i += 1
        elif named:
            self.fail("expected a class name")
        if self.take("e"):
            self.checked(self.unary())
        self.need("{")
        while not self.take("}"):
            if self.take(";"):
                continue
            if self.peek() == "j" and self.ahead() not in "(=;}":
                self.i += 1
                if self.peek() == "{":
                    keep = self.context
                    self.context = METHOD
                    self.block()
                    self.context = keep
                    continue
            asynchronous = generator = False
            if self.peek() == "a" and self.ahead() not in "(=;}" and self.s[self.i + 1] != "\n":
                self.i += 1
                asynchronous = True
            if self.take("*"):
                generator = True
            if self.peek() == "g" and self.ahead() not in "(=;}" and not generator and not asynchronous:
                self.i += 1
                self.key(private=True)
                self.callable(False, False, METHOD)
                continue
            self.key(private=True)
            if self.peek() == "(":
                self.callable(asynchronous, generator, METHOD)
            else:
                if asynchronous or generator:
                    self.fail("expected '('")
                if self.take("="):
                    keep = self.context
                    self.context = METHOD
                    self.checked(self.assignment())
                    self.context = keep
                self.end()

    def key(self, private: bool = False) -> None:
        c = self.peek()
        if c in _WORDS or c in "sd" or private and c == "#":
            self.i += 1
        elif c == "[":
            self.i += 1
            keep, self.no_in = self.no_in, False
            self.checked(self.assignment())
            self.no_in = keep
            self.need("]")
        else:
            self.fail("expected a property name" if c != BAD else "invalid token")

    # expressions

    def checked(self, kind: int) -> int:
        if kind == PATTERN:
            self.fail("invalid shorthand initializer")
        return kind

    def expression(self) -> int:
        keep, self.no_in = self.no_in, False
        kind = self.checked(self.comma_list())
        self.no_in = keep
        return kind

    def comma_list(self) -> int:
        kind = self.assignment()
        while self.take(","):
            self.checked(kind)
            self.checked(self.assignment())
            kind = OTHER
        return kind

    def assignment(self) -> int:
        c = self.peek()
        s = self.s
        if c in _NAMES:
            following = s[self.i + 1]
            if following == ">":
                self.i += 1
                return self.arrow(False)
            if c == "a" and following in _NAMES and s[self.i + 2] == ">":
                self.i += 2
                return self.arrow(True)
            if c == "Z" and self.context & GENERATOR:
                self.i += 1
                if s[self.i] == "*":
                    self.i += 1
                    self.checked(self.assignment())
                elif s[self.i] not in "\n)]},;:\0":
                    self.checked(self.assignment())
                return OTHER
        start = self.i
        kind = self.binary(0)
        c = self.peek()
        if c == ">" and self.cover == self.i and s[start] in "(a":
            return self.arrow(s[start] == "a")
        if c == "?":
            self.checked(kind)
            self.i += 1
            keep, self.no_in = self.no_in, False
            self.checked(self.assignment())
            self.no_in = keep
            self.need(":")
            self.checked(self.assignment())
            return OTHER
        if c == "=":
            if kind not in (NAME, MEMBER, LITERAL, PATTERN):
                self.fail("invalid assignment target", start)
            self.i += 1
            self.checked(self.assignment())
            return DEFAULT
        if c == "^":
            if kind not in (NAME, MEMBER):
                self.fail("invalid assignment target", start)
            self.i += 1
            self.checked(self.assignment())
            return OTHER
        return kind

    def arrow(self, asynchronous: bool) -> int:
        """At `=>`."""
        self.i += 1
        keep = self.context
        self.context = FUNCTION | ASYNC * asynchronous | keep & METHOD
        if self.peek() == "{":
            no_in, self.no_in = self.no_in, False
            self.block()
            self.no_in = no_in
        else:
            self.checked(self.assignment())
        self.context = keep
        return OTHER

    def binary(self, least: int) -> int:
        """Precedence climbing."""
        kind = self.unary()
        while True:
            c = self.peek()
            power = _POWER.get(c)
            if power is None or power <= least or c == "i" and self.no_in:
                return kind
            self.checked(kind)
            self.i += 1
            self.checked(self.binary(power))
            kind = OTHER

    def unary(self, power: bool = True) -> int:
        c = self.peek()
        if c in "u!+":
            self.i += 1
            self.checked(self.unary(power=False))
            if self.peek() == "P":
                self.fail("unary operator before '**' needs parentheses")
            return OTHER
        if c == '"':
            self.i += 1
            at = self.i
            if self.unary() not in (NAME, MEMBER):
                self.fail("invalid operand of prefix operator", at)
            return OTHER
        if c == "w" and (self.context & ASYNC or not self.context & FUNCTION and self.ahead() not in "=.)],;:?^<|&\0>}*/"):
            self.i += 1
            self.checked(self.unary())
            return OTHER
        if c == "#":
            self.i += 1
            if self.peek() != "i":
                self.fail("unexpected private name")
            return OTHER
        kind = self.postfix()
        if power and self.peek() == "P":
            self.checked(kind)
            self.i += 1
            self.checked(self.unary())
            return OTHER
        return kind

    def postfix(self) -> int:
        kind = self.chain(self.primary())
        if self.s[self.i] == '"' and not self.fresh_line():
            if kind not in (NAME, MEMBER):
                self.fail("invalid operand of postfix operator")
            self.i += 1
            return OTHER
        return kind

    def chain(self, kind: int, calls: bool = True) -> int:
        optional = False
        while True:
            c = self.peek()
            if c == ".":
                self.i += 1
                c = self.peek()
                if c not in _WORDS and c != "#":
                    self.fail("expected a property name")
                self.i += 1
                kind = OTHER if optional else MEMBER
            elif c == "(" and calls:
                at = self.i
                self.i += 1
                self.arguments()
                kind = OTHER
                if self.peek() == ">" and self.s[at - 1] == "a" and not self.fresh_line():
                    self.cover = self.i
            elif c == "[":
                self.checked(kind)
                self.i += 1
                self.expression()
                self.need("]")
                kind = OTHER if optional else MEMBER
            elif c == "`" and calls:
                self.i += 1
                optional = True
                c = self.peek()
                if c in _WORDS or c == "#":
                    self.i += 1
                elif c not in "([":
                    self.fail("unexpected token after '?.'")
                kind = OTHER
            elif c == "t":
                self.i += 1
                kind = OTHER
            else:
                return kind

    def arguments(self) -> None:
        keep, self.no_in = self.no_in, False
        while not self.take(")"):
            self.take("3")
            kind = self.assignment()
            if kind == PATTERN and not self.cover_ahead():
                self.fail("invalid shorthand initializer")
            if self.peek() != ")":
                self.need(",")
        self.no_in = keep

    def cover_ahead(self) -> bool:
        return ">" in self.s[self.i : self.i + 200]

    def primary(self) -> int:
        c = self.peek()
        if c == "a" and self.s[self.i + 1] == "F":
            self.i += 2
            self.function(named=False, asynchronous=True)
            return OTHER
        if c in _NAMES:
            if c == "w" and self.context & ASYNC:
                self.fail("unexpected 'await'")
            self.i += 1
            return NAME
        if c in "dstrq":
            self.i += 1
            return OTHER
        if c == "(":
            return self.parenthesised()
        if c == "[":
            return self.array()
        if c == "{":
            return self.object()
        if c == "F":
            self.i += 1
            self.function(named=False)
            return OTHER
        if c == "K":
            self.i += 1
            self.class_(named=False)
            return OTHER
        if c == "N":
            self.i += 1
            if self.take("."):
                if self.peek() not in _NAMES:
                    self.fail("expected 'target'")
                self.i += 1
                return OTHER
            if self.peek() == "M":
                self.fail("cannot use new with import")
            self.chain(self.primary(), calls=False)
            if self.peek() == "(":
                self.i += 1
                self.arguments()
            return OTHER
        if c == "U":
            self.i += 1
            if self.peek() not in "(.[" or not self.context & METHOD:
                self.fail("'super' is unexpected here")
            return OTHER
        if c == "M":
            self.i += 1
            if self.peek() == ".":
                self.i += 1
                self.name()
                return OTHER
            if self.peek() != "(":
                self.fail("unexpected 'import'")
            return OTHER
        self.fail("unexpected end" if c == "\0" else "invalid token" if c == BAD else "unexpected token")

    def parenthesised(self) -> int:
        start = self.i
        self.i += 1
        keep, self.no_in = self.no_in, False
        only_arrow = pattern_ok = False
        kinds = []
        while not self.take(")"):
            if self.take("3"):
                self.binding()
                self.need(")")
                only_arrow = True
                break
            kinds.append(self.assignment())
            if self.peek() != ")":
                self.need(",")
                if self.peek() == ")":
                    only_arrow = True
        self.no_in = keep
        pattern_ok = all(k in (NAME, LITERAL, PATTERN, DEFAULT) for k in kinds)
        if self.s[self.i] == ">":
            if not pattern_ok:
                self.fail("invalid arrow function parameters", start)
            self.cover = self.i
            return OTHER
        if only_arrow or not kinds:
            self.fail("expected '=>'")
        for kind in kinds:
            self.checked(kind)
        return kinds[0] if len(kinds) == 1 and kinds[0] in (NAME, MEMBER) else OTHER

    def array(self) -> int:
        self.i += 1
        keep, self.no_in = self.no_in, False
        found = LITERAL
        while not self.take("]"):
            if self.take(","):
                continue
            spread = self.take("3")
            kind = self.assignment()
            if kind == OTHER or spread and kind == DEFAULT:
                found = OTHER if found != PATTERN else self.fail("invalid shorthand initializer")
            elif kind == PATTERN:
                if found == OTHER:
                    self.fail("invalid shorthand initializer")
                found = PATTERN
            if self.peek() != "]":
                self.need(",")
        self.no_in = keep
        return found

    def object(self) -> int:
        self.i += 1
        keep, self.no_in = self.no_in, False
        found = LITERAL
        while not self.take("}"):
            c = self.peek()
            if c == "3":
                self.i += 1
                if self.assignment() not in (NAME, MEMBER) and found == LITERAL:
                    found = OTHER
            else:
                kind = self.property(c)
                if kind == OTHER and found == LITERAL:
                    found = OTHER
                elif kind == PATTERN:
                    if found == OTHER:
                        self.fail("invalid shorthand initializer")
                    found = PATTERN
            if self.peek() != "}":
                self.need(",")
        self.no_in = keep
        return found

    def property(self, c: str) -> int:
        following = self.ahead()
        if c == "*" or c == "a" and following not in "(:,}=" or c == "g" and following not in "(:,}=":
            self.i += 1
            generator = c == "*" or self.take("*")
            self.key()
            self.callable(c == "a", generator, METHOD)
            return OTHER
        self.key()
        d = self.peek()
        if d == ":":
            self.i += 1
            kind = self.assignment()
            return kind if kind in (OTHER, PATTERN) else LITERAL
        if d == "(":
            self.callable(False, False, METHOD)
            return OTHER
        if c not in _NAMES:
            self.fail("expected ':'")
        if d == "=":
            self.i += 1
            self.checked(self.assignment())
            return PATTERN
        return LITERAL


def _parse(shape: str) -> list[tuple[int, str]]:
    parser = Parser(shape)
    to_any_depth(parser.program, len(shape))
    return parser.errors


def check(text: str) -> list[tuple[int, str]]:
    """(line, message) of every error; an empty text is valid."""
    if text[:1] == "\ufeff":
        text = text[1:]
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text.startswith("#!"):
        text = "//" + text[2:]
    if not _parse(classes(text)):
        return []
    # the quick tokenizer may have taken a division for a regular expression, or met nested templates
    marks, places, _, _ = _scan(text)
    shape, offsets = [], []
    for mark, place in zip(marks, places):
        if mark != "\n" or not shape or shape[-1] != "\n":
            shape.append(mark)
            offsets.append(place)
    errors = _parse("".join(shape))
    offsets.append(len(text))
    lines = Lines(text)
    return sorted({(lines.of(offsets[min(at, len(offsets) - 1)]), m) for at, m in sorted(errors)})
