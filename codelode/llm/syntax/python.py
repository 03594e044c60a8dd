"""Python: statements by indentation, expressions by precedence climbing."""

from __future__ import annotations

import re
from collections import defaultdict

from .core import Fault, Kinds, Parser, memo

_BINARY = {"or": 1, "and": 2, "in": 4, "is": 4, "<": 4, ">": 4, "<=": 4, ">=": 4, "!=": 4, "==": 4, "|": 5, "^": 6, "&": 7, "<<": 8, ">>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "//": 10, "%": 10, "@": 10, "**": 12}
_ASSIGN = frozenset("= += -= *= /= //= %= @= &= |= ^= >>= <<= **=".split())
_TOKEN = re.compile(
    r'""|\n[ \t\f]*|[^\W\d]\w*|0[xX][0-9a-fA-F_]+|0[oO][0-7_]+|0[bB][01_]+|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9][0-9_]*)?[jJ]?(?![\w])|[0-9]\w*'
    r"|\*\*=|//=|>>=|<<=|\.\.\.|:=|->|\*\*|//|<<|>>|<=|>=|==|!=|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|\\\r?\n[ \t]*|[^\s]"
)
_PREFIX = r"(?:(?<![\w])(?:[rRuUbBfFtT]|[rR][bBfFtT]|[bBfFtT][rR]))?"


COMPOUND = frozenset("async @ def class if while for try with a".split())
#: What may follow the word match in a match statement.
MATCH_STARTS = frozenset(("a", "0", '"', "(", "[", "{", "-", "~", "+", "*", "not", "None", "True", "False", "await", "..."))


class PythonKinds(Kinds):
    def __missing__(self, token: str) -> str:
        if token[0] == "\n":
            return token
        if token[0] == "\\":
            return "" if len(token) > 1 else "\\"
        if token[0].isdigit() and not re.fullmatch(
            r"0[xX][0-9a-fA-F_]+|0[oO][0-7_]+|0[bB][01_]+|(?:[0-9][0-9_]*\.?[0-9_]*)(?:[eE][+-]?[0-9][0-9_]*)?[jJ]?", token
        ) or re.fullmatch(r"0[0-9_]*[1-9][0-9_]*", token):
            return "?"
        if token == "$" or token == "?" or token == "`" or token == "!":
            return token
        return super().__missing__(token)


class Python(Parser):
    KEYWORDS = frozenset(
        """False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try
        while with yield""".split()
    )
    OPAQUE = re.compile(
        _PREFIX + r"(?:\"\"\"(?:[^\"\\]|\\(?:.|\n)|\"(?!\"\"))*+\"\"\"|'''(?:[^'\\]|\\(?:.|\n)|'(?!''))*+'''|\"(?:[^\"\\\n]|\\(?:.|\n))*+\"|'(?:[^'\\\n]|\\(?:.|\n))*+')|#[^\n]*"
    )

    def __init__(self, text: str) -> None:
        self.memory = Parser.memories.setdefault(Python, defaultdict(dict))
        kinds = Parser.kind_tables.get(Python)
        if kinds is None:
            kinds = Parser.kind_tables[Python] = PythonKinds(self.KEYWORDS)
        self.text = text
        self.errors: list[tuple[int, str]] = []
        text = text.removeprefix("﻿")
        clean = self.OPAQUE.sub(lambda m: "" if m[0][0] == "#" else '""', text)
        self.clean = clean
        # One token ";" a logical line and its indentation aside; lines in brackets are joined.
        k: list[str] = []
        self.indents: list[tuple[int, str]] = []
        depth, pending = 0, "\n" + re.match(r"[ \t\f]*", clean)[0]
        for x in map(kinds.__getitem__, _TOKEN.findall(clean)):
            if not x:
                continue
            if x[0] == "\n":
                if depth == 0:
                    pending = x
                continue
            if pending is not None:
                if k and k[-1] != "\n":
                    k.append("\n")
                self.indents.append((len(k), pending[1:]))
                pending = None
            if x in ("(", "[", "{"):
                depth += 1
            elif x in (")", "]", "}"):
                depth = max(0, depth - 1)
            k.append(x)
        if k:
            k.append("\n")
        k.append("")
        self.k, self.new_line, self.LINES = k, set(), False
        self.marks = [i for i, x in enumerate(k) if x in ("\n", "")]
        self.mark_at = self.i = self.depth = 0
        self.no_brace = False
        self.unclosed = depth > 0

    def line_of(self, at: int) -> int:
        """The line of the at-th token: strings keep their lines while tokens are counted again."""
        clean = self.OPAQUE.sub(lambda m: ("" if m[0][0] == "#" else '""') + "\x00" * m[0].count("\n"), self.text.removeprefix("﻿"))
        line, seen, depth = 1, -1, 0
        fresh = True
        for m in re.finditer("\x00|" + _TOKEN.pattern, clean):
            x = m[0]
            if x == "\x00":
                line += 1
                continue
            if x[0] in "\n\\" and (x[0] == "\n" or len(x) > 1):
                line += x.count("\n")
                if x[0] == "\n" and depth == 0:
                    fresh = True
                continue
            if fresh and seen >= 0:
                seen += 1  # the end of the logical line before
            fresh = False
            seen += 1
            if seen >= at:
                return line
            depth += (x in "([{") - (x in ")]}")
            depth = max(depth, 0)
        return line

    def unit(self) -> None:
        widths = []
        for at, space in self.indents:
            width = 0
            for c in space:
                width = (width // 8 + 1) * 8 if c == "\t" else 0 if c == "\f" else width + 1
            widths.append((at, width))
        self.width = dict(widths)
        if widths and widths[0][1]:
            self.errors.append((0, "unexpected indent"))
        self.suite(widths[0][1] if widths else 0)
        while not self.at(""):
            self.errors.append((self.i, "a line doesn't match any outer indentation"))
            self.suite(self.width.get(self.i, 0))

    def suite(self, indent: int) -> None:
        """The lines of one indentation, with the deeper ones that belong to them."""
        while not self.at(""):
            width = self.width.get(self.i, indent)
            if width < indent:
                return
            start = self.i
            try:
                if width > indent:
                    raise self.fault("unexpected indent")
                self.statement_line(indent)
            except Fault as fault:
                self.depth = 0
                self.errors.append((fault.at, fault.message))
                self.i = max(self.i, start)
                while not self.at("\n", ""):
                    self.i += 1
                self.take("\n")
                if width > indent:
                    self.suite(width)

    def body(self, indent: int) -> None:
        """What follows a colon: simple statements on the line, or deeper lines."""
        if not self.take("\n"):
            return self.simple_line()
        width = self.width.get(self.i, -1) if not self.at("") else -1
        if width <= indent:
            raise self.fault("expected an indented block")
        self.enter()
        self.suite(width)
        self.depth -= 1
        if not self.at("") and self.width.get(self.i, 0) > indent:
            raise self.fault("a line doesn't match any outer indentation")
        return None

    @memo
    def simple_line(self) -> None:
        while True:
            self.simple()
            if not self.take(";"):
                break
            if self.at("\n"):
                break
        if not self.take("\n"):
            raise self.fault("expected the end of the line")

    def statement_line(self, indent: int) -> None:
        k, x = self.k, self.k[self.i]
        if x not in COMPOUND and (x != "a" or k[self.i + 1] not in MATCH_STARTS):
            return self.simple_line()
        if x == "async" and k[self.i + 1] in ("def", "for", "with"):
            self.i += 1
            x = k[self.i]
        if x == "@":
            self.i += 1
            self.decorator()
            self.need("\n")
            if not self.at("@", "def", "class", "async"):
                raise self.fault("expected a definition")
            if self.width.get(self.i, indent) != indent:
                raise self.fault("unexpected indent")
            self.statement_line(indent)
        elif x == "def":
            self.signature()
            self.body(indent)
        elif x == "class":
            self.klass()
            self.body(indent)
        elif x in ("if", "while"):
            self.clause()
            self.body(indent)
            while x == "if" and self.here("elif", indent):
                self.clause()
                self.body(indent)
            self.other("else", indent)
        elif x == "for":
            self.loop()
            self.body(indent)
            self.other("else", indent)
        elif x == "try":
            self.i += 1
            self.need(":")
            self.body(indent)
            caught = False
            while self.here("except", indent):
                caught = True
                self.handler()
                self.body(indent)
            if caught:
                self.other("else", indent)
            if not self.other("finally", indent) and not caught:
                raise self.fault("expected except or finally")
        elif x == "with":
            self.withs()
            self.body(indent)
        elif x == "a" and self.match_ahead():
            self.i += 1
            self.subject()
            self.need(":")
            self.need("\n")
            deeper = self.width.get(self.i, -1)
            if deeper <= indent:
                raise self.fault("expected an indented block")
            while not self.at("") and self.width.get(self.i) == deeper:
                self.need("a")
                self.patterns()
                if self.take("if"):
                    self.named()
                self.need(":")
                self.body(deeper)
        else:
            self.simple_line()
        return None

    def match_ahead(self) -> bool:
        """A match statement: a name, a subject and a colon at the line's end, with deeper lines that begin with a name."""
        k, i = self.k, self.i
        end = self.mark_after(i)
        if k[end - 1] != ":" or k[i + 1] in ("=", ":", ".", ",", ")") or k[end + 1] != "a" if end + 1 < len(k) else True:
            return False
        return self.width.get(end + 1, 0) > self.width.get(i, 0) and "lambda" not in k[i:end]

    def here(self, word: str, indent: int) -> bool:
        return self.at(word) and self.width.get(self.i, indent) == indent

    def other(self, word: str, indent: int) -> bool:
        if not self.here(word, indent):
            return False
        self.i += 1
        self.need(":")
        self.body(indent)
        return True

    @memo
    def decorator(self) -> None:
        self.named()

    @memo
    def clause(self) -> None:
        self.i += 1
        self.named()
        self.need(":")

    @memo
    def signature(self) -> None:
        self.need("def")
        self.name()
        if self.at("["):
            self.type_parameters()
        self.need("(")
        self.parameters(")", True)
        self.need(")")
        if self.take("->"):
            self.expressions()
        self.need(":")

    def type_parameters(self) -> None:
        self.need("[")
        while not self.at("]"):
            self.take("*") or self.take("**")
            self.name()
            if self.take(":"):
                self.expression()
            if self.take("="):
                self.expression()
            if not self.take(","):
                break
        self.need("]")

    def parameters(self, close: str, annotated: bool) -> None:
        defaults = star = False
        while not self.at(close):
            if self.take("/"):
                pass
            elif self.take("**"):
                self.name()
                if annotated and self.take(":"):
                    self.expression()
            elif self.take("*"):
                star = True
                if self.at("a"):
                    self.i += 1
                    if annotated and self.take(":"):
                        self.take("*")
                        self.expression()
            else:
                self.name()
                if annotated and self.take(":"):
                    self.expression()
                if self.take("="):
                    self.expression()
                    defaults = True
                elif defaults and not star:
                    raise self.fault("a parameter without a default follows one with a default")
            if not self.take(","):
                break

    @memo
    def klass(self) -> None:
        self.need("class")
        self.name()
        if self.at("["):
            self.type_parameters()
        if self.at("("):
            self.arguments()
        self.need(":")

    @memo
    def loop(self) -> None:
        self.need("for")
        self.targets()
        self.need("in")
        self.expressions()
        self.need(":")

    @memo
    def handler(self) -> None:
        self.need("except")
        self.take("*")
        if not self.at(":"):
            self.expressions()
            if self.take("as"):
                self.name()
        self.need(":")

    @memo
    def withs(self) -> None:
        self.need("with")
        if self.at("(") and self.k[self.closing(self.i)] == ":":
            self.i += 1
            while not self.at(")"):
                self.named()
                if self.take("as"):
                    self.target()
                if not self.take(","):
                    break
            self.need(")")
        else:
            while True:
                self.expression()
                if self.take("as"):
                    self.target()
                if not self.take(","):
                    break
        self.need(":")

    def subject(self) -> None:
        self.expressions()

    def patterns(self) -> None:
        """Case patterns look like expressions with "as", stars and alternatives."""
        while True:
            self.take("*")
            self.binary(4)
            while self.take("as"):
                self.name()
            if not self.take(",") or self.at(":", "if"):
                return

    def simple(self) -> None:
        x = self.k[self.i]
        if x in ("pass", "break", "continue"):
            self.i += 1
        elif x == "return":
            self.i += 1
            if not self.at("\n", ";"):
                self.expressions()
        elif x == "raise":
            self.i += 1
            if not self.at("\n", ";"):
                self.expression()
                if self.take("from"):
                    self.expression()
        elif x in ("global", "nonlocal"):
            self.i += 1
            self.name()
            while self.take(","):
                self.name()
        elif x == "del":
            self.i += 1
            self.targets()
        elif x == "assert":
            self.i += 1
            self.expression()
            if self.take(","):
                self.expression()
        elif x == "import":
            self.i += 1
            while True:
                self.dotted()
                if self.take("as"):
                    self.name()
                if not self.take(","):
                    break
        elif x == "from":
            self.i += 1
            dots = False
            while self.at(".", "..."):
                self.i += 1
                dots = True
            if not (dots and self.at("import")):
                self.dotted()
            self.need("import")
            if self.take("*"):
                return
            close = self.take("(")
            while True:
                self.name()
                if self.take("as"):
                    self.name()
                if not self.take(",") or (close and self.at(")")):
                    break
            if close:
                self.need(")")
        elif x == "a" and self.k[self.i + 1] == "a" and self.k[self.i + 2] in ("=", "["):
            self.i += 2  # a type alias
            if self.at("["):
                self.type_parameters()
            self.need("=")
            self.expression()
        else:
            self.assignment()

    def dotted(self) -> None:
        self.name()
        while self.take("."):
            self.name()

    def assignment(self) -> None:
        start = self.i
        self.expressions()
        if self.at(":"):
            self.place(start, True)
            self.i += 1
            self.expression()
            if self.take("="):
                self.expressions()
            return
        while self.k[self.i] in _ASSIGN:
            self.place(start, self.k[self.i] != "=")
            self.i += 1
            start = self.i
            self.expressions()

    def place(self, start: int, single: bool) -> None:
        """Whether what began at ``start`` can be assigned to: it must not end in a call, a literal or an operator."""
        k, end = self.k, self.i
        depth = 0
        for i in range(start, end):
            x = k[i]
            if x in ("(", "[", "{"):
                depth += 1
            elif x in (")", "]", "}"):
                depth -= 1
            elif depth == 0 and (x in ("0", '"', "None", "True", "False", "lambda", "not", "if", "else", "yield", "await") or (x in _BINARY and not (x == "*" and (i == start or k[i - 1] == ",")))):
                raise Fault(start, "cannot assign to this expression")
        if k[end - 1] == ")" and depth == 0 and end - 2 >= start:
            # The last bracket is a call unless it begins the target.
            i, level = end - 1, 0
            while i >= start:
                level += (k[i] == ")") - (k[i] == "(")
                if level == 0:
                    break
                i -= 1
            if i > start and k[i - 1] not in (",", "*"):
                raise Fault(start, "cannot assign to a call")

    def targets(self) -> None:
        while True:
            self.take("*")
            self.target()
            if not self.take(",") or self.at("in", "\n", ";"):
                return

    def target(self) -> None:
        self.postfix()

    def expressions(self) -> None:
        while True:
            if self.take("*"):
                self.binary(4)
            else:
                self.named()
            if not self.take(",") or self.at("\n", ";", "=", ")", "]", "}", ":", ""):
                return

    def named(self) -> None:
        if self.at("a") and self.k[self.i + 1] == ":=":
            self.i += 2
        self.expression()

    @memo
    def expression(self) -> None:
        self.enter()
        if self.take("lambda"):
            self.parameters(":", False)
            self.need(":")
            self.expression()
        elif self.at("yield"):
            self.i += 1
            if self.take("from"):
                self.expression()
            elif not self.at(")", "\n", "=", "]", "}", ";", ","):
                self.expressions()
        else:
            self.binary(0)
            if self.take("if"):
                self.binary(0)
                self.need("else")
                self.expression()
        self.depth -= 1

    def binary(self, least: int) -> None:
        """Precedence climbing."""
        if self.at("not") and least < 4:
            self.i += 1
            self.binary(3)
        else:
            self.unary()
        while True:
            op, width = self.k[self.i], 1
            power = _BINARY.get(op, 0)
            if op == "not" and self.k[self.i + 1] == "in":
                power, width = 4, 2
            elif op == "is" and self.k[self.i + 1] == "not":
                width = 2
            if not power or power <= least:
                return
            self.i += width
            if op == "**":
                self.unary()
            elif self.at("not") and power < 4:
                self.i += 1
                self.binary(3)
            else:
                self.binary(power)

    def unary(self) -> None:
        while self.at("-", "+", "~"):
            self.i += 1
        self.take("await")
        self.postfix()
        if self.take("**"):
            self.unary()

    def postfix(self) -> None:
        self.primary()
        while True:
            if self.take("."):
                self.name()
            elif self.at("("):
                self.arguments()
            elif self.take("["):
                if self.at("]"):
                    raise self.fault("expected an index")
                while not self.at("]"):
                    self.take("*")
                    if not self.at(":", ","):
                        self.named()
                    while self.take(":"):
                        if not self.at(":", ",", "]"):
                            self.expression()
                    if not self.take(","):
                        break
                self.need("]")
            else:
                return

    def arguments(self) -> None:
        self.need("(")
        while not self.at(")"):
            if self.take("*") or self.take("**"):
                self.expression()
            elif self.at("a") and self.k[self.i + 1] == "=":
                self.i += 2
                self.expression()
            else:
                self.named()
                if self.at("for", "async"):
                    self.comprehension()
            if not self.take(","):
                break
        self.need(")")

    def comprehension(self) -> None:
        while self.at("for", "async"):
            self.take("async")
            self.need("for")
            self.targets()
            self.need("in")
            self.binary(0)
            if self.at("if") and False:
                break
            while self.take("if"):
                self.condition()

    def condition(self) -> None:
        if self.at("a") and self.k[self.i + 1] == ":=":
            self.i += 2
        if self.at("lambda"):
            self.expression()
        else:
            self.binary(0)

    def primary(self) -> None:
        x = self.k[self.i]
        if x in ("a", "0", "True", "False", "None", "..."):
            self.i += 1
        elif x == '"':
            while self.take('"'):
                pass
        elif x == "(":
            self.i += 1
            if not self.take(")"):
                self.elements(")")
        elif x == "[":
            self.i += 1
            if not self.take("]"):
                self.elements("]")
        elif x == "{":
            self.i += 1
            if not self.take("}"):
                self.entries()
        else:
            raise self.fault("expected an expression")

    def elements(self, close: str) -> None:
        while not self.at(close):
            if self.take("*"):
                self.binary(4)
            else:
                self.named()
            if self.at("for", "async"):
                self.comprehension()
                break
            if not self.take(","):
                break
        self.need(close)

    def entries(self) -> None:
        while not self.at("}"):
            if self.take("**") or self.take("*"):
                self.binary(4)
            else:
                self.named()
                if self.take(":"):
                    self.expression()
            if self.at("for", "async"):
                self.comprehension()
                break
            if not self.take(","):
                break
        self.need("}")
