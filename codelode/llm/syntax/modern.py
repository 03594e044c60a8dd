"""Kotlin, Swift, Solidity, Zig and PHP."""

from __future__ import annotations

import re

from .braces import CLike
from .core import Fault, tokens

_NESTED_COMMENT = r"//[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*/]|\*(?!/)|/(?!\*))*+\*/)*+\*/"
_PLAIN_COMMENT = r"//[^\n]*|/\*(?:[^*]|\*(?!/))*+\*/"
_DOUBLE, _SINGLE = r"\"(?:[^\"\\\n]|\\.)*+\"", r"'(?:[^'\\\n]|\\.)*+'"
_ARITHMETIC = {"*": 10, "/": 10, "%": 10, "+": 9, "-": 9, "<<": 8, ">>": 8, "<": 6, ">": 6, "<=": 6, ">=": 6, "==": 5, "!=": 5, "&&": 3, "||": 2}


class Modern(CLike):
    """Expressions by precedence climbing; a subclass says which operators there are and what a primary expression is."""

    BINARY: dict[str, int] = {}
    ASSIGN: frozenset[str] = frozenset("= += -= *= /= %= &= |= ^= <<= >>=".split())
    PREFIX: frozenset[str] = frozenset()
    #: Operators that go on with the expression of the line before.
    LEADING: frozenset[str] = frozenset()
    TERNARY = False

    def fresh(self) -> bool:
        """Whether the next token begins a line, where lines matter."""
        return self.i in self.new_line

    def expression(self) -> None:
        self.enter()
        self.binary(0)
        if self.TERNARY and self.at("?"):
            self.i += 1
            if not self.take(":"):
                self.expression()
                self.need(":")
            self.expression()
        if self.k[self.i] in self.ASSIGN and not (self.fresh() and self.k[self.i] not in self.LEADING):
            self.i += 1
            self.expression()
        self.depth -= 1

    def binary(self, least: int) -> None:
        self.unary()
        while True:
            op, width = self.k[self.i], 1
            if self.fresh() and op not in self.LEADING:
                return
            if op == ">" and self.k[self.i + 1] == ">" and ">>" in self.BINARY:
                op, width = ">>", self.shift_width()
            power = self.BINARY.get(op, 0)
            if not power or power <= least:
                if not power and self.infix(least):
                    continue
                return
            self.i += width
            self.binary(power)

    def unary(self) -> None:
        while self.k[self.i] in self.PREFIX:
            self.i += 1
        self.primary()
        self.postfix()

    def primary(self) -> None:
        raise NotImplementedError

    def postfix(self) -> None:
        raise NotImplementedError

    def ended(self) -> None:
        """A statement ends at a semicolon, a line's end or a closing brace."""
        if not (self.take(";") or self.fresh() or self.at("}", "")):
            raise self.fault("expected the end of a statement")

    def balanced(self) -> None:
        """A bracket and all that it holds."""
        end = self.closing(self.i)
        if self.k[end - 1] not in (")", "]", "}"):
            raise self.fault("a bracket is not closed")
        self.i = end

    def skip_words(self, words: frozenset[str]) -> None:
        while self.k[self.i] in words:
            self.i += 1

    def path(self, dot: str = ".") -> None:
        self.name()
        while self.at(dot):
            self.i += 1
            self.name()

    def unit(self) -> None:
        self.until("", self.statement)

    def statement(self) -> None:
        raise NotImplementedError


class Kotlin(Modern):
    LINES = True
    MODIFIERS = frozenset("public private protected internal open abstract final sealed data inner enum annotation companion override lateinit const suspend inline noinline crossinline tailrec operator infix external value vararg expect actual".split())
    SOFT = MODIFIERS | frozenset("by where get set init constructor out reified import catch finally".split())
    KEYWORDS = SOFT | frozenset("package class interface object fun val var typealias this super if else for while do when try return throw break continue in is as null true false".split())
    OPAQUE = re.compile(_NESTED_COMMENT + r"|\"\"\"(?:[^\"]|\"(?!\"\"))*+\"{3,}|\"(?:[^\"\\\n$]|\\.|\$\{(?:[^{}\"\n]|\"[^\"\n]*\"|\{[^{}\n]*\})*+\}|\$)*+\"|" + _SINGLE + r"|`[^`\n]+`", re.S)
    TOKEN = tokens("?:", "?.", "!!", "..<", "..", "===", "!==", "->", "::", "!in\\b")
    BINARY = {"*": 10, "/": 10, "%": 10, "+": 9, "-": 9, "..": 8, "..<": 8, "?:": 6, "<": 4, ">": 4, "<=": 4, ">=": 4, "==": 3, "!=": 3, "===": 3, "!==": 3, "&&": 2, "||": 1}
    PREFIX = frozenset("! - + ++ --".split())
    LEADING = frozenset("?: && || . ?. ->".split())

    @staticmethod
    def replaced(m: re.Match) -> str:
        return "a" if m[0][0] == "`" else Modern.replaced(m)

    def unit(self) -> None:
        if self.k[:1] == ["#"]:
            while not self.fresh() or self.i == 0:
                self.i += 1
        self.until("", self.statement)

    def annotations(self) -> None:
        while self.at("@"):
            self.i += 1
            if self.k[self.i + 1] == ":":
                self.i += 2  # a use-site target
            if self.at("["):
                self.balanced()
                continue
            self.path()
            if self.at("<"):
                self.type_arguments()
            if self.at("(") and not self.fresh():
                self.arguments()

    def modifiers(self) -> None:
        while self.at("@") or self.k[self.i] in self.MODIFIERS:
            if self.at("@"):
                self.annotations()
            else:
                self.i += 1

    def declaration_ahead(self) -> bool:
        at = self.i
        try:
            self.modifiers()
            ahead = self.k[self.i] in ("class", "interface", "fun", "val", "var", "typealias") or (self.at("object") and self.k[self.i + 1] != ":" and self.k[self.i + 1] != "{") or (
                self.at("constructor") and self.k[self.i + 1] == "("
            ) or (self.at("init") and self.k[self.i + 1] == "{") or (self.at("object", "interface") and self.i > at)
        except Fault:
            ahead = False
        self.i = at
        return ahead and not (self.at("fun") and self.k[self.i + 1] == "(")

    def statement(self) -> None:
        if self.take(";"):
            return
        if self.at("package", "import") and self.k[self.i + 1] not in ("=", ".", "("):
            self.i += 1
            self.name_or_keyword()
            while self.take("."):
                if self.take("*"):
                    break
                self.name_or_keyword()
            if self.take("as"):
                self.name()
            return self.ended()
        if self.at("a") and self.k[self.i + 1] == "@" and self.k[self.i + 2] in ("for", "while", "do"):
            self.i += 2  # a label
        if self.declaration_ahead():
            self.declaration()
        elif self.at("for", "while", "do"):
            self.loop()
        else:
            self.annotations()
            self.expression()
        self.ended()

    def name_or_keyword(self) -> None:
        if not self.k[self.i] or not (self.k[self.i] == "a" or self.k[self.i].isalpha()):
            raise self.fault("expected a name")
        self.i += 1

    def declaration(self) -> None:
        start = self.i
        self.modifiers()
        enum = "enum" in self.k[start : self.i]
        word = self.k[self.i]
        self.i += 1
        if word in ("class", "interface", "object"):
            if word == "object" and "companion" in self.k[start : self.i]:
                if self.k[self.i] == "a":
                    self.i += 1
            elif word != "interface" or not self.at("fun"):
                self.name()
            self.generics()
            self.modifiers()
            if self.take("constructor") or self.at("("):
                self.parameters()
            self.supertypes()
            self.where()
            if self.at("{"):
                self.class_body(enum)
        elif word == "fun":
            if self.at("interface"):
                self.i += 1
                self.name()
                self.generics()
                return self.class_body(False) if self.at("{") else None
            self.generics()
            self.receiver()
            self.parameters()
            if self.take(":"):
                self.type()
            self.where()
            self.function_body()
        elif word in ("val", "var"):
            self.generics()
            if self.at("("):
                self.balanced()
            else:
                self.receiver()
            if self.take(":"):
                self.type()
            self.where()
            if self.take("=") or self.take("by"):
                self.expression()
            self.accessors()
        elif word == "typealias":
            self.name()
            self.generics()
            self.need("=")
            self.type()
        elif word == "constructor":
            self.parameters()
            if self.take(":"):
                if not (self.take("this") or self.take("super")):
                    raise self.fault("expected this or super")
                self.arguments()
            if self.at("{"):
                self.block(self.statement)
        else:  # init
            self.block(self.statement)

    def receiver(self) -> None:
        """A name, with the type before it that an extension extends."""
        if self.at("("):
            self.balanced()
            self.take("?")
            self.need(".")
        self.annotations()
        while True:
            self.name()
            if self.at("<"):
                self.type_arguments()
            while self.take("?"):
                pass
            if not (self.take(".") or self.take("?.")):
                return

    def accessors(self) -> None:
        for _ in range(2):
            at = self.i
            self.take(";")
            self.modifiers()
            if not (self.at("get", "set") and (self.k[self.i + 1] in ("(", ";", "}", "") or self.i + 1 in self.new_line)):
                self.i = at
                return
            self.i += 1
            if self.at("(") and not self.fresh():
                self.balanced()
                if self.take(":"):
                    self.type()
                self.function_body()

    def function_body(self) -> None:
        if self.take("="):
            self.expression()
        elif self.at("{"):
            self.block(self.statement)

    def generics(self) -> None:
        if not self.take("<"):
            return
        while not self.at(">"):
            self.annotations()
            self.skip_words(frozenset(("in", "out", "reified")))
            self.name()
            if self.take(":"):
                self.type()
            if not self.take(","):
                break
        self.need(">")

    def where(self) -> None:
        if self.at("where") and self.k[self.i + 1] == "a":
            self.i += 1
            while True:
                self.name()
                self.need(":")
                self.type()
                if not self.take(","):
                    return

    def supertypes(self) -> None:
        if not self.take(":"):
            return
        while True:
            self.annotations()
            self.type()
            if self.at("("):
                self.arguments()
            if self.take("by"):
                self.no_brace, flag = True, self.no_brace
                self.expression()
                self.no_brace = flag
            if not self.take(","):
                return

    def parameters(self) -> None:
        self.need("(")
        self.many(self.parameter, ")")

    def parameter(self) -> None:
        self.modifiers()
        if not self.take("val"):
            self.take("var")
        self.name()
        self.need(":")
        self.type()
        if self.take("="):
            self.expression()

    def class_body(self, enum: bool) -> None:
        self.need("{")
        if enum:
            while self.k[self.i] == "a" or self.k[self.i] in self.SOFT or self.at("@"):
                self.annotations()
                self.name()
                if self.at("("):
                    self.arguments()
                if self.at("{"):
                    self.block(self.member)
                if not self.take(","):
                    break
            if not self.take(";") and not self.at("}"):
                raise self.fault("expected the end of the entries")
        self.block(self.member, opened=True)

    def member(self) -> None:
        if self.take(";"):
            return
        if not self.declaration_ahead():
            raise self.fault("expected a declaration")
        self.declaration()
        self.ended()

    def type(self) -> None:
        self.enter()
        self.annotations()
        self.skip_words(frozenset(("suspend", "in", "out")))
        if self.take("*"):
            pass
        elif self.at("("):
            self.balanced()
            while self.take("?"):
                pass
            if self.take("->"):
                self.type()
        else:
            while True:
                self.name()
                if self.at("<"):
                    self.type_arguments()
                if self.at(".") and self.k[self.i + 1] == "(":
                    self.i += 1
                    self.balanced()
                    self.need("->")
                    self.type()
                    break
                if not self.take("."):
                    break
        while self.at("?", "!!") or (self.at("&") and self.k[self.i + 1] == "a"):
            self.i += 1
            if self.k[self.i - 1] == "&":
                self.type()
        if self.take("?."):
            self.balanced()
            self.need("->")
            self.type()
        self.depth -= 1

    def type_arguments(self) -> None:
        self.need("<")
        while not self.at(">"):
            self.type()
            if not self.take(","):
                break
        self.need(">")

    def loop(self) -> None:
        word = self.k[self.i]
        self.i += 1
        if word == "do":
            self.body()
            if not self.take("while"):
                raise self.fault("expected while")
            self.condition()
            return
        if word == "for":
            self.need("(")
            self.annotations()
            if self.at("("):
                self.balanced()
            else:
                self.name()
                if self.take(":"):
                    self.type()
            if not self.take("in"):
                raise self.fault("expected in")
            self.inner(self.expression)
            self.need(")")
        else:
            self.condition()
        if not self.take(";"):
            self.body()

    def inner(self, rule) -> None:
        flag, self.no_brace = self.no_brace, False
        rule()
        self.no_brace = flag

    def condition(self) -> None:
        self.need("(")
        self.inner(self.expression)
        self.need(")")

    def body(self) -> None:
        if self.at("{"):
            self.block(self.statement)
        elif self.at("for", "while", "do"):
            self.loop()
        else:
            self.expression()

    def infix(self, least: int) -> bool:
        word = self.k[self.i]
        if self.fresh():
            return False
        if word == "as" or word == "is":
            self.i += 1
            self.take("?")
            self.type()
            return True
        if word == "!" and self.k[self.i + 1] in ("is", "in"):
            self.i += 1
            return self.infix(least)
        if word == "in" and least < 5:
            self.i += 1
            self.binary(5)
            return True
        if (word == "a" or word in self.SOFT) and least < 7 and self.k[self.i + 1] not in ("=", ":", ",", ")", "}", "]", ".", ";", "->", ""):
            self.i += 1
            self.binary(7)
            return True
        return False

    def postfix(self) -> None:
        while True:
            x = self.k[self.i]
            if self.fresh() and x not in (".", "?."):
                return
            if x == "(":
                self.inner(self.arguments)
            elif x == "[":
                self.i += 1
                self.inner(lambda: self.many(self.expression, "]"))
            elif x in (".", "?.", "::"):
                self.i += 1
                if not self.take("class"):
                    self.name_or_keyword()
            elif x in ("!!", "++", "--"):
                self.i += 1
            elif x == "{" and not self.no_brace:
                self.lambda_()
            elif x == "?" and self.k[self.i + 1] == "::":
                self.i += 1
            elif x == "@" and self.k[self.i + 1] == "{":
                self.i += 1
            elif x == "@" and self.k[self.i - 1] in ("a", "this", "super", "return", "break", "continue"):
                self.i += 1
                if not self.fresh() and self.k[self.i] == "a":
                    self.i += 1
            elif x == "<" and self.attempt(self.called_type_arguments):
                pass
            else:
                return

    def called_type_arguments(self) -> None:
        self.type_arguments()
        if not self.at("(", "{", "::", ".", "?."):
            raise self.fault("no call")

    def arguments(self) -> None:
        self.need("(")
        self.many(self.argument, ")")

    def argument(self) -> None:
        if (self.k[self.i] == "a" or self.k[self.i] in self.SOFT) and self.k[self.i + 1] == "=":
            self.i += 2
        self.take("*")
        self.annotations()
        self.expression()

    def lambda_(self) -> None:
        at = self.i
        self.need("{")
        arrow = self.attempt(self.lambda_parameters)
        if not arrow:
            self.i = at + 1
        self.block(self.statement, opened=True)

    def lambda_parameters(self) -> None:
        while not self.at("->"):
            if self.at("("):
                self.balanced()
            else:
                self.name()
            if self.take(":"):
                self.type()
            if not self.take(","):
                break
        self.need("->")

    def primary(self) -> None:
        x = self.k[self.i]
        if x in ("0", '"', "null", "true", "false", "this"):
            self.i += 1
        elif x == "super":
            self.i += 1
            if self.at("<"):
                self.type_arguments()
        elif x == "(":
            self.condition()
        elif x == "[":
            self.i += 1
            self.inner(lambda: self.many(self.expression, "]"))
        elif x == "{":
            self.lambda_()
        elif x == "::":
            self.i += 1
            if not self.take("class"):
                self.name()
        elif x == "if":
            self.i += 1
            self.condition()
            if not self.at("else", ";"):
                self.body()
            at = self.i
            self.take(";")
            if self.take("else"):
                if not self.at(";", "}", ")"):
                    self.body()
            else:
                self.i = at
        elif x == "when":
            self.when()
        elif x == "try":
            self.i += 1
            self.block(self.statement)
            handlers = 0
            while self.at("catch") and self.k[self.i + 1] == "(":
                self.i += 1
                self.need("(")
                self.parameter()
                self.need(")")
                self.block(self.statement)
                handlers += 1
            if self.at("finally") and self.k[self.i + 1] == "{":
                self.i += 1
                self.block(self.statement)
            elif not handlers:
                raise self.fault("expected catch or finally")
        elif x == "object" or (x == "data" and self.k[self.i + 1] == "object"):
            self.i += 1 + (x == "data")
            self.supertypes()
            self.class_body(False)
        elif x == "fun":
            self.i += 1
            if self.k[self.i] == "a":
                self.receiver()
            self.parameters()
            if self.take(":"):
                self.type()
            self.function_body()
        elif x in ("return", "throw", "break", "continue"):
            self.i += 1
            if self.at("@") and not self.fresh():
                self.i += 2
            if x == "throw" or (x == "return" and not self.fresh() and not self.at("}", ")", "]", ";", ",", "else", "->", "")):
                self.expression()
        elif x == "a" or x in self.SOFT:
            self.i += 1
        else:
            raise self.fault("expected an expression")

    def when(self) -> None:
        self.i += 1
        if self.take("("):
            self.annotations()
            if self.take("val"):
                self.name()
                if self.take(":"):
                    self.type()
                self.need("=")
            self.inner(self.expression)
            self.need(")")
        self.block(self.branch)

    def branch(self) -> None:
        while True:
            if self.take("else"):
                pass
            elif self.at("is", "in") or (self.at("!") and self.k[self.i + 1] in ("is", "in")):
                self.take("!")
                word = self.k[self.i]
                self.i += 1
                self.type() if word == "is" else self.expression()
            else:
                self.expression()
            if not self.take(",") or self.at("->"):
                break
        if self.take("if"):
            self.expression()
        self.need("->")
        self.body()
        self.ended()


class Swift(Modern):
    LINES = True
    MODIFIERS = frozenset("public private internal fileprivate open static final override mutating nonmutating lazy weak unowned convenience required dynamic optional indirect nonisolated isolated distributed prefix postfix infix consuming borrowing package".split())
    SOFT = MODIFIERS | frozenset("get set willSet didSet some any async actor macro left right none of precedence".split())
    KEYWORDS = SOFT | frozenset(
        "import let var func class struct enum protocol extension init deinit subscript typealias associatedtype operator precedencegroup if else guard for while repeat switch case default where in return throw throws rethrows do catch try defer break continue fallthrough is as nil true false self super await inout".split()
    )
    OPAQUE = re.compile(_NESTED_COMMENT + r"|#\"(?:[^\"\n]|\"(?!#))*+\"#|\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*+\"\"\"|\"(?:[^\"\\\n]|\\\((?:[^()\n]|\((?:[^()\n]|\([^()\n]*\))*+\))*+\)|\\.)*+\"|`[^`\n]+`", re.S)
    TOKEN = tokens("..<", "...", "===", "!==", "->", "??", "&+", "&-", "&*", "~=", "?.")
    BINARY = {"<<": 11, ">>": 11, "*": 10, "/": 10, "%": 10, "&": 10, "&*": 10, "+": 9, "-": 9, "|": 9, "^": 9, "&+": 9, "&-": 9, "...": 8, "..<": 8, "??": 6, "<": 4, ">": 4, "<=": 4, ">=": 4, "==": 4, "!=": 4, "===": 4, "!==": 4, "~=": 4, "&&": 2, "||": 1}
    PREFIX = frozenset("! - + ~ & ... ..<".split())
    LEADING = frozenset(". ?. ? : ?? && || + - * / == != < > <= >= = ... ..< | & ->".split())
    TERNARY = True

    @staticmethod
    def replaced(m: re.Match) -> str:
        if m[0].startswith('#"'):
            return '""'
        return "a" if m[0][0] == "`" else Modern.replaced(m)

    def statement(self) -> None:
        if self.take(";"):
            return
        if self.at("#"):
            # A compiler directive: a condition, or a call in an expression.
            self.i += 1
            word_end = self.i + 1
            if self.at("if", "else") or self.k[self.i] == "a":
                self.i += 1
                while self.k[self.i] and not self.fresh():
                    self.i += 1
                return
            self.i = word_end
            return
        if self.declaration_ahead():
            self.declaration()
        elif self.at("a") and self.k[self.i + 1] == ":" and self.k[self.i + 2] in ("for", "while", "repeat", "switch", "do", "if"):
            self.i += 2
            return self.statement()
        elif not self.control():
            self.expression()
        self.ended()

    def attributes(self) -> None:
        while self.at("@"):
            self.i += 1
            self.path()
            if self.at("(") and not self.fresh():
                self.balanced()

    def modifiers(self) -> None:
        while self.at("@") or (self.k[self.i] in self.MODIFIERS and self.k[self.i + 1] not in (".", "=", ",", ")", ":")) or (self.at("class") and self.k[self.i + 1] in ("func", "var", "let", "subscript")):
            if self.at("@"):
                self.attributes()
            else:
                self.i += 1
                if self.at("(") and self.k[self.i + 1] in ("set", "a") and self.k[self.i + 2] == ")":
                    self.i += 3

    DECLARED = frozenset("import let var func class struct enum protocol extension init deinit subscript typealias associatedtype operator precedencegroup".split())

    def declaration_ahead(self) -> bool:
        at = self.i
        try:
            self.modifiers()
            ahead = self.k[self.i] in self.DECLARED or (self.at("actor") and self.k[self.i + 1] == "a") or (self.at("case") and self.i > at)
        except Fault:
            ahead = False
        self.i = at
        return ahead

    def declaration(self) -> None:
        self.modifiers()
        word = self.k[self.i]
        self.i += 1
        if word == "import":
            self.skip_words(frozenset(("class", "struct", "enum", "protocol", "func", "var", "let", "typealias")))
            self.path()
        elif word in ("let", "var"):
            self.binding()
        elif word == "func":
            if self.k[self.i] == "a" or self.k[self.i] in self.SOFT:
                self.i += 1
            else:
                while self.k[self.i] and not self.at("(", "<"):
                    self.i += 1  # an operator
                if self.at("<") and self.k[self.i + 1] in ("(", "=", "<"):
                    self.i += 1
            self.generics()
            self.signature()
            if self.at("{"):
                self.block(self.statement)
        elif word in ("class", "struct", "enum", "protocol", "extension", "actor"):
            self.type(False) if word == "extension" else self.name()
            self.generics()
            if self.take(":"):
                while True:
                    self.attributes()
                    if not self.take("class"):
                        self.type(False)
                    if not self.take(","):
                        break
            self.where()
            self.block(self.enum_member if word == "enum" else self.member)
        elif word in ("init", "subscript"):
            if not self.take("?"):
                self.take("!")
            self.generics()
            self.signature()
            if self.at("{"):
                self.accessor_block() if word == "subscript" else self.block(self.statement)
        elif word == "deinit":
            self.block(self.statement)
        elif word in ("typealias", "associatedtype"):
            self.name()
            self.generics()
            if self.take(":"):
                self.type()
            if self.take("="):
                self.type()
            self.where()
        else:  # operator, precedencegroup
            while self.k[self.i] and not self.fresh() and not self.at("{"):
                self.i += 1
            if self.at("{"):
                self.balanced()

    def member(self) -> None:
        if self.take(";"):
            return
        if self.at("#"):
            return self.statement()
        if not self.declaration_ahead():
            raise self.fault("expected a declaration")
        self.declaration()
        self.ended()

    def enum_member(self) -> None:
        at = self.i
        self.modifiers()
        if not self.take("case"):
            self.i = at
            return self.member()
        while True:
            self.name()
            if self.at("("):
                self.balanced()
            if self.take("="):
                self.expression()
            if not self.take(","):
                break
        self.ended()

    def binding(self) -> None:
        while True:
            self.pattern()
            if self.take(":"):
                self.type()
            if self.take("="):
                self.expression()
            if self.at("{") and not self.no_brace and not self.fresh():
                self.accessor_block()
            if not self.take(","):
                return

    def accessor_block(self) -> None:
        at = self.i
        if not self.attempt(self.accessors):
            self.i = at
            self.block(self.statement)

    def accessors(self) -> None:
        self.need("{")
        n = 0
        while not self.at("}"):
            self.modifiers()
            if not self.at("get", "set", "willSet", "didSet"):
                raise self.fault("expected an accessor")
            self.i += 1
            if self.at("("):
                self.balanced()
            self.skip_words(frozenset(("async", "throws")))
            if self.at("{"):
                self.block(self.statement)
            self.take(";")
            n += 1
        if not n:
            raise self.fault("no accessor")
        self.need("}")

    def generics(self) -> None:
        if not self.take("<"):
            return
        while not self.at(">"):
            self.name()
            if self.take(":"):
                self.type()
            if not self.take(","):
                break
        self.need(">")

    def where(self) -> None:
        if self.take("where"):
            while True:
                self.type(False)
                if not self.take(":"):
                    self.need("==")
                self.type(False)
                if not self.take(","):
                    return

    def signature(self) -> None:
        self.need("(")
        self.many(self.parameter, ")")
        while self.at("async", "throws", "rethrows"):
            self.i += 1
            if self.at("("):
                self.balanced()
        if self.take("->"):
            self.type()
        self.where()

    def parameter(self) -> None:
        self.attributes()
        self.name_or_keyword()
        if not self.at(":"):
            self.name_or_keyword()
        self.need(":")
        self.take("inout")
        self.type()
        self.take("...")
        if self.take("="):
            self.expression()

    def name_or_keyword(self) -> None:
        if not self.k[self.i] or not (self.k[self.i] == "a" or self.k[self.i].isalpha()):
            raise self.fault("expected a name")
        self.i += 1

    def type(self, optional: bool = True) -> None:
        self.enter()
        while self.take("@"):
            self.path()
            if self.at("(") and self.k[self.closing(self.i)] == "(":
                self.balanced()  # arguments; other brackets are the type's
        self.skip_words(frozenset(("some", "any", "inout", "borrowing", "consuming")))
        if self.at("("):
            self.balanced()
            self.skip_words(frozenset(("async", "throws", "rethrows")))
        elif self.take("["):
            self.type()
            if self.take(":"):
                self.type()
            self.need("]")
        elif self.take("~"):
            self.name()
        else:
            while True:
                if not self.take("self"):
                    self.name()
                if self.at("<"):
                    self.i += 1
                    self.many(self.type, ">")
                if not (self.at(".") and not self.fresh()):
                    break
                self.i += 1
        while self.at("?", "!") and not self.fresh() and (optional or self.k[self.i + 1] != "a"):
            self.i += 1
        if self.at("&") and self.k[self.i + 1] == "a":
            self.i += 1
            self.type(optional)
        if self.at("->") or (self.at("async", "throws") and self.k[self.i + 1] == "->"):
            self.i += 1 if self.at("->") else 2
            self.type(optional)
        self.depth -= 1

    def pattern(self) -> None:
        if self.at("("):
            self.balanced()
        else:
            self.name()

    def headless(self, rule) -> None:
        flag, self.no_brace = self.no_brace, True
        rule()
        self.no_brace = flag

    def inner(self, rule) -> None:
        flag, self.no_brace = self.no_brace, False
        rule()
        self.no_brace = flag

    def conditions(self) -> None:
        while True:
            if self.take("case"):
                self.case_pattern()
                if self.take("="):
                    self.expression()
            elif self.at("let", "var"):
                self.i += 1
                self.pattern()
                if self.take(":"):
                    self.type()
                if self.take("="):
                    self.expression()
            elif self.at("#"):
                self.i += 2
                self.balanced()
            else:
                self.expression()
            if not self.take(","):
                return

    def case_pattern(self) -> None:
        if self.at("let", "var"):
            self.i += 1
        if self.take("is"):
            self.type()
        else:
            self.headless(lambda: self.binary(0))

    def control(self) -> bool:
        x = self.k[self.i]
        if x == "if":
            self.branching()
        elif x == "guard":
            self.i += 1
            self.headless(self.conditions)
            if not self.take("else"):
                raise self.fault("expected else")
            self.block(self.statement)
        elif x == "for":
            self.i += 1
            self.skip_words(frozenset(("try", "await", "case", "let", "var")))
            self.headless(lambda: self.binary(0)) if not self.at("(") else self.balanced()
            if self.take(":"):
                self.type()
            if not self.take("in"):
                raise self.fault("expected in")
            self.headless(self.expression)
            if self.take("where"):
                self.headless(self.expression)
            self.block(self.statement)
        elif x == "while":
            self.i += 1
            self.headless(self.conditions)
            self.block(self.statement)
        elif x == "repeat":
            self.i += 1
            self.block(self.statement)
            if not self.take("while"):
                raise self.fault("expected while")
            self.expression()
        elif x == "switch":
            self.switch()
        elif x == "do":
            self.i += 1
            self.skip_words(frozenset(("throws",)))
            self.block(self.statement)
            while self.take("catch"):
                if not self.at("{"):
                    while True:
                        self.case_pattern()
                        if not self.take(","):
                            break
                    if self.take("where"):
                        self.headless(self.expression)
                self.block(self.statement)
        elif x == "defer":
            self.i += 1
            self.block(self.statement)
        elif x in ("break", "continue", "fallthrough"):
            self.i += 1
            if not self.fresh() and self.k[self.i] == "a":
                self.i += 1
        elif x in ("return", "throw"):
            self.i += 1
            if x == "throw" or not (self.fresh() or self.at("}", ";", "", "case", "default")):
                self.expression()
        else:
            return False
        return True

    def branching(self) -> None:
        self.i += 1
        self.headless(self.conditions)
        self.block(self.statement)
        if self.take("else"):
            self.branching() if self.at("if") else self.block(self.statement)

    def switch(self) -> None:
        self.i += 1
        self.headless(self.expression)
        self.need("{")
        while not self.at("}", ""):
            self.attributes()
            if self.at("#"):
                self.statement()
                continue
            if self.take("case"):
                while True:
                    self.case_pattern()
                    if self.take("where"):
                        self.expression()
                    if not self.take(","):
                        break
            elif not self.take("default"):
                raise self.fault("expected case or default")
            self.need(":")
            while not self.at("case", "default", "}", "@", ""):
                self.statement()
        self.need("}")

    def infix(self, least: int) -> bool:
        word = self.k[self.i]
        if word == "is" and not self.fresh():
            self.i += 1
            self.type(False)
            return True
        if word == "as":
            self.i += 1
            if not self.take("?"):
                self.take("!")
            self.type(False)
            return True
        return False

    def unary(self) -> None:
        while self.k[self.i] in self.PREFIX or self.at("try", "await"):
            word = self.k[self.i]
            self.i += 1
            if word == "try" and not self.take("?"):
                self.take("!")
        self.primary()
        self.postfix()

    def postfix(self) -> None:
        while True:
            x = self.k[self.i]
            if self.fresh() and x not in (".", "?."):
                return
            if x == "(":
                self.inner(self.arguments)
            elif x == "[":
                self.i += 1
                self.inner(lambda: self.many(self.argument, "]"))
            elif x in (".", "?."):
                self.i += 1
                if self.at("0"):
                    self.i += 1
                else:
                    self.name_or_keyword()
            elif x == "!" and self.k[self.i + 1] not in ("=",):
                self.i += 1
            elif x == "?" and self.k[self.i + 1] in (".", "[", "(", "=", ")", ",", "?", "}", "]", "as", "{", "") or (x == "?" and self.i + 1 in self.new_line):
                self.i += 1
            elif x == "{" and not self.no_brace:
                self.closure()
                while self.k[self.i] == "a" and self.k[self.i + 1] == ":" and self.k[self.i + 2] == "{":
                    self.i += 2
                    self.closure()
            elif x == "<" and self.attempt(self.called_type_arguments):
                pass
            else:
                return

    def called_type_arguments(self) -> None:
        self.need("<")
        self.many(self.type, ">")
        if not self.at("(", ".", "{", ")", "]", ","):
            raise self.fault("no call")

    def arguments(self) -> None:
        self.need("(")
        self.many(self.argument, ")")

    def argument(self) -> None:
        if self.k[self.i + 1] == ":" and (self.k[self.i] == "a" or self.k[self.i].isalpha()):
            self.i += 2
        if self.k[self.i] in self.BINARY and self.k[self.i + 1] in (")", ","):
            self.i += 1  # an operator as a function
        else:
            self.expression()

    def closure(self) -> None:
        at = self.i
        self.need("{")
        if not self.attempt(self.closure_head):
            self.i = at + 1
        self.block(self.statement, opened=True)

    def closure_head(self) -> None:
        self.attributes()
        if self.at("["):
            self.balanced()
        if self.at("("):
            self.balanced()
        elif not self.at("in"):
            while True:
                self.name()
                if not self.take(","):
                    break
        self.skip_words(frozenset(("async", "throws")))
        if self.take("->"):
            self.type()
        if not self.take("in"):
            raise self.fault("expected in")

    def primary(self) -> None:
        x = self.k[self.i]
        if x in ("0", '"', "nil", "true", "false", "self", "super"):
            self.i += 1
        elif x == "(":
            self.i += 1
            self.inner(lambda: self.many(self.argument, ")"))
        elif x == "[":
            self.i += 1
            self.inner(self.collection)
        elif x == "{":
            self.closure()
        elif x == ".":
            self.i += 1
            self.name_or_keyword()
        elif x == "#":
            self.i += 1
            self.name_or_keyword()
            if self.at("(") and not self.fresh():
                self.balanced()
        elif x == "\\":
            self.i += 1
            if not self.at("."):
                self.type(False)
        elif x == "if":
            self.branching()
        elif x == "switch":
            self.switch()
        elif x in ("let", "var", "is"):
            self.i += 1
            self.type(False) if x == "is" else self.pattern()
        elif x == "a" or x in self.SOFT or x == "init":
            self.i += 1
        else:
            raise self.fault("expected an expression")

    def collection(self) -> None:
        if self.take(":"):
            return self.need("]")
        while not self.at("]"):
            self.expression()
            if self.take(":"):
                self.expression()
            if not self.take(","):
                break
        self.need("]")


class Solidity(Modern):
    KEYWORDS = frozenset(
        """pragma import using contract interface library abstract struct enum event error modifier constructor receive fallback function returns return mapping if else for while do break continue emit revert try catch assembly
        unchecked delete new is as type public private internal external pure view payable virtual override constant immutable transient anonymous indexed memory storage calldata true false throw""".split()
    )
    SOFT = frozenset("error revert type receive fallback transient as".split())
    OPAQUE = re.compile(_PLAIN_COMMENT + r"|(?:hex|unicode)?" + _DOUBLE + r"|(?:hex|unicode)?" + _SINGLE, re.S)
    TOKEN = tokens("**", "=>", ":=")
    BINARY = {"**": 12, "*": 10, "/": 10, "%": 10, "+": 9, "-": 9, "<<": 8, ">>": 8, "&": 7, "^": 6, "|": 5, "<": 4, ">": 4, "<=": 4, ">=": 4, "==": 3, "!=": 3, "&&": 2, "||": 1}
    PREFIX = frozenset("! ~ - + ++ -- delete".split())
    TERNARY = True
    LOCATIONS = frozenset("memory storage calldata".split())
    VARIABLE = frozenset("public private internal constant immutable transient override".split())

    def unit(self) -> None:
        self.until("", self.top)

    def up_to_semicolon(self) -> None:
        while not self.at(";", ""):
            self.i += 1
        self.need(";")

    def top(self) -> None:
        if self.at("pragma"):
            return self.up_to_semicolon()
        if self.at("import"):
            self.i += 1
            if not self.at('"', "{", "*", "a"):
                raise self.fault("expected a path")
            return self.up_to_semicolon()
        if self.at("abstract", "contract", "interface", "library"):
            self.take("abstract")
            self.i += 1
            self.name()
            if self.take("is"):
                while True:
                    self.path()
                    if self.at("("):
                        self.arguments()
                    if not self.take(","):
                        break
            return self.block(self.part)
        self.part()

    def part(self) -> None:
        x = self.k[self.i]
        if x == "using":
            self.i += 1
            self.balanced() if self.at("{") else self.path()
            if not self.take("for"):
                raise self.fault("expected for")
            if not self.take("*"):
                self.type()
            if self.k[self.i] == "a":
                self.i += 1
            self.need(";")
        elif x == "struct":
            self.i += 1
            self.name()
            self.block(self.field)
        elif x == "enum":
            self.i += 1
            self.name()
            self.need("{")
            self.many(self.name, "}")
        elif x == "event" or (x == "error" and self.k[self.i + 1] == "a"):
            self.i += 1
            self.name()
            self.parameters()
            self.take("anonymous")
            self.need(";")
        elif x == "type" and self.k[self.i + 1] == "a":
            self.i += 2
            if not self.take("is"):
                raise self.fault("expected is")
            self.type()
            self.need(";")
        elif x == "modifier":
            self.i += 1
            self.name()
            if self.at("("):
                self.parameters()
            self.heads()
            self.body()
        elif x in ("constructor", "receive", "fallback", "function") and not (x != "function" and self.k[self.i + 1] != "("):
            self.i += 1
            if x == "function" and not self.at("("):
                self.name()
            at = self.i
            self.parameters()
            self.heads()
            if x == "function" and not self.at("{", ";"):
                self.i = at - 1  # a variable whose type is a function's
                return self.variable()
            self.body()
        else:
            self.variable()

    def body(self) -> None:
        if not self.take(";"):
            self.block(self.statement)

    def heads(self) -> None:
        while not self.at("{", ";", ""):
            if self.take("returns"):
                self.parameters()
            elif self.take("override"):
                if self.at("("):
                    self.balanced()
            elif self.k[self.i] in ("public", "private", "internal", "external", "pure", "view", "payable", "virtual", "constant"):
                self.i += 1
            elif self.at("a"):
                self.path()
                if self.at("("):
                    self.arguments()
            else:
                return

    def field(self) -> None:
        self.type()
        self.name()
        self.need(";")

    def variable(self) -> None:
        self.type()
        while self.k[self.i] in self.VARIABLE:
            self.i += 1
            if self.k[self.i - 1] == "override" and self.at("("):
                self.balanced()
        self.name()
        if self.take("="):
            self.expression()
        self.need(";")

    def parameters(self) -> None:
        self.need("(")
        self.many(self.parameter, ")")

    def parameter(self) -> None:
        self.type()
        self.take("indexed")
        self.skip_words(self.LOCATIONS)
        if self.k[self.i] == "a" or self.k[self.i] in self.SOFT:
            self.i += 1

    def type(self) -> None:
        if self.take("mapping"):
            self.need("(")
            self.type()
            if self.k[self.i] == "a":
                self.i += 1
            self.need("=>")
            self.type()
            if self.k[self.i] == "a":
                self.i += 1
            self.need(")")
        elif self.take("function"):
            self.parameters()
            self.skip_words(frozenset(("public", "private", "internal", "external", "pure", "view", "payable")))
            if self.take("returns"):
                self.parameters()
        else:
            self.path()
            self.take("payable")
        while self.take("["):
            if not self.at("]"):
                self.expression()
            self.need("]")

    def local(self) -> None:
        if self.take("("):
            n = 0
            while not self.at(")"):
                if not self.at(","):
                    self.type()
                    self.skip_words(self.LOCATIONS)
                    self.name()
                    n += 1
                if not self.take(","):
                    break
            self.need(")")
            self.need("=")
            if not n:
                raise self.fault("no variable")
            self.expression()
            return self.need(";")
        self.type()
        self.skip_words(self.LOCATIONS)
        self.name()
        if not self.at("=", ";"):
            raise self.fault("no declaration")
        if self.take("="):
            self.expression()
        self.need(";")

    def statement(self) -> None:
        x = self.k[self.i]
        if x == "{":
            self.block(self.statement)
        elif x == "if":
            self.i += 1
            self.condition()
            self.statement()
            if self.take("else"):
                self.statement()
        elif x == "while":
            self.i += 1
            self.condition()
            self.statement()
        elif x == "do":
            self.i += 1
            self.statement()
            if not self.take("while"):
                raise self.fault("expected while")
            self.condition()
            self.need(";")
        elif x == "for":
            self.i += 1
            self.need("(")
            if not self.take(";"):
                self.simple()
            if not self.at(";"):
                self.expression()
            self.need(";")
            if not self.at(")"):
                self.expression()
            self.need(")")
            self.statement()
        elif x == "unchecked":
            self.i += 1
            self.block(self.statement)
        elif x == "assembly":
            self.i += 1
            self.take('"')
            if self.at("("):
                self.balanced()
            self.balanced()
        elif x == "try":
            self.i += 1
            flag, self.no_brace = self.no_brace, True
            self.expression()
            self.no_brace = flag
            if self.take("returns"):
                self.parameters()
            self.block(self.statement)
            if not self.at("catch"):
                raise self.fault("expected catch")
            while self.take("catch"):
                if not self.at("{", "("):
                    self.name()
                if self.at("("):
                    self.parameters()
                self.block(self.statement)
        elif x in ("break", "continue", "throw"):
            self.i += 1
            self.need(";")
        elif x in ("return", "emit") or (x == "revert" and self.k[self.i + 1] == "a"):
            self.i += 1
            if not (x == "return" and self.at(";")):
                self.expression()
            self.need(";")
        else:
            self.simple()

    def simple(self) -> None:
        if not (self.at("a", "(", "mapping", "function", "error", "type") and self.attempt(self.local)):
            self.expression()
            self.need(";")

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def arguments(self) -> None:
        self.need("(")
        if self.at("{"):
            self.options()
            return self.need(")")
        self.many(self.expression, ")")

    def options(self) -> None:
        self.need("{")
        self.many(self.option, "}")

    def option(self) -> None:
        self.name()
        self.need(":")
        self.expression()

    def primary(self) -> None:
        x = self.k[self.i]
        if x == "0":
            self.i += 1
            if self.at("a") and self.k[self.i + 1] not in ("(", "."):
                self.i += 1  # a unit
        elif x == '"':
            while self.take('"'):
                pass
        elif x == "(":
            self.i += 1
            while not self.at(")"):
                if not self.at(","):
                    self.expression()
                if not self.take(","):
                    break
            self.need(")")
        elif x == "[":
            self.i += 1
            self.many(self.expression, "]")
        elif x == "new":
            self.i += 1
            self.type()
        elif x == "a" or x in self.SOFT or x in ("true", "false", "payable"):
            self.i += 1
        else:
            raise self.fault("expected an expression")

    def postfix(self) -> None:
        while True:
            x = self.k[self.i]
            if x == "(":
                self.arguments()
            elif x == "{" and self.k[self.i + 1] == "a" and self.k[self.i + 2] == ":":
                self.options()
            elif x == "[":
                self.i += 1
                if not self.at("]", ":"):
                    self.expression()
                if self.take(":") and not self.at("]"):
                    self.expression()
                self.need("]")
            elif x == ".":
                self.i += 1
                if not self.take("address"):
                    self.name()
            elif x in ("++", "--"):
                self.i += 1
            else:
                return


class Zig(Modern):
    KEYWORDS = frozenset(
        """pub const var fn export extern inline noinline comptime test usingnamespace struct enum union opaque packed if else while for switch return break continue defer errdefer try catch orelse and or error unreachable undefined
        null true false align callconv linksection volatile allowzero asm async await suspend resume nosuspend anytype anyframe threadlocal""".split()
    )
    OPAQUE = re.compile(r"//[^\n]*|(?:\\\\[^\n]*(?:\n[ \t]*(?=\\\\))?)+|@?" + _DOUBLE + "|" + _SINGLE)
    TOKEN = tokens("++", "**", "+%", "-%", "*%", "+|", "-|", "*|", "..", "...", ".{", ".*", ".?", "=>", "+%=", "-%=", "*%=", "||")
    BINARY = {"||": 10, "*": 10, "/": 10, "%": 10, "*%": 10, "**": 10, "*|": 10, "+": 9, "-": 9, "++": 9, "+%": 9, "-%": 9, "+|": 9, "-|": 9, "<<": 8, ">>": 8, "&": 7, "^": 7, "|": 7, "orelse": 7, "==": 5, "!=": 5, "<": 5, ">": 5, "<=": 5, ">=": 5, "and": 3, "or": 2, "!": 11}
    ASSIGN = Modern.ASSIGN | frozenset("+%= -%= *%=".split())
    PREFIX = frozenset("! - ~ & try await comptime nosuspend ? -%".split())

    @staticmethod
    def replaced(m: re.Match) -> str:
        if m[0].startswith('@"'):
            return "a"
        return "\n" * m[0].count("\n") + '""' if m[0].startswith("\\\\") else Modern.replaced(m)

    def unit(self) -> None:
        self.until("", self.member)

    def member(self) -> None:
        k = self.k
        if self.at("test"):
            self.i += 1
            if self.at('"', "a"):
                self.i += 1
            return self.code_block()
        if self.at("comptime") and k[self.i + 1] == "{":
            self.i += 1
            return self.code_block()
        at = self.i
        self.skip_words(frozenset(("pub", "export", "inline", "noinline", "threadlocal")))
        if self.take("extern"):
            self.take('"')
        if self.at("const", "var"):
            return self.declaration()
        if self.at("fn"):
            self.function()
            if not self.take(";"):
                self.code_block()
            return None
        if self.take("usingnamespace"):
            self.expression()
            return self.need(";")
        self.i = at
        self.take("comptime")
        if not self.at("a", "align"):
            raise self.fault("expected a declaration")
        self.name()
        if self.take(":"):
            self.binary(0)
            if self.take("align"):
                self.balanced()
        if self.take("="):
            self.expression()
        if not self.take(",") and not self.at("}", ""):
            raise self.fault("expected a comma")

    def declaration(self) -> None:
        while True:
            if self.at("const", "var"):
                self.i += 1
            self.name()
            if self.take(":"):
                self.binary(0)
            while self.at("align", "linksection"):
                self.i += 1
                self.balanced()
            if not (self.take(",")):
                break
        if self.take("="):
            self.expression()
        self.need(";")

    def function(self) -> None:
        self.i += 1
        if self.at("a"):
            self.i += 1
        self.need("(")
        self.many(self.parameter, ")")
        while self.at("align", "linksection", "callconv"):
            self.i += 1
            self.balanced()
        if not self.at("{", ";"):
            flag, self.no_brace = self.no_brace, True
            self.take("!")
            self.binary(0)
            self.no_brace = flag

    def parameter(self) -> None:
        self.skip_words(frozenset(("comptime", "noalias")))
        if self.take("..."):
            return
        if self.at("a") and self.k[self.i + 1] == ":":
            self.i += 2
        if not self.take("anytype"):
            self.binary(0)

    def code_block(self) -> None:
        self.block(self.statement)

    def capture(self) -> None:
        if self.take("|"):
            while True:
                self.take("*")
                self.name()
                if not self.take(","):
                    break
            self.need("|")

    def statement(self) -> None:
        if self.at("const", "var") or (self.at("comptime") and self.k[self.i + 1] in ("const", "var")):
            self.take("comptime")
            return self.declaration()
        if self.at("defer", "errdefer", "comptime", "suspend") and not (self.at("comptime") and self.k[self.i + 1] not in ("{", "a")):
            self.i += 1
            self.capture()
            return self.statement()
        started = self.k[self.i]
        self.expression()
        block_like = started in ("if", "while", "for", "switch", "{", "inline") or (started == "a" and self.k[self.i - 1] == "}")
        if not self.take(";") and not (block_like and self.k[self.i - 1] in ("}", ";")):
            raise self.fault("expected ;")

    def condition(self) -> None:
        self.need("(")
        flag, self.no_brace = self.no_brace, False
        self.many(self.loop_operand, ")")
        self.no_brace = flag

    def loop_operand(self) -> None:
        self.binary(0)
        if self.take("..") and not self.at(")", ","):
            self.binary(0)

    def branch(self) -> None:
        """What a condition or a loop does: a block, or an expression, possibly an assignment."""
        self.code_block() if self.at("{") else self.expression()

    def infix(self, least: int) -> bool:
        if self.at("catch") and least < 7:
            self.i += 1
            self.capture()
            self.binary(7) if not self.at("return", "break", "continue") else self.expression()
            return True
        return False

    def unary(self) -> None:
        while True:
            if self.k[self.i] in self.PREFIX:
                self.i += 1
            elif self.at("*", "**"):
                self.i += 1
                self.pointer()
            elif self.at("["):
                self.i += 1
                if self.take("*"):
                    self.take("a") or self.take("c")
                if not self.at("]", ":"):
                    self.expression()
                if self.take(":"):
                    self.expression()
                self.need("]")
                self.pointer()
            else:
                break
        self.primary()
        self.postfix()

    def pointer(self) -> None:
        while self.at("const", "volatile", "allowzero", "align"):
            self.i += 1
            if self.at("("):
                self.balanced()

    def primary(self) -> None:
        x = self.k[self.i]
        self.enter()
        if x in ("0", '"', "null", "true", "false", "undefined", "unreachable", "anytype", "anyframe"):
            self.i += 1
        elif x == "(":
            self.condition()
        elif x == "@":
            self.i += 1
            self.name_or_keyword()
        elif x == ".":
            self.i += 1
            self.name_or_keyword()
        elif x == ".{":
            self.i += 1
            self.initializer()
        elif x == "error":
            self.i += 1
            if self.take("."):
                self.name()
            elif self.take("{"):
                self.many(self.name, "}")
        elif x in ("struct", "enum", "union", "opaque", "packed", "extern"):
            self.skip_words(frozenset(("packed", "extern")))
            if not self.at("struct", "enum", "union", "opaque"):
                raise self.fault("expected a container")
            self.i += 1
            if self.at("("):
                self.balanced()
            self.block(self.member)
        elif x == "fn":
            self.function()
        elif x == "if":
            self.i += 1
            self.condition()
            self.capture()
            self.branch()
            if self.at(";") and self.k[self.i + 1] == "else":
                raise self.fault("unexpected ;")
            if self.take("else"):
                self.capture()
                self.branch()
        elif x in ("while", "for") or (x == "inline" and self.k[self.i + 1] in ("while", "for")):
            self.i += 1 + (x == "inline")
            self.condition()
            self.capture()
            if self.take(":"):
                self.need("(")
                flag, self.no_brace = self.no_brace, False
                self.expression() if not self.at("{") else self.code_block()
                self.no_brace = flag
                self.need(")")
            self.branch()
            if self.take("else"):
                self.capture()
                self.branch()
        elif x == "switch":
            self.i += 1
            self.condition()
            self.need("{")
            self.many(self.prong, "}")
        elif x == "{":
            self.code_block()
        elif x == "asm":
            self.i += 1
            self.take("volatile")
            self.balanced()
        elif x in ("return", "break", "continue", "resume"):
            self.i += 1
            if self.at(":"):
                self.i += 2
            if not self.at(";", ",", ")", "}", "else", "]"):
                self.expression()
        elif x == "a":
            self.i += 1
            if self.at(":") and self.k[self.i + 1] in ("{", "while", "for", "inline", "switch"):
                self.i += 1
                self.primary()
        else:
            raise self.fault("expected an expression")
        self.depth -= 1

    def name_or_keyword(self) -> None:
        if not self.k[self.i] or not (self.k[self.i] == "a" or self.k[self.i].isalpha()):
            raise self.fault("expected a name")
        self.i += 1

    def prong(self) -> None:
        self.take("inline")
        if not self.take("else"):
            while not self.at("=>"):
                self.binary(0)
                if self.take("..."):
                    self.binary(0)
                if not self.take(","):
                    break
        self.need("=>")
        self.capture()
        self.branch()

    def initializer(self) -> None:
        flag, self.no_brace = self.no_brace, False
        while not self.at("}"):
            if self.at(".") and self.k[self.i + 2] == "=":
                self.i += 3
            self.expression()
            if not self.take(","):
                break
        self.need("}")
        self.no_brace = flag

    def postfix(self) -> None:
        while True:
            x = self.k[self.i]
            if x == "(":
                self.i += 1
                flag, self.no_brace = self.no_brace, False
                self.many(self.expression, ")")
                self.no_brace = flag
            elif x == "[":
                self.i += 1
                self.expression()
                if self.take(".."):
                    if not self.at("]", ":"):
                        self.expression()
                    if self.take(":"):
                        self.expression()
                self.need("]")
            elif x == ".":
                self.i += 1
                self.name_or_keyword()
            elif x in (".*", ".?"):
                self.i += 1
            elif x == "{" and not self.no_brace and self.k[self.i - 1] in ("a", "]") and (self.k[self.i + 1] in (".", "}", "0", '"', ".{") or self.k[self.i - 1] == "]"):
                self.i += 1
                self.initializer()
            else:
                return


class Php(Modern):
    KEYWORDS = frozenset(
        """namespace use const function class interface trait enum extends implements abstract final public private protected static readonly var new clone return echo print if else elseif endif while endwhile for endfor foreach endforeach
        switch endswitch case default match break continue do try catch finally throw declare enddeclare global unset isset empty list array fn as insteadof instanceof yield from goto include include_once require require_once and or xor
        true false null exit die self parent callable""".split()
    )
    SOFT = KEYWORDS - frozenset("function class if else while for foreach switch case return echo new".split())
    OPAQUE = re.compile(r"\?>(?:[^<]|<(?!\?))*+(?:<\?(?:php|=)?|\Z)|(?://|#(?!\[))(?:(?!\?>)[^\n])*|/\*(?:[^*]|\*(?!/))*+\*/|<<<[ \t]*(?P<q>['\"]?)(?P<tag>\w+)(?P=q)\r?\n(?:.*\r?\n)*?[ \t]*(?P=tag)\b|\"(?:[^\"\\]|\\.)*+\"|'(?:[^'\\]|\\.)*+'|`[^`]*`")
    TOKEN = tokens("?->", "->", "=>", "::", "??=", "??", "<=>", "===", "!==", "<>", "**=", "**", ".=", "...", "\\")
    BINARY = {"**": 13, "instanceof": 12, "*": 10, "/": 10, "%": 10, "+": 9, "-": 9, "<<": 8, ">>": 8, ".": 7, "<": 6, ">": 6, "<=": 6, ">=": 6, "==": 5, "!=": 5, "===": 5, "!==": 5, "<>": 5, "<=>": 5, "&": 4, "^": 4, "|": 4, "&&": 3, "||": 2, "??": 1, "and": 1, "or": 1, "xor": 1}
    ASSIGN = Modern.ASSIGN | frozenset(".= ??= **=".split())
    PREFIX = frozenset("! - + ~ & @ ++ --".split())
    TERNARY = True
    MODIFIERS = frozenset("abstract final public private protected static readonly var".split())
    CASTS = frozenset("int integer float double string bool boolean array object binary unset".split())

    @staticmethod
    def replaced(m: re.Match) -> str:
        return ";" if m[0].startswith("?>") else Modern.replaced(m)

    def opaque(self, text: str) -> str:
        start = re.search(r"<\?(?:php|=)?", text)
        return super().opaque(text[start.end() :]) if start else ""

    def end(self) -> None:
        if not self.take(";") and not self.at(""):
            raise self.fault("expected ;")

    def attributes(self) -> None:
        while self.at("#") and self.k[self.i + 1] == "[":
            self.i += 1
            self.balanced()

    def qualified(self) -> None:
        self.take("\\")
        self.name()
        while self.take("\\"):
            self.name()

    def type(self) -> None:
        self.take("?")
        while True:
            if self.take("("):
                self.type()
                self.need(")")
            else:
                self.qualified()
            if not (self.at("|") or (self.at("&") and self.k[self.i + 1] in ("a", "\\", "self", "(") and self.k[self.i + 2] in ("a", "&", "...", "\\"))):
                return
            self.i += 1

    def statement(self) -> None:
        self.attributes()
        k, x = self.k, self.k[self.i]
        if x == ";":
            self.i += 1
        elif x == "{":
            self.block(self.statement)
        elif x == "namespace" and k[self.i + 1] != "\\":
            self.i += 1
            if not self.at("{"):
                self.qualified()
            self.block(self.statement) if self.at("{") else self.end()
        elif x == "use":
            self.i += 1
            if self.at("function", "const"):
                self.i += 1
            while True:
                self.take("\\")
                self.name()
                while self.take("\\"):
                    if self.at("{"):
                        self.balanced()
                        break
                    self.name()
                if self.take("as"):
                    self.name()
                if not self.take(","):
                    break
            self.end()
        elif x == "const":
            self.constant()
        elif x == "function" and (k[self.i + 1] == "a" or (k[self.i + 1] == "&" and k[self.i + 2] == "a") or (k[self.i + 1] in self.SOFT and k[self.i + 2] == "(")):
            self.i += 1
            self.take("&")
            self.name()
            self.signature()
            self.block(self.statement)
        elif x in ("class", "interface", "trait") or (x in ("abstract", "final", "readonly") and k[self.i + 1] in ("class", "abstract", "final", "readonly")) or (x == "enum" and k[self.i + 1] == "a"):
            self.class_like()
        elif not self.control(x):
            self.expression()
            self.end()

    def constant(self) -> None:
        self.i += 1
        at = self.i
        if self.k[self.i + 1] != "=":
            self.type()
        if self.at("="):
            self.i = at
        while True:
            self.name()
            self.need("=")
            self.expression()
            if not self.take(","):
                break
        self.end()

    def signature(self) -> None:
        self.need("(")
        self.many(self.parameter, ")")
        if self.take("use"):
            self.need("(")
            self.many(self.captured, ")")
        if self.take(":"):
            self.type()

    def captured(self) -> None:
        self.take("&")
        self.name()

    def parameter(self) -> None:
        self.attributes()
        self.skip_words(self.MODIFIERS)
        if not (self.at("a", "&", "...") and self.k[self.i + 1] in (",", ")", "=", "a", "&", "...", "{") and not (self.at("a") and self.k[self.i + 1] in ("a", "&", "..."))):
            self.type()
        self.take("&")
        self.take("...")
        self.name()
        if self.take("="):
            self.expression()
        if self.at("{"):
            self.balanced()

    def class_like(self) -> None:
        self.skip_words(self.MODIFIERS)
        self.i += 1
        self.name()
        self.class_rest()

    def class_rest(self) -> None:
        if self.take(":"):
            self.type()
        while self.at("extends", "implements"):
            self.i += 1
            while True:
                self.qualified()
                if not self.take(","):
                    break
        self.block(self.member)

    def member(self) -> None:
        self.attributes()
        if self.take("use"):
            while True:
                self.qualified()
                if not self.take(","):
                    break
            return self.balanced() if self.at("{") else self.end()
        if self.take("case"):
            self.name()
            if self.take("="):
                self.expression()
            return self.end()
        start = self.i
        self.skip_words(self.MODIFIERS)
        if self.at("const"):
            return self.constant()
        if self.take("function"):
            self.take("&")
            if not self.k[self.i] or not (self.k[self.i] == "a" or self.k[self.i].isalpha()):
                raise self.fault("expected a name")
            self.i += 1
            self.signature()
            if not self.take(";"):
                self.block(self.statement)
            return None
        if self.i == start:
            raise self.fault("expected a member")
        if self.k[self.i + 1] not in ("=", ";", ",", "{"):
            self.type()
        while True:
            self.name()
            if self.take("="):
                self.expression()
            if not self.take(","):
                break
        return self.balanced() if self.at("{") else self.end()

    def body(self, *ends: str) -> None:
        """A statement, or statements up to a closing word after a colon."""
        if not self.take(":"):
            return self.statement()
        while not self.at(*ends, ""):
            self.statement()

    def closed(self, word: str, colon: bool) -> None:
        if colon:
            if not self.take(word):
                raise self.fault(f"expected {word}")
            self.end()

    def control(self, x: str) -> bool:
        if x == "if":
            self.i += 1
            self.condition()
            colon = self.at(":")
            self.body("elseif", "else", "endif")
            while self.at("elseif") or (self.at("else") and self.k[self.i + 1] == "if"):
                self.i += 1 if self.at("elseif") else 2
                self.condition()
                self.body("elseif", "else", "endif")
            if self.take("else"):
                self.body("endif")
            self.closed("endif", colon)
        elif x in ("while", "for", "foreach", "switch", "declare"):
            self.i += 1
            if x == "for":
                self.need("(")
                for end in (";", ";", ")"):
                    while not self.at(end):
                        self.expression()
                        if not self.take(","):
                            break
                    self.need(end)
            elif x == "foreach":
                self.need("(")
                self.expression()
                if not self.take("as"):
                    raise self.fault("expected as")
                self.expression()
                if self.take("=>"):
                    self.expression()
                self.need(")")
            else:
                self.condition()
            if x == "switch":
                if self.take(":"):
                    while not self.at("endswitch", ""):
                        self.case()
                    self.closed("endswitch", True)
                else:
                    self.block(self.case)
            elif x == "declare" and self.take(";"):
                pass
            else:
                colon = self.at(":")
                self.body(f"end{x}")
                self.closed(f"end{x}", colon)
        elif x == "do":
            self.i += 1
            self.statement()
            if not self.take("while"):
                raise self.fault("expected while")
            self.condition()
            self.end()
        elif x == "try":
            self.i += 1
            self.block(self.statement)
            if not self.at("catch", "finally"):
                raise self.fault("expected catch or finally")
            while self.take("catch"):
                self.need("(")
                self.type()
                if not self.at(")"):
                    self.name()
                self.need(")")
                self.block(self.statement)
            if self.take("finally"):
                self.block(self.statement)
        elif x in ("return", "break", "continue", "echo", "global", "goto") or (x == "static" and self.k[self.i + 1] == "a" and self.k[self.i + 2] in ("=", ";", ",")):
            self.i += 1
            while not self.at(";", ""):
                self.expression()
                if not self.take(","):
                    break
            self.end()
        elif x == "a" and self.k[self.i + 1] == ":" and self.k[self.i + 2] != ":":
            self.i += 2
        else:
            return False
        return True

    def case(self) -> None:
        if self.take("case"):
            self.expression()
        elif not self.take("default"):
            raise self.fault("expected case or default")
        if not self.take(";"):
            self.need(":")
        while not self.at("case", "default", "}", "endswitch", ""):
            self.statement()

    def condition(self) -> None:
        self.need("(")
        self.many(self.expression, ")")

    def unary(self) -> None:
        while True:
            if self.k[self.i] in self.PREFIX:
                self.i += 1
            elif self.at("new", "clone", "print", "throw", "include", "include_once", "require", "require_once") or (self.at("yield") and self.k[self.i + 1] not in (";", ")", ",")):
                word = self.k[self.i]
                self.i += 1
                if word == "new":
                    return self.creation()
                self.take("from")
                if word in ("print", "throw", "include", "include_once", "require", "require_once", "yield"):
                    self.expression()
                    if word == "yield" and self.take("=>"):
                        self.expression()
                    return None
            elif self.at("(") and self.k[self.i + 2] == ")" and self.k[self.i + 1] in ("a", "array", "unset") and (self.k[self.i + 3] in ("a", '"', "0", "(", "!", "-", "[", "new", "self", "static", "@")):
                self.i += 3  # a cast, or a constant in brackets
            else:
                break
        self.primary()
        self.postfix()
        return None

    def creation(self) -> None:
        self.attributes()
        self.skip_words(frozenset(("readonly",)))
        if self.take("class"):
            if self.at("("):
                self.arguments()
            self.class_rest()
        elif self.at("("):
            self.condition()
            if self.at("("):
                self.arguments()
        else:
            self.qualified() if self.at("a", "\\", "static", "self", "parent") else self.primary()
            while self.at("->", "::", "[") and not self.at("("):
                self.i += 1
                if self.k[self.i - 1] == "[":
                    self.expression()
                    self.need("]")
                else:
                    self.name()
            if self.at("("):
                self.arguments()
        self.postfix()

    def arguments(self) -> None:
        self.need("(")
        self.many(self.argument, ")")

    def argument(self) -> None:
        if self.k[self.i + 1] == ":" and self.k[self.i + 2] != ":" and (self.k[self.i] == "a" or self.k[self.i].isalpha()):
            self.i += 2
        if self.take("...") and self.at(")"):
            return
        self.expression()

    def element(self) -> None:
        self.take("...")
        self.expression()
        if self.take("=>"):
            self.expression()

    def elements(self, close: str) -> None:
        while not self.at(close):
            if not self.at(","):
                self.element()
            if not self.take(","):
                break
        self.need(close)

    def primary(self) -> None:
        x = self.k[self.i]
        if x in ("0", '"', "true", "false", "null"):
            self.i += 1
        elif x == "(":
            self.i += 1
            self.expression()
            self.need(")")
        elif x == "[":
            self.i += 1
            self.elements("]")
        elif x in ("array", "list") and self.k[self.i + 1] == "(":
            self.i += 2
            self.elements(")")
        elif x in ("isset", "unset", "empty") or (x in ("exit", "die") and self.k[self.i + 1] == "("):
            self.i += 1
            self.arguments()
        elif x in ("function", "fn") or (x == "static" and self.k[self.i + 1] in ("function", "fn")):
            self.i += 1 + (x == "static")
            arrow = self.k[self.i - 1] == "fn"
            self.take("&")
            self.signature()
            if arrow:
                self.need("=>")
                self.expression()
            else:
                self.block(self.statement)
        elif x == "match" and self.k[self.i + 1] == "(":
            self.i += 1
            self.condition()
            self.need("{")
            self.many(self.arm, "}")
        elif x == "$":
            self.i += 1
            self.balanced() if self.at("{") else self.primary()
        elif x == "#":
            self.attributes()
            self.primary()
        elif x in ("a", "\\") or x in self.SOFT:
            self.qualified()
        else:
            raise self.fault("expected an expression")

    def arm(self) -> None:
        if not (self.at("default") and self.k[self.i + 1] in ("=>", ",")):
            while not self.at("=>"):
                self.expression()
                if not self.take(","):
                    break
        else:
            self.i += 1
            self.take(",")
        self.need("=>")
        self.expression()

    def postfix(self) -> None:
        while True:
            x = self.k[self.i]
            if x == "(":
                self.arguments()
            elif x == "[":
                self.i += 1
                if not self.at("]"):
                    self.expression()
                self.need("]")
            elif x in ("->", "?->", "::"):
                self.i += 1
                if self.at("{"):
                    self.balanced()
                elif self.at("$"):
                    self.primary()
                elif self.k[self.i] == "a" or self.k[self.i].isalpha():
                    self.i += 1
                else:
                    raise self.fault("expected a name")
            elif x in ("++", "--"):
                self.i += 1
            else:
                return
