"""Java, C, Go and Rust."""

from __future__ import annotations

import re

from .core import Fault, Parser, memo, tokens

_C_BINARY = {"||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "<<": 8, ">>": 8, ">>>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10}
_ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= >>>=".split())
_C_COMMENT = r"//[^\n]*|/\*(?:[^*]|\*(?!/))*+\*/"


class CLike(Parser):
    """Expressions that Java and C share."""

    BINARY = _C_BINARY

    def shift_width(self) -> int:
        """Tokens of a shift to the right: each > is a token of its own, for the sake of nested type arguments."""
        k, i = self.k, self.i
        n = 1
        while k[i + n] == ">":
            n += 1
        return n if n > 1 else 0

    @memo
    def expression(self) -> None:
        self.enter()
        self.binary(0)
        if self.take("?"):
            self.expression()
            self.need(":")
            self.expression()
        elif self.k[self.i] in _ASSIGN:
            self.i += 1
            self.expression()
        self.depth -= 1

    def binary(self, least: int) -> None:
        """Precedence climbing."""
        self.unary()
        while True:
            op, width = self.k[self.i], 1
            power = self.BINARY.get(op, 0)
            if op == ">" and (n := self.shift_width()):
                power, width = 8, n
            if not power or power <= least:
                if power == 0 and self.infix(least):
                    continue
                return
            self.i += width
            self.binary(power)

    def infix(self, least: int) -> bool:
        """Operators that don't join two expressions."""
        return False

    def arguments(self) -> None:
        self.need("(")
        self.many(self.expression, ")")

    def attempt(self, rule) -> bool:
        """Whether ``rule`` parses here; if not, nothing has moved."""
        at, depth, errors = self.i, self.depth, len(self.errors)
        try:
            rule()
        except Fault:
            self.i, self.depth = at, depth
            del self.errors[errors:]
            return False
        if len(self.errors) > errors:
            self.i, self.depth = at, depth
            del self.errors[errors:]
            return False
        return True


class Java(CLike):
    PRIMITIVES = frozenset("int long short byte char float double boolean".split())
    MODIFIERS = frozenset("public private protected static final abstract native synchronized transient volatile strictfp default sealed".split())
    KEYWORDS = (
        frozenset(
            """assert break case catch class const continue do else enum extends finally for goto if implements import instanceof interface new package return super switch this throw
            throws try void while true false null var record yield permits when non-sealed""".split()
        )
        | PRIMITIVES
        | MODIFIERS
    )
    SOFT = frozenset("var record yield permits when sealed".split())
    OPAQUE = re.compile(_C_COMMENT + r"|\"\"\"[ \t]*\r?\n(?:[^\"\\]|\\.|\"(?!\"\"))*+\"\"\"|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\u+[0-9a-fA-F]{4}|\\[0-7]{1,3}|\\.)'", re.S)

    def opaque(self, text: str) -> str:
        return super().opaque(text).replace("non-sealed", "sealed")

    def unit(self) -> None:
        self.until("", self.top)

    def top(self) -> None:
        if self.take(";"):
            return
        at = self.i
        self.annotations()
        if self.take("package"):
            self.qualified()
            return self.need(";")
        if self.take("import"):
            self.take("static")
            self.name()
            while self.take("."):
                if self.take("*"):
                    break
                self.name()
            return self.need(";")
        self.i = at
        if not self.type_declaration_ahead():
            if self.k[self.i] in ("a", "void", *self.PRIMITIVES, *self.MODIFIERS, "<", "@"):
                raise self.fault("expected a type declaration")
            raise self.fault("unexpected token")
        self.type_declaration()

    def qualified(self) -> None:
        self.name()
        while self.take("."):
            self.name()

    def annotations(self) -> None:
        while self.at("@") and self.k[self.i + 1] != "interface":
            self.i += 1
            self.qualified()
            if self.at("("):
                self.i += 1
                while not self.at(")"):
                    if self.k[self.i] == "a" and self.k[self.i + 1] == "=":
                        self.i += 2
                    self.element_value()
                    if not self.take(","):
                        break
                self.need(")")

    def element_value(self) -> None:
        if self.take("{"):
            self.many(self.element_value, "}")
        elif self.at("@"):
            self.annotations()
        else:
            self.expression()

    def modifiers(self) -> None:
        while True:
            if self.at("@") and self.k[self.i + 1] != "interface":
                self.annotations()
            elif self.k[self.i] in self.MODIFIERS and not (self.at("default") and self.k[self.i + 1] in (":", "->")):
                self.i += 1
            else:
                return

    def type_declaration_ahead(self) -> bool:
        at = self.i
        try:
            self.modifiers()
            return self.at("class", "interface", "enum") or (self.at("@") and self.k[self.i + 1] == "interface") or (self.at("record") and self.k[self.i + 1] == "a" and self.k[self.i + 2] in ("(", "<"))
        except Fault:
            return False
        finally:
            self.i = at

    def type_declaration(self) -> None:
        self.modifiers()
        self.take("@")
        kind = self.k[self.i]
        self.i += 1
        self.name()
        if self.at("<"):
            self.type_parameters()
        if kind == "record":
            self.need("(")
            self.many(self.parameter, ")")
        for word in ("extends", "implements", "permits"):
            if self.take(word):
                self.type()
                while self.take(","):
                    self.type()
        if kind == "enum":
            self.need("{")
            while self.at("a", "@") or self.k[self.i] in self.SOFT:
                self.annotations()
                self.name()
                if self.at("("):
                    self.arguments()
                if self.at("{"):
                    self.block(self.member)
                if not self.take(","):
                    break
            if self.take(";"):
                self.block(self.member, True)
            else:
                self.need("}")
        else:
            self.block(self.member)

    @memo
    def member(self) -> None:
        if self.take(";"):
            return None
        if self.at("{") or (self.at("static") and self.k[self.i + 1] == "{"):
            self.take("static")
            return self.block(self.statement)
        if self.type_declaration_ahead():
            return self.type_declaration()
        self.head()
        if self.at("{") and self.k[self.i - 1] != "=":
            return self.block(self.statement)
        if self.k[self.i - 1] == "=":
            self.initializer()
            while self.take(","):
                self.declarator()
            self.need(";")
        return None

    @memo
    def head(self) -> None:
        """A member up to the brace of its body, the = of its value or its end."""
        self.modifiers()
        if self.at("<"):
            self.type_parameters()
            self.modifiers()
        if (self.at("a") or self.k[self.i] in self.SOFT) and self.k[self.i + 1] in ("(", "{"):
            self.i += 1  # a constructor
            if self.at("{"):
                return
        else:
            if not self.take("void"):
                self.type()
            self.name()
        if self.at("("):
            self.i += 1
            self.many(self.parameter, ")")
            self.dimensions()
            if self.take("throws"):
                self.type()
                while self.take(","):
                    self.type()
            if self.take("default"):
                self.element_value()
            if not self.at("{"):
                self.need(";")
            return
        self.dimensions()
        while self.take(","):
            self.name()
            self.dimensions()
        if not self.take("="):
            self.need(";")

    def parameter(self) -> None:
        self.modifiers()
        self.type()
        self.annotations()
        self.take("...")
        if self.take("this"):
            return
        self.name()
        self.dimensions()

    def dimensions(self) -> None:
        while self.at("[") and self.k[self.i + 1] == "]":
            self.i += 2

    def declarator(self) -> None:
        self.name()
        self.dimensions()
        if self.take("="):
            self.initializer()

    def initializer(self) -> None:
        if self.take("{"):
            self.enter()
            self.many(self.initializer, "}")
            self.depth -= 1
        else:
            self.expression()

    def type(self) -> None:
        self.annotations()
        if self.k[self.i] in self.PRIMITIVES:
            self.i += 1
        else:
            while True:
                self.name()
                if self.at("<"):
                    self.type_arguments()
                if self.at(".") and self.k[self.i + 1] in ("a", "@"):
                    self.i += 1
                    self.annotations()
                    continue
                break
        self.dimensions()

    def type_arguments(self) -> None:
        self.need("<")
        self.enter()
        while not self.at(">"):
            self.annotations()
            if self.take("?"):
                if self.at("extends", "super"):
                    self.i += 1
                    self.type()
            else:
                self.type()
            while self.take("&"):
                self.type()
            if not self.take(","):
                break
        self.need(">")
        self.depth -= 1

    def type_parameters(self) -> None:
        self.need("<")
        while not self.at(">"):
            self.annotations()
            self.name()
            if self.take("extends"):
                self.type()
                while self.take("&"):
                    self.type()
            if not self.take(","):
                break
        self.need(">")

    # Statements

    @memo
    def statement(self) -> None:
        k, x = self.k, self.k[self.i]
        if x == "{":
            self.block(self.statement)
        elif x == ";":
            self.i += 1
        elif x == "if" or x == "while":
            self.i += 1
            self.condition()
            self.statement()
            if x == "if" and self.take("else"):
                self.statement()
        elif x == "for":
            self.loop()
        elif x == "do":
            self.i += 1
            self.statement()
            self.need("while")
            self.condition()
            self.need(";")
        elif x == "return" or x == "throw" or (x == "yield" and k[self.i + 1] not in ("=", ".", "(", "++", "--")):
            self.i += 1
            if not (x == "return" and self.at(";")):
                self.expression()
            self.need(";")
        elif x in ("break", "continue"):
            self.i += 1
            self.take("a")
            self.need(";")
        elif x == "try":
            self.tries()
        elif x == "switch":
            self.switch()
            self.take(";")
        elif x == "synchronized" and k[self.i + 1] == "(":
            self.i += 1
            self.condition()
            self.block(self.statement)
        elif x == "assert":
            self.i += 1
            self.expression()
            if self.take(":"):
                self.expression()
            self.need(";")
        elif x == "a" and k[self.i + 1] == ":":
            self.i += 2
            self.statement()
        elif x in ("class", "interface", "enum", "record", "abstract", "final", "static", "@", "sealed") and self.type_declaration_ahead():
            self.type_declaration()
        elif not self.attempt(self.variables):
            self.expression()
            self.need(";")
        return None

    def variables(self) -> None:
        self.modifiers()
        self.type()
        self.declarator()
        while self.take(","):
            self.declarator()
        self.need(";")

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def loop(self) -> None:
        self.need("for")
        self.need("(")
        if not self.attempt(self.each):
            if not self.take(";") and not self.attempt(self.variables):
                self.expressions()
                self.need(";")
            if not self.at(";"):
                self.expression()
            self.need(";")
            if not self.at(")"):
                self.expressions()
        self.need(")")
        self.statement()

    def each(self) -> None:
        self.modifiers()
        self.type()
        self.name()
        self.need(":")
        self.expression()

    def expressions(self) -> None:
        self.expression()
        while self.take(","):
            self.expression()

    def tries(self) -> None:
        self.need("try")
        resources = self.take("(")
        if resources:
            while not self.at(")"):
                if not self.attempt(self.resource):
                    self.expression()
                if not self.take(";"):
                    break
            self.need(")")
        self.block(self.statement)
        caught = False
        while self.take("catch"):
            caught = True
            self.need("(")
            self.modifiers()
            self.type()
            while self.take("|"):
                self.type()
            self.name()
            self.need(")")
            self.block(self.statement)
        if self.take("finally"):
            self.block(self.statement)
        elif not caught and not resources:
            raise self.fault("expected catch")

    def resource(self) -> None:
        self.modifiers()
        self.type()
        self.name()
        self.need("=")
        self.expression()

    def switch(self) -> None:
        self.need("switch")
        self.condition()
        self.need("{")
        self.enter()
        while not self.at("}", ""):
            if self.take("case"):
                while True:
                    self.take("default") or self.pattern()
                    if not self.take(","):
                        break
                if self.take("when"):
                    self.expression()
            else:
                self.need("default")
            if self.take("->"):
                if self.at("{", "throw"):
                    self.statement()
                else:
                    self.expression()
                    self.need(";")
            else:
                self.need(":")
                while not self.at("case", "default", "}", ""):
                    self.statement()
        self.need("}")
        self.depth -= 1

    def pattern(self) -> None:
        if not self.attempt(self.type_pattern):
            self.binary(0)
            if self.take("?"):
                self.expression()
                self.need(":")
                self.expression()

    def type_pattern(self) -> None:
        self.modifiers()
        self.type()
        if self.take("("):
            self.many(self.type_pattern, ")")
            if self.at("a"):
                self.i += 1
        else:
            self.name()

    # Expressions

    def infix(self, least: int) -> bool:
        if self.at("instanceof") and least < 7:
            self.i += 1
            if not self.attempt(self.type_pattern):
                self.type()
            return True
        return False

    def lambda_ahead(self) -> bool:
        k, i = self.k, self.i
        if (k[i] == "a" or k[i] in self.SOFT) and k[i + 1] == "->":
            return True
        return k[i] == "(" and k[self.closing(i)] == "->"

    def unary(self) -> None:
        while self.k[self.i] in ("!", "~", "+", "-", "++", "--"):
            self.i += 1
        if self.lambda_ahead():
            if self.take("("):
                self.many(self.lambda_parameter, ")")
            else:
                self.name()
            self.need("->")
            return self.block(self.statement) if self.at("{") else self.expression()
        if self.at("(") and self.attempt(self.cast):
            return None
        self.postfix()
        return None

    def lambda_parameter(self) -> None:
        if self.at("a") and self.k[self.i + 1] in (",", ")"):
            self.i += 1
        else:
            self.parameter()

    def cast(self) -> None:
        self.need("(")
        primitive = self.k[self.i] in self.PRIMITIVES
        self.type()
        while self.take("&"):
            self.type()
        self.need(")")
        if not (self.at("a", "0", '"', "(", "!", "~", "this", "super", "new", "true", "false", "null", "switch") or self.k[self.i] in self.SOFT or (primitive and self.at("+", "-", "++", "--"))):
            raise self.fault("expected an operand")
        self.unary()

    def postfix(self) -> None:
        self.primary()
        while True:
            if self.take("."):
                if self.at("<"):
                    self.type_arguments()
                if self.at("new"):
                    self.creation()
                elif not (self.take("class") or self.take("this") or self.take("super")):
                    self.name()
            elif self.at("("):
                self.arguments()
            elif self.at("["):
                self.i += 1
                self.expression()
                self.need("]")
            elif self.take("::"):
                if self.at("<"):
                    self.type_arguments()
                if not self.take("new"):
                    self.name()
            elif self.at("++", "--"):
                self.i += 1
            else:
                return

    def generic_reference(self) -> None:
        self.type()
        if not self.at("::", "."):
            raise self.fault("expected ::")
        if self.at(".") and self.k[self.i + 1] != "class":
            raise self.fault("expected class")

    def primary(self) -> None:
        x = self.k[self.i]
        if x == "a" and self.k[self.i + 1] in ("<", "[") and self.attempt(self.generic_reference):
            return
        if x in ("a", "0", '"', "this", "super", "true", "false", "null", "void") or x in self.SOFT:
            self.i += 1
        elif x == "(":
            self.i += 1
            self.expression()
            self.need(")")
        elif x == "new":
            self.creation()
        elif x == "switch":
            self.switch()
        elif x in self.PRIMITIVES:
            self.type()
        else:
            raise self.fault("expected an expression")

    def creation(self) -> None:
        self.need("new")
        self.annotations()
        if self.k[self.i] in self.PRIMITIVES:
            self.i += 1
        else:
            self.name()
            while True:
                if self.at("<"):
                    self.type_arguments()
                if not self.take("."):
                    break
                self.name()
        if self.at("["):
            while self.take("["):
                if not self.at("]"):
                    self.expression()
                self.need("]")
            if self.at("{"):
                self.initializer()
            return
        self.arguments()
        if self.at("{"):
            self.block(self.member)


class C(CLike):
    TYPE_WORDS = frozenset(
        """void char short int long float double signed unsigned _Bool _Complex const volatile restrict static extern register auto inline typedef struct union enum _Noreturn _Atomic
        _Thread_local __inline __restrict thread_local constexpr bool __inline__ __const __volatile__ __extension__""".split()
    )
    KEYWORDS = frozenset("break case continue default do else for goto if return sizeof switch while _Alignof _Generic _Static_assert static_assert __attribute__ asm __asm__ typeof".split()) | TYPE_WORDS
    OPAQUE = re.compile(_C_COMMENT + r"|^[ \t]*#(?:[^\\\n/]|\\(?:\r?\n|.)|/(?!\*)|/\*(?:[^*]|\*(?!/))*+\*/)*|(?:\bu8|\b[uUL])?\"(?:[^\"\\\n]|\\(?:.|\r?\n))*+\"|(?:\b[uUL])?'(?:[^'\\\n]|\\.)+'", re.M)

    @staticmethod
    def replaced(m: re.Match) -> str:
        s = m[0].lstrip(" \t")
        if s.startswith(("//", "#")):
            return ""
        return "\n" if s.startswith("/*") and "\n" in s else " " if s.startswith("/*") else '""'

    def unit(self) -> None:
        self.until("", self.external)

    @memo
    def external(self) -> None:
        if self.take(";"):
            return None
        if self.at('"') and self.k[self.i - 1] == "extern":
            self.i += 1
        if self.at("extern") and self.k[self.i + 1] == '"':
            self.i += 2
            return self.block(self.external) if self.at("{") else self.external()
        if self.at("_Static_assert", "static_assert"):
            self.i += 1
            self.arguments()
            return self.need(";")
        self.declaration(True)
        return None

    def attributes(self) -> None:
        while self.at("__attribute__", "asm", "__asm__"):
            self.i = self.closing(self.i + 1)
        while self.at("[") and self.k[self.i + 1] == "[":
            self.i = self.closing(self.i)

    def specifiers(self) -> None:
        """Storage, qualifiers and one type."""
        typed = False
        start = self.i
        while True:
            self.attributes()
            x = self.k[self.i]
            if x in ("struct", "union"):
                self.i += 1
                self.attributes()
                named = self.take("a")
                if self.at("{"):
                    self.block(self.field)
                elif not named:
                    raise self.fault("expected {")
                typed = True
            elif x == "enum":
                self.i += 1
                named = self.take("a")
                if self.take("{"):
                    self.many(self.enumerator, "}")
                elif not named:
                    raise self.fault("expected {")
                typed = True
            elif x == "typeof":
                self.i += 1
                self.arguments()
                typed = True
            elif x in self.TYPE_WORDS:
                self.i += 1
                typed = typed or x in ("void", "char", "short", "int", "long", "float", "double", "signed", "unsigned", "_Bool", "bool", "_Complex")
            elif x == "a" and not typed and self.k[self.i + 1] not in ("=", "(", ",", ";", "[", ")") and not (self.k[self.i + 1] == ":"):
                self.i += 1
                typed = True
            elif x == "a" and not typed and self.i == start and self.k[self.i + 1] in (",", ")", "["):
                self.i += 1  # a parameter of a named type without a name
                typed = True
            elif x == "a" and not typed and self.k[self.i + 1] == "(" and self.k[self.i + 2] == "*":
                self.i += 1  # a pointer to a function that returns a named type
                typed = True
            else:
                break
        if self.i == start:
            raise self.fault("expected a type")

    def enumerator(self) -> None:
        self.name()
        if self.take("="):
            self.expression()

    def field(self) -> None:
        self.specifiers()
        while not self.at(";"):
            if not self.at(":"):
                self.declarator(False)
            if self.take(":"):
                self.expression()
            self.attributes()
            if not self.take(","):
                break
        self.need(";")

    def declaration(self, function: bool) -> None:
        if function and self.at("a") and self.k[self.i + 1] == "(":
            # A macro call, or a function without a type.
            j = self.closing(self.i + 1)
            if self.k[j] == "{":
                self.i = j
                return self.block(self.statement)
            if self.k[j] == ";":
                self.i = j + 1
                return None
        self.specifiers()
        first = True
        while not self.at(";"):
            self.declarator(False)
            self.attributes()
            if first and function and self.at("{") and self.k[self.i - 1] == ")":
                return self.block(self.statement)
            first = False
            if self.take("="):
                self.initializer()
            if not self.take(","):
                break
        self.need(";")
        return None

    def declarator(self, abstract: bool) -> None:
        while self.at("*", "const", "volatile", "restrict", "__restrict", "^"):
            self.i += 1
        self.attributes()
        if self.at("(") and not (abstract and (self.k[self.i + 1] in self.TYPE_WORDS or self.k[self.i + 1] == ")")):
            self.i += 1
            self.declarator(abstract)
            self.need(")")
        elif self.at("a"):
            self.i += 1
        elif not abstract:
            raise self.fault("expected a name")
        while True:
            if self.take("["):
                while self.at("static", "const", "restrict"):
                    self.i += 1
                if not self.at("]"):
                    self.expression()
                self.need("]")
            elif self.at("("):
                self.i += 1
                while not self.at(")"):
                    if not self.take("..."):
                        self.specifiers()
                        self.declarator(True)
                    if not self.take(","):
                        break
                    if self.at(")"):
                        raise self.fault("expected a parameter")
                self.need(")")
            else:
                return

    def initializer(self) -> None:
        if not self.take("{"):
            return self.expression()
        self.enter()
        while not self.at("}"):
            while self.at(".", "["):
                if self.take("."):
                    self.name()
                else:
                    self.i += 1
                    self.expression()
                    self.need("]")
            self.take("=")
            self.initializer()
            if not self.take(","):
                break
        self.need("}")
        self.depth -= 1
        return None

    @memo
    def statement(self) -> None:
        k, x = self.k, self.k[self.i]
        if x == "{":
            self.block(self.statement)
        elif x == ";":
            self.i += 1
        elif x in ("if", "while", "switch"):
            self.i += 1
            self.condition()
            self.statement()
            if x == "if" and self.take("else"):
                self.statement()
        elif x == "for":
            self.i += 1
            self.need("(")
            if not self.take(";"):
                if self.k[self.i] in self.TYPE_WORDS or not self.attempt(self.comma_end):
                    self.declaration(False)
            if not self.at(";"):
                self.comma()
            self.need(";")
            if not self.at(")"):
                self.comma()
            self.need(")")
            self.statement()
        elif x == "do":
            self.i += 1
            self.statement()
            self.need("while")
            self.condition()
            self.need(";")
        elif x == "return":
            self.i += 1
            if not self.at(";"):
                self.comma()
            self.need(";")
        elif x in ("break", "continue"):
            self.i += 1
            self.need(";")
        elif x == "goto":
            self.i += 1
            self.take("*")
            self.comma()
            self.need(";")
        elif x == "case":
            self.i += 1
            self.expression()
            if self.take("..."):
                self.expression()
            self.need(":")
            if not self.at("}"):
                self.statement()
        elif x == "default":
            self.i += 1
            self.need(":")
            if not self.at("}"):
                self.statement()
        elif x == "a" and k[self.i + 1] == ":":
            self.i += 2
            if not self.at("}"):
                self.statement()
        elif x in ("asm", "__asm__"):
            self.attributes()
            self.need(";")
        elif x in self.TYPE_WORDS or x in ("_Static_assert", "typeof"):
            self.declaration(False)
        elif not self.attempt(self.comma_end):
            self.declaration(False)
        return None

    def condition(self) -> None:
        self.need("(")
        self.comma()
        self.need(")")

    def comma(self) -> None:
        self.expression()
        while self.take(","):
            self.expression()

    def comma_end(self) -> None:
        self.comma()
        self.need(";")

    def argument(self) -> None:
        if self.k[self.i] in self.TYPE_WORDS:
            self.type_name()
        else:
            self.expression()

    def arguments(self) -> None:
        self.need("(")
        while not self.at(")"):
            self.argument()
            if not self.take(","):
                break
            if self.at(")"):
                raise self.fault("expected an argument")
        self.need(")")

    def type_name(self) -> None:
        self.specifiers()
        self.declarator(True)

    def typed_parens(self) -> None:
        """A cast or a compound literal."""
        self.need("(")
        named = self.at("a")
        self.type_name_in_parens()
        self.need(")")
        if self.at("{"):
            self.initializer()
            return
        if named and not (self.at("a", "0", '"', "(", "~", "!", "sizeof")):
            raise self.fault("expected an operand")
        self.unary()

    def type_name_in_parens(self) -> None:
        if self.at("a"):
            self.i += 1
            while self.at("*", "const", "volatile"):
                self.i += 1
        else:
            self.type_name()

    def unary(self) -> None:
        while self.k[self.i] in ("!", "~", "+", "-", "*", "&", "++", "--", "&&"):
            self.i += 1
        if self.at("sizeof", "_Alignof"):
            self.i += 1
            if self.at("(") and self.attempt(self.sized):
                return None
            return self.unary()
        if self.at("(") and (self.k[self.i + 1] in self.TYPE_WORDS or self.k[self.i + 1] == "a") and self.attempt(self.typed_parens):
            return None
        self.postfix()
        return None

    def sized(self) -> None:
        self.need("(")
        self.type_name_in_parens()
        self.need(")")

    def postfix(self) -> None:
        x = self.k[self.i]
        if x == '"':
            while self.at('"', "a"):
                self.i += 1  # adjacent strings and macros that stand for strings
        elif x in ("a", "0"):
            self.i += 1
        elif x == "(":
            self.i += 1
            if self.at("{"):
                self.block(self.statement)
            else:
                self.comma()
            self.need(")")
        elif x == "_Generic":
            self.i = self.closing(self.i + 1)
        else:
            raise self.fault("expected an expression")
        while True:
            if self.at("("):
                self.arguments()
            elif self.take("["):
                self.comma()
                self.need("]")
            elif self.at(".", "->"):
                self.i += 1
                self.name()
            elif self.at("++", "--"):
                self.i += 1
            else:
                return


class Go(CLike):
    KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
    BINARY = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "|": 4, "^": 4, "*": 5, "/": 5, "%": 5, "<<": 5, ">>": 5, "&": 5, "&^": 5}
    OPAQUE = re.compile(_C_COMMENT + r"|\"(?:[^\"\\\n]|\\.)*+\"|`[^`]*+`|'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}|.))'")
    TOKEN = tokens(":=", "<-", "&^=", "&^")
    ENDS = frozenset(("a", "0", '"', ")", "]", "}", "return", "break", "continue", "fallthrough", "++", "--"))
    LINES = True

    def __init__(self, text: str) -> None:
        super().__init__(text)
        # Semicolons are put where a line ends after a token that may end a statement.
        k, out, origin = self.k, [], []
        for i, x in enumerate(k):
            if (i in self.new_line or not x) and out and out[-1] in self.ENDS:
                out.append(";")
                origin.append(i)
            out.append(x)
            origin.append(i)
        self.k, self.origin, self.new_line = out, origin, set()
        self.marks = [i for i, x in enumerate(out) if x in (";", "{", "}", "")]

    def line_of(self, at: int) -> int:
        return super().line_of(self.origin[min(at, len(self.origin) - 1)])

    def unit(self) -> None:
        self.need("package")
        self.name()
        self.end()
        self.until("", self.top)

    def end(self) -> None:
        if not self.take(";") and not self.at(")", "}", ""):
            raise self.fault("expected a new line")

    @memo
    def top(self) -> None:
        if self.take(";"):
            return None
        if self.take("import"):
            self.group(self.import_spec)
            return self.end()
        if self.at("func"):
            self.function()
            return self.end()
        if self.at("type", "var", "const"):
            self.declaration()
            return self.end()
        raise self.fault("expected a declaration")

    def group(self, rule) -> None:
        if not self.take("("):
            return rule()
        while not self.at(")", ""):
            if self.take(";"):
                continue
            rule()
            if not self.take(";"):
                break
        self.need(")")
        return None

    def import_spec(self) -> None:
        if self.at("a", "."):
            self.i += 1
        self.need('"')

    def declaration(self) -> None:
        word = self.k[self.i]
        self.i += 1
        self.group(self.type_spec if word == "type" else self.value_spec if word == "var" else self.constant_spec)

    def type_spec(self) -> None:
        self.name()
        if self.at("[") and self.k[self.i + 1] == "a" and self.k[self.i + 2] != "]":
            self.attempt(self.type_parameters)
        self.take("=")
        self.type()

    def type_parameters(self) -> None:
        self.need("[")
        while not self.at("]"):
            self.name()
            while self.take(","):
                self.name()
            self.constraint()
            if not self.take(","):
                break
        self.need("]")

    def constraint(self) -> None:
        while True:
            self.take("~")
            self.type()
            if not self.take("|"):
                return

    def value_spec(self) -> None:
        self.names()
        if not self.at("=", ";", ")"):
            self.type()
        if self.take("="):
            self.expressions()

    def constant_spec(self) -> None:
        self.names()
        if not self.at("=", ";", ")"):
            self.type()
        if self.take("="):
            self.expressions()

    def names(self) -> None:
        self.name()
        while self.take(","):
            self.name()

    def expressions(self) -> None:
        self.expression()
        while self.take(","):
            self.expression()

    def function(self) -> None:
        self.need("func")
        self.header()
        if self.at("{"):
            self.block(self.statement)

    @memo
    def header(self) -> None:
        if self.at("("):
            self.parameters()
        self.name()
        if self.at("["):
            self.type_parameters()
        self.signature()

    def signature(self) -> None:
        self.parameters()
        if self.at("("):
            self.parameters()
        elif self.at("a", "*", "[", "map", "chan", "func", "struct", "interface", "<-"):
            self.type()

    def parameters(self) -> None:
        self.need("(")
        while not self.at(")"):
            # "name type", "name, name type" or only types.
            if self.at("a") and self.k[self.i + 1] not in (",", ")", ".", "["):
                self.i += 1
            elif self.at("a") and self.k[self.i + 1] == "[" and self.k[self.i + 2] in ("]", "0"):
                self.i += 1
            self.take("...")
            self.type()
            if self.at("a", "*", "[", "map", "chan", "func", "interface", "struct", "..."):
                self.take("...")
                self.type()
            if not self.take(","):
                break
            self.take(";")
        self.take(";")
        self.need(")")

    def type(self) -> None:
        self.enter()
        x = self.k[self.i]
        if x == "a":
            self.i += 1
            if self.take("."):
                self.name()
            if self.at("[") and self.k[self.i + 1] not in ("]",):
                self.attempt(self.type_arguments)
        elif x == "*":
            self.i += 1
            self.type()
        elif x == "(":
            self.i += 1
            self.type()
            self.need(")")
        elif x == "[":
            self.i += 1
            if not self.at("]"):
                self.take("...") or self.expression()
            self.need("]")
            self.type()
        elif x == "map":
            self.i += 1
            self.need("[")
            self.type()
            self.need("]")
            self.type()
        elif x in ("chan", "<-"):
            self.i += 1
            if x == "<-":
                self.need("chan")
            else:
                self.take("<-")
            self.type()
        elif x == "func":
            self.i += 1
            self.signature()
        elif x == "struct":
            self.i += 1
            self.block(self.field)
        elif x == "interface":
            self.i += 1
            self.block(self.method)
        else:
            raise self.fault("expected a type")
        self.depth -= 1

    def type_arguments(self) -> None:
        self.need("[")
        self.type()
        while self.take(","):
            self.type()
        self.need("]")

    @memo
    def field(self) -> None:
        if self.take(";"):
            return None
        if self.at("*") or (self.at("a") and self.k[self.i + 1] in (";", "}", ".", '"')):
            self.take("*")
            self.type()
        else:
            self.names()
            self.type()
        self.take('"')
        return self.end()

    def method(self) -> None:
        if self.take(";"):
            return None
        if self.at("a") and self.k[self.i + 1] == "(":
            self.i += 1
            self.signature()
        else:
            self.constraint()
        return self.end()

    @memo
    def statement(self) -> None:
        x = self.k[self.i]
        if x == ";":
            self.i += 1
            return None
        if x == "{":
            self.block(self.statement)
        elif x in ("var", "const", "type"):
            self.declaration()
        elif x == "return":
            self.i += 1
            if not self.at(";", "}"):
                self.expressions()
        elif x in ("break", "continue", "goto"):
            self.i += 1
            self.take("a")
        elif x == "fallthrough":
            self.i += 1
        elif x in ("go", "defer"):
            self.i += 1
            self.expression()
        elif x == "if":
            self.branch()
        elif x == "for":
            self.loop()
        elif x == "switch":
            self.switch()
        elif x == "select":
            self.i += 1
            self.cases()
        elif x == "a" and self.k[self.i + 1] == ":":
            self.i += 2
            if not self.at("}"):
                return self.statement()
        else:
            self.simple()
        return self.end()

    @memo
    def simple(self) -> None:
        self.expressions()
        if self.k[self.i] in _ASSIGN or self.at(":=", "&^="):
            self.i += 1
            if self.take("range"):
                return self.expression()
            self.expressions()
        elif self.at("++", "--"):
            self.i += 1
        elif self.take("<-"):
            self.expression()
        return None

    def guarded(self, rule) -> None:
        """``rule`` where a brace opens the body and no composite value."""
        flag, self.no_brace = self.no_brace, True
        rule()
        self.no_brace = flag

    def branch(self) -> None:
        self.need("if")
        if not self.at(";"):
            self.guarded(self.simple)
        if self.take(";"):
            self.guarded(self.simple)
        self.block(self.statement)
        if self.take("else"):
            if self.at("if"):
                self.branch()
            else:
                self.block(self.statement)

    def loop(self) -> None:
        self.need("for")
        if self.take("range"):
            self.guarded(self.expression)
            return self.block(self.statement)
        if not self.at("{"):
            if not self.at(";"):
                self.guarded(self.simple)
            if self.take(";"):
                if not self.at(";"):
                    self.guarded(self.simple)
                self.need(";")
                if not self.at("{"):
                    self.guarded(self.simple)
        self.block(self.statement)
        return None

    def switch(self) -> None:
        self.need("switch")
        if not self.at("{"):
            if not self.at(";"):
                self.guarded(self.simple)
            if self.take(";") and not self.at("{"):
                self.guarded(self.simple)
        self.cases()

    def cases(self) -> None:
        self.need("{")
        self.enter()
        while not self.at("}", ""):
            if self.take("case"):
                self.case_values()
            else:
                self.need("default")
            self.need(":")
            flag, self.no_brace = self.no_brace, False
            while not self.at("case", "default", "}", ""):
                self.statement()
            self.no_brace = flag
        self.need("}")
        self.depth -= 1

    def case_values(self) -> None:
        while True:
            if self.at("[", "map", "chan", "func", "*", "struct", "interface") and self.attempt(self.lone_type):
                pass
            else:
                self.simple()
            if not self.take(","):
                return

    def lone_type(self) -> None:
        self.type()
        if not self.at(",", ":"):
            raise self.fault("expected :")

    @memo
    def expression(self) -> None:
        self.enter()
        self.binary(0)
        self.depth -= 1

    def unary(self) -> None:
        while self.k[self.i] in ("+", "-", "!", "^", "*", "&", "<-"):
            if self.at("<-") and self.k[self.i + 1] == "chan":
                break
            self.i += 1
        self.postfix()

    def inside(self, rule) -> None:
        flag, self.no_brace = self.no_brace, False
        rule()
        self.no_brace = flag

    def postfix(self) -> None:
        x = self.k[self.i]
        composite = False
        if x == "a":
            self.i += 1
            composite = True
        elif x in ("0", '"'):
            self.i += 1
        elif x == "(":
            self.i += 1
            self.inside(self.parenthesised)
            self.need(")")
        elif x == "func":
            self.i += 1
            self.signature()
            if self.at("{"):
                self.block(self.statement)
        elif x in ("[", "map", "chan", "struct", "interface", "<-"):
            self.type()
            if self.at("{"):
                self.composite()
            elif not self.at("(", ")", ",", "."):
                raise self.fault("expected a value")
        else:
            raise self.fault("expected an expression")
        while True:
            if self.take("."):
                if self.take("("):
                    if not self.take("type"):
                        self.type()
                    self.need(")")
                    composite = False
                else:
                    self.name()
            elif self.at("("):
                self.i += 1
                self.inside(self.call)
                composite = False
            elif self.at("["):
                self.i += 1
                self.inside(self.index)
            elif self.at("{") and composite and not self.no_brace:
                self.composite()
                composite = False
            else:
                return

    def parenthesised(self) -> None:
        if not self.attempt(self.closed_expression):
            self.type()

    def closed_expression(self) -> None:
        self.expression()
        if not self.at(")"):
            raise self.fault("expected )")

    def call(self) -> None:
        while not self.at(")"):
            if not self.attempt(self.argument):
                self.type()
            self.take("...")
            if not self.take(","):
                break
            self.take(";")
        self.need(")")

    def argument(self) -> None:
        self.expression()
        if not self.at(",", ")", "..."):
            raise self.fault("expected )")

    def index(self) -> None:
        if not self.at(":"):
            if not self.attempt(self.indexed):
                self.type()
            while self.take(","):
                if self.at("]"):
                    break
                self.type()
        while self.take(":"):
            if not self.at(":", "]"):
                self.expression()
        self.need("]")

    def indexed(self) -> None:
        self.expression()
        if not self.at("]", ":", ","):
            raise self.fault("expected ]")

    def composite(self) -> None:
        flag, self.no_brace = self.no_brace, False
        self.need("{")
        self.enter()
        while not self.at("}"):
            self.element()
            if self.take(":"):
                self.element()
            if not self.take(","):
                break
        self.need("}")
        self.depth -= 1
        self.no_brace = flag

    def element(self) -> None:
        if self.at("{"):
            self.composite()
        else:
            self.expression()


class Rust(CLike):
    KEYWORDS = frozenset(
        """as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type
        unsafe use where while union macro_rules default""".split()
    )
    SOFT = frozenset("union macro_rules default".split())
    BINARY = _C_BINARY | {"..": 0}
    OPAQUE = re.compile(
        r"//[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*+\*/)*+\*/)*+\*/"
        r"|\b(?:br|cr|r)\"[^\"]*+\"|\b(?:br|cr|r)#\"(?:[^\"]|\"(?!#))*+\"#|\b(?:br|cr|r)##\"(?:[^\"]|\"(?!##))*+\"##|\b(?:br|cr|r)(#{3,})\"(?:[^\"]|\"(?!\1))*+\"\1"
        r"|(?:\b[bc])?\"(?:[^\"\\]|\\(?:.|\r?\n))*+\"|\bb?'(?:[^'\\\n]|\\(?:u\{[0-9a-fA-F_]+\}|x[0-9a-fA-F]{2}|.))'|'(?:[^'\\\n]|\\(?:u\{[0-9a-fA-F_]+\}|x[0-9a-fA-F]{2}|.))'"
    )
    TOKEN = re.compile(
        tokens("..=", "..").pattern.replace('""|', r'""|\'[A-Za-z_]\w*|r#[A-Za-z_]\w*|', 1).replace(r"[0-9](?:[\w.]|(?<=[eEpP])[+-])*|\.[0-9]\w*", r"[0-9]\w*(?:\.(?![.\w])|\.[0-9]\w*(?:(?<=[eE])[+-][0-9]+)?)?")
    )

    def unit(self) -> None:
        self.until("", self.item)

    def attributes(self) -> None:
        while self.at("#") and (self.k[self.i + 1] == "[" or self.k[self.i + 1 : self.i + 3] == ["!", "["]):
            self.i = self.closing(self.i + 1 + (self.k[self.i + 1] == "!"))

    def lifetime(self) -> bool:
        if self.k[self.i][:1] == "'":
            self.i += 1
            return True
        return False

    def visibility(self) -> None:
        if self.take("pub") and self.at("(") and self.k[self.i + 1] in ("crate", "super", "self", "in"):
            self.i = self.closing(self.i)

    def item_ahead(self) -> bool:
        k, i = self.k, self.i
        x, y = k[i], k[i + 1]
        if x in ("fn", "struct", "enum", "trait", "mod", "use", "static", "type", "pub", "extern", "impl", "macro_rules"):
            return x != "macro_rules" or y == "!"
        if x == "const":
            return y != "{"
        if x == "unsafe":
            return y in ("fn", "impl", "trait", "extern")
        if x == "async":
            return y == "fn" or (y == "unsafe" and k[i + 2] == "fn")
        return x == "union" and y == "a" and k[i + 2] in ("{", "<")

    @memo
    def item(self) -> None:
        self.attributes()
        if self.at(""):
            return None
        self.visibility()
        while self.at("default", "unsafe", "async", "extern", "const") and self.k[self.i + 1] in ("fn", "unsafe", "async", "extern", "impl", "trait", '"', "const", "type", "{"):
            if self.at("extern"):
                self.i += 1
                self.take('"')
                if self.at("{"):
                    return self.block(self.item)
                continue
            if self.at("const") and self.k[self.i + 1] == "{":
                break
            self.i += 1
        x = self.k[self.i]
        if x == "fn":
            self.function()
        elif x == "use":
            self.i += 1
            self.use_tree()
            self.need(";")
        elif x in ("struct", "union"):
            self.i += 1
            self.name()
            self.generics()
            if self.at("where"):
                self.where()
            if self.at("("):
                self.i += 1
                self.many(self.tuple_field, ")")
                if self.at("where"):
                    self.where()
                return self.need(";")
            if not self.take(";"):
                self.need("{")
                self.many(self.struct_field, "}")
        elif x == "enum":
            self.i += 1
            self.name()
            self.generics()
            if self.at("where"):
                self.where()
            self.need("{")
            self.many(self.variant, "}")
        elif x == "trait":
            self.i += 1
            self.name()
            self.generics()
            if self.take(":"):
                self.bounds()
            if self.at("where"):
                self.where()
            if self.take("="):
                self.bounds()
                return self.need(";")
            self.block(self.item)
        elif x == "impl":
            self.i += 1
            if self.at("<"):
                self.generics()
            self.take("const")
            self.take("!")
            self.type()
            if self.take("for"):
                self.type()
            if self.at("where"):
                self.where()
            self.block(self.item)
        elif x == "mod":
            self.i += 1
            self.name()
            if not self.take(";"):
                self.block(self.item)
        elif x in ("const", "static"):
            self.i += 1
            self.take("mut")
            self.name()
            if self.take(":"):
                self.type()
            if self.take("="):
                self.expression()
            self.need(";")
        elif x == "type":
            self.i += 1
            self.name()
            self.generics()
            if self.take(":"):
                self.bounds()
            if self.at("where"):
                self.where()
            if self.take("="):
                self.type()
            if self.at("where"):
                self.where()
            self.need(";")
        elif x == "extern":
            self.i += 1
            if self.take("crate"):
                self.take("self") or self.name()
                if self.take("as"):
                    self.name()
                return self.need(";")
            self.take('"')
            self.block(self.item)
        elif x in ("a", "macro_rules", "crate", "self", "super", "::"):
            self.path()
            self.need("!")
            self.take("a")
            self.macro_body()
            self.take(";")
        else:
            raise self.fault("expected an item")
        return None

    def macro_body(self) -> bool:
        if not self.at("(", "[", "{"):
            raise self.fault("expected a macro's arguments")
        brace = self.at("{")
        at = self.i
        self.i = self.closing(at)
        pair = {"(": ")", "[": "]", "{": "}"}[self.k[at]]
        if self.k[self.i - 1] != pair:
            raise Fault(at, "a bracket is not closed")
        return brace

    def use_tree(self) -> None:
        self.take("::")
        while True:
            if self.take("*"):
                return
            if self.take("{"):
                return self.many(self.use_tree, "}")
            if not (self.take("a") or self.take("self") or self.take("super") or self.take("crate") or self.take("Self")):
                raise self.fault("expected a path")
            if not self.take("::"):
                break
        if self.take("as"):
            self.name()

    def tuple_field(self) -> None:
        self.attributes()
        self.visibility()
        self.type()

    def struct_field(self) -> None:
        self.attributes()
        self.visibility()
        self.name()
        self.need(":")
        self.type()

    def variant(self) -> None:
        self.attributes()
        self.name()
        if self.take("("):
            self.many(self.tuple_field, ")")
        elif self.take("{"):
            self.many(self.struct_field, "}")
        if self.take("="):
            self.expression()

    def generics(self) -> None:
        if not self.take("<"):
            return
        while not self.at(">"):
            self.attributes()
            if self.lifetime():
                if self.take(":"):
                    self.bounds()
            else:
                const = self.take("const")
                self.name()
                if self.take(":"):
                    self.type() if const else self.bounds()
                if self.take("="):
                    self.generic_argument()
            if not self.take(","):
                break
        self.need(">")

    def where(self) -> None:
        self.need("where")
        while not self.at("{", ";", "="):
            if not self.lifetime():
                if self.take("for"):
                    self.generics()
                self.type()
            self.need(":")
            self.bounds()
            if not self.take(","):
                break

    def bounds(self) -> None:
        while True:
            if not self.lifetime():
                if self.at(",", ">", "{", "=", ";", ")"):
                    return
                while self.at("?", "~", "const"):
                    self.i += 1
                if self.take("("):
                    self.bounds()
                    self.need(")")
                else:
                    self.type(False)
            if not self.take("+"):
                return

    @memo
    def head(self) -> None:
        self.need("fn")
        self.name()
        self.generics()
        self.need("(")
        self.many(self.parameter, ")")
        if self.take("->"):
            self.type()

    def function(self) -> None:
        self.head()
        if self.at("where"):
            self.where()
        if not self.take(";"):
            self.block(self.statement)

    def parameter(self) -> None:
        self.attributes()
        at = self.i
        while self.at("&", "mut") or self.k[self.i][:1] == "'":
            self.i += 1
        if self.take("self"):
            if self.take(":"):
                self.type()
            return
        self.i = at
        if self.take("..."):
            return
        if self.attempt(self.typed_pattern):
            return
        self.type()

    def typed_pattern(self) -> None:
        self.pattern()
        self.need(":")
        self.type()

    def type(self, sums: bool = True) -> None:
        self.enter()
        x = self.k[self.i]
        if x == "&" or x == "&&":
            self.i += 1
            self.lifetime()
            self.take("mut")
            self.type(False)
        elif x == "*":
            self.i += 1
            if not (self.take("const") or self.take("mut")):
                raise self.fault("expected const or mut")
            self.type(False)
        elif x == "(":
            self.i += 1
            self.many(self.type, ")")
        elif x == "[":
            self.i += 1
            self.type()
            if self.take(";"):
                self.expression()
            self.need("]")
        elif x == "!":
            self.i += 1
        elif x in ("dyn", "impl"):
            self.i += 1
            self.bounds()
        elif x in ("fn", "unsafe", "extern", "for"):
            if self.take("for"):
                self.generics()
            while self.at("unsafe", "extern", '"'):
                self.i += 1
            if self.take("fn"):
                self.need("(")
                self.many(self.function_type_parameter, ")")
                if self.take("->"):
                    self.type()
            else:
                self.type()
        elif x == "<":
            self.qualified_self()
        elif self.lifetime():
            pass
        else:
            self.path()
            if self.at("!") and self.k[self.i + 1] in ("(", "[", "{"):
                self.i += 1
                self.macro_body()
        if sums:
            while self.take("+"):
                if not self.lifetime():
                    self.take("?")
                    self.type(False)
        self.depth -= 1

    def function_type_parameter(self) -> None:
        if self.at("a") and self.k[self.i + 1] == ":":
            self.i += 2
        if not self.take("..."):
            self.type()

    def qualified_self(self) -> None:
        self.need("<")
        self.type()
        if self.take("as"):
            self.type()
        self.need(">")
        while self.take("::"):
            self.segment()

    def path(self) -> None:
        self.take("::")
        self.segment()
        while self.at("::") and (self.k[self.i + 1] in ("a", "<", "Self", "self", "super", "crate", *self.SOFT)):
            self.i += 1
            if self.at("<"):
                self.generic_arguments()
            else:
                self.segment()

    def segment(self) -> None:
        if not (self.take("Self") or self.take("self") or self.take("super") or self.take("crate")):
            self.name()
        if self.at("<"):
            self.generic_arguments()
        elif self.at("(") and self.k[self.i - 1] == "a" and self.text and self.closure_trait:
            pass

    closure_trait = False

    def generic_arguments(self) -> None:
        self.need("<")
        self.enter()
        while not self.at(">"):
            self.generic_argument()
            if not self.take(","):
                break
        self.need(">")
        self.depth -= 1
        self.output()

    def output(self) -> None:
        return

    def generic_argument(self) -> None:
        if self.lifetime():
            return
        if self.at("0", '"', "-", "true", "false"):
            self.take("-")
            self.i += 1
        elif self.at("{"):
            self.block(self.statement)
        else:
            if self.at("a") and self.k[self.i + 1] in ("=", ":"):
                self.i += 1
                if self.take(":"):
                    return self.bounds()
                self.i += 1
            self.type()

    # Statements

    def block_like(self) -> bool:
        """Whether the expression here needs no semicolon after it."""
        x = self.k[self.i]
        if x[:1] == "'" and self.k[self.i + 1] == ":":
            return True
        return x in ("if", "match", "loop", "while", "for", "{") or (x in ("unsafe", "async", "const") and self.k[self.i + 1] in ("{", "move"))

    @memo
    def statement(self) -> None:
        self.attributes()
        if self.at("}"):
            return None
        if self.take(";"):
            return None
        if self.take("let"):
            self.pattern()
            if self.take(":"):
                self.type()
            if self.take("="):
                self.expression()
                if self.take("else"):
                    self.block(self.statement)
            return self.need(";")
        if self.item_ahead():
            return self.item()
        if self.block_like():
            self.primary()
            if self.at(".", "?"):
                self.postfix_rest()
                self.binary_rest()
            self.take(";")
            return None
        macro = self.at("a") and self.k[self.i + 1] == "!" and self.k[self.i + 2] == "{"
        self.expression()
        if not self.take(";") and not self.at("}") and not macro:
            raise self.fault("expected ;")
        return None

    def pattern(self) -> None:
        self.enter()
        self.take("|")
        self.single_pattern()
        while self.take("|"):
            self.single_pattern()
        self.depth -= 1

    def single_pattern(self) -> None:
        x = self.k[self.i]
        if x in ("&", "&&"):
            self.i += 1
            self.take("mut")
            return self.single_pattern()
        if x in ("ref", "mut"):
            while self.at("ref", "mut"):
                self.i += 1
            self.name()
            if self.take("@"):
                self.single_pattern()
            return None
        if x == "(":
            self.i += 1
            return self.many(self.pattern, ")")
        if x == "[":
            self.i += 1
            return self.many(self.pattern, "]")
        if x in ("..", "..="):
            self.i += 1
            if self.at("0", "a", '"', "-"):
                self.single_pattern()
            return None
        if x in ("0", '"', "-", "true", "false"):
            self.take("-")
            self.i += 1
        elif x == "<":
            self.qualified_self()
        elif x == "const" and self.k[self.i + 1] == "{":
            self.i += 1
            return self.block(self.statement)
        else:
            self.path()
            if self.take("@"):
                return self.single_pattern()
            if self.at("!"):
                self.i += 1
                self.macro_body()
                return None
            if self.take("("):
                return self.many(self.pattern, ")")
            if self.at("{") and not self.no_brace_pattern():
                self.i += 1
                return self.many(self.field_pattern, "}")
        if self.at("..", "..=", "..."):
            self.i += 1
            if self.at("0", '"', "-", "a"):
                self.take("-")
                if self.at("a"):
                    self.path()
                else:
                    self.i += 1
        return None

    def no_brace_pattern(self) -> bool:
        return False

    def field_pattern(self) -> None:
        self.attributes()
        if self.take(".."):
            return
        while self.at("ref", "mut"):
            self.i += 1
        if not self.take("0"):
            self.name()
        if self.take(":"):
            self.pattern()

    # Expressions

    @memo
    def expression(self) -> None:
        self.enter()
        self.attributes()
        if self.at("..", "..="):
            self.i += 1
            if not self.at(")", "]", "}", ",", ";", "{"):
                self.binary(0)
        else:
            self.binary(0)
        self.binary_rest()
        self.depth -= 1

    def binary_rest(self) -> None:
        """Ranges and assignments, which bind weakest."""
        if self.BINARY.get(self.k[self.i]):
            self.i += 1
            self.binary(0)
        if self.at("..", "..="):
            self.i += 1
            if not (self.at(")", "]", "}", ",", ";", "=>", "") or (self.at("{") and self.no_brace)):
                self.binary(0)
        if self.k[self.i] in _ASSIGN:
            self.i += 1
            self.expression()

    def infix(self, least: int) -> bool:
        if self.at("as"):
            self.i += 1
            self.type(False)
            return True
        return False

    def unary(self) -> None:
        while self.at("-", "!", "*", "&", "&&"):
            amp = self.at("&", "&&")
            self.i += 1
            if amp:
                if self.at("a") and self.k[self.i + 1] in ("const", "mut"):
                    self.i += 1  # &raw
                self.take("mut") or self.take("const")
        self.primary()
        self.postfix_rest()

    def postfix_rest(self) -> None:
        while True:
            if self.take("?"):
                continue
            if self.take("."):
                if self.take("await"):
                    continue
                if self.take("0"):
                    continue
                self.name()
                if self.at("::"):
                    self.i += 1
                    self.generic_arguments()
            elif self.at("("):
                self.i += 1
                self.free(self.call_arguments)
            elif self.at("["):
                self.i += 1
                self.free(self.expression)
                self.need("]")
            else:
                return

    def free(self, rule) -> None:
        flag, self.no_brace = self.no_brace, False
        rule()
        self.no_brace = flag

    def call_arguments(self) -> None:
        self.many(self.expression, ")")

    def head_expression(self) -> None:
        """An expression before a block: a brace opens the block, not a value."""
        flag, self.no_brace = self.no_brace, True
        if self.at("let"):
            self.let_condition()
        else:
            self.expression()
        while self.at("&&") or self.at("||"):
            self.i += 1
            if self.at("let"):
                self.let_condition()
            else:
                self.binary(0)
        self.no_brace = flag

    def let_condition(self) -> None:
        self.need("let")
        self.pattern()
        self.need("=")
        self.binary(2)

    def primary(self) -> None:
        x = self.k[self.i]
        if x[:1] == "'" and self.k[self.i + 1] == ":":
            self.i += 2
            x = self.k[self.i]
        if x in ("0", '"', "true", "false"):
            self.i += 1
        elif x == "(":
            self.i += 1
            self.free(self.call_arguments)
        elif x == "[":
            self.i += 1
            self.free(self.array)
        elif x == "{":
            self.block(self.statement)
        elif x == "if":
            self.i += 1
            self.head_expression()
            self.block(self.statement)
            if self.take("else"):
                if self.at("if"):
                    self.primary()
                else:
                    self.block(self.statement)
        elif x == "while":
            self.i += 1
            self.head_expression()
            self.block(self.statement)
        elif x == "for":
            self.i += 1
            self.pattern()
            self.need("in")
            self.head_expression()
            self.block(self.statement)
        elif x == "loop":
            self.i += 1
            self.block(self.statement)
        elif x == "match":
            self.i += 1
            self.head_expression()
            flag, self.no_brace = self.no_brace, False
            self.need("{")
            self.enter()
            while not self.at("}", ""):
                self.arm()
            self.need("}")
            self.depth -= 1
            self.no_brace = flag
        elif x in ("unsafe", "async", "const") and self.k[self.i + 1] in ("{", "move"):
            self.i += 1
            self.take("move")
            if self.at("|", "||"):
                return self.primary()
            self.block(self.statement)
        elif x in ("|", "||", "move", "static", "async"):
            while self.at("move", "static", "async"):
                self.i += 1
            if not self.take("||"):
                self.need("|")
                while not self.at("|"):
                    self.attributes()
                    self.single_pattern()
                    if self.take(":"):
                        self.type()
                    if not self.take(","):
                        break
                self.need("|")
            if self.take("->"):
                self.type(False)
                self.block(self.statement)
            else:
                self.expression()
        elif x in ("return", "break", "continue"):
            self.i += 1
            if x != "return":
                self.lifetime()
            if x != "continue" and not (self.at(";", "}", ")", "]", ",", "=>", "") or (self.at("{") and self.no_brace)):
                self.expression()
        elif x == "<":
            self.qualified_self()
            self.literal_rest()
        elif x in ("a", "self", "Self", "super", "crate", "::") or x in self.SOFT:
            self.expression_path()
            if self.at("!") and self.k[self.i + 1] in ("(", "[", "{"):
                self.i += 1
                self.macro_body()
                return None
            self.literal_rest()
        else:
            raise self.fault("expected an expression")
        return None

    def expression_path(self) -> None:
        self.take("::")
        while True:
            if not (self.take("Self") or self.take("self") or self.take("super") or self.take("crate")):
                self.name()
            if not self.take("::"):
                return
            if self.at("<"):
                self.generic_arguments()
                if not self.take("::"):
                    return

    def literal_rest(self) -> None:
        """A struct's fields after its name."""
        if self.at("{") and not self.no_brace:
            self.i += 1
            self.enter()
            while not self.at("}"):
                self.attributes()
                if self.take(".."):
                    if not self.at("}"):
                        self.expression()
                    break
                if not self.take("0"):
                    self.name()
                if self.take(":"):
                    self.expression()
                if not self.take(","):
                    break
            self.need("}")
            self.depth -= 1

    def array(self) -> None:
        if self.take("]"):
            return
        self.expression()
        if self.take(";"):
            self.expression()
            return self.need("]")
        if self.take(","):
            return self.many(self.expression, "]")
        self.need("]")

    def arm(self) -> None:
        self.attributes()
        self.pattern()
        if self.take("if"):
            self.head_guard()
        self.need("=>")
        block = self.at("{")
        if block:
            self.block(self.statement)
            if self.at(".", "?"):
                self.postfix_rest()
                self.binary_rest()
        else:
            self.expression()
        if not self.take(",") and not block and not self.at("}"):
            raise self.fault("expected ,")

    def head_guard(self) -> None:
        if self.at("let"):
            self.let_condition()
            while self.take("&&"):
                self.let_condition() if self.at("let") else self.binary(2)
        else:
            self.expression()
