"""JavaScript and TypeScript, with JSX."""

from __future__ import annotations

import re
from collections import defaultdict

from .core import Fault, Parser, memo, tokens

_BINARY = {
    "??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8,
    "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12,
}
_ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_UNARY = frozenset("! ~ + - ++ -- typeof void delete await".split())


class Script(Parser):
    LINES = True
    TYPES = False
    JSX = True
    TOKEN = tokens("===", "!==", "**=", "**", "&&=", "||=", "??=", "??", "?.")
    KEYWORDS = frozenset(
        """break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try
        typeof var void while with null true false async await yield let static get set of from as type interface enum namespace module declare abstract readonly public private protected
        override implements keyof infer is asserts satisfies unique accessor""".split()
    )
    SOFT = frozenset(
        """async await yield let static get set of from as type interface namespace module declare abstract readonly public private protected override implements keyof infer is asserts
        satisfies unique accessor enum""".split()
    )
    OPAQUE = re.compile(
        r"//[^\n]*|/\*(?:[^*]|\*(?!/))*+\*/|\"(?:[^\"\\\n]|\\(?:.|\n))*+\"|'(?:[^'\\\n]|\\(?:.|\n))*+'|`(?:[^`\\$]|\\(?:.|\n)|\$(?!\{)|\$\{(?:[^{}`]|\{[^{}]*\}|`[^`]*`)*\})*+`"
        r"|(?:(?<=[=(,:;!&|?{}\[+\-*%~^<>\n])|(?<=return)|(?<=typeof))[ \t]*/(?![*/ =>])(?:[^\\/\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*(?![\w(])"
    )

    def opaque(self, text: str) -> str:
        if text.startswith("#!"):
            text = "//" + text[2:]
        return super().opaque(text)

    def unit(self) -> None:
        self.until("", self.statement)

    # Statements

    def end(self) -> None:
        """A semicolon, or the end of a line, a block or the text."""
        if self.take(";") or self.at("}", "") or self.i in self.new_line:
            return
        raise self.fault("expected ;")

    @memo
    def statement(self) -> None:
        k, i = self.k, self.i
        x = k[i]
        if x == "{":
            self.block(self.statement)
        elif x == ";":
            self.i += 1
        elif x in ("const", "var") or (x == "let" and k[i + 1] in ("a", "[", "{", *self.SOFT)):
            if x == "const" and k[i + 1] == "enum":
                self.i += 1
                return self.statement()
            self.variables()
            self.end()
        elif x == "function" or (x == "async" and k[i + 1] == "function" and i + 1 not in self.new_line):
            self.function(True)
        elif x == "class" or (x == "abstract" and k[i + 1] == "class"):
            self.i += x == "abstract"
            self.klass(True)
        elif x == "@":
            self.decorators()
            self.statement()
        elif x == "if":
            self.i += 1
            self.condition()
            self.statement()
            if self.take("else"):
                self.statement()
        elif x == "for":
            self.loop()
        elif x == "while" or x == "with":
            self.i += 1
            self.condition()
            self.statement()
        elif x == "do":
            self.i += 1
            self.statement()
            self.need("while")
            self.condition()
            self.take(";")
        elif x == "switch":
            self.i += 1
            self.condition()
            self.need("{")
            while not self.at("}", ""):
                if self.take("case"):
                    self.expression()
                else:
                    self.need("default")
                self.need(":")
                while not self.at("case", "default", "}", ""):
                    self.statement()
            self.need("}")
        elif x == "try":
            self.i += 1
            self.block(self.statement)
            if self.take("catch"):
                if self.take("("):
                    self.binding()
                    if self.TYPES and self.take(":"):
                        self.type()
                    self.need(")")
                self.block(self.statement)
                if self.take("finally"):
                    self.block(self.statement)
            else:
                self.need("finally")
                self.block(self.statement)
        elif x in ("return", "throw"):
            self.i += 1
            if not (self.at(";", "}", "") or self.i in self.new_line):
                self.expression()
            elif x == "throw":
                raise self.fault("expected an expression")
            self.end()
        elif x in ("break", "continue"):
            self.i += 1
            if self.at("a") and self.i not in self.new_line:
                self.i += 1
            self.end()
        elif x == "debugger":
            self.i += 1
            self.end()
        elif x == "import" and k[i + 1] not in ("(", "."):
            self.imports()
        elif x == "export":
            self.exports()
        elif self.TYPES and x in ("interface", "type", "enum", "namespace", "module", "declare") and k[i + 1] in ("a", '"', "const", "let", "var", "function", "class", "abstract", "enum", "global", *self.SOFT) and i + 1 not in self.new_line:
            self.type_declaration()
        elif x == "a" and k[i + 1] == ":":
            self.i += 2
            self.statement()
        else:
            self.expression()
            self.end()
        return None

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    ambient = False

    def variables(self) -> None:
        constant = self.at("const") and not self.ambient
        self.i += 1
        while True:
            self.binding()
            if self.TYPES:
                self.take("!")
                if self.take(":"):
                    self.type()
            if self.take("="):
                self.assignment()
            elif constant:
                raise self.fault("expected =")
            if not self.take(","):
                break

    def loop(self) -> None:
        self.need("for")
        self.take("await")
        self.need("(")
        if not self.at(";"):
            if self.at("const", "var", "let"):
                self.i += 1
                self.binding()
                if self.TYPES and self.take(":"):
                    self.type()
                if self.at("of", "in"):
                    self.i += 1
                    self.expression()
                    self.need(")")
                    return self.statement()
                if self.take("="):
                    self.assignment()
                while self.take(","):
                    self.binding()
                    if self.take("="):
                        self.assignment()
            else:
                self.expression(False)
                if self.at("of", "in"):
                    self.i += 1
                    self.expression()
                    self.need(")")
                    return self.statement()
        self.need(";")
        if not self.at(";"):
            self.expression()
        self.need(";")
        if not self.at(")"):
            self.expression()
        self.need(")")
        self.statement()

    def binding(self) -> None:
        if self.take("["):
            while not self.at("]"):
                if self.take(","):
                    continue
                self.take("...")
                self.binding()
                if self.take("="):
                    self.assignment()
                if not self.take(","):
                    break
            self.need("]")
        elif self.take("{"):
            self.many(self.property_binding, "}")
        elif self.at("this") and self.TYPES:
            self.i += 1
        else:
            self.name()

    def property_binding(self) -> None:
        if self.take("..."):
            return self.binding()
        self.key()
        if self.take(":"):
            self.binding()
        if self.take("="):
            self.assignment()

    def key(self) -> None:
        if self.take("["):
            self.assignment()
            self.need("]")
        elif self.take("#"):
            self.name()
        elif self.at("a", "0", '"') or self.k[self.i] in self.KEYWORDS:
            self.i += 1
        else:
            raise self.fault("expected a property name")

    @memo
    def signature(self) -> None:
        """Type parameters, parameters and the result's type."""
        if self.TYPES and self.at("<"):
            self.type_parameters()
        self.need("(")
        self.many(self.parameter, ")")
        if self.TYPES and self.take(":"):
            self.result_type()

    def parameter(self) -> None:
        while self.at("@"):
            self.decorators()
        self.take("...")
        if self.TYPES:
            while self.k[self.i] in ("public", "private", "protected", "readonly", "override") and self.k[self.i + 1] in ("a", *self.SOFT):
                self.i += 1
        self.binding()
        if self.TYPES:
            self.take("?")
            if self.take(":"):
                self.type()
        if self.take("="):
            self.assignment()

    def function(self, named: bool) -> None:
        self.take("async")
        self.need("function")
        self.take("*")
        if named or self.at("a") or self.k[self.i] in self.SOFT:
            if not self.at("("):
                self.name()
        self.signature()
        if self.at("{"):
            self.block(self.statement)
        elif self.TYPES:
            self.end()  # an overload
        else:
            raise self.fault("expected {")

    def decorators(self) -> None:
        while self.take("@"):
            if self.take("("):
                self.expression()
                self.need(")")
            else:
                self.name()
                while self.take("."):
                    self.name()
                if self.at("("):
                    self.arguments()

    def klass(self, named: bool) -> None:
        self.need("class")
        if not self.at("{", "extends", "implements"):
            self.name()
        if self.TYPES and self.at("<"):
            self.type_parameters()
        if self.take("extends"):
            self.unary()
            if self.TYPES and self.at("<"):
                self.type_arguments()
        if self.TYPES and self.take("implements"):
            self.type()
            while self.take(","):
                self.type()
        self.block(self.member)

    def member(self) -> None:
        if self.take(";"):
            return
        self.decorators()
        k = self.k
        if k[self.i] == "static" and k[self.i + 1] == "{":
            self.i += 1
            return self.block(self.statement)
        while k[self.i] in ("static", "async", "get", "set", "public", "private", "protected", "readonly", "abstract", "override", "declare", "accessor") and k[self.i + 1] not in ("(", "=", ";", ":", "}", "?", "!", ",", "<"):
            self.i += 1
        self.take("*")
        if self.TYPES and k[self.i] == "[" and k[self.i + 1] == "a" and k[self.i + 2] == ":":
            self.i += 3  # an index signature
            self.type()
            self.need("]")
            self.need(":")
            self.type()
            return self.end()
        self.key()
        if self.TYPES and self.at("?", "!"):
            self.i += 1
        if self.at("(", "<"):
            self.signature()
            if self.at("{"):
                return self.block(self.statement)
            if self.TYPES:
                return self.end()
            raise self.fault("expected {")
        if self.TYPES and self.take(":"):
            self.type()
        if self.take("="):
            self.assignment()
        self.end()

    def imports(self) -> None:
        self.need("import")
        if self.TYPES and self.at("type") and self.k[self.i + 1] not in ("from", ",", "="):
            self.i += 1
        if not self.take('"'):
            if self.at("a") or self.k[self.i] in self.SOFT:
                self.i += 1
                if self.TYPES and self.take("="):
                    self.expression()
                    return self.end()
                if self.take(","):
                    self.import_names()
            else:
                self.import_names()
            self.need("from")
            self.need('"')
        if self.at("with", "a") and self.i not in self.new_line and self.k[self.i + 1] == "{":
            self.i = self.closing(self.i + 1)
        self.end()

    def import_names(self) -> None:
        if self.take("*"):
            self.need("as")
            return self.name()
        self.need("{")
        self.many(self.import_name, "}")

    def import_name(self) -> None:
        if self.TYPES and self.at("type") and self.k[self.i + 1] not in (",", "}", "as"):
            self.i += 1
        self.key()
        if self.take("as"):
            self.key()

    def exports(self) -> None:
        self.need("export")
        if self.take("default"):
            if self.at("function", "class", "abstract") or (self.at("async") and self.k[self.i + 1] == "function"):
                self.take("abstract")
                return self.klass(False) if self.at("class") else self.function(False)
            if self.TYPES and self.at("interface"):
                return self.type_declaration()
            self.assignment()
            return self.end()
        if self.TYPES and self.at("type") and self.k[self.i + 1] in ("{", "*"):
            self.i += 1
        if self.take("*"):
            if self.take("as"):
                self.key()
            self.need("from")
            self.need('"')
            return self.end()
        if self.take("{"):
            self.many(self.import_name, "}")
            if self.take("from"):
                self.need('"')
            return self.end()
        if self.TYPES and (self.take("=") or (self.at("as") and self.k[self.i + 1] == "namespace")):
            self.expression()
            return self.end()
        if not (self.at("const", "var", "let", "function", "class", "async", "@", "import") or (self.TYPES and self.at("interface", "type", "enum", "namespace", "module", "declare", "abstract"))):
            raise self.fault("expected a declaration")
        self.statement()

    # Expressions

    @memo
    def expression(self, with_in: bool = True) -> None:
        self.assignment(with_in)
        while self.take(","):
            self.assignment(with_in)

    @memo
    def assignment(self, with_in: bool = True) -> None:
        self.enter()
        k, i = self.k, self.i
        if self.arrow_ahead():
            self.arrow()
        elif k[i] == "yield" and k[i + 1] not in ("=", "=>", ".", "(", "["):
            self.i += 1
            self.take("*")
            if not self.at(")", "]", "}", ",", ";", ":", "") and self.i not in self.new_line:
                self.assignment(with_in)
        else:
            self.binary(0, with_in)
            if self.take("?"):
                self.assignment()
                self.need(":")
                self.assignment(with_in)
            elif k[self.i] in _ASSIGN:
                self.i += 1
                self.assignment(with_in)
        self.depth -= 1

    def arrow_ahead(self) -> bool:
        k, i = self.k, self.i
        if k[i] == "async" and k[i + 1] in ("a", "(", "<") and i + 1 not in self.new_line:
            i += 1
        if (k[i] == "a" or k[i] in self.SOFT) and k[i + 1] == "=>":
            return True
        if self.TYPES and k[i] == "<":
            depth = 0
            while k[i] and k[i] not in (";", "{", "}"):
                depth += (k[i] == "<") - (k[i] == ">")
                i += 1
                if depth == 0:
                    break
            if k[i] != "(":
                return False
        if k[i] != "(":
            return False
        j = self.closing(i)
        if k[j] == "=>":
            return True
        if self.TYPES and k[j] == ":":
            # A result type between the parameters and the arrow; tried as one, as a conditional may look alike.
            at, depth = self.i, self.depth
            try:
                self.i = i
                self.need("(")
                self.many(self.parameter, ")")
                self.need(":")
                self.result_type()
                return self.at("=>")
            except Fault:
                return False
            finally:
                self.i, self.depth = at, depth
        return False

    def arrow(self) -> None:
        self.take("async")
        if self.at("(", "<"):
            self.signature()
        else:
            self.name()
        self.need("=>")
        if self.at("{"):
            self.block(self.statement)
        else:
            self.assignment()

    def binary(self, least: int, with_in: bool = True) -> None:
        """Precedence climbing."""
        self.unary()
        while True:
            op = self.k[self.i]
            if op == ">" and self.k[self.i + 1] == ">":
                width = 2
                while self.k[self.i + width] == ">":
                    width += 1
                power = 9
            else:
                power, width = _BINARY.get(op, 0), 1
                if self.TYPES and op in ("as", "satisfies") and self.i not in self.new_line:
                    self.i += 1
                    if not self.take("const"):
                        self.type()
                    continue
            if not power or power <= least or (op == "in" and not with_in):
                return
            self.i += width
            self.binary(power if op != "**" else power - 1, with_in)

    def unary(self) -> None:
        while self.k[self.i] in _UNARY:
            if self.at("await") and self.k[self.i + 1] in (")", ",", ";", "=", "."):
                break
            self.i += 1
        if self.TYPES and self.at("<") and not self.JSX:
            self.type_arguments()  # a cast
            return self.unary()
        self.postfix()

    def postfix(self) -> None:
        self.primary()
        while True:
            x = self.k[self.i]
            if x == ".":
                self.i += 1
                self.take("#")
                if not (self.at("a") or self.k[self.i] in self.KEYWORDS):
                    raise self.fault("expected a property")
                self.i += 1
            elif x == "?.":
                self.i += 1
                if self.at("("):
                    self.arguments()
                elif self.take("["):
                    self.expression()
                    self.need("]")
                else:
                    self.key()
            elif x == "(":
                self.arguments()
            elif x == "[":
                self.i += 1
                self.expression()
                self.need("]")
            elif x == '"' and self.k[self.i - 1] in ("a", ")", "]"):
                self.i += 1  # a tagged template
            elif x in ("++", "--") and self.i not in self.new_line:
                self.i += 1
            elif x == "!" and self.TYPES and self.i not in self.new_line and self.k[self.i + 1] != "=":
                self.i += 1
            elif x == "<" and self.TYPES and self.call_types():
                continue
            else:
                return

    def call_types(self) -> bool:
        """Type arguments before a call."""
        at, depth = self.i, self.depth
        try:
            self.type_arguments()
            if self.at("(", '"'):
                return True
        except Fault:
            pass
        self.i, self.depth = at, depth
        return False

    def arguments(self) -> None:
        self.need("(")
        self.many(self.argument, ")")

    def argument(self) -> None:
        self.take("...")
        self.assignment()

    def primary(self) -> None:
        x = self.k[self.i]
        if x in ("a", "0", '"', "this", "super", "null", "true", "false"):
            self.i += 1
        elif x == "(":
            self.i += 1
            self.expression()
            self.need(")")
        elif x == "[":
            self.i += 1
            while not self.at("]"):
                if self.take(","):
                    continue
                self.argument()
                if not self.take(","):
                    break
            self.need("]")
        elif x == "{":
            self.enter()
            self.i += 1
            self.many(self.property, "}")
            self.depth -= 1
        elif x == "function" or (x == "async" and self.k[self.i + 1] == "function"):
            self.function(False)
        elif x == "class":
            self.klass(False)
        elif x == "@":
            self.decorators()
            self.klass(False)
        elif x == "new":
            self.i += 1
            if self.take("."):
                return self.name()
            self.unary() if self.at("new") else self.primary()
            while self.take("."):
                self.key()
            if self.TYPES and self.at("<"):
                self.call_types()
        elif x == "import":
            self.i += 1
            if not self.at("(", "."):
                raise self.fault("expected (")
        elif x == "#" and self.k[self.i + 1] == "a":
            self.i += 2
        elif x == "<" and self.JSX:
            self.element()
        elif x in self.SOFT:
            self.i += 1
        else:
            raise self.fault("expected an expression")

    def property(self) -> None:
        if self.take("..."):
            return self.assignment()
        k = self.k
        while k[self.i] in ("async", "get", "set") and k[self.i + 1] not in (",", "}", ":", "(", "="):
            self.i += 1
        self.take("*")
        shorthand = self.at("a") or k[self.i] in self.SOFT
        self.key()
        if self.at("(", "<"):
            self.signature()
            self.block(self.statement)
        elif self.take(":"):
            self.assignment()
        elif self.take("="):
            self.assignment()  # a default, as in a pattern
        elif not shorthand:
            raise self.fault("expected :")

    def element(self) -> None:
        """JSX: attributes are parsed, text between tags is anything."""
        self.need("<")
        if not self.at(">"):
            self.key()
            while self.at(".", ":", "-"):
                self.i += 1
                self.key()
            while not self.at(">", "/"):
                if self.take("{"):
                    self.take("...")
                    self.expression()
                    self.need("}")
                    continue
                self.key()
                while self.at("-", ":"):
                    self.i += 1
                    self.key()
                if self.take("="):
                    if self.take("{"):
                        self.expression()
                        self.need("}")
                    elif not self.take('"'):
                        self.element()
            if self.take("/"):
                return self.need(">")
        self.need(">")
        while not (self.at("<") and self.k[self.i + 1] == "/"):
            if self.at(""):
                raise self.fault("an element is not closed")
            if self.at("<"):
                self.element()
            elif self.take("{"):
                if not self.at("}"):
                    self.take("...")
                    self.expression()
                self.need("}")
            else:
                self.i += 1
        self.i += 2
        while not self.take(">"):
            if self.at(""):
                raise self.fault("an element is not closed")
            self.i += 1

    # Types

    def type_declaration(self) -> None:
        if self.at("declare") and not self.ambient:
            # Declarations without values: remembered apart from those that need one.
            memory, self.memory, self.ambient = self.memory, defaultdict(dict), True
            try:
                return self.type_declaration()
            finally:
                self.memory, self.ambient = memory, False
        if self.take("declare"):
            if self.at("a", "module", "namespace") and self.k[self.i + 1] in ("{", '"', "a"):
                self.i += 1
                if self.at('"', "a"):
                    self.i += 1
                return self.block(self.statement) if self.at("{") else self.end()
            return self.statement()
        if self.take("interface"):
            self.name()
            if self.at("<"):
                self.type_parameters()
            if self.take("extends"):
                self.type()
                while self.take(","):
                    self.type()
            return self.object_type()
        if self.take("type"):
            self.name()
            if self.at("<"):
                self.type_parameters()
            self.need("=")
            self.type()
            return self.end()
        if self.take("enum"):
            self.name()
            self.need("{")
            return self.many(self.enum_member, "}")
        self.i += 1  # namespace, module
        self.take('"') or self.name()
        while self.take("."):
            self.name()
        self.block(self.statement)

    def enum_member(self) -> None:
        self.key()
        if self.take("="):
            self.assignment()

    def type_parameters(self) -> None:
        self.need("<")
        while not self.at(">"):
            while self.at("const", "in"):
                self.i += 1
            self.name()
            if self.take("extends"):
                self.type()
            if self.take("="):
                self.type()
            if not self.take(","):
                break
        self.need(">")

    def type_arguments(self) -> None:
        self.need("<")
        self.type()
        while self.take(","):
            self.type()
        self.need(">")

    def result_type(self) -> None:
        if self.at("asserts") and self.k[self.i + 1] in ("a", "this") and self.i + 1 not in self.new_line:
            self.i += 2
            if self.take("is"):
                self.type()
            return
        if self.k[self.i] in ("a", "this") and self.k[self.i + 1] == "is":
            self.i += 2
        self.type()

    def type(self) -> None:
        self.enter()
        if self.at("|", "&"):
            self.i += 1
        self.type_operand()
        while self.at("|", "&"):
            self.i += 1
            self.type_operand()
        if self.at("extends") and self.i not in self.new_line:
            self.i += 1
            self.type()
            self.need("?")
            self.type()
            self.need(":")
            self.type()
        self.depth -= 1

    def type_operand(self) -> None:
        while self.k[self.i] in ("keyof", "readonly", "unique", "infer", "typeof", "abstract") and self.k[self.i + 1] not in (",", ")", ">", ";", "=", "|", "&", "}"):
            self.i += 1
        x = self.k[self.i]
        if x == "new" or (x in ("(", "<") and self.function_type_ahead()):
            self.take("new")
            if self.at("<"):
                self.type_parameters()
            self.need("(")
            self.many(self.parameter, ")")
            self.need("=>")
            return self.result_type()
        if x == "(":
            self.i += 1
            self.type()
            self.need(")")
        elif x == "{":
            self.object_type()
        elif x == "[":
            self.i += 1
            self.many(self.tuple_member, "]")
        elif x == "-" and self.k[self.i + 1] == "0":
            self.i += 2
        elif x in ("a", "0", '"', "this", "null", "true", "false", "void", "import") or x in self.SOFT:
            self.i += 1
            if x == "import":
                self.arguments()
            while self.take("."):
                self.key()
            if self.at("<"):
                self.type_arguments()
        else:
            raise self.fault("expected a type")
        while self.at("[") and self.i not in self.new_line:
            self.i += 1
            if not self.at("]"):
                self.type()
            self.need("]")

    def function_type_ahead(self) -> bool:
        k, i = self.k, self.i
        if k[i] == "<":
            return True
        return k[self.closing(i)] == "=>"

    def tuple_member(self) -> None:
        self.take("...")
        if (self.at("a") or self.k[self.i] in self.SOFT) and self.k[self.i + 1] in (":", "?") and (self.k[self.i + 1] == ":" or self.k[self.i + 2] == ":"):
            self.i += 1
            self.take("?")
            self.need(":")
        self.type()
        self.take("?")

    def object_type(self) -> None:
        self.need("{")
        while not self.at("}", ""):
            while self.at("+", "-", "readonly", "get", "set") and self.k[self.i + 1] not in (":", "?", "(", ";", ","):
                self.i += 1
            if self.at("(", "<"):
                self.signature()
            elif self.at("new") and self.k[self.i + 1] in ("(", "<"):
                self.i += 1
                self.signature()
            else:
                if self.take("["):
                    if self.at("a") and self.k[self.i + 1] in (":", "in"):
                        self.i += 2
                        self.type()
                        if self.take("as"):
                            self.type()
                    else:
                        self.expression()
                    self.need("]")
                else:
                    self.key()
                while self.at("?", "+", "-"):
                    self.i += 1
                if self.at("(", "<"):
                    self.signature()
                elif self.take(":"):
                    self.type()
            if not (self.take(";") or self.take(",") or self.at("}") or self.i in self.new_line):
                raise self.fault("expected ;")
        self.need("}")


class TypeScript(Script):
    TYPES, JSX = True, False


class TypeScriptJsx(Script):
    TYPES, JSX = True, True
