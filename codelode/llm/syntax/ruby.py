"""Ruby."""

from __future__ import annotations

import re

from .core import Fault, Kinds, Parser

_HEREDOC = re.compile(r"<<[~-]?(?P<q>[\"'`]?)(?P<tag>[A-Z_]\w*)(?P=q)")
_OPERATORS = "<=> === **= ||= &&= <<= >>= ... ** == != >= <= =~ !~ && || => -> :: &. << >> += -= *= /= %= |= &= ^= ..".split()


class _RubyKinds(Kinds):
    def __missing__(self, token: str) -> str:
        if len(token) > 1 and token.endswith(":") and not token.startswith(":"):
            return self.setdefault(token, "label")
        if len(token) > 1 and token[0] == "@":
            return self.setdefault(token, "a")
        if token[-1] in "?!" and token[0].isalpha():
            return self.setdefault(token, "a")
        return super().__missing__(token)


class Ruby(Parser):
    """Statements up to ``end``; a name that an expression follows on its line is a call without brackets."""

    LINES = True
    KEYWORDS = frozenset("alias and begin BEGIN break case class def defined? do else elsif end END ensure false for if in module next nil not or redo rescue retry return self super then true undef unless until when while yield".split())
    OPAQUE = re.compile(
        r"^=begin\b(?:.*\n)*?=end\b.*|^__END__\n(?:.*\n?)*|\"(?:[^\"\\#]|\\.|#\{(?:[^{}]|\{[^{}]*\})*+\}|#)*+\"|'(?:[^'\\]|\\.)*+'|`[^`]*`|(?<![\w$@:])#[^\n]*|(?<=[\w$@:])#(?!\{)[^\n]*"
        r"|%[wWiIqQr]?(?:\((?:[^()\\]|\\.|\([^()]*\))*+\)|\[(?:[^\[\]\\]|\\.|\[[^\[\]]*\])*+\]|\{(?:[^{}\\]|\\.|\{[^{}]*\})*+\}|<[^<>]*>|\|[^|\n]*\||![^!\n]*!)[a-z]*"
        r"|(?:(?<=[=(,\[{|&!~:;])[ \t]*|(?<=\bif)[ \t]+|(?<=\bwhen)[ \t]+|(?<=\bunless)[ \t]+|(?<=\band)[ \t]+|(?<=\bor)[ \t]+|(?<=\breturn)[ \t]+|(?<=\w)[ \t]+(?=/[^\s=])|^[ \t]*)/(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*"
        r"|(?<![\w:)\]}?]):(?:[^\W\d]\w*[?!=]?(?![\w:])|\"(?:[^\"\\]|\\.)*+\"|\[\]=?|[+\-*/<>=!~%&|^]+(?=[\s,)\]]))|(?<=[\s(,\[=])\?[A-Za-z](?!\w)",
        re.M,
    )
    TOKEN = re.compile(r'""|\n|@{0,2}[^\W\d]\w*[?!]?(?::(?![:\w]))?|\$(?:[\w$]+|[!@&~0-9/\;,.<>_:"+*`\'?])|[0-9](?:[\w]|\.(?=[0-9]))*|' + "|".join(map(re.escape, _OPERATORS)) + r"|[^\s]")
    BINARY = {
        "**": 16, "*": 14, "/": 14, "%": 14, "+": 13, "-": 13, "<<": 12, ">>": 12, "&": 11, "|": 10, "^": 10, "<": 9, ">": 9, "<=": 9, ">=": 9, "<=>": 8, "==": 8, "===": 8, "!=": 8, "=~": 8, "!~": 8, "&&": 7, "||": 6, "..": 5, "...": 5,
    }
    ASSIGN = frozenset("= += -= *= /= %= **= ||= &&= |= &= ^= <<= >>=".split())
    MODIFIERS = frozenset("if unless while until rescue".split())
    #: What begins an argument of a call without brackets.
    START = frozenset(("a", '"', "0", "label", "nil", "true", "false", "self", "->", "def", "defined?", "not", "!", "super", "yield", "::", "case", "~"))
    #: Operators at a line's end go on with the next line; these do at a line's beginning.
    LEADING = frozenset((".", "&."))

    def __init__(self, text: str) -> None:
        Parser.kind_tables.setdefault(type(self), _RubyKinds(self.KEYWORDS))
        super().__init__(text)
        self.no_do = False

    def opaque(self, text: str) -> str:
        out, lines, i = [], text.split("\n"), 0
        while i < len(lines):
            line = lines[i]
            i += 1
            for m in _HEREDOC.finditer(line) if "<<" in line and not line.lstrip().startswith("#") else ():
                end = next((j for j in range(i, len(lines)) if lines[j].strip() == m["tag"]), None)
                if end is not None:
                    i = end + 1
            out.append(_HEREDOC.sub('""', line) if "<<" in line else line)
        return super().opaque("\n".join(out))

    @staticmethod
    def replaced(m: re.Match) -> str:
        s = m[0]
        if s.startswith(("#", "=begin", "__END__")):
            return ""
        return s[: len(s) - len(s.lstrip())] + '""'

    def fresh(self) -> bool:
        return self.i in self.new_line

    def unit(self) -> None:
        self.statements()

    def statements(self, *ends: str) -> None:
        while not self.at(*ends, ""):
            if self.take(";"):
                continue
            start, depth, flag = self.i, self.depth, self.no_do
            try:
                self.statement()
                if not (self.take(";") or self.fresh() or self.at(*ends, "")):
                    raise self.fault("expected the end of a statement")
            except Fault as fault:
                self.depth, self.no_do = depth, flag
                self.errors.append((fault.at, fault.message))
                self.i = max(fault.at, start + 1)
                while self.k[self.i] and not self.fresh():
                    self.i += 1
        self.no_do = False

    def statement(self) -> None:
        self.enter()
        if self.at("alias", "undef"):
            self.i += 1
            while self.k[self.i] and not self.fresh():
                self.i += 1
        elif self.at("BEGIN", "END"):
            self.i += 1
            self.need("{")
            self.statements("}")
            self.need("}")
        else:
            self.sentence()
            while self.k[self.i] in self.MODIFIERS and not self.fresh():
                self.i += 1
                self.sentence()
        self.depth -= 1

    def sentence(self) -> None:
        """Expressions joined by and, or; several values on either side of an assignment."""
        while True:
            while self.at("not", "!"):
                self.i += 1
            self.listed()
            if self.fresh() or not self.at("and", "or"):
                return
            self.i += 1

    def listed(self) -> None:
        self.splat()
        while self.at(",") and not self.fresh():
            self.i += 1
            if self.at("=", "|"):
                break
            self.splat()
        if self.k[self.i] in self.ASSIGN and not self.fresh():
            self.i += 1
            self.listed()
            return
        if self.at("=>", "in") and not self.fresh() and not self.no_do:
            self.i += 1
            self.pattern()

    def splat(self) -> None:
        if self.at("*", "&", "**"):
            self.i += 1
            if self.at(",", ")", "=", "]", "|"):
                return
        self.expression()

    def expression(self) -> None:
        self.enter()
        self.binary(0)
        if self.at("?") and not self.fresh():
            self.i += 1
            if self.at("label"):
                self.i += 1  # the last token of the first branch has the colon
            else:
                self.expression()
                if not self.take(":"):
                    if not (self.k[self.i - 1] == "label"):
                        self.need(":")
            self.expression()
        if self.k[self.i] in self.ASSIGN and not self.fresh():
            self.i += 1
            self.expression() if not self.at("*", "[") else self.splat()
            if self.at("rescue") and not self.fresh():
                self.i += 1
                self.expression()
        self.depth -= 1

    def binary(self, least: int) -> None:
        self.unary()
        while True:
            op = self.k[self.i]
            power = self.BINARY.get(op, 0)
            if not power or power <= least or self.fresh():
                return
            self.i += 1
            if op in ("..", "...") and (self.fresh() or self.at(")", "]", "then", "")):
                return  # an endless range
            self.binary(power)

    def unary(self) -> None:
        while self.at("!", "-", "+", "~", "&", "not", "..", "...", "*", "**"):
            self.i += 1
        if self.take("defined?"):
            return self.unary()
        self.primary()
        self.postfix()
        return None

    def postfix(self) -> None:
        while True:
            x = self.k[self.i]
            if self.fresh() and x not in self.LEADING:
                return
            if x in (".", "&."):
                self.i += 1
                if self.at("("):
                    self.arguments(")")
                    continue
                if not self.k[self.i] or self.k[self.i] in (")", "]", "}", ";", ","):
                    raise self.fault("expected a name")
                label = self.at("label")
                self.i += 1
                if label:
                    return
                self.called()
            elif x == "::":
                self.i += 1
                if not (self.at("a") or self.k[self.i].isalpha()):
                    raise self.fault("expected a name")
                self.i += 1
                self.called()
            elif x == "[":
                self.i += 1
                self.elements("]")
            elif x == "{" and self.k[self.i - 1] in ("a", ")", "super", "yield", "]"):
                self.brace_block()
            elif x == "do" and not self.no_do:
                self.do_block()
            else:
                return

    def called(self) -> None:
        """Arguments after a method's name, with or without brackets."""
        if self.fresh():
            return
        if self.at("("):
            self.arguments(")")
        elif self.k[self.i] in self.START and not (self.at("!") and self.k[self.i + 1] in ("=", "~")):
            self.command()

    def command(self) -> None:
        while True:
            self.element()
            if not (self.at(",") and not self.fresh()):
                return
            self.i += 1

    def arguments(self, close: str) -> None:
        self.i += 1
        flag, self.no_do = self.no_do, False
        self.elements(close)
        self.no_do = flag

    def elements(self, close: str) -> None:
        flag, self.no_do = self.no_do, False
        while not self.at(close):
            self.element()
            while self.k[self.i] in self.MODIFIERS and not self.at(close):
                self.i += 1
                self.sentence()
            if not self.take(","):
                break
        if self.at(";"):
            self.i += 1
            self.statements(close)
        self.need(close)
        self.no_do = flag

    def element(self) -> None:
        if self.at("label"):
            self.i += 1
            if not self.at(",", ")", "]", "}") and not (self.fresh() and self.at("label")):
                self.expression()
            return
        if self.at("*", "**", "&") and self.k[self.i + 1] in (",", ")", "]", "|"):
            self.i += 1
            return
        if self.at("..."):
            self.i += 1
            return
        self.splat()
        if self.at("and", "or"):
            self.i += 1
            self.sentence()
        if self.take("=>"):
            self.expression()
        elif self.k[self.i - 1] == '"' and self.take(":"):
            self.expression()

    def block_parameters(self) -> None:
        if self.take("||"):
            return
        if self.take("|"):
            while not self.at("|", ""):
                if self.at("(", "["):
                    self.i = self.closing(self.i)
                elif self.at("label") or (self.at("a") and self.k[self.i + 1] == "="):
                    self.i += 1 if self.at("label") else 2
                    if not self.at(",", "|"):
                        self.binary(10)
                else:
                    self.i += 1
            self.need("|")

    def brace_block(self) -> None:
        self.need("{")
        flag, self.no_do = self.no_do, False
        self.block_parameters()
        self.statements("}")
        self.need("}")
        self.no_do = flag

    def do_block(self) -> None:
        self.i += 1
        flag, self.no_do = self.no_do, False
        self.block_parameters()
        self.body()
        self.no_do = flag

    def body(self) -> None:
        """Statements, handlers, and end."""
        self.statements("rescue", "else", "ensure", "end")
        while self.take("rescue"):
            while not self.at("then", ";", "") and not self.fresh():
                self.splat()
                if not (self.take(",") or self.take("=>")):
                    break
            self.take("then")
            self.statements("rescue", "else", "ensure", "end")
        if self.take("else"):
            self.statements("ensure", "end")
        if self.take("ensure"):
            self.statements("end")
        self.close()

    def close(self) -> None:
        if not self.take("end"):
            raise self.fault("expected end")

    def condition(self, *words: str) -> None:
        flag, self.no_do = self.no_do, True
        self.statement()
        self.no_do = flag
        for w in words:
            self.take(w)

    def primary(self) -> None:
        x = self.k[self.i]
        self.enter()
        if x in ("0", "nil", "true", "false", "self", "redo", "retry"):
            self.i += 1
        elif x == '"':
            while self.take('"') and not self.fresh():
                pass
        elif x == "(":
            self.i += 1
            flag, self.no_do = self.no_do, False
            self.statements(")")
            self.need(")")
            self.no_do = flag
        elif x == "[":
            self.i += 1
            self.elements("]")
        elif x == "{":
            self.i += 1
            self.elements("}")
        elif x == "->":
            self.i += 1
            if self.at("("):
                self.i = self.closing(self.i)
            else:
                while not self.at("{", "do", "") and not self.fresh():
                    self.i += 1
            self.brace_block() if self.at("{") else self.do_block() if self.at("do") else self.need("{")
        elif x == "::":
            self.i += 1
            self.primary()
        elif x in ("if", "unless"):
            self.i += 1
            self.condition("then")
            self.statements("elsif", "else", "end")
            while self.take("elsif"):
                self.condition("then")
                self.statements("elsif", "else", "end")
            if self.take("else"):
                self.statements("end")
            self.close()
        elif x in ("while", "until"):
            self.i += 1
            self.condition("do")
            self.statements("end")
            self.close()
        elif x == "for":
            self.i += 1
            while not self.at("in", "") and not self.fresh():
                self.i += 1
            if not self.take("in"):
                raise self.fault("expected in")
            self.condition("do")
            self.statements("end")
            self.close()
        elif x == "case":
            self.case()
        elif x == "begin":
            self.i += 1
            flag, self.no_do = self.no_do, False
            self.body()
            self.no_do = flag
        elif x == "def":
            self.definition()
        elif x in ("class", "module"):
            self.i += 1
            if x == "class" and self.take("<<"):
                self.expression()
            else:
                self.take("::")
                if not self.at("a"):
                    raise self.fault("expected a name")
                self.i += 1
                while self.take("::"):
                    self.i += 1
                if x == "class" and self.take("<"):
                    self.expression()
            flag, self.no_do = self.no_do, False
            self.body()
            self.no_do = flag
        elif x in ("return", "break", "next", "yield", "super"):
            self.i += 1
            if self.at("(") and not self.fresh() and x in ("yield", "super"):
                self.arguments(")")
            elif not self.fresh() and self.k[self.i] in self.START | {"[", "(", "*", "-", "{", "begin"}:
                self.command()
        elif x == "a":
            self.i += 1
            self.called()
        else:
            raise self.fault("expected an expression")
        self.depth -= 1

    def case(self) -> None:
        self.i += 1
        if not self.at("when", "in", ";") and not self.fresh():
            flag, self.no_do = self.no_do, True
            self.sentence()
            self.no_do = flag
        self.take(";")
        if not self.at("when", "in"):
            raise self.fault("expected when")
        while self.at("when", "in"):
            word = self.k[self.i]
            self.i += 1
            if word == "in":
                self.pattern()
                if self.at("if", "unless"):
                    self.i += 1
                    self.sentence()
            else:
                while True:
                    self.splat()
                    if not self.take(","):
                        break
            self.take("then")
            self.statements("when", "in", "else", "end")
        if self.take("else"):
            self.statements("end")
        self.close()

    def pattern(self) -> None:
        """A pattern's tokens: brackets match, the rest isn't looked into."""
        first = True
        while self.k[self.i] and not (self.at("then", "if", "unless", ";", ")", "]", "}", "and", "or") or (self.fresh() and not first)):
            first = False
            if self.at("(", "[", "{"):
                self.i = self.closing(self.i)
            else:
                self.i += 1
        if first:
            raise self.fault("expected a pattern")

    def definition(self) -> None:
        self.i += 1
        if not self.k[self.i] or self.fresh():
            raise self.fault("expected a name")
        self.i += 1
        while self.at(".") and not self.fresh():
            self.i += 2
        # Names of operators and setters are several tokens.
        if self.k[self.i - 1] in ("[", "!", "+", "-", "=", "<", ">"):
            while self.at("]", "=", "@", "~") and not self.fresh():
                self.i += 1
        elif self.at("=") and self.k[self.i + 1] in ("(",) and not self.fresh():
            self.i += 1
        if self.at("(") and not self.fresh():
            self.i += 1
            self.parameters(")")
        elif not self.fresh() and not self.at(";", "="):
            self.parameters("")
        flag, self.no_do = self.no_do, False
        if self.at("=") and not self.fresh():
            self.i += 1
            self.statement()
        else:
            self.body()
        self.no_do = flag

    def parameters(self, close: str) -> None:
        while not self.at(close) if close else not (self.fresh() or self.at(";", "")):
            if self.at("("):
                self.i = self.closing(self.i)
            elif self.at("label"):
                self.i += 1
                if not self.at(",", ")", "") and not (not close and self.fresh()):
                    self.expression()
            elif self.at("...", "*", "**", "&"):
                self.i += 1
                self.take("a") or self.take("nil")
            else:
                if not self.take("a"):
                    raise self.fault("expected a parameter")
                if self.take("="):
                    self.expression()
            if not self.take(","):
                break
        if close:
            self.need(close)
