"""What the languages' parsers share: lexing to token kinds, memory of parsed shapes, panic-mode recovery.

A token becomes its *kind*: keywords and operators stand for themselves, "a" for a name, "0" for a
number, '"' for a string. Whether a stretch of code parses depends on kinds only, and code repeats
the same stretches all the time; so what a rule makes of the kinds up to the next of ; { } is
remembered (if the rule ended there), and most statements cost one dictionary look-up.
"""

from __future__ import annotations

import re
import sys
from collections import defaultdict
from functools import wraps

#: Remembered stretches of one language; a full memory is emptied.
MAX_MEMORY = 300_000
#: Frames that a text's rules may be nested; what is nested deeper is judged by its brackets alone.
MAX_FRAMES = 20_000
#: Tokens of a stretch that is remembered at most; longer ones, as of deep nests, hardly come again.
MAX_STRETCH = 500

CONFLICT = re.compile(r"(?m)^(?:<{7}(?: .*)?|>{7}(?: .*)?|\|{7}(?: .*)?|={7})\r?$")


#: The kind of a quote that no string was cut out for.
UNCLOSED = "an open quote"


class Fault(Exception):
    """A syntax error at a token."""

    def __init__(self, at: int, message: str) -> None:
        super().__init__(message)
        self.at, self.message = at, message


class Kinds(dict):
    """The kind of each token text, worked out once."""

    def __init__(self, keywords: frozenset[str]) -> None:
        super().__init__({k: k for k in keywords})

    def __missing__(self, token: str) -> str:
        c = token[0]
        if c.isdigit() or (c == "." and len(token) > 1 and token[1].isdigit()):
            kind = "0"
        elif c.isalpha() or c in "_$" or (c in "@#" and len(token) > 1) or ord(c) > 127:
            kind = "a"
        elif token == '""':
            kind = '"'
        elif token == '"':
            kind = UNCLOSED
        else:
            kind = token
        if len(self) < MAX_MEMORY:
            self[token] = kind
        return kind


def memo(rule):
    """Remembers where ``rule`` ends, by the kinds from its beginning to the next of ; { }."""
    name = rule.__name__

    @wraps(rule)
    def remembered(self, *flags):
        i, n, marks = self.i, self.mark_at, self.marks
        if marks[n] < i or (n and marks[n - 1] >= i):
            n = self.seek(i)
        j = marks[n]
        if j - i > MAX_STRETCH:
            return rule(self, *flags)
        key = tuple(self.k[i : j + 1])
        if flags or self.no_brace:
            key = (flags, self.no_brace, key)
        known = self.memory[name]
        length = known.get(key)
        new_line = self.new_line
        if length is not None and (not new_line or new_line.isdisjoint(range(i + 1, i + length + 1))):
            self.i = i + length
            return None
        result = rule(self, *flags)
        # The rule looked at most one token beyond its end, so an end at the mark or before it depends on the key alone.
        end = self.i
        if end <= j + (self.k[j] in ENDS) and result is None and (not new_line or new_line.isdisjoint(range(i + 1, min(end + 1, len(self.k) - 1) + 1))):
            if len(known) >= MAX_MEMORY:
                known.clear()
            known[key] = end - i
        return result

    return remembered


#: Marks that a remembered stretch may include: a statement ends after them.
ENDS = frozenset((";", "\n"))


def tokens(*more: str) -> re.Pattern:
    """The pattern that cuts tokens: a blanked string, a line end, a word, a number or an operator; ``more`` operators of a language come first."""
    shared = "... >>>= >>= <<= && || == != <= >= += -= *= /= %= &= |= ^= << -> => :: ++ --".split()
    operators = "|".join(re.escape(x) for x in sorted([*more, *shared], key=len, reverse=True))
    return re.compile(rf'""|\n|[^\W\d][\w$]*|\$[\w$]+|[0-9](?:[\w.]|(?<=[eEpP])[+-])*|\.[0-9]\w*|{operators}|[^\s]')


class Parser:
    """A recursive-descent parser over kinds. Subclasses define ``unit`` and the language's lexing."""

    KEYWORDS: frozenset[str] = frozenset()
    #: Comments, strings and other stretches that are replaced before tokens are cut.
    OPAQUE: re.Pattern
    TOKEN = tokens()
    #: Whether the ends of lines matter.
    LINES = False

    memories: dict[type, dict] = {}
    kind_tables: dict[type, Kinds] = {}

    def __init__(self, text: str) -> None:
        cls = type(self)
        self.memory = Parser.memories.setdefault(cls, defaultdict(dict))
        kinds = Parser.kind_tables.get(cls)
        if kinds is None:
            kinds = Parser.kind_tables[cls] = Kinds(self.KEYWORDS)
        self.text = text
        tokens = self.TOKEN.findall(self.opaque(text))
        if self.LINES:
            self.k: list[str] = []
            self.new_line: set[int] = set()
            k, new_line = self.k, self.new_line
            for x in map(kinds.__getitem__, tokens):
                if x == "\n":
                    new_line.add(len(k))
                else:
                    k.append(x)
        else:
            self.k = [x for x in map(kinds.__getitem__, tokens) if x != "\n"]
            self.new_line = set()
        self.k.append("")
        self.marks = [i for i, x in enumerate(self.k) if x in _MARKS]
        self.mark_at = 0
        self.i = 0
        self.depth = 0
        self.no_brace = False
        self.errors: list[tuple[int, str]] = []

    # Lexing -------------------------------------------------------------------------------------

    def opaque(self, text: str) -> str:
        return self.OPAQUE.sub(self.replaced, text)

    @staticmethod
    def replaced(m: re.Match) -> str:
        s = m[0]
        if s.startswith(("//", "#")):
            return ""
        if s.startswith("/*"):
            return "\n" if "\n" in s else " "
        return '""'

    def line_of(self, at: int) -> int:
        """The line of the at-th token, counted from 1; found by cutting the tokens again with their places."""
        spans: list[int] = []

        def kept(m: re.Match) -> str:
            # The replacement keeps its length in lines, so lines can be counted.
            r = self.replaced(m)
            return r + "\x00" * (m[0].count("\n") - r.count("\n"))

        clean = self.OPAQUE.sub(kept, self.text)
        line = 1
        for m in self.TOKEN.finditer(clean):
            if m[0] == "\n" or m[0] == "\x00":
                if m[0] == "\x00":
                    line += 1
                continue
            spans.append(m.start())
            if len(spans) > at:
                break
        if not spans:
            return 1
        where = spans[min(at, len(spans) - 1)]
        return clean.count("\n", 0, where) + clean.count("\x00", 0, where) + 1

    # Tokens -------------------------------------------------------------------------------------

    def seek(self, i: int) -> int:
        """The number of the first mark at or after i. Rules mostly move forward, so the last one is a good start."""
        marks, n = self.marks, self.mark_at
        while n > 0 and marks[n - 1] >= i:
            n -= 1
        while marks[n] < i:
            n += 1
        self.mark_at = n
        return n

    def mark_after(self, i: int) -> int:
        return self.marks[self.seek(i)]

    def at(self, *kinds: str) -> bool:
        return self.k[self.i] in kinds

    def take(self, kind: str) -> bool:
        if self.k[self.i] == kind:
            self.i += 1
            return True
        return False

    def need(self, kind: str) -> None:
        if self.k[self.i] != kind:
            raise self.fault(f"expected {kind}")
        self.i += 1

    def name(self) -> None:
        if self.k[self.i] != "a" and self.k[self.i] not in self.SOFT:
            raise self.fault("expected a name")
        self.i += 1

    SOFT: frozenset[str] = frozenset()

    def fault(self, message: str) -> Fault:
        found = self.k[self.i] or "the end"
        return Fault(self.i, f"{message}, found {found}")

    def enter(self) -> None:
        self.depth += 1

    def closing(self, i: int) -> int:
        """The index after the bracket that closes the one at i; the end if none does."""
        if self.partners is None:
            # All of them are found at once, so that a deep nest costs no more than a flat text.
            self.partners, stack = {}, []
            for at, x in enumerate(self.k):
                if x in ("(", "[", "{"):
                    stack.append(at)
                elif x in (")", "]", "}") and stack:
                    self.partners[stack.pop()] = at + 1
        return self.partners.get(i, len(self.k) - 1)

    partners: dict[int, int] | None = None

    # Statements ---------------------------------------------------------------------------------

    def unit(self) -> None:
        raise NotImplementedError

    def recover(self, fault: Fault, least: int) -> None:
        """Panic mode: notes the error and skips to the next statement at this level."""
        self.errors.append((fault.at, fault.message))
        self.i = max(fault.at, least)
        depth = 0
        while self.k[self.i]:
            x = self.k[self.i]
            if x in ("(", "[", "{"):
                depth += 1
            elif x in (")", "]"):
                depth = max(0, depth - 1)
            elif x == "}":
                if depth == 0:
                    return
                depth -= 1
            elif x == ";" and depth == 0:
                self.i += 1
                return
            self.i += 1
            if depth == 0 and self.i in self.new_line:
                return

    def until(self, end: str, rule) -> None:
        """``rule`` again and again up to ``end``; errors inside are noted and skipped."""
        while not self.at(end, ""):
            start, depth, flag = self.i, self.depth, self.no_brace
            try:
                rule()
                if self.i == start:
                    raise self.fault("unexpected token")
            except Fault as fault:
                self.depth, self.no_brace = depth, flag
                self.recover(fault, start)
                if self.i == start:
                    self.i += 1

    def block(self, rule, opened: bool = False) -> None:
        flag, self.no_brace = self.no_brace, False
        if not opened:
            self.need("{")
        self.enter()
        self.until("}", rule)
        if self.at(""):
            raise self.fault("a block is not closed")
        self.i += 1
        self.depth -= 1
        self.no_brace = flag

    def parse(self) -> list[tuple[int, str]]:
        """All errors as (line, message), in the order of their place."""
        limit = sys.getrecursionlimit()
        sys.setrecursionlimit(max(limit, MAX_FRAMES))
        try:
            self.unit()
            if not self.at(""):
                raise self.fault("unexpected token")
        except Fault as fault:
            self.errors.append((fault.at, fault.message))
        except RecursionError:
            self.errors = self.unmatched()
        finally:
            sys.setrecursionlimit(limit)
        seen, out = set(), []
        for at, message in sorted(self.errors):
            if at not in seen:
                seen.add(at)
                out.append((at, message))
        return [(self.line_of(at), message) for at, message in out[:1]] + [(0, message) for _, message in out[1:]]

    def unmatched(self) -> list[tuple[int, str]]:
        """Brackets without their partners, found with a stack of its own, for texts that are nested deeper than rules can follow."""
        pairs, stack = {")": "(", "]": "[", "}": "{"}, []
        for i, x in enumerate(self.k):
            if x in ("(", "[", "{"):
                stack.append(i)
            elif x in pairs and (not stack or self.k[stack.pop()] != pairs[x]):
                return [(i, "a bracket doesn't match")]
        return [(stack[-1], "a bracket is not closed")] if stack else []

    def many(self, rule, close: str, separator: str = ",") -> None:
        """Rules between separators, a last separator allowed, and the closing bracket."""
        while not self.at(close):
            rule()
            if not self.take(separator):
                break
        self.need(close)


_MARKS = frozenset((";", "{", "}", ""))
