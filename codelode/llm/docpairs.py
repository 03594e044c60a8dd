"""Functions and methods paired with the documentation that describes them.

A symbol's text is read line by line: a signature is found by the language's keywords or by its
form, its body ends where the indentation falls back, the braces close or the end keyword comes, and
the comment block next to the signature (above it, or the string below it) is its documentation. A
pair is kept if the documentation says something: what remains of it without tags that describe
nothing, directives, dates, owners, licences, references elsewhere, placeholders, stock phrases and
the words of the name and of the parameters still holds words.

Everything about a symbol is decided from its own row, so the rows stream through one Arrow stage;
the only shuffle removes repeated symbols.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words beyond the name, the parameters and stock phrases from which a text is a description.
MIN_NEW_WORDS = 2
#: Blank lines that may lie between a comment and the signature it belongs to.
MAX_DISTANCE = 1

# Words before a declaration.
_MODIFIER = r"(?:(?:export|default|public|private|protected|internal|static|final|abstract|override|async|pub(?:\([a-z]+\))?|unsafe|extern|inline|virtual|const|open|suspend|synchronized|native)(?=\s))"
_MODIFIERS = re.compile(rf"[ \t]*(?:{_MODIFIER}[ \t]+)*")
_MODIFIER_LINE = re.compile(rf"[ \t]*(?:{_MODIFIER}\s+)+")
# Where a signature can be: a keyword, a variable that may hold a function, or a bracket that may follow a name.
_PLACE = re.compile(r"(?<![\w$])(?:(?P<kw>def|fn|func|function\*?|fun)|(?P<var>const|let|var))(?=\s)|\(")
_KEYWORD_NAME = re.compile(r"\s+(?P<name>[\w$.?!]++)\s*+")
_RECEIVER, _RECEIVED_NAME = re.compile(r"\s+\("), re.compile(r"\s*+(?P<name>[\w$.?!]++)\s*+")
_VARIABLE = re.compile(r"\s+(?P<name>[\w$]++)\s*+")
_VALUE = re.compile(r"\s*+(?:async\s*+)?(?:function\b\s*+[\w$]*+)?\s*+\(")
# Characters that the type before a C-like function's name can't have, and marks that end its parameters' list.
_NO_TYPE, _STOP = re.compile(r"[^\w<>\[\],.*&:?\s]"), re.compile(r"[;{}]")
_CLOSER, _THROWS = re.compile(r"\)\s*+(?:(?P<throws>throws )|(?P<type>:)|\{)"), re.compile(r"throws [\w., ]++(?::[^{=;]++)?$")
_NOT_NAMES = frozenset("if for while switch catch return else do try with match loop when until unless elif foreach".split())
_LINE_COMMENT = re.compile(r"^[ \t]*(?:///?!?|#(?!\[)|--|\*)")
_COMMENT_START, _COMMENT_END = re.compile(r"^[ \t]*/\*"), re.compile(r"\*/[ \t]*$")
_DOCSTRING = re.compile(r"""^\s*[rRuUbB]{0,2}(\"\"\"|'''|\"|')(.*?)(?<!\\)\1""", re.DOTALL)
_MARKS = re.compile(r"^[ \t]*(?:/\*+!?|\*+/|\*|///?!?|#+!?|--+)?[ \t]?|(?<![ \t])[ \t]*+(?<!\*)\*++/[ \t]*+$")
_QUOTES = re.compile(r"""^\s*[rRuU]?(?:\"\"\"|''')|(?:\"\"\"|''')\s*$""")

# Lines that say nothing about the code.
_DIRECTIVE = re.compile(
    r"(?i)^\s*(?:noqa\b|nolint\b|type:\s*ignore|pylint:|mypy:|pragma\b|eslint[-\s]|tslint[:-]|jshint|prettier-ignore|@?ts-(?:ignore|expect-error|nocheck)|@ts-\w+|#?\s*(?:end)?region\b"
    r"|@?SuppressWarnings|flake8:|fmt:\s*o|isort:|clang-format|istanbul|c8 ignore|coverage:|go:\w+|\+build|rustfmt|clippy::|yapf:|ruff:|noinspection|@formatter)"
)
_ADMIN = re.compile(
    r"(?i)^\s*(?:@?(?:author|authors|since|version|date|created(?: by| on| at)?|modified|updated|last (?:change|modified|updated)|copyright|licen[cs]e|owner|maintainer|reviewer|reviewed|history|revision)\b.*"
    r"|spdx-license-identifier.*|\(c\).*|all rights reserved.*|licensed under.*|\d{4}-\d\d-\d\d\b.{0,30}|\d{1,2}[./]\d{1,2}[./]\d{2,4}.{0,30})$"
)
_ELSEWHERE = re.compile(
    r"(?i)^\s*(?:\{?@?inherit-?doc\}?|(?:\{?@see\b|@link\b|see\b|see also\b|cf\.?|refer to|same as|as (?:above|in parent|described)|ditto|idem|siehe|vgl\.?|gleich wie|wie oben|voir|véase|ver|igual que|comme)\b"
    r"[^.;:]{0,60})[.!]?\s*$"
)
_PLACEHOLDER = re.compile(
    r"(?i)^\W*(?:todo|fixme|xxx|hack|tbd|tba|wip)\b.*$|^\W*(?:write me|document (?:me|this)|docs?|summary|description|method|function|undocumented|none|n/a|na|nothing|lorem ipsum.*|to be (?:continued|done|documented|written)|insert .*|"
    r"(?:add |insert |missing |no )?(?:description|documentation|doc|docs|comment|comments|text)(?: (?:goes )?here| provided| available| yet| needed| missing)*|(?:method|function|class|module) (?:description|summary|documentation|stub)|auto-?generated\b.*|generated (?:method|code|stub).*|returns?|args?|parameters?|coming soon|fill (?:me )?in|placeholder|test|foo|bar|blah.*)\W*$"
)
_BARE_TAG = re.compile(r"(?i)^\s*[@\\](?:deprecated|internal|private|public|protected|override|final|static|hidden|ignore|api|async|virtual|abstract|readonly|beta|alpha|experimental|test|module|namespace|class|function|method|constructor|inheritdoc|returns?|throws?)\s*$")
_TAG = re.compile(r"(?i)^\s*(?:[:@\\](?P<tag>param(?:eter)?|arg(?:ument)?|type|rtype|returns?|raises?|throws?|exception|yields?|keyword|var|ivar|template|tparam|property|prop|since|see)\b\s*)(?P<rest>.*)$")
_SECTION = re.compile(r"(?i)^\s*(?:args|arguments|parameters|params|returns?|raises|yields|throws|attributes|examples?|notes?|keyword args|other parameters|see also|references|warns?)\s*:?\s*$")
_ITEM = re.compile(r"^\s*[-*]?\s*[*`]*([A-Za-z_$][\w$]*)[*`]*+\s*+(?:\([^)]*\)\s*+)?(?::|--?|–)\s+(.*)$")

# Words that phrases about any function use.
STOCK = frozenset(
    """a an and as at be been by can could did do does doing done for from get gets given given has have he here him his how i in inside into is it its itself just let made make makes may me might must my of on
    one onto or our out over shall she should so some that the their them then there these they thing things this those to up upon us use used uses using via was we were what when where which will with within would you your
    function functions method methods helper helpers utility routine procedure subroutine member implementation implements implement wrapper wraps simple simply basic basically handle handles handling
    perform performs performing execute executes run runs process processes processing call calls called return returns returned returning result results value values output input param parameter parameters argument arguments arg args
    object objects instance self cls data item items class type types main public private static self-explanatory description describe describes
    el la los las un una de del que y en es por para con función método der die das ein eine und von zu für ist mit funktion methode le les une du des et est pour avec fonction méthode""".split()
)
_WORD = re.compile(r"[^\W_]+(?:'[^\W\d_]+)?", re.UNICODE)
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|_+|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


def stem(word: str) -> str:
    """A crude English stem, enough to match "resolves" with "resolve" and "entries" with "entry"."""
    w = word.lower()
    for suffix in ("'s", "ings", "ing", "ies", "ied", "ys", "ed", "es", "s", "e", "y"):
        if w.endswith(suffix) and len(w) - len(suffix) >= 3:
            w = w[: -len(suffix)]
            break
    return w[:-1] if len(w) > 3 and w[-1] == w[-2] else w


def _parts(name: str) -> set[str]:
    return {stem(p) for p in _CAMEL.split(name) if p} | {stem(name)}


_STOCK_STEMS = frozenset(stem(w) for w in STOCK)


class _Text:
    """A text with the places of its marks, found once, so that a search for signatures is linear in the text's length."""

    def __init__(self, text: str) -> None:
        self.text = text
        self._marks: dict[re.Pattern, list[int]] = {}

    def marks(self, pattern: re.Pattern) -> list[int]:
        """Where ``pattern`` begins, in order."""
        if pattern not in self._marks:
            self._marks[pattern] = [m.start() for m in pattern.finditer(self.text)]
        return self._marks[pattern]

    def begin(self, at: int) -> int | None:
        """Where the declaration begins whose keyword stands at ``at``: modifiers may precede it, also on lines of their own; None if something else does."""
        text, start = self.text, self.text.rfind("\n", 0, at) + 1
        if not _MODIFIERS.fullmatch(text, start, at):
            return None
        while start:
            line = text.rfind("\n", 0, start - 1) + 1
            if not _MODIFIER_LINE.fullmatch(text, line, start):
                break
            start = line
        return start

    def after_keyword(self, at: int) -> tuple[str, str] | None:
        """(name, parameters) behind a keyword that ends at ``at``."""
        text = self.text
        if m := _RECEIVER.match(text, at):
            close = text.find(")", m.end())
            at = close + 1
            if close < 0:
                return None
        m = (_RECEIVED_NAME if m else _KEYWORD_NAME).match(text, at)
        if not m:
            return None
        bracket = text.find("(", m.end())
        if bracket < 0:
            return None
        opened = text[m.end()]
        if bracket > m.end() and not (opened in "<[" and text[m.end() : bracket].rstrip().endswith(">" if opened == "<" else "]")):
            return None
        close = text.find(")", bracket)
        if close < 0 or text.find("{", bracket, close) >= 0:
            return None
        return m["name"], text[bracket + 1 : close]

    def after_variable(self, at: int) -> tuple[str, str] | None:
        """(name, parameters) of a function that is assigned to the variable whose keyword ends at ``at``."""
        text = self.text
        m = _VARIABLE.match(text, at)
        if not m or m.end() == len(text):
            return None
        equals = text.find("=", m.end() + 1) if text[m.end()] == ":" else m.end()
        if equals < 0 or text[equals] != "=" or not (value := _VALUE.match(text, equals + 1)):
            return None
        close = text.find(")", value.end())
        return (m["name"], text[value.end() : close]) if close >= 0 else None

    def around_bracket(self, at: int) -> tuple[str, str, int] | None:
        """(name, parameters, begin) of a C-like function whose list of parameters opens at ``at``."""
        text = self.text
        end = at
        while end and text[end - 1].isspace():
            end -= 1
        start = end
        while start and (text[start - 1].isalnum() or text[start - 1] in "_$~"):
            start -= 1
        if start == end or (start and not (text[start - 1].isspace() or text[start - 1] in "*&")):
            return None
        # Back to the last character that no type can have; the declaration begins on the next line that isn't blank.
        marks = self.marks(_NO_TYPE)
        i = bisect_left(marks, start)
        begin = 0
        if i:
            begin = text.find("\n", marks[i - 1], start) + 1
            if not begin:
                return None
        stops = self.marks(_STOP)
        j = bisect_left(stops, at)
        if j == len(stops) or text[stops[j]] != "{":
            return None
        closers = self.marks(_CLOSER)
        equals = text.rfind("=", at, stops[j])
        for n in range(bisect_left(closers, at), len(closers)):
            close = closers[n]
            if close > stops[j]:
                return None
            m = _CLOSER.match(text, close)
            if m["throws"]:
                good = bool(_THROWS.match(text, m.start("throws"), stops[j]))
            elif m["type"]:
                good = close > equals and m.end() < stops[j]
                if not good and close < equals:
                    continue
            else:
                good = m.end() == stops[j] + 1
            if good:
                return text[start:end], text[at + 1 : close], begin
        return None


def signature_of(text: str) -> tuple[str, str, int] | None:
    """(name, parameters, line) of the first signature in ``text``; lines count from 0. The time is linear in the text's length, whatever it holds."""
    t, done = _Text(text), 0
    for m in _PLACE.finditer(text):
        if m.start() < done:
            continue
        if m["kw"] or m["var"]:
            begin = t.begin(m.start())
            found = None if begin is None else (t.after_keyword if m["kw"] else t.after_variable)(m.end())
        else:
            found = t.around_bracket(m.start())
            begin = found[2] if found else None
        if not found:
            continue
        if found[0] in _NOT_NAMES:
            done = m.end() + len(found[1])
            continue
        while text[begin].isspace():
            begin += 1
        return found[0], found[1], text.count("\n", 0, begin)
    return None


def body_end(lines: list[str], start: int) -> int:
    """The line after the body of the signature in line ``start``.

    A stack of openers: braces where the signature opens one, ``end`` keywords where the language has
    them, else the indentation.
    """
    head = lines[start]
    if "{" in head or (start + 1 < len(lines) and lines[start + 1].strip() == "{"):
        depth, seen = 0, False
        for i in range(start, len(lines)):
            bare = re.sub(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`[^`]*`|//.*$", "", lines[i])
            depth += bare.count("{") - bare.count("}")
            seen = seen or "{" in bare
            if seen and depth <= 0:
                return i + 1
        return len(lines)
    indent = len(head) - len(head.lstrip())
    ends_with_keyword = not head.rstrip().endswith(":") and any(re.match(rf"^\s{{0,{indent}}}end\b", x) for x in lines[start + 1 :])
    if ends_with_keyword:
        stack = 1
        for i in range(start + 1, len(lines)):
            if re.match(r"^\s*(?:def|class|module|if|unless|while|until|case|begin|for)\b|.*\bdo\b(?:\s*\|[^|]*\|)?\s*$", lines[i]):
                stack += 1
            if re.match(r"^\s*end\b", lines[i]):
                stack -= 1
                if not stack:
                    return i + 1
        return len(lines)
    closed = False
    for i in range(start, len(lines)):
        if not closed:
            closed = lines[i].rstrip().endswith(":") or "):" in lines[i] or "->" in lines[i]
            continue
        if lines[i].strip() and len(lines[i]) - len(lines[i].lstrip()) <= indent:
            return i
    return len(lines)


def adjacent_comment(lines: list[str], at: int, python: bool) -> str:
    """The comment block above line ``at``, at most ``MAX_DISTANCE`` blank lines away, and the string below it."""
    i, blanks = at - 1, 0
    block: list[str] = []
    while i >= 0 and re.match(r"^[ \t]*(?:@\w|#\[|\[\w+.*\]$)", lines[i]):
        i -= 1  # decorators and attributes
    while i >= 0 and not lines[i].strip() and blanks < MAX_DISTANCE:
        i, blanks = i - 1, blanks + 1
    if i >= 0 and _COMMENT_END.search(lines[i]):
        while i >= 0:
            block.append(lines[i])
            if _COMMENT_START.match(lines[i]):
                break
            i -= 1
    else:
        while i >= 0 and _LINE_COMMENT.match(lines[i]):
            block.append(lines[i])
            i -= 1
    out = "\n".join(reversed(block))
    if python:
        rest, j = lines[at:], 0
        while j < len(rest) and not re.search(r":\s*(?:#.*)?$", rest[j]):
            j += 1
        if m := _DOCSTRING.match("\n".join(rest[j + 1 :])):
            out += "\n" + m[2]
    return out.strip("\n")


def cleaned(doc: str) -> list[str]:
    """The documentation's lines without comment marks."""
    doc = _QUOTES.sub("", _QUOTES.sub("", doc.replace("\r\n", "\n")))
    return [_MARKS.sub("", _MARKS.sub("", line)).strip() for line in doc.split("\n")]


def description(doc: str | None, name: str, params: str) -> tuple[str, int]:
    """What ``doc`` says (its telling lines) and how many words of it are new, beyond name, parameters and stock phrases."""
    if not doc or not doc.strip():
        return "", 0
    known = _parts(name) | {s for p in _WORD.findall(params.replace("_", " ")) for s in _parts(p)}
    for p in re.findall(r"[\w$]+", params):
        known |= _parts(p)
    kept, new = [], set()
    for line in cleaned(doc):
        if not re.search(r"[^\W\d_]", line) or any(p.match(line) for p in (_DIRECTIVE, _ADMIN, _ELSEWHERE, _PLACEHOLDER, _BARE_TAG, _SECTION)):
            continue
        text, own = line, set()
        if m := _TAG.match(line):
            if m["tag"].lower() in ("since", "see", "type", "rtype"):
                continue
            text = re.sub(r"^\{[^}]*\}\s*", "", m["rest"])
            if n := re.match(r"\[?([\w$.]+)\]?\s*(?::|-)?\s*", text):
                if m["tag"].lower().startswith(("param", "arg", "keyword", "raise", "throw", "exception", "var", "ivar", "prop", "tparam", "template")):
                    own, text = _parts(n[1]), text[n.end() :]
        elif m := _ITEM.match(line):
            if _parts(m[1]) & known or m[1] in params:
                own, text = _parts(m[1]), m[2]
        words = {stem(part) for w in _WORD.findall(text) for part in (_CAMEL.split(w) if w != w.upper() else [w]) if part and not part.isdigit()}
        fresh = {w for w in words - known - own - _STOCK_STEMS if len(w) > 1}
        if fresh:
            kept.append(line)
            new |= fresh
    return "\n".join(kept), len(new)


def pair_of(name: str | None, signature: str | None, docstring: str | None, body: str) -> tuple[str, int]:
    """(description, new words) of one symbol; the better of its docstring and its adjacent comment."""
    text = body.replace("\r\n", "\n").replace("\r", "\n")
    found = signature_of(text)
    own_name = name or (found[0] if found else "")
    params = found[1] if found else ""
    if signature and "(" in signature:
        params += " " + signature[signature.index("(") :]
    best = description(docstring, own_name, params)
    if found:
        lines = text.split("\n")
        near = description(adjacent_comment(lines, found[2], lines[found[2]].lstrip().startswith(("def ", "async def "))), own_name, params)
        best = max(best, near, key=lambda d: d[1])
    return best


def code_of(body: str) -> str:
    """The function alone: from its signature to the end of its body."""
    text = body.replace("\r\n", "\n").replace("\r", "\n")
    found = signature_of(text)
    if not found:
        return text
    lines = text.split("\n")
    return "\n".join(lines[found[2] : body_end(lines, found[2])])


def documented_functions(symbols: DataFrame, key: str = "symbol_id", min_new_words: int = MIN_NEW_WORDS) -> DataFrame:
    """(key, code, description, n_new): each function or method whose documentation describes it.

    ``symbols`` has name, kind, signature, docstring and body_text. Other kinds, null texts and
    documentation that is missing, empty or a phrase give no row; of a repeated symbol one row counts;
    null keys are left out; extra columns are ignored.
    """
    wanted = symbols.filter(F.lower(F.trim("kind")).isin("function", "method") & F.col("body_text").isNotNull() & F.col(key).isNotNull())
    columns = ["name", "signature", "docstring", "body_text"]
    kind = dict(symbols.dtypes)[key]

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, name, signature, doc, body in zip(b["k"], *[b[c] for c in columns], strict=True):
                text, new = pair_of(name, signature, doc, body)
                if new >= min_new_words:
                    rows.append((k, code_of(body), text, new))
            yield pd.DataFrame(rows, columns=["k", "code", "description", "n_new"])

    out = wanted.select(F.col(key).alias("k"), *columns).mapInPandas(pairs, f"k {kind}, code string, description string, n_new int")
    # Repeated symbols meet after the descriptions are made: half of the rows are gone by then.
    best = out.groupBy("k").agg(F.max(F.struct("n_new", "description", "code")).alias("b"))
    return best.select(F.col("k").alias(key), "b.code", "b.description", "b.n_new")
