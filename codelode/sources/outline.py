"""Symbols and imports of source texts, by line-based outlines of thirteen languages and of registered ones.

A table of patterns per language says which lines declare what; blocks are followed by indentation
(Python, Ruby's end) or by braces outside strings and comments. It approximates a full parser: an
outline never fails, so broken files still give what stands before and after the broken part.
"""

from __future__ import annotations

import re
import runpy
import signal
import threading
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MODS = r"(?:(?:export|default|public|private|protected|internal|static|final|abstract|async|pub(?:\([^)]*\))?|unsafe|const|inline|open|override|virtual|external|pure|view|payable|sealed|data|suspend|extern|declare)\s+)*"


@dataclass(frozen=True)
class Language:
    """How a language declares things. Patterns have the groups name and, for methods outside their type, owner."""

    classes: str
    functions: str
    methods: str = ""
    imports: str = r"^\s*import\s+(?P<module>[\w.:/*@{}, ]+)"
    doc: str = r"^\s*(?:///?!?|/\*\*?|\*/?|\*)\s?"
    separator: str = "."
    indented: bool = False
    private: str = r"\bprivate\b"
    #: Lines that declare a module, and lines inside a type that declare a field; both have the group name.
    modules: str = ""
    fields: str = ""


_C_FUNCTION = r"^(?:[A-Za-z_][\w\s*]*?[\s*])(?P<name>[A-Za-z_]\w*)\s*\([^;]*\)\s*\{?\s*$"
_C_PROTOTYPE = r"^(?!\s*(?:return|else|typedef)\b)(?:[A-Za-z_][\w\s*]*?[\s*])(?P<prototype>[A-Za-z_]\w*)\s*\([^;{}]*\)\s*;\s*$"
#: Fixed patterns: declarations by language.
LANGUAGES: dict[str, Language] = {
    "python": Language(r"^\s*class\s+(?P<name>\w+)", r"^\s*(?:async\s+)?def\s+(?P<name>\w+)", imports=r"^\s*(?:from\s+(?P<module>[\w.]+)\s+import\s+(?P<names>.+)|import\s+(?P<plain>.+))", indented=True, private=r"^_"),
    "javascript": Language(
        rf"^\s*{_MODS}(?:class|interface|enum|type|namespace)\s+(?P<name>[\w$]+)",
        rf"^\s*{_MODS}function\s*\*?\s*(?P<name>[\w$]+)|^\s*(?:export\s+)?(?:const|let|var)\s+(?P<arrow>[\w$]+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*(?::[^=]+)?=>",
        rf"^\s*{_MODS}(?:get\s+|set\s+|\*\s*)?(?P<name>[\w$#]+)\s*(?:<[^>]*>)?\([^;]*\)\s*(?::[^{{;]+)?\{{",
        r"^\s*import\s+(?:(?P<names>.+?)\s+from\s+)?['\"](?P<module>[^'\"]+)['\"]",
        fields=r"^\s*(?:(?:public|private|protected|static|readonly|declare|override)\s+)*(?P<name>[\w$#]+)[?!]?\s*(?::\s*[^=;{}()]+)?(?:=\s*[^;]+)?;\s*$",
    ),
    "rust": Language(
        r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait|union)\s+(?P<name>\w+)|^\s*impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(?P<impl>\w+)",
        rf"^\s*{_MODS}fn\s+(?P<name>\w+)", imports=r"^\s*(?:pub\s+)?use\s+(?P<module>[^;]+);", doc=r"^\s*(?:///?!?|/\*\*?|\*/?)\s?", separator="::", private=r"^(?!.*\bpub\b)",
        modules=r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(?P<name>\w+)\s*[;{]",
    ),
    "go": Language(
        r"^\s*type\s+(?P<name>\w+)\s+", r"^func\s+(?P<name>\w+)\s*[(\[]", r"^func\s+\(\s*\w*\s*\*?(?P<owner>\w+)[^)]*\)\s*(?P<name>\w+)\s*\(", r"^\s*(?:import\s+)?(?:[\w.]+\s+)?\"(?P<module>[^\"]+)\"", private=r"^[a-z_]",
    ),
    "java": Language(
        rf"^\s*{_MODS}(?:class|interface|enum|record|@interface)\s+(?P<name>\w+)", r"(?!)",
        rf"^\s*(?:@\w+(?:\([^)]*\))?\s+)*{_MODS}(?:<[^>]+>\s+)?(?:[\w.<>\[\], ?]+\s+)?(?P<name>\w+)\s*\([^;]*\)\s*(?:throws [\w., ]+)?\{{?\s*$", r"^\s*import\s+(?:static\s+)?(?P<module>[\w.*]+);",
        fields=r"^\s*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|protected|static|final|volatile|transient)\s+)*[A-Za-z_][\w.<>\[\], ?]*\s+(?P<name>\w+)\s*(?:=[^;]*)?;\s*$",
    ),
    "c": Language(r"^\s*(?:typedef\s+)?(?:struct|enum|union)\s+(?P<name>\w+)\s*\{|^\s*typedef\b[^;{]*?(?P<typedef>\w+)\s*;", rf"{_C_FUNCTION}|{_C_PROTOTYPE}", imports=r"^\s*#\s*include\s+[<\"](?P<module>[^>\"]+)", private=r"\bstatic\b"),
    "ruby": Language(r"^\s*(?:class|module)\s+(?P<name>[\w:]+)", r"^\s*def\s+(?:self\.)?(?P<name>[\w?!=]+)", imports=r"^\s*require(?:_relative)?\s+['\"](?P<module>[^'\"]+)", doc=r"^\s*#\s?", separator="::"),
    "php": Language(rf"^\s*{_MODS}(?:class|interface|trait|enum)\s+(?P<name>\w+)", rf"^\s*{_MODS}function\s+&?(?P<name>\w+)", imports=r"^\s*use\s+(?P<module>[\w\\]+)", separator="\\", modules=r"^\s*namespace\s+(?P<name>[\w\\]+)\s*[;{]"),
    "kotlin": Language(rf"^\s*{_MODS}(?:class|interface|object|enum class)\s+(?P<name>\w+)", rf"^\s*{_MODS}fun\s+(?:<[^>]+>\s*)?(?:\w+\.)?(?P<name>\w+)"),
    "swift": Language(rf"^\s*{_MODS}(?:class|struct|actor|enum|protocol|extension)\s+(?P<name>\w+)", rf"^\s*{_MODS}func\s+(?P<name>\w+)"),
    "zig": Language(r"^\s*(?:pub\s+)?const\s+(?P<name>\w+)\s*=\s*(?:extern\s+|packed\s+)?(?:struct|enum|union)", r"^\s*(?:pub\s+)?(?:export\s+)?(?:inline\s+)?fn\s+(?P<name>\w+)", imports=r"@import\(\"(?P<module>[^\"]+)\"\)", private=r"^(?!.*\bpub\b)"),
    "solidity": Language(r"^\s*(?:abstract\s+)?(?:contract|interface|library)\s+(?P<name>\w+)", r"^\s*(?:function|event|modifier)\s+(?P<name>\w+)|^\s*(?P<ctor>constructor)\s*\(", imports=r"^\s*import\s+(?:.*from\s+)?['\"](?P<module>[^'\"]+)", private=r"\b(?:private|internal)\b"),
}
LANGUAGES["typescript"] = LANGUAGES["javascript"]
_NOT_METHODS = frozenset("if for while switch catch return function do else with try match loop sizeof new throw constructor_".split())
_NOT_FIELDS = frozenset("return break continue package import throw else default debugger".split())
_OPAQUE = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)'|'(?:[^'\\\n]|\\.)*'|`[^`]*`")


@dataclass
class Outline:
    symbols: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)


def _brace_depths(text: str) -> tuple[list[int], list[bool]]:
    """The depth of braces at the beginning of each line, strings and comments aside, with one more entry for the end; whether a line opens one."""
    blank = _OPAQUE.sub(lambda m: "\n" * m[0].count("\n"), text)
    depths, opens, depth = [0], [], 0
    for line in blank.split("\n"):
        depth += line.count("{") - line.count("}")
        depths.append(depth)
        opens.append("{" in line)
    return depths, opens


def _doc_above(lines: list[str], at: int, style: re.Pattern) -> str | None:
    i = at - 1
    while i >= 0 and re.match(r"^\s*(?:@\w|#\[)", lines[i]):
        i -= 1
    block = []
    while i >= 0 and lines[i].strip() and style.match(lines[i]):
        block.append(re.sub(r"\*/\s*$", "", style.sub("", lines[i])).strip())
        i -= 1
    text = "\n".join(x for x in reversed(block)).strip()
    return text or None


def _docstring(lines: list[str], start: int, end: int) -> str | None:
    body = "\n".join(lines[start:end])
    m = re.match(r"[\s\S]*?:[ \t]*(?:#.*)?\n\s*[rRuU]?(\"\"\"|''')([\s\S]*?)\1", body)
    return m[2].strip() if m and body.index(m[1]) == m.start(1) else None


def _imports(m: re.Match, line: int) -> list[dict]:
    """Every module and name of an import line."""
    g = m.groupdict()
    if g.get("plain"):
        out = []
        for part in g["plain"].split("#")[0].split(","):
            words = part.split(" as ")
            if words[0].strip():
                out.append({"module": words[0].strip(), "names": [], "alias": words[1].strip() if len(words) > 1 else None, "line": line, "is_from": False})
        return out
    names = re.findall(r"[\w$]+(?=\s*(?:,|\)|\}|$|\bas\b))", re.sub(r"\bas\s+\w+|\btype\s", "", (g.get("names") or "").split("#")[0]))
    return [{"module": g["module"].strip(), "names": [n for n in names if n not in ("from", "as")], "alias": None, "line": line, "is_from": bool(g.get("names"))}]


def outline(text: str | None, language: str | None, path: str = "") -> Outline:
    """Functions, classes, methods and imports of one text. Unknown languages and missing texts come back as errors."""
    out = Outline()
    spec = LANGUAGES.get(language or "")
    if spec is None:
        out.errors.append(f"unsupported language: {language}")
        return out
    if text is None:
        out.errors.append("no text")
        return out
    text = text.replace("\r\n", "\n")
    lines = text.split("\n")
    stem = re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1]) or "module"
    classes, functions, imports, doc = (re.compile(p) for p in (spec.classes, spec.functions, spec.imports, spec.doc))
    methods, modules, fields = (re.compile(p) if p else None for p in (spec.methods, spec.modules, spec.fields))
    depths, opens = ([], []) if spec.indented else _brace_depths(text)
    owners: list[tuple[str, int, int]] = []  # name, end line, depth inside
    functions_open: list[int] = []
    in_import_block = False

    def end_of(i: int) -> int:
        if spec.indented:
            indent = len(lines[i]) - len(lines[i].lstrip())
            j = last = i
            opened = re.sub(r"\s*#.*$", "", lines[i]).rstrip().endswith(":")
            for j in range(i + 1, len(lines)):
                if not opened:
                    opened = re.sub(r"\s*#.*$", "", lines[j]).rstrip().endswith(":")
                    last = j
                    continue
                if lines[j].strip():
                    if len(lines[j]) - len(lines[j].lstrip()) <= indent:
                        break
                    last = j
            return last
        if language == "ruby":
            indent = len(lines[i]) - len(lines[i].lstrip())
            for j in range(i + 1, len(lines)):
                if re.match(rf"^\s{{{indent}}}end\b", lines[j]):
                    return j
            return len(lines) - 1
        base = depths[i]
        for j in range(i, len(lines)):
            if depths[j + 1] > base or (j > i and depths[j] > base):
                for k in range(j, len(lines)):
                    if depths[k + 1] <= base:
                        return k
                return len(lines) - 1
            if opens[j] or ";" in lines[j]:
                return j
        return i

    for i, line in enumerate(lines):
        while owners and i > owners[-1][1]:
            owners.pop()
        while functions_open and i > functions_open[-1]:
            functions_open.pop()
        if not line.strip() or functions_open:
            continue
        if language == "go":
            in_import_block = (in_import_block and not line.startswith(")")) or line.startswith("import (")
        if (m := imports.search(line)) and (language != "go" or in_import_block or line.lstrip().startswith("import")):
            out.imports += _imports(m, i + 1)
            continue
        kind = name = owner = None
        if m := classes.match(line):
            g = m.groupdict()
            name, kind = g.get("name") or g.get("typedef") or g.get("impl"), "class"
            if g.get("impl") and not g.get("name"):
                owners.append((name, end_of(i), i))
                continue
        elif m := functions.match(line):
            g = m.groupdict()
            name = g.get("name") or g.get("prototype") or g.get("arrow") or g.get("ctor")
            kind = "method" if owners else "function"
        elif methods and (owners or language == "go") and (m := methods.match(line)) and m["name"] not in _NOT_METHODS:
            name, kind = m["name"], "method"
            owner = m.groupdict().get("owner")
        elif modules and (m := modules.match(line)):
            name, kind = m["name"], "module"
        elif fields and owners and depths[i] == depths[owners[-1][2]] + 1 and (m := fields.match(line)) and m["name"] not in _NOT_FIELDS:
            name, kind = m["name"], "function"
        if not name or (name in _NOT_METHODS and name != "new"):
            continue
        end = end_of(i)
        owner = owner or (owners[-1][0] if owners else None)
        qualified = spec.separator.join(x for x in (stem, owner, name) if x)
        comment = _docstring(lines, i, end + 1) if spec.indented else _doc_above(lines, i, doc)
        decorators = []
        j = i - 1
        while j >= 0 and re.match(r"^\s*(?:@\w|#\[)", lines[j]):
            decorators.insert(0, lines[j].strip())
            j -= 1
        subject = name if spec.private.startswith("^[") or spec.private == r"^_" else line
        visibility = "private" if re.search(spec.private, subject) else "protected" if re.search(r"\bprotected\b", line) else "public"
        out.symbols.append(
            {
                "name": name, "qualified": qualified, "kind": kind, "line_start": i + 1, "line_end": end + 1, "signature": re.sub(r"\s*[{:]\s*$", "", line.strip()), "docstring": comment,
                "body_text": "\n".join(lines[i : end + 1]), "visibility": visibility, "decorators": ",".join(decorators) or None,
            }
        )
        if kind == "class" or (kind == "module" and end > i and language == "rust"):
            owners.append((name, end, i))
        elif kind != "module":
            functions_open.append(end)
    return out


#: Seconds that one text may take.
TIMEOUT = 5.0


class _TooLong(Exception):
    pass


@contextmanager
def time_limit(seconds: float):
    """Raises in the block after ``seconds``; only a process's main thread can be interrupted, as Spark's Python workers are."""
    if threading.current_thread() is not threading.main_thread() or not hasattr(signal, "setitimer"):
        yield
        return

    def stop(*_):
        raise _TooLong

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


#: An extractor of a registered language: (text, path) -> (symbols, imports), as lists of dicts.
Extractor = Callable[[str, str], tuple[list[dict], list[dict]]]


def load_extractors(folder: str) -> tuple[dict[str, Extractor], list[str]]:
    """Extractors of the Python files in a folder, and what was skipped. A file needs LANGUAGE (a name) and extract (a function); the first of a language counts."""
    found: dict[str, Extractor] = {}
    skipped: list[str] = []
    for path in sorted(Path(folder).glob("*.py")):
        try:
            names = runpy.run_path(str(path))
        except Exception as e:  # noqa: BLE001
            skipped.append(f"{path.name}: {type(e).__name__}: {e}")
            continue
        language, extract = names.get("LANGUAGE"), names.get("extract")
        if not isinstance(language, str) or not callable(extract) or language in found:
            skipped.append(f"{path.name}: no language or no extractor of its own")
            continue
        found[language] = extract
    return found, skipped


def outline_of(text: str | None, language: str | None, path: str = "", extractors: Mapping[str, Extractor] | None = None, seconds: float = TIMEOUT) -> Outline:
    """``outline`` that never fails and never takes longer than ``seconds``; languages that it doesn't know are asked of ``extractors``."""
    try:
        with time_limit(seconds):
            extract = (extractors or {}).get(language or "")
            if extract is None or language in LANGUAGES or text is None:
                return outline(text, language, path)
            symbols, imports = extract(text, path)
            blank_symbol, blank_import = dict.fromkeys(SYMBOL_FIELDS), dict.fromkeys(IMPORT_FIELDS)
            return Outline([blank_symbol | {k: v for k, v in s.items() if k in blank_symbol} for s in symbols], [blank_import | {k: v for k, v in i.items() if k in blank_import} for i in imports])
    except _TooLong:
        return Outline(errors=[f"took longer than {seconds:g} seconds"])
    except Exception as e:  # noqa: BLE001
        return Outline(errors=[f"{type(e).__name__}: {e}"])


SYMBOL_FIELDS = ("name", "qualified", "kind", "line_start", "line_end", "signature", "docstring", "body_text", "visibility", "decorators")
IMPORT_FIELDS = ("module", "names", "alias", "line", "is_from")
SYMBOL = "struct<name: string, qualified: string, kind: string, line_start: bigint, line_end: bigint, signature: string, docstring: string, body_text: string, visibility: string, decorators: string>"
IMPORT = "struct<module: string, names: array<string>, alias: string, line: bigint, is_from: boolean>"


def parse(files: DataFrame, extractors: Mapping[str, Extractor] | None = None, seconds: float = TIMEOUT) -> DataFrame:
    """(file_id, symbols, imports, errors): one row per row of ``files`` (file_id, path, language, source_text).

    Symbols and imports come from one pass. An error in one text, or a text that takes longer than ``seconds``, is reported in its row
    and stops nothing.
    """
    kind = dict(files.dtypes)["file_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, path, language, text in zip(b["file_id"], b["path"], b["language"], b["source_text"], strict=True):
                o = outline_of(text, language, path or "", extractors, seconds)
                rows.append((key, o.symbols, o.imports, o.errors))
            yield pd.DataFrame(rows, columns=["file_id", "symbols", "imports", "errors"])

    return files.select("file_id", "path", "language", "source_text").mapInPandas(run, f"file_id {kind}, symbols array<{SYMBOL}>, imports array<{IMPORT}>, errors array<string>")


def symbols_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("file_id", F.explode("symbols").alias("s")).select("file_id", "s.*")


def imports_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("file_id", F.explode("imports").alias("i")).select("file_id", "i.*")
