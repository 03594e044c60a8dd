"""Recursive-descent parsers that say whether a source text is valid in its language."""

from __future__ import annotations

from .braces import C, Go, Java, Rust
from .core import CONFLICT, Parser
from .modern import Kotlin, Php, Solidity, Swift, Zig
from .ruby import Ruby
from .python import Python
from .script import Script, TypeScript, TypeScriptJsx

#: Language and parser of each file extension.
LANGUAGES: dict[str, tuple[str, type[Parser]]] = {
    ".py": ("python", Python),
    ".pyi": ("python", Python),
    ".rs": ("rust", Rust),
    ".ts": ("typescript", TypeScript),
    ".tsx": ("typescript", TypeScriptJsx),
    ".js": ("javascript", Script),
    ".jsx": ("javascript", Script),
    ".mjs": ("javascript", Script),
    ".cjs": ("javascript", Script),
    ".c": ("c", C),
    ".h": ("c", C),
    ".go": ("go", Go),
    ".java": ("java", Java),
    ".rb": ("ruby", Ruby),
    ".rake": ("ruby", Ruby),
    ".gemspec": ("ruby", Ruby),
    ".php": ("php", Php),
    ".phtml": ("php", Php),
    ".kt": ("kotlin", Kotlin),
    ".kts": ("kotlin", Kotlin),
    ".swift": ("swift", Swift),
    ".zig": ("zig", Zig),
    ".sol": ("solidity", Solidity),
}


def errors_of(text: str | None, extension: str) -> list[tuple[int, str]]:
    """(line, message) of every syntax error, the first cause first; later ones may have the line 0.

    Missing, empty and blank texts are valid, and so are texts of other languages.
    """
    if not text or not text.strip() or extension.lower() not in LANGUAGES:
        return []
    return LANGUAGES[extension.lower()][1](text.replace("\r\n", "\n").replace("\r", "\n")).parse()


__all__ = ["CONFLICT", "LANGUAGES", "errors_of"]
