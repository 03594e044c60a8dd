"""Explicit schemas of the tables; nothing is inferred."""

from __future__ import annotations

FILES = "file_id long, project string, path string, sha256 string, language string, line_count long, byte_size long, last_parsed double, is_entry boolean"
FILE_TAGS = "file_id long, tag string"
SYMBOLS = (
    "symbol_id long, file_id long, name string, qualified string, kind string, line_start long, line_end long, signature string, docstring string, body_text string, visibility string, decorators string"
)
IMPORTS = "file_id long, module string, names array<string>, alias string, line long, is_from boolean"
EDGES = "source_id long, target_id long, kind string, weight double, metadata string"
UNRESOLVED_IMPORTS = "file_id long, import_path string, line long, reason string"
SESSION_ACTIONS = "session_id string, action string, target string, symbol string, ts double, metadata string"
QUERY_HISTORY = "query_id long, query_text string, result_files string, confidence string, session_id string, logged_at double"
NOTES = "content string, type string, tags string, files string, created_at double, expires_at double, session_id string"
CONCEPTS = "concept_id long, name string, kind string, summary string, body string, confidence double, created_at double, updated_at double, session_id string"
CONCEPT_EDGES = "source_id long, target_id long, relation string, weight double, created_at double"
SYMBOL_EMBEDDINGS = "symbol_id long, file_id long, model string, dim int, vector array<float>"

# What kinds, relations and confidences there are.
SYMBOL_KINDS = ("function", "class", "method", "module")
EDGE_KINDS = ("contains", "imports", "references", "calls")
NOTE_TYPES = ("decision", "task", "next", "fact", "blocker", "locked")
CONCEPT_KINDS = ("concept", "pattern", "convention", "risk", "glossary", "architecture", "decision", "invariant")
CONCEPT_RELATIONS = ("related_to", "depends_on", "contradicts", "refines", "example_of", "implements", "replaces", "used_by")
CONFIDENCES = ("high", "medium", "low")
