"""Files that nobody wrote by hand here: generated, minified, third-party copies and data blobs.

The layout statistics of every text are taken where the text is read, by array operations over its bytes, so only a
few numbers per file are shuffled to meet the file's path. Layout, with thresholds per language, judges every file first; what it
can't see (that a well-formed file is a copy, or was generated) is added by the paths of copies and of generated files and by the
comment that opens a file. Samples, fixtures and configuration are hand-written whatever they look like; lock files are generated.
Strings are blanked before layout is measured, so an embedded key or picture makes no file a blob.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Directories and names by which a path shows what a file is.
SAMPLE_PATH = r"(?i)(?:^|/)(?:samples?|examples?|fixtures?|testdata|test_data|templates?|__fixtures__|demos?)(?:/|$)|\.(?:sample|example|tmpl|template|dist)$"
CONFIG_PATH = r"(?i)(?:^|/)\.env[^/]*$|\.(?:json|ya?ml|toml|ini|cfg|conf|env|properties)(?:\.[a-z]+)?$"
COPY_PATH = r"(?i)(?:^|/)(?:node_modules|bower_components|_?vendor|third[_-]party|3rdparty|Godeps|site-packages|jspm_packages)/|(?:^|/)(?:external|deps)/[^/]*-v?[0-9]+(?:\.[0-9]+)+/"
GENERATED_PATH = r"(?i)_pb2(?:_grpc)?\.pyi?$|\.pb(?:\.gw)?\.(?:go|cc|h|rs)$|\.(?:generated|gen|g)\.[a-z]+$|\.designer\.[a-z]+$|(?:^|/)__generated__/|(?:^|/)zz_generated[^/]*$|(?:^|/)migrations/|alembic/versions/|\.d\.ts$|\.min\.(?:js|css|mjs)$"
LOCK_PATH = r"(?i)(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|poetry\.lock|cargo\.lock|go\.sum|composer\.lock|pnpm-lock\.yaml)$"
# What the opening comment of a generated file, or of a copy, says.
GENERATED_MARK = (
    r"(?i)(?:^|[^\w\"'`])@generated\b|<auto-?generated|\bcode generated (?:by|from)\b|\b(?:auto(?:matically)?|machine)[- ]?generated (?:by|from|at|with|using|code|file|source)"
    r"|\b(?:this|the) (?:file|code|source) (?:is|was|has been) (?:auto\w*[- ]?)?generated|\bgenerated (?:by|from|with|using) \S+.{0,60}(?:do not|don't|not) (?:edit|modify|change)|\b(?:edits|changes|modifications)\b[^.;]{0,30}\b(?:are|will be|would be|get) (?:overwritten|lost|discarded|replaced|reverted)|\b(?:file|code|source|module|class|header|stub)s? (?:is|was|were|are|has been|have been) (?:\w+ )?(?:created|produced|emitted|built|compiled|rendered|written|derived|output) (?:by|from|with) \S+|\bedit the (?:template|schema|source|generator|grammar|definition|spec)\w* instead|\bgenerated\b.{0,80}\bdo not (?:edit|modify)"
)
COPY_MARK = (
    r"(?i)\b(?:imported|copied|vendored|taken|borrowed|synced|mirrored|forked|extracted|backported|pulled|adapted) (?:verbatim |unchanged |unmodified )?from \S+.{0,60}\bv?[0-9]+\.[0-9]+|\bupstream (?:copy|version|release|source|file)\b|\blocal (?:changes|modifications|patches)\s*:|\bvendored (?:copy|from|version)\b|\bthird[- ]party (?:code|copy|source)\b|"
    r"\bv?[0-9]+\.[0-9]+(?:\.[0-9]+)?\b.{0,120}(?:\blicen[cs]ed?\b|\(c\)|\bcopyright\b)|(?:\(c\)|\bcopyright\b).{0,80}\bv?[0-9]+\.[0-9]+\.[0-9]+\b"
)

#: The comment that may open a file, after a possible hash-bang line or byte order mark.
_OPENING = re.compile(r"\ufeff?(?:#![^\n]*\n)?((?:\s*+(?://[^\n]*|#(?!include|define|if|pragma|undef|import|!?\[)[^\n]*|/\*.*?\*/|--[^\n]*|<!--.*?-->))+)", re.S)
_STRING = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`"
# A number and the character before it, which is neither a letter, a digit nor a dot.
_NUMBER = r"(?:^|[^\w.])(?:0[xX][0-9a-fA-F]+|[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)[uUlLfF]?\b"
_WORD = r"[A-Za-z_]\w*"
#: Characters from which a run of the base64 and hexadecimal alphabets counts as encoded.
ENCODED_RUN = 48
_ASCII = {name: np.array([chr(i) in chars for i in range(256)]) for name, chars in (
    ("blank", " \t\n\x0b\f\r"), ("alnum", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
)}
_ASCII["encoded"] = _ASCII["alnum"] | np.array([chr(i) in "+/=_-" for i in range(256)])

#: Thresholds per language group: longest line, mean line, share of blanks below which long lines are minified code.
LAYOUT = {"script": (220, 110, 0.14), "style": (220, 110, 0.10), "other": (400, 160, 0.10)}
SCRIPT, STYLE = r"(?i)\.(?:js|mjs|cjs|jsx|ts|tsx)$", r"(?i)\.(?:css|scss|less)$"
#: Shares from which a text is data: number literals among all words and numbers; characters in encoded runs.
NUMBERS, ENCODED, LEAST_CHARS = 0.75, 0.55, 400


#: Bytes of text that a stage handles at a time.
SLICE = 8 << 20
FACTS = {
    "chars": "long", "longest": "long", "mean": "double", "blank": "double", "alnum": "double", "numbers": "long", "words": "long", "encoded": "double", "runs": "long", "marked": "boolean", "copied": "boolean",
}


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes one after the other, and where each begins; one more entry for the end."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8))[offsets[0] : offsets[-1]], offsets - offsets[0]


def _sums(marked: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(marked, dtype=np.int64)])
    return total[starts[1:]] - total[starts[:-1]]


def layout(texts: pa.Array) -> dict[str, np.ndarray]:
    """Each text's statistics; null and empty texts have zeros."""
    t = pc.replace_substring_regex(pc.fill_null(pc.cast(texts, pa.string()), ""), r"\r\n?", "\n")
    blanked = pc.replace_substring_regex(t, _STRING, '""')
    data, starts = _bytes(blanked)
    begins = (data & 0xC0) != 0x80  # of characters
    size = _sums(begins, starts)
    # Lines: from one line end, or one text, to the next.
    ends = data == 10
    edge = np.unique(np.concatenate([starts, np.flatnonzero(ends) + 1]))
    before = np.concatenate([[0], np.cumsum(begins, dtype=np.int64)])
    length = np.diff(before[edge])
    last = edge[1:] - 1
    length = length - ends[last] if len(length) else length
    longest = np.zeros(len(starts) - 1, dtype=np.int64)
    np.maximum.at(longest, np.searchsorted(starts, edge[:-1], side="right") - 1, length)
    n = np.maximum(size, 1)
    # Encoded runs of the text with its strings.
    raw, at = _bytes(t)
    inside = _ASCII["encoded"][raw]
    turns = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    cut = np.unique(np.concatenate([turns, at]))  # runs end where a text ends
    long = (np.diff(cut) >= ENCODED_RUN) & inside[cut[:-1]] if len(cut) > 1 else np.zeros(0, dtype=bool)
    owner = np.searchsorted(at, cut[:-1][long], side="right") - 1
    chars = _sums((raw & 0xC0) != 0x80, at)
    encoded = np.bincount(owner, weights=np.diff(cut)[long], minlength=len(chars)) if len(owner) else np.zeros(len(chars))
    openings = [m[1] if (m := _OPENING.match(x)) else "" for x in t.to_pylist()]
    return {
        "chars": chars, "longest": longest, "mean": size / (_sums(ends, starts) + 1), "blank": _sums(_ASCII["blank"][data], starts) / n, "alnum": _sums(_ASCII["alnum"][data], starts) / n,
        "numbers": np.asarray(pc.count_substring_regex(blanked, _NUMBER), dtype=np.int64), "words": np.asarray(pc.count_substring_regex(blanked, _WORD), dtype=np.int64), "encoded": encoded / np.maximum(chars, 1),
        "runs": np.bincount(owner, minlength=len(chars)), "marked": np.asarray(pc.match_substring_regex(pa.array(openings, pa.string()), GENERATED_MARK)),
        "copied": np.asarray(pc.match_substring_regex(pa.array([" ".join(x.split()) for x in openings], pa.string()), COPY_MARK)),
    }


def _layouts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(b.column("text")), 0), dtype=np.int64)
        part = np.cumsum(sizes) // SLICE
        for lo in np.flatnonzero(np.diff(part, prepend=-1)).tolist():
            piece = b.slice(lo, int(np.searchsorted(part, part[lo], side="right")) - lo)
            yield pa.RecordBatch.from_arrays([piece.column("key"), *map(pa.array, layout(piece.column("text")).values())], names=["key", *FACTS])


def provenance(files: DataFrame, sources: DataFrame, key: str = "file_id", path: str = "path", text: str = "source_text",
               version: str = "last_parsed") -> DataFrame:
    """(key, path, verdict, evidence) for each file: hand, generated, minified, copy or data, and what speaks for it (layout, path, comment).

    The latest row of a file by ``version`` counts; repeated rows count once. A file without a text
    is judged by its path. A null path shows nothing, so the text decides; null keys are left out.
    """
    latest = files.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(version, path)).alias("l")).select(F.col(key).alias("key"), F.col(f"l.{path}").alias("path"))
    stats = sources.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(_layouts, f"key {dict(sources.dtypes)[key]}, " + ", ".join(f"{k} {v}" for k, v in FACTS.items()))
    facts = stats.groupBy("key").agg(F.max(F.struct(*FACTS)).alias("s"))
    both = latest.join(facts, "key", "left").select("key", F.coalesce("path", F.lit("")).alias("path"), "s.*")
    p = F.col("path")

    def limit(i: int) -> Column:
        return F.when(p.rlike(SCRIPT), LAYOUT["script"][i]).when(p.rlike(STYLE), LAYOUT["style"][i]).otherwise(LAYOUT["other"][i])

    long_lines = (F.col("longest") > limit(0)) & ((F.col("mean") > limit(1)) | (F.col("longest") > 0.2 * F.col("chars")))
    minified = long_lines & (F.col("blank") < limit(2)) & (F.col("alnum") < 0.85)
    numbers = (F.col("numbers") / F.greatest(F.col("numbers") + F.col("words"), F.lit(1)) >= NUMBERS) & (F.col("numbers") >= 40)
    data = (F.col("chars") >= LEAST_CHARS) & (numbers | ((F.col("encoded") >= ENCODED) & (F.col("runs") >= 2)))
    by_layout = F.when(F.coalesce(data, F.lit(False)), "data").when(F.coalesce(minified, F.lit(False)), "minified")
    by_path = F.when(p.rlike(COPY_PATH), "copy").when(p.rlike(GENERATED_PATH), "generated")
    by_comment = F.when(F.coalesce("marked", F.lit(False)), "generated").when(F.coalesce("copied", F.lit(False)), "copy")
    written_by_hand = p.rlike(SAMPLE_PATH) | (p.rlike(CONFIG_PATH) & ~p.rlike(LOCK_PATH))
    judged = both.select("key", "path", by_layout.alias("layout"), F.when(p.rlike(LOCK_PATH), "generated").otherwise(by_path).alias("named"), by_comment.alias("comment"), written_by_hand.alias("hand"))
    verdict = F.when(F.col("hand"), "hand").otherwise(F.coalesce("layout", "named", "comment", F.lit("hand")))
    speaks = [F.when(F.col(c).isNotNull() & ~F.col("hand"), name) for c, name in (("layout", "layout"), ("named", "path"), ("comment", "comment"))]
    return judged.select(F.col("key").alias(key), "path", verdict.alias("verdict"), F.array_compact(F.array(*speaks)).alias("evidence"))


def not_handwritten(files: DataFrame, sources: DataFrame, **columns: str) -> DataFrame:
    """(key, verdict, evidence): the files that are generated, minified, copied or data."""
    judged = provenance(files, sources, **columns)
    return judged.filter("verdict <> 'hand'").drop("path")
