"""Credentials in source code and configuration: found across a corpus, and masked in place.

1. Literals that could be credentials are extracted where the text is read (a built-in expression
   skips texts without any cue); only the literals are shuffled.
2. They are indexed corpus-wide: a literal that many owners share is a placeholder, and so is one
   that looks like one; what remains is confirmed if it is structured or irregular enough.
3. Every text is scanned again for all confirmed literals with an Aho-Corasick automaton, whatever
   stands around them; so a password also comes out of a comment, a longer string or an address
   without a telling name. A form that several confirmed literals share is looked for likewise, so
   tokens of unpublished formats are found too. Up to ``BLOCK`` literals of ``BLOCK_CHARS`` characters are one automaton,
   broadcast. More than that are joined with the texts by their anchors (an unbroken run of letters and digits of the literal, which
   every text that holds it also has), so that each text gets an automaton of the literals it may hold: still one scan of the
   corpus, whose only broadcast is a bit set of fixed size that says which runs are anchors at all.

Files whose path marks them as a sample, example, template or test fixture hold no findings and
confirm nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Owners (e.g. projects) that share a literal before it counts as a placeholder.
SHARED_BY = 5
#: Confirmed literals, and their characters, up to which one automaton of all of them is broadcast.
BLOCK, BLOCK_CHARS = 100_000, 16_000_000
#: Bits of the set that says which runs of letters and digits are anchors: 16 MB, whatever the number of literals.
ANCHOR_BITS = 27
#: Confirmed literals of one unpublished form from which the form counts as a token format.
FORM_SUPPORT = 3
MASK = "***"

# Published formats of access keys and tokens.
FORMATS = (
    r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    r"gh[oprsu]_[A-Za-z0-9]{36,}",
    r"github_pat_[A-Za-z0-9_]{22,}",
    r"glpat-[A-Za-z0-9_-]{20,}",
    r"[rs]k_live_[A-Za-z0-9]{16,}",
    r"xox[abeoprs]-[A-Za-z0-9-]{10,}",
    r"AIza[A-Za-z0-9_-]{33,}",
    r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    r"npm_[A-Za-z0-9]{36}",
    r"SG\.[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{30,}",
    r"ya29\.[A-Za-z0-9_-]{20,}",
    r"dckr_pat_[A-Za-z0-9_-]{20,}",
    r"pypi-[A-Za-z0-9_-]{30,}",
)
# What the last parts of a name say about its value.
SECRET_WORDS = frozenset("password passwd pwd pass passphrase secret secrets token auth apikey credential credentials passcode".split())
KEY_OWNERS = frozenset("api access signing secret private encryption auth master client account storage service shared session license admin".split())
# Words of placeholders, and forms that refer to a value elsewhere.
PLACEHOLDER = re.compile(
    r"(?i)change_?me|placeholder|example|dummy|sample|your[-_ ]|my[-_]?(?:secret|password|token)|not-a-|fake|replace|insert|redacted|x{4,}|\*{3,}|0{6,}|1234567"
    r"|^(?:todo|none|null|nil|test|secret|password|passw0rd|admin|default|undefined|true|false)$|^<.*>$|^\[.*\]$|^\$|\$\{|\{\{|^%|^env:|^vault:|^file:|^ref[:+]|set-in-ci|^@"
)
SAMPLE_PATH = r"(?i)(?:^|/)(?:samples?|examples?|fixtures?|testdata|test_data|templates?|__fixtures__|demos?)(?:/|$)|\.(?:sample|example|tmpl|template|dist)$"
CONFIG_PATH = r"(?i)(?:^|/)[^/]*\.?env(?:\.[a-z]+)*$|\.(?:json|ya?ml|toml|ini|cfg|conf|properties)(?:\.[a-z]+)*$"

_FORMAT = re.compile(r"(?<![A-Za-z0-9_])(?:" + "|".join(FORMATS) + r")(?![A-Za-z0-9])")
_ADDRESS = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://([^\s/:@\"'`<>]*):([^\s/@\"'`<>]{3,})@[\w.-]+")
_QUERY = re.compile(r"(?i)[?&][\w-]*(?:key|token|secret|passw(?:or)?d|sig(?:nature)?)=([^\s&\"'`#<>]{8,})")
_SCHEME = re.compile(r"(?i)\b(?:bearer|basic|token)\s+([A-Za-z0-9+/_.~=-]{16,})")
_OPTION = re.compile(r"(?i)(?:--?(?:password|passwd|pass|token|secret|api-?key|auth)[ =]|\s-u\s+[\w.-]+:)([^\s\"'`]{6,})")
_INSIDE = re.compile(r"[\"'`]([^\"'`\n]*=[^\"'`\n]*)[\"'`]")
_ASSIGNED = re.compile(r"(?<![\w$?&])([A-Za-z_][\w-]*)=([^\s;&,()\[\]{}<>]{6,})")
_LOGIN = re.compile(r"(?i)\b(?:log_?in|sign_?in|authenticate|connect|basic_?auth|set_?credentials|credentials?|with_?auth)\s*\(\s*([\"'])[^\"'\n]*\1\s*,\s*([\"'])([^\"'\n]{6,})\2")
_PAIR = re.compile(
    r"([A-Za-z_][\w.-]*)[\"']?\]?[^\S\n]*(?::[^\S\n]*[A-Za-z][\w<>\[\], ]*)?(?::=|=>|[:=])"
    r"(?:\s*(?P<q>\"\"\"|[\"'`])(?P<quoted>[^\n]*?)(?P=q)(?P<more>(?:\s*\+?\s*(?:\\\n)?\s*\+\s*[\"'`][^\"'`\n]*[\"'`])*)|[^\S\n]*(?P<bare>[^\s\"'`,;(){}<>]{6,})(?=[^\S\n]*(?:#.*)?$))",
    re.MULTILINE,
)
_DOTTED_WORDS = re.compile(r"(?:[A-Za-z][a-z0-9_-]*(?:[A-Z][a-z0-9]+)*\.)+[A-Za-z][a-z]*(?:[A-Z][a-z0-9]+)*")
_LITERAL = re.compile(r"[\"'`]([^\"'`\n]*)[\"'`]")
_BEGIN = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY(?: BLOCK)?-----(?=(?:\\n|\\r|\s|\"|'|`|[A-Za-z0-9+/]))")
_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

# Cues: a text without any of them can't hold a literal that the extraction accepts. They are wider than the extraction's
# patterns, never narrower: Java's classes are ASCII's, so negated ones hold more than Python's, and blanks are spelt out.
_CUE_WORDS = (
    "AKIA", "ASIA", "gho_", "ghp_", "ghr_", "ghs_", "ghu_", "github_pat_", "glpat-", "k_live_", "xox", "AIza", "eyJ", "npm_", "SG.", "ya29.", "dckr_pat_", "pypi-", "PRIVATE KEY",
)
_WS = r"[\s\p{Z}\x1c-\x1f\x85]"
# Of the parts that is_secret_name knows, each holds one of these in one of three spellings.
_STEMS = "(?:" + "|".join(f"{w}|{w.capitalize()}|{w.upper()}" for w in ("pass", "pwd", "secret", "token", "auth", "key", "credential")) + ")"
_NAMED = (
    rf"(?d)(?m){_STEMS}[^\s\"'`:=\]]*(?:=[^\s;&,()\[\]{{}}<>\"'`]{{6}}"
    rf"|[\"']?\]?{_WS}*(?::{_WS}*[A-Za-z][^\n:=\"'`]*)?(?::=|=>|[:=])(?:{_WS}*[\"'`]|{_WS}*[^\s\"'`,;(){{}}<>]{{6,}}(?={_WS}*(?:#.*)?$)))"
)
_GUARDED = (
    (("://",), r"://[^\s/:@\"'`<>]*:[^\s/@\"'`<>]{3,}@"),
    (("?", "&"), r"(?iu)[?&][^\s=]*(?:key|token|secret|passw(?:or)?d|sig(?:nature)?)=[^\s&\"'`#<>]{8}"),
    (("-",), rf"(?iu)-(?:(?:password|passwd|pass|token|secret|api-?key|auth)[ =]|u{_WS}+[^\s:]+:)[^\s\"'`]{{6}}"),
    ((), rf"(?iu)(?:bearer|basic|token){_WS}+[A-Za-z0-9+/_.~=-]{{16}}"),
    (("(",), rf"(?iu)(?:log_?in|sign_?in|authenticate|connect|credentials?|auth){_WS}*\({_WS}*([\"'])[^\"'\n]*\1{_WS}*,{_WS}*[\"'][^\"'\n]{{6}}"),
)


def has_cue(text: Column) -> Column:
    """Whether a text could hold a credential at all: true wherever ``candidates`` finds one."""
    cue = F.lit(False)
    for w in _CUE_WORDS:
        cue = cue | text.contains(w)
    for words, pattern in _GUARDED:
        guard = F.lit(not words)
        for w in words:
            guard = guard | text.contains(w)
        cue = cue | (guard & text.rlike(pattern))
    return cue | text.rlike(_NAMED)


def is_secret_name(name: str) -> bool:
    """Whether a name's last parts say that its value is a credential: db_password, apiKey; not token_limit."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    while parts and parts[-1].isdigit():
        parts.pop()
    if not parts:
        return False
    return parts[-1] in SECRET_WORDS or (parts[-1] in ("key", "keys") and len(parts) > 1 and parts[-2] in KEY_OWNERS)


def is_irregular(value: str) -> bool:
    """Whether a literal under a secret's name looks like a real value and not like a word, a path or a reference."""
    if len(value) < 8 or any(c.isspace() for c in value) or PLACEHOLDER.search(value) or len(set(value)) < 5:
        return False
    letters, digits = sum(c.isalpha() for c in value), sum(c.isdigit() for c in value)
    if not letters:
        return False
    if _DOTTED_WORDS.fullmatch(value) and (value == value.lower() or not digits):
        return False  # a host or a module
    if re.fullmatch(r"(?:[a-z]+[0-9]*[-.])+(?:example|com|net|org|io|internal|local)(?::[0-9]+)?", value):
        return False
    if re.fullmatch(r"[./~]*(?:[A-Za-z_-]+[/\\])+[A-Za-z_.-]*", value) or re.match(r"[A-Za-z][\w+.-]*://", value):
        return False  # a path or an address
    special = len(value) - letters - digits
    if re.fullmatch(r"[A-Za-z]+(?:[_.-][A-Za-z]+)*", value):
        # Words: only a wild change of case shows a random value.
        turns = sum(a.islower() != b.islower() for a, b in zip(value, value[1:], strict=False) if a.isalpha() and b.isalpha())
        run = re.search("[A-Z]{2}[a-z]|[a-z][A-Z]{2}", value)
        if re.search("[_.-]", value):
            return turns >= 4 or (turns >= 3 and bool(run))
        return turns >= max(4, len(value) // 3) or (turns >= 2 and bool(run) and sum(c in "aeiouAEIOU" for c in value) < 0.34 * len(value))
    return digits > 0 or (special > 0 and value.lower() != value and value.upper() != value)


def _strong(value: str) -> bool:
    """Whether a literal without a telling name is random enough."""
    return len(value) >= 6 and not PLACEHOLDER.search(value) and len(set(value)) >= 5 and (any(c.isdigit() for c in value) or any(c.isupper() for c in value))


def candidates(text: str) -> list[tuple[int, str, str]]:
    """(offset, value, how) of each literal in ``text`` that could be a credential.

    how: key (a private key), format, place (an address, a header, an option), name (quoted, under a
    secret's name), bare (the same without quotes: only configuration has such literals).
    """
    out: dict[int, tuple[str, str]] = {}
    for m in _BEGIN.finditer(text):
        end = _END.search(text, m.end())
        if end and end.start() - m.end() > 40:
            out[m.start()] = (text[m.end() : end.start()], "key")
    for m in _FORMAT.finditer(text):
        tail = m[0][4:]
        if not PLACEHOLDER.search(tail) and len(set(tail)) >= 6:
            out.setdefault(m.start(), (m[0], "format"))
    for m in _ADDRESS.finditer(text):
        if _strong(m[2]) and m[2].lower() not in ("password", "pass", "secret", m[1].lower()):
            out.setdefault(m.start(2), (m[2], "place"))
    for pattern in (_QUERY, _SCHEME, _OPTION):
        for m in pattern.finditer(text):
            value = m[1].rstrip(".,;")
            if _strong(value) and any(c.isalpha() for c in value) and (any(c.isdigit() for c in value) or is_irregular(value)):
                out.setdefault(m.start(1), (value, "place"))
    for m in _LOGIN.finditer(text):
        if is_irregular(m[3]):
            out.setdefault(m.start(3), (m[3], "place"))
    for literal in _INSIDE.finditer(text):
        for m in _ASSIGNED.finditer(literal[1]):
            if is_secret_name(m[1]) and is_irregular(m[2]):
                out.setdefault(literal.start(1) + m.start(2), (m[2], "place"))
    for m in _PAIR.finditer(text):
        if not is_secret_name(m[1]):
            continue
        if m["bare"] is not None:
            if is_irregular(m["bare"]):
                out.setdefault(m.start("bare"), (m["bare"], "bare"))
            continue
        value = m["quoted"]
        if m["more"]:
            joined = value + "".join(_LITERAL.findall(m["more"]))
            if is_irregular(joined):
                at = m.start("more")
                out.setdefault(m.start("quoted"), (value, "name"))
                for part in _LITERAL.finditer(m["more"]):
                    if part[1]:
                        out.setdefault(at + part.start(1), (part[1], "part"))
        elif is_irregular(value):
            out.setdefault(m.start("quoted"), (value, "name"))
    # A literal inside another one is the same finding: the outer begins first.
    kept: list[tuple[int, str, str]] = []
    for at in sorted(out):
        value, how = out[at]
        if kept and at < kept[-1][0] + len(kept[-1][1]) and kept[-1][2] != "key":
            continue
        kept.append((at, value, how))
    return kept


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [
            (key, file, text.count("\n", 0, at) + 1, value, how)
            for key, file, text in zip(b["key"], b["file"], b["text"], strict=True)
            for at, value, how in candidates(text)
        ]
        yield pd.DataFrame(rows, columns=["key", "file", "line", "value", "how"])


def _texts(symbols: DataFrame, key: str, file: str, text: str) -> DataFrame:
    return symbols.select(F.col(key).alias("key"), F.col(file).alias("file"), F.when(F.col(text).contains("\r"), F.regexp_replace(F.col(text), r"\r\n?", "\n")).otherwise(F.col(text)).alias("text")).filter(
        F.col("key").isNotNull() & (F.length("text") > 0)
    )


def _paths(files: DataFrame, file: str, path: str, owner: str, version: str) -> DataFrame:
    latest = files.groupBy(file).agg(F.max(F.struct(version, path, owner)).alias("l"))
    p = F.coalesce(F.col(f"l.{path}"), F.lit(""))
    return latest.select(F.col(file).alias("file"), F.col(f"l.{owner}").alias("owner"), p.rlike(SAMPLE_PATH).alias("sample"), p.rlike(CONFIG_PATH).alias("config"))


def _schema(symbols: DataFrame, key: str, file: str) -> tuple[str, str]:
    kinds = dict(symbols.dtypes)
    return kinds[key], kinds[file]


def confirmed_literals(symbols: DataFrame, files: DataFrame, key: str = "symbol_id", file: str = "file_id", text: str = "body_text",
                       path: str = "path", owner: str = "project", version: str = "last_parsed", shared_by: int = SHARED_BY) -> tuple[DataFrame, DataFrame]:
    """The candidate literals outside samples (key, file, line, value, how) and the confirmed values among them (value)."""
    kinds = _schema(symbols, key, file)
    cued = _texts(symbols, key, file, text).filter(has_cue(F.col("text")))
    found = cued.mapInPandas(_extract, f"key {kinds[0]}, file {kinds[1]}, line long, value string, how string").distinct()
    placed = found.join(_paths(files, file, path, owner, version), "file", "left").filter(~F.coalesce("sample", F.lit(False)))
    placed = placed.filter((F.col("how") != "bare") | F.coalesce("config", F.lit(False)))
    # Owners of each literal: an aggregate over distinct (value, owner) pairs, so a placeholder in every file costs a row a project.
    spread = placed.select("value", F.coalesce(F.col("owner"), F.col("file").cast("string")).alias("o")).distinct().groupBy("value").agg(F.count(F.lit(1)).alias("owners"))
    rare = spread.filter(F.col("owners") < shared_by).select("value")
    return placed.select("key", "file", "line", "value", "how"), rare


def format_of(value: str) -> str | None:
    """The form of a long literal with a short prefix, as a pattern: its prefix, and each part's letters and length."""
    m = re.match(r"[A-Za-z]{2,8}[._-]", value)
    if not m:
        return None
    pattern, size = re.escape(m[0]), 0
    for part in re.split(r"([._-])", value[m.end() :]):
        if part in (".", "_", "-"):
            pattern += re.escape(part)
            continue
        letters = next((c for c in ("[a-z0-9]", "[A-Z0-9]", "[A-Za-z0-9]") if re.fullmatch(c + "+", part)), None)
        if letters is None:
            return None
        pattern, size = f"{pattern}{letters}{{{len(part)}}}", size + len(part)
    return pattern if size >= 16 and any(c.isdigit() for c in value) else None


def _formats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"value": b["value"], "form": [format_of(v) for v in b["value"]]}).dropna()


def scan_entries(confirmed: DataFrame) -> DataFrame:
    """(entry): what the second scan looks for: "=" and a confirmed literal, or "~" and a form that several confirmed literals share.

    So a token whose format nobody published comes out under any name once the corpus has shown the format.
    """
    known = confirmed.select(F.concat(F.lit("="), "value").alias("entry"))
    forms = confirmed.mapInPandas(_formats, "value string, form string").groupBy("form").agg(F.count_distinct("value").alias("n"))
    return known.unionByName(forms.filter(F.col("n") >= FORM_SUPPORT).select(F.concat(F.lit("~"), "form").alias("entry")))


def _scanner(entries: list[str]):
    """An automaton of literals and of the forms' prefixes; each carries its length and the patterns to try."""
    import ahocorasick

    words: dict[str, list[re.Pattern] | None] = {}
    for e in entries:
        if e[0] == "~":
            prefix = re.match(r"~([A-Za-z]+)\\?([._-])", e)
            words.setdefault(prefix[1] + prefix[2], []).append(re.compile(e[1:] + r"(?![A-Za-z0-9])"))
    words |= {e[1:]: None for e in entries if e[0] == "="}
    automaton = ahocorasick.Automaton()
    for w, patterns in words.items():
        automaton.add_word(w, (len(w), patterns))
    automaton.make_automaton()
    return automaton


def _spans(automaton, text: str) -> list[tuple[int, int]]:
    """The places of confirmed literals and forms that aren't part of a longer word, the longer of two that overlap."""
    hits = []
    for end, (n, patterns) in automaton.iter(text):
        start, stop = end - n + 1, end + 1
        if text[start - 1 : start].isalnum() and text[start].isalnum():
            continue
        if patterns is not None:
            stop = max((m.end() for p in patterns if (m := p.match(text, start))), default=0)
            if not stop or PLACEHOLDER.search(text[end + 1 : stop]):
                continue
        elif text[stop : stop + 1].isalnum() and text[stop - 1].isalnum():
            continue
        hits.append((start, stop))
    hits.sort(key=lambda h: (h[0], -h[1]))
    out: list[tuple[int, int]] = []
    for h in hits:
        if not out or h[0] >= out[-1][1]:
            out.append(h)
    return out


def _entries(confirmed: DataFrame) -> tuple[DataFrame, list[str] | None]:
    """The entries of the second scan, and all of them as a list if they are few enough to be one automaton."""
    entries = cut_lineage(scan_entries(confirmed).distinct())
    size = entries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("entry")), F.lit(0)).alias("chars")).first()
    few = size["n"] <= BLOCK and size["chars"] <= BLOCK_CHARS
    return entries, [r["entry"] for r in entries.collect()] if few else None


_RUN = re.compile(r"[^\W_]+")


def _anchor(entry: str) -> str:
    """The longest run of letters and digits of a literal; of a form, its prefix. A text that holds the entry has this run, with nothing before or after it."""
    if entry[0] == "~":
        return re.match(r"~([A-Za-z]+)", entry)[1]
    return max(_RUN.findall(entry[1:]), key=len, default="")


def _run_hash(run: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(run.encode("utf-8", "surrogatepass")) - (1 << 63)


def _anchored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"anchor": [_run_hash(_anchor(e)) for e in b["entry"]], "entry": b["entry"]})


def _entries_of_texts(texts: DataFrame, keys: list[str], text: str, entries: DataFrame) -> DataFrame:
    """(keys, entries): for each text the entries that it may hold, for more entries than one automaton takes.

    Only runs that are in the bit set of anchors are shuffled. An anchor that very many texts have is skewed on the texts' side
    alone: there is one row for each entry on the other.
    """
    spark = texts.sparkSession
    anchored = cut_lineage(entries.mapInPandas(_anchored, "anchor long, entry string"))
    slot = F.col("anchor").bitwiseAND((1 << ANCHOR_BITS) - 1)
    bits = anchored.select(F.shiftright(slot, 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(anchor & 63 AS int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    rows = bits.toArrow()  # at most 2 ** (ANCHOR_BITS - 6) rows
    words = np.zeros(1 << (ANCHOR_BITS - 6), dtype=np.int64)
    words[np.asarray(rows["w"])] = np.asarray(rows["b"])
    known = spark.sparkContext.broadcast(words)

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mask = (1 << ANCHOR_BITS) - 1
        for b in batches:
            at, anchors = [], []
            for i, t in enumerate(b[text]):
                for h in {_run_hash(r) for r in set(_RUN.findall(t))}:
                    if int(known.value[(h & mask) >> 6]) >> (h & 63) & 1:
                        at.append(i)
                        anchors.append(h)
            yield b[keys].iloc[at].assign(anchor=anchors)

    kinds = dict(texts.dtypes)
    hits = texts.select(*keys, text).filter(F.length(text) > 0).mapInPandas(runs, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", anchor long")
    return hits.join(anchored, "anchor").groupBy(*keys).agg(F.collect_set("entry").alias("entries"))


def credential_lines(symbols: DataFrame, files: DataFrame, key: str = "symbol_id", file: str = "file_id", text: str = "body_text", **columns) -> DataFrame:
    """(key, line): each line of each text on which a credential begins; lines count from 1.

    Null and empty texts have none; repeated rows count once; a text whose file isn't known counts as
    no sample. A private key is reported by its BEGIN line. Private keys, pieces of joined literals and literals of fewer than
    8 characters are reported where they were indexed; everything else where the second scan finds it.
    """
    spark = symbols.sparkSession
    placed, rare = confirmed_literals(symbols, files, key, file, text, **columns)
    placed = cut_lineage(placed.join(rare, "value"))
    kinds = _schema(symbols, key, file)
    scanned = F.col("how").isin("format", "place", "name", "bare") & (F.length("value") >= 8)
    direct = placed.filter((F.col("how") != "part") & ~scanned).select("key", "file", "line")
    entries, few = _entries(placed.filter(scanned).select("value").distinct())
    texts = _texts(symbols, key, file, text)
    schema = f"key {kinds[0]}, file {kinds[1]}, line long"

    def found(k, f, t: str, automaton) -> list[tuple]:
        return [(k, f, t.count("\n", 0, s) + 1) for s, _ in _spans(automaton, t)]

    if few is not None:
        everything = spark.sparkContext.broadcast(few)

        def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            automaton = _scanner(everything.value) if everything.value else None
            for b in batches:
                rows = [r for k, f, t in zip(b["key"], b["file"], b["text"], strict=True) for r in found(k, f, t, automaton)] if automaton is not None else []
                yield pd.DataFrame(rows, columns=["key", "file", "line"])

        again = texts.mapInPandas(lines, schema)
    else:

        def own_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = [r for k, f, t, e in zip(b["key"], b["file"], b["text"], b["entries"], strict=True) for r in found(k, f, t, _scanner(list(e)))]
                yield pd.DataFrame(rows, columns=["key", "file", "line"])

        # A key's repeated rows may have different texts: the digest keeps them apart.
        told = texts.withColumn("digest", F.xxhash64("text"))
        mine = _entries_of_texts(told, ["key", "digest"], "text", entries)
        again = told.join(mine, ["key", "digest"]).select("key", "file", "text", "entries").mapInPandas(own_lines, schema)
    again = again.distinct()
    defaults = {"path": "path", "owner": "project", "version": "last_parsed"} | {k: v for k, v in columns.items() if k != "shared_by"}
    outside = again.join(_paths(files, file, **defaults), "file", "left").filter(~F.coalesce("sample", F.lit(False))).select("key", "file", "line")
    return direct.unionByName(outside).select(F.col("key").alias(key), "line").distinct()


def _shortened(text: str) -> list[int]:
    """Where the line ends of two characters stand once each of them is one."""
    return [m.start() - i for i, m in enumerate(re.finditer("\r\n", text))]


def _masked(text: str, automaton, pieces: list[str]) -> str:
    """``text`` with the automaton's hits and whole ``pieces`` masked."""
    # Literals were learned with plain line ends: they are looked for so, and masked where they stand.
    plain, shortened = (re.sub(r"\r\n?", "\n", text), _shortened(text)) if "\r" in text else (text, [])
    spans = _spans(automaton, plain) if automaton is not None else []
    for p in pieces:
        spans += [m.span(1) for m in re.finditer(r"[\"'`](" + re.escape(p) + r")(?=[\"'`])", plain)]
    last = len(plain) + 1
    for s, e in sorted(set(spans), reverse=True):
        if e <= last:
            text = text[: s + bisect_left(shortened, s)] + MASK + text[e + bisect_left(shortened, e) :]
            last = s
    return text


def redacted(symbols: DataFrame, files: DataFrame, key: str = "symbol_id", file: str = "file_id", text: str = "body_text", **columns) -> DataFrame:
    """``symbols`` with every credential in ``text`` replaced by ``MASK``, its quotes and surroundings untouched.

    Texts of sample files, nulls and texts without credentials stay as they are; extra columns are kept. Short pieces of a joined
    literal are masked in the texts they were found in, where they stand between quotes.
    """
    spark = symbols.sparkSession
    placed, rare = confirmed_literals(symbols, files, key, file, text, **columns)
    placed = cut_lineage(placed.join(rare, "value").select("key", "value").distinct())
    entries, few = _entries(placed.filter(F.length("value") >= 6).select("value").distinct())
    pieces = placed.filter(F.length("value") < 6).groupBy(F.col("key").alias("__key")).agg(F.collect_set("value").alias("__pieces"))
    defaults = {"path": "path", "owner": "project", "version": "last_parsed"} | {k: v for k, v in columns.items() if k != "shared_by"}
    samples = _paths(files, file, **defaults).select(F.col("file").alias("__file"), F.col("sample").alias("__sample"))
    out = symbols.join(samples, F.col(file) == F.col("__file"), "left").join(pieces, F.col(key) == F.col("__key"), "left").drop("__file", "__key")
    if few is not None:
        everything = spark.sparkContext.broadcast(few)

        @F.pandas_udf("string")
        def mask(texts: pd.Series, short: pd.Series) -> pd.Series:
            automaton = _scanner(everything.value) if everything.value else None
            return pd.Series([None if t is None else _masked(t, automaton, [] if p is None else list(p)) for t, p in zip(texts, short, strict=True)], dtype=object)

        masked = mask(F.col(text), F.col("__pieces"))
    else:

        @F.pandas_udf("string")
        def mask_own(texts: pd.Series, short: pd.Series, own: pd.Series) -> pd.Series:
            each = zip(texts, short, own, strict=True)
            return pd.Series([None if t is None else _masked(t, None if e is None else _scanner(list(e)), [] if p is None else list(p)) for t, p, e in each], dtype=object)

        plain = F.regexp_replace(F.col(text), r"\r\n?", "\n")
        out = out.withColumn("__digest", F.xxhash64(plain))
        mine = _entries_of_texts(out.select("__digest", plain.alias("__plain")), ["__digest"], "__plain", entries)
        out = out.join(mine.withColumnRenamed("entries", "__entries"), "__digest", "left")
        masked = mask_own(F.col(text), F.col("__pieces"), F.col("__entries"))
    out = out.withColumn(text, F.when(F.coalesce("__sample", F.lit(False)), F.col(text)).otherwise(masked))
    return out.drop("__sample", "__pieces", "__digest", "__entries")
