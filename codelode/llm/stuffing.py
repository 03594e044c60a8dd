"""Keyword-stuffed pages and link lists, found by how their neighbouring words hang together.

Words and pairs of neighbouring words are counted over the whole corpus (hash aggregates with
map-side combine). Each line of a page gets the mean normalised pointwise mutual information of its
pairs and the share of pairs that the page repeats. Prose lies between two extremes: word salad has
incoherent pairs, stuffing repeats the same collocations again and again. Mutual information alone
can't tell log lines or short headings from salad, so a line counts as spam only if it also has no
sentence structure (few function words), or if it is made of bare links or tags. Code fences, log
lines, tables and links with an explanation are told apart by their form. A page is reported if more
than half of its characters are spam.

Only lines without sentence structure, and lines of long runs of few words, can become spam, so just
their pairs are joined with the corpus counts; the counts themselves cover everything.

Texts are cut into lines and words by Arrow's own functions, batch by batch; what leaves the stage are hashes and counts: each batch's
counts of words and of pairs, added up by one aggregate, and a row of numbers per line with the hashes of its pairs if it is
judged. Its patterns are matched in linear time, whatever the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

# Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    """a about after all also an and any are as at be because been before but by can could did do does each every few for from had has have
    he her here his how i if in into is it its just may me more most must my never no nobody nor not nothing of off on once one only or other our
    out over she should since so some somebody still such than that the their them then there these they this those though to too under until up
    us very was we were what when where which while who why will with without would yet you your
    aber alle alles als am an auch auf aus bei bis da dabei damit danach dann das dass dem den denn der des die diese dieser doch du durch ein
    eine einem einen einer er es etwa falls für gegen haben hat hier ich ihr im in ist jede jeden jeder kann kein keine können man mehr mit
    muss nach nicht noch nur ob oder ohne schon sein seit sie sind so sonst über um und uns unter vom von vor war waren warum was weil wenn werden
    wie wieder wir wird wurde zu zum zur
    à ainsi après au aucun aussi autre aux avant avec avons ce cela ces cet cette chaque comme dans de depuis des donc du elle elles en encore
    est et était être eu fait il ils je la le les leur lorsque lui mais même moins ne ni nous on ont ou où par parce pas peu plus pour pourquoi
    puis que quel qui quoi sa sans se ses si son sont sous sur tant tous tout très trop un une vers vous y
    al ante así aun aunque cada como con cual cuando de del desde donde e el ella en entre era es esa ese eso esta este esto está fue ha hasta
    hay la las le lo los más me mi mientras muy ni no nos o otra otro para pero poco por porque pues que qué se según ser si sin sobre solo son su
    sus también tan tanto todo todos tras un una unos ya yo""".split()
)

#: A line with a lower share of function words, or with fewer words, has no sentence structure.
MIN_FUNCTION_SHARE, MIN_WORDS = 0.2, 4
#: Mean normalised mutual information below which neighbouring words are incoherent.
INCOHERENT = 0.36
#: A pair is repeated if the page has it this often; share of repeated pairs that makes a line stuffed.
REPEATS, STUFFED_SHARE = 4, 0.2
#: A line of so many words, of which no greater share are different, can be stuffed even between function words: with up to
#: ``RUN_VOCABULARY`` different words by one keyword, with more by a phrase.
RUN_WORDS, RUN_VOCABULARY, RUN_DIFFERENT, RUN_REPEATED = 10, 20, 0.75, 0.5
#: Such a line needs a content word with at least this share of its words, and fewer function words than this share.
RUN_KEYWORD, RUN_FUNCTION_SHARE = 0.15, 0.5
#: Share of different words below which a line of four times ``RUN_WORDS`` goes round in circles.
RUN_FEW = 0.15

_FORWARDED = r"(?i)^\s*(?:(?:re|fwd?|aw|wg|tr)\s*:\s*|\(copy\)\s*)+"
_FENCE = r"(?s)(?:^|\n)[ \t]*(?:```|~~~).*?(?:\n[ \t]*(?:```|~~~)[^\n]*|\z)"
_URL = r"(?i)(?:https?://|www\.)[^\s<>\"')\]]+"
_TAG = r"<[^<>\n]*>"
_LOG = r"^\W{0,3}(?:\(?\w{2,5}\)?:?\s+)?\[?(?:\d{4}-\d\d-\d\d[T ])?\d{1,2}:\d\d(?::\d\d)?"
_TABLE = r"^\|.*\|\s*$"
_BARE_LINK = r"(?i)^\W*(?:(?:https?://|www\.)\S+\W*)+$"
_LINK_LABELS = r"(?i)^\W*(?:\d+[.)]\s*)?(?:\[[^\]\n]{0,80}\]\([^)\n]*\)[\s|,;·•»*-]*|<a\s[^<>]*>[^<]{0,80}</a>[\s|,;·•»*-]*)+$"
_HASHTAGS = r"^\W*(?:#[\p{L}\p{N}_]+[\s,;]*){3,}$"
_LABEL, _HASHTAG = r"(?i)\]\(|<a\s", r"#[\p{L}\p{N}_]+"
_HOST = r"(?i)\b(?:[a-z0-9-]+\.)+(?:com|net|org|io|example|info|biz|shop|site|online|dev|co|de|fr|es)\b"
_CODE_LINE = r"^[\t ]*(?:[{}()\[\];]+|.*[;{}]|(?:def|class|func|fn|let|const|var|return|import|from|public|private|if|for|while)\b.*[:;{(].*|[#/*]{1,3}\s?.*|@\w+.*)\s*$"


#: Bytes of text that a stage handles at a time.
SLICE = 8 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about ``SLICE`` bytes; a longer text is a part of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    part = np.cumsum(sizes) // SLICE
    for lo in np.flatnonzero(np.diff(part, prepend=-1)).tolist():
        hi = int(np.searchsorted(part, part[lo], side="right"))
        yield batch.slice(lo, hi - lo)


class _Words:
    """The lines of a batch of texts and their words, as arrays of numbers."""

    def __init__(self, texts: pa.Array) -> None:
        import xxhash

        body = pc.replace_substring_regex(pc.replace_substring_regex(texts, _FENCE, "\n"), r"([.!?] )#", "\\1\n#")
        lines = pc.split_pattern_regex(body, r"[\r\n]+")
        self.page = np.asarray(pc.list_parent_indices(lines))  # of each line
        first = np.searchsorted(self.page, np.arange(len(texts)))
        self.at = np.arange(len(self.page)) - first[self.page]
        self.line = pc.replace_substring_regex(pc.list_flatten(lines), _FORWARDED, "")
        plain = pc.replace_substring_regex(pc.replace_substring_regex(self.line, _URL, " "), _TAG, " ")
        plain = pc.utf8_lower(pc.replace_substring_regex(plain, r"(\p{Ll})(\p{Lu})", r"\1 \2"))
        lists = pc.split_pattern_regex(plain, r"[^\p{L}\p{N}]+")
        words, row = pc.list_flatten(lists), np.asarray(pc.list_parent_indices(lists))
        good = np.asarray(pc.not_equal(words, ""))
        words = pc.replace_substring_regex(words.filter(pa.array(good)), r"^\p{N}+$", "0").dictionary_encode()
        self.row, self.word = row[good], np.asarray(words.indices, dtype=np.int64)  # of each word: its line, its number in this batch
        values = words.dictionary.to_pylist()
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(v) for v in values), dtype=np.uint64, count=len(values))
        self.functions = np.fromiter((v in FUNCTION_WORDS for v in values), dtype=bool, count=len(values))
        self.numbers = np.fromiter((v == "0" for v in values), dtype=bool, count=len(values))
        side_by_side = self.row[1:] == self.row[:-1]
        self.left, self.right = np.flatnonzero(side_by_side), np.flatnonzero(side_by_side) + 1

    def per_line(self, of_words: np.ndarray | None = None) -> np.ndarray:
        """How many words each line has, or how many of those marked."""
        return np.bincount(self.row if of_words is None else self.row[of_words], minlength=len(self.page))

    def pair_hashes(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        a, b = self.hashes[self.word[left]], self.hashes[self.word[right]]
        x = a * _MIX[0] + (b ^ (b >> np.uint64(29))) * _MIX[1]
        return (x ^ (x >> np.uint64(32))).view(np.int64)

    def has(self, pattern: str) -> np.ndarray:
        return np.asarray(pc.match_substring_regex(self.line, pattern))

    def count(self, pattern: str) -> np.ndarray:
        return np.asarray(pc.count_substring_regex(self.line, pattern), dtype=np.int64)

    def judged(self) -> dict[str, np.ndarray]:
        """What is known of each line without the corpus: shape, numbers of words and links, whether it is a long run of few words."""
        n, known = self.per_line(), self.per_line(self.functions[self.word])
        code, times = np.unique(self.row * len(self.hashes) + self.word, return_counts=True)
        row, word = np.divmod(code, max(len(self.hashes), 1))
        different = np.bincount(row, minlength=len(n))
        # The two most frequent content words of each line.
        content = ~(self.functions | self.numbers)[word]
        row, times = row[content], times[content]
        order = np.lexsort((-times, row))
        row, times = row[order], times[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        best, second = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64)
        best[row[rank == 0]], second[row[rank == 1]] = times[rank == 0], times[rank == 1]
        # Keywords come in every clause; a word of repeated sentences comes once in each of them.
        # With more different words, a list of sentences about one thing looks alike, so the keyword must be a phrase of two words.
        keyword = np.where(different <= RUN_VOCABULARY, best, second)
        dense = (n >= RUN_WORDS) & (different <= RUN_DIFFERENT * n) & (keyword >= RUN_KEYWORD * n) & (known < RUN_FUNCTION_SHARE * n)
        # Or a long line turns round very few words.
        round_and_round = (n >= 4 * RUN_WORDS) & (different <= np.minimum(RUN_VOCABULARY, RUN_FEW * n))
        link = self.has(_BARE_LINK) | self.has(_LINK_LABELS) | self.has(_HASHTAGS)
        form = self.has(_LOG) | self.has(_TABLE)
        prose = (known >= MIN_FUNCTION_SHARE * n) & (n >= MIN_WORDS)
        shape = np.select([link, form, prose, self.has(_HOST) & (n <= 12), self.has(_CODE_LINE)], ["link", "form", "prose", "link", "form"], "loose")
        links = np.max([self.count(p) for p in (_URL, _HOST, _LABEL, _HASHTAG)], axis=0)
        run = dense | round_and_round
        return {
            "chars": np.asarray(pc.utf8_length(pc.utf8_trim(self.line, " ")), dtype=np.int64), "n_words": n, "n_links": np.where(shape == "link", links, 0), "shape": shape,
            "doubtful": (shape == "loose") | ((shape == "prose") & run),
        }


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow stage: (pair, h, n): how often the slice has each word (pair false) and each pair of neighbours."""
    for b in batches:
        for s in _slices(b, "__t"):
            w = _Words(s.column("__t"))
            pairs, times = np.unique(w.pair_hashes(w.left, w.right), return_counts=True)
            n = np.bincount(w.word, minlength=len(w.hashes))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(n) + len(pairs)) >= len(n)), pa.array(np.concatenate([w.hashes.view(np.int64), pairs])), pa.array(np.concatenate([n, times]).astype(np.int64))], names=["pair", "h", "n"]
            )


def _lists(values: list[np.ndarray], starts: np.ndarray) -> list[pa.Array]:
    return [pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(v)) for v in values]


def _line_stage(key: str):
    """Arrow stage: a row per line, with the hashes of its different pairs and their words if it is judged by them."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in _slices(b, "__t"):
                w = _Words(s.column("__t"))
                facts = w.judged()
                doubtful = facts.pop("doubtful")
                inside = doubtful[w.row[w.left]]
                left, right = w.left[inside], w.right[inside]
                h, row = w.pair_hashes(left, right), w.row[left]
                order = np.lexsort((h, row))
                h, row, left, right = h[order], row[order], left[order], right[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                first = np.flatnonzero(new)
                k = np.diff(first, append=len(h)).astype(np.int64)
                starts = np.searchsorted(row[first], np.arange(len(w.page) + 1))
                words = w.hashes.view(np.int64)
                whole = np.asarray(pc.utf8_length(s.column("__t")), dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [s.column(key).take(pa.array(w.page)), pa.array(whole[w.page]), pa.array(w.at.astype(np.int32)), *[pa.array(v) for v in facts.values()],
                     *_lists([h[first], words[w.word[left[first]]], words[w.word[right[first]]], k], starts)],
                    names=[key, "__all", "at", *facts, "pair", "a", "b", "k"],
                )

    return stage


def line_scores(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, at, chars, n_words, n_links, spam): each line of each page with whether it is spam; lines of prose, code, logs and tables are not."""
    one = docs.groupBy(key).agg(F.max(text).alias("__t")).filter(F.trim("__t") != "")
    kind = dict(docs.dtypes)[key]
    # Written once, read by the pairs and by the verdicts. No texts are written, and no words but as hashes.
    lines = written(
        one.mapInArrow(_line_stage(key), f"`{key}` {kind}, __all long, at int, chars long, n_words long, n_links long, shape string, pair array<long>, a array<long>, b array<long>, k array<long>")
    )
    # Corpus counts: every line of every page.
    counts = one.select("__t").mapInArrow(_counts, "pair boolean, h long, n long").groupBy("pair", "h").agg(F.sum("n").alias("n"))
    counts = written(counts)
    words, pairs = counts.filter("NOT pair").select("h", "n"), counts.filter("pair").select(F.col("h").alias("pair"), F.col("n").alias("n_pair"))
    totals = counts.agg(F.sum(F.when(~F.col("pair"), F.col("n"))).alias("n_words"), F.sum(F.when(F.col("pair"), F.col("n"))).alias("n_pairs"))  # one row

    own = lines.select(key, "at", F.explode(F.arrays_zip("pair", "a", "b", "k")).alias("x")).select(key, "at", "x.*")
    counted = (
        own.join(pairs, "pair")
        .join(words.select(F.col("h").alias("a"), F.col("n").alias("n_a")), "a")
        .join(words.select(F.col("h").alias("b"), F.col("n").alias("n_b")), "b")
        .crossJoin(F.broadcast(totals))
    )
    p = F.col("n_pair") / F.col("n_pairs")
    information = F.log(p * F.col("n_words") * F.col("n_words") / (F.col("n_a") * F.col("n_b"))) / F.greatest(-F.log(p), F.lit(1e-9))
    in_page = own.groupBy(key, "pair").agg(F.sum("k").alias("in_page"))
    scores = (
        counted.select(key, "at", "pair", "k", information.alias("npmi"))
        .join(in_page, [key, "pair"])
        .groupBy(key, "at")
        .agg(
            (F.sum(F.col("k") * F.col("npmi")) / F.sum("k")).alias("coherence"),
            (F.sum(F.when(F.col("in_page") >= REPEATS, F.col("k")).otherwise(0)) / F.sum("k")).alias("repeated"),
        )
    )
    judged = lines.drop("pair", "a", "b", "k").join(scores, [key, "at"], "left")
    loose = (F.col("shape") == "loose") & (F.col("coherence").isNull() | (F.col("coherence") < INCOHERENT) | (F.col("repeated") >= STUFFED_SHARE))
    stuffed = (F.col("shape") == "prose") & (F.col("repeated") >= RUN_REPEATED)
    return judged.select(key, "__all", "at", "chars", "n_words", "n_links", "shape", "coherence", "repeated", ((F.col("shape") == "link") | loose | F.coalesce(stuffed, F.lit(False))).alias("spam"))


def stuffed_pages(docs: DataFrame, key: str = "doc_id", text: str = "text", share: float = 0.5) -> DataFrame:
    """(key, spam_share): pages more than ``share`` of whose text is repeated keywords, bare links or tags.

    Null, empty and blank texts, and empty tables, give no row; a repeated row counts once. The share
    is of all characters outside blanks at line ends, code included. A single heading is not enough:
    a page needs at least 12 words, three links or tags, or 80 characters in its spam.
    """
    scored = line_scores(docs, key, text)
    # Fenced code counts as text that is not spam: what the lines don't have of the page.
    page = scored.groupBy(key).agg(
        F.sum(F.when(F.col("spam"), F.col("chars")).otherwise(0)).alias("bad"),
        F.sum(F.when(F.col("spam"), F.col("n_words")).otherwise(0)).alias("bad_words"),
        F.sum(F.when(F.col("spam"), F.col("n_links")).otherwise(0)).alias("bad_links"),
        F.sum("chars").alias("seen"),
        F.max("__all").alias("whole"),
        F.max("at").alias("breaks"),
    )
    denominator = F.greatest(F.col("seen"), F.col("whole") - F.col("breaks") * 2)
    enough = (F.col("bad") >= 80) | (F.col("bad_words") >= 12) | (F.col("bad_links") >= 3)
    return page.filter((F.col("bad") > share * denominator) & enough).select(key, (F.col("bad") / denominator).alias("spam_share"))
