"""Evaluation passages inside training text, found through a positional inverted index.

The index's terms are the items' own grams: ``OWN_GRAM`` words at fixed distances (``SHAPES``: next to
each other or with one replaced word between them) that stand so in one item only. Every passage
that counts for an item covers such a gram, so documents that hold none can't leak, and those that hold
one are candidates, whatever words are replaced; nothing is sampled. Grams are hashed from the words'
hashes at every position of a text, and only those that an item owns are kept. At the candidates the
words are compared, which gives exact phrases and phrases in proximity (a few words replaced, marks
between lines).

Texts aren't shuffled for the search, only gram hits by term and candidates by document; the items' own
grams (bounded by ``MAX_BROADCAST_TERMS``, counted first) are sent to all executors.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Items' own grams up to this number are broadcast; more are joined by a shuffle.
MAX_BROADCAST_TERMS = 1_000_000
#: Equal words of an item that no other item may have at the same distances, for a passage to be the item's.
OWN_GRAM = 5
#: Replaced or inserted words in a row that a passage may contain, and its least share of equal words.
MAX_GAP, MIN_SHARE = 2, 0.7
#: The distances: OWN_GRAM words next to each other or with one replaced word among them. With two, slots of one
#: template that happen to be filled alike would be an item's own.
SHAPES = [(0, *inner, last) for last in range(OWN_GRAM - 1, OWN_GRAM + 1) for inner in combinations(range(1, last), OWN_GRAM - 2)]

_INVISIBLE = "[\\u00ad\\u200b-\\u200f\\u2060\\ufeff]"
_LINE_MARK = r"(?m)^[ \t]*(?:[>#*|+;%~/-]+|[0-9]{1,5}[.):|])+(?=\s)"
_MARKUP = r"</?[A-Za-z][^<>\n]{0,80}>|&(?:[A-Za-z]{2,8}|#[0-9]{1,6});|\\[nrt]"


def plain_words(text: Column) -> Column:
    """``text``'s words in lower case, without markup, line marks, punctuation and invisible characters."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), _INVISIBLE, "")
    t = F.regexp_replace(F.regexp_replace(t, _MARKUP, " "), _LINE_MARK, " ")
    return F.filter(F.split(F.lower(t), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def item_fields(items: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(key, field, words): one row per item and field that has words."""
    one = items.groupBy(key).agg(*[F.max(f).alias(f) for f in fields])
    stacked = one.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("x"))
    return stacked.select(key, "x.field", plain_words(F.col("x.text")).alias("words")).filter(F.size("words") > 1)


# Odd factors of the words' hashes, one for each place of a gram, and bits of the table that is asked before the sorted hashes.
_FACTORS = np.random.default_rng(20250101).integers(1, 1 << 62, OWN_GRAM).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE_BITS = 24


def _gram_stage(keys: list[str], kept=None):
    """Arrow stage: (keys, q, g) of each gram of the column ``hashes``; q: its place * len(SHAPES) + its shape. With ``kept`` (sorted) only those among them, without q."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if kept is not None:
            table = np.zeros(1 << _TABLE_BITS, dtype=bool)
            table[(kept.value.view(np.uint64) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
        for b in batches:
            lists = b.column("hashes")
            h = np.asarray(lists.flatten()).view(np.uint64)
            sizes = np.diff(np.asarray(lists.offsets))
            row = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            times = [h * f for f in _FACTORS]
            at, q, g = [], [], []
            for i, d in enumerate(SHAPES):
                n = len(h) - d[-1]
                if n <= 0:
                    continue
                x = np.full(n, i, dtype=np.uint64)
                for t, o in zip(times, d, strict=True):
                    x += t[o : o + n]
                x ^= x >> np.uint64(32)
                x *= _FACTORS[0]
                inside = row[:n] == row[d[-1] : d[-1] + n]
                if kept is not None:
                    inside &= table[(x >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)]
                where = np.flatnonzero(inside)
                x = x[where].view(np.int64)
                if kept is not None:
                    exact = np.minimum(np.searchsorted(kept.value, x), len(kept.value) - 1)
                    where, x = where[kept.value[exact] == x], x[kept.value[exact] == x]
                at.append(row[where])
                q.append(place[where] * len(SHAPES) + i)
                g.append(x)
            at, q, g = (np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for v in (at, q, g))
            columns = [b.column(k).take(pa.array(at)) for k in keys]
            yield pa.RecordBatch.from_arrays([*columns, *([] if kept is not None else [pa.array(q)]), pa.array(g)], names=[*keys, *([] if kept is not None else ["q"]), "g"])

    return stage


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w)).alias("hashes")


_SHAPE = {shape: i for i, shape in enumerate(SHAPES)}
# Words of the document and of the item passed over: a replaced word, up to three inserted ones (marks between lines), a missing one.
_JUMPS = ((1, 1), (1, 0), (2, 0), (3, 0), (2, 2), (0, 1))


def _aligned(doc: list[str], item: list[str], p: int, q: int) -> list[tuple[int, int]]:
    """The equal words (place in ``doc``, place in ``item``) around the equal words at p and q, in order."""
    chain = [(p, q)]
    for step in (1, -1):
        i, j, pending = p + step, q + step, 0
        while 0 <= i < len(doc) and 0 <= j < len(item):
            if doc[i] == item[j]:
                chain.append((i, j))
                i, j, pending = i + step, j + step, 0
                continue
            # Two equal words must follow, or behind a replaced word one, another replaced word and two more; for a single one, see _ends.
            jump = None
            for a, b in _JUMPS:
                x, y = i + step * a, j + step * b
                if not (0 <= x < len(doc) and 0 <= y < len(item) and doc[x] == item[y]):
                    continue
                ahead = [not (0 <= x + d < len(doc) and 0 <= y + d < len(item)) or doc[x + d] == item[y + d] for d in (step, 2 * step, 3 * step)]
                if ahead[0] or (a == b == 1 and ahead[1] and ahead[2]):
                    jump = (x, y, max(a, b))
                    break
            if jump is None or pending + jump[2] > MAX_GAP + 1:
                break
            i, j, pending = jump[0], jump[1], pending + jump[2]
        chain.sort()
    return chain


def _ends(doc: list[str], item: list[str], chain: list[tuple[int, int]]) -> tuple[int, int]:
    """(equal words, replaced words) that single equal words behind one or two replaced ones add at the ends of ``chain``."""
    equal = gone = 0
    for (i, j), step in ((chain[0], -1), (chain[-1], 1)):
        more = True
        while more:
            more = False
            for a in range(1, MAX_GAP + 1):
                x, y = i + step * (a + 1), j + step * (a + 1)
                if 0 <= x < len(doc) and 0 <= y < len(item) and doc[x] == item[y]:
                    equal, gone, i, j, more = equal + 1, gone + a, x, y, True
                    break
    return equal, gone


def _running(doc: list[str], item: list[str], chain: list[tuple[int, int]], own: set[int], least: int) -> int:
    """The most running words, above ``least``, of a part of ``chain`` with a share of equal words and something of its own; else 0."""

    def spans(lo: int, hi: int) -> tuple[int, int]:
        return chain[hi][0] - chain[lo][0] + 1, chain[hi][1] - chain[lo][1] + 1

    starts = []  # where words of its own begin in the chain: in the document at the item's distances, nothing inserted
    for lo in range(len(chain) - OWN_GRAM + 1):
        gram = chain[lo : lo + OWN_GRAM]
        i, j = gram[0]
        shape = _SHAPE.get(tuple(y - j for _, y in gram))
        if shape is not None and all(x - i == y - j for x, y in gram) and j * len(SHAPES) + shape in own:
            starts.append(lo)
    if not starts:
        return 0
    # Mostly the whole chain will do, or the longest part of it.
    best = least
    for n in range(len(chain), OWN_GRAM - 1, -1):
        for lo in range(len(chain) - n + 1):
            inside = spans(lo, lo + n - 1)
            if min(inside) > best and n >= MIN_SHARE * max(inside) and any(lo <= s <= lo + n - OWN_GRAM for s in starts):
                best = min(inside)
        if n == len(chain) and best > least:
            break
    # Single equal words at the ends lengthen a passage, but are nothing of its own: most are chance, such as an article.
    equal, gone = _ends(doc, item, chain)
    whole = spans(0, len(chain) - 1)
    if equal and len(chain) + equal >= MIN_SHARE * (max(whole) + equal + gone):
        best = max(best, min(whole) + equal + gone)
    return best if best > least else 0


def _passage(doc: list[str], item: list[str], own: set[int]) -> int:
    """The running words of the longest passage of ``item`` in ``doc`` that has something of its own, replaced words included; 0 if there is none.

    ``own``: place in the item * len(SHAPES) + shape, of the OWN_GRAM words that no other item has in that shape.
    """
    at: dict[tuple[str, str], list[int]] = defaultdict(list)
    for q in range(len(item) - 1):
        at[item[q], item[q + 1]].append(q)
    best, done = 0, set()
    for p in range(len(doc) - 1):
        for q in at.get((doc[p], doc[p + 1]), ()):
            if (p, q) not in done:
                chain = _aligned(doc, item, p, q)
                done.update(chain)
                best = max(best, _running(doc, item, chain, own, best))
    return best


def leaked_items(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                 fields: tuple[str, ...] = ("prompt", "answer"), min_words: int = 14) -> DataFrame:
    """(doc_key, item_key, n_words): documents that hold at least ``min_words`` running words of an item.

    Letter case, punctuation, spacing, line marks, markup and a few replaced words don't matter: a replaced word counts
    as one of the running words, an inserted one doesn't.
    A passage counts for an item only if five equal words of it, next to each other or with
    one replaced word between them, stand so in no other item.
    Null and empty texts, items without words, and empty tables give no row; repeated rows of a
    document or an item count once; a document that leaks an item in several places gives one row.
    """
    spark = docs.sparkSession
    fields_df = cut_lineage(item_fields(items, item_key, fields))
    kinds = dict(docs.dtypes)[doc_key], dict(items.dtypes)[item_key]
    grams = fields_df.select(item_key, "field", _hashes(F.col("words"))).mapInArrow(_gram_stage([item_key, "field"]), f"`{item_key}` {kinds[1]}, field string, q long, g long")
    grams = cut_lineage(grams)
    # Which grams belong to one item only.
    single = grams.groupBy("g").agg(F.min(item_key).alias("__lo"), F.max(item_key).alias("__hi")).filter("__lo = __hi").select("g")
    owned = cut_lineage(grams.join(single, "g"))
    own = owned.groupBy(item_key, "field").agg(F.collect_list("q").alias("own"))  # bounded by the item's length
    sides = fields_df.join(own, [item_key, "field"])
    terms = owned.select("g", item_key, "field").distinct()
    few = terms.count() <= MAX_BROADCAST_TERMS
    small = F.broadcast if few else (lambda d: d)
    kept = None
    if few:
        known = np.unique(np.asarray(terms.select("g").distinct().toArrow()["g"], dtype=np.int64))
        if not len(known):
            return spark.createDataFrame([], f"`{doc_key}` {kinds[0]}, `{item_key}` {kinds[1]}, n_words long")
        kept = spark.sparkContext.broadcast(known)

    texts = docs.groupBy(doc_key).agg(F.max(text).alias("__text")).filter(F.length("__text") > 0)
    index = texts.select(doc_key, _hashes(plain_words(F.col("__text")))).mapInArrow(_gram_stage([doc_key], kept), f"`{doc_key}` {kinds[0]}, {'' if few else 'q long, '}g long")
    candidates = index.select(doc_key, "g").join(small(terms), "g").select(doc_key, item_key, "field").distinct()

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = [_passage(list(d), list(w), set(o)) for d, w, o in zip(b["doc_words"], b["words"], b["own"], strict=True)]
            yield pd.DataFrame({doc_key: b[doc_key], item_key: b[item_key], "n_words": n})

    pairs = texts.join(candidates, doc_key).select(doc_key, item_key, "field", plain_words(F.col("__text")).alias("doc_words"))
    rows = pairs.join(small(sides), [item_key, "field"]).select(doc_key, item_key, "doc_words", "words", "own")
    found = rows.mapInPandas(compare, f"`{doc_key}` {kinds[0]}, `{item_key}` {kinds[1]}, n_words long")
    return found.filter(F.col("n_words") >= min_words).groupBy(doc_key, item_key).agg(F.max("n_words").alias("n_words"))
