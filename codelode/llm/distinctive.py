"""How distinctive a term is for a record: hypergeometric enrichment against the whole collection.

A record of n term occurrences is a draw from the M occurrences of the collection, K of which are of
the term. The score of a term that occurs k times is the negative logarithm (base 10) of the exact
upper tail P(X >= k), adjusted for the number of terms tested in the record (Benjamini-Hochberg). A
term that every record uses scores near 0; a rare one that this record repeats scores high.

Corpus counts are taken over *words* first (one hash aggregate with map-side combine: its shuffle
grows with the vocabulary, not with the text), and only distinct words are split into identifier
parts. The log-gamma sums are vectorised over all (record, term) rows of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters, digits and the underscore make words; everything else separates them.
_BETWEEN_WORDS = r"[^\p{L}\p{N}_]+"
# Parts of a word: underscores, aB, ABc, a1 and 1a.
_BETWEEN_PARTS = r"_+|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[a-zA-Z])(?=[0-9])|(?<=[0-9])(?=[a-zA-Z])"
#: Terms of the tail's sum that are evaluated at a time.
_CHUNK = 64


def words_of(text: Column) -> Column:
    """The words of ``text`` of two or more characters."""
    return F.filter(F.split(text, _BETWEEN_WORDS), lambda w: F.length(w) > 1)


def parts_of(word: Column) -> Column:
    """A word's identifier parts, in lower case; single letters are dropped, single digits kept."""
    return F.filter(F.transform(F.split(word, _BETWEEN_PARTS), F.lower), lambda p: (F.length(p) > 1) | p.rlike("^[0-9]$"))


def record_text(df: DataFrame, fields: Sequence[str]) -> Column:
    """The record's fields joined by a line end; nulls count as empty."""
    return F.concat_ws("\n", *[F.col(f"`{f}`") for f in fields])


def _word_counts(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    words = df.select(*keys, F.explode(words_of(record_text(df, fields))).alias("__word"))
    return words.groupBy(*keys, "__word").agg(F.count(F.lit(1)).alias("__n"))


def term_counts(df: DataFrame, fields: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, term, n): how often each term occurs in each group of records, or in all."""
    counts = _word_counts(df, keys, fields)
    return counts.select(*keys, "__n", F.explode(parts_of(F.col("__word"))).alias("term")).groupBy(*keys, "term").agg(F.sum("__n").alias("n"))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma(x) for x > 0: Stirling's series after shifting small arguments upwards."""
    x = np.array(x, dtype=np.float64)
    shift = np.zeros_like(x)
    small = x < 10
    while small.any():
        shift[small] += np.log(x[small])
        x[small] += 1
        small = x < 10
    inverse, square = 1 / x, 1 / (x * x)
    series = inverse * (1 / 12 - square * (1 / 360 - square * (1 / 1260 - square * (1 / 1680 - square / 1188))))
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series - shift


def _log_choose(n: np.ndarray, k: np.ndarray) -> np.ndarray:
    return log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)


def upper_tail_log10(k: np.ndarray, n: np.ndarray, big_k: np.ndarray, big_m: np.ndarray) -> np.ndarray:
    """-log10 P(X >= k) of the hypergeometric distribution, element by element; exact sums.

    k of n draws are of the term, which holds ``big_k`` of ``big_m`` occurrences. The tail is summed
    from k upwards until its terms vanish against the sum, so no case is cut off.
    """
    k, n, big_k, big_m = (np.asarray(v, dtype=np.float64) for v in (k, n, big_k, big_m))
    if not k.size:
        return np.zeros(0)
    low = np.maximum(k, np.maximum(0.0, n + big_k - big_m))
    high = np.minimum(n, big_k)
    first = _log_choose(big_k, low) + _log_choose(big_m - big_k, n - low) - _log_choose(big_m, n)
    # Ratios of neighbouring terms: f(i+1)/f(i) = (K-i)(n-i) / ((i+1)(M-K-n+i+1)).
    total, term, i = np.ones_like(k), np.ones_like(k), low.copy()
    at = np.flatnonzero(i < high)
    while at.size:
        for _ in range(_CHUNK):
            j = i[at]
            term[at] *= (big_k[at] - j) * (n[at] - j) / ((j + 1) * (big_m[at] - big_k[at] - n[at] + j + 1))
            total[at] += term[at]
            i[at] = j + 1
            # Terms may grow until the mode; only a falling, vanishing term ends the sum.
            falling = (big_k[at] - j - 1) * (n[at] - j - 1) < (j + 2) * (big_m[at] - big_k[at] - n[at] + j + 2)
            at = at[(i[at] < high[at]) & ~((term[at] < total[at] * 1e-17) & falling)]
            if not at.size:
                break
        large = at[total[at] > 1e250] if at.size else at
        if large.size:
            first[large] += np.log(total[large])
            term[large] /= total[large]
            total[large] = 1.0
    return np.maximum(0.0, -(first + np.log(total)) / np.log(10))


def _tails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        b["raw"] = upper_tail_log10(b["n"].to_numpy(), b["size"].to_numpy(), b["total"].to_numpy(), b["corpus"].to_numpy())
        yield b


def term_scores(df: DataFrame, key: str, fields: Sequence[str], probes: DataFrame | None = None) -> DataFrame:
    """(key, term, n, total, score) for each term of each record, or of the records in ``probes``.

    Counts always cover all of ``df``. ``key`` must be unique in ``df`` (see the caller's
    deduplication); rows with a null key belong to one record. A record without terms, and an empty
    table, give no row. Ties in the score stay; order by score and then by term for a fixed choice.
    """
    corpus = term_counts(df, fields).withColumnRenamed("n", "total")
    scored = df if probes is None else df.join(probes.select(key).distinct(), key, "left_semi")
    own = term_counts(scored, fields, [key])
    size = own.groupBy(key).agg(F.sum("n").alias("size"))
    # One row: the number of occurrences in the collection.
    whole = corpus.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("corpus"))
    rows = own.join(corpus, "term").join(size, key).crossJoin(F.broadcast(whole)).select(key, "term", "n", "size", "total", "corpus")
    kind = dict(rows.dtypes)[key]
    raw = rows.mapInPandas(_tails, f"`{key}` {kind}, term string, n long, size long, total long, corpus long, raw double")
    # Benjamini-Hochberg inside the record: the p-value times tests/rank, made monotone from the weakest upwards.
    from pyspark.sql import Window

    strongest = Window.partitionBy(key).orderBy(F.desc("raw"), "term")
    weaker = Window.partitionBy(key).orderBy(F.desc("raw"), "term").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    tests = F.count(F.lit(1)).over(Window.partitionBy(key))
    ranked = raw.withColumn("__adjusted", F.col("raw") - F.log10(tests / F.row_number().over(strongest)))
    return ranked.select(key, "term", "n", "total", "raw", F.greatest(F.lit(0.0), F.max("__adjusted").over(weaker)).alias("score"))


def top_terms(df: DataFrame, key: str, fields: Sequence[str], probes: DataFrame | None = None) -> DataFrame:
    """(key, term): the most distinctive term of each record; ties go to the rarer, then to the first by name."""
    from pyspark.sql import Window

    best = Window.partitionBy(key).orderBy(F.desc("score"), F.desc("raw"), "total", "term")
    return term_scores(df, key, fields, probes).withColumn("__at", F.row_number().over(best)).filter("__at = 1").select(key, "term")
