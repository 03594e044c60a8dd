"""The subpackage's queries over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.catalogue import tokens_sql
from ..session import table
from . import credentials, distinctive, docpairs, handwritten, leakage, neighbours, parseability, stuffing, tokenization


def one_row(df: DataFrame, key: str, columns: list[str], order: list[str] | None = None) -> DataFrame:
    """One row per key, the greatest by ``order`` and then by the columns."""
    best = F.max(F.struct(*[F.col(c) for c in [*(order or []), *columns]]))
    return df.groupBy(key).agg(best.alias("__b")).select(key, *[F.col(f"__b.{c}").alias(c) for c in columns])


def p2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions with the documentation that describes them."""
    return docpairs.documented_functions(table(spark, sf_dir, "symbols"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions and methods whose documentation describes them."""
    return p2_pairs(spark, sf_dir).select("symbol_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most distinctive term of each probe symbol."""
    symbols = one_row(table(spark, sf_dir, "symbols"), "symbol_id", ["name", "docstring", "body_text"])
    return distinctive.top_terms(symbols, "symbol_id", ["name", "docstring", "body_text"], table(spark, sf_dir, "term_probes"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return tokenization.encode_documents(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of an evaluation item."""
    return leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that don't parse in the language of their extension."""
    return parseability.invalid_files(table(spark, sf_dir, "files"), table(spark, sf_dir, "file_sources")).select("file_id")


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of valid files per project and language."""
    return parseability.acceptance(parseability.parse_files(table(spark, sf_dir, "files"), table(spark, sf_dir, "file_sources")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of symbols of one model of which one is among the five most similar of the other."""
    return neighbours.similar_pairs(table(spark, sf_dir, "symbol_embeddings"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of symbols on which a credential begins."""
    found = credentials.credential_lines(table(spark, sf_dir, "symbols"), table(spark, sf_dir, "files"))
    return found.select("symbol_id", F.col("line").alias("body_line"))


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols with their credentials masked."""
    symbols = one_row(table(spark, sf_dir, "symbols"), "symbol_id", ["file_id", "body_text"])
    return credentials.redacted(symbols, table(spark, sf_dir, "files"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are generated, minified, third-party copies or data blobs."""
    return handwritten.not_handwritten(table(spark, sf_dir, "files"), table(spark, sf_dir, "file_sources")).select("file_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that are mostly repeated keywords, bare links or tags."""
    return stuffing.stuffed_pages(table(spark, sf_dir, "documents")).select("doc_id")


QUERIES = {"p2_found": p2_found, "p2_pairs": p2_pairs, "p3_found": p3_found, "p4_found": p4_found, "p4_rates": p4_rates, "p5_found": p5_found, "p6_found": p6_found, "p6_redacted": p6_redacted, "p7_found": p7_found, "p8_ids": p8_ids, "p9_found": p9_found, "p10_found": p10_found}
_PROBED = tokens_sql("concat_ws(chr(10), name, docstring, body_text)")
ORACLES: dict[str, str] = {
    # The adjustment for the number of tests keeps the strongest term first, so the tail alone decides.
    "p3_found": f"""WITH r AS (SELECT DISTINCT symbol_id, name, docstring, body_text FROM symbols), t AS (SELECT symbol_id, unnest({_PROBED}) AS term FROM r), c AS (SELECT term, count(*) total FROM t GROUP BY term), m AS (SELECT count(*) m FROM t),
      o AS (SELECT symbol_id, term, count(*) k, CAST(sum(count(*)) OVER (PARTITION BY symbol_id) AS BIGINT) n FROM t WHERE symbol_id IN (SELECT symbol_id FROM term_probes) GROUP BY symbol_id, term),
      x AS (SELECT symbol_id, term, total, k, n, m, list_transform(range(k, least(n, total) + 1), lambda i: lgamma(total + 1) - lgamma(i + 1) - lgamma(total - i + 1) + lgamma(m - total + 1) - lgamma(n - i + 1) - lgamma(m - total - n + i + 1)) l FROM o JOIN c USING (term), m),
      p AS (SELECT symbol_id, term, total, list_max(l) + ln(list_sum(list_transform(l, lambda v: exp(v - list_max(l))))) - (lgamma(m + 1) - lgamma(n + 1) - lgamma(m - n + 1)) lp FROM x)
      SELECT symbol_id, term FROM (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY round(lp, 9), total, term) rn FROM p) WHERE rn = 1""",
}
