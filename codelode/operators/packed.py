"""Several values packed in one field, whatever the writer's delimiters and quoting.

One pass of built-in expressions, no shuffle, no Python: quoted spans are cut out and replaced by
indexed placeholders, the rest is split at the delimiters, and each placeholder is looked up in the
array of spans again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let

#: Delimiters between values, as the inside of a regular expression's character class.
DELIMITERS = r",;|\t\r\n"
#: Whole fields that stand for "no values" (compared trimmed and in lower case).
NO_VALUES = ("", "-", "--", "(none)", "none", "null", "nil", "n/a", "na", "[]", "{}", "()", "nan")

# The placeholder is OPEN index CLOSE; an OPEN in the data itself becomes OPEN ESCAPE before, so the two can't collide.
_OPEN, _CLOSE, _ESCAPE = "\ue000", "\ue001", "\ue002"

# In a bracketed list, quotes are closed by the same quote and the backslash escapes.
_LIST_SPAN = r""""[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+'"""
_IS_LIST = r"""(?s)^\[\s*+(?:["'].*)?\]$"""


def _plain_span(delimiters: str) -> str:
    """A quoted value outside lists: it fills its entry, and a doubled quote stands for one."""
    before, after = rf"(?<![^{delimiters}])[ ]*+", rf"(?=[ ]*+(?:[{delimiters}]|\z))"
    quoted = r"""(?:"[^"]*+(?:""[^"]*+)*+"|'[^']*+(?:''[^']*+)*+')"""
    return before + quoted + after


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s ]+|[\s ]+$", "")


def _unquoted_in_list(span: Column) -> Column:
    """A list's quoted string without quotes and escapes; JSON's rules, or plain removal of backslashes."""
    inner = F.substring(span, F.lit(2), F.length(span) - 2)
    inner = F.when(span.startswith("'"), F.replace(F.replace(inner, F.lit("\\'"), F.lit("'")), F.lit('"'), F.lit('\\"'))).otherwise(inner)
    parsed = F.from_json(F.concat(F.lit('["'), inner, F.lit('"]')), "array<string>")
    return F.coalesce(F.get(parsed, F.lit(0)), F.regexp_replace(F.substring(span, F.lit(2), F.length(span) - 2), r"\\(.)", "$1"))


def _unquoted_plain(span: Column) -> Column:
    span = _trimmed(span)
    inner = F.substring(span, F.lit(2), F.length(span) - 2)
    return F.when(span.startswith('"'), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(F.replace(inner, F.lit("''"), F.lit("'")))


def packed_values(field: Column, delimiters: str = DELIMITERS, no_values: Sequence[str] = NO_VALUES) -> Column:
    """``field``'s values in their order as an array of strings.

    Null, blank fields and fields that stand for "no values" give an empty array. Empty entries are
    skipped and take no position. Quotes count only where they enclose a whole entry, so paths with
    apostrophes stay whole. A bracketed list of quoted strings may use JSON's or Python's escapes.
    """
    marker = rf"^{_OPEN}([0-9]+){_CLOSE}$"

    def masked(pieces: Column) -> Column:
        return F.array_join(
            F.transform(
                pieces,
                lambda p, i: F.concat(
                    F.when(i > 0, F.concat(F.lit(_OPEN), (i - 1).cast("string"), F.lit(_CLOSE))).otherwise(F.lit("")),
                    F.replace(p, F.lit(_OPEN), F.lit(_OPEN + _ESCAPE)),
                ),
            ),
            "",
        )

    def entries(body: Column, pattern: str, unquote) -> Column:
        def restored(spans: Column) -> Column:
            def one(e: Column) -> Column:
                index = F.regexp_extract(e, marker, 1)
                plain = F.replace(e, F.lit(_OPEN + _ESCAPE), F.lit(_OPEN))
                return F.when(index != "", _trimmed(unquote(F.get(spans, F.when(index != "", index).cast("int"))))).otherwise(plain)

            split = F.transform(F.split(masked(F.split(body, pattern, -1)), f"[{delimiters}]", -1), _trimmed)
            return F.filter(F.transform(F.filter(split, lambda e: e != ""), one), lambda e: e != "")

        return let(F.regexp_extract_all(body, F.lit(pattern), F.lit(0)), restored)

    def values(text: Column) -> Column:
        inner = F.substring(text, F.lit(2), F.length(text) - 2)
        return (
            F.when(F.lower(text).isin(*no_values), F.array().cast("array<string>"))
            .when(text.rlike(_IS_LIST), entries(inner, _LIST_SPAN, _unquoted_in_list))
            .otherwise(entries(text, _plain_span(delimiters), _unquoted_plain))
        )

    return let(_trimmed(F.coalesce(field, F.lit(""))), values)


def unpack(df: DataFrame, field: str, value: str = "value", pos: str = "pos", keep: Sequence[str] | None = None, delimiters: str = DELIMITERS) -> DataFrame:
    """One row per packed value of ``field``: the kept columns, ``pos`` counted from 1, ``value``.

    Nulls, blank fields and markers of "no values" give no row; a value listed twice gives two rows;
    repeated input rows are kept, as the operator has no key. Columns of ``df`` that are called like
    ``pos`` or ``value`` must not be kept.
    """
    keep = [c for c in df.columns if c not in (field, pos, value)] if keep is None else list(keep)
    packed = df.select(*[F.col(f"`{c}`") for c in keep], packed_values(F.col(f"`{field}`"), delimiters).alias("__packed"))
    return packed.select(*[F.col(f"`{c}`") for c in keep], F.posexplode("__packed").alias("__at", value)).select(
        *[F.col(f"`{c}`") for c in keep], (F.col("__at").cast("long") + 1).alias(pos), F.col(value)
    )


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per key: the ``columns`` of the row that is largest by ``order`` and then by the columns themselves.

    An aggregate with map-side combine, so a hot key costs one row a task in the shuffle. Rows with
    a null key are kept as a group of their own.
    """
    best = F.max(F.struct(*[F.col(c) for c in [*order, *columns]]))
    return df.groupBy(*keys).agg(best.alias("__best")).select(*keys, *[F.col(f"__best.{c}").alias(c) for c in columns])
