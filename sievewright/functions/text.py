"""Scalar expressions: token estimates, fingerprints, lines, rendering. All native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 3.4
#: What marks a function's name, or a request's text, as a batch job.
BATCH_NAMES = ["batch", "bulk", "export", "nightly", "report", "sync"]
BATCH_MARKERS = ["batch", "bulk", "cron", "export", "nightly", "report", "sync"]


def tokens(text: Column) -> Column:
    """Estimated tokens: length over 3.4, cut, at least 1; 0 for the empty text."""
    return F.when(text == "", 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / F.lit(CHARS_PER_TOKEN)))).cast("long")


def truncated(text: Column, limit: int) -> Column:
    return F.substring(text, 1, int(limit * CHARS_PER_TOKEN))


def lines(text: Column) -> Column:
    """Lines as the language's own parser counts them: LF, CR LF or CR."""
    return F.split(text, "\r\n|\r|\n")


def source_lines(text: Column) -> Column:
    """The lines of a source file: what follows a final line end is none."""
    return lines(F.regexp_replace(text, r"(\r\n|\r|\n)\z", ""))


def fingerprint(shapes: Column, signature: Column) -> Column:
    """12 hex digits over the sorted distinct shapes, then the sorted distinct signature."""
    return F.substring(F.md5(F.array_join(F.concat(*(F.array_sort(F.array_distinct(x)) for x in (shapes, signature))), "|")), 1, 12)


def named(*columns: str) -> Column:
    """What equal values have in common and others have not: SHA-256 of each column, null apart from the empty text."""
    return F.concat_ws("|", *(F.coalesce(F.sha2(F.col(c).cast("string"), 256), F.lit("-")) for c in columns))


def function_kind(name: Column) -> Column:
    """module, batch or interactive, from the innermost function's name."""
    return F.when(name.isNull(), "module").when(name.rlike("|".join(BATCH_NAMES)), "batch").otherwise("interactive")


def looks_batch(text: Column) -> Column:
    return F.lower(text).rlike("|".join(BATCH_MARKERS))


def tokens_all(texts: Column) -> Column:
    """Estimated tokens of an array of texts."""
    return F.aggregate(F.transform(texts, tokens), F.lit(0).cast("long"), lambda a, n: a + n)


def saved(before: Column, after: Column) -> Column:
    """Share saved in per cent, one decimal; null where there was nothing to save."""
    return F.round((before - after) * 100.0 / F.nullif(before, F.lit(0)), 1)


def rendered(window: Column, first: Column) -> Column:
    """Numbered lines, numbers padded to four places but never cut."""
    line = lambda x, i: F.concat(F.lpad((first + i).cast("string"), F.greatest(F.lit(4), F.length((first + i).cast("string"))), F.lit(" ")), F.lit(" | "), x)
    return F.array_join(F.transform(window, line), "\n")


def described(action: Column, params: Column) -> Column:
    """action(k=v ...) with sorted keys."""
    pairs = F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.concat(action, F.lit("("), F.array_join(pairs, " "), F.lit(")"))


def cost(billable: Column, output: Column, cached: Column, strong: Column) -> Column:
    """US dollars: fixed prices for a million input and output tokens; cached input at half price."""
    into, out = F.when(strong, 2.50).otherwise(0.15), F.when(strong, 10.00).otherwise(0.60)
    return (billable * into + output * out + cached * into * 0.5) / F.lit(1e6)
