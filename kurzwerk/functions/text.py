"""Column expressions on text: cleaning, splitting, counting. All run in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the text rules.
HYPHEN_BREAK = "-\n(?=[a-zäöüß])"
NEWLINE_RUN = "\n+"
BLANK_RUN = "[ \t]{2,}"
# Unicode white space; the possessive forms and the look-behind keep both ends linear.
SPACE = r"(?U)[\s\x1c-\x1f]"
EDGE_SPACE = r"(?U)\A[\s\x1c-\x1f]++|(?<![\s\x1c-\x1f])[\s\x1c-\x1f]++\z"
VISIBLE = r"(?U)[^\s\x1c-\x1f]"
SENTENCE_GAP = r"(?U)(?<=[.!?])[\s\x1c-\x1f]+"
WORD = r"[\p{L}\p{N}_]+"
UNIT = "[^ ]+"
ROUGE_TOKEN = "[a-z0-9]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also inside nested lambdas."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends; texts without any are not searched."""

    def cut(t: Column) -> Column:
        ends = F.concat(F.left(t, F.lit(1)), F.right(t, F.lit(1)))
        return F.when(ends.rlike(SPACE), F.regexp_replace(t, EDGE_SPACE, "")).otherwise(t)

    return let(text, cut)


def is_visible(text: Column) -> Column:
    """True unless the text is empty or all white space; stops at the first other character."""
    return text.rlike(VISIBLE)


def clean_text(raw: Column) -> Column:
    """Undo extraction artefacts: CR, hyphen breaks, newlines, blank runs, edges."""
    text = F.replace(raw, F.lit("\r"), F.lit(" "))
    text = F.regexp_replace(text, HYPHEN_BREAK, "")
    text = F.regexp_replace(text, NEWLINE_RUN, " ")
    text = F.regexp_replace(text, BLANK_RUN, " ")
    return strip(text)


def n_chars(text: Column) -> Column:
    """Number of code points."""
    return F.length(text).cast("bigint")


def word_tokens(text: Column) -> Column:
    """Lower-case words (letters, digits, underscore)."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def rouge_tokens(text: Column) -> Column:
    """Lower-case ASCII alphanumeric runs."""
    return F.regexp_extract_all(F.lower(text), F.lit(ROUGE_TOKEN), F.lit(0))


def sentences(text: Column) -> Column:
    """Pieces between white space that follows a full stop, ``!`` or ``?``."""
    return F.split(text, SENTENCE_GAP, -1)


def units(text: Column) -> Column:
    """Blank-separated units, the built-in measure of model tokens."""
    return F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))


def blank_count(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))


def unit_count(text: Column) -> Column:
    """Number of units; one more than the blanks where these stand single and inside."""
    single = (
        ~F.contains(text, F.lit("  "))
        & ~F.startswith(text, F.lit(" "))
        & ~F.endswith(text, F.lit(" "))
        & (text != "")
    )
    return F.when(single, blank_count(text) + 1).otherwise(F.regexp_count(text, F.lit(UNIT)))


def first_units(text: Column, limit: int) -> Column:
    """The text itself, or its first ``limit`` units when it has more."""
    return (
        F.when(blank_count(text) < limit, text)
        .when(unit_count(text) <= limit, text)
        .otherwise(F.array_join(F.slice(units(text), 1, limit), " "))
    )


def truncate_units(text: Column, limit: int = 1024, n_special: int = 2) -> Column:
    """Model-side cut: STRUCT(text, truncated).

    ``n_special`` is the number of marker tokens the model adds itself, which
    count towards ``limit``; reaching the limit exactly also sets the flag.
    """
    return F.struct(
        first_units(text, limit - n_special).alias("text"),
        (unit_count(text) + n_special >= limit).alias("truncated"),
    )


def truncate_chars(text: Column, limit: int = 4000) -> Column:
    return F.substring(text, 1, limit)


def percent_text(share: Column) -> Column:
    return F.when(share.isNotNull(), F.format_string("%.0f %%", share * 100))


def python_round(value: Column, digits: int) -> Column:
    """Round a DOUBLE as Python does: the exact binary value decides, ties go to even.

    The product ``value * 10^digits`` is taken with its rounding error (split
    product), so a decimal tie that binary cannot hold falls on the right side.
    Meant for magnitudes far below 2^53 / 10^digits.
    """
    scale = float(10**digits)

    def shifted(x: Column) -> Column:
        big = x * F.lit(134217729.0)
        high = big - (big - x)
        low = x - high
        product = x * scale
        error = (high * scale - product) + low * scale
        nearest = F.rint(product)
        gap = product - nearest
        tie = F.abs(gap) == 0.5
        return (
            F.when(tie & (error > 0), F.floor(product) + 1.0)
            .when(tie & (error < 0), F.floor(product) + 0.0)
            .otherwise(nearest)
        )

    return let(value.cast("double"), shifted) / scale
