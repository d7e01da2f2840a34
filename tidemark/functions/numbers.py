"""Number functions: parsing, literals as written, general number formatting, answer keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import canonical_text, strip

# Fixed value: a number literal in text.
NUMBER = r"-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"


def parse_number(c: Column) -> Column:
    """A text that is entirely one number (thousands commas allowed) as DOUBLE, else NULL."""
    text = F.regexp_replace(strip(c.cast("string")), ",", "")
    return F.when(text.rlike(rf"^{NUMBER}\z"), text.try_cast("double"))


def extract_numbers(c: Column) -> Column:
    """Every number literal of a text, in order, as ARRAY<DOUBLE>."""
    found = F.regexp_extract_all(c, F.lit(f"({NUMBER})"), F.lit(1))
    return F.transform(found, lambda x: x.try_cast("double"))


def literal_decimals(literal: Column) -> Column:
    """Decimal places as written; NULL for exponent notation (and for true/false)."""
    return F.when(F.lower(literal).contains("e"), F.lit(None).cast("int")).otherwise(
        F.when(literal.contains("."), F.length(F.split_part(literal, F.lit("."), F.lit(2)))).otherwise(0)
    )


# A JSON string, or a number outside of one.
_TOKEN = r'("(?:[^"\\]|\\.)*+")|(-?\d[\d.eE+-]*)'


def submitted_literal(raw_arguments: Column, value: Column) -> Column:
    """The top-level ``value`` of the raw JSON exactly as written, so 11.10 keeps two decimals.

    JSON functions normalise numbers, so numbers are turned into strings first.  Of repeated keys the last
    one counts, whatever its type; keys of nested objects do not.  ``value`` is the fallback when the key is
    absent, holds a list or an object, or the text is no JSON object.
    """
    # A mark before and after each number, and none around strings; then the marks become quotes.
    marked = F.replace(F.regexp_replace(raw_arguments, _TOKEN, "$1\u0001$2\u0001"), F.lit("\u0001\u0001"), F.lit(""))
    literal = F.from_json(F.translate(marked, "\u0001", '"'), "value string")["value"]
    checked = F.from_json(raw_arguments, "value string, broken string", {"columnNameOfCorruptRecord": "broken"})
    whole = checked["broken"].isNull() & strip(raw_arguments).endswith("}")
    nested = literal.rlike(r"^[\[{]") & raw_arguments.rlike(r'"value"\s*:\s*[\[{]')
    return F.coalesce(F.when(whole & ~nested, literal), value.cast("string"))


def _lower_exponent(sci: Column) -> Column:
    return F.replace(F.lower(sci), F.lit("infinity"), F.lit("inf"))


def general_format(x: Column, digits: int) -> Column:
    """``%g`` style: ``digits`` significant digits, trailing zeros dropped, exponent if needed."""
    x = x.cast("double")
    # Nine decimals that fit into the wanted digits are the answer already; formatting is slow.
    short = F.round(x, 9).cast("string")
    is_short = F.abs(x).between(1e-3, 9e5) & (F.length(short) <= digits + 1)
    sci = F.format_string(f"%.{digits - 1}e", x)
    rounded = sci.try_cast("double")
    plain = F.regexp_replace(rounded.try_cast("decimal(38,12)").cast("string"), r"\.?0+\z", "")
    in_plain_range = F.abs(rounded).between(1e-4, float(10**digits) * (1 - 1e-15)) | (rounded == 0)
    return (
        F.when(is_short, F.regexp_replace(short, r"\.0\z", ""))
        .when(in_plain_range, plain)
        .otherwise(_lower_exponent(F.regexp_replace(sci, r"\.?0+e", "e")))
    )


def float_text(x: Column) -> Column:
    """Shortest text of a double with at least one decimal; exponent only from 1e16 or below 1e-4."""
    text = x.cast("string")
    plain = F.regexp_replace(x.try_cast("decimal(38,21)").cast("string"), r"(\.\d+?)0+\z", "$1")
    padded = F.regexp_replace(F.regexp_replace(text, r"E(?=\d)", "E+"), r"(?<=E[+-])(\d)\z", "0$1")
    scientific = _lower_exponent(F.regexp_replace(padded, r"(\.0)?E", "e"))
    in_plain_range = (F.abs(x) >= 1e-4) & (F.abs(x) < 1e16)
    # Almost every number is already printed the wanted way.
    as_printed = ((F.abs(x) >= 1e-3) & (F.abs(x) < 1e7)) | (x == 0)
    return F.when(as_printed, text).when(in_plain_range, plain).otherwise(scientific)


def number_key(x: Column, tolerance: Column) -> Column:
    """The number on the tolerance grid, as a text of six significant digits.

    ``rint`` is half-even, like the rounding this reproduces.
    """
    step = F.when(tolerance > 0, tolerance).otherwise(F.lit(1e-9))
    return general_format(F.rint(x / step) * step + F.lit(0.0), 6)


def answer_key(got_number: Column, got_text: Column, tolerance: Column) -> Column:
    """Comparable form of an answer: numbers on the tolerance grid, texts canonical."""
    return F.when(got_number.isNotNull(), number_key(got_number, tolerance)).otherwise(
        canonical_text(got_text)
    )
