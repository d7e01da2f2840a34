"""Unit names: normalisation, rates, conversion, plausible limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import squeeze

# Canonical unit -> (other spellings, largest plausible magnitude).
UNITS: dict[str, tuple[tuple[str, ...], float]] = {
    "°C": (("°c", "c", "degc", "deg c", "celsius", "degrees celsius", "° c"), 60),
    "K": (("k", "kelvin"), 350),
    "°F": (("°f", "f", "degf", "fahrenheit"), 140),
    "%": (("percent", "pct"), 100),
    "mm": (("millimetre", "millimeter", "millimetres", "millimeters"), 20_000),
    "cm": (("centimetre", "centimeter"), 2_000),
    "in": (("inch", "inches"), 800),
    "km/h": (("kmh", "km h-1", "kph", "km/hr"), 300),
    "m/s": (("ms-1", "m s-1", "m/sec", "mps"), 85),
    "kn": (("knot", "knots", "kt"), 165),
    "mph": ((), 190),
    "hPa": (("hpa", "mbar", "mb", "millibar"), 1_100),
    "Pa": (("pa",), 110_000),
    "kPa": (("kpa",), 110),
    "hours": (("h", "hr", "hrs", "hour"), 100_000),
    "days": (("d", "day"), 5_000),
}

# Words that may follow "/" or " per " in a rate.
RATE_PERIODS = ("h", "hr", "hour", "day", "d", "week", "month", "year", "yr", "a", "decade")

# Unit -> (dimension, offset added before, factor to the base unit).
CONVERSIONS: dict[str, tuple[str, float, float]] = {
    "°C": ("temperature", 0.0, 1.0),
    "K": ("temperature", -273.15, 1.0),
    "°F": ("temperature", -32.0, 5 / 9),
    "m/s": ("speed", 0.0, 1.0),
    "km/h": ("speed", 0.0, 1 / 3.6),
    "kn": ("speed", 0.0, 0.514444),
    "mph": ("speed", 0.0, 0.44704),
    "mm": ("length", 0.0, 1.0),
    "cm": ("length", 0.0, 10.0),
    "in": ("length", 0.0, 25.4),
    "hPa": ("pressure", 0.0, 1.0),
    "Pa": ("pressure", 0.0, 0.01),
    "kPa": ("pressure", 0.0, 10.0),
    "%": ("percent", 0.0, 1.0),
}

# Hours and days label counts here and are never rescaled.
COUNT_UNITS = ("hours", "days")
COUNT_WORDS = (
    "records", "record", "hourly records", "count", "counts", "observations", "observation", "rows",
    "row", "entries", "entry", "values", "data points", "datapoints", "samples", "measurements",
    "occurrences",
)


def _aliases() -> dict[str, str]:
    return {a: unit for unit, (names, _) in UNITS.items() for a in (unit.lower(), *names)}


def _lookup(table: dict, key: Column) -> Column:
    """Value of a key in a fixed table.

    The table is one text literal that the optimizer folds into a constant map, which keeps the
    expression small wherever it is used.
    """
    pairs = ";".join(f"{k}={v!r}" if isinstance(v, float) else f"{k}={v}" for k, v in table.items())
    kind = "double" if all(isinstance(v, float) for v in table.values()) else "string"
    constant = F.str_to_map(F.lit(pairs), F.lit(";"), F.lit("=")).cast(f"map<string,{kind}>")
    return F.try_element_at(constant, key)


def alias_table(spark: SparkSession) -> DataFrame:
    """(alias, canonical, plausible_max): a fixed dimension of about sixty rows."""
    pairs = ";".join(f"{a}={u}" for a, u in _aliases().items())
    rows = spark.range(1).select(F.explode(F.str_to_map(F.lit(pairs), F.lit(";"), F.lit("="))).alias("alias", "canonical"))
    return rows.withColumn("plausible_max", plausible_limit(F.col("canonical")))


def unit_alias_join(df: DataFrame, unit: str = "unit") -> DataFrame:
    """Add ``canonical`` and ``plausible_max`` by joining the alias dimension.

    The dimension has a fixed size (a constant of this module), so broadcasting it is safe.
    """
    aliases = F.broadcast(alias_table(df.sparkSession))
    keyed = df.withColumn("_alias", squeeze(F.col(unit)))
    return keyed.join(aliases, keyed["_alias"] == aliases["alias"], "left").drop("_alias", "alias")


def _rate(text: Column, separator: str) -> Column:
    head = F.substring_index(text, separator, 1)
    tail = F.trim(F.substring(text, F.length(head) + len(separator) + 1, F.length(text)))
    base = _lookup(_aliases(), F.trim(head))
    return F.when(
        text.contains(separator) & base.isNotNull() & tail.isin(*RATE_PERIODS),
        F.concat(base, F.lit("/"), tail),
    )


def normalize_unit(unit: Column) -> Column:
    """STRUCT<canonical STRING, is_rate BOOLEAN>; an unknown unit gives (NULL, false)."""
    text = squeeze(unit)
    plain = _lookup(_aliases(), text)
    rate = F.coalesce(_rate(text, "/"), _rate(text, " per "))
    return F.struct(
        F.coalesce(plain, rate).alias("canonical"),
        (plain.isNull() & rate.isNotNull()).alias("is_rate"),
    )


def canonical_unit(unit: Column) -> Column:
    return normalize_unit(unit)["canonical"]


def plausible_limit(canonical: Column) -> Column:
    """Largest plausible magnitude of a canonical unit, NULL for rates and unknown units."""
    return _lookup({u: float(limit) for u, (_, limit) in UNITS.items()}, canonical)


def convert_canonical(value: Column, source: Column, target: Column) -> Column:
    """Convert between canonical units; NULL when they do not share a dimension."""
    dimension = {u: d for u, (d, _, _) in CONVERSIONS.items()}
    offset = {u: o for u, (_, o, _) in CONVERSIONS.items()}
    factor = {u: f for u, (_, _, f) in CONVERSIONS.items()}
    base = (value + _lookup(offset, source)) * _lookup(factor, source)
    converted = base / _lookup(factor, target) - _lookup(offset, target)
    return F.when(source == target, value).when(
        _lookup(dimension, source) == _lookup(dimension, target), converted
    )


def convert_unit(value: Column, source: Column, target: Column) -> Column:
    """Convert between two units given in any spelling."""
    return convert_canonical(value, canonical_unit(source), canonical_unit(target))


# Conversions the catalogue applies to a finished aggregate.
SERIES_CONVERSIONS = {
    ("km/h", "m/s"): lambda x: x / 3.6,
    ("°C", "K"): lambda x: x + 273.15,
    ("°C", "°F"): lambda x: x * 9 / 5 + 32,
    ("hPa", "Pa"): lambda x: x * 100,
    ("mm", "cm"): lambda x: x / 10,
}


def convert_result(value: Column, recorded: str, wanted: str | None) -> Column:
    """Convert an aggregate from the unit the series is recorded in to the one asked for."""
    if wanted is None or wanted == recorded:
        return value
    return SERIES_CONVERSIONS[(recorded, wanted)](value)
